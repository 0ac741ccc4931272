"""Hot groups: one catalog with a third of all rows, one key repeated thousands of times."""

from pyspark.sql import functions as F

from linguaspark.operators import catalog as C
from linguaspark.operators import usage as U
from linguaspark.operators.windows import row_numbers
from helpers import rows


def skewed(spark, n=30000, lang="en"):
    ids = spark.range(n)
    catalog = F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.concat(F.lit("c"), (F.col("id") % 50).cast("string")))
    key = F.when(F.col("id") % 10 == 0, F.lit("hot.key")).otherwise(F.concat(F.lit("k"), F.col("id").cast("string")))
    return ids.select(catalog.alias("catalog"), F.lit(lang).alias("lang"), key.alias("key"),
                      F.concat(F.lit("v"), F.col("id").cast("string")).alias("value"), F.col("id").alias("ord"))


def test_last_wins_hot_key_partial_aggregation(spark):
    e = skewed(spark)
    out = C.last_wins(e)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "partial_max_by" in plan  # combined map-side before the shuffle
    hot = {(r.catalog, r.value) for r in out.where(F.col("key") == "hot.key").collect()}
    want = {}
    for i in range(0, 30000, 10):
        c = "hot" if i % 3 == 0 else f"c{i % 50}"
        want[c] = max(want.get(c, -1), i)
    assert hot == {(c, f"v{i}") for c, i in want.items()}


def test_coverage_with_hot_catalog(spark):
    src = skewed(spark)
    tgt = skewed(spark, lang="ja").where(F.col("ord") % 4 != 0)
    cov = {r.catalog: r for r in C.coverage(src, tgt, ["ja"]).collect()}
    total = sum(r.n_source for r in cov.values())
    assert total == 30000
    assert cov["hot"].n_source == 10000
    assert sum(r.n_missing + r.n_outdated + r.n_same for r in cov.values()) == total


def test_row_numbers_spread_hot_group(spark):
    e = skewed(spark)
    r = row_numbers(e, ["catalog", "lang"], "ord", num_partitions=16)
    spread = (e.repartitionByRange(16, "catalog", "lang", "ord").where(F.col("catalog") == "hot")
              .select(F.spark_partition_id().alias("p")).distinct().count())
    assert spread > 1
    hot = r.where(F.col("catalog") == "hot").select("ord", "rn").orderBy("ord").collect()
    assert [x.rn for x in hot] == list(range(1, 10001))


def test_substring_join_hot_gram(spark):
    lines = spark.range(5000).select(F.concat(F.lit("const a = t('part."), F.col("id").cast("string"),
                                              F.lit(".name')")).alias("text"), F.col("id"))
    needles = spark.createDataFrame([("part.",), ("part.42.name",), ("nam",), ("zz",)], "needle string")
    got = {r.needle: r.n for r in U.substring_join(needles, lines).groupBy("needle").agg(F.count("*").alias("n")).collect()}
    assert got == {"part.": 5000, "part.42.name": 1, "nam": 5000}
    assert rows(U.substring_join(needles, lines).where(F.col("needle") == "part.42.name"), "id") == [(42,)]
