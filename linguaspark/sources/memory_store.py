"""The translation-memory table: Parquet partitioned by ``lang``.

Keyed writes rewrite only the languages present in the new rows (dynamic
partition overwrite). The merged result is checkpointed first, so the
overwrite never reads the files it is replacing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.memory import keep_first, upsert_latest
from ..schemas import TM
from ..session import cut_lineage, path_exists


def read_memory(spark: SparkSession, path: str, langs: list[str] | None = None) -> DataFrame:
    """The TM table; a language filter prunes partitions."""
    if not path_exists(spark, path):
        return spark.createDataFrame([], TM)
    df = spark.read.schema(TM).parquet(path)
    return df.where(F.col("lang").isin(langs)) if langs else df


def write_memory(rows: DataFrame, path: str, mode: str = "upsert") -> None:
    """Write TM rows.

    ``upsert`` (S13): per id the highest ``seq`` wins over old and new rows;
    ``keep`` (S15): the first write of an id is kept; ``append`` (S14): every
    row is added, no key.
    """
    spark = rows.sparkSession
    new = rows.select(*[F.col(f.name).cast(f.dataType) for f in TM.fields])
    if mode == "append" or not path_exists(spark, path):
        merged = new if mode == "append" else (keep_first(new) if mode == "keep" else upsert_latest(new))
        merged.select(*TM.fieldNames()).write.mode("append").partitionBy("lang").parquet(path)
        return
    # one value per partition folder that is about to be replaced; as literals they prune the old table's scan
    langs = [r["lang"] for r in new.select("lang").distinct().collect()]
    named = F.col("lang").isin([x for x in langs if x is not None])
    old = read_memory(spark, path).where(named | F.col("lang").isNull() if None in langs else named)
    both = old.unionByName(new)
    merged = keep_first(both) if mode == "keep" else upsert_latest(both)
    merged = cut_lineage(merged.select(*TM.fieldNames()))
    (merged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("lang").parquet(path))
