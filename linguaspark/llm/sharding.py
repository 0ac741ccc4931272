"""Sharding by a two-pass external shuffle, in DataFrame operations only.

Pass one scatters the records uniformly into buckets by seeded hashes; a
bucket is sized to fit a task's memory. Pass two brings each bucket into one
task, permutes it by a seeded Fisher-Yates shuffle (Spark's ``shuffle``
function) and lays the buckets of a shard end to end.

The shard follows the ``key`` law: only the id and the number of shards
decide. Each (id, shard) pair has a hash, and the shard with the greatest
one wins, so one more shard takes rows only into itself. A shard has as many
buckets as its counted bytes need; the bucket comes from another hash over all
columns, so many rows of one id spread over the buckets of their shard. Rows
equal in every column that fill a good part of a bucket (counted) are spread
by their place in the input instead, as nothing else tells them apart.

Defined cases: a null id is an id like any other; a null or empty text is
a record of size 1 (UTF-8 bytes plus 1); repeated rows are records of their
own; an empty table gives an empty result; other columns travel with their
record and never clash, as only ``shard``, ``grown_shard``, ``bucket`` and
``slot`` are added (input columns so named are replaced).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linguaspark.llm.common import cut_lineage, pick

BUCKET_BYTES = 64 * 1024 * 1024


def shard_of(key: Column, n: int, seed: int) -> Column:
    """The shard in 0..n-1 whose seeded hash with the key is greatest."""
    best = F.greatest(*[F.struct(F.xxhash64(F.lit(seed), F.lit(s), key).alias("h"), F.lit(s).alias("s"))
                        for s in range(n)]) if n > 1 else F.struct(F.lit(0).alias("s"))
    return best["s"].cast("int")


def record_size(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1


def shuffle_shards(df: DataFrame, n_shards: int, key: str = "doc_id", text: str = "text", seed: int = 17,
                   bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """All rows of ``df`` (unless it has clashing names, all columns) with their place in the shuffled shards.

    Adds ``shard``, ``grown_shard`` (the shard if there were one more),
    ``bucket`` and ``slot`` (0, 1, ... within the shard). The records are
    held in memory a bucket at a time: about ``bucket_bytes`` of text. The
    table of buckets (24 bytes for each ``bucket_bytes`` of input) is joined
    to the shuffled buckets as a broadcast, 24 MB for 64 TB at the default.
    """
    added = {"shard", "grown_shard", "bucket", "slot"}
    lower, kept = set(), []
    for c in df.columns:
        if c.lower() not in added and c.lower() not in lower:
            lower.add(c.lower())
            kept.append(c)
    src = pick(df, **{f"r{i}": c for i, c in enumerate(kept)}, key=key, text=text)

    # bytes of each shard, and of rows that are equal in all that can be hashed
    hashable = [f"r{i}" for i in range(len(kept)) if not any(x in src.schema[f"r{i}"].dataType.simpleString() for x in ("map<", "variant"))]
    src = src.select(shard_of(F.col("key"), n_shards, seed).alias("shard"), shard_of(F.col("key"), n_shards + 1, seed).alias("grown_shard"),
                     F.xxhash64(F.lit(seed + 1), "key", "text", *hashable).alias("h"), record_size(F.col("text")).alias("size"),
                     *[f"r{i}" for i in range(len(kept))])
    sized = cut_lineage(src.groupBy("shard", "h").agg(F.sum("size").alias("b"), F.count(F.lit(1)).alias("n")), "shard-sizes")
    n_buckets = [1] * n_shards
    for r in sized.groupBy("shard").agg(F.sum("b").alias("b")).collect():  # at most n_shards rows
        n_buckets[r["shard"]] = max(1, math.ceil(r["b"] / bucket_bytes))
    first_bucket = [sum(n_buckets[:i]) for i in range(n_shards)]
    hot = sized.where((F.col("n") > 1) & (F.col("b") > bucket_bytes / 4)).select(F.col("shard").alias("hs"), F.col("h").alias("hh"))  # at most 4 a bucket

    # pass one: scatter. The bucket number is the partition number, so a task holds one bucket.
    own = F.element_at(F.array(*[F.struct(F.lit(n).alias("n"), F.lit(f).alias("first")) for n, f in zip(n_buckets, first_bucket, strict=True)]),
                       F.col("shard") + 1)
    placed = src.withColumn("row", F.monotonically_increasing_id()).join(
        F.broadcast(hot), (F.col("shard") == F.col("hs")) & (F.col("h") == F.col("hh")), "left")
    spread = F.when(F.col("hh").isNull(), F.col("h")).otherwise(F.xxhash64("h", "row"))
    placed = placed.withColumn("own", own).select(
        "shard", "grown_shard", "h", (F.col("own.first") + F.pmod(spread, F.col("own.n")).cast("int")).alias("bucket"),
        *[f"r{i}" for i in range(len(kept))])
    counts = placed.groupBy("shard", "bucket").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = cut_lineage(counts.select("bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first")),
                         "shard-buckets")

    # pass two: permute each bucket
    record = F.struct("shard", "grown_shard", *[f"r{i}" for i in range(len(kept))])
    shuffled = (placed.select("bucket", F.xxhash64(F.lit(seed + 2), "h").alias("o"), record.alias("r"))
                .repartitionById(sum(n_buckets), F.col("bucket"))
                .groupBy("bucket")
                .agg(F.shuffle(F.array_sort(F.collect_list(F.struct("o", "r")), _by_hash), seed).alias("rows")))
    out = (shuffled.join(F.broadcast(starts), "bucket")
           .select("bucket", "first", F.posexplode("rows").alias("at", "x")))
    return out.select(*[F.col(f"x.r.r{i}").alias(c) for i, c in enumerate(kept)],
                      F.col("x.r.shard").alias("shard"), F.col("x.r.grown_shard").alias("grown_shard"), "bucket",
                      (F.col("first") + F.col("at")).alias("slot"))


def _by_hash(a: Column, b: Column) -> Column:
    return F.when(a["o"] < b["o"], -1).when(a["o"] > b["o"], 1).otherwise(0)


def write_shards(df: DataFrame, path: str, n_shards: int, **options) -> DataFrame:
    """Shuffle and write: a folder per shard, in it one file per bucket, rows in slot order.

    Returns the written table. The files are written in the tasks that
    permuted them, without another shuffle.
    """
    shuffle_shards(df, n_shards, **options).write.mode("overwrite").partitionBy("shard").parquet(path)
    return df.sparkSession.read.parquet(path)
