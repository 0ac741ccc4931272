"""Skew-safe row numbering (W5 batch numbers).

A plain ``row_number() over (partition by catalog order by ord)`` sends a
whole catalog to one task. Here rows are range-partitioned on
``(group, order)`` so a hot group spreads over many tasks; each task's share
of a group is numbered locally and shifted by the counts of the earlier
tasks (a tiny per-task aggregate), as ``zipWithIndex`` does.

Range bounds are sampled anew whenever the exchange is planned anew, so the
locally numbered rows are written once and the counts are taken from that
table: both sides then agree on which task a row was in.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage


def row_numbers(df: DataFrame, group_cols: list[str], order_col: str,
                out: str = "rn", num_partitions: int | None = None) -> DataFrame:
    """1-based position of each row inside its group by ``order_col`` (ties broken arbitrarily).

    Null group values are a group like any other.
    """
    spark = df.sparkSession
    n = num_partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    w_loc = Window.partitionBy("_pid", *group_cols).orderBy(order_col)
    local = cut_lineage(df.repartitionByRange(n, *group_cols, order_col)
                        .withColumn("_pid", F.spark_partition_id())
                        .withColumn("_loc", F.row_number().over(w_loc)), "numbered")
    counts = local.groupBy("_pid", *group_cols).agg(F.max("_loc").alias("_n"))
    w_off = Window.partitionBy(*group_cols).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(F.col("_pid").alias("_p"), *[F.col(c).alias(f"_g{i}") for i, c in enumerate(group_cols)],
                            F.coalesce(F.sum("_n").over(w_off), F.lit(0)).alias("_off"))
    same = reduce(and_, [local[c].eqNullSafe(offsets[f"_g{i}"]) for i, c in enumerate(group_cols)],
                  local["_pid"] == offsets["_p"])
    return (local.join(offsets, same, "left")
            .withColumn(out, (F.col("_off") + F.col("_loc")).cast("bigint"))
            .drop("_pid", "_loc", "_off", "_p", *[f"_g{i}" for i in range(len(group_cols))]))


def batch_numbers(df: DataFrame, group_cols: list[str], order_col: str, size: int,
                  out: str = "batch_id") -> DataFrame:
    """``floor((row_number - 1) / size) + 1`` per group."""
    r = row_numbers(df, group_cols, order_col, out="_rn")
    return r.withColumn(out, (F.floor((F.col("_rn") - 1) / F.lit(size)) + 1).cast("bigint")).drop("_rn")
