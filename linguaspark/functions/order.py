"""The one order type of entries: where a row stands in its catalog or glossary.

An order is an array of steps ``(side, major, minor)`` compared step by step.
Readers give one step (a document position is text, a line or row number a
bigint). A merge of two tables puts one step before what each side has, its
side number, so the sides never mix, whatever they are numbered by, and may
be merged again and again: nothing is renumbered, no pass over the other side
is needed, and nothing is turned into text. Orders of one table compare at
their first unequal step; rows that went through different merges differ in
a side before their steps run out.

``positions`` turns orders into dense numbers where a plain number is wanted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

STEP = T.StructType([T.StructField("side", T.IntegerType()), T.StructField("major", T.StringType()),
                     T.StructField("minor", T.LongType())])
ORDER = T.ArrayType(STEP)


def step(side: int = 0, major: Column | None = None, minor: Column | None = None) -> Column:
    return F.struct(F.lit(side).cast("int").alias("side"), (F.lit("") if major is None else major).alias("major"),
                    (F.lit(0) if minor is None else minor).cast("bigint").alias("minor"))


def is_order(dtype: T.DataType) -> bool:
    return dtype.simpleString() == ORDER.simpleString()


def as_order(col: Column, dtype: T.DataType) -> Column:
    """An order from a position of another type: whole numbers, text, or structs of these field by field."""
    if is_order(dtype):
        return col
    if isinstance(dtype, T.StructType):
        return F.concat(*[as_order(col[f.name], f.dataType) for f in dtype.fields])
    if isinstance(dtype, T.StringType):
        return F.array(step(major=col))
    if isinstance(dtype, T.IntegralType):
        return F.array(step(minor=col))
    raise TypeError(f"rows cannot be ordered by a {dtype.simpleString()}")


def on_side(df: DataFrame, col: str, side: int) -> Column:
    """The order of ``df`` in a merge where its rows are side ``side``."""
    return F.concat(F.array(step(side)), as_order(F.col(col), df.schema[col].dataType))


def positions(df: DataFrame, group_cols: list[str], order_col: str = "ord", out: str = "pos") -> DataFrame:
    """1-based dense positions by order within each group, a hot group spread over many tasks."""
    from ..operators.windows import row_numbers
    return row_numbers(df, group_cols, order_col, out=out)
