"""Row numbers inside big groups without sorting a group in one task."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def number_rows(rows: DataFrame, keys: list[str], buckets: list[str], order: list[str], name: str) -> DataFrame:
    """``rows`` with ``name`` = position from 1 within ``keys`` by (buckets, order).

    Rows are counted per bucket; a bucket's offset is a sum over the small table
    of counts, and only the rows of one bucket are sorted together. ``buckets``
    must be far fewer than rows and small enough to sort. Rows that come
    partitioned by some of these columns are ranked where they are, before the join.
    """
    parts = [*keys, *buckets]
    counts = rows.groupBy(*parts).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*keys).orderBy(*buckets).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*[F.col(p).alias(f"_{p}") for p in parts], F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = F.row_number().over(Window.partitionBy(*parts).orderBy(*order))
    joined = rows.withColumn("_inside", inside).join(offsets, reduce(and_, [F.col(p).eqNullSafe(F.col(f"_{p}")) for p in parts]))
    return joined.withColumn(name, (F.col("_before") + F.col("_inside")).cast("long")).drop("_before", "_inside", *[f"_{p}" for p in parts])


def with_range_bucket(rows: DataFrame, keys: list[str], column: str, buckets: int = 256, name: str = "_bucket") -> DataFrame:
    """``rows`` with ``name``: the part of its group's value range that a number lies in."""
    bounds = rows.groupBy(*keys).agg(F.min(column).alias("_lo"), F.max(column).alias("_hi"))
    share = (F.col(column) - F.col("_lo")) / F.greatest(F.col("_hi") - F.col("_lo"), F.lit(1))
    bounds = bounds.select(*[F.col(k).alias(f"_{k}") for k in keys], "_lo", "_hi")
    joined = rows.join(bounds, reduce(and_, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]))
    return joined.withColumn(name, F.floor(share * (buckets - 1)).cast("int")).drop("_lo", "_hi", *[f"_{k}" for k in keys])


def number_by(rows: DataFrame, keys: list[str], column: str, name: str) -> DataFrame:
    """``rows`` with ``name`` = position from 1 within ``keys`` by one number column."""
    return number_rows(with_range_bucket(rows, keys, column), keys, ["_bucket"], [column], name).drop("_bucket")
