"""Helpers shared by the corpus operators: tables, written stages, hashes, components."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plansift.operators.components import star_components
from plansift.session import checkpoint_folder

#: White space that separates words: the space and 0x09 to 0x0D, nothing else.
SPACES = " \t\n\x0b\f\r"
SPACE_RUN = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame) -> DataFrame:
    """``df`` as a compressed table in the shared checkpoint folder, read again.

    Cuts the lineage; the files outlive lost executors. The folder is a new one
    for each call and stays until the checkpoint folder is cleared, because the
    returned frame is read lazily.
    """
    path = f"{checkpoint_folder(df.sparkSession)}/stage-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows of a side that may be broadcast: a few names and numbers each, some 10 MB.
BROADCAST_ROWS = 100_000


def bounded(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` marked for broadcast if it has at most ``rows`` short rows; beyond that Spark joins by shuffle."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once per row, also where a lambda uses it again and again."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words(text: Column) -> Column:
    """Words of a text as an array; null and blank texts have none."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACES))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACE_RUN, -1))


def md5_unit(*parts: Column | str) -> Column:
    """A reproducible number in (0, 1) from the md5 of the parts: 52 bits, so exact in a double."""
    text = F.concat_ws(":", *[F.coalesce(p.cast("string"), F.lit("null")) if isinstance(p, Column) else F.lit(p) for p in parts])
    return (F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, comp) for every id in a link; comp is the smallest id reachable."""
    found = star_components(links.select(F.lit(0).alias("one"), F.col(a).alias("a"), F.col(b).alias("b")), "one")
    low = found.select(F.col("comp").alias("id"), "comp").distinct()
    return found.select("id", "comp").unionByName(low).distinct()


def group_by_checked(df: DataFrame, needed: set[str]) -> DataFrame:
    """Only the columns an operator works on, so that others never clash with its own names."""
    missing = needed - set(df.columns)
    if missing:
        raise ValueError(f"missing columns: {sorted(missing)}")
    return df.select(*sorted(needed))
