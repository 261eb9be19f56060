"""Operator 10: sharding by proportional stratified interleaving (native).

Rows are ranked in seeded-hash order within their source; sorting by fractional
rank (rank - 1/2) / source size interleaves the sources in proportion; cutting
the order into equal runs gives shards of the mixture whose row counts differ
by one at most (law ``rows``).

No rank sorts a whole source or the whole table in one task: rows are counted
in buckets of the sort key first, and only ranked within a bucket; offsets of
buckets are sums over a small table. Only ids, sizes and hashes are shuffled,
never texts.

Defined results: null text has no bytes (size 16, crc32 of the empty string); a
null source is a source of its own; rows that are equal in id and text are
interchangeable, each gets a slot of its own; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SHARDS = 40
SEED = 23
#: Buckets of a sort key: a bucket holds 1/4096 of a source or of the table.
BUCKETS = 4096
ROW_BYTES = 16


def _numbered(rows: DataFrame, groups: list[str], bucket: str, order: list[str], name: str) -> DataFrame:
    """``rows`` with ``name`` = position from 0 in its group by (bucket, order) and ``name``_of = group size."""
    keys = [*groups, bucket]
    counts = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    in_order = Window.partitionBy(*(groups or [F.lit(0)]))
    offsets = counts.select(
        *[F.col(k).alias(f"_{k}") for k in keys],
        (F.sum("_n").over(in_order.orderBy(bucket)) - F.col("_n")).alias("_before"),
        F.sum("_n").over(in_order).alias(f"{name}_of"))
    match = None
    for k in keys:
        same = F.col(k).eqNullSafe(F.col(f"_{k}"))
        match = same if match is None else match & same
    joined = rows.join(offsets, match)
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1
    return joined.withColumn(name, F.col("_before") + rank).drop("_before", *[f"_{k}" for k in keys])


def shard(docs: DataFrame, shards: int = SHARDS, seed: int = SEED, buckets: int = BUCKETS) -> DataFrame:
    """doc_id, source, size, text_crc32, law, shard, slot, grown_shard for every row of ``docs``."""
    text = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    crc = F.crc32(text).alias("text_crc32")
    rows = docs.select("doc_id", "source", (F.length(text).cast("long") + ROW_BYTES).alias("size"), crc)
    # the top bits of the hash give the bucket, the whole hash the order in it
    drawn = rows.withColumn("h", F.xxhash64(F.lit(seed), "doc_id", "text_crc32")).withColumn(
        "b", F.floor((F.shiftrightunsigned("h", 11) / float(1 << 53)) * buckets)).withColumn("u", F.shiftrightunsigned("h", 1))
    tail = ["doc_id", "text_crc32", "size"]
    ranked = _numbered(drawn, ["source"], "b", ["u", *tail], "rank")
    placed = ranked.withColumn("f", (F.col("rank") + 0.5) / F.col("rank_of")).withColumn("fb", F.floor(F.col("f") * buckets))
    ordered = _numbered(placed, [], "fb", ["f", "u", "source", *tail], "pos")
    cut = ordered.withColumn("shard", F.expr(f"(pos * {shards}) div pos_of"))
    # the first position of shard s is ceil(s * N / shards)
    first = F.expr(f"(shard * pos_of + {shards - 1}) div {shards}")
    return cut.select(
        "doc_id", "source", "size", "text_crc32", F.lit("rows").alias("law"), F.col("shard").cast("int").alias("shard"),
        (F.col("pos") - first).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
