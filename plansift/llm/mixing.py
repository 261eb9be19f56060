"""Operator 9: mixing sources to target weights by Poisson replication (native).

A source of n rows with weight w in a table of N rows has the repetition rate
N * w / n. Each document draws its number of copies by inverting the Poisson
distribution of that rate at a uniform number hashed from seed and id, so a
rerun or a lost executor gives the same copies. Copies are dealt to partitions
by a second hash and sorted by it there. That is the only shuffle of the texts:
the table of sources is written once and, up to BROADCAST_ROWS sources, sent to
all tasks; beyond that Spark joins it by shuffle and splits hot sources.

Weights come from ``targets`` or, by default, from the sources' sizes raised to
``power`` (temperature sampling). They are normalised to sum to one over the
sources present; a source without a target gets none. A null source is a source
of its own. Rows that share an id draw the same count; a null id draws as 'null'.
An empty table gives no rows; texts, also empty and very long ones, are carried
whole and never read. The columns of the input come back inside ``row``, so none
of them clashes with the operator's own.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plansift.llm.common import bounded, md5_unit, written

POWER = 0.5
SEED = "mix-1"


def poisson_table(rate: Column) -> Column:
    """Cumulative Poisson probabilities 0, 1, 2, ... of a rate, far enough that the rest is below double precision."""
    last = F.ceil(rate + 12 * F.sqrt(rate) + 30).cast("int")
    start = F.struct(F.exp(-rate).alias("p"), F.array(F.exp(-rate)).alias("cdf"))

    def step(acc: Column, k: Column) -> Column:
        p = acc["p"] * rate / k
        return F.struct(p.alias("p"), F.concat(acc["cdf"], F.array(F.element_at(acc["cdf"], -1) + p)).alias("cdf"))

    return F.aggregate(F.sequence(F.lit(1), last), start, step, lambda acc: acc["cdf"])


def rates(docs: DataFrame, targets: DataFrame | None = None, power: float = POWER) -> DataFrame:
    """(of, rate) per source; ``targets`` has columns source and weight."""
    sizes = docs.groupBy(F.col("source").alias("of")).agg(F.count(F.lit(1)).alias("n"))
    if targets is None:
        weighted = sizes.withColumn("w", F.pow(F.col("n").cast("double"), F.lit(power)))
    else:
        goal = targets.select(F.col("source").alias("goal"), F.col("weight").cast("double").alias("w"))
        weighted = sizes.join(goal, F.col("of").eqNullSafe(F.col("goal"))).drop("goal")
    total = weighted.agg(F.sum("w").alias("all_w"))
    rows = sizes.agg(F.sum("n").alias("all_n"))
    one_row = F.broadcast(total.crossJoin(F.broadcast(rows)))
    return weighted.crossJoin(one_row).select("of", (F.col("all_n") * (F.col("w") / F.col("all_w")) / F.col("n")).alias("rate"))


def mix(docs: DataFrame, targets: DataFrame | None = None, power: float = POWER, seed: str = SEED) -> DataFrame:
    """``row`` (all columns of a document), copy (from 0), n_copies and shuffle_key, in shuffled order."""
    # a rate above 700 would underflow exp(); it is split into equal parts that are drawn one by one
    table = bounded(written(rates(docs, targets, power).select(
        "of", F.greatest(F.ceil(F.col("rate") / 500.0), F.lit(1)).cast("int").alias("parts"), "rate",
    ).select("of", "parts", poisson_table(F.col("rate") / F.col("parts")).alias("cdf"))))
    drawn = docs.select(F.struct("*").alias("row"), "source", "doc_id").join(
        table, F.col("source").eqNullSafe(F.col("of"))).withColumn("n_copies", F.aggregate(
            F.sequence(F.lit(1), F.col("parts")), F.lit(0),
            lambda acc, part: acc + F.size(F.filter("cdf", lambda c: c <= md5_unit(seed, F.col("doc_id"), part)))))
    copies = drawn.filter("n_copies > 0").select(
        "row", "doc_id", F.col("n_copies").cast("long").alias("n_copies"),
        F.explode(F.sequence(F.lit(0), F.col("n_copies") - 1)).alias("copy"))
    keyed = copies.select("row", F.col("copy").cast("long").alias("copy"), "n_copies", F.md5(F.concat_ws(
        ":", F.lit(seed + "-order"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), "copy")).alias("shuffle_key"))
    return keyed.repartition("shuffle_key").sortWithinPartitions("shuffle_key")


def expected_copies(rate: float) -> float:
    """Mean of the table's distribution; used by the tests."""
    p, cum, mean = math.exp(-rate), 0.0, 0.0
    for k in range(int(math.ceil(rate + 12 * math.sqrt(rate) + 30)) + 1):
        if k:
            p = p * rate / k
        cum, mean = cum + p, mean + k * p
    return mean
