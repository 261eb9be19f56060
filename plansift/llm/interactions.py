"""Operator 12: what filters remove, alone and in every order.

Each row is reduced to a bit set of the filters it fails; rows of a part are
then counts per bit set, at most 2^n of them. A state of the subset lattice is
the set of filters already applied, an edge applies one more. Forward counts
say how many orders reach a state, backward counts how many leave it for the
full set, so an edge lies on forward x backward orders: weighted by that, its
removals add up to the filter's Shapley figure over all orders, and the steps
of a single order are read from the same edges.

A filter "same text as a row with a smaller id" is no property of one row.
Equal texts are counted per (text key, part, bits, labels) with the smallest id
and how often it stands there; only the rows with the smallest id of the whole
table pass. Copies collapse before the shuffle, so a text that a third of all
rows share is a few sums per task, and texts never travel, only their SHA-256.

Defined results: null text is the empty text; a null part is the empty string; a
null id is neither smaller nor greater than any id, so such rows pass the
duplicate filter and fail no other row; rows that repeat an id with the same
text pass together or fail together. Several labels of one id count as set if
one is; null labels and those of unknown ids count as unset. Long texts are read whole. Other
columns are never looked at. An empty table has no parts and gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import permutations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plansift.llm.common import let, words, written

#: n! orders are listed, so more filters than this are refused.
MAX_FILTERS = 7
DUPLICATE = "E"


@dataclass(frozen=True)
class Edge:
    """Applying ``bit`` in the state ``state``; ``orders`` of all orders do so."""

    state: int
    bit: int
    orders: int


def lattice(n: int) -> list[Edge]:
    """All edges of the subset lattice over n filters with the orders through each, counted forwards and backwards."""
    full = (1 << n) - 1
    bits = [1 << k for k in range(n)]
    by_size = sorted(range(full + 1), key=int.bit_count)
    reach, leave = dict.fromkeys(by_size, 0), dict.fromkeys(by_size, 0)
    reach[0] = leave[full] = 1
    for state in by_size[1:]:
        reach[state] = sum(reach[state ^ b] for b in bits if state & b)
    for state in by_size[-2::-1]:
        leave[state] = sum(leave[state | b] for b in bits if not state & b)
    return [Edge(s, b, reach[s] * leave[s | b]) for s in by_size for b in bits if not s & b]


def steps_of_orders(names: str) -> list[tuple[str, int, int, int]]:
    """(order, step, state before it, bit of its filter) for every order of the filters."""
    rows = []
    for order in permutations(names):
        state = 0
        for step, name in enumerate(order, 1):
            bit = 1 << names.index(name)
            rows.append(("".join(order), step, state, bit))
            state |= bit
    return rows


def text_filters(text: Column) -> dict[str, Column]:
    """The text conditions A to D; true means the row fails."""
    full = F.coalesce(text, F.lit(""))
    counted = let(words(full), lambda w: F.struct(F.size(w).alias("n"), F.size(F.array_distinct(w)).alias("distinct")))
    return {
        "AB": let(counted, lambda c: (c["n"] < 100).cast("int") + F.when(100 * c["distinct"] < 80 * c["n"], 2).otherwise(0)),
        "C": 100 * F.length(F.regexp_replace(full, "[^A-Z]+", "")) > 10 * F.length(full),
        "D": full.rlike(r"[#$%&*|]"),
    }


def failed_bits(text: Column) -> Column:
    """A to D as bits 1, 2, 4 and 8."""
    f = text_filters(text)
    return f["AB"] + F.when(f["C"], 4).otherwise(0) + F.when(f["D"], 8).otherwise(0)


def bit_counts(docs: DataFrame, part: Column, bits: Column, text: Column, labels: DataFrame, duplicate_bit: int) -> DataFrame:
    """part, bits, n, good and toxic: rows per set of failed filters, the duplicate filter included."""
    known = labels.filter("doc_id is not null").groupBy(F.col("doc_id").alias("_of")).agg(
        F.coalesce(F.max(F.col("quality") == 1), F.lit(False)).alias("good"),
        F.coalesce(F.max(F.col("toxic") == 1), F.lit(False)).alias("toxic"))
    rows = docs.select(
        F.col("doc_id").alias("_id"), F.sha2(F.coalesce(text, F.lit("")), 256).alias("key"),
        F.coalesce(part, F.lit("")).alias("part"), bits.alias("bits"))
    # rows without an id match no label; their text spreads them over the tasks of the join
    salt = F.when(F.col("_id").isNull(), F.col("key"))
    joined = rows.withColumn("_salt", F.coalesce(salt, F.lit(""))).join(
        known.withColumn("_free", F.lit("")), (F.col("_id") == F.col("_of")) & (F.col("_salt") == F.col("_free")), "left")
    flags = [F.coalesce(c, F.lit(False)).alias(c) for c in ("good", "toxic")]
    by_id = joined.select("_id", "_salt", "key", "part", "bits", *flags).groupBy("_id", "_salt", "key", "part", "bits", "good", "toxic").count()
    # nulls are greater than all numbers here, so that the smallest pair is that of the smallest id
    lowest = F.min(F.when(F.col("_id").isNotNull(), F.struct("_id", "count"))).alias("low")
    by_text = by_id.groupBy("key", "part", "bits", "good", "toxic").agg(
        F.sum("count").alias("n"), F.sum(F.when(F.col("_id").isNull(), F.col("count")).otherwise(0)).alias("no_id"), lowest)
    # a text has a row per part and pair of labels here, however many copies there are
    by_text = by_text.withColumn("first_id", F.min("low._id").over(Window.partitionBy("key")))
    passing = F.col("no_id") + F.when(F.col("low._id") == F.col("first_id"), F.col("low.count")).otherwise(0)
    either = F.array(
        F.struct(F.col("bits").alias("bits"), passing.alias("n")),
        F.struct((F.col("bits") + duplicate_bit).alias("bits"), (F.col("n") - passing).alias("n")))
    count_if = lambda c: F.sum(F.when(F.col(c), F.col("x.n")).otherwise(0)).alias(c)
    return (
        by_text.select("part", "good", "toxic", F.explode(either).alias("x"))
        .groupBy("part", F.col("x.bits").alias("bits")).agg(F.sum("x.n").alias("n"), count_if("good"), count_if("toxic"))
    )


def audit(counts: DataFrame, names: str) -> DataFrame:
    """One row per part, order of the filters ``names`` (a letter each) and step.

    ``counts`` has part, bits, n, good and toxic. The lattice (n 2^(n-1) edges)
    and the list of orders (n! n rows) depend on the number of filters alone.
    """
    if not 1 <= len(names) <= MAX_FILTERS or len(set(names)) != len(names):
        raise ValueError(f"1 to {MAX_FILTERS} different letters: {names!r}")
    spark = counts.sparkSession
    edges = F.array(*[F.struct(F.lit(e.state).alias("state"), F.lit(e.bit).alias("bit"), F.lit(e.orders).cast("long").alias("orders")) for e in lattice(len(names))])
    each = counts.withColumn("e", F.explode(edges)).select("part", "bits", "n", "good", "toxic", "e.*")
    failing = F.col("bits").bitwiseAND(F.col("bit")) != 0
    gone = F.col("bits").bitwiseAND(F.col("state")) != 0
    total = lambda when, value="n": F.sum(F.when(when, F.col(value)).otherwise(0))
    walked = each.groupBy("part", "state", "bit", "orders").agg(
        total(~gone & ~failing).alias("kept"), total(~gone & failing).alias("removed"), total(gone & failing).alias("redundant"),
        total(F.col("bits") == F.col("bit")).alias("unique_fails"),
        total(~gone & failing, "good").alias("good_lost"), total(~gone & failing, "toxic").alias("toxic_lost"))
    shapley = walked.groupBy("part", "bit").agg(F.sum(F.col("orders") * F.col("removed")).alias("shapley"))
    orders = F.broadcast(spark.createDataFrame(steps_of_orders(names), "filter_order string, step int, state int, bit int"))
    return walked.drop("orders").join(shapley, ["part", "bit"]).join(orders, ["state", "bit"]).select(
        "part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def filter_interactions(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The five filters A to E over whole texts of ``docs``, per language."""
    bits = bit_counts(docs, F.col("lang"), failed_bits(F.col("text")), F.col("text"), labels, duplicate_bit=16)
    # a few rows per part; both uses in the audit read them instead of the texts
    return audit(written(bits), "ABCDE")


def oracle_sql() -> str:
    """The same audit by walking every order over the counts of bit sets, in SQL."""
    letters = "(VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16))"
    chars = [f"f{k}" for k in range(1, 6)]
    joins = " ".join(f"JOIN {letters} {c}(l, b) ON {c}.l NOT IN ({', '.join(f'{p}.l' for p in chars[:k + 1])})" for k, c in enumerate(chars[1:]))
    orders = f"SELECT {' || '.join(f'{c}.l' for c in chars)} AS filter_order, [{', '.join(f'{c}.b' for c in chars)}] AS bs FROM {letters} f1(l, b) {joins}"
    return rf"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
f AS (SELECT doc_id, part, (len(ws) < 100)::INT + 2 * (100 * len(list_distinct(ws)) < 80 * len(ws))::INT
  + 4 * (100 * length(regexp_replace(t, '[^A-Z]+', '', 'g')) > 10 * length(t))::INT + 8 * regexp_matches(t, '[#$%&*|]')::INT
  + 16 * coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false)::INT AS bits FROM d),
l AS (SELECT doc_id, coalesce(bool_or(quality = 1), false) AS good, coalesce(bool_or(toxic = 1), false) AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
c AS (SELECT part, bits, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM f LEFT JOIN l USING (doc_id) GROUP BY part, bits),
o AS ({orders}),
s AS (SELECT filter_order, unnest(bs) AS bit, generate_subscripts(bs, 1) AS step, bs FROM o),
q AS (SELECT filter_order, step, bit, coalesce(list_sum(bs[1:step - 1]), 0)::INT AS state FROM s),
r AS (SELECT part, filter_order, step, bit, coalesce(sum(n) FILTER (bits & (state | bit) = 0), 0) AS kept,
  coalesce(sum(n) FILTER (bits & state = 0 AND bits & bit > 0), 0) AS removed, coalesce(sum(n) FILTER (bits & state > 0 AND bits & bit > 0), 0) AS redundant,
  coalesce(sum(n) FILTER (bits = bit), 0) AS unique_fails, coalesce(sum(good) FILTER (bits & state = 0 AND bits & bit > 0), 0) AS good_lost,
  coalesce(sum(toxic) FILTER (bits & state = 0 AND bits & bit > 0), 0) AS toxic_lost FROM c, q GROUP BY part, filter_order, step, bit)
SELECT part, filter_order, step::INT AS step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails,
  good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost, (sum(removed) OVER (PARTITION BY part, bit))::BIGINT AS shapley FROM r"""
