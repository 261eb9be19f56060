"""Operator 13: how far the sources of a language stand apart in their words.

Equal texts of a language are one row with a count per source, found by a hash
join of small rows (language, text key, source, count) with the texts, each of
which travels once. Every such text is cut into terms once; its term counts are
added times the copies, per source, and its terms' document frequencies times
all copies, inside the task; a task then passes on one row per term.

A pair of sources is compared over all kept terms of the language, but most
terms stand in few sources. With p0 and q0 the shares of absent terms,

    sum f(p, q) = V f(p0, q0) + sum over terms of s [f(p, q0) - f(p0, q0)]
                + sum over terms of t [f(p0, q) - f(p0, q0)]
                + sum over common terms [f(p, q) - f(p, q0) - f(p0, q) + f(p0, q0)]

so a source's own terms enter as a histogram of shares, and only terms that both
sources hold are looked at as pairs. These stand in packs of PACK sources a term
and are added up inside tasks per pair of packs, so that a common term never
expands into rows and no group outgrows a task.

All shares and sums are integers: shares are divided as decimals of 38 digits
(exact to counts of 10^27), the rest fits 64 bits.

Defined results: null text, language and source are the empty string, as is a
group of such rows; rows that repeat, with or without ids, count as they stand;
a language without kept terms has pairs of value 0 and no terms; one with a
single source has no pairs. Equal values are ordered by the item's UTF-8 bytes.
Long texts are cut whole. Columns besides text, lang and source are never
looked at, whatever they are called. An empty table gives no rows.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plansift.llm.common import bounded, written

MIN_DOCS = 3
TOP_TERMS = 200
SCALE = 10**9
#: Sources of a language that stand together in one row of a term.
PACK = 64
#: Counts a task gathers before it adds them up and passes them on.
MEMORY = 1 << 22
#: Terms of a batch that a task passes on.
OUT_ROWS = 1 << 14
#: Stands for the number of a source where documents are counted.
DOCUMENTS = -1
#: Pack pairs a task keeps sums of (PACK x PACK numbers each).
OPEN_PAIRS = 64

#: Letters A to Z become small, other ASCII characters that are no letters become spaces.
TERM_BYTES = bytes(b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x61 <= b <= 0x7A else 0x20 for b in range(256))


def terms(text: bytes) -> list[bytes]:
    return text.translate(TERM_BYTES).split()


def numbered_sources(docs: DataFrame) -> DataFrame:
    """lang, source and k: every group that occurs, numbered from 0 within its language."""
    named = docs.select(*[F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("lang", "source")]).distinct()
    return named.withColumn("k", (F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1).cast("int"))


def distinct_texts(docs: DataFrame, numbered: DataFrame) -> DataFrame:
    """lang, text and copies (k, n) of every different text of a language."""
    named = docs.select(*[F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    keyed = named.withColumn("key", F.sha2("text", 256))
    # both sides lie by (lang, key) already, so the join moves nothing more
    copies = keyed.groupBy("lang", "key", "source").agg(F.count(F.lit(1)).alias("n")).join(bounded(numbered), ["lang", "source"]).groupBy("lang", "key").agg(
        F.collect_list(F.struct("k", "n")).alias("copies"))
    texts = keyed.groupBy("lang", "key").agg(F.first("text").alias("text"))
    return texts.join(copies, ["lang", "key"]).select("lang", "text", F.col("copies.k").alias("k"), F.col("copies.n").alias("n"))


class TermIds(dict):
    """Term -> number, in the order of first sight."""

    def __missing__(self, term: bytes) -> int:
        number = self[term] = len(self)
        return number


def added_up(gathered: list[tuple[int, int, np.ndarray, np.ndarray]], langs: list[str], ids: TermIds) -> Iterator[pa.RecordBatch]:
    """The counts that a task holds (language, source, terms and their counts), a row per term in small batches.

    What is held is emptied as soon as it stands in columns, and every column is
    replaced as it is ordered, so the task needs little more than one copy.
    """
    lengths = [len(found) for _, _, found, _ in gathered]
    lang, k = (np.repeat(np.array([g[i] for g in gathered], np.int32), lengths) for i in (0, 1))
    term, n = (np.concatenate([g[i] for g in gathered]) for i in (2, 3))
    gathered.clear()
    words = pa.array(list(ids), pa.binary())
    ids.clear()
    order = np.lexsort((k, lang, term))
    lang = lang[order]
    k = k[order]
    term = term[order]
    n = n[order]
    del order
    row = np.append(True, (term[1:] != term[:-1]) | (lang[1:] != lang[:-1]))
    entry = np.flatnonzero(row | np.append(True, k[1:] != k[:-1]))
    n, k = np.add.reduceat(n, entry), k[entry]
    first = np.flatnonzero(row)
    lang, term = lang[first], term[first]
    offsets = np.append(np.searchsorted(entry, first), len(entry))
    del row, entry, first
    names = pa.array(langs, pa.string())
    for start in range(0, len(term), OUT_ROWS):
        end = min(start + OUT_ROWS, len(term))
        part = slice(offsets[start], offsets[end])
        entries = pa.StructArray.from_arrays([pa.array(k[part], pa.int32()), pa.array(n[part], pa.int64())], names=["k", "n"])
        lists = pa.ListArray.from_arrays(pa.array(offsets[start : end + 1] - offsets[start], pa.int32()), entries)
        yield pa.RecordBatch.from_arrays(
            [names.take(pa.array(lang[start:end])), words.take(pa.array(term[start:end])).cast(pa.string()), lists], ["lang", "term", "e"])


def term_counts(texts: DataFrame) -> DataFrame:
    """lang, term, k and n: occurrences in source k, or documents of the language where k is DOCUMENTS."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs: dict[str, int] = {}
        ids, gathered, size = TermIds(), [], 0

        for batch in batches:
            texts = batch.column("text").cast(pa.binary())
            for i, (name, ks, ns) in enumerate(zip(*[batch.column(c).to_pylist() for c in ("lang", "k", "n")], strict=True)):
                words = terms(texts[i].as_py())
                found, times = np.unique(np.fromiter(map(ids.__getitem__, words), np.int32, len(words)), return_counts=True)
                if not len(found):
                    continue
                lang = langs.setdefault(name, len(langs))
                gathered.append((lang, DOCUMENTS, found, np.full(len(found), sum(ns))))
                gathered.extend((lang, k, found, times * n) for k, n in zip(ks, ns, strict=True))
                size += len(found) * (1 + len(ks))
                if size >= MEMORY:
                    yield from added_up(gathered, list(langs), ids)
                    size = 0
        if gathered:
            yield from added_up(gathered, list(langs), ids)

    each = texts.mapInArrow(run, "lang string, term string, e array<struct<k:int,n:long>>").repartition("lang", "term")
    return each.select("lang", "term", F.inline("e")).groupBy("lang", "term", "k").agg(F.sum("n").alias("n"))


def share(count: Column, total: Column, kinds: Column) -> Column:
    """p of a term with ``count`` occurrences; exact, and null where nothing is kept."""
    wide = lambda c: c.cast("decimal(20,0)")
    top = (wide(F.lit(SCALE)) * (wide(count) + F.lit(1).cast("decimal(1,0)"))).cast("decimal(38,0)")
    bottom = (wide(total) + wide(kinds)).cast("decimal(38,0)")
    return 1 + F.call_function("div", top, F.nullif(bottom, F.lit(0).cast("decimal(38,0)")))


def f_of(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), q)


def common_terms(kept: DataFrame) -> DataFrame:
    """lang, s, t (numbers of sources) and value: the sum over the terms that both hold, for all pairs at once.

    The sources of a term stand in packs; two packs of a term meet in one row,
    in both orders, because f is not symmetric. A task adds up what it sees of a
    pair of packs in one square of numbers.
    """
    packed = kept.groupBy("lang", "term", F.floor(F.col("k") / PACK).alias("pack")).agg(F.collect_list(F.struct("k", "p", "p0")).alias("e"))
    side = lambda x: packed.select("lang", "term", F.col("pack").alias(f"pack_{x}"), *[
        F.col(f"e.{c}").alias(f"{c}_{x}") for c in ("k", "p", "p0")])
    met = side("a").join(side("b"), ["lang", "term"]).drop("term")

    def f(p: np.ndarray, q: np.ndarray) -> np.ndarray:
        return (p - q) * (p - q) // q

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[str, int, int], np.ndarray] = {}

        def out() -> Iterator[pa.RecordBatch]:
            for (lang, x, y), square in sums.items():
                s, t = np.nonzero(square)
                yield pa.RecordBatch.from_arrays([
                    pa.array([lang] * len(s), pa.string()), pa.array(s + x * PACK, pa.int32()), pa.array(t + y * PACK, pa.int32()), pa.array(square[s, t])],
                    ["lang", "s", "t", "value"])
            sums.clear()

        for batch in batches:
            rows_of: dict[tuple[str, int, int], list[int]] = defaultdict(list)
            for row, pair in enumerate(zip(*[batch.column(c).to_pylist() for c in ("lang", "pack_a", "pack_b")], strict=True)):
                rows_of[pair].append(row)
            for pair, rows in rows_of.items():
                if pair not in sums and len(sums) >= OPEN_PAIRS:
                    yield from out()
                square = sums.setdefault(pair, np.zeros((PACK, PACK), np.int64))
                for start in range(0, len(rows), 256):
                    part = batch.take(pa.array(rows[start : start + 256]))
                    n_a, n_b = (part.column(c).value_lengths().to_numpy().astype(np.int64) for c in ("k_a", "k_b"))
                    a, b = ({c: part.column(f"{c}_{x}").flatten().to_numpy() for c in ("k", "p", "p0")} for x in "ab")
                    # each entry of a row's left side meets the n_b entries of its right side, which follow each other
                    times, starts = np.repeat(n_b, n_a), np.repeat(np.cumsum(n_b) - n_b, n_a)
                    left = np.repeat(np.arange(len(times)), times)
                    right = np.arange(len(left)) - np.repeat(np.cumsum(times) - times - starts, times)
                    p, p0, q, q0 = a["p"][left], a["p0"][left], b["p"][right], b["p0"][right]
                    np.add.at(square, (a["k"][left] % PACK, b["k"][right] % PACK), f(p, q) - f(p, q0) - f(p0, q) + f(p0, q0))
        yield from out()

    return met.mapInArrow(run, "lang string, s int, t int, value long")


def source_pairs(groups: DataFrame, kept: DataFrame) -> DataFrame:
    """lang, s, t and value for all ordered pairs of different sources of a language."""
    mine = groups.select("lang", F.col("k").alias("s"), F.col("p0").alias("p"), "kinds")
    other = groups.select("lang", F.col("k").alias("t"), F.col("p0").alias("q"))
    absent = mine.join(other, "lang").filter("s <> t").select("lang", "s", "t", F.coalesce(F.col("kinds") * f_of(F.col("p"), F.col("q")), F.lit(0)).alias("value"))
    shares = kept.groupBy("lang", F.col("k").alias("s"), "p", "p0").agg(F.count(F.lit(1)).alias("h")).join(bounded(other), "lang").filter("s <> t")
    p, p0, q, h = (F.col(c) for c in ("p", "p0", "q", "h"))
    own = shares.select("lang", F.explode(F.array(
        F.struct("s", "t", (h * (f_of(p, q) - f_of(p0, q))).alias("value")),
        F.struct(F.col("t").alias("s"), F.col("s").alias("t"), (h * (f_of(q, p) - f_of(q, p0))).alias("value")))).alias("x")).select("lang", "x.*")
    common = common_terms(kept).filter("s <> t")
    return absent.unionByName(own).unionByName(common).groupBy("lang", "s", "t").agg(F.sum("value").alias("value"))


def divergence(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP_TERMS) -> DataFrame:
    """lang, source, part, item, value and rank: all other sources of the language (``pair``) and the ``top`` terms (``term``)."""
    numbered = written(numbered_sources(docs))
    of_term = Window.partitionBy("lang", "term")
    is_source = F.col("k") != DOCUMENTS
    counted = term_counts(distinct_texts(docs, numbered)).select(
        "*", F.max(F.when(~is_source, F.col("n"))).over(of_term).alias("docs"), F.sum(F.when(is_source, F.col("n"))).over(of_term).alias("in_lang"))
    found = written(counted.filter(F.col("docs") >= min_docs).drop("docs"))
    kinds = found.filter(~is_source).groupBy("lang").agg(F.count(F.lit(1)).alias("kinds"))
    totals = found.filter(is_source).groupBy("lang", "k").agg(F.sum("n").alias("total"))
    total, all_kinds = F.coalesce("total", F.lit(0)), F.coalesce("kinds", F.lit(0))
    groups = written(numbered.join(totals, ["lang", "k"], "left").join(kinds, "lang", "left").select(
        "lang", "source", "k", total.alias("total"), all_kinds.alias("kinds"),
        F.sum(total).over(Window.partitionBy("lang")).alias("lang_total"), share(F.lit(0), total, all_kinds).alias("p0")))
    kept = written(
        found.filter(is_source).join(bounded(groups), ["lang", "k"])
        .select("lang", "term", "source", "k", share(F.col("n"), F.col("total"), F.col("kinds")).alias("p"), "p0",
                share(F.col("in_lang"), F.col("lang_total"), F.col("kinds")).alias("q")))
    names = groups.select("lang", "k", "source")
    pairs = source_pairs(groups, kept).join(bounded(names.withColumnRenamed("k", "s")), ["lang", "s"]).join(
        bounded(names.select("lang", F.col("k").alias("t"), F.col("source").alias("item"))), ["lang", "t"])
    telling = kept.filter("p > q").select("lang", "source", F.col("term").alias("item"), f_of(F.col("p"), F.col("q")).alias("value"))
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")).alias("rank")
    columns = lambda part: ("lang", "source", F.lit(part).alias("part"), "item", "value", rank)
    return pairs.select(*columns("pair")).unionByName(telling.select(*columns("term")).filter(F.col("rank") <= top))


def oracle_sql(min_docs: int = MIN_DOCS, top: int = TOP_TERMS) -> str:
    """The same audit term by term, without collapsing texts or splitting sums, in SQL."""
    capitals = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    share_of = lambda n, total: f"(1 + ({SCALE}::HUGEINT * ({n} + 1)) // ({total} + 1 * v))"
    value = "((p - q) * (p - q)) // q"
    return rf"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
  regexp_extract_all(translate(coalesce(text, ''), '{capitals}', '{capitals.lower()}'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS ts FROM documents),
t AS (SELECT r, lang, source, unnest(ts) AS term FROM d),
w AS (SELECT lang, term FROM t GROUP BY lang, term HAVING count(DISTINCT r) >= {min_docs}),
c AS (SELECT lang, source, term, count(*) AS n FROM t JOIN w USING (lang, term) GROUP BY lang, source, term),
g AS (SELECT DISTINCT lang, source FROM d),
v AS (SELECT lang, count(*) AS v FROM w GROUP BY lang),
s AS (SELECT g.lang, g.source, coalesce(sum(n), 0) AS total FROM g LEFT JOIN c USING (lang, source) GROUP BY g.lang, g.source),
k AS (SELECT s.lang, s.source, w.term, coalesce(n, 0) AS n, {share_of('coalesce(n, 0)', 'total')} AS p
  FROM s JOIN v USING (lang) JOIN w USING (lang) LEFT JOIN c USING (lang, source, term)),
a AS (SELECT lang, sum(total) AS total FROM s GROUP BY lang),
b AS (SELECT c.lang, term, {share_of('sum(n)', 'any_value(total)')} AS q FROM (SELECT c.*, v FROM c JOIN v USING (lang)) c JOIN a USING (lang) GROUP BY c.lang, term, v),
x AS (SELECT k.lang, k.source, o.source AS item, sum({value.replace('p', 'k.p').replace('q', 'o.p')}) AS value
  FROM k JOIN k o ON k.lang = o.lang AND k.term = o.term AND k.source <> o.source GROUP BY k.lang, k.source, o.source),
y AS (SELECT m.lang, m.source, 'pair' AS part, o.source AS item, coalesce(value, 0)::BIGINT AS value
  FROM g m JOIN g o ON m.lang = o.lang AND m.source <> o.source LEFT JOIN x ON x.lang = m.lang AND x.source = m.source AND x.item = o.source
  UNION ALL SELECT lang, source, 'term', term, ({value})::BIGINT FROM k JOIN b USING (lang, term) WHERE n > 0 AND p > q),
z AS (SELECT *, (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item))::INT AS rank FROM y)
SELECT lang, source, part, item, value, rank FROM z WHERE part = 'pair' OR rank <= {top}"""
