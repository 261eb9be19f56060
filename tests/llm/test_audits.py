"""Operators 12 and 13 against plain loops, with nulls, copies and clashing columns."""

import re
from collections import Counter, defaultdict
from itertools import permutations
from math import factorial

import pytest
from pyspark.sql import functions as F

from plansift.llm import divergence, interactions

LABELS = "doc_id long, quality int, toxic int"


def test_lattice_counts_orders():
    for n in range(1, 6):
        edges = interactions.lattice(n)
        assert len(edges) == n * 2 ** (n - 1)
        for e in edges:
            size = e.state.bit_count()
            assert e.orders == factorial(size) * factorial(n - size - 1)
        assert sum(e.orders for e in edges) == n * factorial(n)


def _audit(rows, labels):
    first = {}
    for doc_id, text, _ in rows:
        if doc_id is not None:
            first[text or ""] = min(first.get(text or "", doc_id), doc_id)
    good = {d for d, q, _ in labels if q == 1 and d is not None}
    toxic = {d for d, _, t in labels if t == 1 and d is not None}
    parts = defaultdict(list)
    for doc_id, text, lang in rows:
        t = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = "".join(name for name, bad in (
            ("A", len(words) < 100), ("B", 100 * len(set(words)) < 80 * len(words)), ("C", 100 * len(re.findall("[A-Z]", t)) > 10 * len(t)),
            ("D", bool(re.search(r"[#$%&*|]", t))), ("E", doc_id is not None and doc_id > first[t])) if bad)
        parts[lang or ""].append((fails, doc_id in good, doc_id in toxic))
    out, total = [], Counter()
    for part, docs in parts.items():
        for order in permutations("ABCDE"):
            left, gone = docs, []
            for step, name in enumerate(order, 1):
                hit = [d for d in left if name in d[0]]
                redundant = sum(name in d[0] for d in gone)
                left = [d for d in left if name not in d[0]]
                gone = gone + hit
                total[part, name] += len(hit)
                out.append([part, "".join(order), step, len(left), len(hit), redundant, sum(d[0] == name for d in docs), sum(d[1] for d in hit), sum(d[2] for d in hit)])
    return sorted((*r, total[r[0], r[1][r[2] - 1]]) for r in out)


def test_filter_interactions_against_walking_all_orders(spark, edge_docs, no_docs):
    labels = [(0, 1, 0), (0, 0, 1), (5, 1, None), (6, None, 1), (9, 1, 1), (None, 1, 1), (777, 1, 1), (11, None, None)]
    table = spark.createDataFrame(labels, LABELS).withColumn("part", F.lit("clash")).withColumn("key", F.lit(1))
    got = interactions.filter_interactions(edge_docs, table)
    want = _audit([tuple(r) for r in edge_docs.select("doc_id", "text", "lang").collect()], labels)
    assert sorted(tuple(r) for r in got.collect()) == want
    assert len(want) == 600 * 3
    assert interactions.filter_interactions(no_docs, table).count() == 0
    assert interactions.filter_interactions(edge_docs, table.filter("1 = 0")).agg(F.sum("good_lost")).first()[0] == 0
    with pytest.raises(ValueError, match="different letters"):
        interactions.audit(got, "AAB")


def test_filter_interactions_of_documents(spark, documents):
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    want = _audit([tuple(r) for r in documents.select("doc_id", "text", "lang").collect()], [tuple(r) for r in labels.select("doc_id", "quality", "toxic").collect()])
    assert sorted(tuple(r) for r in interactions.filter_interactions(documents, labels).collect()) == want


def _divergence(rows, top=200):
    docs = [(lang or "", source or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))) for text, lang, source in rows]
    out = []
    for lang in {d[0] for d in docs}:
        seen = Counter(t for d in docs if d[0] == lang for t in set(d[2]))
        kept = [t for t, n in seen.items() if n >= 3]
        sources = sorted({d[1] for d in docs if d[0] == lang})
        counts = {s: Counter(t for d in docs if d[:2] == (lang, s) for t in d[2] if seen[t] >= 3) for s in sources}
        whole = sum(counts.values(), Counter())
        share = lambda c, t: 1 + 10**9 * (c[t] + 1) // (sum(c.values()) + len(kept))  # noqa: B023, E731
        f = lambda p, q: (p - q) * (p - q) // q
        for s in sources:
            pairs = [(sum(f(share(counts[s], t), share(counts[o], t)) for t in kept), o) for o in sources if o != s]
            terms = [(f(share(counts[s], t), share(whole, t)), t) for t in kept if counts[s][t] and share(counts[s], t) > share(whole, t)]
            for part, found in (("pair", pairs), ("term", terms)):
                found.sort(key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, item, value, i) for i, (value, item) in enumerate(found, 1) if part == "pair" or i <= top]
    return sorted(out)


def test_source_divergence_against_plain_loops(spark, edge_docs, no_docs, documents):
    for docs in (edge_docs, documents.limit(80)):
        rows = [tuple(r) for r in docs.select("text", "lang", "source").collect()]
        fixed = spark.createDataFrame(rows, "text string, lang string, source string").withColumn("n", F.lit("clash")).withColumn("key", F.lit(1))
        assert sorted(tuple(r) for r in divergence.divergence(fixed).collect()) == _divergence(rows)
    assert divergence.divergence(no_docs).count() == 0


def test_source_divergence_of_many_sources(spark):
    """More sources than a pack holds, terms in all of them, and a text with copies in several sources."""
    rows = [(f"alpha beta w{i % 7} W{i % 3}x " * (1 + i % 4), "en", f"s{i % 150}") for i in range(400)]
    rows += [("same words here é ü", "en", f"s{i % 5}") for i in range(300)] + [("lonely", "xx", "only"), (None, "yy", "a"), (None, "yy", None)]
    docs = spark.createDataFrame(rows, "text string, lang string, source string")
    got = sorted(tuple(r) for r in divergence.divergence(docs).collect())
    assert got == _divergence(rows)
    assert ("yy", "a", "pair", "", 0, 1) in got


def test_shares_of_huge_counts(spark):
    row = spark.sql("select 900000000000000000L as n, 9000000000000000000L as t, 5L as v").select(
        divergence.share(F.col("n"), F.col("t"), F.col("v")).alias("p")).first()
    assert row.p == 1 + 10**9 * (9 * 10**17 + 1) // (9 * 10**18 + 5)
