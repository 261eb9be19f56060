"""Operators on single texts: quality, licences, toxicity, pieces."""

import hashlib
import math
import random
import sys
import textwrap
import zlib
from collections import Counter
from pathlib import Path

import duckdb
import pytest
import sentencepiece

sys.path.insert(0, str(Path(__file__).resolve().parents[2] / "tools"))

from compare import rows_of  # noqa: E402

from plansift.llm import licenses, pieces, quality, queries, toxicity  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in ("documents", "pages"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_query_matches_sql(spark, duck, name):
    df = queries.QUERIES[name](spark, SF)
    cur = duck.execute(queries.ORACLE[name])
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == rows_of([d[0] for d in cur.description], cur.fetchall())


def _repeats(words, n=5):
    seen, hit = {}, set()
    for i in range(len(words) - n + 1):
        seen.setdefault(tuple(words[i : i + n]), []).append(i)
    for at in seen.values():
        if len(at) > 1:
            hit.update(k for i in at for k in range(i, i + n))
    return len(hit)


def test_quality_edges(spark, edge_docs, no_docs):
    assert quality.quality(no_docs).count() == 0
    got = quality.quality(edge_docs).collect()
    assert len(got) == edge_docs.count()
    for r in got:
        text = r["row"]["text"] or ""
        words = [w.decode() for w in text.encode().split()]
        assert r["n_words"] == len(words) and r["word_chars"] == sum(map(len, words))
        assert r["n_symbols"] == sum(text.count(c) for c in "#*$%&|<>")
        assert r["n_repeat_words"] == _repeats(words)
        lines = [x for x in text.split("\n") if x.encode().split()]
        assert r["n_dup_lines"] == len(lines) - len(set(lines))
        assert r["row"]["n_words"] == "clash"
        assert not (r["base_failed"] and r["kept"])


def test_quality_order_does_not_change_the_verdict(spark, documents):
    base = quality.with_base(documents)
    forward = base.withColumn("k", quality.cascade(quality.RULES)).select("doc_id", "k").collect()
    backward = base.withColumn("k", quality.cascade(quality.RULES[::-1])).select("doc_id", "k").collect()
    assert sorted(forward) == sorted(backward)
    assert {r.name for r in quality.rule_order(base)} == {r.name for r in quality.RULES}


def test_license_full_texts_and_gaps(spark, no_docs, edge_docs):
    mit = ". ".join(licenses.SENTENCES[n] for n in ("mit-grant", "mit-keep", "mit-warranty", "mit-liability")) + "."
    header = "\n".join(licenses.SENTENCES[n] for n in ("apache-header", "apache-comply", "apache-obtain", "apache-url", "apache-unless", "apache-see"))
    torn = licenses.SENTENCES["unlicense-free"] + ".\n" + "other words.\n" * 5 + licenses.SENTENCES["unlicense-anyone"]
    near = licenses.SENTENCES["unlicense-free"] + ".\n" + "other words.\n" * 2 + licenses.SENTENCES["unlicense-anyone"]
    rows = [(1, mit), (2, header), (3, torn), (4, near), (5, mit + "\n" + mit), (6, None)]
    got = {r["doc_id"]: [(x["licence"], x["kind"], x["n"]) for x in r["licences"]]
           for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: [("mit", "text", 1)], 2: [("apache-2.0", "header", 1)], 3: [], 4: [("unlicense", "text", 1)],
                   5: [("mit", "text", 2)], 6: []}
    assert licenses.scan(no_docs).count() == 0
    found = {r["doc_id"]: r["licences"] for r in licenses.scan(edge_docs).collect()}
    assert [(x["licence"], x["n"]) for x in found[14]] == [("mit", 1), ("cc-by-nc-4.0", 1)]


@pytest.mark.parametrize("width", [38, 72])
@pytest.mark.parametrize("leader", ["", "# ", " * ", "// ", ";; ", "REM ", "dnl ", "C     "])
def test_license_wrapped_texts(spark, width, leader):
    """Every rule is found in hard-wrapped text, in comments, with either line end, and with a long sentence between two known ones."""
    other = "In no event will the authors be held to pay for any damages of any kind that arise from what was made here or elsewhere"
    wrapped = lambda names, end: end.join(leader + line for line in textwrap.wrap(
        ". ".join(names), width, break_long_words=False, break_on_hyphens=False))
    rows, expected = [], {}
    for k, (licence, kind, names) in enumerate(licenses.RULES):
        texts = [licenses.SENTENCES[n] for n in names]
        between = [texts[0], other, *texts[1:]]
        rows += [(3 * k, "Copyright 2020 A. Author\n" + wrapped(texts, "\n")), (3 * k + 1, wrapped(texts, "\r\n")), (3 * k + 2, wrapped(between, "\n") + "\nend")]
        expected |= {3 * k + i: [(licence, kind, 1)] for i in range(3)}
    got = {r["doc_id"]: [(x["licence"], x["kind"], x["n"]) for x in r["licences"]]
           for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == expected


def test_license_blank_lines_end_sentences(spark):
    grant = licenses.SENTENCES["unlicense-free"]
    rows = [(1, grant.replace("software released", "software\n\nreleased") + ".\n" + licenses.SENTENCES["unlicense-anyone"]),
            (2, "Released\n# under the MIT\n# License"), (3, "This work is released\nunder CC0 1.0"),
            (4, "Licensed under the Apache License, Version 2.0\n(the \"License\");\nelse"), (5, "x Released under\nthe MIT License")]
    got = {r["doc_id"]: [(x["licence"], x["kind"]) for x in r["licences"]] for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: [], 2: [("mit", "notice")], 3: [("cc0-1.0", "notice")], 4: [("apache-2.0", "notice")], 5: []}


def _toxic_rows(n):
    rng = random.Random(3)
    words = [f"word{i}" for i in range(300)]
    rows = []
    for i in range(n):
        text = [rng.choice(words) for _ in range(rng.randint(5, 120))]
        bad = i % 5 == 0
        for _ in range(max(1, len(text) // 25) if bad else 0):
            text.insert(rng.randint(0, len(text)), rng.choice(["Idiot", "scum,", "moron", "trash"]))
        rows.append((i, " ".join(text), int(bad)))
    return rows


def test_toxicity_held_out(spark):
    rows = _toxic_rows(1500)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y, y) for i, _, y in rows], "doc_id long, quality int, toxic int")
    truth = {i: y for i, _, y in rows}
    got = toxicity.toxicity(docs, labels).collect()
    held = [r for r in got if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in got)
    assert len(held) > 300 and sum(r["predicted"] == truth[r["doc_id"]] for r in held) >= 0.99 * len(held)
    # labels of the held-out part are never read
    flipped = labels.selectExpr("doc_id", "quality", "CASE WHEN crc32(encode(string(doc_id), 'UTF-8')) % 4 = 2 THEN 1 - toxic ELSE toxic END AS toxic")
    again = {r["doc_id"]: r["score"] for r in toxicity.toxicity(docs, flipped).collect()}
    assert all(abs(again[r["doc_id"]] - r["score"]) < 1e-12 for r in got)


@pytest.mark.parametrize("phrase", ["baca daca ebca fada", "zab yec xid wof"])
def test_toxicity_of_a_fixed_phrase(spark, phrase):
    """Neither ordinary words in a fixed order nor words that each have one predecessor show in continuation counts."""
    rng = random.Random(4)
    rows = []
    for i in range(1500):
        text = ["".join(rng.choices("abcdef", k=2)) + rng.choice(["ca", "da"]) for _ in range(rng.randint(20, 120))]
        text.append("".join(rng.choices("ghijklmnopqrstu", k=9)))  # new words stand in all texts
        rows.append((i, " ".join(([phrase] if i % 5 == 0 else []) + text), int(i % 5 == 0)))
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 0, y) for i, _, y in rows], "doc_id long, quality int, toxic int")
    held = [r for r in toxicity.toxicity(docs, labels).collect() if r["held_out"]]
    assert len(held) > 300 and sum(r["predicted"] == rows[r["doc_id"]][2] for r in held) >= 0.99 * len(held)


def test_toxicity_pairs_against_loops(spark):
    """Ratios equal the formula over plain counts."""
    rows = [(" ".join(random.Random(i).choices(["aa", "bb", "cc", "dd"], k=9)), i % 2) for i in range(30)]
    tables = toxicity.Tables.of(toxicity.word_pairs(spark.createDataFrame(rows, "text string, toxic int")))
    pairs = [Counter(), Counter()]
    for text, y in rows:
        words = ["", *text.split()]
        pairs[y].update(zip(words, words[1:], strict=False))
    both = pairs[0].keys() | pairs[1].keys()
    shared = Counter(w for _, w in both)

    def lower(c, w, d):
        follows = Counter(b for _, b in pairs[c])
        total = sum(follows.values())
        left = sum(min(d, n) for n in follows.values()) / total
        own = max(follows[w] - d, 0) / total
        # a beginning is the word itself here
        return own + left * (own + left * shared[w] / len(both)), left

    for k, d in enumerate(toxicity.DISCOUNTS):
        p = {}
        for v, w in {(v, w) for v in ["", "aa", "bb", "cc", "dd"] for w in ["aa", "bb", "cc", "dd"]}:
            for c in (0, 1):
                total = sum(n for (b, _), n in pairs[c].items() if b == v)
                left = sum(min(d, n) for (b, _), n in pairs[c].items() if b == v) / total
                p[v, w, c] = max(pairs[c][v, w] - d, 0) / total + left * lower(c, w, d)[0]
        offset = 2 * math.log(lower(1, "aa", d)[1] / lower(0, "aa", d)[1])
        for text, _ in rows[:5]:
            words = ["", *text.split()]
            each = [math.log(p[v, w, 1] / p[v, w, 0]) - offset for v, w in zip(words, words[1:], strict=False)]
            assert abs(tables.reader()(text)[k][0] - sum(each) / len(each)) < 1e-9


def test_toxicity_edges(spark, edge_docs, no_docs):
    labels = spark.createDataFrame([(0, 1, 0), (5, 0, 1), (5, 0, 0), (None, 1, 1), (7, 1, None)], "doc_id long, quality int, toxic int")
    for some in (labels, labels.filter("1 = 0")):
        got = toxicity.toxicity(edge_docs, some).collect()
        assert len(got) == edge_docs.count() and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in got)
        assert toxicity.toxicity(no_docs, some).count() == 0


@pytest.fixture(scope="module")
def model():
    return pieces.public_model()


def test_pieces_equal_the_library(model):
    table, library = pieces.PieceTable(model), sentencepiece.SentencePieceProcessor(model_proto=model)
    rng = random.Random(7)
    pool = [*"abcdefg theérñ的是\n\t   ▁.,0123<>x", "the", " ing", "<s>", "</s>", "<0x0A>", "▁▁", "🙂", "\x00", "　", "\r\n", "      ", "ﬁ"]
    texts = ["".join(rng.choice(pool) for _ in range(rng.randint(0, 30))) for _ in range(3000)]
    texts += [" " * n for n in range(40)] + ["ab" * n for n in range(40)] + ["a" * 3000]
    for text in texts:
        ids = table.encode(text)
        assert ids == library.encode(text, add_eos=True)
        assert table.decode(ids) == library.decode(ids)


def test_pieces_table_and_edges(spark, model, edge_docs, no_docs):
    library = sentencepiece.SentencePieceProcessor(model_proto=model)
    texts = [r["text"] or "" for r in edge_docs.select("text").collect()]
    got = pieces.encode_decode(edge_docs, model).collect()
    expected = sorted((library.encode(t, add_eos=True) for t in texts))
    assert sorted(r["ids"] for r in got) == expected
    assert sorted(r["decoded"] for r in got) == sorted(library.decode(i) for i in expected)
    digests = pieces.encode_decode(edge_docs, model, digest=True).collect()
    assert sorted(r["ids"] for r in digests) == sorted(hashlib.sha256(" ".join(map(str, i)).encode()).hexdigest() for i in expected)
    assert pieces.encode_decode(no_docs, model).count() == 0
