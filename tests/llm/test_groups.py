"""Operators across documents, against plain loops: near duplicates, passages, lines, mixing, shards, the pipeline."""

import hashlib
import math
import random
import struct
import zlib
from collections import Counter

import corpus_pipeline
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from plansift.llm import lines, minhash, mixing, sharding, substrings, vectors


class Union:
    def __init__(self, ids):
        self.up = {i: i for i in ids}

    def root(self, i):
        while self.up[i] != i:
            i = self.up[i]
        return i

    def join(self, a, b):
        a, b = self.root(a), self.root(b)
        self.up[max(a, b)] = min(a, b)


def shingle_set(text, n):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} if len(words) >= n else ({tuple(words)} if words else set())


def brute_near(rows, n, percent):
    sets = {i: shingle_set(t, n) for i, t in rows}
    groups, holders = Union(sets), {}
    for i, s in sets.items():
        for j, both in Counter(j for g in s for j in holders.get(g, ())).items():
            if 100 * both >= percent * (len(s) + len(sets[j]) - both):
                groups.join(i, j)
        for g in s:
            holders.setdefault(g, []).append(i)
    return {i: (len(s), groups.root(i)) for i, s in sets.items()}


def near_copies(n, seed=1):
    """A group of near copies with zero to ten edits each, so that many pairs lie around the threshold."""
    rng = random.Random(seed)
    base = [f"t{rng.randint(0, 10**6)}" for _ in range(150)]
    rows = []
    for i in range(n):
        words = list(base)
        for _ in range(rng.randint(0, 10)):
            words[rng.randrange(len(words))] = f"e{rng.randint(0, 10**9)}"
        rows.append((i, " ".join(words)))
    return rows


@pytest.mark.parametrize(("shingle", "percent"), [(3, 85), (5, 80)])
def test_minhash_against_loops(spark, documents, shingle, percent):
    rows = [(r["doc_id"], r["text"]) for r in documents.collect()]
    rows += [(1000 + i, t) for i, t in near_copies(300)]
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), shingle, percent).collect()
    expected = brute_near(rows, shingle, percent)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == expected
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)


def test_minhash_edges(spark, edge_docs, no_docs):
    got = minhash.near_duplicates(edge_docs, 3, 85).collect()
    assert len(got) == edge_docs.count() and minhash.near_duplicates(no_docs, 3, 85).count() == 0
    by = {r["doc_id"]: r for r in got if r["doc_id"] is not None}
    assert [by[i]["n_shingles"] for i in (0, 1, 2, 3, 4)] == [0, 0, 0, 1, 1]
    assert by[1]["component_id"] == 1 and by[6]["component_id"] == 5 and by[100]["component_id"] == 5 and by[10]["component_id"] == 9
    assert all(r["kept"] and r["component_id"] is None for r in got if r["doc_id"] is None)


def brute_substrings(rows, window=50):
    first = {}
    split = [(i, (t or "").encode().split()) for i, t in rows]
    for i, words in split:
        for p in range(len(words) - window + 1):
            key = tuple(words[p : p + window])
            first[key] = min(first.get(key, math.inf), math.inf if i is None else i)
    out = []
    for i, words in split:
        own, gone = math.inf if i is None else i, set()
        for p in range(len(words) - window + 1):
            if first[tuple(words[p : p + window])] < own:
                gone.update(range(p, p + window))
        kept = b" ".join(w for k, w in enumerate(words) if k not in gone)
        out.append((str(i), len(words), len(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("cells", [substrings.MAX_CELLS, 1 << 12])
def test_substrings_against_loops(spark, documents, edge_docs, cells):
    """A sketch far too narrow lets more windows through; results stay the same."""
    docs = documents.select("doc_id", "text").unionByName(edge_docs.select((F.col("doc_id") + 500).alias("doc_id"), "text"))
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    got = substrings.dedup_substrings(docs, digest=True, max_cells=cells).collect()
    assert sorted((str(r["doc_id"]), r["n_words"], r["n_removed"], r["kept"]) for r in got) == brute_substrings(rows)


def test_substrings_spans_and_empty(spark, edge_docs, no_docs):
    assert substrings.dedup_substrings(no_docs).count() == 0
    for r in substrings.dedup_substrings(edge_docs).collect():
        assert sum(s["end"] - s["first"] for s in r["spans"]) == r["n_removed"]
        assert len(r["kept"].encode().split()) == r["n_words"] - r["n_removed"]


def test_vectors_against_loops(spark):
    rng = np.random.default_rng(5)
    base = rng.standard_normal((400, 32))
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    near = base[:100] + rng.standard_normal((100, 32)) * rng.uniform(0.001, 0.09, (100, 1))
    crowd = base[0] + rng.standard_normal((150, 32)) * 0.02
    every = np.concatenate([base, near * 3.0, crowd, base[5:8], base[5:8]])
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(every)]
    odd = [None, [0.0] * 32, [None] * 32, [float("nan")] * 32, [float("inf")] * 32, [], [1.0, 2.0], [2.0, 4.0]]
    rows += [(2000 + k, v) for k, v in enumerate(odd)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("id", F.lit("clash")).withColumn("n_links", F.lit(0))
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in vectors.near_vectors(df).collect()}
    unit = every / np.linalg.norm(every, axis=1, keepdims=True)
    hit = unit @ unit.T >= 0.95
    groups = Union(range(len(every)))
    for a, b in zip(*np.nonzero(hit), strict=True):
        groups.join(int(a), int(b))
    expected = {i: (int(hit[i].sum()) - 1, groups.root(i)) for i in range(len(every))}
    expected |= {2000 + k: (0, 2000 + k) for k in range(6)} | {2006: (1, 2006), 2007: (1, 2006)}
    links = sum(n for n, _ in expected.values())
    assert sum(n for n, _, _ in got.values()) >= 0.99 * links and all(got[i][0] <= expected[i][0] for i in expected)
    assert sum(got[i] == (n, c, i == c) for i, (n, c) in expected.items()) >= 0.99 * len(expected)
    assert vectors.near_vectors(df.filter("1 = 0")).count() == 0


def test_vectors_recall_over_many_cells(spark, monkeypatch):
    """Cells, tables and tiles far smaller than the data; pairs planted just above the threshold, a crowded group, links counted once."""
    monkeypatch.setattr(vectors, "CELL_ROWS", 60)
    monkeypatch.setattr(vectors, "TILE_ROWS", 40)
    rng = np.random.default_rng(9)
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    base = unit(rng.standard_normal((2500, 48)))
    side = rng.standard_normal((1200, 48))
    side = unit(side - (side * base[:1200]).sum(axis=1, keepdims=True) * base[:1200])
    cosine = rng.uniform(0.950001, 0.955, (1200, 1))
    planted = base[:1200] * cosine + side * np.sqrt(1 - cosine**2)
    crowd = unit(base[2000] + rng.standard_normal((300, 48)) * 0.02)
    every = np.concatenate([base, planted, crowd])
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(every)], "vec_id long, embedding array<double>")
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in vectors.near_vectors(df).collect()}
    hit = unit(every) @ unit(every).T >= 0.95
    want = hit.sum(axis=1) - 1
    ends = np.array([got[i][0] for i in range(len(every))])
    assert (ends <= want).all()
    assert ends[2500:3700].sum() >= 0.99 * want[2500:3700].sum() and ends[3700:].sum() >= 0.999 * want[3700:].sum()
    assert sum(got[2500 + i][1] == i for i in range(1200)) >= 0.99 * 1200 and len({got[i][1] for i in range(3700, 4000)}) == 1


def test_vector_tables_follow_the_recall():
    chance = vectors.same_cell(math.sqrt(0.1))
    assert abs(chance - np.clip(1 - np.abs(np.random.default_rng(1).standard_normal(400_000)) * math.sqrt(0.1) / 2, 0, None).mean()) < 1e-3
    counts = [vectors.table_count(depth, 0.95, 0.9975) for depth in range(12)]
    assert counts[0] == 1 and counts == sorted(counts) and all(1 - (1 - chance**d) ** counts[d] >= 0.9975 for d in range(1, 12))


def test_lines_edges(spark, edge_docs, no_docs):
    find = lambda docs: lines.dedup_lines(docs, "doc_id", F.col("source"), F.col("text"))
    assert find(no_docs).count() == 0
    assert find(edge_docs).count() == edge_docs.count()
    pages = [(i, "h", f"nav\nown {i}\nnav") for i in range(10)] + [(20, "h", None), (21, "small", "nav"), (22, None, "nav"), (22, None, "nav")]
    pages += [(30 + i, "two", f"nav\nown {i}") for i in range(2)] + [(40 + i, "four", "nav\n" * (i < 2) + f"own {i}") for i in range(4)]
    got = {r["row"]["page"]: r for r in lines.dedup_lines(spark.createDataFrame(pages, "page long, host string, text string"), "page", F.col("host"), F.col("text")).collect()}
    assert got[3]["kept_text"] == "own 3" and got[3]["n_dropped"] == 2 and got[3]["n_lines"] == 3
    assert got[20]["kept_text"] is None and got[21]["kept_text"] == "nav"
    # a host of one page keeps all; on hosts of two and four pages a line on two of them is boilerplate, also where the host is null
    assert got[22]["n_dropped"] == 1 and got[22]["kept_text"] == ""
    assert [got[i]["kept_text"] for i in (30, 31, 40, 41, 42, 43)] == ["own 0", "own 1", "own 0", "own 1", "own 2", "own 3"]


def test_mixing(spark, edge_docs, no_docs):
    assert mixing.mix(no_docs).count() == 0
    assert {r["row"]["n"] for r in mixing.mix(edge_docs).collect()} <= {"clash"}
    docs = spark.range(6000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 6 == 0, "b").otherwise("a").alias("source"))
    targets = spark.createDataFrame([("a", 1.0), ("b", 3.0), ("gone", 9.0)], "source string, weight double")
    got = Counter(r["row"]["source"] for r in mixing.mix(docs, targets).collect())
    assert abs(got["a"] - 1500) < 200 and abs(got["b"] - 4500) < 300
    again = Counter(r["row"]["source"] for r in mixing.mix(docs.repartition(7), targets).collect())
    assert got == again and abs(mixing.expected_copies(4.5) - 4.5) < 1e-9
    only = mixing.mix(docs.limit(3).withColumn("source", F.lit("s")), spark.createDataFrame([("s", 1.0)], "source string, weight double"))
    assert all(r["n_copies"] >= 1 for r in only.collect())


def test_shards(spark, documents, edge_docs, no_docs):
    assert sharding.shard(no_docs).count() == 0
    for docs, shards in ((documents, 40), (edge_docs, 40), (documents, 7)):
        rows = docs.select("doc_id", "text", "source").collect()
        got = sharding.shard(docs, shards).collect()
        facts = sorted((str(r["doc_id"]), len((r["text"] or "").encode()) + 16, zlib.crc32((r["text"] or "").encode())) for r in rows)
        assert sorted((str(r["doc_id"]), r["size"], r["text_crc32"]) for r in got) == facts
        slots = {}
        for r in got:
            slots.setdefault(r["shard"], []).append(r["slot"])
        assert all(sorted(s) == list(range(len(s))) for s in slots.values())
        sizes = [len(slots.get(s, ())) for s in range(shards)]
        assert max(sizes) - min(sizes) <= 1 and sum(sizes) == len(rows)
        # every shard holds the mixture, give or take one row of a source at either end
        totals = Counter(r["source"] for r in rows)
        for s, n in enumerate(sizes):
            own = Counter(r["source"] for r in got if r["shard"] == s)
            assert all(abs(own[k] - totals[k] * n / len(rows)) <= 2 for k in totals)


def test_shards_are_cut_from_one_order(spark, documents, edge_docs):
    """Against a plain sort by fractional rank and hash."""
    for docs, shards in ((documents, 40), (edge_docs, 7)):
        sources = {}
        for r in docs.select("doc_id", "text", "source").collect():
            text = (r["text"] or "").encode()
            key = xxhash.xxh64_intdigest(struct.pack("<i", sharding.SEED), 42)
            for number in (r["doc_id"], zlib.crc32(text)):
                key = key if number is None else xxhash.xxh64_intdigest(struct.pack("<q", number), key)
            first = (r["doc_id"] is not None, r["doc_id"] or 0)
            sources.setdefault(r["source"], []).append((key >> 1, first, zlib.crc32(text), len(text) + 16, r["doc_id"]))
        order = []
        for source, rows in sources.items():
            name = (source is not None, source or "")
            order += [((i + 0.5) / len(rows), row[0], name, *row[1:]) for i, row in enumerate(sorted(rows, key=lambda x: x[:4]))]
        order.sort(key=lambda x: x[:6])
        want = []
        for i, row in enumerate(order):
            shard = i * shards // len(order)
            want.append((shard, i - -(-shard * len(order) // shards), str(row[-1]), row[4]))
        assert sorted((r["shard"], r["slot"], str(r["doc_id"]), r["text_crc32"]) for r in sharding.shard(docs, shards).collect()) == sorted(want)


def test_shards_of_repeated_rows_and_few_buckets(spark):
    docs = spark.createDataFrame([(1, "same", "a")] * 50 + [(2, None, None)] * 3, "doc_id long, text string, source string")
    got = sharding.shard(docs, 4, buckets=3).collect()
    assert sorted(Counter(r["shard"] for r in got).values()) == [13, 13, 13, 14]


def test_pipeline_line_dedup_of_small_sources(spark):
    sizes = {"one": 1, "two": 2, "four": 4, "none": 2}
    rows = [(10 * k + i, f"nav\nown {i}" if s != "none" else f"nav {i}", "en", s, 9) for k, (s, n) in enumerate(sizes.items()) for i in range(n)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = {r["doc_id"]: (r["text"], r["n_chars"]) for r in corpus_pipeline.line_dedup(spark, docs, "").collect()}
    assert got == {i: (f"own {i % 10}", 5) if s in ("two", "four") else (t, 9) for i, t, _, s, _ in rows}


def test_pipeline_near_dedup_of_repeated_and_null_ids(spark):
    base = " ".join(f"w{i}" for i in range(200))
    rows = [(1, base, "en", "a", 1), (1, base + " tail", "en", "b", 2), (2, base + " end", "de", "a", 3), (3, "other text of few words here", "en", "a", 4)]
    rows += [(None, base, "en", "a", 1)] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = corpus_pipeline.near_dedup(spark, docs, "").collect()
    assert Counter(r["doc_id"] for r in got) == {1: 1, 3: 1, None: 2}


def test_substrings_of_null_ids_whose_short_tags_are_equal(spark):
    """Two texts without an id whose keys share 32 bits lose the words of their own repeated windows only."""
    shared = " ".join(f"s{i}" for i in range(50))
    seen = {}
    for i in range(400_000):
        text = f"{shared} " + " ".join(f"t{i}-{k}" for k in range(2)) if i % 2 else " ".join(f"t{i}-{k}" for k in range(3)) + f" {shared}"
        tag = xxhash.xxh3_128_digest(text.encode())[4:8]
        if tag in seen and seen[tag].startswith("s0") != text.startswith("s0"):
            break
        seen[tag] = text
    docs = spark.createDataFrame([(1, shared), (None, seen[tag]), (None, text)], "doc_id long, text string")
    got = {r["kept"] for r in substrings.dedup_substrings(docs).filter("doc_id is null").collect()}
    assert got == {t.replace(shared, "").strip() for t in (seen[tag], text)}


CLASHES = ("_row", "row", "nth", "of", "stays", "kept", "n_words", "page", "key", "copy", "ids", "host", "_m", "text_key")


def test_pipeline_stages_leave_other_columns_alone(spark):
    text = lambda i: " ".join(f"word{i}x{k}" for k in range(30)) + ".\nA second line of document " + str(i)
    rows = [(i, text(i), "en", f"s{i % 2}", len(text(i)), i) for i in range(12)] + [(20, text(0), "en", "s9", len(text(0)), 20), (21, "", "en", None, 0, 21), (None, None, None, None, None, 22)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, mark long")
    for name in CLASHES:
        docs = docs.withColumn(name, F.concat(F.lit("own "), F.col("mark")))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, docs = docs, stage(spark, docs, "").cache()
        assert docs.columns == before.columns
        found = docs.collect()
        assert all(r[c] == f"own {r['mark']}" for r in found for c in CLASHES)
        marks = {r["mark"] for r in found}
        if name == "quality_rules":
            assert marks == {*range(12), 20}
        if name == "near_dedup":
            assert marks == set(range(12))
        if name == "mix_sources":
            assert marks <= set(range(12)) and len(found) > 3
    last = corpus_pipeline.STAGES[-1][1](spark, docs, "")
    assert last.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and last.count() == docs.count()


def test_mixing_draws_follow_the_formula(spark):
    """High rates in several parts, and a null source, against the inverted distribution."""
    docs = spark.createDataFrame([(i, "big" if i < 2 else None) for i in range(3000)], "doc_id long, source string")
    targets = spark.createDataFrame([("big", 1.0), (None, 1.0)], "source string, weight double")
    got = {(r["row"]["doc_id"]): r["n_copies"] for r in mixing.mix(docs, targets).collect()}
    for doc_id in (0, 1, 2, 50, 2999):
        rate = 3000 * 0.5 / (2 if doc_id < 2 else 2998)
        parts, want = max(math.ceil(rate / 500), 1), 0
        for part in range(1, parts + 1):
            u = (int(hashlib.md5(f"{mixing.SEED}:{doc_id}:{part}".encode()).hexdigest()[:13], 16) + 0.5) / (1 << 52)
            p = cum = math.exp(-rate / parts)
            k = 0
            while cum <= u:
                k += 1
                p = p * (rate / parts) / k
                cum += p
            want += k
        assert got.get(doc_id, 0) == want


def test_pipeline_stages(spark, edge_docs, documents):
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["quality_rules", "line_dedup", "near_dedup", "mix_sources", "sentence_pieces"]
    for docs in (documents, edge_docs.select(documents.columns), documents.filter("1 = 0")):
        for name, stage in corpus_pipeline.STAGES:
            before, docs = docs, stage(spark, docs, "").cache()
            if name != names[-1]:
                assert docs.columns == before.columns
            if name == "near_dedup":
                rows = [(r["doc_id"], r["text"]) for r in before.filter("doc_id is not null").dropDuplicates(["doc_id"]).collect()]
                expected = {i for i, (_, c) in brute_near(rows, 5, 80).items() if i == c}
                ids = [r["doc_id"] for r in docs.filter("doc_id is not null").collect()]
                assert set(ids) == expected and len(ids) == len(expected)
            if name == "line_dedup":
                assert docs.count() == before.count()
