"""Operator 5: MinHash near-dedup by tensored banding, every link verified.

Two collections of SIDE half keys are made from minhashes, HALF in each half
key. A table key combines half key i of the one with half key j of the other:
SIDE * SIDE tables from 2 * SIDE * HALF minhashes, where plain banding would
compute HALF * 2 for each table. At the threshold 0.85 a pair shares a table
with probability over 0.999.

Documents with equal shingle sets collapse into a class first, so copies cost
one row. Buckets are never expanded into pairs:

1. Each class joins the smallest class it meets in any bucket. Such a star is
   split into chunks of bounded size; inside a chunk links are verified on full
   sets, skipping pairs that are joined already. Links found become components.
2. In each bucket that still holds several components, the member with the
   fewest shingles of its own is compared with the members of other components.
3. Whatever is left is done exactly: all members outside the largest component
   of a bucket meet every member of other components. Shingles that no other such member holds bound how much a
   member can share with any other; members and pairs that cannot reach the
   threshold fall away without being compared. The rest pass a test on their
   minhashes, then their full sets are compared.

So every pair that shares a bucket is either verified or already connected.
Shingles are compared as 64-bit hashes of their words.

Defined results: a text with fewer words than a shingle is one shingle of all
its words; without words the set is empty and links with nothing. A null id
links with nothing and is kept. Rows that share an id are one document in the
link graph. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plansift.llm.common import components, written
from plansift.llm.tokens import U64, WordHashes, column_bytes, constants, hashed, mix, slices

HALF = 3
SIDE = 9
#: Members and shingles of a chunk that one task verifies at a time.
CHUNK_ROWS = 128
CHUNK_SHINGLES = 2_000_000
#: Standard deviations below the expected number of equal minhashes at which a pair is still compared in full.
SLACK = 5.0
#: Classes of shingles whose counts bound what two sets share.
CLASSES = 128


class Shingles:
    """Distinct shingle hashes of a slice of texts: values sorted within each text, and offsets."""

    def __init__(self, size: int):
        self.size, self.memory = size, WordHashes()
        self.weights = constants(size, 17)

    def of(self, texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
        values, offsets = hashed([(t or b"").lower().split() for t in texts], self.memory)
        counts = np.diff(offsets)
        n = self.size
        with np.errstate(over="ignore"):
            total = max(len(values) - n + 1, 0)
            runs = np.zeros(total, U64)
            for k in range(n):
                runs += values[k : k + total] * self.weights[k]
            runs = mix(runs)
            sets = []
            for start, count in zip(offsets[:-1].tolist(), counts.tolist(), strict=True):
                if count >= n:
                    sets.append(np.unique(runs[start : start + count - n + 1]))
                elif count:
                    whole = np.array([count], U64)
                    for k in range(count):
                        whole = mix(whole + values[start + k] * self.weights[k])
                    sets.append(whole)
                else:
                    sets.append(np.zeros(0, U64))
        sizes = np.array([len(s) for s in sets], np.int64)
        return np.concatenate(sets) if sets else np.zeros(0, U64), np.concatenate([[0], np.cumsum(sizes)])


def _set_keys(values: np.ndarray, offsets: np.ndarray, full: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits per non-empty set."""
    with np.errstate(over="ignore"):
        k1 = np.add.reduceat(mix(values ^ U64(0xA5A5A5A5)), offsets[:-1][full])
        k2 = np.add.reduceat(mix(values + U64(0x51ED2701)), offsets[:-1][full])
    return k1.view(np.int64), k2.view(np.int64)


def signatures(docs: DataFrame, shingle: int, half: int = HALF, side: int = SIDE) -> DataFrame:
    """doc_id, n, k1 and k2 (key of the set), sig (minhashes), a and b (half keys); null keys for an empty set."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles, hashes = Shingles(shingle), 2 * side * half
        multiply = constants(hashes, 29)
        fold = constants(half, 31)
        for batch in batches:
            texts, ids = column_bytes(batch, "text"), batch.column("doc_id")
            for i, j in slices(texts):
                values, offsets = shingles.of(texts[i:j])
                sizes = np.diff(offsets)
                full = sizes > 0
                sig = np.zeros((j - i, hashes), np.uint32)
                k1, k2 = np.zeros(j - i, np.int64), np.zeros(j - i, np.int64)
                if full.any():
                    k1[full], k2[full] = _set_keys(values, offsets, full)
                    with np.errstate(over="ignore"):
                        for k in range(hashes):
                            low = np.minimum.reduceat(values * multiply[k], offsets[:-1][full])
                            sig[full, k] = (low >> U64(32)).astype(np.uint32)
                        halves = mix((sig.reshape(j - i, 2 * side, half).astype(U64) * fold).sum(axis=2, dtype=U64)
                                     + np.arange(2 * side, dtype=U64)).view(np.int64)
                else:
                    halves = np.zeros((j - i, 2 * side), np.int64)
                off = pa.array(np.arange(0, (j - i) * side + 1, side, dtype=np.int32))
                lists = [pa.ListArray.from_arrays(off, pa.array(np.ascontiguousarray(h).reshape(-1))) for h in (halves[:, :side], halves[:, side:])]
                yield pa.RecordBatch.from_arrays([
                    ids.slice(i, j - i).cast(pa.int64()), pa.array(sizes), pa.array(k1, mask=~full), pa.array(k2, mask=~full),
                    pa.array([row.tobytes() for row in sig], pa.binary()), *lists,
                ], ["doc_id", "n", "k1", "k2", "sig", "a", "b"])

    return docs.select("doc_id", "text").mapInArrow(run, (
        "doc_id long, n long, k1 long, k2 long, sig binary, a array<long>, b array<long>"))


def shingle_sets(texts: DataFrame, shingle: int) -> DataFrame:
    """doc_id, k1, k2, n, items (the set as bytes of sorted 64-bit values) for rows of (doc_id, text)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingles(shingle)
        for batch in batches:
            data, ids = column_bytes(batch, "text"), batch.column("doc_id")
            for i, j in slices(data):
                values, offsets = shingles.of(data[i:j])
                sizes = np.diff(offsets)
                full = sizes > 0
                k1, k2 = np.zeros(j - i, np.int64), np.zeros(j - i, np.int64)
                if full.any():
                    k1[full], k2[full] = _set_keys(values, offsets, full)
                yield pa.RecordBatch.from_arrays([
                    ids.slice(i, j - i).cast(pa.int64()), pa.array(k1, mask=~full), pa.array(k2, mask=~full), pa.array(sizes),
                    pa.array([values[x:y].tobytes() for x, y in zip(offsets[:-1], offsets[1:], strict=True)], pa.binary()),
                ], ["doc_id", "k1", "k2", "n", "items"])

    return texts.select("doc_id", "text").mapInArrow(run, "doc_id long, k1 long, k2 long, n long, items binary")


def similar(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """100 * intersection >= percent * union, on sorted distinct values."""
    small, large = (x, y) if len(x) <= len(y) else (y, x)
    if 100 * len(small) < percent * len(large):
        return False
    at = np.searchsorted(large, small)
    at[at == len(large)] = 0
    both = int((large[at] == small).sum())
    return 100 * both >= percent * (len(x) + len(y) - both)


def _star_links(members: DataFrame, percent: int) -> DataFrame:
    """(star, chunk, id, n, items) -> links (a, b) that connect all similar members of each chunk."""
    def run(data: pd.DataFrame) -> pd.DataFrame:
        data = data.sort_values("id")
        ids = data["id"].tolist()
        sets = [np.frombuffer(x, U64) for x in data["items"]]
        parent = list(range(len(ids)))

        def root(i: int) -> int:
            while parent[i] != i:
                parent[i] = parent[parent[i]]
                i = parent[i]
            return i

        links = []
        for j in range(1, len(ids)):
            for i in range(j):
                a, b = root(i), root(j)
                if a != b and (ids[i] == ids[j] or similar(sets[i], sets[j], percent)):
                    parent[max(a, b)] = min(a, b)
                    if ids[i] != ids[j]:
                        links.append((ids[i], ids[j]))
        return pd.DataFrame(links, columns=["a", "b"], dtype="int64")

    return members.groupBy("star", "chunk").applyInPandas(run, "a long, b long")


def _check_pairs(pairs: DataFrame, percent: int) -> DataFrame:
    """(a, b, items_a, items_b) -> (a, b) of similar sets."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            xs, ys = batch.column("items_a").to_pylist(), batch.column("items_b").to_pylist()
            keep = pa.array([similar(np.frombuffer(x, U64), np.frombuffer(y, U64), percent) for x, y in zip(xs, ys, strict=True)], pa.bool_())
            yield batch.select(["a", "b"]).filter(keep)

    return pairs.select("a", "b", "items_a", "items_b").mapInArrow(run, "a long, b long")


def _agree(pairs: DataFrame, percent: int, hashes: int) -> DataFrame:
    """(a, b, sig_a, sig_b) -> (a, b) whose minhashes could belong to a similar pair."""
    p = percent / 100
    least = int(np.floor(hashes * p - SLACK * np.sqrt(hashes * p * (1 - p))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint32).reshape(-1, hashes) for c in ("sig_a", "sig_b"))
                yield batch.select(["a", "b"]).filter(pa.array((x == y).sum(axis=1) >= least))

    return pairs.select("a", "b", "sig_a", "sig_b").mapInArrow(run, "a long, b long")


def _both(pairs: DataFrame, facts: DataFrame, column: str) -> DataFrame:
    for side in ("a", "b"):
        pairs = pairs.join(facts.select(F.col("id").alias(side), F.col(column).alias(f"{column}_{side}")), side)
    return pairs


def _shared_bounds(sets: DataFrame) -> DataFrame:
    """(id, n, items) -> id, low (size) and most: how many of its shingles any other of these sets can share.

    Shingles that only one set holds count out. An id with several sets keeps its largest size as the bound.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, items in zip(batch.column("id").to_pylist(), batch.column("items").to_pylist(), strict=True):
                values = np.frombuffer(items, np.int64)
                for start in range(0, len(values), 100_000):
                    part = values[start : start + 100_000]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), i)), pa.array(part)], ["id", "shingle"])

    held = sets.select("id", "items").mapInArrow(run, "id long, shingle long").groupBy("shingle").agg(
        F.count(F.lit(1)).alias("c"), F.min("id").alias("id"))
    alone = held.filter("c = 1").groupBy("id").agg(F.count(F.lit(1)).alias("alone"))
    sizes = sets.groupBy("id").agg(F.min("n").alias("low"), F.max("n").alias("high"), F.count(F.lit(1)).alias("c"))
    most = F.when(F.col("c") == 1, F.col("high") - F.coalesce("alone", F.lit(0))).otherwise(F.col("high"))
    return sizes.join(alone, "id", "left").select("id", "low", most.alias("most"))


def _verified(pairs: DataFrame, reps: DataFrame, sets: DataFrame, percent: int, hashes: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar."""
    close = _agree(_both(pairs, reps, "sig"), percent, hashes).distinct()
    return _check_pairs(_both(close, sets, "items"), percent)


def _halves(reps: DataFrame) -> DataFrame:
    """id, a and b: its half keys, which differ by position. Empty for an id with several sets, whose pairs then repeat."""
    one = reps.groupBy("id").agg(F.count(F.lit(1)).alias("c"), F.first("a").alias("a"), F.first("b").alias("b"))
    none = F.array().cast("array<long>")
    return one.select("id", *[F.when(F.col("c") == 1, F.col(c)).otherwise(none).alias(c) for c in ("a", "b")])


def _class_counts(sets: DataFrame) -> DataFrame:
    """id and counts: how many shingles of its set fall in each of CLASSES classes; none for long sets or several of one id."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = [np.bincount((np.frombuffer(x, U64) >> U64(20)) % U64(CLASSES), minlength=CLASSES) for x in batch.column("items").to_pylist()]
            yield pa.RecordBatch.from_arrays([
                batch.column("id"), pa.array([c.astype(np.int8).tolist() if c.max() < 128 else None for c in counts], pa.list_(pa.int8()))], ["id", "counts"])

    held = sets.select("id", "items").mapInArrow(run, "id long, counts array<tinyint>")
    return held.groupBy("id").agg(F.count(F.lit(1)).alias("c"), F.first("counts").alias("counts")).filter("c = 1").drop("c")


def _may_link(alive: DataFrame, percent: int) -> DataFrame:
    """Rows of (key, id, comp, low, most) that could be similar to the smallest other set of their bucket, at best."""
    least = alive.groupBy("key").agg(F.min("low").alias("least"))
    fits = 100 * F.col("most") >= percent * (F.col("low") + F.greatest("least", "most") - F.col("most"))
    return alive.join(least, "key").filter(fits).drop("least")


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80, half: int = HALF, side: int = SIDE) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for every row of ``docs`` (doc_id, text)."""
    marks = written(signatures(docs, shingle, half, side))
    linkable = marks.filter("n > 0 and doc_id is not null")
    classes = linkable.groupBy("k1", "k2").agg(F.min("doc_id").alias("id"))
    reps = written(
        linkable.join(classes.select(F.col("id").alias("doc_id"), "k1", "k2"), ["doc_id", "k1", "k2"])
        .select(F.col("doc_id").alias("id"), "k1", "k2", "n", "sig", "a", "b"))
    keys = reps.select("id", F.posexplode("a").alias("i", "ka"), "b").select("id", "i", "ka", F.posexplode("b").alias("j", "kb")).select(
        "id", F.xxhash64("ka", "kb").alias("key"), F.col("i").cast("byte").alias("i"), F.col("j").cast("byte").alias("j"))
    crowded = keys.groupBy("key").agg(F.min("id").alias("low"), F.max("id").alias("high")).filter("low < high").select("key", "low")
    buckets = written(keys.join(crowded, "key"))

    stars = written(buckets.groupBy("id").agg(F.min("low").alias("star")))
    # full sets of all classes in crowded buckets, from their representatives' texts
    wanted = reps.select("id", "k1", "k2").join(stars.select("id"), "id")
    texts = docs.select("doc_id", "text").join(wanted.select(F.col("id").alias("doc_id")).distinct(), "doc_id")
    sets = written(
        shingle_sets(texts, shingle).withColumnRenamed("doc_id", "id").join(wanted, ["id", "k1", "k2"]).dropDuplicates(["id", "k1", "k2"])
        .select("id", "n", "items"))

    sized = stars.join(sets, "id")
    weight = sized.groupBy("star").agg(F.count(F.lit(1)).alias("rows"), F.sum("n").alias("shingles")).select(
        "star", F.greatest(F.ceil(F.col("rows") / CHUNK_ROWS), F.ceil(F.col("shingles") / CHUNK_SHINGLES)).cast("int").alias("chunks"))
    members = sized.join(weight, "star").select("star", F.pmod(F.xxhash64("id"), F.col("chunks")).cast("int").alias("chunk"), "id", "n", "items")
    centres = weight.join(sets.withColumnRenamed("id", "star"), "star").select(
        "star", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), F.col("star").alias("id"), "n", "items")
    links = written(_star_links(members.filter("id <> star").unionByName(centres), percent))

    first = components(links)
    named = buckets.select("key", "i", "j", "id").distinct().join(first, "id", "left").withColumn("comp", F.coalesce("comp", "id"))
    mixed = named.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo < hi").select("key")
    alive = written(named.join(mixed, "key"))
    bounds = written(_shared_bounds(alive.select("id").distinct().join(sets, "id")))
    alive = written(_may_link(alive.join(bounds, "id"), percent).join(_halves(reps), "id"))
    # first the member of each bucket with the fewest shingles of its own, the likeliest to link the others
    nearest = alive.groupBy("key").agg(F.min_by(
        F.struct("id", "comp", "low", "most"), F.struct(F.col("low") - F.col("most"), "id")).alias("near"))
    both = F.least("most", "near.most")
    tried = alive.join(nearest, "key").filter(
        (F.col("comp") != F.col("near.comp")) & (100 * both >= percent * (F.col("low") + F.col("near.low") - both)))
    tried = tried.select(F.least("id", "near.id").alias("a"), F.greatest("id", "near.id").alias("b")).distinct()
    more = written(_verified(tried, reps, sets, percent, 2 * side * half))
    names = alive.select("id", "comp").distinct()
    joined = more.join(names.withColumnRenamed("id", "a").withColumnRenamed("comp", "ca"), "a").join(
        names.withColumnRenamed("id", "b").withColumnRenamed("comp", "cb"), "b").select(F.col("ca").alias("a"), F.col("cb").alias("b"))
    renamed = components(joined).select(F.col("id").alias("comp"), F.col("comp").alias("new"))
    alive = alive.join(renamed, "comp", "left").withColumn("comp", F.coalesce("new", "comp")).drop("new")
    mixed = alive.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo < hi").select("key")
    alive = alive.join(mixed, "key")
    alive = written(alive.join(_class_counts(alive.select("id").distinct().join(sets, "id")), "id", "left"))

    # then all that is left
    largest = alive.groupBy("key", "comp").agg(F.count(F.lit(1)).alias("c")).groupBy("key").agg(
        F.max_by("comp", F.struct("c", "comp")).alias("largest"))
    strays = alive.join(largest, "key").filter("comp <> largest").select(
        "key", F.col("id").alias("x"), F.col("comp").alias("comp_x"), F.col("low").alias("low_x"), F.col("most").alias("most_x"),
        F.col("a").alias("a_x"), F.col("b").alias("b_x"), F.col("counts").alias("counts_x"), "largest")
    both = F.least("most", "most_x")
    shared = F.aggregate(F.zip_with("counts", "counts_x", lambda x, y: F.least(x, y).cast("long")), F.lit(0).cast("long"), lambda acc, v: acc + v)
    met = strays.join(alive, "key").filter(
        (F.col("comp") != F.col("comp_x")) & ((F.col("comp") == F.col("largest")) | (F.col("x") < F.col("id")))
        & (100 * both >= percent * (F.col("low") + F.col("low_x") - both))
        # a pair meets in many tables; it is taken from the first
        & ~F.arrays_overlap(F.slice("a", 1, F.col("i")), F.slice("a_x", 1, F.col("i")))
        & ~F.arrays_overlap(F.slice("b", 1, F.col("j")), F.slice("b_x", 1, F.col("j")))
        # sets share at most the smaller count of each class of shingles
        & F.coalesce((100 + percent) * shared >= percent * (F.col("low") + F.col("low_x")), F.lit(True)))
    pairs = met.select(F.least("x", "id").alias("a"), F.greatest("x", "id").alias("b")).distinct()
    rest = _verified(pairs, reps, sets, percent, 2 * side * half)
    every = components(links.unionByName(more).unionByName(rest))

    class_comp = classes.join(every, "id", "left").select("k1", "k2", F.coalesce("comp", "id").alias("comp"))
    out = marks.select("doc_id", "n", F.when(F.col("doc_id").isNotNull(), F.col("k1")).alias("k1"), "k2").join(class_comp, ["k1", "k2"], "left")
    comp = F.coalesce("comp", "doc_id")
    return out.select(
        "doc_id", F.col("n").alias("n_shingles"), comp.alias("component_id"),
        F.coalesce(F.col("doc_id") == comp, F.lit(True)).alias("kept"))
