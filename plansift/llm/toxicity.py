"""Operator 4: toxicity by class-conditional Kneser-Ney models.

Each class has its own model P(word | word before): the number of times the word
follows the other in texts of that class, less the discount. What the discount
takes away goes to the word's continuation count, the number of different words
that it follows in texts of the class, so that copies of a text count once
there. What the discount takes of that goes to the word's beginning (its first
letters), counted in the same way for the class, and from there to counts shared
by both classes. A rare word therefore scores as its beginning does, and a word
that is new in both classes says nothing beyond what stood before it.

A document is compared by its log-likelihood ratio (toxic against ordinary) per
word, over all its words and over its most telling ones, under the whole model
and under the continuation counts alone; a logistic curve fitted on documents
that gave no counts turns these into a score. The discount with the
least loss on those documents is used.

Counts come from a sample of labelled documents that is bounded by
``max_labelled``, drawn by a hash of the id; scoring covers whole texts of all
documents. Only the text enters a score.

Defined results: null and empty texts score as a text without any telling word.
Labels that are null, that stand on held-out ids or on unknown documents are not
used; of several labels of one id the greatest counts. Without labels of both
classes every score is the share of toxic labels.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plansift.llm.common import md5_unit, written

MAX_LABELLED = 16000
BEGINNING = 5
DISCOUNTS = (1.5, 2.5, 4.0, 8.0)
#: Share of the labelled sample that calibrates instead of giving counts.
CALIBRATION = 0.3
THRESHOLD = 0.3
TOP = 3
#: Ratio per word, best and TOP best, under both models.
FEATURES = 6
WORD = re.compile(r"[^\W\d_]+")
MEMORY = 1 << 19


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % 4 == 2, F.lit(False))


def word_pairs(rows: DataFrame) -> DataFrame:
    """before, word and how often they stand together in ordinary (c0) and toxic texts (c1); before is empty at the first word."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 200):
                part = batch.slice(start, 200)
                toxic, before, word, n = [], [], [], []
                for text, label in zip(part.column("text").to_pylist(), part.column("toxic").to_pylist(), strict=True):
                    words = WORD.findall((text or "").lower())
                    pairs = Counter(zip(["", *words], words, strict=False))
                    toxic += [label] * len(pairs)
                    before += [b for b, _ in pairs]
                    word += [w for _, w in pairs]
                    n += pairs.values()
                yield pa.RecordBatch.from_arrays(
                    [pa.array(toxic, pa.int32()), pa.array(before, pa.string()), pa.array(word, pa.string()), pa.array(n, pa.int64())],
                    ["toxic", "before", "word", "n"])

    each = rows.select("text", F.col("toxic").cast("int").alias("toxic")).mapInArrow(run, "toxic int, before string, word string, n long")
    return each.groupBy("before", "word").agg(*[F.sum(F.when(F.col("toxic") == c, F.col("n")).otherwise(0)).alias(f"c{c}") for c in (0, 1)])


@dataclass
class Counts:
    """Continuation counts per expression (ordinary, toxic, shared) and what discounts need of the rest."""

    kept: dict[str, tuple[int, int, int]] = field(default_factory=dict)
    total: tuple[int, int] = (0, 0)
    shared: int = 0
    #: per class, the number of expressions with a count of 1, 2, ... up to the largest discount
    of_count: tuple[dict[int, int], dict[int, int]] = field(default_factory=lambda: ({}, {}))

    def backoff(self, label: int, discount: float) -> float:
        taken = sum(n * min(discount, k) for k, n in self.of_count[label].items())
        return taken / self.total[label] if self.total[label] else 1.0

    def own(self, label: int, discount: float, n: tuple[int, int, int]) -> float:
        return max(n[label] - discount, 0) / max(self.total[label], 1)


def often() -> Column:
    """Whether a pair keeps a count of its own after some discount."""
    return F.greatest("c0", "c1") > min(DISCOUNTS)


def continuation_counts(pairs: DataFrame, expression: Column) -> Counts:
    """Counts of one kind of expression; those seen twice in a class or in a frequent pair come to the driver.

    The sample bounds their number; the others have no count of their own left after any discount.
    """
    table = written(pairs.groupBy(expression.alias("e")).agg(
        F.count_if(F.col("c0") > 0).alias("n0"), F.count_if(F.col("c1") > 0).alias("n1"), F.count(F.lit(1)).alias("s"),
        F.max(often()).alias("often")))
    top = int(max(DISCOUNTS)) + 1
    sums = table.agg(F.sum("n0").alias("a"), F.sum("n1").alias("b"), F.sum("s").alias("s")).first()
    of_count = []
    for column in ("n0", "n1"):
        found = table.filter(F.col(column) > 0).groupBy(F.least(column, F.lit(top)).alias("k")).agg(F.count(F.lit(1)).alias("n")).collect()
        of_count.append({r["k"]: r["n"] for r in found})
    got = table.filter("n0 > 1 or n1 > 1 or often").select("e", "n0", "n1", "s").toArrow()
    kept = {e: (n0, n1, s) for e, n0, n1, s in zip(*[c.to_pylist() for c in got.columns], strict=True)}
    return Counts(kept, (sums["a"] or 0, sums["b"] or 0), sums["s"] or 0, (of_count[0], of_count[1]))


class Ids(dict):
    """Numbers of words: known ones first, then one for all without counts, then those of beginnings."""

    def __init__(self, words: list[str], beginnings: list[str]):
        super().__init__(zip(words, range(len(words)), strict=True))
        self.words, self.others = words, {e: len(words) + 1 + k for k, e in enumerate(beginnings)}

    def __missing__(self, word: str) -> int:
        if len(self) >= MEMORY + len(self.words):
            self.clear()
            self.update(zip(self.words, range(len(self.words)), strict=True))
        value = self[word] = self.others.get(word[:BEGINNING], len(self.words))
        return value


@dataclass
class Ratios:
    """Log-likelihood ratios of one discount, measured against a word new in both classes, whose ratio is 0."""

    #: by number of a word: of its continuation counts, and of what is left to them after the word
    lowest: np.ndarray
    after: np.ndarray
    #: by place in the sorted frequent pairs
    pairs: np.ndarray

    def features(self, word: np.ndarray, before: np.ndarray, place: np.ndarray, hit: np.ndarray) -> list[float]:
        """Ratio per word over the whole text, of its most telling word, and of its TOP most telling words, under both models."""
        lowest = self.lowest[word]
        return [*_summary(np.where(hit, self.pairs[place], lowest + self.after[before])), *_summary(lowest)]


def _summary(values: np.ndarray) -> tuple[float, float, float]:
    if not len(values):
        return 0.0, 0.0, 0.0
    best = np.partition(values, len(values) - TOP)[-TOP:] if len(values) > TOP else values
    return float(values.sum()) / len(values), float(best.max()), float(best.sum()) / TOP


@dataclass
class Tables:
    """What scoring looks up: numbers of words, sorted keys of frequent pairs, and the ratios of some discounts."""

    words: list[str]
    beginnings: list[str]
    keys: np.ndarray
    ratios: list[Ratios]

    def reader(self):
        """A function from a text to the features of each discount."""
        ids = Ids(self.words, self.beginnings)

        def read(text: str | None) -> list[list[float]]:
            found = np.fromiter(map(ids.__getitem__, ["", *WORD.findall((text or "").lower())]), np.int64)
            before, word = found[:-1], found[1:]
            key = before << 32 | word
            place = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            return [r.features(word, before, place, self.keys[place] == key) for r in self.ratios]

        return read

    @staticmethod
    def of(pairs: DataFrame) -> Tables:
        """Tables for all discounts; frequent pairs and the words before them come to the driver, bounded by the sample."""
        words = continuation_counts(pairs, F.col("word"))
        beginnings = continuation_counts(pairs, F.substring("word", 1, BEGINNING))
        taken = [F.sum(F.least(F.col(f"c{c}").cast("double"), F.lit(d))).alias(f"t{c}_{k}") for k, d in enumerate(DISCOUNTS) for c in (0, 1)]
        rows = pairs.groupBy("before").agg(F.sum("c0").alias("c0"), F.sum("c1").alias("c1"), F.max(often()).alias("often"), *taken)
        contexts = rows.filter("often").drop("often").toArrow()
        frequent = pairs.filter(often()).select("before", "word", "c0", "c1").toArrow()

        names = sorted(words.kept.keys() | set(contexts.column("before").to_pylist()))
        heads = sorted(beginnings.kept)
        numbers = pa.array(names, pa.string())
        size = len(names) + 1 + len(heads)
        at = lambda column: pc.index_in(column.cast(pa.string()), value_set=numbers).to_numpy().astype(np.int64)
        before, word = at(frequent.column("before")), at(frequent.column("word"))
        order = np.argsort(before << 32 | word)
        before, word = before[order], word[order]
        counts = [frequent.column(f"c{c}").to_numpy()[order] for c in (0, 1)]
        # a key that no text has keeps the table from being empty
        keys = np.append(before << 32 | word, np.iinfo(np.int64).max)

        ratios = []
        for k, discount in enumerate(DISCOUNTS):
            first = [beginnings.backoff(c, discount) for c in (0, 1)]
            second = [words.backoff(c, discount) for c in (0, 1)]
            base = math.log(first[1] / first[0])
            offset = base + math.log(second[1] / second[0])
            start = {e: [beginnings.own(c, discount, n) + first[c] * n[2] / beginnings.shared for c in (0, 1)] for e, n in beginnings.kept.items()}
            of_head = {e: math.log(p[1] / p[0]) - base for e, p in start.items()}
            lowest, likely = np.zeros(size), np.zeros((2, len(names)))
            lowest[len(names) + 1 :] = [of_head[e] for e in heads]
            for i, e in enumerate(names):
                n, head = words.kept.get(e), e[:BEGINNING]
                if n is None:
                    lowest[i] = of_head.get(head, 0.0)
                    continue
                below, of = start[head], beginnings.kept[head][2]
                p = [words.own(c, discount, n) + second[c] * below[c] * n[2] / of for c in (0, 1)]
                likely[:, i] = p
                lowest[i] = math.log(p[1] / p[0]) - offset
            # what the discount takes of a word's followers; a word that a class does not have leaves all to the lower counts
            left, times = np.ones((2, size)), np.ones((2, size))
            for c in (0, 1):
                total = contexts.column(f"c{c}").to_numpy()
                place = at(contexts.column("before"))
                left[c, place] = np.where(total > 0, contexts.column(f"t{c}_{k}").to_numpy() / np.maximum(total, 1), 1.0)
                times[c, place] = np.maximum(total, 1)
            p = [np.maximum(counts[c] - discount, 0) / times[c, before] + left[c, before] * likely[c, word] for c in (0, 1)]
            ratios.append(Ratios(lowest, np.log(left[1] / left[0]), np.append(np.log(p[1] / p[0]) - offset, 0.0)))
        return Tables(names, heads, keys, ratios)


@dataclass
class Curve:
    """A logistic curve over standardised features."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    loss: float

    def __call__(self, x: np.ndarray) -> np.ndarray:
        z = self.weights[0] + ((x - self.mean) / self.scale) @ self.weights[1:]
        return 1 / (1 + np.exp(-np.clip(z, -60, 60)))

    @staticmethod
    def fitted(x: np.ndarray, y: np.ndarray) -> Curve:
        mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-9
        full = np.column_stack([np.ones(len(x)), (x - mean) / scale])
        curve = Curve(mean, scale, np.zeros(full.shape[1]), 0.0)
        ridge = 1e-4 * len(y)
        for _ in range(100):
            p = curve(x)
            slope = full.T @ (p - y) + ridge * np.r_[0, curve.weights[1:]]
            bend = (full * (p * (1 - p))[:, None]).T @ full + ridge * np.eye(full.shape[1])
            step = np.linalg.solve(bend, slope)
            curve.weights = curve.weights - step
            if np.abs(step).max() < 1e-8:
                break
        p = np.clip(curve(x), 1e-12, 1 - 1e-12)
        curve.loss = float(-(y * np.log(p) + (1 - y) * np.log(1 - p)).mean())
        return curve


def labelled_sample(docs: DataFrame, labels: DataFrame, max_labelled: int) -> DataFrame:
    """(text, toxic, fit) of at most ``max_labelled`` labelled documents outside the held-out part."""
    usable = labels.filter(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    chosen = (
        usable.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
        .withColumn("u", md5_unit("labelled", F.col("doc_id"))).orderBy("u", "doc_id").limit(max_labelled))
    return written(
        docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # bounded by max_labelled
        .select("text", "toxic", (md5_unit("fold", F.col("doc_id")) >= CALIBRATION).alias("fit")))


@dataclass
class Model:
    #: with the ratios of the one discount chosen
    tables: Tables | None
    curve: Curve | None
    prior: float


def train(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> Model:
    sample = labelled_sample(docs, labels, max_labelled)
    sizes = {(r["fit"], r["toxic"]): r["n"] for r in sample.groupBy("fit", "toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    n = sum(sizes.values())
    prior = sum(v for (_, toxic), v in sizes.items() if toxic == 1) / n if n else 0.0
    if not all(sizes.get((True, c)) for c in (0, 1)):
        return Model(None, None, prior)
    tried = Tables.of(written(word_pairs(sample.filter("fit"))))
    judged = sample.filter("not fit") if all(sizes.get((False, c)) for c in (0, 1)) else sample
    shared = docs.sparkSession.sparkContext.broadcast(tried)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = shared.value.reader()
        for batch in batches:
            rows = [[x for features in read(t) for x in features] for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), pa.array(rows, pa.list_(pa.float64()))], ["toxic", "x"])

    got = judged.select("text", F.col("toxic").cast("int").alias("toxic")).mapInArrow(run, "toxic int, x array<double>").collect()
    x, y = np.array([r["x"] for r in got]), np.array([r["toxic"] for r in got], float)
    curves = [Curve.fitted(x[:, FEATURES * k : FEATURES * (k + 1)], y) for k in range(len(DISCOUNTS))]
    best = min(range(len(DISCOUNTS)), key=lambda k: curves[k].loss)
    return Model(replace(tried, ratios=[tried.ratios[best]]), curves[best], prior)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and score for every row of ``docs``."""
    shared = docs.sparkSession.sparkContext.broadcast(model.tables)  # bounded by the sample
    curve, prior = model.curve, model.prior

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = shared.value.reader() if shared.value else None
        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                part = batch.slice(start, 500)
                if read is None:
                    scores = np.full(part.num_rows, prior)
                else:
                    scores = curve(np.array([read(t)[0] for t in part.column("text").to_pylist()]).reshape(-1, FEATURES))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(scores, pa.float64())], ["doc_id", "score"])

    id_type = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {id_type}, score double")


def toxicity(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score and predicted for every document."""
    scored = score(docs, train(docs, labels, max_labelled))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
