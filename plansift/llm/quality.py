"""Operator 2: quality rules as a short-circuit cascade (native).

Base counts are made for every document. The rules then run as one nested
CASE: a document that a rule rejects never reaches the next one. The order is
measured, not fixed: each rule runs alone on a bounded sample, and rules with
the most rejections per second come first. The order changes the cost only; a
document is kept if it passes every rule, in whatever order.

Defined results: null and blank texts have no words, so they fail the base
rule. Repeated rows are judged alike. An empty table gives no rows. Texts of any
length are read whole. The columns of the input come back inside ``row``, so none
of them clashes with the operator's own.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plansift.llm.common import SPACES, let, words, written

NGRAM = 5
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
SYMBOLS = "#*$%&|<>"
#: Rows of the sample that orders the rules; it never decides about a document.
SAMPLE_ROWS = 400
#: Copies of the sample in a timed run, so that a rule's work shows beside the cost of a job.
REPEATS = 20


@dataclass(frozen=True)
class Rule:
    """``rejects`` gets the column names of :func:`with_base` and is true for bad documents."""

    name: str
    rejects: Callable[[], Column]


def _word_lines(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), "\n", -1), lambda line: F.btrim(line, F.lit(SPACES)) != "")


def _share_of_lines(pattern: str) -> Column:
    return let(_word_lines(F.col("text")), lambda lines: (
        F.size(F.filter(lines, lambda line: line.rlike(pattern))) / F.greatest(F.size(lines), F.lit(1))))


RULES = [
    Rule("symbols", lambda: 10 * F.col("n_symbols") > 3 * F.col("n_words")),
    Rule("word_length", lambda: (F.col("word_chars") < 2 * F.col("n_words")) | (F.col("word_chars") > 20 * F.col("n_words"))),
    Rule("repeated_lines", lambda: 2 * F.col("n_dup_lines") > F.size(_word_lines(F.col("text")))),
    Rule("no_letters", lambda: let(
        F.length(F.regexp_replace("text", r"[0-9\x21-\x40\x5B-\x60\x7B-\x7E\x09-\x0D\x20]+", "")),
        lambda letters: 4 * letters < F.col("word_chars"))),
    Rule("ellipsis_lines", lambda: _share_of_lines(r"(\.\.\.|\x{2026})[\x20\x09-\x0D]*$") > 0.3),
    Rule("bullet_lines", lambda: _share_of_lines(r"^[\x20\x09-\x0D]*[-*\x{2022}][\x20]") > 0.9),
    Rule("long_word", lambda: F.col("text").rlike(r"[^\x20\x09-\x0D]{1000}")),
]


def repeated_words(tokens: Column, n: int = NGRAM) -> Column:
    """Words of an array that lie in an n-word window found twice or more in it.

    Windows are compared by a 64-bit hash of their words inside one text. Most
    texts repeat none, which the distinct count settles; only the others sort.
    """
    def cover(hashes: Column) -> Column:
        pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), (i + 1).alias("p"))))

        def positions(s: Column) -> Column:
            same = lambda x, y: F.coalesce(x["h"] == y["h"], F.lit(False))
            flagged = F.transform(s, lambda x, j: F.when(same(F.get(s, j - 1), x) | same(F.get(s, j + 1), x), x["p"]))
            return F.sort_array(F.filter(flagged, lambda p: p.isNotNull()))

        def total(p: Column) -> Column:
            steps = F.zip_with(p, F.slice(p, 2, F.size(p)), lambda x, y: F.least(F.coalesce(y - x, F.lit(n)), F.lit(n)))
            return F.aggregate(steps, F.lit(0).cast("long"), lambda acc, step: acc + step)

        return let(let(pairs, positions), total)

    def of(w: Column) -> Column:
        # reading five words by index is several times cheaper than cutting a slice for each window
        every = F.transform(w, lambda word, i: F.xxhash64(word, *[F.get(w, i + k) for k in range(1, n)]))
        hashes = F.slice(every, 1, F.size(w) - (n - 1))
        return F.when(F.size(w) <= n, F.lit(0).cast("long")).otherwise(let(hashes, lambda h: F.when(
            F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(cover(h))))

    return let(tokens, of)


def with_base(docs: DataFrame) -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed."""
    text = F.coalesce(F.col("text"), F.lit(""))
    measured = let(words(F.col("text")), lambda w: F.struct(
        F.size(w).cast("long").alias("n_words"),
        F.length(F.concat_ws("", w)).cast("long").alias("word_chars"),
        repeated_words(w).alias("n_repeat_words"),
    ))
    dup_lines = let(_word_lines(text), lambda lines: F.size(lines) - F.size(F.array_distinct(lines)))
    return (
        docs.withColumn("_m", measured)
        .withColumn("n_words", F.col("_m.n_words")).withColumn("word_chars", F.col("_m.word_chars"))
        .withColumn("n_symbols", F.length(F.regexp_replace(text, f"[^{SYMBOLS}]+", "")).cast("long"))
        .withColumn("n_dup_lines", dup_lines.cast("long"))
        .withColumn("n_repeat_words", F.col("_m.n_repeat_words"))
        .withColumn("base_failed", (F.col("n_words") < MIN_WORDS)
                    | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")))
        .drop("_m")
    )


def rule_order(docs: DataFrame, rules: list[Rule] = RULES, sample_rows: int = SAMPLE_ROWS) -> list[Rule]:
    """Rules by rejections per second on a sample of ``docs``, best first.

    Only rows that pass the base rule count, as only they reach the cascade. A
    rule's time is the shorter one of two runs over REPEATS copies of the sample.
    """
    drawn = docs.select("text").sample(min(1.0, 2 * sample_rows / max(docs.count(), 1)), seed=11).limit(sample_rows)
    sample = written(with_base(drawn).filter("not base_failed")).withColumn("_copy", F.explode(F.sequence(F.lit(1), F.lit(REPEATS))))

    def run(column: Column) -> tuple[float, int, int]:
        times = []
        for _ in range(2):
            start = time.perf_counter()
            row = sample.agg(F.sum(column.cast("long")).alias("bad"), F.count(F.lit(1)).alias("n")).first()
            times.append(time.perf_counter() - start)
        return min(times), row["bad"] or 0, row["n"]

    floor, _, n = run(F.length("text") < 0)
    if not n:
        return list(rules)
    score = {}
    for rule in rules:
        cost, bad, _ = run(F.coalesce(rule.rejects(), F.lit(False)))
        score[rule.name] = (bad + 0.5) / (n + 1) / max(cost - floor, 1e-4)
    return sorted(rules, key=lambda rule: -score[rule.name])


def cascade(rules: list[Rule]) -> Column:
    """True if no rule rejects; CASE stops at the first that does."""
    verdict = F.lit(True)
    for rule in reversed(rules):
        verdict = F.when(F.coalesce(rule.rejects(), F.lit(False)), F.lit(False)).otherwise(verdict)
    return F.when(F.col("base_failed"), F.lit(False)).otherwise(verdict)


def quality(docs: DataFrame, rules: list[Rule] = RULES, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """A row per document: ``row`` (all its columns, untouched), the base counts, base_failed and kept."""
    order = rule_order(docs, rules, sample_rows)
    return with_base(docs.select(F.struct("*").alias("row"), "text")).withColumn("kept", cascade(order))
