"""Operator 6: substring dedup behind a count-min prefilter.

A window is 50 consecutive words of a document. A word goes if a window over it
also starts in a document with a smaller id.

1. Each task counts the windows of its partition in a sketch of two rows with
   2**32 cells. A window is counted through its minimiser, the smallest hash
   among its 26 runs of 25 words: equal windows have equal minimisers, so a
   minimiser's count is never below the window's, while only one position in
   fourteen is counted. A document counts a minimiser once. The partial sketches
   (sorted cell numbers) are merged by shard, sums stop at two. A third row
   counts whole texts.
2. The cells counted twice are folded into one bit map, as wide as their number
   asks for up to MAX_CELLS, which bounds what is broadcast (MAX_CELLS / 8
   bytes). Beyond that width only more windows pass.
3. A second pass over the texts keeps the windows whose estimate is two or more
   in both rows. Exactly those are grouped by 96 bits of hash of their words, and
   the smallest document id of each group decides. Of texts estimated equal, all
   but the first go as a whole and only the first brings windows.

Estimates are never too low, so no repeated window is lost. A passage that very
many documents share is summed in the map tasks; the join that marks it is a
sort-merge join which Spark splits when skewed.

Defined results: null text has no words. Documents under 50 words keep all. A
null id counts as larger than all others. Rows that share an id never remove
words from each other. An empty table gives no rows; columns besides doc_id and
text are never looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plansift.llm.common import written
from plansift.llm.tokens import U64, WordHashes, column_bytes, constants, hashed, mix, slices

WINDOW = 50
GRAM = 25
#: Cells of all sketch rows together; one bit each is broadcast, 128 MB at most.
MAX_CELLS = 1 << 30
MIN_CELLS = 1 << 16
CELLS_PER_ITEM = 64
#: Rows of the sketch: two for minimisers, one for whole texts.
ROWS, TEXTS = 3, 2
SHARD_BITS = 8
LAST_ID = (1 << 63) - 1


class Rolling:
    """Polynomial hashes of all runs of n words, from prefix sums modulo 2**64."""

    def __init__(self, seed: int):
        self.base = int(constants(1, seed)[0])
        self.inverse = pow(self.base, -1, 1 << 64)
        self.powers = self.inverses = np.ones(1, U64)

    def __call__(self, values: np.ndarray, n: int) -> np.ndarray:
        size = len(values)
        if size < n:
            return np.zeros(0, U64)
        with np.errstate(over="ignore"):
            if len(self.powers) < size:
                ones = np.ones(size, U64)
                self.powers = np.cumprod(np.where(np.arange(size) > 0, U64(self.base), ones))
                self.inverses = np.cumprod(np.where(np.arange(size) > 0, U64(self.inverse), ones))
            sums = np.concatenate([np.zeros(1, U64), np.cumsum(values * self.powers[:size])])
            return mix((sums[n:] - sums[:-n]) * self.inverses[: size - n + 1])


def sliding_min(values: np.ndarray, n: int) -> np.ndarray:
    """Minimum of every run of n values, by doubling."""
    width, out = 1, values
    while width < n:
        step = min(width, n - width)
        out = np.minimum(out[:-step], out[step:])
        width += step
    return out


class Windows:
    """Windows of a slice of documents: their start, document and minimiser."""

    def __init__(self, window: int, gram: int):
        self.window, self.gram = window, gram
        self.memory, self.grams = WordHashes(), Rolling(101)
        self.first, self.second = Rolling(202), Rolling(303)

    def of(self, texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Word hashes, document offsets, and for each window inside one document: start, document, minimiser."""
        values, offsets = hashed(texts, self.memory)
        low = sliding_min(self.grams(values, self.gram), self.window - self.gram + 1)
        starts = np.arange(len(low))
        doc = np.searchsorted(offsets, starts, side="right") - 1
        inside = starts + self.window <= offsets[doc + 1] if len(low) else np.zeros(0, bool)
        return values, offsets, starts[inside], doc[inside], low[inside]


def _cells(low: np.ndarray, row: int) -> np.ndarray:
    """A 32-bit cell number per minimiser and row; narrower maps use its top bits."""
    return ((low >> U64(32)) if row == 0 else (low & U64(0xFFFFFFFF))).astype(np.uint32)


def _sketch_batches(rows: dict[int, np.ndarray]) -> Iterator[pa.RecordBatch]:
    """(row, shard, cells): sorted cell numbers of one partition, repeated once for each further document."""
    for row, values in rows.items():
        cells = np.sort(values)
        cuts = np.searchsorted(cells >> np.uint32(32 - SHARD_BITS), np.arange((1 << SHARD_BITS) + 1))
        parts = [(s, cells[a:b]) for s, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if b > a]
        yield pa.RecordBatch.from_arrays([
            pa.array([row] * len(parts), pa.int32()), pa.array([s for s, _ in parts], pa.int32()),
            pa.array([c.tobytes() for _, c in parts], pa.binary()),
        ], ["row", "shard", "cells"])


def _once_each(doc: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Values without repeats inside a document."""
    if not len(values):
        return values
    order = np.lexsort((values, doc))
    values, doc = values[order], doc[order]
    return values[np.concatenate([[True], (values[1:] != values[:-1]) | (doc[1:] != doc[:-1])])]


def partial_sketches(docs: DataFrame, window: int, gram: int) -> DataFrame:
    """A partial sketch of the minimisers (rows 0 and 1) and of the texts (row 2) of each partition of ``docs``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows, found, whole = Windows(window, gram), [], []
        for batch in batches:
            texts = column_bytes(batch, "text")
            for i, j in slices(texts):
                split = [(t or b"").split() for t in texts[i:j]]
                _, _, _, doc, low = windows.of(split)
                found.append(_once_each(doc, low))
                whole += [_text_key(w)[:4] for w in split if len(w) >= window]
        if whole:
            low = np.concatenate(found)
            yield from _sketch_batches({0: _cells(low, 0), 1: _cells(low, 1), TEXTS: np.frombuffer(b"".join(whole), np.uint32)})

    return docs.select("text").mapInArrow(run, "row int, shard int, cells binary")


def merged_cells(partial: DataFrame) -> DataFrame:
    """(row, shard, n, cells): the cells of a shard counted twice or more over all partitions."""
    size = 1 << (32 - SHARD_BITS)

    def run(key: tuple, parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        once, twice = np.zeros(size, bool), np.zeros(size, bool)
        for part in parts:
            for data in part["cells"]:
                cells = np.frombuffer(data, np.uint32) & np.uint32(size - 1)
                twice[cells[1:][cells[1:] == cells[:-1]]] = True
                twice[cells[once[cells]]] = True
                once[cells] = True
        cells = (np.flatnonzero(twice) + int(key[1]) * size).astype(np.uint32)
        yield pd.DataFrame({"row": [int(key[0])], "shard": [int(key[1])], "n": [len(cells)], "cells": [cells.tobytes()]})

    # annotations name the iterator form; they are set here because the module's are strings
    run.__annotations__ = {"key": tuple, "parts": Iterator[pd.DataFrame], "return": Iterator[pd.DataFrame]}
    return partial.groupBy("row", "shard").applyInPandas(run, "row int, shard int, n long, cells binary")


def folded(merged: DataFrame, bits: int) -> DataFrame:
    """(row, shard, part): bit maps of 2**bits cells a row, in parts of a shard each; a cell folds to its top bits."""
    width = bits - SHARD_BITS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = []
            for data in batch.column("cells").to_pylist():
                cells = (np.frombuffer(data, np.uint32) & np.uint32((1 << (32 - SHARD_BITS)) - 1)) >> np.uint32(32 - SHARD_BITS - width)
                held = np.zeros(1 << width, bool)
                held[cells] = True
                parts.append(np.packbits(held).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("shard"), pa.array(parts, pa.binary())], ["row", "shard", "part"])

    return merged.select("row", "shard", "cells").mapInArrow(run, "row int, shard int, part binary")


@dataclass
class Sketch:
    """One bit for each folded cell counted twice or more, for all rows; MAX_CELLS / 8 bytes at most."""

    twice: np.ndarray
    bits: int


def _estimated(twice: np.ndarray, bits: int, cells: np.ndarray, row: int) -> np.ndarray:
    """Whether a row of the sketch counts cells twice or more."""
    cell = cells >> np.uint32(32 - bits)
    bit = (7 - (cell & np.uint32(7))).astype(np.uint8)
    return (twice[row * ((1 << bits) // 8) + (cell >> np.uint32(3))] >> bit) & 1 == 1


def sketch(docs: DataFrame, window: int, gram: int, max_cells: int) -> Sketch:
    """The merged sketch of all partitions, as wide as its number of repeated cells asks for."""
    merged = written(merged_cells(partial_sketches(docs, window, gram)))
    most = merged.groupBy("row").agg(F.sum("n").alias("n")).agg(F.max("n").alias("n")).first()["n"] or 0
    cells = min(max(most * CELLS_PER_ITEM, MIN_CELLS), max_cells // ROWS)
    bits = min(max(SHARD_BITS + 3, int(np.floor(np.log2(cells)))), 32)
    row_bytes, shard_bytes = (1 << bits) // 8, (1 << (bits - SHARD_BITS)) // 8
    twice = np.zeros(ROWS * row_bytes, np.uint8)
    for part in folded(merged, bits).toLocalIterator():
        at = part["row"] * row_bytes + part["shard"] * shard_bytes
        twice[at : at + shard_bytes] = np.frombuffer(part["part"], np.uint8)
    return Sketch(twice, bits)


def _text_key(words: list[bytes]) -> bytes:
    """128 bits of a word sequence."""
    return xxhash.xxh3_128_digest(b" ".join(words))


def candidates(docs: DataFrame, sketch: Sketch, window: int, gram: int, digest: bool, copies: bool = True) -> DataFrame:
    """Every document with its candidate windows; without any, its kept words are final.

    With ``copies`` a text estimated to stand in several documents is passed on without windows (``copy``).
    ``id`` and ``text_key`` (128 bits of the words) name a row in what follows; rows equal in both have equal results.
    """
    shared, bits = docs.sparkSession.sparkContext.broadcast(sketch.twice), sketch.bits

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows, table = Windows(window, gram), shared.value
        for batch in batches:
            texts, ids = column_bytes(batch, "text"), batch.column("doc_id").cast(pa.int64())
            for i, j in slices(texts):
                split = [(t or b"").split() for t in texts[i:j]]
                values, offsets, starts, doc, low = windows.of(split)
                keys = [_text_key(w) for w in split]
                copy = np.diff(offsets) >= window if copies else np.zeros(len(split), bool)
                copy &= _estimated(table, bits, np.frombuffer(b"".join(k[:4] for k in keys), np.uint32), TEXTS)
                hit = _estimated(table, bits, _cells(low, 0), 0) & _estimated(table, bits, _cells(low, 1), 1) & ~copy[doc]
                starts, doc = starts[hit], doc[hit]
                first = windows.first(values, window)[starts].view(np.int64)
                second = (windows.second(values, window)[starts] >> U64(32)).astype(np.uint32).view(np.int32)
                cuts = np.searchsorted(doc, np.arange(len(split) + 1)).astype(np.int32)
                some = (cuts[1:] > cuts[:-1]) | copy
                lists = [pa.ListArray.from_arrays(pa.array(cuts), pa.array(x)) for x in (
                    first, second, (starts - offsets[doc]).astype(np.int32))]
                yield pa.RecordBatch.from_arrays([
                    ids.slice(i, j - i), ids.slice(i, j - i).fill_null(LAST_ID), pa.array(copy), pa.array(keys, pa.binary()),
                    pa.array(np.diff(offsets)),
                    pa.array([None if s else _kept(w, digest) for w, s in zip(split, some, strict=True)], pa.string()),
                    pa.array([b" ".join(w).decode() if s else None for w, s in zip(split, some, strict=True)], pa.string()),
                    *lists,
                ], ["doc_id", "id", "copy", "text_key", "n_words", "kept", "words", "h1", "h2", "start"])

    return docs.select("doc_id", "text").mapInArrow(run, (
        "doc_id long, id long, copy boolean, text_key binary, n_words long, kept string, words string, h1 array<long>, h2 array<int>, start array<int>"))


def _kept(words: list[bytes], digest: bool) -> str:
    text = b" ".join(words)
    return hashlib.sha256(text).hexdigest() if digest else text.decode()


def _cut(docs: DataFrame, window: int, digest: bool) -> DataFrame:
    """Removes the windows that start at ``starts`` from ``words``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, starts = column_bytes(batch, "words"), batch.column("starts").to_pylist()
            spans, removed, kept = [], [], []
            for text, at in zip(texts, starts, strict=True):
                words = text.split()
                edge = np.zeros(len(words) + 1, np.int32)
                at = np.array(at or [], np.int64)
                np.add.at(edge, at, 1)
                np.add.at(edge, at + window, -1)
                gone = np.cumsum(edge)[:-1] > 0
                change = np.flatnonzero(np.diff(np.concatenate([[0], gone.astype(np.int8), [0]])))
                spans.append([{"first": int(a), "end": int(b)} for a, b in change.reshape(-1, 2)])
                removed.append(int(gone.sum()))
                kept.append(_kept([w for w, g in zip(words, gone.tolist(), strict=True) if not g], digest))
            span = pa.list_(pa.struct([("first", pa.int32()), ("end", pa.int32())]))
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id"), batch.column("n_words"), pa.array(removed, pa.int64()),
                pa.array(spans, span), pa.array(kept, pa.string())], ["doc_id", "n_words", "n_removed", "spans", "kept"])

    return docs.select("doc_id", "n_words", "words", "starts").mapInArrow(run, (
        "doc_id long, n_words long, n_removed long, spans array<struct<first:int,end:int>>, kept string"))


def dedup_substrings(
    docs: DataFrame, window: int = WINDOW, gram: int = GRAM, digest: bool = False, max_cells: int = MAX_CELLS,
) -> DataFrame:
    """doc_id, n_words, n_removed, spans (removed words, end exclusive) and kept (its words joined by one space).

    With ``digest`` kept is the sha256 of that text, and unchanged texts are not written between the passes.
    """
    counted = sketch(docs, window, gram, max_cells)
    found = written(candidates(docs, counted, window, gram, digest))
    copies = found.filter("copy").select("doc_id", "id", "text_key", "n_words", "words")
    first = copies.groupBy("text_key").agg(F.min("id").alias("first"))
    copies = written(copies.join(first, "text_key"))
    firsts = candidates(
        copies.filter("id = first").select("doc_id", F.col("words").alias("text")), counted, window, gram, digest, copies=False)
    found = found.filter("not copy").unionByName(written(firsts))

    some = found.filter("words is not null")
    rows = some.select("id", "text_key", F.explode(F.arrays_zip("h1", "h2", "start")).alias("w")).select("id", "text_key", "w.h1", "w.h2", "w.start")
    lowest = rows.groupBy("h1", "h2").agg(F.min("id").alias("low"), F.max("id").alias("high")).filter("low < high").drop("high")
    starts = rows.join(lowest, ["h1", "h2"]).filter("id > low").groupBy("id", "text_key").agg(F.collect_list("start").alias("starts"))
    cut = _cut(some.select("doc_id", "id", "text_key", "n_words", "words").join(starts, ["id", "text_key"], "left"), window, digest)
    none = F.array().cast("array<struct<first:int,end:int>>")
    whole = found.filter("words is null").select("doc_id", "n_words", F.lit(0).cast("long").alias("n_removed"), none.alias("spans"), "kept")
    nothing = hashlib.sha256(b"").hexdigest() if digest else ""
    all_words = F.array(F.struct(F.lit(0).alias("first"), F.col("n_words").cast("int").alias("end")))
    later = copies.filter("id > first").select(
        "doc_id", "n_words", F.col("n_words").alias("n_removed"), all_words.alias("spans"), F.lit(nothing).alias("kept"))
    return whole.unionByName(cut).unionByName(later)
