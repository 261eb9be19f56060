"""Word hashes of whole texts, vectorised over batches of documents inside tasks."""

from __future__ import annotations

import sys
import types
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
import xxhash

U64 = np.uint64
#: Texts are hashed in slices of about this many bytes, so a task's memory does not follow the batch size.
SLICE_BYTES = 4 << 20
#: Words remembered by a task; over it the memory starts anew.
WORD_MEMORY = 1 << 19


def kept_in_worker(key: tuple, make: Callable[[], Any]) -> Any:
    """An object that a Python worker makes once and keeps for its later tasks.

    Functions travel by value, so their module's globals are new in each task;
    a module object of its own outlives them. Results never depend on it.
    """
    state = sys.modules.setdefault("plansift_worker_state", types.ModuleType("plansift_worker_state"))
    kept = state.__dict__.setdefault("kept", {})
    if key not in kept:
        kept[key] = make()
    return kept[key]


class WordHashes(dict):
    """Bytes of a word -> 64-bit hash, remembered for frequent words."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= WORD_MEMORY:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
        return x ^ (x >> U64(31))


def constants(n: int, seed: int) -> np.ndarray:
    """``n`` odd 64-bit constants from a seed."""
    return mix(np.arange(1, n + 1, dtype=U64) * U64(0x9E3779B97F4A7C15) + U64(seed)) | U64(1)


def column_bytes(batch: pa.RecordBatch, name: str) -> list[bytes | None]:
    """A string column as bytes, without decoding."""
    column = batch.column(name)
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return column.cast(kind).to_pylist()


def slices(texts: list[bytes | None]) -> Iterator[tuple[int, int]]:
    """Row ranges of about SLICE_BYTES; a longer text is a range of its own."""
    start = size = 0
    for i, text in enumerate(texts):
        size += len(text or b"")
        if size >= SLICE_BYTES:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def hashed(texts: list[list[bytes]], memory: WordHashes) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts in one array, and the offsets of the texts in it."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    values = np.fromiter((memory[w] for text in texts for w in text), U64, int(offsets[-1]))
    return values, offsets
