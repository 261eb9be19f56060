"""Rows of a zone brought together once and worked on in array passes over many zones."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Rows that a task gathers before it works on them.
GATHER = 1 << 15
#: Pairs that are looked at in one pass.
PAIRS = 1 << 20


def ramps(counts: np.ndarray) -> np.ndarray:
    """0, 1, .. count - 1 for every count, one after the other."""
    return np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)


def chunks(counts: np.ndarray) -> Iterator[slice]:
    """Slices of rows with about ``PAIRS`` counts each; a row is never cut."""
    ends = np.cumsum(counts)
    at = 0
    while at < len(counts):
        done = ends[at - 1] if at else 0
        stop = max(at + 1, int(np.searchsorted(ends, done + PAIRS, "right")))
        yield slice(at, stop)
        at = stop


def near_pairs(group: np.ndarray, x: np.ndarray, y: np.ndarray, at_group: np.ndarray, at_x: np.ndarray, at_y: np.ndarray, size: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (row, place) of one group whose place lies in the row's cell of the given size or in one beside it.

    Pairs come in parts of about ``PAIRS``, rows in their order; all pairs within
    ``size`` along both axes are among them. Values that are not finite have none.
    """
    def cells(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        known = np.isfinite(v)
        return np.floor(np.where(known, v, 0.0) / size).astype(np.int64), known

    (cx, x_known), (cy, y_known), (at_cx, at_x_known), (at_cy, at_y_known) = map(cells, (x, y, at_x, at_y))
    rows, places = np.flatnonzero(x_known & y_known), np.flatnonzero(at_x_known & at_y_known)
    if not len(rows) or not len(places):
        return
    left = min(cx[rows].min(), at_cx[places].min()) - 1
    wide = max(cx[rows].max(), at_cx[places].max()) - left + 2
    low = min(cy[rows].min(), at_cy[places].min()) - 1
    high = max(cy[rows].max(), at_cy[places].max()) - low + 2
    # columns of cells are numbered as they occur, so the numbers of cells stay small
    columns, number = np.unique(at_group[places] * wide + at_cx[places] - left, return_inverse=True)
    cell = number * high + at_cy[places] - low
    order = np.argsort(cell, kind="stable")
    places, cell = places[order], cell[order]
    starts, counts = [], []
    for step in (-1, 0, 1):
        column = group[rows] * wide + cx[rows] - left + step
        found = np.minimum(np.searchsorted(columns, column), len(columns) - 1)
        base = found * high + cy[rows] - low
        first = np.searchsorted(cell, base - 1)
        starts.append(first)
        counts.append(np.where(columns[found] == column, np.searchsorted(cell, base + 1, "right") - first, 0))
    starts, counts = np.stack(starts, axis=1), np.stack(counts, axis=1)
    for part in chunks(counts.sum(axis=1)):
        n = counts[part].ravel()
        yield np.repeat(np.repeat(rows[part], 3), n), places[np.repeat(starts[part].ravel(), n) + ramps(n)]


def link(low: np.ndarray, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """``low``, the least number that each node is connected with, after linking the nodes ``u`` and ``v``."""
    while True:
        before = low.copy()
        least = np.minimum(low[u], low[v])
        for end in (low[u], low[v], u, v):
            np.minimum.at(low, end, least)
        while (low[low] != low).any():
            low = low[low]
        if (low == before).all():
            return low


def floats(table: pa.RecordBatch, *names: str) -> list[np.ndarray]:
    return [table.column(n).to_numpy(zero_copy_only=False).astype(float) for n in names]


def by_zone(rows: DataFrame, keys: list[str], work: Callable[[pa.RecordBatch, np.ndarray], list[pa.Array]], schema: StructType, stay: str | None = None, placed: bool = False) -> DataFrame:
    """What ``work`` gives for the rows of several zones and the zone number of each row.

    Without ``stay`` the zones it gets are whole. With it the rows so marked come
    first in their zone; only they are held while the others stream by, so a zone
    may have any number of those. ``placed`` says that the rows of a zone lie in
    one partition already.
    """
    arrow = to_arrow_schema(schema)

    def numbers(column: pa.Array) -> np.ndarray:
        plain = pa.types.is_integer(column.type) and not column.null_count
        return column.to_numpy(zero_copy_only=False) if plain else column.dictionary_encode("encode").indices.to_numpy(zero_copy_only=False)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n, wait = [], 0, GATHER

        def zones() -> tuple[pa.RecordBatch, np.ndarray]:
            table = pa.concat_batches(held)
            marks = [numbers(table.column(k)) for k in keys]
            return table, np.cumsum(np.append(True, np.any([m[1:] != m[:-1] for m in marks], axis=0))) - 1

        def worked(table: pa.RecordBatch, zone: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(work(table, zone), schema=arrow)

        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            n += batch.num_rows
            if n < wait:
                continue
            table, zone = zones()
            # the last zone may go on in the next batch
            last = int(np.searchsorted(zone, zone[-1]))
            rest = table.slice(last)
            if stay is not None:
                yield worked(table, zone)
                rest = rest.filter(rest.column(stay))
            elif last:
                yield worked(table.slice(0, last), zone[:last])
            held, n = [rest], rest.num_rows
            wait = max(GATHER, 2 * n)
        if n:
            yield worked(*zones())

    order = [*keys] if stay is None else [*keys, F.desc(stay)]
    return (rows if placed else rows.repartition(*keys)).sortWithinPartitions(*order).mapInArrow(run, schema)
