"""Operator 1: embedding near-dedup by collision-counting projections.

Unit vectors are projected on seeded random directions. Two vectors collide in
a projection when the one lies in the window around the other. The window is
wide enough that a pair at the cosine threshold collides nearly always; a pair
that collides in at least ``least`` of all projections is verified in double
precision. Window and count come from the wanted recall: differences of a pair
at the threshold are normal with standard deviation sqrt(2 - 2 * cosine), so the
number of its collisions is binomial.

No task sorts a whole projection. Vectors meet in tables: a table cuts ``depth``
projections of its own into cells of WIDTH, at random offsets, and a vector
stands once in each table. A pair at the threshold shares the cell of a table
with the chance p^depth, p being known from the same normal differences, so the
number of tables follows from the wanted recall; it is the number of copies of a
vector, whatever the size of the table. Depth grows with the logarithm of the
number of vectors, until a cell holds about CELL_ROWS of them, as measured on a
bounded sample; copies then grow with about its fifth root (20 tables for a
million spread vectors, 32 for ten million, 49 for a hundred million), and never
beyond MAX_TABLES, from where on cells grow instead (4,700 vectors at a billion). Inside a cell, vectors are sorted by a counting projection, and a
query reads its window of the sorted list, counting collisions in the others.
Crowded cells are cut into tiles of bounded size, so no cell is one task.

A pair that meets in several tables counts in the first of them, which its cell
numbers tell. Equal vectors collapse first. Link counts need no list of pairs: a
tile returns a count per vector and a spanning forest of its links. A group of
near-equal vectors still costs its square inside the tiles, in each table,
because each link counts.

Defined results: vectors that are null, zero or hold null or non-finite
components link with nothing, nor do vectors of different lengths. Rows that
share an id are one node of the link graph. An empty table gives no rows. Columns
besides the id and the vector are never looked at. Labels play no part.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plansift.llm.common import components, written
from plansift.llm.tokens import U64, mix

COSINE = 0.95
PROJECTIONS = 24
#: Chance that a pair exactly at the threshold is found; closer pairs are found more often.
RECALL = 0.995
#: Vectors that a cell should hold, and tables that a vector stands in at most.
CELL_ROWS = 1500
MAX_TABLES = 64
MAX_DEPTH = 24
#: Width of a cell; a spread of unit vectors has the standard deviation 1.
WIDTH = 2.0
#: Vectors that measure how full cells are; they never decide about a pair.
SAMPLE_ROWS = 1000
#: Vectors on either side of a tile.
TILE_ROWS = 4000
SEED = 41


def _normal_within(z: float) -> float:
    return math.erf(z / math.sqrt(2))


def calibrated(cosine: float, projections: int, recall: float) -> tuple[float, int]:
    """Half-window and least count so that a pair at the threshold passes with ``recall``."""
    z = 2.0  # a window that such a pair collides in with 0.954
    p = _normal_within(z)
    tail = 0.0
    for least in range(projections, -1, -1):
        tail += math.comb(projections, least) * p**least * (1 - p) ** (projections - least)
        if tail >= recall:
            break
    return z * math.sqrt(2 - 2 * cosine), least


def same_cell(deviation: float, width: float = WIDTH) -> float:
    """Chance that two numbers with normal difference lie in one cell at a random offset: the mean of 1 - |d| / width above 0."""
    cut = width / deviation
    mean = deviation * math.sqrt(2 / math.pi) * (1 - math.exp(-cut * cut / 2))
    return _normal_within(cut) - mean / width


def table_count(depth: int, cosine: float, recall: float) -> int:
    """Tables of ``depth`` projections so that a pair at the threshold meets in one of them with ``recall``."""
    if not depth:
        return 1
    return math.ceil(math.log(1 - recall) / math.log(1 - same_cell(math.sqrt(2 - 2 * cosine)) ** depth))


def directions(size: int, count: int, seed: int, what: int) -> np.ndarray:
    return np.random.default_rng([seed, size, what]).standard_normal((size, count))


def unit_vectors(full: np.ndarray) -> np.ndarray:
    scale = full / np.abs(full).max(axis=1, keepdims=True)
    return scale / np.linalg.norm(scale, axis=1, keepdims=True)


def cell_numbers(unit: np.ndarray, tables: int, depth: int, seed: int) -> np.ndarray:
    """A 64-bit cell number per vector and table, the table's number mixed in."""
    size = unit.shape[1]
    out = np.empty((len(unit), tables), np.int64)
    offsets = np.random.default_rng([seed, size, 7]).random((tables, depth)) * WIDTH
    for t in range(tables):
        at = np.floor((unit @ directions(size, depth, seed, 100 + t) + offsets[t]) / WIDTH).astype(np.int64)
        value = np.full(len(unit), t + 1, U64)
        for k in range(depth):
            value = mix(value ^ (at[:, k].view(U64) + U64((k + 1) * 0x9E3779B97F4A7C15 % 2**64)))
        out[:, t] = value.view(np.int64)
    return out


def chosen_depth(classes: DataFrame, n: int, cosine: float, recall: float, seed: int, precision: str) -> int:
    """Least depth at which cells hold CELL_ROWS vectors on average, as far as MAX_TABLES lets it grow."""
    if n <= CELL_ROWS:
        return 0
    drawn = classes.select("vec").sample(min(1.0, 2 * SAMPLE_ROWS / n), seed=seed).limit(SAMPLE_ROWS).collect()
    by_size: dict[int, list[np.ndarray]] = {}
    for row in drawn:
        v = np.frombuffer(row["vec"], precision).astype(np.float64)
        by_size.setdefault(len(v), []).append(v)
    for depth in range(1, MAX_DEPTH + 1):
        if table_count(depth, cosine, recall) > MAX_TABLES:
            return depth - 1
        shared = 0
        for rows in by_size.values():
            _, counts = np.unique(cell_numbers(unit_vectors(np.stack(rows)), 3, depth, seed), return_counts=True)
            shared += int((counts * (counts - 1)).sum())
        if shared / 3 / max(len(drawn) * (len(drawn) - 1), 1) * n <= CELL_ROWS:
            return depth
    return MAX_DEPTH


def unit_rows(vectors: DataFrame, tables: int, depth: int, seed: int, precision: str) -> DataFrame:
    """id, weight, size, vec and cells (a number per table) of usable vectors.

    Cells are computed here once and travel with the vector; all else is made
    again from it where it is needed, so that a copy is little more than the vector.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: dict[int, list[tuple[int, int, bytes]]] = {}
            for row in zip(*[batch.column(c).to_pylist() for c in ("id", "weight", "vec")], strict=True):
                found.setdefault(len(row[2]) // np.dtype(precision).itemsize, []).append(row)
            for size, rows in found.items():
                full = np.frombuffer(b"".join(v for _, _, v in rows), precision).reshape(len(rows), size)
                cells = cell_numbers(unit_vectors(full.astype(np.float64)), tables, depth, seed)
                yield pa.RecordBatch.from_arrays([
                    pa.array([i for i, _, _ in rows], pa.int64()), pa.array([w for _, w, _ in rows], pa.int64()), pa.array([size] * len(rows), pa.int32()),
                    pa.array([v for _, _, v in rows], pa.binary()),
                    pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1) * tables, pa.int32()), pa.array(cells.ravel()))],
                    ["id", "weight", "size", "vec", "cells"])

    return vectors.mapInArrow(run, "id long, weight long, size int, vec binary, cells array<long>")


def usable(rows: DataFrame, id_col: str, vec_col: str, precision: str) -> DataFrame:
    """id and vec (its numbers as bytes) of the vectors that can link."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, out = [], []
            for i, values in zip(batch.column("id").to_pylist(), batch.column("v").to_pylist(), strict=True):
                if i is None or not values or None in values:
                    continue
                v = np.array(values, np.float64)
                if np.isfinite(v).all() and v.any():
                    ids.append(i)
                    out.append((v + 0.0).astype(precision).tobytes())  # one zero
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(out, pa.binary())], ["id", "vec"])

    return rows.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("v")).mapInArrow(run, "id long, vec binary")


def _tile_links(tiles: DataFrame, cosine: float, half: float, least: int, projections: int, seed: int, precision: str) -> DataFrame:
    """Tiles (members of parts i and j of a cell) -> (id, n, near): links of a vector in the tile, and a forest of them."""
    names = ["id", "n", "near"]

    def run(data: pa.Table) -> pa.Table:
        column = lambda name: data.column(name).to_numpy()
        part, table = column("part"), int(data.column("t")[0].as_py())
        i, j = (int(data.column(c)[0].as_py()) for c in ("i", "j"))
        ids, weight = column("id"), column("weight")
        vec = unit_vectors(np.frombuffer(b"".join(data.column("vec").to_pylist()), precision).reshape(data.num_rows, -1).astype(np.float64))
        proj = (vec @ directions(vec.shape[1], projections, seed, 1)).astype(np.float32)
        cells = data.column("cells").combine_chunks().flatten().to_numpy().reshape(data.num_rows, -1)[:, :table]
        order = np.argsort(proj[:, -1], kind="stable")
        q, c = order[part[order] == i], order[part[order] == j]
        # windows as one-byte steps: |x - y| <= half rounds to at most ``near`` steps, never fewer
        near = np.uint8(61)  # steps wrap at 256, four half-windows away: a count can only be too high
        steps = np.floor(proj / (half / 60)).astype(np.int64).astype(np.uint8).T
        qs, cs, sorted_c = steps[:, q].copy(), steps[:, c].copy(), proj[c, -1]
        found_q, found_c = [], []
        for a in range(0, len(q), 128):
            b = min(a + 128, len(q))
            low = np.searchsorted(sorted_c, proj[q[a], -1] - half)
            high = np.searchsorted(sorted_c, proj[q[b - 1], -1] + half, side="right")
            if low == high:
                continue
            hits = np.zeros((b - a, high - low), np.uint8)
            for k in range(proj.shape[1]):
                hits += (cs[k, None, low:high] - qs[k, a:b, None] + near) <= 2 * near
            rows, cols = np.nonzero(hits >= least)
            rows, cols = q[a + rows], c[low + cols]
            if i == j:
                rows, cols = rows[ids[rows] != ids[cols]], cols[ids[rows] != ids[cols]]
            for start in range(0, len(rows), 1 << 16):
                x, y = rows[start : start + (1 << 16)], cols[start : start + (1 << 16)]
                good = np.einsum("ij,ij->i", vec[x], vec[y]) >= cosine
                x, y = x[good], y[good]
                fresh = ~(cells[x] == cells[y]).any(axis=1) if table else np.ones(len(x), bool)
                found_q.append(x[fresh])
                found_c.append(y[fresh])
        x, y = (np.concatenate(f) if f else np.zeros(0, np.int64) for f in (found_q, found_c))
        total = np.bincount(x, weights=weight[y], minlength=len(ids)).astype(np.int64)
        if i != j:
            total += np.bincount(y, weights=weight[x], minlength=len(ids)).astype(np.int64)
        some = total > 0
        node, root = _forest(ids[x], ids[y]) if len(x) else (np.zeros(0, np.int64),) * 2
        linked = node != root
        return pa.table([
            np.concatenate([ids[some], node[linked]]), np.concatenate([total[some], np.zeros(linked.sum(), np.int64)]), np.concatenate([ids[some], root[linked]])], names)

    return tiles.groupBy("size", "t", "cell", "i", "j").applyInArrow(run, "id long, n long, near long")


def _forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links: each end with the smallest id of its component."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while True:
        before = label.copy()
        np.minimum.at(label, x, label[y])
        np.minimum.at(label, y, label[x])
        label = label[label]
        if (label == before).all():
            return nodes, nodes[label]


def near_vectors(
    rows: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", cosine: float = COSINE,
    projections: int = PROJECTIONS, recall: float = RECALL, seed: int = SEED,
) -> DataFrame:
    """id, n_links, component_id and kept for every row."""
    # vectors travel in the precision they have; all arithmetic is in double precision
    precision = "<f4" if rows.schema[vec_col].dataType.simpleString() == "array<float>" else "<f8"
    good = written(usable(rows, id_col, vec_col, precision))
    classes = written(good.groupBy("vec").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("weight")))
    # half of the allowed loss goes to the tables, half to the count
    each = 1 - (1 - recall) / 2
    depth = chosen_depth(classes, classes.count(), cosine, each, seed, precision)
    tables = table_count(depth, cosine, each)
    half, least = calibrated(cosine, projections, each)
    placed = written(unit_rows(classes, tables, depth, seed, precision))
    parts = written(placed.select("size", F.posexplode("cells").alias("t", "cell")).groupBy("size", "t", "cell").agg(F.count(F.lit(1)).alias("members")).filter(
        "members > 1").select("size", "t", "cell", F.ceil(F.col("members") / TILE_ROWS).cast("int").alias("parts")))
    members = placed.select("*", F.posexplode("cells").alias("t", "cell")).join(parts, ["size", "t", "cell"])
    own = members.withColumn("part", F.pmod(F.xxhash64(F.lit(1), "id"), F.col("parts")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    tiles = own.withColumn("i", F.least("part", "other")).withColumn("j", F.greatest("part", "other"))
    found = written(_tile_links(tiles, cosine, half, least, projections, seed, precision))
    links = found.groupBy("id").agg(F.sum("n").alias("n"))
    comps = components(found.filter("id <> near").select("id", "near"), "id", "near")
    # back to all vectors: copies share their class and link with each other
    named = good.join(classes.withColumnRenamed("id", "rep"), "vec").select("id", "rep", "weight")
    facts = (
        named.join(links.withColumnRenamed("id", "rep"), "rep", "left").join(comps.withColumnRenamed("id", "rep"), "rep", "left")
        .groupBy("id").agg(F.max(F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.min(F.coalesce("comp", "rep")).alias("comp")))
    out = rows.select(F.col(id_col).alias("id")).join(facts, "id", "left")
    comp = F.coalesce("comp", "id")
    return out.select(
        F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).alias("n_links"), comp.alias("component_id"),
        F.coalesce(F.col("id") == comp, F.lit(True)).alias("kept"))
