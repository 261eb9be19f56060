"""Junction graph between horizontal and vertical walls.

Walls are first reduced to distinct lines. A horizontal line is listed in every
grid cell its span touches, a vertical line likewise, so a pair meets only in
the one cell that holds the crossing point: the join key is (plan, cell), never
the plan alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from plansift.functions.numeric import round_to
from plansift.functions.ranking import number_rows
from plansift.functions.zones import by_zone, chunks, floats, ramps
from plansift.operators.walls import LINE

CELL = 64.0
#: Side of the tiles in which junctions of lines are counted.
TILE = 1024.0
TYPES = ["L", "T", "X"]


def span_cells(low: Column, high: Column, size: float = CELL) -> Column:
    return F.explode(F.sequence(F.floor(low / size), F.floor(high / size)))


def cell_of(value: Column, size: float = CELL) -> Column:
    return F.floor(value / size)


def tile_of(value: Column) -> Column:
    """Number of the tile along an axis; tile 0 lies around the origin."""
    return F.floor(value / TILE + 0.5)


def junction_hits(walls: DataFrame) -> DataFrame:
    """One row per (junction point, line): rank 0/1/2 for L/T/X, ``at_end`` if that line ends there."""
    lines = walls.filter("orientation <> 'diagonal'").groupBy(*LINE).agg(
        F.count(F.lit(1)).alias("n"), F.any_value("cfg").alias("cfg")
    )
    reach = F.col("cfg.junction") * 2.5
    h = lines.filter("orientation = 'horizontal'").select(
        "plan_id", F.struct("orientation", "coord", "s", "e", "thickness", "n").alias("h"), "cfg",
        span_cells(F.col("s") - reach, F.col("e") + reach).alias("cx"), cell_of(F.col("coord")).alias("cy"),
    )
    v = lines.filter("orientation = 'vertical'").select(
        "plan_id", F.struct("orientation", "coord", "s", "e", "thickness", "n").alias("v"),
        span_cells(F.col("s") - reach, F.col("e") + reach).alias("cy"), cell_of(F.col("coord")).alias("cx"),
    )
    tol = F.least(
        F.greatest(
            F.col("cfg.junction"), F.greatest(F.col("h.thickness"), F.col("v.thickness")) / 2 + F.col("cfg.snap")
        ),
        F.col("cfg.junction") * 2.5,
    )
    pairs = (
        h.join(v, ["plan_id", "cx", "cy"])
        .withColumn("tol", tol)
        .filter(
            F.col("v.coord").between(F.col("h.s") - F.col("tol"), F.col("h.e") + F.col("tol"))
            & F.col("h.coord").between(F.col("v.s") - F.col("tol"), F.col("v.e") + F.col("tol"))
        )
    )

    def ends(line: str, at: str) -> Column:
        return (F.abs(F.col(at) - F.col(f"{line}.s")) <= F.col("tol")) | (F.abs(F.col(at) - F.col(f"{line}.e")) <= F.col("tol"))

    typed = pairs.withColumn("h_end", ends("h", "v.coord")).withColumn("v_end", ends("v", "h.coord"))
    rank = F.when(F.col("h_end") & F.col("v_end"), 0).when(F.col("h_end") | F.col("v_end"), 1).otherwise(2)
    return (
        typed.select(
            "plan_id", round_to(F.col("v.coord"), 2).alias("x"), round_to(F.col("h.coord"), 2).alias("y"),
            rank.alias("rank"),
            F.explode(
                F.array(
                    F.struct(F.col("h").alias("line"), F.col("h_end").alias("at_end")),
                    F.struct(F.col("v").alias("line"), F.col("v_end").alias("at_end")),
                )
            ).alias("m"),
        )
        .groupBy("plan_id", "x", "y", "m.line")
        .agg(F.max("rank").alias("rank"), F.bool_or("m.at_end").alias("at_end"))
    )


def junctions_from_hits(hits: DataFrame) -> DataFrame:
    return (
        hits.groupBy("plan_id", "x", "y")
        .agg(F.max("rank").alias("rank"), F.sum("line.n").alias("n_walls"))
        .select("plan_id", "x", "y", F.element_at(F.array(*map(F.lit, TYPES)), F.col("rank") + 1).alias("type"), "n_walls")
    )


def _in_tiles(lines: DataFrame, columns: list[str]) -> DataFrame:
    """``columns`` of the lines, listed in the tiles of their plan that they may have junctions in."""
    flat = F.col("orientation") == "horizontal"
    wide = F.col("junction") * 2.5 + 1.0
    at = round_to(F.col("coord"), 2)
    along = F.sequence(tile_of(F.col("s") - wide), tile_of(F.col("e") + wide))
    return lines.withColumn("_along", F.explode(along)).withColumns({
        "_tx": F.when(flat, F.col("_along")).otherwise(tile_of(at)), "_ty": F.when(flat, tile_of(at)).otherwise(F.col("_along")), "_at": at, "_flat": flat}).select(*columns, "_tx", "_ty", "_at", "_flat")


LIMITS = {"junction": "cfg.junction", "snap": "cfg.snap"}


def _points(walls: DataFrame) -> DataFrame:
    """J01 by tile: plan_id, x, y, type, n_walls and ``_ord``, the position by (x, y) in the tile.

    All lines through a point meet in its tile, in one shuffle of distinct lines.
    """
    lines = walls.filter("orientation IN ('horizontal', 'vertical') AND plan_id IS NOT NULL AND coord IS NOT NULL AND s IS NOT NULL AND e IS NOT NULL").select(*LINE, *[F.col(c).alias(n) for n, c in LIMITS.items()]).groupBy(*LINE).agg(
        F.count(F.lit(1)).alias("n"), *[F.any_value(n).alias(n) for n in LIMITS])
    listed = _in_tiles(lines, ["plan_id", "coord", "s", "e", "thickness", "n", *LIMITS])
    schema = StructType([listed.schema["plan_id"]] + StructType.fromDDL("x double, y double, type string, n_walls long, _ord long").fields)
    return by_zone(listed, ["plan_id", "_tx", "_ty"], _crossings, schema)


def junctions(walls: DataFrame) -> DataFrame:
    """One row per point with the highest type seen (L < T < X) and the number of walls."""
    return _points(walls).drop("_ord")


def numbered_junctions(walls: DataFrame) -> DataFrame:
    """J01 with ``ord``, the position by (x, y) in the plan.

    A plan that lies in one tile is numbered there; only plans of several tiles
    are numbered over the counts of their columns.
    """
    columns = ["plan_id", "x", "y", "type", "n_walls", "ord"]
    wide = F.col("cfg.junction") * 2.5 + 1.0
    far = walls.filter((tile_of(round_to(F.col("coord"), 2)) != 0) | (tile_of(F.col("s") - wide) != 0) | (tile_of(F.col("e") + wide) != 0)).select("plan_id").distinct()
    if far.isEmpty():
        return _points(walls).withColumnRenamed("_ord", "ord").select(*columns)
    one = _points(walls.join(far, "plan_id", "left_anti")).withColumnRenamed("_ord", "ord").select(*columns)
    several = number_rows(junctions(walls.join(far, "plan_id", "left_semi")), ["plan_id"], ["x"], ["y"], "ord")
    return one.unionByName(several.select(*columns))


def line_connections(hits: DataFrame) -> DataFrame:
    """Per line: number of junctions (J02 when > 0) and whether an end is supported."""
    return hits.groupBy(
        "plan_id", "line.orientation", "line.coord", "line.s", "line.e", "line.thickness"
    ).agg(F.count(F.lit(1)).alias("n_junctions"), F.bool_or("at_end").alias("supported"))


def count_connections(walls: DataFrame, distinct: bool = False) -> DataFrame:
    """J02 + J03 as ``line_connections`` of ``junction_hits``, without a list of the points.

    A point belongs to one tile of the plan, where all lines through it meet, so
    each tile counts the points of its lines and the counts add up. ``distinct``
    says that no two walls lie on the same line; then the counts come by wall
    (plan_id, ord), else by line.
    """
    key = ["plan_id", "ord"] if distinct else LINE
    # a wall without a place has no junctions, and would stretch the search for all others
    axis = walls.filter("orientation <> 'diagonal' AND coord IS NOT NULL AND s IS NOT NULL AND e IS NOT NULL")
    limits = [F.col(c).alias(n) for n, c in LIMITS.items()]
    lines = axis.select(*LINE, "ord", *limits) if distinct else axis.select(*LINE, *limits).groupBy(*LINE).agg(*[F.any_value(n).alias(n) for n in LIMITS])
    listed = _in_tiles(lines, [c for c in lines.columns if not distinct or c != "orientation"])
    schema = StructType([listed.schema[k] for k in key] + StructType.fromDDL("n long, at_end boolean").fields)
    found = by_zone(listed, ["plan_id", "_tx", "_ty"], partial(_meetings, key), schema)
    return found.groupBy(*key).agg(F.sum("n").alias("n_junctions"), F.bool_or("at_end").alias("supported"))


def _pairs(table: pa.RecordBatch, zone: np.ndarray, larger: np.ufunc = np.fmax) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Level and upright lines of a tile that meet, and whether they do so at an end of either, in bounded parts.

    ``larger`` tells whether a thickness that is not known counts as none.
    """
    coord, s, e, thickness, junction, snap = floats(table, "coord", "s", "e", "thickness", "junction", "snap")
    flat = table.column("_flat").to_numpy(zero_copy_only=False)
    h, v = np.flatnonzero(flat), np.flatnonzero(~flat)
    v = v[np.lexsort((coord[v], zone[v]))]
    # upright lines by zone and place; a unit of slack covers what the long number cannot hold
    left, span = (coord[v].min(), np.ptp(coord[v])) if len(v) else (0.0, 0.0)
    width = 2 * span + 8
    place = zone[v] * width + coord[v] - left
    low, high = (np.clip(x - left, -2.0, span + 2.0) for x in (s[h] - 2.5 * junction[h] - 1, e[h] + 2.5 * junction[h] + 1))
    start = np.searchsorted(place, zone[h] * width + low)
    times = np.maximum(np.searchsorted(place, zone[h] * width + high, "right") - start, 0)
    for part in chunks(times):
        a = np.repeat(h[part], times[part])
        b = v[np.repeat(start[part], times[part]) + ramps(times[part])]
        tol = np.minimum(larger(junction[a], larger(thickness[a], thickness[b]) / 2 + snap[a]), junction[a] * 2.5)
        meet = (coord[b] >= s[a] - tol) & (coord[b] <= e[a] + tol) & (coord[a] >= s[b] - tol) & (coord[a] <= e[b] + tol)
        a, b, tol = a[meet], b[meet], tol[meet]
        a_end, b_end = ((np.abs(coord[other] - s[one]) <= tol) | (np.abs(coord[other] - e[one]) <= tol) for one, other in ((a, b), (b, a)))
        yield a, b, a_end, b_end


def _crossings(table: pa.RecordBatch, zone: np.ndarray) -> list[pa.Array]:
    """The points of every tile with their type, the walls through them and their position."""
    at, = floats(table, "_at")
    n = table.column("n").to_numpy()
    flat = table.column("_flat").to_numpy(zero_copy_only=False)
    xs, x = np.unique(np.where(flat, 0.0, at), return_inverse=True)
    ys, y = np.unique(np.where(flat, at, 0.0), return_inverse=True)
    none = np.empty(0, np.int64)
    seen, level, upright = [none], [none], [none]
    for a, b, a_end, b_end in _pairs(table, zone):
        point = (zone[a] * len(xs) + x[b]) * len(ys) + y[a]
        rank = np.where(a_end & b_end, 0, np.where(a_end | b_end, 1, 2))
        for held, codes in ((seen, point * len(TYPES) + rank), (level, a * len(xs) + x[b]), (upright, b * len(ys) + y[a])):
            held.append(np.unique(codes))
    point, rank = np.divmod(np.unique(np.concatenate(seen)), len(TYPES))
    last = np.flatnonzero(np.append(point[1:] != point[:-1], True)[: len(point)])
    point, rank = point[last], rank[last]
    walls = np.zeros(len(point), np.int64)
    a, ax = np.divmod(np.unique(np.concatenate(level)), max(len(xs), 1))
    b, by = np.divmod(np.unique(np.concatenate(upright)), max(len(ys), 1))
    for line, code in ((a, (zone[a] * len(xs) + ax) * len(ys) + y[a]), (b, (zone[b] * len(xs) + x[b]) * len(ys) + by)):
        np.add.at(walls, np.searchsorted(point, code), n[line])
    rest, iy = np.divmod(point, len(ys))
    tile, ix = np.divmod(rest, len(xs))
    # tiles follow each other, so a tile's first row tells its plan
    plan = table.column("plan_id").take(pa.array(np.searchsorted(zone, tile)))
    return [plan, pa.array(xs[ix]), pa.array(ys[iy]), pa.array(TYPES).take(pa.array(rank)), pa.array(walls), pa.array(np.arange(len(point)) - np.searchsorted(tile, tile) + 1)]


def _meetings(key: list[str], table: pa.RecordBatch, zone: np.ndarray) -> list[pa.Array]:
    """Points (``n``) of every line that has any in its tile, and whether one lies at an end of it."""
    at, = floats(table, "_at")
    points, ends = [np.empty((0, 2))], np.zeros(table.num_rows, bool)
    for a, b, a_end, b_end in _pairs(table, zone, np.maximum):
        for one, other, end in ((a, b, a_end), (b, a, b_end)):
            ends[one[end]] = True
            points.append(np.unique(np.stack([one, at[other]], axis=1), axis=0) if len(one) else points[0])
    # a point of a line is its place along it
    line = np.unique(np.concatenate(points), axis=0)[:, 0].astype(np.int64)
    n = np.bincount(line, minlength=table.num_rows)
    hit = np.flatnonzero(n)
    rows = pa.array(hit)
    return [*[table.column(k).take(rows) for k in key], pa.array(n[hit]), pa.array(ends[hit])]


def connected_walls(walls: DataFrame) -> DataFrame:
    """Walls that take part in any junction."""
    return walls.join(line_connections(junction_hits(walls)), LINE, "left_semi")


def supported_walls(walls: DataFrame) -> DataFrame:
    """Walls with an end near a crossing wall."""
    return walls.join(line_connections(junction_hits(walls)).filter("supported"), LINE, "left_semi")


def junction_members(walls: DataFrame) -> DataFrame:
    """(plan, point, type, wall): the graph as an edge list instead of a list per point."""
    hits = junction_hits(walls)
    points = junctions_from_hits(hits).select("plan_id", "x", "y", "type")
    flat = hits.select(
        "plan_id", "x", "y", "line.orientation", "line.coord", "line.s", "line.e", "line.thickness", "at_end"
    )
    return flat.join(points, ["plan_id", "x", "y"]).join(walls.select(*LINE, "wall_id", "ord"), LINE)


def junction_summary(points: DataFrame) -> DataFrame:
    """Total and count per type for each plan."""
    return points.groupBy("plan_id").agg(
        F.count(F.lit(1)).alias("junction_count"),
        *[F.count_if(F.col("type") == t).alias(f"junction_{t}") for t in TYPES],
    )
