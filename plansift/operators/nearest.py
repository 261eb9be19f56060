"""Nearest-neighbour joins inside a plan, blocked by tiles.

Targets are reduced to distinct geometry first. Points look for points in tiles
of their plan, where ever wider cells are searched; rows that may have a nearer
target beyond their tile go over a hierarchy of grids. Openings and walls meet
in strips of their plan. The answer is exact at every stage.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from plansift.functions.zones import PAIRS, by_zone, chunks, floats, near_pairs, ramps
from plansift.operators.junctions import cell_of

#: Least width of the strips along which openings look for walls.
STRIP = 4096.0
#: Orientations that an opening looks across.
LEVEL, UPRIGHT, BOTH = 1, 2, 3
#: Least side of the tiles in which points look for targets.
SQUARE = 4096.0
#: Buckets of plans that are told to all tasks at once.
BUCKETS = 1 << 20
HIT = "_pass int, _level boolean, _coord double, _s double, _e double, _dist double"
OTHER = {"horizontal": "vertical", "vertical": "horizontal"}


def distinct_lines(walls: DataFrame) -> DataFrame:
    """Distinct wall lines with the first wall on each."""
    return walls.groupBy("plan_id", "orientation", "coord", "s", "e").agg(
        F.min("ord").alias("line_ord"), F.min_by("wall_id", "ord").alias("wall_id")
    )


def reach_of(points: DataFrame) -> DataFrame:
    """One row: how far along a wall any opening looks."""
    return points.agg(F.coalesce(F.max(F.col("span") / 2 + F.col("tol")), F.lit(0.0)).alias("_reach"))


def nearest_lines(
    points: DataFrame, walls: DataFrame, keep: list[str], enforce: bool = True, distinct: bool = False, outer: bool = False, reach: DataFrame | None = None,
    payload: tuple[str, ...] = (), free: bool = False,
) -> DataFrame:
    """The wall nearest across its axis whose span meets the opening.

    ``points`` has ``plan_id, x, y, span, orientation, tol`` and the columns
    ``keep``, which may be any and pass through. With ``enforce`` a wall of the
    opening's own orientation wins over any other; without it (or when the
    orientation is null) both compete. Ties go to the longer, then the earlier
    wall. Points without a wall are absent, or have a null line with ``outer``.

    Walls and openings of a strip of a plan meet in one task. A strip is at least
    four times as wide as the furthest opening of the table looks (``reach``, one
    row), and lists the walls within that reach, so an opening lies in one strip.
    Where its strips along x and along y have one number, as in any plan that
    fits a strip, an opening meets both orientations at once; others look across
    their own first, and go on to the other only if they find nothing there. ``distinct`` says that no two walls lie
    on the same line; others collapse to distinct lines first. ``payload`` names
    columns of the wall that come with its line. ``free`` adds a second line,
    ``free``: the wall found when both orientations compete, from the same pass.
    """
    axis = walls.filter("orientation <> 'diagonal'")
    told = axis.select("plan_id", "orientation", "coord", "s", "e", "ord", F.struct("wall_id", *payload).alias("wall"))
    reach = F.broadcast(reach_of(points) if reach is None else reach)
    # a unit of slack for rounding
    wide = F.col("_reach") + 1.0
    # strip 0 lies around the origin
    strip = lambda at: F.floor(at / F.greatest(wide * 4, F.lit(STRIP)) + 0.5)

    def listed(rows: DataFrame) -> DataFrame:
        lines = rows.withColumnRenamed("ord", "line_ord") if distinct else rows.groupBy("plan_id", "orientation", "coord", "s", "e").agg(
            F.min("ord").alias("line_ord"), F.min_by("wall", "ord").alias("wall"))
        return lines.crossJoin(reach).select(
            "plan_id", F.explode(F.sequence(strip(F.col("s") - wide), strip(F.col("e") + wide))).alias("_strip"), F.lit(True).alias("_line"),
            (F.col("orientation") == "horizontal").alias("_flat"), F.col("coord").alias("_a"), F.col("s").alias("_b"), F.col("e").alias("_c"),
            F.col("line_ord").alias("_ord"), F.col("wall").alias("_wall"))

    own = F.col("orientation") if enforce else F.lit(None).cast("string")
    base = points.select(
        *keep, *([] if "plan_id" in keep else ["plan_id"]), F.when(own.isin(*OTHER), own == "horizontal").alias("_own"),
        F.col("x").cast("double").alias("_a"), F.col("y").cast("double").alias("_b"), (F.col("span") / 2 + F.col("tol")).alias("_c")).crossJoin(reach)
    carried = [c for c in base.columns if c not in ("plan_id", "_reach")]

    def across(rows: DataFrame, walls: DataFrame, columns: list[str]) -> DataFrame:
        """``rows`` with the wall, as ``_hit``, that is best in the orientations they look across."""
        together = rows.select("plan_id", "_strip", F.lit(False).alias("_line"), "_look", *columns).unionByName(walls, allowMissingColumns=True)
        out = ["plan_id", "_look", *columns]
        about = [together.schema["_wall"], *StructType.fromDDL(HIT).fields, together.schema["_ord"]]
        names = [f.name for f in about]
        twice = [StructField(f"{f.name}_free", f.dataType) for f in about] if free else []
        found = StructType([rows.schema[c] for c in out] + about + twice)

        def hit(suffix: str) -> Column:
            wall, passed, level, coord, s, e, dist, ord_ = (F.col(n + suffix) for n in names)
            return F.when(dist.isNotNull(), F.struct(
                passed.alias("pass"), dist.alias("dist"), (s - e).alias("neg_len"), ord_.alias("line_ord"), wall.alias("wall"),
                F.when(level, "horizontal").otherwise("vertical").alias("orientation"), coord.alias("coord"), s.alias("s"), e.alias("e")))

        return by_zone(together, ["plan_id", "_strip"], partial(_meet, out, free), found, stay="_line").select(
            *out, hit("").alias("_hit"), *([hit("_free").alias("_free")] if free else []))

    level = F.coalesce("_own", F.lit(True))
    one = F.when(level, LEVEL).otherwise(UPRIGHT)
    x_strip, y_strip = strip(F.col("_a")), strip(F.col("_b"))
    looking = base.withColumn("_look", F.when(x_strip == y_strip, BOTH).otherwise(one)).withColumn("_strip", F.when(level, x_strip).otherwise(y_strip))
    at_once, apart = looking.filter(F.col("_look") == BOTH), looking.filter(F.col("_look") != BOTH)
    # only plans with openings of the second kind send their walls again; they are told by a bounded number of buckets
    bucket = F.pmod(F.xxhash64("plan_id"), F.lit(BUCKETS))
    plans = F.broadcast(apart.select(bucket.alias("_bucket")).distinct())
    again = listed(told.withColumn("_bucket", bucket).join(plans, "_bucket", "left_semi").drop("_bucket"))
    first = across(apart, again, carried)
    # a free line is known only when both orientations were looked across
    settled = F.lit(False) if free else F.col("_own").isNotNull() & F.col("_hit").isNotNull()
    rest = first.filter(~settled).withColumnsRenamed({"_hit": "_before", "_free": "_before_free"}).crossJoin(reach).withColumn("_strip", F.when(level, y_strip).otherwise(x_strip)).withColumn(
        "_look", F.when(level, UPRIGHT).otherwise(LEVEL))
    hits = ["_hit", "_free"] if free else ["_hit"]
    befores = {"_hit": "_before", "_free": "_before_free"}
    second = across(rest, again, [*carried, *[befores[h] for h in hits]]).withColumns({h: F.least(befores[h], h) for h in hits})
    columns = ["plan_id", *carried, *hits]
    every = across(at_once, listed(told), carried).select(*columns).unionByName(second.select(*columns))
    if not free:
        every = every.unionByName(first.filter(settled).select(*columns))

    def line(of: str) -> Column:
        return F.when(F.col(of).isNotNull(), F.struct(
            F.col(f"{of}.wall.wall_id").alias("wall_id"), *[F.col(f"{of}.{c}").alias(c) for c in ("orientation", "coord", "s", "e", "dist")],
            *[F.col(f"{of}.wall.{c}").alias(c) for c in payload]))

    return (every if outer else every.filter("_hit IS NOT NULL")).select(*keep, line("_hit").alias("line"), *([line("_free").alias("free")] if free else []))


def _meet(out: list[str], free: bool, table: pa.RecordBatch, zone: np.ndarray) -> list[pa.Array]:
    """The columns ``out`` of the openings among the rows, and the wall that each finds in its zone; with ``free`` also the best of any orientation."""
    is_line = table.column("_line").to_numpy(zero_copy_only=False)
    lines, probes = np.flatnonzero(is_line), np.flatnonzero(~is_line)
    # coord, s, e of a line; x, y, half the reach of an opening
    a, b, c = floats(table, "_a", "_b", "_c")
    level = table.column("_flat").fill_null(False).to_numpy(zero_copy_only=False)
    own = table.column("_own").cast(pa.int8()).fill_null(2).to_numpy()
    look = table.column("_look").fill_null(0).to_numpy()
    n = np.bincount(zone[lines], minlength=int(zone[-1]) + 1)
    start = (np.cumsum(n) - n)[zone[probes]]
    times = n[zone[probes]]
    one = alike = np.arange(len(probes))
    if times.sum() > 8 * PAIRS:
        # in crowded zones openings that look alike look once
        sights = np.stack([v[probes] for v in (zone, a, b, c, own, look)])
        _, one, alike = np.unique(sights, axis=1, return_index=True, return_inverse=True)
        alike = alike.ravel()
    rank = np.empty(len(lines), np.int64)
    rank[pc.sort_indices(table.column("_ord").take(pa.array(lines))).to_numpy()] = np.arange(len(lines))
    # the wall that each finds, with its own orientation first or without
    best, passed = np.full((1 + free, len(one)), -1), np.zeros((1 + free, len(one)), np.int32)
    times = times[one]
    for part in chunks(times):
        p = np.repeat(np.arange(len(one))[part], times[part])
        at = np.repeat(start[one[part]], times[part]) + ramps(times[part])
        line, probe = lines[at], probes[one[p]]
        flat = level[line]
        along, seen = np.where(flat, a[probe], b[probe]), np.where(flat, look[probe] != UPRIGHT, look[probe] != LEVEL)
        meets = np.flatnonzero(seen & (along + c[probe] >= b[line]) & (along - c[probe] <= c[line]))
        p, at, line, probe, flat = p[meets], at[meets], line[meets], probe[meets], flat[meets]
        dist = np.abs(np.where(flat, b[probe], a[probe]) - a[line])
        foreign = ((own[probe] != 2) & (own[probe] != flat)).astype(np.int32)
        for k, first in enumerate((foreign, np.zeros_like(foreign))[: 1 + free]):
            order = np.lexsort((rank[at], b[line] - c[line], dist, first, p))
            new = order[np.flatnonzero(np.append(True, p[order][1:] != p[order][:-1]))] if len(p) else order
            best[k, p[new]], passed[k, p[new]] = line[new], first[new]
    columns = [table.column(k).take(pa.array(probes)) for k in out]
    for found, other in zip(best[:, alike], passed[:, alike]):
        lost = found < 0
        from_line = pa.array(np.where(lost, 0, found), mask=lost)
        dist = np.abs(np.where(level[found], b[probes], a[probes]) - a[found])
        columns += [table.column("_wall").take(from_line), pa.array(other, mask=lost), pa.array(level[found], mask=lost)]
        columns += [pa.array(v, pa.float64(), mask=lost) for v in (a[found], b[found], c[found], dist)]
        columns.append(table.column("_ord").take(from_line))
    return columns


def nearest_point(
    points: DataFrame, targets: DataFrame, keep: list[str], payload: Column, limit: float | None, size: float = 80.0
) -> DataFrame:
    """Nearest target by Manhattan distance, first target on ties.

    ``points``: plan_id, x, y and ``keep``; ``targets``: plan_id, tx, ty, tord.
    Points and distinct targets of a tile of a plan meet in one task, which
    holds the targets and streams the points. With ``limit`` a tile lists the
    targets within that reach, and is complete. Without it a point is settled
    when its nearest target is closer than the border of its tile, and a
    hierarchy of grids finds the rest.
    """
    spots = targets.groupBy("plan_id", "tx", "ty").agg(
        F.min("tord").alias("tord"), F.min_by(payload, "tord").alias("payload")
    )
    side = SQUARE if limit is None else max(SQUARE, 4.0 * limit)
    # tile 0 lies around the origin
    tile = lambda at: F.floor(at / side + 0.5)
    slack = 0.0 if limit is None else limit + 1.0
    around = lambda at: F.explode(F.sequence(tile(F.col(at) - slack), tile(F.col(at) + slack)))
    listed = spots.withColumn("_tx", around("tx")).withColumn("_ty", around("ty")).select(
        "plan_id", "_tx", "_ty", F.lit(True).alias("_spot"), F.col("tx").cast("double").alias("_x"), F.col("ty").cast("double").alias("_y"), F.col("tord").alias("_ord"),
        F.col("payload").alias("_payload"))
    rows = points.select(*keep, *([] if "plan_id" in keep else ["plan_id"]), F.col("x").cast("double").alias("_x"), F.col("y").cast("double").alias("_y"))
    together = rows.filter("plan_id IS NOT NULL").withColumns({"_tx": tile(F.col("_x")), "_ty": tile(F.col("_y")), "_spot": F.lit(False)}).unionByName(listed, allowMissingColumns=True)
    out = [*rows.columns, "_tx", "_ty"]
    schema = StructType([together.schema[c] for c in out] + [together.schema["_payload"]] + StructType.fromDDL("_dist double, _settled boolean").fields)
    found = by_zone(together, ["plan_id", "_tx", "_ty"], partial(_nearest, out, side, size, limit), schema, stay="_spot")
    near = found.filter("_settled").select(*keep, F.struct(F.col("_payload").alias("payload"), F.col("_dist").alias("dist")).alias("hit"))
    if limit is not None:
        return near
    left = found.filter("NOT _settled").select(*rows.columns).withColumnsRenamed({"_x": "x", "_y": "y"})
    # a plan whose points are all settled sends no targets again; plans are told by a bounded number of buckets
    bucket = F.pmod(F.xxhash64("plan_id"), F.lit(BUCKETS))
    plans = F.broadcast(left.select(bucket.alias("_bucket")).distinct())
    again = spots.withColumn("_bucket", bucket).join(plans, "_bucket", "left_semi").drop("_bucket")
    dist = F.abs(F.col("x") - F.col("tx")) + F.abs(F.col("y") - F.col("ty"))
    return near.unionByName(_over_levels(left, again, keep, dist, size))


def _nearest(out: list[str], side: float, size: float, limit: float | None, table: pa.RecordBatch, zone: np.ndarray) -> list[pa.Array]:
    """The columns ``out`` of the points among the rows, and the nearest target in their tile.

    Points look in cells of ``size`` first and, while they find nothing within
    that width, in cells twice as wide, so no point is compared with all targets.
    """
    is_spot = table.column("_spot").to_numpy(zero_copy_only=False)
    spots, points = np.flatnonzero(is_spot), np.flatnonzero(~is_spot)
    x, y = floats(table, "_x", "_y")
    rank = np.empty(len(spots), np.int64)
    rank[pc.sort_indices(table.column("_ord").take(pa.array(spots))).to_numpy()] = np.arange(len(spots))
    best, dist = np.full(len(points), -1), np.full(len(points), np.inf)
    open_ = np.flatnonzero(np.isfinite(x[points]) & np.isfinite(y[points]) & np.isin(zone[points], zone[spots]))
    width = size if limit is None else limit
    while len(open_):
        p = points[open_]
        for a, b in near_pairs(zone[p], x[p], y[p], zone[spots], x[spots], y[spots], width):
            d = np.abs(x[p[a]] - x[spots[b]]) + np.abs(y[p[a]] - y[spots[b]])
            order = np.lexsort((rank[b], d, a))
            new = order[np.flatnonzero(np.append(True, a[order][1:] != a[order][:-1]))] if len(a) else order
            best[open_[a[new]]], dist[open_[a[new]]] = b[new], d[new]
        found = dist[open_] <= width
        best[open_[~found]], dist[open_[~found]] = -1, np.inf
        # cells of two tiles hold a whole tile
        open_ = open_[~found] if limit is None and width < 2 * side else open_[:0]
        width *= 2
    settled = best >= 0
    if limit is None:
        tiles = [table.column(c).fill_null(0).to_numpy(zero_copy_only=False)[points] for c in ("_tx", "_ty")]
        border = np.minimum.reduce([np.minimum(v[points] - (t - 0.5) * side, (t + 0.5) * side - v[points]) for v, t in zip((x, y), tiles)])
        # a unit of slack for rounding
        settled &= dist < border - 1.0
    lost = best < 0
    taken = pa.array(np.where(lost, 0, spots[best] if len(spots) else best), mask=lost)
    rows = pa.array(points)
    return [*[table.column(c).take(rows) for c in out], table.column("_payload").take(taken), pa.array(dist, mask=lost), pa.array(settled)]


NEIGHBOURS = [(dx, dy) for dx in (-1, 0, 1) for dy in (-1, 0, 1)]


def _over_levels(rows: DataFrame, spots: DataFrame, keep: list[str], dist: Column, size: float) -> DataFrame:
    """Nearest spots over a hierarchy of grids whose cells double from level to level, up to the extent of each plan.

    A point looks at the lowest level where a spot lies in its 3 x 3 cells. The
    nearest of these bounds its distance, and the level whose cells are as wide
    as that bound holds the true nearest spot.
    """
    places = rows.select("plan_id", "x", "y").unionByName(spots.select("plan_id", F.col("tx").alias("x"), F.col("ty").alias("y")))
    extent = places.groupBy("plan_id").agg((F.max("x") - F.min("x") + F.max("y") - F.min("y")).alias("extent"))
    level_of = lambda reach: F.ceil(F.log2(F.greatest(reach, F.lit(size)) / size) + 1e-9).cast("int")
    tops = extent.select("plan_id", (level_of(F.col("extent")) + 1).alias("top"))
    width = F.lit(size) * F.pow(F.lit(2.0), F.col("level"))
    listed = spots.join(tops, "plan_id").withColumn("level", F.explode(F.sequence(F.lit(0), F.col("top")))).select(
        "plan_id", "tx", "ty", "tord", "payload", "level", F.floor(F.col("tx") / width).alias("cx"), F.floor(F.col("ty") / width).alias("cy"))

    def around(found: DataFrame) -> DataFrame:
        cells = F.array(*[F.struct((F.floor(F.col("x") / width) + dx).alias("cx"), (F.floor(F.col("y") / width) + dy).alias("cy")) for dx, dy in NEIGHBOURS])
        return found.select(*keep, "x", "y", "level", F.inline(cells))

    every = rows.join(tops, "plan_id").withColumn("level", F.explode(F.sequence(F.lit(0), F.col("top"))))
    cell = ["plan_id", "level", "cx", "cy"]
    lowest = around(every).join(listed.select(*cell).distinct(), cell, "left_semi").groupBy(*keep, "x", "y").agg(F.min("level").alias("level"))
    bound = around(lowest).join(listed, cell).groupBy(*keep, "x", "y").agg(F.min(dist).alias("bound"))
    exact = around(bound.withColumn("level", level_of(F.col("bound"))))
    return exact.join(listed, cell).withColumn("dist", dist).groupBy(*keep).agg(
        F.min_by(F.struct("payload", "dist"), F.struct("dist", "tord")).alias("hit"))
