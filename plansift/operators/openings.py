"""Doors and windows: normalise, anchor to walls, filter, annotate."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StructField, StructType

from plansift.functions.folds import fold_sorted
from plansift.functions.numeric import round_to
from plansift.functions.zones import by_zone, chunks, floats, ramps
from plansift.operators.junctions import cell_of
from plansift.operators.nearest import distinct_lines, nearest_lines, reach_of

# fixed values: swing of a door by the side of its wall
SWING_BY_SIDE = {"bottom": "up", "top": "down", "left": "right", "right": "left"}
SIDES = ["bottom", "top", "left", "right"]
LARGE_SPAN = 200.0
WINDOWS_PER_WALL = 3
LEGACY_THICKNESS = 4.0
SHARED_GAP = 5.0
#: Length of the cells along which room edges meet.
ROOM_CELL = 256.0
#: Rooms up to so far from the origin meet in one task per plan.
ROOM_TILE = 4096.0


def lookup(table: dict[str, str], key: Column) -> Column:
    """Constant map lookup, null for unknown keys."""
    return F.element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), key)


def default_side(side: Column, orientation: Column) -> Column:
    return F.coalesce(side, F.when(orientation == "horizontal", "top").otherwise("right"))


def normalize_openings(raw: DataFrame) -> DataFrame:
    """Checks and defaults; ``error`` names why a row is unusable."""
    error = (
        F.when(~F.coalesce(F.col("kind").isin("door", "window"), F.lit(False)), "kind must be door or window")
        .when(F.coalesce("span", F.lit(0.0)) <= 0, "span must be positive")
        .when(F.col("x").isNull() & F.col("offset").isNull(), "needs offset or position")
    )
    door = F.col("kind") == "door"
    return raw.withColumns(
        {
            "error": error,
            "confidence": F.coalesce("confidence", F.lit(1.0)),
            "door_type": F.when(door, F.coalesce("door_type", "type", F.lit("normal"))),
            "swing": F.when(door, F.coalesce(F.col("swing"), lookup(SWING_BY_SIDE, F.col("side")))),
        }
    )


def offset_on(line: str) -> Column:
    """Distance from the wall start to the opening start."""
    along = F.when(F.col(f"{line}.orientation") == "horizontal", F.col("x")).otherwise(F.col("y"))
    return along - F.col(f"{line}.s") - F.col("span") / 2


def position_on(line: str, offset: Column) -> tuple[Column, Column]:
    """Centre of the opening placed at ``offset`` on its wall."""
    center = F.col(f"{line}.s") + offset + F.col("span") / 2
    flat = F.col(f"{line}.orientation") == "horizontal"
    coord = F.col(f"{line}.coord")
    return F.when(flat, center).otherwise(coord), F.when(flat, coord).otherwise(center)


def anchor(openings: DataFrame, walls: DataFrame, distinct: bool = False) -> DataFrame:
    """Place every opening on a wall.

    ``openings``: plan_id, opening_id, x, y, span, orientation, side, confidence,
    kind, offset, wall_id, cfg. Adds the wall, the position on it and ``status``
    (anchored, no compatible wall, span does not fit). ``distinct`` says that no
    two walls lie on the same line.
    """
    about = ("side", "confidence")
    info = walls.select(
        "plan_id", "wall_id", F.struct("wall_id", "orientation", "coord", "s", "e", F.lit(0.0).alias("dist"), *about).alias("line")
    )
    points = openings.withColumn("tol", F.col("cfg.snap")).drop("line")
    reach = reach_of(points)
    # openings that name no wall need not look for its name
    named = points.filter("wall_id IS NOT NULL").join(info, ["plan_id", "wall_id"], "left")
    search = named.filter("line IS NULL").drop("line").unionByName(points.filter("wall_id IS NULL").select(*named.drop("line").columns))
    found = nearest_lines(search, walls, search.columns, outer=True, reach=reach, payload=about, distinct=distinct, free=True)
    offset = F.coalesce(F.col("offset"), offset_on("line"))

    def fits(off: Column, line: str) -> Column:
        return (off >= -F.col("tol")) & (off + F.col("span") <= F.col(f"{line}.e") - F.col(f"{line}.s") + F.col("tol"))

    def measured(rows: DataFrame) -> DataFrame:
        return rows.withColumn("off", offset).withColumn("ok", fits(F.col("off"), "line"))

    again = F.coalesce(F.col("line").isNotNull() & ~F.col("ok") & F.col("orientation").isNotNull(), F.lit(False))
    # an opening that does not fit its wall tries the wall of any orientation, which the one pass over the walls told too;
    # only openings that name their wall have to look for it
    named = measured(named.filter("line IS NOT NULL"))
    misfit = named.filter(again).withColumnRenamed("line", "line1")
    second = nearest_lines(misfit, walls, misfit.columns, enforce=False, outer=True, reach=reach, payload=about, distinct=distinct).withColumnsRenamed(
        {"line": "free", "line1": "line"})
    placed = measured(found)
    # others keep their wall
    placed = placed.withColumn("free", F.when(again, F.col("free")))
    kept = named.filter(~again).withColumn("free", F.lit(None).cast(placed.schema["free"].dataType))
    placed = placed.unionByName(kept).unionByName(second).withColumn("off2", F.coalesce(F.col("offset"), offset_on("free")))
    use2 = F.coalesce(fits(F.col("off2"), "free"), F.lit(False))
    placed = placed.withColumn("_use2", use2)
    out = placed.withColumns({
        "off": F.when(F.col("_use2"), F.col("off2")).otherwise(F.col("off")), "ok": F.col("_use2") | F.coalesce("ok", F.lit(False)),
        "line": F.when(F.col("_use2"), F.col("free")).otherwise(F.col("line"))})
    status = F.when(F.col("line").isNull(), "no compatible wall").when(~F.col("ok"), "span does not fit").otherwise("anchored")
    px, py = position_on("line", F.col("off"))
    out = out.withColumn("status", status).withColumn("line_wall", F.col("line.wall_id"))
    side = F.coalesce("side", default_side(F.col("line.side"), F.col("line.orientation")))
    return out.select(
        "plan_id", "opening_id", "kind", "status", F.col("line_wall").alias("wall_id"), "span",
        F.col("line.orientation").alias("orientation"), px.alias("x"), py.alias("y"),
        round_to("off", 4).alias("offset"), side.alias("side"), F.col("side").isNull().alias("side_inferred"),
        round_to(F.least("confidence", "line.confidence"), 4).alias("confidence"),
        F.when(F.col("kind") == "door", lookup(SWING_BY_SIDE, side)).alias("swing"),
    )


def drop_furniture(openings: DataFrame, walls: DataFrame) -> DataFrame:
    """keep openings that are wide, unplaced, or close to a wall line of any orientation."""
    lines = (
        distinct_lines(walls.filter("orientation <> 'diagonal'"))
        .withColumn("ac", F.explode(F.sequence(cell_of(F.col("s")), cell_of(F.col("e")))))
        .withColumn("cc", cell_of(F.col("coord")))
        .select("plan_id", F.col("orientation").alias("line_o"), "coord", "s", "e", "ac", "cc")
    )
    free = (F.col("span") > LARGE_SPAN) | F.col("x").isNull()
    tol = F.col("cfg.snap")
    probe = openings.filter(~free).withColumn("line_o", F.explode(F.array(F.lit("horizontal"), F.lit("vertical"))))
    flat = F.col("line_o") == "horizontal"
    probe = (
        probe.withColumn("along", F.when(flat, F.col("x")).otherwise(F.col("y")))
        .withColumn("cross", F.when(flat, F.col("y")).otherwise(F.col("x")))
        .withColumn("low", F.col("along") - F.col("span") / 2 - tol)
        .withColumn("high", F.col("along") + F.col("span") / 2 + tol)
        .withColumn("ac", F.explode(F.sequence(cell_of(F.col("low")), cell_of(F.col("high")))))
        .withColumn("cc", F.explode(F.sequence(cell_of(F.col("cross") - tol * 3), cell_of(F.col("cross") + tol * 3))))
    )
    near = (
        probe.join(
            lines,
            (probe.plan_id == lines.plan_id) & (probe.line_o == lines.line_o) & (probe.ac == lines.ac)
            & (probe.cc == lines.cc) & (F.abs(probe.cross - lines.coord) <= probe.cfg.snap * 3)
            & (probe.low <= lines.e) & (probe.high >= lines.s),
            "left_semi",
        )
        .select("plan_id", "opening_id")
        .distinct()
    )
    return openings.filter(free).unionByName(openings.filter(~free).join(near, ["plan_id", "opening_id"], "left_semi"))


def dedupe_on_wall(openings: DataFrame) -> DataFrame:
    """Of heavily overlapping openings of one kind on one wall keep the larger.

    ``openings``: plan_id, wall_id, kind, ord, along, span. Exact repeats go
    first (map-side), then chains of touching intervals are cut apart, and the
    distinct intervals of one chain stream through the fold in order.
    """
    group = ["plan_id", "wall_id", "kind"]
    unique = openings.groupBy(*group, "along", "span").agg(F.min("ord").alias("ord"))
    low, high = F.col("along") - F.col("span") / 2, F.col("along") + F.col("span") / 2
    order = Window.partitionBy(*group).orderBy("low", "along", "ord")
    chained = (
        unique.withColumn("low", low)
        .withColumn("high", high)
        .withColumn("_reach", F.max("high").over(order.rowsBetween(Window.unboundedPreceding, -1)))
        .withColumn("_new", (F.col("low") >= F.col("_reach")).cast("int"))
        .withColumn("chain", F.sum(F.coalesce("_new", F.lit(0))).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    )
    # no opening that follows reaches further back than half of the widest one of its chain
    wide = chained.withColumn("widest", F.max("span").over(Window.partitionBy(*group, "chain")))
    kept = fold_sorted(wide, [*group, "chain"], ["along", "ord"], ["along", "span", "ord", "widest"], _keep_larger,
                       f"along double, span double, ord {wide.schema['ord'].dataType.simpleString()}")
    return kept.drop("chain")


def _keep_larger(items: Iterator[tuple]) -> Iterator[tuple]:
    """Openings in order; one that covers half of the first kept one it meets, or is covered so, replaces it if it is larger."""
    open_: list[tuple] = []
    for along, span, ord_, widest in items:
        back = along - widest / 2
        yield from (k for k in open_ if k[0] + k[1] / 2 <= back)
        open_ = [k for k in open_ if k[0] + k[1] / 2 > back]
        low, high = along - span / 2, along + span / 2
        hit = next((k for k in open_ if min(high, k[0] + k[1] / 2) - max(low, k[0] - k[1] / 2) > min(span, k[1]) * 0.5), None)
        if hit is not None and span <= hit[1]:
            continue
        if hit is not None:
            open_.remove(hit)
        open_.append((along, span, ord_))
    yield from open_


def limit_exterior_windows(openings: DataFrame, walls: DataFrame | None) -> DataFrame:
    """At most three windows on an exterior wall, widest first, earlier first on ties.

    Without ``walls`` the openings tell ``is_exterior`` of their wall themselves.
    """
    if walls is not None:
        outer = walls.filter("is_exterior").select("plan_id", "wall_id", F.lit(True).alias("is_exterior"))
        return limit_exterior_windows(openings.drop("is_exterior").join(outer, ["plan_id", "wall_id"], "left"), None).drop("is_exterior")
    rank = F.row_number().over(Window.partitionBy("plan_id", "wall_id").orderBy(F.desc("span"), "ord"))
    limited = F.coalesce((F.col("kind") == "window") & F.col("is_exterior"), F.lit(False))
    kept = openings.filter(limited).withColumn("_rank", rank).filter(F.col("_rank") <= WINDOWS_PER_WALL).drop("_rank")
    return openings.filter(~limited).unionByName(kept)


# -- legacy rooms ------------------------------------------------------------


FACING = {"left": "right", "right": "left", "bottom": "top", "top": "bottom"}


def _edges(rooms: DataFrame) -> DataFrame:
    """``rooms`` four times, with side, edge, lo and hi."""
    x2, y2 = F.col("x") + F.col("w"), F.col("y") + F.col("h")
    edge = {
        "bottom": (F.col("y"), F.col("x"), x2),
        "top": (y2, F.col("x"), x2),
        "left": (F.col("x"), F.col("y"), y2),
        "right": (x2, F.col("y"), y2),
    }
    return rooms.withColumn(
        "_e",
        F.explode(F.array(*[F.struct(F.lit(n).alias("side"), c.alias("edge"), a.alias("lo"), b.alias("hi")) for n, (c, a, b) in edge.items()])),
    ).select(*rooms.columns, "_e.side", "_e.edge", "_e.lo", "_e.hi")


def room_sides(rooms: DataFrame) -> DataFrame:
    """The four edges of every room; ``interior`` when another room shares the edge.

    The rooms of a plan meet in one task, in one shuffle; it holds the plan's
    distinct boxes and streams its rooms. Only plans that reach beyond
    ``ROOM_TILE`` from the origin list their edges in cells.
    """
    within = lambda c: F.abs(c) < ROOM_TILE
    near = within(F.col("x")) & within(F.col("y")) & within(F.col("x") + F.col("w")) & within(F.col("y") + F.col("h"))
    far = rooms.filter(~near).select("plan_id").distinct()
    if far.isEmpty():
        return _sides_in_plans(rooms)
    return _sides_in_plans(rooms.join(far, "plan_id", "left_anti")).unionByName(_sides_over_cells(rooms.join(far, "plan_id", "left_semi")))


def _sides_in_plans(rooms: DataFrame) -> DataFrame:
    """``room_sides`` with the rooms of a plan in one task."""
    box = ["x", "y", "w", "h"]
    lost = F.col("plan_id").isNull() | F.col("room_id").isNull()
    same_box, same_room = Window.partitionBy("plan_id", *box), Window.partitionBy("plan_id", "room_id")
    spot = F.struct(*box)
    marked = rooms.filter(~lost).repartition("plan_id").withColumns({
        "_least": F.min("room_id").over(same_box), "_most": F.max("room_id").over(same_box), "_odd": ~F.min(spot).over(same_room).eqNullSafe(F.max(spot).over(same_room))})
    # the first room of a box also tells the box
    roles = F.when(F.col("room_id") == F.col("_least"), F.array(F.lit(True), F.lit(False))).otherwise(F.array(F.lit(False)))
    rows = marked.withColumn("_spot", F.explode(roles))
    out = [*rooms.columns, "_odd"]
    schema = StructType([rows.schema[c] for c in out] + [StructField(f"_{side}", BooleanType()) for side in SIDES])
    found = by_zone(rows, ["plan_id"], partial(_shared, out), schema, stay="_spot", placed=True)
    interior = F.element_at(F.create_map(*[x for side in SIDES for x in (F.lit(side), F.col(f"_{side}"))]), F.col("side"))
    sides = _edges(found).withColumn("interior", interior)
    # rooms of one number but several boxes share what any of them shares
    whole = Window.partitionBy("plan_id", "room_id", "side")
    several = sides.filter("_odd").withColumn("interior", F.max("interior").over(whole))
    columns = ["plan_id", "room_id", "side", *[c for c in rooms.columns if c not in ("plan_id", "room_id")], "edge", "lo", "hi", "interior"]
    alone = _edges(rooms.filter(lost)).withColumn("interior", F.lit(False))
    return sides.filter("NOT _odd").select(*columns).unionByName(several.select(*columns)).unionByName(alone.select(*columns))


def _shared(out: list[str], table: pa.RecordBatch, zone: np.ndarray) -> list[pa.Array]:
    """The columns ``out`` of the rooms among the rows, and for each side whether another room of the plan shares it."""
    is_spot = table.column("_spot").to_numpy(zero_copy_only=False)
    spots, rooms = np.flatnonzero(is_spot), np.flatnonzero(~is_spot)
    x, y, w, h = floats(table, "x", "y", "w", "h")
    ids = pa.concat_arrays([table.column(c) for c in ("room_id", "_least", "_most")]).dictionary_encode().indices.to_numpy().reshape(3, -1)
    edges = {"bottom": (y, x, x + w), "top": (y + h, x, x + w), "left": (x, y, y + h), "right": (x + w, y, y + h)}
    # equal boxes look once
    _, one, alike = np.unique(np.stack([v[rooms] for v in (zone, x, y, w, h)]), axis=1, return_index=True, return_inverse=True)
    one, alike = rooms[one], alike.ravel()
    flags = []
    for side in SIDES:
        (edge, lo, hi), (other, other_lo, other_hi) = edges[side], edges[FACING[side]]
        known = spots[np.isfinite(other[spots])]
        known = known[np.lexsort((other[known], zone[known]))]
        left = other[known].min(initial=0.0)
        wide = other[known].max(initial=0.0) - left + 4 * SHARED_GAP
        at = np.where(np.isfinite(edge[one]), np.clip(edge[one] - left, -2 * SHARED_GAP, wide), 0.0)
        place = zone[known] * 2 * wide + other[known] - left
        # a unit of slack for rounding
        first = np.searchsorted(place, zone[one] * 2 * wide + at - SHARED_GAP - 1)
        times = np.maximum(np.searchsorted(place, zone[one] * 2 * wide + at + SHARED_GAP + 1, "right") - first, 0)
        least, most = np.full(len(one), np.iinfo(np.int64).max), np.full(len(one), -1)
        for part in chunks(times):
            k = np.repeat(np.arange(len(one))[part], times[part])
            i, j = one[k], known[np.repeat(first[part], times[part]) + ramps(times[part])]
            met = (zone[i] == zone[j]) & (np.abs(edge[i] - other[j]) < SHARED_GAP) & (lo[i] < other_hi[j]) & (hi[i] > other_lo[j])
            np.minimum.at(least, k[met], np.minimum(ids[1], ids[2])[j[met]])
            np.maximum.at(most, k[met], np.maximum(ids[1], ids[2])[j[met]])
        own = ids[0][rooms]
        flags.append(pa.array((most[alike] >= 0) & ((least[alike] != own) | (most[alike] != own))))
    taken = pa.array(rooms)
    return [*[table.column(c).take(taken) for c in out], *flags]


def _sides_over_cells(rooms: DataFrame) -> DataFrame:
    """``room_sides`` of plans of any size: edges are listed in cells."""
    sides = _edges(rooms)
    others = (
        sides.select("plan_id", "room_id", lookup(FACING, F.col("side")).alias("side"), "edge", "lo", "hi")
        .withColumn("ec", F.explode(F.sequence(cell_of(F.col("edge") - SHARED_GAP), cell_of(F.col("edge") + SHARED_GAP))))
        .withColumn("ac", F.explode(F.sequence(cell_of(F.col("lo"), ROOM_CELL), cell_of(F.col("hi"), ROOM_CELL))))
        # listed edges are many times what their table's size suggests, so they are never sent to all tasks
        .hint("merge").alias("o")
    )
    mine = (
        sides.select("plan_id", "room_id", "side", "edge", "lo", "hi")
        .withColumn("ec", cell_of(F.col("edge")))
        .withColumn("ac", F.explode(F.sequence(cell_of(F.col("lo"), ROOM_CELL), cell_of(F.col("hi"), ROOM_CELL))))
        .alias("m")
    )
    shared = (
        mine.join(
            others,
            (F.col("m.plan_id") == F.col("o.plan_id")) & (F.col("m.side") == F.col("o.side"))
            & (F.col("m.ec") == F.col("o.ec")) & (F.col("m.ac") == F.col("o.ac"))
            & (F.col("m.room_id") != F.col("o.room_id"))
            & (F.abs(F.col("m.edge") - F.col("o.edge")) < SHARED_GAP)
            & (F.col("m.lo") < F.col("o.hi")) & (F.col("m.hi") > F.col("o.lo")),
            "left_semi",
        )
        .select("plan_id", "room_id", "side")
        .distinct()
        .withColumn("interior", F.lit(True))
    )
    return sides.join(shared.hint("merge"), ["plan_id", "room_id", "side"], "left").withColumn("interior", F.coalesce("interior", F.lit(False)))


def legacy_wall_candidates(sides: DataFrame) -> DataFrame:
    """P10: four wall candidates per room; upright walls stop one thickness short."""
    flat = F.col("side").isin("bottom", "top")
    coord = F.when((F.col("side") == "right") & ~F.col("interior"), F.col("edge") - LEGACY_THICKNESS).otherwise(F.col("edge"))
    return sides.select(
        "plan_id", "room_id", "side",
        F.when(flat, "horizontal").otherwise("vertical").alias("orientation"),
        round_to(coord, 6).alias("coord"),
        F.when(flat, F.col("lo")).otherwise(F.col("lo") + LEGACY_THICKNESS).alias("s"),
        F.when(flat, F.col("hi")).otherwise(F.col("hi") - LEGACY_THICKNESS).alias("e"),
        (~F.col("interior")).alias("is_exterior"),
    )


def legacy_openings(sides: DataFrame) -> DataFrame:
    """Interval of each room opening on its wall line."""
    flat = F.col("side").isin("bottom", "top")
    coord = F.when((F.col("side") == "right") & ~F.col("interior"), F.col("edge") - LEGACY_THICKNESS).otherwise(F.col("edge"))
    return sides.filter("opening_side = side AND opening_width > 0").select(
        "plan_id", "room_id", "side", F.col("opening_kind").alias("kind"),
        F.when(flat, "horizontal").otherwise("vertical").alias("orientation"),
        round_to(coord, 6).alias("coord"),
        (F.col("lo") + F.col("opening_offset")).alias("start"),
        (F.col("lo") + F.col("opening_offset") + F.col("opening_width")).alias("end"),
        F.col("opening_width").alias("span"),
        (~F.col("interior")).alias("is_exterior"),
        "door_type",
    )


def match_legacy(openings: DataFrame, walls: DataFrame) -> DataFrame:
    """The shortest wall on the same line that contains the opening; equal exterior flag first.

    Ties go by wall id. Equal walls are one, the first of them, and equal
    intervals look once; both meet in the grid cells along the line that the
    opening's start falls in, so a line with many walls does not meet all its openings.
    """
    line = ["plan_id", "orientation", "coord"]
    inside = (F.col("s") <= F.col("start") + 1e-6) & (F.col("e") >= F.col("end") - 1e-6)
    w = walls.groupBy(*line, "s", "e", F.col("is_exterior").alias("w_ext")).agg(F.min("wall_id").alias("wall_id")).withColumn(
        "cell", F.explode(F.sequence(cell_of(F.col("s") - 1e-6, ROOM_CELL), cell_of(F.col("e") + 1e-6, ROOM_CELL))))
    place = [*line, "start", "end", "is_exterior"]
    probe = openings.select(*place).distinct().withColumn("cell", cell_of(F.col("start"), ROOM_CELL))
    best = probe.join(w, [*line, "cell"]).filter(inside).groupBy(*place).agg(F.min(
        F.struct((F.col("w_ext") != F.col("is_exterior")).alias("other"), (F.col("e") - F.col("s")).alias("len"), "wall_id", "s")).alias("m"))
    rows = openings.select(*place, "room_id", "side", "kind", "span").join(best, place)
    # a room's opening that is listed more than once has one match
    return rows.groupBy("plan_id", "room_id", "side", "kind", "start", "end", "span").agg(F.min("m").alias("m")).select(
        "plan_id", "room_id", "side", "kind", "span", "m.wall_id", round_to(F.col("start") - F.col("m.s"), 4).alias("offset"))


# -- model output adapters -----------------------------------------------------


def polygon_boxes(corners: DataFrame, heights: DataFrame) -> DataFrame:
    """Bounding boxes with the y axis flipped by the picture height."""
    box = corners.groupBy("plan_id", "poly_id", "poly_type", "cls").agg(
        F.min("px").alias("x1"), F.max("px").alias("x2"), F.min("py").alias("ymin"), F.max("py").alias("ymax")
    )
    return box.join(heights.select("plan_id", "image_h"), "plan_id").select(
        "plan_id", "poly_id", "poly_type", "cls", "x1", "x2",
        (F.col("image_h") - F.col("ymax")).alias("y1"), (F.col("image_h") - F.col("ymin")).alias("y2"),
    )


def polygon_walls(boxes: DataFrame) -> DataFrame:
    """The longer axis is the wall, the shorter its thickness; specks are dropped."""
    xs, ys = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    flat = xs >= ys
    return boxes.filter((F.col("poly_type") == "wall") & ((xs >= 2) | (ys >= 2))).select(
        "plan_id", "poly_id",
        F.when(flat, "horizontal").otherwise("vertical").alias("orientation"),
        F.when(flat, (F.col("y1") + F.col("y2")) / 2).otherwise((F.col("x1") + F.col("x2")) / 2).alias("coord"),
        F.when(flat, F.col("x1")).otherwise(F.col("y1")).alias("s"),
        F.when(flat, F.col("x2")).otherwise(F.col("y2")).alias("e"),
        F.greatest(F.least(xs, ys), F.lit(1.0)).alias("thickness"),
    )


def polygon_openings(boxes: DataFrame) -> DataFrame:
    """P13 + P14: centre, span, orientation, kind and swing of opening polygons.

    The swing compares both half extents of a box around its own centre, so the
    difference never reaches the dead zone and the swing stays null.
    """
    xs, ys = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    cx, cy = (F.col("x1") + F.col("x2")) / 2, (F.col("y1") + F.col("y2")) / 2
    flat = xs >= ys
    # fixed values: opening classes
    kind = F.coalesce(F.element_at(F.create_map(F.lit(1), F.lit("window"), F.lit(2), F.lit("door")), F.col("cls")), F.lit("door"))
    high = F.when(flat, F.col("y2") - cy).otherwise(F.col("x2") - cx)
    low = F.when(flat, cy - F.col("y1")).otherwise(cx - F.col("x1"))
    swing = F.when(
        F.abs(high - low) >= 2.0,
        F.when(flat, F.when(high > low, "up").otherwise("down")).otherwise(F.when(high > low, "right").otherwise("left")),
    )
    is_opening = (F.col("poly_type") == "opening") | ((F.col("poly_type") == "icon") & F.col("cls").isin(1, 2))
    return boxes.filter(is_opening & ((xs >= 2) | (ys >= 2))).select(
        "plan_id", "poly_id", kind.alias("kind"), cx.alias("x"), cy.alias("y"), F.greatest(xs, ys).alias("span"),
        F.when(flat, "horizontal").otherwise("vertical").alias("orientation"),
        F.when(kind == "door", swing).alias("swing"),
    )


def segments_to_walls(segments: DataFrame) -> DataFrame:
    """Centre line of a pixel box, thickness = extent + 1, confidence 0.7."""
    flat = F.col("orientation") == "horizontal"
    return segments.select(
        "plan_id", "segment_id", "orientation",
        F.when(flat, (F.col("y1") + F.col("y2")) / 2).otherwise((F.col("x1") + F.col("x2")) / 2).alias("coord"),
        F.when(flat, F.col("x1")).otherwise(F.col("y1")).alias("s"),
        F.when(flat, F.col("x2")).otherwise(F.col("y2")).alias("e"),
        F.greatest(F.lit(1.0), F.when(flat, F.col("y2") - F.col("y1")).otherwise(F.col("x2") - F.col("x1")) + 1.0).alias("thickness"),
        F.lit(0.7).alias("confidence"),
    )


def vector_lines(points: DataFrame, lines: DataFrame, heights: DataFrame) -> DataFrame:
    """Lines given as point indexes -> walls with y flipped."""
    a = points.select("plan_id", F.col("idx").alias("a"), F.col("x").alias("x1"), F.col("y").alias("ya"))
    b = points.select("plan_id", F.col("idx").alias("b"), F.col("x").alias("x2"), F.col("y").alias("yb"))
    out = lines.join(a, ["plan_id", "a"]).join(b, ["plan_id", "b"]).join(heights.select("plan_id", "image_h"), "plan_id")
    dx, dy = F.abs(F.col("x2") - F.col("x1")), F.abs(F.col("yb") - F.col("ya"))
    return out.select(
        "plan_id", "line_no", "x1", (F.col("image_h") - F.col("ya")).alias("y1"), "x2",
        (F.col("image_h") - F.col("yb")).alias("y2"), F.when(dx >= dy, "horizontal").otherwise("vertical").alias("orientation"),
    )


def suppress_openings(openings: DataFrame, policy: DataFrame) -> DataFrame:
    """Per plan, how many openings a detection policy removes and why."""
    return (
        policy.join(openings.groupBy("plan_id").agg(F.count(F.lit(1)).alias("n")), "plan_id", "left")
        .select(
            "plan_id", "detection_disabled",
            F.when(F.col("detection_disabled"), F.lit(0)).otherwise(F.coalesce("n", F.lit(0))).alias("kept"),
            F.when(F.col("detection_disabled"), F.coalesce("n", F.lit(0))).otherwise(F.lit(0)).alias("suppressed"),
            F.when(F.col("detection_disabled"), F.lit("disabled_by_product_decision")).alias("reason"),
        )
    )


def to_annotations(openings: DataFrame, heights: DataFrame) -> DataFrame:
    """Openings as picture-space segments with one decimal and the swing of their kind."""
    half = F.col("span") / 2
    flat = F.col("orientation") == "horizontal"
    y = F.col("image_h") - F.col("y")
    # fixed values: window side to annotation swing
    by_side_h = {"bottom": "up", "top": "down", "up": "up", "down": "down"}
    by_side_v = {"left": "left", "right": "right"}
    window_swing = F.when(flat, lookup(by_side_h, F.col("side"))).otherwise(lookup(by_side_v, F.col("side")))
    return openings.join(heights.select("plan_id", "image_h"), "plan_id").select(
        "plan_id", "opening_id", F.col("kind").alias("type"),
        round_to(F.when(flat, F.col("x") - half).otherwise(F.col("x")), 1).alias("x1"),
        round_to(F.when(flat, y).otherwise(y - half), 1).alias("y1"),
        round_to(F.when(flat, F.col("x") + half).otherwise(F.col("x")), 1).alias("x2"),
        round_to(F.when(flat, y).otherwise(y + half), 1).alias("y2"),
        F.when(F.col("kind") == "door", F.col("swing")).otherwise(F.coalesce(window_swing, F.col("swing"))).alias("swing"),
    )


def fill_semantics(openings: DataFrame, walls: DataFrame | None) -> DataFrame:
    """P20: missing door swings and window sides from the wall; ``filled`` names the fill.

    Without ``walls`` the openings tell the side and orientation of their wall as ``w_side`` and ``w_o``.
    """
    joined = openings
    if walls is not None:
        joined = openings.join(walls.select("plan_id", "wall_id", F.col("side").alias("w_side"), F.col("orientation").alias("w_o")), ["plan_id", "wall_id"], "left")
    fallback = F.when(F.col("w_o").isNotNull(), default_side(F.col("w_side"), F.col("w_o")))
    swing = lookup(SWING_BY_SIDE, fallback)
    fill_door = (F.col("kind") == "door") & F.col("swing").isNull() & swing.isNotNull()
    fill_window = (F.col("kind") == "window") & F.col("side").isNull() & fallback.isNotNull()
    return joined.select(
        *[c for c in openings.columns if c not in ("swing", "side", "w_side", "w_o")],
        F.when(fill_door, swing).otherwise(F.col("swing")).alias("swing"),
        F.when(fill_window, fallback).otherwise(F.col("side")).alias("side"),
        F.when(fill_door, "door swing").when(fill_window, "window exterior side").alias("filled"),
    )
