"""Drawing geometry: entity measures, render plan, line entities, previews, boxes."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plansift.functions.numeric import round_half_even, round_to
from plansift.operators.intervals import cut_walls
from plansift.operators.openings import lookup

# fixed values: names of the dimension types
DIMENSION_TYPES = {0: "LINEAR", 1: "ALIGNED", 2: "ANGULAR", 3: "DIAMETER", 4: "RADIUS", 5: "ANGULAR_3PT", 6: "ORDINATE"}
DEFAULT_THICKNESS = 4.0
JUNCTION_TOLERANCE = 6.0
WALL_HEIGHT = 96
MIN_SHORT_SIDE = 512
# fixed values: drawing layers of converted vector files
WALL_LAYERS = ["WALL", "COLUMN"]
WINDOW_LAYERS = ["WINDOW"]
DOOR_LAYERS = ["DOOR_FIRE", "DOOR", "DOOR_FIRE_TEXT"]
DETAIL_LAYER = "0"
DETAIL_WINDOW_STROKE = "rgb(178,0,178)"
DETAIL_DOOR_STROKE = "rgb(63,63,63)"


def angle_of(dx: Column, dy: Column) -> Column:
    return F.pmod(F.degrees(F.atan2(dy, dx)), F.lit(360.0))


def entity_measures(rows: DataFrame) -> DataFrame:
    """Line length and angle, circle size, arc span, length and end points."""
    dx, dy = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    line, circle, arc = (F.col("type") == t for t in ("LINE", "CIRCLE", "ARC"))
    span = F.pmod(F.col("end_angle") - F.col("start_angle"), F.lit(360.0))

    def on_circle(fn, center: str, angle: str) -> Column:
        return F.when(arc, round_to(F.col(center) + F.col("radius") * fn(F.radians(angle)), 4))

    return rows.select(
        "file_id", "handle", "type",
        F.when(line, round_to(F.hypot(dx, dy), 4)).when(arc, round_to(F.radians(span) * F.col("radius"), 4)).alias("length"),
        F.when(line, round_to(angle_of(dx, dy), 4)).alias("angle"),
        F.when(circle, round_to(F.col("radius") * F.col("radius") * math.pi, 4)).alias("area"),
        F.when(circle, round_to(F.col("radius") * (2 * math.pi), 4)).alias("circumference"),
        F.when(arc, span).alias("span_angle"),
        on_circle(F.cos, "x1", "start_angle").alias("start_x"), on_circle(F.sin, "y1", "start_angle").alias("start_y"),
        on_circle(F.cos, "x1", "end_angle").alias("end_x"), on_circle(F.sin, "y1", "end_angle").alias("end_y"),
    )


def dimension_type(raw: Column) -> Column:
    """Low four bits -> type name."""
    base = raw.bitwiseAND(0x0F)
    table = F.create_map(*[F.lit(x) for kv in DIMENSION_TYPES.items() for x in kv])
    return F.coalesce(F.try_element_at(table, base), F.format_string("UNKNOWN(%d)", base))


def polyline_segments(vertices: DataFrame, keys: list[str]) -> DataFrame:
    """Segment length and angle per vertex; closed polylines return to their first vertex.

    ``vertices``: keys, n, x, y, bulge, closed.
    """
    order = Window.partitionBy(*keys).orderBy("n")
    first = vertices.groupBy(*keys).agg(F.min_by(F.struct("x", "y"), "n").alias("first"))
    nxt = F.lead(F.struct("x", "y")).over(order)
    rows = vertices.withColumn("_next", nxt).join(first, keys).withColumn(
        "to", F.coalesce("_next", F.when(F.col("closed"), F.col("first")))).filter("to IS NOT NULL")
    dx, dy = F.col("to.x") - F.col("x"), F.col("to.y") - F.col("y")
    return rows.select(
        *keys, "n", round_to(F.hypot(dx, dy), 4).alias("length"), round_to(angle_of(dx, dy), 4).alias("angle"),
        F.when(F.col("bulge") != 0, round_to(F.degrees(F.atan("bulge") * 4), 4)).alias("bulge_angle"),
    )


def polyline_lengths(vertices: DataFrame, keys: list[str]) -> DataFrame:
    """Total length of each polyline, the way back of closed ones included. ``vertices``: keys, n, x, y, closed."""
    order = Window.partitionBy(*keys).orderBy("n")
    point = F.struct("x", "y")
    first = F.first(point).over(order)
    to = F.coalesce(F.lead(point).over(order), F.when(F.col("closed"), first))
    steps = vertices.withColumn("_to", to).withColumn("_length", F.hypot(F.col("_to.x") - F.col("x"), F.col("_to.y") - F.col("y")))
    return steps.groupBy(*keys).agg(round_to(F.coalesce(F.sum("_length"), F.lit(0.0)), 4).alias("total_length"))


def layer_filter(rows: DataFrame, layers: list[str]) -> DataFrame:
    """entities on the named layers."""
    return rows.filter(F.col("layer").isin(*layers))


def layer_summary(rows: DataFrame) -> DataFrame:
    """Counts per layer and type and per layer, with extents, in one pass."""
    return rows.rollup("file_id", "layer", "type").agg(
        F.grouping_id().alias("level"), F.count(F.lit(1)).alias("n"), F.min("x1").alias("min_x"), F.max("x1").alias("max_x"),
        F.min("y1").alias("min_y"), F.max("y1").alias("max_y"),
    ).filter("level IN (0, 1, 3)")


def dimension_types(rows: DataFrame) -> DataFrame:
    """Dimension entities per file, layer and decoded type."""
    found = rows.filter("type = 'DIMENSION'").withColumn("dim_type", dimension_type(F.col("dim_raw")))
    return found.groupBy("file_id", "layer", "dim_type").agg(F.count(F.lit(1)).alias("n"))


def input_profile(sizes: DataFrame) -> DataFrame:
    """Pictures with a short side below 512 are scaled up; sizes and scales of the run."""
    short = F.least("image_w", "image_h")
    low = short < MIN_SHORT_SIDE
    scale = F.when(low, F.lit(float(MIN_SHORT_SIDE)) / short).otherwise(1.0)
    w = F.when(low, F.greatest(F.lit(1), round_half_even(F.col("image_w") * scale).cast("int"))).otherwise(F.col("image_w"))
    h = F.when(low, F.greatest(F.lit(1), round_half_even(F.col("image_h") * scale).cast("int"))).otherwise(F.col("image_h"))
    return sizes.select(
        *sizes.columns, low.alias("applied"), F.when(low, "low_res_upscaled").otherwise("native_resolution").alias("profile"),
        w.alias("run_w"), h.alias("run_h"), (w / F.col("image_w")).alias("scale_x"), (h / F.col("image_h")).alias("scale_y"),
    )


def rescale_walls(walls: DataFrame, sx: Column, sy: Column) -> DataFrame:
    """X-like fields by sx, y-like by sy, thickness by their mean."""
    flat = F.col("orientation") == "horizontal"
    along, cross = F.when(flat, sx).otherwise(sy), F.when(flat, sy).otherwise(sx)
    return walls.withColumns({"s": F.col("s") * along, "e": F.col("e") * along, "coord": F.col("coord") * cross,
                              "thickness": F.col("thickness") * ((sx + sy) / 2)})


def region_walls(regions: DataFrame) -> DataFrame:
    """Centre line and thickness (at least 1) of a region rectangle."""
    flat = F.col("orientation") == "horizontal"
    mid_x, mid_y = (F.col("x1") + F.col("x2")) / 2, (F.col("y1") + F.col("y2")) / 2
    return regions.select(
        "plan_id", "region_id", "orientation", F.when(flat, mid_y).otherwise(mid_x).alias("coord"),
        F.when(flat, F.col("x1")).otherwise(F.col("y1")).alias("s"), F.when(flat, F.col("x2")).otherwise(F.col("y2")).alias("e"),
        F.greatest(F.lit(1.0), F.when(flat, F.col("y2") - F.col("y1")).otherwise(F.col("x2") - F.col("x1"))).alias("thickness"),
    )


def region_edges(regions: DataFrame) -> DataFrame:
    """The four outline segments of a region."""
    ends = [("x1", "y1", "x2", "y1"), ("x2", "y1", "x2", "y2"), ("x2", "y2", "x1", "y2"), ("x1", "y2", "x1", "y1")]
    edges = F.array(*[F.struct(*[F.col(c).alias(n) for c, n in zip(e, ("ax", "ay", "bx", "by"))]) for e in ends])
    return regions.select("plan_id", "region_id", F.posexplode(edges).alias("edge", "p")).select("plan_id", "region_id", "edge", "p.ax", "p.ay", "p.bx", "p.by")


def standard_thickness(raw: Column, threshold: float = 5.0) -> Column:
    """P25: 4 or 6."""
    return F.when(raw >= threshold, 6.0).otherwise(4.0)


def fill_style(thickness: Column) -> Column:
    """P25: hatch by thickness."""
    return F.when(thickness >= 5.0, "SOLID").otherwise("ANSI31")


def median_thickness(regions: DataFrame) -> DataFrame:
    """6 above the plan's median draw thickness, else 4."""
    median = regions.filter("draw_thickness > 0").groupBy("plan_id").agg(F.percentile("draw_thickness", 0.5).alias("median"))
    return regions.join(median, "plan_id", "left").withColumn(
        "std_thickness", F.when(F.col("draw_thickness") > F.coalesce("median", F.lit(4.0)), 6).otherwise(4)).drop("median")


def wall_geometry(walls: DataFrame, detected: Column) -> DataFrame:
    """Drawing geometry of walls; thickness as detected or the standard 4."""
    raw = F.greatest(F.lit(1.0), "thickness")
    return walls.withColumns({"thickness": raw, "draw_thickness": F.when(detected, raw).otherwise(DEFAULT_THICKNESS),
                              "base_start": F.col("s"), "base_end": F.col("e")})


def opening_intervals(openings: DataFrame, geometry: DataFrame | None) -> DataFrame:
    """J20 + P26: interval of each opening on its wall; openings of unknown walls are dropped.

    Without ``geometry`` the openings tell ``wall_o`` and ``base_start`` of their wall themselves.
    """
    if geometry is not None:
        openings = openings.join(geometry.select("plan_id", "wall_id", F.col("orientation").alias("wall_o"), "base_start"), ["plan_id", "wall_id"])
    along = F.when(F.col("wall_o") == "horizontal", F.col("x")).otherwise(F.col("y"))
    start = F.coalesce(F.col("base_start") + F.col("offset"), along - F.col("span") / 2)
    return openings.withColumn("g1", start).withColumn("g2", F.col("g1") + F.col("span")).drop("wall_o", "base_start")


def extend_at_junctions(geometry: DataFrame, members: DataFrame) -> DataFrame:
    """A wall end at a junction grows by the draw thickness, once per end.

    Junctions of a wall are visited in point order; once the start has moved, a
    later junction is compared with the moved start. The distinct points on one
    line are few, so they are folded per wall.
    """
    flat = F.col("orientation") == "horizontal"
    at = members.groupBy("plan_id", "wall_id").agg(
        F.sort_array(F.collect_set(F.when(F.col("orientation") == "horizontal", F.col("x")).otherwise(F.col("y")))).alias("at"))
    rows = geometry.join(at, ["plan_id", "wall_id"], "left").withColumn("tol", F.greatest(F.lit(JUNCTION_TOLERANCE), F.col("draw_thickness") / 2 + 2.0))

    def step(acc: Column, j: Column) -> Column:
        start = F.col("s") - F.when(acc["start"], F.col("draw_thickness")).otherwise(0.0)
        end = F.col("e") + F.when(acc["end"], F.col("draw_thickness")).otherwise(0.0)
        at_start = F.abs(start - j) <= F.col("tol")
        at_end = ~at_start & (F.abs(end - j) <= F.col("tol"))
        return F.struct((acc["start"] | at_start).alias("start"), (acc["end"] | at_end).alias("end"))

    init = F.struct(F.lit(False).alias("start"), F.lit(False).alias("end"))
    moved = F.aggregate(F.coalesce("at", F.array().cast("array<double>")), init, step)
    out = rows.withColumn("_m", moved)
    return out.withColumns({
        "s": F.col("s") - F.when(F.col("_m.start"), F.col("draw_thickness")).otherwise(0.0),
        "e": F.col("e") + F.when(F.col("_m.end"), F.col("draw_thickness")).otherwise(0.0),
    }).drop("_m", "at", "tol")


def line_entities(geometry: DataFrame, gaps: DataFrame) -> DataFrame:
    """Two faces per solid part and two caps per gap."""
    keys = ["plan_id", "wall_id"]
    cut = cut_walls(geometry, gaps, ["orientation", "coord", "draw_thickness"])
    c0, c1 = F.col("coord"), F.col("coord") + F.col("draw_thickness")

    def entity(kind, a0, c_a, a1, c_b) -> Column:
        flat = F.col("orientation") == "horizontal"
        return F.struct(F.lit(kind).alias("kind"), F.when(flat, a0).otherwise(c_a).alias("x1"), F.when(flat, c_a).otherwise(a0).alias("y1"),
                        F.when(flat, a1).otherwise(c_b).alias("x2"), F.when(flat, c_b).otherwise(a1).alias("y2"))

    faces = F.flatten(F.transform("parts", lambda p: F.array(*[entity("face", p["start"], c, p["end"], c) for c in (c0, c1)])))
    g1, g2 = F.col("g1"), F.col("g2")
    caps = F.when(g1.isNotNull(), F.array(*[entity("cap", g, c0, g, c1) for g in (g1, g2)])).otherwise(F.array())
    return cut.select(*keys, F.inline(F.concat(faces, caps)))


def bounds_filter(lines: DataFrame, bounds: DataFrame, margin: float) -> DataFrame:
    """lines with both ends inside the plan's bounds widened by ``margin``."""
    inside = F.lit(True)
    for axis in ("x", "y"):
        for end in ("1", "2"):
            inside = inside & F.col(f"{axis}{end}").between(F.col(f"min_{axis}") - margin, F.col(f"max_{axis}") + margin)
    return lines.join(bounds, "plan_id").filter(inside).select(*lines.columns)


def segment_bounds(lines: DataFrame) -> DataFrame:
    """Bounds of segments and the padded picture size (at least 64)."""
    out = lines.groupBy("plan_id").agg(
        F.min(F.least("x1", "x2")).alias("min_x"), F.max(F.greatest("x1", "x2")).alias("max_x"),
        F.min(F.least("y1", "y2")).alias("min_y"), F.max(F.greatest("y1", "y2")).alias("max_y"))
    return out.withColumns({
        "width": F.greatest(F.lit(64), round_half_even(F.col("max_x") - F.col("min_x") + 40).cast("int")),
        "height": F.greatest(F.lit(64), round_half_even(F.col("max_y") - F.col("min_y") + 40).cast("int")),
    })


def fit_canvas(points: DataFrame, size: int = 256, padding: int = 8) -> DataFrame:
    """Scale and shift every sample's points into the canvas."""
    b = points.groupBy("plan_id").agg(F.min("x").alias("min_x"), F.max("x").alias("max_x"), F.min("y").alias("min_y"), F.max("y").alias("max_y"))
    room = float(max(size - 2 * padding, 1))
    w = F.greatest(F.col("max_x") - F.col("min_x"), F.lit(1.0))
    h = F.greatest(F.col("max_y") - F.col("min_y"), F.lit(1.0))
    fitted = b.withColumn("scale", F.least(F.lit(room) / w, F.lit(room) / h))
    return points.join(fitted, "plan_id").withColumns({
        "x": F.col("x") * F.col("scale") + (F.lit(padding) - F.col("min_x") * F.col("scale")),
        "y": F.col("y") * F.col("scale") + (F.lit(padding) - F.col("min_y") * F.col("scale")),
    }).drop("min_x", "max_x", "min_y", "max_y")


def box_heatmaps(boxes: DataFrame) -> DataFrame:
    """Side midpoints (channels 13-16) and corners (17-20) of opening boxes."""
    mx = round_half_even((F.col("bx0") + F.col("bx1")) / 2).cast("long")
    my = round_half_even((F.col("by0") + F.col("by1")) / 2).cast("long")
    x0, x1, y0, y1 = (F.col(c).cast("long") for c in ("bx0", "bx1", "by0", "by1"))
    points = [(x0, my), (x1, my), (mx, y0), (mx, y1), (x0, y0), (x1, y0), (x0, y1), (x1, y1)]
    items = F.array(*[F.struct(F.lit(13 + i).alias("channel"), x.alias("x"), y.alias("y")) for i, (x, y) in enumerate(points)])
    return boxes.select("plan_id", "box_id", F.inline(items))


def scale_view_box(points: DataFrame, width: int, height: int) -> DataFrame:
    """View-box coordinates -> clipped pixels."""
    def axis(v: str, lo: str, extent: str, size: int) -> Column:
        px = F.rint((F.col(v) - F.col(lo)) * (F.lit(float(size)) / F.greatest(extent, F.lit(1e-6)))).cast("int")
        return F.greatest(F.lit(0), F.least(F.lit(size - 1), px))

    return points.withColumn("px", axis("x", "vb_x", "vb_w", width)).withColumn("py", axis("y", "vb_y", "vb_h", height))


def classify_element(layer: Column, tag: Column, stroke: Column, semantic_id: Column, d: Column) -> Column:
    """Wall, window or door by layer; details by stroke, id or arc."""
    up = F.upper(F.coalesce(layer, F.lit("")))
    path = tag == "path"
    detail = (up == DETAIL_LAYER) & path
    window = detail & (F.coalesce(semantic_id == "33", F.lit(False)) | F.coalesce(stroke == DETAIL_WINDOW_STROKE, F.lit(False)))
    door = detail & F.coalesce(d.contains("A "), F.lit(False)) & F.coalesce(stroke == DETAIL_DOOR_STROKE, F.lit(False))
    return F.when(up.isin(WALL_LAYERS), "wall").when(up.isin(WINDOW_LAYERS) | window, "window").when(up.isin(DOOR_LAYERS) | door, "door")


def scene_boxes(regions: DataFrame, walls: DataFrame) -> DataFrame:
    """Box centre, width and depth for 3D; plans with regions use them, the rest their walls."""
    dx, dy = F.abs(F.col("x2") - F.col("x1")), F.abs(F.col("y2") - F.col("y1"))
    from_regions = regions.filter((dx >= 1) | (dy >= 1)).select(
        "plan_id", F.col("region_id").alias("id"), ((F.col("x1") + F.col("x2")) / 2).alias("x"), (-(F.col("y1") + F.col("y2")) / 2).alias("z"), dx.alias("width"), dy.alias("depth"))
    flat = F.col("orientation") == "horizontal"
    mid, length = (F.col("s") + F.col("e")) / 2, F.col("e") - F.col("s")
    rest = walls.join(regions.select("plan_id").distinct(), "plan_id", "left_anti").select(
        "plan_id", F.col("wall_id").alias("id"), F.when(flat, mid).otherwise(F.col("coord")).alias("x"), (-F.when(flat, F.col("coord")).otherwise(mid)).alias("z"),
        F.when(flat, length).otherwise(F.col("thickness")).alias("width"), F.when(flat, F.col("thickness")).otherwise(length).alias("depth"))
    return from_regions.unionByName(rest).withColumn("height", F.lit(WALL_HEIGHT))


# -- opening review ----------------------------------------------------------------


def swing_options(a: str = "") -> Column:
    """Allowed swings by the longer axis."""
    tall = F.abs(F.col("y2") - F.col("y1")) >= F.abs(F.col("x2") - F.col("x1"))
    return F.when(tall, F.array(F.lit("left"), F.lit("right"))).otherwise(F.array(F.lit("up"), F.lit("down")))


def translate(rows: DataFrame, dx: Column, dy: Column) -> DataFrame:
    """Move annotations."""
    return rows.withColumns({"x1": F.col("x1") + dx, "x2": F.col("x2") + dx, "y1": F.col("y1") + dy, "y2": F.col("y2") + dy})


def swing_target(swing: Column) -> tuple[Column, Column]:
    """Handle point of a swing, at least 28 from the middle."""
    cx, cy = (F.col("x1") + F.col("x2")) / 2, (F.col("y1") + F.col("y2")) / 2
    r = F.greatest(F.lit(28.0), F.hypot(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")) * 0.55)
    x = F.when(swing == "left", cx - r).when(swing == "right", cx + r).otherwise(cx)
    y = F.when(swing == "up", cy - r).when(swing.isin("left", "right"), cy).otherwise(cy + r)
    return x, y


def review_annotations(rows: DataFrame) -> DataFrame:
    """Doors and windows with four numeric ends; anything else is not under review."""
    ends = [F.col(c).try_cast("double") for c in ("x1", "y1", "x2", "y2")]
    known = F.col("type").isin("door", "window")
    for end in ends:
        known = known & end.isNotNull() & ~F.isnan(end)
    return rows.filter(known).withColumns(dict(zip(("x1", "y1", "x2", "y2"), ends)))


def with_swing(rows: DataFrame, swing: Column) -> DataFrame:
    """Set the swing; one that is not allowed for the annotation's axis leaves the old one."""
    return rows.withColumn("swing", F.when(F.array_contains(swing_options(), swing), swing).otherwise(F.col("swing")))


def slab_tip(swing: Column) -> tuple[Column, Column]:
    """Free end of an open door leaf, one opening width from the hinge (x1, y1) towards the swing."""
    width = F.hypot(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"))
    slab = {"up": -math.pi / 2, "down": math.pi / 2, "left": math.pi, "right": 0.0}
    turn = F.element_at(F.create_map(*[F.lit(v) for kv in slab.items() for v in kv]), swing)
    return F.col("x1") + F.cos(turn) * width, F.col("y1") + F.sin(turn) * width


def preview_arcs(rows: DataFrame) -> DataFrame:
    """Quadratic curve of each door from the leaf's tip to the other jamb; windows have none.

    The control point completes hinge, tip and jamb to a parallelogram.
    """
    tip_x, tip_y = slab_tip(F.col("swing"))
    return rows.filter("type = 'door'").select(
        "plan_id", "opening_id", tip_x.alias("start_x"), tip_y.alias("start_y"),
        (tip_x + F.col("x2") - F.col("x1")).alias("control_x"), (tip_y + F.col("y2") - F.col("y1")).alias("control_y"),
        F.col("x2").alias("end_x"), F.col("y2").alias("end_y"))


def preview_lines(rows: DataFrame) -> DataFrame:
    """Preview segments of an annotation with type, ends and swing: two slab lines of a door, six of a window."""
    x1, y1, x2, y2 = (F.col(c) for c in ("x1", "y1", "x2", "y2"))
    tip_x, tip_y = slab_tip(F.col("swing"))
    lean = F.atan2(y2 - y1, x2 - x1)
    ox, oy = F.cos(lean) * 3, F.sin(lean) * 3

    def seg(a, b, c, d) -> Column:
        return F.struct(a.alias("ax"), b.alias("ay"), c.alias("bx"), d.alias("by"))

    door = F.array(seg(x1, y1, tip_x, tip_y), seg(x1 + ox, y1 + oy, tip_x + ox, tip_y + oy))
    lo_x, hi_x, lo_y, hi_y = F.least(x1, x2), F.greatest(x1, x2), F.least(y1, y2), F.greatest(y1, y2)
    mx, my = (x1 + x2) / 2, (y1 + y2) / 2
    sill_y = F.when(F.col("swing") == "up", my + 16).otherwise(my - 16)
    sill_x = F.when(F.col("swing") == "left", mx + 16).otherwise(mx - 16)
    wide = F.array(seg(lo_x, my - 4, hi_x, my - 4), seg(lo_x, my, hi_x, my), seg(lo_x, my + 4, hi_x, my + 4),
                   seg(lo_x, my - 4, lo_x, my + 4), seg(hi_x, my - 4, hi_x, my + 4), seg(lo_x, sill_y, hi_x, sill_y))
    tall = F.array(seg(mx - 4, lo_y, mx - 4, hi_y), seg(mx, lo_y, mx, hi_y), seg(mx + 4, lo_y, mx + 4, hi_y),
                   seg(mx - 4, lo_y, mx + 4, lo_y), seg(mx - 4, hi_y, mx + 4, hi_y), seg(sill_x, lo_y, sill_x, hi_y))
    lines = F.when(F.col("type") == "door", door).when(F.abs(x2 - x1) >= F.abs(y2 - y1), wide).otherwise(tall)
    return rows.select("plan_id", "opening_id", F.posexplode(lines).alias("n", "l")).select("plan_id", "opening_id", "n", "l.*")


def regularize(points: Column, limit_deg: float = 15.0) -> Column:
    """Snap nearly axis-parallel steps of an ordered point list; each step starts at the adjusted point."""
    def step(acc: Column, p: Column) -> Column:
        last = F.element_at(acc, -1)
        dx, dy = p["x"] - last["x"], p["y"] - last["y"]
        angle = F.abs(F.degrees(F.atan2(dy.cast("double"), dx.cast("double"))))
        flat = (angle < limit_deg) | (angle > 180 - limit_deg)
        upright = F.abs(angle - 90) < limit_deg
        moved = F.struct(
            F.when(~flat & upright, last["x"]).otherwise(p["x"]).alias("x"), F.when(flat, last["y"]).otherwise(p["y"]).alias("y"))
        return F.when((F.abs(dx) < 1) & (F.abs(dy) < 1), acc).otherwise(F.concat(acc, F.array(moved)))

    return F.when(F.size(points) < 2, points).otherwise(F.aggregate(F.slice(points, 2, F.size(points)), F.slice(points, 1, 1), step))


def miter_outline(walls: DataFrame, neighbours: DataFrame) -> DataFrame:
    """Outline of a diagonal wall, its ends mitred against touching walls.

    ``walls``: plan_id, wall_id, x1..y2, half; ``neighbours``: plan_id, ord, ox1..oy2, o_half.
    Corners slide along their own edge lines, so the last neighbour in order
    with a valid miter decides an end. Candidates meet in cells of the largest
    end tolerance of their plan.
    """
    half = F.col("half")
    length = F.hypot(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"))
    base = walls.withColumn("len", length).filter("len >= 1").withColumns({
        "ux": (F.col("x2") - F.col("x1")) / F.col("len"), "uy": (F.col("y2") - F.col("y1")) / F.col("len"),
        "tol": F.greatest(half * 4, F.lit(10.0)), "far": half * 4,
    })
    size = base.groupBy("plan_id").agg(F.max("tol").alias("cell"))
    ends = base.select("*", F.inline(F.array(
        F.struct(F.lit(1).alias("end"), F.col("x1").alias("px"), F.col("y1").alias("py"), F.col("ux").alias("bx"), F.col("uy").alias("by")),
        F.struct(F.lit(2).alias("end"), F.col("x2").alias("px"), F.col("y2").alias("py"), (-F.col("ux")).alias("bx"), (-F.col("uy")).alias("by")),
    ))).join(size, "plan_id")
    ends = ends.withColumns({  # corner a lies on the +normal side of the wall, b on the other
        "ca_x": F.col("px") - F.col("uy") * half, "ca_y": F.col("py") + F.col("ux") * half,
        "cb_x": F.col("px") + F.col("uy") * half, "cb_y": F.col("py") - F.col("ux") * half,
    })
    ring = F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx in (-1, 0, 1) for dy in (-1, 0, 1)])
    probes = ends.select("*", F.inline(ring)).withColumn("cx", F.floor(F.col("px") / F.col("cell")) + F.col("dx")).withColumn(
        "cy", F.floor(F.col("py") / F.col("cell")) + F.col("dy"))
    meets = neighbours.select("plan_id", "ord", "wall_id", "o_half", F.inline(F.array(
        F.struct(F.lit(1).alias("o_end"), F.col("ox1").alias("sx"), F.col("oy1").alias("sy"), F.col("ox2").alias("fx"), F.col("oy2").alias("fy")),
        F.struct(F.lit(2).alias("o_end"), F.col("ox2").alias("sx"), F.col("oy2").alias("sy"), F.col("ox1").alias("fx"), F.col("oy1").alias("fy")),
    ))).withColumnRenamed("wall_id", "o_wall").join(size, "plan_id").withColumn("cx", F.floor(F.col("sx") / F.col("cell"))).withColumn(
        "cy", F.floor(F.col("sy") / F.col("cell"))).drop("cell")
    hits = probes.join(meets, ["plan_id", "cx", "cy"]).filter(
        (F.col("wall_id") != F.col("o_wall")) & (F.abs(F.col("px") - F.col("sx")) < F.col("tol")) & (F.abs(F.col("py") - F.col("sy")) < F.col("tol")))
    key = ["plan_id", "wall_id", "end"]
    # a neighbour touching with both ends counts through its first end
    once = hits.groupBy(*key, "ord").agg(F.min_by(F.struct("sx", "sy", "fx", "fy", "o_half"), "o_end").alias("o")).join(ends, key[:2] + ["end"])
    ol = F.hypot(F.col("o.fx") - F.col("o.sx"), F.col("o.fy") - F.col("o.sy"))
    once = once.withColumn("ol", ol).filter("ol >= 1").withColumns({"ox": (F.col("o.fx") - F.col("o.sx")) / F.col("ol"), "oy": (F.col("o.fy") - F.col("o.sy")) / F.col("ol")})
    cross = F.col("bx") * F.col("oy") - F.col("by") * F.col("ox")

    def meet(corner: str, sign: int) -> tuple[Column, Column]:
        qx = F.col("o.sx") - sign * F.col("oy") * F.col("o.o_half")
        qy = F.col("o.sy") + sign * F.col("ox") * F.col("o.o_half")
        t = ((qx - F.col(f"{corner}_x")) * F.col("oy") - (qy - F.col(f"{corner}_y")) * F.col("ox")) / cross
        return F.col(f"{corner}_x") + t * F.col("bx"), F.col(f"{corner}_y") + t * F.col("by")

    def option(sign: int) -> Column:
        ax, ay = meet("ca", sign)
        bx, by = meet("cb", -sign)
        da, db = F.hypot(ax - F.col("px"), ay - F.col("py")), F.hypot(bx - F.col("px"), by - F.col("py"))
        ok = (F.abs(cross) >= 1e-8) & (da < F.col("far")) & (db < F.col("far"))
        return F.when(ok, F.struct((da + db).alias("score"), F.lit(-sign).alias("rank"), ax.alias("ax"), ay.alias("ay"), bx.alias("bx"), by.alias("by")))

    best = once.withColumn("m", F.array_min(F.array_compact(F.array(option(1), option(-1))))).filter("m IS NOT NULL")
    last = best.groupBy(*key).agg(F.max_by("m", "ord").alias("m"))
    out = ends.join(last, key, "left")
    return out.select(
        *key, F.coalesce("m.ax", "ca_x").alias("ax"), F.coalesce("m.ay", "ca_y").alias("ay"),
        F.coalesce("m.bx", "cb_x").alias("bx"), F.coalesce("m.by", "cb_y").alias("by"), F.col("m").isNotNull().alias("mitred"))
