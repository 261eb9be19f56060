"""Wall regions from a mask: candidates, fitting to the page, trimming, clamping."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plansift.functions.numeric import round_to
from plansift.functions.ranking import number_by
from plansift.functions.zones import by_zone, chunks, floats, ramps
from plansift.operators import components as C
from plansift.operators import masks as M, sheets as S
from plansift.operators.junctions import cell_of
from plansift.session import cut_lineage

# fixed values: drawing page and limits
PAGE = (40.0, 30.0, 1530.0, 1080.0)
MAX_THICKNESS = 6.0
KEEP_DEPTH = 0.4
MIN_ASPECT = 2.5
TRIM_TOLERANCE, TRIM_MARGIN = 2.0, 1.3


def page_transform(w: Column, h: Column) -> Column:
    """struct(scale, offset_x, offset_y) that fits a picture on the page, centred on the loose axis."""
    x1, y1, x2, y2 = PAGE
    plan_w, plan_h = x2 - x1, y2 - y1
    wide = w / h > plan_w / plan_h
    scale = F.when(wide, F.lit(plan_w) / w).otherwise(F.lit(plan_h) / h)
    off_x = F.when(wide, F.lit(x1)).otherwise(F.lit(x1) + (F.lit(plan_w) - w * scale) / 2)
    off_y = F.when(wide, F.lit(y1) + (F.lit(plan_h) - h * scale) / 2).otherwise(F.lit(y1))
    return F.struct(scale.alias("scale"), off_x.alias("offset_x"), off_y.alias("offset_y"))


def to_page(x: Column, y: Column, h: Column, t: Column) -> tuple[Column, Column]:
    """Picture point -> drawing point (y flipped)."""
    return x * t["scale"] + t["offset_x"], (h - y) * t["scale"] + t["offset_y"]


def to_picture(x: Column, y: Column, h: Column, t: Column) -> tuple[Column, Column]:
    """Drawing point -> picture point."""
    return (x - t["offset_x"]) / t["scale"], h - (y - t["offset_y"]) / t["scale"]


def mask_summary(stats: DataFrame, frame: DataFrame) -> DataFrame:
    """Pixels, coverage, components, largest component and bounding box of a mask."""
    return stats.join(frame.select("plan_id", "w", "h"), "plan_id").groupBy("plan_id").agg(
        F.sum("area").alias("nonzero_pixel_count"), round_to(F.sum("area") / F.max(F.col("w") * F.col("h")), 6).alias("coverage_ratio"),
        F.count(F.lit(1)).alias("component_count"), F.max("area").alias("largest_component_area"),
        F.min("bx0").alias("x1"), F.min("by0").alias("y1"), (F.max("bx1") + 1).alias("x2"), (F.max("by1") + 1).alias("y2"),
    )


def heatmap_junctions(points: DataFrame, frame: DataFrame) -> DataFrame:
    """Heatmap points grown by a 5 x 5 ellipse, one centroid per component of at least 3 pixels."""
    return C.component_stats(_clusters(points, frame, [M.grow(M.ellipse_kernel(5))])).filter("area >= 3")


def _clusters(mask: DataFrame, frame: DataFrame, steps: list[M.Step]) -> DataFrame:
    short = M.shorten(steps)
    return C.labelled({"m": mask}, frame, lambda s: [s.morph(s["m"], short)], reach=M.reach_of(short))


def icons_to_openings(icons: DataFrame, frame: DataFrame, kind: str) -> DataFrame:
    """Icon pixels closed, grown and grouped; small groups are dropped."""
    # fixed values: kernel size and least area per kind
    size, least_area = (11, 120) if kind == "door" else (15, 150)
    kernel = M.ellipse_kernel(size)
    stats = C.component_stats(_clusters(icons, frame, [*M.closing(kernel), M.grow(kernel)])).filter(F.col("area") >= least_area)
    w, h = F.col("bx1") - F.col("bx0") + 1, F.col("by1") - F.col("by0") + 1
    return stats.select(
        "plan_id", F.lit(kind).alias("kind"), round_to("cx", 4).alias("x"), round_to("cy", 4).alias("y"),
        F.greatest(w, h).cast("double").alias("span"), F.when(w >= h, "horizontal").otherwise("vertical").alias("orientation"), "area",
    )


def _lines(s: S.Sheet, mask: S.Boxes, flat: bool) -> S.Boxes:
    """what the opening with a line of a fortieth of the picture, 8 at least, leaves of a mask."""
    need = np.maximum(8, np.minimum(s.w, s.h) // 40)
    if flat:
        return mask.take(mask.x1 - mask.x0 + 1 >= need[mask.g])
    tall = s.union(S.Boxes(mask.g, mask.y0, mask.y1, mask.x0, mask.x1))
    kept = tall.take(tall.x1 - tall.x0 + 1 >= need[tall.g])
    return s.union(S.Boxes(kept.g, kept.y0, kept.y1, kept.x0, kept.x1))


def candidates(
    masks: dict[str, DataFrame], frame: DataFrame, orientations: tuple[str, ...], rule: Callable[[S.Sheet], S.Boxes] | None = None, reach: int = 0,
) -> DataFrame:
    """components of the line opening with the reason for skipping them, null when accepted.

    The mask is the first of ``masks``, or what ``rule`` draws from them; all orientations share its sheets.
    """
    first = next(iter(masks))
    if "vertical" in orientations:
        # a column run is long enough or not within this reach
        side = frame.agg(F.max(F.least("w", "h")).alias("side")).first()["side"]
        reach += max(8, int(side or 0) // 40)

    def work(s: S.Sheet) -> list[S.Boxes]:
        mask = s[first] if rule is None else rule(s)
        return [_lines(s, mask, o == "horizontal") for o in orientations]

    found = C.labelled(masks, frame, work, reach=reach)
    need = frame.select("plan_id", F.greatest(F.lit(8), F.floor(F.least("w", "h") / 40)).alias("need"))
    stats = C.component_stats(found, ["plan_id", "cls"]).join(need, "plan_id")
    stats = stats.withColumn("orientation", F.element_at(F.array(*map(F.lit, orientations)), F.col("cls") + 1))
    w, h = F.col("bx1") - F.col("bx0") + 1, F.col("by1") - F.col("by0") + 1
    flat = F.col("orientation") == "horizontal"
    length, depth = F.when(flat, w).otherwise(h), F.when(flat, h).otherwise(w)
    reason = F.when((length < F.col("need")) | (depth < 2), "too_short").when(length / depth < MIN_ASPECT, "insufficient_aspect_ratio")
    return stats.select(
        "plan_id", "comp", "bx0", "bx1", "by0", "by1", length.alias("length"), depth.alias("depth"), reason.alias("skip_reason"), "orientation")


def region_rectangles(accepted: DataFrame, frame: DataFrame) -> DataFrame:
    """Accepted candidates trimmed to 40 percent of their depth, on the page."""
    flat = F.col("orientation") == "horizontal"
    trim = F.col("depth") * (1 - KEEP_DEPTH) / 2
    left = F.when(flat, F.col("bx0")).otherwise(F.col("bx0") + trim)
    right = F.when(flat, F.col("bx1") + 1).otherwise(F.col("bx1") + 1 - trim)
    top = F.when(flat, F.col("by0") + trim).otherwise(F.col("by0"))
    bottom = F.when(flat, F.col("by1") + 1 - trim).otherwise(F.col("by1") + 1)
    placed = accepted.join(frame.select("plan_id", "w", "h"), "plan_id").withColumn("t", page_transform(F.col("w"), F.col("h")))
    x1, y1 = to_page(left, bottom, F.col("h"), F.col("t"))
    x2, y2 = to_page(right, top, F.col("h"), F.col("t"))
    return placed.select("plan_id", "orientation", F.col("comp").alias("ord"), x1.alias("x1"), y1.alias("y1"), x2.alias("x2"), y2.alias("y2"))


PAGE_CELL = 128.0
#: Rectangles of a plan that one task compares with each other; plans with more of them list theirs in cells.
FEW = 256


def _crowded(rects: DataFrame) -> DataFrame:
    return rects.groupBy("plan_id").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > FEW).select("plan_id")


def trim_rectangles(rects: DataFrame, number: str | None = None) -> DataFrame:
    """Ends of horizontal rectangles move to the vertical ones they meet, then the reverse.

    Each pass tests the bounds it started with; of several matches the last in
    order wins. The second pass reads the moved horizontal bounds. ``number``
    adds the position by ``ord`` within the plan and orientation. A plan's
    rectangles meet in one task, in one shuffle; only plans with more than
    ``FEW`` list them in cells.
    """
    rects = rects.filter("orientation IN ('horizontal', 'vertical')")
    crowded = _crowded(rects)
    if crowded.isEmpty():
        return _trim_plans(rects, number)
    crowded = cut_lineage(crowded)
    many = rects.join(crowded, "plan_id", "left_semi")
    if number is not None:
        many = number_by(many, ["plan_id", "orientation"], "ord", number)
    h = many.filter("orientation = 'horizontal'")
    v = many.filter("orientation = 'vertical'")
    h2 = _trim(h, v, "x", "y")
    v2 = _trim(v, h2, "y", "x")
    return _trim_plans(rects.join(crowded, "plan_id", "left_anti"), number).unionByName(h2).unionByName(v2)


def _trim_plans(rects: DataFrame, number: str | None) -> DataFrame:
    bounds = ["x1", "y1", "x2", "y2"]
    placed = rects.withColumns({c: F.col(c).cast("double") for c in bounds}).repartition("plan_id")
    if number is not None:
        placed = placed.withColumn(number, F.row_number().over(Window.partitionBy("plan_id", "orientation").orderBy("ord")).cast("long"))
    names = placed.columns

    def work(table: pa.RecordBatch, zone: np.ndarray) -> list[pa.Array]:
        flat = pc.equal(table.column("orientation"), "horizontal").to_numpy(zero_copy_only=False)
        old = dict(zip(bounds, floats(table, *bounds)))
        new = {c: v.copy() for c, v in old.items()}
        known = pc.and_(table.column("plan_id").is_valid(), table.column("ord").is_valid()).to_numpy(zero_copy_only=False)
        last = pc.rank(table.column("ord"), tiebreaker="dense").to_numpy(zero_copy_only=False).astype(np.int64)
        rows = np.flatnonzero(known)
        h, v = rows[flat[rows]], rows[~flat[rows]]
        _move(h, v, zone, last, old, new, "x", "y")
        _move(v, h, zone, last, {**old, "x1": new["x1"], "x2": new["x2"]}, new, "y", "x")
        return [pa.array(new[c], from_pandas=True) if c in new else table.column(c) for c in names]

    return by_zone(placed, ["plan_id"], work, placed.schema, placed=True)


def _move(mine: np.ndarray, other: np.ndarray, zone: np.ndarray, last: np.ndarray, old: dict, new: dict, a: str, c: str) -> None:
    """``_trim`` for the rows ``mine`` and ``other`` of the same zones, into ``new``."""
    lo, hi = old[f"{a}1"], old[f"{a}2"]
    mid = (old[f"{c}1"] + old[f"{c}2"]) / 2
    start = np.searchsorted(zone[other], zone[mine])
    counts = np.searchsorted(zone[other], zone[mine], "right") - start
    for part in chunks(counts):
        n = counts[part]
        m, o = np.repeat(mine[part], n), other[np.repeat(start[part], n) + ramps(n)]
        hit = (mid[m] >= old[f"{c}1"][o] - TRIM_TOLERANCE) & (mid[m] <= old[f"{c}2"][o] + TRIM_TOLERANCE) & (lo[m] < hi[o]) & (hi[m] > lo[o])
        m, o = m[hit], o[hit]
        # the last in order is written last
        order = np.lexsort((last[o], m))
        m, o = m[order], o[order]
        far = (hi[o] - lo[o]) * TRIM_MARGIN
        high = (lo[o] - TRIM_TOLERANCE < hi[m]) & (hi[m] < hi[o] + far)
        low = (lo[o] - far < lo[m]) & (lo[m] < hi[o] + TRIM_TOLERANCE)
        new[f"{a}2"][m[high]] = hi[o[high]]
        new[f"{a}1"][m[low]] = lo[o[low]]


def _trim(mine: DataFrame, other: DataFrame, a: str, c: str) -> DataFrame:
    """Move the ends of ``mine`` along axis ``a``; ``c`` is the crossing axis."""
    lo, hi = f"{a}1", f"{a}2"
    mid = (F.col(f"{c}1") + F.col(f"{c}2")) / 2
    reach = F.col("o_hi") - F.col("o_lo")
    probes = mine.withColumn("mid", mid).withColumn("ca", F.explode(F.sequence(cell_of(F.col(lo), PAGE_CELL), cell_of(F.col(hi), PAGE_CELL)))).withColumn(
        "cc", cell_of(F.col("mid"), PAGE_CELL))
    listed = other.select(
        "plan_id", F.col("ord").alias("o_ord"), F.col(lo).alias("o_lo"), F.col(hi).alias("o_hi"), F.col(f"{c}1").alias("o_c1"), F.col(f"{c}2").alias("o_c2"),
    ).withColumn("ca", F.explode(F.sequence(cell_of(F.col("o_lo"), PAGE_CELL), cell_of(F.col("o_hi"), PAGE_CELL)))).withColumn(
        "cc", F.explode(F.sequence(cell_of(F.col("o_c1") - TRIM_TOLERANCE, PAGE_CELL), cell_of(F.col("o_c2") + TRIM_TOLERANCE, PAGE_CELL))))
    hits = probes.join(listed, ["plan_id", "ca", "cc"]).filter(
        F.col("mid").between(F.col("o_c1") - TRIM_TOLERANCE, F.col("o_c2") + TRIM_TOLERANCE) & (F.col(lo) < F.col("o_hi")) & (F.col(hi) > F.col("o_lo"))
    )
    high = (F.col("o_lo") - TRIM_TOLERANCE < F.col(hi)) & (F.col(hi) < F.col("o_hi") + reach * TRIM_MARGIN)
    low = (F.col("o_lo") - reach * TRIM_MARGIN < F.col(lo)) & (F.col(lo) < F.col("o_hi") + TRIM_TOLERANCE)
    moved = hits.groupBy("plan_id", "ord").agg(
        F.max_by(F.when(high, F.col("o_hi")), F.when(high, F.col("o_ord"))).alias("new_hi"),
        F.max_by(F.when(low, F.col("o_lo")), F.when(low, F.col("o_ord"))).alias("new_lo"),
    )
    return mine.join(moved, ["plan_id", "ord"], "left").withColumns(
        {lo: F.coalesce("new_lo", lo), hi: F.coalesce("new_hi", hi)}
    ).drop("new_lo", "new_hi")


def clamp_thickness(rects: DataFrame, limit: float = MAX_THICKNESS) -> DataFrame:
    """Rectangles thicker than ``limit`` shrink around their centre line."""
    flat = F.col("orientation") == "horizontal"
    raw = F.greatest(F.lit(0.0), F.when(flat, F.col("y2") - F.col("y1")).otherwise(F.col("x2") - F.col("x1")))
    out = rects.withColumn("raw_thickness", raw).withColumn("draw_thickness", F.least("raw_thickness", F.lit(limit))).withColumn(
        "clamped", F.col("raw_thickness") > limit)
    half = F.col("draw_thickness") / 2

    def side(name: str, axis: str, is_axis: Column, sign: int) -> Column:
        mid = (F.col(f"{axis}1") + F.col(f"{axis}2")) / 2
        return F.when(F.col("clamped") & is_axis, mid + sign * half).otherwise(F.col(name)).alias(name)

    return out.select(
        *[c for c in out.columns if c not in ("x1", "y1", "x2", "y2")],
        side("x1", "x", ~flat, -1), side("y1", "y", flat, -1), side("x2", "x", ~flat, 1), side("y2", "y", flat, 1),
    )


def region_plan(mask: DataFrame, frame: DataFrame, erasers: DataFrame | None = None) -> DataFrame:
    """Wall regions of a mask with their numbers, bounds before and after trimming, and clamped thickness.

    The mask is closed by 5 x 5 twice and opened by 3 x 3, and the erasers are cut (F13).
    """
    steps = M.shorten([*M.closing(M.rect_kernel(5, 2)), *M.opening(M.rect_kernel(3))])
    masks = {"m": mask} if erasers is None else {"m": mask, "erasers": erasers}

    def clean(s: S.Sheet) -> S.Boxes:
        cleaned = s.morph(s["m"], steps)
        return cleaned if erasers is None else s.minus(cleaned, s["erasers"])

    found = candidates(masks, frame, ("horizontal", "vertical"), clean, M.reach_of(steps)).filter("skip_reason IS NULL")
    names = ["x1", "y1", "x2", "y2"]
    before = cut_lineage(region_rectangles(found, frame)).withColumns({f"raw_{n}": F.col(n) for n in names})
    after = trim_rectangles(before, "_number")
    adjusted = F.lit(False)
    for n in names:
        adjusted = adjusted | (F.abs(F.col(n) - F.col(f"raw_{n}")) > 1e-6)
    return clamp_thickness(after.withColumn("adjusted", adjusted)).withColumn("region_id", F.format_string("%s-region-%04d", F.substring("orientation", 1, 1), "_number")).drop("_number")


def region_meta(plan: DataFrame) -> DataFrame:
    """Region, clamped and adjusted counts."""
    return plan.groupBy("plan_id").agg(
        F.count(F.lit(1)).alias("region_count"), F.count_if("clamped").alias("clamped_region_count"),
        F.count_if((F.col("orientation") == "horizontal") & F.col("adjusted")).alias("horizontal_adjusted_count"),
        F.count_if((F.col("orientation") == "vertical") & F.col("adjusted")).alias("vertical_adjusted_count"),
    )
