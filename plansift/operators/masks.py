"""Mask algebra on run tables.

A mask is rows ``(plan_id, y, x0, x1)`` with inclusive ends, or boxes with
``y0, y1`` instead of ``y``, which may overlap and reach over the frame. Both
work everywhere; results are runs where runs came in. A whole expression over
masks is worked on sheets (``sheets``) behind one shuffle of boxes. ``frame`` is
``(plan_id, w, h)``.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plansift.functions.numeric import round_half_even, round_to
from plansift.operators import sheets
from plansift.operators.sheets import KEY, Boxes, Sheet, as_boxes


def merge_runs(runs: DataFrame, keys: list[str] = KEY) -> DataFrame:
    """Disjoint maximal runs; touching runs join."""
    return boxes_to_runs(merge_boxes(as_boxes(runs, keys), keys), keys)


def clip(boxes: DataFrame, frame: DataFrame) -> DataFrame:
    """Boxes (x0, x1, y0, y1) cut to the frame; boxes outside vanish."""
    return (
        boxes.join(frame.select("plan_id", "w", "h"), "plan_id")
        .withColumns({"x0": F.greatest("x0", F.lit(0)), "x1": F.least("x1", F.col("w") - 1),
                      "y0": F.greatest("y0", F.lit(0)), "y1": F.least("y1", F.col("h") - 1)})
        .filter("x0 <= x1 AND y0 <= y1")
        .drop("w", "h")
    )


def boxes_to_runs(boxes: DataFrame, keys: list[str] = KEY) -> DataFrame:
    return boxes.select(*keys, F.explode(F.sequence("y0", "y1")).alias("y"), "x0", "x1")


def wall_boxes(walls: DataFrame) -> DataFrame:
    """Pixel boxes of axis-aligned walls with square ends, centred on the line."""
    t = F.greatest(F.lit(1), round_half_even("thickness").cast("long"))
    lo = round_half_even("coord").cast("long") - F.floor(t / 2)
    s, e = round_half_even("s").cast("long"), round_half_even("e").cast("long")
    flat = F.col("orientation") == "horizontal"
    return walls.select(
        *[c for c in walls.columns if c not in ("x0", "x1", "y0", "y1")],
        F.when(flat, s).otherwise(lo).alias("x0"), F.when(flat, e).otherwise(lo + t - 1).alias("x1"),
        F.when(flat, lo).otherwise(s).alias("y0"), F.when(flat, lo + t - 1).otherwise(e).alias("y1"),
    )


def rasterize(walls: DataFrame, frame: DataFrame) -> DataFrame:
    """Walls as merged runs inside the frame."""
    return boxes_to_runs(rasterize_boxes(walls, frame))


def rasterize_boxes(walls: DataFrame, frame: DataFrame) -> DataFrame:
    """M01 as disjoint boxes."""
    return sheets.drawn({"m": wall_boxes(walls)}, frame, lambda s: s["m"]).drop("cls")


def complement(runs: DataFrame, frame: DataFrame, pad: int = 0) -> DataFrame:
    """Everything of the frame (widened by ``pad``) that the runs leave free."""
    return boxes_to_runs(complement_boxes(runs, frame, pad))


def set_areas(masks: dict[str, DataFrame], frame: DataFrame | None = None, rule: Callable[[Sheet], list[Boxes]] | None = None, reach: int = 0) -> DataFrame:
    """Pixels (``area``) per plan and set of masks (``bits``, a bit per mask in their order); ``rule`` may draw other masks from them."""
    names = list(masks)
    pick = rule or (lambda s: [s[name] for name in names])
    found = sheets.on_sheets(masks, frame, lambda s: s.areas(*pick(s)), "bits long, area long", reach)
    return found.groupBy("plan_id", "bits").agg(F.sum("area").alias("area"))


def areas_by_set(boxes: DataFrame, keys: list[str] = KEY, frame: DataFrame | None = None) -> DataFrame:
    """Pixels (``area``) per set of masks that cover them, for up to 62 masks, behind one shuffle of distinct boxes.

    ``boxes`` has ``bit``: the masks that a box belongs to, a bit per mask. Boxes
    may overlap and, with ``frame``, reach over it.
    """
    rows = boxes.select(*keys, F.col("bit").alias("bits"), "x0", "x1", "y0", "y1")
    found = sheets.on_sheets({}, frame, lambda s: s.areas_by_set(), "bits long, area long", keys=keys, layered=rows)
    return found.groupBy(*keys, "bits").agg(F.sum("area").alias("area"))


def _like(boxes: DataFrame, mask: DataFrame) -> DataFrame:
    return boxes.drop("cls") if "y0" in mask.columns else boxes_to_runs(boxes)


def union(a: DataFrame, b: DataFrame, frame: DataFrame | None = None) -> DataFrame:
    """Pixels in either mask."""
    return _like(sheets.drawn({"a": a, "b": b}, frame, lambda s: s.union(s["a"], s["b"])), a)


def intersect(a: DataFrame, b: DataFrame, frame: DataFrame | None = None) -> DataFrame:
    """Pixels in both masks."""
    return _like(sheets.drawn({"a": a, "b": b}, frame, lambda s: s.both(s["a"], s["b"])), a)


def subtract(a: DataFrame, b: DataFrame, frame: DataFrame | None = None) -> DataFrame:
    """Pixels of the first mask outside the second."""
    return _like(sheets.drawn({"a": a, "b": b}, frame, lambda s: s.minus(s["a"], s["b"])), a)


def overlay(masks: dict[str, DataFrame], frame: DataFrame | None = None) -> DataFrame:
    """Class per box; earlier names win."""
    names = list(masks)
    found = sheets.drawn(masks, frame, lambda s: s.overlay(*[s[name] for name in names]))
    return found.withColumn("cls", F.element_at(F.array(*map(F.lit, names)), F.col("cls").cast("int")))


def rect_kernel(size: int, repeat: int = 1) -> list[tuple[int, int, int]]:
    """(dy, left, right) of a square kernel, applied ``repeat`` times."""
    lo, hi = (size // 2) * repeat, (size - 1 - size // 2) * repeat
    return [(dy, lo, hi) for dy in range(-lo, hi + 1)]


def ellipse_kernel(size: int) -> list[tuple[int, int, int]]:
    """(dy, left, right) of the inscribed ellipse of an odd square."""
    r = size // 2
    half = {dy: int(round(math.sqrt(r * r - dy * dy))) for dy in range(-r, r + 1)}
    return [(dy, h, h) for dy, h in half.items()]


def nested_boxes(kernel: list[tuple[int, int, int]]) -> list[tuple[int, int, int, int]]:
    """A convex kernel as (up, down, left, right) boxes whose union it is."""
    out = []
    for a, b in sorted({(a, b) for _, a, b in kernel}):
        rows = [dy for dy, a2, b2 in kernel if a2 >= a and b2 >= b]
        out.append((-min(rows), max(rows), a, b))
    return out


@dataclass(frozen=True)
class Step:
    """Grow by rectangles (up, down, left, right), then turn set and unset pixels over if ``turn``.

    ``pad`` widens the frame of the turn. No rectangle leaves the pixels as they are.
    """

    grow: tuple[tuple[int, int, int, int], ...] = ()
    turn: bool = False
    pad: int = 0


def grow(kernel: list[tuple[int, int, int]]) -> Step:
    return Step(tuple(nested_boxes(kernel)))


def mirrored(kernel: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    return [(-dy, b, a) for dy, a, b in kernel]


def erosion(kernel: list[tuple[int, int, int]], border: str = "extend") -> list[Step]:
    """Turn, grow by the mirrored kernel, turn. ``border='extend'`` treats outside pixels as set, ``'clip'`` as unset."""
    pad = max(max(abs(dy), a, b) for dy, a, b in kernel) if border == "clip" else 0
    return [Step(turn=True, pad=pad), Step(grow(mirrored(kernel)).grow, turn=True)]


def closing(kernel: list[tuple[int, int, int]]) -> list[Step]:
    return [grow(kernel), *erosion(kernel)]


def opening(kernel: list[tuple[int, int, int]], border: str = "extend") -> list[Step]:
    return [*erosion(kernel, border), grow(mirrored(kernel))]


def shorten(steps: list[Step]) -> list[Step]:
    """The same chain in fewer steps.

    A turn right after growing belongs to that step, two turns in a row cancel,
    and two growths in a row are one by all sums of their rectangles. Cutting to
    the frame in between changes nothing for rectangles: a pixel outside can be
    moved to the nearest one inside without losing reach.
    """
    out: list[Step] = []
    for step in steps:
        last = out[-1] if out else None
        if last is None or step.pad or last.pad or (last.turn and step.grow):
            out.append(step)
        elif last.turn:
            out[-1] = replace(last, turn=not step.turn)
        else:
            both = tuple(sorted({tuple(i + j for i, j in zip(p, q)) for p in last.grow for q in step.grow})) if last.grow and step.grow else last.grow or step.grow
            out[-1] = Step(both, step.turn)
        if out and not out[-1].grow and not out[-1].turn:
            out.pop()
    return out


def reach_of(steps: list[Step]) -> int:
    """Rows that a pixel's result can depend on, up or down."""
    return sum(max((max(up, down) for up, down, _, _ in step.grow), default=0) + step.pad for step in steps)


def morph(boxes: DataFrame, steps: list[Step], frame: DataFrame | None = None, keys: list[str] = KEY) -> DataFrame:
    """Disjoint boxes after a chain of growing and turning over, behind one shuffle."""
    short = shorten(steps)
    return sheets.drawn({"m": boxes}, frame, lambda s: s.morph(s["m"], short), reach_of(short), keys).drop("cls")


def dilate_boxes(boxes: DataFrame, kernel: list[tuple[int, int, int]], frame: DataFrame | None = None, keys: list[str] = KEY) -> DataFrame:
    """Grow boxes by a convex kernel and make them disjoint again."""
    return morph(boxes, [grow(kernel)], frame, keys)


def close_boxes(boxes: DataFrame, kernel, frame: DataFrame) -> DataFrame:
    return morph(boxes, closing(kernel), frame)


def morph_runs(runs: DataFrame, steps: list[Step], frame: DataFrame | None = None, keys: list[str] = KEY) -> DataFrame:
    """A chain on a mask; runs are listed again at the end if runs came in."""
    out = morph(runs, steps, frame, keys)
    return out if "y0" in runs.columns else boxes_to_runs(out, keys)


def dilate(runs: DataFrame, kernel: list[tuple[int, int, int]], frame: DataFrame | None = None, keys: list[str] = KEY) -> DataFrame:
    """Grow by a convex kernel."""
    return morph_runs(runs, [grow(kernel)], frame, keys)


def erode(runs: DataFrame, kernel: list[tuple[int, int, int]], frame: DataFrame, border: str = "extend") -> DataFrame:
    """Shrink by a convex kernel."""
    return morph_runs(runs, erosion(kernel, border), frame)


def close(runs: DataFrame, kernel, frame: DataFrame) -> DataFrame:
    return morph_runs(runs, closing(kernel), frame)


def open_(runs: DataFrame, kernel, frame: DataFrame, border: str = "extend") -> DataFrame:
    return morph_runs(runs, opening(kernel, border), frame)


def close_open(runs: DataFrame, close_kernel, open_kernel, frame: DataFrame) -> DataFrame:
    """Close, then open, as one chain of three steps."""
    return morph_runs(runs, [*closing(close_kernel), *opening(open_kernel)], frame)


# -- rectangles ----------------------------------------------------------------


def compact(runs: DataFrame, keys: list[str] = KEY) -> DataFrame:
    """Stack equal runs of consecutive rows into boxes (x0, x1, y0, y1)."""
    order = Window.partitionBy(*keys, "x0", "x1").orderBy("y")
    return (
        runs.withColumn("_g", F.col("y") - F.row_number().over(order))
        .groupBy(*keys, "x0", "x1", "_g")
        .agg(F.min("y").alias("y0"), F.max("y").alias("y1"))
        .drop("_g")
    )


def merge_boxes(boxes: DataFrame, keys: list[str] = KEY) -> DataFrame:
    """Overlapping boxes -> disjoint stacked boxes of the same pixels."""
    return sheets.drawn({"m": boxes}, None, lambda s: s["m"], keys=keys).drop("cls")


def complement_boxes(boxes: DataFrame, frame: DataFrame, pad: int = 0) -> DataFrame:
    """Free space of the frame (widened by ``pad``) around a mask, as stacked boxes."""
    return sheets.drawn({"m": boxes}, frame, lambda s: s.free(s.layers["m"], pad), keys=KEY, pad=pad).drop("cls")


def turned(boxes: DataFrame) -> DataFrame:
    """Boxes with rows and columns exchanged."""
    swap = {"x0": "y0", "x1": "y1", "y0": "x0", "y1": "x1"}
    return boxes.select(*[F.col(swap.get(c, c)).alias(c) for c in boxes.columns])


def column_slabs(boxes: DataFrame, keys: list[str] = KEY) -> DataFrame:
    """Boxes turned by 90 degrees: maximal vertical runs, equal columns kept together."""
    return turned(merge_boxes(turned(as_boxes(boxes, keys)), keys))


def open_lines(runs: DataFrame, length: Column | int, horizontal: bool) -> DataFrame:
    """Opening with a 1 x L line: keep runs (or column runs) of at least L pixels, as boxes.

    ``runs`` are maximal, as runs or boxes; ``length`` may be a column of them that is constant per plan.
    """
    need = F.lit(length) if isinstance(length, int) else length
    if horizontal:
        return as_boxes(runs.filter(F.col("x1") - F.col("x0") + 1 >= need))
    tall = F.col("y1") - F.col("y0") + 1
    if isinstance(length, int):
        return column_slabs(runs).filter(tall >= need)
    per_plan = runs.groupBy("plan_id").agg(F.max(need).alias("_need"))
    return column_slabs(runs).join(per_plan, "plan_id").filter(tall >= F.col("_need")).drop("_need")


# -- measures ------------------------------------------------------------------


def mask_scores(pred: DataFrame, truth: DataFrame, frame: DataFrame | None = None) -> DataFrame:
    """Pixels, IoU (null on empty union) and recall (null on empty truth) per plan."""
    return area_scores(set_areas({"p": pred, "t": truth}, frame))


def area_scores(areas: DataFrame, p: int = 1, t: int = 2) -> DataFrame:
    """A09 from the areas of sets of masks; ``p`` and ``t`` are the bits of the two masks."""
    in_p, in_t = (F.col("bits").bitwiseAND(bit) != 0 for bit in (p, t))
    total = lambda cond: F.sum(F.when(cond, F.col("area")).otherwise(0))
    sums = areas.filter(in_p | in_t).groupBy("plan_id").agg(total(in_p & in_t).alias("inter"), F.sum("area").alias("uni"), total(in_t).alias("truth_px"))
    return sums.select(
        "plan_id", "inter", "uni", "truth_px",
        round_to(F.when(F.col("uni") > 0, F.col("inter") / F.col("uni")), 6).alias("iou"),
        round_to(F.when(F.col("truth_px") > 0, F.col("inter") / F.col("truth_px")), 6).alias("recall"),
    )


def relaxed_scores(pred: DataFrame, truth: DataFrame, frame: DataFrame, size: int = 3) -> DataFrame:
    """Scores after growing both masks by the same ellipse."""
    steps = [grow(ellipse_kernel(size))]
    return area_scores(set_areas({"p": pred, "t": truth}, frame, lambda s: [s.morph(s[n], steps) for n in "pt"], reach_of(steps)))


# -- pixels --------------------------------------------------------------------

# fixed values: class colours
ROOM_COLORS = [
    ((255, 255, 255), 0), ((244, 249, 239), 1), ((32, 37, 45), 2), ((241, 231, 214), 3), ((250, 241, 221), 4), ((233, 242, 255), 5),
    ((226, 241, 245), 6), ((240, 240, 240), 7), ((226, 226, 226), 8), ((237, 230, 239), 9), ((231, 233, 236), 10), ((248, 248, 248), 11),
]
ICON_COLORS = [((255, 255, 255), 0), ((69, 142, 255), 1), ((214, 116, 47), 2)]


def nearest_color(r: Column, g: Column, b: Column, palette) -> Column:
    """Class of the nearest palette colour (squared distance, first entry on ties)."""
    scored = [
        F.struct(((r - cr) * (r - cr) + (g - cg) * (g - cg) + (b - cb) * (b - cb)).alias("d"), F.lit(i).alias("i"), F.lit(cls).alias("cls"))
        for i, ((cr, cg, cb), cls) in enumerate(palette)
    ]
    return F.array_min(F.array(*scored))["cls"]


def is_dark_wall(r: Column, g: Column, b: Column) -> Column:
    """Near-black paint is always wall."""
    return (r < 80) & (g < 80) & (b < 80)


def is_orange(r: Column, g: Column, b: Column) -> Column:
    """Orange paint is wall when thick, door when thin."""
    return (r > 130) & (r - b > 80) & (g < 160)


def split_paint(dark: DataFrame, orange: DataFrame, frame: DataFrame, thick: int = 6) -> tuple[DataFrame, DataFrame]:
    """(wall mask, door mask) from dark and orange masks by the thickness test."""
    steps = shorten(opening(rect_kernel(thick)))
    bold = lambda s: s.morph(s["orange"], steps)
    wall = sheets.drawn({"dark": dark, "orange": orange}, frame, lambda s: s.union(s["dark"], bold(s)), reach_of(steps))
    door = sheets.drawn({"orange": orange}, frame, lambda s: s.minus(s["orange"], bold(s)), reach_of(steps))
    return _like(wall, dark), _like(door, orange)


def close_rooms(walls: DataFrame, thick: DataFrame, icons: DataFrame) -> tuple[dict[str, DataFrame], Callable[[Sheet], Boxes], int]:
    """Masks, rule and reach of walls closed by 5 x 5 twice, with annotated walls and openings painted shut."""
    steps = shorten(closing(rect_kernel(5, 2)))
    masks = {"walls": walls, "thick": thick, "icons": icons}
    return masks, lambda s: s.union(s.morph(s["walls"], steps), s["thick"], s["icons"]), reach_of(steps)


DIRECTIONS = {"right": (1, 0), "down": (0, 1), "left": (-1, 0), "up": (0, -1)}
BITS = {"right": 1, "down": 2, "left": 4, "up": 8}
# fixed values: channel by the set of neighbours (sum of the bits above)
CHANNEL_BY_BITS = {1: 0, 2: 1, 4: 2, 8: 3, 9: 4, 3: 5, 6: 6, 12: 7, 7: 8, 14: 9, 13: 10, 11: 11, 15: 12}


def _neighbour_sums(pixels: DataFrame, offsets: list[tuple[int, int, int]]) -> DataFrame:
    """Every pixel tells each neighbour about itself; one shuffle replaces a join per direction."""
    told = F.array(
        F.struct(F.lit(0).alias("dx"), F.lit(0).alias("dy"), F.lit(0).alias("v"), F.lit(1).alias("own")),
        *[F.struct(F.lit(-dx).alias("dx"), F.lit(-dy).alias("dy"), F.lit(v).alias("v"), F.lit(0).alias("own")) for dx, dy, v in offsets],
    )
    return (
        pixels.select("image_id", "x", "y", F.inline(told))
        .groupBy("image_id", (F.col("x") + F.col("dx")).alias("x"), (F.col("y") + F.col("dy")).alias("y"))
        .agg(F.sum("v").alias("v"), F.max("own").alias("own"))
        .filter("own = 1")
        .drop("own")
    )


def skeleton_channels(pixels: DataFrame, w: int, h: int) -> DataFrame:
    """End, corner, T and cross channels of inner skeleton pixels from their four neighbours."""
    sums = _neighbour_sums(pixels, [(*DIRECTIONS[d], BITS[d]) for d in DIRECTIONS])
    table = F.create_map(*[F.lit(x) for kv in CHANNEL_BY_BITS.items() for x in kv])
    inner = F.col("x").between(1, w - 2) & F.col("y").between(1, h - 2)
    return sums.filter(inner & (F.col("v") > 0)).withColumn("channel", F.try_element_at(table, F.col("v").cast("int"))).filter("channel IS NOT NULL").drop("v")


def junction_degrees(pixels: DataFrame, w: int, h: int) -> DataFrame:
    """Channel 0, 1, 2 for inner pixels with two, three, four or more of eight neighbours."""
    around = [(dx, dy, 1) for dx in (-1, 0, 1) for dy in (-1, 0, 1) if dx or dy]
    sums = _neighbour_sums(pixels, around)
    inner = F.col("x").between(1, w - 2) & F.col("y").between(1, h - 2)
    return sums.filter(inner & (F.col("v") >= 2)).select("image_id", "x", "y", F.least(F.col("v") - 2, F.lit(2)).cast("int").alias("channel"))


def color_coded(pixels: DataFrame, limit: int = 50) -> DataFrame:
    """More than ``limit`` green or blue marker pixels."""
    green = (F.col("g") > 140) & (F.col("r") < 130) & (F.col("b") < 130)
    blue = (F.col("b") > 140) & (F.col("g") < 150) & (F.col("r") < 130)
    return pixels.groupBy("image_id").agg(
        F.count_if(green).alias("green"), F.count_if(blue).alias("blue")
    ).withColumn("color_coded", F.col("green") + F.col("blue") > limit)


def otsu(pixels: DataFrame) -> DataFrame:
    """Threshold with the largest between-class variance per image, inverted when most is dark.

    The histogram has 256 bins at most, so the window runs over bins, not pixels.
    """
    hist = pixels.groupBy("image_id", "v").agg(F.count(F.lit(1)).alias("n"))
    order = Window.partitionBy("image_id").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy("image_id")
    cum = hist.withColumns({
        "w0": F.sum("n").over(order), "s0": F.sum(F.col("n") * F.col("v")).over(order),
        "total": F.sum("n").over(whole), "sum": F.sum(F.col("n") * F.col("v")).over(whole),
    })
    w1 = F.col("total") - F.col("w0")
    gap = F.col("s0") / F.col("w0") - (F.col("sum") - F.col("s0")) / w1
    variance = F.when(w1 > 0, round_to(F.col("w0") * w1 * gap * gap, 3)).otherwise(0.0)
    best = cum.groupBy("image_id").agg(
        F.min_by(F.struct("v", "w0", "total"), F.struct((-variance).alias("m"), F.col("v"))).alias("t")
    )
    dark = F.col("t.w0") / F.col("t.total")
    return best.select("image_id", F.col("t.v").alias("threshold"), F.col("t.w0").alias("dark"), (dark > 0.5).alias("inverted"))
