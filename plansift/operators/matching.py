"""Matching between sources: junctions, openings, exterior segments, parent walls, stages."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Callable, Iterator
from functools import partial
from itertools import groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from plansift.functions.folds import fold_sorted
from plansift.functions.numeric import round_half_even, round_to
from plansift.functions.zones import GATHER, by_zone, floats, near_pairs
from plansift.operators import masks as M, sheets
from plansift.operators.intervals import gaps_in_line, merge_spans
from plansift.operators.junctions import TILE, cell_of
from plansift.session import cut_lineage, keep_rows

JUNCTION_REACH = 12.0
#: Side of the cells in which openings meet; wider than most of them reach, so few are listed twice.
OPENING_CELL = 128.0


#: Pairs of a plan that one task settles; larger plans are settled in rounds over rows.
SETTLE = 1 << 18


def greedy_match(pairs: DataFrame) -> DataFrame:
    """One-to-one greedy matching of candidate pairs (plan_id, p_ord, e_ord, score).

    Predictions choose in the order of p_ord, each the free partner with the
    least (score, e_ord). The pairs of a plan come to one task, which settles
    plans of at most ``SETTLE`` pairs in that order and passes on the pairs of
    larger ones, so it holds a bounded number. Those are settled in rounds over
    rows: a pair is settled once it is the best of its prediction and no earlier
    prediction wants its partner, whatever happens elsewhere. Each round settles
    all such pairs, with a minimum per side, and takes their ends out by anti
    joins. The first open prediction of a plan always settles or runs out of
    partners, so the rounds end; their number is that of the longest chain of
    choices that wait for each other.
    """
    p, e = ["plan_id", "p_ord"], ["plan_id", "e_ord"]
    rows = pairs.filter("plan_id IS NOT NULL AND p_ord IS NOT NULL AND e_ord IS NOT NULL").select(*p, "e_ord", "score")
    schema = rows.schema.add("settled", "boolean")
    state = keep_rows(rows.repartition("plan_id").sortWithinPartitions("plan_id", "p_ord", "score", "e_ord").mapInArrow(partial(_settle, SETTLE, to_arrow_schema(schema)), schema))
    settled, left = state.filter("settled").drop("settled"), state.filter("NOT settled").drop("settled")
    while not left.isEmpty():
        best = left.groupBy(*p).agg(F.min(F.struct("score", "e_ord")).alias("b")).select(*p, "b.e_ord", "b.score")
        first = left.groupBy(*e).agg(F.min("p_ord").alias("first"))
        now = best.join(first, e).filter("p_ord = first").drop("first")
        rest = left.join(now.select(*p), p, "left_anti").join(now.select(*e), e, "left_anti")
        state = cut_lineage(now.withColumn("settled", F.lit(True)).unionByName(rest.withColumn("settled", F.lit(False))))
        settled = settled.unionByName(state.filter("settled").drop("settled"))
        left = state.filter("NOT settled").drop("settled")
    return settled


def _settle(most: int, schema: pa.Schema, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs in the order of plan, prediction and score -> the settled pairs, and all pairs of plans with more than ``most`` of them."""
    held: list[pa.RecordBatch] = []
    n, wait, large = 0, GATHER, None

    def marked(table: pa.RecordBatch, settled: bool) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*table.columns, pa.array(np.full(table.num_rows, settled))], schema=schema)

    def chosen(table: pa.RecordBatch) -> pa.RecordBatch:
        plan, p, e = (c.dictionary_encode().indices.to_numpy() for c in table.columns[:3])
        node = (plan.astype(np.int64) * (int(e.max(initial=0)) + 1) + e).tolist()
        rows, taken, done = [], set(), None
        for row, (at, partner) in enumerate(zip(zip(plan.tolist(), p.tolist()), node)):
            if at != done and partner not in taken:
                taken.add(partner)
                rows.append(row)
                done = at
        return marked(table.take(pa.array(rows, pa.int64())), True)

    def worked(last: bool) -> Iterator[pa.RecordBatch]:
        nonlocal held, n, wait, large
        table = pa.concat_batches(held)
        plan = table.column(0)
        passing = 0
        if large is not None:
            passing = pc.sum(pc.equal(plan, large)).as_py() or 0
            yield marked(table.slice(0, passing), False)
            table, plan = table.slice(passing), plan.slice(passing)
        if not table.num_rows:
            held, n = [], 0
            return
        large = None
        # the last plan may go on in the next batch
        stop = table.num_rows if last else pc.index(plan, plan[-1]).as_py()
        if stop:
            sizes = pc.value_counts(plan.slice(0, stop))
            big = sizes.field("values").filter(pc.greater(sizes.field("counts"), most))
            is_big = pc.is_in(plan.slice(0, stop), value_set=big)
            yield chosen(table.slice(0, stop).filter(pc.invert(is_big)))
            yield marked(table.slice(0, stop).filter(is_big), False)
        rest = table.slice(stop)
        if rest.num_rows > most:
            large = plan[-1]
            yield marked(rest, False)
            rest = rest.slice(0, 0)
        held, n = [rest] if rest.num_rows else [], rest.num_rows
        wait = max(GATHER, 2 * n)

    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        n += batch.num_rows
        if n >= wait:
            yield from worked(False)
    if held:
        yield from worked(True)


def junction_pairs(pred: DataFrame, truth: DataFrame, reach: float = JUNCTION_REACH) -> DataFrame:
    """Same-type junctions within ``reach``. Inputs: plan_id, ord, x, y, type.

    Both sides meet in tiles of their plan, in one shuffle; a tile holds the
    junctions of the truth within reach of it and the others stream by.
    """
    side = max(TILE, 4.0 * reach)
    tile = lambda at: F.floor(at / side + 0.5)
    # a unit of slack for rounding
    around = lambda at: F.explode(F.sequence(tile(F.col(at) - reach - 1.0), tile(F.col(at) + reach + 1.0)))
    place = [F.col(c).cast("double").alias(c) for c in ("x", "y")]
    p = pred.filter("plan_id IS NOT NULL").select("plan_id", F.col("ord").alias("p_ord"), *place, "type").withColumns({"_tx": tile(F.col("x")), "_ty": tile(F.col("y")), "_truth": F.lit(False)})
    e = truth.filter("plan_id IS NOT NULL").select("plan_id", F.col("ord").alias("e_ord"), *place, "type").withColumn("_tx", around("x")).withColumn("_ty", around("y")).withColumn("_truth", F.lit(True))
    together = p.unionByName(e, allowMissingColumns=True)
    schema = StructType([together.schema[c] for c in ("plan_id", "p_ord", "e_ord")]).add("score", "double")
    return by_zone(together, ["plan_id", "_tx", "_ty"], partial(_near_junctions, reach), schema, stay="_truth")


def stage_junction_pairs(points: DataFrame, pairs: list[tuple[str, str]], reach: float = JUNCTION_REACH) -> DataFrame:
    """``junction_pairs`` of all (left, right) pairs of stages, with the number of the ``pair``, in one shuffle.

    ``points``: stage, plan_id, ord, x, y, type. A tile holds the junctions of all stages.
    """
    names = sorted({name for pair in pairs for name in pair})
    side = max(TILE, 4.0 * reach)
    tile = lambda at: F.floor(at / side + 0.5)
    around = lambda at: F.explode(F.sequence(tile(F.col(at) - reach - 1.0), tile(F.col(at) + reach + 1.0)))
    number = F.element_at(F.create_map(*[F.lit(x) for k, name in enumerate(names) for x in (name, k)]), F.col("stage"))
    rows = points.filter(F.col("plan_id").isNotNull() & F.col("stage").isin(names)).select(
        "plan_id", number.alias("_stage"), "ord", *[F.col(c).cast("double").alias(c) for c in ("x", "y")], "type").withColumn("_tx", around("x")).withColumn("_ty", around("y"))
    rows = rows.withColumn("_home", (F.col("_tx") == tile(F.col("x"))) & (F.col("_ty") == tile(F.col("y"))))
    schema = StructType([rows.schema["plan_id"]]).add("pair", "integer")
    for name in ("p_ord", "e_ord"):
        schema = schema.add(name, rows.schema["ord"].dataType)
    numbers = [(names.index(a), names.index(b)) for a, b in pairs]
    return by_zone(rows, ["plan_id", "_tx", "_ty"], partial(_near_stages, reach, numbers), schema.add("score", "double"))


def _near_stages(reach: float, pairs: list[tuple[int, int]], table: pa.RecordBatch, zone: np.ndarray) -> list[pa.Array]:
    """Pairs of junctions of one type, the left one at home in its tile, for all pairs of stages."""
    stage = table.column("_stage").to_numpy()
    home = table.column("_home").to_numpy(zero_copy_only=False)
    found = [_near(reach, table, zone, np.flatnonzero(home & (stage == a)), np.flatnonzero(stage == b)) for a, b in pairs]
    pair = np.repeat(np.arange(len(pairs), dtype=np.int32), [len(f[0]) for f in found])
    a, b, score = (np.concatenate(c) for c in zip(*found))
    rows, ord_ = pa.array(a), table.column("ord")
    return [table.column("plan_id").take(rows), pa.array(pair), ord_.take(rows), ord_.take(pa.array(b)), pa.array(score)]


def _near(reach: float, table: pa.RecordBatch, zone: np.ndarray, p: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of ``p`` and of ``e`` of one zone and type within ``reach``, and how far they are apart."""
    x, y = floats(table, "x", "y")
    kind = pc.fill_null(table.column("type").dictionary_encode().indices, -1).to_numpy(zero_copy_only=False)
    p, e = p[kind[p] >= 0], e[kind[e] >= 0]
    group = zone * (int(kind.max(initial=0)) + 1) + kind
    found = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))]
    for a, b in near_pairs(group[p], x[p], y[p], group[e], x[e], y[e], reach):
        a, b = p[a], e[b]
        dx, dy = x[a] - x[b], y[a] - y[b]
        score = np.sqrt(dx * dx + dy * dy)
        near = score <= reach
        found.append((a[near], b[near], score[near]))
    return tuple(np.concatenate(c) for c in zip(*found))


def _near_junctions(reach: float, table: pa.RecordBatch, zone: np.ndarray) -> list[pa.Array]:
    """Pairs of junctions of one type among the rows of a tile."""
    truth = table.column("_truth").to_numpy(zero_copy_only=False)
    a, b, score = _near(reach, table, zone, np.flatnonzero(~truth), np.flatnonzero(truth))
    rows = pa.array(a)
    return [table.column("plan_id").take(rows), table.column("p_ord").take(rows), table.column("e_ord").take(pa.array(b)), pa.array(score)]


def opening_pairs(pred: DataFrame, truth: DataFrame, same_kind: bool = True) -> DataFrame:
    """J22 candidates: close enough and of similar span. Inputs: plan_id, ord, x, y, span, kind."""
    # spans differ by half at most, so the distance limit is below 1.5 predicted spans
    reach = F.greatest(F.lit(12.0), F.col("span") * 1.5)
    cell = lambda v: cell_of(v, OPENING_CELL)
    p = pred.filter("span > 0").select("plan_id", F.col("ord").alias("p_ord"), "x", "y", "span", F.col("kind")).withColumn(
        "cx", F.explode(F.sequence(cell(F.col("x") - reach), cell(F.col("x") + reach)))).withColumn(
        "cy", F.explode(F.sequence(cell(F.col("y") - reach), cell(F.col("y") + reach))))
    e = truth.filter("span > 0").select("plan_id", F.col("ord").alias("e_ord"), F.col("x").alias("ex"), F.col("y").alias("ey"), F.col("span").alias("e_span"),
                                        F.col("kind").alias("e_kind")).withColumns({"cx": cell(F.col("ex")), "cy": cell(F.col("ey"))})
    dist = F.sqrt((F.col("x") - F.col("ex")) * (F.col("x") - F.col("ex")) + (F.col("y") - F.col("ey")) * (F.col("y") - F.col("ey")))
    longest = F.greatest("span", "e_span")
    error = F.abs(F.col("span") - F.col("e_span")) / longest
    found = p.join(e, ["plan_id", "cx", "cy"]).withColumn("dist", dist).withColumn("error", error).filter(
        (F.col("dist") <= F.greatest(F.lit(12.0), longest * 0.75)) & (F.col("error") <= 0.5))
    if same_kind:
        found = found.filter("kind = e_kind")
    return found.select("plan_id", "p_ord", "e_ord", (F.col("dist") + F.col("error") * 10.0).alias("score"))


def match_metrics(pred: DataFrame, truth: DataFrame, matches: DataFrame) -> DataFrame:
    """Counts, precision and recall; 1.0 where both sides are empty."""
    def count(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy("plan_id").agg(F.count(F.lit(1)).alias(name))

    out = count(pred, "predicted").join(count(truth, "expected"), "plan_id", "full").join(count(matches, "matches"), "plan_id", "left").fillna(0)
    precision = F.when(F.col("predicted") > 0, F.col("matches") / F.col("predicted")).otherwise(F.when(F.col("expected") == 0, 1.0).otherwise(0.0))
    recall = F.when(F.col("expected") > 0, F.col("matches") / F.col("expected")).otherwise(F.when(F.col("predicted") == 0, 1.0).otherwise(0.0))
    return out.withColumns({"precision": round_to(precision, 6), "recall": round_to(recall, 6)})


def wall_support(openings: DataFrame, walls: DataFrame, mask: DataFrame, frame: DataFrame | None = None) -> DataFrame:
    """Openings whose wall is drawn in the mask around them (plan_id, ord).

    ``openings``: plan_id, ord, wall_id, x, y, span; ``mask``: boxes of the
    other side's walls, cut to the frame. An opening's own wall is drawn and cut
    to a square of max(8, span) around the opening; at least max(3, thickness)
    pixels of that must be in the mask. Openings without a known wall have no
    support. Distinct cuts come along to the sheets of the mask, which count
    their pixels.
    """
    wall = ["orientation", "coord", "s", "e", "thickness"]
    known = openings.select("plan_id", "ord", "wall_id", "x", "y", "span").join(walls.select("plan_id", "wall_id", *wall), ["plan_id", "wall_id"])
    return drawn_support(known, mask, frame)


def drawn_support(openings: DataFrame, mask: DataFrame, frame: DataFrame | None = None) -> DataFrame:
    """``wall_support`` of openings that carry their wall's orientation, coord, s, e and thickness."""
    pixel = lambda c: round_half_even(c).cast("long")
    x, y, r = pixel("x"), pixel("y"), F.greatest(F.lit(8), pixel("span"))
    near = M.wall_boxes(openings).select(
        "plan_id", "ord", F.greatest(F.lit(3), pixel("thickness")).alias("need"),
        F.greatest("x0", x - r).alias("x0"), F.least("x1", x + r).alias("x1"), F.greatest("y0", y - r).alias("y0"), F.least("y1", y + r).alias("y1")).filter("x0 <= x1 AND y0 <= y1")
    cut = ["plan_id", "x0", "x1", "y0", "y1"]
    block = lambda y: F.floor(F.col(y) / sheets.BLOCK)
    points = near.select(*cut).distinct().withColumn("block", F.explode(F.sequence(block("y0"), block("y1"))))

    def work(s: sheets.Sheet) -> dict[str, np.ndarray]:
        p, drawn = s.points, s.own(s["m"])
        pixels = np.zeros(len(p.g), np.int64)
        for i, j in sheets.meetings(p, drawn):
            wide, high = (np.minimum(p_hi[i], d_hi[j]) - np.maximum(p_lo[i], d_lo[j]) + 1 for p_lo, p_hi, d_lo, d_hi in ((p.x0, p.x1, drawn.x0, drawn.x1), (p.y0, p.y1, drawn.y0, drawn.y1)))
            np.add.at(pixels, i, wide * high)
        met = np.flatnonzero(pixels)
        return p.take(met).columns() | {"pixels": pixels[met]}

    counts = sheets.on_sheets({"m": mask}, frame, work, "x0 long, x1 long, y0 long, y1 long, pixels long", points=points)
    total = counts.groupBy(*cut).agg(F.sum("pixels").alias("pixels"))
    return near.join(total, cut).filter("pixels >= need").select("plan_id", "ord")


def opening_metrics(pred: DataFrame, truth: DataFrame, matches: DataFrame, supported: DataFrame) -> DataFrame:
    """match_metrics, with the matches that have wall support and their share of the predictions."""
    anchored = matches.join(supported.withColumnRenamed("ord", "p_ord"), ["plan_id", "p_ord"], "left_semi").groupBy("plan_id").agg(F.count(F.lit(1)).alias("anchored"))
    out = match_metrics(pred, truth, matches).join(anchored, "plan_id", "left").fillna(0, ["anchored"])
    share = F.when(F.col("predicted") > 0, F.col("anchored") / F.col("predicted")).otherwise(F.when(F.col("expected") == 0, 1.0).otherwise(0.0))
    return out.withColumn("anchor_precision", round_to(share, 6))


# -- windows, exterior segments, parents -----------------------------------------


def exterior_by_extremes(walls: DataFrame) -> DataFrame:
    """Walls in the outer tenth of their axis. A wall in both bands appears once per band."""
    keys = ["plan_id", "orientation"]
    span = walls.groupBy(*keys).agg(F.min("coord").alias("lo"), F.max("coord").alias("hi"))
    band = F.when(F.col("hi") > F.col("lo"), (F.col("hi") - F.col("lo")) * 0.1).otherwise(20.0)
    rows = walls.join(span, keys).withColumn("band", band)
    low = rows.filter(F.col("coord") <= F.col("lo") + F.col("band")).withColumn("edge", F.lit("low"))
    high = rows.filter(F.col("coord") >= F.col("hi") - F.col("band")).withColumn("edge", F.lit("high"))
    return low.unionByName(high).drop("lo", "hi", "band")


def centroid(walls: DataFrame) -> DataFrame:
    """Mean of the wall middles and the plan width."""
    flat = F.col("orientation") == "horizontal"
    mid = (F.col("s") + F.col("e")) / 2
    x = F.when(flat, mid).otherwise(F.col("coord"))
    y = F.when(flat, F.col("coord")).otherwise(mid)
    lo, hi = F.when(flat, F.col("s")).otherwise(F.col("coord")), F.when(flat, F.col("e")).otherwise(F.col("coord"))
    return walls.groupBy("plan_id").agg(round_to(F.avg(x), 6).alias("cx"), round_to(F.avg(y), 6).alias("cy"), (F.max(hi) - F.min(lo)).alias("width"))


def assign_windows(windows: DataFrame, segments: DataFrame, coord_tol: float = 20.0, range_tol: float = 10.0) -> DataFrame:
    """Segment with the least cross distance (+4 for the other orientation), first on ties.

    ``windows``: plan_id, opening_id, x, y, orientation; ``segments``: plan_id, seg_id, orientation, coord, s, e.
    Equal windows look once and equal segments are one, the first of them, so
    a crowded plan costs its distinct places and lines.
    """
    flat = F.col("seg_o") == "horizontal"
    place = ["plan_id", "x", "y", "orientation"]
    probe = windows.select(*place).distinct().withColumn("seg_o", F.explode(F.array(F.lit("horizontal"), F.lit("vertical")))).withColumns(
        {"along": F.when(flat, F.col("x")).otherwise(F.col("y")), "cross": F.when(flat, F.col("y")).otherwise(F.col("x"))})
    probe = probe.withColumn("ac", cell_of(F.col("along"))).withColumn("cc", F.explode(F.sequence(cell_of(F.col("cross") - coord_tol), cell_of(F.col("cross") + coord_tol))))
    lines = segments.groupBy("plan_id", F.col("orientation").alias("seg_o"), "coord", "s", "e").agg(F.min("seg_id").alias("seg_id"))
    listed = lines.withColumn(
        "ac", F.explode(F.sequence(cell_of(F.col("s") - range_tol), cell_of(F.col("e") + range_tol)))).withColumn("cc", cell_of(F.col("coord")))
    diff = F.abs(F.col("cross") - F.col("coord"))
    score = diff + F.when(F.col("orientation") != F.col("seg_o"), 4.0).otherwise(0.0)
    found = probe.join(listed, ["plan_id", "seg_o", "ac", "cc"]).filter(
        F.col("along").between(F.col("s") - range_tol, F.col("e") + range_tol) & (diff <= coord_tol)
    ).groupBy(*place).agg(F.min_by(F.struct("seg_id", "along", score.alias("score")), F.struct(score.alias("score"), F.col("seg_id"))).alias("m"))
    return windows.select(*place, "opening_id").join(found, place).select("plan_id", "opening_id", "m.seg_id", F.col("m.along").alias("center"), "m.score")


def openings_on_walls(openings: DataFrame, walls: DataFrame, tol: float = 8.0) -> DataFrame:
    """Pairs of openings and walls of the opening's orientation, middle within the span and close to the line."""
    flat = F.col("orientation") == "horizontal"
    probe = openings.withColumns({"along": F.when(flat, F.col("x")).otherwise(F.col("y")), "cross": F.when(flat, F.col("y")).otherwise(F.col("x"))}).select(
        "plan_id", "opening_id", "orientation", "along", "cross", cell_of(F.col("along")).alias("ac"),
        F.explode(F.sequence(cell_of(F.col("cross") - tol), cell_of(F.col("cross") + tol))).alias("cc"))
    listed = walls.select("plan_id", "wall_id", "orientation", "coord", "s", "e").withColumn(
        "ac", F.explode(F.sequence(cell_of(F.col("s") - tol), cell_of(F.col("e") + tol)))).withColumn("cc", cell_of(F.col("coord")))
    return probe.join(listed, ["plan_id", "orientation", "ac", "cc"]).filter(
        F.col("along").between(F.col("s") - tol, F.col("e") + tol) & (F.abs(F.col("cross") - F.col("coord")) < tol)
    ).select("plan_id", "opening_id", "wall_id")


def parent_walls(windows: DataFrame, walls: DataFrame, thickness: float = 4.0) -> DataFrame:
    """Wall of the same orientation close to the window's line with the largest overlap, first on ties."""
    flat = F.col("orientation") == "horizontal"
    tol = thickness * 1.5
    probe = windows.withColumns({"along": F.when(flat, F.col("x")).otherwise(F.col("y")), "cross": F.when(flat, F.col("y")).otherwise(F.col("x"))}).withColumns(
        {"lo": F.col("along") - F.col("span") / 2, "hi": F.col("along") + F.col("span") / 2})
    probe = probe.select("plan_id", "opening_id", "orientation", "lo", "hi", "cross", F.explode(F.sequence(cell_of(F.col("lo")), cell_of(F.col("hi")))).alias("ac")).withColumn(
        "cc", F.explode(F.sequence(cell_of(F.col("cross") - tol), cell_of(F.col("cross") + tol))))
    listed = walls.groupBy("plan_id", "orientation", "coord", "s", "e").agg(F.min("ord").alias("line_ord"), F.min_by("wall_id", "ord").alias("wall_id")).withColumn(
        "ac", F.explode(F.sequence(cell_of(F.col("s")), cell_of(F.col("e"))))).withColumn("cc", cell_of(F.col("coord")))
    overlap = F.least("hi", "e") - F.greatest("lo", "s")
    return probe.join(listed, ["plan_id", "orientation", "ac", "cc"]).withColumn("overlap", overlap).filter(
        (F.abs(F.col("coord") - F.col("cross")) <= tol) & (F.col("overlap") > 0)
    ).groupBy("plan_id", "opening_id").agg(
        F.max_by(F.struct("wall_id", "overlap", (F.col("coord") - thickness / 2).alias("edge_low"), (F.col("coord") + thickness / 2).alias("edge_high")),
                 F.struct(F.col("overlap"), (-F.col("line_ord")).alias("o"))).alias("m")).select("plan_id", "opening_id", "m.*")


def resolve_junctions(walls: DataFrame, mode: str = "canvas") -> DataFrame:
    """Ends at crossing walls are trimmed or extended; the first crossing wall in order decides.

    ``walls``: plan_id, wall_id, ord, orientation, mid, lo, hi, half. Both axes
    read the original walls. At a corner the horizontal wall covers the square
    and the vertical one stops; elsewhere ``mode`` decides.
    """
    near = walls.groupBy("plan_id").agg(F.greatest(F.lit(6.0), F.max("half") * 3).alias("near"))
    ends = walls.select("plan_id", "wall_id", "orientation", "mid", F.inline(F.array(
        F.struct(F.lit("lo").alias("end"), F.col("lo").alias("at")), F.struct(F.lit("hi").alias("end"), F.col("hi").alias("at"))))).join(near, "plan_id")
    ends = ends.withColumn("cm", cell_of(F.col("mid"))).withColumn(
        "ca", F.explode(F.sequence(cell_of(F.col("at") - F.col("near")), cell_of(F.col("at") + F.col("near")))))
    others = walls.join(near, "plan_id").groupBy("plan_id", "orientation", "mid", "lo", "hi", "half").agg(F.min("ord").alias("o_ord"), F.max("near").alias("near")).select(
        "plan_id", F.when(F.col("orientation") == "horizontal", "vertical").otherwise("horizontal").alias("orientation"), F.col("mid").alias("o_mid"),
        F.col("lo").alias("o_lo"), F.col("hi").alias("o_hi"), F.col("half").alias("o_half"), "o_ord", cell_of(F.col("mid")).alias("ca"),
        F.explode(F.sequence(cell_of(F.col("lo") - F.col("near")), cell_of(F.col("hi") + F.col("near")))).alias("cm"))
    hit = ends.join(others, ["plan_id", "orientation", "cm", "ca"]).filter(
        (F.abs(F.col("at") - F.col("o_mid")) <= F.col("near")) & F.col("mid").between(F.col("o_lo") - F.col("near"), F.col("o_hi") + F.col("near")))
    corner = (F.abs(F.col("o_lo") - F.col("mid")) <= F.col("near")) | (F.abs(F.col("o_hi") - F.col("mid")) <= F.col("near"))
    first = hit.groupBy("plan_id", "wall_id", "orientation", "end").agg(
        F.min_by(F.struct("o_mid", "o_half", corner.alias("corner")), "o_ord").alias("m"))
    outward = F.when(F.col("m.corner"), F.col("orientation") == "horizontal").otherwise(F.lit(mode == "canvas"))
    sign = F.when(F.col("end") == "hi", 1.0).otherwise(-1.0) * F.when(outward, 1.0).otherwise(-1.0)
    moved = first.select("plan_id", "wall_id", "end", (F.col("m.o_mid") + sign * F.col("m.o_half")).alias("to"))
    wide = moved.groupBy("plan_id", "wall_id").agg(F.max(F.when(F.col("end") == "lo", F.col("to"))).alias("new_lo"), F.max(F.when(F.col("end") == "hi", F.col("to"))).alias("new_hi"))
    return walls.join(wide, ["plan_id", "wall_id"], "left").withColumns(
        {"lo": F.coalesce("new_lo", "lo"), "hi": F.coalesce("new_hi", "hi")}).drop("new_lo", "new_hi")


def audit_rollup(chains: DataFrame) -> DataFrame:
    """Chains per status and the largest gap and error of every plan."""
    return chains.groupBy("plan_id").agg(
        F.count(F.lit(1)).alias("audited"), F.count_if(F.col("status") == "pass").alias("passed"), F.count_if(F.col("status") == "warn").alias("warned"),
        F.count_if(F.col("status") == "fail").alias("failed"), F.max("gap").alias("max_gap"), F.max("closure_error").alias("max_closure_error"))


# -- ordered merges ----------------------------------------------------------------


def merge_mask_walls(walls: DataFrame, gap: int = 15, dist: int = 16) -> DataFrame:
    """Merge into the first earlier wall that is close and touching; the line becomes the integer mean.

    Walls only interact inside a chain of lines closer than ``dist`` and spans
    closer than ``gap``, so the plan is cut into such chains by two window
    passes over distinct coordinates and each chain streams through the fold.
    """
    keys = ["plan_id", "orientation"]
    rows = walls.select(*keys, "ord", *[F.col(c).cast("long").alias(c) for c in ("coord", "s", "e")])
    order = Window.partitionBy(*keys).orderBy("coord")
    bands = rows.select(*keys, "coord").distinct().withColumn("_new", (F.col("coord") - F.lag("coord").over(order) >= dist).cast("int")).withColumn(
        "band", F.sum(F.coalesce("_new", F.lit(0))).over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")
    banded = rows.join(bands, [*keys, "coord"])
    starts = banded.groupBy(*keys, "band", "s").agg(F.max("e").alias("e"))
    along = Window.partitionBy(*keys, "band").orderBy("s")
    islands = starts.withColumn("_reach", F.max("e").over(along.rowsBetween(Window.unboundedPreceding, -1))).withColumn(
        "_new", (F.col("s") > F.col("_reach") + gap).cast("int")).withColumn(
        "island", F.sum(F.coalesce("_new", F.lit(0))).over(along.rowsBetween(Window.unboundedPreceding, 0))).select(*keys, "band", "s", "island")
    rows = banded.join(islands, [*keys, "band", "s"])
    folded = fold_sorted(rows, [*keys, "band", "island"], ["coord", "s", "ord"], ["coord", "s", "e"], partial(_merge_into_first, gap, dist), "coord long, s long, e long")
    return folded.drop("band", "island")


def _merge_into_first(gap: int, dist: int, items: Iterator[tuple]) -> Iterator[tuple]:
    """Walls by line; those that lie too far behind the line at hand are final."""
    open_: list[list[int]] = []
    for coord, s, e in items:
        yield from (tuple(m) for m in open_ if coord - m[0] >= dist)
        open_ = [m for m in open_ if coord - m[0] < dist]
        first = next((m for m in open_ if s <= m[2] + gap and e >= m[1] - gap), None)
        if first is None:
            open_.append([coord, s, e])
        else:
            first[:] = (coord + first[0]) // 2, min(s, first[1]), max(e, first[2])
    yield from (tuple(m) for m in open_)


def merge_shared_walls(spans: DataFrame, thickness: float = 4.0) -> DataFrame:
    """Upright walls exactly one thickness left of the next line join it when any spans overlap.

    ``spans``: plan_id, coord, s, e. A merged line hands its spans on, so a
    run of lines one thickness apart streams through the fold from left to right;
    runs are found by a window over the distinct lines.
    """
    merged = merge_spans(spans, ["plan_id", "coord"], "s", "e").drop("island")
    order = Window.partitionBy("plan_id").orderBy("coord")
    runs = merged.select("plan_id", "coord").distinct().withColumn("_new", (F.col("coord") - F.lag("coord").over(order) != thickness).cast("int")).withColumn(
        "run", F.sum(F.coalesce("_new", F.lit(0))).over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")
    rows = merged.join(runs, ["plan_id", "coord"])
    flat = fold_sorted(rows, ["plan_id", "run"], ["coord", "s"], ["coord", "s", "e"], _hand_on, "coord double, s double, e double")
    return merge_spans(flat, ["plan_id", "coord"], "s", "e").drop("island")


def _hand_on(items: Iterator[tuple]) -> Iterator[tuple]:
    """Lines from left to right; a line whose spans overlap those handed on takes them over."""
    held: list[tuple] = []
    at = None
    for coord, group in groupby(items, key=lambda item: item[0]):
        line = [(s, e) for _, s, e in group]
        ends = [e for _, e in line]
        # the spans of a line are disjoint and sorted, so the first that ends behind a start is the only candidate
        touch = any((k := bisect_right(ends, s)) < len(line) and line[k][0] < e for s, e in held)
        if not touch:
            yield from ((at, s, e) for s, e in held)
            held = []
        held, at = line + held, coord
    yield from ((at, s, e) for s, e in held)


def _strips(walls: DataFrame) -> DataFrame:
    center = F.floor((F.col("c0") + F.col("c1")) / 2)
    reach = F.greatest(F.lit(3), (F.col("c1") - F.col("c0") + 2).cast("int"))
    return walls.filter("e > s").select(
        "plan_id", "wall_id", "orientation", (center - reach).alias("near"), (center + reach).alias("far"), F.col("s").cast("long").alias("lo"), F.col("e").cast("long").alias("hi"))


def wall_gaps(walls: DataFrame, masks: dict[str, DataFrame], frame: DataFrame, rule: Callable[[sheets.Sheet], sheets.Boxes], reach: int = 0, min_gap: int = 12, min_context: int = 8) -> DataFrame:
    """Gaps (plan_id, wall_id, gap_start, gap_end) of walls in the mask that ``rule`` draws; ``walls`` as for ``gaps_along_walls``.

    Distinct strips come along to the sheet of their plan, which tells their
    gaps; walls find the gaps of their strip by one join. Only plans of several
    blocks list strips and boxes in cells.
    """
    strip = ["plan_id", "_flat", "near", "far", "lo", "hi"]
    known = _strips(walls).withColumn("_flat", F.coalesce(F.col("orientation") == "horizontal", F.lit(False)))
    # an upright strip is told by its ends across, which change places
    flat = F.col("_flat")
    ends = {"x0": ("lo", "far"), "x1": ("hi", "near"), "y0": ("near", "lo"), "y1": ("far", "hi")}
    points = known.filter("plan_id IS NOT NULL").select(*strip).distinct().select(
        "plan_id", F.lit(0).cast("long").alias("block"), *[F.when(flat, F.col(a)).otherwise(F.col(b)).cast("long").alias(c) for c, (a, b) in ends.items()])

    def work(s: sheets.Sheet) -> dict[str, np.ndarray]:
        p, mask = s.points, rule(s)
        upright = p.x0 > p.x1
        boxes = sheets.Boxes(p.g, np.minimum(p.x0, p.x1), np.maximum(p.x0, p.x1), p.y0, p.y1)
        lo, hi = np.where(upright, p.y0, p.x0), np.where(upright, p.y1, p.x1)
        found = [(i, np.maximum(lo[i], np.where(upright[i], mask.y0[j], mask.x0[j])), np.minimum(hi[i], np.where(upright[i], mask.y1[j], mask.x1[j]))) for i, j in sheets.meetings(boxes, mask)]
        n, r0, r1 = (np.concatenate([np.zeros(0, np.int64), *c]) for c in (zip(*found) if found else ((), (), ())))
        order = np.lexsort((r0, n))
        n, r0, r1 = n[order], r0[order], r1[order]
        # how far the runs of a strip reach, as a number that grows from strip to strip
        base = r0.min(initial=0)
        wide = r1.max(initial=0) - base + 3
        reached = np.maximum.accumulate(n * wide + r1 - base)
        new = np.append(True, n[1:] * wide + r0[1:] - base > reached[:-1] + 1)[: len(n)]
        first = np.flatnonzero(new)
        at, a = n[first], r0[first]
        b = reached[np.append(first[1:], len(n))[: len(first)] - 1] - at * wide + base
        head = np.append(True, at[1:] != at[:-1])[: len(at)]
        last = np.append(at[1:] != at[:-1], True)[: len(at)]
        at = np.append(at, at[head])
        g0 = np.append(b + 1, lo[at[len(a) :]])
        g1 = np.append(np.where(last, hi[at[: len(a)]] + 1, np.append(a[1:], 0)[: len(a)]), a[head])
        keep = (g1 - g0 >= min_gap) & (g0 - lo[at] >= min_context) & (hi[at] + 1 - g1 >= min_context)
        at, g0, g1 = at[keep], g0[keep], g1[keep]
        near, far = np.where(upright, boxes.x0, p.y0), np.where(upright, boxes.x1, p.y1)
        return {"g": p.g[at], "_flat": ~upright[at], "near": near[at], "far": far[at], "lo": lo[at], "hi": hi[at], "gap_start": g0 - lo[at], "gap_end": g1 - lo[at]}

    low = frame.filter(F.col("h") <= sheets.BLOCK)
    gaps = sheets.on_sheets(masks, low, work, "_flat boolean, near long, far long, lo long, hi long, gap_start long, gap_end long", reach, points=points)
    columns = ["plan_id", "wall_id", "gap_start", "gap_end"]
    out = known.join(gaps, strip).select(*columns)
    tall = frame.filter(F.col("h") > sheets.BLOCK)
    if tall.isEmpty():
        return out
    ids = tall.select("plan_id").distinct()
    mask = sheets.drawn({name: m.join(ids, "plan_id", "left_semi") for name, m in masks.items()}, tall, rule, reach)
    runs = gaps_along_walls(walls.join(ids, "plan_id", "left_semi"), mask.drop("cls"))
    return out.unionByName(gaps_in_line(runs, ["plan_id", "wall_id"], min_gap, min_context).select(*columns))


def gaps_along_walls(walls: DataFrame, mask: DataFrame) -> DataFrame:
    """W15 input: presence of mask pixels along each wall's strip, as runs with the strip bounds.

    ``walls``: plan_id, wall_id, orientation, c0, c1 (first and last line of the wall), s, e.
    """
    strips = _strips(walls)
    flat = F.col("orientation") == "horizontal"
    boxes = strips.select("plan_id", "wall_id", "orientation", "lo", "hi", F.when(flat, F.col("lo")).otherwise(F.col("near")).alias("bx0"), F.when(flat, F.col("hi")).otherwise(F.col("far")).alias("bx1"),
                          F.when(flat, F.col("near")).otherwise(F.col("lo")).alias("by0"), F.when(flat, F.col("far")).otherwise(F.col("hi")).alias("by1"))
    cells = boxes.withColumn("cx", F.explode(F.sequence(cell_of(F.col("bx0")), cell_of(F.col("bx1"))))).withColumn("cy", F.explode(F.sequence(cell_of(F.col("by0")), cell_of(F.col("by1")))))
    blocks = (mask if "y0" in mask.columns else M.compact(mask)).withColumn("cx", F.explode(F.sequence(cell_of(F.col("x0")), cell_of(F.col("x1"))))).withColumn("cy", F.explode(F.sequence(cell_of(F.col("y0")), cell_of(F.col("y1")))))
    hit = cells.join(blocks, ["plan_id", "cx", "cy"]).filter((F.col("x0") <= F.col("bx1")) & (F.col("x1") >= F.col("bx0")) & (F.col("y0") <= F.col("by1")) & (F.col("y1") >= F.col("by0")))
    runs = hit.select("plan_id", "wall_id", "lo", "hi", F.greatest("lo", F.when(flat, F.col("x0")).otherwise(F.col("y0"))).alias("r0"), F.least("hi", F.when(flat, F.col("x1")).otherwise(F.col("y1"))).alias("r1"))
    return merge_spans(runs, ["plan_id", "wall_id", "lo", "hi"], "r0", "r1", 1).select("plan_id", "wall_id", "lo", "hi", F.col("r0").alias("x0"), F.col("r1").alias("x1"))


# -- stages --------------------------------------------------------------------------


def compare_stages(left: DataFrame, right: DataFrame, frame: DataFrame) -> DataFrame:
    """Wall counts, exterior counts, footprint IoU and shell recall of two stages of the same plans."""
    def counts(walls: DataFrame, side: str) -> DataFrame:
        return walls.groupBy("plan_id").agg(F.count(F.lit(1)).alias(f"walls_{side}"), F.count_if("is_exterior").alias(f"exterior_{side}"))

    scores = M.mask_scores(M.wall_boxes(left), M.wall_boxes(right), frame).select("plan_id", F.col("iou").alias("wall_footprint_iou"))
    shell = M.mask_scores(M.wall_boxes(left.filter("is_exterior")), M.wall_boxes(right.filter("is_exterior")), frame).select("plan_id", F.col("recall").alias("exterior_shell_recall"))
    out = counts(left, "left").join(counts(right, "right"), "plan_id", "full").fillna(0)
    return out.withColumn("wall_count_diff", F.col("walls_left") - F.col("walls_right")).join(scores, "plan_id", "left").join(shell, "plan_id", "left")


def compare_all_stages(
    walls: DataFrame, points: DataFrame, openings: DataFrame, pairs: list[tuple[str, str]], frame: DataFrame,
) -> DataFrame:
    """J25 for any stages of the same plans: one row per plan and (left, right) pair.

    ``walls``: stage, plan_id, orientation, coord, s, e, thickness, is_exterior;
    ``points``: stage, plan_id, ord, x, y, type; ``openings``: stage, plan_id,
    ord, kind, x, y, span. All masks are swept at once: two bits per stage, one
    for its walls and one for its exterior walls; every pair's IoU and shell
    recall are sums over the sets of bits. All pairs match their junctions, and
    their openings, in the same rounds.
    """
    names = sorted({name for pair in pairs for name in pair})
    if 2 * len(names) > 62:
        raise ValueError("at most 31 stages")
    bit = {name: 1 << k for k, name in enumerate(names)}
    shell = {name: 1 << (k + len(names)) for k, name in enumerate(names)}
    number = lambda table: F.element_at(F.create_map(*[F.lit(x) for name, b in table.items() for x in (name, b)]), F.col("stage")).cast("long")
    known = walls.filter(F.col("stage").isin(names))
    tagged = known.withColumn("bit", number(bit) + F.when(F.col("is_exterior"), number(shell)).otherwise(0))
    areas = M.areas_by_set(M.wall_boxes(tagged), frame=frame.select("plan_id", "w", "h"))

    listed = F.array(*[F.struct(F.lit(k).alias("pair"), F.lit(a).alias("left"), F.lit(b).alias("right")) for k, (a, b) in enumerate(pairs)])
    of = lambda bits, side: F.col("bits").bitwiseAND(F.element_at(F.create_map(*[F.lit(x) for name, b in bits.items() for x in (name, b)]), F.col(side)).cast("long")) != 0
    total = lambda cond: F.sum(F.when(cond, F.col("area")).otherwise(0))
    a, b, a_shell, b_shell = of(bit, "left"), of(bit, "right"), of(shell, "left"), of(shell, "right")
    masks = areas.select("*", F.inline(listed)).groupBy("plan_id", "pair").agg(
        round_to(total(a & b) / F.nullif(total(a | b), F.lit(0)), 6).alias("wall_footprint_iou"),
        round_to(total(a_shell & b_shell) / F.nullif(total(b_shell), F.lit(0)), 6).alias("exterior_shell_recall"))
    counts = known.groupBy("plan_id", "stage").agg(F.count(F.lit(1)).alias("n"), F.count_if("is_exterior").alias("x"))
    each = frame.select("plan_id", F.inline(listed))
    for side in ("left", "right"):
        each = each.join(counts.select("plan_id", F.col("stage").alias(side), F.col("n").alias(f"walls_{side}"), F.col("x").alias(f"exterior_{side}")), ["plan_id", side], "left")

    # a plan and a pair together are one plan to the matching
    def sides(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
        keyed = rows.select("*", F.inline(listed)).withColumn("plan_id", F.col("plan_id") * len(pairs) + F.col("pair"))
        return keyed.filter("stage = left").drop("stage", "pair", "left", "right"), keyed.filter("stage = right").drop("stage", "pair", "left", "right")

    def scores(rows: DataFrame, candidates: DataFrame, what: str) -> DataFrame:
        left, right = sides(rows)
        found = match_metrics(left, right, greedy_match(candidates))
        return found.select(
            F.floor(F.col("plan_id") / len(pairs)).cast("long").alias("plan_id"), F.pmod("plan_id", F.lit(len(pairs))).cast("int").alias("pair"),
            F.col("precision").alias(f"{what}_precision"), F.col("recall").alias(f"{what}_recall"))

    met = stage_junction_pairs(points, pairs).withColumn("plan_id", F.col("plan_id") * len(pairs) + F.col("pair")).drop("pair")
    out = each.fillna(0).join(masks, ["plan_id", "pair"], "left")
    out = out.join(scores(points, met, "junction"), ["plan_id", "pair"], "left").join(scores(openings, opening_pairs(*sides(openings)), "opening"), ["plan_id", "pair"], "left")
    return out.withColumn("wall_count_diff", F.col("walls_left") - F.col("walls_right")).drop("pair")


def compare_lines(drawn: DataFrame, planned: DataFrame, frame: DataFrame) -> DataFrame:
    """Line counts, difference and IoU of one-pixel line masks; two empty sides agree fully."""
    def thin(lines: DataFrame) -> DataFrame:
        return M.wall_boxes(lines.withColumn("thickness", F.lit(1.0)))

    def count(lines: DataFrame, name: str) -> DataFrame:
        return lines.groupBy("plan_id").agg(F.count(F.lit(1)).alias(name))

    iou = M.mask_scores(thin(drawn), thin(planned), frame).select("plan_id", "iou")
    both = frame.select("plan_id").join(count(drawn, "predicted"), "plan_id", "left").join(count(planned, "expected"), "plan_id", "left").fillna(0)
    return both.join(iou, "plan_id", "left").select(
        "plan_id", "predicted", "expected", (F.col("predicted") - F.col("expected")).alias("diff"),
        F.when((F.col("predicted") == 0) & (F.col("expected") == 0), 1.0).otherwise(F.col("iou")).alias("line_iou"))
