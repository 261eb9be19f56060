"""Wall cleaning: normalise, project, snap, merge, classify, filter.

Axis-aligned walls are rows ``(plan_id, wall_id, ord, orientation, coord, s, e,
thickness, confidence, cfg)``. A plan may hold any number of rows. Every step
first collapses rows to distinct coordinates with a map-side aggregate, so the
windows and joins that follow see coordinates, not rows, and one crowded plan
stays as small as its drawing area.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plansift.functions.numeric import round_to
from plansift.functions.ranking import number_rows
from plansift.functions.zones import by_zone, floats
from plansift.operators.intervals import close_islands

EPS = 1e-6
DIAGONAL_DEG = 15.0
MAX_CONFIDENCE = 0.995
LINE = ["plan_id", "orientation", "coord", "s", "e", "thickness"]


# -- normalise ---------------------------------------------------------------


def json_points(polyline: Column | str) -> Column:
    """Points as array<struct<x,y>> from ``{"x":..,"y":..}`` or ``[x,y]`` items."""
    text = F.col(polyline) if isinstance(polyline, str) else polyline
    pairs = F.transform(
        F.from_json(text, "array<array<double>>"), lambda p: F.struct(p[0].alias("x"), p[1].alias("y"))
    )
    return F.when(text.rlike(r"^\s*\[\s*\["), pairs).otherwise(F.from_json(text, "array<struct<x:double,y:double>>"))


def parse_points(raw: DataFrame) -> DataFrame:
    """Replace the JSON ``polyline`` by x1, y1, x2, y2 (null for a missing point)."""
    keep = [c for c in raw.columns if c != "polyline"]
    return raw.select(*keep, json_points("polyline").alias("_p")).select(
        *keep,
        F.get("_p", F.lit(0))["x"].alias("x1"), F.get("_p", F.lit(0))["y"].alias("y1"),
        F.get("_p", F.lit(1))["x"].alias("x2"), F.get("_p", F.lit(1))["y"].alias("y2"),
    )


def normalize_walls(raw: DataFrame) -> DataFrame:
    """Axis-aligned walls with defaults; ``error`` names why a row is unusable."""
    flat = F.abs(F.col("y1") - F.col("y2")) <= EPS
    upright = F.abs(F.col("x1") - F.col("x2")) <= EPS
    found = F.when(flat, "horizontal").when(upright, "vertical")
    error = (
        F.when(F.col("x1").isNull() | F.col("x2").isNull(), "needs two points")
        .when(~flat & ~upright, "not axis-aligned")
        .when(~F.coalesce("orientation", found).isin("horizontal", "vertical"), "not axis-aligned")
    )
    swap = F.when(flat, F.col("x1") > F.col("x2")).otherwise(F.col("y1") > F.col("y2"))
    return raw.withColumn("error", error).select(
        "plan_id", "wall_id", "ord", "error",
        F.coalesce("orientation", found).alias("orientation"),
        F.when(swap, F.col("x2")).otherwise(F.col("x1")).alias("x1"),
        F.when(swap, F.col("y2")).otherwise(F.col("y1")).alias("y1"),
        F.when(swap, F.col("x1")).otherwise(F.col("x2")).alias("x2"),
        F.when(swap, F.col("y1")).otherwise(F.col("y2")).alias("y2"),
        F.coalesce("thickness", F.lit(4.0)).alias("thickness"),
        F.coalesce("confidence", F.lit(1.0)).alias("confidence"),
        F.coalesce("is_exterior", F.lit(False)).alias("is_exterior"),
    )


def normalize_any(raw: DataFrame) -> DataFrame:
    """Keep diagonals; order the ends along the main axis (x for diagonals)."""
    flat = F.abs(F.col("y1") - F.col("y2")) <= EPS
    upright = F.abs(F.col("x1") - F.col("x2")) <= EPS
    kind = F.coalesce(
        F.col("orientation"), F.when(flat, "horizontal").when(upright, "vertical").otherwise("diagonal")
    )
    swap = F.when(kind == "vertical", F.col("y1") > F.col("y2")).otherwise(F.col("x1") > F.col("x2"))
    ends = {"x1": "x2", "y1": "y2", "x2": "x1", "y2": "y1"}
    return raw.select(
        *[c for c in raw.columns if c not in {*ends, "orientation"}],
        kind.alias("orientation"),
        *[F.when(swap, F.col(b)).otherwise(F.col(a)).alias(a) for a, b in ends.items()],
    )


def project_near_axis(raw: DataFrame) -> DataFrame:
    """Walls within 15 degrees of an axis move onto it; ``projected`` marks them."""
    dx = F.abs(F.col("x2") - F.col("x1"))
    dy = F.abs(F.col("y2") - F.col("y1"))
    slanted = (dx >= EPS) & (dy >= EPS)
    angle = F.degrees(F.atan2(dy, dx))
    to_h = slanted & (angle <= DIAGONAL_DEG)
    to_v = slanted & ~to_h & (F.lit(90.0) - angle <= DIAGONAL_DEG)
    x_mean = (F.col("x1") + F.col("x2")) / 2
    y_mean = (F.col("y1") + F.col("y2")) / 2
    return raw.select(
        *[c for c in raw.columns if c not in {"x1", "y1", "x2", "y2", "orientation"}],
        F.when(to_h, "horizontal").when(to_v, "vertical").otherwise(F.col("orientation")).alias("orientation"),
        F.when(to_h, F.least("x1", "x2")).when(to_v, x_mean).otherwise(F.col("x1")).alias("x1"),
        F.when(to_h, y_mean).when(to_v, F.least("y1", "y2")).otherwise(F.col("y1")).alias("y1"),
        F.when(to_h, F.greatest("x1", "x2")).when(to_v, x_mean).otherwise(F.col("x2")).alias("x2"),
        F.when(to_h, y_mean).when(to_v, F.greatest("y1", "y2")).otherwise(F.col("y2")).alias("y2"),
        (to_h | to_v).alias("projected"),
    )


def to_axis(walls: DataFrame) -> DataFrame:
    """Two-point rows -> axis rows. Diagonals get s = 0, e = length, coord = null."""
    flat = F.col("orientation") == "horizontal"
    diagonal = F.col("orientation") == "diagonal"
    length = F.hypot(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"))
    return (
        walls.withColumn("coord", F.when(diagonal, F.lit(None)).when(flat, F.col("y1")).otherwise(F.col("x1")))
        .withColumn("s", F.when(diagonal, F.lit(0.0)).when(flat, F.col("x1")).otherwise(F.col("y1")))
        .withColumn("e", F.when(diagonal, length).when(flat, F.col("x2")).otherwise(F.col("y2")))
    )


def to_points(walls: DataFrame) -> DataFrame:
    """Axis rows -> x1, y1, x2, y2."""
    flat = F.col("orientation") == "horizontal"
    return (
        walls.withColumn("x1", F.when(flat, F.col("s")).otherwise(F.col("coord")))
        .withColumn("y1", F.when(flat, F.col("coord")).otherwise(F.col("s")))
        .withColumn("x2", F.when(flat, F.col("e")).otherwise(F.col("coord")))
        .withColumn("y2", F.when(flat, F.col("coord")).otherwise(F.col("e")))
    )


def scale_walls(walls: DataFrame, scale: Column | float) -> DataFrame:
    """P07 for walls: pixels to inches."""
    factor = scale if isinstance(scale, Column) else F.lit(scale)
    return walls.withColumns({c: F.col(c) * factor for c in ("coord", "s", "e", "thickness")})


# -- snap and merge ----------------------------------------------------------


def cluster_values(values: DataFrame, keys: list[str], value: str, tolerance: Column) -> DataFrame:
    """Chain sorted values while the step is within tolerance.

    Returns keys + (value, cluster, center, n). Equal values are counted before
    the window, so its input is one row per distinct coordinate.
    """
    distinct = values.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n"), F.max(tolerance).alias("_tol"))
    order = Window.partitionBy(*keys).orderBy(value)
    stepped = distinct.withColumn(
        "_new", (F.col(value) - F.lag(value).over(order) > F.col("_tol")).cast("int")
    ).withColumn(
        "cluster",
        F.sum(F.coalesce("_new", F.lit(0))).over(order.rowsBetween(Window.unboundedPreceding, 0)),
    )
    member = Window.partitionBy(*keys, "cluster")
    return stepped.withColumn(
        "center", F.sum(F.col(value) * F.col("n")).over(member) / F.sum("n").over(member)
    ).drop("_new")


def _snap_map(walls: DataFrame) -> DataFrame:
    """(plan, orientation, role, value) -> value on the nearest cluster center within tolerance."""
    values = walls.select(
        "plan_id", "orientation", F.col("cfg.snap").alias("tol"),
        F.explode(
            F.array(
                F.struct(F.lit("coord").alias("role"), F.col("coord").alias("value")),
                F.struct(F.lit("span").alias("role"), F.col("s").alias("value")),
                F.struct(F.lit("span").alias("role"), F.col("e").alias("value")),
            )
        ).alias("v"),
    ).select("plan_id", "orientation", "tol", "v.role", "v.value")
    keys = ["plan_id", "orientation", "role"]
    clustered = cluster_values(values, keys, "value", F.col("tol"))
    # centers keep the order of their clusters, so the nearest one is the own, previous or next center
    around = Window.partitionBy(*keys).orderBy("value")
    own = Window.partitionBy(*keys, "cluster").orderBy("value")
    whole = own.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    near = (
        clustered.withColumn("_pc", F.lag("center").over(around))
        .withColumn("_nc", F.lead("center").over(around))
        .withColumn("prev_center", F.first("_pc").over(whole))
        .withColumn("next_center", F.last("_nc").over(whole))
    )

    def dist(c: str) -> Column:
        return F.coalesce(F.abs(F.col(c) - F.col("value")), F.lit(float("inf")))

    best = (
        F.when((dist("prev_center") <= dist("center")) & (dist("prev_center") <= dist("next_center")), F.col("prev_center"))
        .when(dist("center") <= dist("next_center"), F.col("center"))
        .otherwise(F.col("next_center"))
    )
    return near.withColumn("best", best).select(
        *keys, "value",
        F.when(F.abs(F.col("best") - F.col("value")) <= F.col("_tol"), F.col("best")).otherwise(F.col("value")).alias("snapped"),
    )


def _replace(walls: DataFrame, mapping: DataFrame, field: str, value: str, new: str) -> DataFrame:
    renamed = mapping.select("plan_id", "orientation", F.col(value).alias(field), F.col(new).alias("_new"))
    return (
        walls.join(renamed, ["plan_id", "orientation", field], "left")
        .withColumn(field, F.coalesce("_new", field))
        .drop("_new")
    )


def snap_walls(walls: DataFrame) -> DataFrame:
    """Lines and ends move to their cluster centers; diagonals pass through."""
    axis = walls.filter("orientation <> 'diagonal'")
    mapping = _snap_map(axis)
    coords = mapping.filter("role = 'coord'")
    spans = mapping.filter("role = 'span'")
    out = _replace(axis, coords, "coord", "value", "snapped")
    out = _replace(out, spans, "s", "value", "snapped")
    return _replace(out, spans, "e", "value", "snapped")


def snap_to_axes(walls: DataFrame) -> DataFrame:
    """Ends move to the nearest crossing line within the junction tolerance (first line on ties)."""
    axes = (
        walls.groupBy("plan_id", "orientation", "coord")
        .agg(F.min("ord").alias("first_ord"), F.max("cfg.junction").alias("tol"))
        .select(
            "plan_id", "coord", "first_ord", "tol",
            F.when(F.col("orientation") == "horizontal", "vertical").otherwise("horizontal").alias("orientation"),
            F.explode(F.sequence(*[F.floor(F.col("coord") / F.col("tol")) + d for d in (-1, 1)])).alias("cell"),
        )
    )
    ends = (
        walls.select(
            "plan_id", "orientation", F.col("cfg.junction").alias("j"), F.explode(F.array("s", "e")).alias("value")
        )
        .groupBy("plan_id", "orientation", "value")
        .agg(F.max("j").alias("j"))
        .withColumn("cell", F.floor(F.col("value") / F.col("j")))
    )
    dist = F.abs(F.col("coord") - F.col("value"))
    mapping = (
        ends.join(axes, ["plan_id", "orientation", "cell"])
        .filter(dist <= F.col("tol"))
        .groupBy("plan_id", "orientation", "value")
        .agg(F.min_by("coord", F.struct(dist.alias("d"), F.col("first_ord"))).alias("snapped"))
    )
    out = _replace(walls, mapping, "s", "value", "snapped")
    return _replace(out, mapping, "e", "value", "snapped")


def snap_all(walls: DataFrame) -> DataFrame:
    """W02 and then J06 of axis rows, in one shuffle of the walls.

    The walls of a plan meet in one task. It holds a row for each distinct
    coordinate and end, and the walls stream by.
    """
    # role 0 is the wall itself, 1 a coordinate, 2 and 3 an end
    rows = walls.filter("orientation <> 'diagonal' AND plan_id IS NOT NULL").repartition("plan_id")
    told = [F.struct(F.lit(0).alias("role"), F.lit(None).cast("double").alias("value"), F.lit(None).cast("long").alias("n"), F.lit(None).cast("long").alias("ord"))]
    for role, name in ((1, "coord"), (2, "s"), (3, "e")):
        same = Window.partitionBy("plan_id", "orientation", name)
        rows = rows.withColumns({f"_first{role}": F.row_number().over(same.orderBy("ord")) == 1, f"_n{role}": F.count(F.lit(1)).over(same)})
        told.append(F.when(F.col(f"_first{role}") & F.col(name).isNotNull(), F.struct(
            F.lit(role).alias("role"), F.col(name).cast("double").alias("value"), F.col(f"_n{role}").alias("n"), F.col("ord").cast("long").alias("ord"))))
    spread = rows.select("*", F.explode(F.array_compact(F.array(*told))).alias("_t"))
    own = F.col("_t.role") == 0
    listed = spread.select(
        "plan_id", (~own).alias("_spot"), (F.col("orientation") == "horizontal").alias("_flat"), *[F.col(f"_t.{c}").alias(f"_{c}") for c in ("role", "value", "n", "ord")],
        F.col("cfg.snap").alias("_snap"), F.col("cfg.junction").alias("_junction"), *[F.when(own, F.col(c)).alias(c) for c in walls.columns if c != "plan_id"])
    out = listed.select(*walls.columns)
    return by_zone(listed, ["plan_id"], partial(_snapped, walls.columns), out.schema, stay="_spot", placed=True)


def _snapped(out: list[str], table: pa.RecordBatch, zone: np.ndarray) -> list[pa.Array]:
    """The walls among the rows, on the centers of their clusters and then on crossing lines."""
    role = table.column("_role").to_numpy()
    group = zone * 2 + table.column("_flat").to_numpy(zero_copy_only=False)
    value, n, order, snap, junction = floats(table, "_value", "_n", "_ord", "_snap", "_junction")
    rows = np.flatnonzero(role == 0)
    coord, s, e = (v[rows] for v in floats(table, "coord", "s", "e"))
    mine = group[rows]

    def centers(at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct (group, value) and the value on the nearest center."""
        at = at[np.lexsort((value[at], group[at]))]
        g, v = group[at], value[at]
        first = np.flatnonzero(np.append(True, (g[1:] != g[:-1]) | (v[1:] != v[:-1]))[: len(at)])
        if not len(first):
            return g, v, v
        count = np.add.reduceat(n[at], first)
        g, v, tol = g[first], v[first], snap[at][first]
        new = np.append(True, (g[1:] != g[:-1]) | (v[1:] - v[:-1] > tol[1:]))
        start, cluster = np.flatnonzero(new), np.cumsum(new) - 1
        center = np.add.reduceat(v * count, start) / np.add.reduceat(count, start)
        of = g[start]
        before = np.append(np.inf, np.where(of[1:] == of[:-1], center[:-1], np.inf))[cluster]
        after = np.append(np.where(of[1:] == of[:-1], center[1:], np.inf), np.inf)[cluster]
        here = center[cluster]
        low, mid, high = (np.abs(c - v) for c in (before, here, after))
        best = np.where((low <= mid) & (low <= high), before, np.where(mid <= high, here, after))
        return g, v, np.where(np.abs(best - v) <= tol, best, v)

    def ranked(g: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sorted values and the number of each (group, value) among all pairs."""
        known = np.unique(v)
        return known, g * (len(known) + 1) + np.searchsorted(known, v)

    def moved(v: np.ndarray, told: tuple[np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
        g, known, to = told
        if not len(g):
            return v
        values, key = ranked(g, known)
        found = np.searchsorted(key, mine * (len(values) + 1) + np.searchsorted(values, v))
        return np.where(np.isfinite(v), to[np.minimum(found, len(to) - 1)], v)

    lines = centers(np.flatnonzero(role == 1))
    ends = centers(np.flatnonzero(role > 1))
    coord, s, e = moved(coord, lines), moved(s, ends), moved(e, ends)

    # crossing lines by group of the walls that end there, with the first wall on each
    spots = np.flatnonzero(role == 1)
    if len(spots):
        g, known, to = lines
        values, key = ranked(g, known)
        to = to[np.searchsorted(key, group[spots] * (len(values) + 1) + np.searchsorted(values, value[spots]))]
        across, rank = group[spots] ^ 1, order[spots]
        by = np.lexsort((rank, to, across))
        across, to, rank = across[by], to[by], rank[by]
        first = np.flatnonzero(np.append(True, (across[1:] != across[:-1]) | (to[1:] != to[:-1])))
        across, to, rank = across[first], to[first], rank[first]
        values, key = ranked(across, to)

        def crossed(v: np.ndarray) -> np.ndarray:
            after = np.searchsorted(key, mine * (len(values) + 1) + np.searchsorted(values, v))
            best, dist, earlier = v, np.where(np.isfinite(v), junction[rows], -1.0), np.full(len(v), np.inf)
            for at in (after - 1, after):
                safe = np.clip(at, 0, len(to) - 1)
                far = np.abs(to[safe] - v)
                better = (at == safe) & (across[safe] == mine) & ((far < dist) | ((far == dist) & (rank[safe] < earlier)))
                best, dist, earlier = np.where(better, to[safe], best), np.where(better, far, dist), np.where(better, rank[safe], earlier)
            return best

        s, e = crossed(s), crossed(e)
    at = pa.array(rows)
    new = {"coord": coord, "s": s, "e": e}
    return [pa.array(new[c], mask=np.isnan(new[c])) if c in new else table.column(c).take(at) for c in out]


def merge_collinear(walls: DataFrame) -> DataFrame:
    """W03 + F04 + W17: join spans of one line across small gaps, drop short results, number the rest."""
    line = ["plan_id", "orientation", "coord"]
    starts = walls.groupBy(*line, "s").agg(
        F.max("e").alias("e"), F.sum("thickness").alias("t_sum"), F.sum("confidence").alias("c_sum"),
        F.count(F.lit(1)).alias("n"), F.min("ord").alias("first_ord"), F.any_value("cfg").alias("cfg"),
    )
    order = Window.partitionBy(*line).orderBy("s")
    islands = (
        starts.withColumn("_reach", F.max("e").over(order.rowsBetween(Window.unboundedPreceding, -1)))
        .withColumn("_new", (F.col("s") > F.col("_reach") + F.col("cfg.merge_gap")).cast("int"))
        .withColumn("island", F.sum(F.coalesce("_new", F.lit(0))).over(order.rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("line_ord", F.min("first_ord").over(Window.partitionBy(*line)))
    )
    # windows over the partitions at hand; an aggregate would shuffle the lines again for their floating coordinate
    merged = close_islands(islands, [*line, "line_ord", "island"], "s", {
        "e": F.max("e"), "t_sum": F.sum("t_sum"), "c_sum": F.sum("c_sum"), "n_sources": F.sum("n"),
    }).filter(F.col("e") - F.col("s") >= F.col("cfg.min_length")).select(
        *line, "line_ord", "s", "e", (F.col("t_sum") / F.col("n_sources")).alias("thickness"),
        round_to(F.least(F.lit(0.99), F.col("c_sum") / F.col("n_sources") + 0.15), 4).alias("confidence"), "n_sources", "cfg")
    return number_rows(merged, ["plan_id"], ["line_ord", "orientation", "coord"], ["s"], "ord").select(
        "plan_id", F.format_string("wall-%04d", "ord").alias("wall_id"), "ord", "orientation", "coord", "s", "e",
        "thickness", "confidence", F.lit(False).alias("is_exterior"), F.lit(None).cast("string").alias("side"),
        "n_sources", "cfg",
    )


# -- classify and filter -----------------------------------------------------


def classify_exterior(walls: DataFrame, junction_counts: DataFrame, again: Column | None = None) -> DataFrame:
    """Walls on the bounding box with enough coverage become exterior; raise the confidence.

    ``again`` restricts the confidence boost (not the classification) to plans
    whose wall set changed since the last pass. ``junction_counts`` come by wall
    (plan_id, ord) or by line.
    """
    by = ["plan_id", "ord"] if "ord" in junction_counts.columns else LINE
    horizontal = F.col("orientation") == "horizontal"
    vertical = F.col("orientation") == "vertical"
    box = walls.groupBy("plan_id").agg(
        F.min(F.when(horizontal, F.col("s")).otherwise(F.col("coord"))).alias("min_x"),
        F.max(F.when(horizontal, F.col("e")).otherwise(F.col("coord"))).alias("max_x"),
        F.min(F.when(horizontal, F.col("coord")).otherwise(F.col("s"))).alias("min_y"),
        F.max(F.when(horizontal, F.col("coord")).otherwise(F.col("e"))).alias("max_y"),
    )
    length = F.col("e") - F.col("s")
    extent = F.when(horizontal, F.col("max_x") - F.col("min_x")).otherwise(F.col("max_y") - F.col("min_y"))
    ref = F.when(extent > EPS, extent).otherwise(F.lit(1.0))
    covers = (length / ref >= F.col("cfg.exterior_coverage")) | (length >= ref - F.col("cfg.snap"))
    near_low = F.abs(F.col("coord") - F.when(horizontal, F.col("min_y")).otherwise(F.col("min_x"))) <= F.col("cfg.snap")
    near_high = F.abs(F.col("coord") - F.when(horizontal, F.col("max_y")).otherwise(F.col("max_x"))) <= F.col("cfg.snap")
    side = F.when(
        near_low, F.when(covers, F.when(horizontal, "bottom").otherwise("left"))
    ).when(near_high, F.when(covers, F.when(horizontal, "top").otherwise("right")))
    out = (
        walls.drop("side", "is_exterior", "n_junctions")
        .join(box, "plan_id")
        .join(junction_counts.select(*by, "n_junctions"), by, "left")
        .withColumn("side", F.when(horizontal | vertical, side))
        .withColumn("is_exterior", F.col("side").isNotNull())
        .withColumn("n_junctions", F.coalesce("n_junctions", F.lit(0)))
    )
    first = F.when(F.col("is_exterior"), F.least(F.lit(MAX_CONFIDENCE), F.col("confidence") + 0.05)).otherwise(F.col("confidence"))
    boosted = F.when(F.col("n_junctions") >= 2, F.least(F.lit(MAX_CONFIDENCE), first + 0.03)).otherwise(first)
    boosted = round_to(boosted, 4)
    if again is not None:
        boosted = F.when(again, boosted).otherwise(F.col("confidence"))
    return out.withColumn("confidence", boosted).drop("min_x", "max_x", "min_y", "max_y")


def mark_text_artifacts(walls: DataFrame) -> DataFrame:
    """``drop`` is true for short, thin, compact, unconnected walls."""
    length = F.col("e") - F.col("s")
    supported = (F.col("n_junctions") > 0) | F.col("is_exterior")
    text_like = (
        ~supported
        & (length < F.col("cfg.text_length"))
        & (F.col("thickness") < F.col("cfg.text_thickness"))
        & (length / F.greatest("thickness", F.lit(EPS)) < 3.0)
    )
    return walls.withColumn("drop", text_like)


def mark_isolated_noise(walls: DataFrame) -> DataFrame:
    """``drop`` is true for stubby or short walls without any connection."""
    length = F.col("e") - F.col("s")
    supported = (F.col("n_junctions") > 0) | F.col("is_exterior")
    stubby = (length > 0) & (F.col("thickness") / length > 0.55) & (length < F.col("cfg.min_length") * 2)
    short = length < F.greatest(F.col("cfg.min_length") * 1.5, F.col("thickness") * 2.0)
    return walls.withColumn("drop", ~supported & (F.coalesce(stubby, F.lit(False)) | short))
