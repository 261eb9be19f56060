"""The parse flow: raw walls and openings of many plans -> clean structure and quality gate, in one job chain."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plansift.operators import config, gates, junctions, openings, walls
from plansift.session import cut_lineage


@dataclass
class Structures:
    walls: DataFrame
    openings: DataFrame
    junctions: DataFrame
    removed: DataFrame


def _classify(rows: DataFrame, removed: DataFrame | None = None) -> DataFrame:
    """Rebuild the junction counts and classify; after a removal only the plans that lost walls get the boost again."""
    counts = junctions.count_connections(rows, distinct=True)
    if removed is None:
        return walls.classify_exterior(rows, counts)
    marked = rows.join(removed.select("plan_id", F.lit(True).alias("_again")), "plan_id", "left")
    return walls.classify_exterior(marked, counts, F.coalesce("_again", F.lit(False))).drop("_again")


def _drop(marked: DataFrame) -> tuple[DataFrame, DataFrame]:
    removed = marked.groupBy("plan_id").agg(F.count_if("drop").alias("n")).filter("n > 0")
    return marked.filter("NOT drop").drop("drop"), removed


def clean_walls(raw: DataFrame, plans: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Normalise, snap, merge, classify and filter; returns walls and removals per plan and filter.

    Merging and the later steps read their input several times, so each stage is
    written once to the checkpoint folder instead of being recomputed.
    """
    usable = walls.normalize_walls(raw).filter("error IS NULL").drop("error")
    axis = config.with_adaptive_config(walls.to_axis(usable), plans).select(
        "plan_id", "wall_id", "ord", "orientation", "coord", "s", "e", "thickness", "confidence", "cfg")
    snapped = cut_lineage(walls.snap_all(axis))
    merged = cut_lineage(walls.merge_collinear(snapped))
    marked = cut_lineage(walls.mark_text_artifacts(_classify(merged)))
    kept, text = _drop(marked)
    marked = cut_lineage(walls.mark_isolated_noise(_classify(kept, text)))
    kept, noise = _drop(marked)
    final = cut_lineage(_classify(kept, noise))
    removed = text.withColumn("filter", F.lit("text")).unionByName(noise.withColumn("filter", F.lit("noise")))
    return final, removed


#: Columns that raw openings may leave out.
OPTIONAL = {"wall_id": "string", "offset": "double", "side": "string", "swing": "string", "door_type": "string", "type": "string"}


def _dropped(before: DataFrame, after: DataFrame, name: str) -> DataFrame:
    """Rows per plan that a filter took."""
    counts = before.groupBy("plan_id").agg(F.count(F.lit(1)).alias("b")).join(
        after.groupBy("plan_id").agg(F.count(F.lit(1)).alias("a")), "plan_id", "left")
    gone = F.col("b") - F.coalesce("a", F.lit(0))
    return counts.select("plan_id", gone.alias("n"), F.lit(name).alias("filter")).filter("n > 0")


def _numbered(raw: DataFrame) -> DataFrame:
    """Openings with ``ord``; without one they count by id, so that no order depends on how the rows lie."""
    return raw if "ord" in raw.columns else raw.withColumn("ord", F.col("opening_id"))


def _on_walls(rows: DataFrame, lines: DataFrame) -> DataFrame:
    """Openings of known walls with ``along``: their middle on the axis of the wall, from the offset where there is no position."""
    line = lines.select("plan_id", "wall_id", F.struct("orientation", "s").alias("line"))
    middle = F.coalesce(
        F.when(F.col("line.orientation") == "horizontal", F.col("x")).otherwise(F.col("y")), F.col("line.s") + F.col("offset") + F.col("span") / 2)
    return rows.join(line, ["plan_id", "wall_id"]).withColumn("along", middle).drop("line")


def clean_openings(raw: DataFrame, final: DataFrame, plans: DataFrame) -> tuple[DataFrame, DataFrame]:
    """P03, F03, then W07 and W08 for openings that name a known wall; openings before anchoring, and removals per filter.

    Openings that name no wall, or one that does not exist, are not compared with others.
    """
    full = _numbered(raw)
    for name, kind in OPTIONAL.items():
        if name not in full.columns:
            full = full.withColumn(name, F.lit(None).cast(kind))
    usable = openings.normalize_openings(full).filter("error IS NULL").drop("error")
    # every later step reads these rows several times
    near = cut_lineage(openings.drop_furniture(config.with_adaptive_config(usable, plans), final))
    named = _on_walls(near, final)
    free = near.join(final.select("plan_id", "wall_id"), ["plan_id", "wall_id"], "left_anti")
    kept = openings.dedupe_on_wall(named).select("plan_id", "wall_id", "kind", "ord")
    single = cut_lineage(named.join(kept, ["plan_id", "wall_id", "kind", "ord"], "left_semi").drop("along"))
    limited = openings.limit_exterior_windows(single, final)
    removed = (
        _dropped(raw, usable, "opening_invalid").unionByName(_dropped(usable, near, "furniture"))
        .unionByName(_dropped(named, single, "opening_duplicate")).unionByName(_dropped(single, limited, "window_limit")))
    return cut_lineage(free.unionByName(limited)), removed


def clean(raw_walls: DataFrame, raw_openings: DataFrame, plans: DataFrame) -> Structures:
    """All stages for all plans. Openings keep the wall and offset they name; the rest find theirs when anchored."""
    final, removed = clean_walls(raw_walls, plans)
    rows, gone = clean_openings(raw_openings, final, plans)
    return Structures(final, openings.anchor(rows, final, distinct=True), junctions.junctions(final), removed.unionByName(gone))


def gate(result: Structures, plans: DataFrame) -> DataFrame:
    """Metrics, shell coverage and gate reasons of every plan."""
    metrics = gates.structure_metrics(plans, result.walls, result.openings)
    rows = metrics.join(gates.shell_coverage(result.walls), "plan_id", "left").join(
        junctions.junction_summary(result.junctions), "plan_id", "left"
    ).withColumn("detection_disabled", F.lit(False)).withColumn("review_flags", F.array().cast("array<string>"))
    return gates.quality_gate(rows.fillna(0, ["junction_count", "junction_L", "junction_T", "junction_X", "bbox_sides_covered"]))
