"""Quality metrics, the structural gate and benchmark thresholds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plansift.functions.numeric import round_to

# fixed values: gate limits and messages
SNAP = 4.0
MIN_EXTERIOR = 2
MIN_SIDE = 0.6
MIN_SIDES = 3
MIN_AVERAGE = 0.7
MESSAGES = {
    "no_walls_detected": "Quality gate: no walls detected.",
    "no_openings_detected": "Quality gate: no openings detected.",
    "anomalous_exterior_wall_count": "Quality gate: exterior wall count is too low.",
    "footprint_not_reasonably_closed": "Quality gate: exterior shell does not close reasonably.",
}
# fixed values: benchmark limits
THRESHOLDS = {
    "min_wall_count": 4,
    "min_exterior_wall_count": 3,
    "max_review_flags": 5,
    "min_junction_count": 3,
    "min_wall_iou": 0.85,
    "min_exterior_shell_recall": 0.70,
    "min_junction_precision": 0.50,
    "min_junction_recall": 0.50,
}


def structure_metrics(plans: DataFrame, walls: DataFrame, openings: DataFrame) -> DataFrame:
    """Wall and opening counts of every plan, zero where nothing was found."""
    w = walls.groupBy("plan_id").agg(
        F.count(F.lit(1)).alias("wall_count"),
        F.count_if("is_exterior").alias("exterior_wall_count"),
    )
    o = openings.groupBy("plan_id").agg(
        F.count_if(F.col("status") == "anchored").alias("opening_count"),
        F.count_if((F.col("status") == "anchored") & (F.col("kind") == "door")).alias("door_count"),
        F.count_if((F.col("status") == "anchored") & (F.col("kind") == "window")).alias("window_count"),
        F.count_if(F.col("status") != "anchored").alias("filtered_opening_count"),
    )
    counts = ["wall_count", "exterior_wall_count", "opening_count", "door_count", "window_count", "filtered_opening_count"]
    return (
        plans.select("plan_id").join(w, "plan_id", "left").join(o, "plan_id", "left").fillna(0, counts)
        .withColumn("interior_wall_count", F.col("wall_count") - F.col("exterior_wall_count"))
    )


def shell_coverage(walls: DataFrame) -> DataFrame:
    """How much of each bounding-box side its longest wall covers."""
    flat = F.col("orientation") == "horizontal"
    box = walls.groupBy("plan_id").agg(
        F.min(F.when(flat, F.col("s")).otherwise(F.col("coord"))).alias("min_x"),
        F.max(F.when(flat, F.col("e")).otherwise(F.col("coord"))).alias("max_x"),
        F.min(F.when(flat, F.col("coord")).otherwise(F.col("s"))).alias("min_y"),
        F.max(F.when(flat, F.col("coord")).otherwise(F.col("e"))).alias("max_y"),
    )
    share = (F.col("e") - F.col("s")) / F.when(
        flat, F.greatest(F.col("max_x") - F.col("min_x"), F.lit(1.0))
    ).otherwise(F.greatest(F.col("max_y") - F.col("min_y"), F.lit(1.0)))

    def side(is_flat: Column, bound: str) -> Column:
        on = is_flat & (F.abs(F.col("coord") - F.col(bound)) <= SNAP)
        return F.coalesce(F.max(F.when(on, share)), F.lit(0.0))

    sides = ["top", "bottom", "left", "right"]
    per_side = walls.join(box, "plan_id").groupBy("plan_id").agg(
        side(flat, "max_y").alias("top"), side(flat, "min_y").alias("bottom"),
        side(~flat, "min_x").alias("left"), side(~flat, "max_x").alias("right"),
    )
    covered = sum((F.col(s) >= MIN_SIDE).cast("int") for s in sides)
    return per_side.select(
        "plan_id", covered.alias("bbox_sides_covered"),
        round_to(F.least(*sides), 4).alias("bbox_min_side_coverage"),
        round_to(sum(F.col(s) for s in sides) / 4, 4).alias("bbox_avg_side_coverage"),
    )


def detection_disabled(mode: Column, flag: Column) -> Column:
    """Opening detection is off when either source says so."""
    return F.coalesce(mode == "disabled", F.lit(False)) | F.coalesce(flag, F.lit(False))


def compact(*items: Column) -> Column:
    return F.array_compact(F.array(*items))


def quality_gate(metrics: DataFrame) -> DataFrame:
    """Reasons, pass flag and messages (each appended once, U04)."""
    reasons = compact(
        F.when(F.col("wall_count") == 0, "no_walls_detected"),
        F.when((F.col("opening_count") == 0) & ~F.col("detection_disabled"), "no_openings_detected"),
        F.when(F.col("exterior_wall_count") < MIN_EXTERIOR, "anomalous_exterior_wall_count"),
        F.when(
            (F.coalesce("bbox_sides_covered", F.lit(0)) < MIN_SIDES)
            | (F.coalesce("bbox_avg_side_coverage", F.lit(0.0)) < MIN_AVERAGE),
            "footprint_not_reasonably_closed",
        ),
    )
    table = F.create_map(*[F.lit(x) for kv in MESSAGES.items() for x in kv])
    return (
        metrics.withColumn("gate_reasons", reasons)
        .withColumn("gate_passed", F.size("gate_reasons") == 0)
        .withColumn("gate_reason_count", F.size("gate_reasons"))
        .withColumn("review_flags", F.array_union("review_flags", F.transform("gate_reasons", lambda r: table[r])))
    )


def annotation_override(gated: DataFrame, annotations: DataFrame) -> DataFrame:
    """Counts from reviewed annotations replace the detected ones and lift the no-openings reason."""
    counts = annotations.filter("type IN ('door', 'window')").groupBy("plan_id").agg(
        F.count(F.lit(1)).alias("n_ann"), F.count_if(F.col("type") == "door").alias("n_door"),
        F.count_if(F.col("type") == "window").alias("n_window"),
    )
    has = F.coalesce("n_ann", F.lit(0)) > 0
    reasons = F.when(has, F.array_remove("gate_reasons", "no_openings_detected")).otherwise(F.col("gate_reasons"))
    flags = F.when(has, F.array_remove("review_flags", MESSAGES["no_openings_detected"])).otherwise(F.col("review_flags"))
    return gated.join(counts, "plan_id", "left").withColumns(
        {
            "opening_count": F.when(has, F.col("n_ann")).otherwise(F.col("opening_count")),
            "door_count": F.when(has, F.col("n_door")).otherwise(F.col("door_count")),
            "window_count": F.when(has, F.col("n_window")).otherwise(F.col("window_count")),
            "gate_reasons": reasons, "gate_passed": F.size(reasons) == 0, "review_flags": flags,
            "needs_review": F.size(flags) > 0,
        }
    ).drop("n_ann", "n_door", "n_window")


def geometry_flags(flags: Column) -> Column:
    """drop flags that talk about openings, doors or windows."""
    return F.filter(flags, lambda f: ~F.lower(f).rlike("opening|door|window"))


def evaluate_thresholds(results: DataFrame, limits: dict[str, float] | None = None) -> DataFrame:
    """``failures`` lists every violated limit; a failed run reports only that."""
    t = {**THRESHOLDS, **(limits or {})}

    def below(value: str, limit: str, name: str) -> Column:
        return F.when(F.col(value) < t[limit], f"{name}<{t[limit]}")

    checks = compact(
        F.when(~F.coalesce("quality_gate_passed", F.lit(True)), "quality_gate_failed"),
        below("wall_count", "min_wall_count", "wall_count"),
        below("exterior_wall_count", "min_exterior_wall_count", "exterior_wall_count"),
        F.when(F.size(geometry_flags(F.col("review_flags"))) > t["max_review_flags"], f"review_flags>{t['max_review_flags']}"),
        below("junction_count", "min_junction_count", "junction_count"),
        below("wall_footprint_iou", "min_wall_iou", "wall_footprint_iou"),
        below("exterior_shell_recall", "min_exterior_shell_recall", "exterior_shell_recall"),
        below("junction_precision", "min_junction_precision", "junction_precision"),
        below("junction_recall", "min_junction_recall", "junction_recall"),
    )
    failures = F.when(~F.col("success"), F.array(F.lit("pipeline_success=false"))).otherwise(checks)
    return results.withColumn("failures", failures).withColumn("meets_thresholds", F.size("failures") == 0)


def run_summary(results: DataFrame) -> DataFrame:
    """One row with totals and rates; rates are zero for an empty run."""
    total = F.count(F.lit(1))

    def rate(c: Column) -> Column:
        return F.when(total > 0, round_to(F.count_if(c) / total, 6)).otherwise(0.0)

    ok, met = F.col("success"), F.coalesce("meets_thresholds", F.lit(False))
    return results.agg(
        total.alias("total"), F.count_if(ok).alias("passed"), F.count_if(~ok).alias("failed"), rate(ok).alias("pass_rate"),
        F.count_if(met).alias("threshold_passed"), F.count_if(~met).alias("threshold_failed"),
        rate(met).alias("threshold_pass_rate"), rate(F.col("needs_review")).alias("review_rate"),
        F.coalesce(round_to(F.avg("elapsed_ms"), 6), F.lit(0.0)).alias("avg_elapsed_ms"),
        F.count_if("normalized").alias("normalized_case_count"), F.count_if(~F.col("normalized")).alias("native_case_count"),
    )


def finalize(results: DataFrame) -> DataFrame:
    """Default backend name and the review flag."""
    return results.withColumn("inference_backend", F.coalesce("backend", "source", F.lit("unknown"))).withColumn(
        "needs_review", F.size("review_flags") > 0
    )


def with_fallback(primary: DataFrame, fallback: DataFrame, minimum: int = 8) -> DataFrame:
    """plans whose primary result has fewer than ``minimum`` walls take the fallback walls."""
    enough = primary.groupBy("plan_id").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= minimum).select("plan_id")
    kept = primary.join(enough, "plan_id", "left_semi").withColumn("origin", F.lit("primary"))
    other = fallback.join(enough, "plan_id", "left_anti").withColumn("origin", F.lit("fallback"))
    return kept.unionByName(other)
