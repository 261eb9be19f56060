"""Gate and threshold queries."""

from pyspark.sql import functions as F

from plansift import views as V
from plansift.catalog.cleaning import base
from plansift.catalog.openings import ANCHOR, anchored, final_walls
from plansift.catalog.registry import query, rnd
from plansift.operators import gates as G, junctions as J


@query("a02_structure_metrics", "walls openings plans", ANCHOR.rstrip() + """,
wm AS (SELECT plan_id, count(*) AS wall_count, count(*) FILTER (is_exterior) AS exterior_wall_count FROM fw GROUP BY plan_id),
om AS (SELECT plan_id, count(*) FILTER (status = 'anchored') AS opening_count, count(*) FILTER (status = 'anchored' AND kind = 'door') AS door_count,
 count(*) FILTER (status = 'anchored' AND kind = 'window') AS window_count, count(*) FILTER (status <> 'anchored') AS filtered_opening_count FROM anchored GROUP BY plan_id)
SELECT plan_id, coalesce(wall_count, 0) AS wall_count, coalesce(exterior_wall_count, 0) AS exterior_wall_count, coalesce(opening_count, 0) AS opening_count,
 coalesce(door_count, 0) AS door_count, coalesce(window_count, 0) AS window_count, coalesce(filtered_opening_count, 0) AS filtered_opening_count,
 coalesce(wall_count, 0) - coalesce(exterior_wall_count, 0) AS interior_wall_count FROM plans LEFT JOIN wm USING (plan_id) LEFT JOIN om USING (plan_id)""")
def _(spark, sf):
    walls = final_walls(spark, sf)
    return G.structure_metrics(V.plans(spark, sf), walls, anchored(spark, sf, walls))


SHELL = f"""
bx AS (SELECT plan_id, min(CASE orientation WHEN 'horizontal' THEN s ELSE coord END) AS min_x, max(CASE orientation WHEN 'horizontal' THEN e ELSE coord END) AS max_x,
 min(CASE orientation WHEN 'horizontal' THEN coord ELSE s END) AS min_y, max(CASE orientation WHEN 'horizontal' THEN coord ELSE e END) AS max_y FROM walls GROUP BY plan_id),
sd AS (SELECT plan_id, coalesce(max((e - s) / greatest(max_x - min_x, 1)) FILTER (orientation = 'horizontal' AND abs(coord - max_y) <= 4), 0) AS top,
 coalesce(max((e - s) / greatest(max_x - min_x, 1)) FILTER (orientation = 'horizontal' AND abs(coord - min_y) <= 4), 0) AS bottom,
 coalesce(max((e - s) / greatest(max_y - min_y, 1)) FILTER (orientation = 'vertical' AND abs(coord - min_x) <= 4), 0) AS lft,
 coalesce(max((e - s) / greatest(max_y - min_y, 1)) FILTER (orientation = 'vertical' AND abs(coord - max_x) <= 4), 0) AS rgt
 FROM walls JOIN bx USING (plan_id) GROUP BY plan_id),
shell AS (SELECT plan_id, (top >= 0.6::DOUBLE)::INT + (bottom >= 0.6::DOUBLE)::INT + (lft >= 0.6::DOUBLE)::INT + (rgt >= 0.6::DOUBLE)::INT AS bbox_sides_covered,
 {rnd('least(top, bottom, lft, rgt)', 4)} AS bbox_min_side_coverage, {rnd('(top + bottom + lft + rgt) / 4', 4)} AS bbox_avg_side_coverage FROM sd)"""


@query("a03_shell_coverage", "walls", SHELL + " SELECT * FROM shell")
def _(spark, sf):
    return G.shell_coverage(V.walls(spark, sf))


# raw counts stand in for the cleaned ones: exterior = walls flagged by order key
GATE = SHELL + """,
m AS (SELECT p.plan_id, coalesce(wall_count, 0) AS wall_count, coalesce(ext, 0) AS exterior_wall_count, coalesce(oc, 0) AS opening_count,
 unit = 'pixel' OR p.plan_id % 3 = 0 AS detection_disabled, coalesce(bbox_sides_covered, 0) AS sides, coalesce(bbox_avg_side_coverage, 0) AS cov,
 coalesce(dc, 0) AS dc FROM plans p
 LEFT JOIN (SELECT plan_id, count(*) AS wall_count, count(*) FILTER (k % 8 = 0) AS ext FROM walls GROUP BY plan_id) w ON w.plan_id = p.plan_id
 LEFT JOIN (SELECT plan_id, count(*) AS oc, count(*) FILTER (kind = 'door') AS dc FROM openings WHERE span > 26 GROUP BY plan_id) o ON o.plan_id = p.plan_id
 LEFT JOIN shell ON shell.plan_id = p.plan_id),
gate AS (SELECT *, list_filter([CASE WHEN wall_count = 0 THEN 'no_walls_detected' END, CASE WHEN opening_count = 0 AND NOT detection_disabled THEN 'no_openings_detected' END,
 CASE WHEN exterior_wall_count < 2 THEN 'anomalous_exterior_wall_count' END,
 CASE WHEN sides < 3 OR cov < 0.7 THEN 'footprint_not_reasonably_closed' END], lambda x: x IS NOT NULL) AS reasons FROM m)"""
FLAG_OF = """CASE x WHEN 'no_walls_detected' THEN 'Quality gate: no walls detected.' WHEN 'no_openings_detected' THEN 'Quality gate: no openings detected.'
 WHEN 'anomalous_exterior_wall_count' THEN 'Quality gate: exterior wall count is too low.' ELSE 'Quality gate: exterior shell does not close reasonably.' END"""


def gate_input(spark, sf):
    walls = V.walls(spark, sf).groupBy("plan_id").agg(
        F.count(F.lit(1)).alias("wall_count"), F.count_if(F.col("k") % 8 == 0).alias("exterior_wall_count"))
    wide = V.openings(spark, sf).filter("span > 26")
    openings = wide.groupBy("plan_id").agg(
        F.count(F.lit(1)).alias("opening_count"), F.count_if(F.col("kind") == "door").alias("door_count"),
        F.count_if(F.col("kind") == "window").alias("window_count"))
    plans = V.plans(spark, sf).withColumn(
        "detection_disabled",
        G.detection_disabled(F.when(F.col("unit") == "pixel", "disabled"), F.col("plan_id") % 3 == 0))
    return (
        plans.join(walls, "plan_id", "left").join(openings, "plan_id", "left").join(G.shell_coverage(V.walls(spark, sf)), "plan_id", "left")
        .fillna(0, ["wall_count", "exterior_wall_count", "opening_count", "door_count", "window_count"])
        .withColumn("review_flags", F.array(F.lit("Quality gate: no openings detected.")))
    )


@query("a04_quality_gate", "walls openings plans", GATE + f""" SELECT plan_id, array_to_string(reasons, ',') AS gate_reasons, len(reasons) = 0 AS gate_passed,
 len(reasons) AS gate_reason_count, array_to_string(list_concat(['Quality gate: no openings detected.'],
 list_filter(list_transform(reasons, lambda x: {FLAG_OF}), lambda f: f <> 'Quality gate: no openings detected.')), '|') AS review_flags FROM gate""")
def _(spark, sf):
    out = G.quality_gate(gate_input(spark, sf))
    return out.select("plan_id", F.array_join("gate_reasons", ",").alias("gate_reasons"), "gate_passed", "gate_reason_count",
                      F.array_join("review_flags", "|").alias("review_flags"))


@query("a05_annotation_override", "walls openings plans", GATE + """,
ann AS (SELECT plan_id, count(*) AS n, count(*) FILTER (kind = 'door') AS nd, count(*) FILTER (kind = 'window') AS nw FROM openings WHERE k % 3 = 0 GROUP BY plan_id)
SELECT plan_id, CASE WHEN n > 0 THEN n ELSE opening_count END AS opening_count, CASE WHEN n > 0 THEN nd ELSE dc END AS door_count,
 array_to_string(CASE WHEN n > 0 THEN list_filter(reasons, lambda r: r <> 'no_openings_detected') ELSE reasons END, ',') AS gate_reasons,
 len(CASE WHEN n > 0 THEN list_filter(reasons, lambda r: r <> 'no_openings_detected') ELSE reasons END) = 0 AS gate_passed,
 CASE WHEN n > 0 THEN len(list_filter(reasons, lambda r: r <> 'no_openings_detected')) > 0 ELSE true END AS needs_review
 FROM gate LEFT JOIN ann USING (plan_id)""")
def _(spark, sf):
    ann = V.openings(spark, sf).filter("k % 3 = 0").select("plan_id", F.col("kind").alias("type"))
    out = G.annotation_override(G.quality_gate(gate_input(spark, sf)), ann)
    return out.select("plan_id", "opening_count", "door_count", F.array_join("gate_reasons", ",").alias("gate_reasons"), "gate_passed", "needs_review")


@query("p40_detection_mode", "plans", """SELECT plan_id, (unit = 'pixel' OR plan_id % 3 = 0) AS detection_disabled FROM plans""")
def _(spark, sf):
    flag = G.detection_disabled(F.when(F.col("unit") == "pixel", "disabled"), F.col("plan_id") % 3 == 0)
    return V.plans(spark, sf).select("plan_id", flag.alias("detection_disabled"))


FLAGS = ["Skipped wall #1", "Filtered Opening x", "Removed text", "door swing filled", "Quality gate", "excess WINDOW(s)", "isolated", "noise", "shell"]


def flags(spark, sf):
    return V.plans(spark, sf).withColumn(
        "review_flags", F.expr("slice(array(%s), cast(plan_id %% 4 as int) + 1, cast(plan_id %% 9 as int))" % ",".join(f"'{f}'" for f in FLAGS)))


SQL_FLAGS = "fl AS (SELECT *, list_slice([%s], plan_id %% 4 + 1, plan_id %% 4 + plan_id %% 9) AS flags FROM plans)" % ",".join(f"'{f}'" for f in FLAGS)


@query("f07_geometry_flags", "plans", SQL_FLAGS + """ SELECT plan_id, array_to_string(list_filter(flags, lambda f: NOT regexp_matches(lower(f), 'opening|door|window')), '|') AS flags FROM fl""")
def _(spark, sf):
    return flags(spark, sf).select("plan_id", F.array_join(G.geometry_flags(F.col("review_flags")), "|").alias("flags"))


@query("u04_merge_flags", "plans", SQL_FLAGS + """ SELECT plan_id, array_to_string(list_sort(list_distinct(list_concat(flags, ['shell', 'Quality gate']))), '|') AS flags FROM fl""")
def _(spark, sf):
    both = F.array_union("review_flags", F.array(F.lit("shell"), F.lit("Quality gate")))
    return flags(spark, sf).select("plan_id", F.array_join(F.array_sort(both), "|").alias("flags"))


@query("p43_finalize", "plans", SQL_FLAGS + """ SELECT plan_id, coalesce(CASE WHEN plan_id % 3 = 0 THEN 'local' END, CASE WHEN plan_id % 2 = 0 THEN unit END, 'unknown') AS inference_backend,
 len(flags) > 0 AS needs_review FROM fl""")
def _(spark, sf):
    rows = flags(spark, sf).withColumn("backend", F.when(F.col("plan_id") % 3 == 0, "local")).withColumn(
        "source", F.when(F.col("plan_id") % 2 == 0, F.col("unit")))
    return G.finalize(rows).select("plan_id", "inference_backend", "needs_review")


RESULT = SQL_FLAGS + """,
rs AS (SELECT fl.plan_id, flags, coalesce(wall_count, 0) AS wall_count, coalesce(ext, 0) AS ext, coalesce(jc, 0) AS jc, fl.plan_id % 5 <> 1 AS gate, fl.plan_id % 17 <> 0 AS success,
 CASE WHEN fl.plan_id % 6 <> 0 THEN ((37 * fl.plan_id) % 100)::DOUBLE / 100 END AS iou, ((53 * fl.plan_id) % 100)::DOUBLE / 100 AS recall,
 ((29 * fl.plan_id) % 100)::DOUBLE / 100 AS jp, ((71 * fl.plan_id) % 100)::DOUBLE / 100 AS jr, least(image_w, image_h) < 512 AS normalized,
 (fl.plan_id % 1000)::DOUBLE AS elapsed FROM fl
 LEFT JOIN (SELECT plan_id, count(*) AS wall_count, count(*) FILTER (k % 8 = 0) AS ext FROM walls GROUP BY plan_id) w ON w.plan_id = fl.plan_id
 LEFT JOIN (SELECT plan_id, count(*) AS jc FROM junctions GROUP BY plan_id) j ON j.plan_id = fl.plan_id),
ev AS (SELECT *, CASE WHEN NOT success THEN ['pipeline_success=false'] ELSE list_filter([CASE WHEN NOT gate THEN 'quality_gate_failed' END,
 CASE WHEN wall_count < 4 THEN 'wall_count<4' END, CASE WHEN ext < 3 THEN 'exterior_wall_count<3' END,
 CASE WHEN len(list_filter(flags, lambda f: NOT regexp_matches(lower(f), 'opening|door|window'))) > 5 THEN 'review_flags>5' END,
 CASE WHEN jc < 3 THEN 'junction_count<3' END, CASE WHEN iou < 0.85 THEN 'wall_footprint_iou<0.85' END,
 CASE WHEN recall < 0.7 THEN 'exterior_shell_recall<0.7' END, CASE WHEN jp < 0.5 THEN 'junction_precision<0.5' END,
 CASE WHEN jr < 0.5 THEN 'junction_recall<0.5' END], lambda x: x IS NOT NULL) END AS failures FROM rs)"""


def results(spark, sf):
    walls = V.walls(spark, sf).groupBy("plan_id").agg(
        F.count(F.lit(1)).alias("wall_count"), F.count_if(F.col("k") % 8 == 0).alias("exterior_wall_count"))
    points = J.junction_summary(J.junctions(base(spark, sf))).select("plan_id", "junction_count")

    def share(factor):
        return ((F.col("plan_id") * factor) % 100).cast("double") / 100

    rows = flags(spark, sf).join(walls, "plan_id", "left").join(points, "plan_id", "left").fillna(
        0, ["wall_count", "exterior_wall_count", "junction_count"])
    return rows.withColumns({
        "quality_gate_passed": F.col("plan_id") % 5 != 1, "success": F.col("plan_id") % 17 != 0,
        "wall_footprint_iou": F.when(F.col("plan_id") % 6 != 0, share(37)), "exterior_shell_recall": share(53),
        "junction_precision": share(29), "junction_recall": share(71),
        "normalized": F.least("image_w", "image_h") < 512, "elapsed_ms": (F.col("plan_id") % 1000).cast("double"),
        "needs_review": F.size("review_flags") > 0,
    })


@query("a07_thresholds", "plans walls junctions", RESULT + " SELECT plan_id, array_to_string(failures, ',') AS failures, len(failures) = 0 AS meets_thresholds FROM ev")
def _(spark, sf):
    out = G.evaluate_thresholds(results(spark, sf))
    return out.select("plan_id", F.array_join("failures", ",").alias("failures"), "meets_thresholds")


@query("a08_run_summary", "plans walls junctions", RESULT + f""" SELECT count(*) AS total, count(*) FILTER (success) AS passed, count(*) FILTER (NOT success) AS failed,
 {rnd('count(*) FILTER (success) / count(*)', 6)} AS pass_rate, count(*) FILTER (len(failures) = 0) AS threshold_passed, count(*) FILTER (len(failures) > 0) AS threshold_failed,
 {rnd('count(*) FILTER (len(failures) = 0) / count(*)', 6)} AS threshold_pass_rate, {rnd('count(*) FILTER (len(flags) > 0) / count(*)', 6)} AS review_rate,
 {rnd('avg(elapsed)', 6)} AS avg_elapsed_ms, count(*) FILTER (normalized) AS normalized_case_count, count(*) FILTER (NOT normalized) AS native_case_count FROM ev""")
def _(spark, sf):
    return G.run_summary(G.evaluate_thresholds(results(spark, sf)))


@query("f17_fallback", "walls truth_walls", """
n AS (SELECT plan_id FROM walls GROUP BY plan_id HAVING count(*) >= 8)
SELECT plan_id, wall_id, 'primary' AS origin FROM walls WHERE plan_id IN (SELECT plan_id FROM n)
UNION ALL SELECT plan_id, wall_id, 'fallback' FROM truth_walls WHERE plan_id NOT IN (SELECT plan_id FROM n)""")
def _(spark, sf):
    return G.with_fallback(V.walls(spark, sf), V.truth_walls(spark, sf)).select("plan_id", "wall_id", "origin")
