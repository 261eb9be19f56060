"""End-to-end flows."""

from pyspark.sql import functions as F

from plansift import views as V
from plansift.catalog.cleaning import SQL_CFG, SQL_P02, sql_axes, sql_classify, sql_junctions, sql_merge, sql_snap
from plansift.catalog.datasets import AUDIT, DROP, SPLIT
from plansift.catalog.openings import ANCHOR_STEPS, sql_best
from plansift.catalog.registry import query, rnd
from plansift.operators import walls as W
from plansift.plans import clean, curate

CARRY = "snap junction merge_gap min_length text_length text_thickness"
CLEAN = SQL_CFG + "," + SQL_P02 + f""",
n0 AS (SELECT n.plan_id, wall_id, ord, orientation, CASE orientation WHEN 'horizontal' THEN y1 ELSE x1 END AS coord, CASE orientation WHEN 'horizontal' THEN x1 ELSE y1 END AS s,
 CASE orientation WHEN 'horizontal' THEN x2 ELSE y2 END AS e, thickness, confidence, {', '.join(CARRY.split())} FROM normal n JOIN cfg ON cfg.plan_id = n.plan_id),""" + ",".join([
    sql_snap("n0", "n1", "snap"), sql_axes("n1", "n2", "junction"), sql_merge("n2", "n3", "merge_gap", "min_length", CARRY),
    sql_junctions("n3", "k3", "junction", "snap"), sql_classify("n3", "k3_c", "n4", "snap"),
]) + """,
t4 AS (SELECT *, NOT (n_junctions > 0 OR is_exterior) AND e - s < text_length AND thickness < text_thickness AND (e - s) / greatest(thickness, 1e-6) < 3 AS bad FROM n4),
r4 AS (SELECT DISTINCT plan_id FROM t4 WHERE bad), n5 AS (SELECT * EXCLUDE (bad, n_junctions, side, is_exterior) FROM t4 WHERE NOT bad),""" + ",".join([
    sql_junctions("n5", "k5", "junction", "snap"), sql_classify("n5", "k5_c", "n6", "snap", again="plan_id IN (SELECT plan_id FROM r4)"),
]) + """,
t6 AS (SELECT *, NOT (n_junctions > 0 OR is_exterior) AND ((e - s > 0 AND thickness / (e - s) > 0.55 AND e - s < min_length * 2) OR e - s < greatest(min_length * 1.5, thickness * 2)) AS bad FROM n6),
r6 AS (SELECT DISTINCT plan_id FROM t6 WHERE bad), n7 AS (SELECT * EXCLUDE (bad, n_junctions, side, is_exterior) FROM t6 WHERE NOT bad),""" + ",".join([
    sql_junctions("n7", "k7", "junction", "snap"), sql_classify("n7", "k7_c", "fw", "snap", again="plan_id IN (SELECT plan_id FROM r6)"),
])


def raw(spark, sf):
    return W.parse_points(V.raw_walls(spark, sf))


@query("clean_walls_flow", "raw_xy plans", CLEAN + " SELECT plan_id, wall_id, orientation, " + rnd("coord", 6) + " AS coord, " + rnd("s", 6) + " AS s, " + rnd("e", 6) + " AS e, "
       + rnd("thickness", 6) + " AS thickness, confidence, side, is_exterior, n_junctions FROM fw")
def _(spark, sf):
    out, _ = clean.clean_walls(raw(spark, sf), V.plans(spark, sf))
    return out.select("plan_id", "wall_id", "orientation", *[W.round_to(c, 6).alias(c) for c in ("coord", "s", "e", "thickness")], "confidence", "side", "is_exterior", "n_junctions")


# every third opening names a wall by its number, whether it exists or not
NAMED = "CASE WHEN k % 3 = 0 THEN {} END"


def named_openings(spark, sf):
    return V.openings(spark, sf).withColumn("wall_id", F.expr(NAMED.format("format_string('wall-%04d', 1 + k % 12)")))


CLASH = "least(k.along + k.span / 2, x[1].along + x[1].span / 2) - greatest(k.along - k.span / 2, x[1].along - x[1].span / 2) > least(k.span, x[1].span) * 0.5"
NEAR = f""",
oq AS (SELECT o.*, {NAMED.format("printf('wall-%04d', 1 + k % 12)")} AS wall_id, snap FROM openings o JOIN cfg ON cfg.plan_id = o.plan_id WHERE span > 200 OR EXISTS (SELECT 1 FROM fw w
 WHERE w.plan_id = o.plan_id AND CASE w.orientation WHEN 'horizontal' THEN abs(o.y - w.coord) <= snap * 3 AND o.x - span / 2 <= w.e + snap AND o.x + span / 2 >= w.s - snap
 ELSE abs(o.x - w.coord) <= snap * 3 AND o.y - span / 2 <= w.e + snap AND o.y + span / 2 >= w.s - snap END)),
nm AS (SELECT oq.*, CASE w.orientation WHEN 'horizontal' THEN oq.x ELSE oq.y END AS along, w.is_exterior AS outer_, {{'wall_id': w.wall_id, 'o': w.orientation, 'coord': w.coord, 's': w.s, 'e': w.e, 'dist': 0.0::DOUBLE}} AS line
 FROM oq JOIN fw w ON w.plan_id = oq.plan_id AND w.wall_id = oq.wall_id),
nl AS (SELECT plan_id, wall_id, kind, list([{{'along': along, 'ord': ord, 'span': span}}] ORDER BY along, ord) AS items FROM nm GROUP BY ALL),
nk AS (SELECT plan_id, wall_id, kind, unnest(list_reduce(items, lambda acc, x: CASE WHEN len(list_filter(acc, lambda k: {CLASH})) = 0 THEN list_concat(acc, x)
   WHEN x[1].span > list_filter(acc, lambda k: {CLASH})[1].span THEN list_concat(list_filter(acc, lambda m: m.ord <> list_filter(acc, lambda k: {CLASH})[1].ord), x) ELSE acc END)).ord AS ord FROM nl),
ns AS (SELECT *, row_number() OVER (PARTITION BY plan_id, wall_id, kind ORDER BY span DESC, ord) AS rn FROM nm SEMI JOIN nk USING (plan_id, wall_id, kind, ord)),
nw AS (SELECT * FROM ns WHERE kind <> 'window' OR NOT outer_ OR rn <= 3),
op AS (SELECT * FROM oq ANTI JOIN nm USING (plan_id, opening_id) UNION ALL SELECT * EXCLUDE (along, outer_, line, rn) FROM nw),"""
PARSE = CLEAN + NEAR + sql_best("op", "fw", "b1", tol="o.snap") + "," + sql_best("op", "fw", "b2", "NULL", "o.snap") + """,
b0 AS (SELECT plan_id, opening_id, line FROM nw UNION ALL SELECT plan_id, opening_id, line FROM b1 ANTI JOIN nw USING (plan_id, opening_id))""" + (
    ANCHOR_STEPS.replace(">= -4", ">= -snap").replace("+ 4 ", "+ snap ").replace("FROM openings o", "FROM op o").replace("b1.line", "b0.line").replace("LEFT JOIN b1 ", "LEFT JOIN b0 ")
    .replace("line.wall_id AS wall_id, span", "line.wall_id AS placed, span"))
GATE = PARSE + f""",
bx AS (SELECT plan_id, min(CASE orientation WHEN 'horizontal' THEN s ELSE coord END) AS min_x, max(CASE orientation WHEN 'horizontal' THEN e ELSE coord END) AS max_x,
 min(CASE orientation WHEN 'horizontal' THEN coord ELSE s END) AS min_y, max(CASE orientation WHEN 'horizontal' THEN coord ELSE e END) AS max_y FROM fw GROUP BY plan_id),
sd AS (SELECT plan_id, coalesce(max((e - s) / greatest(max_x - min_x, 1)) FILTER (orientation = 'horizontal' AND abs(coord - max_y) <= 4), 0) AS top,
 coalesce(max((e - s) / greatest(max_x - min_x, 1)) FILTER (orientation = 'horizontal' AND abs(coord - min_y) <= 4), 0) AS bottom,
 coalesce(max((e - s) / greatest(max_y - min_y, 1)) FILTER (orientation = 'vertical' AND abs(coord - min_x) <= 4), 0) AS lft,
 coalesce(max((e - s) / greatest(max_y - min_y, 1)) FILTER (orientation = 'vertical' AND abs(coord - max_x) <= 4), 0) AS rgt FROM fw JOIN bx USING (plan_id) GROUP BY plan_id),
m AS (SELECT p.plan_id, coalesce(n, 0) AS wall_count, coalesce(x, 0) AS exterior_wall_count, coalesce(a, 0) AS opening_count, coalesce(f, 0) AS filtered_opening_count, coalesce(j, 0) AS junction_count,
 coalesce((top >= 0.6::DOUBLE)::INT + (bottom >= 0.6::DOUBLE)::INT + (lft >= 0.6::DOUBLE)::INT + (rgt >= 0.6::DOUBLE)::INT, 0) AS sides, coalesce({rnd('(top + bottom + lft + rgt) / 4', 4)}, 0) AS cov FROM plans p
 LEFT JOIN (SELECT plan_id, count(*) AS n, count(*) FILTER (is_exterior) AS x FROM fw GROUP BY plan_id) w ON w.plan_id = p.plan_id
 LEFT JOIN (SELECT plan_id, count(*) FILTER (status = 'anchored') AS a, count(*) FILTER (status <> 'anchored') AS f FROM anchored GROUP BY plan_id) o ON o.plan_id = p.plan_id
 LEFT JOIN (SELECT plan_id, count(*) AS j FROM k7 GROUP BY plan_id) k ON k.plan_id = p.plan_id LEFT JOIN sd ON sd.plan_id = p.plan_id)
SELECT plan_id, wall_count, exterior_wall_count, opening_count, filtered_opening_count, junction_count, sides AS bbox_sides_covered,
 array_to_string(list_filter([CASE WHEN wall_count = 0 THEN 'no_walls_detected' END, CASE WHEN opening_count = 0 THEN 'no_openings_detected' END, CASE WHEN exterior_wall_count < 2 THEN 'anomalous_exterior_wall_count' END,
 CASE WHEN sides < 3 OR cov < 0.7 THEN 'footprint_not_reasonably_closed' END], lambda r: r IS NOT NULL), ',') AS gate_reasons FROM m"""


@query("parse_structure_flow", "raw_xy plans openings", GATE)
def _(spark, sf):
    plans = V.plans(spark, sf)
    out = clean.gate(clean.clean(raw(spark, sf), named_openings(spark, sf), plans), plans)
    return out.select("plan_id", "wall_count", "exterior_wall_count", "opening_count", "filtered_opening_count", "junction_count", "bbox_sides_covered",
                      F.array_join("gate_reasons", ",").alias("gate_reasons"))


@query("curated_splits_flow", "manifest audit_input", AUDIT + f", kept AS (SELECT m.* FROM manifest m JOIN audit a USING (sample_id) WHERE NOT {DROP})," + SPLIT.format(src="kept") + """ SELECT dataset, sample_id, "rank", split FROM splits""")
def _(spark, sf):
    return curate.curated_splits(V.manifest(spark, sf), V.audit_input(spark, sf)).select("dataset", "sample_id", "rank", "split")
