"""Drawing queries."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from plansift import views as V
from plansift.catalog.cleaning import base, sql_junctions
from plansift.catalog.openings import ON_WALL, on_wall
from plansift.catalog.registry import query, rnd
from plansift.functions.formats import feet_inches
from plansift.functions.numeric import round_to
from plansift.operators import drawing as D, intervals as I, junctions as J, regions as R
from plansift.sources import archives


def r6(df, *cols, n=6):
    return df.withColumns({c: round_to(c, n) for c in cols})


RECT = """
rc AS (SELECT plan_id, wall_id AS region_id, ord, orientation, CASE orientation WHEN 'horizontal' THEN s ELSE coord - thickness / 2 END AS x1, CASE orientation WHEN 'horizontal' THEN coord - thickness / 2 ELSE s END AS y1,
 CASE orientation WHEN 'horizontal' THEN e ELSE coord + thickness / 2 END AS x2, CASE orientation WHEN 'horizontal' THEN coord + thickness / 2 ELSE e END AS y2, thickness FROM (SELECT * REPLACE (thickness + k % 5 AS thickness) FROM walls))"""


def rects(spark, sf):
    flat = "orientation = 'horizontal'"
    return V.walls(spark, sf).withColumn("thickness", F.expr("thickness + k % 5")).selectExpr(
        "plan_id", "wall_id AS region_id", "ord", "orientation", "thickness",
        f"if({flat}, s, coord - thickness / 2) AS x1", f"if({flat}, coord - thickness / 2, s) AS y1",
        f"if({flat}, e, coord + thickness / 2) AS x2", f"if({flat}, coord + thickness / 2, e) AS y2")


@query("p08_rescale_geometry", "walls plans", """SELECT w.plan_id, wall_id, round(CASE orientation WHEN 'horizontal' THEN coord * sy ELSE coord * sx END, 6) AS coord,
 round(CASE orientation WHEN 'horizontal' THEN s * sx ELSE s * sy END, 6) AS s, round(thickness * ((sx + sy) / 2), 6) AS thickness
 FROM walls w JOIN (SELECT plan_id, 500.0::DOUBLE / image_w AS sx, 400.0::DOUBLE / image_h AS sy FROM plans) p ON p.plan_id = w.plan_id""")
def _(spark, sf):
    scales = V.plans(spark, sf).select("plan_id", (F.lit(500.0) / F.col("image_w")).alias("sx"), (F.lit(400.0) / F.col("image_h")).alias("sy"))
    out = D.rescale_walls(V.walls(spark, sf).join(scales, "plan_id"), F.col("sx"), F.col("sy"))
    return out.select("plan_id", "wall_id", *[F.round(c, 6).alias(c) for c in ("coord", "s", "thickness")])


@query("p09_input_profile", "plans", """
l AS (SELECT plan_id, image_w, image_h, least(image_w, image_h) < 512 AS applied, 512.0::DOUBLE / least(image_w, image_h) AS sc FROM plans),
z AS (SELECT *, CASE WHEN applied THEN greatest(1, round_even(image_w * sc, 0))::INT ELSE image_w END AS run_w, CASE WHEN applied THEN greatest(1, round_even(image_h * sc, 0))::INT ELSE image_h END AS run_h FROM l)
SELECT plan_id, applied, CASE WHEN applied THEN 'low_res_upscaled' ELSE 'native_resolution' END AS profile, run_w, run_h, round(run_w / image_w, 6) AS scale_x, round(run_h / image_h, 6) AS scale_y FROM z""")
def _(spark, sf):
    out = D.input_profile(V.plans(spark, sf))
    return out.select("plan_id", "applied", "profile", "run_w", "run_h", F.round("scale_x", 6).alias("scale_x"), F.round("scale_y", 6).alias("scale_y"))


TR = """
tr AS (SELECT plan_id, image_h AS h, CASE WHEN wide THEN 1490.0::DOUBLE / image_w ELSE 1050.0::DOUBLE / image_h END AS sc,
 CASE WHEN wide THEN 40.0::DOUBLE ELSE 40 + (1490 - image_w * (1050.0::DOUBLE / image_h)) / 2 END AS ox, CASE WHEN wide THEN 30 + (1050 - image_h * (1490.0::DOUBLE / image_w)) / 2 ELSE 30.0::DOUBLE END AS oy
 FROM (SELECT *, image_w / image_h > 1490.0::DOUBLE / 1050 AS wide FROM plans))"""


@query("p21_page_transform", "openings plans", TR + f""" SELECT o.plan_id, opening_id, {rnd('x * sc + ox', 4)} AS px, {rnd('(h - y) * sc + oy', 4)} AS py, {rnd('x', 4)} AS bx, {rnd('y', 4)} AS by_ FROM openings o JOIN tr ON tr.plan_id = o.plan_id""")
def _(spark, sf):
    rows = V.openings(spark, sf).join(V.plans(spark, sf), "plan_id").withColumn("t", R.page_transform(F.col("image_w"), F.col("image_h")))
    px, py = R.to_page(F.col("x"), F.col("y"), F.col("image_h"), F.col("t"))
    bx, by = R.to_picture(px, py, F.col("image_h"), F.col("t"))
    return rows.select("plan_id", "opening_id", *[round_to(c, 4).alias(n) for c, n in ((px, "px"), (py, "py"), (bx, "bx"), (by, "by_"))])


@query("p22_region_walls", "walls", RECT + " SELECT plan_id, region_id, orientation, CASE orientation WHEN 'horizontal' THEN (y1 + y2) / 2 ELSE (x1 + x2) / 2 END AS coord, CASE orientation WHEN 'horizontal' THEN x1 ELSE y1 END AS s, greatest(1, CASE orientation WHEN 'horizontal' THEN y2 - y1 ELSE x2 - x1 END) AS thickness FROM rc")
def _(spark, sf):
    return D.region_walls(rects(spark, sf)).drop("e")


@query("p22_region_edges", "walls", RECT + """ SELECT plan_id, region_id, 0 AS edge, x1 AS ax, y1 AS ay, x2 AS bx, y1 AS by_ FROM rc UNION ALL SELECT plan_id, region_id, 1, x2, y1, x2, y2 FROM rc
 UNION ALL SELECT plan_id, region_id, 2, x2, y2, x1, y2 FROM rc UNION ALL SELECT plan_id, region_id, 3, x1, y2, x1, y1 FROM rc""")
def _(spark, sf):
    return D.region_edges(rects(spark, sf)).withColumnRenamed("by", "by_")


@query("p23_median_thickness", "walls", RECT + """, md AS (SELECT plan_id, quantile_cont(thickness, 0.5) AS m FROM rc GROUP BY plan_id) SELECT plan_id, region_id, CASE WHEN thickness > m THEN 6 ELSE 4 END AS std_thickness FROM rc JOIN md USING (plan_id)""")
def _(spark, sf):
    return D.median_thickness(rects(spark, sf).withColumnRenamed("thickness", "draw_thickness")).select("plan_id", "region_id", "std_thickness")


@query("p24_clamp_thickness", "walls", RECT + """, th AS (SELECT *, greatest(0, CASE orientation WHEN 'horizontal' THEN y2 - y1 ELSE x2 - x1 END) AS raw FROM rc)
SELECT plan_id, region_id, raw AS raw_thickness, least(raw, 6) AS draw_thickness, raw > 6 AS clamped, CASE WHEN raw > 6 AND orientation = 'vertical' THEN (x1 + x2) / 2 - 3 ELSE x1 END AS x1,
 CASE WHEN raw > 6 AND orientation = 'horizontal' THEN (y1 + y2) / 2 + 3 ELSE y2 END AS y2 FROM th""")
def _(spark, sf):
    return R.clamp_thickness(rects(spark, sf).drop("thickness")).select("plan_id", "region_id", "raw_thickness", "draw_thickness", "clamped", "x1", "y2")


@query("p25_standard_thickness", "walls", RECT + " SELECT plan_id, region_id, CASE WHEN thickness >= 5 THEN 6.0::DOUBLE ELSE 4.0::DOUBLE END AS std, CASE WHEN thickness >= 5 THEN 'SOLID' ELSE 'ANSI31' END AS fill FROM rc")
def _(spark, sf):
    return rects(spark, sf).select("plan_id", "region_id", D.standard_thickness(F.col("thickness")).alias("std"), D.fill_style(F.col("thickness")).alias("fill"))


@query("j16_trim_rectangles", "walls", RECT + """,
h1 AS (SELECT h.plan_id, h.ord, arg_max(CASE WHEN v.x1 - 2 < h.x2 AND h.x2 < v.x2 + (v.x2 - v.x1) * 1.3 THEN v.x2 END, CASE WHEN v.x1 - 2 < h.x2 AND h.x2 < v.x2 + (v.x2 - v.x1) * 1.3 THEN v.ord END) AS nh,
 arg_max(CASE WHEN v.x1 - (v.x2 - v.x1) * 1.3 < h.x1 AND h.x1 < v.x2 + 2 THEN v.x1 END, CASE WHEN v.x1 - (v.x2 - v.x1) * 1.3 < h.x1 AND h.x1 < v.x2 + 2 THEN v.ord END) AS nl
 FROM rc h JOIN rc v ON h.plan_id = v.plan_id AND h.orientation = 'horizontal' AND v.orientation = 'vertical' AND (h.y1 + h.y2) / 2 BETWEEN v.y1 - 2 AND v.y2 + 2 AND h.x1 < v.x2 AND h.x2 > v.x1 GROUP BY ALL),
h2 AS (SELECT rc.* REPLACE (coalesce(nl, x1) AS x1, coalesce(nh, x2) AS x2) FROM rc LEFT JOIN h1 USING (plan_id, ord) WHERE orientation = 'horizontal'),
v1 AS (SELECT v.plan_id, v.ord, arg_max(CASE WHEN h.y1 - 2 < v.y2 AND v.y2 < h.y2 + (h.y2 - h.y1) * 1.3 THEN h.y2 END, CASE WHEN h.y1 - 2 < v.y2 AND v.y2 < h.y2 + (h.y2 - h.y1) * 1.3 THEN h.ord END) AS nh,
 arg_max(CASE WHEN h.y1 - (h.y2 - h.y1) * 1.3 < v.y1 AND v.y1 < h.y2 + 2 THEN h.y1 END, CASE WHEN h.y1 - (h.y2 - h.y1) * 1.3 < v.y1 AND v.y1 < h.y2 + 2 THEN h.ord END) AS nl
 FROM rc v JOIN h2 h ON h.plan_id = v.plan_id AND v.orientation = 'vertical' AND (v.x1 + v.x2) / 2 BETWEEN h.x1 - 2 AND h.x2 + 2 AND v.y1 < h.y2 AND v.y2 > h.y1 GROUP BY ALL),
v2 AS (SELECT rc.* REPLACE (coalesce(nl, y1) AS y1, coalesce(nh, y2) AS y2) FROM rc LEFT JOIN v1 USING (plan_id, ord) WHERE orientation = 'vertical')
SELECT plan_id, region_id, x1, y1, x2, y2 FROM h2 UNION ALL SELECT plan_id, region_id, x1, y1, x2, y2 FROM v2""")
def _(spark, sf):
    return R.trim_rectangles(rects(spark, sf)).select("plan_id", "region_id", "x1", "y1", "x2", "y2")


GEO = """
geo AS (SELECT w.plan_id, wall_id, orientation, coord, s, e, s AS base_start, CASE WHEN unit = 'pixel' THEN greatest(1, thickness) ELSE 4 END AS dt FROM walls w JOIN plans USING (plan_id))"""


def geometry(spark, sf):
    return D.wall_geometry(V.walls(spark, sf).join(V.plans(spark, sf).select("plan_id", "unit"), "plan_id"), F.col("unit") == "pixel")


@query("p26_render_geometry", "walls plans", GEO + " SELECT plan_id, wall_id, coord, s, e, base_start, dt AS draw_thickness FROM geo")
def _(spark, sf):
    return geometry(spark, sf).select("plan_id", "wall_id", "coord", "s", "e", "base_start", "draw_thickness")


@query("j17_extend_at_junctions", "walls plans", GEO + "," + sql_junctions("walls", "jn") + """,
mb AS (SELECT DISTINCT plan_id, h_id AS wall_id, x AS pos_ FROM jn_p UNION SELECT DISTINCT plan_id, v_id, y FROM jn_p),
ls AS (SELECT plan_id, wall_id, list_concat([{'j': 0.0::DOUBLE, 'se': false, 'ee': false}], list({'j': pos_, 'se': false, 'ee': false} ORDER BY pos_)) AS js FROM mb GROUP BY plan_id, wall_id),
g2 AS (SELECT geo.*, greatest(6, dt / 2 + 2)::DOUBLE AS tol, js FROM geo LEFT JOIN ls USING (plan_id, wall_id)),
fo AS (SELECT *, CASE WHEN js IS NULL THEN NULL ELSE list_reduce(js, lambda a, x: {'j': x.j, 'se': a.se OR abs(s - (CASE WHEN a.se THEN dt ELSE 0 END) - x.j) <= tol,
 'ee': a.ee OR (NOT abs(s - (CASE WHEN a.se THEN dt ELSE 0 END) - x.j) <= tol AND abs(e + (CASE WHEN a.ee THEN dt ELSE 0 END) - x.j) <= tol)}) END AS f FROM g2)
SELECT plan_id, wall_id, s - CASE WHEN f.se THEN dt ELSE 0 END AS s, e + CASE WHEN f.ee THEN dt ELSE 0 END AS e FROM fo""")
def _(spark, sf):
    return D.extend_at_junctions(geometry(spark, sf), J.junction_members(base(spark, sf))).select("plan_id", "wall_id", "s", "e")


# openings on their best wall, with the interval they cut
GAPS = ON_WALL + ", gp AS (SELECT plan_id, wall_id, opening_id, along - span / 2 AS g1, along + span / 2 AS g2 FROM onw)"


def gaps(spark, sf):
    rows = on_wall(spark, sf).withColumns({"offset": F.lit(None).cast("double"), "wall_o": F.col("line.orientation"), "base_start": F.col("line.s")}).drop("line")
    return D.opening_intervals(rows, None).select("plan_id", "wall_id", "opening_id", "g1", "g2")


@query("j20_openings_on_walls", "walls openings plans", GAPS + " SELECT * FROM gp")
def _(spark, sf):
    return gaps(spark, sf)


PARTS = GAPS + """,
cu AS (SELECT g.plan_id, g.wall_id, g1, g2, s, e, coalesce(lag(g2) OVER w, s) AS cur, lead(g1) OVER w IS NULL AS last_ FROM gp g JOIN walls USING (plan_id, wall_id) WINDOW w AS (PARTITION BY g.plan_id, g.wall_id ORDER BY g1, g2, opening_id)),
sp AS (SELECT plan_id, wall_id, cur AS "start", g1 AS "end" FROM cu WHERE cur < g1 UNION ALL SELECT plan_id, wall_id, g2, e FROM cu WHERE last_ AND g2 < e
 UNION ALL SELECT plan_id, wall_id, s, e FROM walls w WHERE NOT EXISTS (SELECT 1 FROM gp WHERE gp.plan_id = w.plan_id AND gp.wall_id = w.wall_id))"""


@query("w09_solid_parts", "walls openings plans", PARTS + " SELECT * FROM sp")
def _(spark, sf):
    return I.solid_parts(V.walls(spark, sf), gaps(spark, sf))


@query("p27_line_entities", "walls openings plans", PARTS + "," + GEO + """,
le AS (SELECT sp.plan_id, sp.wall_id, 'face' AS kind, "start" AS a0, coord + n * dt AS ca, "end" AS a1, coord + n * dt AS cb, orientation FROM sp JOIN geo USING (plan_id, wall_id), (VALUES (0), (1)) t(n)
 UNION ALL SELECT g.plan_id, g.wall_id, 'cap', CASE n WHEN 0 THEN g1 ELSE g2 END, coord, CASE n WHEN 0 THEN g1 ELSE g2 END, coord + dt, orientation FROM gp g JOIN geo USING (plan_id, wall_id), (VALUES (0), (1)) t(n))
SELECT plan_id, wall_id, kind, CASE orientation WHEN 'horizontal' THEN a0 ELSE ca END AS x1, CASE orientation WHEN 'horizontal' THEN ca ELSE a0 END AS y1,
 CASE orientation WHEN 'horizontal' THEN a1 ELSE cb END AS x2, CASE orientation WHEN 'horizontal' THEN cb ELSE a1 END AS y2 FROM le""")
def _(spark, sf):
    return D.line_entities(geometry(spark, sf), gaps(spark, sf))


LINES = """
ln AS (SELECT plan_id, wall_id, CASE orientation WHEN 'horizontal' THEN s ELSE coord END AS x1, CASE orientation WHEN 'horizontal' THEN coord ELSE s END AS y1,
 CASE orientation WHEN 'horizontal' THEN e ELSE coord END AS x2, CASE orientation WHEN 'horizontal' THEN coord ELSE e END AS y2 FROM walls),
bd AS (SELECT plan_id, min(least(x1, x2)) AS min_x, max(greatest(x1, x2)) AS max_x, min(least(y1, y2)) AS min_y, max(greatest(y1, y2)) AS max_y FROM ln GROUP BY plan_id)"""


def lines(spark, sf):
    from plansift.operators.walls import to_points
    return to_points(V.walls(spark, sf)).select("plan_id", "wall_id", "x1", "y1", "x2", "y2")


@query("a31_segment_bounds", "walls", LINES + " SELECT *, greatest(64, round_even(max_x - min_x + 40, 0))::INT AS width, greatest(64, round_even(max_y - min_y + 40, 0))::INT AS height FROM bd")
def _(spark, sf):
    return D.segment_bounds(lines(spark, sf))


@query("f05_bounds_filter", "walls openings", LINES + """, ob AS (SELECT plan_id, min(x) AS a, max(x) AS b, min(y) AS c, max(y) AS d FROM openings GROUP BY plan_id)
SELECT ln.* FROM ln JOIN ob USING (plan_id) WHERE x1 BETWEEN a - 24 AND b + 24 AND x2 BETWEEN a - 24 AND b + 24 AND y1 BETWEEN c - 24 AND d + 24 AND y2 BETWEEN c - 24 AND d + 24""")
def _(spark, sf):
    bounds = V.openings(spark, sf).groupBy("plan_id").agg(F.min("x").alias("min_x"), F.max("x").alias("max_x"), F.min("y").alias("min_y"), F.max("y").alias("max_y"))
    return D.bounds_filter(lines(spark, sf), bounds, 24.0)


@query("p35_fit_canvas", "openings", f"""
b AS (SELECT plan_id, min(x) AS x0, min(y) AS y0, least(240.0::DOUBLE / greatest(max(x) - min(x), 1), 240.0::DOUBLE / greatest(max(y) - min(y), 1)) AS sc FROM openings GROUP BY plan_id)
SELECT o.plan_id, opening_id, {rnd('x * sc + (8 - x0 * sc)', 4)} AS x, {rnd('y * sc + (8 - y0 * sc)', 4)} AS y FROM openings o JOIN b USING (plan_id)""")
def _(spark, sf):
    return r6(D.fit_canvas(V.openings(spark, sf).select("plan_id", "opening_id", "x", "y")), "x", "y", n=4).drop("scale")


@query("p36_box_heatmaps", "openings", """
bx AS (SELECT plan_id, opening_id AS box_id, x AS x0, x + span AS x1, y AS y0, y + 5 AS y1 FROM openings)
SELECT plan_id, box_id, channel, (CASE channel WHEN 13 THEN x0 WHEN 14 THEN x1 WHEN 17 THEN x0 WHEN 18 THEN x1 WHEN 19 THEN x0 WHEN 20 THEN x1 ELSE round_even((x0 + x1) / 2, 0) END)::BIGINT AS x,
 (CASE channel WHEN 15 THEN y0 WHEN 16 THEN y1 WHEN 17 THEN y0 WHEN 18 THEN y0 WHEN 19 THEN y1 WHEN 20 THEN y1 ELSE round_even((y0 + y1) / 2, 0) END)::BIGINT AS y
 FROM bx, (VALUES (13), (14), (15), (16), (17), (18), (19), (20)) t(channel)""")
def _(spark, sf):
    boxes = V.openings(spark, sf).selectExpr("plan_id", "opening_id AS box_id", "x AS bx0", "x + span AS bx1", "y AS by0", "y + 5 AS by1")
    return D.box_heatmaps(boxes)


@query("p37_view_box_points", "openings", """SELECT plan_id, opening_id, greatest(0, least(255, round_even((x - 10) * (256.0::DOUBLE / 300), 0)))::INT AS px, greatest(0, least(199, round_even((y - 5) * (200.0::DOUBLE / 250), 0)))::INT AS py FROM openings""")
def _(spark, sf):
    rows = V.openings(spark, sf).selectExpr("plan_id", "opening_id", "x", "y", "10D AS vb_x", "5D AS vb_y", "300D AS vb_w", "250D AS vb_h")
    return D.scale_view_box(rows, 256, 200).select("plan_id", "opening_id", "px", "py")


P38_LAYERS = ["WALL", "COLUMN", "window", "DOOR", "DOOR_FIRE", "0", "0", "NOTES"]
P38_STROKES = ["rgb(178,0,178)", "rgb(63,63,63)", "rgb(1,2,3)"]
P38_PATHS = ["M 0 0 L 9 9", "M 1 1 A 2 2 0 0 1 4 4"]


def _pick(values, index):
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index % len(values)).cast("int") + 1)


def _sql_pick(values, index):
    return f"(['{"', '".join(values)}'])[({index}) % {len(values)} + 1]"


@query("p38_classify_elements", "", f"""
el AS (SELECT doc_id AS archive, n, CASE n WHEN 0 THEN 'svg' WHEN 1 THEN 'g' WHEN 4 THEN 'circle' ELSE 'path' END AS tag,
 CASE WHEN n > 0 THEN {_sql_pick(P38_LAYERS, "n_chars")} END AS layer, n = 2 AND n_chars % 40 = 33 AS by_id,
 CASE n WHEN 2 THEN {_sql_pick(P38_STROKES, "n_chars // 8")} WHEN 3 THEN {_sql_pick(P38_STROKES, "n_chars // 24")} END AS stroke,
 n = 3 AND n_chars // 72 % 2 = 1 AS arc FROM documents, (VALUES (0), (1), (2), (3), (4)) t(n))
SELECT archive, n::BIGINT AS ordinal, CASE WHEN upper(layer) IN ('WALL', 'COLUMN') THEN 'wall'
 WHEN upper(layer) = 'WINDOW' OR (layer = '0' AND tag = 'path' AND (by_id OR stroke = 'rgb(178,0,178)')) THEN 'window'
 WHEN layer IN ('DOOR', 'DOOR_FIRE') OR (layer = '0' AND tag = 'path' AND arc AND stroke = 'rgb(63,63,63)') THEN 'door' END AS cls FROM el""")
def _(spark, sf):
    n = F.col("n_chars")
    docs = V.load(spark, sf, "documents").select(F.col("doc_id").alias("archive"), F.format_string(
        '<svg xmlns="http://www.w3.org/2000/svg" xmlns:inkscape="http://www.inkscape.org/namespaces/inkscape" viewBox="0 0 100 100">'
        '<g inkscape:label="%s"><path semantic-id="%d" stroke="%s" d="M 0 0 L 9 9"/><path stroke="%s" d="%s"/><circle cx="5" cy="6" r="2"/></g></svg>',
        _pick(P38_LAYERS, n), n % 40, _pick(P38_STROKES, F.floor(n / 8)), _pick(P38_STROKES, F.floor(n / 24)),
        _pick(P38_PATHS, F.floor(n / 72))).alias("svg"))
    rows = archives.svg_elements(docs)
    return rows.select("archive", F.col("ordinal").cast("long").alias("ordinal"), D.classify_element(*(F.col(c) for c in ("layer", "tag", "stroke", "semantic_id", "d"))).alias("cls"))


@query("p39_feet_inches", "openings", """
v AS (SELECT opening_id, plan_id, x * 1.25::DOUBLE + span / 8 AS inches FROM openings),
f AS (SELECT *, floor(inches)::BIGINT // 12 AS feet, round_even(inches - (floor(inches)::BIGINT // 12) * 12, 0)::BIGINT AS rest FROM v)
SELECT plan_id, opening_id, concat(CASE WHEN rest = 12 THEN feet + 1 ELSE feet END, '''-', CASE WHEN rest = 12 THEN 0 ELSE rest END, '"') AS text FROM f""")
def _(spark, sf):
    return V.openings(spark, sf).select("plan_id", "opening_id", feet_inches(F.col("x") * 1.25 + F.col("span") / 8).alias("text"))


@query("p31_scene_boxes", "walls plans", RECT + """, rr AS (SELECT * FROM rc WHERE plan_id % 2 = 0 AND (abs(x2 - x1) >= 1 OR abs(y2 - y1) >= 1))
SELECT plan_id, region_id AS id, (x1 + x2) / 2 AS x, 0 - (y1 + y2) / 2 AS z, abs(x2 - x1) AS width, abs(y2 - y1) AS depth, 96 AS height FROM rr
UNION ALL SELECT plan_id, wall_id, CASE orientation WHEN 'horizontal' THEN (s + e) / 2 ELSE coord END, 0 - CASE orientation WHEN 'horizontal' THEN coord ELSE (s + e) / 2 END,
 CASE orientation WHEN 'horizontal' THEN e - s ELSE thickness END, CASE orientation WHEN 'horizontal' THEN thickness ELSE e - s END, 96 FROM walls WHERE plan_id NOT IN (SELECT plan_id FROM rr)""")
def _(spark, sf):
    out = D.scene_boxes(rects(spark, sf).filter("plan_id % 2 = 0"), V.walls(spark, sf))
    return out.withColumn("z", F.col("z") + 0.0)


ANN = """
an AS (SELECT plan_id, opening_id, kind AS type, CASE orientation WHEN 'horizontal' THEN x - span / 2 ELSE x END AS x1, CASE orientation WHEN 'horizontal' THEN y ELSE y - span / 2 END AS y1,
 CASE orientation WHEN 'horizontal' THEN x + span / 2 ELSE x END AS x2, CASE orientation WHEN 'horizontal' THEN y ELSE y + span / 2 END AS y2,
 CASE k % 4 WHEN 0 THEN 'up' WHEN 1 THEN 'down' WHEN 2 THEN 'left' ELSE 'right' END AS swing FROM openings)"""


def annotations(spark, sf):
    flat = "orientation = 'horizontal'"
    return V.openings(spark, sf).selectExpr(
        "plan_id", "opening_id", "kind AS type", f"if({flat}, x - span / 2, x) AS x1", f"if({flat}, y, y - span / 2) AS y1", f"if({flat}, x + span / 2, x) AS x2",
        f"if({flat}, y, y + span / 2) AS y2", "element_at(array('up', 'down', 'left', 'right'), cast(k % 4 AS int) + 1) AS swing")


@query("p30_review_geometry", "openings", ANN + f""" SELECT plan_id, opening_id, CASE WHEN abs(y2 - y1) >= abs(x2 - x1) THEN 'left,right' ELSE 'up,down' END AS options,
 {rnd("CASE swing WHEN 'left' THEN (x1 + x2) / 2 - r WHEN 'right' THEN (x1 + x2) / 2 + r ELSE (x1 + x2) / 2 END", 4)} AS hx, {rnd("CASE swing WHEN 'up' THEN (y1 + y2) / 2 - r WHEN 'down' THEN (y1 + y2) / 2 + r ELSE (y1 + y2) / 2 END", 4)} AS hy,
 x1 + 3 AS moved_x1, y2 - 2 AS moved_y2 FROM (SELECT *, greatest(28, sqrt((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1)) * 0.55::DOUBLE) AS r FROM an)""")
def _(spark, sf):
    rows = annotations(spark, sf)
    hx, hy = D.swing_target(F.col("swing"))
    marked = rows.withColumns({"options": F.array_join(D.swing_options(), ","), "hx": round_to(hx, 4), "hy": round_to(hy, 4)})
    return D.translate(marked, F.lit(3.0), F.lit(-2.0)).select("plan_id", "opening_id", "options", "hx", "hy", F.col("x1").alias("moved_x1"), F.col("y2").alias("moved_y2"))


@query("p30_preview_lines", "openings", ANN + f""",
g AS (SELECT *, abs(x2 - x1) >= abs(y2 - y1) AS wide, least(x1, x2) AS lx, greatest(x1, x2) AS hx, least(y1, y2) AS ly, greatest(y1, y2) AS hy, (x1 + x2) / 2 AS mx, (y1 + y2) / 2 AS my,
 sqrt((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1)) AS w, CASE swing WHEN 'up' THEN -pi() / 2 WHEN 'down' THEN pi() / 2 WHEN 'left' THEN pi() ELSE 0 END AS turn, atan2(y2 - y1, x2 - x1) AS lean FROM an),
l AS (SELECT plan_id, opening_id, n, x1 + n * cos(lean) * 3 AS ax, y1 + n * sin(lean) * 3 AS ay, x1 + cos(turn) * w + n * cos(lean) * 3 AS bx, y1 + sin(turn) * w + n * sin(lean) * 3 AS by_ FROM g, (VALUES (0), (1)) t(n) WHERE type = 'door'
 UNION ALL SELECT plan_id, opening_id, n, CASE n WHEN 4 THEN hx ELSE lx END, CASE WHEN n < 3 THEN my + (n - 1) * 4 WHEN n < 5 THEN my - 4 ELSE CASE swing WHEN 'up' THEN my + 16 ELSE my - 16 END END,
  CASE n WHEN 3 THEN lx ELSE hx END, CASE WHEN n < 3 THEN my + (n - 1) * 4 WHEN n < 5 THEN my + 4 ELSE CASE swing WHEN 'up' THEN my + 16 ELSE my - 16 END END FROM g, (VALUES (0), (1), (2), (3), (4), (5)) t(n) WHERE type = 'window' AND wide
 UNION ALL SELECT plan_id, opening_id, n, CASE WHEN n < 3 THEN mx + (n - 1) * 4 WHEN n < 5 THEN mx - 4 ELSE CASE swing WHEN 'left' THEN mx + 16 ELSE mx - 16 END END, CASE n WHEN 4 THEN hy ELSE ly END,
  CASE WHEN n < 3 THEN mx + (n - 1) * 4 WHEN n < 5 THEN mx + 4 ELSE CASE swing WHEN 'left' THEN mx + 16 ELSE mx - 16 END END, CASE n WHEN 3 THEN ly ELSE hy END FROM g, (VALUES (0), (1), (2), (3), (4), (5)) t(n) WHERE type = 'window' AND NOT wide)
SELECT plan_id, opening_id, n, {rnd('ax', 4)} AS ax, {rnd('ay', 4)} AS ay, {rnd('bx', 4)} AS bx, {rnd('by_', 4)} AS by_ FROM l""")
def _(spark, sf):
    return r6(D.preview_lines(annotations(spark, sf)).withColumnRenamed("by", "by_"), "ax", "ay", "bx", "by_", n=4)


@query("p30_preview_arcs", "openings", ANN + f""",
sw AS (SELECT *, CASE WHEN abs(y2 - y1) >= abs(x2 - x1) THEN CASE WHEN swing IN ('up', 'down') THEN 'left' ELSE swing END ELSE CASE WHEN swing IN ('left', 'right') THEN 'up' ELSE swing END END AS to_ FROM an),
tp AS (SELECT *, sqrt((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1)) AS w FROM sw WHERE type = 'door'),
ar AS (SELECT *, x1 + CASE to_ WHEN 'left' THEN -w WHEN 'right' THEN w ELSE 0 END AS tx, y1 + CASE to_ WHEN 'up' THEN -w WHEN 'down' THEN w ELSE 0 END AS ty FROM tp)
SELECT plan_id, opening_id, {rnd('tx', 4)} AS start_x, {rnd('ty', 4)} AS start_y, {rnd('tx + x2 - x1', 4)} AS control_x, {rnd('ty + y2 - y1', 4)} AS control_y, {rnd('x2', 4)} AS end_x, {rnd('y2', 4)} AS end_y FROM ar""")
def _(spark, sf):
    # the first swing is turned to one the axis allows, where it is not
    rows = D.review_annotations(annotations(spark, sf))
    first = F.element_at(D.swing_options(), 1)
    allowed = D.with_swing(rows, F.when(F.array_contains(D.swing_options(), F.col("swing")), F.col("swing")).otherwise(first))
    return r6(D.preview_arcs(allowed), "start_x", "start_y", "control_x", "control_y", "end_x", "end_y", n=4)


@query("p32_entity_measures", "entities", f"""
m AS (SELECT *, (end_angle - start_angle + 720) % 360 AS sp FROM entities)
SELECT file_id, handle, type, CASE type WHEN 'LINE' THEN {rnd('sqrt((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1))', 4)} WHEN 'ARC' THEN {rnd('radians(sp) * radius', 4)} END AS length,
 CASE type WHEN 'LINE' THEN {rnd('CASE WHEN degrees(atan2(y2 - y1, x2 - x1)) < 0 THEN degrees(atan2(y2 - y1, x2 - x1)) + 360 ELSE degrees(atan2(y2 - y1, x2 - x1)) END', 4)} END AS angle,
 CASE type WHEN 'CIRCLE' THEN {rnd('radius * radius * pi()', 4)} END AS area, CASE type WHEN 'CIRCLE' THEN {rnd('radius * 2 * pi()', 4)} END AS circumference, CASE type WHEN 'ARC' THEN sp END AS span_angle,
 CASE type WHEN 'ARC' THEN {rnd('x1 + radius * cos(radians(start_angle))', 4)} END AS start_x, CASE type WHEN 'ARC' THEN {rnd('y1 + radius * sin(radians(start_angle))', 4)} END AS start_y,
 CASE type WHEN 'ARC' THEN {rnd('x1 + radius * cos(radians(end_angle))', 4)} END AS end_x, CASE type WHEN 'ARC' THEN {rnd('y1 + radius * sin(radians(end_angle))', 4)} END AS end_y FROM m""")
def _(spark, sf):
    return D.entity_measures(V.entities(spark, sf))


@query("p33_polyline_segments", "polygons", f"""
n AS (SELECT plan_id, poly_id, corner, px, py, coalesce(lead(px) OVER w, CASE WHEN cls < 2 THEN first_value(px) OVER w END) AS qx, coalesce(lead(py) OVER w, CASE WHEN cls < 2 THEN first_value(py) OVER w END) AS qy
 FROM polygons WINDOW w AS (PARTITION BY plan_id, poly_id ORDER BY corner))
SELECT plan_id, poly_id, corner AS n, {rnd('sqrt((qx - px) * (qx - px) + (qy - py) * (qy - py))', 4)} AS length,
 {rnd('CASE WHEN degrees(atan2(qy - py, qx - px)) < 0 THEN degrees(atan2(qy - py, qx - px)) + 360 ELSE degrees(atan2(qy - py, qx - px)) END', 4)} AS angle,
 CASE WHEN corner > 0 THEN {rnd('degrees(4 * atan(corner / 4.0::DOUBLE))', 4)} END AS bulge_angle FROM n WHERE qx IS NOT NULL""")
def _(spark, sf):
    rows = V.polygons(spark, sf).selectExpr("plan_id", "poly_id", "corner AS n", "px AS x", "py AS y", "corner / 4 AS bulge", "cls < 2 AS closed")
    return D.polyline_segments(rows, ["plan_id", "poly_id"])


@query("p33_polyline_length", "polygons", f"""
n AS (SELECT plan_id, poly_id, px, py, coalesce(lead(px) OVER w, CASE WHEN cls < 2 THEN first_value(px) OVER w END) AS qx, coalesce(lead(py) OVER w, CASE WHEN cls < 2 THEN first_value(py) OVER w END) AS qy
 FROM polygons WINDOW w AS (PARTITION BY plan_id, poly_id ORDER BY corner))
SELECT plan_id, poly_id, {rnd('coalesce(sum(sqrt((qx - px) * (qx - px) + (qy - py) * (qy - py))), 0)', 4)} AS total_length FROM n GROUP BY plan_id, poly_id""")
def _(spark, sf):
    rows = V.polygons(spark, sf).selectExpr("plan_id", "poly_id", "corner AS n", "px AS x", "py AS y", "cls < 2 AS closed")
    return D.polyline_lengths(rows, ["plan_id", "poly_id"])


@query("a17_dimension_types", "entities", """SELECT file_id, layer, CASE dim_raw & 15 WHEN 0 THEN 'LINEAR' WHEN 1 THEN 'ALIGNED' WHEN 2 THEN 'ANGULAR' WHEN 3 THEN 'DIAMETER' WHEN 4 THEN 'RADIUS' WHEN 5 THEN 'ANGULAR_3PT'
 WHEN 6 THEN 'ORDINATE' ELSE concat('UNKNOWN(', dim_raw & 15, ')') END AS dim_type, count(*) AS n FROM entities WHERE type = 'DIMENSION' GROUP BY ALL""")
def _(spark, sf):
    return D.dimension_types(V.entities(spark, sf))


@query("p34_dimension_types", "entities", """SELECT file_id, handle, CASE dim_raw & 15 WHEN 0 THEN 'LINEAR' WHEN 1 THEN 'ALIGNED' WHEN 2 THEN 'ANGULAR' WHEN 3 THEN 'DIAMETER' WHEN 4 THEN 'RADIUS' WHEN 5 THEN 'ANGULAR_3PT' WHEN 6 THEN 'ORDINATE'
 ELSE concat('UNKNOWN(', dim_raw & 15, ')') END AS dim_type FROM entities WHERE type = 'DIMENSION'""")
def _(spark, sf):
    return V.entities(spark, sf).filter("type = 'DIMENSION'").select("file_id", "handle", D.dimension_type(F.col("dim_raw")).alias("dim_type"))


@query("f11_layer_filter", "entities", "SELECT file_id, handle FROM entities WHERE layer IN ('WALLS', 'DOORS')")
def _(spark, sf):
    return D.layer_filter(V.entities(spark, sf), ["WALLS", "DOORS"]).select("file_id", "handle")


@query("a17_layer_summary", "entities", """SELECT file_id, layer, type, grouping_id(file_id, layer, type) AS level, count(*) AS n, min(x1) AS min_x, max(x1) AS max_x, min(y1) AS min_y, max(y1) AS max_y
 FROM entities GROUP BY GROUPING SETS ((file_id, layer, type), (file_id, layer), (file_id))""")
def _(spark, sf):
    return D.layer_summary(V.entities(spark, sf))


@query("p45_regularize_points", "polygons", """
ls AS (SELECT plan_id, poly_id, list([{'x': px::BIGINT, 'y': py::BIGINT}] ORDER BY corner) AS items FROM polygons GROUP BY ALL)
SELECT plan_id, poly_id, to_json(list_reduce(items, lambda acc, p: CASE WHEN abs(p[1].x - acc[-1].x) < 1 AND abs(p[1].y - acc[-1].y) < 1 THEN acc ELSE list_concat(acc, [{
 'x': CASE WHEN abs(degrees(atan2((p[1].y - acc[-1].y)::DOUBLE, (p[1].x - acc[-1].x)::DOUBLE))) BETWEEN 15 AND 165 AND abs(abs(degrees(atan2((p[1].y - acc[-1].y)::DOUBLE, (p[1].x - acc[-1].x)::DOUBLE))) - 90) < 15 THEN acc[-1].x ELSE p[1].x END,
 'y': CASE WHEN abs(degrees(atan2((p[1].y - acc[-1].y)::DOUBLE, (p[1].x - acc[-1].x)::DOUBLE))) BETWEEN 15 AND 165 THEN p[1].y ELSE acc[-1].y END}]) END))::VARCHAR AS points FROM ls""")
def _(spark, sf):
    item = F.sort_array(F.collect_list(F.struct("corner", F.col("px").cast("long").alias("x"), F.col("py").cast("long").alias("y"))))
    lists = V.polygons(spark, sf).groupBy("plan_id", "poly_id").agg(F.transform(item, lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y"))).alias("points"))
    out = lists.select("plan_id", "poly_id", D.regularize(F.col("points")).alias("points"))
    return out.select("plan_id", "poly_id", F.to_json("points").alias("points"))


def sql_option(name, sign):
    """One miter candidate of G05 in SQL: both corners slid along the wall to the neighbour's edge lines."""
    def meet(corner, side):
        t = f"(((sx - ({side}) * oy * 3) - {corner}x) * oy - ((sy + ({side}) * ox * 3) - {corner}y) * ox) / cr"
        return f"{corner}x + {t} * dx AS p{corner}x, {corner}y + {t} * dy AS p{corner}y"
    return f"""
{name}_p AS (SELECT *, {meet("qa", sign)}, {meet("qb", -sign)} FROM nb WHERE abs(cr) >= 1e-8),
{name} AS (SELECT plan_id, wall_id, "end", ord, sqrt((pqax - px) ** 2 + (pqay - py) ** 2) AS da, sqrt((pqbx - px) ** 2 + (pqby - py) ** 2) AS db, {-sign} AS rank, pqax, pqay, pqbx, pqby FROM {name}_p)"""


@query("g05_miter_outline", "polygons", """
w AS (SELECT plan_id, poly_id AS wall_id, max(px) FILTER (corner = 0) AS x1, max(py) FILTER (corner = 0) AS y1, max(px) FILTER (corner = 2) AS x2, max(py) FILTER (corner = 2) AS y2 FROM polygons WHERE poly_type = 'wall' GROUP BY ALL),
l AS (SELECT *, sqrt((x2 - x1) ** 2 + (y2 - y1) ** 2) AS len FROM w), u AS (SELECT *, (x2 - x1) / len AS ux, (y2 - y1) / len AS uy FROM l WHERE len >= 1),
en AS (SELECT plan_id, wall_id, 1 AS "end", x1 AS px, y1 AS py, ux AS dx, uy AS dy, ux, uy FROM u UNION ALL SELECT plan_id, wall_id, 2, x2, y2, -ux, -uy, ux, uy FROM u),
ec AS (SELECT *, px - uy * 3 AS qax, py + ux * 3 AS qay, px + uy * 3 AS qbx, py - ux * 3 AS qby FROM en),
ne AS (SELECT plan_id, wall_id AS ord, 1 AS o_end, x1 AS sx, y1 AS sy, x2 AS fx, y2 AS fy, len FROM l UNION ALL SELECT plan_id, wall_id, 2, x2, y2, x1, y1, len FROM l),
hi AS (SELECT ec.*, ord, sx, sy, (fx - sx) / len AS ox, (fy - sy) / len AS oy, len FROM ec JOIN ne ON ec.plan_id = ne.plan_id AND wall_id <> ord AND abs(px - sx) < 12 AND abs(py - sy) < 12
 QUALIFY row_number() OVER (PARTITION BY ec.plan_id, wall_id, "end", ord ORDER BY o_end) = 1),
nb AS (SELECT *, dx * oy - dy * ox AS cr FROM hi WHERE len >= 1),""" + sql_option("oa", 1) + "," + sql_option("ob", -1) + """,
be AS (SELECT * FROM (SELECT * FROM oa UNION ALL SELECT * FROM ob) WHERE da < 12 AND db < 12 QUALIFY row_number() OVER (PARTITION BY plan_id, wall_id, "end", ord ORDER BY da + db, rank) = 1),
la AS (SELECT * FROM be QUALIFY row_number() OVER (PARTITION BY plan_id, wall_id, "end" ORDER BY ord DESC) = 1)
SELECT plan_id, wall_id, "end", """ + ", ".join(f"{rnd(f'coalesce(p{c}, {c})', 4)} AS {n}" for c, n in (("qax", "ax"), ("qay", "ay"), ("qbx", "bx"), ("qby", "by_"))) + """, la.ord IS NOT NULL AS mitred
 FROM ec LEFT JOIN la USING (plan_id, wall_id, "end")""")
def _(spark, sf):
    # polygon diagonals stand for slanted walls
    ends = V.polygons(spark, sf).filter("poly_type = 'wall'").groupBy("plan_id", "poly_id").agg(
        F.min_by(F.struct("px", "py"), "corner").alias("a"), F.max_by(F.struct("px", "py"), F.when(F.col("corner") == 2, 1).otherwise(0)).alias("b"))
    walls = ends.select("plan_id", F.col("poly_id").alias("wall_id"), F.col("a.px").alias("x1"), F.col("a.py").alias("y1"), F.col("b.px").alias("x2"), F.col("b.py").alias("y2"), F.lit(3.0).alias("half"))
    others = walls.selectExpr("plan_id", "wall_id", "wall_id AS ord", "x1 AS ox1", "y1 AS oy1", "x2 AS ox2", "y2 AS oy2", "half AS o_half")
    return r6(D.miter_outline(walls, others).withColumnRenamed("by", "by_"), "ax", "ay", "bx", "by_", n=4)
