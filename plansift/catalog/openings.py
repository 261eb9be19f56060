"""Opening queries."""

from pyspark.sql import functions as F

from plansift import views as V
from plansift.catalog.cleaning import base, sql_classify, sql_junctions, sql_merge
from plansift.catalog.registry import query, rnd
from plansift.functions.ranking import number_by
from plansift.session import keep_rows
from plansift.operators import config, intervals as I, junctions as J, nearest as N, openings as O, walls as W

SWING = "CASE {0} WHEN 'bottom' THEN 'up' WHEN 'top' THEN 'down' WHEN 'left' THEN 'right' WHEN 'right' THEN 'left' END"

RAW = """raw AS (SELECT plan_id, opening_id, CASE WHEN k % 11 = 0 THEN 'arch' ELSE kind END AS kind, CASE WHEN k % 17 = 0 THEN 0 ELSE span END AS span,
 CASE WHEN k % 7 < 2 THEN NULL ELSE x END AS x, CASE WHEN k % 7 = 0 THEN NULL ELSE 5.0::DOUBLE END AS "offset", side,
 CASE WHEN k % 3 = 0 THEN NULL ELSE confidence END AS confidence, CASE WHEN k % 5 = 3 THEN 'sliding' END AS type FROM openings), """


def raw_openings(spark, sf):
    return V.openings(spark, sf).selectExpr(
        "plan_id", "opening_id", "if(k % 11 = 0, 'arch', kind) AS kind", "if(k % 17 = 0, 0D, span) AS span",
        "if(k % 7 < 2, NULL, x) AS x", "if(k % 7 = 0, NULL, 5.0D) AS offset", "side", "if(k % 3 = 0, NULL, confidence) AS confidence",
        "if(k % 5 = 3, 'sliding', NULL) AS type", "cast(NULL AS string) AS door_type", "cast(NULL AS string) AS swing",
    )


@query("p03_normalize_openings", "openings", RAW + f"""
e AS (SELECT *, CASE WHEN kind NOT IN ('door', 'window') THEN 'kind must be door or window' WHEN span <= 0 THEN 'span must be positive'
 WHEN x IS NULL AND "offset" IS NULL THEN 'needs offset or position' END AS error FROM raw)
SELECT plan_id, opening_id, error, kind, span, round(coalesce(confidence, 1.0::DOUBLE), 6) AS confidence,
 CASE WHEN kind = 'door' THEN coalesce(type, 'normal') END AS door_type,
 CASE WHEN kind = 'door' THEN {SWING.format('side')} END AS swing FROM e""")
def _(spark, sf):
    out = O.normalize_openings(raw_openings(spark, sf))
    return out.select("plan_id", "opening_id", "error", "kind", "span", F.round("confidence", 6).alias("confidence"), "door_type", "swing")


# merged and classified walls, the input of the anchoring queries
SQL_FINAL = sql_merge("walls", "mg") + ", " + sql_junctions("mg", "jn") + ", " + sql_classify("mg", "jn_c", "fw") + ", "


def final_walls(spark, sf):
    # both are read many times below, so computed once and kept below the shared checkpoint folder
    merged = keep_rows(W.merge_collinear(base(spark, sf)))
    return keep_rows(W.classify_exterior(merged, J.count_connections(merged, distinct=True)))


def sql_best(src, walls, out, enforce="o.orientation", tol="4"):
    own = f"CASE WHEN {enforce} IS NULL OR w.orientation = {enforce} THEN 0 ELSE 1 END"
    return f"""
{out}_c AS (SELECT o.plan_id, o.opening_id, w.wall_id, w.orientation AS wo, w.coord, w.s, w.e, w.ord, {own} AS pass,
  CASE w.orientation WHEN 'horizontal' THEN abs(o.y - w.coord) ELSE abs(o.x - w.coord) END AS dist,
  CASE w.orientation WHEN 'horizontal' THEN o.x ELSE o.y END AS along, o.span, {tol} AS tol_
  FROM {src} o JOIN {walls} w ON o.plan_id = w.plan_id),
{out} AS (SELECT plan_id, opening_id, arg_min({{'wall_id': wall_id, 'o': wo, 'coord': coord, 's': s, 'e': e, 'dist': dist}}, (pass, dist, s - e, ord)) AS line
  FROM {out}_c WHERE along + span / 2 >= s - tol_ AND along - span / 2 <= e + tol_ GROUP BY plan_id, opening_id)"""


@query("j04_best_wall", "walls openings", sql_best("openings", "walls", "bw")
       + " SELECT plan_id, opening_id, line.wall_id AS wall_id, line.dist AS dist FROM bw")
def _(spark, sf):
    points = V.openings(spark, sf).withColumn("tol", F.lit(4.0))
    out = N.nearest_lines(points, V.walls(spark, sf), ["plan_id", "opening_id"])
    return out.select("plan_id", "opening_id", "line.wall_id", "line.dist")


ANCHOR_STEPS = """,
a AS (SELECT o.*, b1.line AS line, CASE WHEN b1.line.o = 'horizontal' THEN o.x ELSE o.y END - b1.line.s - o.span / 2 AS off FROM openings o
 LEFT JOIN b1 USING (plan_id, opening_id)),
a2 AS (SELECT a.*, off >= -4 AND off + span <= a.line.e - a.line.s + 4 AS ok, b2.line AS line2,
 CASE WHEN b2.line.o = 'horizontal' THEN x ELSE y END - b2.line.s - span / 2 AS off2 FROM a LEFT JOIN b2 USING (plan_id, opening_id)),
a3 AS (SELECT * REPLACE (CASE WHEN line IS NOT NULL AND NOT ok AND off2 >= -4 AND off2 + span <= line2.e - line2.s + 4 THEN line2 ELSE line END AS line,
 CASE WHEN line IS NOT NULL AND NOT ok AND off2 >= -4 AND off2 + span <= line2.e - line2.s + 4 THEN off2 ELSE off END AS off,
 coalesce(ok, false) OR (line IS NOT NULL AND off2 >= -4 AND off2 + span <= line2.e - line2.s + 4) AS ok) FROM a2),
anchored AS (SELECT a3.plan_id, opening_id, kind, CASE WHEN line IS NULL THEN 'no compatible wall' WHEN NOT ok THEN 'span does not fit' ELSE 'anchored' END AS status,
 line.wall_id AS wall_id, span, line.o AS orientation, CASE line.o WHEN 'horizontal' THEN line.s + off + span / 2 ELSE line.coord END AS x,
 CASE line.o WHEN 'horizontal' THEN line.coord ELSE line.s + off + span / 2 END AS y, """ + rnd("off", 4) + """ AS "offset",
 coalesce(a3.side, w.side, CASE line.o WHEN 'horizontal' THEN 'top' ELSE 'right' END) AS side, a3.side IS NULL AS side_inferred,
 """ + rnd("least(a3.confidence, w.confidence)", 4) + """ AS confidence FROM a3 LEFT JOIN fw w ON w.plan_id = a3.plan_id AND w.wall_id = line.wall_id) """
ANCHOR = SQL_FINAL + sql_best("openings", "fw", "b1") + ", " + sql_best("openings", "fw", "b2", "NULL") + ANCHOR_STEPS


def anchored(spark, sf, walls=None):
    rows = config.with_default_config(V.openings(spark, sf)).withColumn("offset", F.lit(None).cast("double")).withColumn(
        "wall_id", F.lit(None).cast("string"))
    return O.anchor(rows, final_walls(spark, sf) if walls is None else walls, distinct=True)


@query("j05_anchor_openings", "walls openings", ANCHOR + f"""SELECT plan_id, opening_id, kind, status, wall_id, span, orientation, x, y, "offset",
 CASE WHEN line_null THEN NULL ELSE side END AS side, side_inferred, confidence, CASE WHEN kind = 'door' AND NOT line_null THEN {SWING.format('side')} END AS swing
 FROM (SELECT *, wall_id IS NULL AS line_null FROM anchored)""")
def _(spark, sf):
    out = anchored(spark, sf)
    lost = F.col("wall_id").isNull()
    return out.withColumn("side", F.when(~lost, F.col("side"))).withColumn("swing", F.when(~lost, F.col("swing")))


@query("p42_offset_position", "walls openings", sql_best("openings", "walls", "bw") + """
SELECT plan_id, opening_id, CASE line.o WHEN 'horizontal' THEN x ELSE y END - line.s - span / 2 AS "offset",
 CASE line.o WHEN 'horizontal' THEN x ELSE line.coord END AS x, CASE line.o WHEN 'horizontal' THEN line.coord ELSE y END AS y
 FROM bw JOIN openings USING (plan_id, opening_id)""")
def _(spark, sf):
    points = V.openings(spark, sf).withColumn("tol", F.lit(4.0))
    hit = N.nearest_lines(points, V.walls(spark, sf), ["plan_id", "opening_id", "x", "y", "span"])
    out = hit.withColumn("offset", O.offset_on("line"))
    px, py = O.position_on("line", F.col("offset"))
    return out.select("plan_id", "opening_id", "offset", px.alias("x"), py.alias("y"))


@query("f03_furniture_filter", "walls openings", """SELECT plan_id, opening_id FROM openings o WHERE span > 200 OR EXISTS (SELECT 1 FROM walls w
 WHERE w.plan_id = o.plan_id AND CASE w.orientation WHEN 'horizontal' THEN abs(o.y - w.coord) <= 12 AND o.x - span / 2 <= w.e + 4 AND o.x + span / 2 >= w.s - 4
 ELSE abs(o.x - w.coord) <= 12 AND o.y - span / 2 <= w.e + 4 AND o.y + span / 2 >= w.s - 4 END)""")
def _(spark, sf):
    out = O.drop_furniture(config.with_default_config(V.openings(spark, sf)), V.walls(spark, sf))
    return out.select("plan_id", "opening_id")


SQL_MID = "mid AS (SELECT plan_id, wall_id, ord, CASE orientation WHEN 'horizontal' THEN (s + e) / 2 ELSE coord END AS mx, CASE orientation WHEN 'horizontal' THEN coord ELSE (s + e) / 2 END AS my FROM walls), "
SQL_NEAR = """near AS (SELECT o.plan_id, o.opening_id, arg_min(w.wall_id, (abs(o.x - mx) + abs(o.y - my), w.ord)) AS wall_id, min(abs(o.x - mx) + abs(o.y - my)) AS dist
 FROM openings o JOIN mid w ON o.plan_id = w.plan_id GROUP BY ALL) """


def midpoints(walls):
    flat = F.col("orientation") == "horizontal"
    mid = (F.col("s") + F.col("e")) / 2
    return walls.select("plan_id", "wall_id", F.col("ord").alias("tord"), F.when(flat, mid).otherwise(F.col("coord")).alias("tx"),
                        F.when(flat, F.col("coord")).otherwise(mid).alias("ty"))


@query("j07_nearest_midpoint_80", "walls openings", SQL_MID + SQL_NEAR + "SELECT * FROM near WHERE dist <= 80")
def _(spark, sf):
    out = N.nearest_point(V.openings(spark, sf), midpoints(V.walls(spark, sf)), ["plan_id", "opening_id"], F.col("wall_id"), 80.0)
    return out.select("plan_id", "opening_id", F.col("hit.payload").alias("wall_id"), "hit.dist")


@query("j08_nearest_midpoint", "walls openings", SQL_MID + SQL_NEAR + "SELECT * FROM near")
def _(spark, sf):
    out = N.nearest_point(V.openings(spark, sf), midpoints(V.walls(spark, sf)), ["plan_id", "opening_id"], F.col("wall_id"), None)
    return out.select("plan_id", "opening_id", F.col("hit.payload").alias("wall_id"), "hit.dist")


# openings put on their best wall, the input of the per-wall filters
ON_WALL = sql_best("openings", "walls", "bw") + """,
onw AS (SELECT o.*, line.wall_id AS wall_id, CASE line.o WHEN 'horizontal' THEN o.x ELSE o.y END AS along FROM openings o JOIN bw USING (plan_id, opening_id))"""


def on_wall(spark, sf):
    points = V.openings(spark, sf).withColumn("tol", F.lit(4.0))
    hit = N.nearest_lines(points, V.walls(spark, sf), points.columns)
    flat = F.col("line.orientation") == "horizontal"
    return hit.withColumns({"along": F.when(flat, F.col("x")).otherwise(F.col("y")), "wall_id": F.col("line.wall_id")}).drop("tol")


@query("w07_dedupe_openings", "walls openings", ON_WALL + """,
lists AS (SELECT plan_id, wall_id, kind, list([{'along': along, 'ord': ord, 'span': span}] ORDER BY along, ord) AS items FROM onw GROUP BY ALL),
kept AS (SELECT plan_id, wall_id, kind, list_reduce(items, lambda acc, x: CASE
   WHEN len(list_filter(acc, lambda k: least(k.along + k.span / 2, x[1].along + x[1].span / 2) - greatest(k.along - k.span / 2, x[1].along - x[1].span / 2) > least(k.span, x[1].span) * 0.5)) = 0
     THEN list_concat(acc, x)
   WHEN x[1].span > list_filter(acc, lambda k: least(k.along + k.span / 2, x[1].along + x[1].span / 2) - greatest(k.along - k.span / 2, x[1].along - x[1].span / 2) > least(k.span, x[1].span) * 0.5)[1].span
     THEN list_concat(list_filter(acc, lambda m: m.ord <> list_filter(acc, lambda k: least(k.along + k.span / 2, x[1].along + x[1].span / 2) - greatest(k.along - k.span / 2, x[1].along - x[1].span / 2) > least(k.span, x[1].span) * 0.5)[1].ord), x)
   ELSE acc END) AS items FROM lists),
flat AS (SELECT plan_id, wall_id, kind, unnest(items) AS k FROM kept)
SELECT plan_id, wall_id, kind, k.along AS along, k.span AS span, k.ord AS ord FROM flat""")
def _(spark, sf):
    return O.dedupe_on_wall(on_wall(spark, sf).drop("line"))


@query("w08_limit_windows", "walls openings", SQL_FINAL + sql_best("openings", "fw", "bw") + """,
onw AS (SELECT o.*, line.wall_id AS wall_id, coalesce(w.is_exterior, false) AS outer_ FROM openings o JOIN bw USING (plan_id, opening_id)
 LEFT JOIN fw w ON w.plan_id = o.plan_id AND w.wall_id = line.wall_id),
r AS (SELECT *, row_number() OVER (PARTITION BY plan_id, wall_id, kind ORDER BY span DESC, ord) AS rn FROM onw)
SELECT plan_id, opening_id, wall_id FROM r WHERE kind <> 'window' OR NOT outer_ OR rn <= 3""")
def _(spark, sf):
    walls = final_walls(spark, sf)
    points = V.openings(spark, sf).withColumn("tol", F.lit(4.0))
    hit = N.nearest_lines(points, walls, ["plan_id", "opening_id", "kind", "span", "ord"], distinct=True, payload=("is_exterior",))
    rows = hit.withColumn("wall_id", F.col("line.wall_id")).withColumn("is_exterior", F.col("line.is_exterior")).drop("line")
    return O.limit_exterior_windows(rows, None).select("plan_id", "opening_id", "wall_id")


# -- legacy rooms

SIDES = """
edges AS (SELECT rooms.*, side, CASE side WHEN 'bottom' THEN y WHEN 'top' THEN y + h WHEN 'left' THEN x ELSE x + w END AS edge,
 CASE WHEN side IN ('bottom', 'top') THEN x ELSE y END AS lo, CASE WHEN side IN ('bottom', 'top') THEN x + w ELSE y + h END AS hi
 FROM rooms, (VALUES ('bottom'), ('top'), ('left'), ('right')) t(side)),
sides AS (SELECT a.*, EXISTS (SELECT 1 FROM edges b WHERE b.plan_id = a.plan_id AND b.room_id <> a.room_id
 AND b.side = CASE a.side WHEN 'left' THEN 'right' WHEN 'right' THEN 'left' WHEN 'top' THEN 'bottom' ELSE 'top' END
 AND abs(a.edge - b.edge) < 5 AND a.lo < b.hi AND a.hi > b.lo) AS interior FROM edges a)"""
CAND = SIDES + """,
cand AS (SELECT plan_id, room_id, side, CASE WHEN side IN ('bottom', 'top') THEN 'horizontal' ELSE 'vertical' END AS orientation,
 CASE WHEN side = 'right' AND NOT interior THEN edge - 4 ELSE edge END AS coord,
 CASE WHEN side IN ('bottom', 'top') THEN lo ELSE lo + 4 END AS s, CASE WHEN side IN ('bottom', 'top') THEN hi ELSE hi - 4 END AS e,
 NOT interior AS is_exterior FROM sides)"""
SPANS = CAND + """,
r1 AS (SELECT *, max(e) OVER (PARTITION BY plan_id, orientation, coord, is_exterior ORDER BY s, e, room_id, side ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM cand),
r2 AS (SELECT *, sum(CASE WHEN s > reach + 1e-6 THEN 1 ELSE 0 END) OVER (PARTITION BY plan_id, orientation, coord, is_exterior ORDER BY s, e, room_id, side ROWS UNBOUNDED PRECEDING) AS island FROM r1),
r3 AS (SELECT plan_id, orientation, coord, is_exterior, island, min(s) AS s, max(e) AS e FROM r2 GROUP BY ALL),
lw AS (SELECT *, printf('wall-%04d', row_number() OVER (PARTITION BY plan_id ORDER BY orientation, coord, is_exterior, s)) AS wall_id FROM r3)"""
LOPEN = """,
lo AS (SELECT plan_id, room_id, side, opening_kind AS kind, CASE WHEN side IN ('bottom', 'top') THEN 'horizontal' ELSE 'vertical' END AS orientation,
 CASE WHEN side = 'right' AND NOT interior THEN edge - 4 ELSE edge END AS coord, lo + opening_offset AS "start", lo + opening_offset + opening_width AS "end",
 opening_width AS span, NOT interior AS is_exterior, door_type FROM sides WHERE opening_side = side AND opening_width > 0)"""


@query("j09_room_adjacency", "rooms", SIDES + " SELECT plan_id, room_id, side, interior FROM sides")
def _(spark, sf):
    return O.room_sides(V.rooms(spark, sf)).select("plan_id", "room_id", "side", "interior")


@query("p10_legacy_wall_candidates", "rooms", CAND + " SELECT * FROM cand")
def _(spark, sf):
    return O.legacy_wall_candidates(O.room_sides(V.rooms(spark, sf)))


@query("w04_merge_spans", "rooms", SPANS + " SELECT plan_id, wall_id, orientation, coord, is_exterior, s, e FROM lw")
def _(spark, sf):
    return I.merge_legacy_walls(O.legacy_wall_candidates(O.room_sides(V.rooms(spark, sf))))


@query("p11_legacy_openings", "rooms", SIDES + LOPEN + " SELECT * FROM lo")
def _(spark, sf):
    return O.legacy_openings(O.room_sides(V.rooms(spark, sf)))


@query("j10_match_legacy_opening", "rooms", SPANS + LOPEN + """,
m AS (SELECT lo.plan_id, room_id, side, kind, "start", "end", span, arg_min({'id': lw.wall_id, 's': lw.s}, (lw.is_exterior <> lo.is_exterior, lw.e - lw.s, lw.wall_id)) AS w
 FROM lo JOIN lw ON lo.plan_id = lw.plan_id AND lo.orientation = lw.orientation AND lo.coord = lw.coord AND lw.s <= "start" + 1e-6 AND lw.e >= "end" - 1e-6 GROUP BY ALL)
SELECT plan_id, room_id, side, kind, span, w.id AS wall_id, "start" - w.s AS "offset" FROM m""")
def _(spark, sf):
    # read by the openings and, twice, by the walls
    sides = keep_rows(O.room_sides(V.rooms(spark, sf)))
    return O.match_legacy(O.legacy_openings(sides), I.merge_legacy_walls(O.legacy_wall_candidates(sides)))


# -- model output adapters

BOX = """
box AS (SELECT plan_id, poly_id, poly_type, cls, min(px) AS x1, max(px) AS x2, any_value(image_h) - max(py) AS y1, any_value(image_h) - min(py) AS y2
 FROM polygons JOIN plans USING (plan_id) GROUP BY plan_id, poly_id, poly_type, cls)"""


def boxes(spark, sf):
    return O.polygon_boxes(V.polygons(spark, sf), V.plans(spark, sf))


@query("p12_polygon_walls", "polygons plans", BOX + """ SELECT plan_id, poly_id, CASE WHEN x2 - x1 >= y2 - y1 THEN 'horizontal' ELSE 'vertical' END AS orientation,
 CASE WHEN x2 - x1 >= y2 - y1 THEN (y1 + y2) / 2 ELSE (x1 + x2) / 2 END AS coord, CASE WHEN x2 - x1 >= y2 - y1 THEN x1 ELSE y1 END AS s,
 CASE WHEN x2 - x1 >= y2 - y1 THEN x2 ELSE y2 END AS e, greatest(least(x2 - x1, y2 - y1), 1) AS thickness
 FROM box WHERE poly_type = 'wall' AND (x2 - x1 >= 2 OR y2 - y1 >= 2)""")
def _(spark, sf):
    return O.polygon_walls(boxes(spark, sf))


SQL_POPEN = """,
po AS (SELECT plan_id, poly_id, CASE cls WHEN 1 THEN 'window' ELSE 'door' END AS kind, (x1 + x2) / 2 AS x, (y1 + y2) / 2 AS y, greatest(x2 - x1, y2 - y1) AS span,
 CASE WHEN x2 - x1 >= y2 - y1 THEN 'horizontal' ELSE 'vertical' END AS orientation FROM box
 WHERE (poly_type = 'opening' OR (poly_type = 'icon' AND cls IN (1, 2))) AND (x2 - x1 >= 2 OR y2 - y1 >= 2))"""


@query("p13_polygon_openings", "polygons plans", BOX + SQL_POPEN + " SELECT * FROM po")
def _(spark, sf):
    return O.polygon_openings(boxes(spark, sf)).drop("swing")


@query("p14_door_swing", "polygons plans", BOX + SQL_POPEN + " SELECT plan_id, kind, count(*) AS n, count(*) FILTER (false) AS with_swing FROM po GROUP BY ALL")
def _(spark, sf):
    out = O.polygon_openings(boxes(spark, sf))
    return out.groupBy("plan_id", "kind").agg(F.count(F.lit(1)).alias("n"), F.count("swing").alias("with_swing"))


@query("p15_vector_lines", "polygons plans", """
pt AS (SELECT plan_id, px AS x1, py AS y1, lead(px) OVER w AS x2, lead(py) OVER w AS y2, row_number() OVER w - 1 AS line_no FROM polygons WHERE corner = 0 WINDOW w AS (PARTITION BY plan_id ORDER BY poly_id))
SELECT plan_id, line_no, x1, image_h - y1 AS y1, x2, image_h - y2 AS y2, CASE WHEN abs(x2 - x1) >= abs(y2 - y1) THEN 'horizontal' ELSE 'vertical' END AS orientation
 FROM pt JOIN plans USING (plan_id) WHERE line_no % 2 = 0 AND x2 IS NOT NULL""")
def _(spark, sf):
    corners = number_by(V.polygons(spark, sf).filter("corner = 0").select("plan_id", "poly_id", "px", "py"), ["plan_id"], "poly_id", "n")
    points = corners.selectExpr("plan_id", "px AS x", "py AS y", "n - 1 AS idx")
    lines = points.filter("idx % 2 = 0").selectExpr("plan_id", "idx AS line_no", "idx AS a", "idx + 1 AS b")
    return O.vector_lines(points, lines, V.plans(spark, sf))


@query("p16_segments_to_walls", "walls", """SELECT plan_id, wall_id AS segment_id, orientation, (coord + coord + thickness - 1) / 2 AS coord, s, e - 1 AS e,
 greatest(1.0::DOUBLE, thickness) AS thickness, 0.7::DOUBLE AS confidence FROM walls""")
def _(spark, sf):
    flat = "orientation = 'horizontal'"
    seg = V.walls(spark, sf).selectExpr(
        "plan_id", "wall_id AS segment_id", "orientation", f"if({flat}, s, coord) AS x1", f"if({flat}, e - 1, coord + thickness - 1) AS x2",
        f"if({flat}, coord, s) AS y1", f"if({flat}, coord + thickness - 1, e - 1) AS y2")
    return O.segments_to_walls(seg)


@query("p17_contract_to_structure", "walls plans", """SELECT w.plan_id, printf('raw-wall-%04d', row_number() OVER (PARTITION BY w.plan_id ORDER BY ord)) AS wall_id,
 orientation, coord, s, e, concat('remote_worker/', unit) AS source, 'unverified' AS scale_status FROM walls w JOIN plans USING (plan_id)""")
def _(spark, sf):
    return number_by(V.walls(spark, sf), ["plan_id"], "ord", "n").join(V.plans(spark, sf), "plan_id").select(
        "plan_id", F.format_string("raw-wall-%04d", "n").alias("wall_id"), "orientation", "coord", "s", "e",
        F.concat(F.lit("remote_worker/"), "unit").alias("source"), F.lit("unverified").alias("scale_status"))


@query("p18_suppress_openings", "openings plans", """
n AS (SELECT plan_id, count(*) AS n FROM openings GROUP BY plan_id)
SELECT plan_id, unit = 'pixel' AS detection_disabled, CASE WHEN unit = 'pixel' THEN 0 ELSE coalesce(n, 0) END AS kept,
 CASE WHEN unit = 'pixel' THEN coalesce(n, 0) ELSE 0 END AS suppressed, CASE WHEN unit = 'pixel' THEN 'disabled_by_product_decision' END AS reason
 FROM plans LEFT JOIN n USING (plan_id)""")
def _(spark, sf):
    policy = V.plans(spark, sf).selectExpr("plan_id", "unit = 'pixel' AS detection_disabled")
    return O.suppress_openings(V.openings(spark, sf), policy)


@query("p19_opening_annotations", "openings plans", f"""SELECT plan_id, opening_id, kind AS type, {rnd("CASE orientation WHEN 'horizontal' THEN x - span / 2 ELSE x END", 1)} AS x1,
 {rnd("CASE orientation WHEN 'horizontal' THEN image_h - y ELSE image_h - y - span / 2 END", 1)} AS y1,
 {rnd("CASE orientation WHEN 'horizontal' THEN x + span / 2 ELSE x END", 1)} AS x2,
 {rnd("CASE orientation WHEN 'horizontal' THEN image_h - y ELSE image_h - y + span / 2 END", 1)} AS y2,
 CASE WHEN kind = 'door' THEN {SWING.format('side')} WHEN orientation = 'horizontal' THEN coalesce(CASE side WHEN 'bottom' THEN 'up' WHEN 'top' THEN 'down' END, {SWING.format('side')})
 ELSE coalesce(CASE side WHEN 'left' THEN 'left' WHEN 'right' THEN 'right' END, {SWING.format('side')}) END AS swing FROM openings JOIN plans USING (plan_id)""")
def _(spark, sf):
    rows = V.openings(spark, sf).withColumn("swing", O.lookup(O.SWING_BY_SIDE, F.col("side")))
    return O.to_annotations(rows, V.plans(spark, sf))


@query("p20_fill_semantics", "walls openings", SQL_FINAL + sql_best("openings", "fw", "bw") + f""",
j AS (SELECT o.plan_id, opening_id, kind, o.side, line.wall_id AS wall_id, coalesce(w.side, CASE w.orientation WHEN 'horizontal' THEN 'top' WHEN 'vertical' THEN 'right' END) AS fb
 FROM openings o LEFT JOIN bw USING (plan_id, opening_id) LEFT JOIN fw w ON w.plan_id = o.plan_id AND w.wall_id = line.wall_id)
SELECT plan_id, opening_id, wall_id, kind, CASE WHEN kind = 'door' THEN {SWING.format('fb')} END AS swing,
 CASE WHEN kind = 'window' THEN coalesce(side, fb) ELSE side END AS side,
 CASE WHEN kind = 'door' AND fb IS NOT NULL THEN 'door swing' WHEN kind = 'window' AND side IS NULL AND fb IS NOT NULL THEN 'window exterior side' END AS filled FROM j""")
def _(spark, sf):
    walls = final_walls(spark, sf)
    points = V.openings(spark, sf).withColumn("tol", F.lit(4.0))
    hit = N.nearest_lines(points, walls, ["plan_id", "opening_id", "kind", "side"], distinct=True, outer=True, payload=("side",))
    rows = hit.select("plan_id", "opening_id", "kind", "side", F.col("line.wall_id").alias("wall_id"), F.lit(None).cast("string").alias("swing"),
                      F.col("line.side").alias("w_side"), F.col("line.orientation").alias("w_o"))
    return O.fill_semantics(rows, None)


@query("f14_validate_responses", "walls", """SELECT plan_id, wall_id, CASE WHEN k % 11 = 0 THEN 'MODEL_NOT_LOADED' WHEN k % 11 BETWEEN 1 AND 6 THEN 'INVALID_RESPONSE' END AS code,
 CASE k % 11 WHEN 0 THEN 'Unknown worker error' WHEN 1 THEN 'missing required fields: model_version' WHEN 2 THEN 'wall polyline must contain exactly 2 points' WHEN 3 THEN 'invalid wall orientation'
 WHEN 4 THEN 'invalid opening kind' WHEN 5 THEN 'opening span must be positive' WHEN 6 THEN 'image_size must contain width and height' END AS message FROM walls""")
def _(spark, sf):
    from plansift.sources import responses
    fault = F.col("k") % 11
    point = F.struct(F.col("s").alias("x"), F.col("coord").alias("y"))
    doc = F.to_json(F.struct(
        F.when(fault == 0, F.struct(F.lit("MODEL_NOT_LOADED").alias("code"))).alias("error"), F.lit("m").alias("model_name"),
        F.when(fault != 1, "1").alias("model_version"),
        F.array(F.struct(F.when(fault == 2, F.array(point)).otherwise(F.array(point, point)).alias("polyline"), "thickness",
                         F.when(fault == 3, "diagonal").otherwise(F.col("orientation")).alias("orientation"))).alias("walls"),
        F.array(F.struct(F.when(fault == 4, "arch").otherwise("door").alias("kind"), F.when(fault == 5, 0.0).otherwise(20.0).alias("span"))).alias("openings"),
        F.struct(F.lit(10).alias("width"), F.when(fault != 6, 20).alias("height")).alias("image_size"),
    ))
    out = responses.validate(V.walls(spark, sf).select("plan_id", "wall_id", doc.alias("response")))
    return out.select("plan_id", "wall_id", "code", "message")
