"""Wall cleaning queries."""

from pyspark.sql import functions as F

from plansift import views as V
from plansift.catalog.registry import query, rnd
from plansift.functions.ranking import number_by
from plansift.operators import config, junctions as J, walls as W

D = config.DEFAULTS


def base(spark, sf):
    return config.with_default_config(V.walls(spark, sf))


# -- SQL fragments reused by the flow queries; each reads and writes a named relation ------------


def sql_snap(src: str, out: str, snap: str = "4") -> str:
    """W02 in SQL; ``snap`` is a number or a column of ``src``."""
    return f"""
{out}_v AS (SELECT plan_id, orientation, role, value, count(*) AS n, max(tol) AS tol FROM (
  SELECT plan_id, orientation, 'coord' AS role, coord AS value, {snap} AS tol FROM {src} UNION ALL
  SELECT plan_id, orientation, 'span', s, {snap} FROM {src} UNION ALL
  SELECT plan_id, orientation, 'span', e, {snap} FROM {src}) GROUP BY ALL),
{out}_f AS (SELECT *, CASE WHEN value - lag(value) OVER w > tol THEN 1 ELSE 0 END AS fresh FROM {out}_v
  WINDOW w AS (PARTITION BY plan_id, orientation, role ORDER BY value)),
{out}_i AS (SELECT *, sum(fresh) OVER (PARTITION BY plan_id, orientation, role ORDER BY value) AS cl FROM {out}_f),
{out}_c AS (SELECT plan_id, orientation, role, cl, sum(value * n) / sum(n) AS center FROM {out}_i GROUP BY ALL),
{out}_m AS MATERIALIZED (SELECT v.plan_id, v.orientation, v.role, v.value, coalesce(arg_min(c.center, (abs(c.center - v.value), c.center)), v.value) AS snapped
  FROM {out}_i v LEFT JOIN {out}_c c ON c.plan_id = v.plan_id AND c.orientation = v.orientation AND c.role = v.role AND c.center BETWEEN v.value - v.tol AND v.value + v.tol
  GROUP BY v.plan_id, v.orientation, v.role, v.value),
{out} AS (SELECT w.* REPLACE (a.snapped AS coord, b.snapped AS s, c.snapped AS e) FROM {src} w
  JOIN {out}_m a ON a.plan_id = w.plan_id AND a.orientation = w.orientation AND a.role = 'coord' AND a.value = w.coord
  JOIN {out}_m b ON b.plan_id = w.plan_id AND b.orientation = w.orientation AND b.role = 'span' AND b.value = w.s
  JOIN {out}_m c ON c.plan_id = w.plan_id AND c.orientation = w.orientation AND c.role = 'span' AND c.value = w.e)"""


def sql_axes(src: str, out: str, tol: str = "6") -> str:
    """J06 in SQL."""
    return f"""
{out}_a AS (SELECT plan_id, CASE orientation WHEN 'horizontal' THEN 'vertical' ELSE 'horizontal' END AS orientation,
  coord AS axis, min(ord) AS first_ord FROM {src} GROUP BY ALL),
{out}_e AS (SELECT DISTINCT plan_id, orientation, value, tol FROM (
  SELECT plan_id, orientation, s AS value, {tol} AS tol FROM {src} UNION ALL
  SELECT plan_id, orientation, e, {tol} FROM {src})),
{out}_m AS (SELECT v.plan_id, v.orientation, v.value, arg_min(a.axis, (abs(a.axis - v.value), a.first_ord)) AS snapped
  FROM {out}_e v JOIN {out}_a a ON a.plan_id = v.plan_id AND a.orientation = v.orientation AND abs(a.axis - v.value) <= v.tol
  GROUP BY ALL),
{out} AS (SELECT w.* REPLACE (coalesce(b.snapped, w.s) AS s, coalesce(c.snapped, w.e) AS e) FROM {src} w
  LEFT JOIN {out}_m b ON b.plan_id = w.plan_id AND b.orientation = w.orientation AND b.value = w.s
  LEFT JOIN {out}_m c ON c.plan_id = w.plan_id AND c.orientation = w.orientation AND c.value = w.e)"""


def sql_merge(src: str, out: str, gap: str = "48", minimum: str = "12", carry: str = "") -> str:
    """W03 + F04 + W17 in SQL; ``carry`` lists extra columns that are constant per plan."""
    extra = "".join(f", any_value({c}) AS {c}" for c in carry.split())
    names = "".join(f", {c}" for c in carry.split())
    return f"""
{out}_r AS (SELECT *, {gap} AS gap_, {minimum} AS min_, max(e) OVER (PARTITION BY plan_id, orientation, coord ORDER BY s, ord
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach, min(ord) OVER (PARTITION BY plan_id, orientation, coord) AS line_ord
  FROM {src}),
{out}_i AS (SELECT *, sum(CASE WHEN s > reach + gap_ THEN 1 ELSE 0 END) OVER (PARTITION BY plan_id, orientation, coord
  ORDER BY s, ord ROWS UNBOUNDED PRECEDING) AS island FROM {out}_r),
{out}_g AS (SELECT plan_id, orientation, coord, island, line_ord, min(s) AS s, max(e) AS e, avg(thickness) AS thickness,
  {rnd("least(0.99::DOUBLE, avg(confidence) + 0.15::DOUBLE)", 4)} AS confidence, count(*) AS n_sources, any_value(min_) AS min_{extra}
  FROM {out}_i GROUP BY plan_id, orientation, coord, island, line_ord),
{out} AS (SELECT plan_id, printf('wall-%04d', row_number() OVER w) AS wall_id, row_number() OVER w AS ord, orientation, coord, s, e,
  thickness, confidence, n_sources{names} FROM {out}_g WHERE e - s >= min_ WINDOW w AS (PARTITION BY plan_id ORDER BY line_ord, s))"""


def sql_junctions(src: str, out: str, junction: str = "6", snap: str = "4") -> str:
    """J01 in SQL: {out}_p pairs, {out} points, {out}_c junctions per wall."""
    return f"""
{out}_t AS (SELECT h.plan_id, h.wall_id AS h_id, v.wall_id AS v_id, v.coord AS vx, h.coord AS hy, h.s AS hs, h.e AS he, v.s AS vs, v.e AS ve,
  least(greatest(h.jt_, greatest(h.thickness, v.thickness) / 2 + h.st_), 2.5 * h.jt_) AS tol
  FROM (SELECT *, {junction}::DOUBLE AS jt_, {snap}::DOUBLE AS st_ FROM {src}) h JOIN {src} v
  ON h.plan_id = v.plan_id AND h.orientation = 'horizontal' AND v.orientation = 'vertical'),
{out}_p AS (SELECT plan_id, h_id, v_id, {rnd("vx", 2)} AS x, {rnd("hy", 2)} AS y,
  least(abs(vx - hs), abs(vx - he)) <= tol AS h_end, least(abs(hy - vs), abs(hy - ve)) <= tol AS v_end FROM {out}_t
  WHERE vx BETWEEN hs - tol AND he + tol AND hy BETWEEN vs - tol AND ve + tol),
{out} AS (SELECT plan_id, x, y,
  CASE max(CASE WHEN h_end AND v_end THEN 0 WHEN h_end OR v_end THEN 1 ELSE 2 END) WHEN 0 THEN 'L' WHEN 1 THEN 'T' ELSE 'X' END AS type,
  count(DISTINCT h_id) + count(DISTINCT v_id) AS n_walls FROM {out}_p GROUP BY ALL),
{out}_c AS (SELECT plan_id, wall_id, count(*) AS n_junctions FROM (
  SELECT DISTINCT plan_id, h_id AS wall_id, x, y FROM {out}_p UNION SELECT DISTINCT plan_id, v_id, x, y FROM {out}_p) GROUP BY ALL)"""


def sql_classify(src: str, counts: str, out: str, snap: str = "4", cov: str = "0.7", again: str = "true") -> str:
    """A06 in SQL."""
    return f"""
{out}_b AS (SELECT plan_id, min(CASE orientation WHEN 'horizontal' THEN s ELSE coord END) AS min_x,
  max(CASE orientation WHEN 'horizontal' THEN e ELSE coord END) AS max_x,
  min(CASE orientation WHEN 'horizontal' THEN coord ELSE s END) AS min_y,
  max(CASE orientation WHEN 'horizontal' THEN coord ELSE e END) AS max_y FROM {src} GROUP BY ALL),
{out}_x AS (SELECT w.*, coalesce(c.n_junctions, 0) AS nj, {again} AS again_, {snap} AS snap_,
  CASE orientation WHEN 'horizontal' THEN min_y ELSE min_x END AS low, CASE orientation WHEN 'horizontal' THEN max_y ELSE max_x END AS high,
  CASE orientation WHEN 'horizontal' THEN max_x - min_x ELSE max_y - min_y END AS extent
  FROM {src} w JOIN {out}_b USING (plan_id) LEFT JOIN {counts} c ON c.plan_id = w.plan_id AND c.wall_id = w.wall_id),
{out}_y AS (SELECT *, (e - s) / (CASE WHEN extent > 1e-6 THEN extent ELSE 1 END) >= {cov}::DOUBLE
   OR (e - s) >= (CASE WHEN extent > 1e-6 THEN extent ELSE 1 END) - snap_ AS covers FROM {out}_x),
{out}_z AS (SELECT *, CASE WHEN abs(coord - low) <= snap_ THEN (CASE WHEN covers THEN (CASE orientation WHEN 'horizontal' THEN 'bottom' ELSE 'left' END) END)
   WHEN abs(coord - high) <= snap_ THEN (CASE WHEN covers THEN (CASE orientation WHEN 'horizontal' THEN 'top' ELSE 'right' END) END) END AS side_ FROM {out}_y),
{out}_w AS (SELECT *, CASE WHEN side_ IS NOT NULL THEN least(0.995::DOUBLE, confidence + 0.05::DOUBLE) ELSE confidence END AS c1 FROM {out}_z),
{out} AS (SELECT * EXCLUDE (low, high, extent, covers, snap_, c1, again_, nj, side_) REPLACE (CASE WHEN again_ THEN
   {rnd("CASE WHEN nj >= 2 THEN least(0.995::DOUBLE, c1 + 0.03::DOUBLE) ELSE c1 END", 4)} ELSE confidence END AS confidence),
   nj AS n_junctions, side_ AS side, side_ IS NOT NULL AS is_exterior FROM {out}_w)"""


# -- queries ---------------------------------------------------------------------------------------


@query("p01_normalize_point", "raw_xy", """SELECT plan_id, wall_id, ax AS x1, ay AS y1,
 CASE WHEN n_points = 2 THEN bx END AS x2, CASE WHEN n_points = 2 THEN by_ END AS y2 FROM raw_xy""")
def _(spark, sf):
    return W.parse_points(V.raw_walls(spark, sf)).select("plan_id", "wall_id", "x1", "y1", "x2", "y2")


SQL_P02 = """
p02 AS (SELECT *, CASE WHEN n_points < 2 THEN 'needs two points' WHEN abs(ay - by_) > 1e-6 AND abs(ax - bx) > 1e-6 THEN 'not axis-aligned' END AS error,
 CASE WHEN abs(ay - by_) <= 1e-6 THEN ax > bx ELSE ay > by_ END AS swap FROM raw_xy),
normal AS (SELECT plan_id, wall_id, ord, coalesce(orientation, CASE WHEN abs(ay - by_) <= 1e-6 THEN 'horizontal' ELSE 'vertical' END) AS orientation,
 CASE WHEN swap THEN bx ELSE ax END AS x1, CASE WHEN swap THEN by_ ELSE ay END AS y1,
 CASE WHEN swap THEN ax ELSE bx END AS x2, CASE WHEN swap THEN ay ELSE by_ END AS y2,
 coalesce(thickness, 4.0::DOUBLE) AS thickness, coalesce(confidence, 1.0::DOUBLE) AS confidence, is_exterior FROM p02 WHERE error IS NULL)
"""


@query("p02_normalize_walls", "raw_xy", SQL_P02 + " SELECT * EXCLUDE (confidence), round(confidence, 6) AS confidence FROM normal")
def _(spark, sf):
    out = W.normalize_walls(W.parse_points(V.raw_walls(spark, sf)))
    return out.filter("error IS NULL").drop("error").withColumn("confidence", F.round("confidence", 6))


@query("p02_rejected_walls", "raw_xy", SQL_P02 + " SELECT plan_id, error, count(*) AS n FROM p02 WHERE error IS NOT NULL GROUP BY ALL")
def _(spark, sf):
    out = W.normalize_walls(W.parse_points(V.raw_walls(spark, sf)))
    return out.filter("error IS NOT NULL").groupBy("plan_id", "error").agg(F.count(F.lit(1)).alias("n"))


@query("p04_normalize_geometry", "raw_xy", """
k AS (SELECT *, coalesce(orientation, CASE WHEN abs(ay - by_) <= 1e-6 THEN 'horizontal' WHEN abs(ax - bx) <= 1e-6 THEN 'vertical' ELSE 'diagonal' END) AS kind
 FROM raw_xy WHERE n_points = 2),
f AS (SELECT *, CASE WHEN kind = 'vertical' THEN ay > by_ ELSE ax > bx END AS swap FROM k)
SELECT plan_id, wall_id, kind AS orientation, CASE WHEN swap THEN bx ELSE ax END AS x1, CASE WHEN swap THEN by_ ELSE ay END AS y1,
 CASE WHEN swap THEN ax ELSE bx END AS x2, CASE WHEN swap THEN ay ELSE by_ END AS y2 FROM f""")
def _(spark, sf):
    raw = W.parse_points(V.raw_walls(spark, sf)).filter("x2 IS NOT NULL")
    return W.normalize_any(raw).select("plan_id", "wall_id", "orientation", "x1", "y1", "x2", "y2")


@query("p05_project_near_axis", "raw_xy", """
a AS (SELECT *, abs(bx - ax) AS dx, abs(by_ - ay) AS dy FROM raw_xy WHERE n_points = 2),
b AS (SELECT *, dx >= 1e-6 AND dy >= 1e-6 AND degrees(atan2(dy, dx)) <= 15 AS to_h,
 dx >= 1e-6 AND dy >= 1e-6 AND degrees(atan2(dy, dx)) > 15 AND 90 - degrees(atan2(dy, dx)) <= 15 AS to_v FROM a)
SELECT plan_id, wall_id, CASE WHEN to_h THEN 'horizontal' WHEN to_v THEN 'vertical' ELSE orientation END AS orientation,
 CASE WHEN to_h THEN least(ax, bx) WHEN to_v THEN (ax + bx) / 2 ELSE ax END AS x1,
 CASE WHEN to_h THEN (ay + by_) / 2 WHEN to_v THEN least(ay, by_) ELSE ay END AS y1,
 CASE WHEN to_h THEN greatest(ax, bx) WHEN to_v THEN (ax + bx) / 2 ELSE bx END AS x2,
 CASE WHEN to_h THEN (ay + by_) / 2 WHEN to_v THEN greatest(ay, by_) ELSE by_ END AS y2,
 to_h OR to_v AS projected FROM b""")
def _(spark, sf):
    raw = W.parse_points(V.raw_walls(spark, sf)).filter("x2 IS NOT NULL")
    return W.project_near_axis(raw).select("plan_id", "wall_id", "orientation", "x1", "y1", "x2", "y2", "projected")


SQL_CFG = """
cfg AS (SELECT plan_id, CASE WHEN unit = 'pixel' THEN 3 * sc ELSE 4 END AS snap, CASE WHEN unit = 'pixel' THEN 5 * sc ELSE 6 END AS junction,
 CASE WHEN unit = 'pixel' THEN 6 * sc ELSE 48 END AS merge_gap, CASE WHEN unit = 'pixel' THEN 5 * sc ELSE 12 END AS min_length,
 CASE WHEN unit = 'pixel' THEN 30 * sc ELSE 60 END AS text_length, CASE WHEN unit = 'pixel' THEN 2 * sc ELSE 6 END AS text_thickness,
 CASE WHEN unit = 'pixel' THEN (100 * sc) * (100 * sc) ELSE 40000 END AS furniture_area
 FROM (SELECT *, greatest(image_w / 500.0::DOUBLE, 1.0::DOUBLE) AS sc FROM plans))"""


@query("p06_adaptive_config", "plans", SQL_CFG + " SELECT plan_id, " + ", ".join(
    f"round(({c})::DOUBLE, 6) AS {c}" for c in ("snap", "junction", "merge_gap", "min_length", "text_length", "text_thickness", "furniture_area")) + " FROM cfg")
def _(spark, sf):
    cfg = config.adaptive_config(V.plans(spark, sf))
    names = [n for n in D if n != "exterior_coverage"]
    return cfg.select("plan_id", *[F.round(F.col(f"cfg.{n}"), 6).alias(n) for n in names])


@query("p07_apply_scale", "walls plans", """SELECT w.plan_id, wall_id, round(coord * f, 6) AS coord, round(s * f, 6) AS s, round(e * f, 6) AS e,
 round(thickness * f, 6) AS thickness FROM walls w JOIN (SELECT plan_id, 1490.0::DOUBLE / image_w AS f FROM plans) p ON p.plan_id = w.plan_id""")
def _(spark, sf):
    scale = V.plans(spark, sf).select("plan_id", (F.lit(1490.0) / F.col("image_w")).alias("f"))
    out = W.scale_walls(V.walls(spark, sf).join(scale, "plan_id"), F.col("f"))
    return out.select("plan_id", "wall_id", *[F.round(c, 6).alias(c) for c in ("coord", "s", "e", "thickness")])


@query("j01_junction_graph", "junctions", "SELECT plan_id, x, y, type, n_walls FROM junctions")
def _(spark, sf):
    return J.junctions(base(spark, sf))


@query("a01_junction_summary", "junctions", """SELECT plan_id, count(*) AS junction_count, count(*) FILTER (type = 'L') AS "junction_L",
 count(*) FILTER (type = 'T') AS "junction_T", count(*) FILTER (type = 'X') AS "junction_X" FROM junctions GROUP BY plan_id""")
def _(spark, sf):
    return J.junction_summary(J.junctions(base(spark, sf)))


@query("j02_connected_walls", "jpairs", "SELECT plan_id, h_id AS wall_id FROM jpairs UNION SELECT plan_id, v_id FROM jpairs")
def _(spark, sf):
    return J.connected_walls(base(spark, sf)).select("plan_id", "wall_id")


@query("j03_supported_walls", "jpairs", "SELECT plan_id, h_id AS wall_id FROM jpairs WHERE h_end UNION SELECT plan_id, v_id FROM jpairs WHERE v_end")
def _(spark, sf):
    return J.supported_walls(base(spark, sf)).select("plan_id", "wall_id")


@query("w01_cluster_values", "walls", """
v AS (SELECT plan_id, orientation, coord, count(*) AS n FROM walls GROUP BY ALL),
f AS (SELECT *, CASE WHEN coord - lag(coord) OVER (PARTITION BY plan_id, orientation ORDER BY coord) > 4 THEN 1 ELSE 0 END AS fresh FROM v),
i AS (SELECT *, sum(fresh) OVER (PARTITION BY plan_id, orientation ORDER BY coord) AS cluster FROM f)
SELECT plan_id, orientation, cluster::BIGINT AS cluster, """ + rnd("sum(coord * n) / sum(n)", 6) + """ AS center, sum(n)::BIGINT AS n FROM i GROUP BY ALL""")
def _(spark, sf):
    clustered = W.cluster_values(V.walls(spark, sf), ["plan_id", "orientation"], "coord", F.lit(D["snap"]))
    return clustered.groupBy("plan_id", "orientation", "cluster").agg(
        W.round_to(F.max("center"), 6).alias("center"), F.sum("n").alias("n"))


@query("w02_snap_walls", "walls", sql_snap("walls", "sn") + " SELECT plan_id, wall_id, "
       + ", ".join(f"{rnd(c, 6)} AS {c}" for c in ("coord", "s", "e")) + " FROM sn")
def _(spark, sf):
    out = W.snap_walls(base(spark, sf))
    return out.select("plan_id", "wall_id", *[W.round_to(c, 6).alias(c) for c in ("coord", "s", "e")])


@query("j06_snap_to_axes", "walls", sql_axes("walls", "ax") + " SELECT plan_id, wall_id, coord, s, e FROM ax")
def _(spark, sf):
    return W.snap_to_axes(base(spark, sf)).select("plan_id", "wall_id", "coord", "s", "e")


SQL_MERGED = " SELECT plan_id, wall_id, orientation, coord, s, e, " + rnd("thickness", 6) + " AS thickness, confidence, n_sources FROM mg"


@query("w03_merge_collinear", "walls", sql_merge("walls", "mg") + SQL_MERGED)
def _(spark, sf):
    out = W.merge_collinear(base(spark, sf))
    return out.select("plan_id", "wall_id", "orientation", "coord", "s", "e", W.round_to("thickness", 6).alias("thickness"),
                      "confidence", "n_sources")


@query("w17_sequential_ids", "walls", "SELECT plan_id, wall_id AS source_id, printf('wall-%04d', row_number() OVER (PARTITION BY plan_id ORDER BY ord)) AS wall_id FROM walls")
def _(spark, sf):
    rows = number_by(V.walls(spark, sf).select("plan_id", "wall_id", "ord"), ["plan_id"], "ord", "n")
    return rows.select("plan_id", F.col("wall_id").alias("source_id"), F.format_string("wall-%04d", "n").alias("wall_id"))


@query("f04_minimum_length", "walls", sql_merge("walls", "mg", "48", "60") + " SELECT plan_id, wall_id, s, e FROM mg")
def _(spark, sf):
    rows = base(spark, sf).withColumn("cfg", F.col("cfg").withField("min_length", F.lit(60.0)))
    return W.merge_collinear(rows).select("plan_id", "wall_id", "s", "e")


@query("a06_classify_exterior", "walls", sql_junctions("walls", "jn") + ", " + sql_classify("walls", "jn_c", "cl")
       + " SELECT plan_id, wall_id, side, is_exterior, confidence, n_junctions FROM cl")
def _(spark, sf):
    walls = base(spark, sf)
    counts = J.line_connections(J.junction_hits(walls))
    out = W.classify_exterior(walls, counts)
    return out.select("plan_id", "wall_id", "side", "is_exterior", "confidence", "n_junctions")


SQL_TEXT = "NOT (n_junctions > 0 OR is_exterior) AND e - s < 60 AND thickness < 6 AND (e - s) / greatest(thickness, 1e-6) < 3"
SQL_NOISE = """NOT (n_junctions > 0 OR is_exterior) AND ((e - s > 0 AND thickness / (e - s) > 0.55 AND e - s < 24)
 OR e - s < greatest(18, thickness * 2))"""
THIN = "thin AS (SELECT * REPLACE (CASE WHEN k % 3 = 0 THEN s + (e - s) / 32 ELSE e END AS e) FROM walls), "


def thin(spark, sf):
    """Walls with every third one cut to a stub, so the artifact filters have work."""
    return base(spark, sf).withColumn("e", F.when(F.col("k") % 3 == 0, F.col("s") + (F.col("e") - F.col("s")) / 32).otherwise(F.col("e")))


@query("f01_text_artifacts", "walls", THIN + sql_junctions("thin", "jn") + ", " + sql_classify("thin", "jn_c", "cl")
       + f" SELECT plan_id, count(*) AS n, count(*) FILTER ({SQL_TEXT}) AS removed FROM cl GROUP BY plan_id")
def _(spark, sf):
    walls = thin(spark, sf)
    out = W.mark_text_artifacts(W.classify_exterior(walls, J.line_connections(J.junction_hits(walls))))
    return out.groupBy("plan_id").agg(F.count(F.lit(1)).alias("n"), F.count_if("drop").alias("removed"))


@query("f02_isolated_noise", "walls", THIN + sql_junctions("thin", "jn") + ", " + sql_classify("thin", "jn_c", "cl")
       + f" SELECT plan_id, wall_id FROM cl WHERE NOT ({SQL_NOISE})")
def _(spark, sf):
    walls = thin(spark, sf)
    out = W.mark_isolated_noise(W.classify_exterior(walls, J.line_connections(J.junction_hits(walls))))
    return out.filter("NOT drop").select("plan_id", "wall_id")


@query("u05_wall_list", "raw_xy", """
k AS (SELECT *, coalesce(orientation, CASE WHEN abs(ay - by_) <= 1e-6 THEN 'horizontal' WHEN abs(ax - bx) <= 1e-6 THEN 'vertical' ELSE 'diagonal' END) AS kind
 FROM raw_xy WHERE n_points = 2)
SELECT plan_id, kind AS orientation, count(*) AS n FROM k GROUP BY ALL""")
def _(spark, sf):
    rows = W.normalize_any(W.parse_points(V.raw_walls(spark, sf)).filter("x2 IS NOT NULL"))
    parts = [rows.filter(F.col("orientation") == o) for o in ("horizontal", "vertical", "diagonal")]
    merged = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return merged.groupBy("plan_id", "orientation").agg(F.count(F.lit(1)).alias("n"))
