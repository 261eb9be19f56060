"""Component, room and region queries."""

from pyspark.sql import functions as F

from plansift import views as V
from plansift.catalog.cleaning import base
from plansift.catalog.masks import BASE, CLOSED, FRAME, ICONS, closed_rooms, frame, icon_mask, runs_digest, sql_close, sql_complement, sql_dilate, sql_merge, sql_open, wall_mask
from plansift.catalog.registry import query, rnd
from plansift.functions.formats import feet_inches
from plansift.operators import components as C, masks as M, regions as R


def sql_compact(src, out):
    return f"""
{out}_g AS (SELECT *, y - row_number() OVER (PARTITION BY plan_id, x0, x1 ORDER BY y) AS g FROM {src}),
{out} AS (SELECT plan_id, x0, x1, min(y) AS y0, max(y) AS y1, min(y) * 2097152 + x0 AS id FROM {out}_g GROUP BY plan_id, x0, x1, g)"""


def sql_label(src, out, slack=1):
    """Components by smallest-id propagation over boxes."""
    return sql_compact(src, f"{out}_b") + f""",
{out}_e AS (SELECT a.plan_id, a.id AS a, b.id AS b FROM {out}_b a JOIN {out}_b b ON a.plan_id = b.plan_id AND a.y1 + 1 = b.y0 AND a.x0 <= b.x1 + {slack} AND a.x1 + {slack} >= b.x0),
{out}_n AS (SELECT * FROM {out}_e UNION ALL SELECT plan_id, b, a FROM {out}_e),
{out}_c(plan_id, id, comp) USING KEY (plan_id, id) AS (SELECT plan_id, id, id AS comp FROM {out}_b UNION
 (SELECT n.plan_id, n.b AS id, min(c.comp) AS comp FROM {out}_c c JOIN {out}_n n ON n.plan_id = c.plan_id AND n.a = c.id
  JOIN recurring.{out}_c r ON r.plan_id = n.plan_id AND r.id = n.b WHERE c.comp < r.comp GROUP BY n.plan_id, n.b)),
{out} AS (SELECT b.*, c.comp FROM {out}_b b JOIN {out}_c c USING (plan_id, id))"""


def sql_stats(src, out):
    return f"""
{out} AS (SELECT plan_id, comp, sum((x1 - x0 + 1) * (y1 - y0 + 1))::BIGINT AS area, min(x0) AS bx0, max(x1) AS bx1, min(y0) AS by0, max(y1) AS by1,
 sum((x1 - x0 + 1) * (y1 - y0 + 1) * (x0 + x1)) / 2 / sum((x1 - x0 + 1) * (y1 - y0 + 1)) AS cx,
 sum((x1 - x0 + 1) * (y1 - y0 + 1) * (y0 + y1)) / 2 / sum((x1 - x0 + 1) * (y1 - y0 + 1)) AS cy FROM {src} GROUP BY plan_id, comp)"""


ROUND = f"SELECT plan_id, comp, area, bx0, bx1, by0, by1, {rnd('cx', 4)} AS cx, {rnd('cy', 4)} AS cy FROM "


def rounded(stats):
    return stats.select("plan_id", "comp", "area", "bx0", "bx1", "by0", "by1", M.round_to("cx", 4).alias("cx"), M.round_to("cy", 4).alias("cy"))


@query("g02_components", "walls plans", BASE + "," + sql_label("wm", "lb") + "," + sql_stats("lb", "st") + " " + ROUND + "st")
def _(spark, sf):
    return rounded(C.component_stats(C.label_boxes(wall_mask(spark, sf), frame=frame(spark, sf))))


FREE = CLOSED + "," + sql_complement("closed", "fr") + "," + sql_label("fr", "lf", 0)


# nearest free pixel per label, pixel by pixel
SEEDED = FREE + "," + sql_stats("lf", "st") + """,
sd AS (SELECT l.*, greatest(0, least(seed_x, w - 1)) AS sx, greatest(0, least(seed_y, h - 1)) AS sy FROM labels3 l JOIN frame USING (plan_id)),
off AS (SELECT a.v AS dx, b.v AS dy, greatest(abs(a.v), abs(b.v)) AS ring FROM (SELECT unnest(range(-20, 21)) AS v) a, (SELECT unnest(range(-20, 21)) AS v) b),
cand AS (SELECT sd.plan_id, label_ord, lf.comp, dx, dy, ring, sx, sy FROM sd JOIN lf ON lf.plan_id = sd.plan_id AND lf.x0 <= sx + 20 AND lf.x1 >= sx - 20 AND lf.y0 <= sy + 20 AND lf.y1 >= sy - 20
 JOIN off ON sx + dx BETWEEN lf.x0 AND lf.x1 AND sy + dy BETWEEN lf.y0 AND lf.y1),
pick AS (SELECT plan_id, label_ord, arg_min({'comp': comp, 'x': sx + dx, 'y': sy + dy}, (ring, dx, dy)) AS p FROM cand GROUP BY plan_id, label_ord),
rg AS (SELECT k.plan_id, label_ord, p.comp AS comp, p.x AS seed_x, p.y AS seed_y, area, bx0, bx1, by0, by1 FROM pick k JOIN st ON st.plan_id = k.plan_id AND st.comp = k.p.comp WHERE area >= 50)"""


def regions(spark, sf):
    masks, rule, reach = closed_rooms(spark, sf)
    return C.seeded_regions(V.labels(spark, sf), masks, frame(spark, sf), lambda s: s.free(rule(s)), reach)


@query("g03_room_regions", "walls openings labels3", SEEDED + " SELECT * FROM rg")
def _(spark, sf):
    return regions(spark, sf).select("plan_id", F.col("label_ord").cast("long").alias("label_ord"), "comp", "seed_x", "seed_y", "area", "bx0", "bx1", "by0", "by1")


AUDIT = SEEDED + """,
pr AS (SELECT plan_id, comp, max(area) AS area, count(*) AS n FROM rg GROUP BY plan_id, comp),
ra AS (SELECT plan_id, sum(area)::BIGINT AS union_area_px, sum(area * n)::BIGINT AS raw_labeled_area_px, sum(area * (n - 1))::BIGINT AS overlap_area_px,
 sum(n - 1)::BIGINT AS duplicated_region_count, sum(n - 1)::BIGINT AS overlapping_label_count FROM pr GROUP BY plan_id)"""


@query("a25_room_rows", "walls openings labels3", SEEDED + """
SELECT plan_id, label_ord, area, CASE WHEN label_ord > f THEN f END AS duplicate_of_index, CASE WHEN label_ord > f THEN area ELSE 0 END AS overlap_area_px
 FROM (SELECT *, min(label_ord) OVER (PARTITION BY plan_id, comp) AS f FROM rg)""")
def _(spark, sf):
    return C.room_rows(regions(spark, sf))


@query("a25_region_audit", "walls openings labels3", AUDIT + " SELECT * FROM ra")
def _(spark, sf):
    return C.region_audit(regions(spark, sf))


TOTAL = AUDIT + """,
sc AS (SELECT ra.*, total_sqft, CASE WHEN total_sqft > 0 AND union_area_px >= 100 THEN sqrt(total_sqft * 144.0::DOUBLE / union_area_px) END AS scale_ipp
 FROM ra JOIN (SELECT plan_id, any_value(total_sqft) AS total_sqft FROM labels3 GROUP BY plan_id) USING (plan_id))"""


def totals(spark, sf):
    return V.labels(spark, sf).groupBy("plan_id").agg(F.max("total_sqft").alias("total_sqft"))


@query("a23_scale_from_total", "walls openings labels3", TOTAL + f""" SELECT plan_id, {rnd('scale_ipp', 6)} AS scale_ipp, {rnd('raw_labeled_area_px * scale_ipp * scale_ipp / 144', 4)} AS raw_sum_sqft,
 {rnd('(raw_labeled_area_px * scale_ipp * scale_ipp / 144 - total_sqft) / total_sqft * 100', 4)} AS total_delta_pct FROM sc""")
def _(spark, sf):
    out = C.scale_from_total(C.region_audit(regions(spark, sf)), totals(spark, sf))
    return out.select("plan_id", M.round_to("scale_ipp", 6).alias("scale_ipp"), M.round_to("raw_sum_sqft", 4).alias("raw_sum_sqft"), M.round_to("total_delta_pct", 4).alias("total_delta_pct"))


@query("a24_scale_from_labels", "walls openings labels3", SEEDED + f""",
ea AS (SELECT rg.plan_id, sqrt(sqft * 144.0::DOUBLE / area) AS scale FROM rg JOIN labels3 USING (plan_id, label_ord) WHERE sqft > 0)
SELECT plan_id, {rnd('quantile_cont(scale, 0.5)', 6)} AS scale_ipp, count(*) AS n_labels FROM ea GROUP BY plan_id""")
def _(spark, sf):
    rows = regions(spark, sf).join(V.labels(spark, sf).select("plan_id", "label_ord", "sqft"), ["plan_id", "label_ord"])
    return C.scale_from_labels(rows).select("plan_id", M.round_to("scale_ipp", 6).alias("scale_ipp"), "n_labels")


@query("w16_room_dimensions", "walls openings labels3", TOTAL + """,
bd AS (SELECT rg.*, greatest(12, least(30, floor(least(bx1 - bx0, by1 - by0) * 0.25)))::BIGINT AS band FROM rg),
hx AS (SELECT bd.plan_id, label_ord, max(x1 - x0) AS span_w FROM bd JOIN lf ON lf.plan_id = bd.plan_id AND lf.comp = bd.comp AND seed_x BETWEEN x0 AND x1 AND y0 <= seed_y + band AND y1 >= seed_y - band GROUP BY ALL),
vp AS (SELECT lf.plan_id, lf.comp, x, y0, y1 FROM lf, LATERAL (SELECT unnest(range(x0, x1 + 1)) AS x)),
vg AS (SELECT *, sum(CASE WHEN y0 > prev + 1 THEN 1 ELSE 0 END) OVER (PARTITION BY plan_id, comp, x ORDER BY y0 ROWS UNBOUNDED PRECEDING) AS g
 FROM (SELECT *, lag(y1) OVER (PARTITION BY plan_id, comp, x ORDER BY y0) AS prev FROM vp)),
vr AS (SELECT plan_id, comp, x, min(y0) AS y0, max(y1) AS y1 FROM vg GROUP BY plan_id, comp, x, g),
vx AS (SELECT bd.plan_id, label_ord, max(y1 - y0) AS span_h FROM bd JOIN vr ON vr.plan_id = bd.plan_id AND vr.comp = bd.comp AND seed_y BETWEEN y0 AND y1 AND x BETWEEN seed_x - band AND seed_x + band GROUP BY ALL)
SELECT plan_id, label_ord, span_w, span_h FROM hx JOIN vx USING (plan_id, label_ord)""")
def _(spark, sf):
    masks, rule, reach = closed_rooms(spark, sf)
    out = C.seeded_spans(V.labels(spark, sf), masks, frame(spark, sf), lambda s: s.free(rule(s)), reach)
    return out.select("plan_id", F.col("label_ord").cast("long").alias("label_ord"), "span_w", "span_h")


@query("g04_interior_components", "walls plans", BASE + "," + sql_dilate("wm", "dl", M.rect_kernel(3)) + "," + sql_complement("dl", "fr") + "," + sql_label("fr", "lf", 0) + "," + sql_stats("lf", "st")
       + " SELECT s.plan_id, comp, area FROM st s JOIN frame USING (plan_id) WHERE bx0 > 0 AND by0 > 0 AND bx1 < w - 1 AND by1 < h - 1")
def _(spark, sf):
    f = frame(spark, sf)
    steps = [M.grow(M.rect_kernel(3))]
    free = C.labelled({"walls": wall_mask(spark, sf)}, f, lambda s: [s.free(s.morph(s["walls"], steps))], diagonal=False, reach=M.reach_of(steps))
    return C.inner_components(C.component_stats(free), f).select("plan_id", "comp", "area")


@query("g06_footprint", "walls plans", BASE + "," + sql_complement("wm", "fr") + "," + sql_label("fr", "lf", 0) + "," + sql_stats("lf", "st") + """,
en AS (SELECT s.plan_id, comp FROM st s JOIN frame USING (plan_id) WHERE bx0 > 0 AND by0 > 0 AND bx1 < w - 1 AND by1 < h - 1),
ir AS (SELECT lf.plan_id, unnest(range(y0, y1 + 1)) AS y, x0, x1 FROM lf JOIN en USING (plan_id, comp)),
al AS (SELECT plan_id, y, x0, x1 FROM wm UNION ALL SELECT plan_id, y, x0, x1 FROM ir),""" + sql_close("al", "fp", M.rect_kernel(5)) + "," + sql_label("fp", "lp") + "," + sql_stats("lp", "sp") + """
SELECT plan_id, count(*) AS n_components, arg_min(area, (-area, comp))::BIGINT AS area, arg_min(comp, (-area, comp))::BIGINT AS comp, sum(area)::BIGINT AS total_area FROM sp GROUP BY plan_id""")
def _(spark, sf):
    masks, f, rule, reach = C.footprint_sheets(wall_mask(spark, sf), frame(spark, sf))
    stats = C.component_stats(C.labelled(masks, f, rule, reach=reach))
    total = stats.groupBy("plan_id").agg(F.sum("area").alias("total_area"))
    return C.largest_component(stats).join(total, "plan_id").select("plan_id", "n_components", "top.area", "top.comp", "total_area")


@query("a26_mask_summary", "walls plans", BASE + "," + sql_label("wm", "lb") + "," + sql_stats("lb", "st") + f"""
SELECT plan_id, sum(area)::BIGINT AS nonzero_pixel_count, {rnd('sum(area) / any_value(w * h)', 6)} AS coverage_ratio, count(*) AS component_count, max(area) AS largest_component_area,
 min(bx0) AS x1, min(by0) AS y1, max(bx1) + 1 AS x2, max(by1) + 1 AS y2 FROM st JOIN frame USING (plan_id) GROUP BY plan_id""")
def _(spark, sf):
    return R.mask_summary(C.component_stats(C.label_boxes(wall_mask(spark, sf), frame=frame(spark, sf))), frame(spark, sf))


@query("m09_heatmap_junctions", "pixel_grid", "frame AS (SELECT DISTINCT image_id AS plan_id, 64 AS w, 64 AS h FROM pixel_grid), pt AS (SELECT image_id AS plan_id, y, x AS x0, x AS x1 FROM pixel_grid),"
       + sql_dilate("pt", "dl", M.ellipse_kernel(5)) + "," + sql_label("dl", "lb") + "," + sql_stats("lb", "st") + " " + ROUND + "st WHERE area >= 3")
def _(spark, sf):
    grid = V.pixel_grid(spark, sf)
    f = grid.select(F.col("image_id").alias("plan_id")).distinct().selectExpr("plan_id", "64L AS w", "64L AS h")
    points = grid.selectExpr("image_id AS plan_id", "cast(y AS bigint) AS y", "cast(x AS bigint) AS x0", "cast(x AS bigint) AS x1")
    return rounded(R.heatmap_junctions(points, f))


def sql_icons(mask, kind, size, least):
    kernel = M.ellipse_kernel(size)
    return (sql_close(mask, f"{mask}_c", kernel) + "," + sql_dilate(f"{mask}_c", f"{mask}_d", kernel) + "," + sql_label(f"{mask}_d", f"{mask}_l") + "," + sql_stats(f"{mask}_l", f"{mask}_s") + f""",
{mask}_o AS (SELECT plan_id, '{kind}' AS kind, {rnd('cx', 4)} AS x, {rnd('cy', 4)} AS y, greatest(bx1 - bx0, by1 - by0) + 1.0::DOUBLE AS span,
 CASE WHEN bx1 - bx0 >= by1 - by0 THEN 'horizontal' ELSE 'vertical' END AS orientation, area FROM {mask}_s WHERE area >= {least})""")


@query("m10_icon_openings", "walls openings plans", FRAME + "," + ICONS + "," + sql_icons("dm", "door", 11, 120) + "," + sql_icons("nm", "window", 15, 150) + " SELECT * FROM dm_o UNION ALL SELECT * FROM nm_o")
def _(spark, sf):
    f = frame(spark, sf)
    doors = R.icons_to_openings(icon_mask(spark, sf, "door"), f, "door")
    return doors.unionByName(R.icons_to_openings(icon_mask(spark, sf, "window"), f, "window"))


@query("f12_minimum_area", "walls plans", BASE + "," + sql_label("wm", "lb") + "," + sql_stats("lb", "st") + " SELECT plan_id, comp, area FROM st WHERE area >= 150")
def _(spark, sf):
    return C.component_stats(C.label_boxes(wall_mask(spark, sf), frame=frame(spark, sf))).filter("area >= 150").select("plan_id", "comp", "area")


@query("g01_endpoint_clusters", "walls", """
en AS (SELECT plan_id, wall_no, 0 AS end_no, wall_no * 2 AS id, CASE orientation WHEN 'horizontal' THEN s ELSE coord END AS x, CASE orientation WHEN 'horizontal' THEN coord ELSE s END AS y FROM (SELECT *, ord AS wall_no FROM walls)
 UNION ALL SELECT plan_id, wall_no, 1, wall_no * 2 + 1, CASE orientation WHEN 'horizontal' THEN e ELSE coord END, CASE orientation WHEN 'horizontal' THEN coord ELSE e END FROM (SELECT *, ord AS wall_no FROM walls)),
ed AS (SELECT a.plan_id, a.id AS a, b.id AS b FROM en a JOIN en b ON a.plan_id = b.plan_id AND a.wall_no <> b.wall_no AND (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= 144),
cc(plan_id, id, comp) USING KEY (plan_id, id) AS (SELECT plan_id, id, id FROM en UNION (SELECT n.plan_id, n.b, min(c.comp) FROM cc c JOIN ed n ON n.plan_id = c.plan_id AND n.a = c.id
 JOIN recurring.cc r ON r.plan_id = n.plan_id AND r.id = n.b WHERE c.comp < r.comp GROUP BY n.plan_id, n.b)),
lb AS (SELECT en.*, comp FROM en JOIN cc USING (plan_id, id)),
mn AS (SELECT plan_id, comp, avg(x) AS mx, avg(y) AS my, count(*) AS n FROM lb GROUP BY ALL)
SELECT plan_id, wall_no, end_no, comp, n, """ + rnd("mx", 6) + " AS x, " + rnd("my", 6) + " AS y FROM lb JOIN mn USING (plan_id, comp)")
def _(spark, sf):
    flat = "orientation = 'horizontal'"
    walls = V.walls(spark, sf)
    ends = walls.selectExpr("plan_id", "ord AS wall_no", "0 AS end_no", f"if({flat}, s, coord) AS x", f"if({flat}, coord, s) AS y").unionByName(
        walls.selectExpr("plan_id", "ord AS wall_no", "1 AS end_no", f"if({flat}, e, coord) AS x", f"if({flat}, coord, e) AS y"))
    out = C.endpoint_clusters(ends)
    return out.withColumn("x", M.round_to("x", 6)).withColumn("y", M.round_to("y", 6))


# -- region plan

def sql_trim(src, lo, hi, c1, c2, other, out):
    """One pass of J16 over {src}: ends move to what they meet in {other}."""
    high, low = (f"CASE WHEN o.{lo} - 2 < m.{hi} AND m.{hi} < o.{hi} + (o.{hi} - o.{lo}) * 1.3 THEN", f"CASE WHEN o.{lo} - (o.{hi} - o.{lo}) * 1.3 < m.{lo} AND m.{lo} < o.{hi} + 2 THEN")
    return f"""
{out}_m AS (SELECT m.plan_id, m.ord, arg_max({high} o.{hi} END, {high} o.ord END) AS nh, arg_max({low} o.{lo} END, {low} o.ord END) AS nl FROM {src} m JOIN {other} o
 ON m.plan_id = o.plan_id AND (m.{c1} + m.{c2}) / 2 BETWEEN o.{c1} - 2 AND o.{c2} + 2 AND m.{lo} < o.{hi} AND m.{hi} > o.{lo} GROUP BY m.plan_id, m.ord),
{out} AS (SELECT r.* REPLACE (coalesce(nl, {lo}) AS {lo}, coalesce(nh, {hi}) AS {hi}) FROM {src} r LEFT JOIN {out}_m USING (plan_id, ord))"""


REGIONS = BASE + "," + sql_close("wm", "cl", M.rect_kernel(5, 2)) + "," + sql_open("cl", "op", M.rect_kernel(3)) + """,
nd AS (SELECT plan_id, w, h, greatest(8, least(w, h) // 40) AS need FROM frame),
hr AS (SELECT op.* FROM op JOIN nd USING (plan_id) WHERE x1 - x0 + 1 >= need),
px AS (SELECT plan_id, y, unnest(range(x0, x1 + 1)) AS x FROM op),
pg AS (SELECT *, y - row_number() OVER (PARTITION BY plan_id, x ORDER BY y) AS g FROM px),
pn AS (SELECT *, count(*) OVER (PARTITION BY plan_id, x, g) AS n FROM pg),
pk AS (SELECT pn.plan_id, y, x AS x0, x AS x1 FROM pn JOIN nd USING (plan_id) WHERE n >= need),""" + sql_merge("pk", "vr") + "," + sql_label("hr", "hl") + "," + sql_label("vr", "vl") + "," + sql_stats("hl", "hs") + "," + sql_stats("vl", "vs") + """,
cn AS (SELECT *, bx1 - bx0 + 1 AS len, by1 - by0 + 1 AS dep, 'horizontal' AS o FROM hs UNION ALL SELECT *, by1 - by0 + 1, bx1 - bx0 + 1, 'vertical' FROM vs),
ac AS (SELECT cn.*, w, h, w / h > 1490.0::DOUBLE / 1050 AS wide, dep * (1 - 0.4::DOUBLE) / 2 AS trim FROM cn JOIN nd USING (plan_id) WHERE len >= need AND dep >= 2 AND len / dep >= 2.5),
tr AS (SELECT *, CASE WHEN wide THEN 1490.0::DOUBLE / w ELSE 1050.0::DOUBLE / h END AS sc FROM ac),
pl AS (SELECT *, CASE WHEN wide THEN 40.0::DOUBLE ELSE 40 + (1490 - w * sc) / 2 END AS ox, CASE WHEN wide THEN 30 + (1050 - h * sc) / 2 ELSE 30.0::DOUBLE END AS oy FROM tr),
rc AS (SELECT plan_id, o, comp AS ord, (CASE o WHEN 'horizontal' THEN bx0 ELSE bx0 + trim END) * sc + ox AS x1, (h - CASE o WHEN 'horizontal' THEN by1 + 1 - trim ELSE by1 + 1 END) * sc + oy AS y1,
 (CASE o WHEN 'horizontal' THEN bx1 + 1 ELSE bx1 + 1 - trim END) * sc + ox AS x2, (h - CASE o WHEN 'horizontal' THEN by0 + trim ELSE by0 END) * sc + oy AS y2 FROM pl),
rh AS (SELECT * FROM rc WHERE o = 'horizontal'), rv AS (SELECT * FROM rc WHERE o = 'vertical'),""" + sql_trim("rh", "x1", "x2", "y1", "y2", "rv", "h2") + "," + sql_trim("rv", "y1", "y2", "x1", "x2", "h2", "v2") + """,
al AS (SELECT * FROM h2 UNION ALL SELECT * FROM v2),
rs AS (SELECT al.plan_id, al.o AS orientation, al.ord, al.x1, al.y1, al.x2, al.y2, rc.x1 AS raw_x1, rc.y1 AS raw_y1, rc.x2 AS raw_x2, rc.y2 AS raw_y2,
 greatest(abs(al.x1 - rc.x1), abs(al.y1 - rc.y1), abs(al.x2 - rc.x2), abs(al.y2 - rc.y2)) > 1e-6 AS adjusted, greatest(0.0::DOUBLE, CASE al.o WHEN 'horizontal' THEN al.y2 - al.y1 ELSE al.x2 - al.x1 END) AS thick FROM al JOIN rc USING (plan_id, o, ord)),
rp AS (SELECT plan_id, orientation, ord, adjusted, thick AS raw_thickness, least(thick, 6) AS draw_thickness, thick > 6 AS clamped, raw_x1, raw_y1, raw_x2, raw_y2,
 CASE WHEN thick > 6 AND orientation = 'vertical' THEN (x1 + x2) / 2 - 3 ELSE x1 END AS x1, CASE WHEN thick > 6 AND orientation = 'horizontal' THEN (y1 + y2) / 2 - 3 ELSE y1 END AS y1,
 CASE WHEN thick > 6 AND orientation = 'vertical' THEN (x1 + x2) / 2 + 3 ELSE x2 END AS x2, CASE WHEN thick > 6 AND orientation = 'horizontal' THEN (y1 + y2) / 2 + 3 ELSE y2 END AS y2,
 printf('%s-region-%04d', orientation[1], row_number() OVER (PARTITION BY plan_id, orientation ORDER BY ord)) AS region_id FROM rs)"""
REGION_NUMBERS = ["raw_thickness", "draw_thickness", *(f"{raw}{c}{n}" for raw in ("raw_", "") for n in (1, 2) for c in "xy")]


@query("m12_region_plan", "walls plans", REGIONS + " SELECT plan_id, region_id, orientation, ord, adjusted, clamped, " + ", ".join(f"{rnd(c, 4)} AS {c}" for c in REGION_NUMBERS) + " FROM rp")
def _(spark, sf):
    plan = R.region_plan(wall_mask(spark, sf), frame(spark, sf))
    return plan.select("plan_id", "region_id", "orientation", "ord", "adjusted", "clamped", *[M.round_to(c, 4).alias(c) for c in REGION_NUMBERS])


@query("a27_region_meta", "walls plans", REGIONS + """ SELECT plan_id, count(*) AS region_count, count(*) FILTER (clamped) AS clamped_region_count,
 count(*) FILTER (orientation = 'horizontal' AND adjusted) AS horizontal_adjusted_count, count(*) FILTER (orientation = 'vertical' AND adjusted) AS vertical_adjusted_count FROM rp GROUP BY plan_id""")
def _(spark, sf):
    return R.region_meta(R.region_plan(wall_mask(spark, sf), frame(spark, sf)))


@query("f10_region_candidates", "walls plans", BASE + """,
nd AS (SELECT plan_id, greatest(8, least(w, h) // 40) AS need FROM frame),
hr AS (SELECT wm.* FROM wm JOIN nd USING (plan_id) WHERE x1 - x0 + 1 >= need),""" + sql_label("hr", "lb") + "," + sql_stats("lb", "st") + """
SELECT plan_id, comp, bx1 - bx0 + 1 AS length, by1 - by0 + 1 AS depth, CASE WHEN bx1 - bx0 + 1 < need OR by1 - by0 + 1 < 2 THEN 'too_short'
 WHEN (bx1 - bx0 + 1) / (by1 - by0 + 1) < 2.5 THEN 'insufficient_aspect_ratio' END AS skip_reason FROM st JOIN nd USING (plan_id)""")
def _(spark, sf):
    return R.candidates({"walls": wall_mask(spark, sf)}, frame(spark, sf), ("horizontal",)).select("plan_id", "comp", "length", "depth", "skip_reason")
