"""Mask and pixel queries."""

from pyspark.sql import functions as F

from plansift import views as V
from plansift.catalog.registry import query, rnd
from plansift.operators import masks as M, sheets


def frame(spark, sf):
    return V.plans(spark, sf).selectExpr("plan_id", "cast(image_w AS bigint) AS w", "cast(image_h AS bigint) AS h")


def wall_mask(spark, sf):
    """Boxes of the walls, as they are drawn; masks are cut to the frame where they are worked on."""
    return M.wall_boxes(V.walls(spark, sf))


def truth_mask(spark, sf):
    return M.wall_boxes(V.truth_walls(spark, sf))


# -- SQL twins of the mask operators; each names its output relation ------------------------------


def sql_merge(src, out, keys="plan_id"):
    return f"""
{out}_r AS (SELECT {keys}, y, x0, x1, max(x1) OVER (PARTITION BY {keys}, y ORDER BY x0, x1 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM (SELECT DISTINCT {keys}, y, x0, x1 FROM {src})),
{out}_i AS (SELECT *, sum(CASE WHEN x0 > reach + 1 THEN 1 ELSE 0 END) OVER (PARTITION BY {keys}, y ORDER BY x0, x1 ROWS UNBOUNDED PRECEDING) AS g FROM {out}_r),
{out} AS (SELECT {keys}, y, min(x0) AS x0, max(x1) AS x1 FROM {out}_i GROUP BY {keys}, y, g)"""


def sql_boxes(src, out):
    return f"""
{out} AS (SELECT plan_id, greatest(x0, 0) AS x0, least(x1, w - 1) AS x1, greatest(y0, 0) AS y0, least(y1, h - 1) AS y1 FROM (
 SELECT w.plan_id, f.w, f.h, CASE orientation WHEN 'horizontal' THEN s ELSE coord - thickness // 2 END::BIGINT AS x0,
  CASE orientation WHEN 'horizontal' THEN e ELSE coord - thickness // 2 + thickness - 1 END::BIGINT AS x1,
  CASE orientation WHEN 'horizontal' THEN coord - thickness // 2 ELSE s END::BIGINT AS y0,
  CASE orientation WHEN 'horizontal' THEN coord - thickness // 2 + thickness - 1 ELSE e END::BIGINT AS y1
  FROM {src} w JOIN frame f USING (plan_id)) WHERE greatest(x0, 0) <= least(x1, w - 1) AND greatest(y0, 0) <= least(y1, h - 1))"""


FRAME = "frame AS (SELECT plan_id, image_w AS w, image_h AS h FROM plans)"


def sql_raster(src, out):
    return sql_boxes(src, f"{out}_b") + f", {out}_p AS (SELECT plan_id, unnest(range(y0, y1 + 1)) AS y, x0, x1 FROM {out}_b)," + sql_merge(f"{out}_p", out)


def sql_complement(src, out, pad=0):
    return f"""
{out}_n AS (SELECT plan_id, y, x0, x1 FROM {src} UNION ALL SELECT plan_id, unnest(range({-pad}, h + {pad})) AS y, {-pad - 1}, {-pad - 1} FROM frame
 UNION ALL SELECT plan_id, unnest(range({-pad}, h + {pad})) AS y, w + {pad}, w + {pad} FROM frame),
{out}_l AS (SELECT plan_id, y, x1 + 1 AS x0, lead(x0) OVER (PARTITION BY plan_id, y ORDER BY x0) - 1 AS x1 FROM {out}_n),
{out} AS (SELECT * FROM {out}_l WHERE x0 <= x1)"""


def sql_dilate(src, out, kernel, clip=True):
    rows = ", ".join(f"({dy}, {a}, {b})" for dy, a, b in kernel)
    body = f"SELECT plan_id, y + dy AS y, x0 - a AS x0, x1 + b AS x1 FROM {src}, (VALUES {rows}) k(dy, a, b)"
    if clip:
        body = (f"SELECT plan_id, y, greatest(x0, 0) AS x0, least(x1, w - 1) AS x1 FROM ({body}) JOIN frame USING (plan_id) "
                "WHERE greatest(x0, 0) <= least(x1, w - 1) AND y >= 0 AND y < h")
    return f"{out}_k AS ({body})," + sql_merge(f"{out}_k", out)


def sql_erode(src, out, kernel, pad=0):
    mirrored = [(-dy, b, a) for dy, a, b in kernel]
    return (sql_complement(src, f"{out}_f", pad) + "," + sql_dilate(f"{out}_f", f"{out}_d", mirrored) + ","
            + sql_complement(f"{out}_d", out))


def sql_close(src, out, kernel):
    return sql_dilate(src, f"{out}_g", kernel) + "," + sql_erode(f"{out}_g", out, kernel)


def sql_open(src, out, kernel):
    return sql_erode(src, f"{out}_e", kernel) + "," + sql_dilate(f"{out}_e", out, [(-dy, b, a) for dy, a, b in kernel])


def sql_sweep(masks, out):
    """masks: {column: relation}; {out} has one boolean per mask."""
    events = " UNION ALL ".join(
        f"SELECT plan_id, y, x0 AS x, {', '.join(('1' if n == m else '0') + ' AS ' + m for m in masks)} FROM {r} UNION ALL "
        f"SELECT plan_id, y, x1 + 1, {', '.join('-1' if n == m else '0' for m in masks)} FROM {r}" for n, r in masks.items())
    sums = ", ".join(f"sum({m}) AS {m}" for m in masks)
    run = ", ".join(f"sum({m}) OVER w > 0 AS {m}" for m in masks)
    return f"""
{out}_v AS (SELECT plan_id, y, x, {sums} FROM ({events}) GROUP BY plan_id, y, x),
{out}_u AS (SELECT plan_id, y, x AS x0, lead(x) OVER w - 1 AS x1, {run} FROM {out}_v WINDOW w AS (PARTITION BY plan_id, y ORDER BY x)),
{out} AS (SELECT * FROM {out}_u WHERE x1 IS NOT NULL AND ({' OR '.join(masks)}))"""


def sql_sub(a, b, out):
    return sql_sweep({"fa": a, "fb": b}, f"{out}_s") + f", {out}_q AS (SELECT * FROM {out}_s WHERE fa AND NOT fb)," + sql_merge(f"{out}_q", out)


def sql_union(a, b, out):
    return f"{out}_q AS (SELECT plan_id, y, x0, x1 FROM {a} UNION ALL SELECT plan_id, y, x0, x1 FROM {b})," + sql_merge(f"{out}_q", out)


def digest(name):
    """Per-plan digest of a run table, so whole masks compare without shipping every run."""
    return (f" SELECT plan_id, count(*) AS runs, sum(x1 - x0 + 1)::BIGINT AS pixels, sum(y * (x0 + 1))::BIGINT AS check_start, "
            f"sum((y + 3) * (x1 + 1))::BIGINT AS check_end FROM {name} GROUP BY plan_id")


def runs_digest(boxes):
    """The digest of the runs of disjoint boxes that are as wide as the mask goes: sums over rows in closed form."""
    n = F.col("y1") - F.col("y0") + 1
    rows = F.call_function("div", n * (F.col("y0") + F.col("y1")), F.lit(2))
    return boxes.groupBy("plan_id").agg(
        F.sum(n).alias("runs"), F.sum(n * (F.col("x1") - F.col("x0") + 1)).alias("pixels"),
        F.sum(rows * (F.col("x0") + 1)).alias("check_start"), F.sum((rows + 3 * n) * (F.col("x1") + 1)).alias("check_end"))


def pixels_of(boxes, *keys):
    return boxes.groupBy(*keys).agg(F.sum((F.col("x1") - F.col("x0") + 1) * (F.col("y1") - F.col("y0") + 1)).alias("pixels"))


BASE = FRAME + "," + sql_raster("walls", "wm")
BOTH = BASE + "," + sql_raster("truth_walls", "tm")


@query("m01_rasterize_walls", "walls plans", BASE + digest("wm"))
def _(spark, sf):
    return runs_digest(M.rasterize_boxes(V.walls(spark, sf), frame(spark, sf)))


@query("m03_dilate_ellipse", "walls plans", BASE + "," + sql_dilate("wm", "dl", M.ellipse_kernel(5)) + digest("dl"))
def _(spark, sf):
    return runs_digest(M.dilate(wall_mask(spark, sf), M.ellipse_kernel(5), frame(spark, sf)))


@query("m03_erode_extend", "walls plans", BASE + "," + sql_erode("wm", "er", M.rect_kernel(3)) + digest("er"))
def _(spark, sf):
    return runs_digest(M.erode(wall_mask(spark, sf), M.rect_kernel(3), frame(spark, sf)))


@query("m03_erode_clip", "walls plans", BASE + "," + sql_erode("wm", "er", M.rect_kernel(3), 1) + digest("er"))
def _(spark, sf):
    return runs_digest(M.erode(wall_mask(spark, sf), M.rect_kernel(3), frame(spark, sf), border="clip"))


@query("m03_close_open", "walls plans", BASE + "," + sql_close("wm", "cl", M.rect_kernel(5, 2)) + "," + sql_open("cl", "op", M.rect_kernel(3)) + digest("op"))
def _(spark, sf):
    return runs_digest(M.close_open(wall_mask(spark, sf), M.rect_kernel(5, 2), M.rect_kernel(3), frame(spark, sf)))


@query("m02_line_opening", "walls plans", BASE + """,
px AS (SELECT plan_id, y, unnest(range(x0, x1 + 1)) AS x FROM wm),
vr AS (SELECT plan_id, x, y, y - row_number() OVER (PARTITION BY plan_id, x ORDER BY y) AS g FROM px),
vl AS (SELECT plan_id, x, min(y) AS y0, count(*) AS n FROM vr GROUP BY plan_id, x, g HAVING count(*) >= 60),
hz AS (SELECT plan_id, sum(x1 - x0 + 1) AS h_pixels, sum(y * x0) AS h_check FROM wm WHERE x1 - x0 + 1 >= 60 GROUP BY plan_id),
vt AS (SELECT plan_id, sum(n) AS v_pixels, sum(x * y0) AS v_check FROM vl GROUP BY plan_id)
SELECT plan_id, coalesce(h_pixels, 0)::BIGINT AS h_pixels, coalesce(h_check, 0)::BIGINT AS h_check, coalesce(v_pixels, 0)::BIGINT AS v_pixels,
 coalesce(v_check, 0)::BIGINT AS v_check FROM hz FULL JOIN vt USING (plan_id)""")
def _(spark, sf):
    mask = M.rasterize_boxes(V.walls(spark, sf), frame(spark, sf))
    tall = F.col("y1") - F.col("y0") + 1
    h = M.open_lines(mask, 60, True).groupBy("plan_id").agg(
        F.sum((F.col("x1") - F.col("x0") + 1) * tall).alias("h_pixels"), F.sum(F.call_function("div", tall * (F.col("y0") + F.col("y1")), F.lit(2)) * F.col("x0")).alias("h_check"))
    wide = F.col("x1") - F.col("x0") + 1
    v = M.open_lines(mask, 60, False).groupBy("plan_id").agg(
        F.sum((F.col("y1") - F.col("y0") + 1) * wide).alias("v_pixels"),
        F.sum((F.col("y0") * wide * (F.col("x0") + F.col("x1")) / 2)).cast("long").alias("v_check"))
    return h.join(v, "plan_id", "full").fillna(0)


@query("a09_mask_scores", "walls truth_walls plans", BOTH + "," + sql_sweep({"p": "wm", "t": "tm"}, "sw") + f""",
sm AS (SELECT plan_id, coalesce(sum(x1 - x0 + 1) FILTER (p AND t), 0)::BIGINT AS inter, sum(x1 - x0 + 1)::BIGINT AS uni, coalesce(sum(x1 - x0 + 1) FILTER (t), 0)::BIGINT AS truth_px FROM sw GROUP BY plan_id)
SELECT *, {rnd('inter / nullif(uni, 0)', 6)} AS iou, {rnd('inter / nullif(truth_px, 0)', 6)} AS recall FROM sm""")
def _(spark, sf):
    return M.mask_scores(wall_mask(spark, sf), truth_mask(spark, sf), frame(spark, sf))


@query("a10_footprint_scores", "walls truth_walls plans", FRAME + """,
we AS (SELECT * FROM walls WHERE k % 4 = 1), te AS (SELECT * FROM truth_walls WHERE k % 4 = 1),""" + sql_raster("we", "wx") + "," + sql_raster("te", "tx") + "," + sql_sweep({"p": "wx", "t": "tx"}, "sw") + f""",
sm AS (SELECT plan_id, coalesce(sum(x1 - x0 + 1) FILTER (p AND t), 0)::BIGINT AS inter, coalesce(sum(x1 - x0 + 1) FILTER (t), 0)::BIGINT AS truth_px FROM sw GROUP BY plan_id)
SELECT plan_id, {rnd('inter / nullif(truth_px, 0)', 6)} AS shell_recall FROM sm""")
def _(spark, sf):
    # the exterior shell: the walls both sources flag as exterior
    outer = [M.wall_boxes(w.filter("k % 4 = 1")) for w in (V.walls(spark, sf), V.truth_walls(spark, sf))]
    return M.mask_scores(*outer, frame(spark, sf)).select("plan_id", F.col("recall").alias("shell_recall"))


@query("a11_relaxed_scores", "walls truth_walls plans", BOTH + "," + sql_dilate("wm", "wd", M.ellipse_kernel(3)) + "," + sql_dilate("tm", "td", M.ellipse_kernel(3)) + ","
       + sql_sweep({"p": "wd", "t": "td"}, "sw") + f""" SELECT plan_id, {rnd('coalesce(sum(x1 - x0 + 1) FILTER (p AND t), 0) / sum(x1 - x0 + 1)', 6)} AS iou,
 {rnd('coalesce(sum(x1 - x0 + 1) FILTER (p AND t), 0) / nullif(sum(x1 - x0 + 1) FILTER (t), 0)', 6)} AS recall FROM sw GROUP BY plan_id""")
def _(spark, sf):
    out = M.relaxed_scores(wall_mask(spark, sf), truth_mask(spark, sf), frame(spark, sf))
    return out.select("plan_id", "iou", "recall")


@query("u03_mask_set_operations", "walls truth_walls plans", BOTH + "," + sql_sweep({"p": "wm", "t": "tm"}, "sw") + """
SELECT plan_id, sum(x1 - x0 + 1)::BIGINT AS union_px, coalesce(sum(x1 - x0 + 1) FILTER (p AND t), 0)::BIGINT AS both_px, coalesce(sum(x1 - x0 + 1) FILTER (p AND NOT t), 0)::BIGINT AS only_px
 FROM sw GROUP BY plan_id""")
def _(spark, sf):
    a, b, f = wall_mask(spark, sf), truth_mask(spark, sf), frame(spark, sf)
    parts = [pixels_of(op(a, b, f), "plan_id").withColumnRenamed("pixels", name) for op, name in ((M.union, "union_px"), (M.intersect, "both_px"), (M.subtract, "only_px"))]
    return parts[0].join(parts[1], "plan_id", "full").join(parts[2], "plan_id", "full").fillna(0)


# opening icons: a 12 x 6 box per door, 16 x 4 per window, along the opening
ICON_BOX = """
ib AS (SELECT o.plan_id, kind, greatest(x0, 0) AS x0, least(x1, w - 1) AS x1, greatest(y0, 0) AS y0, least(y1, h - 1) AS y1 FROM (SELECT plan_id, kind,
 (x - CASE WHEN orientation = 'horizontal' THEN floor(span / 2) ELSE 3 END)::BIGINT AS x0, (x + CASE WHEN orientation = 'horizontal' THEN floor(span / 2) ELSE 2 END)::BIGINT AS x1,
 (y - CASE WHEN orientation = 'horizontal' THEN 3 ELSE floor(span / 2) END)::BIGINT AS y0, (y + CASE WHEN orientation = 'horizontal' THEN 2 ELSE floor(span / 2) END)::BIGINT AS y1
 FROM openings) o JOIN frame USING (plan_id) WHERE greatest(x0, 0) <= least(x1, w - 1) AND greatest(y0, 0) <= least(y1, h - 1)),
ip AS (SELECT plan_id, kind, unnest(range(y0, y1 + 1)) AS y, x0, x1 FROM ib), dp AS (SELECT * FROM ip WHERE kind = 'door'), np AS (SELECT * FROM ip WHERE kind = 'window'),"""
ICONS = ICON_BOX + sql_merge("dp", "dm") + "," + sql_merge("np", "nm")


def icon_mask(spark, sf, kind):
    flat = "orientation = 'horizontal'"
    boxes = V.openings(spark, sf).filter(F.col("kind") == kind).selectExpr(
        "plan_id", f"cast(x - if({flat}, floor(span / 2), 3) AS bigint) AS x0", f"cast(x + if({flat}, floor(span / 2), 2) AS bigint) AS x1",
        f"cast(y - if({flat}, 3, floor(span / 2)) AS bigint) AS y0", f"cast(y + if({flat}, 2, floor(span / 2)) AS bigint) AS y1")
    return boxes


@query("m06_precedence_overlay", "walls openings plans", BASE + "," + ICONS + "," + sql_sweep({"door": "dm", "win": "nm", "wall": "wm"}, "sw") + """
SELECT plan_id, CASE WHEN door THEN 'door' WHEN win THEN 'win' ELSE 'wall' END AS cls, sum(x1 - x0 + 1)::BIGINT AS pixels FROM sw GROUP BY 1, 2""")
def _(spark, sf):
    out = M.overlay({"door": icon_mask(spark, sf, "door"), "win": icon_mask(spark, sf, "window"), "wall": wall_mask(spark, sf)}, frame(spark, sf))
    return pixels_of(out, "plan_id", "cls")


@query("f13_eraser", "walls openings plans", BASE + "," + ICONS + "," + sql_union("dm", "nm", "er") + "," + sql_sub("wm", "er", "cut") + digest("cut"))
def _(spark, sf):
    return runs_digest(cut_mask(spark, sf))


def cut_mask(spark, sf):
    """Walls without the openings."""
    return M.subtract(wall_mask(spark, sf), erasers(spark, sf), frame(spark, sf))


def erasers(spark, sf):
    return icon_mask(spark, sf, "door").unionByName(icon_mask(spark, sf, "window"))


@query("m05_paint_rules", "walls plans", FRAME + """,
dw AS (SELECT * FROM walls WHERE k % 3 = 0), ow AS (SELECT * REPLACE (CASE WHEN k % 2 = 0 THEN thickness ELSE 8 END AS thickness) FROM walls WHERE k % 3 <> 0),"""
       + sql_raster("dw", "dk") + "," + sql_raster("ow", "og") + "," + sql_open("og", "thick", M.rect_kernel(6)) + ","
       + sql_union("dk", "thick", "pw") + "," + sql_sub("og", "thick", "pd") + """
SELECT plan_id, 'wall' AS cls, sum(x1 - x0 + 1)::BIGINT AS pixels FROM pw GROUP BY plan_id UNION ALL SELECT plan_id, 'door', sum(x1 - x0 + 1)::BIGINT FROM pd GROUP BY plan_id""")
def _(spark, sf):
    f = frame(spark, sf)
    walls = V.walls(spark, sf)
    dark = M.wall_boxes(walls.filter("k % 3 = 0"))
    orange = M.wall_boxes(walls.filter("k % 3 <> 0").withColumn("thickness", F.expr("if(k % 2 = 0, thickness, 8D)")))
    wall, door = M.split_paint(dark, orange, f)
    return pixels_of(wall, "plan_id").withColumn("cls", F.lit("wall")).unionByName(pixels_of(door, "plan_id").withColumn("cls", F.lit("door")))


@query("m05_paint_colors", "pixels", """SELECT image_id, count(*) FILTER (r < 80 AND g < 80 AND b < 80) AS dark, count(*) FILTER (r > 130 AND r - b > 80 AND g < 160) AS orange FROM pixels GROUP BY image_id""")
def _(spark, sf):
    rgb = F.col("r"), F.col("g"), F.col("b")
    return V.pixels(spark, sf).groupBy("image_id").agg(F.count_if(M.is_dark_wall(*rgb)).alias("dark"), F.count_if(M.is_orange(*rgb)).alias("orange"))


PALETTE = ", ".join(f"({i}, {c[0]}, {c[1]}, {c[2]}, {cls})" for i, (c, cls) in enumerate(M.ROOM_COLORS))


@query("m04_nearest_color", "pixels", f"""
nc AS (SELECT image_id, px, arg_min(cls, ((r - cr) * (r - cr) + (g - cg) * (g - cg) + (b - cb) * (b - cb), i)) AS cls FROM pixels, (VALUES {PALETTE}) t(i, cr, cg, cb, cls) GROUP BY image_id, px)
SELECT image_id, cls, count(*) AS n FROM nc GROUP BY ALL""")
def _(spark, sf):
    cls = M.nearest_color(F.col("r"), F.col("g"), F.col("b"), M.ROOM_COLORS)
    return V.pixels(spark, sf).groupBy("image_id", cls.alias("cls")).agg(F.count(F.lit(1)).alias("n"))


@query("m07_skeleton_channels", "pixel_grid", """
nb AS (SELECT p.image_id, p.x, p.y, sum(CASE WHEN q.x = p.x + 1 AND q.y = p.y THEN 1 WHEN q.x = p.x AND q.y = p.y + 1 THEN 2 WHEN q.x = p.x - 1 AND q.y = p.y THEN 4 ELSE 8 END) AS bits
 FROM pixel_grid p JOIN pixel_grid q ON p.image_id = q.image_id AND abs(p.x - q.x) + abs(p.y - q.y) = 1 WHERE p.x BETWEEN 1 AND 62 AND p.y BETWEEN 1 AND 62 GROUP BY ALL)
SELECT image_id, x, y, CASE bits WHEN 1 THEN 0 WHEN 2 THEN 1 WHEN 4 THEN 2 WHEN 8 THEN 3 WHEN 9 THEN 4 WHEN 3 THEN 5 WHEN 6 THEN 6 WHEN 12 THEN 7 WHEN 7 THEN 8 WHEN 14 THEN 9 WHEN 13 THEN 10 WHEN 11 THEN 11 ELSE 12 END AS channel
 FROM nb WHERE bits NOT IN (5, 10)""")
def _(spark, sf):
    return M.skeleton_channels(V.pixel_grid(spark, sf), 64, 64)


@query("m08_junction_degrees", "pixel_grid", """
nb AS (SELECT p.image_id, p.x, p.y, count(*) AS n FROM pixel_grid p JOIN pixel_grid q ON p.image_id = q.image_id AND greatest(abs(p.x - q.x), abs(p.y - q.y)) = 1
 WHERE p.x BETWEEN 1 AND 62 AND p.y BETWEEN 1 AND 62 GROUP BY ALL)
SELECT image_id, x, y, least(n - 2, 2) AS channel FROM nb WHERE n >= 2""")
def _(spark, sf):
    return M.junction_degrees(V.pixel_grid(spark, sf), 64, 64)


@query("m11_closed_mask", "walls openings plans", BASE + "," + ICONS + "," + sql_close("wm", "cw", M.rect_kernel(5, 2)) + ", th AS (SELECT * REPLACE (14 AS thickness) FROM walls WHERE k % 5 = 0),"
       + sql_raster("th", "tk") + "," + sql_union("dm", "nm", "ic") + "," + sql_union("cw", "tk", "c1") + "," + sql_union("c1", "ic", "closed") + digest("closed"))
def _(spark, sf):
    masks, rule, reach = closed_rooms(spark, sf)
    return runs_digest(sheets.drawn(masks, frame(spark, sf), rule, reach))


def closed_rooms(spark, sf):
    """Walls closed by 5 x 5 twice, annotated walls at 14 pixels, openings painted shut: masks, rule and reach."""
    thick = M.wall_boxes(V.walls(spark, sf).filter("k % 5 = 0").withColumn("thickness", F.lit(14.0)))
    icons = icon_mask(spark, sf, "door").unionByName(icon_mask(spark, sf, "window"))
    return M.close_rooms(wall_mask(spark, sf), thick, icons)


CLOSED = BASE + "," + ICONS + "," + sql_close("wm", "cw", M.rect_kernel(5, 2)) + ", th AS (SELECT * REPLACE (14 AS thickness) FROM walls WHERE k % 5 = 0)," + sql_raster("th", "tk") + "," + sql_union("dm", "nm", "ic") + "," + sql_union("cw", "tk", "c1") + "," + sql_union("c1", "ic", "closed")


@query("a32_color_coded", "pixels", """SELECT image_id, count(*) FILTER (g > 140 AND r < 130 AND b < 130) AS green, count(*) FILTER (b > 140 AND g < 150 AND r < 130) AS blue,
 count(*) FILTER (g > 140 AND r < 130 AND b < 130) + count(*) FILTER (b > 140 AND g < 150 AND r < 130) > 50 AS color_coded FROM pixels GROUP BY image_id""")
def _(spark, sf):
    return M.color_coded(V.pixels(spark, sf))


@query("a33_otsu", "pixels", f"""
hs AS (SELECT image_id, (r + g + b) // 3 AS v, count(*) AS n FROM pixels GROUP BY ALL),
cm AS (SELECT *, sum(n) OVER w AS w0, sum(n * v) OVER w AS s0, sum(n) OVER (PARTITION BY image_id) AS total, sum(n * v) OVER (PARTITION BY image_id) AS sm FROM hs WINDOW w AS (PARTITION BY image_id ORDER BY v)),
va AS (SELECT *, CASE WHEN total - w0 > 0 THEN {rnd('w0 * (total - w0) * (s0 / w0 - (sm - s0) / (total - w0)) * (s0 / w0 - (sm - s0) / (total - w0))', 3)} ELSE 0 END AS vr FROM cm)
SELECT image_id, arg_min(v, (-vr, v)) AS threshold, arg_min(w0, (-vr, v))::BIGINT AS dark, arg_min(w0, (-vr, v)) / any_value(total) > 0.5 AS inverted FROM va GROUP BY image_id""")
def _(spark, sf):
    return M.otsu(V.pixels(spark, sf).selectExpr("image_id", "cast(floor((r + g + b) / 3) AS int) AS v"))
