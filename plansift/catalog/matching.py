"""Matching queries."""

import re

from pyspark.sql import functions as F

from plansift import views as V
from plansift.catalog.cleaning import base, sql_junctions
from plansift.catalog.masks import BASE, FRAME, ICONS, erasers, frame, sql_raster, sql_sub, sql_sweep, sql_union, truth_mask, wall_mask
from plansift.catalog.openings import SQL_FINAL, final_walls
from plansift.catalog.registry import query, rnd
from plansift.operators import config, intervals as I, junctions as J, masks as M, matching as X, nearest as N
from plansift.functions.numeric import round_to


def numbered_junctions(walls):
    return J.numbered_junctions(config.with_default_config(walls))


GREEDY = f"""
ls AS (SELECT plan_id, list([{{'p': p_ord, 'e': e_ord}}] ORDER BY p_ord, score, e_ord) AS items FROM pr GROUP BY plan_id),
fd AS (SELECT plan_id, len(list_reduce(items, lambda acc, x: CASE WHEN len(list_filter(acc, lambda m: m.p = x[1].p OR m.e = x[1].e)) = 0 THEN list_concat(acc, x) ELSE acc END)) AS n FROM ls),
cp AS (SELECT plan_id, count(*) AS n FROM pd GROUP BY plan_id), ce AS (SELECT plan_id, count(*) AS n FROM td GROUP BY plan_id),
al AS (SELECT plan_id, coalesce(cp.n, 0) AS predicted, coalesce(ce.n, 0) AS expected, coalesce(fd.n, 0) AS matches FROM cp FULL JOIN ce USING (plan_id) LEFT JOIN fd USING (plan_id))
SELECT plan_id, predicted, expected, matches,
 {rnd("CASE WHEN predicted > 0 THEN matches / predicted WHEN expected = 0 THEN 1.0::DOUBLE ELSE 0 END", 6)} AS precision,
 {rnd("CASE WHEN expected > 0 THEN matches / expected WHEN predicted = 0 THEN 1.0::DOUBLE ELSE 0 END", 6)} AS recall FROM al"""


@query("j21_junction_match", "walls truth_walls", sql_junctions("walls", "p") + "," + sql_junctions("truth_walls", "t") + """,
pd AS (SELECT *, row_number() OVER (PARTITION BY plan_id ORDER BY x, y) AS ord FROM p), td AS (SELECT *, row_number() OVER (PARTITION BY plan_id ORDER BY x, y) AS ord FROM t),
pr AS (SELECT pd.plan_id, pd.ord AS p_ord, td.ord AS e_ord, sqrt((pd.x - td.x) * (pd.x - td.x) + (pd.y - td.y) * (pd.y - td.y)) AS score FROM pd JOIN td ON pd.plan_id = td.plan_id AND pd.type = td.type
 AND sqrt((pd.x - td.x) * (pd.x - td.x) + (pd.y - td.y) * (pd.y - td.y)) <= 12),""" + GREEDY)
def _(spark, sf):
    from plansift.session import keep_rows
    pred, truth = (keep_rows(numbered_junctions(w)) for w in (V.walls(spark, sf), V.truth_walls(spark, sf)))
    return X.match_metrics(pred, truth, X.greedy_match(X.junction_pairs(pred, truth)))


@query("j21_junction_pairs", "walls truth_walls", sql_junctions("walls", "p") + "," + sql_junctions("truth_walls", "t") + """
SELECT p.plan_id, count(*) AS n FROM p JOIN t ON p.plan_id = t.plan_id AND p.type = t.type AND (p.x - t.x) * (p.x - t.x) + (p.y - t.y) * (p.y - t.y) <= 144 GROUP BY p.plan_id""")
def _(spark, sf):
    pairs = X.junction_pairs(numbered_junctions(V.walls(spark, sf)), numbered_junctions(V.truth_walls(spark, sf)))
    return pairs.groupBy("plan_id").agg(F.count(F.lit(1)).alias("n"))


def opening_sides(spark, sf):
    pred = V.openings(spark, sf)
    truth = pred.filter("k % 10 <> 0").withColumns({"x": F.col("x") + F.col("k") % 7, "span": F.col("span") + F.col("k") % 5})
    return pred, truth


# an opening's wall is the first that runs through its middle
OPENING_WALL = """
ow AS (SELECT o.plan_id, o.ord, min_by(w.wall_id, w.ord) AS wall_id FROM openings o JOIN walls w ON w.plan_id = o.plan_id AND w.orientation = o.orientation
 AND w.coord = CASE o.orientation WHEN 'horizontal' THEN o.y ELSE o.x END AND CASE o.orientation WHEN 'horizontal' THEN o.x ELSE o.y END BETWEEN w.s AND w.e GROUP BY o.plan_id, o.ord)"""


def openings_with_walls(spark, sf):
    found = V.openings(spark, sf)
    flat = F.col("o.orientation") == "horizontal"
    along, cross = F.when(flat, F.col("o.x")).otherwise(F.col("o.y")), F.when(flat, F.col("o.y")).otherwise(F.col("o.x"))
    on = found.alias("o").join(V.walls(spark, sf).alias("w"), (F.col("o.plan_id") == F.col("w.plan_id")) & (F.col("o.orientation") == F.col("w.orientation")) & (cross == F.col("w.coord"))
                               & along.between(F.col("w.s"), F.col("w.e")))
    first = F.min_by(F.struct("w.orientation", "w.coord", "w.s", "w.e", "w.thickness"), "w.ord")
    return on.groupBy("o.plan_id", "o.ord", "o.x", "o.y", "o.span").agg(first.alias("wall")).select("plan_id", "ord", "x", "y", "span", "wall.*")


@query("j22_opening_match", "openings walls truth_walls plans", FRAME + "," + sql_raster("truth_walls", "tm") + "," + OPENING_WALL + """,
pd AS (SELECT * FROM openings), td AS (SELECT * REPLACE (x + k % 7 AS x, span + k % 5 AS span) FROM openings WHERE k % 10 <> 0),
pq AS (SELECT p.plan_id, p.ord AS p_ord, t.ord AS e_ord, sqrt((p.x - t.x) * (p.x - t.x) + (p.y - t.y) * (p.y - t.y)) AS d, abs(p.span - t.span) / greatest(p.span, t.span) AS er, greatest(p.span, t.span) AS m
 FROM pd p JOIN td t ON p.plan_id = t.plan_id AND p.kind = t.kind),
pr AS (SELECT plan_id, p_ord, e_ord, d + er * 10 AS score FROM pq WHERE d <= greatest(12, m * 0.75) AND er <= 0.5),""" + GREEDY.replace(
    "AS n FROM ls)", "AS n, list_reduce(items, lambda acc, x: CASE WHEN len(list_filter(acc, lambda m: m.p = x[1].p OR m.e = x[1].e)) = 0 THEN list_concat(acc, x) ELSE acc END) AS got FROM ls)").replace(
    "\nSELECT plan_id, predicted", """,
mp AS (SELECT plan_id, unnest(got).p AS ord FROM fd),
wr AS (SELECT o.plan_id, o.ord, greatest(3, w.thickness::BIGINT) AS need, greatest(8, o.span::BIGINT) AS r, o.x::BIGINT AS cx, o.y::BIGINT AS cy, w.orientation = 'horizontal' AS flat,
 w.coord::BIGINT - w.thickness::BIGINT // 2 AS lo, w.thickness::BIGINT AS t, w.s::BIGINT AS s, w.e::BIGINT AS e FROM openings o JOIN mp USING (plan_id, ord) JOIN ow USING (plan_id, ord) JOIN walls w ON w.plan_id = o.plan_id AND w.wall_id = ow.wall_id),
wb AS (SELECT plan_id, ord, need, greatest(CASE WHEN flat THEN s ELSE lo END, cx - r) AS ax, least(CASE WHEN flat THEN e ELSE lo + t - 1 END, cx + r) AS bx,
 greatest(CASE WHEN flat THEN lo ELSE s END, cy - r) AS ay, least(CASE WHEN flat THEN lo + t - 1 ELSE e END, cy + r) AS by_ FROM wr),
an AS (SELECT plan_id, count(*) AS anchored FROM (SELECT wb.plan_id, ord FROM wb JOIN tm ON tm.plan_id = wb.plan_id AND tm.y BETWEEN ay AND by_ AND tm.x0 <= bx AND tm.x1 >= ax
 GROUP BY wb.plan_id, ord, need HAVING sum(least(bx, x1) - greatest(ax, x0) + 1) >= need) GROUP BY plan_id)
SELECT plan_id, predicted""").replace(" AS recall FROM al", f""" AS recall, coalesce(anchored, 0) AS anchored,
 {rnd("CASE WHEN predicted > 0 THEN coalesce(anchored, 0) / predicted WHEN expected = 0 THEN 1.0::DOUBLE ELSE 0 END", 6)} AS anchor_precision FROM al LEFT JOIN an USING (plan_id)"""))
def _(spark, sf):
    pred, truth = opening_sides(spark, sf)
    supported = X.drawn_support(openings_with_walls(spark, sf), truth_mask(spark, sf), frame(spark, sf))
    return X.opening_metrics(pred, truth, X.greedy_match(X.opening_pairs(pred, truth)), supported)


@query("j22_opening_pairs", "openings", f"""
tr AS (SELECT * REPLACE (x + k % 7 AS x, span + k % 5 AS span) FROM openings WHERE k % 10 <> 0),
pr AS (SELECT p.plan_id, sqrt((p.x - t.x) * (p.x - t.x) + (p.y - t.y) * (p.y - t.y)) AS d, abs(p.span - t.span) / greatest(p.span, t.span) AS er, greatest(p.span, t.span) AS m FROM openings p JOIN tr t ON p.plan_id = t.plan_id AND p.kind = t.kind)
SELECT plan_id, count(*) AS n, {rnd('sum(d + er * 10)', 4)} AS total FROM pr WHERE d <= greatest(12, m * 0.75) AND er <= 0.5 GROUP BY plan_id""")
def _(spark, sf):
    return X.opening_pairs(*opening_sides(spark, sf)).groupBy("plan_id").agg(F.count(F.lit(1)).alias("n"), round_to(F.sum("score"), 4).alias("total"))


EXT = """
sp AS (SELECT plan_id, orientation, min(coord) AS lo, max(coord) AS hi FROM walls GROUP BY ALL),
bn AS (SELECT w.*, lo, hi, CASE WHEN hi > lo THEN (hi - lo) * 0.1::DOUBLE ELSE 20 END AS band FROM walls w JOIN sp USING (plan_id, orientation)),
ex AS (SELECT *, 'low' AS edge FROM bn WHERE coord <= lo + band UNION ALL SELECT *, 'high' FROM bn WHERE coord >= hi - band)"""


@query("a29_exterior_by_extremes", "walls", EXT + " SELECT plan_id, wall_id, edge FROM ex")
def _(spark, sf):
    return X.exterior_by_extremes(V.walls(spark, sf)).select("plan_id", "wall_id", "edge")


@query("a30_centroid", "walls", f"""SELECT plan_id, {rnd("avg(CASE orientation WHEN 'horizontal' THEN (s + e) / 2 ELSE coord END)", 6)} AS cx, {rnd("avg(CASE orientation WHEN 'horizontal' THEN coord ELSE (s + e) / 2 END)", 6)} AS cy,
 max(CASE orientation WHEN 'horizontal' THEN e ELSE coord END) - min(CASE orientation WHEN 'horizontal' THEN s ELSE coord END) AS width FROM walls GROUP BY plan_id""")
def _(spark, sf):
    return X.centroid(V.walls(spark, sf))


ASSIGN = EXT + """,
sg AS (SELECT DISTINCT plan_id, ord AS seg_id, orientation, coord, s, e FROM ex),
wa AS (SELECT o.plan_id, opening_id, g.seg_id, CASE g.orientation WHEN 'horizontal' THEN o.x ELSE o.y END AS along, abs(CASE g.orientation WHEN 'horizontal' THEN o.y ELSE o.x END - coord) AS diff,
 CASE WHEN g.orientation <> o.orientation THEN 4 ELSE 0 END AS pen, s, e FROM openings o JOIN sg g ON o.plan_id = g.plan_id WHERE kind = 'window'),
asg AS (SELECT plan_id, opening_id, arg_min(seg_id, (diff + pen, seg_id)) AS seg_id, arg_min(along, (diff + pen, seg_id)) AS center, min(diff + pen) AS score FROM wa WHERE diff <= 20 AND along BETWEEN s - 10 AND e + 10 GROUP BY ALL)"""


def segments(spark, sf):
    return X.exterior_by_extremes(V.walls(spark, sf)).select("plan_id", F.col("ord").alias("seg_id"), "orientation", "coord", "s", "e").distinct()


def assigned(spark, sf):
    return X.assign_windows(V.openings(spark, sf).filter("kind = 'window'"), segments(spark, sf))


@query("j11_windows_to_segments", "walls openings", ASSIGN + " SELECT * FROM asg")
def _(spark, sf):
    return assigned(spark, sf)


CHAIN = ASSIGN + """,
pt AS (SELECT plan_id, seg_id, 0 AS part, s AS p FROM sg WHERE (plan_id, seg_id) IN (SELECT plan_id, seg_id FROM asg) UNION ALL SELECT plan_id, seg_id, 2, e FROM sg WHERE (plan_id, seg_id) IN (SELECT plan_id, seg_id FROM asg)
 UNION ALL SELECT plan_id, seg_id, 1, center FROM asg),
sx AS (SELECT plan_id, seg_id, abs(lead(p) OVER (PARTITION BY plan_id, seg_id ORDER BY part, p) - p) AS step FROM pt),
cs AS (SELECT plan_id, seg_id, coalesce(sum(step) FILTER (step >= 2), 0) AS generated, coalesce(sum(step) FILTER (step < 2), 0) AS skipped, count(*) FILTER (step >= 2) AS n_dims FROM sx WHERE step IS NOT NULL GROUP BY ALL),
ch AS (SELECT plan_id, seg_id, generated, skipped, n_dims, abs(abs(e - s) - (generated + skipped)) AS closure_error, abs(abs(e - s) - generated) AS gap FROM cs JOIN sg USING (plan_id, seg_id)),
cz AS (SELECT *, CASE WHEN closure_error > 1 THEN 'fail' WHEN gap <= 1 THEN 'pass' ELSE 'warn' END AS status FROM ch)"""


def chains(spark, sf):
    return I.chain_lengths(segments(spark, sf), assigned(spark, sf))


@query("w10_dimension_chain", "walls openings", CHAIN + " SELECT * FROM cz")
def _(spark, sf):
    return chains(spark, sf).select("plan_id", "seg_id", "generated", "skipped", "n_dims", "closure_error", "gap", "status")


@query("a28_chain_audit", "walls openings", CHAIN + """ SELECT plan_id, count(*) AS audited, count(*) FILTER (status = 'pass') AS passed, count(*) FILTER (status = 'warn') AS warned, count(*) FILTER (status = 'fail') AS failed,
 max(gap) AS max_gap, max(closure_error) AS max_closure_error FROM cz GROUP BY plan_id""")
def _(spark, sf):
    return X.audit_rollup(chains(spark, sf))


@query("j12_openings_on_walls", "walls openings", """SELECT o.plan_id, opening_id, wall_id FROM openings o JOIN walls w ON o.plan_id = w.plan_id AND o.orientation = w.orientation
 AND CASE o.orientation WHEN 'horizontal' THEN o.x ELSE o.y END BETWEEN s - 8 AND e + 8 AND abs(CASE o.orientation WHEN 'horizontal' THEN o.y ELSE o.x END - coord) < 8""")
def _(spark, sf):
    return X.openings_on_walls(V.openings(spark, sf), V.walls(spark, sf))


@query("j13_parent_wall", "walls openings", """
c AS (SELECT o.plan_id, opening_id, w.wall_id, w.ord, coord, least(CASE o.orientation WHEN 'horizontal' THEN o.x ELSE o.y END + span / 2, e) - greatest(CASE o.orientation WHEN 'horizontal' THEN o.x ELSE o.y END - span / 2, s) AS overlap
 FROM openings o JOIN walls w ON o.plan_id = w.plan_id AND o.orientation = w.orientation AND abs(CASE o.orientation WHEN 'horizontal' THEN o.y ELSE o.x END - coord) <= 6 WHERE kind = 'window')
SELECT plan_id, opening_id, arg_max(wall_id, (overlap, -ord)) AS wall_id, max(overlap) AS overlap, arg_max(coord, (overlap, -ord)) - 2 AS edge_low, arg_max(coord, (overlap, -ord)) + 2 AS edge_high FROM c WHERE overlap > 0 GROUP BY ALL""")
def _(spark, sf):
    return X.parent_walls(V.openings(spark, sf).filter("kind = 'window'"), V.walls(spark, sf))


@query("j14_thickness_from_region", "walls openings", """
mid AS (SELECT plan_id, ord, thickness, CASE orientation WHEN 'horizontal' THEN (s + e) / 2 ELSE coord END AS mx, CASE orientation WHEN 'horizontal' THEN coord ELSE (s + e) / 2 END AS my FROM walls),
md AS (SELECT plan_id, quantile_cont(thickness, 0.5) AS m FROM walls GROUP BY plan_id),
n AS (SELECT o.plan_id, o.opening_id, arg_min(thickness, (abs(x - mx) + abs(y - my), ord2)) AS t FROM openings o JOIN (SELECT *, ord AS ord2 FROM mid) w ON o.plan_id = w.plan_id GROUP BY ALL)
SELECT n.plan_id, opening_id, CASE WHEN t > m THEN 6.0::DOUBLE ELSE 4.0::DOUBLE END AS thickness FROM n JOIN md USING (plan_id)""")
def _(spark, sf):
    walls = V.walls(spark, sf)
    flat = F.col("orientation") == "horizontal"
    mid = (F.col("s") + F.col("e")) / 2
    targets = walls.select("plan_id", "thickness", F.col("ord").alias("tord"), F.when(flat, mid).otherwise(F.col("coord")).alias("tx"), F.when(flat, F.col("coord")).otherwise(mid).alias("ty"))
    hit = N.nearest_point(V.openings(spark, sf), targets, ["plan_id", "opening_id"], F.col("thickness"), None)
    median = walls.groupBy("plan_id").agg(F.percentile("thickness", 0.5).alias("m"))
    return hit.join(median, "plan_id").select("plan_id", "opening_id", F.when(F.col("hit.payload") > F.col("m"), 6.0).otherwise(4.0).alias("thickness"))


def sql_resolve(mode):
    return f"""
nr AS (SELECT plan_id, greatest(6.0::DOUBLE, max(thickness / 2) * 3) AS near FROM walls GROUP BY plan_id),
en AS (SELECT w.*, near, t.side, CASE t.side WHEN 'lo' THEN s ELSE e END AS pos_ FROM walls w JOIN nr USING (plan_id), (VALUES ('lo'), ('hi')) t(side)),
ht AS (SELECT a.plan_id, a.wall_id, a.orientation, a.side, b.ord AS o_ord, b.coord AS o_mid, b.thickness / 2 AS o_half, abs(b.s - a.coord) <= near OR abs(b.e - a.coord) <= near AS corner
 FROM en a JOIN walls b ON a.plan_id = b.plan_id AND a.orientation <> b.orientation AND abs(a.pos_ - b.coord) <= near AND a.coord BETWEEN b.s - near AND b.e + near),
fs AS (SELECT plan_id, wall_id, orientation, side, arg_min({{'m': o_mid, 'h': o_half, 'c': corner}}, o_ord) AS f FROM ht GROUP BY ALL),
mv AS (SELECT plan_id, wall_id, side, f.m + (CASE side WHEN 'hi' THEN 1 ELSE -1 END) * (CASE WHEN CASE WHEN f.c THEN orientation = 'horizontal' ELSE {mode} END THEN 1 ELSE -1 END) * f.h AS to_ FROM fs)
SELECT w.plan_id, w.wall_id, coalesce(max(to_) FILTER (side = 'lo'), any_value(s)) AS lo, coalesce(max(to_) FILTER (side = 'hi'), any_value(e)) AS hi FROM walls w LEFT JOIN mv USING (plan_id, wall_id) GROUP BY w.plan_id, w.wall_id"""


def resolver_input(spark, sf):
    return V.walls(spark, sf).select("plan_id", "wall_id", "ord", "orientation", F.col("coord").alias("mid"), F.col("s").alias("lo"), F.col("e").alias("hi"), (F.col("thickness") / 2).alias("half"))


@query("j15_resolve_canvas", "walls", sql_resolve("true"))
def _(spark, sf):
    return X.resolve_junctions(resolver_input(spark, sf), "canvas").select("plan_id", "wall_id", "lo", "hi")


@query("j15_resolve_drawing", "walls", sql_resolve("false"))
def _(spark, sf):
    return X.resolve_junctions(resolver_input(spark, sf), "dxf").select("plan_id", "wall_id", "lo", "hi")


@query("w05_merge_exterior", "walls", EXT + """,
sg AS (SELECT DISTINCT plan_id, orientation, coord, s, ord, e, CASE WHEN k % 7 = 0 THEN 'mask' ELSE 'annotation' END AS source FROM ex),
ls AS (SELECT plan_id, orientation, list([{'coord': coord, 's': s, 'e': e, 'source': source}] ORDER BY coord, s, ord) AS items FROM sg GROUP BY ALL),
fd AS (SELECT plan_id, orientation, list_reduce(items, lambda acc, x: CASE WHEN abs(x[1].coord - acc[-1].coord) <= 3 AND x[1].s <= acc[-1].e + 5 AND x[1].source = acc[-1].source
 THEN list_concat(acc[:-2], [{'coord': (acc[-1].coord + x[1].coord) / 2, 's': least(acc[-1].s, x[1].s), 'e': greatest(acc[-1].e, x[1].e), 'source': acc[-1].source}]) ELSE list_concat(acc, x) END) AS items FROM ls),
fl AS (SELECT plan_id, orientation, unnest(items) AS g FROM fd)
SELECT plan_id, orientation, """ + rnd("g.coord", 6) + " AS coord, g.s AS s, g.e AS e, g.source AS source FROM fl")
def _(spark, sf):
    rows = X.exterior_by_extremes(V.walls(spark, sf)).withColumn("source", F.when(F.col("k") % 7 == 0, "mask").otherwise("annotation"))
    return I.fold_exterior(rows.select("plan_id", "orientation", "coord", "s", "ord", "e", "source").distinct())


@query("w06_merge_mask_walls", "walls", """
ls AS (SELECT plan_id, orientation, list([{'coord': coord::BIGINT, 's': s::BIGINT, 'e': e::BIGINT}] ORDER BY coord, s, ord) AS items FROM walls GROUP BY ALL),
fd AS (SELECT plan_id, orientation, list_reduce(items, lambda acc, x: CASE
  WHEN len(list_filter(acc, lambda m: abs(x[1].coord - m.coord) < 16 AND x[1].s <= m.e + 15 AND x[1].e >= m.s - 15)) = 0 THEN list_concat(acc, x)
  ELSE list_transform(acc, lambda m, i: CASE WHEN i = list_position(list_transform(acc, lambda q: abs(x[1].coord - q.coord) < 16 AND x[1].s <= q.e + 15 AND x[1].e >= q.s - 15), true)
   THEN {'coord': (x[1].coord + m.coord) // 2, 's': least(x[1].s, m.s), 'e': greatest(x[1].e, m.e)} ELSE m END) END) AS items FROM ls),
fl AS (SELECT plan_id, orientation, unnest(items) AS g FROM fd)
SELECT plan_id, orientation, g.coord AS coord, g.s AS s, g.e AS e FROM fl""")
def _(spark, sf):
    return X.merge_mask_walls(V.walls(spark, sf))


def sql_spans(src, out):
    """Maximal spans of (plan_id, coord, s, e) in SQL."""
    return f"""
{out}_r AS (SELECT *, max(e) OVER (PARTITION BY plan_id, coord ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM {src}),
{out}_i AS (SELECT *, sum(CASE WHEN s > reach THEN 1 ELSE 0 END) OVER (PARTITION BY plan_id, coord ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS g FROM {out}_r),
{out} AS (SELECT plan_id, coord, min(s) AS s, max(e) AS e FROM {out}_i GROUP BY plan_id, coord, g)"""


@query("j23_merge_shared_walls", "walls", "sv AS (SELECT plan_id, floor(coord / 4) * 4 + 4 * (k % 2) AS coord, s, e FROM walls WHERE orientation = 'vertical')," + sql_spans("sv", "m1") + """,
ln AS (SELECT plan_id, coord, list({'s': s, 'e': e} ORDER BY s, e) AS spans FROM m1 GROUP BY ALL),
ls AS (SELECT plan_id, list([{'coord': coord, 'spans': spans}] ORDER BY coord) AS items FROM ln GROUP BY plan_id),
fd AS (SELECT plan_id, unnest(list_reduce(items, lambda acc, x: CASE WHEN x[1].coord - acc[-1].coord = 4 AND len(list_filter(acc[-1].spans, lambda a: len(list_filter(x[1].spans, lambda b: a.s < b.e AND b.s < a.e)) > 0)) > 0
 THEN list_concat(acc[:-2], [{'coord': x[1].coord, 'spans': list_concat(x[1].spans, acc[-1].spans)}]) ELSE list_concat(acc, x) END)) AS g FROM ls),
f2 AS (SELECT plan_id, g.coord AS coord, unnest(g.spans) AS sp FROM fd), f3 AS (SELECT plan_id, coord, sp.s AS s, sp.e AS e FROM f2),""" + sql_spans("f3", "m2") + " SELECT plan_id, coord, s, e FROM m2")
def _(spark, sf):
    spans = V.walls(spark, sf).filter("orientation = 'vertical'").withColumn("coord", F.floor(F.col("coord") / 4) * 4.0 + 4 * (F.col("k") % 2))
    return X.merge_shared_walls(spans.select("plan_id", "coord", "s", "e"))


@query("w15_wall_gaps", "walls openings plans", BASE + "," + ICONS + "," + sql_union("dm", "nm", "er") + "," + sql_sub("wm", "er", "cut") + """,
st AS (SELECT plan_id, wall_id, orientation, coord::BIGINT AS c0, (coord + thickness - 1)::BIGINT AS c1, s::BIGINT AS lo, e::BIGINT AS hi FROM walls),
sq AS (SELECT *, (c0 + c1) // 2 - greatest(3, c1 - c0 + 2) AS near, (c0 + c1) // 2 + greatest(3, c1 - c0 + 2) AS far FROM st),
ph AS (SELECT sq.plan_id, wall_id, lo, hi, greatest(lo, x0) AS r0, least(hi, x1) AS r1 FROM sq JOIN cut ON cut.plan_id = sq.plan_id AND orientation = 'horizontal' AND y BETWEEN near AND far AND x0 <= hi AND x1 >= lo
 UNION ALL SELECT sq.plan_id, wall_id, lo, hi, y, y FROM sq JOIN cut ON cut.plan_id = sq.plan_id AND orientation = 'vertical' AND y BETWEEN lo AND hi AND x0 <= far AND x1 >= near),
pr AS (SELECT plan_id, wall_id, lo, hi, r0, max(r1) AS r1 FROM ph GROUP BY ALL),
pi AS (SELECT *, max(r1) OVER (PARTITION BY plan_id, wall_id ORDER BY r0 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM pr),
pj AS (SELECT *, sum(CASE WHEN r0 > reach + 1 THEN 1 ELSE 0 END) OVER (PARTITION BY plan_id, wall_id ORDER BY r0 ROWS UNBOUNDED PRECEDING) AS g FROM pi),
pk AS (SELECT plan_id, wall_id, lo, hi, min(r0) AS a, max(r1) AS b FROM pj GROUP BY plan_id, wall_id, lo, hi, g),
gz AS (SELECT plan_id, wall_id, lo, hi, b + 1 AS g0, coalesce(lead(a) OVER (PARTITION BY plan_id, wall_id ORDER BY a), hi + 1) AS g1 FROM pk
 UNION ALL SELECT plan_id, wall_id, lo, hi, lo, min(a) FROM pk GROUP BY plan_id, wall_id, lo, hi)
SELECT plan_id, wall_id, g0 - lo AS gap_start, g1 - lo AS gap_end FROM gz WHERE g1 - g0 >= 12 AND g0 - lo >= 8 AND hi + 1 - g1 >= 8""")
def _(spark, sf):
    walls = V.walls(spark, sf).selectExpr("plan_id", "wall_id", "orientation", "cast(coord AS bigint) AS c0", "cast(coord + thickness - 1 AS bigint) AS c1", "s", "e")
    masks = {"walls": wall_mask(spark, sf), "erasers": erasers(spark, sf)}
    return X.wall_gaps(walls, masks, frame(spark, sf), lambda s: s.minus(s["walls"], s["erasers"]))


@query("j25_stage_comparison", "walls truth_walls plans", FRAME + ", le AS (SELECT * FROM walls WHERE k % 4 = 1), re AS (SELECT * FROM truth_walls WHERE k % 4 = 1)," + sql_raster("walls", "lm") + "," + sql_raster("truth_walls", "rm") + ","
       + sql_raster("le", "lx") + "," + sql_raster("re", "rx") + "," + sql_sweep({"p": "lm", "t": "rm"}, "sa") + "," + sql_sweep({"p": "lx", "t": "rx"}, "sb") + f""",
a AS (SELECT plan_id, {rnd('coalesce(sum(x1 - x0 + 1) FILTER (p AND t), 0) / sum(x1 - x0 + 1)', 6)} AS iou FROM sa GROUP BY plan_id),
b AS (SELECT plan_id, {rnd('coalesce(sum(x1 - x0 + 1) FILTER (p AND t), 0) / nullif(sum(x1 - x0 + 1) FILTER (t), 0)', 6)} AS rec FROM sb GROUP BY plan_id),
cl AS (SELECT plan_id, count(*) AS n, count(*) FILTER (k % 4 = 1) AS x FROM walls GROUP BY plan_id), cr AS (SELECT plan_id, count(*) AS n, count(*) FILTER (k % 4 = 1) AS x FROM truth_walls GROUP BY plan_id)
SELECT plan_id, coalesce(cl.n, 0) AS walls_left, coalesce(cl.x, 0) AS exterior_left, coalesce(cr.n, 0) AS walls_right, coalesce(cr.x, 0) AS exterior_right, coalesce(cl.n, 0) - coalesce(cr.n, 0) AS wall_count_diff,
 iou AS wall_footprint_iou, rec AS exterior_shell_recall FROM cl FULL JOIN cr USING (plan_id) LEFT JOIN a USING (plan_id) LEFT JOIN b USING (plan_id)""")
def _(spark, sf):
    left, right = (w.withColumn("is_exterior", F.col("k") % 4 == 1) for w in (V.walls(spark, sf), V.truth_walls(spark, sf)))
    return X.compare_stages(left, right, frame(spark, sf))


STAGES = ("raw", "post", "plan", "drawing", "truth")
STAGE_PAIRS = [("raw", "truth"), ("post", "truth"), ("plan", "truth"), ("drawing", "truth"), ("raw", "post"), ("plan", "post"), ("drawing", "plan")]
# raw: walls as read; post: merged and classified; plan: thickness 4 or 6; drawing: lines; junctions of plan and drawing are those of post
STAGE_WALLS = """
sv AS (SELECT 'raw' AS stage, plan_id, orientation, coord, s, e, thickness, k % 4 = 1 AS is_exterior FROM walls
 UNION ALL SELECT 'post', plan_id, orientation, coord, s, e, thickness, is_exterior FROM fw
 UNION ALL SELECT 'plan', plan_id, orientation, coord, s, e, CASE WHEN thickness >= 5 THEN 6 ELSE 4 END, is_exterior FROM fw
 UNION ALL SELECT 'drawing', plan_id, orientation, coord, s, e, 1, is_exterior FROM fw
 UNION ALL SELECT 'truth', plan_id, orientation, coord, s, e, thickness, k % 4 = 1 FROM truth_walls),
sw AS (SELECT * REPLACE (round_even(coord, 0) AS coord, round_even(s, 0) AS s, round_even(e, 0) AS e, greatest(1, round_even(thickness, 0))::BIGINT AS thickness) FROM sv),
sp AS (VALUES """ + ", ".join(f"({k}, '{a}', '{b}')" for k, (a, b) in enumerate(STAGE_PAIRS)) + "),"


def _sql_matched(points, candidates, prefix):
    """Greedy matches of all pairs at once; a plan and a pair are one plan."""
    n = len(STAGE_PAIRS)
    body = f"""
{prefix}pd AS (SELECT q.* REPLACE (q.plan_id * {n} + p.pair AS plan_id) FROM {points} q JOIN sq p ON q.stage = p.lft), {prefix}td AS (SELECT q.* REPLACE (q.plan_id * {n} + p.pair AS plan_id) FROM {points} q JOIN sq p ON q.stage = p.rgt),
{candidates}""" + re.sub(r"\b(ls|fd|cp|ce|al|pr|pd|td)\b", rf"{prefix}\1", GREEDY)
    head, _, tail = body.rpartition("\nSELECT plan_id, predicted")
    return f"{head},\n{prefix}mm AS (SELECT plan_id, predicted{tail}),"


@query("j25_all_stages", "walls truth_walls openings plans", SQL_FINAL + FRAME + "," + STAGE_WALLS + "".join(
    f"m_{s} AS (SELECT * FROM sw WHERE stage = '{s}'), x_{s} AS (SELECT * FROM sw WHERE stage = '{s}' AND is_exterior)," + sql_raster(f"m_{s}", f"r_{s}") + "," + sql_raster(f"x_{s}", f"q_{s}") + "," for s in STAGES)
    + sql_sweep({**{f"w_{s}": f"r_{s}" for s in STAGES}, **{f"s_{s}": f"q_{s}" for s in STAGES}}, "swp") + ", sq AS (SELECT col0 AS pair, col1 AS lft, col2 AS rgt FROM sp)," + "mk AS (" + " UNION ALL ".join(
        f"SELECT plan_id, {k} AS pair, {rnd(f'coalesce(sum(x1 - x0 + 1) FILTER (w_{a} AND w_{b}), 0) / nullif(sum(x1 - x0 + 1) FILTER (w_{a} OR w_{b}), 0)', 6)} AS iou,"
        f" {rnd(f'coalesce(sum(x1 - x0 + 1) FILTER (s_{a} AND s_{b}), 0) / nullif(sum(x1 - x0 + 1) FILTER (s_{b}), 0)', 6)} AS rec FROM swp GROUP BY plan_id" for k, (a, b) in enumerate(STAGE_PAIRS)) + "),"
    + sql_junctions("walls", "ja") + "," + sql_junctions("fw", "jb") + "," + sql_junctions("truth_walls", "jc") + ", jp AS (" + " UNION ALL ".join(
        f"SELECT '{stage}' AS stage, plan_id, x, y, type, row_number() OVER (PARTITION BY plan_id ORDER BY x, y) AS ord FROM {src}" for stage, src in (("raw", "ja"), ("post", "jb"), ("plan", "jb"), ("drawing", "jb"), ("truth", "jc"))) + "),"
    + _sql_matched("jp", "jpr AS (SELECT jpd.plan_id, jpd.ord AS p_ord, jtd.ord AS e_ord, sqrt((jpd.x - jtd.x) * (jpd.x - jtd.x) + (jpd.y - jtd.y) * (jpd.y - jtd.y)) AS score FROM jpd JOIN jtd ON jpd.plan_id = jtd.plan_id AND jpd.type = jtd.type"
                   " AND sqrt((jpd.x - jtd.x) * (jpd.x - jtd.x) + (jpd.y - jtd.y) * (jpd.y - jtd.y)) <= 12),", "j")
    + "op AS (SELECT t.stage, plan_id, ord, kind, x, y, span FROM openings, (VALUES ('raw'), ('post')) t(stage) UNION ALL SELECT 'truth', plan_id, ord, kind, x + k % 7, y, span + k % 5 FROM openings WHERE k % 10 <> 0),"
    + _sql_matched("op", "opq AS (SELECT p.plan_id, p.ord AS p_ord, t.ord AS e_ord, sqrt((p.x - t.x) * (p.x - t.x) + (p.y - t.y) * (p.y - t.y)) AS d, abs(p.span - t.span) / greatest(p.span, t.span) AS er, greatest(p.span, t.span) AS m"
                   " FROM opd p JOIN otd t ON p.plan_id = t.plan_id AND p.kind = t.kind), opr AS (SELECT plan_id, p_ord, e_ord, d + er * 10 AS score FROM opq WHERE d <= greatest(12, m * 0.75) AND er <= 0.5),", "o")
    + f"""
ct AS (SELECT plan_id, stage, count(*) AS n, count(*) FILTER (is_exterior) AS x FROM sw GROUP BY plan_id, stage)
SELECT f.plan_id, q.lft AS "left", q.rgt AS "right", coalesce(a.n, 0) AS walls_left, coalesce(a.x, 0) AS exterior_left, coalesce(b.n, 0) AS walls_right, coalesce(b.x, 0) AS exterior_right,
 coalesce(a.n, 0) - coalesce(b.n, 0) AS wall_count_diff, iou AS wall_footprint_iou, rec AS exterior_shell_recall, jm."precision" AS junction_precision, jm.recall AS junction_recall,
 om."precision" AS opening_precision, om.recall AS opening_recall FROM frame f, sq q LEFT JOIN ct a ON a.plan_id = f.plan_id AND a.stage = q.lft LEFT JOIN ct b ON b.plan_id = f.plan_id AND b.stage = q.rgt
 LEFT JOIN mk ON mk.plan_id = f.plan_id AND mk.pair = q.pair LEFT JOIN jmm jm ON jm.plan_id = f.plan_id * {len(STAGE_PAIRS)} + q.pair LEFT JOIN omm om ON om.plan_id = f.plan_id * {len(STAGE_PAIRS)} + q.pair""")
def _(spark, sf):
    from plansift.session import keep_rows
    raw, truth = (w.withColumn("is_exterior", F.col("k") % 4 == 1) for w in (V.walls(spark, sf), V.truth_walls(spark, sf)))
    post = final_walls(spark, sf)
    columns = ["plan_id", "orientation", "coord", "s", "e", "thickness", "is_exterior"]
    named = lambda rows, stage: rows.withColumn("stage", F.lit(stage))
    walls = named(raw.select(columns), "raw")
    for rows, stage in ((post, "post"), (post.withColumn("thickness", F.when(F.col("thickness") >= 5, 6.0).otherwise(4.0)), "plan"), (post.withColumn("thickness", F.lit(1.0)), "drawing"), (truth, "truth")):
        walls = walls.unionByName(named(rows.select(columns), stage))
    found = {stage: keep_rows(numbered_junctions(rows.drop("cfg"))) for stage, rows in (("raw", raw), ("post", post), ("truth", truth))}
    points = named(found["raw"], "raw")
    for stage, of in (("post", "post"), ("plan", "post"), ("drawing", "post"), ("truth", "truth")):
        points = points.unionByName(named(found[of], stage))
    pred, moved = opening_sides(spark, sf)
    places = ["plan_id", "ord", "kind", "x", "y", "span"]
    openings = named(pred.select(places), "raw").unionByName(named(pred.select(places), "post")).unionByName(named(moved.select(places), "truth"))
    return X.compare_all_stages(walls, points, openings, STAGE_PAIRS, frame(spark, sf))


@query("j26_line_comparison", "walls truth_walls plans", FRAME + ", lw AS (SELECT * REPLACE (1 AS thickness) FROM walls WHERE k % 3 > 0), rw AS (SELECT * REPLACE (1 AS thickness) FROM truth_walls)," + sql_raster("lw", "lm") + "," + sql_raster("rw", "rm") + ","
       + sql_sweep({"p": "lm", "t": "rm"}, "sa") + f""",
a AS (SELECT plan_id, {rnd('coalesce(sum(x1 - x0 + 1) FILTER (p AND t), 0) / sum(x1 - x0 + 1)', 6)} AS iou FROM sa GROUP BY plan_id),
cl AS (SELECT plan_id, count(*) AS n FROM lw GROUP BY plan_id), cr AS (SELECT plan_id, count(*) AS n FROM rw GROUP BY plan_id)
SELECT f.plan_id, coalesce(cl.n, 0) AS predicted, coalesce(cr.n, 0) AS expected, coalesce(cl.n, 0) - coalesce(cr.n, 0) AS diff, CASE WHEN cl.n IS NULL AND cr.n IS NULL THEN 1.0::DOUBLE ELSE iou END AS line_iou
 FROM frame f LEFT JOIN cl USING (plan_id) LEFT JOIN cr USING (plan_id) LEFT JOIN a USING (plan_id)""")
def _(spark, sf):
    return X.compare_lines(V.walls(spark, sf).filter("k % 3 > 0"), V.truth_walls(spark, sf), frame(spark, sf))
