"""Dataset and label queries, including the file sources they read."""

import io
import tarfile

import pandas as pd
from pyspark.sql import functions as F

from plansift import views as V
from plansift.catalog.registry import query, rnd
from plansift.functions.ranking import number_by
from plansift.operators import datasets as D
from plansift.sources import archives, cases, files, labels, reports, structures

AUDIT = """
ra AS (SELECT *, wall / greatest(total, 1) AS ratio FROM audit_input),
fl AS (SELECT *, list_filter([CASE WHEN wall = 0 THEN 'no_walls' END, CASE WHEN room = 0 THEN 'no_rooms' END, CASE WHEN opening = 0 THEN 'no_openings' END,
 CASE WHEN points < 4 THEN 'sparse_heatmaps' END, CASE WHEN ratio < 0.01 THEN 'wall_ratio_too_low' END, CASE WHEN ratio > 0.6 THEN 'wall_ratio_too_high' END,
 CASE WHEN least(h, w) < 96 THEN 'tiny_image' END, CASE WHEN greatest(h, w) > 2048 THEN 'oversized_image' END,
 CASE WHEN rooms < 2 THEN 'limited_room_diversity' END], lambda x: x IS NOT NULL) AS flags FROM ra),
audit AS (SELECT *, greatest(0, least(100, CASE WHEN wall > 0 THEN 15 ELSE 0 END + CASE WHEN wall > 0 AND ratio BETWEEN 0.03 AND 0.35 THEN 10 ELSE 0 END
 + CASE WHEN room > 0 THEN 10 + least(rooms * 5, 20) ELSE 0 END + CASE WHEN opening > 0 THEN 15 ELSE 0 END
 + CASE WHEN channels >= 6 THEN 15 WHEN channels >= 2 THEN 8 ELSE 0 END + CASE WHEN least(h, w) >= 128 THEN 10 ELSE 0 END
 + CASE WHEN greatest(h, w) <= 1024 THEN 5 ELSE 0 END - coalesce(list_sum(list_transform(flags, lambda f: CASE WHEN f IN ('no_walls', 'no_rooms') THEN 30
 WHEN f IN ('wall_ratio_too_low', 'wall_ratio_too_high') THEN 15 WHEN f = 'no_openings' THEN 10 ELSE 5 END)), 0)))::INTEGER AS quality_score FROM fl)"""
DROP = "(list_has_any(flags, ['no_walls', 'no_rooms', 'wall_ratio_too_low', 'wall_ratio_too_high', 'tiny_image']) OR quality_score < 35)"


def audit(spark, sf):
    return D.score_samples(V.audit_input(spark, sf))


@query("a12_score_samples", "audit_input", AUDIT + " SELECT sample_id, array_to_string(flags, ',') AS flags, quality_score FROM audit")
def _(spark, sf):
    return audit(spark, sf).select("sample_id", F.array_join("flags", ",").alias("flags"), "quality_score")


@query("a13_audit_summary", "audit_input", AUDIT + f""" SELECT 'dataset' AS kind, dataset AS name, count(*)::DOUBLE AS value FROM audit GROUP BY dataset
UNION ALL SELECT 'flag', f, count(*)::DOUBLE FROM (SELECT unnest(flags) AS f FROM audit) GROUP BY f
UNION ALL SELECT 'score', 'sample_count', count(*)::DOUBLE FROM audit UNION ALL SELECT 'score', 'average_quality_score', {rnd('avg(quality_score)', 6)} FROM audit
UNION ALL SELECT 'score', 'min_quality_score', min(quality_score)::DOUBLE FROM audit UNION ALL SELECT 'score', 'max_quality_score', max(quality_score)::DOUBLE FROM audit""")
def _(spark, sf):
    return D.audit_summary(audit(spark, sf))


@query("f06_drop_rule", "audit_input", AUDIT + f" SELECT sample_id, {DROP} OR list_contains(flags, 'no_openings') AS drop_it FROM audit")
def _(spark, sf):
    return audit(spark, sf).select("sample_id", D.should_drop(require_openings=True).alias("drop_it"))


def curated(spark, sf):
    return D.curate(V.manifest(spark, sf), audit(spark, sf).filter("sample_id % 19 <> 0"))


CURATED = AUDIT + f", cur AS (SELECT m.*, flags, quality_score, NOT {DROP} AS keep FROM manifest m JOIN audit a USING (sample_id) WHERE sample_id % 19 <> 0)"


@query("j18_manifest_audit", "manifest audit_input", CURATED + " SELECT sample_id, dataset, quality_score, array_to_string(flags, ',') AS flags, keep FROM cur")
def _(spark, sf):
    return curated(spark, sf).select("sample_id", "dataset", "quality_score", F.array_join("flags", ",").alias("flags"), "keep")


@query("a14_curation_summary", "manifest audit_input", CURATED + " SELECT dataset, count(*) FILTER (keep) AS kept, count(*) FILTER (NOT keep) AS dropped FROM cur GROUP BY dataset")
def _(spark, sf):
    return D.curation_summary(curated(spark, sf))


SPLIT = """
rk AS (SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY md5(concat('13:', sample_id)), sample_id) AS "rank", count(*) OVER (PARTITION BY dataset) AS total FROM {src}),
z1 AS (SELECT *, floor(total * 0.8::DOUBLE)::BIGINT AS t, floor(total * 0.1::DOUBLE)::BIGINT AS v FROM rk),
z2 AS (SELECT *, total - t - v AS te, CASE WHEN v = 0 THEN greatest(t - 1, 1) ELSE t END AS t1 FROM z1),
z3 AS (SELECT *, CASE WHEN total >= 3 THEN CASE WHEN te = 0 THEN greatest(t1 - 1, 1) ELSE t1 END ELSE least(total, 1) END AS nt,
 CASE WHEN total >= 3 THEN greatest(v, 1) ELSE 0 END AS nv FROM z2),
splits AS (SELECT *, CASE WHEN "rank" <= nt THEN 'train' WHEN "rank" <= nt + nv THEN 'val' ELSE 'test' END AS split FROM z3)"""


@query("w11_stratified_split", "manifest", SPLIT.format(src="manifest") + """ SELECT dataset, sample_id, "rank", split FROM splits""")
def _(spark, sf):
    return D.assign_splits(V.manifest(spark, sf)).select("dataset", "sample_id", "rank", "split")


@query("a15_split_summary", "manifest", SPLIT.format(src="manifest") + " SELECT split, count(*) AS n, string_agg(DISTINCT dataset, ',' ORDER BY dataset) AS datasets FROM splits GROUP BY split")
def _(spark, sf):
    return D.split_summary(D.assign_splits(V.manifest(spark, sf)))


@query("t01_ordered_splits", "manifest", SPLIT.format(src="manifest") + " SELECT split, dataset, sample_id, row_number() OVER (PARTITION BY split, dataset ORDER BY sample_id) AS pos FROM splits")
def _(spark, sf):
    rows = D.assign_splits(V.manifest(spark, sf)).select("split", "dataset", "sample_id")
    return number_by(rows, ["split", "dataset"], "sample_id", "pos").orderBy("split", "dataset", "sample_id")


PATHS = """'samples/' || dataset || '/' || sample_id || '/image.png' AS image_path, 'samples/' || dataset || '/' || sample_id || '/label.npy' AS label_path,
 CASE WHEN preview_path IS NOT NULL THEN 'samples/' || dataset || '/' || sample_id || '/preview.png' END AS preview_path"""


@query("p44_materialized_paths", "manifest", f"SELECT sample_id, {PATHS} FROM manifest")
def _(spark, sf):
    return D.materialize_paths(V.manifest(spark, sf), include_preview=True).select("sample_id", "image_path", "label_path", "preview_path")


@query("j19_rewrite_splits", "manifest", SPLIT.format(src="manifest") + f" SELECT sample_id, split, {PATHS} FROM splits WHERE sample_id % 7 <> 0")
def _(spark, sf):
    rows = V.manifest(spark, sf)
    made = D.materialize_paths(rows.filter("sample_id % 7 <> 0"), include_preview=True).select("sample_id", "image_path", "label_path", "preview_path")
    return D.rewrite_splits(D.assign_splits(rows), made)


@query("f15_pending_folders", "manifest", """SELECT sample_id AS folder FROM manifest WHERE sample_id BETWEEN 10 AND 900 AND preview_path IS NULL""")
def _(spark, sf):
    rows = V.manifest(spark, sf)
    return D.pending_folders(rows.select(F.col("sample_id").alias("folder")), rows.filter("preview_path IS NOT NULL").select(F.col("sample_id").alias("folder")), 10, 900)


@query("a37_labelling_totals", "manifest", f"""SELECT count(*) FILTER (preview_path IS NULL AND sample_id % 10 > 0) AS done, count(*) FILTER (preview_path IS NOT NULL) AS skipped,
 count(*) FILTER (preview_path IS NULL AND sample_id % 10 = 0) AS errors, {rnd('count(*) FILTER (preview_path IS NULL AND sample_id % 10 > 0) * 0.045::DOUBLE', 6)} AS total_cost FROM manifest""")
def _(spark, sf):
    return D.labelling_totals(V.manifest(spark, sf).selectExpr(
        "CASE WHEN preview_path IS NOT NULL THEN 'skipped' WHEN sample_id % 10 = 0 THEN 'error' ELSE 'done' END AS outcome"))


@query("u01_union_manifests", "manifest", """SELECT dataset, sample_id, preview_path, NULL::VARCHAR AS part, 'documents' AS manifest FROM manifest
UNION ALL SELECT role, conv_id, NULL, 'turns', 'conversations' FROM conversations""")
def _(spark, sf):
    other = V.load(spark, sf, "conversations").selectExpr("role AS dataset", "conv_id AS sample_id", "'turns' AS part")
    return D.union_manifests(documents=V.manifest(spark, sf).drop("part"), conversations=other).select("dataset", "sample_id", "preview_path", "part", "manifest")


@query("t02_row_limit", "manifest", "SELECT sample_id, dataset FROM manifest ORDER BY dataset, sample_id LIMIT 50")
def _(spark, sf):
    return V.manifest(spark, sf).orderBy("dataset", "sample_id").limit(50).select("sample_id", "dataset")


@query("t03_first_per_archive", "members", """SELECT archive, name, rn FROM (SELECT *, row_number() OVER (PARTITION BY archive ORDER BY ordinal) AS rn FROM members) WHERE rn <= 50""")
def _(spark, sf):
    return archives.first_members(V.members(spark, sf), 50).select("archive", "name", "rn")


# -- label metrics on pixels

PAIRS = """pr AS (SELECT image_id, px, r % 4 AS pred, (r + CASE WHEN b % 5 = 0 THEN 1 ELSE 0 END) % 4 AS truth, CASE WHEN g % 2 = 0 THEN 'room' ELSE 'icon' END AS head FROM pixels)"""


def pairs(spark, sf):
    return V.pixels(spark, sf).selectExpr("r % 4 AS pred", "(r + if(b % 5 = 0, 1, 0)) % 4 AS truth", "if(g % 2 = 0, 'room', 'icon') AS head")


@query("a19_class_iou", "pixels", PAIRS + f""",
k AS (SELECT c AS cls, {rnd('count(*) FILTER (pred = truth)::DOUBLE / count(*)', 6)} AS iou, count(*) FILTER (pred = truth)::DOUBLE / count(*) AS raw FROM pr, (VALUES (0), (1), (2), (3)) t(c) WHERE pred = c OR truth = c GROUP BY c)
SELECT cls, iou FROM k UNION ALL SELECT -1, {rnd('avg(raw)', 6)} FROM k""")
def _(spark, sf):
    return D.class_iou(pairs(spark, sf))


@query("a21_pixel_accuracy", "pixels", PAIRS + f" SELECT head, {rnd('avg((pred = truth)::INT)', 6)} AS accuracy FROM pr GROUP BY head")
def _(spark, sf):
    return D.pixel_accuracy(pairs(spark, sf))


@query("a20_class_weights", "pixels", f"""
px AS (SELECT r % 4 * 2 + (CASE WHEN r > 200 THEN 1 ELSE 0 END) AS cls, count(*) AS pixels FROM pixels GROUP BY 1),
fr AS (SELECT cls, pixels::DOUBLE / sum(pixels) OVER () AS freq FROM px),
md AS (SELECT list(freq ORDER BY freq)[count(*) // 2 + 1] AS median FROM fr)
SELECT cls, {rnd('least(median / (freq + 1e-10), 10)', 6)} AS weight FROM fr, md""")
def _(spark, sf):
    counts = V.pixels(spark, sf).selectExpr("r % 4 * 2 + if(r > 200, 1, 0) AS cls").groupBy("cls").agg(F.count(F.lit(1)).alias("pixels"))
    return D.class_weights(counts)


# -- file sources: Spark writes the tables as files first, then the source reads them back


@query("s01_read_manifest", "manifest", "SELECT dataset, sample_id, part, preview_path FROM manifest")
def _(spark, sf):
    path = files.scratch(spark) + "/manifest"
    files.write_jsonl(V.manifest(spark, sf), path)
    return files.read_manifest(spark, path).select("dataset", "sample_id", "part", "preview_path")


@query("s02_write_sorted_jsonl", "manifest", """SELECT concat('{"dataset":"', dataset, '","part":"', part, '","sample_id":', sample_id, '}') AS value FROM manifest""")
def _(spark, sf):
    path = files.scratch(spark) + "/sorted"
    files.write_jsonl(V.manifest(spark, sf).select("sample_id", "part", "dataset"), path)
    return spark.read.text(path)


CASES = """
fl AS (SELECT concat('case-', doc_id // 3) AS "case", CASE WHEN doc_id % 3 = 0 THEN CASE doc_id % 4 WHEN 0 THEN 'input.png' WHEN 1 THEN 'original.jpg' WHEN 2 THEN 'input.jpeg' ELSE 'original.png' END
 WHEN doc_id % 3 = 1 THEN CASE WHEN doc_id % 2 = 0 THEN 'expected.json' ELSE 'label.npy' END ELSE 'heatmaps.json' END AS name FROM documents)"""


@query("s03_discover_cases", "", CASES + """,
g AS (SELECT "case", bool_or(name = 'input.png') AS a, bool_or(name = 'input.jpg') AS b, bool_or(name = 'input.jpeg') AS c, bool_or(name = 'original.png') AS d, bool_or(name = 'original.jpg') AS e,
 bool_or(name = 'expected.json') AS x, bool_or(name = 'label.npy') AS l, bool_or(name = 'heatmaps.json') AS h FROM fl GROUP BY 1)
SELECT "case", CASE WHEN a THEN 'input.png' WHEN b THEN 'input.jpg' WHEN c THEN 'input.jpeg' WHEN d THEN 'original.png' ELSE 'original.jpg' END AS image,
 CASE WHEN a OR b OR c THEN CASE WHEN x THEN 'contract' ELSE 'none' END ELSE 'segmentation' END AS ground_truth_kind FROM g WHERE a OR b OR c OR ((d OR e) AND l AND h)""")
def _(spark, sf):
    listing = V.load(spark, sf, "documents").selectExpr(
        "concat('case-', floor(doc_id / 3)) AS case",
        """CASE WHEN doc_id % 3 = 0 THEN element_at(array('input.png', 'original.jpg', 'input.jpeg', 'original.png'), cast(doc_id % 4 AS int) + 1)
           WHEN doc_id % 3 = 1 THEN if(doc_id % 2 = 0, 'expected.json', 'label.npy') ELSE 'heatmaps.json' END AS name""")
    return cases.discover(listing)


@query("s04_read_structures", "walls", "SELECT plan_id, wall_id, orientation, s AS x1, coord AS y1, thickness, orientation = 'horizontal' AS is_exterior FROM walls")
def _(spark, sf):
    docs = V.walls(spark, sf).select("plan_id", F.to_json(F.struct(F.array(F.struct(
        F.col("wall_id").alias("id"), "orientation", "thickness", (F.col("orientation") == "horizontal").alias("is_exterior"),
        F.array(F.struct(F.col("s").alias("x"), F.col("coord").alias("y")), F.struct(F.col("e").alias("x"), F.col("coord").alias("y"))).alias("polyline"),
    )).alias("walls"))).alias("doc"))
    return structures.explode_walls(structures.parse(docs, "doc"), "plan_id").select(
        "plan_id", "wall_id", "orientation", "x1", "y1", "thickness", "is_exterior")


def structure_files(spark, sf):
    """Structure documents, one line each, with walls, openings at the walls' middles and a junction at every first end."""
    # a wall travels as its ends; its document parts are built where the document is
    one = V.walls(spark, sf).withColumn("flat", F.col("orientation") == "horizontal").selectExpr(
        "k AS doc_id", """named_struct('ord', ord, 'id', wall_id, 'orientation', orientation, 'thickness', thickness, 'confidence', confidence,
         'x1', if(flat, s, coord), 'y1', if(flat, coord, s), 'x2', if(flat, e, coord), 'y2', if(flat, coord, e)) AS r""")
    parts = one.groupBy("doc_id").agg(F.array_sort(F.collect_list("r")).alias("r"))
    docs = parts.select("doc_id", F.to_json(F.struct(
        F.expr("""transform(r, r -> named_struct('id', r.id, 'orientation', r.orientation, 'thickness', r.thickness, 'confidence', r.confidence, 'is_exterior', r.orientation = 'horizontal', 'polyline',
         array(named_struct('x', r.x1, 'y', r.y1), named_struct('x', r.x2, 'y', r.y2))))""").alias("walls"),
        F.expr("""transform(r, r -> named_struct('id', concat('o-', r.id), 'kind', if(r.orientation = 'horizontal', 'door', 'window'), 'wall_id', r.id, 'orientation', r.orientation, 'offset', 0D,
         'span', if(r.orientation = 'horizontal', r.x2 - r.x1, r.y2 - r.y1) / 4,
         'position', named_struct('x', if(r.orientation = 'horizontal', (r.x1 + r.x2) / 2, r.x1), 'y', if(r.orientation = 'horizontal', r.y1, (r.y1 + r.y2) / 2))))""").alias("openings"),
        F.expr("transform(r, r -> named_struct('type', if(r.orientation = 'horizontal', 'L', 'T'), 'wall_ids', array(r.id), 'point', named_struct('x', r.x1, 'y', r.y1)))").alias("junctions"))).alias("doc"))
    path = files.scratch(spark) + "/structures"
    structures.write_lines(docs, "doc_id", "doc", path)
    return structures.read_lines(spark, path)


@query("s04_structure_walls", "walls", """SELECT k AS doc_id, row_number() OVER (PARTITION BY k ORDER BY ord, wall_id) - 1 AS n, wall_id, CASE orientation WHEN 'horizontal' THEN s ELSE coord END AS x1,
 CASE orientation WHEN 'horizontal' THEN coord ELSE s END AS y1, CASE orientation WHEN 'horizontal' THEN e ELSE coord END AS x2, CASE orientation WHEN 'horizontal' THEN coord ELSE e END AS y2, thickness FROM walls""")
def _(spark, sf):
    return structures.explode_walls(structure_files(spark, sf), "doc_id").select("doc_id", F.col("ord").alias("n"), "wall_id", "x1", "y1", "x2", "y2", "thickness")


@query("s04_structure_openings", "walls", """SELECT k AS doc_id, concat('o-', wall_id) AS opening_id, CASE orientation WHEN 'horizontal' THEN 'door' ELSE 'window' END AS kind, wall_id,
 CASE orientation WHEN 'horizontal' THEN (s + e) / 2 ELSE coord END AS x, CASE orientation WHEN 'horizontal' THEN coord ELSE (s + e) / 2 END AS y, (e - s) / 4 AS span FROM walls""")
def _(spark, sf):
    return structures.explode_openings(structure_files(spark, sf), "doc_id").select("doc_id", "opening_id", "kind", "wall_id", "x", "y", "span")


@query("s04_structure_junctions", "walls", """SELECT k AS doc_id, CASE orientation WHEN 'horizontal' THEN 'L' ELSE 'T' END AS type, wall_id,
 CASE orientation WHEN 'horizontal' THEN s ELSE coord END AS x, CASE orientation WHEN 'horizontal' THEN coord ELSE s END AS y FROM walls""")
def _(spark, sf):
    return structures.explode_junctions(structure_files(spark, sf), "doc_id").select("doc_id", "type", F.element_at("wall_ids", 1).alias("wall_id"), "x", "y")


LABEL = """
dim AS (SELECT doc_id, (8 + doc_id % 5)::BIGINT AS h, (10 + doc_id % 7)::BIGINT AS w FROM documents),
rn AS (SELECT doc_id AS sample_id, ch AS channel, (doc_id + y + b + ch) % 6 AS cls, y, 4 * b AS x0, least(4 * b + 3, w - 1) AS x1
 FROM dim, (VALUES (0), (1)) c(ch), LATERAL (SELECT unnest(range(h)) AS y), LATERAL (SELECT unnest(range((w + 3) // 4)) AS b))"""


@query("s05_read_label_masks", "", LABEL + " SELECT sample_id, channel::BIGINT AS channel, cls::BIGINT AS cls, y, x0, x1 FROM rn")
def _(spark, sf):
    docs = V.load(spark, sf, "documents").selectExpr("doc_id AS sample_id", "8 + doc_id % 5 AS h", "10 + doc_id % 7 AS w")
    out = labels.read_label_runs(docs.mapInPandas(labels.encode_test_labels, "sample_id long, content binary"))
    return out.select("sample_id", *[F.col(c).cast("long").alias(c) for c in ("channel", "cls", "y", "x0", "x1")])


@query("a18_class_pixels", "", LABEL + " SELECT sample_id, channel::BIGINT AS channel, cls::BIGINT AS cls, sum(x1 - x0 + 1)::BIGINT AS pixels FROM rn GROUP BY ALL")
def _(spark, sf):
    docs = V.load(spark, sf, "documents").selectExpr("doc_id AS sample_id", "8 + doc_id % 5 AS h", "10 + doc_id % 7 AS w")
    runs = labels.read_label_runs(docs.mapInPandas(labels.encode_test_labels, "sample_id long, content binary"))
    out = D.class_pixels(runs)
    return out.select("sample_id", *[F.col(c).cast("long").alias(c) for c in ("channel", "cls", "pixels")])


@query("a12_sample_counts", "", LABEL + f""",
px AS (SELECT sample_id, channel, cls, sum(x1 - x0 + 1) AS p FROM rn GROUP BY ALL),
ct AS (SELECT sample_id, coalesce(sum(p) FILTER (channel = 0), 0)::BIGINT AS total, coalesce(sum(p) FILTER (channel = 0 AND cls = 2), 0)::BIGINT AS wall,
 coalesce(sum(p) FILTER (channel = 0 AND cls = 1), 0)::BIGINT AS outdoor, coalesce(sum(p) FILTER (channel = 0 AND cls > 2), 0)::BIGINT AS room,
 coalesce(sum(p) FILTER (channel = 1 AND cls IN (1, 2)), 0)::BIGINT AS opening, coalesce(sum(p) FILTER (channel = 1 AND cls <> 0), 0)::BIGINT AS icon,
 count(*) FILTER (channel = 0 AND cls > 2) AS rooms FROM px GROUP BY sample_id)
SELECT *, {rnd('wall / greatest(total, 1)', 6)} AS wall_ratio, {rnd('room / greatest(total, 1)', 6)} AS room_ratio, {rnd('opening / greatest(total, 1)', 6)} AS opening_ratio FROM ct""")
def _(spark, sf):
    docs = V.load(spark, sf, "documents").selectExpr("doc_id AS sample_id", "8 + doc_id % 5 AS h", "10 + doc_id % 7 AS w")
    runs = labels.read_label_runs(docs.mapInPandas(labels.encode_test_labels, "sample_id long, content binary"))
    return D.with_ratios(D.sample_counts(D.class_pixels(runs)))


@query("s06_read_heatmaps", "", """SELECT doc_id AS sample_id, c::VARCHAR AS channel, (doc_id + i) % 50 AS x, (3 * doc_id + i) % 40 AS y
 FROM documents, (VALUES (0), (1), (2)) t(c), LATERAL (SELECT unnest(range((doc_id + c) % 4)) AS i)""")
def _(spark, sf):
    def points(c):
        steps = F.filter(F.array(*map(F.lit, range(4))), lambda i: i < (F.col("doc_id") + c) % 4)
        return F.transform(steps, lambda i: F.array((F.col("doc_id") + i) % 50, (F.col("doc_id") * 3 + i) % 40))

    maps = F.map_from_entries(F.array(*[F.struct(F.lit(str(c)), points(c)) for c in range(3)]))
    docs = V.load(spark, sf, "documents").select(F.col("doc_id").alias("sample_id"), F.to_json(maps).alias("heatmaps"))
    return labels.explode_heatmaps(docs)


@query("s07_write_report", "manifest", "SELECT sample_id AS case_id, dataset, part AS run_id FROM manifest")
def _(spark, sf):
    path = files.scratch(spark) + "/report"
    files.write_report(V.manifest(spark, sf).selectExpr("sample_id AS case_id", "part AS run_id", "dataset"), path)
    return files.read_report(spark, path).select("case_id", "run_id", "dataset")


# runs of a benchmark: a customer's orders of one priority are one case of one run
RUNS = """
rr AS (SELECT concat(o_orderpriority, '/', o_custkey % 3) AS run_id, o_custkey // 3 AS case_id, o_orderstatus <> 'F' AS success, o_orderstatus = 'P' AS needs_review,
 CASE WHEN o_orderkey % 7 > 0 THEN o_orderkey % 3 > 0 END AS meets_thresholds, o_orderkey % 4 = 0 AS normalized, floor(o_totalprice)::BIGINT AS elapsed_ms FROM orders),
ru AS (SELECT DISTINCT concat(o_orderpriority, '/', o_custkey % 3) AS run_id, concat('d', ascii(o_orderpriority) % 2) AS dataset, concat('b', o_custkey % 3) AS backend,
 substr(o_orderpriority, 1, 1) IN ('2', '3') AS is_baseline FROM orders)"""


def write_runs(spark, sf):
    """A report of all runs; a first report of one backend's runs is faulty and replaced by the second."""
    orders = V.load(spark, sf, "orders")
    run = "concat(o_orderpriority, '/', o_custkey % 3) AS run_id"
    results = orders.selectExpr(
        run, "o_custkey div 3 AS case_id", "o_orderstatus <> 'F' AS success", "o_orderstatus = 'P' AS needs_review",
        "if(o_orderkey % 7 > 0, o_orderkey % 3 > 0, null) AS meets_thresholds", "o_orderkey % 4 = 0 AS normalized", "cast(floor(o_totalprice) AS bigint) AS elapsed_ms")
    runs = orders.selectExpr(
        run, "concat('d', ascii(o_orderpriority) % 2) AS dataset", "concat('b', o_custkey % 3) AS backend", "substr(o_orderpriority, 1, 1) IN ('2', '3') AS is_baseline").distinct()
    path = files.scratch(spark) + "/runs"
    faulty = "backend = 'b1'"
    reports.write(results.withColumn("success", F.lit(False)).withColumn("case_id", F.lit(-1).cast("long")), runs.filter(faulty), path)
    reports.write(results, runs, path)
    return path


@query("s07_run_summary", "", RUNS + f"""
SELECT run_id, dataset, backend, is_baseline, count(*) AS total, count_if(success) AS passed, count_if(NOT success) AS failed, {rnd('count_if(success) / count(*)', 6)} AS pass_rate,
 count_if(meets_thresholds) AS threshold_passed, count_if(NOT meets_thresholds) AS threshold_failed, {rnd('count_if(meets_thresholds) / count(*)', 6)} AS threshold_pass_rate,
 {rnd('count_if(needs_review) / count(*)', 6)} AS review_rate, {rnd('sum(elapsed_ms) / count(*)', 6)} AS avg_elapsed_ms, count_if(normalized) AS normalized_case_count, count_if(NOT normalized) AS native_case_count
FROM rr JOIN ru USING (run_id) GROUP BY ALL""")
def _(spark, sf):
    path = write_runs(spark, sf)
    return reports.read(spark, path, reports.RUNS).join(reports.read(spark, path, reports.SUMMARY), "run_id")


@query("s07_baseline_changes", "", RUNS + f""",
cs AS (SELECT run_id, case_id, bool_and(success) AS ok, max(elapsed_ms) AS ms FROM rr GROUP BY ALL),
ch AS (SELECT a.run_id, max(b.run_id) AS baseline_id FROM ru a JOIN ru b ON a.dataset = b.dataset AND a.backend = b.backend AND a.run_id <> b.run_id WHERE b.is_baseline GROUP BY a.run_id),
ba AS (SELECT ch.run_id, case_id, ok AS base_ok, ms AS base_ms FROM cs JOIN ch ON cs.run_id = baseline_id),
mi AS (SELECT cs.* FROM cs SEMI JOIN ch USING (run_id)),
bo AS (SELECT run_id, ok, base_ok, ms - base_ms AS change FROM mi FULL JOIN ba USING (run_id, case_id))
SELECT run_id, baseline_id, count_if(ok IS NOT NULL AND base_ok IS NOT NULL) AS shared, count_if(base_ok IS NULL) AS added, count_if(ok IS NULL) AS missing, count_if(base_ok AND NOT ok) AS broken,
 count_if(ok AND NOT base_ok) AS mended, {rnd('sum(change) / nullif(count(change), 0)', 6)} AS avg_elapsed_change FROM bo JOIN ch USING (run_id) GROUP BY ALL""")
def _(spark, sf):
    path = write_runs(spark, sf)
    return reports.against_baseline(*(reports.read(spark, path, t) for t in (reports.RESULTS, reports.RUNS, reports.BASELINES)))


@query("s08_array_summary", "", LABEL + """,
d AS (SELECT doc_id AS sample_id, h, w FROM dim)
SELECT sample_id, channel::BIGINT AS channel, concat('[', h, ',', w, ']') AS shape, 'uint8' AS dtype, coalesce(sum(x1 - x0 + 1) FILTER (cls <> 0), 0)::BIGINT AS nonzero_count,
 min(cls)::BIGINT AS min, max(cls)::BIGINT AS max FROM rn JOIN d USING (sample_id) GROUP BY sample_id, channel, h, w""")
def _(spark, sf):
    docs = V.load(spark, sf, "documents").selectExpr("doc_id AS sample_id", "8 + doc_id % 5 AS h", "10 + doc_id % 7 AS w")
    runs = labels.read_label_runs(docs.mapInPandas(labels.encode_test_labels, "sample_id long, content binary"))
    out = labels.array_summary(runs)
    return out.select("sample_id", "shape", "dtype", *[F.col(c).cast("long").alias(c) for c in ("channel", "nonzero_count", "min", "max")])


@query("s09_crawl_checkpoint", "crawl_index", "SELECT source, count(*) AS n, count(DISTINCT source_url) AS urls FROM crawl_index GROUP BY source")
def _(spark, sf):
    path = files.scratch(spark) + "/index"
    # an older state of the whole index: the first version of the checkpoint, which the second replaces
    files.save_table(V.crawl_index(spark, sf).withColumn("source", F.concat(F.lit("old-"), "source")), path)
    files.save_table(V.crawl_index(spark, sf), path)
    return files.load_table(spark, path, V.crawl_index(spark, sf).schema).groupBy("source").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("source_url").alias("urls"))


@query("s10_append_history", "run_log", "SELECT run_id, count(*) AS n FROM run_log GROUP BY run_id")
def _(spark, sf):
    path = files.scratch(spark) + "/history"
    rows = V.run_log(spark, sf).select("run_id", "event_id", "val_loss")
    for part in (0, 1):
        files.append_jsonl(rows.filter(F.col("event_id") % 2 == part), path)
    return spark.read.schema(rows.schema).json(path).groupBy("run_id").agg(F.count(F.lit(1)).alias("n"))


#: Archives that are made at a time.
PACKED = 256


def pack_archives(batches):
    """Archives of n empty members each, as the query's input files."""
    for batch in batches:
        for start in range(0, len(batch), PACKED):
            part = batch.iloc[start : start + PACKED]
            blobs = []
            for n, d in zip(part["n"], part["d"]):
                buffer = io.BytesIO()
                with tarfile.open(fileobj=buffer, mode="w") as tar:
                    for i in range(n):
                        tar.addfile(tarfile.TarInfo(f"d{d}/f{i}" + (".png", ".svg", "")[i % 3]))
                blobs.append(buffer.getvalue())
            yield pd.DataFrame({"archive": part["archive"], "content": blobs})


@query("s11_scan_archives", "", """SELECT doc_id AS archive, i AS ordinal, concat('d', doc_id % 3, '/f', i, CASE i % 3 WHEN 0 THEN '.png' WHEN 1 THEN '.svg' ELSE '' END) AS name
 FROM documents, LATERAL (SELECT unnest(range(1 + doc_id % 5)) AS i)""")
def _(spark, sf):
    docs = V.load(spark, sf, "documents").selectExpr("doc_id AS archive", "1 + doc_id % 5 AS n", "doc_id % 3 AS d")
    packed = docs.mapInPandas(pack_archives, "archive long, content binary")
    return archives.scan(packed)


@query("s12_paired_members", "members", """SELECT archive, regexp_replace(name, '\\.[^.]*$', '') AS stem FROM members WHERE name NOT LIKE '%/%' AND regexp_matches(lower(name), '\\.(png|svg)$')
 GROUP BY 1, 2 HAVING count(DISTINCT lower(regexp_extract(name, '\\.[^.]*$'))) = 2""")
def _(spark, sf):
    return archives.paired_stems(V.members(spark, sf))


SVG_ROWS = """
el AS (SELECT doc_id, n, CASE n WHEN 0 THEN 'svg' WHEN 1 THEN 'g' WHEN 2 THEN 'path' WHEN 3 THEN 'path' ELSE 'circle' END AS tag,
 CASE n WHEN 1 THEN CASE WHEN doc_id % 2 = 0 THEN 'WALL' ELSE 'WINDOW' END END AS layer, CASE n WHEN 2 THEN (doc_id % 40)::VARCHAR END AS semantic_id,
 CASE WHEN n = 2 THEN 'rgb(63,63,63)' WHEN n = 3 THEN concat('rgb(', doc_id % 9, ',0,0)') END AS stroke FROM documents, (VALUES (0), (1), (2), (3), (4)) t(n))"""


def svg_docs(spark, sf):
    return V.load(spark, sf, "documents").select(F.col("doc_id").alias("archive"), F.format_string(
        '<svg xmlns="http://www.w3.org/2000/svg" xmlns:inkscape="http://www.inkscape.org/namespaces/inkscape" viewBox="0 0 100 100">'
        '<g inkscape:label="%s"><path semantic-id="%d" stroke="rgb(63,63,63)" d="M 0 0 L 9 9"/><path stroke="rgb(%d,0,0)" d="M 1 1"/><circle cx="5" cy="6" r="2"/></g></svg>',
        F.when(F.col("doc_id") % 2 == 0, "WALL").otherwise("WINDOW"), F.col("doc_id") % 40, F.col("doc_id") % 9).alias("svg"))


@query("s13_svg_elements", "", SVG_ROWS + " SELECT doc_id AS archive, n::BIGINT AS ordinal, tag, CASE WHEN n = 0 THEN NULL ELSE CASE WHEN doc_id % 2 = 0 THEN 'WALL' ELSE 'WINDOW' END END AS layer, semantic_id, stroke FROM el")
def _(spark, sf):
    out = archives.svg_elements(svg_docs(spark, sf))
    return out.select("archive", F.col("ordinal").cast("long").alias("ordinal"), "tag", "layer", "semantic_id", "stroke")


@query("a16_semantic_counters", "", SVG_ROWS + """
SELECT kind, value, count(*) AS n FROM (SELECT 'tag' AS kind, tag AS value FROM el UNION ALL SELECT 'layer', layer FROM el WHERE n = 1
 UNION ALL SELECT 'semantic_id', semantic_id FROM el UNION ALL SELECT 'stroke', stroke FROM el) WHERE value IS NOT NULL GROUP BY ALL""")
def _(spark, sf):
    return archives.counters(archives.svg_elements(svg_docs(spark, sf)))


@query("a16_member_counters", "members", """SELECT archive, kind, value, count(*) AS n FROM (
 SELECT archive, 'extension' AS kind, CASE WHEN regexp_extract(name, '[^/]*(\\.[^./]+)$', 1) = '' THEN '<no_ext>' ELSE lower(regexp_extract(name, '[^/]*(\\.[^./]+)$', 1)) END AS value FROM members
 UNION ALL SELECT archive, 'top_level', split_part(name, '/', 1) FROM members) GROUP BY ALL""")
def _(spark, sf):
    return archives.member_counters(V.members(spark, sf))


HINTS = """
hn AS (SELECT archive, ordinal, name, 'annotation' AS hint FROM members WHERE regexp_matches(lower(name), '[.](json|xml|txt|csv)|annotation|label')
 UNION ALL SELECT archive, ordinal, name, 'image' FROM members WHERE regexp_matches(lower(name), '[.](png|jpg|jpeg|bmp)$'))"""


@query("a16_hint_lists", "members", HINTS + """
SELECT archive, hint, rn, ordinal, name FROM (SELECT *, row_number() OVER (PARTITION BY archive, hint ORDER BY ordinal, name) AS rn FROM hn) WHERE rn <= 50""")
def _(spark, sf):
    return archives.hint_lists(V.members(spark, sf))


@query("a16_archive_totals", "members", HINTS + """,
hc AS (SELECT archive, count_if(hint = 'annotation') AS annotation_like, count_if(hint = 'image') AS image_like FROM hn GROUP BY archive)
SELECT archive, count(*) AS members_scanned, coalesce(any_value(annotation_like), 0) AS annotation_like, coalesce(any_value(image_like), 0) AS image_like,
 count(DISTINCT lower(regexp_extract(name, '[^/]*([.][^./]+)$', 1))) AS extensions, count(DISTINCT split_part(name, '/', 1)) AS top_level FROM members LEFT JOIN hc USING (archive) GROUP BY archive""")
def _(spark, sf):
    return archives.archive_totals(V.members(spark, sf))


@query("a16_semantic_totals", "", SVG_ROWS + """,
ct AS (SELECT doc_id % 7 AS archive, kind, value FROM (SELECT doc_id, 'tag' AS kind, tag AS value FROM el UNION ALL SELECT doc_id, 'layer', layer FROM el WHERE n = 1
 UNION ALL SELECT doc_id, 'semantic_id', semantic_id FROM el UNION ALL SELECT doc_id, 'stroke', stroke FROM el) WHERE value IS NOT NULL)
SELECT archive, kind, value, count(*) AS n FROM ct GROUP BY ALL""")
def _(spark, sf):
    elements = archives.svg_elements(svg_docs(spark, sf)).withColumn("archive", F.col("archive") % 7)
    return archives.counters(elements, ("archive",))


@query("s15_sample_manifest", "manifest plans", """SELECT sample_id, concat(dataset, '/', sample_id, '/image.png') AS image_path, concat(dataset, '/', sample_id, '/label.npy') AS label_path,
 concat('[3,', 320 + sample_id % 50, ',', 400 + sample_id % 50, ']') AS image_shape FROM manifest""")
def _(spark, sf):
    rows = V.manifest(spark, sf).selectExpr("dataset", "sample_id", "320 + sample_id % 50 AS h", "400 + sample_id % 50 AS w", "1.0D AS scale")
    return files.sample_manifest(rows).select("sample_id", "image_path", "label_path", F.to_json("image_shape").alias("image_shape"))


@query("s16_artifact_index", "plans", """SELECT plan_id, 4 + (plan_id % 2 = 0)::INT + (plan_id % 3 = 0)::INT + (plan_id % 5 = 0)::INT AS n_artifacts,
 CASE WHEN plan_id % 3 = 0 THEN concat('/artifacts/', plan_id, '/provenance.json') END AS provenance_url FROM plans""")
def _(spark, sf):
    rows = V.plans(spark, sf).selectExpr("cast(plan_id AS string) AS request_id", "plan_id", "plan_id % 2 = 0 AS has_region_plan",
                                         "plan_id % 3 = 0 AS has_provenance", "plan_id % 5 = 0 AS has_overlay", "false AS has_region_debug")
    out = files.artifact_index(rows)
    return out.select("plan_id", F.size("urls").alias("n_artifacts"), F.col("urls")["provenance_url"].alias("provenance_url"))
