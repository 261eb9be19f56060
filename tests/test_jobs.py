import math

import pytest
from pyspark.sql import functions as F

from plansift.functions.formats import feet_inches
from plansift.operators import crawl, datasets, drawing, training
from plansift.plans import clean
from plansift.sources import cases, files


def test_splits_are_stable_and_complete(spark):
    rows = [("first", i) for i in range(10)] + [("second", 100 + i) for i in range(4)]
    df = spark.createDataFrame(rows, "dataset string, sample_id long")
    a = {r.sample_id: r.split for r in datasets.assign_splits(df, seed=9).collect()}
    assert a == {r.sample_id: r.split for r in datasets.assign_splits(df.repartition(3), seed=9).collect()}
    assert set(a.values()) == {"train", "val", "test"} and len(a) == 14


@pytest.mark.parametrize("n,want", [(1, (1, 0, 0)), (2, (1, 0, 1)), (3, (1, 1, 1)), (10, (8, 1, 1)), (25, (20, 2, 3))])
def test_split_sizes(spark, n, want):
    df = spark.createDataFrame([("d", i) for i in range(n)], "dataset string, sample_id long")
    got = {r.split: r.n for r in datasets.split_summary(datasets.assign_splits(df)).collect()}
    assert tuple(got.get(k, 0) for k in ("train", "val", "test")) == want


def test_degenerate_sample_is_dropped(spark):
    df = spark.createDataFrame([(1, 4096, 0, 0, 0, 0, 0, 0, 64, 64), (2, 4096, 600, 2000, 50, 3, 6, 20, 200, 200)],
                               "sample_id long, total long, wall long, room long, opening long, rooms int, channels int, points int, h int, w int")
    out = {r.sample_id: r for r in datasets.score_samples(df).withColumn("drop", datasets.should_drop()).collect()}
    assert {"no_walls", "no_rooms"} <= set(out[1].flags) and out[1].quality_score < 20 and out[1].drop
    assert not out[2].drop


def test_feet_inches(spark):
    df = spark.createDataFrame([(68.0,), (71.6,), (0.4,)], "v double").select(feet_inches("v").alias("t"))
    assert [r.t for r in df.collect()] == ["5'-8\"", "6'-0\"", "0'-0\""]


def test_early_stop(spark):
    losses = [5, 4, 4.5, 4.2, 3, 3.1, 3.2, 3.3, 1]
    df = spark.createDataFrame([(1, i, float(v)) for i, v in enumerate(losses)], "run_id int, epoch int, val_loss double")
    rows = training.best_so_far(df, ["run_id"], 3).orderBy("epoch").collect()
    assert [r.epoch for r in rows] == list(range(8)) and rows[-1].best_loss == 3.0


def test_case_discovery_reads_real_files(spark, tmp_path):
    for name in ("a/input.png", "a/expected.json", "b/original.jpg", "b/label.npy", "b/heatmaps.json", "c/original.png", "d/input.jpeg"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(b"x")
    rows = cases.discover(cases.list_files(spark, str(tmp_path))).collect()
    assert [(r.case, r.ground_truth_kind) for r in rows] == [("a", "contract"), ("b", "segmentation"), ("d", "none")]


def test_missing_manifest_is_empty(spark, tmp_path):
    assert files.read_manifest(spark, str(tmp_path / "none")).count() == 0


def test_link_rules(spark):
    df = spark.createDataFrame([("/plans/12", True), ("http://a.com/house-plans/x", True), ("http://b.com/plans/1", False), ("/plans/a.css", False), ("/about", False), ("/x/12345/", True)], "h string, want boolean")
    out = df.withColumn("got", crawl.is_plan_link(F.col("h"), F.lit("a.com"))).collect()
    assert all(r.got == r.want for r in out), out


def test_regularize_points(spark):
    df = spark.createDataFrame([([(0, 0), (100, 3), (104, 80), (104, 80), (60, 40)],)], "p array<struct<x:bigint,y:bigint>>")
    got = [(p.x, p.y) for p in df.select(drawing.regularize(F.col("p")).alias("p")).first().p]
    assert got == [(0, 0), (100, 0), (100, 80), (104, 80), (60, 40)]


def test_miter_of_a_right_angle(spark):
    walls = spark.createDataFrame([(1, "a", 0.0, 0.0, 100.0, 100.0, 2.0)], "plan_id long, wall_id string, x1 double, y1 double, x2 double, y2 double, half double")
    other = spark.createDataFrame([(1, 5, "b", 100.0, 100.0, 200.0, 0.0, 2.0)], "plan_id long, ord long, wall_id string, ox1 double, oy1 double, ox2 double, oy2 double, o_half double")
    out = {r.end: r for r in drawing.miter_outline(walls, other).collect()}
    assert not out[1].mitred and out[2].mitred
    # both corners of the mitred end lie on the bisector x = 100
    assert math.isclose(out[2].ax, 100.0) and math.isclose(out[2].bx, 100.0)


def test_parse_flow_on_a_box(spark):
    raw = [(1, f"w{i}", i, None, a, b, c, d, 4.0, 0.9, False) for i, (a, b, c, d) in enumerate(
        [(20.0, 20.0, 200.0, 20.0), (200.0, 140.0, 20.0, 141.0 - 1), (20.0, 20.0, 20.0, 140.0), (200.0, 20.0, 200.0, 140.0), (110.0, 20.0, 110.0, 140.0)])]
    walls = spark.createDataFrame(raw, "plan_id long, wall_id string, ord long, orientation string, x1 double, y1 double, x2 double, y2 double, thickness double, confidence double, is_exterior boolean")
    ops = spark.createDataFrame([(1, "o1", "door", 110.0, 74.0, 28.0, "vertical", None, 0.8), (1, "o2", "window", 151.0, 20.0, 30.0, "horizontal", None, 0.7)],
                                "plan_id long, opening_id string, kind string, x double, y double, span double, orientation string, side string, confidence double")
    plans = spark.createDataFrame([(1, 220, 160, "pixel")], "plan_id long, image_w int, image_h int, unit string")
    out = clean.gate(clean.clean(walls, ops, plans), plans).first()
    assert (out.wall_count, out.exterior_wall_count, out.opening_count, out.gate_passed) == (5, 4, 2, True)
