import random

import pytest
from pyspark.sql import functions as F

from plansift import catalog
from plansift.functions import zones
from plansift.operators import config, nearest, nearest as N, openings as O
from tests.helpers import H, V, walls


@pytest.mark.parametrize("limit", [None, 80.0, 700.0])
def test_nearest_points_over_the_borders_of_tiles(spark, monkeypatch, limit):
    monkeypatch.setattr(nearest, "SQUARE", 512.0)
    monkeypatch.setattr(zones, "GATHER", 32)
    draw = random.Random(2)
    at = lambda: float(draw.randrange(-1500, 1500))
    spots = [(p, at(), at(), i) for p in (1, 2) for i in range(90)] + [(3, 9000.0, 9000.0, 0), (4, 5.0, 5.0, 1), (4, 5.0, 5.0, 0), (4, 5.0, -5.0, 2)]
    points = [(p, i, at(), at()) for p in (1, 2, 3, 5) for i in range(80)] + [(4, 0, 5.0, 0.0), (1, 900, None, 5.0), (1, 901, *spots[0][1:3])]
    df = spark.createDataFrame(points, "plan_id long, opening_id long, x double, y double")
    targets = spark.createDataFrame(spots, "plan_id long, tx double, ty double, tord long")
    got = nearest.nearest_point(df, targets, ["plan_id", "opening_id"], F.concat(F.lit("w"), F.col("tord")), limit).collect()
    want = {}
    for p, i, x, y in points:
        near = min(((abs(x - a) + abs(y - b), o) for q, a, b, o in spots if q == p and x is not None), default=None)
        if near and (limit is None or near[0] <= limit):
            want[p, i] = (f"w{near[1]}", near[0])
    assert {(r.plan_id, r.opening_id): (r.hit.payload, r.hit.dist) for r in got} == want and len(got) == len(want)


def test_points_are_not_listed_in_cells_before_they_meet_targets(spark):
    catalog.load_all()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = catalog.QUERIES["j07_nearest_midpoint_80"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" not in plan and plan.count("Exchange") == 2
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_free_lines_come_from_the_pass_over_the_walls(spark):
    # openings in one strip of both axes, and in strips of two numbers
    rng = random.Random(8)
    rows = [(rng.choice([H, V]), rng.randrange(0, 9000, 90), s := rng.randrange(0, 9000, 50), s + rng.randrange(40, 700)) for _ in range(400)]
    lines = walls(spark, rows + [(H, 4, 0, 90), (V, 6, 0, 90)])
    probes = [(1, i, float(rng.randrange(9000)), float(rng.randrange(9000)), 20.0, rng.choice([H, V, None]), 4.0) for i in range(200)] + [(1, 900, 9.0, 9.0, 5.0, H, 4.0)]
    probes = spark.createDataFrame(probes, "plan_id long, n long, x double, y double, span double, orientation string, tol double")
    both = {r.n: (r.line, r.free) for r in N.nearest_lines(probes, lines, ["n"], outer=True, free=True).collect()}
    own, other = ({r.n: r.line for r in N.nearest_lines(probes, lines, ["n"], enforce, outer=True).collect()} for enforce in (True, False))
    assert both == {n: (own[n], other[n]) for n in own} and sum(own[n] != other[n] for n in own) > 20


def test_anchoring_passes_over_the_walls_a_few_times(spark):
    rows = [(1, "a", 1.0, 1.0, 9.0, H, None, 0.5, "door", None, None)]
    openings = config.with_default_config(spark.createDataFrame(rows, "plan_id long, opening_id string, x double, y double, span double, orientation string, side string, confidence double, kind string, offset double, wall_id string"))
    plan = O.anchor(openings, walls(spark, [(H, 0, 0, 200), (V, 0, 0, 120)]), distinct=True)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") <= 8
