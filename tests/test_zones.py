import random

import pytest

from plansift import catalog
from plansift.operators import intervals, junctions, nearest, openings
from tests.helpers import H, V, walls

POINT = "plan_id long, opening_id long, x double, y double, span double, orientation string, tol double"


def _walls(spark, seed, size, n):
    draw = random.Random(seed)
    rows = {(draw.choice([H, V]), draw.randrange(-size, size), s, s + draw.randrange(20, 900)) for s in (draw.randrange(-size, size) for _ in range(n))}
    return sorted(rows)


@pytest.mark.parametrize("enforce", [True, False])
def test_openings_find_the_best_wall_over_the_borders_of_strips(spark, enforce, monkeypatch):
    monkeypatch.setattr(nearest, "STRIP", 512.0)
    rows = _walls(spark, 5, 6000, 60)
    draw = random.Random(6)
    points = [(1, i, float(draw.randrange(-6000, 6000)), float(draw.randrange(-6000, 6000)), float(draw.choice([10, 300, 2000])), draw.choice([H, V, None]), 4.0) for i in range(120)]
    points += [(1, 500, None, 5.0, 20.0, H, 4.0), (2, 501, 5.0, 5.0, 20.0, H, 4.0)]
    got = nearest.nearest_lines(spark.createDataFrame(points, POINT), walls(spark, rows), ["plan_id", "opening_id"], enforce, outer=True).collect()

    def best(x, y, span, own, tol):
        found = []
        for i, (o, coord, s, e) in enumerate(rows):
            along, cross = (x, y) if o == H else (y, x)
            if along is not None and along + span / 2 + tol >= s and along - span / 2 - tol <= e:
                foreign = enforce and own is not None and own != o
                found.append((foreign, abs(cross - coord) if cross is not None else 0.0, s - e, i))
        return f"w{min(found)[-1]}" if found else None

    want = {p[1]: best(*p[2:]) if p[0] == 1 else None for p in points if p[1] != 500}
    assert len(got) == len(points)
    assert {r.opening_id: r.line and r.line.wall_id for r in got if r.opening_id != 500} == want


def test_connections_counted_in_tiles_equal_those_of_the_listed_points(spark, monkeypatch):
    monkeypatch.setattr(junctions, "TILE", 128.0)
    rows = walls(spark, [(o, c / 3, s, e) for o, c, s, e in _walls(spark, 7, 900, 150)])
    want = {tuple(r) for r in junctions.line_connections(junctions.junction_hits(rows)).collect()}
    assert {tuple(r) for r in junctions.count_connections(rows).collect()} == want and len(want) > 50
    by_wall = {(r.ord, r.n_junctions, r.supported) for r in junctions.count_connections(rows, distinct=True).collect()}
    names = {(r.orientation, r.coord, r.s, r.e): r.ord for r in rows.collect()}
    assert by_wall == {(names[w[1:5]], *w[6:]) for w in want}


def test_parts_of_walls_outside_gaps(spark):
    rows = walls(spark, [(H, 0, 0, 100), (H, 10, 0, 100), (V, 0, 0, 50)])
    gaps = spark.createDataFrame([(1, "w0", 10.0, 60.0), (1, "w0", 20.0, 30.0), (1, "w1", 0.0, 100.0), (1, "x", 1.0, 2.0)], "plan_id long, wall_id string, g1 double, g2 double")
    got = {(r.wall_id, r.start, r.end) for r in intervals.solid_parts(rows, gaps).collect()}
    assert got == {("w0", 0.0, 10.0), ("w0", 30.0, 100.0), ("w2", 0.0, 50.0)}



def test_lookups_of_walls_do_not_list_openings_in_cells(spark):
    catalog.load_all()
    sf = "/root/testdata/sf0.001"
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = catalog.QUERIES["w07_dedupe_openings"](spark, sf)._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" not in plan
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_windows_tell_their_wall_themselves(spark):
    rows = [(1, f"o{i}", "w0", "window", float(i), i, True) for i in range(5)] + [(1, "d", "w0", "door", 1.0, 9, True), (1, "i", "w1", "window", 1.0, 10, None)]
    df = spark.createDataFrame(rows, "plan_id long, opening_id string, wall_id string, kind string, span double, ord long, is_exterior boolean")
    outer = spark.createDataFrame([(1, "w0", True), (1, "w1", False)], "plan_id long, wall_id string, is_exterior boolean")
    want = {"o2", "o3", "o4", "d", "i"}
    assert {r.opening_id for r in openings.limit_exterior_windows(df, None).collect()} == want
    assert {r.opening_id for r in openings.limit_exterior_windows(df.drop("is_exterior"), outer).collect()} == want
