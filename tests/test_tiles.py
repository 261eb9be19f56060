"""Junctions, their pairs and matches, and masks of stages against plain loops."""

import random

import pytest
from pyspark.sql import functions as F

from plansift import catalog
from plansift.operators import junctions as J, masks as M, matching as X
from tests.helpers import H, V, frame, walls

PAIR = "plan_id long, p_ord long, e_ord long, score double"
POINT = "plan_id long, ord long, x double, y double, type string"


def random_walls(seed, n=60, wide=300):
    rng = random.Random(seed)
    rows = [(rng.choice([H, V]), rng.randrange(0, wide, 7), s := rng.randrange(0, wide, 5), s + rng.randrange(20, wide)) for _ in range(n)]
    return rows + rows[:5]


@pytest.mark.parametrize("wide", [300, 2600])
def test_junctions_of_tiles_are_those_of_the_hits(spark, wide):
    rows = walls(spark, random_walls(1, 80, wide)).unionByName(walls(spark, random_walls(2), plan=2))
    want = {tuple(r) for r in J.junctions_from_hits(J.junction_hits(rows)).collect()}
    got = [tuple(r) for r in J.junctions(rows).collect()]
    assert set(got) == want and len(got) == len(want) > 100
    numbered = sorted((r.plan_id, r.ord, r.x, r.y, r.type, r.n_walls) for r in J.numbered_junctions(rows).collect())
    expected = []
    for plan in (1, 2):
        expected += [(plan, i, x, y, t, n) for i, (x, y, t, n) in enumerate(sorted(w[1:] for w in want if w[0] == plan), 1)]
    assert numbered == expected


def test_walls_without_a_place_have_no_junctions(spark):
    rows = walls(spark, random_walls(6)).unionByName(walls(spark, random_walls(7), plan=2))
    for c, of in (("coord", 7), ("s", 11), ("e", 13), ("thickness", 5), ("plan_id", 17)):
        rows = rows.withColumn(c, F.when(F.col("ord") % of != 3, F.col(c)))
    want = sorted(map(tuple, J.junctions_from_hits(J.junction_hits(rows)).collect()))
    assert sorted(map(tuple, J.junctions(rows).collect())) == want and len(want) > 100
    known = rows.filter("plan_id IS NOT NULL AND thickness IS NOT NULL")
    counts = {tuple(r) for r in J.line_connections(J.junction_hits(known)).collect()}
    assert {tuple(r) for r in J.count_connections(known).collect()} == counts


def greedy(pairs):
    out, p_done, e_done = set(), set(), set()
    for plan, p, score, e in sorted((r[0], r[1], r[3], r[2]) for r in pairs):
        if (plan, p) not in p_done and (plan, e) not in e_done:
            p_done.add((plan, p))
            e_done.add((plan, e))
            out.add((plan, p, e, score))
    return out


@pytest.mark.parametrize("most", [1, 40, 1 << 18])
def test_plans_of_any_size_are_matched_alike(spark, monkeypatch, most):
    monkeypatch.setattr(X, "SETTLE", most, raising=False)
    monkeypatch.setattr(X, "GATHER", 16, raising=False)
    rng = random.Random(3)
    pairs = [(plan, rng.randrange(9), rng.randrange(9), float(rng.randrange(4))) for plan in range(6) for _ in range(3 if plan % 2 else 60)]
    # a row without a number is matched with nothing
    rows = spark.createDataFrame([*pairs, (1, None, 3, 0.0), (1, 3, None, 0.0)], PAIR)
    assert {tuple(r) for r in X.greedy_match(rows).collect()} == greedy(pairs)


def test_small_plans_are_matched_without_rounds(spark, monkeypatch):
    def cut(rows):
        raise AssertionError("a round over rows")

    monkeypatch.setattr(X, "cut_lineage", cut)
    rows = [(p, i, i + d, float(d)) for p in range(5) for i in range(20) for d in (0, 1)]
    assert {tuple(r) for r in X.greedy_match(spark.createDataFrame(rows, PAIR)).collect()} == greedy(rows)


def test_pairs_over_the_border_of_tiles(spark):
    rng = random.Random(4)
    point = lambda i: (1, i, float(rng.randrange(490, 540)), float(rng.randrange(490, 540)), rng.choice("LTX"))
    a, b = ([point(i) for i in range(60)] + [(None, 99, 1.0, 1.0, "L"), (1, 98, None, 1.0, "L")] for _ in "ab")
    want = {(1, p[1], e[1]) for p in a[:60] for e in b[:60] if p[4] == e[4] and (p[2] - e[2]) ** 2 + (p[3] - e[3]) ** 2 <= 144}
    left, right = (spark.createDataFrame(r, POINT) for r in (a, b))
    got = [(r.plan_id, r.p_ord, r.e_ord) for r in X.junction_pairs(left, right).collect()]
    assert set(got) == want and len(got) == len(want) > 50
    both = left.selectExpr("*", "'a' AS stage").unionByName(right.selectExpr("*", "'b' AS stage"))
    staged = [(r.pair, r.plan_id, r.p_ord, r.e_ord) for r in X.stage_junction_pairs(both, [("b", "a"), ("a", "b")]).collect()]
    assert sorted(s[1:] for s in staged if s[0] == 1) == sorted(got)
    assert sorted((s[1], s[3], s[2]) for s in staged if s[0] == 0) == sorted(got)


def test_sets_of_many_masks_that_overlap(spark):
    rng = random.Random(5)
    f = frame(spark, 40, 30)
    boxes = [(1, 1 << rng.randrange(40) | 1 << rng.randrange(40), x := rng.randrange(-5, 40), x + rng.randrange(12), y := rng.randrange(-5, 30), y + rng.randrange(9)) for _ in range(40)]
    rows = spark.createDataFrame([*boxes, *boxes[:3], (2, 1, 0, 5, 0, 5)], "plan_id long, bit long, x0 long, x1 long, y0 long, y1 long")
    want = {}
    for x in range(40):
        for y in range(30):
            bits = 0
            for _, bit, x0, x1, y0, y1 in boxes:
                bits |= bit if x0 <= x <= x1 and y0 <= y <= y1 else 0
            want[bits] = want.get(bits, 0) + 1
    want.pop(0, None)
    assert {(r.plan_id, r.bits): r.area for r in M.areas_by_set(rows, frame=f).collect()} == {(1, b): n for b, n in want.items()}


def test_pairs_of_junctions_cost_a_few_shuffles(spark):
    catalog.load_all()
    plan = catalog.QUERIES["j21_junction_pairs"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") <= 6 and "Window" not in plan
