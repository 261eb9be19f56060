import random

import pytest

from plansift import catalog
from plansift.functions import zones
from plansift.operators import components as C

ENDS = "plan_id long, wall_no long, end_no int, x double, y double"


def plain(rows, tolerance):
    """Comp, size and mean of every end by the definition."""
    comp = {r[:3]: r[1] * 2 + r[2] for r in rows}
    known = [r for r in rows if r[3] is not None and r[4] is not None]
    near = [(a[:3], b[:3]) for a in known for b in known if a[0] == b[0] and a[1] != b[1] and (a[3] - b[3]) ** 2 + (a[4] - b[4]) ** 2 <= tolerance**2]
    moved = True
    while moved:
        moved = False
        for a, b in near:
            if comp[b] < comp[a]:
                comp[a], moved = comp[b], True
    out = {}
    for r in rows:
        mates = [q for q in rows if q[0] == r[0] and comp[q[:3]] == comp[r[:3]]]
        mean = [None if r[i] is None else round(sum(q[i] for q in mates) / len(mates), 6) for i in (3, 4)]
        out[r[:3]] = (comp[r[:3]], len(mates), *mean)
    return out


@pytest.mark.parametrize("rows_of_block, gather", [(4096, 1 << 15), (64, 16)])
def test_clusters_over_blocks_equal_the_definition(spark, monkeypatch, rows_of_block, gather):
    monkeypatch.setattr(C, "BLOCK_ROWS", rows_of_block)
    monkeypatch.setattr(zones, "GATHER", gather)
    draw = random.Random(3)
    rows = [(p, w, e, float(draw.randrange(-90, 90)), float(draw.randrange(-150, 150))) for p, n in ((1, 60), (2, 25), (3, 2)) for w in range(n) for e in (0, 1)]
    # a wall of no length alone, one beside another wall, a crowded point and ends without a place
    rows += [(4, 0, 0, 5.0, 5.0), (4, 0, 1, 5.0, 5.0), (4, 1, 0, 90.0, 0.0), (4, 1, 1, 90.0, 0.0), (4, 2, 0, 95.0, 0.0), (4, 2, 1, 300.0, 0.0)]
    rows += [(5, w, 0, 7.0, 33.0) for w in range(80)] + [(5, w, 1, 400.0 + 30 * w, 33.0) for w in range(80)]
    rows += [(6, 0, 0, None, 1.0), (6, 1, 0, None, 1.0), (6, 2, 0, 3.0, None)]
    out = C.endpoint_clusters(spark.createDataFrame(rows, ENDS)).collect()
    got = {(r.plan_id, r.wall_no, r.end_no): (r.comp, r.n, *[None if v is None else round(v, 6) for v in (r.x, r.y)]) for r in out}
    assert len(out) == len(rows)
    want = plain(rows, 12.0)
    assert {k: v for k, v in got.items() if k[0] != 6} == {k: v for k, v in want.items() if k[0] != 6}
    assert [got[6, w, 0][:2] for w in range(3)] == [(2 * w, 1) for w in range(3)]


def test_ends_are_shuffled_once(spark):
    catalog.load_all()
    plan = catalog.QUERIES["g01_endpoint_clusters"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Join" not in plan
