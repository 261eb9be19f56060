import random

from plansift.functions import zones
from plansift.operators import walls as W
from tests.helpers import H, V, walls


def test_snapping_in_one_shuffle_equals_its_two_steps(spark, monkeypatch):
    monkeypatch.setattr(zones, "GATHER", 64)
    draw = random.Random(9)
    rows = None
    for plan, n in ((1, 150), (2, 12), (3, 1), (4, 40)):
        lines = [(draw.choice([H, V]), draw.randrange(-300, 300), s, s + draw.randrange(2, 90)) for s in (draw.randrange(-300, 300) for _ in range(n))]
        part = walls(spark, lines, plan)
        rows = part if rows is None else rows.unionByName(part)
    rows = rows.unionByName(walls(spark, [(H, 7, 0, 50)] * 90 + [(V, 48, 0, 9), (V, 52, 0, 9)], 5))
    names = ["plan_id", "wall_id", "ord", "orientation", "coord", "s", "e", "thickness", "confidence"]
    want = sorted(map(tuple, W.snap_to_axes(W.snap_walls(rows)).select(*names).collect()))
    snapped = W.snap_all(rows)
    got = sorted(map(tuple, snapped.select(*names).collect()))
    assert [r[:4] for r in got] == [r[:4] for r in want]
    assert all(abs(a - b) < 1e-9 for g, w in zip(got, want) for a, b in zip(g[4:], w[4:]))
    assert snapped._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
