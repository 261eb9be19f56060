import random

from plansift import catalog
from plansift.operators import regions as R

RECT = "plan_id long, orientation string, ord long, x1 double, y1 double, x2 double, y2 double"


def test_rectangles_of_a_plan_meet_without_joins(spark):
    catalog.load_all()
    plan = catalog.QUERIES["j16_trim_rectangles"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan


def test_few_and_crowded_plans_are_trimmed_alike(spark, monkeypatch):
    pick = random.Random(5)
    rows = []
    for i in range(400):
        plan, flat = i % 9, pick.random() < 0.5
        x, y, long = pick.randint(0, 300), pick.randint(0, 200), pick.randint(1, 250)
        w, h = (long, pick.randint(2, 8)) if flat else (pick.randint(2, 8), long)
        rows.append((plan or None, "horizontal" if flat else "vertical", None if i == 50 else (i * 37) % 401, float(x), float(y), float(x + w), float(y + h)))
    rows.append((1, "horizontal", 900, None, 1.0, 5.0, 2.0))
    rects = spark.createDataFrame(rows, RECT)
    key = lambda r: tuple((v is None, v or 0) for v in r)
    got = {}
    for few in (256, 45, 0):
        monkeypatch.setattr(R, "FEW", few)
        got[few] = sorted(map(tuple, R.trim_rectangles(rects).collect()), key=key)
    assert got[256] == got[45] == got[0] and got[256] != sorted(rows, key=key)
    known = rects.filter("plan_id IS NOT NULL AND ord IS NOT NULL")
    for few in (256, 0):
        monkeypatch.setattr(R, "FEW", few)
        numbers = {(r.plan_id, r.orientation, r.ord): r.n for r in R.trim_rectangles(known, "n").collect()}
        for (plan, orientation, order), n in numbers.items():
            assert n == sum(1 for p, o, k in numbers if (p, o) == (plan, orientation) and k <= order)
