import numpy as np

from plansift import catalog
from plansift.functions import zones
from plansift.operators import components as C, intervals as I, matching as X, openings as O, sheets as S

SIDES = "plan_id long, room_id long, x double, y double, w double, h double"


def test_listed_edges_are_never_broadcast(spark):
    catalog.load_all()
    plan = catalog.QUERIES["j09_room_adjacency"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastExchange" not in plan


def test_edges_meet_over_the_borders_of_cells(spark):
    # edges up to 5 apart around 64 and 256, and a long room beside a short one
    rooms = [(1, 1, 0, 0, 62, 1000), (1, 2, 66, 700, 100, 20), (1, 3, 300, 250, 50, 6), (1, 4, 300, 258, 50, 9), (2, 5, 0, 0, 62, 10), (2, 6, 67, 0, 9, 10)]
    found = O.room_sides(spark.createDataFrame([(p, r, *map(float, v)) for p, r, *v in rooms], SIDES)).filter("interior").collect()
    assert sorted((r.room_id, r.side) for r in found) == [(1, "right"), (2, "left"), (3, "top"), (4, "bottom")]


def test_seeds_meet_free_boxes_on_their_sheet(spark):
    catalog.load_all()
    plan = catalog.QUERIES["g03_room_regions"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan


def test_seeds_on_sheets_find_what_seeds_over_cells_find(spark):
    # low plans and one of several blocks; seeds inside walls, between rooms, beyond the frame, without a place or label
    boxes, frames, labels = [], [], []
    for plan, (w, h) in enumerate([(300, 200), (130, 70), (90, 5000), (64, 64), (0, 10)]):
        frames.append((plan, w, h))
        boxes += [(plan, x, x + (7 * x + plan) % 90, y, y + 3) for x in range(0, 300, 37) for y in range(0, 5000, 61)]
        boxes += [(plan, x, x + 2, y, y + (5 * y) % 150) for x in range(0, 300, 41) for y in range(0, 5000, 97)]
        labels += [(plan, i, (53 * i + plan) % 330 - 15, (389 * i) % (h + 30) - 15) for i in range(60)]
        labels += [(plan, 90, None, 5), (plan, 91, 5, None), (plan, None, 20, 10)]
    boxes += [(3, 0, 63, 0, 63), (9, 0, 5, 0, 5)]
    walls = spark.createDataFrame(boxes, "plan_id long, x0 long, x1 long, y0 long, y1 long")
    frame = spark.createDataFrame(frames, "plan_id long, w long, h long")
    seeds = spark.createDataFrame(labels + [(9, 1, 3, 3), (None, 1, 3, 3)], "plan_id long, label_ord int, seed_x int, seed_y int")
    free = C.labelled({"m": walls}, frame, lambda s: [s.free(s["m"])], diagonal=False)
    found = C.seeded_regions(seeds, {"m": walls}, frame, lambda s: s.free(s["m"]), 0)
    want = C.room_regions(seeds, free, frame).select(*found.columns)
    key = lambda r: tuple((v is None, v or 0) for v in r)
    rows = sorted(map(tuple, found.collect()), key=key)
    assert len(rows) > 100 and rows == sorted(map(tuple, want.collect()), key=key)
    assert found.schema["label_ord"].dataType == seeds.schema["label_ord"].dataType


def test_gaps_are_told_on_sheets_as_over_cells(spark):
    # walls inside, over and beside the frame, on a low plan and on one of several blocks
    boxes, walls = [], []
    for plan, high in ((1, 400), (2, 6000)):
        for i in range(60):
            flat, c, s = i % 2 == 0, (i * 83) % min(high, 500) - 20, (i * 41) % 90 - 30
            long = high + 50 if i % 7 == 0 and not flat else 60 + (i * 29) % 300
            walls.append((plan, f"w{i}", "horizontal" if flat else "vertical", c, c + 3 + i % 4, float(s), float(s + long)))
            for at in range(s + i % 5, s + long, 31 + i % 11):
                span = (at, at + 12 + i % 9) if i % 3 else (at, at + 40)
                boxes.append((plan, *span, c, c + 3) if flat else (plan, c, c + 3, *span))
    # equal strips of two walls, a strip without a mask, no length, no plan
    walls += [(1, "again", *walls[2][2:]), (1, "bare", "horizontal", 9000, 9004, 0.0, 90.0), (1, "none", "vertical", 5, 9, 7.0, 7.0), (None, "lost", *walls[0][2:]), (8, "alone", *walls[0][2:])]
    walls = spark.createDataFrame(walls, "plan_id long, wall_id string, orientation string, c0 long, c1 long, s double, e double")
    boxes = spark.createDataFrame(boxes, "plan_id long, x0 long, x1 long, y0 long, y1 long")
    frame = spark.createDataFrame([(1, 450, 400), (2, 450, 6000), (3, 10, 10)], "plan_id long, w long, h long")
    for least, context in ((12, 8), (1, 0)):
        got = X.wall_gaps(walls, {"m": boxes}, frame, lambda s: s["m"], 0, least, context)
        runs = X.gaps_along_walls(walls, C.label_boxes(boxes, frame=frame).drop("id", "comp"))
        want = sorted(map(tuple, I.gaps_in_line(runs, ["plan_id", "wall_id"], least, context).collect()))
        rows = sorted(map(tuple, got.collect()))
        assert {p for p, *_ in rows} == {1, 2} and rows == want
    assert any(w == "again" for _, w, *_ in rows)


def test_boxes_of_a_sheet_meet_once(monkeypatch):
    pick = np.random.default_rng(3)

    def some(n):
        x, y = pick.integers(-150, 300, n), pick.integers(-150, 300, n)
        return S.Boxes(pick.integers(0, 3, n), x, x + pick.integers(0, 200, n), y, y + pick.integers(0, 200, n))

    monkeypatch.setattr(zones, "PAIRS", 50)
    a, b = some(80), some(120)
    found = [pair for i, j in S.meetings(a, b) for pair in zip(i.tolist(), j.tolist())]
    want = [(i, j) for i in range(80) for j in range(120) if a.g[i] == b.g[j] and a.x0[i] <= b.x1[j] and b.x0[j] <= a.x1[i] and a.y0[i] <= b.y1[j] and b.y0[j] <= a.y1[i]]
    assert sorted(found) == want
def test_room_spans_are_told_on_sheets_as_over_cells(spark):
    boxes, frames, labels = [], [], []
    for plan, (w, h) in enumerate([(300, 200), (130, 70), (90, 5000), (64, 64)]):
        frames.append((plan, w, h))
        boxes += [(plan, x, x + (7 * x + plan) % 90, y, y + 3) for x in range(0, 300, 37) for y in range(0, 5000, 61)]
        boxes += [(plan, x, x + 2, y, y + (5 * y) % 150) for x in range(0, 300, 41) for y in range(0, 5000, 97)]
        labels += [(plan, i, (53 * i + plan) % 330 - 15, (389 * i) % (h + 30) - 15) for i in range(60)] + [(plan, None, 20, 10)]
    walls = spark.createDataFrame(boxes, "plan_id long, x0 long, x1 long, y0 long, y1 long")
    frame = spark.createDataFrame(frames, "plan_id long, w long, h long")
    seeds = spark.createDataFrame(labels + labels[:9], "plan_id long, label_ord int, seed_x int, seed_y int")
    free = C.labelled({"m": walls}, frame, lambda s: [s.free(s["m"])], diagonal=False)
    want = C.seed_spans(C.room_regions(seeds, free, frame), free)
    found = C.seeded_spans(seeds, {"m": walls}, frame, lambda s: s.free(s["m"]), 0)
    rows = sorted(map(tuple, found.collect()))
    assert len(rows) > 100 and rows == sorted(map(tuple, want.collect()))
    plan = C.seeded_spans(seeds, {"m": walls}, frame.filter("h < 4000"), lambda s: s.free(s["m"]), 0)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan




def test_rooms_of_a_plan_share_sides_in_one_task_as_over_cells(spark, monkeypatch):
    monkeypatch.setattr(zones, "GATHER", 64)
    rng = np.random.default_rng(9)
    rooms = [(int(p), i % 150, *(float(v) for v in (10 * rng.integers(0, 12) + rng.integers(0, 4), 10 * rng.integers(0, 12), 10 * rng.integers(1, 4), 10 * rng.integers(1, 4)))) for i, p in enumerate(rng.integers(0, 9, 400))]
    # rooms that come twice, with a number of their own, with several boxes, far out, without plan, number or place
    rooms += rooms[:30] + [(0, 900, *r[2:]) for r in rooms[:5]] + [(p, 901, float(30 * p), 500.0, 30.0, 30.0) for p in (1, 1, 2)] + [(1, 901, 90.0, 700.0, 9.0, 9.0), (1, 902, 60.0, 500.0, 30.0, 30.0)]
    rooms += [(20, 1, 0.0, 9000.0, 10.0, 10.0), (20, 2, 10.0, 9000.0, 10.0, 10.0), (None, 1, 0.0, 0.0, 9.0, 9.0), (3, None, 0.0, 0.0, 30.0, 30.0), (3, 903, None, 0.0, 9.0, 9.0)]
    table = spark.createDataFrame(rooms, SIDES)
    got, want = O.room_sides(table), O._sides_over_cells(table)
    key = lambda r: tuple((v is None, v or 0) for v in r)
    assert got.columns == want.columns
    assert sorted(map(tuple, got.collect()), key=key) == sorted(map(tuple, want.collect()), key=key)


def test_rooms_of_a_plan_meet_in_one_shuffle(spark):
    catalog.load_all()
    plan = catalog.QUERIES["j09_room_adjacency"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("Exchange ") <= 3
