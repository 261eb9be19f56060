"""Masks on sheets: plans of several blocks, rough boxes, and the price of an expression."""

import random

import numpy as np
import pytest

from plansift import catalog
from plansift.operators import components as C, masks as M, sheets as S
from tests.helpers import frame

BOX = "plan_id long, x0 long, x1 long, y0 long, y1 long"
HIGH = 2 * S.BLOCK + 500


def shapes(seed, at, n=25):
    """Boxes of 60 x 60 pixels around row ``at``, overlapping and repeated."""
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        x, y = rng.randrange(10, 60), rng.randrange(60)
        out.append((1, x, x + rng.randrange(9), at + y, at + y + rng.randrange(9)))
    # a closed room over the border of blocks
    out += [(1, 20, 22, at + 5, at + 55), (1, 40, 42, at + 5, at + 55), (1, 20, 42, at + 5, at + 7), (1, 20, 42, at + 53, at + 55)]
    return out + out[:3]


def pixels(boxes, at):
    return sorted((x, y - at) for r in boxes.collect() for x in range(r.x0, r.x1 + 1) for y in range(r.y0, r.y1 + 1))


@pytest.mark.parametrize("work", ["merge", "close_open", "subtract", "footprint", "columns"])
def test_a_mask_over_the_border_of_blocks_is_the_same_mask(spark, work):
    f = frame(spark, 90, HIGH)
    got = []
    for at in (1000, S.BLOCK - 30):
        a, b = (spark.createDataFrame(shapes(seed, at, n), BOX) for seed, n in ((1, 12), (2, 25)))
        out = {
            "merge": lambda: M.merge_boxes(a), "close_open": lambda: M.close_open(a, M.rect_kernel(5, 2), M.rect_kernel(3), f),
            "subtract": lambda: M.subtract(b, a, f), "footprint": lambda: C.footprint(a, f), "columns": lambda: M.column_slabs(a),
        }[work]()
        got.append(pixels(out, at))
    assert got[0] == got[1] and len(got[0]) == len(set(got[0])) > 0


def test_components_over_the_border_of_blocks(spark):
    f = frame(spark, 90, HIGH)
    got = []
    for at in (1000, S.BLOCK - 30):
        for diagonal in (True, False):
            boxes = spark.createDataFrame(shapes(3, at, 20), BOX)
            stats = C.component_stats(C.label_boxes(boxes, diagonal, f)).collect()
            got.append((diagonal, sorted((r.area, r.bx0, r.bx1, r.by0 - at, r.by1 - at, r.comp - at * S.ROW) for r in stats)))
            assert sorted(r.area for r in C.component_stats(C.label_boxes(boxes, diagonal)).collect()) == sorted(r.area for r in stats)
    assert got[:2] == got[2:]


def test_areas_of_sets_of_rough_boxes(spark):
    f = frame(spark, 50, 40).unionByName(frame(spark, 10, 10, plan=2))
    a = [(1, -5, 9, -5, 9), (1, 0, 9, 0, 9), (1, 45, 60, 30, 70), (3, 0, 5, 0, 5)]
    b = [(1, 5, 14, 5, 14), (2, 8, 20, 8, 20)]
    rows = M.set_areas({"a": spark.createDataFrame(a, BOX), "b": spark.createDataFrame(b, BOX)}, f).collect()
    assert sorted((r.plan_id, r.bits, r.area) for r in rows) == [(1, 1, 75 + 50), (1, 2, 75), (1, 3, 25), (2, 2, 4)]


def test_many_plans_in_one_task(spark, monkeypatch):
    rows = [(p, x, x + 2, y, y + 2) for p in range(300) for x, y in ((p % 7, 3), (p % 5 + 4, 5), (30, p % 11))]
    boxes = spark.createDataFrame(rows, BOX).coalesce(1)
    areas = {r.plan_id: r.area for r in M.set_areas({"m": boxes}).collect()}
    assert areas == {p: len({(x, y) for q, x0, x1, y0, y1 in rows if q == p for x in range(x0, x1 + 1) for y in range(y0, y1 + 1)}) for p in range(300)}


@pytest.mark.parametrize("name", ["a10_footprint_scores", "m03_close_open", "m11_closed_mask", "f13_eraser", "g02_components"])
def test_an_expression_costs_a_few_shuffles_and_lists_no_rows(spark, name):
    catalog.load_all()
    plan = catalog.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") <= 4 and "Window" not in plan and "sequence(y0" not in plan


def random_boxes(seed, plans, n):
    rng = random.Random(seed)
    rows = sorted((rng.randrange(plans), rng.randrange(60), rng.randrange(40), rng.randrange(9), rng.randrange(9)) for _ in range(n))
    g, x, y, w, h = (np.array(c) for c in zip(*rows))
    return S.Boxes(g, x, x + w, y, y + h)


def test_strips_cover_what_the_rectangles_cover():
    box = S.Boxes(*(np.array([v]) for v in (0, 20, 23, 30, 31)))
    covered = lambda boxes: sorted((x, y) for x0, x1, y0, y1 in zip(boxes.x0, boxes.x1, boxes.y0, boxes.y1) for x in range(x0, x1 + 1) for y in range(y0, y1 + 1))
    kernels = [M.grow(M.ellipse_kernel(11)).grow, M.grow(M.rect_kernel(4)).grow, ((0, 3, 2, 5), (4, 1, 1, 0), (2, 2, 0, 9)), ((0, 0, 0, 0), (1, 0, 0, 0), (0, 0, 3, 0))]
    for grow in kernels:
        got = covered(S.strips(grow, box))
        each = [covered(S.Boxes(box.g, box.x0 - left, box.x1 + right, box.y0 - up, box.y1 + down)) for up, down, left, right in grow]
        # no pixel twice
        assert got == sorted(set(sum(each, [])))


def test_a_chain_of_steps_holds_a_bounded_number_of_cut_boxes(monkeypatch):
    kernel = M.ellipse_kernel(15)
    steps = M.shorten([*M.closing(kernel), M.grow(kernel)])
    n = 400
    boxes = random_boxes(5, n, 8 * n)
    sheet = S.Sheet(n + 1, {"m": boxes}, np.zeros(n + 1, int), (np.full(n + 1, 80), np.full(n + 1, 60)), 40)
    whole = sheet.morph(sheet["m"], steps)
    sizes = []
    ramps = S.ramps
    monkeypatch.setattr(S, "PIECES", 2000, raising=False)
    monkeypatch.setattr(S, "ramps", lambda counts: sizes.append(counts.sum()) or ramps(counts))
    parts = sheet.morph(sheet["m"], steps)
    assert all((a == b).all() for a, b in zip(vars(whole).values(), vars(parts).values()))
    # one sheet more than the bound at most
    assert max(sizes) < 2000 + 5000
