import random

from plansift.operators import components as C, masks as M, regions as R
from tests.helpers import frame, mask, pixels_of

W, H = 40, 30


def blob(seed, n=14):
    rng = random.Random(seed)
    out = set()
    for _ in range(n):
        x, y, w, h = rng.randrange(W), rng.randrange(H), rng.randrange(1, 9), rng.randrange(1, 7)
        out |= {(a, b) for a in range(x, min(W, x + w)) for b in range(y, min(H, y + h))}
    return out


def grow(pixels, kernel):
    return {(x + dx, y + dy) for x, y in pixels for dy, a, b in kernel for dx in range(-a, b + 1) if 0 <= x + dx < W and 0 <= y + dy < H}


def shrink(pixels, kernel):
    full = {(x, y) for x in range(W) for y in range(H)}
    return full - grow(full - pixels, [(-dy, b, a) for dy, a, b in kernel])


def labels(pixels, diagonal):
    steps = [(dx, dy) for dx in (-1, 0, 1) for dy in (-1, 0, 1) if (dx or dy) and (diagonal or not (dx and dy))]
    left, out = set(pixels), []
    while left:
        todo, comp = [left.pop()], set()
        while todo:
            p = todo.pop()
            comp.add(p)
            for dx, dy in steps:
                q = (p[0] + dx, p[1] + dy)
                if q in left:
                    left.remove(q)
                    todo.append(q)
        out.append(comp)
    return out


def test_set_operations(spark):
    a, b = blob(1), blob(2)
    ma, mb = mask(spark, a), mask(spark, b)
    assert pixels_of(M.union(ma, mb)) == a | b
    assert pixels_of(M.intersect(ma, mb)) == a & b
    assert pixels_of(M.subtract(ma, mb)) == a - b
    scores = M.mask_scores(ma, mb).first()
    assert scores.iou == round(len(a & b) / len(a | b), 6)
    assert M.mask_scores(ma, ma).first().iou == 1.0


def test_morphology(spark):
    a, f = blob(3), frame(spark, W, H)
    for kernel in (M.rect_kernel(3), M.ellipse_kernel(5), M.rect_kernel(6)):
        assert pixels_of(M.dilate(mask(spark, a), kernel, f)) == grow(a, kernel)
        assert pixels_of(M.erode(mask(spark, a), kernel, f)) == shrink(a, kernel)


def test_components_both_connectivities(spark):
    a = blob(4, 9)
    for diagonal in (True, False):
        stats = C.component_stats(C.label_boxes(mask(spark, a), diagonal)).collect()
        assert sorted(r.area for r in stats) == sorted(len(c) for c in labels(a, diagonal))


def test_column_slabs_are_vertical_runs(spark):
    a = blob(5)
    slabs = M.column_slabs(M.compact(mask(spark, a))).collect()
    runs = {(x, r.y0, r.y1) for r in slabs for x in range(r.x0, r.x1 + 1)}
    flipped = {(y, x) for x, y in a}
    from tests.helpers import runs_of
    assert runs == set(runs_of(flipped))


def test_icon_openings(spark):
    icons = {(x, y) for x in range(10, 16) for y in range(10, 14)} | {(30, 5)}
    rows = R.icons_to_openings(mask(spark, icons), frame(spark, W, H), "door").collect()
    kernel = M.ellipse_kernel(11)
    closed = shrink(grow(icons, kernel), kernel)
    grown = grow(closed, kernel)
    want = [len(c) for c in labels(grown, True) if len(c) >= 120]
    assert sorted(r.area for r in rows) == sorted(want)


def test_region_plan_on_bars(spark):
    boxes = [(20, 20, 120, 30), (20, 60, 120, 70), (150, 20, 160, 120), (180, 20, 190, 120)]
    bars = {(x, y) for a, b, c, d in boxes for x in range(a, c + 1) for y in range(b, d + 1)}
    plan = R.region_plan(mask(spark, bars), frame(spark, 220, 160)).collect()
    assert len(plan) == 4 and max(r.draw_thickness for r in plan) <= 6.0
    meta = R.region_meta(R.region_plan(mask(spark, bars), frame(spark, 220, 160))).first()
    assert meta.region_count == len(plan)


def test_room_seed_on_a_wall_moves_to_the_nearest_open_pixel(spark):
    wall = {(x, y) for x in range(W) for y in range(H) if x == 20 or x == 21}
    f = frame(spark, W, H)
    free = C.label_boxes(M.complement(mask(spark, wall), f), diagonal=False)
    seeds = spark.createDataFrame([(1, 0, 21, 9), (1, 1, 3, 3), (1, 2, 30, 4)], "plan_id long, label_ord int, seed_x int, seed_y int")
    regions = {r.label_ord: r for r in C.room_regions(seeds, free, f).collect()}
    # rings grow by the larger offset; inside the ring the smallest dx, then the smallest dy comes first
    assert (regions[0].seed_x, regions[0].seed_y) == (22, 8)
    assert regions[1].area == 20 * H and regions[2].comp == regions[0].comp
    audit = C.region_audit(C.room_regions(seeds, free, f)).first()
    assert audit.union_area_px == (20 + 18) * H and audit.duplicated_region_count == 1


def test_endpoint_clusters_skip_ends_of_one_wall(spark):
    rows = [(1, 0, 0, 0.0, 0.0), (1, 0, 1, 5.0, 0.0), (1, 1, 0, 100.0, 0.0), (1, 1, 1, 200.0, 0.0), (1, 2, 0, 206.0, 0.0), (1, 2, 1, 300.0, 0.0)]
    df = spark.createDataFrame(rows, "plan_id long, wall_no long, end_no int, x double, y double")
    out = {(r.wall_no, r.end_no): (r.x, r.n) for r in C.endpoint_clusters(df).collect()}
    assert out[(0, 0)] == (0.0, 1) and out[(0, 1)] == (5.0, 1)
    assert out[(1, 1)] == (203.0, 2) == out[(2, 0)]


def test_chains_in_few_steps(spark):
    a, f = blob(6, 20), frame(spark, W, H)
    k, m = M.rect_kernel(3, 2), M.rect_kernel(6)
    flip = lambda kernel: [(-dy, r, left) for dy, left, r in kernel]
    steps = [*M.closing(k), *M.opening(m)]
    assert len(M.shorten(steps)) == 3
    want = grow(shrink(shrink(grow(a, k), k), m), flip(m))
    assert pixels_of(M.close_open(mask(spark, a), k, m, f)) == want
    e = M.ellipse_kernel(7)
    grown = pixels_of(M.boxes_to_runs(M.morph(M.compact(mask(spark, a)), [*M.closing(e), M.grow(e)], f)))
    assert grown == grow(shrink(grow(a, e), e), e)
    clipped = pixels_of(M.open_(mask(spark, a), M.rect_kernel(3), f, border="clip"))
    inner = {(x, y) for x, y in a if all((x + i, y + j) in a for i in (-1, 0, 1) for j in (-1, 0, 1))}
    assert clipped == grow(inner, M.rect_kernel(3))


def test_morphology_of_empty_and_full_plans_over_many_bands(spark):
    f = frame(spark, 30, 200).unionByName(frame(spark, 5, 5, plan=2))
    a = {(x, y) for x in range(4, 9) for y in range(3, 190)} | {(29, 199)}
    kernel = M.rect_kernel(5)
    whole = {(x, y) for x in range(30) for y in range(200)}
    got = M.erode(mask(spark, a), kernel, f)
    assert pixels_of(got.filter("plan_id = 1")) == {(x, y) for x, y in a if all((x + i, y + j) in a or (x + i, y + j) not in whole for i in range(-2, 3) for j in range(-2, 3))}
    assert got.filter("plan_id = 2").count() == 0
    assert pixels_of(M.erode(mask(spark, whole), kernel, f)) == whole
