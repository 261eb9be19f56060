from collections import Counter

from pyspark.sql import functions as F

from plansift.operators import gates, intervals, junctions, matching, openings, walls as W
from tests.helpers import BOX, H, V, walls


def types(spark, rows):
    return Counter(r.type for r in junctions.junctions(walls(spark, rows)).collect())


def test_box_has_four_corners(spark):
    assert types(spark, BOX) == {"L": 4}


def test_interior_wall_adds_two_t(spark):
    assert types(spark, BOX + [(V, 100, 0, 120)])["T"] == 2


def test_cross_is_one_x(spark):
    rows = junctions.junctions(walls(spark, [(H, 50, 0, 200), (V, 100, 0, 120)])).collect()
    assert [(r.x, r.y, r.type) for r in rows] == [(100.0, 50.0, "X")]


def test_junctions_across_cells_and_negative_coordinates(spark):
    rows = [(H, -70, -300, 300), (V, -130, -400, 400), (V, 128, -400, 400)]
    assert types(spark, rows) == {"X": 2}


def test_merge_is_idempotent(spark):
    once = W.merge_collinear(walls(spark, [(H, 10, 0, 50), (H, 10, 60, 90), (H, 10, 300, 400), (V, 5, 0, 8)]))
    spans = {(r.orientation, r.s, r.e) for r in once.collect()}
    assert spans == {(H, 0.0, 90.0), (H, 300.0, 400.0)}
    assert {(r.orientation, r.s, r.e) for r in W.merge_collinear(once).collect()} == spans


def test_box_walls_are_exterior_and_pass_the_gate(spark):
    rows = walls(spark, BOX)
    out = W.classify_exterior(rows, junctions.line_connections(junctions.junction_hits(rows)))
    assert {r.wall_id: r.side for r in out.collect()} == {"w0": "bottom", "w1": "top", "w2": "left", "w3": "right"}
    shell = gates.shell_coverage(out).first()
    assert (shell.bbox_sides_covered, shell.bbox_avg_side_coverage) == (4, 1.0)


def gate(spark, n_open, n_ext, disabled):
    row = [(4, n_open, n_ext, 4, 1.0, disabled, [])]
    df = spark.createDataFrame(row, "wall_count int, opening_count int, exterior_wall_count int, bbox_sides_covered int, bbox_avg_side_coverage double, detection_disabled boolean, review_flags array<string>")
    return gates.quality_gate(df).first()


def test_gate_reasons(spark):
    bad = gate(spark, 0, 0, False)
    assert bad.gate_reasons == ["no_openings_detected", "anomalous_exterior_wall_count"] and not bad.gate_passed
    assert gate(spark, 0, 4, True).gate_passed


def test_identical_structures_score_one(spark):
    from tests.helpers import frame
    rows = walls(spark, BOX)
    out = matching.compare_stages(rows, rows, frame(spark, 220, 160)).first()
    assert out.wall_footprint_iou == 1.0 and out.wall_count_diff == 0


def test_solid_parts_follow_gap_order(spark):
    w = walls(spark, [(H, 0, 0, 100)])
    g = spark.createDataFrame([(1, "w0", 10.0, 60.0), (1, "w0", 20.0, 30.0), (1, "w0", 80.0, 90.0)], "plan_id long, wall_id string, g1 double, g2 double")
    parts = sorted((r.start, r.end) for r in intervals.solid_parts(w, g).collect())
    assert parts == [(0.0, 10.0), (30.0, 80.0), (90.0, 100.0)]


def fold_openings(items):
    kept = []
    for along, span, ord_ in sorted(items, key=lambda t: (t[0], t[2])):
        hit = next((k for k in kept if min(along + span / 2, k[0] + k[1] / 2) - max(along - span / 2, k[0] - k[1] / 2) > 0.5 * min(span, k[1])), None)
        if hit is None:
            kept.append((along, span, ord_))
        elif span > hit[1]:
            kept.remove(hit)
            kept.append((along, span, ord_))
    return {(a, s) for a, s, _ in kept}


def test_dedupe_matches_a_plain_loop(spark):
    import random
    rng = random.Random(3)
    items = [(float(rng.randrange(0, 300)), float(rng.randrange(5, 40)), i) for i in range(120)]
    items += [(a, s, i + 1000) for a, s, i in items[:30]]
    df = spark.createDataFrame([(1, "w", "door", o, a, s) for a, s, o in items], "plan_id long, wall_id string, kind string, ord long, along double, span double")
    assert {(r.along, r.span) for r in openings.dedupe_on_wall(df).collect()} == fold_openings(items)


def test_greedy_match_equals_a_plain_loop(spark):
    import random
    rng = random.Random(5)
    pred = [(i, rng.random() * 120, rng.random() * 60, rng.choice("LT")) for i in range(90)]
    truth = [(i, rng.random() * 120, rng.random() * 60, rng.choice("LT")) for i in range(80)]
    used, want = set(), set()
    for i, x, y, t in pred:
        best = min((((x - a) ** 2 + (y - b) ** 2) ** 0.5, j) for j, a, b, u in truth if u == t and j not in used) if any(u == t and j not in used for j, _, _, u in truth) else None
        if best and best[0] <= 12:
            used.add(best[1])
            want.add((i, best[1]))
    schema = "plan_id long, ord long, x double, y double, type string"
    p, e = (spark.createDataFrame([(1, *r) for r in rows], schema) for rows in (pred, truth))
    got = matching.greedy_match(matching.junction_pairs(p, e))
    assert {(r.p_ord, r.e_ord) for r in got.collect()} == want
    m = matching.match_metrics(p, e, got).first()
    assert m.matches == len(want) and m.precision == round(len(want) / 90, 6)


def test_shared_walls_merge_one_thickness_apart(spark):
    rows = [(1, 96.0, 0.0, 50.0), (1, 100.0, 40.0, 90.0), (1, 104.0, 200.0, 300.0), (1, 300.0, 0.0, 9.0)]
    df = spark.createDataFrame(rows, "plan_id long, coord double, s double, e double")
    assert sorted((r.coord, r.s, r.e) for r in matching.merge_shared_walls(df).collect()) == [(100.0, 0.0, 90.0), (104.0, 200.0, 300.0), (300.0, 0.0, 9.0)]


def test_resolver_leaves_no_overlap_for_drawings(spark):
    rows = walls(spark, BOX).select("plan_id", "wall_id", "ord", "orientation", F.col("coord").alias("mid"), F.col("s").alias("lo"), F.col("e").alias("hi"), F.lit(2.0).alias("half"))
    out = {r.wall_id: (r.lo, r.hi) for r in matching.resolve_junctions(rows, "dxf").collect()}
    assert out["w0"] == (-2.0, 202.0) and out["w2"] == (2.0, 118.0)


def greedy_loop(pairs):
    used, out = set(), []
    by_p = {}
    for p, e, score in pairs:
        by_p.setdefault(p, []).append((score, e))
    for p in sorted(by_p):
        free = [(score, e) for score, e in by_p[p] if e not in used]
        if free:
            score, e = min(free)
            used.add(e)
            out.append((p, e, score))
    return sorted(out)


def test_greedy_match_of_one_component_of_100_000_pairs(spark):
    import random
    rng = random.Random(8)
    pairs = sorted({(p, rng.randrange(16_000)) for p in range(20_000) for _ in range(6)})[:100_000]
    scored = [(p, e, float(rng.randrange(40))) for p, e in pairs]
    df = spark.createDataFrame([(1, *r) for r in scored], "plan_id long, p_ord long, e_ord long, score double")
    assert sorted((r.p_ord, r.e_ord, r.score) for r in matching.greedy_match(df).collect()) == greedy_loop(scored)


def test_greedy_match_of_nothing_and_of_a_chain(spark):
    schema = "plan_id long, p_ord long, e_ord long, score double"
    assert matching.greedy_match(spark.createDataFrame([], schema)).count() == 0
    # everyone wants what the one before takes
    chain = [(p, e, float(p - e)) for p in range(12) for e in (p, p - 1) if e >= 0]
    df = spark.createDataFrame([(1, *r) for r in chain], schema)
    assert sorted((r.p_ord, r.e_ord, r.score) for r in matching.greedy_match(df).collect()) == greedy_loop(chain)


def test_wall_support_counts_pixels(spark):
    lines = walls(spark, [(H, 50, 0, 200), (V, 100, 0, 200)])
    drawn = spark.createDataFrame([(1, 0, 60, 48, 49), (1, 96, 99, 150, 150), (1, 101, 101, 150, 151)], "plan_id long, x0 long, x1 long, y0 long, y1 long")
    rows = [(0, "w0", 70.0, 50.0, 6.0), (1, "w0", 68.0, 50.0, 8.0), (2, "w0", 120.0, 50.0, 4.0), (3, "w1", 100.0, 150.0, 4.0), (4, "w9", 30.0, 50.0, 9.0), (5, "w0", 30.0, 50.0, 9.0)]
    ops = spark.createDataFrame([(1, *r) for r in rows], "plan_id long, ord long, wall_id string, x double, y double, span double")
    # a wall of 4 covers coord - 2 to coord + 1 and needs 4 pixels: ord 0 sees none, ord 1 sees two of column 60, ord 3 sees four
    wall_0, wall_1 = {(x, y) for x in range(0, 201) for y in range(48, 52)}, {(x, y) for x in range(98, 102) for y in range(0, 201)}
    mask_px = {(x, y) for _, x0, x1, y0, y1 in drawn.collect() for x in range(x0, x1 + 1) for y in range(y0, y1 + 1)}
    want = set()
    for ord_, wall, x, y, span in rows:
        r = max(8, round(span))
        box = {p for p in {"w0": wall_0, "w1": wall_1}.get(wall, set()) if abs(p[0] - x) <= r and abs(p[1] - y) <= r}
        if len(box & mask_px) >= 4:
            want.add(ord_)
    assert {r.ord for r in matching.wall_support(ops, lines, drawn).collect()} == want == {3, 5}


def test_contracted_edges_keep_components(spark):
    import random
    from plansift.operators import components as C
    rng = random.Random(2)
    edges = [(k, rng.randrange(400), rng.randrange(400)) for k in (1, 2) for _ in range(300)]
    df = spark.createDataFrame(edges, "plan_id long, a long, b long").repartition(3)
    plain = {(r.plan_id, r.id): r.comp for r in C.star_components(df, "plan_id").collect()}
    small = C.contract(df, "plan_id")
    assert {(r.plan_id, r.id): r.comp for r in C.star_components(small, "plan_id").collect()} == plain
    assert small.repartition(1).count() <= 3 * len(plain)


def test_folds_stream_through_a_chain_of_100_000(spark):
    import random
    rng = random.Random(4)
    items = [(3.0 * i, float(rng.randrange(4, 14)), i) for i in range(100_000)]
    schema = "plan_id long, wall_id string, kind string, ord long, along double, span double"
    df = spark.createDataFrame([(1, "w", "door", o, a, s) for a, s, o in items], schema)
    got = {(r.along, r.span, r.ord) for r in openings.dedupe_on_wall(df).collect()}
    kept = []
    for along, span, ord_ in items:
        hit = next((k for k in kept[-12:] if min(along + span / 2, k[0] + k[1] / 2) - max(along - span / 2, k[0] - k[1] / 2) > 0.5 * min(span, k[1])), None)
        if hit is not None and span <= hit[1]:
            continue
        if hit is not None:
            kept.remove(hit) if len(kept) < 12 else kept.__delitem__(len(kept) - 12 + kept[-12:].index(hit))
        kept.append((along, span, ord_))
    assert got == set(kept)


def test_mask_walls_merge_as_in_a_plain_loop(spark):
    import random
    rng = random.Random(6)
    rows = [(1, "horizontal", i, rng.randrange(300), s := rng.randrange(400), s + rng.randrange(5, 60)) for i in range(400)]
    df = spark.createDataFrame(rows, "plan_id long, orientation string, ord long, coord long, s long, e long")
    want = []
    for coord, s, e in sorted((c, s, o, e) for _, _, o, c, s, e in rows) and [(c, s, e) for c, s, o, e in sorted((c, s, o, e) for _, _, o, c, s, e in rows)]:
        for m in want:
            if abs(coord - m[0]) < 16 and s <= m[2] + 15 and e >= m[1] - 15:
                m[:] = [(coord + m[0]) // 2, min(s, m[1]), max(e, m[2])]
                break
        else:
            want.append([coord, s, e])
    assert sorted((r.coord, r.s, r.e) for r in matching.merge_mask_walls(df).collect()) == sorted(map(tuple, want))


def test_nearest_point_over_grid_levels(spark):
    import random
    from plansift.operators import nearest
    rng = random.Random(12)
    spots = [(p, rng.choice((0, 1)) * 9000 + rng.random() * 50, rng.random() * 40 - 3000, i) for p in (1, 2) for i in range(40)] + [(3, 5.0, 5.0, 0)]
    points = [(p, i, rng.uniform(-20_000, 20_000), rng.uniform(-4000, 9000)) for p in (1, 2, 3, 4) for i in range(60)] + [(1, 100, *spots[0][1:3])]
    df = spark.createDataFrame(points, "plan_id long, opening_id long, x double, y double")
    targets = spark.createDataFrame(spots, "plan_id long, tx double, ty double, tord long")
    got = {(r.plan_id, r.opening_id): (r.hit.payload, round(r.hit.dist, 6)) for r in nearest.nearest_point(df, targets, ["plan_id", "opening_id"], F.col("tord"), None).collect()}
    want = {}
    for p, i, x, y in points:
        near = min(((abs(x - a) + abs(y - b), o) for q, a, b, o in spots if q == p), default=None)
        if near:
            want[p, i] = (near[1], round(near[0], 6))
    assert got == want


def test_wall_support_counts_a_pixel_once_and_over_blocks(spark):
    lines = walls(spark, [(V, 100, 4000, 4200)])
    ops = spark.createDataFrame([(1, 0, "w0", 100.0, 4096.0, 4.0), (1, 1, "w0", 100.0, 4030.0, 4.0)], "plan_id long, ord long, wall_id string, x double, y double, span double")
    frame = spark.createDataFrame([(1, 300, 5000)], "plan_id long, w long, h long")
    columns = "plan_id long, x0 long, x1 long, y0 long, y1 long"
    # ord 0 sees two pixels above and two below the border of blocks; ord 1 sees two, drawn twice
    drawn = spark.createDataFrame([(1, 99, 99, 4094, 4097), (1, 99, 100, 4030, 4030), (1, 99, 100, 4030, 4030), (1, 98, 100, 4030, 4030)], columns)
    assert [r.ord for r in matching.wall_support(ops, lines, drawn, frame).collect()] == [0]
    # four of them, one in both boxes
    more = drawn.unionByName(spark.createDataFrame([(1, 100, 101, 4030, 4030)], columns))
    assert sorted(r.ord for r in matching.wall_support(ops, lines, more, frame).collect()) == [0, 1]
