"""Run reports, review geometry, archive lists and structure lines against plain loops."""

import math
from collections import Counter, defaultdict

from plansift.catalog import datasets
from plansift.operators import drawing, matching, openings
from plansift.sources import archives, reports, structures

RESULT = "run_id string, case_id long, success boolean, needs_review boolean, meets_thresholds boolean, normalized boolean, elapsed_ms long"
RUN = "run_id string, dataset string, backend string, is_baseline boolean"


def results(spark, rows):
    return spark.createDataFrame(rows, RESULT)


def test_report_of_runs_with_numbers_as_names(spark, tmp_path):
    path = str(tmp_path / "report")
    rows = [("007", 1, True, False, True, False, 10), ("007", 2, False, True, False, True, 30), ("8/a", 1, True, True, None, None, 5)]
    runs = [("007", "d", "b", True), ("8/a", "d", "b", False)]
    reports.write(results(spark, rows), spark.createDataFrame(runs, RUN), path)
    got = {r.run_id: r for r in reports.read(spark, path, reports.SUMMARY).collect()}
    assert set(got) == {"007", "8/a"}
    seven, eight = got["007"], got["8/a"]
    assert (seven.total, seven.passed, seven.failed, seven.pass_rate, seven.avg_elapsed_ms, seven.normalized_case_count, seven.native_case_count) == (2, 1, 1, 0.5, 20.0, 1, 1)
    assert (eight.threshold_passed, eight.threshold_failed, eight.threshold_pass_rate, eight.review_rate, eight.native_case_count) == (0, 0, 0.0, 1.0, 1)
    assert [r.run_id for r in reports.read(spark, path, reports.BASELINES).collect()] == ["007"]
    assert reports.read(spark, path, reports.RESULTS, "007").count() == 2


def test_a_run_written_again_leaves_the_others(spark, tmp_path):
    path = str(tmp_path / "report")
    both = [("a", 1, False, False, None, False, 1), ("a", 2, False, False, None, False, 1), ("b", 1, True, False, None, False, 2)]
    reports.write(results(spark, both), spark.createDataFrame([("a", "d", "x", False), ("b", "d", "x", False)], RUN), path)
    assert reports.read(spark, path, reports.BASELINES).count() == 0
    again = [("a", 3, True, False, True, False, 7)]
    for _ in range(2):
        reports.write(results(spark, again), spark.createDataFrame([("a", "d", "x", True)], RUN), path)
        assert sorted((r.run_id, r.case_id, r.success) for r in reports.read(spark, path, reports.RESULTS).collect()) == [("a", 3, True), ("b", 1, True)]
        assert sorted((r.run_id, r.total) for r in reports.read(spark, path, reports.SUMMARY).collect()) == [("a", 1), ("b", 1)]
    assert [r.run_id for r in reports.read(spark, path, reports.BASELINES).collect()] == ["a"]


def test_against_baseline(spark):
    rows = [("base", 1, True, None, None, None, 10), ("base", 2, True, None, None, None, 10), ("base", 3, False, None, None, None, 10),
            ("new", 1, True, None, None, None, 14), ("new", 2, False, None, None, None, 10), ("new", 2, True, None, None, None, 12), ("new", 3, True, None, None, None, 10), ("new", 9, True, None, None, None, 1),
            ("none", 4, None, None, None, None, None), ("other", 1, True, None, None, None, 3)]
    runs = spark.createDataFrame([("base", "d", "b", True), ("new", "d", "b", False), ("none", "d", "b", False), ("other", "d", "c", False)], RUN)
    got = {r.run_id: tuple(r)[1:] for r in reports.against_baseline(results(spark, rows), runs, runs.filter("is_baseline")).collect()}
    assert got == {"new": ("base", 3, 1, 0, 1, 1, 2.0), "none": ("base", 0, 1, 3, 0, 0, None)}


def test_door_arcs(spark):
    rows = [(1, "a", "door", 0.0, 0.0, 30.0, 0.0, "up"), (1, "b", "door", 5.0, 10.0, 5.0, 50.0, "left"), (1, "w", "window", 0.0, 0.0, 30.0, 0.0, "up"), (1, "z", "door", 0.0, 0.0, 30.0, 0.0, None)]
    df = spark.createDataFrame(rows, "plan_id int, opening_id string, type string, x1 double, y1 double, x2 double, y2 double, swing string")
    turn = {"up": (0, -1), "down": (0, 1), "left": (-1, 0), "right": (1, 0)}
    want = {}
    for _, name, kind, x1, y1, x2, y2, swing in rows:
        if kind == "door" and swing:
            w = math.hypot(x2 - x1, y2 - y1)
            tip = x1 + turn[swing][0] * w, y1 + turn[swing][1] * w
            want[name] = (*tip, tip[0] + x2 - x1, tip[1] + y2 - y1, x2, y2)
    got = {r.opening_id: [round(v, 6) + 0.0 for v in tuple(r)[2:]] for r in drawing.preview_arcs(df.filter("swing IS NOT NULL")).collect()}
    assert got == {k: [round(v, 6) + 0.0 for v in t] for k, t in want.items()}
    # without a swing there is no leaf to draw, but the row stays
    assert [r.start_x for r in drawing.preview_arcs(df.filter("swing IS NULL")).collect()] == [None]


def test_review_keeps_typed_annotations(spark):
    rows = [("a", "door", "1", "2", "3", "4"), ("b", "room", "1", "2", "3", "4"), ("c", "window", None, "2", "3", "4"), ("d", "window", "x", "2", "3", "4"), ("e", None, "1", "2", "3", "4")]
    df = spark.createDataFrame(rows, "opening_id string, type string, x1 string, y1 string, x2 string, y2 string")
    got = drawing.review_annotations(df).collect()
    assert [(r.opening_id, r.x1, r.y2) for r in got] == [("a", 1.0, 4.0)]


def test_hint_lists_and_totals(spark):
    names = ["a/Label.TXT", "a/b.png", "x.JPG", "my.json.png", "plain", "d/.svg", None]
    rows = [("big", i % 400, f"{i % 3}/{i}_{names[i % 6]}") for i in range(900)] + [("small", i, n) for i, n in enumerate(names)]
    df = spark.createDataFrame(rows, "archive string, ordinal long, name string").repartition(7)
    want, totals = defaultdict(list), Counter()
    for archive, ordinal, name in rows:
        totals[archive] += 1
        low = (name or "").lower()
        if any(h in low for h in (".json", ".xml", ".txt", ".csv", "annotation", "label")):
            want[archive, "annotation"].append((ordinal, name))
        if low.endswith((".png", ".jpg", ".jpeg", ".bmp")):
            want[archive, "image"].append((ordinal, name))
    got = defaultdict(list)
    for r in archives.hint_lists(df).orderBy("rn").collect():
        got[r.archive, r.hint].append((r.ordinal, r.name))
    assert got == {k: sorted(v)[:50] for k, v in want.items()}
    for r in archives.archive_totals(df).collect():
        assert (r.members_scanned, r.annotation_like, r.image_like) == (totals[r.archive], len(want[r.archive, "annotation"]), len(want[r.archive, "image"]))
    assert archives.hint_lists(df.limit(0)).count() == 0


def test_structure_lines_round_trip(spark, tmp_path):
    doc = '{"walls":[{"id":"w\\t1\\n","orientation":"horizontal","polyline":[{"x":0,"y":1},{"x":9,"y":1}]}],"junctions":[{"point":{"x":0,"y":1},"type":"L","wall_ids":["w"]}]}'
    docs = spark.createDataFrame([(1, doc), (2, None), (3, "not json"), (None, doc)], "doc_id long, doc string")
    structures.write_lines(docs, "doc_id", "doc", str(tmp_path / "s"))
    back = structures.read_lines(spark, str(tmp_path / "s"))
    assert sorted(r.doc_id for r in back.collect()) == [1, 2, 3]
    walls = structures.explode_walls(back, "doc_id").collect()
    assert [(r.doc_id, r.wall_id, r.x2, r.thickness) for r in walls] == [(1, "w\t1\n", 9.0, 4.0)]
    assert [(r.doc_id, r.type, r.wall_ids) for r in structures.explode_junctions(back, "doc_id").collect()] == [(1, "L", ["w"])]
    assert structures.explode_openings(back, "doc_id").count() == 0


def test_windows_and_segments_on_one_place(spark):
    windows = [(1, f"o{i}", float(50 + i % 3), 10.0 + i % 2, "horizontal") for i in range(300)]
    segments = [(1, i, "horizontal" if i % 2 else "vertical", float(10 + i % 4), 0.0, 100.0) for i in range(200)]
    want = {}
    for _, name, x, y, o in windows:
        best = None
        for _, seg, so, coord, s, e in segments:
            along, cross = (x, y) if so == "horizontal" else (y, x)
            if s - 10 <= along <= e + 10 and abs(cross - coord) <= 20:
                key = abs(cross - coord) + (4 if so != o else 0), seg
                best = min(best or key, key)
        if best:
            want[name] = best
    got = matching.assign_windows(spark.createDataFrame(windows, "plan_id long, opening_id string, x double, y double, orientation string"),
                                  spark.createDataFrame(segments, "plan_id long, seg_id long, orientation string, coord double, s double, e double"))
    assert {r.opening_id: (r.score, r.seg_id) for r in got.collect()} == want


def test_legacy_openings_on_a_crowded_line(spark):
    doors = [(1, f"r{i}", "top", "door", "horizontal", 5.0, float(i % 90), float(i % 90 + 8), 8.0, i % 2 == 0) for i in range(250)]
    walls = [(1, "horizontal", 5.0, f"w{i:03d}", float(i % 40), float(i % 40 + 20 + i % 50), i % 3 == 0) for i in range(150)]
    want = {}
    for _, room, _, _, _, _, start, end, _, outer in doors:
        fit = [(ext != outer, e - s, name, s) for _, _, _, name, s, e, ext in walls if s <= start + 1e-6 and e >= end - 1e-6]
        if fit:
            want[room] = min(fit)[2], start - min(fit)[3]
    got = openings.match_legacy(
        spark.createDataFrame(doors, "plan_id long, room_id string, side string, kind string, orientation string, coord double, start double, end double, span double, is_exterior boolean"),
        spark.createDataFrame(walls, "plan_id long, orientation string, coord double, wall_id string, s double, e double, is_exterior boolean"))
    assert {r.room_id: (r.wall_id, r.offset) for r in got.collect()} == want


def test_structure_files_are_compressed_and_bounded(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(structures, "FILE_ROWS", 100, raising=False)
    docs = spark.range(1000).coalesce(1).selectExpr("id AS doc_id", """concat('{"walls":[', repeat('{"id":"w","orientation":"horizontal"},', 20), '{"id":"last"}]}') AS doc""")
    text = docs.selectExpr("sum(length(doc)) AS n").first()["n"]
    structures.write_lines(docs, "doc_id", "doc", str(tmp_path / "s"))
    files = [p for p in (tmp_path / "s").iterdir() if p.name.startswith("part-")]
    assert len(files) == 10 and sum(p.stat().st_size for p in files) < text / 5
    back = structures.read_lines(spark, str(tmp_path / "s")).selectExpr("doc_id", "size(structure.walls) AS n").collect()
    assert sorted((r.doc_id, r.n) for r in back) == [(i, 21) for i in range(1000)]


def test_structure_documents_are_built_behind_the_shuffle(spark, monkeypatch, tmp_path):
    written = []
    monkeypatch.setattr(structures, "write_lines", lambda docs, *rest: written.append(docs))
    monkeypatch.setattr(structures, "read_lines", lambda spark, path: None)
    datasets.structure_files(spark, "/root/testdata/sf0.001")
    rows = str(written[0]._jdf.queryExecution().optimizedPlan())
    # what is gathered by document names no part of one
    assert "polyline" not in rows[rows.index("Aggregate"):]
