from collections import Counter

from pyspark.sql import functions as F

from plansift.plans import clean
from tests.helpers import BOX, walls


def test_openings_that_name_their_wall_pass_every_filter(spark):
    final = walls(spark, BOX).withColumn("is_exterior", F.lit(True))
    plans = spark.createDataFrame([(1, 400, 320, "pixel")], "plan_id long, image_w long, image_h long, unit string")
    door, window = "door", "window"
    rows = [
        (1, "a", 1, door, 40.0, 0.0, 20.0, "w0", 30.0), (1, "b", 2, door, 44.0, 0.0, 30.0, "w0", 29.0),  # b covers a
        *[(1, f"c{i}", 10 + i, window, 30.0 + 40 * i, 120.0, 10.0 + i, "w1", None) for i in range(5)],  # two too many
        (1, "d", 30, "arch", 10.0, 0.0, 20.0, None, None), (1, "e", 31, door, 10.0, 0.0, 0.0, None, None),  # unusable
        (1, "f", 32, door, 100.0, 0.0, 20.0, None, None),
    ]
    raw = spark.createDataFrame(rows, "plan_id long, opening_id string, ord long, kind string, x double, y double, span double, wall_id string, offset double")
    raw = raw.withColumn("orientation", F.lit("horizontal")).withColumn("confidence", F.lit(0.9)).withColumn("k", F.lit(0))
    kept, removed = clean.clean_openings(raw, final, plans)
    assert {r["opening_id"] for r in kept.collect()} == {"b", "c2", "c3", "c4", "f"}
    counts = Counter()
    for r in removed.collect():
        counts[r["filter"]] += r["n"]
    assert counts == {"opening_invalid": 2, "opening_duplicate": 1, "window_limit": 2}
    from plansift.operators import openings
    placed = {r["opening_id"]: r for r in openings.anchor(kept, final).collect()}
    assert placed["b"]["wall_id"] == "w0" and placed["b"]["offset"] == 29.0 and placed["f"]["status"] == "anchored"


def test_row_numbers_over_buckets(spark):
    from plansift.functions.ranking import number_by

    rows = spark.createDataFrame([(g, (i * 37) % 101) for g in ("a", "b", None) for i in range(101)], "g string, v long")
    got = number_by(rows, ["g"], "v", "n").collect()
    assert len(got) == 303 and all(r["n"] == r["v"] + 1 for r in got)


def _openings(spark, rows):
    raw = spark.createDataFrame(rows, "plan_id long, opening_id string, kind string, x double, y double, span double, wall_id string, offset double, orientation string")
    return raw.withColumn("confidence", F.lit(0.9)).withColumn("k", F.lit(0))


def test_openings_are_compared_on_known_walls_only_and_on_the_wall_s_axis(spark):
    final = walls(spark, BOX).withColumn("is_exterior", F.lit(False))
    plans = spark.createDataFrame([(1, 400, 320, "pixel")], "plan_id long, image_w long, image_h long, unit string")
    rows = [
        # two doors by offset alone, far apart; a third lies on the first
        (1, "a", "door", None, None, 20.0, "w0", 30.0, None), (1, "b", "door", None, None, 20.0, "w0", 150.0, None), (1, "c", "door", 42.0, 0.0, 18.0, "w0", None, None),
        # two on a wall that does not exist stay as they are
        (1, "d", "window", 60.0, 0.0, 20.0, "w77", None, None), (1, "e", "window", 61.0, 0.0, 20.0, "w77", None, None),
        # two on an upright wall, far apart, that call themselves horizontal
        (1, "f", "door", 200.0, 20.0, 16.0, "w3", None, "horizontal"), (1, "g", "door", 200.0, 100.0, 16.0, "w3", None, "horizontal"),
    ]
    kept, removed = clean.clean_openings(_openings(spark, rows), final, plans)
    assert {r["opening_id"] for r in kept.collect()} == {"a", "b", "d", "e", "f", "g"}
    assert [(r["filter"], r["n"]) for r in removed.collect()] == [("opening_duplicate", 1)]
