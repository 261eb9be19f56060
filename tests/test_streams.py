"""Streams over several batches: restarts, replays, and what plain loops give."""

from pyspark.sql import functions as F

from plansift.sources import files
from plansift.streaming import jobs

INDEX = "event_id long, source string, source_url string, ts timestamp"


def feed(spark, folder, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)


def index_rows(spark, start, n, source="a"):
    rows = spark.range(start, start + n).select(
        F.col("id").alias("event_id"), F.lit(source).alias("source"), F.concat(F.lit("u"), F.col("id") % 70).alias("source_url"),
        F.timestamp_seconds(1_700_000_000 + (F.col("id") * 37) % 500).alias("ts"))
    return [tuple(r) for r in rows.collect()]


def run(spark, job, folder):
    job(spark.readStream.schema(INDEX).parquet(f"{folder}/in"), f"{folder}/job").awaitTermination()


def test_a_url_never_returns_after_a_restart(spark, tmp_path):
    folder = str(tmp_path)
    job = lambda stream, out: jobs.unique_urls(stream, out, once=True)
    for start in (0, 50, 200):
        feed(spark, f"{folder}/in", index_rows(spark, start, 60), INDEX)
        run(spark, job, folder)
    got = jobs.stored(spark, f"{folder}/job/out", "source_url string").collect()
    want = {f"u{i % 70}" for start in (0, 50, 200) for i in range(start, start + 60)}
    assert sorted(r.source_url for r in got) == sorted(want) and {r.batch for r in got} <= {0, 1, 2}


def test_targets_hold_over_batches_and_one_source_with_all_rows(spark, tmp_path):
    folder = str(tmp_path)
    job = lambda stream, out: jobs.until_target(stream, {"a": 90}, 5, out, once=True)
    want, left = [], {"a": 90, "b": 5}
    for start, n, source in ((0, 60, "a"), (100, 80, "a"), (300, 9, "b"), (400, 20, "a")):
        rows = index_rows(spark, start, n, source)
        feed(spark, f"{folder}/in", rows, INDEX)
        run(spark, job, folder)
        first = sorted(rows, key=lambda r: (r[3], r[0]))[: left[source]]
        left[source] -= len(first)
        want += [r[:3] for r in first]
    got = jobs.stored(spark, f"{folder}/job/out", jobs.TAKEN).select("event_id", "source", "source_url").collect()
    assert sorted(tuple(r) for r in got) == sorted(want) and left == {"a": 0, "b": 0}


def test_open_windows_are_counted_when_the_source_runs_dry(spark, tmp_path):
    folder = str(tmp_path)
    job = lambda stream, out: jobs.progress(stream, out, once=True, window="1 minute", delay="1 hour")
    rows = []
    for start in (0, 300):
        part = index_rows(spark, start, 300)
        rows += part
        feed(spark, f"{folder}/in", part, INDEX)
        run(spark, job, folder)
    got = {r.window_start: r.n for r in jobs.latest_counts(spark, f"{folder}/job", "source").collect()}
    want = {}
    for r in rows:
        minute = r[3].replace(second=0, microsecond=0)
        want[minute] = want.get(minute, 0) + 1
    assert got == want


PAGES = "source string, page_id long, url string, html string"


def page(i, source="s", images=1):
    tags = "".join(f'<img src="/floor-plan-{(i + k) % 9}.png" alt="">' for k in range(images))
    return (source, i, f"http://h.example/page/{i}", f'<a href="/plans/{i % 4}"></a><a href="/plans/{i % 4}"></a><a href="/about"></a>{tags}')


def test_harvest_skips_what_it_has_and_replays_alike(spark, tmp_path):
    folder = str(tmp_path)

    def go():
        stream = spark.readStream.schema(PAGES).parquet(f"{folder}/in")
        jobs.harvest(stream, f"{folder}/job", "none", {}, 6, once=True).awaitTermination()

    feed(spark, f"{folder}/in", [page(i) for i in range(4)], PAGES)
    go()
    images = lambda: sorted((r.source_url, r.page_id, r.batch) for r in jobs.stored(spark, f"{folder}/job/images", jobs.IMAGES).collect())
    first = [(f"http://h.example/floor-plan-{i}.png", i, 0) for i in range(4)]
    assert images() == first
    # page 1 again, page 10 shows an image that is there, and more new ones than the target allows
    feed(spark, f"{folder}/in", [page(1), page(10), *[page(i) for i in range(4, 9)]], PAGES)
    go()
    assert images() == [*first, ("http://h.example/floor-plan-4.png", 4, 1), ("http://h.example/floor-plan-5.png", 5, 1)]
    links = jobs.stored(spark, f"{folder}/job/links", jobs.LINKS).collect()
    assert sorted((r.page_id, r.target) for r in links) == sorted((i, f"http://h.example/plans/{i % 4}") for i in (0, 1, 2, 3, 4, 5, 6, 7, 8, 10))
    # a batch that is replayed sees earlier batches only and replaces its own rows
    before = images()
    batch = spark.createDataFrame([page(1), page(10), *[page(i) for i in range(4, 9)]], PAGES)
    seen = jobs._earlier(batch, f"{folder}/job/visited", jobs.VISITED, 1)
    assert {r.url for r in seen.collect()} == {f"http://h.example/page/{i}" for i in range(4)}
    jobs._put(spark.createDataFrame([("s", r[1], 0, r[0], "", "") for r in before if r[2] == 1], jobs.IMAGES), f"{folder}/job/images", 1)
    assert images() == before


def test_a_checkpoint_table_is_whole_at_any_time(spark, tmp_path):
    path, schema = str(tmp_path / "t"), "a long"
    assert files.load_table(spark, path, schema).count() == 0
    files.save_table(spark.range(5).toDF("a"), path)
    old = files.load_table(spark, path, schema)
    broken = spark.range(3).select(F.raise_error(F.lit("stop")).cast("long").alias("a"))
    try:
        files.save_table(broken, path)
    except Exception as exc:  # noqa: BLE001
        assert "stop" in str(exc)
    assert files.load_table(spark, path, schema).count() == 5
    files.save_table(spark.range(2).toDF("a"), path)
    assert files.load_table(spark, path, schema).count() == 2 and old.count() == 5
