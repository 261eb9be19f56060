"""Structured Streaming jobs for crawl progress, event logs, harvests and run histories.

Every job takes a streaming DataFrame (``readStream``) and returns a started
query. Checkpoint and output folders are passed in, so a job restarts where it
stopped. Jobs that write per micro-batch put each batch in a folder of its own
number and replace that folder when the batch is replayed, so a replay gives
the same rows once.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from plansift.operators import crawl
from plansift.sources import files


def _start(writer, folder: str, once: bool, every: str) -> StreamingQuery:
    writer = writer.option("checkpointLocation", f"{folder}/checkpoint")
    trigger = {"availableNow": True} if once else {"processingTime": every}
    return writer.trigger(**trigger).start()


def _put(rows: DataFrame, path: str, batch_id: int) -> None:
    rows.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")


def stored(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """All batches of a job with their number; empty before the first one."""
    return files.read_or_empty(spark, path, f"{schema}, batch long")


def _earlier(batch: DataFrame, path: str, schema: str, batch_id: int) -> DataFrame:
    return stored(batch.sparkSession, path, schema).filter(F.col("batch") < batch_id)


def _counts_by_batch(counts: DataFrame, folder: str, once: bool, every: str) -> StreamingQuery:
    """Window counts as they change: each batch holds the new counts of the windows it touched, open ones included."""
    return _start(counts.writeStream.outputMode("update").foreachBatch(lambda batch, n: _put(batch, f"{folder}/out", n)), folder, once, every)


def latest_counts(spark: SparkSession, folder: str, key: str) -> DataFrame:
    """window_start, ``key`` and n: the newest count of every window."""
    rows = stored(spark, f"{folder}/out", f"window_start timestamp, {key} string, n long")
    return rows.groupBy("window_start", key).agg(F.max_by("n", "batch").alias("n"))


def progress(index: DataFrame, folder: str, once: bool = False, window: str = "1 hour", delay: str = "10 minutes") -> StreamingQuery:
    """Collected images per source and window; ``latest_counts`` and ``progress_rates`` read them.

    The watermark only says when a window may leave the state; its count is
    written whenever it changes, so nothing is missing when the source runs dry.
    """
    counts = index.withWatermark("ts", delay).groupBy(F.window("ts", window), "source").agg(F.count(F.lit(1)).alias("n"))
    return _counts_by_batch(counts.select(F.col("window.start").alias("window_start"), "source", "n"), folder, once, "5 seconds")


def progress_rates(windows: DataFrame, target: int) -> DataFrame:
    """Total, mean rate over the last six growing windows and minutes left, per source and window."""
    samples = windows.select(
        "source", F.unix_timestamp("window_start").alias("t_sec"),
        F.sum("n").over(crawl.Window.partitionBy("source").orderBy("window_start")).alias("total"))
    return crawl.rate_and_eta(samples, target, ["source"])


TOTALS = "source string, n long, last_ts timestamp"


def progress_totals(index: DataFrame, folder: str, once: bool = False) -> StreamingQuery:
    """Running totals per source; ``files.load_table`` reads the newest complete picture of ``folder/out``."""
    totals = index.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.max("ts").alias("last_ts"))
    return _start(totals.writeStream.outputMode("complete").foreachBatch(lambda batch, _: files.save_table(batch, f"{folder}/out")), folder, once, "5 seconds")


EVENT = "event string, ts timestamp, user_id long"


def event_log(lines: DataFrame, folder: str, once: bool = False, window: str = "1 day", delay: str = "10 minutes") -> StreamingQuery:
    """JSON lines -> event counts per window, read by ``latest_counts``; late lines beyond ``delay`` are left out."""
    events = lines.select(F.from_json("value", EVENT).alias("e")).select("e.*").filter("event IS NOT NULL")
    counts = events.withWatermark("ts", delay).groupBy(F.window("ts", window), "event").agg(F.count(F.lit(1)).alias("n"))
    return _counts_by_batch(counts.select(F.col("window.start").alias("window_start"), "event", "n"), folder, once, "10 seconds")


def unique_urls(index: DataFrame, folder: str, once: bool = False) -> StreamingQuery:
    """Each url once, ever.

    What was written before is the memory: a batch keeps its first row per url
    and is joined with the stored urls. No state grows in the executors, and
    nothing is forgotten.
    """
    def publish(batch: DataFrame, n: int) -> None:
        known = _earlier(batch, f"{folder}/out", "source_url string", n)
        _put(batch.select("source_url").distinct().join(known, "source_url", "left_anti"), f"{folder}/out", n)

    return _start(index.writeStream.foreachBatch(publish), folder, once, "5 seconds")


def history(records: DataFrame, folder: str, once: bool = False) -> StreamingQuery:
    """Epoch records appended to a table; ``operators.training.best_so_far`` reads it."""
    return _start(records.writeStream.outputMode("append").format("parquet").option("path", f"{folder}/out"), folder, once, "10 seconds")


TAKEN = "event_id long, source string, source_url string"


def until_target(index: DataFrame, targets: dict[str, int], default: int, folder: str, once: bool = False) -> StreamingQuery:
    """Rows of every source until its target is reached, the earliest of a batch first.

    The rows taken before say what is left. A source with all the rows of a
    batch is cut by time ranges, which are counted and ranked apart.
    """
    def publish(batch: DataFrame, n: int) -> None:
        taken = _earlier(batch, f"{folder}/out", TAKEN, n).groupBy("source").agg(F.count(F.lit(1)).alias("have"))
        limit = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for pair in targets.items() for x in pair]), F.col("source")), F.lit(default)) if targets else F.lit(default)
        left = batch.select("source").distinct().join(taken, "source", "left").select(
            "source", F.greatest(F.lit(0), limit - F.coalesce("have", F.lit(0))).alias("remaining"))
        _put(crawl.take_until_target(batch, left).select("event_id", "source", "source_url"), f"{folder}/out", n)

    return _start(index.writeStream.foreachBatch(publish), folder, once, "5 seconds")


IMAGES = "source string, page_id long, ordinal int, source_url string, page_url string, alt string"
LINKS = "page_id long, ordinal int, target string"
VISITED = "url string"


def harvest(
    pages: DataFrame, folder: str, alt_pattern: str, targets: dict[str, int], default: int, links_per_page: int = 80, once: bool = False,
    source_of: Callable[[DataFrame], DataFrame] = lambda pages: pages,
) -> StreamingQuery:
    """Pages (source, page_id, url, html) -> floor images and plan links that are new, until a source has enough.

    A page that was visited in an earlier batch is skipped; an image is kept
    once, at its first place; images beyond the source's target are left; of a
    page's plan links the first ``links_per_page`` are listed. ``folder/images``,
    ``folder/links`` and ``folder/visited`` hold the batches.
    """
    def publish(batch: DataFrame, n: int) -> None:
        seen = _earlier(batch, f"{folder}/visited", VISITED, n)
        fresh = source_of(batch).select("source", "page_id", "url", "html").join(seen, "url", "left_anti").persist()
        try:
            tags = crawl.images(fresh).join(fresh.select("page_id", "source").distinct(), "page_id")
            floor = tags.filter(crawl.is_floor_image(F.col("src"), F.col("alt"), F.lit(alt_pattern))).select(
                "source", "page_id", "ordinal", crawl.resolve(F.col("src"), F.col("url")).alias("source_url"), F.col("url").alias("page_url"), "alt")
            place = F.struct("page_id", "ordinal")
            once_each = floor.groupBy("source_url").agg(F.min_by(F.struct("source", "page_id", "ordinal", "page_url", "alt"), place).alias("r")).select("r.*", "source_url")
            kept = _earlier(batch, f"{folder}/images", IMAGES, n)
            new = crawl.unseen(once_each, kept, seen)
            have = kept.groupBy("source").agg(F.count(F.lit(1)).alias("have"))
            limit = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for pair in targets.items() for x in pair]), F.col("source")), F.lit(default)) if targets else F.lit(default)
            left = new.select("source").distinct().join(have, "source", "left").select("source", F.greatest(F.lit(0), limit - F.coalesce("have", F.lit(0))).alias("remaining"))
            taken = crawl.take_until_target(new, left, ["page_id", "ordinal"])
            _put(taken.select("source", "page_id", "ordinal", "source_url", "page_url", "alt"), f"{folder}/images", n)
            hrefs = crawl.links(fresh).filter(crawl.is_plan_link(F.col("href"), crawl.url_host(F.col("url"))))
            targets_of = hrefs.select("page_id", crawl.resolve(F.col("href"), F.col("url")).alias("target"), "ordinal")
            listed = crawl.first_per_page(crawl.distinct_in_order(targets_of, ["page_id"], "target", "ordinal"), links_per_page)
            _put(listed.select("page_id", "ordinal", "target"), f"{folder}/links", n)
            _put(fresh.select("url").distinct(), f"{folder}/visited", n)
        finally:
            fresh.unpersist()

    return _start(pages.writeStream.foreachBatch(publish), folder, once, "10 seconds")
