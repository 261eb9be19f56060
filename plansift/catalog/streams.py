"""Streaming jobs driven over the event table until all of it is read."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from plansift import views as V
from plansift.catalog.registry import query, rnd
from plansift.catalog.training import BEST
from plansift.operators import crawl as C, training as T
from plansift.sources import files
from plansift.streaming import jobs


def event_stream(spark, sf):
    schema = V.load(spark, sf, "events").schema
    return spark.readStream.schema(schema).parquet(f"{sf}/event[s].parquet")


def index_stream(spark, sf):
    return event_stream(spark, sf).selectExpr("event_id", "event_type AS source", "concat('u', event_id % 5000) AS source_url", "cast(ts AS timestamp) AS ts")


@query("r01_progress_windows", "crawl_index", "SELECT date_trunc('hour', ts)::TIMESTAMP AS window_start, source, count(*) AS n FROM crawl_index GROUP BY ALL")
def _(spark, sf):
    folder = files.scratch(spark)
    jobs.progress(index_stream(spark, sf), folder, once=True).awaitTermination()
    return jobs.latest_counts(spark, folder, "source").withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@query("r01_progress_rates", "crawl_index", f"""
hr AS (SELECT source, floor(epoch(ts) / 3600)::BIGINT AS h, count(*) AS n FROM crawl_index GROUP BY ALL),
sm AS (SELECT source, h * 3600 AS t_sec, sum(n) OVER (PARTITION BY source ORDER BY h) AS total FROM hr),
st AS (SELECT *, total - lag(total) OVER w AS d, t_sec - lag(t_sec) OVER w AS s FROM sm WINDOW w AS (PARTITION BY source ORDER BY t_sec)),
rt AS (SELECT *, d / s * 60 AS rate FROM st WHERE d > 0 AND s > 0),
av AS (SELECT *, avg(rate) OVER (PARTITION BY source ORDER BY t_sec ROWS BETWEEN 5 PRECEDING AND CURRENT ROW) AS ar FROM rt)
SELECT source, t_sec, total::BIGINT AS total, {rnd('ar', 6)} AS avg_rate, {rnd('(5000 - total) / ar', 4)} AS eta_min FROM av""")
def _(spark, sf):
    folder = files.scratch(spark)
    jobs.progress(index_stream(spark, sf), folder, once=True).awaitTermination()
    return jobs.progress_rates(jobs.latest_counts(spark, folder, "source"), 5000)


@query("r01_progress_totals", "crawl_index", "SELECT source, count(*) AS n, max(ts) AS last_ts FROM crawl_index GROUP BY source")
def _(spark, sf):
    folder = files.scratch(spark)
    jobs.progress_totals(index_stream(spark, sf), folder, once=True).awaitTermination()
    return files.load_table(spark, f"{folder}/out", jobs.TOTALS).withColumn("last_ts", F.col("last_ts").cast("timestamp_ntz"))


@query("r02_event_log", "", "SELECT date_trunc('day', ts)::TIMESTAMP AS window_start, event_type AS event, count(*) AS n FROM events GROUP BY ALL")
def _(spark, sf):
    folder = files.scratch(spark)
    lines = V.load(spark, sf, "events").select(F.to_json(F.struct(
        F.col("event_type").alias("event"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("ts"), "user_id")).alias("value"))
    lines.write.text(f"{folder}/in")
    jobs.event_log(spark.readStream.text(f"{folder}/in"), folder, once=True).awaitTermination()
    return jobs.latest_counts(spark, folder, "event").withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@query("r03_unique_urls", "crawl_index", "SELECT DISTINCT source_url FROM crawl_index")
def _(spark, sf):
    folder = files.scratch(spark)
    jobs.unique_urls(index_stream(spark, sf), folder, once=True).awaitTermination()
    return jobs.stored(spark, f"{folder}/out", "source_url string").select("source_url")


@query("r04_training_history", "run_log", BEST + " SELECT run_id, max(best_epoch) AS best_epoch, min(best_loss) AS best_loss FROM (SELECT be.* FROM be LEFT JOIN fs ON fs.run_id = be.run_id WHERE stop IS NULL OR epoch <= stop) GROUP BY run_id")
def _(spark, sf):
    folder = files.scratch(spark)
    records = event_stream(spark, sf).selectExpr("user_id AS run_id", "event_id", "ts", "value AS val_loss")
    jobs.history(records, folder, once=True).awaitTermination()
    table = spark.read.schema(records.schema).parquet(f"{folder}/out")
    epochs = table.select("run_id", "val_loss", F.row_number().over(Window.partitionBy("run_id").orderBy("ts", "event_id")).alias("epoch"))
    return T.best_so_far(epochs, ["run_id"], 8).groupBy("run_id").agg(F.max("best_epoch").alias("best_epoch"), F.min("best_loss").alias("best_loss"))


@query("r05_until_target", "crawl_index", """SELECT event_id, source, source_url FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY ts, event_id) AS rn FROM crawl_index)
 WHERE rn <= CASE WHEN source = 'click' THEN 1500 ELSE 300 END""")
def _(spark, sf):
    folder = files.scratch(spark)
    jobs.until_target(index_stream(spark, sf), {"click": 1500}, 300, folder, once=True).awaitTermination()
    return jobs.stored(spark, f"{folder}/out", jobs.TAKEN).select("event_id", "source", "source_url")


def with_images(pages):
    """The pages hold no images, so each gets one tag derived from its id; its language is its source."""
    return pages.selectExpr("regexp_extract(html, 'lang=\"([a-z]*)\"', 1) AS source", "page_id", "url", """concat(html, '<img alt="', if(page_id % 3 = 0, 'Main Floor', 'front view'), '" src="',
        CASE page_id % 4 WHEN 0 THEN concat('/img/floor-plan-', page_id % 40, '.png') WHEN 1 THEN concat('/img/', page_id, '.jpg?w=1')
        WHEN 2 THEN concat('/img/', page_id, '.svg') ELSE 'data:image/png' END, '">') AS html""")


def harvested(spark, sf):
    folder = files.scratch(spark)
    pages = spark.readStream.schema(V.load(spark, sf, "pages").schema).parquet(f"{sf}/page[s].parquet")
    jobs.harvest(pages, folder, r"\bfloor\b", {"en": 40}, 10, links_per_page=3, once=True, source_of=with_images).awaitTermination()
    return folder


HARVEST = rf"""
im AS (SELECT regexp_extract(html, 'lang="([a-z]*)"', 1) AS source, page_id, url, CASE WHEN page_id % 3 = 0 THEN 'Main Floor' ELSE 'front view' END AS alt,
 (len(regexp_extract_all(html, '<img\s[^>]*>')))::INT AS ordinal, CASE page_id % 4 WHEN 0 THEN concat('/img/floor-plan-', page_id % 40, '.png') WHEN 1 THEN concat('/img/', page_id, '.jpg?w=1') WHEN 2 THEN concat('/img/', page_id, '.svg') ELSE 'data:image/png' END AS src FROM pages),
fl AS (SELECT source, page_id, ordinal, concat(regexp_extract(url, '^([a-z]+://[^/?#]+)', 1), src) AS source_url, url AS page_url, alt FROM im
 WHERE src NOT LIKE 'data:%' AND regexp_matches(src, '{C.IMAGE_EXTENSIONS}') AND (regexp_matches(alt, '(?i)\bfloor\b') OR regexp_matches(src, '{C.FLOOR_URL}'))),
on_ AS (SELECT * FROM fl QUALIFY row_number() OVER (PARTITION BY source_url ORDER BY page_id, ordinal) = 1)"""


@query("r06_harvest_images", "", HARVEST + """ SELECT source, page_id, ordinal, source_url, page_url, alt FROM on_
 QUALIFY row_number() OVER (PARTITION BY source ORDER BY page_id, ordinal) <= CASE WHEN source = 'en' THEN 40 ELSE 10 END""")
def _(spark, sf):
    return jobs.stored(spark, f"{harvested(spark, sf)}/images", jobs.IMAGES).drop("batch")
