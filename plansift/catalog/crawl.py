"""Crawl queries."""

from pyspark.sql import functions as F

from plansift import views as V
from plansift.catalog.registry import query, rnd
from plansift.operators import crawl as C

LINK = r"<a\s[^>]*?href=[\"']([^\"']*)[\"']".replace("'", "''")
LINKS = f"""
lk AS (SELECT page_id, url, i - 1 AS ordinal, l[i] AS href FROM (SELECT page_id, url, regexp_extract_all(html, '{LINK}', 1) AS l FROM pages), LATERAL (SELECT unnest(range(1, len(l) + 1)) AS i))"""


def links(spark, sf):
    return C.links(V.load(spark, sf, "pages"))


@query("r06_harvest_links", "", LINKS + """ SELECT page_id, ordinal, href, CASE WHEN regexp_matches(href, '^[a-z][a-z0-9+.-]*:') THEN href
 WHEN href LIKE '//%' THEN concat(regexp_extract(url, '^([a-z]+:)', 1), href) WHEN href LIKE '/%' THEN concat(regexp_extract(url, '^([a-z]+://[^/?#]+)', 1), href)
 ELSE concat(regexp_extract(url, '^([a-z]+://[^/?#]+)', 1), '/', href) END AS target FROM lk""")
def _(spark, sf):
    return links(spark, sf).select("page_id", F.col("ordinal").cast("long").alias("ordinal"), "href", C.resolve(F.col("href"), F.col("url")).alias("target"))


@query("u02_distinct_links", "", LINKS + " SELECT href, page_id, ordinal FROM (SELECT *, row_number() OVER (PARTITION BY href ORDER BY page_id, ordinal) AS rn FROM lk) WHERE rn = 1")
def _(spark, sf):
    rows = links(spark, sf).withColumn("at", F.struct("page_id", "ordinal"))
    return C.distinct_in_order(rows, [], "href", "at").select("href", "at.page_id", "at.ordinal")


@query("t03_first_links", "", LINKS + " SELECT page_id, href, rn FROM (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY ordinal) AS rn FROM lk) WHERE rn <= 3")
def _(spark, sf):
    return C.first_per_page(links(spark, sf), 3).select("page_id", "href", "rn")


@query("f08_plan_links", "", r"""
ur AS (SELECT page_id, url, regexp_extract(url, '^(?:[a-z]+:)?//([^/?#]*)', 1) AS host, regexp_extract(url, '^(?:(?:[a-z]+:)?//[^/?#]*)?([^?#]*)', 1) AS path FROM pages)
SELECT page_id, regexp_matches(concat(path, '/plans/', page_id, '/x'), '(?i)(/plan[s]?/|/house-plan[s]?/|/home-plan[s]?/|/floor-plan[s]?/|/model[s]?/|chp-|dhs-|thd-|/\d{4,}/|plan-\d|plan_\d)') AS made,
 regexp_matches(path, '(?i)(/plan[s]?/|/house-plan[s]?/|/home-plan[s]?/|/floor-plan[s]?/|/model[s]?/|chp-|dhs-|thd-|/\d{4,}/|plan-\d|plan_\d)') AND NOT regexp_matches(path, '(?i)\.(css|js|xml|pdf|zip|svg|ico|woff|ttf|eot)$') AS own,
 false AS foreign_host FROM ur""")
def _(spark, sf):
    url, host = F.col("url"), C.url_host(F.col("url"))
    made = F.concat(C.url_path(url), F.lit("/plans/"), F.col("page_id"), F.lit("/x"))
    return V.load(spark, sf, "pages").select(
        "page_id", C.is_plan_link(made, host).alias("made"), C.is_plan_link(url, host).alias("own"),
        C.is_plan_link(F.lit("http://other.example/plans/1"), host).alias("foreign_host"))


@query("f09_floor_images", "", r"""
im AS (SELECT page_id, CASE page_id % 4 WHEN 0 THEN concat('/img/floor-plan-', page_id, '.png') WHEN 1 THEN concat('/img/', page_id, '.jpg?w=1') WHEN 2 THEN concat('/img/', page_id, '.svg') ELSE 'data:image/png' END AS src,
 CASE WHEN page_id % 3 = 0 THEN 'Main Floor' ELSE 'front view' END AS alt FROM pages)
SELECT page_id, src, src <> '' AND src NOT LIKE 'data:%' AND regexp_matches(src, '(?i)\.(jpg|jpeg|png)(\?.*)?$') AND (regexp_matches(alt, '(?i)\bfloor\b')
 OR regexp_matches(src, '(?i)floor.?plan|floorplan|fp[-_]|[-_]fp\.|main[-_]floor|first[-_]floor')) AS ok FROM im""")
def _(spark, sf):
    # the pages hold no images, so each page gets one image tag derived from its id
    tags = V.load(spark, sf, "pages").selectExpr("page_id", "url", """concat('<body><img alt="', if(page_id % 3 = 0, 'Main Floor', 'front view'), '" src="',
        CASE page_id % 4 WHEN 0 THEN concat('/img/floor-plan-', page_id, '.png') WHEN 1 THEN concat('/img/', page_id, '.jpg?w=1')
        WHEN 2 THEN concat('/img/', page_id, '.svg') ELSE 'data:image/png' END, '"></body>') AS html""")
    return C.images(tags).select("page_id", "src", C.is_floor_image(F.col("src"), F.col("alt"), F.lit(r"\bfloor\b")).alias("ok"))


@query("f12_download_size", "", "SELECT doc_id FROM documents WHERE strlen(text) >= 8000")
def _(spark, sf):
    return V.load(spark, sf, "documents").filter(F.octet_length("text") >= C.MIN_IMAGE_BYTES).select("doc_id")


@query("j24_crawl_resume", "crawl_index", """SELECT event_id, source_url FROM crawl_index c WHERE NOT EXISTS (SELECT 1 FROM crawl_index i WHERE i.event_id % 3 = 0 AND i.source_url = c.source_url)
 AND concat('p', event_id % 50) NOT IN (SELECT concat('p', page_id % 25) FROM pages)""")
def _(spark, sf):
    rows = V.crawl_index(spark, sf).withColumn("page_url", F.concat(F.lit("p"), F.col("event_id") % 50))
    visited = V.load(spark, sf, "pages").select(F.concat(F.lit("p"), F.col("page_id") % 25).alias("url"))
    return C.unseen(rows, rows.filter("event_id % 3 = 0"), visited).select("event_id", "source_url")


QUOTA = """
qs AS (SELECT source, CASE WHEN source = 'click' THEN 1500 ELSE greatest(100, 1500 // greatest(1, (SELECT count(DISTINCT source) FROM crawl_index WHERE source <> 'click'))) END AS quota,
 count(*) FILTER (event_id % 9 = 0) AS have FROM crawl_index GROUP BY source)"""


def quotas(spark, sf):
    index = V.crawl_index(spark, sf)
    return C.quotas(index.select("source").distinct(), index.filter("event_id % 9 = 0"), 3000, "click")


@query("a36_source_quotas", "crawl_index", QUOTA + " SELECT source, quota::BIGINT AS quota, have, greatest(0, quota - have)::BIGINT AS remaining FROM qs")
def _(spark, sf):
    return quotas(spark, sf)


@query("t05_take_until_target", "crawl_index", QUOTA + """ SELECT source, event_id, rn FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY ts, event_id) AS rn FROM crawl_index) JOIN qs USING (source) WHERE rn <= quota - have""")
def _(spark, sf):
    return C.take_until_target(V.crawl_index(spark, sf), quotas(spark, sf)).select("source", "event_id", "rn")


@query("a34_status_by_source", "crawl_index", f"""
ps AS (SELECT source, count(*) AS n FROM crawl_index GROUP BY source), k AS (SELECT count(*) AS k FROM ps)
SELECT source, n, {rnd('n / 5000::DOUBLE', 6)} AS share_of_total, {rnd('n / floor(5000 / k)', 6)} AS share_of_source FROM ps, k""")
def _(spark, sf):
    return C.status_by_source(V.crawl_index(spark, sf), 5000)


@query("t04_ranked_sources", "crawl_index", "SELECT source, n, row_number() OVER (ORDER BY n DESC, source) AS pos FROM (SELECT source, count(*) AS n FROM crawl_index GROUP BY source)")
def _(spark, sf):
    from pyspark.sql import Window
    # one row per source: a short list
    ranked = C.status_by_source(V.crawl_index(spark, sf), 5000)
    return ranked.select("source", "n", F.row_number().over(Window.orderBy(F.desc("n"), "source")).alias("pos"))


@query("w12_rate_and_eta", "", f"""
hr AS (SELECT event_type, floor(epoch(ts) / 3600)::BIGINT AS h, count(*) AS n FROM events GROUP BY ALL),
sm AS (SELECT event_type, h * 3600 AS t_sec, sum(n) OVER (PARTITION BY event_type ORDER BY h) AS total FROM hr),
st AS (SELECT *, total - lag(total) OVER w AS d, t_sec - lag(t_sec) OVER w AS s FROM sm WINDOW w AS (PARTITION BY event_type ORDER BY t_sec)),
rt AS (SELECT *, d / s * 60 AS rate FROM st WHERE d > 0 AND s > 0),
av AS (SELECT *, avg(rate) OVER (PARTITION BY event_type ORDER BY t_sec ROWS BETWEEN 5 PRECEDING AND CURRENT ROW) AS ar FROM rt)
SELECT event_type, t_sec, total::BIGINT AS total, {rnd('ar', 6)} AS avg_rate, {rnd('(5000 - total) / ar', 4)} AS eta_min FROM av""")
def _(spark, sf):
    from pyspark.sql import Window
    hourly = V.load(spark, sf, "events").groupBy("event_type", F.floor(F.unix_timestamp("ts") / 3600).alias("h")).agg(F.count(F.lit(1)).alias("n"))
    running = F.sum("n").over(Window.partitionBy("event_type").orderBy("h"))
    return C.rate_and_eta(hourly.select("event_type", (F.col("h") * 3600).alias("t_sec"), running.alias("total")), 5000, ["event_type"])
