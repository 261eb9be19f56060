"""Crawl bookkeeping: link harvest, filters, resume, quotas, progress."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plansift.functions.numeric import round_to
from plansift.functions.ranking import with_range_bucket

# fixed values: url patterns
PLAN_SIGNALS = (
    r"(?i)(/plan[s]?/|/house-plan[s]?/|/home-plan[s]?/|/floor-plan[s]?/|/model[s]?/|chp-|dhs-|thd-|/\d{4,}/|plan-\d|plan_\d)"
)
SKIP_EXTENSIONS = r"(?i)\.(css|js|xml|pdf|zip|svg|ico|woff|ttf|eot)$"
IMAGE_EXTENSIONS = r"(?i)\.(jpg|jpeg|png)(\?.*)?$"
FLOOR_URL = r"(?i)floor.?plan|floorplan|fp[-_]|[-_]fp\.|main[-_]floor|first[-_]floor"
LINK = r"<a\s[^>]*?href=[\"']([^\"']*)[\"']"
IMAGE = r"<img\s[^>]*>"
MIN_IMAGE_BYTES = 8000


def links(pages: DataFrame) -> DataFrame:
    """Every link of a page with its position."""
    found = F.regexp_extract_all("html", F.lit(LINK), 1)
    return pages.select("page_id", "url", F.posexplode(found).alias("ordinal", "href"))


def images(pages: DataFrame) -> DataFrame:
    """Image source and alt text in page order (src, else data-src, else data-lazy)."""
    tags = pages.select("page_id", "url", F.posexplode(F.regexp_extract_all("html", F.lit(IMAGE), 0)).alias("ordinal", "tag"))

    def attr(name: str) -> Column:
        value = F.regexp_extract("tag", rf"\s{name}=[\"']([^\"']*)[\"']", 1)
        return F.when(value != "", value)

    src = F.coalesce(attr("src"), attr("data-src"), attr("data-lazy"), F.lit(""))
    return tags.select("page_id", "url", "ordinal", F.trim(src).alias("src"), F.trim(F.coalesce(attr("alt"), F.lit(""))).alias("alt"))


def resolve(href: Column, page_url: Column) -> Column:
    """Absolute url of a link: absolute, scheme-relative, root-relative, else relative to the host."""
    root = F.regexp_extract(page_url, r"^([a-z]+://[^/?#]+)", 1)
    return (
        F.when(href.rlike(r"^[a-z][a-z0-9+.-]*:"), href)
        .when(href.startswith("//"), F.concat(F.regexp_extract(page_url, r"^([a-z]+:)", 1), href))
        .when(href.startswith("/"), F.concat(root, href))
        .otherwise(F.concat(root, F.lit("/"), href))
    )


def url_host(url: Column) -> Column:
    return F.regexp_extract(url, r"^(?:[a-z]+:)?//([^/?#]*)", 1)


def url_path(url: Column) -> Column:
    return F.regexp_extract(url, r"^(?:(?:[a-z]+:)?//[^/?#]*)?([^?#]*)", 1)


def is_plan_link(href: Column, base_host: Column) -> Column:
    """same host or relative, no skipped extension, a plan signal in the path."""
    host, path = url_host(href), url_path(href)
    return (
        (href != "") & ~href.startswith("data:") & ((host == "") | (host == base_host))
        & ~path.rlike(SKIP_EXTENSIONS) & path.rlike(PLAN_SIGNALS)
    )


def is_floor_image(src: Column, alt: Column, alt_pattern: Column) -> Column:
    """an image file whose alt text matches the source's pattern or whose url looks like a floor plan."""
    named = F.regexp_like(alt, F.concat(F.lit("(?i)"), alt_pattern))
    return (src != "") & ~src.startswith("data:") & src.rlike(IMAGE_EXTENSIONS) & (named | src.rlike(FLOOR_URL))


def distinct_in_order(rows: DataFrame, keys: list[str], value: str, ordinal: str) -> DataFrame:
    """Each value once, at its first position."""
    return rows.groupBy(*keys, value).agg(F.min(ordinal).alias(ordinal))


def first_per_page(rows: DataFrame, n: int) -> DataFrame:
    """The first ``n`` links of every page."""
    rank = F.row_number().over(Window.partitionBy("page_id").orderBy("ordinal"))
    return rows.withColumn("rn", rank).filter(F.col("rn") <= n)


def unseen(candidates: DataFrame, index: DataFrame, visited: DataFrame) -> DataFrame:
    """Candidates not collected yet and from pages not visited yet."""
    return candidates.join(index.select("source_url"), "source_url", "left_anti").join(
        visited.select(F.col("url").alias("page_url")), "page_url", "left_anti")


def quotas(sources: DataFrame, index: DataFrame, target: int, main: str) -> DataFrame:
    """Half of the target for the main source, the rest shared (at least 100 each), minus what is there."""
    half = target // 2
    others = F.greatest(F.lit(1), F.count_if(F.col("source") != main))
    share = sources.agg(F.greatest(F.lit(100), F.floor(F.lit(target - half) / others)).alias("share"))
    have = index.groupBy("source").agg(F.count(F.lit(1)).alias("have"))
    out = sources.join(F.broadcast(share)).join(have, "source", "left").withColumn("have", F.coalesce("have", F.lit(0)))
    quota = F.when(F.col("source") == main, F.lit(half)).otherwise(F.col("share"))
    return out.select("source", quota.cast("long").alias("quota"), "have", F.greatest(F.lit(0), quota.cast("long") - F.col("have")).alias("remaining"))


def take_until_target(rows: DataFrame, remaining: DataFrame, order: list[str] | None = None) -> DataFrame:
    """The first rows of every source, by ``order``, until its remaining quota is used.

    Rows are counted in ranges of the first order column; a range that begins
    behind the quota is dropped before anything is sorted, and rows are ranked
    inside their range, so no task ranks a source that has most of the rows.
    """
    order = order or ["ts", "event_id"]
    first = F.col(order[0])
    number = F.unix_micros(first.cast("timestamp")) if rows.schema[order[0]].dataType.simpleString().startswith("timestamp") else first.cast("long")
    limited = rows.join(remaining.select("source", "remaining"), "source").filter("remaining > 0").withColumn("_at", number)
    ranges = with_range_bucket(limited, ["source"], "_at")
    counts = ranges.groupBy("source", "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("source").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    begins = counts.select("source", "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    near = ranges.join(begins, ["source", "_bucket"]).filter("_before < remaining")
    rank = F.row_number().over(Window.partitionBy("source", "_bucket").orderBy(*order))
    return near.withColumn("rn", (F.col("_before") + rank).cast("int")).filter("rn <= remaining").drop("_at", "_bucket", "_before")


def status_by_source(index: DataFrame, target: int) -> DataFrame:
    """A34 + T04: rows and share of the target per source, largest first."""
    per = index.groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    n_sources = per.agg(F.greatest(F.count(F.lit(1)), F.lit(1)).alias("k"))
    share = F.lit(target) / F.col("k")
    return per.join(F.broadcast(n_sources)).select(
        "source", "n", round_to(F.col("n") / F.lit(float(target)), 6).alias("share_of_total"),
        round_to(F.col("n") / F.floor(share), 6).alias("share_of_source"),
    ).orderBy(F.desc("n"), "source")


def rate_and_eta(samples: DataFrame, target: int, keys: list[str] | None = None) -> DataFrame:
    """Mean rate per minute over the last six growing samples and minutes left.

    ``samples``: t_sec, total (progress samples, one row per refresh).
    """
    keys = keys or []
    order = Window.partitionBy(*keys).orderBy("t_sec")
    step = F.col("total") - F.lag("total").over(order)
    seconds = F.col("t_sec") - F.lag("t_sec").over(order)
    grown = samples.withColumn("_d", step).withColumn("_s", seconds).filter("_d > 0 AND _s > 0").withColumn("rate", F.col("_d") / F.col("_s") * 60)
    recent = F.avg("rate").over(order.rowsBetween(-5, 0))
    out = grown.withColumn("avg_rate", recent)
    return out.select(*keys, "t_sec", "total", round_to("avg_rate", 6).alias("avg_rate"),
                      round_to((F.lit(target) - F.col("total")) / F.col("avg_rate"), 4).alias("eta_min"))
