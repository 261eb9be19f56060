"""Operator 8: line dedup by site-relative frequency (native).

A line is boilerplate on a host when two pages or more hold it and those are
more than ``max_ratio`` of the host's pages, however few pages the host has.
Lines are counted once a page, so a page cannot push its own lines over the
ratio, and a host of one page keeps all.

Counting is one aggregate over (host, line key) with map-side sums; the key is
128 bits of hash, so lines never travel twice. A hot host spreads over its
lines, a line on every page of a host is one partial sum per task, and the
join that marks it is a plain sort-merge join that Spark splits when skewed.

Defined results: a null host is a host of its own; null text counts as a page
without lines and stays null. Blank lines are never dropped, nor counted.
Repeated rows count as pages of their own. Texts of any length are read whole; an
empty table gives no rows. The columns of the input come back inside ``row``, so
none of them clashes with the operator's own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plansift.llm.common import SPACES, let

MAX_RATIO = 0.2

#: Tags that end a line of visible text.
BLOCK_TAGS = "p|div|br|li|ul|ol|nav|article|section|header|footer|h[1-6]|title|head|body|html|table|tr|td|th|aside|main|pre|blockquote"


def host_of(url: Column) -> Column:
    """Lower-case host of a URL; null where there is none."""
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]+)", 1))
    return F.when(host != "", host)


def visible_text(html: Column) -> Column:
    """Text of a page, one line per block: scripts, styles and comments go, block tags break lines, other tags go."""
    bare = F.regexp_replace(html, r"(?is)<script.*?</script>|<style.*?</style>|<!--.*?-->", "")
    broken = F.regexp_replace(bare, rf"(?i)</?({BLOCK_TAGS})(/|[ \t\n\r][^>]*)?>", "\n")
    return F.regexp_replace(broken, r"<[^>]*>", "")


def line_key(line: Column) -> Column:
    """128 bits of a trimmed line."""
    return F.struct(F.xxhash64(line).alias("h1"), F.xxhash64(F.lit(7), line).alias("h2"))


def _trimmed(lines: Column) -> Column:
    return F.transform(lines, lambda line: F.btrim(line, F.lit(SPACES)))


def dedup_lines(
    pages: DataFrame, page_id: str, host: Column, text: Column, max_ratio: float = MAX_RATIO,
) -> DataFrame:
    """``row`` (all columns of ``pages``), host, n_lines, n_dropped and kept_text per page.

    ``page_id`` only spreads the work; rows that share one are still told apart.
    """
    keyed = pages.select(
        F.struct("*").alias("row"), host.alias("host"), text.alias("text"),
        F.struct(F.xxhash64(page_id, host, text).alias("p1"), F.xxhash64(F.lit(7), page_id, host, text).alias("p2")).alias("page"),
    )
    lines = lambda: _trimmed(F.split("text", "\n", -1))
    content = F.filter(F.array_distinct(lines()), lambda line: line != "")
    on_page = (
        keyed.select("page", "host", F.explode(content).alias("line"))
        .select("page", "host", line_key(F.col("line")).alias("key"))
    )
    totals = keyed.groupBy("host").agg(F.count(F.lit(1)).alias("pages"))
    found = on_page.groupBy("host", "key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    common = (
        found.join(totals.withColumnRenamed("host", "of"), F.col("host").eqNullSafe(F.col("of")))
        .filter(F.col("n") > max_ratio * F.col("pages")).select(F.col("host").alias("of"), F.col("key").alias("bad"))
    )
    drops = (
        on_page.join(common, F.col("host").eqNullSafe(F.col("of")) & (F.col("key") == F.col("bad")))
        .groupBy("page").agg(F.collect_set("key").alias("drops"))
    )
    marked = keyed.join(drops, "page", "left")
    is_bad = lambda line, bad: (line != "") & F.array_contains(bad, line_key(line))
    kept = F.when(F.col("drops").isNull(), F.struct(F.col("text").alias("text"), F.lit(0).alias("n"))).otherwise(
        let(F.col("drops"), lambda bad: let(F.split("text", "\n", -1), lambda raw: let(
            F.filter(raw, lambda line: ~is_bad(F.btrim(line, F.lit(SPACES)), bad)),
            lambda good: F.struct(F.array_join(good, "\n").alias("text"), (F.size(raw) - F.size(good)).alias("n"))))))
    n_lines = F.size(F.filter(F.coalesce(lines(), F.array().cast("array<string>")), lambda line: line != ""))
    return (
        marked.withColumn("kept", kept)
        .select("row", "host", n_lines.cast("long").alias("n_lines"),
                F.col("kept.n").cast("long").alias("n_dropped"), F.col("kept.text").alias("kept_text"))
    )
