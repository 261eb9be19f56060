"""Archive members and SVG elements as tables."""

from __future__ import annotations

import functools
import io
import itertools
import tarfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# fixed values: what a member's name holds or ends with
ANNOTATION_HINTS = (".json", ".xml", ".txt", ".csv", "annotation", "label")
IMAGE_ENDS = (".png", ".jpg", ".jpeg", ".bmp")

LABEL = "{http://www.inkscape.org/namespaces/inkscape}label"


#: Members that a task hands on at a time.
MEMBERS = 1 << 13


def scan(contents: DataFrame, scan_limit: int | None = None) -> DataFrame:
    """(archive, content) -> members in archive order, all of them unless ``scan_limit`` is given.

    A task reads one archive at a time, in the place where its bytes lie, and
    hands on a bounded number of members, however many archives come together.
    """
    schema = pa.schema([("archive", pa.int64()), ("ordinal", pa.int64()), ("name", pa.string())])

    def members(batch: pa.RecordBatch) -> Iterator[tuple]:
        for archive, content in zip(batch.column("archive"), batch.column("content")):
            with pa.BufferReader(content.as_buffer()) as file, tarfile.open(fileobj=file) as tar:
                for ordinal in itertools.count() if scan_limit is None else range(scan_limit):
                    member = tar.next()
                    if member is None:
                        break
                    # the archive would keep every member it has read
                    tar.members.clear()
                    yield archive.as_py(), ordinal, member.name

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in itertools.batched(members(batch), MEMBERS):
                yield pa.RecordBatch.from_arrays([pa.array(column, kind) for column, kind in zip(zip(*rows), schema.types)], schema=schema)

    return contents.select("archive", "content").mapInArrow(walk, "archive long, ordinal long, name string")


def paired_stems(members: DataFrame) -> DataFrame:
    """Root-level stems that have both a .png and a .svg member."""
    ext = F.lower(F.regexp_extract("name", r"(\.[^.]*)$", 1))
    root = members.filter(~F.col("name").contains("/")).withColumn("ext", ext).filter(F.col("ext").isin(".png", ".svg"))
    return (
        root.groupBy("archive", F.regexp_replace("name", r"\.[^.]*$", "").alias("stem"))
        .agg(F.bool_or(F.col("ext") == ".png").alias("png"), F.bool_or(F.col("ext") == ".svg").alias("svg"))
        .filter("png AND svg")
        .select("archive", "stem")
    )


def first_members(members: DataFrame, n: int) -> DataFrame:
    """The first ``n`` members of every archive.

    The cut is applied per ordinal bucket first, so a huge archive never sorts in one task.
    """
    bucket = F.pmod(F.hash("ordinal"), F.lit(64))
    local = F.row_number().over(Window.partitionBy("archive", "_b").orderBy("ordinal"))
    few = members.withColumn("_b", bucket).withColumn("_r", local).filter(F.col("_r") <= n).drop("_b", "_r")
    return few.withColumn("rn", F.row_number().over(Window.partitionBy("archive").orderBy("ordinal"))).filter(F.col("rn") <= n)


def member_counters(members: DataFrame) -> DataFrame:
    """Extensions and top-level folders per archive."""
    ext = F.lower(F.regexp_extract("name", r"[^/]*(\.[^./]+)$", 1))
    parts = F.array(
        F.struct(F.lit("extension").alias("kind"), F.when(ext == "", "<no_ext>").otherwise(ext).alias("value")),
        F.struct(F.lit("top_level").alias("kind"), F.element_at(F.filter(F.split("name", "/"), lambda p: p != ""), 1).alias("value")),
    )
    return members.select("archive", F.inline(parts)).groupBy("archive", "kind", "value").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"))


def hints(name: Column) -> Column:
    """Which lists a member's name belongs to: ``annotation``, ``image``, both or none."""
    low = F.lower(name)

    def any_of(tests: list[Column]) -> Column:
        return functools.reduce(Column.__or__, tests)

    annotation = any_of([low.contains(hint) for hint in ANNOTATION_HINTS])
    image = any_of([low.endswith(end) for end in IMAGE_ENDS])
    return F.array_compact(F.array(F.when(annotation, F.lit("annotation")), F.when(image, F.lit("image"))))


def hint_lists(members: DataFrame, n: int = 50) -> DataFrame:
    """The first ``n`` annotation-like and image-like members of every archive, by ordinal.

    Ties of an ordinal go by name. Ranks are cut in buckets first, so a list
    is picked from a few rows a bucket, however many members an archive has.
    """
    listed = members.select("archive", "ordinal", "name", F.explode(hints(F.col("name"))).alias("hint"))
    keys, order = ["archive", "hint"], [F.asc_nulls_last("ordinal"), F.asc("name")]
    few = listed.withColumn("_b", F.pmod(F.xxhash64("ordinal", "name"), F.lit(256))).withColumn(
        "_r", F.row_number().over(Window.partitionBy(*keys, "_b").orderBy(*order))).filter(F.col("_r") <= n)
    return few.withColumn("rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("rn") <= n).select(*keys, "rn", "ordinal", "name")


def archive_totals(members: DataFrame) -> DataFrame:
    """Per archive the members scanned, those of either hint and the numbers of extensions and top folders."""
    ext = F.lower(F.regexp_extract("name", r"[^/]*(\.[^./]+)$", 1))
    top = F.element_at(F.filter(F.split("name", "/"), lambda p: p != ""), 1)
    marked = members.select("archive", hints(F.col("name")).alias("h"), ext.alias("ext"), top.alias("top"))
    # one row per archive, extension and folder leaves the map side; a huge archive never gathers its members
    groups = marked.groupBy("archive", "ext", "top").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.array_contains("h", "annotation")).alias("a"), F.count_if(F.array_contains("h", "image")).alias("i"))
    return groups.groupBy("archive").agg(
        F.sum("n").alias("members_scanned"), F.sum("a").alias("annotation_like"), F.sum("i").alias("image_like"),
        F.count_distinct("ext").alias("extensions"), F.count_distinct("top").alias("top_level"))


def _elements(batches):
    for batch in batches:
        rows = []
        for archive, text in zip(batch["archive"], batch["svg"]):
            stack, ordinal = [], 0
            for event, node in ElementTree.iterparse(io.BytesIO(text.encode()), events=("start", "end")):
                if event == "end":
                    stack.pop()
                    continue
                own = node.get(LABEL)
                stack.append(own or (stack[-1] if stack else None))
                rows.append((archive, ordinal, node.tag.split("}", 1)[-1], stack[-1], own, node.get("semantic-id"), node.get("stroke"), node.get("d"), node.get("cx"), node.get("cy"), node.get("r")))
                ordinal += 1
        yield pd.DataFrame(rows, columns=["archive", "ordinal", "tag", "layer", "own_label", "semantic_id", "stroke", "d", "cx", "cy", "r"])


def svg_elements(docs: DataFrame) -> DataFrame:
    """Every element of (archive, svg) with its layer label, semantic id and stroke."""
    schema = "archive long, ordinal int, tag string, layer string, own_label string, semantic_id string, stroke string, d string, cx string, cy string, r string"
    return docs.select("archive", "svg").mapInPandas(_elements, schema)


def counters(elements: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Counts of tags, layers, semantic ids and strokes, most common first; in all or for each ``by``."""
    parts = F.array(*[F.struct(F.lit(k).alias("kind"), F.col(c).alias("value")) for k, c in (("tag", "tag"), ("layer", "own_label"), ("semantic_id", "semantic_id"), ("stroke", "stroke"))])
    return elements.select(*by, F.inline(parts)).filter("value IS NOT NULL").groupBy(*by, "kind", "value").agg(F.count(F.lit(1)).alias("n")).orderBy(*by, F.desc("n"))
