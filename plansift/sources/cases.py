"""Benchmark case discovery."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CONTRACT = ["input.png", "input.jpg", "input.jpeg"]
SEGMENTATION = ["original.png", "original.jpg", "original.jpeg"]


def list_files(spark: SparkSession, root: str) -> DataFrame:
    """(case, name) of every file one level below ``root``; file contents are not read."""
    paths = spark.read.format("binaryFile").load(f"{root}/*/*").select("path")
    return paths.select(
        F.element_at(F.split("path", "/"), -2).alias("case"), F.element_at(F.split("path", "/"), -1).alias("name")
    )


def discover(listing: DataFrame, limit: int | None = None) -> DataFrame:
    """Usable cases in name order with their image and ground-truth kind."""
    present = listing.groupBy("case").agg(F.collect_set(F.when(F.col("name").isin(*CONTRACT, *SEGMENTATION, "expected.json", "label.npy", "heatmaps.json"), F.col("name"))).alias("names"))

    def first(names: list[str]):
        return F.coalesce(*[F.when(F.array_contains("names", n), F.lit(n)) for n in names])

    contract, original = first(CONTRACT), first(SEGMENTATION)
    labelled = F.array_contains("names", "label.npy") & F.array_contains("names", "heatmaps.json")
    expected = F.array_contains("names", "expected.json")
    kind = F.when(contract.isNotNull(), F.when(expected, "contract").otherwise("none")).when(
        original.isNotNull() & labelled, "segmentation"
    )
    out = present.select("case", F.coalesce(contract, original).alias("image"), kind.alias("ground_truth_kind")).filter(
        "ground_truth_kind IS NOT NULL"
    ).orderBy("case")
    return out if limit is None else out.limit(limit)
