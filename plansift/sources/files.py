"""JSON-lines, report and checkpoint tables on a shared file system."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

MANIFEST = T.StructType(
    [
        T.StructField("dataset", T.StringType()), T.StructField("sample_id", T.LongType()),
        T.StructField("source_id", T.StringType()), T.StructField("part", T.StringType()),
        T.StructField("image_path", T.StringType()), T.StructField("label_path", T.StringType()),
        T.StructField("heatmaps_path", T.StringType()), T.StructField("meta_path", T.StringType()),
        T.StructField("preview_path", T.StringType()), T.StructField("scale", T.DoubleType()),
        T.StructField("image_shape", T.ArrayType(T.IntegerType())), T.StructField("label_shape", T.ArrayType(T.IntegerType())),
    ]
)


def scratch(spark: SparkSession) -> str:
    """A fresh folder below the shared checkpoint folder (a temporary one in local mode)."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a shared folder")
        return tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    return f"{folder}/plansift-{uuid.uuid4().hex}"


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines with the manifest schema; a missing path is an empty table."""
    try:
        return spark.read.schema(MANIFEST).json(path)
    except AnalysisException as exc:
        if exc.getCondition() == "PATH_NOT_FOUND":
            return spark.createDataFrame([], MANIFEST)
        raise


def write_jsonl(df: DataFrame, path: str) -> None:
    """One JSON object per line with sorted keys."""
    df.select(*sorted(df.columns)).write.mode("overwrite").json(path)


def append_jsonl(df: DataFrame, path: str) -> None:
    """Add records to a growing history."""
    df.select(*sorted(df.columns)).write.mode("append").json(path)


def write_report(results: DataFrame, path: str) -> None:
    """Result rows partitioned by run; runs that are not in ``results`` keep their folders."""
    results.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run_id").parquet(path)


def read_report(spark: SparkSession, path: str, run_id: str | None = None) -> DataFrame:
    """Rows of one run, which reads its folder only, or of all runs."""
    report = spark.read.parquet(path)
    return report if run_id is None else report.filter(F.col("run_id") == run_id)


def read_or_empty(spark: SparkSession, path: str, schema: str | T.StructType, kind: str = "parquet") -> DataFrame:
    """The files under ``path``; no rows where nothing was written yet."""
    try:
        return spark.read.schema(schema).format(kind).load(path)
    except AnalysisException as exc:
        if exc.getCondition() == "PATH_NOT_FOUND":
            return spark.createDataFrame([], schema)
        raise


VERSION = "number long, name string"


def save_table(df: DataFrame, path: str) -> None:
    """Replace a checkpoint table.

    The new version is written beside the others, and its name is published
    last, in one small append. A job that fails before that leaves the old version,
    and a reader never sees half a table.
    """
    spark, name = df.sparkSession, uuid.uuid4().hex
    df.write.parquet(f"{path}/data/{name}")
    last = read_or_empty(spark, f"{path}/versions", VERSION, "json").agg(F.max("number")).first()[0] or 0
    spark.range(1).select(F.lit(last + 1).cast("long").alias("number"), F.lit(name).alias("name")).write.mode("append").json(f"{path}/versions")


def load_table(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """Read the last published version of a checkpoint table, empty when there is none."""
    last = read_or_empty(spark, f"{path}/versions", VERSION, "json").agg(F.max_by("name", "number")).first()[0]
    return spark.createDataFrame([], schema) if last is None else spark.read.schema(schema).parquet(f"{path}/data/{last}")


def sample_manifest(samples: DataFrame) -> DataFrame:
    """Manifest rows with relative paths and shapes."""
    root = F.concat_ws("/", "dataset", F.col("sample_id").cast("string"))
    names = {"image_path": "image.png", "label_path": "label.npy", "heatmaps_path": "heatmaps.json", "meta_path": "meta.json"}
    return samples.select(
        "dataset", "sample_id", "scale", *[F.concat_ws("/", root, F.lit(v)).alias(k) for k, v in names.items()],
        F.array(F.lit(3), F.col("h").cast("int"), F.col("w").cast("int")).alias("image_shape"),
        F.array(F.lit(2), F.col("h").cast("int"), F.col("w").cast("int")).alias("label_shape"),
    )


def artifact_index(requests: DataFrame) -> DataFrame:
    """Url per artifact that exists; absent ones are left out of the map."""
    always = {"preview_url": "preview.png", "structure_url": "structure.json", "quality_url": "quality.json", "structure_preview_url": "structure_preview.png"}
    optional = {
        "dxf_region_plan_url": ("has_region_plan", "dxf_region_plan.json"), "mask_region_debug_url": ("has_region_debug", "mask_region_debug.json"),
        "provenance_url": ("has_provenance", "provenance.json"), "worker_overlay_url": ("has_overlay", "worker_overlay.png"),
    }

    def url(name: str):
        return F.concat(F.lit("/artifacts/"), "request_id", F.lit(f"/{name}"))

    pairs = []
    for key, name in always.items():
        pairs += [F.lit(key), url(name)]
    for key, (flag, name) in optional.items():
        pairs += [F.lit(key), F.when(F.col(flag), url(name))]
    return requests.withColumn("urls", F.map_filter(F.create_map(*pairs), lambda k, v: v.isNotNull()))
