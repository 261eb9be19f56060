"""Nested structure documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

POINT = "struct<x:double,y:double>"
STRUCTURE = (
    f"struct<model:string,source:string,"
    f"walls:array<struct<id:string,orientation:string,polyline:array<{POINT}>,thickness:double,confidence:double,is_exterior:boolean,side:string>>,"
    f"openings:array<struct<id:string,kind:string,wall_id:string,position:{POINT},offset:double,span:double,orientation:string,side:string,swing:string,confidence:double>>,"
    f"junctions:array<struct<point:{POINT},type:string,wall_ids:array<string>>>,"
    f"structure_meta:struct<unit:string,scale_status:string,scale_hint:double,image_size:struct<width:int,height:int>>>"
)

#: Documents of a file.
FILE_ROWS = 50_000


def read(spark: SparkSession, path: str) -> DataFrame:
    """One structure per file, the file name as plan id."""
    rows = spark.read.text(path, wholetext=True).withColumn("plan_id", F.regexp_extract(F.input_file_name(), r"([^/]+)/[^/]+$", 1))
    return parse(rows, "value")


def write_lines(docs: DataFrame, key: str, column: str, path: str) -> None:
    """Many structures per file, one line each: the key, a tab, the document.

    JSON text holds no raw line break or tab, so a line is a document whatever
    its strings are. A null document is written as an empty one. Files are
    compressed and hold ``FILE_ROWS`` documents at most, so one is read by a task.
    """
    line = F.concat_ws("\t", F.col(key).cast("string"), F.coalesce(F.col(column), F.lit("{}")))
    docs.filter(F.col(key).isNotNull()).select(line.alias("value")).write.mode("overwrite").option("maxRecordsPerFile", FILE_ROWS).text(path, compression="gzip")


def read_lines(spark: SparkSession, path: str, key: str = "doc_id", kind: str = "long") -> DataFrame:
    """Structures written by ``write_lines``. Files are gathered by size, so millions of small documents need few tasks.

    A line whose document cannot be parsed keeps its key and has no parts.
    """
    parts = F.split("value", "\t", 2)
    rows = spark.read.text(path).select(parts[0].cast(kind).alias(key), parts[1].alias("_doc"))
    return parse(rows, "_doc").drop("_doc")


def parse(docs: DataFrame, column: str) -> DataFrame:
    return docs.withColumn("structure", F.from_json(column, STRUCTURE))


def explode_walls(docs: DataFrame, key: str) -> DataFrame:
    walls = docs.select(key, F.posexplode("structure.walls").alias("ord", "w"))
    p = F.col("w.polyline")
    return walls.select(
        key, "ord", F.col("w.id").alias("wall_id"), "w.orientation", p[0]["x"].alias("x1"), p[0]["y"].alias("y1"),
        p[1]["x"].alias("x2"), p[1]["y"].alias("y2"), F.coalesce("w.thickness", F.lit(4.0)).alias("thickness"),
        F.coalesce("w.confidence", F.lit(1.0)).alias("confidence"), F.coalesce("w.is_exterior", F.lit(False)).alias("is_exterior"),
    )


def explode_openings(docs: DataFrame, key: str) -> DataFrame:
    return docs.select(key, F.posexplode("structure.openings").alias("ord", "o")).select(
        key, "ord", F.col("o.id").alias("opening_id"), "o.kind", "o.wall_id", "o.position.x", "o.position.y", "o.offset", "o.span",
        "o.orientation", "o.side", "o.swing", "o.confidence",
    )


def explode_junctions(docs: DataFrame, key: str) -> DataFrame:
    return docs.select(key, F.explode("structure.junctions").alias("j")).select(key, "j.point.x", "j.point.y", "j.type", "j.wall_ids")
