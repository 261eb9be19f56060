"""Model responses: schema and validation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RESPONSE = (
    "struct<error:struct<code:string,message:string>,model_name:string,model_version:string,"
    "walls:array<struct<polyline:array<struct<x:double,y:double>>,thickness:double,orientation:string,is_exterior:boolean,confidence:double>>,"
    "openings:array<struct<kind:string,position:struct<x:double,y:double>,span:double,orientation:string,confidence:double,swing:string,door_type:string>>,"
    "image_size:struct<width:int,height:int>>"
)
REQUIRED = ["model_name", "model_version", "walls", "openings", "image_size"]


def validate(docs: DataFrame, column: str = "response") -> DataFrame:
    """parsed response with ``code`` and ``message`` of the first violation, null for a valid one."""
    out = docs.withColumn("r", F.from_json(column, RESPONSE))
    missing = F.array_compact(F.array(*[F.when(F.col(f"r.{n}").isNull(), n) for n in REQUIRED]))
    axes = ("horizontal", "vertical")
    checks = [
        (F.exists("r.walls", lambda w: F.coalesce(F.size(w["polyline"]), F.lit(0)) != 2), "wall polyline must contain exactly 2 points"),
        (F.exists("r.walls", lambda w: w["orientation"].isNotNull() & ~w["orientation"].isin(*axes)), "invalid wall orientation"),
        (F.exists("r.walls", lambda w: F.coalesce(w["thickness"], F.lit(4.0)) <= 0), "wall thickness must be positive"),
        (F.exists("r.openings", lambda o: ~F.coalesce(o["kind"].isin("door", "window"), F.lit(False))), "invalid opening kind"),
        (F.exists("r.openings", lambda o: o["orientation"].isNotNull() & ~o["orientation"].isin(*axes)), "invalid opening orientation"),
        (F.exists("r.openings", lambda o: F.coalesce(o["span"], F.lit(0.0)) <= 0), "opening span must be positive"),
        (F.col("r.image_size.width").isNull() | F.col("r.image_size.height").isNull(), "image_size must contain width and height"),
    ]
    failed = F.coalesce(*[F.when(cond, text) for cond, text in checks])
    payload = F.col("r.error").isNotNull()
    message = (
        F.when(payload, F.coalesce("r.error.message", F.lit("Unknown worker error")))
        .when(F.size(missing) > 0, F.concat(F.lit("missing required fields: "), F.array_join(missing, ",")))
        .otherwise(failed)
    )
    code = F.when(payload, F.coalesce("r.error.code", F.lit("UNKNOWN"))).when(F.col("message").isNotNull(), "INVALID_RESPONSE")
    return out.withColumn("message", message).withColumn("code", code)


def split_valid(validated: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Accepted and rejected responses."""
    return validated.filter("code IS NULL").drop("code", "message"), validated.filter("code IS NOT NULL").drop("r")
