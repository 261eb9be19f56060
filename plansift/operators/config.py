"""Per-plan limits, carried on every row as one struct column ``cfg``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values: default limits
DEFAULTS = {
    "snap": 4.0,
    "junction": 6.0,
    "merge_gap": 48.0,
    "min_length": 12.0,
    "text_length": 60.0,
    "text_thickness": 6.0,
    "furniture_area": 40000.0,
    "exterior_coverage": 0.7,
}
# fixed values: limits per unit of image scale for plans measured in pixels
PER_SCALE = {
    "snap": 3.0,
    "junction": 5.0,
    "merge_gap": 6.0,
    "min_length": 5.0,
    "text_length": 30.0,
    "text_thickness": 2.0,
}
REFERENCE_WIDTH = 500.0


def default_config() -> Column:
    return F.struct(*[F.lit(v).alias(k) for k, v in DEFAULTS.items()])


def with_default_config(rows: DataFrame) -> DataFrame:
    return rows.withColumn("cfg", default_config())


def adaptive_config(plans: DataFrame) -> DataFrame:
    """One ``cfg`` per plan, scaled with the picture width when the unit is pixel."""
    scale = F.greatest(F.coalesce(F.col("image_w"), F.lit(1000)) / F.lit(REFERENCE_WIDTH), F.lit(1.0))
    scaled = {k: F.lit(v) * scale for k, v in PER_SCALE.items()}
    scaled["furniture_area"] = (F.lit(100.0) * scale) * (F.lit(100.0) * scale)
    scaled["exterior_coverage"] = F.lit(DEFAULTS["exterior_coverage"])
    pixel = F.struct(*[scaled[k].alias(k) for k in DEFAULTS])
    return plans.select("plan_id", F.when(F.col("unit") == "pixel", pixel).otherwise(default_config()).alias("cfg"))


def with_adaptive_config(rows: DataFrame, plans: DataFrame) -> DataFrame:
    return rows.join(adaptive_config(plans), "plan_id")
