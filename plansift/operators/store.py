"""Project and plan store operations on tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def owned_projects(projects: DataFrame, owner) -> DataFrame:
    """F16: projects of one owner."""
    return projects.filter(F.col("owner") == owner)


def owned_plans(plans: DataFrame, projects: DataFrame, owner) -> DataFrame:
    """F16: plans reached through the owner's projects."""
    mine = owned_projects(projects, owner).select(F.col("id").alias("project_id"))
    return plans.join(mine, "project_id", "left_semi")


def project_list(projects: DataFrame, plans: DataFrame) -> DataFrame:
    """Projects with plan count and latest change, newest first."""
    counts = plans.groupBy(F.col("project_id").alias("id")).agg(F.count(F.lit(1)).alias("plan_count"), F.max("updated_at").alias("updated_at"))
    return projects.join(counts, "id", "left").withColumn("plan_count", F.coalesce("plan_count", F.lit(0))).orderBy(F.desc("updated_at"))


def cascade_delete(plans: DataFrame, deleted: DataFrame) -> DataFrame:
    """Plans left after their projects are deleted."""
    return plans.join(deleted.select(F.col("id").alias("project_id")), "project_id", "left_anti")


def partial_update(plans: DataFrame, updates: DataFrame, fields: list[str]) -> DataFrame:
    """Only supplied fields change; ``has_<field>`` tells a supplied null from an absent one."""
    new = updates.select("id", *[F.col(f).alias(f"new_{f}") for f in fields], *[f"has_{f}" for f in fields])
    out = plans.join(new, "id", "left")
    for f in fields:
        out = out.withColumn(f, F.when(F.coalesce(f"has_{f}", F.lit(False)), F.col(f"new_{f}")).otherwise(F.col(f)))
    return out.select(*plans.columns)


def workspace_header(listed: DataFrame) -> DataFrame:
    """Project count, total plans, latest activity."""
    return listed.agg(F.count(F.lit(1)).alias("projects"), F.sum("plan_count").alias("total_plans"), F.max("updated_at").alias("latest_activity"))


def to_plan(rows: DataFrame) -> DataFrame:
    """Stored row -> plan record; missing lists become empty."""
    item = "array<struct<type:string,x1:double,y1:double,x2:double,y2:double,swing:string,_source:string>>"
    return rows.select(
        "id", F.col("project_id").alias("projectId"), "name", "structure",
        F.coalesce(F.from_json("reviewed_opening_annotations", item), F.array().cast(item)).alias("reviewedOpeningAnnotations"),
        F.struct(
            F.coalesce(F.from_json("placed_items_3d", "array<string>"), F.array().cast("array<string>")).alias("placedItems3d"),
            F.col("floor_material").alias("floorMaterial"), F.col("wall_material").alias("wallMaterial"),
        ).alias("scene"),
        F.col("updated_at").alias("updatedAt"),
    )


def drop_transient(annotations: Column) -> Column:
    """Annotations without the bookkeeping field."""
    return F.transform(annotations, lambda a: a.dropFields("_source"))


def mark_reviewed(structure: Column) -> Column:
    """Set the reviewed flag inside the nested meta."""
    return structure.withField("structure_meta.reviewed_opening_annotations_saved", F.lit(True))


def catalogue_lists(items: DataFrame) -> DataFrame:
    """Distinct categories with their sub-categories."""
    return items.select("category", "subcategory").distinct().orderBy("category", "subcategory")


def log_event(event: Column | str, **fields: Column) -> Column:
    """One JSON event with sorted keys; nested scalars stay, other values become text."""
    name = F.lit(event) if isinstance(event, str) else event
    items = {"event": name, **fields}
    return F.to_json(F.struct(*[items[k].alias(k) for k in sorted(items)]), {"ignoreNullFields": "false"})


def route_request(structure: Column, plan: Column, image: Column) -> Column:
    """Which input a request is parsed from; null when there is none."""
    return F.when(structure.isNotNull(), "structure").when(plan.isNotNull(), "plan").when(image.isNotNull(), "image")


def drawing_mode(source: Column, has_mask: Column, mask_sources: tuple[str, ...] = ("mask_local", "ensemble_local")) -> Column:
    """Mask regions when the source makes masks and one is present."""
    return F.when(source.isin(*mask_sources) & has_mask, "mask_regions").otherwise("structural")
