"""Project store queries."""

from pyspark.sql import functions as F

from plansift import views as V
from plansift.catalog.registry import query
from plansift.operators import store as S


def stores(spark, sf):
    return V.projects(spark, sf), V.plan_store(spark, sf)


@query("s14_store_tables", "plan_store", """SELECT id, CASE WHEN price > 200000 THEN 'L' ELSE 'S' END AS size, 'pixel' AS unit FROM plan_store""")
def _(spark, sf):
    _, plans = stores(spark, sf)
    docs = plans.select("id", F.to_json(F.struct(F.when(F.col("price") > 200000, "L").otherwise("S").alias("size"),
                                                 F.struct(F.lit("pixel").alias("unit")).alias("meta"))).alias("structure"))
    v = F.parse_json("structure")
    return docs.select("id", F.variant_get(v, "$.size", "string").alias("size"), F.variant_get(v, "$.meta.unit", "string").alias("unit"))


@query("f16_owner_filter", "projects plan_store", "SELECT id, project_id FROM plan_store WHERE project_id IN (SELECT id FROM projects WHERE owner = 7)")
def _(spark, sf):
    projects, plans = stores(spark, sf)
    return S.owned_plans(plans, projects, 7).select("id", "project_id")


@query("j27_project_list", "projects plan_store", """SELECT p.id, name, coalesce(n, 0) AS plan_count, u AS updated_at FROM projects p
 LEFT JOIN (SELECT project_id, count(*) AS n, max(updated_at) AS u FROM plan_store GROUP BY project_id) c ON c.project_id = p.id""")
def _(spark, sf):
    return S.project_list(*stores(spark, sf)).select("id", "name", "plan_count", "updated_at")


@query("j28_cascade_delete", "projects plan_store", "SELECT id, project_id FROM plan_store WHERE project_id NOT IN (SELECT id FROM projects WHERE owner < 5)")
def _(spark, sf):
    projects, plans = stores(spark, sf)
    return S.cascade_delete(plans, projects.filter("owner < 5")).select("id", "project_id")


@query("j29_partial_update", "plan_store", """SELECT id, CASE WHEN id % 4 = 0 THEN 'renamed' ELSE name END AS name, CASE WHEN id % 6 = 0 THEN NULL ELSE status END AS status FROM plan_store""")
def _(spark, sf):
    _, plans = stores(spark, sf)
    updates = plans.filter("id % 2 = 0").selectExpr("id", "'renamed' AS name", "cast(NULL AS string) AS status", "id % 4 = 0 AS has_name", "id % 6 = 0 AS has_status")
    return S.partial_update(plans, updates, ["name", "status"]).select("id", "name", "status")


@query("a35_workspace_header", "projects plan_store", """SELECT count(*) AS projects, sum(coalesce(n, 0))::BIGINT AS total_plans, max(u) AS latest_activity FROM projects p
 LEFT JOIN (SELECT project_id, count(*) AS n, max(updated_at) AS u FROM plan_store GROUP BY project_id) c ON c.project_id = p.id""")
def _(spark, sf):
    return S.workspace_header(S.project_list(*stores(spark, sf)))


@query("p29_row_mapper", "plan_store", """SELECT id, project_id AS "projectId", CASE WHEN id % 3 = 0 THEN 0 ELSE 1 END AS n_annotations, 'hardwood' AS floor FROM plan_store""")
def _(spark, sf):
    _, plans = stores(spark, sf)
    rows = plans.selectExpr(
        "id", "project_id", "name", "updated_at", "cast(NULL AS string) AS structure", "cast(NULL AS string) AS placed_items_3d", "'hardwood' AS floor_material", "'white-paint' AS wall_material",
        """if(id % 3 = 0, NULL, '[{"type":"door","x1":1,"y1":2,"x2":3,"y2":4,"_source":"auto"}]') AS reviewed_opening_annotations""")
    return S.to_plan(rows).select("id", "projectId", F.size("reviewedOpeningAnnotations").alias("n_annotations"), F.col("scene.floorMaterial").alias("floor"))


@query("p28_persist_review", "plan_store", """SELECT id, '[{"type":"door","x1":' || (id % 9) || '}]' AS annotations, '{"structure_meta":{"unit":"pixel","reviewed_opening_annotations_saved":true}}' AS structure FROM plan_store""")
def _(spark, sf):
    _, plans = stores(spark, sf)
    notes = F.array(F.struct(F.lit("door").alias("type"), (F.col("id") % 9).alias("x1"), F.lit("auto").alias("_source")))
    structure = F.struct(F.struct(F.lit("pixel").alias("unit")).alias("structure_meta"))
    return plans.select("id", F.to_json(S.drop_transient(notes)).alias("annotations"), F.to_json(S.mark_reviewed(structure)).alias("structure"))


@query("u06_catalogue_lists", "", "SELECT DISTINCT p_type AS category, p_brand AS subcategory FROM part")
def _(spark, sf):
    return S.catalogue_lists(V.load(spark, sf, "part").select(F.col("p_type").alias("category"), F.col("p_brand").alias("subcategory")))


@query("p41_log_event", "plan_store", """SELECT id, concat('{"count":', project_id, ',"event":"plan.saved","ok":', CASE WHEN id % 2 = 0 THEN 'true' ELSE 'false' END, ',"reason":', CASE WHEN id % 5 = 0 THEN 'null' ELSE concat('"', status, '"') END, '}') AS line FROM plan_store""")
def _(spark, sf):
    _, plans = stores(spark, sf)
    return plans.select("id", S.log_event("plan.saved", reason=F.when(F.col("id") % 5 != 0, F.col("status")), ok=F.col("id") % 2 == 0, count=F.col("project_id")).alias("line"))


@query("p46_request_routing", "plan_store", """SELECT id, CASE WHEN id % 2 = 0 THEN 'structure' WHEN id % 3 = 0 THEN 'plan' WHEN id % 5 = 0 THEN 'image' END AS route,
 CASE WHEN id % 4 < 2 AND id % 3 > 0 THEN 'mask_regions' ELSE 'structural' END AS mode FROM plan_store""")
def _(spark, sf):
    _, plans = stores(spark, sf)
    given = [F.when(F.col("id") % m == 0, F.lit("x")) for m in (2, 3, 5)]
    source = F.element_at(F.array(*map(F.lit, ("mask_local", "ensemble_local", "heuristic", "remote"))), (F.col("id") % 4 + 1).cast("int"))
    return plans.select("id", S.route_request(*given).alias("route"), S.drawing_mode(source, F.col("id") % 3 > 0).alias("mode"))
