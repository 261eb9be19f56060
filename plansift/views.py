"""Floor-plan tables derived from the benchmark star schema.

Each view is plain integer arithmetic over one input table, so another engine
can reproduce it exactly. ``load`` reads only the columns a view needs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# (orderkey, partkey, suppkey, linenumber) repeats at some scale factors; the quantity tells those rows apart
ORD = "((l_orderkey * 100000 + l_suppkey) * 10 + l_linenumber) * 64 + cast(l_quantity AS int)"
ID = "concat_ws('-', l_orderkey, l_partkey, l_suppkey, l_linenumber, cast(l_quantity AS int))"


def load(spark: SparkSession, sf: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{table}.parquet")


def plans(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "part").selectExpr(
        "p_partkey AS plan_id",
        "400 + 4 * p_size AS image_w",
        "320 + 2 * p_size AS image_h",
        "if(p_partkey % 2 = 0, 'pixel', 'inch') AS unit",
    )


def walls(spark: SparkSession, sf: str) -> DataFrame:
    return (
        load(spark, sf, "lineitem")
        .filter("l_returnflag IN ('A', 'N')")
        .selectExpr(
            "l_partkey AS plan_id",
            f"{ID} AS wall_id",
            f"{ORD} AS ord",
            "if((l_orderkey + l_linenumber) % 2 = 0, 'horizontal', 'vertical') AS orientation",
            "cast(40 * (l_suppkey % 8) + l_orderkey % 5 AS double) AS coord",
            "cast(40 * (l_orderkey % 4) + l_linenumber % 3 AS double) AS s",
            "cast(40 * (l_orderkey % 4) + l_linenumber % 3 + 40 * (1 + cast(l_quantity AS int) % 6) AS double) AS e",
            "cast(4 + 2 * (l_linenumber % 2) AS double) AS thickness",
            "0.5D + l_discount AS confidence",
            "l_orderkey AS k",
        )
    )


def truth_walls(spark: SparkSession, sf: str) -> DataFrame:
    """The same plans as drawn by a second source: lines moved by up to one unit, some missing."""
    return (
        load(spark, sf, "lineitem")
        .filter("l_returnflag IN ('A', 'N') AND l_orderkey % 10 <> 0")
        .selectExpr(
            "l_partkey AS plan_id",
            f"{ID} AS wall_id",
            f"{ORD} AS ord",
            "if((l_orderkey + l_linenumber) % 2 = 0, 'horizontal', 'vertical') AS orientation",
            "cast(40 * (l_suppkey % 8) + l_orderkey % 5 + l_suppkey % 3 - 1 AS double) AS coord",
            "cast(40 * (l_orderkey % 4) + l_linenumber % 3 AS double) AS s",
            "cast(40 * (l_orderkey % 4) + l_linenumber % 3 + 40 * (1 + cast(l_quantity AS int) % 6) AS double) AS e",
            "cast(4 + 2 * (l_linenumber % 2) AS double) AS thickness",
            "0.5D + l_discount AS confidence",
            "l_orderkey AS k",
        )
    )


def raw_walls(spark: SparkSession, sf: str) -> DataFrame:
    """Unclean wall rows: JSON points in two spellings, reversed ends, slants, gaps in the fields."""
    slant = "if(l_suppkey % 4 = 0, 10 * (l_linenumber % 5), 0)"
    s = "40 * (l_orderkey % 4) + l_linenumber % 3"
    e = f"{s} + 40 * (1 + cast(l_quantity AS int) % 6)"
    c = "40 * (l_suppkey % 8) + l_orderkey % 5"
    flat = "(l_orderkey + l_linenumber) % 2 = 0"
    flip = "l_orderkey % 3 = 0"
    return (
        load(spark, sf, "lineitem")
        .filter("l_returnflag IN ('A', 'N')")
        .selectExpr(
            "l_partkey AS plan_id",
            f"{ID} AS wall_id",
            f"{ORD} AS ord",
            f"if(l_orderkey % 4 = 0 OR {slant} <> 0, NULL, if({flat}, 'horizontal', 'vertical')) AS orientation",
            f"if({flat}, if({flip}, {e}, {s}), {c}) AS ax",
            f"if({flat}, {c}, if({flip}, {e}, {s})) AS ay",
            f"if({flat}, if({flip}, {s}, {e}), {c} + {slant}) AS bx",
            f"if({flat}, {c} + {slant}, if({flip}, {s}, {e})) AS `by`",
            "if(l_orderkey % 13 = 0, 1, 2) AS n_points",
            "if(l_linenumber % 5 = 0, NULL, cast(4 + 2 * (l_linenumber % 2) AS double)) AS thickness",
            "if(l_linenumber % 6 = 0, NULL, 0.5D + l_discount) AS confidence",
            "l_linenumber % 2 = 0 AS is_exterior",
        )
        .selectExpr(
            "plan_id", "wall_id", "ord", "orientation", "thickness", "confidence", "is_exterior",
            """CASE WHEN n_points = 1 THEN format_string('[{"x":%d,"y":%d}]', ax, ay)
                    WHEN ord % 2 = 0 THEN format_string('[{"x":%d,"y":%d},{"x":%d,"y":%d}]', ax, ay, bx, `by`)
                    ELSE format_string('[[%d,%d],[%d,%d]]', ax, ay, bx, `by`) END AS polyline""",
        )
    )


def openings(spark: SparkSession, sf: str) -> DataFrame:
    flat = "(l_orderkey + l_linenumber) % 2 = 0"
    cross = "cast(40 * (l_suppkey % 8) + l_orderkey % 5 AS double)"
    along = "cast(40 * (l_orderkey % 8) + 20 AS double)"
    return (
        load(spark, sf, "lineitem")
        .filter("l_returnflag = 'R'")
        .selectExpr(
            "l_partkey AS plan_id",
            f"{ID} AS opening_id",
            f"{ORD} AS ord",
            "if(l_linestatus = 'O', 'door', 'window') AS kind",
            f"if({flat}, 'horizontal', 'vertical') AS orientation",
            f"if({flat}, {along}, {cross}) AS x",
            f"if({flat}, {cross}, {along}) AS y",
            "cast(8 + cast(l_quantity AS int) % 24 AS double) AS span",
            "0.5D + l_tax AS confidence",
            "CASE l_orderkey % 5 WHEN 0 THEN 'top' WHEN 1 THEN 'bottom' WHEN 2 THEN 'left' END AS side",
            "l_orderkey AS k",
        )
    )


def rooms(spark: SparkSession, sf: str) -> DataFrame:
    """Room boxes on a 100 x 80 grid, one per order; the customer is the plan."""
    return load(spark, sf, "orders").selectExpr(
        "o_custkey AS plan_id",
        "o_orderkey AS room_id",
        "concat('ROOM ', o_orderkey % 9) AS name",
        "cast(100 * (o_orderkey % 7) AS double) AS x",
        "cast(80 * (floor(o_orderkey / 7) % 5) AS double) AS y",
        "cast(100 * (1 + o_orderkey % 2) AS double) AS w",
        "cast(80 + 80 * (floor(o_orderkey / 2) % 2) AS double) AS h",
        "if(o_orderstatus = 'P', 'window', 'door') AS opening_kind",
        "element_at(array('bottom', 'top', 'left', 'right', 'middle'), cast(o_orderkey % 5 AS int) + 1) AS opening_side",
        "cast(o_orderkey % 30 AS double) AS opening_offset",
        "cast(o_orderkey % 36 AS double) AS opening_width",
        "if(o_orderstatus = 'F', 'garage', 'normal') AS door_type",
    )


def labels(spark: SparkSession, sf: str) -> DataFrame:
    """Room labels: three seeds per plan inside the picture."""
    return plans(spark, sf).selectExpr(
        "plan_id",
        "posexplode(array(1, 2, 3)) AS (label_ord, n)",
        "image_w", "image_h",
    ).selectExpr(
        "plan_id",
        "label_ord",
        "concat('ROOM ', n) AS room_name",
        "cast((37 * plan_id + 131 * n) % image_w AS int) AS seed_x",
        "cast((53 * plan_id + 97 * n) % image_h AS int) AS seed_y",
        "cast((plan_id + n) % 5 * 60 AS double) AS sqft",
        "cast(1000 + plan_id % 700 AS double) AS total_sqft",
    )


def pixels(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "lineitem").selectExpr(
        "l_partkey AS image_id",
        f"{ORD} AS px",
        "cast((7 * l_orderkey) % 256 AS int) AS r",
        "cast((31 * l_suppkey) % 256 AS int) AS g",
        "cast((13 * l_partkey + l_linenumber) % 256 AS int) AS b",
    )


def pixel_grid(spark: SparkSession, sf: str) -> DataFrame:
    """Sparse pixel positions inside a 64 x 64 tile per image."""
    return load(spark, sf, "lineitem").selectExpr(
        "l_partkey AS image_id",
        "cast(l_orderkey % 64 AS int) AS x",
        "cast((3 * l_suppkey + l_linenumber) % 64 AS int) AS y",
    ).distinct()


def manifest(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "documents").selectExpr(
        "source AS dataset", "doc_id AS sample_id", "lang AS part",
        "if(doc_id % 3 = 0, concat('pv/', doc_id, '.png'), NULL) AS preview_path",
    )


def audit_input(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "documents").selectExpr(
        "doc_id AS sample_id", "source AS dataset",
        "n_chars + 100 AS total",
        "floor(n_chars * ((37 * doc_id) % 80) / 100) AS wall",
        "floor(n_chars * ((53 * doc_id) % 60) / 100) AS room",
        "greatest((11 * doc_id) % 40 - 5, 0) AS opening",
        "(7 * doc_id) % 6 AS rooms", "(5 * doc_id) % 12 AS channels", "(3 * doc_id) % 30 AS points",
        "60 + (29 * doc_id) % 1200 AS h", "60 + (41 * doc_id) % 2400 AS w",
    )


def crawl_index(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "events").selectExpr(
        "event_id", "event_type AS source", "concat('u', event_id % 5000) AS source_url", "ts",
    )


def run_log(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "events").selectExpr(
        "user_id AS run_id", "event_id", "ts", "value AS val_loss",
        "cast(get_json_object(props, '$.k') AS int) AS k",
    )


def projects(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "customer").selectExpr("c_custkey AS id", "c_nationkey AS owner", "c_name AS name")


def plan_store(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "orders").selectExpr(
        "o_orderkey AS id", "o_custkey AS project_id", "o_orderpriority AS name",
        "o_orderdate AS updated_at", "o_orderstatus AS status", "o_totalprice AS price",
    )


def polygons(spark: SparkSession, sf: str) -> DataFrame:
    """Polygon corners: each lineitem is a slightly slanted box of four corners."""
    return (
        load(spark, sf, "lineitem")
        .selectExpr(
            "l_partkey AS plan_id", f"{ORD} AS poly_id",
            "CASE WHEN l_returnflag = 'R' THEN 'icon' WHEN l_returnflag = 'N' THEN 'opening' ELSE 'wall' END AS poly_type",
            "cast(l_linenumber % 4 AS int) AS cls",
            "cast(30 * (l_orderkey % 13) AS double) AS x", "cast(20 * (l_suppkey % 15) AS double) AS y",
            "cast(cast(l_quantity AS int) % 40 AS double) AS w", "cast(l_orderkey % 11 AS double) AS h",
            "cast(l_linenumber % 2 AS double) AS d",
            "posexplode(array(0, 1, 2, 3)) AS (corner, n)",
        )
        .selectExpr(
            "plan_id", "poly_id", "poly_type", "cls", "corner",
            "x + if(n IN (1, 2), w, 0) + if(n = 2, d, 0) AS px", "y + if(n >= 2, h, 0) AS py",
        )
    )


def entities(spark: SparkSession, sf: str) -> DataFrame:
    """Drawing entities; the file is the part, layers and types follow the row."""
    return load(spark, sf, "lineitem").selectExpr(
        "l_partkey AS file_id", f"{ORD} AS handle",
        "element_at(array('WALLS', 'DOORS', 'WINS', 'DIMS', '0'), cast(l_suppkey % 5 AS int) + 1) AS layer",
        "element_at(array('LINE', 'CIRCLE', 'ARC', 'DIMENSION'), cast(l_linenumber % 4 AS int) + 1) AS type",
        "cast(l_orderkey % 97 AS double) AS x1", "cast(l_suppkey % 89 AS double) AS y1",
        "cast(l_orderkey % 83 AS double) AS x2", "cast((l_suppkey * 7) % 79 AS double) AS y2",
        "cast(1 + l_orderkey % 17 AS double) AS radius",
        "cast((l_orderkey * 15) % 360 AS double) AS start_angle", "cast((l_suppkey * 45) % 360 AS double) AS end_angle",
        "cast(l_orderkey % 256 AS int) AS dim_raw",
    )


def members(spark: SparkSession, sf: str) -> DataFrame:
    """Archive members, twelve documents in a row per archive."""
    return load(spark, sf, "documents").selectExpr(
        "concat('arch-', floor(doc_id / 12) % 7) AS archive", "doc_id AS ordinal",
        """CASE WHEN doc_id % 4 = 0 THEN concat('s', floor(doc_id / 12), '.png')
                WHEN doc_id % 4 = 1 THEN concat('s', floor(doc_id / 12), '.svg')
                WHEN doc_id % 4 = 2 THEN concat(lang, '/label_', doc_id, '.JSON')
                ELSE concat(lang, '/raw') END AS name""",
    )
