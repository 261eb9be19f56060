"""SQL twins of ``plansift.views``: name -> (views it needs, SELECT text)."""

ORD = "((l_orderkey * 100000 + l_suppkey) * 10 + l_linenumber) * 64 + CAST(floor(l_quantity) AS BIGINT)"
ID = "concat_ws('-', l_orderkey, l_partkey, l_suppkey, l_linenumber, CAST(floor(l_quantity) AS BIGINT))"
FLAT = "(l_orderkey + l_linenumber) % 2 = 0"
SPAN_S = "40 * (l_orderkey % 4) + l_linenumber % 3"
SPAN_E = f"{SPAN_S} + 40 * (1 + CAST(floor(l_quantity) AS BIGINT) % 6)"
SLANT = "(CASE WHEN l_suppkey % 4 = 0 THEN 10 * (l_linenumber % 5) ELSE 0 END)"
FLIP = "l_orderkey % 3 = 0"
COORD = "40 * (l_suppkey % 8) + l_orderkey % 5"

_WALL = f"""SELECT l_partkey AS plan_id, {ID} AS wall_id, {ORD} AS ord,
 CASE WHEN {FLAT} THEN 'horizontal' ELSE 'vertical' END AS orientation,
 ({{coord}})::DOUBLE AS coord, ({SPAN_S})::DOUBLE AS s, ({SPAN_E})::DOUBLE AS e,
 (4 + 2 * (l_linenumber % 2))::DOUBLE AS thickness, 0.5::DOUBLE + l_discount AS confidence, l_orderkey AS k
 FROM lineitem WHERE l_returnflag IN ('A', 'N')"""

VIEWS: dict[str, tuple[str, str]] = {
    "plans": ("", """SELECT p_partkey AS plan_id, 400 + 4 * p_size AS image_w, 320 + 2 * p_size AS image_h,
 CASE WHEN p_partkey % 2 = 0 THEN 'pixel' ELSE 'inch' END AS unit FROM part"""),
    "walls": ("", _WALL.format(coord=COORD)),
    "truth_walls": ("", _WALL.format(coord=COORD + " + l_suppkey % 3 - 1") + " AND l_orderkey % 10 <> 0"),
    # geometry of raw_walls before it is spelled as JSON
    "raw_xy": ("", f"""SELECT l_partkey AS plan_id, {ID} AS wall_id, {ORD} AS ord,
 CASE WHEN l_orderkey % 4 = 0 OR {SLANT} <> 0 THEN NULL WHEN {FLAT} THEN 'horizontal' ELSE 'vertical' END AS orientation,
 (CASE WHEN {FLAT} THEN (CASE WHEN {FLIP} THEN {SPAN_E} ELSE {SPAN_S} END) ELSE {COORD} END)::DOUBLE AS ax,
 (CASE WHEN {FLAT} THEN {COORD} ELSE (CASE WHEN {FLIP} THEN {SPAN_E} ELSE {SPAN_S} END) END)::DOUBLE AS ay,
 (CASE WHEN {FLAT} THEN (CASE WHEN {FLIP} THEN {SPAN_S} ELSE {SPAN_E} END) ELSE {COORD} + {SLANT} END)::DOUBLE AS bx,
 (CASE WHEN {FLAT} THEN {COORD} + {SLANT} ELSE (CASE WHEN {FLIP} THEN {SPAN_S} ELSE {SPAN_E} END) END)::DOUBLE AS by_,
 CASE WHEN l_orderkey % 13 = 0 THEN 1 ELSE 2 END AS n_points,
 CASE WHEN l_linenumber % 5 = 0 THEN NULL ELSE (4 + 2 * (l_linenumber % 2))::DOUBLE END AS thickness,
 CASE WHEN l_linenumber % 6 = 0 THEN NULL ELSE 0.5::DOUBLE + l_discount END AS confidence,
 l_linenumber % 2 = 0 AS is_exterior
 FROM lineitem WHERE l_returnflag IN ('A', 'N')"""),
    "openings": ("", f"""SELECT l_partkey AS plan_id, {ID} AS opening_id, {ORD} AS ord,
 CASE WHEN l_linestatus = 'O' THEN 'door' ELSE 'window' END AS kind,
 CASE WHEN {FLAT} THEN 'horizontal' ELSE 'vertical' END AS orientation,
 (CASE WHEN {FLAT} THEN 40 * (l_orderkey % 8) + 20 ELSE {COORD} END)::DOUBLE AS x,
 (CASE WHEN {FLAT} THEN {COORD} ELSE 40 * (l_orderkey % 8) + 20 END)::DOUBLE AS y,
 (8 + CAST(floor(l_quantity) AS BIGINT) % 24)::DOUBLE AS span, 0.5::DOUBLE + l_tax AS confidence,
 CASE l_orderkey % 5 WHEN 0 THEN 'top' WHEN 1 THEN 'bottom' WHEN 2 THEN 'left' END AS side, l_orderkey AS k
 FROM lineitem WHERE l_returnflag = 'R'"""),
    "rooms": ("", """SELECT o_custkey AS plan_id, o_orderkey AS room_id, concat('ROOM ', o_orderkey % 9) AS name,
 (100 * (o_orderkey % 7))::DOUBLE AS x, (80 * ((o_orderkey // 7) % 5))::DOUBLE AS y,
 (100 * (1 + o_orderkey % 2))::DOUBLE AS w, (80 + 80 * ((o_orderkey // 2) % 2))::DOUBLE AS h,
 CASE WHEN o_orderstatus = 'P' THEN 'window' ELSE 'door' END AS opening_kind,
 CASE o_orderkey % 5 WHEN 0 THEN 'bottom' WHEN 1 THEN 'top' WHEN 2 THEN 'left' WHEN 3 THEN 'right' ELSE 'middle' END AS opening_side,
 (o_orderkey % 30)::DOUBLE AS opening_offset, (o_orderkey % 36)::DOUBLE AS opening_width,
 CASE WHEN o_orderstatus = 'F' THEN 'garage' ELSE 'normal' END AS door_type FROM orders"""),
    "labels3": ("plans", """SELECT plan_id, n - 1 AS label_ord, concat('ROOM ', n) AS room_name,
 (37 * plan_id + 131 * n) % image_w AS seed_x, (53 * plan_id + 97 * n) % image_h AS seed_y,
 ((plan_id + n) % 5 * 60)::DOUBLE AS sqft, (1000 + plan_id % 700)::DOUBLE AS total_sqft
 FROM plans, (VALUES (1), (2), (3)) t(n)"""),
    "pixels": ("", f"""SELECT l_partkey AS image_id, {ORD} AS px, (7 * l_orderkey) % 256 AS r, (31 * l_suppkey) % 256 AS g,
 (13 * l_partkey + l_linenumber) % 256 AS b FROM lineitem"""),
    "pixel_grid": ("", """SELECT DISTINCT l_partkey AS image_id, l_orderkey % 64 AS x, (3 * l_suppkey + l_linenumber) % 64 AS y
 FROM lineitem"""),
    "manifest": ("", """SELECT source AS dataset, doc_id AS sample_id, lang AS part,
 CASE WHEN doc_id % 3 = 0 THEN concat('pv/', doc_id, '.png') END AS preview_path FROM documents"""),
    "audit_input": ("", """SELECT doc_id AS sample_id, source AS dataset, n_chars + 100 AS total,
 (n_chars * ((37 * doc_id) % 80)) // 100 AS wall, (n_chars * ((53 * doc_id) % 60)) // 100 AS room,
 greatest((11 * doc_id) % 40 - 5, 0) AS opening, (7 * doc_id) % 6 AS rooms, (5 * doc_id) % 12 AS channels,
 (3 * doc_id) % 30 AS points, 60 + (29 * doc_id) % 1200 AS h, 60 + (41 * doc_id) % 2400 AS w FROM documents"""),
    "crawl_index": ("", """SELECT event_id, event_type AS source, concat('u', event_id % 5000) AS source_url, ts FROM events"""),
    "run_log": ("", """SELECT user_id AS run_id, event_id, ts, value AS val_loss,
 CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events"""),
    "projects": ("", "SELECT c_custkey AS id, c_nationkey AS owner, c_name AS name FROM customer"),
    "plan_store": ("", """SELECT o_orderkey AS id, o_custkey AS project_id, o_orderpriority AS name,
 o_orderdate AS updated_at, o_orderstatus AS status, o_totalprice AS price FROM orders"""),
    "polygons": ("", f"""SELECT plan_id, poly_id, poly_type, cls, n AS corner,
 x + CASE WHEN n IN (1, 2) THEN w ELSE 0 END + CASE WHEN n = 2 THEN d ELSE 0 END AS px,
 y + CASE WHEN n >= 2 THEN h ELSE 0 END AS py
 FROM (SELECT l_partkey AS plan_id, {ORD} AS poly_id,
 CASE WHEN l_returnflag = 'R' THEN 'icon' WHEN l_returnflag = 'N' THEN 'opening' ELSE 'wall' END AS poly_type,
 l_linenumber % 4 AS cls, (30 * (l_orderkey % 13))::DOUBLE AS x, (20 * (l_suppkey % 15))::DOUBLE AS y,
 (CAST(floor(l_quantity) AS BIGINT) % 40)::DOUBLE AS w, (l_orderkey % 11)::DOUBLE AS h, (l_linenumber % 2)::DOUBLE AS d
 FROM lineitem) b, (VALUES (0), (1), (2), (3)) c(n)"""),
    "entities": ("", f"""SELECT l_partkey AS file_id, {ORD} AS handle,
 CASE l_suppkey % 5 WHEN 0 THEN 'WALLS' WHEN 1 THEN 'DOORS' WHEN 2 THEN 'WINS' WHEN 3 THEN 'DIMS' ELSE '0' END AS layer,
 CASE l_linenumber % 4 WHEN 0 THEN 'LINE' WHEN 1 THEN 'CIRCLE' WHEN 2 THEN 'ARC' ELSE 'DIMENSION' END AS type,
 (l_orderkey % 97)::DOUBLE AS x1, (l_suppkey % 89)::DOUBLE AS y1, (l_orderkey % 83)::DOUBLE AS x2,
 ((l_suppkey * 7) % 79)::DOUBLE AS y2, (1 + l_orderkey % 17)::DOUBLE AS radius,
 ((l_orderkey * 15) % 360)::DOUBLE AS start_angle, ((l_suppkey * 45) % 360)::DOUBLE AS end_angle,
 l_orderkey % 256 AS dim_raw FROM lineitem"""),
    "members": ("", """SELECT concat('arch-', (doc_id // 12) % 7) AS archive, doc_id AS ordinal,
 CASE doc_id % 4 WHEN 0 THEN concat('s', doc_id // 12, '.png') WHEN 1 THEN concat('s', doc_id // 12, '.svg')
 WHEN 2 THEN concat(lang, '/label_', doc_id, '.JSON') ELSE concat(lang, '/raw') END AS name FROM documents"""),
    # default limits: snap 4, junction 6, merge gap 48, minimum length 12
    "jpairs": ("walls", """SELECT h.plan_id, h.wall_id AS h_id, v.wall_id AS v_id, v.coord AS x, h.coord AS y,
 least(abs(v.coord - h.s), abs(v.coord - h.e)) <= t.tol AS h_end,
 least(abs(h.coord - v.s), abs(h.coord - v.e)) <= t.tol AS v_end
 FROM walls h JOIN walls v ON h.plan_id = v.plan_id AND h.orientation = 'horizontal' AND v.orientation = 'vertical',
 LATERAL (SELECT least(greatest(6.0::DOUBLE, greatest(h.thickness, v.thickness) / 2 + 4), 15.0::DOUBLE) AS tol) t
 WHERE v.coord BETWEEN h.s - t.tol AND h.e + t.tol AND h.coord BETWEEN v.s - t.tol AND v.e + t.tol"""),
    "junctions": ("walls jpairs", """SELECT plan_id, x, y,
 CASE max(CASE WHEN h_end AND v_end THEN 0 WHEN h_end OR v_end THEN 1 ELSE 2 END) WHEN 0 THEN 'L' WHEN 1 THEN 'T' ELSE 'X' END AS type,
 count(DISTINCT h_id) + count(DISTINCT v_id) AS n_walls FROM jpairs GROUP BY ALL"""),
}
