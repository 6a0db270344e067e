"""The derived tables of ``sources.derive`` once more, as SQL for the comparison."""

from __future__ import annotations

import re

_CLASS = """CASE event_type WHEN 'view' THEN 'person' WHEN 'click' THEN 'car'
 WHEN 'purchase' THEN 'chair' WHEN 'signup' THEN 'dog' ELSE 'unknown' END"""
_CONF = "least(1.0::DOUBLE, value / 100.0::DOUBLE)"
_CORRECTED = """CASE WHEN {i} % 5 = 0 THEN CASE {c} WHEN 'person' THEN 'dog' WHEN 'dog' THEN 'person'
 WHEN 'car' THEN 'truck' ELSE 'person' END ELSE {c} END"""
STATUS = """CASE WHEN {c} >= 0.85 THEN 'confirmed' WHEN {c} >= 0.5 THEN 'provisional'
 ELSE 'needs_review' END"""

TABLES = {
    "base_detections": f"""SELECT event_id AS det_id, 'cam_' || (user_id % 4) AS camera_id, ts, user_id,
 {_CLASS} AS class_name, {_CONF} AS confidence,
 ((event_id*37) % 560)::INTEGER AS x1, ((event_id*53) % 400)::INTEGER AS y1,
 ((event_id*37) % 560 + 10 + (event_id*7) % 71)::INTEGER AS x2,
 ((event_id*53) % 400 + 20 + (event_id*11) % 121)::INTEGER AS y2 FROM events""",
    "detections": """SELECT *, row_number() OVER (PARTITION BY camera_id ORDER BY ts, det_id) AS frame_no
 FROM base_detections""",
    "track_detections": f"""SELECT event_id AS det_id, 'cam_' || (user_id % 4) AS camera_id, n AS frame_no,
 user_id AS object_key, {_CLASS} AS class_name, {_CONF} AS confidence,
 ((user_id*97) % 500 + n % 10)::INTEGER AS x1, ((user_id*61) % 350)::INTEGER AS y1,
 ((user_id*97) % 500 + n % 10 + 60)::INTEGER AS x2, ((user_id*61) % 350 + 120)::INTEGER AS y2
 FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events)""",
    "objects": f"""SELECT user_id::VARCHAR AS id, {_CLASS} AS primary_class, {_CONF} AS confidence,
 {STATUS.format(c='(' + _CONF + ')')} AS classification_status, props AS attributes_json,
 first_seen, ts AS last_seen, 'cam_' || (user_id % 4) AS camera_id,
 first_seen AS created_at, ts AS updated_at, sightings, event_id AS last_event_id FROM (
 SELECT *, min(ts) OVER (PARTITION BY user_id) AS first_seen,
 count(*) OVER (PARTITION BY user_id) AS sightings,
 row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k = 1""",
    "trajectory_points": """SELECT user_id::VARCHAR AS object_id, value / 100 AS x, (event_id % 50) / 10 AS y,
 0.5::DOUBLE + (user_id % 20) / 10 AS z, ts AS "timestamp", 'cam_' || (event_id % 4) AS camera_id, event_id
 FROM events""",
    "alternatives": """SELECT det_id, class_name, confidence FROM base_detections UNION ALL
 SELECT det_id, 'other', greatest(0.0::DOUBLE, confidence - ((det_id % 30) / 100 + 0.005::DOUBLE))
 FROM base_detections""",
    "review_queue": f"""SELECT event_id AS id, user_id::VARCHAR AS object_id, props AS schema_json,
 CASE WHEN event_id % 7 <> 0 THEN 'crop_' || event_id || '.png' END AS image_path,
 CASE WHEN event_id % 17 = 0 THEN 'user_flagged' ELSE 'low_confidence' END AS reason,
 {_CLASS} AS provisional_class, {_CONF} AS confidence,
 CASE WHEN event_id % 17 = 0 THEN 4 WHEN {_CONF} < 0.2 THEN 3 ELSE 1 END AS priority,
 ts AS created_at, user_id, CASE WHEN event_id % 4 <= 1 THEN 'pending' WHEN event_id % 4 = 2
 THEN 'reviewed' ELSE 'skipped' END AS status FROM events WHERE {_CONF} < 0.5""",
    "review_decisions": f"""SELECT id AS review_id, {_CORRECTED.format(i='id', c='provisional_class')} AS human_class,
 'r' || (user_id % 3) AS reviewer, created_at + INTERVAL 1 HOUR AS decided_at, 'submit' AS action
 FROM review_queue WHERE status = 'reviewed'""",
    "feedback": f"""SELECT *, original_class = corrected_class AS was_correct FROM (
 SELECT event_id AS feedback_id, user_id::VARCHAR AS object_id, original_class,
 {_CONF} AS original_confidence, {_CORRECTED.format(i='event_id', c='original_class')} AS corrected_class,
 'r' || (user_id % 3) AS reviewer, ts AS "timestamp",
 CASE WHEN event_id % 7 <> 0 THEN 'crop_' || event_id || '.png' END AS image_path, props AS attributes
 FROM (SELECT *, {_CLASS} AS original_class FROM events))""",
    "vectors": """SELECT vec_id, 'obj_' || (vec_id // 4) AS object_id, 'cam_' || (label % 3) AS camera_id,
 'class_' || (label % 5) AS primary_class, embedding::DOUBLE[] AS embedding, vec_id AS ts FROM embeddings""",
    "gallery": "SELECT vec_id AS entry_id, * EXCLUDE (vec_id) FROM vectors",
    "gallery_queries": "SELECT vec_id AS query_id, * EXCLUDE (vec_id) FROM vectors WHERE vec_id % 20 = 0",
    "vector_queries": "SELECT vec_id AS query_id, * EXCLUDE (vec_id) FROM vectors",
    "jittered_queries": """SELECT vec_id AS query_id, object_id, camera_id, primary_class, ts,
 list_transform(range(1, len(embedding) + 1), lambda i: embedding[i] + 0.01::DOUBLE * ((i * vec_id) % 7 - 3)) AS embedding
 FROM vectors""",
    "stage_timings": """SELECT event_id // 5 AS frame_id, event_type AS stage, value AS duration_ms,
 (event_id // 5) % 11 = 0 AS skipped, ts, event_id FROM events""",
    "metric_samples": "SELECT event_type AS name, value, 'ms' AS unit, ts, event_id FROM events",
    "memory_samples": """SELECT event_id, ts, 400.0::DOUBLE + value AS rss_mb, 800.0::DOUBLE + event_id % 300 AS vms_mb,
 ((event_id * 7) % 100)::DOUBLE AS percent, 4000.0::DOUBLE - value AS available_mb FROM events""",
    "masks": """SELECT event_id // 24 AS frame_key, event_id AS mask_id,
 CASE event_id % 3 WHEN 0 THEN 'fastsam' WHEN 1 THEN 'depth' ELSE 'pointcloud' END AS source,
 0.5::DOUBLE + (event_id % 50) / 100 AS confidence, x::INTEGER AS x1, y::INTEGER AS y1,
 (x + 8 + g % 10)::INTEGER AS x2, (y + 8 + (g * 3) % 8)::INTEGER AS y2,
 CASE WHEN event_id % 9 <> 0 THEN (1500 + 500 * (event_id % 5)) / 1000 END AS depth_median, ts,
 user_id::VARCHAR AS object_id FROM (
 SELECT *, event_id // 3 AS g, ((event_id // 3) * 7) % 40 + (event_id % 3) * ((event_id // 3) % 4) AS x,
 ((event_id // 3) * 5) % 30 AS y FROM events)""",
    "mask_pixels": """SELECT frame_key, mask_id, v::INTEGER AS v, u::INTEGER AS u FROM (
 SELECT frame_key, mask_id, x1, x2, unnest(range(y1, y2)) AS v FROM masks), unnest(range(x1, x2)) AS t(u)""",
    "pixels": """SELECT g.frame_key, g.v::INTEGER AS v, g.u::INTEGER AS u,
 ((u * 3 + v * 5 + frame_key) % 256)::INTEGER AS b, ((u * 3 + v * 5 + 2 * frame_key) % 256)::INTEGER AS g,
 ((u * 3 + v * 5 + 3 * frame_key) % 256)::INTEGER AS r,
 (CASE WHEN (u * 7 + v * 13 + frame_key) % 97 = 0 THEN 0 WHEN top IS NULL THEN 4500
 ELSE 1500 + 500 * (top % 5) END)::INTEGER AS depth_raw
 FROM (SELECT frame_key, v, u FROM (SELECT DISTINCT frame_key FROM masks), range(48) AS a(v), range(64) AS b(u)) g
 LEFT JOIN (SELECT frame_key, v, u, min(mask_id) AS top FROM mask_pixels GROUP BY ALL) USING (frame_key, v, u)""",
    "points": """SELECT l_orderkey % 50 AS frame_key, l_orderkey * 1024 + row_number() OVER (PARTITION BY l_orderkey
 ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_tax) AS point_id, l_extendedprice::DOUBLE / 50000 AS x,
 l_quantity::DOUBLE / 25 AS y, 0.2::DOUBLE + (l_tax::DOUBLE + 0.0::DOUBLE) * 50 AS z FROM lineitem""",
}

_NEEDS = {name: [t for t in TABLES if t != name and re.search(rf"\b{t}\b", body)]
          for name, body in TABLES.items()}


def with_tables(sql: str) -> str:
    """Put the definitions of the derived tables a statement names in front of it."""
    order: list[str] = []

    def visit(name: str) -> None:
        for dep in _NEEDS[name]:
            visit(dep)
        if name not in order:
            order.append(name)

    for name in TABLES:
        if re.search(rf"\b{name}\b", sql):
            visit(name)
    ctes = [f"{name} AS ({TABLES[name]})" for name in order]
    body = sql.strip()
    recursive = ""
    if body[:15].upper() == "WITH RECURSIVE ":
        recursive, body = "RECURSIVE ", "WITH " + body[15:]
    if body[:5].upper() == "WITH " and ctes:
        ctes.append("")
        return f"WITH {recursive}" + ",\n".join(ctes) + body[5:]
    return (f"WITH {recursive}" + ",\n".join(ctes) + "\n" if ctes else "") + body


def refined_sql(masks: str, least: int) -> str:
    """Tables ``cleaned`` and ``kept``: what fits the depth of ``masks`` (frame_key, mask_id, v, u) after one closing and
    one opening by squares of five pixels in images of 64 x 48, and that of it which has ``least`` pixels."""
    def step(name, of, only_whole):
        whole = " HAVING count(*) = (least(y + 2, 47) - greatest(y - 2, 0) + 1) * (least(x + 2, 63) - greatest(x - 2, 0) + 1)"
        return f"""{name} AS MATERIALIZED (SELECT frame_key, mask_id, y AS v, x AS u FROM (SELECT frame_key, mask_id, v + dv AS y, u + du AS x
 FROM {of}, range(-2, 3) a(dv), range(-2, 3) b(du)) WHERE y BETWEEN 0 AND 47 AND x BETWEEN 0 AND 63
 GROUP BY ALL{whole if only_whole else ""})"""
    return f"""spread AS (SELECT mask_id, median(depth_raw) / 1000 AS m, stddev_pop(depth_raw) / 1000 AS sd, count(*) AS n
 FROM {masks} JOIN pixels USING (frame_key, v, u) WHERE depth_raw > 0 GROUP BY 1),
fits AS (SELECT frame_key, mask_id, v, u FROM {masks} JOIN pixels USING (frame_key, v, u) JOIN spread s USING (mask_id)
 WHERE s.n >= 10 AND sd >= 0.1 AND depth_raw > 0 AND abs(depth_raw - m * 1000) < 200),
{step("wide", "fits", False)}, {step("closed", "wide", True)}, {step("thin", "closed", True)}, {step("cleaned", "thin", False)},
kept AS MATERIALIZED (SELECT * FROM cleaned WHERE mask_id IN (SELECT mask_id FROM cleaned GROUP BY 1 HAVING count(*) >= {least}))"""
