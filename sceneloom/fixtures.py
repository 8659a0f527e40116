"""Scene-shaped tables derived from the driver's tables, as SQL text that Spark and DuckDB evaluate alike.

``scene(spark, sf_dir, name)`` is such a table as a DataFrame; ``with_sql(names)`` the CTEs for a query text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

BASE = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "conversations")

TABLES: dict[str, tuple[tuple[str, ...], str]] = {
    "detections": (
        ("events",),
        """SELECT frame_idx, det_id, role, CASE role
            WHEN 'O' THEN CASE event_id % 3 WHEN 0 THEN 'kitchen cabinet' WHEN 1 THEN 'fridge' ELSE 'wooden desk' END
            WHEN 'C' THEN CASE event_id % 3 WHEN 0 THEN 'cabinet door' WHEN 1 THEN 'fridge door' ELSE 'desk drawer' END
            ELSE CASE event_id % 3 WHEN 0 THEN 'handle' WHEN 1 THEN 'door handle' ELSE 'drawer knob' END END AS label,
            score, x1, y1, least(640, x1 + CASE role WHEN 'O' THEN 320 WHEN 'C' THEN 180 ELSE 20 + 20 * (event_id % 3) END) AS x2,
            least(480, y1 + CASE role WHEN 'O' THEN 240 WHEN 'C' THEN 140 ELSE 15 + 15 * (event_id % 3) END) AS y2
        FROM (SELECT event_id, cast(floor(event_id / cast(8 AS double)) AS bigint) AS frame_idx, event_id % 8 AS det_id,
            CASE WHEN event_type IN ('view', 'signup') THEN 'O' WHEN event_type = 'click' THEN 'C' ELSE 'U' END AS role,
            value / (value + 20) AS score, (event_id * 37) % 600 AS x1, (event_id * 53) % 440 AS y1 FROM events) e""",
    ),
    "relations_2d": (
        ("detections",),
        """SELECT *, contain >= 0.5 AS pass_threshold, contain >= 0.5 AND count(CASE WHEN contain >= 0.5 THEN 1 END) OVER (PARTITION BY frame_idx, edge_type, child_det_id) = 1 AS selected
        FROM (SELECT p.frame_idx, concat(p.role, '-', c.role) AS edge_type, p.det_id AS parent_det_id, c.det_id AS child_det_id,
            p.role AS parent_role, c.role AS child_role, p.label AS parent_label, c.label AS child_label, c.score AS child_score,
            cast(greatest(0, least(p.x2, c.x2) - greatest(p.x1, c.x1) + 1) * greatest(0, least(p.y2, c.y2) - greatest(p.y1, c.y1) + 1) AS double)
                / cast((c.x2 - c.x1 + 1) * (c.y2 - c.y1 + 1) AS double) AS contain
            FROM detections p JOIN detections c ON p.frame_idx = c.frame_idx
            WHERE concat(p.role, c.role) IN ('OC', 'CU', 'OU')) r""",
    ),
    "edge_candidates": (
        ("lineitem",),
        """SELECT *, concat(parent_role, '-', child_role) AS edge_type, concat(parent_role, lpad(cast(pn AS string), 9, '0')) AS parent_node_id,
            concat(child_role, lpad(cast(cn AS string), 9, '0')) AS child_node_id, concat('f', lpad(cast(frame_idx AS string), 6, '0')) AS frame_key
        FROM (SELECT cast(floor(l_orderkey / cast(500 AS double)) AS bigint) AS frame_idx, ((l_orderkey * 100000 + l_partkey) * 10 + l_linenumber) * 10000 + l_suppkey AS evidence_id,
            CASE l_suppkey % 2 WHEN 0 THEN 'O' ELSE 'C' END AS parent_role,
            CASE WHEN l_suppkey % 2 = 0 AND l_partkey % 40 < 10 THEN 'C' ELSE 'U' END AS child_role,
            l_suppkey % 12 + 1 AS pn, l_partkey % 40 + 1 AS cn,
            CASE WHEN l_quantity < 5 THEN NULL ELSE 0.05 + 9 * l_discount END AS s2d_score,
            l_returnflag = 'A' AS selected, l_linestatus = 'F' AS pass_threshold, l_quantity / 50 AS coverage, l_tax * 12 AS sdet,
            l_linenumber % 3 <> 0 AS from_raw, l_linenumber % 2 = 0 AS from_final,
            CASE l_linenumber % 4 WHEN 0 THEN 'turn the handle' WHEN 1 THEN 'twist handle' WHEN 2 THEN 'Rotate' ELSE '' END AS relation_text,
            CASE l_linenumber % 4 WHEN 0 THEN 'atlas' WHEN 1 THEN 'frame_result' WHEN 2 THEN 'allowed_parent_map' ELSE 'none' END AS semantic_source
            FROM lineitem) l""",
    ),
    "nodes": (
        ("part",),
        """SELECT n, cast(floor(n / cast(120 AS double)) AS bigint) AS scene, role, concat(role, lpad(cast(n AS string), 9, '0')) AS node_id,
            CASE role WHEN 'O' THEN CASE n % 3 WHEN 0 THEN 'kitchen cabinet' WHEN 1 THEN 'fridge' ELSE 'wooden desk' END
            WHEN 'C' THEN CASE n % 3 WHEN 0 THEN 'cabinet door' WHEN 1 THEN 'fridge door' ELSE 'desk drawer' END
            ELSE CASE n % 3 WHEN 0 THEN 'handle' WHEN 1 THEN 'door handle' ELSE 'drawer knob' END END AS label,
            CASE n % 5 WHEN 0 THEN 'rejected' WHEN 1 THEN 'stable' WHEN 2 THEN 'stable' ELSE 'provisional' END AS state,
            (n % 10) * 0.3 + CASE role WHEN 'C' THEN 0.05 WHEN 'U' THEN 0.09 ELSE cast(0 AS double) END AS cx,
            cast(floor(n / cast(10 AS double)) AS double) * 0.25 AS cy, cast(p_size AS double) * 0.01 AS cz,
            (CASE role WHEN 'O' THEN cast(0.3 AS double) WHEN 'C' THEN cast(0.12 AS double) ELSE cast(0.02 AS double) END) * (1 + (n % 4) * cast(0.1 AS double)) AS half,
            cast(p_size AS double) / 50 AS anchor_quality, cast((n * 7) % 100 AS double) / 100 AS quality_ema, n % 11 = 0 AS border,
            n % 4 AS n_support, n % 3 AS n_real, cast((n * 13) % 100 AS double) / 100 AS confidence, n AS feature_id
        FROM (SELECT p_partkey AS n, p_size, role FROM part CROSS JOIN (SELECT 'O' AS role UNION ALL SELECT 'C' UNION ALL SELECT 'U') r ) p""",
    ),
    "boxes3d": (
        ("nodes",),
        """SELECT *, cx - half AS bx1, cy - half AS by1, cz - half AS bz1, cx + half AS bx2, cy + half AS by2, cz + half AS bz2 FROM nodes""",
    ),
    "observations": (
        ("events",),
        """SELECT event_id AS seq, event_id AS frame_idx, concat('U', lpad(cast(user_id % 40 + 1 AS string), 9, '0')) AS node_id,
            value / 500 AS quality, event_type = 'error' AS imputed, event_type AS label, value / (value + 20) AS score,
            (user_id % 40) * cast(0.1 AS double) + ((event_id * 17) % 100) * cast(0.002 AS double) AS cx,
            (user_id % 7) * cast(0.2 AS double) + ((event_id * 29) % 100) * cast(0.001 AS double) AS cy, cast(event_id % 50 AS double) * cast(0.001 AS double) AS cz
        FROM events""",
    ),
    "points": (
        ("lineitem",),
        """SELECT ((l_orderkey * 100000 + l_partkey) * 10 + l_linenumber) * 10000 + l_suppkey AS pid, l_partkey % 100 AS node, l_quantity * cast(0.004 AS double) AS x, l_discount * 2 AS y,
            l_tax * 2 AS z, (l_orderkey * 7) % 180 AS hue, (l_partkey * 11) % 256 AS sat, (l_suppkey * 13) % 256 AS val FROM lineitem""",
    ),
    "depth_samples": (
        ("lineitem",),
        """SELECT ((l_orderkey * 100000 + l_partkey) * 10 + l_linenumber) * 10000 + l_suppkey AS pid, l_partkey % 200 AS grp, cast(0.5 AS double) + l_extendedprice / 50000 AS depth FROM lineitem""",
    ),
    "atlas": (
        (),
        """SELECT * FROM (VALUES ('O-C', 'cabinet', 'door', 'atlas', 'open', 'cabinet', 'carrier'), ('O-C', 'fridge', 'fridge door', 'frame_result', 'pull open', 'fridge', 'carrier'),
            ('O-C', 'desk', 'drawer', 'atlas', 'slide', 'desk', 'carrier'), ('C-U', 'door', 'handle', 'atlas', 'pull the handle', 'cabinet', 'carrier'),
            ('C-U', 'fridge door', 'handle', 'allowed_parent_map', 'pull', 'fridge', 'carrier'), ('C-U', 'drawer', 'knob', 'frame_result', 'pull', 'desk', 'carrier'),
            ('O-U', 'fridge', 'handle', 'atlas', 'pull', 'fridge', 'direct'), ('O-U', 'desk', 'drawer knob', 'atlas', 'turn the knob', 'desk', 'direct'),
            ('O-U', 'cabinet', 'handle', 'allowed_parent_map', 'pull', 'cabinet', 'direct')) AS t(edge_type, parent_label, child_label, source, relation_text, object_context, owner_kind)""",
    ),
    "templates": (
        (),
        """SELECT * FROM (VALUES ('fridge', 'light up', 'kitchen cabinet'), ('wooden desk', 'power', 'fridge'), ('desk', 'control', 'fridge door'), ('door', 'switch', 'knob')) AS t(source_label, relation_text, target_label)""",
    ),
    "scene_votes": (
        ("events",),
        """SELECT user_id % 5 AS sequence, event_id AS frame_idx, CASE event_type WHEN 'click' THEN 'kitchen' WHEN 'view' THEN 'kitchen' WHEN 'purchase' THEN 'office' WHEN 'signup' THEN 'bedroom' ELSE 'unknown' END AS scene,
            cast(0.7 AS double) + cast(0.3 AS double) * value / (value + 20) AS confidence FROM events""",
    ),
    "pose_track": (("events",), """SELECT EPOCH_US(ts) AS t_us, value AS tx, value * 2 AS ty, value / 100 AS rz FROM events WHERE event_id % 10 = 0"""),
    "frame_times": (("events",), """SELECT event_id AS frame_idx, EPOCH_US(ts) AS t_us FROM events WHERE event_id % 10 <> 0"""),
    "alias_steps": (("supplier",), """SELECT s_suppkey AS source, s_suppkey - 1 AS target FROM supplier WHERE s_suppkey % 5 <> 0"""),
    "gt_edges": (
        ("customer", "nation"),
        """SELECT concat('c', cast(c_custkey AS string)) AS child, concat('n', cast(c_nationkey AS string)) AS parent FROM customer
        UNION ALL SELECT concat('n', cast(n_nationkey AS string)), concat('r', cast(n_regionkey AS string)) FROM nation
        UNION ALL SELECT concat('c', cast(c_custkey AS string)), concat('r', cast(n_regionkey AS string)) FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_custkey % 3 <> 0""",
    ),
}


def _order(names: tuple[str, ...]) -> list[str]:
    out: list[str] = []
    for name in names:
        if name in TABLES:
            for x in [*_order(TABLES[name][0]), name]:
                if x not in out:
                    out.append(x)
    return out


def with_sql(*names: str, recursive: bool = False) -> str:
    """DuckDB CTEs of the derived tables, open for more: ends with a comma."""
    ctes = ", ".join(f"{n} AS ({TABLES[n][1]})" for n in _order(names)).replace("AS string)", "AS varchar)")
    return f"WITH {'RECURSIVE ' if recursive else ''}{ctes}, "


DEALT = {"relations_2d": ("detections", "frame_idx")}  # pairs of a table's rows, which meet on a column
TASK_ROWS = 100_000


def scene(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A derived table. Where rows of one are paired, tasks grow in number with them, so that what a task sorts does not grow."""
    if name in BASE:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    order = _order((name,))
    base = sorted({b for n in order for b in TABLES[n][0] if b in BASE})
    tables = {b: spark.read.parquet(f"{sf_dir}/{b}.parquet") for b in base}
    texts = {n: TABLES[n][1] for n in order}
    for of, by in (DEALT[n] for n in order if n in DEALT):
        parts = tables[TABLES[of][0][0]].count() // TASK_ROWS
        if parts:
            parts = max(parts + 1, spark.sparkContext.defaultParallelism)
            texts[of] = f"SELECT /*+ REPARTITION({parts}, {by}) */ * FROM ({texts[of]}) dealt"
    ctes = [f"{b} AS (SELECT * FROM {{{b}}})" for b in base] + [f"{n} AS ({text})" for n, text in texts.items()]
    text = ("WITH " + ", ".join(ctes) + f" SELECT * FROM {name}").replace("EPOCH_US(ts)", "unix_micros(cast(ts AS timestamp))")
    return spark.sql(text, **tables)
