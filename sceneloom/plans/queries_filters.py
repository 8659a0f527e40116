"""Queries: filters, predicates and gates."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..fixtures import scene, with_sql
from ..functions import geometry as G
from ..functions import labels as L
from ..functions import scores as S
from ..operators import filters as P
from ..registry import query

DET = with_sql("detections")
REL = with_sql("relations_2d")
_OWN = """o AS (SELECT p.frame_idx, p.det_id AS carrier_id, c.det_id AS unit_id,
    CASE WHEN p.x1 <= (c.x1 + c.x2) * 0.5::DOUBLE AND (c.x1 + c.x2) * 0.5::DOUBLE <= p.x2 AND p.y1 <= (c.y1 + c.y2) * 0.5::DOUBLE AND (c.y1 + c.y2) * 0.5::DOUBLE <= p.y2 THEN 1 ELSE 0 END
    + CASE WHEN (c.x2 - c.x1) * (c.y2 - c.y1) <= 0 THEN 0 ELSE greatest(0, least(p.x2, c.x2) - greatest(p.x1, c.x1)) * greatest(0, least(p.y2, c.y2) - greatest(p.y1, c.y1)) / ((c.x2 - c.x1) * (c.y2 - c.y1))::DOUBLE END
    + exp(-sqrt(pow(((c.x1 + c.x2) * 0.5::DOUBLE - (p.x1 + p.x2) * 0.5::DOUBLE) / greatest(p.x2 - p.x1, 1), 2) + pow(((c.y1 + c.y2) * 0.5::DOUBLE - (p.y1 + p.y2) * 0.5::DOUBLE) / greatest(p.y2 - p.y1, 1), 2))) AS s
    FROM detections p JOIN detections c ON p.frame_idx = c.frame_idx AND p.role = 'C' AND c.role = 'U')"""


@query(
    "unit_carrier_owner",
    DET + _OWN + """, r AS (SELECT *, round(s, 6) AS score FROM o),
    w AS (SELECT *, row_number() OVER (PARTITION BY frame_idx, unit_id ORDER BY score DESC, carrier_id) AS rn,
        lead(score) OVER (PARTITION BY frame_idx, unit_id ORDER BY score DESC, carrier_id) AS second FROM r)
    SELECT frame_idx, unit_id, carrier_id, score, round(score - second, 6) AS margin FROM w WHERE rn = 1""",
)
def unit_carrier_owner(spark, sf_dir):
    """For each unit detection the carrier of its frame that owns it best, with the margin to the second."""
    d = scene(spark, sf_dir, "detections")
    c = d.where("role = 'C'").select("frame_idx", F.col("det_id").alias("carrier_id"), *[F.col(x).alias(f"p_{x}") for x in ("x1", "y1", "x2", "y2")])
    u = d.where("role = 'U'").select("frame_idx", F.col("det_id").alias("unit_id"), "x1", "y1", "x2", "y2")
    j = c.join(u, "frame_idx").withColumn("score", F.round(G.ownership(G.box("p_"), G.box())["score"], 6))
    w = Window.partitionBy("frame_idx", "unit_id").orderBy(F.desc("score"), "carrier_id")
    return j.withColumns({"rn": F.row_number().over(w), "second": F.lead("score").over(w)}).where("rn = 1").select("frame_idx", "unit_id", "carrier_id", "score", F.round(F.col("score") - F.col("second"), 6).alias("margin"))


@query("valid_depth", with_sql("depth_samples") + "z AS (SELECT * FROM depth_samples WHERE depth BETWEEN 0.6 AND 1.4) SELECT grp, count(*) AS n, round(min(depth), 6) AS low, round(max(depth), 6) AS high FROM z GROUP BY grp")
def valid_depth(spark, sf_dir):
    return P.valid_depth(scene(spark, sf_dir, "depth_samples"), "depth", 0.6, 1.4).groupBy("grp").agg(F.count("*").alias("n"), F.round(F.min("depth"), 6).alias("low"), F.round(F.max("depth"), 6).alias("high"))


@query("role_threshold_filter", DET + "z AS (SELECT 1) SELECT frame_idx, det_id, role FROM detections WHERE score >= CASE role WHEN 'O' THEN 0.5 WHEN 'C' THEN 0.6 ELSE 0.7 END")
def role_threshold_filter(spark, sf_dir):
    return P.role_threshold(scene(spark, sf_dir, "detections"), {"O": 0.5, "C": 0.6, "U": 0.7}).select("frame_idx", "det_id", "role")


@query("border_filter", DET + "z AS (SELECT 1) SELECT frame_idx, det_id, (x1 <= 2)::INT + (y1 <= 2)::INT + (x2 >= 637)::INT + (y2 >= 477)::INT AS sides FROM detections WHERE x1 <= 2 OR y1 <= 2 OR x2 >= 637 OR y2 >= 477")
def border_filter(spark, sf_dir):
    return P.with_border(scene(spark, sf_dir, "detections")).where("border").select("frame_idx", "det_id", "sides")


@query("tiny_two_border", DET + "z AS (SELECT *, (x1 <= 3)::INT + (y1 <= 3)::INT + (x2 >= 636)::INT + (y2 >= 476)::INT AS sides FROM detections) SELECT frame_idx, det_id FROM z WHERE NOT (role IN ('C', 'U') AND sides >= 2 AND (x2 - x1 + 1) * (y2 - y1 + 1) / 307200.0 < 0.04)")
def tiny_two_border(spark, sf_dir):
    return P.tiny_two_border(scene(spark, sf_dir, "detections")).select("frame_idx", "det_id")


ALLOWED = "a AS (SELECT * FROM (VALUES ('handle', 'kitchen cabinet'), ('handle', 'cabinet door'), ('drawer knob', 'desk drawer')) AS t(child_label, parent_label))"


def allowed(spark):
    return spark.createDataFrame([("handle", "kitchen cabinet"), ("handle", "cabinet door"), ("drawer knob", "desk drawer")], "child_label string, parent_label string")


@query(
    "unit_without_parent",
    REL + ALLOWED + """, u AS (SELECT frame_idx, det_id, label FROM detections WHERE role = 'U')
    SELECT frame_idx, det_id, CASE WHEN NOT EXISTS (SELECT 1 FROM a WHERE a.child_label = u.label) THEN 'no_allowed_parent'
        WHEN NOT EXISTS (SELECT 1 FROM a JOIN detections d ON d.label = a.parent_label AND d.role <> 'U' WHERE a.child_label = u.label AND d.frame_idx = u.frame_idx) THEN 'no_parent_detected'
        WHEN NOT EXISTS (SELECT 1 FROM relations_2d r WHERE r.frame_idx = u.frame_idx AND r.child_det_id = u.det_id AND r.pass_threshold) THEN 'no_passing_edge' ELSE '' END AS reason FROM u""",
)
def unit_without_parent(spark, sf_dir):
    return P.units_without_parent(scene(spark, sf_dir, "detections"), scene(spark, sf_dir, "relations_2d"), allowed(spark))


@query(
    "parent_without_unit",
    REL + """a AS (SELECT * FROM (VALUES ('fridge door', 'fridge'), ('desk drawer', 'wooden desk'), ('desk drawer', 'kitchen cabinet')) AS t(child_label, parent_label))
    SELECT frame_idx, det_id, role FROM detections d WHERE role <> 'U' AND NOT (role = 'O' AND label = 'wooden desk')
    AND NOT (role = 'C' AND EXISTS (SELECT 1 FROM a JOIN detections o ON o.role = 'O' AND o.label = a.parent_label WHERE a.child_label = d.label AND o.label = 'wooden desk' AND o.frame_idx = d.frame_idx))
    AND NOT EXISTS (SELECT 1 FROM relations_2d r WHERE r.frame_idx = d.frame_idx AND r.parent_det_id = d.det_id AND r.child_role = 'U' AND r.pass_threshold)""",
)
def parent_without_unit(spark, sf_dir):
    """Objects and carriers without a passing unit; remote candidates stay, and carriers that one of them may own."""
    d = scene(spark, sf_dir, "detections")
    owners = spark.createDataFrame([("fridge door", "fridge"), ("desk drawer", "wooden desk"), ("desk drawer", "kitchen cabinet")], "child_label string, parent_label string")
    return P.parents_without_unit(d, scene(spark, sf_dir, "relations_2d"), P.remote_exempt(d, ["wooden desk"], owners)).select("frame_idx", "det_id", "role")


_BEST = """k AS (SELECT r.*, d.score, (d.x2 - d.x1 + 1) * (d.y2 - d.y1 + 1) AS area, count(*) OVER (PARTITION BY r.frame_idx, r.parent_det_id) AS units FROM relations_2d r JOIN detections d ON d.frame_idx = r.frame_idx AND d.det_id = r.child_det_id WHERE r.child_role = 'U' AND r.pass_threshold),
    best AS (SELECT * FROM k QUALIFY row_number() OVER (PARTITION BY frame_idx, child_det_id ORDER BY CASE parent_role WHEN 'C' THEN 0 ELSE 1 END, contain DESC, parent_det_id) = 1)"""


@query(
    "small_unit_rule",
    REL + _BEST + """, m AS (SELECT frame_idx, parent_det_id, count(*) AS sure, median(area) AS mid FROM k WHERE score > 0.7 GROUP BY ALL)
    SELECT frame_idx, child_det_id AS det_id FROM best JOIN m USING (frame_idx, parent_det_id) WHERE score < 0.7 AND units > 1 AND sure > 1 AND mid > 0 AND area < 0.5 * mid""",
)
def small_unit_rule(spark, sf_dir):
    return P.small_unsure_units(scene(spark, sf_dir, "detections"), scene(spark, sf_dir, "relations_2d"), share=0.5)


@query(
    "border_single_unit",
    REL + _BEST + """, g AS (SELECT best.* FROM best JOIN detections d ON d.frame_idx = best.frame_idx AND d.det_id = best.child_det_id WHERE units = 1 AND (d.x1 <= 2 OR d.y1 <= 2 OR d.x2 >= 637 OR d.y2 >= 477))
    SELECT frame_idx, child_det_id AS det_id FROM g UNION SELECT frame_idx, parent_det_id FROM g
    UNION SELECT g.frame_idx, r.parent_det_id FROM g JOIN relations_2d r ON r.frame_idx = g.frame_idx AND r.edge_type = 'O-C' AND r.pass_threshold AND r.child_det_id = g.parent_det_id WHERE g.parent_role = 'C'""",
)
def border_single_unit(spark, sf_dir):
    return P.border_single_units(scene(spark, sf_dir, "detections"), scene(spark, sf_dir, "relations_2d"))


@query(
    "border_no_link",
    REL + """z AS (SELECT 1) SELECT frame_idx, det_id FROM detections d WHERE NOT (x1 <= 2 OR y1 <= 2 OR x2 >= 637 OR y2 >= 477)
    OR EXISTS (SELECT 1 FROM relations_2d r WHERE r.frame_idx = d.frame_idx AND (r.selected OR r.pass_threshold) AND d.det_id IN (r.parent_det_id, r.child_det_id))""",
)
def border_no_link(spark, sf_dir):
    return P.linked_or_inside(scene(spark, sf_dir, "detections"), scene(spark, sf_dir, "relations_2d")).select("frame_idx", "det_id")


@query(
    "orphan_unit_filter",
    REL + """z AS (SELECT 1) SELECT frame_idx, det_id, role FROM detections d WHERE role <> 'U' OR EXISTS (SELECT 1 FROM relations_2d r WHERE r.frame_idx = d.frame_idx AND r.child_det_id = d.det_id AND r.child_role = 'U' AND (r.contain > 0.2 OR r.pass_threshold))""",
)
def orphan_unit_filter(spark, sf_dir):
    r = scene(spark, sf_dir, "relations_2d")
    return P.units_with_parent(scene(spark, sf_dir, "detections"), r, r.where("contain > 0.2")).select("frame_idx", "det_id", "role")


@query("blocked_objects", DET + "z AS (SELECT 1) SELECT role, label, count(*) AS n FROM detections WHERE label NOT IN ('fridge', 'drawer knob') GROUP BY role, label")
def blocked_objects(spark, sf_dir):
    return P.without_labels(scene(spark, sf_dir, "detections"), ["fridge", "drawer knob"]).groupBy("role", "label").agg(F.count("*").alias("n"))


@query(
    "edge_prefilter_reasons",
    with_sql("edge_candidates") + """z AS (SELECT edge_type, CASE WHEN parent_node_id = child_node_id THEN 'self_loop' WHEN edge_type NOT IN ('O-C', 'C-U', 'O-U') THEN 'illegal_role_pair'
        WHEN semantic_source <> 'none' AND l THEN 'child_center_outside_parent_box' WHEN sdet <= 0.25 THEN 'sdet_below_threshold' WHEN coverage <= 0.9 THEN 'gcamc_below_threshold' ELSE '' END AS reason
        FROM (SELECT *, NOT selected AS l FROM edge_candidates))
    SELECT edge_type, reason, count(*) AS n FROM z GROUP BY edge_type, reason""",
)
def edge_prefilter_reasons(spark, sf_dir):
    e = scene(spark, sf_dir, "edge_candidates")
    return e.withColumn("reason", P.prefilter_reason(F.col("semantic_source") != "none", F.col("selected"))).groupBy("edge_type", "reason").agg(F.count("*").alias("n"))


def _history(o):
    """Recent centroids and support of each node."""
    w = Window.partitionBy("node_id").orderBy(F.desc("seq"))
    last = o.withColumn("rn", F.row_number().over(w)).where("rn <= 12")
    mid = last.groupBy("node_id").agg(*[F.median(c).alias(f"m_{c}") for c in ("cx", "cy", "cz")])
    spread = last.join(mid, "node_id").groupBy("node_id").agg(F.round(F.max(G.norm(*[F.col(c) - F.col(f"m_{c}") for c in ("cx", "cy", "cz")])), 6).alias("spread"))
    return spread


_SPREAD = """h AS (SELECT *, row_number() OVER (PARTITION BY node_id ORDER BY seq DESC) AS rn FROM observations),
    m AS (SELECT node_id, median(cx) AS mx, median(cy) AS my, median(cz) AS mz FROM h WHERE rn <= 12 GROUP BY node_id),
    s AS (SELECT node_id, round(max(sqrt(pow(cx - mx, 2) + pow(cy - my, 2) + pow(cz - mz, 2))), 6) AS spread FROM h JOIN m USING (node_id) WHERE rn <= 12 GROUP BY node_id)"""


@query("centroid_spread", with_sql("observations") + _SPREAD + " SELECT * FROM s")
def centroid_spread(spark, sf_dir):
    return _history(scene(spark, sf_dir, "observations"))


@query(
    "node_eligibility",
    with_sql("nodes", "observations") + _SPREAD + """, e AS (SELECT n.*, coalesce(spread, 0) AS spread, CASE WHEN state IN ('rejected', 'stable') THEN state WHEN n_support < 2 THEN 'insufficient_total_support_frames' WHEN n_real < 1 THEN 'insufficient_real_depth_frames'
        WHEN anchor_quality < 0.55 THEN 'anchor_quality_below_threshold' WHEN quality_ema < 0.5 THEN 'geometry_quality_below_threshold' WHEN border THEN 'extreme_boundary_anchor' WHEN coalesce(spread, 0) > 0.12 THEN 'centroid_spread_above_threshold' ELSE 'confirmed_provisional' END AS reason
        FROM nodes n LEFT JOIN s USING (node_id))
    SELECT node_id, reason, reason IN ('stable', 'confirmed_provisional') AS eligible, round(CASE reason WHEN 'stable' THEN 1 WHEN 'confirmed_provisional' THEN (anchor_quality + quality_ema + least(1, n_support / 2.0)) / 3 ELSE 0 END, 6)::DOUBLE AS graph_confidence FROM e""",
)
def node_eligibility(spark, sf_dir):
    n = scene(spark, sf_dir, "nodes").join(_history(scene(spark, sf_dir, "observations")), "node_id", "left").withColumn("spread", F.coalesce("spread", F.lit(0.0)))
    return P.eligibility(n).select("node_id", "reason", "eligible", F.round("graph_confidence", 6).alias("graph_confidence"))


@query(
    "fusion_and_promotion_gates",
    with_sql("nodes", "observations") + """z AS (SELECT o.seq, n.node_id, CASE WHEN o.quality >= 0.62 THEN 'reliable' WHEN o.quality >= 0.38 THEN 'provisional' WHEN o.quality >= 0.2 THEN 'low_quality' ELSE 'rejected' END AS st, o.imputed, o.quality, n.state,
        round(sqrt(pow(o.cx - n.cx, 2) + pow(o.cy - n.cy, 2) + pow(o.cz - n.cz, 2)), 6) AS residual, 1 + o.quality * 3 AS expansion, n.n_support, n.n_real, n.quality_ema FROM observations o JOIN nodes n ON o.node_id = n.node_id),
    r AS (SELECT CASE WHEN st NOT IN ('reliable', 'provisional') THEN 'obs_' || st WHEN imputed AND state = 'stable' THEN 'imputed_geometry_not_fused_into_stable' WHEN quality < 0.35 THEN 'quality_gate' WHEN residual > 0.12 THEN 'centroid_residual_gate' WHEN n_support >= 2 AND expansion > 2.5 THEN 'bbox_expansion_gate' ELSE 'accepted' END AS fusion,
        CASE WHEN state = 'rejected' THEN 'rejected' WHEN n_support < 2 THEN 'insufficient_support_frames' WHEN n_real < 2 THEN 'insufficient_real_depth_support' WHEN quality_ema < 0.55 THEN 'low_quality_ema' WHEN residual > 0.08 THEN 'centroid_unstable' ELSE 'stable' END AS promotion FROM z)
    SELECT fusion, promotion, count(*) AS n FROM r GROUP BY fusion, promotion""",
)
def fusion_and_promotion_gates(spark, sf_dir):
    o, n = scene(spark, sf_dir, "observations"), scene(spark, sf_dir, "nodes").select("node_id", "state", "n_support", "n_real", "quality_ema", *[F.col(c).alias(f"n_{c}") for c in ("cx", "cy", "cz")])
    j = o.join(n, "node_id").withColumn("residual", F.round(G.norm(*[F.col(c) - F.col(f"n_{c}") for c in ("cx", "cy", "cz")]), 6))
    stable = F.col("state") == "stable"
    fusion = P.fusion_reason(S.status(F.col("quality")), F.col("imputed"), F.col("quality"), F.col("residual"), stable, 1 + F.col("quality") * 3, F.col("n_support"))
    promotion = P.promotion_reason(F.col("state"), F.col("n_support"), F.col("n_real"), F.col("quality_ema"), F.col("residual"))
    return j.select(fusion.alias("fusion"), promotion.alias("promotion")).groupBy("fusion", "promotion").agg(F.count("*").alias("n"))


@query(
    "observation_quality",
    with_sql("points") + """q AS (SELECT pid, round(greatest(0, least(1, 0.2 * least(1, x * 5) + 0.15 * least(1, y * 10) + 0.2 * least(1, sat / greatest(1, 40 * 3.0)) + 0.2 * exp(-greatest(z, x * 0.5) / 0.05) + 0.15 * least(1, val / 255.0)
        + 0.1 * coalesce(exp(-abs(CASE WHEN hue > 90 THEN y END) / 0.04), 1) - CASE WHEN hue < 20 THEN 0.15 ELSE 0 END - CASE WHEN hue % 7 = 0 THEN 0.05 ELSE 0 END - CASE WHEN x < 1e-5 THEN 0.1 ELSE 0 END)), 6) AS quality FROM points)
    SELECT pid, quality, CASE WHEN quality >= 0.62 THEN 'reliable' WHEN quality >= 0.38 THEN 'provisional' WHEN quality >= 0.2 THEN 'low_quality' ELSE 'rejected' END AS status FROM q""",
)
def observation_quality(spark, sf_dir):
    p = scene(spark, sf_dir, "points")
    c = F.col
    q = F.round(S.quality(c("x") * 5, c("y") * 10, c("sat"), F.lit(40.0), c("z"), c("x"), c("val") / 255.0, F.when(c("hue") > 90, c("y")), c("hue") < 20, c("hue") % 7 == 0, c("x")), 6)
    return p.select("pid", q.alias("quality")).withColumn("status", S.status(c("quality")))


@query("incident_nodes", with_sql("nodes", "edge_candidates") + "t AS (SELECT * FROM edge_candidates WHERE trim(relation_text) <> '') SELECT node_id, role FROM nodes WHERE node_id IN (SELECT parent_node_id FROM t UNION SELECT child_node_id FROM t)")
def incident_nodes(spark, sf_dir):
    return P.incident(scene(spark, sf_dir, "nodes"), scene(spark, sf_dir, "edge_candidates")).select("node_id", "role")


@query("pending_predicates", with_sql("edge_candidates") + "z AS (SELECT edge_type, CASE WHEN trim(relation_text) = '' THEN 'pending' ELSE 'functional' END AS functional_status FROM edge_candidates) SELECT edge_type, functional_status, count(*) AS n FROM z GROUP BY 1, 2")
def pending_predicates(spark, sf_dir):
    status = F.when(F.trim("relation_text") == "", "pending").otherwise("functional")
    return scene(spark, sf_dir, "edge_candidates").groupBy("edge_type", status.alias("functional_status")).agg(F.count("*").alias("n"))


@query(
    "capped_candidates",
    with_sql("edge_candidates") + """r AS (SELECT *, row_number() OVER (PARTITION BY frame_idx ORDER BY sdet DESC, evidence_id) AS rn FROM edge_candidates WHERE selected)
    SELECT frame_idx, evidence_id, rn FROM r WHERE rn <= 3""",
)
def capped_candidates(spark, sf_dir):
    e = scene(spark, sf_dir, "edge_candidates").where("selected")
    w = Window.partitionBy("frame_idx").orderBy(F.desc("sdet"), "evidence_id")
    return P.capped(e, ["frame_idx"], [F.desc("sdet"), "evidence_id"], 3).select("frame_idx", "evidence_id", F.row_number().over(w).cast("long").alias("rn"))


@query(
    "endpoint_drop_reasons",
    with_sql("edge_candidates", "nodes") + """z AS (SELECT CASE WHEN e.coverage < 0.1 THEN 'parent_not_lifted' WHEN e.sdet < 0.1 THEN 'child_not_lifted' WHEN p.node_id IS NULL THEN 'parent_not_associated' WHEN c.node_id IS NULL THEN 'child_not_associated' WHEN p.node_id = c.node_id THEN 'self_loop' ELSE '' END AS reason
        FROM edge_candidates e LEFT JOIN nodes p ON p.node_id = e.parent_node_id AND p.state <> 'rejected' LEFT JOIN nodes c ON c.node_id = e.child_node_id AND c.state <> 'rejected')
    SELECT reason, count(*) AS n FROM z GROUP BY reason""",
)
def endpoint_drop_reasons(spark, sf_dir):
    e, n = scene(spark, sf_dir, "edge_candidates"), scene(spark, sf_dir, "nodes").where("state <> 'rejected'")
    j = e.join(n.select(F.col("node_id").alias("p")), e["parent_node_id"] == F.col("p"), "left").join(n.select(F.col("node_id").alias("c")), e["child_node_id"] == F.col("c"), "left")
    return j.groupBy(P.endpoint_reason(F.col("coverage") >= 0.1, F.col("sdet") >= 0.1, F.col("p"), F.col("c")).alias("reason")).agg(F.count("*").alias("n"))


@query(
    "policy_labels",
    DET + """a AS (SELECT * FROM (VALUES ('icebox', 'fridge', 'suppress'), ('table', 'wooden desk', 'hint_only'), ('grip', 'door handle', 'aggregate')) AS t(alias, label, action))
    SELECT coalesce(action, 'keep') AS action, role, count(*) AS n FROM detections d LEFT JOIN a ON a.label = d.label OR a.alias = d.label GROUP BY 1, 2""",
)
def policy_labels(spark, sf_dir):
    """Policy by alias-aware labels: one row a known name, joined by equality."""
    rows = [("icebox", "fridge", "suppress"), ("table", "wooden desk", "hint_only"), ("grip", "door handle", "aggregate")]
    names = spark.createDataFrame([(n, r[2]) for r in rows for n in r[:2]], "name string, action string")
    return scene(spark, sf_dir, "detections").join(F.broadcast(names), L.plain_label(F.col("label")) == F.col("name"), "left").groupBy(F.coalesce("action", F.lit("keep")).alias("action"), "role").agg(F.count("*").alias("n"))


@query(
    "frame_label_view",
    DET + "z AS (SELECT 1) SELECT frame_idx, to_json(list_sort(list_distinct(list(label) FILTER (label NOT IN ('fridge', 'handle')))))::VARCHAR AS labels FROM detections GROUP BY frame_idx HAVING count(*) FILTER (label NOT IN ('fridge', 'handle')) > 0",
)
def frame_label_view(spark, sf_dir):
    """The labels of a frame without suppressed and hint-only ones."""
    held = F.array(F.lit("fridge"), F.lit("handle"))
    d = scene(spark, sf_dir, "detections").groupBy("frame_idx").agg(F.collect_set("label").alias("l"))
    kept = F.array_sort(F.filter("l", lambda x: ~F.array_contains(held, x)))
    return d.select("frame_idx", kept.alias("l")).where(F.size("l") > 0).select("frame_idx", F.to_json("l").alias("labels"))


@query(
    "sanitized_atlas",
    with_sql("nodes") + """z AS (SELECT role, label, n, row_number() OVER (PARTITION BY role, label ORDER BY n) AS rn FROM nodes WHERE label NOT IN ('fridge'))
    SELECT role, label, n FROM z WHERE rn <= CASE role WHEN 'O' THEN 12 ELSE 2 END""",
)
def sanitized_atlas(spark, sf_dir):
    """Generic and banned labels go; at most 12 objects, 2 carriers and 2 units a label stay."""
    n = scene(spark, sf_dir, "nodes").where(~F.col("label").isin("fridge") & ~L.generic(F.col("label")))
    w = Window.partitionBy("role", "label").orderBy("n")
    return n.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= F.when(F.col("role") == "O", 12).otherwise(2)).select("role", "label", "n")


_WORDS = "SELECT * FROM (VALUES ('kitchen'), ('home'), ('electric'), ('misc'), ('wooden'), ('generics'), ('')) AS m(modifier) CROSS JOIN (VALUES ('utensils'), ('utensil holder'), ('appliances'), ('device'), ('stuff'), ('boxes'), ('box'), ('furniture'), ('things'), ('item'), ('knife'), ('tableware'), ('countertop')) AS n(noun)"


_NOUNS = "['appliance', 'device', 'equipment', 'utensil', 'tool', 'object', 'thing', 'item', 'stuff', 'kitchenware', 'tableware', 'furniture']"


@query(
    "generic_labels",
    "WITH w AS (" + _WORDS + """), l AS (SELECT DISTINCT trim(modifier || ' ' || noun) AS label FROM w UNION SELECT DISTINCT lower(trim(p_name)) FROM part),
    t AS (SELECT label, string_split(label, ' ') AS t FROM l),
    x AS (SELECT label, t, list_transform(t, lambda v: CASE WHEN v LIKE '%es' AND length(v) > 4 THEN CASE WHEN list_contains({nouns}, v[:-3]) THEN v[:-3] WHEN list_contains({nouns}, v[:-2]) THEN v[:-2] ELSE v[:-3] END WHEN v LIKE '%s' AND length(v) > 3 THEN v[:-2] ELSE v END) AS s FROM t),
    y AS (SELECT label, len(t) AS n, s[-1] AS last, len(list_filter(s[:-2], lambda v: NOT list_contains(['kitchen', 'home', 'household', 'electric', 'electrical', 'generic', 'misc'], v))) AS odd FROM x)
    SELECT label, label IN ('appliance', 'box', 'cardboard box', 'container', 'counter top', 'countertop', 'equipment', 'device', 'furniture', 'utensil', 'tool', 'object', 'thing', 'home appliance', 'kitchenware', 'tableware')
        OR (n <= 3 AND list_contains({nouns}, last) AND odd = 0) OR (n = 2 AND last IN ('object', 'thing', 'item')) AS generic FROM y""".replace("{nouns}", _NOUNS),
)
def generic_labels(spark, sf_dir):
    """Which labels name no concrete object, over phrases and all part names."""
    l = spark.sql(_WORDS).select(F.trim(F.concat_ws(" ", "modifier", "noun")).alias("label")).union(scene(spark, sf_dir, "part").select(F.lower(F.trim("p_name")))).distinct()
    return l.select("label", L.generic(F.col("label")).alias("generic"))
