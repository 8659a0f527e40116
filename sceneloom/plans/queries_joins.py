"""Queries: joins."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..fixtures import scene, with_sql
from ..functions import geometry as G
from ..functions import labels as L
from ..functions import scores as S
from ..functions import vectors as V
from ..operators import fixpoint as X
from ..operators import joins as J
from ..operators import windows as W
from ..registry import query

XYZ = ["cx", "cy", "cz"]
_NORM = "trim(regexp_replace(regexp_replace(replace(replace(lower(trim({0})), '_', ' '), '-', ' '), '[^a-z0-9 ]+', ' ', 'g'), ' +', ' ', 'g'))"
_SUFFIX = "({0} = {1} OR {0} LIKE '% ' || {1})"


@query("frames_matched", with_sql("detections", "scene_votes") + "f AS (SELECT DISTINCT frame_idx FROM detections), v AS (SELECT DISTINCT frame_idx FROM scene_votes WHERE scene <> 'unknown') SELECT (SELECT count(*) FROM f WHERE frame_idx IN (SELECT frame_idx FROM v)) AS matched, (SELECT count(*) FROM f WHERE frame_idx NOT IN (SELECT frame_idx FROM v)) AS skipped")
def frames_matched(spark, sf_dir):
    f = scene(spark, sf_dir, "detections").select("frame_idx").distinct()
    v = scene(spark, sf_dir, "scene_votes").where("scene <> 'unknown'").select("frame_idx", F.lit(1).alias("hit")).distinct()
    return f.join(v, "frame_idx", "left").agg(F.count("hit").alias("matched"), F.count_if(F.col("hit").isNull()).alias("skipped"))


@query(
    "score_lookup",
    with_sql("edge_candidates") + """k AS (SELECT * FROM edge_candidates WHERE s2d_score IS NOT NULL AND evidence_id % 6 = 3),
    e AS (SELECT *, row_number() OVER (PARTITION BY frame_key, edge_type, parent_node_id, child_node_id ORDER BY evidence_id) AS rn FROM k),
    j AS (SELECT c.evidence_id, coalesce(k.s2d_score, e.s2d_score) AS s FROM edge_candidates c LEFT JOIN k ON k.evidence_id = c.evidence_id LEFT JOIN e ON e.rn = 1 AND e.frame_key = c.frame_key AND e.edge_type = c.edge_type AND e.parent_node_id = c.parent_node_id AND e.child_node_id = c.child_node_id)
    SELECT evidence_id, round(s, 6) AS score FROM j WHERE s IS NOT NULL""",
)
def score_lookup(spark, sf_dir):
    """Scores by content key, else by (frame, type, parent, child)."""
    c = scene(spark, sf_dir, "edge_candidates")
    known = c.where("s2d_score is not null and evidence_id % 6 = 3").select("evidence_id", "frame_key", "edge_type", "parent_node_id", "child_node_id", F.col("s2d_score").alias("score"))
    return J.looked_up(c, known, "evidence_id", ["frame_key", "edge_type", "parent_node_id", "child_node_id"], "score").where("score is not null").select("evidence_id", F.round("score", 6).alias("score"))


@query(
    "pair_gate_scores",
    with_sql("observations", "nodes") + """o AS (SELECT * FROM observations),
    j AS (SELECT o.seq, n.node_id, sqrt(pow(o.cx - n.cx, 2) + pow(o.cy - n.cy, 2) + pow(o.cz - n.cz, 2)) AS d, least(0.15, greatest(0.03, 0.5 * greatest(2 * n.half, 0.05))) AS tau, o.quality, n.quality_ema FROM o JOIN nodes n ON n.role = 'U')
    SELECT seq, node_id, round(d, 6) AS distance, round(exp(-d * d / (2 * 0.08 * 0.08)), 6) AS geometry, round(0.5 * quality + (exp(-d * d / (2 * 0.08 * 0.08)) + quality_ema + quality) / 6, 6) AS total,
        CASE WHEN NOT d < tau THEN 'distance_gate' WHEN NOT quality > 0.05 THEN 'iou_gate' WHEN 0.5 * quality + (exp(-d * d / (2 * 0.08 * 0.08)) + quality_ema + quality) / 6 < 0.45 THEN 'score_gate' ELSE '' END AS reason
    FROM j WHERE d <= 0.15""",
)
def pair_gate_scores(spark, sf_dir):
    """Observation and node pairs of one role within reach, by 0.15 m cells, with their four-clue score and first failing gate."""
    o = scene(spark, sf_dir, "observations").select("seq", "quality", *[F.col(c).alias(f"o_{c}") for c in XYZ])
    n = scene(spark, sf_dir, "nodes").where("role = 'U'").select("node_id", "quality_ema", "half", *XYZ)
    p = J.within(o, n, ["o_cx", "o_cy", "o_cz"], XYZ, 0.15)
    g = S.gaussian(F.col("distance"))
    total = S.pair_total(F.col("quality"), g, F.col("quality_ema"), F.col("quality"))
    reason = S.first_of((~(F.col("distance") < S.pair_tau(2 * F.col("half"), F.lit(0.05))), "distance_gate"), (~(F.col("quality") > 0.05), "iou_gate"), (total < 0.45, "score_gate"))
    return p.select("seq", "node_id", F.round("distance", 6).alias("distance"), F.round(g, 6).alias("geometry"), F.round(total, 6).alias("total"), reason.alias("reason"))


@query(
    "projected_overlap",
    with_sql("points", "depth_samples", "detections") + """c AS (SELECT p.node, x + 0.1 AS x, y + 0.1 AS y, z + 0.3 AS z, d.depth FROM points p JOIN depth_samples d USING (pid)),
    u AS (SELECT node, z, depth, x * 900 / z + 20 AS u, y * 1200 / z + 30 AS v FROM c WHERE z > 1e-6), w AS (SELECT *, z <= depth + 0.08 AND depth > 0 AS seen FROM u WHERE u BETWEEN -640 AND 1279 AND v BETWEEN -480 AND 959),
    n AS (SELECT node, count(*) AS n, count(*) FILTER (seen) AS k FROM w GROUP BY node),
    b AS (SELECT node, quantile_cont(least(639, greatest(0, u)), 0.02) AS x1, quantile_cont(least(479, greatest(0, v)), 0.02) AS y1, quantile_cont(least(639, greatest(0, u)), 0.98) AS x2, quantile_cont(least(479, greatest(0, v)), 0.98) AS y2 FROM w JOIN n USING (node) WHERE n >= 3 AND (seen OR k < 3) GROUP BY node),
    j AS (SELECT d.frame_idx, d.det_id, b.node, greatest(0, least(d.x2, b.x2) - greatest(d.x1, b.x1)) * greatest(0, least(d.y2, b.y2) - greatest(d.y1, b.y1)) AS i, (d.x2 - d.x1) * (d.y2 - d.y1) + (b.x2 - b.x1) * (b.y2 - b.y1) AS s FROM detections d JOIN b ON b.node = d.frame_idx % 100 WHERE d.role = 'O')
    SELECT frame_idx, det_id, node, round(i / (s - i), 6) AS iou FROM j WHERE i > 0""",
)
def projected_overlap(spark, sf_dir):
    """Each node's points projected with the test of depth, their 2-98 percentile box within the image, and its overlap with
    the detections of the frame that sees it."""
    p = scene(spark, sf_dir, "points").join(scene(spark, sf_dir, "depth_samples").select("pid", "depth"), "pid")
    b = J.projected_boxes(p.select("node", (F.col("x") + 0.1).alias("x"), (F.col("y") + 0.1).alias("y"), (F.col("z") + 0.3).alias("z"), "depth"), "node", (900.0, 1200.0, 20.0, 30.0), 640, 480)
    d = scene(spark, sf_dir, "detections").where("role = 'O'").withColumn("node", F.col("frame_idx") % 100)
    return d.join(b, "node").withColumn("iou", G.iou2d(G.box(), G.box("p_"))).where("iou > 0").select("frame_idx", "det_id", "node", F.round("iou", 6).alias("iou"))


@query(
    "identity_pairs",
    with_sql("observations", "nodes") + """j AS (SELECT o.seq, n.node_id, n.state, sqrt(pow(o.cx - n.cx, 2) + pow(o.cy - n.cy, 2) + pow(o.cz - n.cz, 2)) AS d, greatest(0.03, least(0.25, 0.5 * 2 * n.half)) AS tau, o.quality AS sim, n.quality_ema AS sem FROM observations o JOIN nodes n ON n.role = 'U'),
    k AS (SELECT *, 0.5 * sim + (exp(-d * d / (2 * 0.08 * 0.08)) + sem + sim) / 6 AS total FROM j WHERE d <= 0.25)
    SELECT seq, node_id, round(d, 6) AS distance, CASE WHEN state <> 'stable' THEN 'node_not_identity_eligible' WHEN NOT sim > 0.05 THEN 'iou_gate' WHEN total < 0.45 THEN 'score_gate' WHEN sem < 0.5 THEN 'semantic_gate' WHEN NOT d < tau THEN 'identity_distance_gate' ELSE '' END AS reason FROM k""",
)
def identity_pairs(spark, sf_dir):
    """Pairs that may share an identity without fusing geometry: the four-clue score under gates of its own."""
    o = scene(spark, sf_dir, "observations").select("seq", "quality", *[F.col(c).alias(f"o_{c}") for c in XYZ])
    n = scene(spark, sf_dir, "nodes").where("role = 'U'").select("node_id", "state", "quality_ema", "half", *XYZ)
    p = J.within(o, n, ["o_cx", "o_cy", "o_cz"], XYZ, 0.25)
    total = S.pair_total(F.col("quality"), S.gaussian(F.col("distance")), F.col("quality_ema"), F.col("quality"))
    return p.select("seq", "node_id", F.round("distance", 6).alias("distance"), S.identity_reason(F.col("state"), F.col("quality"), total, F.col("quality_ema"), F.col("distance"), 2 * F.col("half"), "U").alias("reason"))


@query(
    "parent_conflict",
    with_sql("edge_candidates", "nodes") + """s AS (SELECT e.frame_idx, e.frame_key, e.child_node_id, e.child_role, e.parent_role, e.parent_node_id FROM edge_candidates e JOIN nodes p ON p.node_id = e.parent_node_id WHERE p.state = 'stable' AND e.selected),
    v AS (SELECT child_node_id, parent_role, parent_node_id, count(DISTINCT frame_key) AS frames FROM s GROUP BY ALL),
    r AS (SELECT *, row_number() OVER w AS rn, coalesce(lead(frames) OVER w, 0) AS second FROM v WINDOW w AS (PARTITION BY child_node_id, parent_role ORDER BY frames DESC, parent_node_id DESC)),
    own AS (SELECT child_node_id, parent_role, parent_node_id AS own FROM r WHERE rn = 1 AND frames >= 2 AND frames - second >= 1),
    c AS (SELECT s.frame_idx, s.child_node_id, s.parent_role, count(*) AS parents, bool_and(s.parent_node_id <> own.own) AS against FROM s JOIN own USING (child_node_id, parent_role) WHERE s.child_role = 'U' OR s.parent_role = 'O' GROUP BY ALL)
    SELECT frame_idx, child_node_id, sum(parents)::BIGINT AS parents FROM c WHERE against GROUP BY ALL""",
)
def parent_conflict(spark, sf_dir):
    """Children whose stable object or carrier contradicts every stable object, or carrier, of a frame; a carrier has an
    object only."""
    from ..operators.aggregates import stable_parent

    e, n = scene(spark, sf_dir, "edge_candidates").where("selected"), scene(spark, sf_dir, "nodes").where("state = 'stable'")
    s = e.join(n.select(F.col("node_id").alias("parent_node_id")), "parent_node_id", "left_semi")
    own = stable_parent(s, ["child_node_id", "parent_role"]).select("child_node_id", "parent_role", F.col("parent_node_id").alias("own"))
    return J.contradicted(s, own)


_POSE = with_sql("pose_track", "frame_times") + """b AS (SELECT f.frame_idx, f.t_us, p.t_us AS bt, p.tx AS btx, p.rz AS brz FROM frame_times f ASOF LEFT JOIN pose_track p ON f.t_us >= p.t_us),
    a AS (SELECT b.*, p.t_us AS nt, p.tx AS atx, p.rz AS arz FROM b ASOF LEFT JOIN pose_track p ON b.t_us <= p.t_us)"""


@query("pose_asof", _POSE + " SELECT frame_idx, CASE WHEN t_us - bt <= nt - t_us THEN bt ELSE nt END AS pose_us FROM a WHERE bt IS NOT NULL AND nt IS NOT NULL AND least(t_us - bt, nt - t_us) <= 15e8")
def pose_asof(spark, sf_dir):
    """The nearest pose of each frame within the track's range and the tolerance, the earlier of two as near."""
    f = J.as_of(scene(spark, sf_dir, "frame_times"), scene(spark, sf_dir, "pose_track"), "t_us", ["tx"])
    return J.nearest(f, "t_us", 15e8).select("frame_idx", F.col("nearest_t_us").alias("pose_us"))


@query(
    "pose_interpolated",
    _POSE + """, s AS (SELECT *, CASE WHEN nt > bt THEN (t_us - bt) / (nt - bt)::DOUBLE ELSE 0 END AS k FROM a WHERE bt IS NOT NULL AND nt IS NOT NULL AND (t_us IN (nt, bt) OR (t_us - bt <= 4e9 AND nt - t_us <= 4e9)))
    SELECT frame_idx, round(CASE WHEN t_us = nt THEN atx ELSE btx + (atx - btx) * k END, 6) AS tx, round(cos(CASE WHEN t_us = nt THEN arz ELSE brz + (arz - brz) * k END), 6) AS r00, round(-sin(CASE WHEN t_us = nt THEN arz ELSE brz + (arz - brz) * k END), 6) AS r01 FROM s""",
)
def pose_interpolated(spark, sf_dir):
    """Poses between their two neighbours in time, the rotation along its vector."""
    f = J.as_of(scene(spark, sf_dir, "frame_times"), scene(spark, sf_dir, "pose_track"), "t_us", ["tx", "rz"])
    p = J.interpolated(f, "t_us", ["tx", "rz"], 4e9)
    r = G.axis_angle([F.lit(0.0), F.lit(0.0), F.col("rz")])
    return p.select("frame_idx", F.round("tx", 6).alias("tx"), F.round(r[0], 6).alias("r00"), F.round(r[1], 6).alias("r01"))


@query(
    "consolidation_candidates",
    with_sql("nodes") + """c AS (SELECT DISTINCT least(a.node_id, b.node_id) AS a, greatest(a.node_id, b.node_id) AS b FROM nodes a JOIN nodes b ON a.scene = b.scene AND a.n % 7 = b.n % 7 AND a.node_id < b.node_id)
    SELECT a.node_id AS a, b.node_id AS b FROM nodes a JOIN nodes b ON a.scene = b.scene AND a.role = b.role AND a.label = b.label AND a.node_id < b.node_id WHERE (a.node_id, b.node_id) NOT IN (SELECT (a, b) FROM c)""",
)
def consolidation_candidates(spark, sf_dir):
    """Pairs of one scene, role and label that were never seen in one frame."""
    n = scene(spark, sf_dir, "nodes").withColumn("key", L.track_label(F.col("label")))
    seen = J.co_observed(n.select((F.col("scene") * 7 + F.col("n") % 7).alias("frame"), "node_id"), "frame", "node_id")
    left, right = n.select("scene", "role", "key", F.col("node_id").alias("a")), n.select("scene", "role", "key", F.col("node_id").alias("b"))
    return left.join(right, ["scene", "role", "key"]).where("a < b").join(seen, ["a", "b"], "left_anti").select("a", "b")


SAMPLE = 1024  # points of a node that distances are measured on
_SAMPLE = f"r AS (SELECT node, pid, x, y, z, row_number() OVER (PARTITION BY node ORDER BY pid) - 1 AS i, count(*) OVER (PARTITION BY node) AS n FROM points), s AS (SELECT * FROM r WHERE n <= {SAMPLE} OR list_contains(list_transform(range({SAMPLE}), lambda j: floor(j * ((n - 1) / {SAMPLE - 1}.0::DOUBLE) + 1e-9)::BIGINT), i))"


@query(
    "point_overlap_fraction",
    with_sql("points") + _SAMPLE + """, h AS (SELECT DISTINCT a.node AS a, b.node AS b, a.pid FROM s a JOIN s b ON a.node <> b.node AND pow(a.x - b.x, 2) + pow(a.y - b.y, 2) + pow(a.z - b.z, 2) <= 0.0001 WHERE b.node = (a.node + 1) % 100),
    n AS (SELECT node, count(*) AS n FROM s GROUP BY node)
    SELECT h.a, h.b, round(count(*) / n.n::DOUBLE, 6) AS share FROM h JOIN n ON n.node = h.a GROUP BY h.a, h.b, n.n""",
)
def point_overlap_fraction(spark, sf_dir):
    """The share of a node's points (an even sample) within 1 cm of the next node's, by grid cells."""
    s = W.evenly(scene(spark, sf_dir, "points"), ["node"], ["pid"], SAMPLE)
    a = s.select(F.col("node").alias("a"), ((F.col("node") + 1) % 100).alias("b"), F.col("pid"), *[F.col(c).alias(f"a_{c}") for c in "xyz"])
    b = s.select(F.col("node").alias("b"), *[F.col(c).alias(f"b_{c}") for c in "xyz"])
    hit = J.within(a, b, ["a_x", "a_y", "a_z"], ["b_x", "b_y", "b_z"], 0.010000001, ["b"]).where("pow(a_x - b_x, 2) + pow(a_y - b_y, 2) + pow(a_z - b_z, 2) <= 0.0001").select("a", "b", "pid").distinct()
    n = s.groupBy(F.col("node").alias("a")).agg(F.count("*").alias("n"))
    return hit.groupBy("a", "b").agg(F.count("*").alias("k")).join(n, "a").select("a", "b", F.round(F.col("k") / F.col("n"), 6).alias("share"))


@query(
    "surface_distance",
    with_sql("points") + _SAMPLE + """, d AS (SELECT a.node AS unit, b.node AS carrier, a.pid, sqrt(min(pow(a.x - b.x, 2) + pow(a.y - b.y, 2) + pow(a.z - b.z, 2))) AS d FROM s a JOIN s b ON b.node = (a.node + 1) % 100 GROUP BY a.node, b.node, a.pid),
    k AS (SELECT *, row_number() OVER (PARTITION BY unit ORDER BY d, pid) AS rn, count(*) OVER (PARTITION BY unit) AS n FROM d)
    SELECT unit, carrier, round(median(d), 6) AS distance FROM k WHERE rn <= greatest(1, ceil(n * 0.2)) GROUP BY unit, carrier""",
)
def surface_distance(spark, sf_dir):
    """The median of the nearest fifth of a unit's distances to a carrier's points, each to the nearest by cells that grow."""
    s = W.evenly(scene(spark, sf_dir, "points"), ["node"], ["pid"], SAMPLE)
    u = s.select(F.col("node").alias("unit"), ((F.col("node") + 1) % 100).alias("carrier"), "pid", *[F.col(c).alias(f"u_{c}") for c in "xyz"])
    c = s.select(F.col("node").alias("carrier"), *[F.col(k).alias(f"c_{k}") for k in "xyz"])
    d = J.nearest_points(u, c, ["carrier"], "u_", "c_", ["unit", "pid"], 0.02).withColumnRenamed("distance", "d")
    o = Window.partitionBy("unit").orderBy("d", "pid")
    k = d.withColumns({"rn": F.row_number().over(o), "n": F.count("*").over(Window.partitionBy("unit"))}).where("rn <= greatest(1, ceil(n * 0.2))")
    return k.groupBy("unit", "carrier").agg(F.round(F.median("d"), 6).alias("distance"))


@query(
    "aabb_gap_pairs",
    with_sql("boxes3d") + """g AS (SELECT c.node_id AS carrier, u.node_id AS unit, sqrt(pow(greatest(0, c.bx1 - u.bx2, u.bx1 - c.bx2), 2) + pow(greatest(0, c.by1 - u.by2, u.by1 - c.by2), 2) + pow(greatest(0, c.bz1 - u.bz2, u.bz1 - c.bz2), 2)) AS gap FROM boxes3d c JOIN boxes3d u ON c.role = 'C' AND u.role = 'U')
    SELECT carrier, unit, round(gap, 6) AS gap FROM g WHERE gap <= 0.08""",
)
def aabb_gap_pairs(spark, sf_dir):
    """Carriers and units whose boxes are at most 0.08 m apart: boxes that share a cell, then the gap."""
    b = scene(spark, sf_dir, "boxes3d")
    side = lambda role, p: b.where(f"role = '{role}'").select(F.col("node_id").alias(f"{p}id"), *[F.col(f"b{c}").alias(f"{p}{c}") for c in J.BOX3D])
    j = J.near_boxes(side("C", "c_"), side("U", "u_"), "c_", "u_", 0.08)
    gap = G.gap3d(J.box_columns("c_"), J.box_columns("u_"))
    return j.withColumn("gap", gap).where("gap <= 0.08").select(F.col("c_id").alias("carrier"), F.col("u_id").alias("unit"), F.round("gap", 6).alias("gap"))


@query(
    "label_compatibility_pairs",
    f"WITH n AS (SELECT DISTINCT {_NORM.format('p_name')} AS label FROM part), m AS (SELECT DISTINCT regexp_extract(label, '[^ ]+$') AS prior FROM n) SELECT label, prior FROM n JOIN m ON label = prior OR label LIKE '% ' || prior",
)
def label_compatibility_pairs(spark, sf_dir):
    n = scene(spark, sf_dir, "part").select(L.prior_label(F.col("p_name")).alias("label")).distinct()
    return J.by_suffix(n, "label", n.select(F.substring_index("label", " ", -1).alias("prior")).distinct(), "prior").select("label", "prior")


@query(
    "semantic_prior_join",
    with_sql("relations_2d", "atlas") + """z AS (SELECT r.frame_idx, r.edge_type, r.parent_det_id, r.child_det_id, a.source, a.relation_text FROM relations_2d r JOIN atlas a ON a.edge_type = r.edge_type AND (r.parent_label = a.parent_label OR r.parent_label LIKE '% ' || a.parent_label) AND (r.child_label = a.child_label OR r.child_label LIKE '% ' || a.child_label))
    SELECT edge_type, source, relation_text, count(*) AS n FROM z GROUP BY ALL""",
)
def semantic_prior_join(spark, sf_dir):
    r, a = scene(spark, sf_dir, "relations_2d"), scene(spark, sf_dir, "atlas").withColumnsRenamed({"edge_type": "a_type", "parent_label": "a_parent", "child_label": "a_child"})
    j = J.by_suffix(r, "child_label", a, "a_child").where((F.col("edge_type") == F.col("a_type")) & L.compatible(F.col("parent_label"), F.col("a_parent")))
    return j.groupBy("edge_type", "source", "relation_text").agg(F.count("*").alias("n"))


@query(
    "candidate_expansion",
    with_sql("relations_2d", "atlas") + """p AS (SELECT d.*, a.edge_type, a.parent_label AS pl FROM detections d JOIN (SELECT DISTINCT edge_type, parent_label, child_label FROM atlas) a ON d.role = split_part(a.edge_type, '-', 2) AND (d.label = a.child_label OR d.label LIKE '% ' || a.child_label)
        WHERE NOT EXISTS (SELECT 1 FROM relations_2d r WHERE r.frame_idx = d.frame_idx AND r.edge_type = a.edge_type AND r.child_det_id = d.det_id AND r.pass_threshold)),
    j AS (SELECT DISTINCT c.frame_idx, c.edge_type, c.det_id AS child_det_id, d.det_id AS parent_det_id, round(CASE WHEN d.x1 <= (c.x1 + c.x2) * 0.5 AND (c.x1 + c.x2) * 0.5 <= d.x2 AND d.y1 <= (c.y1 + c.y2) * 0.5 AND (c.y1 + c.y2) * 0.5 <= d.y2 THEN 1 ELSE 0 END
        + CASE WHEN (c.x2 - c.x1) * (c.y2 - c.y1) <= 0 THEN 0 ELSE greatest(0, least(d.x2, c.x2) - greatest(d.x1, c.x1)) * greatest(0, least(d.y2, c.y2) - greatest(d.y1, c.y1)) / ((c.x2 - c.x1) * (c.y2 - c.y1))::DOUBLE END
        + exp(-sqrt(pow(((c.x1 + c.x2) * 0.5::DOUBLE - (d.x1 + d.x2) * 0.5::DOUBLE) / greatest(d.x2 - d.x1, 1), 2) + pow(((c.y1 + c.y2) * 0.5::DOUBLE - (d.y1 + d.y2) * 0.5::DOUBLE) / greatest(d.y2 - d.y1, 1), 2))), 6) AS score
        FROM p c JOIN detections d ON d.frame_idx = c.frame_idx AND d.role = split_part(c.edge_type, '-', 1) AND (d.label = c.pl OR d.label LIKE '% ' || c.pl)),
    w AS (SELECT *, row_number() OVER (PARTITION BY frame_idx, edge_type, child_det_id ORDER BY score DESC, parent_det_id) AS rank FROM j)
    SELECT * FROM w WHERE rank <= 2""",
)
def candidate_expansion(spark, sf_dir):
    d, r = scene(spark, sf_dir, "detections"), scene(spark, sf_dir, "relations_2d")
    priors = scene(spark, sf_dir, "atlas").select("edge_type", "parent_label", "child_label").distinct()
    return J.expanded(d, d, priors, r.where("pass_threshold")).withColumn("rank", F.col("rank").cast("long"))


@query(
    "cross_role_duplicates",
    with_sql("detections") + """j AS (SELECT c.frame_idx, c.det_id AS carrier, u.det_id AS unit, greatest(0, least(c.x2, u.x2) - greatest(c.x1, u.x1)) * greatest(0, least(c.y2, u.y2) - greatest(c.y1, u.y1)) AS i, (c.x2 - c.x1) * (c.y2 - c.y1) + (u.x2 - u.x1) * (u.y2 - u.y1) AS s FROM detections c JOIN detections u ON c.frame_idx = u.frame_idx AND c.role = 'C' AND u.role = 'U')
    SELECT frame_idx, carrier, min(unit) AS witness, count(*) AS n FROM j WHERE i > 0 AND i / greatest(s - i, 1e-9) >= 0.02 GROUP BY frame_idx, carrier""",
)
def cross_role_duplicates(spark, sf_dir):
    """Carriers that a unit of the frame covers, with their first witness."""
    d = scene(spark, sf_dir, "detections")
    c = d.where("role = 'C'").select("frame_idx", F.col("det_id").alias("carrier"), *[F.col(x).alias(f"c_{x}") for x in ("x1", "y1", "x2", "y2")])
    u = d.where("role = 'U'").select("frame_idx", F.col("det_id").alias("unit"), "x1", "y1", "x2", "y2")
    hit = c.join(u, "frame_idx").where(G.iou2d(G.box("c_"), G.box(), "1e-9") >= 0.02)
    return hit.groupBy("frame_idx", "carrier").agg(F.min("unit").alias("witness"), F.count("*").alias("n"))


@query(
    "remote_best_source",
    with_sql("nodes", "templates") + """d AS (SELECT scene, greatest(0.35 * sqrt(pow(max(cx) - min(cx), 2) + pow(max(cy) - min(cy), 2) + pow(max(cz) - min(cz), 2)), 0.25) AS scale FROM nodes GROUP BY scene),
    m AS (SELECT t.*, s.side, n.scene, n.node_id, n.cx, n.cy, n.cz, n.confidence, n.n, n.label = CASE s.side WHEN 0 THEN source_label ELSE target_label END AS exact FROM templates t CROSS JOIN (SELECT 0 AS side UNION ALL SELECT 1) s
        JOIN nodes n ON n.label = CASE s.side WHEN 0 THEN source_label ELSE target_label END OR n.label LIKE '% ' || CASE s.side WHEN 0 THEN source_label ELSE target_label END OR CASE s.side WHEN 0 THEN source_label ELSE target_label END LIKE '% ' || n.label),
    e AS (SELECT *, bool_or(exact) OVER (PARTITION BY scene, source_label, relation_text, target_label, side) AS any_exact FROM m), k AS (SELECT * FROM e WHERE exact OR NOT any_exact),
    j AS (SELECT a.source_label, a.relation_text, a.target_label, b.node_id AS target, a.node_id AS source, round(0.4 + 0.25 * (1 - exp(-(a.n % 3))) + 0.15 * exp(-sqrt(pow(a.cx - b.cx, 2) + pow(a.cy - b.cy, 2) + pow(a.cz - b.cz, 2)) / d.scale) + 0.15 * least(1, ((a.n + b.n) % 4) / 3.0) + 0.05 * least(1, greatest(0, 0.5 * (a.confidence + b.confidence))), 6) AS score
        FROM k a JOIN k b ON a.side = 0 AND b.side = 1 AND a.scene = b.scene AND a.source_label = b.source_label AND a.relation_text = b.relation_text AND a.target_label = b.target_label AND a.node_id <> b.node_id JOIN d ON d.scene = a.scene),
    w AS (SELECT *, row_number() OVER p AS rn, lead(score) OVER p AS second FROM j WINDOW p AS (PARTITION BY source_label, relation_text, target_label, target ORDER BY score DESC, source)),
    x AS (SELECT *, row_number() OVER (PARTITION BY source, target, relation_text ORDER BY score DESC, source_label) AS k FROM w WHERE rn = 1)
    SELECT source, target, relation_text, score, round(score - second, 6) AS margin FROM x WHERE k = 1""",
)
def remote_best_source(spark, sf_dir):
    """For each remote template and target node the source node of its scene with the best score; one row a (source, target, text)."""
    from ..plans.graph import remote_links

    n = scene(spark, sf_dir, "nodes").withColumn("observed", F.col("n") % 3)
    return remote_links(n, scene(spark, sf_dir, "templates"), lambda s, t: (s["n"] + t["n"]) % 4, ["scene"])


_HINTED = """m AS (SELECT frame_idx, det_id, 'C' || lpad(((det_id * 5 + frame_idx % 3) % 24)::VARCHAR, 9, '0') AS node_id, x1, y1, x2, y2 FROM detections WHERE role = 'C'),
    h AS (SELECT DISTINCT m.node_id, r.parent_label AS owner, r.frame_idx, r.parent_det_id FROM relations_2d r JOIN m ON m.frame_idx = r.frame_idx AND m.det_id = r.child_det_id WHERE r.edge_type = 'O-C' AND contain > 0.3),
    o AS (SELECT frame_idx, node_id, min(det_id) AS det_id FROM m GROUP BY ALL), ob AS (SELECT m.* FROM m JOIN o USING (frame_idx, node_id, det_id)),
    nm AS (SELECT node_id, cos(n * 0.15) AS nx, sin(n * 0.15) AS ny, 0.0::DOUBLE AS nz, bx1, by1, bz1, bx2, by2, bz2 FROM boxes3d WHERE role = 'C')"""


@query(
    "owner_hint_links",
    with_sql("relations_2d", "boxes3d") + _HINTED + """, f AS (SELECT DISTINCT a.owner, a.node_id AS a, b.node_id AS b, a.frame_idx FROM h a JOIN h b ON a.owner = b.owner AND a.frame_idx = b.frame_idx AND a.parent_det_id = b.parent_det_id AND a.node_id < b.node_id),
    g AS (SELECT owner, a, b, f.frame_idx, greatest(0, least(x.x2, y.x2) - greatest(x.x1, y.x1)) * greatest(0, least(x.y2, y.y2) - greatest(x.y1, y.y1)) AS i, (x.x2 - x.x1) * (x.y2 - x.y1) + (y.x2 - y.x1) * (y.y2 - y.y1) AS s FROM f JOIN ob x ON x.frame_idx = f.frame_idx AND x.node_id = a JOIN ob y ON y.frame_idx = f.frame_idx AND y.node_id = b),
    k AS (SELECT owner, a, b, count(*) AS frames, count(*) FILTER (i / (s - i) > 1e-4) AS n_overlaps FROM g GROUP BY ALL)
    SELECT owner, a, b, frames, n_overlaps, round(abs(p.nx * q.nx + p.ny * q.ny + p.nz * q.nz), 6) AS normal_dot, round(sqrt(pow(greatest(0, p.bx1 - q.bx2, q.bx1 - p.bx2), 2) + pow(greatest(0, p.by1 - q.by2, q.by1 - p.by2), 2) + pow(greatest(0, p.bz1 - q.bz2, q.bz1 - p.bz2), 2)), 6) AS gap
    FROM k JOIN nm p ON p.node_id = a JOIN nm q ON q.node_id = b WHERE n_overlaps >= 1 AND abs(p.nx * q.nx + p.ny * q.ny + p.nz * q.nz) >= 0.9 AND sqrt(pow(greatest(0, p.bx1 - q.bx2, q.bx1 - p.bx2), 2) + pow(greatest(0, p.by1 - q.by2, q.by1 - p.by2), 2) + pow(greatest(0, p.bz1 - q.bz2, q.bz1 - p.bz2), 2)) <= 0.4""",
)
def owner_hint_links(spark, sf_dir):
    """Carriers that share an owner hint in frames in which they overlap, with like normals and a small gap."""
    node = F.concat(F.lit("C"), F.lpad(((F.col("det_id") * 5 + F.col("frame_idx") % 3) % 24).cast("string"), 9, "0"))
    m = scene(spark, sf_dir, "detections").where("role = 'C'").select("frame_idx", "det_id", node.alias("node_id"), "x1", "y1", "x2", "y2")
    r = scene(spark, sf_dir, "relations_2d").where("edge_type = 'O-C' and contain > 0.3").select("frame_idx", F.col("child_det_id").alias("det_id"), F.col("parent_label").alias("owner"), "parent_det_id")
    seen = m.groupBy("frame_idx", "node_id").agg(F.min(F.struct("det_id", "x1", "y1", "x2", "y2")).alias("m")).select("frame_idx", "node_id", "m.x1", "m.y1", "m.x2", "m.y2")
    b = scene(spark, sf_dir, "boxes3d").where("role = 'C'").select("node_id", F.cos(F.col("n") * 0.15).alias("nx"), F.sin(F.col("n") * 0.15).alias("ny"), F.lit(0.0).alias("nz"), *[F.col(f"b{c}").alias(c) for c in J.BOX3D])
    out = J.hint_links(r.join(m.select("frame_idx", "det_id", "node_id"), ["frame_idx", "det_id"]), seen, b, gap=0.4)
    return out.select("owner", "a", "b", "frames", "n_overlaps", F.round("normal_dot", 6).alias("normal_dot"), F.round("gap", 6).alias("gap"))


@query(
    "historical_recovery",
    with_sql("edge_candidates", "boxes3d") + """l AS (SELECT DISTINCT parent_node_id, child_node_id FROM edge_candidates WHERE edge_type = 'C-U' AND selected AND pass_threshold AND sdet > 0.9 AND coverage > 0.96),
    k AS (SELECT DISTINCT e.child_node_id, e.parent_node_id FROM edge_candidates e WHERE edge_type = 'C-U' AND from_raw AND coverage > 0.3 AND child_node_id NOT IN (SELECT child_node_id FROM l) AND NOT EXISTS (SELECT 1 FROM edge_candidates x WHERE x.edge_type = 'C-U' AND x.semantic_source = 'atlas' AND x.frame_idx % 7 = 0 AND x.parent_node_id = e.parent_node_id AND x.child_node_id = e.child_node_id)),
    g AS (SELECT k.child_node_id AS unit, k.parent_node_id AS carrier, round(sqrt(pow(greatest(0, p.bx1 - q.bx2, q.bx1 - p.bx2), 2) + pow(greatest(0, p.by1 - q.by2, q.by1 - p.by2), 2) + pow(greatest(0, p.bz1 - q.bz2, q.bz1 - p.bz2), 2)), 6) AS distance FROM k JOIN boxes3d p ON p.node_id = k.parent_node_id JOIN boxes3d q ON q.node_id = k.child_node_id WHERE p.state <> 'rejected' AND q.state <> 'rejected'),
    w AS (SELECT *, row_number() OVER (PARTITION BY unit ORDER BY distance, carrier) AS rank FROM g WHERE distance <= 1.2) SELECT * FROM w WHERE rank <= 2""",
)
def historical_recovery(spark, sf_dir):
    """Units without a link: the two nearest carriers that were seen with them, whose mask covers them, and that no pair has
    yet."""
    e, b = scene(spark, sf_dir, "edge_candidates").where("edge_type = 'C-U'"), scene(spark, sf_dir, "boxes3d").where("state <> 'rejected'")
    linked = e.where("selected and pass_threshold and sdet > 0.9 and coverage > 0.96").select("child_node_id").distinct()
    known = e.where("semantic_source = 'atlas' and frame_idx % 7 = 0").select("parent_node_id", "child_node_id").distinct()
    return J.recovered(e.where("from_raw"), linked, known, b, reach=1.2, covered=0.3, top=2)


_TRACKS = """t AS (SELECT 'C' || node AS id, 'C' AS role, pid, x + node * 0.5 AS x, y, z FROM points UNION ALL SELECT 'U' || node, 'U', pid, x + node * 0.5 + CASE node % 3 WHEN 0 THEN 0.002 WHEN 1 THEN 0.012 ELSE 0.2 END, y, z FROM points WHERE node % 5 <> 4 AND pid % 4 <> 3),
    r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY pid) - 1 AS i, count(*) OVER (PARTITION BY id) AS n FROM t), s AS (SELECT * FROM r WHERE n <= 512 OR list_contains(list_transform(range(512), lambda j: floor(j * ((n - 1) / 511.0::DOUBLE) + 1e-9)::BIGINT), i)),
    c AS (SELECT id, role, avg(x) AS cx, avg(y) AS cy, avg(z) AS cz, sqrt(pow(max(x) - min(x), 2) + pow(max(y) - min(y), 2) + pow(max(z) - min(z), 2)) AS extent FROM t GROUP BY id, role)"""


@query(
    "retired_carriers",
    with_sql("points") + _TRACKS + """, p AS (SELECT a.id AS carrier, b.id AS unit, sqrt(pow(a.cx - b.cx, 2) + pow(a.cy - b.cy, 2) + pow(a.cz - b.cz, 2)) AS d, greatest(0.03, 0.35 * greatest(a.extent, b.extent)) AS most FROM c a JOIN c b ON a.role = 'C' AND b.role = 'U'),
    k AS (SELECT * FROM p WHERE d <= most), h AS (SELECT k.carrier, k.unit, x.pid AS xp, y.pid AS yp FROM k JOIN s x ON x.id = k.carrier JOIN s y ON y.id = k.unit AND pow(x.x - y.x, 2) + pow(x.y - y.y, 2) + pow(x.z - y.z, 2) <= 0.0001),
    n AS (SELECT id, count(*) AS n FROM s GROUP BY id), o AS (SELECT h.carrier, h.unit, count(DISTINCT xp) / any_value(a.n)::DOUBLE AS cu, count(DISTINCT yp) / any_value(b.n)::DOUBLE AS uc FROM h JOIN n a ON a.id = h.carrier JOIN n b ON b.id = h.unit GROUP BY ALL),
    w AS (SELECT carrier, unit, round(d, 6) AS distance, round(least(cu, uc), 6) AS mutual, round(greatest(cu, uc), 6) AS one_way FROM o JOIN k USING (carrier, unit) WHERE least(cu, uc) >= 0.45 AND greatest(cu, uc) >= 0.8)
    SELECT * FROM w QUALIFY row_number() OVER (PARTITION BY carrier ORDER BY mutual DESC, one_way DESC, distance, unit) = 1""",
)
def retired_carriers(spark, sf_dir):
    """Carriers that a witness unit duplicates: centroids within the gate, points that cover each other, the best witness."""
    p = scene(spark, sf_dir, "points")
    shift = F.when(F.col("node") % 3 == 0, 0.002).when(F.col("node") % 3 == 1, 0.012).otherwise(0.2)
    side = lambda d, role, x: d.select(F.concat(F.lit(role), F.col("node").cast("string")).alias("id"), F.lit(role).alias("role"), "pid", x.alias("x"), "y", "z")
    t = side(p, "C", F.col("x") + F.col("node") * 0.5).unionByName(side(p.where("node % 5 <> 4 and pid % 4 <> 3"), "U", F.col("x") + F.col("node") * 0.5 + shift))
    return J.retired(t, 512).select("carrier", "unit", *[F.round(c, 6).alias(c) for c in ("distance", "mutual", "one_way")])


@query("hierarchy_roles", with_sql("gt_edges") + "t AS (SELECT DISTINCT a.child AS unit, a.parent AS carrier, b.parent AS object FROM gt_edges a JOIN gt_edges b ON a.parent = b.child JOIN gt_edges c ON c.child = a.child AND c.parent = b.parent) SELECT carrier, object, count(*) AS units FROM t GROUP BY carrier, object")
def hierarchy_roles(spark, sf_dir):
    return J.closed_triangles(scene(spark, sf_dir, "gt_edges")).groupBy("carrier", "object").agg(F.count("*").alias("units"))


@query("uco_closure", with_sql("gt_edges") + "c AS (SELECT a.child AS unit, b.parent AS object, a.parent AS carrier FROM gt_edges a JOIN gt_edges b ON a.parent = b.child WHERE NOT EXISTS (SELECT 1 FROM gt_edges c WHERE c.child = a.child AND c.parent = b.parent)) SELECT unit, object, carrier FROM c")
def uco_closure(spark, sf_dir):
    e = scene(spark, sf_dir, "gt_edges")
    return J.owner_closure(e, e, e)


@query("covisibility_pairs", with_sql("edge_candidates") + "f AS (SELECT DISTINCT frame_idx, child_node_id AS n FROM edge_candidates ) SELECT DISTINCT a.n AS a, b.n AS b FROM f a JOIN f b ON a.frame_idx = b.frame_idx AND a.n < b.n")
def covisibility_pairs(spark, sf_dir):
    return J.co_observed(scene(spark, sf_dir, "edge_candidates"), "frame_idx", "child_node_id")


@query(
    "alias_canonical",
    with_sql("alias_steps", recursive=True) + """w(source, target) AS (SELECT source, target FROM alias_steps UNION SELECT w.source, a.target FROM w JOIN alias_steps a ON w.target = a.source)
    SELECT source, target AS canonical FROM w WHERE target NOT IN (SELECT source FROM alias_steps)""",
)
def alias_canonical(spark, sf_dir):
    return X.canonical(scene(spark, sf_dir, "alias_steps"))


@query(
    "descendants",
    with_sql("gt_edges", recursive=True) + "d(root, node) AS (SELECT parent, child FROM gt_edges WHERE parent IN ('r1', 'r3') UNION SELECT d.root, e.child FROM d JOIN gt_edges e ON e.parent = d.node) SELECT root, count(*) AS n FROM d GROUP BY root",
)
def descendants(spark, sf_dir):
    e = scene(spark, sf_dir, "gt_edges")
    return X.descendants(e, e.where("parent in ('r1', 'r3')").select(F.col("parent").alias("root")).distinct()).groupBy("root").agg(F.count("*").alias("n"))


_HITS = """v AS (SELECT vec_id, embedding FROM embeddings), q AS (SELECT vec_id AS query_id, embedding AS e FROM embeddings WHERE vec_id % 20 = 0),
    s AS (SELECT query_id, vec_id, round(list_dot_product(e::DOUBLE[], embedding::DOUBLE[]) / (sqrt(list_dot_product(e::DOUBLE[], e::DOUBLE[])) * sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]))), 6) AS similarity FROM q CROSS JOIN v),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, vec_id) AS rank FROM s)"""


@query("retrieval_hits", "WITH " + _HITS + " SELECT query_id, vec_id, similarity, rank FROM r WHERE rank <= 3 OR similarity > 0.75")
def retrieval_hits(spark, sf_dir):
    """Hits of a query set, every twentieth vector, among all vectors: the first 3, or closer than 0.75."""
    from .evaluate import hits

    e = scene(spark, sf_dir, "embeddings")
    return hits(_queries(e), e.select("vec_id", "embedding"), 3, 0.75)


def _queries(e):
    return e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))


@query("nearest_prototype", "WITH " + _HITS + " SELECT query_id, vec_id AS prototype, similarity FROM r WHERE rank = 1")
def nearest_prototype(spark, sf_dir):
    from .evaluate import hits

    e = scene(spark, sf_dir, "embeddings")
    return hits(_queries(e), e.select("vec_id", "embedding"), 1, 2.0).select("query_id", F.col("vec_id").alias("prototype"), "similarity")


@query(
    "feature_cosines",
    """WITH a AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings), b AS (SELECT vec_id - 1 AS vec_id, embedding::DOUBLE[] AS f FROM embeddings)
    SELECT vec_id, round(greatest(0, least(1, list_dot_product(e, f) / (sqrt(list_dot_product(e, e)) * sqrt(list_dot_product(f, f))))), 6) AS similarity FROM a JOIN b USING (vec_id)""",
)
def feature_cosines(spark, sf_dir):
    e = scene(spark, sf_dir, "embeddings")
    return e.select("vec_id", F.col("embedding").alias("e")).join(e.select((F.col("vec_id") - 1).alias("vec_id"), "embedding"), "vec_id").select("vec_id", F.round(V.cosine(F.col("e"), F.col("embedding")), 6).alias("similarity"))
