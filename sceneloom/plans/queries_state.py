"""Queries: ordered folds, assignment, suppression, evaluation, map building."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..fixtures import scene, with_sql
from ..functions import geometry as G
from ..operators import assign as O
from ..operators import fixpoint as X
from ..operators import fold as T
from ..operators import scan
from ..operators.artifacts import mock_features
from ..registry import query
from . import completion as C
from . import mapping as M
from . import reports as R
from . import tracker as K

_FIRST = "o AS (SELECT *, row_number() OVER (PARTITION BY node_id ORDER BY seq) AS rn FROM observations)"


@query("quality_ema", with_sql("observations", recursive=True) + _FIRST + ", e(node_id, rn, ema) AS (SELECT node_id, rn, quality FROM o WHERE rn = 1 UNION ALL SELECT o.node_id, o.rn, 0.75::DOUBLE * e.ema + 0.25::DOUBLE * o.quality FROM e JOIN o ON o.node_id = e.node_id AND o.rn = e.rn + 1) SELECT node_id, max(rn) AS n, round(arg_max(ema, rn), 6) AS ema FROM e GROUP BY node_id")
def quality_ema(spark, sf_dir):
    s = scan.averages(scene(spark, sf_dir, "observations"), ["node_id"], "seq", "quality", 0.25)
    return s.select("node_id", "n", F.round("ema", 6).alias("ema"))


_VEC = """v AS (SELECT label AS k, vec_id, embedding::DOUBLE[] AS e, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS rn FROM embeddings),
    f(k, rn, e) AS (SELECT k, rn, list_transform(e, lambda x: x / sqrt(list_dot_product(e, e))) FROM v WHERE rn = 1 UNION ALL
    SELECT k, rn, list_transform(m, lambda x: x / sqrt(list_dot_product(m, m))) FROM (SELECT v.k, v.rn, list_transform(range(1, 65), lambda i: {0}) AS m FROM f JOIN v ON v.k = f.k AND v.rn = f.rn + 1))"""


@query("feature_ema", "WITH RECURSIVE " + _VEC.format("0.7::DOUBLE * f.e[i] + 0.3::DOUBLE * v.e[i]") + " SELECT k AS label, round(arg_max(e[1], rn), 6) AS first, round(arg_max(e[64], rn), 6) AS last FROM f GROUP BY k")
def feature_ema(spark, sf_dir):
    return _feature_ema(scene(spark, sf_dir, "embeddings"))


def _feature_ema(e):
    s = T.ordered(e, ["label"], ["vec_id"], ["embedding"]).select("label", T.average_vector(F.col("steps"), "embedding", 0.3).alias("v"))
    return s.select("label", F.round(F.get("v", F.lit(0)), 6).alias("first"), F.round(F.get("v", F.lit(63)), 6).alias("last"))


@query("weighted_feature_mean", "WITH RECURSIVE " + _VEC.format("f.e[i] + (v.vec_id % 7 + 1) / 8.0::DOUBLE * v.e[i]") + " SELECT k AS label, round(arg_max(e[1], rn), 6) AS first, round(arg_max(e[64], rn), 6) AS last FROM f GROUP BY k")
def weighted_feature_mean(spark, sf_dir):
    return _weighted_feature_mean(scene(spark, sf_dir, "embeddings"))


def _weighted_feature_mean(e):
    s = T.ordered(e.withColumn("w", (F.col("vec_id") % 7 + 1) / 8.0), ["label"], ["vec_id"], ["embedding", "w"]).select("label", T.weighted_direction(F.col("steps"), "embedding", "w").alias("v"))
    return s.select("label", F.round(F.get("v", F.lit(0)), 6).alias("first"), F.round(F.get("v", F.lit(63)), 6).alias("last"))


_POST = """e AS (SELECT frame_idx, child_node_id AS c, parent_node_id AS p, s2d_score FROM edge_candidates WHERE edge_type IN ('O-C', 'O-U')),
    fr AS (SELECT frame_idx, row_number() OVER (ORDER BY frame_idx) AS t FROM (SELECT DISTINCT frame_idx FROM e)),
    ad AS (SELECT c, p, frame_idx, sum(ln(least(1 - 1e-4, greatest(1e-4, s2d_score)) / (1 - least(1 - 1e-4, greatest(1e-4, s2d_score))))) AS a FROM e WHERE s2d_score IS NOT NULL GROUP BY ALL),
    pr AS (SELECT DISTINCT c, p FROM ad UNION SELECT DISTINCT c, '__no_parent__' FROM ad),
    st AS (SELECT c, min(t) AS since FROM ad JOIN fr USING (frame_idx) GROUP BY c),
    gr AS (SELECT pr.c, pr.p, fr.t, fr.frame_idx, CASE WHEN pr.p = '__no_parent__' THEN 0 ELSE sum(a) OVER (PARTITION BY pr.c, pr.p ORDER BY fr.t) END AS odds FROM pr JOIN st USING (c) JOIN fr ON fr.t >= st.since LEFT JOIN ad ON ad.c = pr.c AND ad.p = pr.p AND ad.frame_idx = fr.frame_idx),
    ok AS (SELECT c, p, t, frame_idx, odds::DOUBLE AS odds, count(*) OVER (PARTITION BY c, t) AS n FROM gr WHERE odds IS NOT NULL),
    ls AS (SELECT c, t, any_value(frame_idx) AS frame_idx, list(p ORDER BY p) AS ps, list(odds ORDER BY p) AS os FROM ok GROUP BY c, t),
    fold(c, t, frame_idx, ps, os, q) AS (
        SELECT c, t, frame_idx, ps, os, list_transform(x, lambda v: v / list_sum(x)) FROM (SELECT c, t, frame_idx, ps, os, list_transform(l, lambda v: exp(v - list_max(l))) AS x FROM
            (SELECT ls.c, ls.t, ls.frame_idx, ps, os, list_transform(os, lambda o: (o + 0.05 * ln(1.0::DOUBLE / len(ps))) / 0.15) AS l FROM ls JOIN st ON st.c = ls.c AND st.since = ls.t))
        UNION ALL
        SELECT c, t, frame_idx, ps, os, list_transform(x, lambda v: v / list_sum(x)) FROM (SELECT c, t, frame_idx, ps, os, list_transform(l, lambda v: exp(v - list_max(l))) AS x FROM
            (SELECT c, t, frame_idx, ps, os, list_transform(range(1, len(ps) + 1), lambda i: (os[i] + 0.05 * ln(greatest(b[i] / list_sum(b), 1e-9))) / 0.15) AS l FROM
                (SELECT ls.c, ls.t, ls.frame_idx, ls.ps, ls.os, list_transform(ls.ps, lambda k: coalesce(fold.q[list_position(fold.ps, k)], 1.0::DOUBLE / len(ls.ps))) AS b FROM fold JOIN ls ON ls.c = fold.c AND ls.t = fold.t + 1))))"""


@query("posterior_fold", with_sql("edge_candidates", recursive=True) + _POST + " SELECT c AS child_node_id, frame_idx, len(ps) AS parents, round(list_max(q), 6) AS top FROM fold")
def posterior_fold(spark, sf_dir):
    """The posterior of every child's parents, frame by frame."""
    e = scene(spark, sf_dir, "edge_candidates").where("edge_type in ('O-C', 'O-U')").select("frame_idx", "child_node_id", "parent_node_id", "s2d_score")
    return T.posteriors(e).select("child_node_id", "frame_idx", F.size("p").cast("long").alias("parents"), F.round(F.array_max("p"), 6).alias("top"))


@query(
    "parent_decision",
    with_sql("edge_candidates", recursive=True) + _POST + """, l AS (SELECT c, max(t) AS t FROM fold GROUP BY c), u AS (SELECT c, unnest(ps) AS p, unnest(os) AS o, unnest(q) AS q FROM fold JOIN l USING (c, t)),
    n AS (SELECT c, q AS none FROM u WHERE p = '__no_parent__'), r AS (SELECT c, p, o, round(q, 9) AS q, row_number() OVER w AS rn, lead(round(q, 9)) OVER w AS second FROM u WHERE p <> '__no_parent__' WINDOW w AS (PARTITION BY c ORDER BY round(q, 9) DESC, p))
    SELECT c AS child_node_id, p AS parent_node_id, round(q, 6) AS posterior, round(o, 6) AS log_odds, CASE WHEN o <= 0 OR q <= none OR q - greatest(none, coalesce(second, 0)) < 0.05 THEN 'provisional' ELSE 'confirmed' END AS status FROM r JOIN n USING (c) WHERE rn = 1""",
)
def parent_decision(spark, sf_dir):
    e = scene(spark, sf_dir, "edge_candidates").where("edge_type in ('O-C', 'O-U')").select("frame_idx", "child_node_id", "parent_node_id", "s2d_score")
    return T.decisions(T.segments(e, T.calendar(e)))


@query(
    "parent_switches",
    with_sql("edge_candidates", recursive=True) + _POST + """, u AS (SELECT c, t, frame_idx, unnest(ps) AS p, round(unnest(q), 9) AS q FROM fold),
    n AS (SELECT c, t, any_value(frame_idx) AS frame_idx, first(p ORDER BY q DESC, p <> '__no_parent__', p) AS top, first(p ORDER BY q DESC, p) AS plain FROM u GROUP BY c, t),
    l AS (SELECT *, lag(plain) OVER (PARTITION BY c ORDER BY t) AS before FROM n)
    SELECT c AS child_node_id, frame_idx, top, coalesce(before <> top, false) AS switched FROM l""",
)
def parent_switches(spark, sf_dir):
    """The first of each frame's posterior and whether it differs from the frame before."""
    e = scene(spark, sf_dir, "edge_candidates").where("edge_type in ('O-C', 'O-U')").select("frame_idx", "child_node_id", "parent_node_id", "s2d_score")
    return T.switches(T.posteriors(e))


@query(
    "scene_switch",
    with_sql("scene_votes", recursive=True) + """o AS (SELECT *, row_number() OVER (PARTITION BY sequence ORDER BY frame_idx) AS rn, scene <> 'unknown' AND confidence >= 0.9 AS good FROM scene_votes),
    f(sequence, rn, locked, other, run, last, go, frame_idx) AS (
        SELECT sequence, rn, CASE WHEN good THEN scene END, NULL::VARCHAR, 0, NULL::BIGINT, false, frame_idx FROM o WHERE rn = 1
        UNION ALL
        SELECT sequence, rn, CASE WHEN (locked IS NULL AND good) OR go THEN scene ELSE locked END, CASE WHEN go OR NOT d THEN NULL ELSE scene END, CASE WHEN go THEN 0 ELSE run END, CASE WHEN go THEN frame_idx ELSE last END, go, frame_idx FROM (
            SELECT *, d AND run >= 2 AND (last IS NULL OR frame_idx - last >= 20) AS go FROM (
                SELECT o.sequence, o.rn, o.frame_idx, o.scene, o.good, f.locked, f.last, coalesce(f.locked IS NOT NULL AND o.good AND o.scene <> f.locked, false) AS d,
                    CASE WHEN coalesce(f.locked IS NOT NULL AND o.good AND o.scene <> f.locked, false) THEN CASE WHEN f.other = o.scene THEN f.run + 1 ELSE 1 END ELSE 0 END AS run
                FROM f JOIN o ON o.sequence = f.sequence AND o.rn = f.rn + 1)))
    SELECT sequence, frame_idx, locked AS scene FROM f WHERE go""",
)
def scene_switch(spark, sf_dir):
    return scan.scene_switches(scene(spark, sf_dir, "scene_votes")).select("sequence", "frame_idx", "scene")


_PAIRS = "p AS (SELECT o.seq // 4 AS grp, o.seq, n.node_id, round(exp(-pow(o.quality - n.quality_ema, 2) * 4) * (0.5 + (o.seq * n.n) % 17 / 34.0), 6) AS score FROM observations o JOIN nodes n ON n.role = 'U' AND n.n // 4 = (o.seq // 4) % (SELECT greatest(1, count(*) // 4) FROM part))"


@query(
    "frame_assignment",
    with_sql("observations", "nodes") + _PAIRS + """, k AS (SELECT grp, seq, row_number() OVER (PARTITION BY grp ORDER BY seq) AS i FROM (SELECT DISTINCT grp, seq FROM p)), q AS (SELECT p.*, k.i FROM p JOIN k USING (grp, seq) WHERE score > 0.2),
    a AS (SELECT grp, node_id, score FROM q WHERE i = 1 UNION ALL SELECT DISTINCT grp, NULL, 0 FROM k), b AS (SELECT grp, node_id, score FROM q WHERE i = 2 UNION ALL SELECT DISTINCT grp, NULL, 0 FROM k), c AS (SELECT grp, node_id, score FROM q WHERE i = 3 UNION ALL SELECT DISTINCT grp, NULL, 0 FROM k), d AS (SELECT grp, node_id, score FROM q WHERE i = 4 UNION ALL SELECT DISTINCT grp, NULL, 0 FROM k)
    SELECT a.grp, round(max(a.score + b.score + c.score + d.score), 6) AS total FROM a JOIN b ON a.grp = b.grp AND coalesce(a.node_id <> b.node_id, true) JOIN c ON c.grp = a.grp AND coalesce(c.node_id <> a.node_id, true) AND coalesce(c.node_id <> b.node_id, true)
    JOIN d ON d.grp = a.grp AND coalesce(d.node_id <> a.node_id, true) AND coalesce(d.node_id <> b.node_id, true) AND coalesce(d.node_id <> c.node_id, true) GROUP BY a.grp""",
)
def frame_assignment(spark, sf_dir):
    """Observations and nodes paired for the greatest total score, each frame by itself."""
    frames = scene(spark, sf_dir, "part").agg(F.greatest(F.lit(1), F.floor(F.count("*") / 4)).cast("long").alias("k"))  # one row
    o = scene(spark, sf_dir, "observations").select(F.floor(F.col("seq") / 4).cast("long").alias("grp"), "seq", "quality").crossJoin(frames).withColumn("at", F.col("grp") % F.col("k")).drop("k")
    n = scene(spark, sf_dir, "nodes").where("role = 'U'").select("node_id", "n", "quality_ema", F.floor(F.col("n") / 4).cast("long").alias("at"))
    score = F.round(F.exp(-F.pow(F.col("quality") - F.col("quality_ema"), 2) * 4) * (0.5 + (F.col("seq") * F.col("n")) % 17 / 34.0), 6)
    p = o.join(n, "at").select("grp", "seq", "node_id", score.alias("score")).where("score > 0.2")
    total = O.assigned(p, ["grp"], "seq", "node_id", "score").groupBy("grp").agg(F.sum("score").alias("total"))
    return o.join(n.select("at").distinct(), "at", "left_semi").select("grp").distinct().join(total, "grp", "left").select("grp", F.round(F.coalesce("total", F.lit(0.0)), 6).alias("total"))


@query(
    "eval_node_recall",
    with_sql("boxes3d") + """g AS (SELECT n AS gt, role, label, cx, cy, cz, half, scene FROM boxes3d), q AS (SELECT n AS pr, role, label, cx + 0.02 AS cx, cy - 0.26 AS cy, cz, half, scene FROM boxes3d),
    j AS (SELECT g.role, gt, pr FROM g JOIN q ON g.scene = q.scene AND g.role = q.role AND g.label = q.label AND abs(g.cx - q.cx) < g.half + q.half AND abs(g.cy - q.cy) < g.half + q.half AND abs(g.cz - q.cz) < g.half + q.half)
    SELECT g.role, count(DISTINCT g.gt) AS truth, count(DISTINCT j.gt) AS with_overlap FROM g LEFT JOIN j ON j.role = g.role AND j.gt = g.gt GROUP BY g.role""",
)
def eval_node_recall(spark, sf_dir):
    """Ground truth nodes with a prediction of their role and label that overlaps them."""
    from .evaluate import overlaps

    b = scene(spark, sf_dir, "boxes3d")
    g = b.select(F.col("n").alias("gt"), "scene", "role", "label", "cx", "cy", "cz", "half")
    p = b.select(F.col("n").alias("pr"), "scene", "role", "label", (F.col("cx") + 0.02).alias("cx"), (F.col("cy") - 0.26).alias("cy"), "cz", "half")
    hit = overlaps(g, p, ["scene", "role", "label"]).select("role", "gt").distinct()
    t = g.groupBy("role").agg(F.count_distinct("gt").alias("truth"))
    return t.join(hit.groupBy("role").agg(F.count("*").alias("with_overlap")), "role", "left").select("role", "truth", F.coalesce("with_overlap", F.lit(0)).alias("with_overlap"))


@query("eval_matching")
def eval_matching(spark, sf_dir):
    """One-to-one matches, as many as can be and of the greatest overlap, by role, with the micro recall."""
    from ..operators.aggregates import recall
    from .evaluate import overlaps

    b = scene(spark, sf_dir, "boxes3d")
    g = b.select(F.col("n").alias("gt"), "scene", "role", "label", "cx", "cy", "cz", "half")
    p = b.select(F.col("n").alias("pr"), "scene", "role", "label", (F.col("cx") + 0.02).alias("cx"), (F.col("cy") - 0.26).alias("cy"), "cz", "half")
    hits = O.assigned(overlaps(g, p, ["scene", "role", "label"]), ["scene", "role"], "gt", "pr", "iou", most=True)
    return recall(hits.select("role", "gt"), g.select("role", "gt"), ["role"])


def _greedy(order: str, conflict: str, tied: str = "false", columns: str = "d.frame_idx, d.det_id, d.role", pixel: int = 1) -> str:
    """SQL of greedy suppression: detections in order, each alive one drops its later conflicts (and itself if one is tied)."""
    return (
        with_sql("detections", recursive=True)
        + f"""d AS (SELECT *, row_number() OVER (PARTITION BY frame_idx ORDER BY {order}) AS rn, ((x2 - x1 + {pixel}) * (y2 - y1 + {pixel}))::DOUBLE AS area FROM detections),
    j AS (SELECT a.frame_idx, a.rn, b.rn AS other, greatest(0, least(a.x2, b.x2) - greatest(a.x1, b.x1) + {pixel}) * greatest(0, least(a.y2, b.y2) - greatest(a.y1, b.y1) + {pixel}) AS i, a.area AS aa, b.area AS ba, a.role AS ar, b.role AS br, a.label AS al, b.label AS bl, a.score AS sa, b.score AS sb FROM d a JOIN d b ON a.frame_idx = b.frame_idx AND b.rn > a.rn),
    c AS (SELECT frame_idx, rn, list(other) FILTER ({conflict}) AS later, list(other) FILTER ({conflict} AND {tied}) AS ties FROM j GROUP BY ALL),
    f(frame_idx, rn, gone) AS (SELECT DISTINCT frame_idx, 0::BIGINT, []::BIGINT[] FROM d UNION ALL SELECT f.frame_idx, f.rn + 1, CASE WHEN list_contains(f.gone, f.rn + 1) THEN f.gone
        ELSE list_concat(list_concat(f.gone, coalesce(c.later, [])), CASE WHEN len(list_filter(coalesce(c.ties, []), lambda x: NOT list_contains(f.gone, x))) > 0 THEN [f.rn + 1] ELSE [] END) END
        FROM f JOIN d ON d.frame_idx = f.frame_idx AND d.rn = f.rn + 1 LEFT JOIN c ON c.frame_idx = f.frame_idx AND c.rn = f.rn + 1),
    l AS (SELECT frame_idx, arg_max(gone, rn) AS gone FROM f GROUP BY frame_idx)
    SELECT {columns} FROM d JOIN l USING (frame_idx) WHERE NOT list_contains(gone, d.rn)"""
    )


@query("nms", _greedy("score DESC, det_id", "i / greatest(aa + ba - i, 1e-9) > 0.5", columns="d.frame_idx, d.det_id", pixel=0))
def nms(spark, sf_dir):
    """Greedy suppression in each frame, by score."""
    return O.suppressed(scene(spark, sf_dir, "detections"), ["frame_idx"], 0.5).select("frame_idx", "det_id")


@query("role_nms", _greedy("CASE role WHEN 'U' THEN 0 WHEN 'C' THEN 1 ELSE 2 END, score DESC, det_id", "i / (aa + ba - i + 1e-9) > 0.3", "ar = 'O' AND br = 'O' AND abs(sa - sb) <= 1e-6"))
def role_nms(spark, sf_dir):
    """Units suppress carriers and objects, carriers objects; two objects of one score that overlap both go."""
    return O.suppressed_by_role(scene(spark, sf_dir, "detections"), ["frame_idx"], 0.3).select("frame_idx", "det_id", "role")


@query("coverage_suppression", _greedy("score DESC, det_id", "ar = br AND (ar <> 'U' OR al = bl) AND i >= 0.95 * greatest(least(aa, ba), 1e-9)"))
def coverage_suppression(spark, sf_dir):
    return O.covered_away(scene(spark, sf_dir, "detections"), ["frame_idx"]).select("frame_idx", "det_id", "role")


@query("node_normals")
def node_normals(spark, sf_dir):
    """Normals of nodes' points about their median: sums in Spark, a 3 x 3 eigenvector a node."""
    return M.normals(scene(spark, sf_dir, "points"), "node")


@query("depth_clusters")
def depth_clusters(spark, sf_dir):
    """The main density cluster of each node's points."""
    return M.main_cluster(scene(spark, sf_dir, "points").select("node", "pid", "x", "y", "z"), "node", 0.03, 4).groupBy("node").agg(F.count("*").alias("n"))


@query("legacy_clusters")
def legacy_clusters(spark, sf_dir):
    """The points of each node that its main cluster holds, found on voxels; all where that is too small a share."""
    p = scene(spark, sf_dir, "points").select("node", "pid", "x", "y", "z")
    return M.in_main_cluster(p, "node", 0.02, 4, 0.3, 0.01).groupBy("node").agg(F.count("*").alias("n"))


@query("adaptive_clusters")
def adaptive_clusters(spark, sf_dir):
    """The points of each node in the cluster of its parent's depth, else nearest the image's center, at a radius that follows
    depth."""
    p = scene(spark, sf_dir, "points").select("node", "pid", "x", "y", (F.col("z") + 0.5).alias("z"))
    p = p.withColumns({"u": 500.0 * F.col("x") / F.col("z"), "v": 500.0 * F.col("y") / F.col("z"), "parent": F.when(F.col("node") % 2 == 0, F.lit(0.55)), "band": F.lit(0.025)})
    return M.in_best_cluster(p, "node", 500.0, (100.0, 100.0), pixels=60.0, high=0.1, least=4).groupBy("node").agg(F.count("*").alias("n"))


def _observed(spark, sf_dir):
    """Observations of many sequences, with points about their center, colours by label, boxes where a camera sees them, and
    as parents the objects and carriers that the frame shows at the same place."""
    o = scene(spark, sf_dir, "observations").withColumn("z", F.col("cz") + 1.5)
    sides = [(a, b, c) for a in (-0.02, 0.0, 0.02) for b in (-0.02, 0.02) for c in (-0.01, 0.01)]
    points = F.array(*[F.array(F.col("cx") + a, F.col("cy") + b, F.col("z") + c) for a, b, c in sides])
    u, v = 500.0 * F.col("cx") / F.col("z") + 320.0, 500.0 * F.col("cy") / F.col("z") + 240.0
    status = F.when(F.col("quality") >= 0.62, "reliable").when(F.col("quality") >= 0.38, "provisional").when(F.col("quality") >= 0.2, "low_quality").otherwise("rejected")
    features = o.select("label").distinct().withColumn("feature", mock_features(F.col("label")))
    role = F.when(F.col("label").isin("view", "signup"), "O").when(F.col("label") == "click", "C").otherwise("U")
    o = o.withColumns({"sequence": (F.col("seq") % 4 + 4 * F.floor(F.col("seq") / 2000)).cast("long"), "frame": F.floor(F.col("seq") / 16).cast("long"), "role": role})
    there = F.collect_list(F.struct("seq", "role")).over(Window.partitionBy("sequence", "frame", "node_id"))
    above = F.transform(F.filter(there, lambda x: (x["role"] < F.lit("U")) & (x["seq"] != F.col("seq"))), lambda x: x["seq"])
    o = o.join(features, "label")
    return o.select("sequence", F.col("frame").alias("frame_idx"), F.col("seq").alias("det_id"), "role", "label", "score", "quality", status.alias("status"), "imputed", F.lit(False).alias("border"), points.alias("points"), F.col("feature").alias("hist"), "feature", (u - 8).alias("x1"), (v - 8).alias("y1"), (u + 8).alias("x2"), (v + 8).alias("y2"), *[F.lit(0.0).alias(f"t{c}") for c in "xyz"], F.array_sort(above).alias("parents"))


@query("track_map")
def track_map(spark, sf_dir):
    """Observations of sequences tracked frame by frame: match, fuse, keep identity, birth."""
    return K.tracked(_observed(spark, sf_dir), settings=K.Settings(identity=True))


@query("track_nodes")
def track_nodes(spark, sf_dir):
    """The nodes that the tracker leaves."""
    return K.built(_observed(spark, sf_dir))


@query("track_covisibility")
def track_covisibility(spark, sf_dir):
    """Nodes that the tracker's frames show together."""
    return K.covisible(K.replayed(_observed(spark, sf_dir)))


@query("track_consolidation")
def track_consolidation(spark, sf_dir):
    """Duplicate tracks merged to a fixpoint: source, target."""
    b = scene(spark, sf_dir, "boxes3d")
    grown = b.withColumns({f"b{c}{k}": F.col(f"c{c}") + (2 * k - 3) * 2.0 * F.col("half") for c in "xyz" for k in (1, 2)})
    return M.consolidated(grown, b.select((F.col("scene") * 7 + F.col("n") % 7).alias("frame"), "node_id"))


@query(
    "carrier_resolution",
    with_sql("edge_candidates", "boxes3d") + """a AS (SELECT parent_node_id AS c, child_node_id AS u, count(*) FILTER (selected) AS strong, max(coverage) * 3 AS own, bool_or(semantic_source = 'atlas') AS atl, bool_or(semantic_source = 'frame_result') AS fr, bool_or(semantic_source = 'allowed_parent_map') AS al FROM edge_candidates WHERE edge_type = 'C-U' GROUP BY ALL),
    g AS (SELECT a.*, CASE WHEN atl THEN 0.9 WHEN fr THEN 0.85 WHEN al THEN 0.75 END::DOUBLE AS prior, sqrt(pow(greatest(0, p.bx1 - q.bx2, q.bx1 - p.bx2), 2) + pow(greatest(0, p.by1 - q.by2, q.by1 - p.by2), 2) + pow(greatest(0, p.bz1 - q.bz2, q.bz1 - p.bz2), 2)) AS gap FROM a JOIN boxes3d p ON p.node_id = a.c JOIN boxes3d q ON q.node_id = a.u),
    s AS (SELECT c, u, round(0.3 * prior + 0.3 * exp(-gap / 0.03) + 0.4 * CASE WHEN strong > 0 THEN 0.75 * (1 - exp(-strong)) + 0.25 * least(1, own / 3) ELSE 0.15 * least(1, own / 3) END, 6) AS score, round(gap, 6) AS gap FROM g WHERE prior IS NOT NULL AND gap <= 1.5),
    w AS (SELECT *, row_number() OVER p AS rn, round(score - lead(score) OVER p, 6) AS margin FROM s WINDOW p AS (PARTITION BY u ORDER BY score DESC, gap, c))
    SELECT u AS unit, c AS carrier, score, margin, CASE WHEN score <= 0.8 OR coalesce(margin < 0.05, false) THEN 'provisional' ELSE 'confirmed' END AS status FROM w WHERE rn = 1""",
)
def carrier_resolution(spark, sf_dir):
    """The carrier of each unit: prior, distance and observation scored, one chosen, confirmed or provisional."""
    return M.carriers(scene(spark, sf_dir, "edge_candidates"), scene(spark, sf_dir, "boxes3d"), reach=1.5)


_CHOSEN = """a AS (SELECT child_node_id, parent_node_id, edge_type, count(*) FILTER (selected) AS n, min(relation_text) AS relation_text FROM edge_candidates WHERE pn % 3 <> 0 OR edge_type <> 'O-C' GROUP BY ALL),
    f AS (SELECT edge_type, parent_node_id, child_node_id, relation_text, n < 20 AS provisional FROM a QUALIFY row_number() OVER (PARTITION BY child_node_id ORDER BY n DESC, parent_node_id, edge_type) = 1)"""


_RUN = (
    with_sql("edge_candidates", "nodes")
    + _CHOSEN
    + """, o AS (SELECT child_node_id AS c, parent_node_id AS owner FROM f WHERE edge_type = 'O-C'),
    lo AS (SELECT f.edge_type, f.parent_node_id, f.child_node_id, f.relation_text, CASE WHEN f.provisional THEN 'O000000001' ELSE owner END AS object_parent_id, owner AS carrier_object_parent_id
        FROM f LEFT JOIN o ON o.c = f.parent_node_id AND f.edge_type = 'C-U' WHERE right(f.child_node_id, 1) NOT IN ('2', '6', '7')),
    el AS (SELECT node_id, label, role FROM nodes WHERE state = 'stable'),
    ca AS (SELECT e.edge_type, e.parent_node_id, e.child_node_id, e.s2d_score, e.relation_text, e.coverage >= 0.3 AS pass_prefilter, e.s2d_score IS NOT NULL AS s2d_available,
        CASE WHEN p.state = 'rejected' OR c.state = 'rejected' THEN 'canonical_node_missing' ELSE '' END AS reason
        FROM edge_candidates e LEFT JOIN nodes p ON p.node_id = e.parent_node_id LEFT JOIN nodes c ON c.node_id = e.child_node_id WHERE (e.pn * 3 + e.cn) % 5 = 0 AND (e.cn % 4 <> 2 OR (e.edge_type <> 'C-U' AND e.coverage < 0.9 AND (e.cn % 8 <> 2 OR e.s2d_score IS NULL))))"""
)


def _run(spark, sf_dir):
    """A run's eligible nodes, candidates, and chosen edges of some children."""
    e, n = scene(spark, sf_dir, "edge_candidates"), scene(spark, sf_dir, "nodes")
    f = _chosen(e)
    owner = f.where("edge_type = 'O-C'").select(F.col("child_node_id").alias("parent_node_id"), F.col("parent_node_id").alias("owner"), F.lit("C-U").alias("edge_type"))
    local = f.join(owner, ["parent_node_id", "edge_type"], "left").where(~F.substring("child_node_id", -1, 1).isin("2", "6", "7"))
    local = local.select("edge_type", "parent_node_id", "child_node_id", "relation_text", F.when(F.col("provisional"), "O000000001").otherwise(F.col("owner")).alias("object_parent_id"), F.col("owner").alias("carrier_object_parent_id"))
    out = n.where("state = 'rejected'").select("node_id")
    c = e.where("(pn * 3 + cn) % 5 = 0 AND (cn % 4 <> 2 OR (edge_type <> 'C-U' AND coverage < 0.9 AND (cn % 8 <> 2 OR s2d_score IS NULL)))")
    for side in ("parent", "child"):
        c = c.join(out.select(F.col("node_id").alias(f"{side}_node_id"), F.lit(True).alias(f"{side}_gone")), f"{side}_node_id", "left")
    c = c.withColumns({"reason": F.when(F.col("parent_gone") | F.col("child_gone"), "canonical_node_missing").otherwise(""), "pass_prefilter": F.col("coverage") >= 0.3, "s2d_available": F.col("s2d_score").isNotNull()})
    return n.where("state = 'stable'").select("node_id", "label", "role"), c, local


def _chosen(e):
    a = e.where("pn % 3 <> 0 or edge_type <> 'O-C'").groupBy("child_node_id", "parent_node_id", "edge_type").agg(F.count_if("selected").alias("n"), F.min("relation_text").alias("relation_text"))
    best = Window.partitionBy("child_node_id").orderBy(F.desc("n"), "parent_node_id", "edge_type")
    return a.withColumn("rn", F.row_number().over(best)).where("rn = 1").withColumn("provisional", F.col("n") < 20)


_OPEN = """k AS (SELECT ca.child_node_id AS node_id, count(*) AS candidates, count(*) FILTER (p.node_id IS NOT NULL) AS mapped, count(*) FILTER (p.node_id IS NOT NULL AND edge_type IN ('O-C', 'O-U')) AS objects,
        count(*) FILTER (p.node_id IS NOT NULL AND edge_type IN ('O-C', 'O-U') AND s2d_score IS NOT NULL) AS measured, count(*) FILTER (p.node_id IS NOT NULL AND edge_type IN ('O-C', 'O-U') AND pass_prefilter) AS passed,
        count(*) FILTER (p.node_id IS NOT NULL AND edge_type = 'C-U') AS carriers FROM ca LEFT JOIN el p ON p.node_id = ca.parent_node_id GROUP BY 1),
    op AS (SELECT el.node_id, el.label, el.role, coalesce(candidates, 0) AS candidates, coalesce(mapped, 0) AS mapped, coalesce(objects, 0) AS objects, coalesce(measured, 0) AS measured, coalesce(passed, 0) AS passed, coalesce(carriers, 0) AS carriers
        FROM el LEFT JOIN k USING (node_id) WHERE role <> 'O' AND el.node_id NOT IN (SELECT child_node_id FROM lo))"""


@query(
    "completeness_report",
    _RUN + ", " + _OPEN + """, q AS (SELECT count(*) AS candidates, count(*) FILTER (edge_type IN ('O-C', 'O-U') AND pass_prefilter) AS prefilter, count(*) FILTER (edge_type IN ('O-C', 'O-U') AND pass_prefilter AND s2d_available) AS available, count(*) FILTER (reason <> '') AS unresolved FROM ca),
    h AS (SELECT child_node_id FROM ca WHERE edge_type IN ('O-C', 'O-U') AND trim(relation_text) <> '' UNION SELECT child_node_id FROM lo WHERE edge_type = 'C-U' AND carrier_object_parent_id IS NOT NULL),
    z AS (SELECT q.*, (SELECT count(*) FROM el WHERE role <> 'O' AND node_id NOT IN (SELECT child_node_id FROM h)) AS orphans, (SELECT count(*) FROM op) AS alone,
        (SELECT count(*) FROM lo WHERE parent_node_id NOT IN (SELECT node_id FROM el) OR child_node_id NOT IN (SELECT node_id FROM el)) AS illegal, (SELECT count(*) FROM lo WHERE trim(relation_text) = '') AS untold,
        (SELECT count(*) FROM (SELECT child_node_id FROM lo GROUP BY 1 HAVING count(*) > 1)) AS many, (SELECT count(*) FROM lo WHERE edge_type = 'C-U' AND object_parent_id <> carrier_object_parent_id) AS crossed FROM q),
    r AS (SELECT *, list_filter([CASE WHEN prefilter > available THEN 's2d_coverage_incomplete' END, CASE WHEN unresolved > 0 THEN 'endpoint_mapping_sparse' END, CASE WHEN orphans > 0 THEN 'graph_eligible_child_has_no_object_candidate' END,
        CASE WHEN alone > 0 THEN 'graph_eligible_child_has_no_local_parent' END, CASE WHEN illegal > 0 THEN 'illegal_node_id' END, CASE WHEN untold > 0 THEN 'functional_predicate_missing' END, CASE WHEN many > 0 THEN 'multiple_immediate_parents' END,
        CASE WHEN crossed > 0 THEN 'cross_object_carrier_unit_edge' END], lambda x: x IS NOT NULL) AS why FROM z)
    SELECT candidates, prefilter, available, unresolved, orphans, alone, len(why) = 0 AND candidates > 0 AS complete, array_to_string(why, ',') AS reasons FROM r""",
)
def completeness_report(spark, sf_dir):
    """Whether a run's graph is complete, and why not."""
    nodes, candidates, local = _run(spark, sf_dir)
    return R.completeness(nodes, candidates, local, local)


@query(
    "link_diagnostics",
    _RUN + ", " + _OPEN + """ SELECT node_id, label, role, CASE WHEN candidates = 0 THEN 'no_parent_candidate' WHEN mapped = 0 THEN 'parent_unmapped_or_ineligible' WHEN carriers > 0 THEN 'carrier_candidate_rejected_by_local_evidence_or_conflict'
        WHEN objects > 0 AND measured = 0 AND passed > 0 THEN 'object_s2d_unavailable_after_prefilter' WHEN objects > 0 AND measured = 0 THEN 'object_candidate_not_instance_validated' ELSE 'parent_resolution_unavailable' END AS reason,
        node_id NOT IN (SELECT parent_node_id FROM lo UNION SELECT child_node_id FROM lo) AS isolated, candidates, mapped, measured, carriers FROM op""",
)
def link_diagnostics(spark, sf_dir):
    """Eligible carriers and units without a parent, and the first reason for it."""
    nodes, candidates, local = _run(spark, sf_dir)
    return R.unlinked(nodes, candidates, local, local)


_NODE_OF = "role || lpad(((frame_idx * 8 + det_id) % 2500 + 1)::VARCHAR, 9, '0')"


@query(
    "unresolved_endpoints",
    with_sql("relations_2d", "nodes") + f"""a AS (SELECT frame_idx, det_id, {_NODE_OF} AS node_id, (frame_idx * 8 + det_id) % 2500 + 1 AS k, role FROM detections WHERE frame_idx % 11 <> 0 AND (frame_idx * 3 + det_id) % 5 <> 0),
    m AS (SELECT frame_idx, det_id, CASE WHEN n.node_id IS NULL THEN a.node_id ELSE a.role || lpad((k - k % 5)::VARCHAR, 9, '0') END AS node_id FROM a LEFT JOIN nodes n ON n.node_id = a.node_id),
    fr AS (SELECT DISTINCT frame_idx FROM detections WHERE frame_idx % 11 <> 0),
    j AS (SELECT r.frame_idx, r.edge_type, r.parent_det_id, r.child_det_id, p.node_id AS pn, c.node_id AS cn, x.node_id AS px, y.node_id AS cx, fr.frame_idx AS seen FROM relations_2d r LEFT JOIN fr USING (frame_idx)
        LEFT JOIN m p ON p.frame_idx = r.frame_idx AND p.det_id = r.parent_det_id LEFT JOIN m c ON c.frame_idx = r.frame_idx AND c.det_id = r.child_det_id LEFT JOIN nodes x ON x.node_id = p.node_id LEFT JOIN nodes y ON y.node_id = c.node_id),
    w AS (SELECT *, CASE WHEN seen IS NULL THEN 'association_frame_missing' WHEN pn IS NULL AND cn IS NULL THEN 'both_detection_endpoints_unmapped' WHEN pn IS NULL THEN 'parent_detection_endpoint_unmapped'
        WHEN cn IS NULL THEN 'child_detection_endpoint_unmapped' WHEN px IS NULL OR cx IS NULL THEN 'canonical_node_missing' ELSE '' END AS reason FROM j)
    SELECT frame_idx, edge_type, parent_det_id, child_det_id, reason FROM w WHERE reason <> ''""",
)
def unresolved_endpoints(spark, sf_dir):
    """Candidates whose detections lead to no node after tracks were merged, and the first reason for it."""
    k = (F.col("frame_idx") * 8 + F.col("det_id")) % 2500 + 1
    d = scene(spark, sf_dir, "detections").where("frame_idx % 11 <> 0").select("frame_idx", "det_id", F.concat("role", F.lpad(k.cast("string"), 9, "0")).alias("node_id"))
    kept = F.when((F.col("frame_idx") * 3 + F.col("det_id")) % 5 != 0, F.col("det_id"))
    n = scene(spark, sf_dir, "nodes")
    steps = n.where("n % 5 <> 0").select(F.col("node_id").alias("source"), F.concat("role", F.lpad((F.col("n") - 1).cast("string"), 9, "0")).alias("target"))
    out = R.endpoints(
        scene(spark, sf_dir, "relations_2d").withColumnRenamed("frame_idx", "frame_key").select("frame_key", "edge_type", "parent_det_id", "child_det_id"),
        d.select(F.col("frame_idx").alias("frame_key"), kept.alias("det_id"), "node_id"),
        X.canonical(steps),
        n.select("node_id", "state"),
    )
    return out.where("reason <> ''").select(F.col("frame_key").alias("frame_idx"), "edge_type", "parent_det_id", "child_det_id", "reason")


@query("completed_objects")
def completed_objects(spark, sf_dir):
    """Objects of deferred labels, made of stable carriers that share owner hints, overlap, lie near and in one plane."""
    b = scene(spark, sf_dir, "boxes3d").where("role = 'C' and state = 'stable'")
    normal = F.array(F.cos(F.col("n") * 0.05), F.sin(F.col("n") * 0.05), F.lit(0.0))
    nodes = b.select("node_id", normal.alias("normal"), *[F.col(f"b{c}").alias(c) for c in M.BOX])
    deferred = spark.createDataFrame([("kitchen cabinet",), ("wooden desk",)], "label string")
    owned = C.owned_by(b.select("scene", "node_id", "label"), scene(spark, sf_dir, "atlas"), deferred)
    node = F.concat(F.lit("C"), F.lpad((F.floor(F.col("frame_idx") / 3) * 3 + F.col("det_id") + 1).cast("long").cast("string"), 9, "0"))
    d = scene(spark, sf_dir, "detections").where("role = 'C'").withColumn("node_id", node)
    seen = d.groupBy("frame_idx", "node_id").agg(F.min(F.struct("det_id", "x1", "y1", "x2", "y2")).alias("m")).select("frame_idx", "node_id", "m.*")
    r = scene(spark, sf_dir, "relations_2d").where("edge_type = 'O-C' and contain > 0.1").select("frame_idx", F.col("child_det_id").alias("det_id"), F.col("parent_label").alias("label"), "parent_det_id")
    hints = C.hinted(owned, d.select("frame_idx", "det_id", "node_id").join(r, ["frame_idx", "det_id"]).drop("det_id"))
    links = C.membership_links(hints, seen.drop("det_id"), nodes, gap=0.6, dot=0.9)
    return C.completed(hints, links, nodes, scene(spark, sf_dir, "nodes").select("scene", "node_id"))


@query("owner_distance", with_sql("boxes3d") + "z AS (SELECT 1) SELECT a.role, count(*) AS n, round(min(sqrt(pow(a.cx - b.cx, 2) + pow(a.cy - b.cy, 2) + pow(a.cz - b.cz, 2))), 6) AS least, round(median(sqrt(pow(a.cx - b.cx, 2) + pow(a.cy - b.cy, 2) + pow(a.cz - b.cz, 2))), 6) AS middle, round(max(sqrt(pow(a.cx - b.cx, 2) + pow(a.cy - b.cy, 2) + pow(a.cz - b.cz, 2))), 6) AS most FROM boxes3d a JOIN boxes3d b ON a.n = b.n AND b.role = 'O' AND a.role <> 'O' GROUP BY a.role")
def owner_distance(spark, sf_dir):
    b = scene(spark, sf_dir, "boxes3d")
    o = b.where("role = 'O'").select("n", *[F.col(c).alias(f"o_{c}") for c in ("cx", "cy", "cz")])
    d = b.where("role <> 'O'").join(o, "n").withColumn("d", G.norm(*[F.col(c) - F.col(f"o_{c}") for c in ("cx", "cy", "cz")]))
    return d.groupBy("role").agg(F.count("*").alias("n"), F.round(F.min("d"), 6).alias("least"), F.round(F.median("d"), 6).alias("middle"), F.round(F.max("d"), 6).alias("most"))


@query(
    "final_hierarchy",
    with_sql("edge_candidates") + _CHOSEN + """, o AS (SELECT child_node_id AS c, parent_node_id AS owner, provisional AS unsure FROM f WHERE edge_type = 'O-C')
    SELECT edge_type, parent_node_id, child_node_id, CASE WHEN trim(relation_text) <> '' THEN 'complete' ELSE 'pending' END AS functional_status, CASE WHEN edge_type = 'C-U' THEN owner END AS object_parent_id, CASE WHEN edge_type = 'C-U' THEN CASE WHEN owner IS NULL THEN 'unknown' WHEN unsure THEN 'provisional' ELSE 'confirmed' END END AS object_parent_status FROM f LEFT JOIN o ON o.c = f.parent_node_id""",
)
def final_hierarchy(spark, sf_dir):
    """The chosen parent of each child as the final graph's edge."""
    return M.final_hierarchy(_chosen(scene(spark, sf_dir, "edge_candidates")))
