"""Queries: artifacts, masks, checks, lifting, relation decisions, recall by subset."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .. import schema as C
from ..fixtures import scene, with_sql
from ..functions import geometry as G
from ..operators import artifacts as A
from ..operators import masks as K
from ..operators import windows as W
from ..registry import query
from . import lifting as I

DET = with_sql("detections")


@query("detection_checks", DET + "z AS (SELECT 1) SELECT rule, n FROM (SELECT 'role' AS rule, count(*) FILTER (role NOT IN ('O', 'C', 'U')) AS n FROM detections UNION ALL SELECT 'score', count(*) FILTER (NOT score BETWEEN 0 AND 1) FROM detections UNION ALL SELECT 'box', count(*) FILTER (NOT (x2 > x1 AND y2 > y1)) FROM detections UNION ALL SELECT 'finite', 0 UNION ALL SELECT 'label', count(*) FILTER (trim(label) = '') FROM detections)")
def detection_checks(spark, sf_dir):
    return C.violations(scene(spark, sf_dir, "detections"), C.detection_rules())


@query("dense_id_check", DET + "z AS (SELECT 1) SELECT frame_idx, count(*) AS n FROM detections GROUP BY frame_idx HAVING count(*) <> count(DISTINCT det_id) OR min(det_id) <> 0 OR max(det_id) <> count(*) - 1")
def dense_id_check(spark, sf_dir):
    return C.dense_ids(scene(spark, sf_dir, "detections")).select("frame_idx", "n")


_RUNS = "runs AS (SELECT frame_idx, det_id, y1 + i AS row, x1 + i % 3 AS start, greatest(0, x2 - x1 - 2 * (i % 3)) AS length FROM detections, (SELECT unnest(range(12)) AS i) WHERE y1 + i < y2 AND x2 - x1 - 2 * (i % 3) > 0)"


def _runs(spark, sf_dir):
    d = scene(spark, sf_dir, "detections").withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(11))))
    n = F.col("x2") - F.col("x1") - 2 * (F.col("i") % 3)
    return d.where((F.col("y1") + F.col("i") < F.col("y2")) & (n > 0)).select("frame_idx", "det_id", (F.col("y1") + F.col("i")).cast("int").alias("row"), (F.col("x1") + F.col("i") % 3).cast("int").alias("start"), n.cast("int").alias("length"))


@query(
    "mask_coverage",
    with_sql("relations_2d") + _RUNS + """, p AS (SELECT frame_idx, parent_det_id, child_det_id FROM relations_2d), a AS (SELECT frame_idx, det_id, sum(length) AS area FROM runs GROUP BY ALL),
    b AS (SELECT p.*, sum(greatest(0, least(x.start + x.length, y.start + y.length) - greatest(x.start, y.start))) AS shared FROM p JOIN runs x ON x.frame_idx = p.frame_idx AND x.det_id = p.parent_det_id JOIN runs y ON y.frame_idx = p.frame_idx AND y.det_id = p.child_det_id AND y.row = x.row GROUP BY ALL)
    SELECT p.frame_idx, p.parent_det_id, p.child_det_id, round(CASE WHEN area > 0 THEN coalesce(shared, 0) / area ELSE 0 END, 6)::DOUBLE AS coverage FROM p LEFT JOIN b USING (frame_idx, parent_det_id, child_det_id) LEFT JOIN a ON a.frame_idx = p.frame_idx AND a.det_id = p.child_det_id""",
)
def mask_coverage(spark, sf_dir):
    p = scene(spark, sf_dir, "relations_2d").select("frame_idx", "parent_det_id", "child_det_id")
    return K.coverage(_runs(spark, sf_dir), p).withColumn("coverage", F.round("coverage", 6)).select("frame_idx", "parent_det_id", "child_det_id", "coverage")


@query("mask_main_part", DET + _RUNS + " SELECT frame_idx, det_id, sum(length)::BIGINT AS area FROM runs GROUP BY ALL")
def mask_main_part(spark, sf_dir):
    """These masks are of one part each, so the main part is the mask."""
    return K.areas(K.shaped(_runs(spark, sf_dir), "main"))


@query("mask_support")
def mask_support(spark, sf_dir):
    """The area in which each object or carrier may hold children, from a mask with gaps: parts, holes, closing, hull."""
    d = scene(spark, sf_dir, "detections").where("role <> 'U'").select("frame_idx", "det_id", *[F.col(c).cast("int").alias(c) for c in ("x1", "y1", "x2", "y2")])
    r = _runs(spark, sf_dir).where("(row + det_id) % 5 <> 3")
    return K.areas(K.support(r.join(d.select("frame_idx", "det_id"), ["frame_idx", "det_id"], "left_semi"), d, 3, 640, 480))


@query(
    "relation_decision",
    with_sql("relations_2d") + """m AS (SELECT *, least(1, contain + child_det_id * 0.01) AS mask FROM relations_2d), p AS (SELECT *, count(*) OVER c AS n, row_number() OVER (PARTITION BY frame_idx, edge_type, child_det_id ORDER BY mask DESC, parent_det_id) AS rn, lead(mask) OVER (PARTITION BY frame_idx, edge_type, child_det_id ORDER BY mask DESC, parent_det_id) AS second FROM m WHERE pass_threshold WINDOW c AS (PARTITION BY frame_idx, edge_type, child_det_id))
    SELECT frame_idx, edge_type, child_det_id, CASE WHEN n = 1 OR (mask >= CASE WHEN child_role = 'U' THEN 0.2 ELSE 0.7 END AND round(mask - second, 9) >= 0.1) THEN parent_det_id END AS parent_det_id, CASE WHEN n = 1 THEN 'single' WHEN mask >= CASE WHEN child_role = 'U' THEN 0.2 ELSE 0.7 END AND round(mask - second, 9) >= 0.1 THEN 'mask' ELSE 'ambiguous' END AS decision FROM p WHERE rn = 1""",
)
def relation_decision(spark, sf_dir):
    """One parent a child and type: the only passing one, else the best mask if good and clear of the second."""
    r = scene(spark, sf_dir, "relations_2d").withColumn("mask", F.least(F.lit(1.0), F.col("contain") + F.col("child_det_id") * 0.01))
    return I.decided(r)


@query(
    "lifted_observations",
    with_sql("points", "depth_samples") + """s AS (SELECT p.node, p.x, p.y, d.depth AS z, p.pid FROM points p JOIN depth_samples d USING (pid) WHERE d.depth BETWEEN 0.1 AND 10), m AS (SELECT node, median(z) AS mid FROM s GROUP BY node), a AS (SELECT node, median(abs(z - mid)) AS mad FROM s JOIN m USING (node) GROUP BY node),
    k AS (SELECT s.node, (x * 1000 - 100) * z / 500 AS wx, (y * 1000 - 80) * z / 500 AS wy, z AS wz FROM s JOIN m USING (node) JOIN a USING (node) WHERE abs(z - mid) <= greatest(0.025, 3 * greatest(mad, 0.002)))
    SELECT node, count(*) AS n, round(avg(wx), 6) AS cx, round(avg(wy), 6) AS cy, round(avg(wz), 6) AS cz, round(quantile_cont(wx, 0.02), 6) AS x1, round(quantile_cont(wx, 0.98), 6) AS x2 FROM k GROUP BY node HAVING count(*) >= 8""",
)
def lifted_observations(spark, sf_dir):
    """Pixels with depth lifted to points: depth band about the median, back-projection, centroid and robust bounds."""
    px = scene(spark, sf_dir, "points").join(scene(spark, sf_dir, "depth_samples").select("pid", "depth"), "pid").select("node", "pid", (F.col("x") * 1000).alias("u"), (F.col("y") * 1000).alias("v"), F.col("depth").alias("z"))
    o = I.lifted(px, "node", (500.0, 500.0, 100.0, 80.0), 8, axes="x")
    return o.select("node", "n", *[F.round(c, 6).alias(c) for c in ("cx", "cy", "cz", "x1", "x2")])


@query("candidate_hashes", with_sql("edge_candidates") + """z AS (SELECT 1) SELECT DISTINCT frame_key, edge_type, parent_node_id, child_node_id, sha256('["' || frame_key || '","' || edge_type || '","' || parent_node_id || '","' || child_node_id || '"]') AS candidate_hash FROM edge_candidates""")
def candidate_hashes(spark, sf_dir):
    e = scene(spark, sf_dir, "edge_candidates").select("frame_key", "edge_type", "parent_node_id", "child_node_id").distinct()
    return e.withColumn("candidate_hash", A.candidate_hash(*[A.quoted(F.col(c)) for c in e.columns]))


@query(
    "cached_scores",
    with_sql("edge_candidates") + """c AS (SELECT evidence_id, CASE WHEN coverage <= 0.9 THEN 'gcamc_below_threshold' ELSE '' END AS fail FROM edge_candidates), k AS (SELECT evidence_id, s2d_score FROM edge_candidates WHERE evidence_id % 3 = 0 AND s2d_score IS NOT NULL)
    SELECT CASE WHEN k.s2d_score IS NOT NULL THEN '' WHEN fail <> '' THEN fail ELSE 'cache_miss' END AS error, count(*) AS n, count(k.s2d_score) AS scored FROM c LEFT JOIN k USING (evidence_id) GROUP BY 1""",
)
def cached_scores(spark, sf_dir):
    e = scene(spark, sf_dir, "edge_candidates")
    c = e.select(F.col("evidence_id").alias("cache_key"), F.when(F.col("coverage") <= 0.9, "gcamc_below_threshold").otherwise("").alias("fail_reason"))
    k = e.where("evidence_id % 3 = 0").select(F.col("evidence_id").alias("cache_key"), "s2d_score")
    return A.scored(c, k).groupBy("error").agg(F.count("*").alias("n"), F.count("s2d_score").alias("scored"))


@query(
    "mock_label_features",
    with_sql("nodes") + """l AS (SELECT DISTINCT label FROM nodes), s AS (SELECT label, list_sum(list_transform(range(1, length(label) + 1), lambda i: i * ascii(label[i]))) AS seed FROM l), v AS (SELECT label, list_transform(range(8), lambda i: ((seed + 37 * i) % 101) / 100.0::DOUBLE) AS v FROM s)
    SELECT label, round(v[1] / sqrt(list_dot_product(v, v)), 6) AS first, round(v[8] / sqrt(list_dot_product(v, v)), 6) AS last FROM v""",
)
def mock_label_features(spark, sf_dir):
    n = scene(spark, sf_dir, "nodes").select("label").distinct().withColumn("v", A.mock_features(F.col("label")))
    return n.select("label", F.round(F.get("v", F.lit(0)), 6).alias("first"), F.round(F.get("v", F.lit(7)), 6).alias("last"))


@query(
    "predicate_sources",
    with_sql("edge_candidates") + """e AS (SELECT parent_node_id, child_node_id, CASE WHEN pn % 3 = 0 AND trim(relation_text) <> '' THEN relation_text END AS own, CASE WHEN pn % 3 = 1 AND relation_text = 'Rotate' THEN relation_text END AS past, CASE WHEN pn % 5 = 2 THEN 'open' END AS prior FROM edge_candidates WHERE edge_type <> 'O-C'),
    g AS (SELECT parent_node_id, child_node_id, count(own) AS n, count(past) AS m, count(DISTINCT CASE own WHEN 'turn the handle' THEN 'rotate handle' WHEN 'twist handle' THEN 'rotate handle' ELSE lower(own) END) AS k, min(past) AS past, max(prior) AS prior, arg_min(own, (length(own), own)) AS own FROM e GROUP BY ALL)
    SELECT parent_node_id, child_node_id, CASE WHEN n > 0 THEN CASE WHEN k = 1 THEN own ELSE '' END WHEN m > 0 THEN past ELSE coalesce(prior, '') END AS relation_text, CASE WHEN n > 0 THEN CASE WHEN k = 1 THEN 'instance' ELSE 'instance_conflict' END WHEN m > 0 THEN 'pair_history' WHEN prior IS NOT NULL THEN 'contextual_semantics' ELSE 'unresolved' END AS predicate_source FROM g""",
)
def predicate_sources(spark, sf_dir):
    """Relation texts by instance, then pair history, then prior, with their source."""
    e = scene(spark, sf_dir, "edge_candidates").where("edge_type <> 'O-C'")
    ev = e.select("parent_node_id", "child_node_id", F.when((F.col("pn") % 3 == 0) & (F.trim("relation_text") != ""), F.col("relation_text")).alias("instance_text"), F.when((F.col("pn") % 3 == 1) & (F.col("relation_text") == "Rotate"), F.col("relation_text")).alias("history_text"), F.when(F.col("pn") % 5 == 2, "open").alias("prior"))
    return A.predicate_text(ev, ["parent_node_id", "child_node_id"], F.col("prior"))


@query("directed_remote_pairs", with_sql("nodes") + "p AS (SELECT DISTINCT a.label AS f, b.label AS t FROM nodes a JOIN nodes b ON a.n = b.n) SELECT CASE WHEN t LIKE '%handle%' THEN t ELSE f END AS from_label, CASE WHEN t LIKE '%handle%' THEN f ELSE t END AS to_label, 'works' AS relation FROM p WHERE f <> t AND NOT (f LIKE '%handle%' AND t LIKE '%handle%')")
def directed_remote_pairs(spark, sf_dir):
    n = scene(spark, sf_dir, "nodes").select("n", "label")
    p = n.select("n", F.col("label").alias("from_label")).join(n.select("n", F.col("label").alias("to_label")), "n").select("from_label", "to_label", F.lit(" works ").alias("relation")).distinct()
    return A.directed(p, ["handle"])


@query("remote_evidence", with_sql("relations_2d") + "z AS (SELECT frame_idx, 'n' || parent_det_id AS s, 'n' || child_det_id AS t, contain FROM relations_2d WHERE edge_type = 'O-C') SELECT s AS source, t AS target, count(*) AS count, round(sum(contain), 6) AS evidence, count(DISTINCT frame_idx) AS frames FROM z GROUP BY ALL")
def remote_evidence(spark, sf_dir):
    d = scene(spark, sf_dir, "detections").select(F.col("frame_idx").alias("frame_key"), "det_id", F.concat(F.lit("n"), F.col("det_id").cast("string")).alias("node_id"))
    r = scene(spark, sf_dir, "relations_2d").where("edge_type = 'O-C'").select(F.col("frame_idx").alias("frame_key"), F.col("parent_det_id").alias("from_det"), F.col("child_det_id").alias("to_det"), F.col("contain").alias("score"))
    return A.remote_evidence(r, d)


@query("instance_boxes", with_sql("points") + "a AS (SELECT node AS annot_id, pid FROM points) SELECT annot_id, count(*) AS n, min(x) AS x1, max(x) AS x2, min(y) AS y1, max(y) AS y2, min(z) AS z1, max(z) AS z2 FROM a JOIN points USING (pid) GROUP BY annot_id")
def instance_boxes(spark, sf_dir):
    p = scene(spark, sf_dir, "points")
    a = p.groupBy(F.col("node").alias("annot_id")).agg(F.collect_list("pid").alias("indices"))
    return A.instance_boxes(a, p.select(F.col("pid").alias("idx"), "x", "y", "z"))


@query("truth_relations", "WITH a AS (SELECT c_custkey AS id, c_nationkey AS s FROM customer WHERE c_nationkey % 3 = 0) SELECT o_orderkey, o_custkey AS first, o_custkey + 1 AS second FROM orders JOIN customer ON c_custkey = o_custkey WHERE c_nationkey % 3 = 0 AND EXISTS (SELECT 1 FROM a WHERE a.id = o_custkey + 1 AND a.s = c_nationkey)")
def truth_relations(spark, sf_dir):
    c = scene(spark, sf_dir, "customer").select(F.col("c_custkey").alias("annot_id"), F.col("c_nationkey").alias("scene_id"))
    o = scene(spark, sf_dir, "orders").join(c.withColumnRenamed("annot_id", "o_custkey"), "o_custkey").select("o_orderkey", "scene_id", F.col("o_custkey").alias("first"), (F.col("o_custkey") + 1).alias("second"))
    return A.truth(c, o, c.where("scene_id % 3 = 0").select("scene_id").distinct())[1].select("o_orderkey", "first", "second")


@query(
    "recall_by_subset",
    with_sql("nodes") + """g AS (SELECT node_id, role, n % 3 <> 0 AS hit, n % 4 = 0 AS tabletop FROM nodes), s AS (SELECT role AS subset, hit FROM g UNION ALL SELECT 'tabletop', hit FROM g WHERE tabletop UNION ALL SELECT 'overall', hit FROM g) SELECT subset, count(*) AS truth, count(*) FILTER (hit) AS matched, round(count(*) FILTER (hit) / count(*)::DOUBLE, 6) AS recall FROM s GROUP BY subset""",
)
def recall_by_subset(spark, sf_dir):
    """Recall of overlapping subsets: each row is counted in all of its own."""
    n = scene(spark, sf_dir, "nodes")
    s = n.select(F.explode(F.array_compact(F.array(F.col("role"), F.when(F.col("n") % 4 == 0, "tabletop"), F.lit("overall")))).alias("subset"), (F.col("n") % 3 != 0).alias("hit"))
    return s.groupBy("subset").agg(F.count("*").alias("truth"), F.count_if("hit").alias("matched")).withColumn("recall", F.round(F.col("matched") / F.col("truth"), 6))


@query(
    "eval_triplets",
    with_sql("boxes3d") + """g AS (SELECT a.n AS e, a.node_id AS c, b.node_id AS p, a.n % 5 AS r FROM boxes3d a JOIN boxes3d b ON a.n = b.n AND a.role = 'U' AND b.role = 'C'), i AS (SELECT node_id, n % 2 = 0 AS ok, round(1.0::DOUBLE / (1 + n % 7), 6) AS iou FROM boxes3d)
    SELECT g.e AS gt, g.e AS pr, round((x.iou + y.iou) / 2, 6) AS quality FROM g JOIN i x ON x.node_id = g.c AND x.ok JOIN i y ON y.node_id = g.p AND y.ok WHERE g.r <> 3""",
)
def eval_triplets(spark, sf_dir):
    """Edges whose endpoints and relation are all hits, with the mean overlap of the endpoints."""
    from .evaluate import triplets

    b = scene(spark, sf_dir, "boxes3d")
    e = b.where("role = 'U'").select(F.col("n").alias("edge"), F.col("node_id").alias("child"), (F.col("n") % 5).alias("relation")).join(b.where("role = 'C'").select(F.col("n").alias("edge"), F.col("node_id").alias("parent")), "edge")
    n = b.where("n % 2 = 0").select(F.col("node_id").alias("gt"), F.col("node_id").alias("pr"), F.round(1.0 / (1 + F.col("n") % 7), 6).alias("iou"))
    r = spark.createDataFrame([(i, i) for i in (0, 1, 2, 4)], "query_id long, vec_id long")
    return triplets(e, e, n, r).withColumn("quality", F.round("quality", 6))


@query("overlay_points", with_sql("nodes") + "b AS (SELECT node_id, cx, cy, cz, unnest(range(24)) AS i FROM nodes), z AS (SELECT *, 1 - 2 * (i + 0.5::DOUBLE) / 24 AS h FROM b) SELECT node_id, i, round(cx + 0.02 * sqrt(1 - h * h) * cos(i * 2.399963229728653), 6) AS x, round(cy + 0.02 * sqrt(1 - h * h) * sin(i * 2.399963229728653), 6) AS y, round(cz + 0.02 * h, 6) AS z FROM z")
def overlay_points(spark, sf_dir):
    p = A.shell(scene(spark, sf_dir, "nodes"))
    return p.select("node_id", "i", *[F.round(c, 6).alias(c) for c in "xyz"])


@query("inference_boxes", DET + "z AS (SELECT 1) SELECT frame_idx, det_id, (x1 * 0.8 - 5)::DOUBLE AS ix1, (y2 * 0.8 - 3)::DOUBLE AS iy2, round(((x1 * 0.8 - 5) + 5) / 0.8, 6)::DOUBLE AS bx1 FROM detections")
def inference_boxes(spark, sf_dir):
    """Boxes in the detector's image and back."""
    d = scene(spark, sf_dir, "detections")
    i = G.to_inference(G.box(), 0.8, 5, 3)
    b = G.from_inference(i, 0.8, 5, 3)
    return d.select("frame_idx", "det_id", i[0].alias("ix1"), i[3].alias("iy2"), F.round(b[0], 6).alias("bx1"))


@query(
    "points_near_edges",
    with_sql("points", "nodes") + """e AS (SELECT 0.05::DOUBLE AS ax, 0.05::DOUBLE AS ay, 0.05::DOUBLE AS az, 0.15::DOUBLE AS ex, 0.1::DOUBLE AS ey, 0.1::DOUBLE AS ez), s AS (SELECT pid, x, y, z, e.*, least(1, greatest(0, ((x - ax) * (ex - ax) + (y - ay) * (ey - ay) + (z - az) * (ez - az)) / (pow(ex - ax, 2) + pow(ey - ay, 2) + pow(ez - az, 2)))) AS t FROM points, e)
    SELECT pid, round(sqrt(pow(x - ax - t * (ex - ax), 2) + pow(y - ay - t * (ey - ay), 2) + pow(z - az - t * (ez - az), 2)), 6) AS distance FROM s""",
)
def points_near_edges(spark, sf_dir):
    d = G.segment_distance([F.col(c) for c in "xyz"], [F.lit(v) for v in (0.05, 0.05, 0.05)], [F.lit(v) for v in (0.15, 0.1, 0.1)])
    return scene(spark, sf_dir, "points").select("pid", F.round(d, 6).alias("distance"))


@query("parent_depth_prior", with_sql("depth_samples", "relations_2d") + "s AS (SELECT grp, median(depth) AS m FROM depth_samples GROUP BY grp), p AS (SELECT frame_idx, child_det_id, s.m FROM relations_2d r JOIN s ON s.grp = (r.frame_idx * 8 + r.parent_det_id) % 200 WHERE r.pass_threshold) SELECT frame_idx, child_det_id, round(median(m), 9) AS depth, count(*) AS parents FROM p GROUP BY ALL")
def parent_depth_prior(spark, sf_dir):
    """The median of the parents' median depths, a child's prior."""
    s = scene(spark, sf_dir, "depth_samples").groupBy("grp").agg(F.median("depth").alias("m"))
    r = scene(spark, sf_dir, "relations_2d").where("pass_threshold").withColumn("grp", (F.col("frame_idx") * 8 + F.col("parent_det_id")) % 200)
    return r.join(s, "grp").groupBy("frame_idx", "child_det_id").agg(F.round(F.median("m"), 9).alias("depth"), F.count("*").alias("parents"))


@query(
    "parent_map",
    with_sql("relations_2d") + "f AS (SELECT frame_idx, bool_or(selected) AS any_selected FROM relations_2d GROUP BY frame_idx) SELECT frame_idx, child_det_id, min(parent_det_id) AS first_parent, count(*) AS parents FROM relations_2d JOIN f USING (frame_idx) WHERE CASE WHEN any_selected THEN selected ELSE pass_threshold END GROUP BY ALL",
)
def parent_map(spark, sf_dir):
    """Parents of a frame's children: the selected relations, or the passing ones of a frame without any."""
    r = scene(spark, sf_dir, "relations_2d")
    any_ = F.bool_or("selected").over(Window.partitionBy("frame_idx"))
    return r.withColumn("any", any_).where("case when any then selected else pass_threshold end").groupBy("frame_idx", "child_det_id").agg(F.min("parent_det_id").alias("first_parent"), F.count("*").alias("parents"))


@query("stage_counts", with_sql("relations_2d") + "z AS (SELECT 1) SELECT edge_type, count(*) AS raw, count(*) FILTER (pass_threshold) AS passing, count(*) FILTER (selected) AS final, count(DISTINCT frame_idx) AS frames FROM relations_2d GROUP BY ROLLUP (edge_type)")
def stage_counts(spark, sf_dir):
    r = scene(spark, sf_dir, "relations_2d").rollup("edge_type")
    return r.agg(F.count("*").alias("raw"), F.count_if("pass_threshold").alias("passing"), F.count_if("selected").alias("final"), F.count_distinct("frame_idx").alias("frames"))


@query("carrier_margins", with_sql("edge_candidates") + "a AS (SELECT child_node_id AS unit, parent_node_id AS carrier, round(avg(coverage), 6) AS score FROM edge_candidates WHERE edge_type = 'C-U' GROUP BY ALL), w AS (SELECT *, row_number() OVER p AS rn, round(score - lead(score) OVER p, 6) AS margin FROM a WINDOW p AS (PARTITION BY unit ORDER BY score DESC, carrier)) SELECT unit, carrier, score, margin FROM w WHERE rn = 1")
def carrier_margins(spark, sf_dir):
    a = scene(spark, sf_dir, "edge_candidates").where("edge_type = 'C-U'").groupBy(F.col("child_node_id").alias("unit"), F.col("parent_node_id").alias("carrier")).agg(F.round(F.avg("coverage"), 6).alias("score"))
    return W.top_with_margin(a, ["unit"], "score", ["carrier"]).withColumn("margin", F.round("margin", 6))


@query(
    "relation_capacity",
    with_sql("relations_2d") + """m AS (SELECT *, least(1, contain + child_det_id * 0.05) AS mask FROM relations_2d WHERE pass_threshold), w AS (SELECT *, parent_label = 'kitchen cabinet' AS one, count(*) OVER p AS n, row_number() OVER (PARTITION BY frame_idx, parent_det_id, parent_label, child_label ORDER BY mask DESC, child_det_id) AS rn, lead(mask) OVER (PARTITION BY frame_idx, parent_det_id, parent_label, child_label ORDER BY mask DESC, child_det_id) AS second FROM m WINDOW p AS (PARTITION BY frame_idx, parent_det_id, parent_label, child_label))
    SELECT frame_idx, parent_det_id, child_det_id FROM w WHERE NOT one OR n = 1 OR (rn = 1 AND round(mask - second, 9) >= 0.1)""",
)
def relation_capacity(spark, sf_dir):
    """Label pairs of one child a parent keep the best child where it is clear."""
    r = scene(spark, sf_dir, "relations_2d").withColumn("mask", F.least(F.lit(1.0), F.col("contain") + F.col("child_det_id") * 0.05))
    pairs = r.where("parent_label = 'kitchen cabinet'").select("parent_label", "child_label").distinct()
    return I.within_capacity(r, pairs).select("frame_idx", "parent_det_id", "child_det_id")


_C = "SELECT parent_node_id, child_node_id, count(*) FILTER (selected AND sdet > 0.8) AS strong FROM edge_candidates WHERE edge_type = '{}' GROUP BY ALL"


@query(
    "carrier_gate_reasons",
    with_sql("edge_candidates", "boxes3d", "atlas") + f"""cu AS ({_C.format('C-U')}), ou AS ({_C.format('O-U')}),
    s AS (SELECT child_node_id, parent_node_id, count(*) FILTER (selected) AS n FROM edge_candidates WHERE edge_type IN ('O-C', 'O-U') AND cn % 4 <> 0 GROUP BY ALL), b AS (SELECT *, row_number() OVER (PARTITION BY child_node_id ORDER BY n DESC, parent_node_id) AS rn FROM s), ob AS (SELECT child_node_id, parent_node_id, CASE WHEN n % 2 = 0 THEN 'confirmed' ELSE 'provisional' END AS status FROM b WHERE rn = 1),
    pr AS (SELECT p.node_id AS pid, c.node_id AS cid, a.edge_type, list(a.object_context) AS ctx, bool_or(owner_kind = 'direct') AS dir FROM boxes3d p, boxes3d c, atlas a WHERE a.edge_type = p.role || '-' || c.role AND (p.label = a.parent_label OR p.label LIKE '% ' || a.parent_label) AND (c.label = a.child_label OR c.label LIKE '% ' || a.child_label) AND p.n <= 12 AND c.n <= 40 GROUP BY ALL),
    di AS (SELECT ou.parent_node_id, ou.child_node_id FROM ou JOIN pr ON pr.pid = ou.parent_node_id AND pr.cid = ou.child_node_id JOIN boxes3d n ON n.node_id = ou.parent_node_id WHERE strong > 0 AND dir AND len(list_filter(ctx, lambda x: n.label = x OR n.label LIKE '% ' || x)) > 0),
    j AS (SELECT cu.*, pr.ctx, co.parent_node_id AS cob, uo.parent_node_id AS uob, uo.status AS ust, di.child_node_id IS NOT NULL AS direct, ow.label AS owner, sqrt(pow(greatest(0, p.bx1 - q.bx2, q.bx1 - p.bx2), 2) + pow(greatest(0, p.by1 - q.by2, q.by1 - p.by2), 2) + pow(greatest(0, p.bz1 - q.bz2, q.bz1 - p.bz2), 2)) AS gap
        FROM cu JOIN boxes3d p ON p.node_id = cu.parent_node_id JOIN boxes3d q ON q.node_id = cu.child_node_id LEFT JOIN pr ON pr.pid = cu.parent_node_id AND pr.cid = cu.child_node_id LEFT JOIN ob co ON co.child_node_id = cu.parent_node_id LEFT JOIN ob uo ON uo.child_node_id = cu.child_node_id
        LEFT JOIN di ON di.parent_node_id = uo.parent_node_id AND di.child_node_id = cu.child_node_id LEFT JOIN boxes3d ow ON ow.node_id = co.parent_node_id)
    SELECT parent_node_id AS carrier, child_node_id AS unit, CASE WHEN ust IS NOT NULL AND ust <> 'provisional' AND direct THEN 'direct_object_context_preferred' WHEN uob IS NOT NULL AND uob IS DISTINCT FROM cob AND strong <= 0 AND cob IS NULL THEN 'unobserved_carrier_cannot_replace_measured_object'
        WHEN uob IS NOT NULL AND uob IS DISTINCT FROM cob AND strong <= 0 AND ust <> 'provisional' THEN 'cross_object_candidate' WHEN owner IS NOT NULL AND ctx IS NOT NULL AND strong <= 0 AND len(list_filter(ctx, lambda x: owner = x OR owner LIKE '% ' || x OR x LIKE '% ' || owner)) = 0 THEN 'semantic_object_context_mismatch'
        WHEN ctx IS NULL THEN 'no_semantic_cu_support' WHEN gap > 0.5 THEN 'aabb_gate_above_threshold' ELSE '' END AS reason FROM j""",
)
def carrier_gate_reasons(spark, sf_dir):
    """Why a carrier may not own a unit: protected objects, other objects, contexts, priors, reach."""
    from .mapping import carrier_gates

    e, b = scene(spark, sf_dir, "edge_candidates"), scene(spark, sf_dir, "boxes3d")
    count = lambda kind: e.where(F.col("edge_type") == kind).groupBy("parent_node_id", "child_node_id").agg(F.count_if(F.col("selected") & (F.col("sdet") > 0.8)).alias("strong"))
    s = e.where("edge_type in ('O-C', 'O-U') and cn % 4 <> 0").groupBy("child_node_id", "parent_node_id").agg(F.count_if("selected").alias("n"))
    o = s.withColumn("rn", F.row_number().over(Window.partitionBy("child_node_id").orderBy(F.desc("n"), "parent_node_id"))).where("rn = 1").withColumn("status", F.when(F.col("n") % 2 == 0, "confirmed").otherwise("provisional"))
    return carrier_gates(count("C-U"), o, count("O-U"), b.select("node_id", "label"), scene(spark, sf_dir, "atlas"), b, reach=0.5)
