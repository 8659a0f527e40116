"""Queries: aggregates, windows, ranking, set operators."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..fixtures import scene, with_sql
from ..functions import geometry as G
from ..functions import labels as L
from ..functions import scores as S
from ..operators import aggregates as A
from ..operators import scan
from ..operators import windows as W
from ..registry import query

EDG = with_sql("edge_candidates")
_CANON = "trim(regexp_replace(regexp_replace(regexp_replace(lower(trim(relation_text)), '[^a-z0-9 ]+', ' ', 'g'), '\\b(a|an|the)\\b', ' ', 'g'), ' +', ' ', 'g'))"
_ROT = f"CASE WHEN regexp_matches({_CANON}, '^(turn|twist)( |$)') AND NOT regexp_matches({_CANON}, '^(turn|twist) (on|off)( |$)') THEN regexp_replace({_CANON}, '^(turn|twist)', 'rotate') ELSE {_CANON} END"
_UNANIMOUS = "CASE WHEN count(DISTINCT canon) = 1 AND min(canon) <> '' THEN arg_min(trim(relation_text), (length(trim(relation_text)), trim(relation_text))) FILTER (trim(relation_text) <> '') ELSE '' END AS relation_text"
_AGG = """count(*) AS n, count(*) FILTER (selected) AS n_selected, count(*) FILTER (pass_threshold) AS n_pass, count(*) FILTER (selected OR pass_threshold) AS n_strong, count(s2d_score) AS n_scored, count(*) FILTER (from_raw) AS n_raw, count(*) FILTER (from_final) AS n_final,
    count(DISTINCT frame_key) AS n_frames, max(s2d_score) AS s2d_max, max(coverage) AS coverage_max, min(frame_idx) AS first_frame, max(frame_idx) AS last_frame, array_to_string(list_sort(list_distinct(list(semantic_source))), ',') AS sources"""


@query("candidate_aggregate", EDG + f"c AS (SELECT *, CASE WHEN trim(relation_text) <> '' THEN {_ROT} END AS canon FROM edge_candidates) SELECT parent_node_id, child_node_id, edge_type, {_AGG}, {_UNANIMOUS} FROM c GROUP BY ALL")
def candidate_aggregate(spark, sf_dir):
    return A.candidate_aggregate(scene(spark, sf_dir, "edge_candidates"))


@query(
    "stage_overlays",
    EDG + """s AS (SELECT 'all' AS stage, * FROM edge_candidates UNION ALL SELECT 'raw', * FROM edge_candidates WHERE from_raw UNION ALL SELECT 'final', * FROM edge_candidates WHERE from_final UNION ALL SELECT 'selected', * FROM edge_candidates WHERE selected
        UNION ALL SELECT 'scored', * FROM edge_candidates WHERE s2d_score IS NOT NULL UNION ALL SELECT 'strong', * FROM edge_candidates WHERE selected OR pass_threshold UNION ALL SELECT 'semantic_only', * FROM edge_candidates WHERE NOT from_raw AND NOT from_final)
    SELECT stage, edge_type, count(*) AS n, count(DISTINCT parent_node_id || child_node_id) AS pairs FROM s GROUP BY stage, edge_type""",
)
def stage_overlays(spark, sf_dir):
    """One aggregate under seven predicates: a row is exploded into the stages that hold it, so that the scan runs once."""
    c = F.col
    stages = {"all": F.lit(True), "raw": c("from_raw"), "final": c("from_final"), "selected": c("selected"), "scored": c("s2d_score").isNotNull(), "strong": c("selected") | c("pass_threshold"), "semantic_only": ~c("from_raw") & ~c("from_final")}
    e = scene(spark, sf_dir, "edge_candidates").withColumn("stage", F.explode(F.array_compact(F.array(*[F.when(p, n) for n, p in stages.items()]))))
    return e.groupBy("stage", "edge_type").agg(F.count("*").alias("n"), F.count_distinct(F.concat("parent_node_id", "child_node_id")).alias("pairs"))


@query("relation_text_unanimity", EDG + f"c AS (SELECT parent_node_id, child_node_id, relation_text, {_ROT} AS canon FROM edge_candidates WHERE trim(relation_text) <> '') SELECT parent_node_id, child_node_id, {_UNANIMOUS} FROM c GROUP BY ALL")
def relation_text_unanimity(spark, sf_dir):
    e = scene(spark, sf_dir, "edge_candidates").where("trim(relation_text) <> ''")
    return e.groupBy("parent_node_id", "child_node_id").agg(A.unanimous_text(F.col("relation_text")).alias("relation_text"))


@query("voxel_downsample", with_sql("points") + "v AS (SELECT node, floor(x / 0.05) AS a, floor(y / 0.05) AS b, floor(z / 0.05) AS c, count(*) AS n, avg(x) AS x, avg(y) AS y, avg(z) AS z FROM points GROUP BY ALL) SELECT node, count(*) AS voxels, max(n) AS most, round(sum(x), 6) AS x, round(sum(y), 6) AS y, round(sum(z), 6) AS z FROM v GROUP BY node")
def voxel_downsample(spark, sf_dir):
    v = A.voxels(scene(spark, sf_dir, "points"), ["node"], 0.05, [])
    return v.groupBy("node").agg(F.count("*").alias("voxels"), F.max("n").alias("most"), *[F.round(F.sum(c), 6).alias(c) for c in "xyz"])


@query("robust_bounds", with_sql("points") + "z0 AS (SELECT 1) SELECT node, " + ", ".join(f"round(quantile_cont({c}, {q}), 6) AS {c}{n}" for c in "xyz" for n, q in ((1, 0.02), (2, 0.98))) + ", " + ", ".join(f"round(median({c}), 6) AS {c}m" for c in "xyz") + " FROM points GROUP BY node")
def robust_bounds(spark, sf_dir):
    b = A.robust_bounds(scene(spark, sf_dir, "points"), ["node"])
    return b.select("node", *[F.round(c, 6).alias(c) for c in b.columns if c != "node"])


@query("depth_stats", with_sql("depth_samples") + "m AS (SELECT grp, median(depth) AS median, quantile_cont(depth, 0.75) - quantile_cont(depth, 0.25) AS iqr FROM depth_samples GROUP BY grp) SELECT grp, round(any_value(m.median), 9) AS median, round(any_value(iqr), 9) AS iqr, round(median(abs(depth - m.median)), 9) AS mad FROM depth_samples JOIN m USING (grp) GROUP BY grp")
def depth_stats(spark, sf_dir):
    s = A.spread_stats(scene(spark, sf_dir, "depth_samples"), ["grp"], "depth")
    return s.select("grp", *[F.round(c, 9).alias(c) for c in ("median", "iqr", "mad")])


@query("iqr_depth_filter", with_sql("depth_samples") + "q AS (SELECT grp, quantile_cont(depth, 0.25) AS a, quantile_cont(depth, 0.75) AS b FROM depth_samples GROUP BY grp) SELECT grp, count(*) AS n FROM depth_samples JOIN q USING (grp) WHERE depth BETWEEN a - 0.1 * (b - a) AND b + 0.1 * (b - a) GROUP BY grp")
def iqr_depth_filter(spark, sf_dir):
    d = scene(spark, sf_dir, "depth_samples")
    q = d.groupBy("grp").agg(F.percentile("depth", 0.25).alias("a"), F.percentile("depth", 0.75).alias("b"))
    return d.join(q, "grp").where("depth between a - 0.1D * (b - a) and b + 0.1D * (b - a)").groupBy("grp").agg(F.count("*").alias("n"))


@query(
    "colour_histogram",
    with_sql("points") + "h AS (SELECT node, least(11, floor(hue * 12 / 180.0))::BIGINT AS bhue, least(11, floor(sat * 12 / 256.0))::BIGINT AS bsat, least(11, floor(val * 12 / 256.0))::BIGINT AS bval, count(*) AS n FROM points GROUP BY ALL) SELECT *, round(n / sqrt(sum(n * n) OVER (PARTITION BY node)), 6) AS weight FROM h",
)
def colour_histogram(spark, sf_dir):
    h = A.colour_histogram(scene(spark, sf_dir, "points"), ["node"])
    return h.withColumn("weight", F.round("weight", 6))


@query("label_votes", with_sql("observations") + "v AS (SELECT node_id, label, round(sum(score), 6) AS vote FROM observations GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY node_id ORDER BY vote DESC, label) AS rn FROM v) SELECT node_id, label, vote FROM r WHERE rn = 1")
def label_votes(spark, sf_dir):
    return A.best_label(scene(spark, sf_dir, "observations"), ["node_id"])


_LOGIT = "ln(least(1 - 1e-4, greatest(1e-4, s2d_score)) / (1 - least(1 - 1e-4, greatest(1e-4, s2d_score))))"


@query("log_odds_parent", EDG + f"z AS (SELECT 1) SELECT child_node_id, parent_node_id, round(sum({_LOGIT}), 6) AS log_odds, count(DISTINCT frame_key) AS frames, count(*) AS n FROM edge_candidates WHERE s2d_score IS NOT NULL AND edge_type IN ('O-C', 'O-U') GROUP BY ALL")
def log_odds_parent(spark, sf_dir):
    return A.log_odds(scene(spark, sf_dir, "edge_candidates").where("edge_type in ('O-C', 'O-U')")).withColumn("log_odds", F.round("log_odds", 6))


@query("modal_relation_text", EDG + "n AS (SELECT child_node_id, parent_node_id, relation_text, count(*) AS n FROM edge_candidates WHERE trim(relation_text) <> '' GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY child_node_id, parent_node_id ORDER BY n DESC, relation_text) AS rn FROM n) SELECT child_node_id, parent_node_id, relation_text, n FROM r WHERE rn = 1")
def modal_relation_text(spark, sf_dir):
    return A.modal_text(scene(spark, sf_dir, "edge_candidates"), ["child_node_id", "parent_node_id"])


@query("stable_parent_vote", EDG + "n AS (SELECT child_node_id, parent_node_id, count(DISTINCT frame_key) AS frames FROM edge_candidates WHERE selected GROUP BY ALL), r AS (SELECT *, row_number() OVER p AS rn, coalesce(lead(frames) OVER p, 0) AS second FROM n WINDOW p AS (PARTITION BY child_node_id ORDER BY frames DESC, parent_node_id DESC)) SELECT child_node_id, parent_node_id, frames, second FROM r WHERE rn = 1 AND frames >= 2 AND frames - second >= 1")
def stable_parent_vote(spark, sf_dir):
    return A.stable_parent(scene(spark, sf_dir, "edge_candidates").where("selected"), ["child_node_id"])


@query("parent_vote_history", EDG + "f AS (SELECT DISTINCT child_node_id, parent_node_id, frame_idx FROM edge_candidates WHERE selected) SELECT child_node_id, parent_node_id, frame_idx, count(*) OVER (PARTITION BY child_node_id, parent_node_id ORDER BY frame_idx) AS frames FROM f")
def parent_vote_history(spark, sf_dir):
    """Support so far of each parent, frame by frame."""
    f = scene(spark, sf_dir, "edge_candidates").where("selected").select("child_node_id", "parent_node_id", "frame_idx").distinct()
    return f.withColumn("frames", F.count("*").over(Window.partitionBy("child_node_id", "parent_node_id").orderBy("frame_idx")))


@query("run_counters", EDG + "z AS (SELECT 1) SELECT edge_type, semantic_source, count(*) AS n, count(*) FILTER (selected) AS selected, round(avg(s2d_score), 6) AS score_mean, min(s2d_score) AS score_min, max(s2d_score) AS score_max FROM edge_candidates GROUP BY GROUPING SETS ((edge_type, semantic_source), (edge_type), ())")
def run_counters(spark, sf_dir):
    e = scene(spark, sf_dir, "edge_candidates")
    sets = e.groupingSets([["edge_type", "semantic_source"], ["edge_type"], []], "edge_type", "semantic_source")
    return sets.agg(F.count("*").alias("n"), F.count_if("selected").alias("selected"), F.round(F.avg("s2d_score"), 6).alias("score_mean"), F.min("s2d_score").alias("score_min"), F.max("s2d_score").alias("score_max"))


@query("raw_final_retention", EDG + "r AS (SELECT DISTINCT frame_key, edge_type, parent_node_id, child_node_id FROM edge_candidates WHERE from_raw), f AS (SELECT DISTINCT frame_key, edge_type, parent_node_id, child_node_id FROM edge_candidates WHERE from_final), b AS (SELECT * FROM r INTERSECT SELECT * FROM f) SELECT (SELECT count(*) FROM r) AS raw, (SELECT count(*) FROM b) AS kept, round((SELECT count(*) FROM b) / greatest(1, (SELECT count(*) FROM r))::DOUBLE, 6) AS rate")
def raw_final_retention(spark, sf_dir):
    e = scene(spark, sf_dir, "edge_candidates")
    key = e.groupBy("frame_key", "edge_type", "parent_node_id", "child_node_id").agg(F.bool_or("from_raw").alias("r"), F.bool_or("from_final").alias("f"))
    return key.agg(F.count_if("r").alias("raw"), F.count_if(F.col("r") & F.col("f")).alias("kept")).withColumn("rate", F.round(F.col("kept") / F.greatest(F.lit(1), F.col("raw")), 6))


@query("anchor_index", EDG + "o AS (SELECT child_node_id, frame_key, min(parent_node_id) AS parent_node_id FROM edge_candidates GROUP BY child_node_id, frame_key HAVING count(DISTINCT parent_node_id) = 1), p AS (SELECT parent_node_id, child_node_id, count(*) AS frames FROM o GROUP BY ALL) SELECT parent_node_id, string_agg(child_node_id, ',' ORDER BY child_node_id) AS children, sum(frames)::BIGINT AS frames FROM p GROUP BY parent_node_id")
def anchor_index(spark, sf_dir):
    return A.anchor_index(scene(spark, sf_dir, "edge_candidates"))


@query("owner_hint_sets", with_sql("relations_2d") + "z AS (SELECT 1) SELECT frame_idx, child_det_id, count(DISTINCT (parent_label, parent_det_id)) AS hints, min(parent_label) AS first_label FROM relations_2d WHERE edge_type = 'O-C' AND contain > 0.3 GROUP BY ALL")
def owner_hint_sets(spark, sf_dir):
    r = scene(spark, sf_dir, "relations_2d").where("edge_type = 'O-C' and contain > 0.3")
    g = r.groupBy("frame_idx", "child_det_id").agg(F.collect_set(F.struct("parent_label", "parent_det_id")).alias("s"))
    return g.select("frame_idx", "child_det_id", F.size("s").cast("long").alias("hints"), F.array_min("s")["parent_label"].alias("first_label"))


@query("derived_objects", with_sql("boxes3d") + "w AS (SELECT *, greatest(confidence, quality_ema, 1e-3) AS w FROM boxes3d WHERE role = 'C' AND state <> 'rejected') SELECT label, count(*) AS members, sum(n_support)::BIGINT AS support, " + ", ".join(f"round({f}({c}), 6) AS {c}" for c, f in (("bx1", "min"), ("by1", "min"), ("bz1", "min"), ("bx2", "max"), ("by2", "max"), ("bz2", "max"))) + ", " + ", ".join(f"round(sum({c} * w) / sum(w), 6) AS {c}" for c in ("cx", "cy", "cz")) + " FROM w GROUP BY label")
def derived_objects(spark, sf_dir):
    d = A.derived_object(scene(spark, sf_dir, "boxes3d").where("role = 'C' and state <> 'rejected'"), ["label"])
    return d.select("label", "members", "support", *[F.round(c, 6).alias(c) for c in d.columns[3:]])


@query("scene_diagonal", with_sql("nodes") + "z AS (SELECT 1) SELECT round(sqrt(pow(max(cx) - min(cx), 2) + pow(max(cy) - min(cy), 2) + pow(max(cz) - min(cz), 2)), 6) AS diagonal FROM nodes")
def scene_diagonal(spark, sf_dir):
    from .graph import scene_diagonal as d

    return d(scene(spark, sf_dir, "nodes")).select(F.round("diagonal", 6).alias("diagonal"))


@query("role_minimum", "WITH l AS (SELECT p_name AS label, CASE p_size % 7 WHEN 0 THEN 'U' WHEN 1 THEN 'C' ELSE 'O' END AS role FROM part) SELECT label, CASE min(CASE role WHEN 'U' THEN 0 WHEN 'C' THEN 1 ELSE 2 END) WHEN 0 THEN 'U' WHEN 1 THEN 'C' ELSE 'O' END AS role, count(DISTINCT role) AS roles FROM l GROUP BY label")
def role_minimum(spark, sf_dir):
    """The lowest role that each name is used in, over all parts."""
    p = scene(spark, sf_dir, "part")
    return A.lowest_role(p.select(F.col("p_name").alias("label"), F.when(F.col("p_size") % 7 == 0, "U").when(F.col("p_size") % 7 == 1, "C").otherwise("O").alias("role")))


_TOLD = "CASE ({0}) % 5 WHEN 0 THEN 'part of' WHEN 1 THEN '' WHEN 2 THEN ' pull ' WHEN 3 THEN 'open' ELSE 'pull the handle' END"


@query(
    "nested_prior_flatten",
    with_sql("relations_2d") + f"""e AS (SELECT o.frame_idx, o.parent_label AS object, o.child_label AS carrier, o.parent_det_id AS p, o.child_det_id AS c, u.child_det_id AS n, u.child_label AS unit,
        trim({_TOLD.format('o.frame_idx + o.child_det_id')}) AS oc, trim({_TOLD.format('o.frame_idx * 3 + u.child_det_id')}) AS cu
        FROM relations_2d o JOIN relations_2d u ON u.frame_idx = o.frame_idx AND o.edge_type = 'O-C' AND u.edge_type = 'C-U' AND u.parent_det_id = o.child_det_id WHERE o.contain > 0 AND u.contain > 0),
    a AS (SELECT object, carrier, first(oc ORDER BY oc <> '' DESC, oc <> 'part of' DESC, length(oc) DESC, frame_idx, p, c) AS oc_relation FROM e GROUP BY ALL),
    b AS (SELECT object, carrier, unit, first(cu ORDER BY cu <> '' DESC, cu <> 'part of' DESC, length(cu) DESC, frame_idx, p, c, n) AS cu_relation FROM e GROUP BY ALL)
    SELECT object, carrier, unit, oc_relation, cu_relation FROM b JOIN a USING (object, carrier)""",
)
def nested_prior_flatten(spark, sf_dir):
    """What frames say of objects, nested as object -> carriers -> units, merged by what says most, and flattened."""
    r = scene(spark, sf_dir, "relations_2d").where("contain > 0").select("frame_idx", "edge_type", "parent_det_id", "child_det_id", "parent_label", "child_label")
    told = lambda n: F.element_at(F.array(*map(F.lit, ("part of", "", " pull ", "open", "pull the handle"))), (n % 5 + 1).cast("int"))
    u = r.where("edge_type = 'C-U'").select("frame_idx", F.col("parent_det_id").alias("child_det_id"), F.struct(F.col("child_det_id").alias("n"), F.col("child_label").alias("unit"), told(F.col("frame_idx") * 3 + F.col("child_det_id")).alias("cu_relation")).alias("u"))
    units = u.groupBy("frame_idx", "child_det_id").agg(F.array_sort(F.collect_list("u")).alias("units"))
    c = r.where("edge_type = 'O-C'").join(units, ["frame_idx", "child_det_id"])
    entry = F.struct("parent_det_id", "child_det_id", F.col("child_label").alias("carrier"), told(F.col("frame_idx") + F.col("child_det_id")).alias("oc_relation"), "units")
    nested = c.groupBy("frame_idx", F.col("parent_label").alias("object")).agg(F.array_sort(F.collect_list(entry)).alias("carriers"))
    return A.merged_priors(nested, "frame_idx")


@query("edge_softmax", EDG + f"s AS (SELECT child_node_id, parent_node_id, round(sum({_LOGIT}), 6) / 100 AS l FROM edge_candidates WHERE s2d_score IS NOT NULL GROUP BY ALL), e AS (SELECT *, exp(l - max(l) OVER (PARTITION BY child_node_id)) AS e FROM s) SELECT child_node_id, parent_node_id, round(e / sum(e) OVER (PARTITION BY child_node_id), 6) AS p FROM e")
def edge_softmax(spark, sf_dir):
    s = A.log_odds(scene(spark, sf_dir, "edge_candidates")).withColumn("l", F.round("log_odds", 6) / 100)
    return s.select("child_node_id", "parent_node_id", F.round(W.softmax(F.col("l"), ["child_node_id"]), 6).alias("p"))


_MODES = """i AS (SELECT *, CASE WHEN depth - lag(depth) OVER w > 0.004 THEN 1 ELSE 0 END AS new FROM depth_samples WINDOW w AS (PARTITION BY grp ORDER BY depth, pid)), j AS (SELECT *, sum(new) OVER (PARTITION BY grp ORDER BY depth, pid) AS island FROM i),
    k AS (SELECT *, count(*) OVER (PARTITION BY grp, island) AS size FROM j), l AS (SELECT *, max(size) OVER (PARTITION BY grp) AS most FROM k), m AS (SELECT grp, depth, CASE WHEN most < 4 THEN 0 ELSE island END AS island FROM l WHERE size >= 4 OR most < 4),
    n AS (SELECT grp, island, count(*) AS n, median(depth) AS median, min(depth) AS low, max(depth) AS high FROM m GROUP BY ALL), d AS (SELECT m.grp, m.island, median(abs(depth - median)) AS mad FROM m JOIN n USING (grp, island) GROUP BY ALL),
    o AS (SELECT n.*, d.mad, row_number() OVER (PARTITION BY n.grp ORDER BY median, n.island) - 1 AS mode FROM n JOIN d USING (grp, island))"""


@query("depth_modes", with_sql("depth_samples") + _MODES + " SELECT grp, mode, n, round(median, 9) AS median, round(mad, 9) AS mad, round(low, 9) AS low, round(high, 9) AS high FROM o")
def depth_modes(spark, sf_dir):
    m = W.depth_modes(scene(spark, sf_dir, "depth_samples"), ["grp"], "depth", "pid", gap=0.004)
    return m.select("grp", F.col("mode").cast("long").alias("mode"), "n", *[F.round(c, 9).alias(c) for c in ("median", "mad", "low", "high")])


@query(
    "chosen_depth_mode",
    with_sql("depth_samples") + _MODES + """, t AS (SELECT *, CASE WHEN grp % 3 = 0 THEN 0.9 + grp % 7 * 0.1 END AS seed, CASE WHEN grp % 2 = 0 THEN 0.8 + grp % 5 * 0.1 END AS parent FROM o),
    r AS (SELECT *, CASE WHEN coalesce(abs(median - parent) <= 0.025, false) THEN 0 WHEN coalesce(abs(median - seed) <= 0.05, false) THEN 1 ELSE 2 END AS tier FROM t),
    w AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY tier, CASE WHEN tier < 2 THEN coalesce(round(abs(median - seed), 9), 999) ELSE 0 END, round(mad, 9), n DESC, mode) AS rn FROM r) SELECT grp, mode, tier, n FROM w WHERE rn = 1""",
)
def chosen_depth_mode(spark, sf_dir):
    m = W.depth_modes(scene(spark, sf_dir, "depth_samples"), ["grp"], "depth", "pid", gap=0.004)
    m = m.withColumns({"seed": F.expr("CASE WHEN grp % 3 = 0 THEN 0.9 + grp % 7 * 0.1 END").cast("double"), "parent": F.expr("CASE WHEN grp % 2 = 0 THEN 0.8 + grp % 5 * 0.1 END").cast("double")})
    return W.chosen_mode(m, ["grp"], "seed", "parent").select("grp", F.col("mode").cast("long").alias("mode"), "tier", "n")


@query("remote_window_confirm", EDG + "f AS (SELECT DISTINCT parent_node_id, child_node_id, frame_idx FROM edge_candidates WHERE selected), h AS (SELECT *, count(*) OVER (PARTITION BY parent_node_id, child_node_id ORDER BY frame_idx RANGE BETWEEN 29 PRECEDING AND CURRENT ROW) AS hits FROM f) SELECT *, hits >= 2 AS confirmed FROM h")
def remote_window_confirm(spark, sf_dir):
    f = scene(spark, sf_dir, "edge_candidates").where("selected").select("parent_node_id", "child_node_id", "frame_idx").distinct()
    return W.confirmed_in_window(f, ["parent_node_id", "child_node_id"], "frame_idx")


_STREAK = """o AS (SELECT *, scene <> 'unknown' AND confidence >= 0.8 AS ok FROM scene_votes), l AS (SELECT *, lag(ok) OVER w AS lo, lag(scene) OVER w AS ls FROM o WINDOW w AS (PARTITION BY sequence ORDER BY frame_idx)),
    b AS (SELECT *, sum(CASE WHEN NOT ok OR NOT coalesce(lo, false) OR scene <> coalesce(ls, '') THEN 1 ELSE 0 END) OVER (PARTITION BY sequence ORDER BY frame_idx) AS run FROM l),
    s AS (SELECT sequence, frame_idx, scene, sum(ok::INT) OVER (PARTITION BY sequence, run ORDER BY frame_idx)::BIGINT AS streak FROM b)"""


@query("scene_streaks", with_sql("scene_votes") + _STREAK + " SELECT * FROM s")
def scene_streaks(spark, sf_dir):
    v = scene(spark, sf_dir, "scene_votes")
    return scan.streaks(v, ["sequence"], "frame_idx", "scene", (F.col("scene") != "unknown") & (F.col("confidence") >= 0.8)).select("sequence", "frame_idx", "scene", "streak")


@query("scene_lock", with_sql("scene_votes") + _STREAK + ", w AS (SELECT *, row_number() OVER (PARTITION BY sequence ORDER BY frame_idx) AS rn FROM s WHERE streak >= 2) SELECT sequence, frame_idx AS lock_frame, scene FROM w WHERE rn = 1")
def scene_lock(spark, sf_dir):
    """The frame and scene at which each sequence locks for good."""
    v = scene(spark, sf_dir, "scene_votes")
    s = scan.streaks(v, ["sequence"], "frame_idx", "scene", (F.col("scene") != "unknown") & (F.col("confidence") >= 0.8)).where("streak >= 2")
    return s.groupBy("sequence").agg(F.min(F.struct("frame_idx", "scene")).alias("m")).select("sequence", F.col("m.frame_idx").alias("lock_frame"), F.col("m.scene").alias("scene"))


@query("evenly_spaced_sample", with_sql("points") + "r AS (SELECT node, pid, row_number() OVER (PARTITION BY node ORDER BY pid) - 1 AS i, count(*) OVER (PARTITION BY node) AS n FROM points) SELECT node, pid FROM r WHERE n <= 64 OR list_contains(list_transform(range(64), lambda j: floor(j * ((n - 1) / 63.0::DOUBLE) + 1e-9)::BIGINT), i)")
def evenly_spaced_sample(spark, sf_dir):
    return W.evenly(scene(spark, sf_dir, "points"), ["node"], ["pid"], 64).select("node", "pid")


@query("cell_ordered_sample", with_sql("points") + "r AS (SELECT node, pid, row_number() OVER (PARTITION BY node ORDER BY floor(x * 128), floor(y * 128), floor(z * 128), pid) - 1 AS i, count(*) OVER (PARTITION BY node) AS n FROM points) SELECT node, pid FROM r WHERE n <= 50 OR list_contains(list_transform(range(50), lambda j: round_even(j * ((n - 1) / 49.0::DOUBLE), 0)::BIGINT), i)")
def cell_ordered_sample(spark, sf_dir):
    order = [F.floor(F.col(c) * 128) for c in "xyz"]
    return W.evenly(scene(spark, sf_dir, "points"), ["node"], [*order, "pid"], 50, rounded=True).select("node", "pid")


@query("bounded_history", with_sql("observations") + "r AS (SELECT node_id, seq, quality, row_number() OVER (PARTITION BY node_id ORDER BY seq DESC) AS rn FROM observations) SELECT node_id, count(*) AS n, min(seq) AS first_seq, round(avg(quality), 6) AS mean_quality FROM r WHERE rn <= 12 GROUP BY node_id")
def bounded_history(spark, sf_dir):
    return W.history(scene(spark, sf_dir, "observations"), ["node_id"], "seq").groupBy("node_id").agg(F.count("*").alias("n"), F.min("seq").alias("first_seq"), F.round(F.avg("quality"), 6).alias("mean_quality"))


@query("node_numbering", with_sql("detections") + "z AS (SELECT 1) SELECT frame_idx, det_id, role || lpad((row_number() OVER (PARTITION BY role ORDER BY frame_idx, det_id) + CASE role WHEN 'C' THEN 100 ELSE 0 END)::VARCHAR, 6, '0') AS node_id FROM detections")
def node_numbering(spark, sf_dir):
    return W.numbered(scene(spark, sf_dir, "detections"), "role", ["frame_idx", "det_id"], {"C": 100}).select("frame_idx", "det_id", "node_id")


@query("natural_sort", "WITH p AS (SELECT DISTINCT p_brand AS name FROM part) SELECT name, row_number() OVER (ORDER BY regexp_extract(name, '^[^0-9]*'), regexp_extract(name, '[0-9]+')::BIGINT, name) AS rank FROM p")
def natural_sort(spark, sf_dir):
    """Names by their text and then their number, not its digits."""
    from ..sources.files import natural_key

    p = scene(spark, sf_dir, "part").select(F.col("p_brand").alias("name")).distinct()
    return p.withColumn("rank", F.row_number().over(Window.orderBy(natural_key(F.col("name")), "name")).cast("long"))


@query("first_position_dedupe", with_sql("detections") + "r AS (SELECT frame_idx, label, min(det_id) AS det_id FROM detections GROUP BY ALL) SELECT frame_idx, label, det_id, row_number() OVER (PARTITION BY frame_idx ORDER BY det_id) AS place FROM r")
def first_position_dedupe(spark, sf_dir):
    """Labels of a frame once, in the order of their first place."""
    f = scene(spark, sf_dir, "detections").groupBy("frame_idx", "label").agg(F.min("det_id").alias("det_id"))
    return f.withColumn("place", F.row_number().over(Window.partitionBy("frame_idx").orderBy("det_id")).cast("long"))


@query(
    "candidate_union",
    EDG + """u AS (SELECT frame_key, edge_type, parent_node_id, child_node_id, 0 AS pr, selected, true AS raw, false AS fin, coverage FROM edge_candidates WHERE from_raw UNION ALL SELECT frame_key, edge_type, parent_node_id, child_node_id, 1, selected, false, true, coverage FROM edge_candidates WHERE from_final
        UNION ALL SELECT frame_key, edge_type, parent_node_id, child_node_id, 2, false, false, false, NULL FROM edge_candidates WHERE semantic_source = 'atlas')
    SELECT frame_key, edge_type, parent_node_id, child_node_id, min(pr) AS priority, bool_or(selected) AS selected, NOT bool_or(raw) AND NOT bool_or(fin) AS semantic_only, max(coverage) AS coverage, string_agg(DISTINCT pr::VARCHAR, ',' ORDER BY pr::VARCHAR) AS sources FROM u GROUP BY ALL""",
)
def candidate_union(spark, sf_dir):
    """Raw, final and prior candidates united by key: flags or'ed, sources joined, the better geometry kept."""
    e = scene(spark, sf_dir, "edge_candidates")
    key = ["frame_key", "edge_type", "parent_node_id", "child_node_id"]
    part = lambda d, p, raw, final: d.select(*key, F.lit(p).alias("pr"), "selected", F.lit(raw).alias("raw"), F.lit(final).alias("final"), "coverage")
    prior = e.where("semantic_source = 'atlas'").withColumns({"selected": F.lit(False), "coverage": F.lit(None).cast("double")})
    u = part(e.where("from_raw"), 0, True, False).unionByName(part(e.where("from_final"), 1, False, True)).unionByName(part(prior, 2, False, False))
    return u.groupBy(*key).agg(F.min("pr").alias("priority"), F.bool_or("selected").alias("selected"), (~F.bool_or("raw") & ~F.bool_or("final")).alias("semantic_only"), F.max("coverage").alias("coverage"), F.array_join(F.array_sort(F.collect_set(F.col("pr").cast("string"))), ",").alias("sources"))


@query("tag_set_ops", with_sql("detections", "atlas") + "t AS (SELECT DISTINCT label FROM detections), k AS (SELECT parent_label AS label FROM atlas UNION SELECT child_label FROM atlas) SELECT 'both' AS part, label FROM (SELECT * FROM t INTERSECT SELECT * FROM k) UNION ALL SELECT 'seen', label FROM (SELECT * FROM t EXCEPT SELECT * FROM k) UNION ALL SELECT 'known', label FROM (SELECT * FROM k EXCEPT SELECT * FROM t)")
def tag_set_ops(spark, sf_dir):
    t = scene(spark, sf_dir, "detections").select("label").distinct()
    a = scene(spark, sf_dir, "atlas")
    k = a.select(F.col("parent_label").alias("label")).union(a.select("child_label")).distinct()
    named = lambda n, d: d.select(F.lit(n).alias("part"), "label")
    return named("both", t.intersect(k)).union(named("seen", t.subtract(k))).union(named("known", k.subtract(t)))


@query("directed_dedupe", EDG + "r AS (SELECT *, row_number() OVER (PARTITION BY parent_node_id, child_node_id ORDER BY CASE WHEN trim(relation_text) <> '' THEN 0 ELSE 1 END, s2d_score DESC NULLS LAST, evidence_id) AS rn FROM edge_candidates) SELECT parent_node_id, child_node_id, relation_text, s2d_score FROM r WHERE rn = 1")
def directed_dedupe(spark, sf_dir):
    """One row a directed pair: with a text before without, then the highest score."""
    w = Window.partitionBy("parent_node_id", "child_node_id").orderBy(F.when(F.trim("relation_text") != "", 0).otherwise(1), F.desc_nulls_last("s2d_score"), "evidence_id")
    return scene(spark, sf_dir, "edge_candidates").withColumn("rn", F.row_number().over(w)).where("rn = 1").select("parent_node_id", "child_node_id", "relation_text", "s2d_score")


@query("label_norm", "WITH d AS (SELECT doc_id, text AS t FROM documents) SELECT doc_id, trim(regexp_replace(regexp_replace(translate(lower(t), '_-', '  '), '[^a-z0-9 ]+', ' ', 'g'), ' +', ' ', 'g')) AS prior, sha256(t) AS hash, md5(t) AS md5 FROM d")
def label_norm(spark, sf_dir):
    t = F.col("text")
    return scene(spark, sf_dir, "documents").select("doc_id", L.prior_label(t).alias("prior"), F.sha2(t, 256).alias("hash"), F.md5(t.cast("binary")).alias("md5"))


@query("label_variants", "WITH p AS (SELECT p_partkey, p_brand || ' / ' || upper(p_type) || '/' || p_brand AS t FROM part) SELECT p_partkey, array_to_string(list_sort(list_distinct(list_filter(list_transform(string_split(t, '/'), lambda x: lower(trim(x))), lambda x: x <> ''))), '|') AS variants FROM p")
def label_variants(spark, sf_dir):
    t = F.concat("p_brand", F.lit(" / "), F.upper("p_type"), F.lit("/"), "p_brand")
    return scene(spark, sf_dir, "part").select("p_partkey", F.array_join(L.variants(t), "|").alias("variants"))


@query("canonical_texts", EDG + f"z AS (SELECT 1) SELECT DISTINCT relation_text, {_ROT} AS canonical FROM edge_candidates")
def canonical_texts(spark, sf_dir):
    return scene(spark, sf_dir, "edge_candidates").select("relation_text", L.canonical_text(F.col("relation_text")).alias("canonical")).distinct()


@query(
    "iou_variants",
    with_sql("relations_2d") + """b AS (SELECT p.frame_idx, p.det_id AS a, c.det_id AS b, greatest(0, least(p.x2, c.x2) - greatest(p.x1, c.x1)) * greatest(0, least(p.y2, c.y2) - greatest(p.y1, c.y1)) AS i, (p.x2 - p.x1) * (p.y2 - p.y1) + (c.x2 - c.x1) * (c.y2 - c.y1) AS s FROM detections p JOIN detections c ON p.frame_idx = c.frame_idx AND p.det_id < c.det_id)
    SELECT frame_idx, a, b, round(CASE WHEN i <= 0 THEN 0 ELSE i / (s - i)::DOUBLE END, 6) AS iou, round(i / greatest(s - i, 1e-9), 6) AS iou_floor FROM b""",
)
def iou_variants(spark, sf_dir):
    d = scene(spark, sf_dir, "detections")
    side = lambda p: d.select("frame_idx", F.col("det_id").alias(p), *[F.col(x).alias(f"{p}_{x}") for x in ("x1", "y1", "x2", "y2")])
    j = side("a").join(side("b"), "frame_idx").where("a < b")
    return j.select("frame_idx", "a", "b", F.round(G.iou2d(G.box("a_"), G.box("b_")), 6).alias("iou"), F.round(G.iou2d(G.box("a_"), G.box("b_"), "1e-9"), 6).alias("iou_floor"))


_INTER = " * ".join(f"greatest(0, least(a.b{c}2, b.b{c}2) - greatest(a.b{c}1, b.b{c}1))" for c in "xyz")


@query(
    "box3d_pairs",
    with_sql("boxes3d") + f"j AS (SELECT a.node_id AS a, b.node_id AS b, {_INTER} AS i, 8 * (pow(a.half, 3) + pow(b.half, 3)) AS s, sqrt(" + " + ".join(f"pow(greatest(0, a.b{c}1 - b.b{c}2, b.b{c}1 - a.b{c}2), 2)" for c in "xyz") + ") AS gap FROM boxes3d a JOIN boxes3d b ON a.role = 'O' AND b.role = 'C' AND a.n % 20 = b.n % 20 AND a.scene = b.scene) SELECT a, b, round(i / (s - i), 6) AS iou, round(gap, 6) AS gap FROM j",
)
def box3d_pairs(spark, sf_dir):
    b = scene(spark, sf_dir, "boxes3d").withColumn("k", F.col("n") % 20)
    side = lambda role, p: b.where(f"role = '{role}'").select("k", "scene", F.col("node_id").alias(p), *[F.col(f"b{c}").alias(f"{p}_{c}") for c in ("x1", "y1", "z1", "x2", "y2", "z2")])
    j = side("O", "a").join(side("C", "b"), ["k", "scene"])
    boxes = [[F.col(f"{p}_{c}") for c in ("x1", "y1", "z1", "x2", "y2", "z2")] for p in "ab"]
    return j.select("a", "b", F.round(G.iou3d(*boxes), 6).alias("iou"), F.round(G.gap3d(*boxes), 6).alias("gap"))


@query(
    "rigid_transforms",
    with_sql("points") + """q AS (SELECT pid, x, y, z, 1.0::DOUBLE AS w, hue / 180.0::DOUBLE AS qz FROM points), n AS (SELECT *, w / sqrt(w * w + qz * qz) AS a, qz / sqrt(w * w + qz * qz) AS b FROM q),
    r AS (SELECT pid, (1 - 2 * b * b) * x - 2 * a * b * y + 1 AS wx, 2 * a * b * x + (1 - 2 * b * b) * y + 2 AS wy, z + 3 AS wz FROM n)
    SELECT pid, round(wx, 6) AS wx, round(wy, 6) AS wy, round(wz, 6) AS wz, round(wx * 500 / wz + 320, 6) AS u, round(wy * 500 / wz + 240, 6) AS v FROM r""",
)
def rigid_transforms(spark, sf_dir):
    """Points turned by a quaternion, moved, projected."""
    p = scene(spark, sf_dir, "points")
    zero = F.lit(0.0)
    r = G.rotation(F.lit(1.0), zero, zero, F.col("hue") / 180.0)
    moved = [a + b for a, b in zip(G.turned(r, [F.col(c) for c in "xyz"]), (1.0, 2.0, 3.0), strict=True)]
    p = p.select("pid", *[m.alias(n) for m, n in zip(moved, ("wx", "wy", "wz"), strict=True)])
    u, v, _ = G.projected([F.col("wx"), F.col("wy"), F.col("wz")], F.lit(500.0), F.lit(500.0), F.lit(320.0), F.lit(240.0))
    return p.select("pid", *[F.round(c, 6).alias(c) for c in ("wx", "wy", "wz")], F.round(u, 6).alias("u"), F.round(v, 6).alias("v"))


@query("json_score_parse", "WITH e AS (SELECT event_id, json_extract(props, '$.k')::DOUBLE AS k FROM events) SELECT event_id, least(0.99, greatest(0.01, k)) AS whole, least(0.99, greatest(0.01, k / 100)) AS cut FROM e")
def json_score_parse(spark, sf_dir):
    """Scores from whole answers and from answers that were cut off."""
    from ..functions.texts import score

    e = scene(spark, sf_dir, "events").withColumn("n", F.get_json_object("props", "$.k").cast("double"))
    answer = F.concat(F.lit('{"s2d_score": "'), (F.col("n") / 100).cast("string"), F.lit('", "reason": "the unit is'))
    return e.select("event_id", score(F.col("props"), "k").alias("whole"), score(answer).alias("cut"))


@query("relation_keys", "WITH o AS (SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN ' ' || o_orderkey || ' ' WHEN o_orderkey % 3 = 1 THEN '  ' END AS id, o_orderstatus AS s, o_custkey::VARCHAR AS a, o_orderpriority AS d FROM orders) SELECT o_orderkey, coalesce(nullif(trim(id), ''), s || '|' || a || '|' || a || '|' || d) AS key FROM o")
def relation_keys(spark, sf_dir):
    o = scene(spark, sf_dir, "orders")
    rid = F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit(" "), F.col("o_orderkey").cast("string"), F.lit(" "))).when(F.col("o_orderkey") % 3 == 1, F.lit("  "))
    cust = F.col("o_custkey").cast("string")
    return o.select("o_orderkey", L.relation_key(rid, F.col("o_orderstatus"), cust, cust, F.col("o_orderpriority")).alias("key"))


@query(
    "hierarchy_scores",
    EDG + """a AS (SELECT parent_node_id, child_node_id, count(*) FILTER (selected) AS strong, max(coverage) * 3 AS own, min(sdet) / 10 AS d, bool_or(semantic_source = 'atlas') AS atlas, bool_or(semantic_source = 'frame_result') AS fr, bool_or(semantic_source = 'allowed_parent_map') AS al FROM edge_candidates WHERE edge_type = 'C-U' GROUP BY ALL),
    s AS (SELECT *, CASE WHEN atlas THEN 0.9 WHEN fr THEN 0.85 WHEN al THEN 0.75 END AS prior FROM a)
    SELECT parent_node_id, child_node_id, prior::DOUBLE AS prior, round(0.3 * prior + 0.3 * exp(-d / 0.03) + 0.4 * CASE WHEN strong > 0 THEN 0.75 * (1 - exp(-strong)) + 0.25 * least(1, own / 3) ELSE 0.15 * least(1, own / 3) END, 6) AS score FROM s WHERE prior IS NOT NULL""",
)
def hierarchy_scores(spark, sf_dir):
    e = scene(spark, sf_dir, "edge_candidates").where("edge_type = 'C-U'")
    a = e.groupBy("parent_node_id", "child_node_id").agg(F.count_if("selected").alias("strong"), (F.max("coverage") * 3).alias("own"), (F.min("sdet") / 10).alias("d"), F.collect_set("semantic_source").alias("sources"))
    prior = S.prior_of(F.col("sources"))
    return a.where(prior.isNotNull()).select("parent_node_id", "child_node_id", prior.alias("prior"), F.round(S.hierarchy(prior, F.col("d"), F.col("strong"), F.col("own")), 6).alias("score"))
