"""Filters and gates over detections, relations, nodes and candidates.

Relations are rows (frame_idx, edge_type, parent_det_id, child_det_id, pass_threshold, selected, ...); reasons are given by
the first condition that holds, in the order of the reference's rules.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import geometry as G
from ..functions.scores import first_of


def valid_depth(points: DataFrame, column: str = "depth", low: float = 0.1, high: float = 10.0) -> DataFrame:
    z = F.col(column)
    return points.where(~F.isnan(z) & z.between(low, high))


def role_threshold(dets: DataFrame, thresholds: dict[str, float]) -> DataFrame:
    least = F.create_map(*[x for k, v in thresholds.items() for x in (F.lit(k), F.lit(float(v)))])
    return dets.where(F.col("score") >= F.coalesce(least[F.col("role")], F.lit(0.0)))


def with_border(dets: DataFrame, width: float = 640, height: float = 480, margin: float = 2) -> DataFrame:
    sides = G.touches(G.box(), width, height, margin)
    return dets.withColumn("sides", sum((s.cast("int") for s in sides[1:]), sides[0].cast("int"))).withColumn("border", F.col("sides") > 0)


def inclusive_area() -> F.Column:
    """The area of a box whose last pixels belong to it."""
    side = lambda a, b: F.greatest(F.lit(0.0), F.col(b) - F.col(a) + 1)
    return side("x1", "x2") * side("y1", "y2")


def tiny_two_border(dets: DataFrame, width: float = 640, height: float = 480) -> DataFrame:
    """Drops carriers and units that touch two sides and cover less than 1/25 of the image; boxes hold their last pixels."""
    share = inclusive_area() / (width * height)
    return with_border(dets, width, height, 3).where(~(F.col("role").isin("C", "U") & (F.col("sides") >= 2) & (share < 1 / 25)))


def units_without_parent(dets: DataFrame, relations: DataFrame, allowed: DataFrame) -> DataFrame:
    """Units with the reason why they go: no allowed parent label, none of them detected in the frame, or no passing edge.

    allowed: (child_label, parent_label).
    """
    units = dets.where("role = 'U'").select("frame_idx", "det_id", "label")
    legal = units.join(allowed.select("child_label").distinct(), units["label"] == F.col("child_label"), "left").select("frame_idx", "det_id", F.col("child_label").isNotNull().alias("legal"))
    present = units.join(allowed, units["label"] == allowed["child_label"]).join(dets.where("role <> 'U'").select(F.col("frame_idx").alias("f"), F.col("label").alias("l")), (F.col("f") == F.col("frame_idx")) & (F.col("l") == F.col("parent_label")), "left_semi").select(F.col("frame_idx").alias("pf"), F.col("det_id").alias("pd")).distinct()
    passing = relations.where("child_role = 'U' and pass_threshold").select(F.col("frame_idx").alias("rf"), F.col("child_det_id").alias("rd")).distinct()
    j = legal.join(present, (F.col("frame_idx") == F.col("pf")) & (F.col("det_id") == F.col("pd")), "left").join(passing, (F.col("frame_idx") == F.col("rf")) & (F.col("det_id") == F.col("rd")), "left")
    reason = first_of((~F.col("legal"), "no_allowed_parent"), (F.col("pd").isNull(), "no_parent_detected"), (F.col("rd").isNull(), "no_passing_edge"))
    return j.select("frame_idx", "det_id", reason.alias("reason"))


def parents_without_unit(dets: DataFrame, relations: DataFrame, exempt: DataFrame) -> DataFrame:
    """Objects and carriers with no passing unit; exempt (frame_idx, det_id) rows stay."""
    has = relations.where("child_role = 'U' and pass_threshold").select("frame_idx", F.col("parent_det_id").alias("det_id"))
    keys = ["frame_idx", "det_id"]
    return dets.where("role <> 'U'").join(has, keys, "left_anti").join(exempt, keys, "left_anti")


def remote_exempt(dets: DataFrame, remote: list[str], allowed: DataFrame) -> DataFrame:
    """(frame_idx, det_id) of objects whose label is a remote candidate's, and of carriers that such an object of their frame
    may own. allowed: (child_label, parent_label)."""
    objects = dets.where((F.col("role") == "O") & F.col("label").isin(remote)).select("frame_idx", "det_id", "label")
    owners = objects.select("frame_idx", F.col("label").alias("parent_label")).distinct()
    carriers = dets.where("role = 'C'").join(allowed, F.col("label") == F.col("child_label")).join(owners, ["frame_idx", "parent_label"], "left_semi")
    return objects.select("frame_idx", "det_id").union(carriers.select("frame_idx", "det_id")).distinct()


def best_unit_parents(relations: DataFrame) -> DataFrame:
    """frame_idx, det_id (a unit), its best passing parent (a carrier before an object, then the greatest containment, then
    the first), that parent's role, and ``units``, how many passing units the parent has."""
    passing = relations.where("child_role = 'U' and pass_threshold and parent_role in ('C', 'O')")
    units = F.count("*").over(Window.partitionBy("frame_idx", "parent_det_id"))
    best = Window.partitionBy("frame_idx", "child_det_id").orderBy((F.col("parent_role") == "C").desc(), F.desc("contain"), "parent_det_id")
    j = passing.withColumn("units", units).withColumn("rn", F.row_number().over(best)).where("rn = 1")
    return j.select("frame_idx", F.col("child_det_id").alias("det_id"), "parent_det_id", "parent_role", "units")


def small_unsure_units(dets: DataFrame, relations: DataFrame, score: float = 0.7, share: float = 0.25) -> DataFrame:
    """Units below ``score`` whose best parent has at least two units above it, whose median area is more than 1/share of
    theirs; boxes hold their last pixels."""
    area = dets.select("frame_idx", "det_id", "score", inclusive_area().alias("area"))
    siblings = relations.where("child_role = 'U' and pass_threshold").select("frame_idx", "parent_det_id", F.col("child_det_id").alias("det_id")).join(area, ["frame_idx", "det_id"])
    sure = siblings.where(F.col("score") > score).groupBy("frame_idx", "parent_det_id").agg(F.count("*").alias("sure"), F.percentile("area", 0.5).alias("middle"))
    j = best_unit_parents(relations).join(area, ["frame_idx", "det_id"]).join(sure, ["frame_idx", "parent_det_id"])
    return j.where((F.col("score") < score) & (F.col("units") > 1) & (F.col("sure") > 1) & (F.col("middle") > 0) & (F.col("area") < share * F.col("middle"))).select("frame_idx", "det_id")


def border_single_units(dets: DataFrame, relations: DataFrame) -> DataFrame:
    """What goes with a border unit whose best parent has no other passing unit: the unit, that parent, a carrier's objects."""
    border = with_border(dets).where("role = 'U' and border").select("frame_idx", "det_id")
    hit = best_unit_parents(relations).where("units = 1").join(border, ["frame_idx", "det_id"], "left_semi")
    owners = relations.where("edge_type = 'O-C' and pass_threshold").select("frame_idx", F.col("parent_det_id").alias("owner"), F.col("child_det_id").alias("parent_det_id"))
    up = hit.where("parent_role = 'C'").join(owners, ["frame_idx", "parent_det_id"]).select("frame_idx", F.col("owner").alias("det_id"))
    return hit.select("frame_idx", "det_id").union(hit.select("frame_idx", "parent_det_id")).union(up).distinct()


def linked_or_inside(dets: DataFrame, relations: DataFrame) -> DataFrame:
    """Border detections stay only if a selected or passing relation of the frame has them. Both ends of a relation are taken in
    one pass, and leave as few rows as there are detections before they meet these."""
    ends = relations.where("selected or pass_threshold").select("frame_idx", F.explode(F.array("parent_det_id", "child_det_id")).alias("det_id")).distinct()
    b = with_border(dets)
    return b.where("not border").unionByName(b.where("border").join(ends, ["frame_idx", "det_id"], "left_semi"))


def units_with_parent(dets: DataFrame, final: DataFrame, raw: DataFrame) -> DataFrame:
    """Units stay if a passing final relation or any raw one leads to them; other roles all stay."""
    known = final.where("child_role = 'U' and pass_threshold").select("frame_idx", F.col("child_det_id").alias("det_id")).union(raw.where("child_role = 'U'").select("frame_idx", F.col("child_det_id"))).distinct()
    return dets.where("role <> 'U'").unionByName(dets.where("role = 'U'").join(known, ["frame_idx", "det_id"], "left_semi"))


def without_labels(dets: DataFrame, labels: list[str]) -> DataFrame:
    return dets.where(~F.col("label").isin(labels))


def prefilter_reason(semantic: F.Column, center_inside: F.Column, detector: float = 0.25, coverage: float = 0.90) -> F.Column:
    legal = F.concat_ws("-", "parent_role", "child_role").isin("O-C", "C-U", "O-U")
    return first_of((F.col("parent_node_id") == F.col("child_node_id"), "self_loop"), (~legal, "illegal_role_pair"), (semantic & ~center_inside, "child_center_outside_parent_box"), (F.col("sdet") <= detector, "sdet_below_threshold"), (F.col("coverage") <= coverage, "gcamc_below_threshold"))


def eligibility(nodes: DataFrame, stable_only: bool = False) -> DataFrame:
    """Reason, verdict and confidence of each node, from the node alone: state, support, depth, anchor, quality, border, spread."""
    support = F.least(F.lit(1.0), F.col("n_support") / 2.0)
    reason = first_of(
        (F.col("state") == "rejected", "rejected"),
        (F.col("state") == "stable", "stable"),
        (F.lit(stable_only), "provisional_disallowed_by_stable_only"),
        (F.col("n_support") < 2, "insufficient_total_support_frames"),
        (F.col("n_real") < 1, "insufficient_real_depth_frames"),
        (F.col("anchor_quality") < 0.55, "anchor_quality_below_threshold"),
        (F.col("quality_ema") < 0.50, "geometry_quality_below_threshold"),
        (F.col("border"), "extreme_boundary_anchor"),
        (F.col("spread") > 0.12, "centroid_spread_above_threshold"),
        otherwise="confirmed_provisional",
    )
    out = nodes.withColumn("reason", reason)
    mean = (F.col("anchor_quality") + F.col("quality_ema") + support) / 3.0
    return out.withColumns({"eligible": F.col("reason").isin("stable", "confirmed_provisional"), "graph_confidence": F.when(F.col("reason") == "stable", 1.0).when(F.col("reason") == "confirmed_provisional", mean).otherwise(0.0)})


def fusion_reason(status: F.Column, imputed: F.Column, quality: F.Column, residual: F.Column, stable: F.Column, expansion: F.Column, n_obs: F.Column) -> F.Column:
    """Whether an observation's geometry enters a node: ``accepted``, or the first gate that refuses it."""
    bad = ~status.isin("reliable", "provisional")
    return F.when(bad, F.concat(F.lit("obs_"), status)).otherwise(first_of((imputed & stable, "imputed_geometry_not_fused_into_stable"), (quality < 0.35, "quality_gate"), (residual > 0.12, "centroid_residual_gate"), ((n_obs >= 2) & (expansion > 2.5), "bbox_expansion_gate"), otherwise="accepted"))


def promotion_reason(state: F.Column, support: F.Column, real: F.Column, ema: F.Column, spread: F.Column) -> F.Column:
    return first_of((state == "rejected", "rejected"), (support < 2, "insufficient_support_frames"), (real < 2, "insufficient_real_depth_support"), (ema < 0.55, "low_quality_ema"), (spread > 0.08, "centroid_unstable"), otherwise="stable")


def incident(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes that an edge with a relation text touches."""
    told = edges.where(F.trim("relation_text") != "")
    ends = told.select(F.col("parent_node_id").alias("node_id")).union(told.select("child_node_id")).distinct()
    return nodes.join(ends, "node_id", "left_semi")


def capped(df: DataFrame, by: list[str], order: list, cap: int) -> DataFrame:
    """The first ``cap`` rows of each group; 0 keeps all."""
    if cap <= 0:
        return df
    return df.withColumn("_rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("_rank") <= cap).drop("_rank")


def endpoint_reason(parent_lifted: F.Column, child_lifted: F.Column, parent_node: F.Column, child_node: F.Column) -> F.Column:
    return first_of((~parent_lifted, "parent_not_lifted"), (~child_lifted, "child_not_lifted"), (parent_node.isNull(), "parent_not_associated"), (child_node.isNull(), "child_not_associated"), (parent_node == child_node, "self_loop"))
