"""Reports of a graph run: endpoints that no node stands for, children without a parent, whether the run is complete.

Each is a few grouped counts over candidates, joined by node; what a report says of the whole run is one row of sums.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scores as S

OBJECT_EDGES = ("O-C", "O-U")


def endpoints(candidates: DataFrame, associations: DataFrame, aliases: DataFrame, nodes: DataFrame) -> DataFrame:
    """candidates with parent_node_id and child_node_id after merged tracks, their states, and ``reason``: the first of five
    why an endpoint is unresolved, empty if none is.

    candidates: frame_key, parent_det_id, child_det_id; associations: frame_key, det_id (null: a frame without matches),
    node_id; aliases: source, canonical; nodes: node_id, state."""
    known = associations.where("det_id is not null").select("frame_key", "det_id", "node_id").join(aliases.select(F.col("source").alias("node_id"), "canonical"), "node_id", "left")
    known = known.select("frame_key", "det_id", F.coalesce("canonical", "node_id").alias("node_id"))
    j = candidates.join(associations.select("frame_key").distinct().withColumn("_frame", F.lit(True)), "frame_key", "left")
    for side in ("parent", "child"):
        j = j.join(known.select("frame_key", F.col("det_id").alias(f"{side}_det_id"), F.col("node_id").alias(f"{side}_node_id")), ["frame_key", f"{side}_det_id"], "left")
        j = j.join(nodes.select(F.col("node_id").alias(f"{side}_node_id"), F.col("state").alias(f"{side}_node_state"), F.lit(True).alias(f"_{side}")), f"{side}_node_id", "left")
    parent, child = F.col("parent_node_id").isNull(), F.col("child_node_id").isNull()
    reason = S.first_of(
        (F.col("_frame").isNull(), "association_frame_missing"),
        (parent & child, "both_detection_endpoints_unmapped"),
        (parent, "parent_detection_endpoint_unmapped"),
        (child, "child_detection_endpoint_unmapped"),
        (F.col("_parent").isNull() | F.col("_child").isNull(), "canonical_node_missing"),
    )
    return j.withColumn("reason", reason).drop("_frame", "_parent", "_child")


def unlinked(nodes: DataFrame, candidates: DataFrame, local: DataFrame, final: DataFrame) -> DataFrame:
    """Carriers and units without a local parent: node_id, label, role, reason, isolated, and how many of their candidates
    there are, with an eligible parent, with a measured object, with a carrier.

    nodes: the eligible ones (node_id, label, role); candidates: parent_node_id, child_node_id, edge_type, s2d_score,
    pass_prefilter; local, final: edges (parent_node_id, child_node_id)."""
    open_ = nodes.where("role in ('C', 'U')").join(local.select(F.col("child_node_id").alias("node_id")), "node_id", "left_anti")
    eligible = nodes.select(F.col("node_id").alias("parent_node_id"), F.lit(True).alias("mapped"))
    of_object = F.col("mapped") & F.col("edge_type").isin(*OBJECT_EDGES)
    c = candidates.where("child_node_id is not null").join(eligible, "parent_node_id", "left").withColumn("mapped", F.coalesce("mapped", F.lit(False)))
    c = c.groupBy(F.col("child_node_id").alias("node_id")).agg(
        F.count("*").alias("candidates"),
        F.count_if("mapped").alias("mapped"),
        F.count_if(of_object).alias("objects"),
        F.count_if(of_object & F.col("s2d_score").isNotNull()).alias("measured"),
        F.count_if(of_object & F.col("pass_prefilter")).alias("passed"),
        F.count_if(F.col("mapped") & (F.col("edge_type") == "C-U")).alias("carriers"),
    )
    ends = final.select(F.col("parent_node_id").alias("node_id")).union(final.select("child_node_id")).distinct().withColumn("incident", F.lit(True))
    j = open_.join(c, "node_id", "left").join(ends, "node_id", "left").fillna(0, ["candidates", "mapped", "objects", "measured", "passed", "carriers"])
    bare = (F.col("objects") > 0) & (F.col("measured") == 0)
    reason = S.first_of(
        (F.col("candidates") == 0, "no_parent_candidate"),
        (F.col("mapped") == 0, "parent_unmapped_or_ineligible"),
        (F.col("carriers") > 0, "carrier_candidate_rejected_by_local_evidence_or_conflict"),
        (bare & (F.col("passed") > 0), "object_s2d_unavailable_after_prefilter"),
        (bare, "object_candidate_not_instance_validated"),
        otherwise="parent_resolution_unavailable",
    )
    return j.select("node_id", "label", "role", reason.alias("reason"), F.col("incident").isNull().alias("isolated"), "candidates", "mapped", "measured", "carriers")


def completeness(nodes: DataFrame, candidates: DataFrame, local: DataFrame, final: DataFrame, derived: DataFrame | None = None, capped: bool = False, smoke: bool = False) -> DataFrame:
    """One row: counts, whether the graph is complete, and the reasons why it is not, in their order.

    nodes, local, final: as for ``unlinked``; local edges have edge_type, object_parent_id and carrier_object_parent_id (of
    the unit's and of the carrier's object), final ones relation_text; candidates also s2d_available, relation_text and
    ``reason`` of an unresolved endpoint; derived: object edges (child_node_id) of completed objects."""
    objects = F.col("edge_type").isin(*OBJECT_EDGES)
    told = lambda c: F.trim(F.coalesce(c, F.lit(""))) != ""
    mapped = F.col("parent_node_id").isNotNull() & F.col("child_node_id").isNotNull()
    sums = candidates.agg(
        F.count("*").alias("candidates"),
        F.count_if(objects & F.col("pass_prefilter")).alias("prefilter"),
        F.count_if(objects & F.col("pass_prefilter") & F.col("s2d_available")).alias("available"),
        F.count_if(F.col("s2d_available") & ~mapped & (F.col("reason") == "")).alias("unaccounted"),
        F.count_if(F.col("reason") != "").alias("unresolved"),
    )
    offered = candidates.where(objects & told(F.col("relation_text"))).select(F.col("child_node_id").alias("node_id")).union(local.where("edge_type = 'C-U' and carrier_object_parent_id is not null").select("child_node_id"))
    if derived is not None:
        offered = offered.union(derived.select("child_node_id"))
    orphans = nodes.where("role in ('C', 'U')").join(offered, "node_id", "left_anti").agg(F.count("*").alias("orphans"))
    alone = unlinked(nodes, candidates, local, final).agg(F.count("*").alias("alone"))
    known = lambda side: nodes.select(F.col("node_id").alias(f"{side}_node_id"), F.lit(True).alias(f"_{side}"))
    edges = final.join(known("parent"), "parent_node_id", "left").join(known("child"), "child_node_id", "left")
    edges = edges.agg(F.count_if(F.col("_parent").isNull() | F.col("_child").isNull()).alias("illegal"), F.count_if(~told(F.col("relation_text"))).alias("untold"))
    many = local.groupBy("child_node_id").agg(F.count("*").alias("n")).agg(F.count_if(F.col("n") > 1).alias("many"))
    cross = local.agg(F.count_if((F.col("edge_type") == "C-U") & (F.col("object_parent_id") != F.col("carrier_object_parent_id"))).alias("cross"))
    row = sums
    for other in (orphans, alone, edges, many, cross):  # each one row
        row = row.crossJoin(other)
    why = [
        (F.col("prefilter") > F.col("available"), "s2d_coverage_incomplete"),
        (F.col("unaccounted") > 0, "endpoint_mapping_unaccounted"),
        (F.col("unresolved") > 0, "endpoint_mapping_sparse"),
        (F.col("orphans") > 0, "graph_eligible_child_has_no_object_candidate"),
        (F.col("alone") > 0, "graph_eligible_child_has_no_local_parent"),
        (F.col("illegal") > 0, "illegal_node_id"),
        (F.col("untold") > 0, "functional_predicate_missing"),
        (F.col("many") > 0, "multiple_immediate_parents"),
        (F.col("cross") > 0, "cross_object_carrier_unit_edge"),
        (F.lit(capped), "artificial_edge_cap"),
        (F.lit(smoke), "smoke_mode"),
    ]
    row = row.withColumn("reasons", F.array_compact(F.array(*[F.when(c, name) for c, name in why])))
    complete = (F.size("reasons") == 0) & (F.col("candidates") > 0)
    return row.select("candidates", "prefilter", "available", "unresolved", "orphans", "alone", complete.alias("complete"), F.array_join("reasons", ",").alias("reasons"))
