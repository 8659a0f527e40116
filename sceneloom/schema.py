"""Schemas of the engine's tables and the checks that a table has to pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Tables by name, as DDL. Null scores are missing, never 0.
TABLES = {
    "cameras": "sequence string, camera_id int, model string, width int, height int, fx double, fy double, cx double, cy double, depth_scale double",
    "poses": "sequence string, frame_key string, qw double, qx double, qy double, qz double, tx double, ty double, tz double",
    "frames": "sequence string, frame_idx long, frame_key string, source_index long, rgb_path string, depth_path string",
    "detections": "frame_idx long, det_id long, label string, role string, score double, x1 double, y1 double, x2 double, y2 double",
    "mask_runs": "frame_idx long, det_id long, row int, start int, length int",
    "relations_2d": "frame_idx long, stage string, edge_type string, parent_det_id long, child_det_id long, contain double, mask_contain double, pass_threshold boolean, selected boolean, relation_text string",
    "observations": "observation_id string, frame_idx long, det_id long, label string, role string, score double, quality double, status string, imputed boolean, points array<struct<x:double,y:double,z:double,r:int,g:int,b:int>>, cx double, cy double, cz double",
    "nodes": "node_id string, role string, label string, state string, cx double, cy double, cz double, anchor_quality double, quality_ema double, support_frames array<bigint>, semantic_feature array<float>",
    "pair_scores": "frame_idx long, observation_id string, node_id string, distance double, tau double, iou double, geometry double, appearance double, semantics double, total double, valid boolean, reason string, selected boolean",
    "associations": "frame_idx long, det_id long, node_id string, kind string",
    "edge_candidates": "candidate_hash string, frame_idx long, frame_key string, edge_type string, parent_node_id string, child_node_id string, s2d_score double, selected boolean, pass_threshold boolean, sources array<string>, relation_text string",
    "graph_edges": "edge_type string, parent_node_id string, child_node_id string, relation_text string, score double, status string, provisional boolean",
    "eval_report": "sequence string, subset string, matched long, truth long, recall double",
}

ROLES, EDGE_TYPES = ("O", "C", "U"), ("O-C", "C-U", "O-U", "remote")
#: Readers take versions up to this one; writers write it.
VERSION = 3


def dense_ids(dets: DataFrame) -> DataFrame:
    """Frames whose detection ids are not 0 to n - 1."""
    return dets.groupBy("frame_idx").agg(F.count("*").alias("n"), F.count_distinct("det_id").alias("ids"), F.min("det_id").alias("low"), F.max("det_id").alias("high")).where("n <> ids or low <> 0 or high <> n - 1")


def violations(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """rule, n: how many rows break each rule; a null verdict breaks it too."""
    one = df.agg(*[F.count_if(~F.coalesce(c, F.lit(False))).alias(k) for k, c in rules.items()])
    return one.select(F.explode(F.array(*[F.struct(F.lit(k).alias("rule"), F.col(k).alias("n")) for k in rules])).alias("x")).select("x.rule", "x.n")


def detection_rules() -> dict[str, Column]:
    finite = lambda c: ~F.isnan(F.col(c).cast("double")) & (F.abs(F.col(c)) < float("inf"))
    return {"role": F.col("role").isin(*ROLES), "score": F.col("score").between(0, 1), "box": (F.col("x2") > F.col("x1")) & (F.col("y2") > F.col("y1")), "finite": finite("x1") & finite("y1") & finite("x2") & finite("y2"), "label": F.trim("label") != ""}


def migrated(df: DataFrame) -> DataFrame:
    """Detections of any version in the present form: raw boxes and masks where they are, else the older columns."""
    have = set(df.columns)
    if "schema_version" in have:
        newer = df.where(F.col("schema_version") > VERSION).limit(1).count()
        if newer:
            raise ValueError(f"a row's schema_version is above {VERSION}")
    first = lambda *names: F.coalesce(*[F.col(n) for n in names if n in have]) if any(n in have for n in names) else F.lit(None)
    return df.withColumns({"box": first("box_raw", "box_xyxy", "box"), "schema_version": F.lit(VERSION)})
