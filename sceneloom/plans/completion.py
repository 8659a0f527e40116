"""Objects that no detection gives, made of their stable carriers: owners by priors and evidence, membership links, groups.

Joins find owners, hints and links; components of links are found by a fixpoint, and only inside one component, whose links
have an order, is there a loop. Ids are given a scene.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import labels as L
from ..operators.fixpoint import components, saved
from ..operators.joins import by_suffix


def alike(a, b):
    """Labels of which one is the other's end."""
    return L.compatible(a, b) | L.compatible(b, a)


def owned_by(carriers: DataFrame, atlas: DataFrame, deferred: DataFrame) -> DataFrame:
    """carriers (node_id, label) with ``owner``: the one deferred owner label that the priors allow; none with several.
    atlas: edge_type, parent_label, child_label; deferred: label."""
    prior = atlas.where("edge_type = 'O-C'").select("parent_label", "child_label").distinct()
    allowed = deferred.select(F.col("label").alias("wanted"))
    # both are short lists of labels; a prior's parent meets a deferred label by their ends, either way
    keyed = lambda d, c: d.withColumn("_end", F.substring_index(L.prior_label(F.col(c)), " ", -1))
    owners = keyed(prior, "parent_label").join(keyed(allowed, "wanted"), "_end").where(alike(F.col("parent_label"), F.col("wanted"))).select("parent_label", "child_label").distinct()
    met = by_suffix(carriers.select("node_id", "label"), "label", owners, "child_label").select("node_id", "parent_label").distinct()
    one = met.groupBy("node_id").agg(F.count("*").alias("n"), F.min("parent_label").alias("owner")).where("n = 1").select("node_id", "owner")
    return carriers.join(one, "node_id")


def hinted(owned: DataFrame, hints: DataFrame) -> DataFrame:
    """scene, owner, node_id, frame_idx, parent_det_id: the hints of each carrier whose label fits its owner.
    owned: scene, node_id, owner; hints: node_id, label, frame_idx, parent_det_id."""
    j = owned.select("scene", "node_id", "owner").join(hints, "node_id").where(alike(F.col("owner"), F.col("label")))
    return j.select("scene", "owner", "node_id", "label", "frame_idx", "parent_det_id").distinct()


def membership_links(hints: DataFrame, seen: DataFrame, nodes: DataFrame, gap: float = 0.12, dot: float = 0.90, iou: float = 1e-4, frames: int = 1, hint_frames: int = 1) -> DataFrame:
    """scene, owner, a, b, hint_frames, overlaps, best, normal_dot, gap: pairs of an owner's carriers that share hints in enough
    frames, overlap there often enough, lie alike and near.

    hints: of ``hinted``; seen: frame_idx, node_id, x1..y2; nodes: node_id, normal (array), x1..z2."""
    from ..functions import geometry as G
    from ..operators.joins import BOX3D, box_columns

    key = ["scene", "owner", "label", "frame_idx", "parent_det_id"]
    shared = hints.withColumnRenamed("node_id", "a").join(hints.withColumnRenamed("node_id", "b"), key).where("a < b").select("scene", "owner", "a", "b", "frame_idx").distinct()
    box = lambda k: seen.select("frame_idx", F.col("node_id").alias(k), *[F.col(c).alias(f"{k}_{c}") for c in ("x1", "y1", "x2", "y2")])
    j = shared.join(box("a"), ["frame_idx", "a"], "left").join(box("b"), ["frame_idx", "b"], "left").withColumn("iou", G.iou2d(G.box("a_"), G.box("b_")))
    met = F.coalesce(F.col("iou") > iou, F.lit(False))
    k = j.groupBy("scene", "owner", "a", "b").agg(F.count("*").alias("hint_frames"), F.count_if(met).alias("overlaps"), F.max(F.when(met, F.col("iou"))).alias("best"))
    k = k.where((F.col("hint_frames") >= hint_frames) & (F.col("overlaps") >= frames))
    side = lambda k: nodes.where("normal is not null").select(F.col("node_id").alias(k), F.col("normal").alias(f"{k}_normal"), *[F.col(c).alias(f"{k}_{c}") for c in BOX3D])
    m = k.join(side("a"), "a").join(side("b"), "b")
    m = m.withColumns({"normal_dot": F.abs(F.aggregate(F.zip_with("a_normal", "b_normal", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)), "gap": G.gap3d(box_columns("a_"), box_columns("b_"))})
    return m.where((F.col("normal_dot") >= dot) & (F.col("gap") <= gap)).select("scene", "owner", "a", "b", "hint_frames", "overlaps", "best", "normal_dot", "gap")


def one_plane(normals: list[np.ndarray], dot: float) -> bool:
    """Whether all normals, turned to the first one's side, lie along their sum."""
    n = np.stack(normals)
    n = n * np.where(n @ n[0] < 0, -1.0, 1.0)[:, None]
    total = n.sum(axis=0)
    length = np.linalg.norm(total)
    return bool(length > 1e-12 and (np.abs(n @ total) / length >= dot).all())


def joined(links: DataFrame, nodes: DataFrame, dot: float = 0.90) -> DataFrame:
    """scene, owner, node_id, lead: carriers joined along links in the order of shared frames, overlaps, best overlap and gap;
    a link whose sets' normals together are of no one plane is left out. nodes: node_id, normal."""
    named = lambda c: F.concat_ws("\x1f", F.col("scene").cast("string"), "owner", c)
    ends = saved(links.select("scene", "owner", "a", "b", F.struct((-F.col("hint_frames")).alias("f"), (-F.col("overlaps")).alias("o"), (-F.col("best")).alias("i"), "gap", "a", "b").alias("rank"), named("a").alias("from"), named("b").alias("to")))
    part = components(ends.select(F.col("from").alias("a"), F.col("to").alias("b")))
    own = ends.join(part.select(F.col("node").alias("from"), F.col("label").alias("part")), "from")
    normal = lambda k: nodes.select(F.col("node_id").alias(k), F.col("normal").alias(f"{k}_normal"))
    own = own.join(normal("a"), "a").join(normal("b"), "b").select("scene", "owner", "part", "rank.*", "a_normal", "b_normal")

    def unite(g: pd.DataFrame) -> pd.DataFrame:
        members, lead, normals = {}, {}, {}
        for r in g.itertuples():
            for k, v in ((r.a, r.a_normal), (r.b, r.b_normal)):
                normals[k] = np.asarray(v, float)
                lead.setdefault(k, k)
                members.setdefault(k, [k])
        for r in g.sort_values(["f", "o", "i", "gap", "a", "b"]).itertuples():
            x, y = lead[r.a], lead[r.b]
            both = members[x] + members[y]
            if x == y or not one_plane([normals[k] for k in both], dot):
                continue
            keep, drop = sorted((x, y))
            members.pop(drop)
            members[keep] = both
            for k in both:
                lead[k] = keep
        return pd.DataFrame([(g["scene"].iloc[0], g["owner"].iloc[0], k, v) for k, v in lead.items()], columns=["scene", "owner", "node_id", "lead"])

    return own.groupBy("scene", "owner", "part").applyInPandas(unite, f"scene {dict(links.dtypes)['scene']}, owner string, node_id string, lead string")


def completed(hints: DataFrame, links: DataFrame, nodes: DataFrame, taken: DataFrame, dot: float = 0.90, single_frames: int = 2) -> DataFrame:
    """scene, object_id, owner, node_id: groups of two or more carriers, and carriers alone that were hinted at in enough
    frames, as objects numbered on from the scene's last. hints: of ``hinted``; taken: scene, node_id (all ids that are taken)."""
    sets = joined(links, nodes, dot)
    size = F.count("*").over(Window.partitionBy("scene", "owner", "lead"))
    grouped = sets.withColumn("n", size).where("n > 1").select("scene", "owner", "node_id", "lead", F.lit(0).alias("single"))
    alone = hints.groupBy("scene", "owner", "node_id").agg(F.count_distinct("frame_idx").alias("frames")).where(F.col("frames") >= single_frames)
    alone = alone.join(grouped.select("scene", "owner", "node_id"), ["scene", "owner", "node_id"], "left_anti").select("scene", "owner", "node_id", F.col("node_id").alias("lead"), F.lit(1).alias("single"))
    all_ = saved(grouped.unionByName(alone))
    last = taken.where(F.col("node_id").rlike("^O[0-9]+$")).groupBy("scene").agg(F.max(F.substring("node_id", 2, 18).cast("long")).alias("last"))
    heads = all_.select("scene", "owner", "single", "lead").distinct().join(last, "scene", "left")
    n = F.row_number().over(Window.partitionBy("scene").orderBy("owner", "single", "lead")) + F.coalesce("last", F.lit(0))
    named = heads.select("scene", "owner", "lead", F.concat(F.lit("O"), F.lpad(n.cast("string"), 6, "0")).alias("object_id"))
    return all_.join(named, ["scene", "owner", "lead"]).select("scene", "object_id", "owner", "node_id")
