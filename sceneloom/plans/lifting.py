"""Lifting pixels to points, and the choice of a parent among 2D relations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import geometry as G
from ..operators.aggregates import quantiles, with_groups
from ..operators.fixpoint import saved, stored


def banded(pixels: DataFrame, by: str, prior: DataFrame | None = None, floor: float = 0.025, least_mad: float = 0.002, scale: float = 3.0) -> DataFrame:
    """Pixels whose depth lies in the band about their detection's median; with a prior (by, depth) its band is united. Pixels
    are read several times, so they should be stored."""
    m = quantiles(pixels, [by], F.col("z"), {"_mid": 0.5})
    p = with_groups(pixels, m, [by])
    mad = quantiles(p, [by], F.abs(F.col("z") - F.col("_mid")), {"_mad": 0.5})
    band = F.greatest(F.lit(floor), scale * F.greatest("_mad", F.lit(least_mad)))
    p = with_groups(pixels, saved(m.join(mad, by)), [by])
    near = F.abs(F.col("z") - F.col("_mid")) <= band
    if prior is not None:
        p = p.join(prior.select(by, F.col("depth").alias("_prior")), by, "left")
        own = F.coalesce(F.abs(F.col("z") - F.col("_prior")) <= F.lit(floor), F.lit(False))
        enough = F.count_if(own).over(Window.partitionBy(by)) >= 3
        near = near | (own & enough)
    return p.where(near).select(*pixels.columns)


def lifted(pixels: DataFrame, by: str, camera: tuple[float, float, float, float], least: int, pose: tuple | None = None, prior: DataFrame | None = None, axes: str = "xyz") -> DataFrame:
    """pixels (by, u, v, z): one observation a detection: n, centroid (mean), 2-98 percentile bounds on ``axes``, of at least
    ``least`` points. pose is (rotation of 9, translation of 3) as Columns. A detection's pixels may be any number: they are
    stored once and counted, never held."""
    valid = stored(pixels.where(~F.isnan("z") & F.col("z").between(0.1, 10.0)), "pixels")
    xyz = G.back_projected(F.col("u"), F.col("v"), F.col("z"), *[F.lit(float(k)) for k in camera])
    if pose is not None:
        xyz = [a + b for a, b in zip(G.turned(pose[0], xyz), pose[1], strict=True)]
    pts = banded(valid, by, prior).select(by, *[c.alias(n) for c, n in zip(xyz, ("wx", "wy", "wz"), strict=True)])
    out = pts.groupBy(by).agg(F.count("*").alias("n"), *[F.avg(f"w{c}").alias(f"c{c}") for c in "xyz"]).where(F.col("n") >= least)
    for c in axes:
        out = out.join(quantiles(pts, [by], F.col(f"w{c}"), {f"{c}1": 0.02, f"{c}2": 0.98}), by)
    return out


def decided(relations: DataFrame, carrier: float = 0.7, unit: float = 0.2, lead: float = 0.1) -> DataFrame:
    """relations with ``mask`` (mask containment): the parent of each child and type, or none, and how it was chosen."""
    w = Window.partitionBy("frame_idx", "edge_type", "child_det_id")
    o = w.orderBy(F.desc("mask"), "parent_det_id")
    r = relations.where("pass_threshold").withColumns({"n": F.count("*").over(w), "rn": F.row_number().over(o), "second": F.lead("mask").over(o)}).where("rn = 1")
    good = (F.col("mask") >= F.when(F.col("child_role") == "U", unit).otherwise(carrier)) & (F.round(F.col("mask") - F.col("second"), 9) >= lead)
    how = F.when(F.col("n") == 1, "single").when(good, "mask").otherwise("ambiguous")
    return r.select("frame_idx", "edge_type", "child_det_id", F.when(how != "ambiguous", F.col("parent_det_id")).alias("parent_det_id"), how.alias("decision"))


def within_capacity(relations: DataFrame, pairs: DataFrame, lead: float = 0.1) -> DataFrame:
    """Passing relations of label pairs that hold one child a parent: the best mask if clear of the second, else none; all
    others as they are. pairs: parent_label, child_label."""
    r = relations.where("pass_threshold").join(F.broadcast(pairs.withColumn("one", F.lit(True))), ["parent_label", "child_label"], "left")
    w = Window.partitionBy("frame_idx", "parent_det_id", "parent_label", "child_label")
    o = w.orderBy(F.desc("mask"), "child_det_id")
    r = r.withColumns({"n": F.count("*").over(w), "rn": F.row_number().over(o), "second": F.lead("mask").over(o)})
    keep = F.col("one").isNull() | (F.col("n") == 1) | ((F.col("rn") == 1) & (F.round(F.col("mask") - F.col("second"), 9) >= lead))
    return r.where(keep).select(*relations.columns)
