"""Scores and gates as Column expressions, with the default parameters of a mapping run."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .geometry import clip


def gaussian(distance: Column, sigma: float = 0.08) -> Column:
    return F.exp(-(distance * distance) / (2.0 * sigma * sigma))


def decayed(distance: Column, scale: float) -> Column:
    return F.exp(-distance / scale)


def saturating(n: Column) -> Column:
    return 1.0 - F.exp(-F.greatest(n, F.lit(0)).cast("double"))


def logit(p: Column, epsilon: float = 1e-4) -> Column:
    q = clip(p, epsilon, 1.0 - epsilon)
    return F.log(q / (1.0 - q))


def pair_tau(extent_a: Column, extent_b: Column, floor: float = 0.03, cap: float = 0.15, scale: float = 0.5) -> Column:
    return F.least(F.lit(cap), F.greatest(F.lit(floor), scale * F.greatest(extent_a, extent_b)))


def pair_total(iou: Column, geometry: Column, appearance: Column, semantics: Column) -> Column:
    return 0.5 * iou + (geometry + appearance + semantics) / 6.0


def quality(detection: Column, mask: Column, points: Column, min_points: Column, mad: Column, iqr: Column, cluster: Column, residual: Column, border: Column, tiny_far: Column, area_ratio: Column) -> Column:
    """Six weighted terms less three penalties, in [0, 1]. A null residual is no parent: the full term."""
    out = 0.20 * clip(detection, 0, 1) + 0.15 * clip(mask, 0, 1) + 0.20 * F.least(F.lit(1.0), points / F.greatest(F.lit(1.0), min_points * 3.0))
    out = out + 0.20 * F.exp(-F.greatest(mad, iqr * 0.5) / 0.05) + 0.15 * clip(cluster, 0, 1) + 0.10 * F.coalesce(F.exp(-F.abs(residual) / 0.04), F.lit(1.0))
    out = out - F.when(border, 0.15).otherwise(0.0) - F.when(tiny_far, 0.05).otherwise(0.0) - F.when(area_ratio < 1e-5, 0.10).otherwise(0.0)
    return clip(out, 0, 1)


def status(q: Column) -> Column:
    return F.when(q >= 0.62, "reliable").when(q >= 0.38, "provisional").when(q >= 0.20, "low_quality").otherwise("rejected")


def prior_of(sources: Column) -> Column:
    """The prior of a set of sources; null without one that counts."""
    return F.when(F.array_contains(sources, "atlas"), 0.90).when(F.arrays_overlap(sources, F.array(F.lit("frame_result"), F.lit("graph_frame_result"))), 0.85).when(F.array_contains(sources, "allowed_parent_map"), 0.75)


def hierarchy(prior: Column, distance: Column, observed: Column, ownership_max: Column) -> Column:
    own = clip(ownership_max / 3.0, 0, 1)
    seen = F.when(observed > 0, 0.75 * saturating(observed) + 0.25 * own).otherwise(0.15 * own)
    return 0.3 * prior + 0.3 * decayed(distance, 0.03) + 0.4 * seen


def remote(observed: Column, distance: Column, scale: Column, common_frames: Column, maturity: Column) -> Column:
    covisible = F.least(F.lit(1.0), common_frames / 3.0)
    return 0.40 + 0.25 * saturating(observed) + 0.15 * F.exp(-distance / scale) + 0.15 * covisible + 0.05 * clip(maturity, 0, 1)


def first_of(*cases: tuple[Column, str], otherwise: str = "") -> Column:
    """The name of the first condition that holds."""
    out = F.when(F.coalesce(cases[0][0], F.lit(False)), cases[0][1])
    for condition, name in cases[1:]:
        out = out.when(F.coalesce(condition, F.lit(False)), name)
    return out.otherwise(otherwise)


#: How near an identity must be at least, by role.
IDENTITY_FLOOR = {"O": 0.08, "C": 0.05, "U": 0.03}


def identity_reason(state: Column, overlap: Column, total: Column, semantic: Column, distance: Column, diagonal: Column, role: str, most: float = 0.25, scale: float = 0.5, similar: float = 0.5) -> Column:
    """Why a pair may not share an identity without geometry, or nothing."""
    tau = F.greatest(F.lit(IDENTITY_FLOOR.get(role, 0.0)), F.least(F.lit(most), scale * diagonal))
    return first_of((state != "stable", "node_not_identity_eligible"), (~(overlap > 0.05), "iou_gate"), (total < 0.45, "score_gate"), (semantic < similar, "semantic_gate"), (~(distance < tau), "identity_distance_gate"))
