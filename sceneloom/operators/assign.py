"""Optimal one-to-one assignment and greedy suppression inside bounded groups (a frame and role, a sequence and subset).

A group is one frame's detections or one sequence's nodes; ``solve`` is the shortest augmenting path method with
potentials on a dense cost matrix, in numpy.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def solve(cost: np.ndarray) -> np.ndarray:
    """For each row of an n x m matrix, n <= m, its column in an assignment of least total cost."""
    n, m = cost.shape
    u, v = np.zeros(n + 1), np.zeros(m + 1)
    owner, way = np.zeros(m + 1, int), np.zeros(m + 1, int)
    for i in range(1, n + 1):
        owner[0], j0 = i, 0
        least, done = np.full(m + 1, np.inf), np.zeros(m + 1, bool)
        while True:
            done[j0] = True
            free = np.flatnonzero(~done[1:]) + 1
            reduced = cost[owner[j0] - 1, free - 1] - u[owner[j0]] - v[free]
            better = reduced < least[free]
            least[free[better]] = reduced[better]
            way[free[better]] = j0
            j1 = free[np.argmin(least[free])]
            step = least[j1]
            u[owner[done]] += step
            v[done] -= step
            least[~done] -= step
            j0 = j1
            if not owner[j0]:
                break
        while j0:
            owner[j0], j0 = owner[way[j0]], way[j0]
    out = np.empty(n, int)
    out[owner[1:][owner[1:] > 0] - 1] = np.flatnonzero(owner[1:] > 0)
    return out


def best_pairs(score: np.ndarray, valid: np.ndarray) -> list[tuple[int, int]]:
    """Pairs of greatest total score; a row or column may stay alone."""
    n, m = score.shape
    if not n or not m or not valid.any():
        return []
    best = np.where(valid, score, -1.0)
    first = best.argmax(axis=1)
    some = np.flatnonzero(best[np.arange(n), first] > 0)
    if len(np.unique(first[some])) == len(some) and not (valid & (score == 0)).any():
        return [(int(i), int(first[i])) for i in some]  # each row can have the best that it could
    cost = np.zeros((n, m + n))
    cost[:, :m] = np.where(valid, -score, 1e9)
    return [(i, int(j)) for i, j in enumerate(solve(cost)) if j < m and valid[i, j]]


def most_pairs(quality: np.ndarray, valid: np.ndarray) -> list[tuple[int, int]]:
    """As many pairs as can be, and of those the greatest total quality."""
    n, m = quality.shape
    if not n or not m or not valid.any():
        return []
    return best_pairs(np.where(valid, quality + max(n, m) + 1, 0.0), valid)


def _boxes(g: pd.DataFrame) -> np.ndarray:
    return g[["x1", "y1", "x2", "y2"]].to_numpy(float)


def _overlap(a: np.ndarray, b: np.ndarray, pixel: float = 0.0) -> np.ndarray:
    """Areas of overlap of one box with others; with ``pixel`` 1, of boxes whose last pixels belong to them."""
    w = np.minimum(a[2], b[:, 2]) - np.maximum(a[0], b[:, 0]) + pixel
    h = np.minimum(a[3], b[:, 3]) - np.maximum(a[1], b[:, 1]) + pixel
    return np.maximum(w, 0) * np.maximum(h, 0)


def _area(b: np.ndarray, pixel: float = 0.0) -> np.ndarray:
    return np.maximum(b[..., 2] - b[..., 0] + pixel, 0) * np.maximum(b[..., 3] - b[..., 1] + pixel, 0)


def in_whole_groups(df: DataFrame, by: list[str], order: list, work: Callable[[pd.DataFrame, np.ndarray], pd.DataFrame], schema, parts: int = 0) -> DataFrame:
    """``work`` on whole groups, many at a time, whose rows stand together in ``order``; it gets where they begin, and the
    end. A group that a batch cuts is carried on. For many small groups. ``parts``: how many tasks share them, if Spark's own
    number does not suit."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: pd.DataFrame | None = None
        for batch in batches:
            g = batch if held is None else pd.concat([held, batch], ignore_index=True)
            if not len(g):
                continue
            new = np.zeros(len(g), bool)
            for c in by:
                v = g[c].to_numpy()
                new[1:] |= v[1:] != v[:-1]
            starts = np.concatenate([[0], np.flatnonzero(new)])
            held = g.iloc[starts[-1] :]
            if starts[-1]:
                yield work(g.iloc[: starts[-1]], starts)
        if held is not None:
            yield work(held, np.array([0, len(held)]))

    return (df.repartition(parts, *by) if parts else df.repartition(*by)).sortWithinPartitions(*by, *order).mapInPandas(run, schema)


def assigned(pairs: DataFrame, by: list[str], left: str, right: str, score: str, most: bool = False) -> DataFrame:
    """pairs: one row a legal pair with its score; the chosen ones, group by group."""

    def choose(g: pd.DataFrame, bounds: np.ndarray) -> pd.DataFrame:
        keep = np.zeros(len(g), bool)
        ends, value = [g[c].to_numpy() for c in (left, right)], g[score].to_numpy(float)
        for a, b in zip(bounds[:-1], bounds[1:], strict=True):
            (rows, i), (cols, j) = (np.unique(x[a:b], return_inverse=True) for x in ends)
            s, at = np.zeros((len(rows), len(cols))), np.full((len(rows), len(cols)), -1)
            s[i, j], at[i, j] = value[a:b], np.arange(a, b)
            keep[[at[p] for p in (most_pairs if most else best_pairs)(s, at >= 0)]] = True
        return g[keep]

    cols = [*by, left, right, score]
    return in_whole_groups(pairs.select(*cols), by, [left, right], choose, pairs.select(*cols).schema)


def kept_by(df: DataFrame, by: list[str], order: list, mask: Callable[[pd.DataFrame], np.ndarray]) -> DataFrame:
    """The rows that ``mask`` keeps of each group."""

    def work(g: pd.DataFrame, bounds: np.ndarray) -> pd.DataFrame:
        return g[np.concatenate([mask(g.iloc[a:b]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)])]

    return in_whole_groups(df, by, order, work, df.schema)


def suppressed(dets: DataFrame, by: list[str], iou: float) -> DataFrame:
    """Greedy non-maximum suppression in order of score."""

    def mask(g: pd.DataFrame) -> np.ndarray:
        b = _boxes(g)
        area, alive = _area(b), np.ones(len(g), bool)
        for i in range(len(g)):
            if alive[i]:
                both = _overlap(b[i], b)
                hit = both / np.maximum(area[i] + area - both, 1e-9) > iou
                hit[: i + 1] = False
                alive[hit] = False
        return alive

    return kept_by(dets, by, [F.desc("score"), "det_id"], mask)


def suppressed_by_role(dets: DataFrame, by: list[str], iou: float) -> DataFrame:
    """Greedy suppression of units, carriers, objects in this order, each by score, across roles; boxes hold their last
    pixels. An object that overlaps a later object of its score (within 1e-6) goes with all that it overlaps."""

    def mask(g: pd.DataFrame) -> np.ndarray:
        b, thing, score = _boxes(g), (~g["role"].isin(["U", "C"])).to_numpy(), g["score"].to_numpy()
        area, alive = _area(b, 1.0), np.ones(len(g), bool)
        for i in range(len(g)):
            if not alive[i]:
                continue
            both = _overlap(b[i], b, 1.0)
            hit = (both / (area[i] + area - both + 1e-9) > iou) & alive
            hit[: i + 1] = False
            if thing[i] and (hit & thing & (np.abs(score - score[i]) <= 1e-6)).any():
                alive[i] = False
            alive[hit] = False
        return alive

    rank = F.when(F.col("role") == "U", 0).when(F.col("role") == "C", 1).otherwise(2)
    return kept_by(dets, by, [rank, F.desc("score"), "det_id"], mask)


def covered_away(dets: DataFrame, by: list[str], share: float = 0.95) -> DataFrame:
    """Drops the lower-scored of two detections of a role if one covers ``share`` of the other; units only of one label.
    Boxes hold their last pixels."""

    def mask(g: pd.DataFrame) -> np.ndarray:
        b, role, label = _boxes(g), g["role"].to_numpy(), g["label"].to_numpy()
        area, alive = _area(b, 1.0), np.ones(len(g), bool)
        for i in range(len(g)):
            if alive[i]:
                both = _overlap(b[i], b, 1.0)
                hit = (both >= share * np.maximum(np.minimum(area, area[i]), 1e-9)) & (role == role[i]) & ((role != "U") | (label == label[i]))
                hit[: i + 1] = False
                alive[hit] = False
        return alive

    return kept_by(dets, by, [F.desc("score"), "det_id"], mask)
