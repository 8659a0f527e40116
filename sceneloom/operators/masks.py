"""Masks as runs of pixels: (frame_idx, det_id, row, start, length). Coverage is an overlap of runs, in the JVM; shapes that
depend on neighbours (components, closing, filling, hulls) are grouped by detection, whose mask one image bounds, and worked
on many masks at once."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .assign import in_whole_groups

KEY = ["frame_idx", "det_id"]


def areas(runs: DataFrame) -> DataFrame:
    return runs.groupBy(*KEY).agg(F.sum("length").cast("long").alias("area"))


def coverage(runs: DataFrame, pairs: DataFrame) -> DataFrame:
    """pairs (frame_idx, parent_det_id, child_det_id): adds the share of the child's pixels that are the parent's, 0 if it
    has none. Runs meet on frame and row. Runs are many a detection, which Spark's estimate of their size does not know, so
    that none of them is broadcast."""
    side = lambda k, p: runs.select("frame_idx", F.col("det_id").alias(f"{k}_det_id"), "row", F.col("start").alias(f"{p}s"), (F.col("start") + F.col("length")).alias(f"{p}e")).hint("merge")
    j = pairs.join(side("parent", "p"), ["frame_idx", "parent_det_id"]).join(side("child", "c"), ["frame_idx", "child_det_id", "row"])
    both = j.groupBy(*pairs.columns).agg(F.sum(F.greatest(F.lit(0), F.least("pe", "ce") - F.greatest("ps", "cs"))).alias("both"))
    own = areas(runs).withColumnRenamed("det_id", "child_det_id")
    return pairs.join(both.hint("merge"), pairs.columns, "left").join(own.hint("merge"), ["frame_idx", "child_det_id"], "left").withColumn("coverage", F.when(F.coalesce("area", F.lit(0)) > 0, F.coalesce("both", F.lit(0)) / F.col("area")).otherwise(0.0)).drop("both", "area")


def grid(g: pd.DataFrame) -> tuple[np.ndarray, int, int]:
    top, left = int(g["row"].min()), int(g["start"].min())
    m = np.zeros((int(g["row"].max()) - top + 1, int((g["start"] + g["length"]).max()) - left), bool)
    for r, s, n in g[["row", "start", "length"]].itertuples(index=False):
        m[r - top, s - left : s - left + n] = True
    return m, top, left


def to_runs(m: np.ndarray, top: int, left: int) -> pd.DataFrame:
    wide = np.zeros((m.shape[0], m.shape[1] + 2), np.int8)
    wide[:, 1:-1] = m
    step = np.diff(wide, axis=1)
    r, s = np.nonzero(step == 1)
    _, e = np.nonzero(step == -1)
    return pd.DataFrame({"row": r + top, "start": s + left, "length": e - s})


def _shift(m: np.ndarray, dy: int, dx: int) -> np.ndarray:
    out = np.zeros_like(m)
    h, w = m.shape
    out[max(0, dy) : h + min(0, dy), max(0, dx) : w + min(0, dx)] = m[max(0, -dy) : h + min(0, -dy), max(0, -dx) : w + min(0, -dx)]
    return out


def dilated(m: np.ndarray) -> np.ndarray:
    return np.logical_or.reduce([_shift(m, dy, dx) for dy in (-1, 0, 1) for dx in (-1, 0, 1)])


def eroded(m: np.ndarray) -> np.ndarray:
    return np.logical_and.reduce([_shift(m, dy, dx) for dy in (-1, 0, 1) for dx in (-1, 0, 1)])


def parts(m: np.ndarray) -> np.ndarray:
    """Numbers of 8-connected parts from 1, 0 outside: labels spread to the least of their neighbourhood."""
    out = np.where(m, np.arange(1, m.size + 1).reshape(m.shape), 0)
    far = m.size + 2
    while True:
        new = np.where(m, np.minimum.reduce([np.where((x := _shift(out, dy, dx)) > 0, x, far) for dy in (-1, 0, 1) for dx in (-1, 0, 1)]), 0)
        if (new == out).all():
            return np.unique(out, return_inverse=True)[1].reshape(m.shape) if not m.all() else np.ones(m.shape, int)
        out = new


def filled(m: np.ndarray) -> np.ndarray:
    """The mask without holes: what the outside does not reach."""
    wide = np.pad(m, 1)
    seen = np.zeros_like(wide)
    seen[0, :] = seen[-1, :] = seen[:, 0] = seen[:, -1] = True
    while True:
        new = (seen | _shift(seen, 1, 0) | _shift(seen, -1, 0) | _shift(seen, 0, 1) | _shift(seen, 0, -1)) & ~wide
        if (new == seen).all():
            return ~seen[1:-1, 1:-1]
        seen = new


def run_parts(mask: np.ndarray, row: np.ndarray, start: np.ndarray, end: np.ndarray, near: int = 8) -> np.ndarray:
    """The first run of each run's 8- or 4-connected part, over many masks at once; runs in the order of mask, row, start."""
    n = len(row)
    place = np.arange(n)
    wide, high = int(end.max()) + 3 if n else 1, int(row.max()) + 3 if n else 1
    line = (mask * high + row) * wide
    corner = int(near == 4)  # runs that touch at a corner only are one part of 8, two of 4
    low = np.searchsorted(line + end, line + wide + start + corner)  # in the row below, from the first run that ends at its start or later
    top = np.searchsorted(line + start, line + wide + end - corner, side="right")
    low = np.maximum(low, np.searchsorted(line, line + wide))
    count = np.maximum(top - low, 0)
    a = np.repeat(place, count)
    b = np.repeat(low, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    lead = place.copy()
    while len(a):
        least = np.minimum(lead[a], lead[b])
        new = lead.copy()
        np.minimum.at(new, lead[a], least)
        np.minimum.at(new, lead[b], least)
        new = np.minimum(new, new[new])
        if (new == lead).all():
            break
        lead = new
    while (lead[lead] != lead).any():
        lead = lead[lead]
    return lead


def main_runs(runs: tuple[np.ndarray, ...], at_center: bool) -> tuple[np.ndarray, ...]:
    mask, row, start, end = runs
    if not len(mask):
        return runs
    heads = np.flatnonzero(np.append(True, mask[1:] != mask[:-1]))
    size = np.diff(np.append(heads, len(mask)))
    part = run_parts(mask, row, start, end)
    each = lambda f, v: np.repeat(f.reduceat(v, heads), size)
    top, bottom, left, right = each(np.minimum, row), each(np.maximum, row), each(np.minimum, start), each(np.maximum, end)
    cy, cx = top + (bottom - top + 1) // 2, left + (right - left) // 2
    center = each(np.maximum, np.where((row == cy) & (start <= cx) & (cx < end), part, -1))
    area = np.bincount(part, end - start, minlength=len(row))[part].astype(np.int64)
    most = area == each(np.maximum, area)
    if at_center:
        keep = part == np.where(center >= 0, center, each(np.maximum, np.where(most, part, -1)))
    else:
        keep = part == each(np.minimum, np.where(most, part, len(part)))
    return mask[keep], row[keep], start[keep], end[keep]


def main_parts(runs: DataFrame, at_center: bool = True) -> DataFrame:
    """Runs of each mask's part at the center of its bounds, else of its largest part (of equals the last; where the center
    does not count the first)."""
    return over_masks(runs, lambda r: main_runs(r, at_center))


RUN = "frame_idx long, det_id long, row int, start int, length int"


def ellipse(radius: int) -> list[tuple[int, int]]:
    """Rows of a round neighbourhood: (rows down, pixels to either side)."""
    return [(dy, int(np.rint(np.sqrt(radius * radius - dy * dy)))) for dy in range(-radius, radius + 1)]


def swept(mask: np.ndarray, row: np.ndarray, start: np.ndarray, end: np.ndarray, depth: int = 1) -> tuple[np.ndarray, ...]:
    """Runs (mask, row, start, end) of pixels that ``depth`` spans or more cover, in this order; over many masks at once."""
    some = start < end
    mask, row, start, end = mask[some], row[some], start[some], end[some]
    if not len(mask):
        return mask, row, start, end
    low, left = row.min(), start.min()
    high, wide = int(row.max() - low) + 1, int(end.max() - left) + 2
    line = (mask * high + (row - low)) * wide - left
    at = np.concatenate([line + start, line + end])
    order = np.argsort(at, kind="stable")
    level, at = np.cumsum(np.where(order < len(mask), 1, -1)), at[order]
    last = np.append(at[1:] != at[:-1], True)  # the level after all ends at a place
    level, at = level[last] >= depth, at[last]
    step = np.diff(level.astype(np.int8), prepend=0)  # a row's spans all end in it, so that each row begins at level 0
    s, e = at[step == 1], at[step == -1]
    line, x = np.divmod(s, wide)
    return line // high, line % high + low, x + left, x + left + (e - s)


def grown_runs(runs: tuple[np.ndarray, ...], around: list[tuple[int, int]]) -> tuple[np.ndarray, ...]:
    mask, row, start, end = runs
    dy, dx = (np.repeat(np.array(v, np.int64), len(mask)) for v in zip(*around))
    each = lambda v: np.tile(v, len(around))
    return swept(each(mask), each(row) + dy, each(start) - dx, each(end) + dx)


def shrunk_runs(runs: tuple[np.ndarray, ...], around: list[tuple[int, int]]) -> tuple[np.ndarray, ...]:
    mask, row, start, end = runs
    dy, dx = (np.repeat(np.array(v, np.int64), len(mask)) for v in zip(*around))
    each = lambda v: np.tile(v, len(around))
    return swept(each(mask), each(row) - dy, each(start) + dx, each(end) - dx, len(around))


def cut_runs(runs: tuple[np.ndarray, ...], width: int, height: int) -> tuple[np.ndarray, ...]:
    mask, row, start, end = runs
    start, end = np.maximum(start, 0), np.minimum(end, width)
    some = (row >= 0) & (row < height) & (start < end)
    return mask[some], row[some], start[some], end[some]


def closed_runs(runs: tuple[np.ndarray, ...], radius: int, width: int, height: int) -> tuple[np.ndarray, ...]:
    around, far = ellipse(radius), 2 * radius + 2
    mask, row, start, end = cut_runs(grown_runs(runs, around), width, height)
    start, end = np.where(start == 0, -far, start), np.where(end == width, width + far, end)
    edge = np.unique(mask[(row < radius) | (row >= height - radius)])
    outside = np.array([*range(-radius, 0), *range(height, height + radius)], np.int64)
    full = lambda v: np.full(len(edge) * len(outside), v)
    spans = [(mask, np.repeat(edge, len(outside))), (row, np.tile(outside, len(edge))), (start, full(-far)), (end, full(width + far))]
    return cut_runs(shrunk_runs(tuple(np.concatenate(v) for v in spans), around), width, height)


def filled_runs(runs: tuple[np.ndarray, ...]) -> tuple[np.ndarray, ...]:
    """The masks without holes: rows are filled but for the gaps that the outside reaches. Runs in order, apart in a row."""
    mask, row, start, end = runs
    if not len(mask):
        return runs
    first = np.append(True, (mask[1:] != mask[:-1]) | (row[1:] != row[:-1]))
    gap = ~first
    if not gap.any():
        return runs
    new = np.append(True, mask[1:] != mask[:-1])
    heads = np.flatnonzero(new)
    which = np.cumsum(new) - 1
    left, right = np.minimum.reduceat(start, heads) - 1, np.maximum.reduceat(end, heads) + 1
    top, bottom = row[heads], row[np.append(heads[1:], len(row)) - 1]
    # a frame about each mask's bounds: beside the runs, it is background
    rows = bottom - top + 3
    frame = np.repeat(np.arange(len(heads)), rows)
    line = np.arange(rows.sum()) - np.repeat(np.cumsum(rows) - rows, rows) + np.repeat(top - 1, rows)
    m, r = np.concatenate([frame, which]), np.concatenate([line, row])
    s, e = np.concatenate([left[frame], end]), np.concatenate([right[frame], start])
    order, ends = np.lexsort((s, r, m)), np.lexsort((e, r, m))
    m, r, s, e = m[order], r[order], s[order], e[ends]
    some = s < e
    m, r, s, e = m[some], r[some], s[some], e[some]
    lead = run_parts(m, r - r.min(), s - s.min(), e - s.min(), 4)
    outer = np.zeros(len(m), bool)
    outer[lead[np.append(True, m[1:] != m[:-1])]] = True  # a mask's first background run is its frame's upper edge
    hole = ~outer[lead]
    back = mask[heads][m[hole]]
    return swept(np.concatenate([mask, back]), np.concatenate([row, r[hole]]), np.concatenate([start, s[hole]]), np.concatenate([end, e[hole]]))


TASK_ROWS = 500_000


def over_masks(runs: DataFrame, work, rows: int | None = None) -> DataFrame:
    """``work`` on the runs (mask, row, start, end) of many whole masks at once. Tasks grow in number with the runs, which are
    counted or at most ``rows``, so that what one of them sorts does not grow."""
    parts = (runs.count() if rows is None else rows) // TASK_ROWS
    parts = parts + 1 if parts else 0

    def each(g: pd.DataFrame, bounds: np.ndarray) -> pd.DataFrame:
        row, start, length = (g[c].to_numpy(np.int64) for c in ("row", "start", "length"))
        mask, row, start, end = work((np.repeat(np.arange(len(bounds) - 1), np.diff(bounds)), row, start, start + length))
        own = [g[c].to_numpy()[bounds[:-1]][mask] for c in KEY]
        return pd.DataFrame({KEY[0]: own[0], KEY[1]: own[1], "row": row, "start": start, "length": end - start})

    return in_whole_groups(runs.select(*KEY, "row", "start", "length"), KEY, ["row", "start"], each, RUN, parts)


def grown(runs: DataFrame, around: list[tuple[int, int]]) -> DataFrame:
    """Each mask and all pixels that ``around`` reaches from it: spans of the rows about each run, joined."""
    return over_masks(runs, lambda r: grown_runs(r, around))


def shrunk(runs: DataFrame, around: list[tuple[int, int]]) -> DataFrame:
    """The pixels of each mask all of whose ``around`` lies in it: covered by the shortened runs of every row about them."""
    return over_masks(runs, lambda r: shrunk_runs(r, around))


def closed(runs: DataFrame, radius: int, width: int, height: int) -> DataFrame:
    """Each mask without gaps that a round neighbourhood does not fit into; beyond the image all counts as mask."""
    return over_masks(runs, lambda r: closed_runs(r, radius, width, height))


def clipped(runs: DataFrame, left, top, right, bottom) -> DataFrame:
    s, e = F.greatest("start", left), F.least(F.col("start") + F.col("length"), right)
    return runs.where((F.col("row") >= top) & (F.col("row") < bottom) & (s < e)).select(*KEY, "row", s.cast("int").alias("start"), (e - s).cast("int").alias("length"))


def envelope(mask: np.ndarray, row: np.ndarray, x: np.ndarray, side: int) -> tuple[np.ndarray, ...]:
    """mask, row, x of the hull's left (-1) or right (1) side in every row from a mask's first to its last. Comes: the
    outermost pixel of each row with some, in order. A point that lies within the line of its neighbours is no corner."""
    m, r, c = mask, row, side * x
    while len(m) > 2:
        turn = (c[1:-1] - c[:-2]) * (r[2:] - r[1:-1]) - (c[2:] - c[1:-1]) * (r[1:-1] - r[:-2])
        keep = np.ones(len(m), bool)
        keep[1:-1] = (turn > 0) | (m[:-2] != m[1:-1]) | (m[2:] != m[1:-1])
        if keep.all():
            break
        m, r, c = m[keep], r[keep], c[keep]
    last = np.append(m[1:] != m[:-1], True)
    rows = np.where(last, 1, np.append(r[1:] - r[:-1], 1))  # to the next corner
    step = np.arange(rows.sum()) - np.repeat(np.cumsum(rows) - rows, rows)
    rise = np.repeat(np.where(last, 0, np.append(c[1:] - c[:-1], 0)), rows)
    return np.repeat(m, rows), np.repeat(r, rows) + step, side * (np.repeat(c, rows) + rise * step // np.repeat(rows, rows))


def hull_runs(runs: tuple[np.ndarray, ...]) -> tuple[np.ndarray, ...]:
    mask, row, start, end = runs
    if not len(mask):
        return runs
    few = np.bincount(mask, end - start)[mask] < 3
    m, r, s, e = (v[~few] for v in runs)
    if not len(m):
        return runs
    heads = np.flatnonzero(np.append(True, (m[1:] != m[:-1]) | (r[1:] != r[:-1])))
    hm, hr, left = envelope(m[heads], r[heads], np.minimum.reduceat(s, heads), -1)
    _, _, right = envelope(m[heads], r[heads], np.maximum.reduceat(e, heads) - 1, 1)
    some = left <= right
    return tuple(np.concatenate(v) for v in ((mask[few], hm[some]), (row[few], hr[some]), (start[few], left[some]), (end[few], right[some] + 1)))


def hulls(runs: DataFrame) -> DataFrame:
    """Each mask's convex hull, from its runs' ends; a mask of fewer than three pixels stays as it is."""
    return over_masks(runs, hull_runs)


def support(runs: DataFrame, boxes: DataFrame, radius: int, width: int, height: int) -> DataFrame:
    """Where a parent may hold children: its mask within its box, the largest part, without holes, closed, its hull, within
    the box again. boxes: frame_idx, det_id, x1, y1, x2, y2 (pixels; the ends are outside)."""
    within = lambda r: clipped(r.hint("merge").join(boxes.select(*KEY, "x1", "y1", "x2", "y2"), KEY), F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2"))

    def area(r: tuple[np.ndarray, ...]) -> tuple[np.ndarray, ...]:
        whole = filled_runs(main_runs(r, False))
        return hull_runs(closed_runs(whole, radius, width, height) if radius else whole)

    return within(over_masks(within(runs), area, runs.count()))


def shaped(runs: DataFrame, how: str) -> DataFrame:
    """Runs of each mask after ``main`` (its part at the center, else its largest), ``erode``, ``dilate``, ``close`` or ``fill``."""
    if how == "main":
        return main_parts(runs)

    def work(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
        m, top, left = grid(g)
        if how in ("dilate", "close"):
            m, top, left = np.pad(m, 1), top - 1, left - 1
        m = {"erode": eroded, "dilate": dilated, "close": lambda x: eroded(dilated(x)), "fill": filled}[how](m)
        return to_runs(m, top, left).assign(frame_idx=key[0], det_id=key[1])[["frame_idx", "det_id", "row", "start", "length"]]

    return runs.groupBy(*KEY).applyInPandas(work, "frame_idx long, det_id long, row int, start int, length int")
