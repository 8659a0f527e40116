"""Ordered folds over a key's rows: sorted arrays and ``aggregate``, which stay in the JVM; the posterior, whose state is a
table of parents, in numpy, a child a group.

An array is one key's history (a node's observations, a child's frames), which the map bounds. Order is always a column.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import scores as S
from ..functions import vectors as V
from .fixpoint import saved

NULL_PARENT = "__no_parent__"


def ordered(df: DataFrame, by: list[str], order: list[str], values: list[str]) -> DataFrame:
    """by and ``steps``: the values of each key in order."""
    return df.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(*order, *values))).alias("steps"))


def average_vector(steps: Column, value: str, alpha: float) -> Column:
    """Moving average of vectors, of length 1 after each step."""
    first = V.unit(F.get(steps, F.lit(0))[value])
    return F.aggregate(F.slice(steps, 2, F.greatest(F.size(steps), F.lit(1))), first, lambda a, s: V.unit(F.zip_with(a, s[value], lambda x, y: (1 - alpha) * x + alpha * y)))


def weighted_direction(steps: Column, value: str, weight: str) -> Column:
    """Sum of weighted vectors, brought to length 1 after each step, so that order counts."""
    first = V.unit(F.get(steps, F.lit(0))[value])
    return F.aggregate(F.slice(steps, 2, F.greatest(F.size(steps), F.lit(1))), first, lambda a, s: V.unit(F.zip_with(a, s[value], lambda x, y: x + s[weight] * y)))


def calendar(frames: DataFrame, rows: int = 500_000) -> DataFrame:
    """frame_idx and ``t``: its number from 1 on. Frames are sorted by ranges; a range goes on from the counts before it."""
    own = saved(frames.select("frame_idx").distinct())
    parts = max(int(frames.sparkSession.conf.get("spark.sql.shuffle.partitions")), own.count() // rows)
    own = saved(own.repartitionByRange(parts, "frame_idx").withColumn("_part", F.spark_partition_id()))
    n = own.groupBy("_part").agg(F.count("*").alias("n"))  # a row a range
    before = n.withColumn("_before", F.coalesce(F.sum("n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n")
    t = F.row_number().over(Window.partitionBy("_part").orderBy("frame_idx")) + F.col("_before")
    return saved(own.join(before, "_part").select("frame_idx", t.cast("long").alias("t")))


def segments(evidence: DataFrame, frames: DataFrame, entropy: float = 0.1, temporal: float = 0.05) -> DataFrame:
    """child_node_id, since, until, parents, odds, p: the posterior of a child's parents so far and of no parent, for runs of
    frames (numbers of ``calendar``) in which it is the same, from the child's first evidence to the last frame.

    evidence: frame_idx, child_node_id, parent_node_id, s2d_score (null: unscored, counts as a frame only). Every frame
    optimizes every known child again; frames without evidence of a child apply one fixed map, which draws nearer to its
    fixed point by a factor of temporal / (entropy + temporal), so that a run of them costs a few dozen steps at most,
    however long it is. Increments are summed in Spark; a child's frames with evidence are one group.
    """
    adds = evidence.where("s2d_score is not null").groupBy("child_node_id", "frame_idx", "parent_node_id").agg(F.sum(S.logit(F.col("s2d_score"))).alias("gain"))
    end = frames.agg(F.max("t")).first()[0] or 0

    def fold(g: pd.DataFrame) -> pd.DataFrame:
        names = sorted({*g["parent_node_id"].dropna(), NULL_PARENT})
        at = {k: i for i, k in enumerate(names)}
        odds, p = np.zeros(len(names)), np.full(len(names), np.nan)
        seen = np.array([k == NULL_PARENT for k in names])
        g = g.sort_values("t", kind="stable")
        times, starts = np.unique(g["t"].to_numpy(), return_index=True)
        gain, parent = g["gain"].to_numpy(float), np.array([at.get(k, -1) for k in g["parent_node_id"]])
        rows = []
        for k, (t, a) in enumerate(zip(times, starts)):
            z, until = (starts[k + 1], int(times[k + 1]) - 1) if k + 1 < len(times) else (len(g), end)
            there = parent[a:z] >= 0
            np.add.at(odds, parent[a:z][there], gain[a:z][there])
            seen[parent[a:z][there]] = True
            own, now = [n for n, s in zip(names, seen) if s], int(t)
            while now <= until:
                before = np.where(np.isnan(p), 1.0 / seen.sum(), p)[seen]
                before = before / max(before.sum(), 1e-12)
                logit = (odds[seen] + temporal * np.log(np.maximum(before, 1e-9))) / (entropy + temporal)
                e = np.exp(logit - logit.max())
                p[seen] = e / e.sum()
                still = now > t and np.abs(p[seen] - before).max() < 1e-13
                last = until if still else now
                rows.append((g["child_node_id"].iloc[0], now, last, own, odds[seen].tolist(), p[seen].tolist()))
                now = last + 1
        return pd.DataFrame(rows, columns=["child_node_id", "since", "until", "parents", "odds", "p"])

    numbered = adds.join(frames, "frame_idx").select("child_node_id", "t", "parent_node_id", "gain")
    return numbered.groupBy("child_node_id").applyInPandas(fold, "child_node_id string, since long, until long, parents array<string>, odds array<double>, p array<double>")


def each_frame(runs: DataFrame, frames: DataFrame) -> DataFrame:
    """child_node_id, frame_idx, parents, odds, p: a row for each frame of each run."""
    every = runs.withColumn("t", F.explode(F.sequence("since", "until"))).drop("since", "until")
    return every.join(frames, "t").drop("t")


def posteriors(evidence: DataFrame, entropy: float = 0.1, temporal: float = 0.05) -> DataFrame:
    """child_node_id, frame_idx, parents, odds, p: the posterior after each frame, from a child's first evidence on."""
    frames = calendar(evidence)
    return each_frame(segments(evidence, frames, entropy, temporal), frames)


def switches(post: DataFrame) -> DataFrame:
    """child_node_id, frame_idx, top (the first of the posterior: no parent before others as likely, then by name) and
    whether it differs from what was first, by name only, a frame before."""
    each = F.transform(F.arrays_zip("parents", "p"), lambda x: F.struct((-F.round(x["p"], 9)).alias("order"), (x["parents"] != NULL_PARENT).alias("real"), x["parents"].alias("name")))
    plain = F.transform(each, lambda x: F.struct(x["order"].alias("order"), x["name"].alias("name")))
    top = post.select("child_node_id", "frame_idx", F.array_min(each)["name"].alias("top"), F.array_min(plain)["name"].alias("plain"))
    before = F.lag("plain").over(Window.partitionBy("child_node_id").orderBy("frame_idx"))
    return top.withColumn("switched", F.coalesce(before != F.col("top"), F.lit(False))).drop("plain")


def decisions(runs: DataFrame, margin: float = 0.05) -> DataFrame:
    """The best real parent of each child after the last frame, and whether it is confirmed or provisional. runs: ``segments``."""
    last = runs.groupBy("child_node_id").agg(F.max_by(F.struct("parents", "odds", "p"), "until").alias("s")).select("child_node_id", "s.*")
    flat = last.select("child_node_id", F.explode(F.arrays_zip("parents", "odds", "p")).alias("x")).select("child_node_id", F.col("x.parents").alias("parent"), F.col("x.odds").alias("odds"), F.col("x.p").alias("p"))
    none = flat.where(F.col("parent") == NULL_PARENT).select("child_node_id", F.col("p").alias("none"))
    from .windows import top_with_margin

    real = flat.where(F.col("parent") != NULL_PARENT).withColumn("p", F.round("p", 9))
    best = top_with_margin(real, ["child_node_id"], "p", ["parent"]).join(none, "child_node_id")
    second = F.col("p") - F.coalesce("margin", F.col("p"))
    lead = F.col("p") - F.greatest("none", second)
    weak = (F.col("odds") <= 0) | (F.col("p") <= F.col("none")) | (lead < margin)
    return best.select("child_node_id", F.col("parent").alias("parent_node_id"), F.round("p", 6).alias("posterior"), F.round("odds", 6).alias("log_odds"), F.when(weak, "provisional").otherwise("confirmed").alias("status"))
