"""Evaluation plans: retrieval hits, overlaps, recall."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import vectors as V


QUERY_ROWS, VECTOR_ROWS = 8192, 16384  # of a block


def hits(queries: DataFrame, vocabulary: DataFrame, k: int, threshold: float, query_rows: int = QUERY_ROWS, vector_rows: int = VECTOR_ROWS) -> DataFrame:
    """queries (query_id, q), vocabulary (vec_id, embedding): query_id, vec_id, similarity, rank of what is a hit: among the
    first k, or closer than the threshold.

    Both sides are dealt into blocks of about so many rows, and each pair of blocks is one task's matrix product, which
    leaves a heap of k rows a query and what passes the threshold; heaps meet by query. Of equally near vectors the least
    vec_ids come first, so that a heap is full by itself however many are equal.
    """
    blocks = [max(1, -(-d.count() // n)) for d, n in ((queries, query_rows), (vocabulary, vector_rows))]
    ids = {c: d for c, d in (queries.dtypes + vocabulary.dtypes) if c in ("query_id", "vec_id")}
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    dealt = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    q = queries.select("query_id", V.unit(F.col("q")).alias("v"), dealt("query_id", blocks[0]).alias("a"), every(blocks[1]).alias("b"))
    v = vocabulary.select("vec_id", V.unit(F.col("embedding")).alias("v"), every(blocks[0]).alias("a"), dealt("vec_id", blocks[1]).alias("b"))

    def compare(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        names = ["query_id", "vec_id", "similarity"]
        if not len(left) or not len(right):
            return pd.DataFrame(columns=names)
        right = right.sort_values("vec_id")
        ids, vec = left["query_id"].to_numpy(), right["vec_id"].to_numpy()
        m, t, out = np.stack(left["v"].to_numpy()), np.stack(right["v"].to_numpy()).T, []
        for at in range(0, len(m), 256):
            s = np.round(m[at : at + 256] @ t, 6)
            i, j = np.nonzero(first_of(s, k) | (s > threshold))
            out.append(pd.DataFrame({"query_id": ids[at + i], "vec_id": vec[j], "similarity": s[i, j]}))
        return pd.concat(out)

    met = q.groupBy("a", "b").cogroup(v.groupBy("a", "b")).applyInPandas(compare, f"query_id {ids['query_id']}, vec_id {ids['vec_id']}, similarity double")
    w = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "vec_id")
    return met.withColumn("rank", F.row_number().over(w).cast("long")).where((F.col("rank") <= k) | (F.col("similarity") > threshold))


def first_of(s: np.ndarray, k: int) -> np.ndarray:
    """The k largest of each row; of equal ones the first."""
    if s.shape[1] <= k:
        return np.ones(s.shape, bool)
    least = np.partition(s, s.shape[1] - k, axis=1)[:, [s.shape[1] - k]]
    above, equal = s > least, s == least
    return above | (equal & (np.cumsum(equal, axis=1) <= k - above.sum(axis=1, keepdims=True)))


def overlaps(truth: DataFrame, predicted: DataFrame, on: list[str]) -> DataFrame:
    """Pairs of boxes (center and half extent) of equal ``on`` whose intersection has a volume; adds iou."""
    from ..functions import geometry as G
    from ..operators.joins import box_columns, near_boxes

    box = lambda p: [(F.col(f"c{c}") + (2 * k - 3) * F.col("half")).alias(f"{p}{c}{k}") for k in (1, 2) for c in "xyz"]
    j = near_boxes(truth.select(*on, "gt", *box("g_")), predicted.select(*on, "pr", *box("p_")), "g_", "p_", 0.0, on)
    return j.withColumn("iou", G.iou3d(box_columns("g_"), box_columns("p_"))).where("iou > 0").select(*on, "gt", "pr", "iou")


def triplets(truth: DataFrame, predicted: DataFrame, nodes: DataFrame, relations: DataFrame) -> DataFrame:
    """Edge pairs whose endpoints overlap and whose relation is a hit, with the mean overlap.

    truth (edge, child, parent, relation), predicted (edge, child, parent, relation), nodes (gt, pr, iou),
    relations (query_id, vec_id): hits of predicted relations in the vocabulary of true ones.
    """
    n = lambda a: nodes.select(F.col("gt").alias(f"{a}_gt"), F.col("pr").alias(f"{a}_pr"), F.col("iou").alias(f"{a}_iou"))
    t = truth.select(F.col("edge").alias("gt"), F.col("child").alias("c_gt"), F.col("parent").alias("p_gt"), F.col("relation").alias("vec_id"))
    p = predicted.select(F.col("edge").alias("pr"), F.col("child").alias("c_pr"), F.col("parent").alias("p_pr"), F.col("relation").alias("query_id"))
    j = t.join(n("c"), "c_gt").join(n("p"), "p_gt").join(p, ["c_pr", "p_pr"]).join(relations.select("query_id", "vec_id").distinct(), ["query_id", "vec_id"])
    return j.select("gt", "pr", ((F.col("c_iou") + F.col("p_iou")) / 2).alias("quality"))
