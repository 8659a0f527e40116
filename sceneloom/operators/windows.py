"""Window and ranking operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def top_with_margin(df: DataFrame, by: list[str], score: str, ties: list) -> DataFrame:
    """The best row of each group with its margin to the second (null for a single row)."""
    w = Window.partitionBy(*by).orderBy(F.desc(score), *ties)
    return df.withColumns({"_rn": F.row_number().over(w), "margin": F.col(score) - F.lead(score).over(w)}).where("_rn = 1").drop("_rn")


def softmax(score: Column, by: list[str]) -> Column:
    w = Window.partitionBy(*by)
    e = F.exp(score - F.max(score).over(w))
    return e / F.sum(e).over(w)


def islands(df: DataFrame, by: list[str], value: str, gap: float, tie: str) -> DataFrame:
    """Numbers runs of sorted values without a step over ``gap``."""
    w = Window.partitionBy(*by).orderBy(value, tie)
    new = F.when(F.col(value) - F.lag(value).over(w) > gap, 1).otherwise(0)
    return df.withColumn("_new", new).withColumn("island", F.sum("_new").over(w)).drop("_new")


def depth_modes(samples: DataFrame, by: list[str], value: str, tie: str, gap: float = 0.04, least: int = 4) -> DataFrame:
    """Modes of depth: islands of at least ``least`` samples, or else all of a group; count, median, MAD, range, index."""
    i = islands(samples, by, value, gap, tie)
    size = F.count("*").over(Window.partitionBy(*by, "island"))
    i = i.withColumn("_size", size).withColumn("_any", F.max("_size").over(Window.partitionBy(*by)))
    kept = i.where((F.col("_size") >= least) | (F.col("_any") < least)).withColumn("island", F.when(F.col("_any") < least, 0).otherwise(F.col("island")))
    m = kept.groupBy(*by, "island").agg(F.count("*").alias("n"), F.median(value).alias("median"), F.min(value).alias("low"), F.max(value).alias("high"))
    d = kept.join(m.select(*by, "island", "median"), [*by, "island"]).groupBy(*by, "island").agg(F.median(F.abs(F.col(value) - F.col("median"))).alias("mad"))
    return m.join(d, [*by, "island"]).withColumn("mode", F.row_number().over(Window.partitionBy(*by).orderBy("median", "island")) - 1)


def chosen_mode(modes: DataFrame, by: list[str], seed: str, parent: str, band: float = 0.025, seed_band: float = 0.05) -> DataFrame:
    """One mode a group: of those near the parent's depth, else near the seed's, that nearest the seed; else the most compact."""
    near_parent = F.coalesce(F.abs(F.col("median") - F.col(parent)) <= band, F.lit(False))
    seed_distance = F.abs(F.col("median") - F.col(seed))
    near_seed = F.coalesce(seed_distance <= seed_band, F.lit(False))
    tier = F.when(near_parent, 0).when(near_seed, 1).otherwise(2)
    far = F.when(tier < 2, F.coalesce(F.round(seed_distance, 9), F.lit(999.0))).otherwise(0.0)
    w = Window.partitionBy(*by).orderBy(tier, far, F.round("mad", 9), F.desc("n"), "mode")
    return modes.withColumn("tier", tier).withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def confirmed_in_window(rows: DataFrame, by: list[str], frame: str, frames: int = 30, times: int = 2) -> DataFrame:
    """Hits of the last ``frames`` frames, the current one included, and whether they confirm."""
    w = Window.partitionBy(*by).orderBy(F.col(frame)).rangeBetween(-(frames - 1), 0)
    return rows.withColumn("hits", F.count("*").over(w)).withColumn("confirmed", F.col("hits") >= times)


def evenly(df: DataFrame, by: list[str], order: list, k: int, rounded: bool = False) -> DataFrame:
    """k rows of each group at evenly spaced ranks (cut off, or rounded half to even); all of a group of k or fewer."""
    w = Window.partitionBy(*by)
    r = df.withColumns({"_i": F.row_number().over(w.orderBy(*order)) - 1, "_n": F.count("*").over(w)})
    step = (F.col("_n") - 1) / F.lit(float(max(1, k - 1)))
    place = lambda j: (F.bround(j * step) if rounded else F.floor(j * step + F.lit(1e-9))).cast("long")
    # a row is taken if some j in 0..k-1 lands on it: only those next to its own share of the way can
    guess = F.floor(F.col("_i") / F.when(step > 0, step).otherwise(1.0)).cast("long")
    lands = F.exists(F.sequence(F.greatest(F.lit(0).cast("long"), guess - 1), F.least(F.lit(k - 1).cast("long"), guess + 2)), lambda j: place(j) == F.col("_i"))
    return r.where((F.col("_n") <= k) | lands).drop("_i", "_n")


def history(df: DataFrame, by: list[str], order: str, n: int = 12) -> DataFrame:
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(order)))).where(F.col("_rn") <= n).drop("_rn")


def numbered(df: DataFrame, role: str, order: list, start: dict[str, int] | None = None) -> DataFrame:
    """Node ids by role: a letter and six digits, running on from the last of each role."""
    base = F.coalesce(F.create_map(*[x for k, v in (start or {"": 0}).items() for x in (F.lit(k), F.lit(v))])[F.col(role)], F.lit(0))
    n = F.row_number().over(Window.partitionBy(role).orderBy(*order)) + base
    return df.withColumn("node_id", F.concat(F.col(role), F.lpad(n.cast("string"), 6, "0")))
