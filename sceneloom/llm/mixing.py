"""Mixing sources to target weights: capped water-filling over sources, then seeded whole and fractional repetitions.

Everything here is DataFrame operations; rows that share a source, or a draw, are never gathered in one task.

Defined results: a null text has size 0; a null source is a source of its own, last in order; a null doc_id is an id
like any other; rows equal in doc_id, text and source are mixed as separate rows, and where the mix takes only some of
them once more, these are the first ones in the order in which Spark reads them; an empty table gives an empty mix; other
columns are kept by ``mixture`` and not read, whatever their names (the operator's own names begin with ``_mix_``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut

BIN_ROWS = 4096  # rows of a source in a bin, about; only the bins' sums are put in order as a whole
RANGE_SOURCES = 50_000  # sources in a sorted range, about
BROADCAST_SOURCES = 50_000  # rows of some 100 bytes
HEX = 13  # leading hex digits of a draw that choose its bin: 52 bits, exact in a double


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def unit(draw: Column) -> Column:
    return F.conv(F.substring(draw, 1, HEX), 16, 10).cast("double") / F.lit(float(16**HEX))


def ranked_sources(sizes: DataFrame) -> DataFrame:
    """Adds ``rank`` from 1 in code point order, null last: by sorted ranges, so that no task holds all sources."""
    sizes = cut(sizes)
    parts = max(8, sizes.count() // RANGE_SOURCES)
    laid = cut(sizes.repartitionByRange(parts, F.col("source").asc_nulls_last()).withColumn("part", F.spark_partition_id()))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # at most ``parts`` rows
    offsets = laid.groupBy("part").agg(F.count("*").alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    inside = F.row_number().over(Window.partitionBy("part").orderBy(F.col("source").asc_nulls_last()))
    return laid.withColumn("inside", inside).join(F.broadcast(offsets), "part").withColumn("rank", F.col("before") + F.col("inside")).drop("part", "inside", "before")


def fill(sources: DataFrame, cap_times: float = 3.0) -> DataFrame:
    """sources: source, source_size, weight -> adds target. Sources beyond their cap are clamped to it and their excess
    is shared by weight among the others, until none is above; one aggregate over the sources each round."""
    cap = F.col("source_size") * F.lit(float(cap_times))
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    level = clamped = None
    while True:
        above = F.lit(False) if level is None else cap <= F.col("weight") * F.lit(level)
        free, held, n = sources.agg(F.sum(F.when(~above, F.col("weight"))), F.sum(F.when(above, F.col("source_size"))), F.count_if(above)).first()
        if not free or n == clamped:
            break
        level, clamped = (total - cap_times * (held or 0)) / float(free), n
    share = F.lit(0.0) if level is None else F.least(cap, F.col("weight") * F.lit(float(level)))
    return sources.withColumn("target", F.round(share.cast("double"), 6))


def mixture(docs: DataFrame, weights: Column | None = None, cap_times: int = 3, seed: str = "mix", rows: bool = False) -> DataFrame:
    """docs with doc_id, text, source -> doc_id, size, source_size, target, reps; with ``rows``, docs and _mix_reps.

    ``weights`` is an expression over ``rank``; without one the sources weigh 1, 2, 3, repeating. A source repeats all
    its rows floor(target / size) times; the rest of the target is filled by rows in the order of a seeded draw on
    doc_id and text, up to the row that passes it by less than half its own size; of equal rows as many as fit.
    """
    weight = F.lit(1.0) + (F.col("rank") - 1) % 3 if weights is None else weights
    key = F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.md5(F.coalesce(F.col("text"), F.lit("")))))
    thin = cut(docs.select("doc_id", "source", n_words(F.col("text")).alias("size"), key.alias("draw")).withColumn("u", unit(F.col("draw"))))
    sizes = thin.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("rows"))
    sources = cut(ranked_sources(sizes).withColumn("weight", weight.cast("double")))
    filled = fill(sources, cap_times).withColumn("times", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0)))
    filled = cut(filled.select("source", "source_size", "target", F.floor("times").cast("long").alias("whole"), (F.col("target") - F.floor("times") * F.col("source_size")).alias("rest"), F.greatest(F.lit(1), F.ceil(F.col("rows") / BIN_ROWS)).cast("long").alias("bins")))
    binned = lambda d: F.least(F.floor(d["u"] * F.col("bins")).cast("long"), F.col("bins") - 1)
    s = filled.select(F.col("source").alias("s_source"), "bins", "rest", "whole", "source_size", "target")
    placed = thin.join(s, thin["source"].eqNullSafe(s["s_source"])).select("s_source", "size", "draw", "doc_id", binned(thin).alias("bin"), "rest")
    sums = placed.groupBy("s_source", "bin", "rest").agg(F.sum("size").alias("bin_size"))
    upto = Window.partitionBy("s_source").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    # the bin in which the rest ends: below it all rows are taken once more, above it none
    edge = sums.withColumn("upto", F.sum("bin_size").over(upto)).filter("upto > rest").groupBy("s_source").agg(F.min(F.struct("bin", (F.col("upto") - F.col("bin_size")).alias("before"))).alias("edge"))
    edge = cut(edge.select("s_source", F.col("edge.bin").alias("edge_bin"), F.col("edge.before").alias("before")))
    e = edge.withColumnRenamed("s_source", "e_source")
    # rows of one draw are equal in all that is read: they count as one row with a number of times
    inside = placed.join(e, placed["s_source"].eqNullSafe(e["e_source"]) & (placed["bin"] == e["edge_bin"]))
    inside = inside.groupBy("s_source", "draw", "doc_id", "size", "before", "rest").agg(F.count("*").alias("times"))
    upto = Window.partitionBy("s_source").orderBy("draw").rowsBetween(Window.unboundedPreceding, 0)
    reach = F.col("before") + F.sum(F.col("size") * F.col("times")).over(upto) - F.col("size") * F.col("times")
    # the j-th of them is taken if what stands before it and half of its own size are within the rest
    fits = F.when(F.col("size") > 0, F.floor((F.col("rest") - F.col("reach")) / F.col("size") + 0.5)).otherwise(F.when(F.col("reach") <= F.col("rest"), F.col("times")).otherwise(0))
    more = inside.withColumn("reach", reach).withColumn("some", F.greatest(F.lit(0), F.least("times", fits)).cast("long")).filter("some > 0")
    last = more.groupBy("s_source").agg(F.max(F.struct("draw", "some", "times")).alias("l")).select(F.col("s_source").alias("l_source"), F.col("l.draw").alias("last_draw"), F.col("l.some").alias("some"), F.col("l.times").alias("times"))
    plan = s.join(e, s["s_source"].eqNullSafe(e["e_source"]), "left").join(last, s["s_source"].eqNullSafe(last["l_source"]), "left")
    plan = cut(plan.select(*[F.col(c).alias(f"_mix_p_{c}") for c in ("s_source", "bins", "whole", "source_size", "target", "edge_bin", "last_draw", "some", "times")]))
    n, split = plan.agg(F.count("*"), F.count_if(F.col("_mix_p_some") < F.col("_mix_p_times"))).first()
    if n <= BROADCAST_SOURCES:  # else the join shuffles, and Spark splits a hot source's rows
        plan = F.broadcast(plan)
    base = docs.withColumns({"_mix_draw": key, "_mix_u": unit(key)}) if rows else thin.withColumnsRenamed({"draw": "_mix_draw", "u": "_mix_u"})
    out = base.join(plan, base["source"].eqNullSafe(plan["_mix_p_s_source"]))
    b = F.least(F.floor(F.col("_mix_u") * F.col("_mix_p_bins")).cast("long"), F.col("_mix_p_bins") - 1)
    # a source without an edge bin has its rest beyond all rows, which only rounding can bring about: then all are taken
    once = F.col("_mix_p_edge_bin").isNull() | (b < F.col("_mix_p_edge_bin")) | ((b == F.col("_mix_p_edge_bin")) & (F.col("_mix_draw") <= F.coalesce("_mix_p_last_draw", F.lit(""))))
    own = [F.col(f"`{c}`") for c in docs.columns] if rows else [F.col("doc_id"), F.col("size"), F.col("_mix_p_source_size").alias("source_size"), F.col("_mix_p_target").alias("target")]
    reps = lambda taken: F.least(F.col("_mix_p_whole") + F.when(taken & (F.col("_mix_p_target") > 0), 1).otherwise(0), F.lit(int(cap_times))).cast("int").alias("_mix_reps" if rows else "reps")
    if not split:
        return out.select(*own, reps(once))
    part = F.coalesce((F.col("_mix_p_some") < F.col("_mix_p_times")) & (F.col("_mix_draw") == F.col("_mix_p_last_draw")), F.lit(False))
    tied = numbered(out.filter(part), "_mix_p_s_source").select(*own, reps(F.col("_mix_nth") <= F.col("_mix_p_some")))
    return out.filter(~part).select(*own, reps(once)).unionByName(tied)


def numbered(rows: DataFrame, by: str) -> DataFrame:
    """Adds ``_mix_nth`` from 1 within ``by``: ranks inside a task's rows, and the counts of the tasks before it."""
    laid = cut(rows.withColumn("_mix_row", F.monotonically_increasing_id())).withColumn("_mix_part", F.shiftright("_mix_row", 33))
    before = Window.partitionBy("_mix_c_by").orderBy("_mix_c_part").rowsBetween(Window.unboundedPreceding, -1)
    counts = laid.groupBy(F.col(by).alias("_mix_c_by"), F.col("_mix_part").alias("_mix_c_part")).agg(F.count("*").alias("_mix_c"))
    counts = counts.select("_mix_c_by", "_mix_c_part", F.coalesce(F.sum("_mix_c").over(before), F.lit(0)).alias("_mix_before"))
    inside = laid.withColumn("_mix_in", F.row_number().over(Window.partitionBy(by, "_mix_part").orderBy("_mix_row")))
    met = inside.join(counts, F.col(by).eqNullSafe(F.col("_mix_c_by")) & (F.col("_mix_part") == F.col("_mix_c_part")))
    return met.withColumn("_mix_nth", F.col("_mix_before") + F.col("_mix_in"))


def mixed_digest(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, taken."""
    return mixture(docs).withColumn("taken", F.col("size") * F.col("reps")).drop("reps")


def mixed_rows(docs: DataFrame) -> DataFrame:
    """The mix itself: each row as often as it is taken, with the columns of docs."""
    m = mixture(docs, rows=True).filter("_mix_reps > 0")
    return m.withColumn("_mix_copy", F.explode(F.array_repeat(F.lit(1), F.col("_mix_reps")))).drop("_mix_copy", "_mix_reps")
