"""Grouped aggregates over candidates, points and nodes; all are partial-then-final where Spark's functions are."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import geometry as G
from ..functions import labels as L
from ..functions import scores as S
from .fixpoint import saved

PAIR = ["parent_node_id", "child_node_id", "edge_type"]


def unanimous_text(text: Column, *labels: Column, canon: Column | None = None) -> Column:
    """The shortest, then first, original text if all texts of a group mean the same; else empty. ``canon`` is the canonical
    text where it is a column already."""
    told = F.trim(text) != ""
    canon = F.when(told, L.canonical_text(F.trim(text), labels) if canon is None else canon)
    one = (F.min(canon) == F.max(canon)) & (F.min(canon) != "")
    return F.when(one, F.min(F.when(told, F.struct(F.length(F.trim(text)).alias("n"), F.trim(text).alias("t"))))["t"]).otherwise("")


def candidate_aggregate(candidates: DataFrame, keep: Column | None = None) -> DataFrame:
    """One row a (parent, child, type) over the candidates that ``keep`` (a predicate) lets in."""
    c = (candidates if keep is None else candidates.where(keep)).withColumn("_canon", L.canonical_text(F.trim("relation_text")))
    strong = F.col("selected") | F.col("pass_threshold")
    return c.groupBy(*PAIR).agg(
        F.count("*").alias("n"),
        F.count_if("selected").alias("n_selected"),
        F.count_if("pass_threshold").alias("n_pass"),
        F.count_if(strong).alias("n_strong"),
        F.count("s2d_score").alias("n_scored"),
        F.count_if("from_raw").alias("n_raw"),
        F.count_if("from_final").alias("n_final"),
        F.count_distinct("frame_key").alias("n_frames"),
        F.max("s2d_score").alias("s2d_max"),
        F.max("coverage").alias("coverage_max"),
        F.min("frame_idx").alias("first_frame"),
        F.max("frame_idx").alias("last_frame"),
        F.array_join(F.array_sort(F.collect_set("semantic_source")), ",").alias("sources"),
        unanimous_text(F.col("relation_text"), canon=F.col("_canon")).alias("relation_text"),
    )


def voxels(points: DataFrame, by: list[str], size: float, values: list[str]) -> DataFrame:
    """The mean of each occupied cell of a group."""
    cell = [F.floor(F.col(c) / size).cast("long").alias(f"v{c}") for c in "xyz"]
    return points.groupBy(*by, *cell).agg(F.count("*").alias("n"), *[F.avg(c).alias(c) for c in ("x", "y", "z", *values)])


BINS = 1024
SORTED = 50_000  # a narrowed interval of at most so many rows is sorted
FEW_GROUPS = 100_000
NARROWED = 8


def with_groups(rows: DataFrame, groups: DataFrame, by: list[str]) -> DataFrame:
    """Rows joined to a saved table of their groups, which is broadcast only if it has few rows; else rows and groups are sorted."""
    return rows.join(groups.hint("broadcast" if groups.count() <= FEW_GROUPS else "merge"), by)


def quantiles(rows: DataFrame, by: list[str], value: Column, shares: dict[str, float]) -> DataFrame:
    """by and a column a share: the exact percentiles that ``percentile`` gives, for groups that grow with the table, of which
    no task holds the values. Rows are read several times, so they should be stored.

    The ranks beside each share are searched in an interval of values, first the group's whole range. A pass counts an
    interval's rows in bins, and goes on in the bin that holds the rank; few rows, or what bins do not part, are counted by
    value and sorted."""
    v = rows.select(*by, value.cast("double").alias("_v")).where(F.col("_v").isNotNull())
    key = [*by, "_low", "_high"]
    whole = v.groupBy(*by).agg(F.count("*").alias("_n"), F.min("_v").alias("_low"), F.max("_v").alias("_high"))
    at = lambda q: (F.col("_n") - 1) * F.lit(float(q))
    ends = F.array(*[F.struct(F.lit(name).alias("_of"), F.lit(i).alias("_end"), f(at(q)).cast("long").alias("_rank"), (at(q) - F.floor(at(q))).alias("_share")) for name, q in shares.items() for i, f in enumerate((F.floor, F.ceil))])
    todo, done = saved(whole.withColumn("_e", F.explode(ends)).select(*key, "_n", "_e.*")), None
    for turn in range(NARROWED + 2):
        met = todo.where(F.col("_low") == F.col("_high"))
        done = met if done is None else done.unionByName(met)
        todo = todo.where(F.col("_low") != F.col("_high"))
        most = todo.agg(F.max("_n")).first()[0]
        if most is None:
            break
        last = most <= SORTED or turn >= NARROWED
        near = with_groups(v, saved(todo.select(*key).distinct()), by).where((F.col("_v") >= F.col("_low")) & (F.col("_v") <= F.col("_high")))
        if last:
            parts = near.groupBy(*key, F.col("_v").alias("_bin")).agg(F.count("*").alias("_k"), F.first("_v").alias("_l"), F.first("_v").alias("_h"))
        else:
            # halves, so that no difference overflows; bins stand in the order of values, and the least and greatest are apart
            span = F.col("_high") / 2 - F.col("_low") / 2
            finite = (span > 0) & (span < float("inf"))
            inside = F.least(F.lit(BINS - 1), F.floor((F.col("_v") / 2 - F.col("_low") / 2) / F.when(finite, span) * BINS))
            bin_ = F.when(F.isnan("_v"), BINS + 2).when(F.col("_v") == float("inf"), BINS + 1).when(F.col("_v") == float("-inf"), -1).otherwise(F.coalesce(inside, F.lit(0)))
            parts = near.groupBy(*key, bin_.alias("_bin")).agg(F.count("*").alias("_k"), F.min("_v").alias("_l"), F.max("_v").alias("_h"))
        before = F.sum("_k").over(Window.partitionBy(*key).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1))
        parts = parts.withColumn("_before", F.coalesce(before, F.lit(0)))
        own = with_groups(parts, todo, key).where((F.col("_rank") >= F.col("_before")) & (F.col("_rank") < F.col("_before") + F.col("_k")))
        todo = saved(own.select(*by, F.col("_l").alias("_low"), F.col("_h").alias("_high"), F.col("_k").alias("_n"), "_of", "_end", (F.col("_rank") - F.col("_before")).alias("_rank"), "_share"))
    pick = lambda name, i: F.max(F.when((F.col("_of") == name) & (F.col("_end") == i), F.col("_low")))
    got = done.groupBy(*by).agg(*[c.alias(f"{name}{i}") for name in shares for i, c in ((0, pick(name, 0)), (1, pick(name, 1)), (2, F.max(F.when(F.col("_of") == name, F.col("_share")))))])
    between = lambda a, b, t: F.when(F.col(a) == F.col(b), F.col(a)).otherwise((1 - F.col(t)) * F.col(a) + F.col(t) * F.col(b))
    return saved(got.select(*by, *[between(f"{n}0", f"{n}1", f"{n}2").alias(n) for n in shares]))


def robust_bounds(points: DataFrame, by: list[str], low: float = 0.02, high: float = 0.98) -> DataFrame:
    return points.groupBy(*by).agg(*[F.percentile(c, q).alias(f"{c}{n}") for c in "xyz" for n, q in ((1, low), (2, high))], *[F.median(c).alias(f"{c}m") for c in "xyz"])


def spread_stats(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """median, MAD and IQR of a group (the IQR of one value is 0); two passes, since a deviation needs the median."""
    m = df.groupBy(*by).agg(F.median(value).alias("median"), (F.percentile(value, 0.75) - F.percentile(value, 0.25)).alias("iqr"))
    d = df.join(m.select(*by, "median"), by).groupBy(*by).agg(F.median(F.abs(F.col(value) - F.col("median"))).alias("mad"))
    return m.join(d, by)


def colour_histogram(points: DataFrame, by: list[str], bins: int = 12) -> DataFrame:
    """Occupied bins of hue (0 to 180), saturation and value (0 to 256) with their L2-normalized weight."""
    b = [F.least(F.lit(bins - 1), F.floor(F.col(c) * bins / span)).cast("long").alias(f"b{c}") for c, span in (("hue", 180.0), ("sat", 256.0), ("val", 256.0))]
    n = points.groupBy(*by, *b).agg(F.count("*").alias("n"))
    total = F.sqrt(F.sum(F.col("n") * F.col("n")).over(Window.partitionBy(*by)))
    return n.withColumn("weight", F.col("n") / total)


def best_label(votes: DataFrame, by: list[str], label: str = "label", score: str = "score") -> DataFrame:
    """The label of the greatest summed score; the first of equals."""
    s = votes.groupBy(*by, label).agg(F.round(F.sum(score), 6).alias("vote"))
    return s.withColumn("rn", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("vote"), label))).where("rn = 1").drop("rn")


def log_odds(evidence: DataFrame) -> DataFrame:
    """Summed log odds and distinct support frames of each (child, parent); unscored rows count for nothing."""
    e = evidence.where(F.col("s2d_score").isNotNull() & ~F.isnan("s2d_score"))
    return e.groupBy("child_node_id", "parent_node_id").agg(F.sum(S.logit(F.col("s2d_score"))).alias("log_odds"), F.count_distinct("frame_key").alias("frames"), F.count("*").alias("n"))


def modal_text(evidence: DataFrame, by: list[str]) -> DataFrame:
    n = evidence.where("trim(relation_text) <> ''").groupBy(*by, "relation_text").agg(F.count("*").alias("n"))
    return n.withColumn("rn", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("n"), "relation_text"))).where("rn = 1").drop("rn")


def stable_parent(evidence: DataFrame, by: list[str], support: int = 2, margin: int = 1) -> DataFrame:
    """The parent seen in the most distinct frames, if in enough and by enough more than the second; ties by id, descending."""
    n = evidence.groupBy(*by, "parent_node_id").agg(F.count_distinct("frame_key").alias("frames"))
    w = Window.partitionBy(*by).orderBy(F.desc("frames"), F.desc("parent_node_id"))
    r = n.withColumns({"rn": F.row_number().over(w), "second": F.coalesce(F.lead("frames").over(w), F.lit(0))})
    return r.where((F.col("rn") == 1) & (F.col("frames") >= support) & (F.col("frames") - F.col("second") >= margin)).drop("rn")


def anchor_index(evidence: DataFrame) -> DataFrame:
    """Parents with the children whose parent was unique in some frame, and in how many frames."""
    one = evidence.groupBy("child_node_id", "frame_key").agg(F.count_distinct("parent_node_id").alias("k"), F.min("parent_node_id").alias("parent_node_id")).where("k = 1")
    per = one.groupBy("parent_node_id", "child_node_id").agg(F.count("*").alias("frames"))
    return per.groupBy("parent_node_id").agg(F.array_join(F.array_sort(F.collect_list("child_node_id")), ",").alias("children"), F.sum("frames").alias("frames"))


def derived_object(nodes: DataFrame, by: list[str]) -> DataFrame:
    """Members joined into one: boxes, centroids weighted by confidence (at least 1e-3), frames and counts."""
    w = F.greatest(F.col("confidence"), F.col("quality_ema"), F.lit(1e-3))
    box = [f(c).alias(c) for c, f in (("bx1", F.min), ("by1", F.min), ("bz1", F.min), ("bx2", F.max), ("by2", F.max), ("bz2", F.max))]
    return nodes.groupBy(*by).agg(F.count("*").alias("members"), F.sum("n_support").alias("support"), *box, *[(F.sum(F.col(c) * w) / F.sum(w)).alias(c) for c in ("cx", "cy", "cz")])


def lowest_role(labels: DataFrame) -> DataFrame:
    """A label of several roles keeps the lowest: unit, carrier, object."""
    rank = F.when(F.col("role") == "U", 0).when(F.col("role") == "C", 1).otherwise(2)
    return labels.groupBy("label").agg(F.min(F.struct(rank.alias("r"), "role"))["role"].alias("role"), F.count_distinct("role").alias("roles"))


#: Fixed value: the relation that says the least; any other takes its place.
PLAIN_RELATION = "part of"


def preferred(text: Column, *order: Column) -> Column:
    """Of a group's relation texts the one that says most: any before none, another before ``part of``, the longer, and of
    equals the first by ``order`` (numbers)."""
    t = F.trim(F.coalesce(text, F.lit("")))
    return F.max_by(t, F.struct((t != "").alias("some"), (t != PLAIN_RELATION).alias("own"), F.length(t).alias("size"), *[(-o).alias(f"o{i}") for i, o in enumerate(order)]))


def merged_priors(nested: DataFrame, order: str) -> DataFrame:
    """object, carrier, unit, oc_relation, cu_relation: nested lists of many entries as one list, each name once.

    nested: order (a number), object, carriers (carrier, oc_relation, units (unit, cu_relation)). A carrier's relation is
    chosen over all its entries, a unit's over those of the carrier; empty names are left out."""
    of = nested.select(F.col(order).alias("_order"), "object", F.posexplode("carriers").alias("_at", "_c")).select("_order", "_at", "object", F.col("_c.carrier").alias("carrier"), F.col("_c.oc_relation").alias("_oc"), F.col("_c.units").alias("_units")).where("trim(object) <> '' and trim(carrier) <> ''")
    carriers = of.groupBy("object", "carrier").agg(preferred(F.col("_oc"), F.col("_order"), F.col("_at")).alias("oc_relation"))
    units = of.select("_order", "_at", "object", "carrier", F.posexplode("_units").alias("_n", "_u")).where("trim(_u.unit) <> ''")
    units = units.groupBy("object", "carrier", F.col("_u.unit").alias("unit")).agg(preferred(F.col("_u.cu_relation"), F.col("_order"), F.col("_at"), F.col("_n")).alias("cu_relation"))
    return units.join(carriers, ["object", "carrier"]).select("object", "carrier", "unit", "oc_relation", "cu_relation")


def recall(hits: DataFrame, truth: DataFrame, by: list[str]) -> DataFrame:
    """Matched, truth and recall by group and, where ``by`` is null, over all."""
    t = truth.groupBy(*by).agg(F.count("*").alias("truth"))
    h = hits.groupBy(*by).agg(F.count("*").alias("matched"))
    j = t.join(h, by, "left").withColumn("matched", F.coalesce("matched", F.lit(0)))
    total = j.agg(*[F.lit("overall").alias(by[0])], F.sum("truth").alias("truth"), F.sum("matched").alias("matched"))
    return j.unionByName(total).withColumn("recall", F.round(F.col("matched") / F.col("truth"), 6))


def gap(a: str, b: str) -> Column:
    return G.gap3d([F.col(f"{a}{k}") for k in ("x1", "y1", "z1", "x2", "y2", "z2")], [F.col(f"{b}{k}") for k in ("x1", "y1", "z1", "x2", "y2", "z2")])
