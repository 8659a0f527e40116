"""Graph plans: remote links, immediate parents, object edges, consolidation."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import geometry as G
from ..functions import labels as L
from ..functions import scores as S

XYZ = ("cx", "cy", "cz")
BLOCK = 256  # source nodes in a list


def scene_diagonal(nodes: DataFrame, by: list[str] = ()) -> DataFrame:
    """One row, or one a scene: the length of the diagonal of the centroids' box; 1 for a single node."""
    size = G.norm(*[F.max(c) - F.min(c) for c in XYZ])
    return nodes.groupBy(*by).agg(F.when(F.count("*") > 1, size).otherwise(1.0).alias("diagonal"))


def template_nodes(nodes: DataFrame, templates: DataFrame, side: str, by: list[str]) -> DataFrame:
    """Nodes of a template's label: those with exactly it, or else all that are compatible either way. Labels are many nodes'
    each, so that theirs are compared and nodes join them."""
    t = templates.withColumn("want", L.prior_label(F.col(side)))
    n = nodes.select("label").distinct().withColumn("have", L.prior_label(F.col("label")))
    long = n.withColumn("key", F.explode(L.word_suffixes(F.col("label")))).join(t, F.col("key") == F.col("want")).drop("key")
    short = t.withColumn("key", F.explode(L.word_suffixes(F.col(side)))).join(n, F.col("key") == F.col("have")).drop("key").where("have <> want")
    fitting = long.unionByName(short).select("label", *templates.columns, (F.col("have") == F.col("want")).cast("int").alias("exact"))
    w = Window.partitionBy(*by, *templates.columns)
    return nodes.join(fitting, "label").withColumn("best", F.max("exact").over(w)).where("exact = best").drop("exact", "best")


def remote_links(nodes: DataFrame, templates: DataFrame, common: Callable[[dict, dict], Column], by: list[str]) -> DataFrame:
    """source, target, relation_text, score, margin: for each template and target node the best source node of its scene (``by``).

    nodes: node_id, label, centroid, confidence, n, observed (times that the source was observed as one).
    """
    keep = ["node_id", "confidence", "n", "observed", *XYZ]
    group = [*by, *templates.columns]
    # sources come to a target as lists, in order of their ids, each of which leaves its best two: pairs are no rows
    s = template_nodes(nodes, templates, "source_label", by)
    s = s.withColumn("block", F.floor((F.row_number().over(Window.partitionBy(*group).orderBy("node_id")) - 1) / BLOCK))
    s = s.groupBy(*group, "block").agg(F.sort_array(F.collect_list(F.struct(*keep))).alias("sources"))
    t = template_nodes(nodes, templates, "target_label", by).select(*group, *[F.col(k).alias(f"t_{k}") for k in keep])
    j = t.join(scene_diagonal(nodes, by), by).join(s.hint("merge"), group)
    target = {k: F.col(f"t_{k}") for k in keep}
    scale = F.greatest(0.35 * F.col("diagonal"), F.lit(0.25))

    def scored(x: Column, i: Column) -> Column:
        source = {k: x[k] for k in keep}
        distance = G.norm(*[source[c] - target[c] for c in XYZ])
        score = S.remote(source["observed"], distance, scale, common(source, target).cast("double"), 0.5 * (source["confidence"] + target["confidence"]))
        return F.struct(F.round(score, 6).alias("score"), (-i).alias("before"), x["node_id"].alias("source"))

    others = F.filter("sources", lambda x: x["node_id"] != target["node_id"])
    best_two = F.slice(F.sort_array(F.transform(others, scored), asc=False), 1, 2)
    j = j.select(*templates.columns, F.col("t_node_id").alias("target"), F.explode(best_two).alias("best")).select(*templates.columns, "best.source", "target", "best.score")
    w = Window.partitionBy(*templates.columns, "target").orderBy(F.desc("score"), "source")
    best = j.withColumns({"rn": F.row_number().over(w), "second": F.lead("score").over(w)}).where("rn = 1")
    once = Window.partitionBy("source", "target", L.prior_label(F.col("relation_text"))).orderBy(F.desc("score"), "source_label")
    return best.withColumn("k", F.row_number().over(once)).where("k = 1").select("source", "target", "relation_text", "score", F.round(F.col("score") - F.col("second"), 6).alias("margin"))
