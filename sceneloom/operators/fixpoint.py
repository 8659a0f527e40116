"""Closures: alias chains, descendants, components. Each round is a join; results so far are checkpointed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shared import scratch, shared_dir


def saved(df: DataFrame) -> DataFrame:
    """A reliable checkpoint in the folder that the session names."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame, name: str) -> DataFrame:
    """The rows as an intermediate table, for what many rounds read in part; deleted when the driver ends."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def canonical(steps: DataFrame) -> DataFrame:
    """steps (source, target): the end of each chain, by doubling; a source on a cycle gets its least member."""
    now = saved(steps.select("source", F.col("target").alias("canonical")))
    rounds, most = 0, 2 + int(max(2, now.count())).bit_length()
    while rounds < most:
        ahead = now.select(F.col("source").alias("s"), F.col("canonical").alias("further"))
        new = saved(now.join(ahead, F.col("canonical") == F.col("s"), "left").select("source", F.coalesce("further", "canonical").alias("canonical"), F.col("further").isNotNull().alias("moved")))
        done = not new.where("moved").limit(1).count()
        now, rounds = new.drop("moved"), rounds + 1
        if done:
            return now
    around = saved(now.join(steps.select(F.col("source").alias("canonical")).distinct(), "canonical", "left_semi"))
    ring = components(steps.join(around.select("source"), "source", "left_semi").select(F.col("source").alias("a"), F.col("target").alias("b")))
    return now.join(ring.withColumnRenamed("node", "source"), "source", "left").select("source", F.coalesce("label", "canonical").alias("canonical"))


def descendants(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """edges (child, parent), roots (root): all (root, node) that edges lead down to; cycles end."""
    found = saved(edges.join(roots, F.col("parent") == F.col("root")).select("root", F.col("child").alias("node")).distinct())
    front = found
    while True:
        front = saved(front.join(edges, F.col("node") == F.col("parent")).select("root", F.col("child").alias("node")).distinct().join(found, ["root", "node"], "left_anti"))
        if not front.limit(1).count():
            return found
        found = saved(found.unionByName(front))


def components(links: DataFrame) -> DataFrame:
    """links (a, b): node and the least node it is linked with, by spreading and shortening labels."""
    both = saved(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))))
    labels = saved(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("label")))
    while True:
        near = both.join(labels.withColumnsRenamed({"node": "b", "label": "l"}), "b").groupBy("a").agg(F.min("l").alias("l"))
        # a checkpoint, so that the join on a label that many nodes share stands on plain shuffles, which Spark can split
        step = saved(labels.join(near, labels["node"] == near["a"]).select("node", "label", F.least("label", "l").alias("next")))
        jump = step.select(F.col("node").alias("j"), F.col("next").alias("jump"))
        new = saved(step.join(jump, F.col("next") == F.col("j")).select("node", F.least("next", "jump").alias("new"), "label"))
        if not new.where("new <> label").limit(1).count():
            return new.select("node", F.col("new").alias("label"))
        labels = new.select("node", F.col("new").alias("label"))
