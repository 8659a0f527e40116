"""Sharding by a hierarchical weighted hash tree: region, rack, shard.

At each level a row draws -ln(u) / weight for every child, u from a hash of the row's key and the child's name, and goes
to the least. A child's weight is the sum of its leaves, so a change of weights moves rows only into or out of subtrees
whose weights change. A shard is added as a region of its own (``grow``), so that no other subtree's weight changes and
rows only move into it.

Everything here is DataFrame operations. Slots are exact ranks without a task that holds a shard or a key: rows equal in
all that the order reads are counted as one, what is left is sorted into ranges of the whole order, the ranges' counts are
summed in order, and slots are taken inside the ranges.

Defined results: a null text has size 1 and checksum 0; a null doc_id is a key of its own; rows equal in doc_id share a
shard and have slots of their own; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut

RANGE_ROWS = 500_000
RUN = 4096  # equal rows that one row stands for while they are numbered
HEX = 13


@dataclass(frozen=True)
class Node:
    name: str
    weight: float = 1.0
    children: tuple["Node", ...] = field(default=())
    shard: int | None = None

    @property
    def total(self) -> float:
        return sum(c.total for c in self.children) if self.children else self.weight


def tree(shards: int, racks: int = 2, per_rack: int = 2) -> Node:
    """``shards`` leaves of weight 1: ``per_rack`` to a rack, ``racks`` to a region."""
    leaf = lambda s: Node(f"shard{s}", shard=s)
    rack = lambda r: Node(f"rack{r}", children=tuple(leaf(s) for s in range(r * per_rack, min(shards, (r + 1) * per_rack))))
    n_racks = -(-shards // per_rack)
    region = lambda g: Node(f"region{g}", children=tuple(rack(r) for r in range(g * racks, min(n_racks, (g + 1) * racks))))
    return Node("root", children=tuple(region(g) for g in range(-(-n_racks // racks))))


def grow(root: Node, shard: int, weight: float = 1.0) -> Node:
    """The tree with one more shard, in a rack and a region of its own."""
    leaf = Node(f"shard{shard}", weight, shard=shard)
    return Node(root.name, children=(*root.children, Node(f"region+{shard}", children=(Node(f"rack+{shard}", children=(leaf,)),))))


def draw(key: Column, name: str) -> Column:
    """u in (0, 1) from 52 bits of a hash of the key and a node's name."""
    hexed = F.substring(F.md5(F.concat(F.lit(f"{name}/"), key)), 1, HEX)
    return (F.conv(hexed, 16, 10).cast("double") + 0.5) / F.lit(float(16**HEX))


def place(key: Column, node: Node) -> Column:
    """The shard that the key descends to."""
    if not node.children:
        return F.lit(node.shard)
    if len(node.children) == 1:
        return place(key, node.children[0])
    costs = [(-F.log(draw(key, c.name)) / F.lit(float(c.total))).alias(f"c{i}") for i, c in enumerate(node.children)]
    best = F.array_position(F.array(*costs), F.array_min(F.array(*costs)))
    out = F.when(best == 1, place(key, node.children[0]))
    for i, c in enumerate(node.children[1:], 2):
        out = out.when(best == i, place(key, c))
    return out


def sharded(docs: DataFrame, shards: int = 8, root: Node | None = None) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard; one row for each row of docs."""
    root = root or tree(shards)
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))
    content = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    thin = docs.select("doc_id", (F.octet_length(content).cast("long") + 1).alias("size"), F.crc32(content).alias("text_crc32"), F.md5(key.cast("binary")).alias("h"))
    placed = thin.withColumns({"shard": place(key, root).cast("int"), "grown_shard": place(key, grow(root, shards)).cast("int")})
    order = ["shard", "h", "doc_id", "size", "text_crc32"]
    each = cut(placed.groupBy(*order, "grown_shard").agg(F.count("*").alias("times")))
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), each.count() // RANGE_ROWS)
    laid = cut(each.repartitionByRange(parts, *order).withColumn("part", F.spark_partition_id()))
    counts = laid.groupBy("part", "shard").agg(F.sum("times").alias("n"))
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # at most ``parts`` rows a shard
    counts = counts.select(F.col("part").alias("p"), F.col("shard").alias("s"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    inside = Window.partitionBy("part", "shard").orderBy(*order[1:]).rowsBetween(Window.unboundedPreceding, -1)
    ranked = laid.withColumn("inside", F.coalesce(F.sum("times").over(inside), F.lit(0)))
    out = ranked.join(counts, (F.col("part") == F.col("p")) & (F.col("shard") == F.col("s")))
    first = F.explode(F.sequence(F.lit(0).cast("long"), F.col("times") - 1, F.lit(RUN).cast("long")))
    out = out.withColumn("first", first).withColumn("nth", F.explode(F.sequence(F.col("first"), F.least(F.col("times"), F.col("first") + RUN) - 1)))
    return out.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("before") + F.col("inside") + F.col("nth")).cast("long").alias("slot"), "grown_shard")
