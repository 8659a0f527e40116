"""Merkle dataset manifest: a tree of hashes for each group of rows, one over the groups' roots, and a proof for each row.

``Forest`` sorts rows by ranges of (group, order) over partitions. Rows of a group are numbered across partitions by
offsets: the driver learns each partition's first and last group and their counts, no more. A task then builds, level by
level, every aligned subtree that lies in its partition; of these only the maximal ones go on: two a level for a group that
reaches beyond the partition, and the root of a group that does not. The ragged ones meet by coordinate (group, index of
the ancestor STEP levels up), STEP levels a shuffle, until all upper levels are there. A second pass builds the same
subtrees again and walks from each leaf to its root, with siblings from the subtree or from the upper nodes.

Broadcast are the nodes that no partition holds for itself: at most 2 (log2(LEAVES) + 2) digests of 64 bytes a partition,
whatever the rows; a partition has about LEAVES rows where there are many, so that is 3 kB a million rows. Rows move once,
as digests; texts never.

Defined results: nulls are hashed as ``-``; null doc_ids come first in their group; of rows with one doc_id the smaller leaf
comes first; equal rows have equal leaves, and each gets the proof of one of their places. The groups with a null lang come
first. A null doc_id is not tampered with. An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import sha256

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sceneloom import ship

from .common import cut, stored, text_bytes

LEAVES = 1 << 20
STEP = 8
BLOCK = 4096
WIDTH = 64  # characters of a digest

_NODE = "g string, gid int, level int, idx long, total long, digest string"


def field(c: Column) -> Column:
    text = c.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(n_chars: Column | None = None) -> Column:
    n = F.col("n_chars") if n_chars is None else n_chars
    return F.sha2(F.concat(*(field(c) for c in (F.col("doc_id"), F.col("source"), F.col("lang"), n, F.col("text")))), 256)


def leaves(docs: DataFrame, modulus: int = 7) -> DataFrame:
    """doc_id, lang, leaf and ``tampered``: the leaf with one more character counted where modulus divides the id's CRC."""
    chosen = (F.crc32(F.col("doc_id").cast("string").cast("binary")) % modulus == 0) & F.col("n_chars").isNotNull()
    more = F.col("n_chars").cast("decimal(38,0)") + 1
    return docs.select("doc_id", "lang", leaf().alias("leaf"), F.when(chosen, leaf(more)).alias("tampered"))


def height(total: int) -> int:
    """Levels above the leaves."""
    return (total - 1).bit_length()


def at_level(total: int, level: int) -> int:
    """Nodes of a level."""
    return -(-total // (1 << level))


def parents(nodes: np.ndarray) -> np.ndarray:
    """Digests (n, WIDTH) two by two; a last one alone by itself."""
    data = nodes.tobytes()
    out = "".join([sha256(data[i : i + 2 * WIDTH]).hexdigest() for i in range(0, len(data), 2 * WIDTH)])
    return np.frombuffer(out.encode(), np.uint8).reshape(-1, WIDTH)


def subtrees(nodes: np.ndarray, first: int, total: int) -> list[tuple[int, np.ndarray]]:
    """Of leaves first, first + 1, ...: for each level the first index and the digests of nodes with all their leaves here."""
    out = [(first, nodes)]
    while total > 1:
        end = first + len(nodes)
        low, high = (first + 1) // 2, (end + 1) // 2 if end == total else end // 2
        if high <= low:
            break
        nodes = parents(nodes[2 * low - first : min(2 * high, end) - first])
        first, total = low, (total + 1) // 2
        out.append((first, nodes))
    return out


def maximal(levels: list[tuple[int, np.ndarray]]) -> Iterator[tuple[int, int, bytes]]:
    """(level, index, digest) of the nodes whose parent is not among them."""
    for k, (first, nodes) in enumerate(levels):
        low, n = levels[k + 1] if k + 1 < len(levels) else (0, ())
        for i in {*range(first, min(first + len(nodes), first + 2)), *range(max(first, first + len(nodes) - 2), first + len(nodes))}:
            if not low <= i >> 1 < low + len(n):
                yield k, i, nodes[i - first].tobytes()


def joined(nodes: dict[tuple[int, int], bytes], low: int, high: int, total: int) -> Iterator[tuple[int, int, bytes]]:
    """Nodes of the levels above ``low`` to ``high`` that those given make."""
    for k in range(low, min(high, height(total))):
        n = at_level(total, k)
        for p in sorted({i >> 1 for lv, i in nodes if lv == k}):
            pair = [nodes.get((k, i)) for i in (2 * p, 2 * p + 1) if i < n]
            if (k + 1, p) not in nodes and all(pair):
                nodes[k + 1, p] = sha256(b"".join(pair)).hexdigest().encode()
                yield k + 1, p, nodes[k + 1, p]


def finishing(low: int, high: int):
    """Makes, of one group of nodes below an ancestor of level ``high``, the nodes between."""

    def finish(part: pd.DataFrame) -> pd.DataFrame:
        g, gid, total = part["g"].iloc[0], part["gid"].iloc[0], int(part["total"].iloc[0])
        known = {(int(k), int(i)): d.encode() for k, i, d in zip(part["level"], part["idx"], part["digest"])}
        new = [(g, gid, k, i, total, d.decode()) for k, i, d in joined(known, low, high, total)]
        return pd.DataFrame(new, columns=["g", "gid", "level", "idx", "total", "digest"])

    return finish


@dataclass
class Places:
    """Of each partition: the number of its first group, that group's rows before it, and the number of its last group.
    Of each such group: its rows, and whether partitions share it."""

    spans: dict[int, tuple[int, int, int]]
    totals: list[int]
    shared: list[bool]

    @classmethod
    def of(cls, rows: list) -> Places:
        spans, totals, shared, names, now = {}, [], [], [], -1
        for r in rows:  # in the order of partitions
            first, last = ((r[e]["some"], r[e]["g"]) for e in ("first", "last"))
            before = 0
            if now >= 0 and names[now] == first:
                before, shared[now] = totals[now], True
                totals[now] += r["first"]["n"]
            else:
                now = len(names)
                names.append(first)
                totals.append(r["first"]["n"])
                shared.append(False)
            begun = now
            if last != first:
                now = len(names)
                names.append(last)
                totals.append(r["last"]["n"])
                shared.append(False)
            spans[r["pid"]] = (begun, before, now)
        return cls(spans, totals, shared)

    def tops(self) -> int:
        return max((height(t) for t, s in zip(self.totals, self.shared) if s), default=0)


def runs(batches: Iterator[pa.RecordBatch], places: Places) -> Iterator[tuple]:
    """Of a partition's rows, each group: (rows, number or None, offset, total)."""
    got = [b for b in batches if b.num_rows]
    if not got:
        return
    rows = pa.Table.from_batches(got)
    first_number, before, last_number = places.spans[rows.column("pid")[0].as_py()]
    g = rows.column("g").combine_chunks()
    codes = g.dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
    bounds = [0, *(np.flatnonzero(codes[1:] != codes[:-1]) + 1).tolist(), len(codes)]
    for j, (a, z) in enumerate(zip(bounds, bounds[1:])):
        number = first_number if j == 0 else last_number if z == len(codes) else None
        shared = number is not None and places.shared[number]
        yield rows.slice(a, z - a), number if shared else None, before if j == 0 else 0, places.totals[number] if shared else z - a


def digests(column: pa.ChunkedArray) -> np.ndarray:
    return text_bytes(column)[0].reshape(-1, WIDTH)


class Forest:
    """rows: any columns, among them ``leaf``; a tree for each value of ``group`` (null too), its leaves in order of ``order``."""

    def __init__(self, rows: DataFrame, group: Column, order: list[str], tasks: int):
        spark = rows.sparkSession
        ship(spark)
        self.names = rows.columns
        base = stored(rows.select(group.cast("string").alias("g"), *rows.columns, F.monotonically_increasing_id().alias("salt")), "leaves")
        parts = max(tasks, -(-base.count() // LEAVES))
        key = ["g", *order, "leaf", "salt"]
        self.rows = cut(base.repartitionByRange(parts, *key).sortWithinPartitions(*key)).withColumn("pid", F.spark_partition_id())
        each = self.rows.groupBy("pid", "g").agg(F.count("*").alias("n"))
        ends = each.groupBy("pid").agg(*(f(F.struct(F.col("g").isNotNull().alias("some"), "g", "n")).alias(n) for f, n in ((F.min, "first"), (F.max, "last"))))
        self.places = Places.of(sorted(ends.collect(), key=lambda r: r["pid"]))
        self.nodes = self._upper()

    def _upper(self) -> DataFrame:
        """The nodes that no partition holds below another of its own: shared groups' ragged and upper nodes, all roots."""
        sent = self.rows.sparkSession.sparkContext.broadcast(self.places)

        def ragged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            found = []
            for rows, number, before, total in runs(batches, sent.value):
                g = rows.column("g")[0].as_py()
                found += [(g, number, k, i, total, d.decode()) for k, i, d in maximal(subtrees(digests(rows.column("leaf")), before, total))]
            if found:
                kinds = (pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found), kinds)], ["g", "gid", "level", "idx", "total", "digest"])

        nodes = cut(self.rows.select("pid", "g", "leaf").mapInArrow(ragged, _NODE))
        for low in range(0, self.places.tops(), STEP):
            high = low + STEP
            here = nodes.filter(F.col("gid").isNotNull() & F.col("level").between(low, high - 1))
            ancestor = F.call_function("shiftright", F.col("idx"), F.lit(high) - F.col("level"))
            nodes = cut(nodes.unionByName(here.groupBy("gid", ancestor.alias("above")).applyInPandas(finishing(low, high), _NODE)))
        return nodes

    def roots(self) -> DataFrame:
        """g and ``digest``, the root of its tree."""
        up = F.call_function("shiftright", F.col("total") - 1, F.col("level"))
        return self.nodes.filter(up == 0).select("g", "digest")

    def walked(self, listed: bool = False) -> DataFrame:
        """The rows with what leads from each leaf to its root. listed: ``path``, for each level what is hashed to the left
        and to the right of the node. Else ``siblings``, their digests in one string from the leaves up, and ``folded``: the
        root computed with them from ``tampered`` or, where that is null, from ``leaf``."""
        upper: dict[int, dict[int, tuple[np.ndarray, np.ndarray]]] = {}
        found: dict[tuple[int, int], list] = {}
        for r in self.nodes.filter(F.col("gid").isNotNull()).select("gid", "level", "idx", "digest").collect():
            found.setdefault((r["gid"], r["level"]), []).append((r["idx"], r["digest"].encode()))
        for (gid, level), each in found.items():
            each.sort()
            upper.setdefault(gid, {})[level] = (np.array([i for i, _ in each], np.int64), np.frombuffer(b"".join(d for _, d in each), np.uint8).reshape(-1, WIDTH))
        sent = self.rows.sparkSession.sparkContext.broadcast((self.places, upper))
        keep = ["g", *self.names]
        types = {f.name: f.dataType.simpleString() for f in self.rows.schema.fields}
        more = "path array<struct<l:string,r:string>>" if listed else "siblings string, folded string"

        def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            places, above = sent.value
            for rows, number, before, total in runs(batches, places):
                leafs = digests(rows.column("leaf"))
                levels = subtrees(leafs, before, total)
                for at in range(0, len(leafs), BLOCK):
                    piece = rows.slice(at, BLOCK)
                    steps = list(siblings(np.arange(before + at, before + at + piece.num_rows), levels, total, above.get(number, {})))
                    new = path(steps, piece.num_rows) if listed else folds(steps, leafs[at : at + BLOCK], piece)
                    for b in pa.Table.from_arrays([*(piece.column(n) for n in keep), *new], [*keep, *(["path"] if listed else ["siblings", "folded"])]).combine_chunks().to_batches():
                        yield b

        return self.rows.select("pid", *keep).mapInArrow(walk, ", ".join(f"`{n}` {types[n]}" for n in keep) + ", " + more)


def siblings(idx: np.ndarray, levels: list[tuple[int, np.ndarray]], total: int, above: dict) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each level from the leaves up: siblings' digests (undefined where there is none), whether there is one, whether
    it stands to the left."""
    for k in range(height(total)):
        other = idx ^ 1
        there = other < at_level(total, k)
        first, nodes = levels[k] if k < len(levels) else (0, np.empty((0, WIDTH), np.uint8))
        out = np.zeros((len(idx), WIDTH), np.uint8)
        here = there & (other >= first) & (other < first + len(nodes))
        out[here] = nodes[other[here] - first]
        far = there & ~here
        if far.any():
            known, digest = above[k]
            out[far] = digest[np.searchsorted(known, other[far])]
        yield out, there, (idx & 1) == 1
        idx = idx >> 1


def path(steps: list, n: int) -> list[pa.Array]:
    rows: list[list[dict]] = [[] for _ in range(n)]
    for digest, there, left in steps:
        for r in range(n):
            d = digest[r].tobytes().decode() if there[r] else ""
            rows[r].append({"l": d, "r": ""} if left[r] else {"l": "", "r": d})
    return [pa.array(rows, pa.list_(pa.struct([("l", pa.string()), ("r", pa.string())])))]


def folds(steps: list, leafs: np.ndarray, piece: pa.Table) -> list[pa.Array]:
    changed = piece.column("tampered").to_pylist()
    own = leafs.tobytes()
    node = [c.encode() if c else own[i * WIDTH : (i + 1) * WIDTH] for i, c in enumerate(changed)]
    met: list[list[bytes]] = [[] for _ in node]
    for digest, there, left in steps:
        data = digest.tobytes()
        for r, (some, before) in enumerate(zip(there.tolist(), left.tolist())):
            if some:
                d = data[r * WIDTH : (r + 1) * WIDTH]
                met[r].append(d)
                node[r] = sha256(d + node[r] if before else node[r] + d).hexdigest().encode()
            else:
                node[r] = sha256(node[r]).hexdigest().encode()
    return [pa.array([b"".join(m).decode() for m in met], pa.string()), pa.array([x.decode() for x in node], pa.string())]


@dataclass
class Manifest:
    """root (null without rows); ``rows``: leaf, siblings and folded root of each row's tree beside its columns; ``groups``:
    each group's subroot and the path from it to the root."""

    root: str | None
    rows: DataFrame
    groups: DataFrame


def manifest(docs: DataFrame) -> Manifest:
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    trees = Forest(leaves(docs), F.col("lang"), ["doc_id"], tasks)
    over = Forest(trees.roots().select(F.col("g").alias("of"), F.col("digest").alias("leaf")), F.lit(""), ["of"], 1)
    top = over.roots().first()
    groups = stored(over.walked(listed=True).select("of", F.col("leaf").alias("subroot"), "path"), "groups")
    return Manifest(top["digest"] if top else None, trees.walked(), groups)


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified; one row for each row of docs."""
    m = manifest(docs)
    met = m.rows.join(m.groups, F.col("g").eqNullSafe(F.col("of")))
    upper = F.array_join(F.transform("path", lambda x: F.concat(x["l"], x["r"])), "")
    folded = F.aggregate("path", F.col("folded"), lambda acc, x: F.sha2(F.concat(x["l"], acc, x["r"]), 256))
    out = met.select("doc_id", "leaf", "subroot", F.lit(m.root).cast("string").alias("root"), F.sha2(F.concat("siblings", upper), 256).alias("proof_sha256"), folded.alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
