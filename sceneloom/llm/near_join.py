"""N-gram Jaccard join with Bayesian candidate pruning.

Texts are sets of SHINGLE-word shingles (words are runs of visible characters; a text of fewer words, but not none, is
one shingle). Two texts are linked if their sets' Jaccard similarity is at least THRESHOLD. MinHash values in BANDS bands
of ROWS bring pairs together that are that similar, each with a chance of all but 3 in a million. A candidate pair's
MinHash values are compared incrementally: after each STEP of them the pair is dropped if, from a uniform prior, the
posterior probability of reaching the threshold is below TOLERANCE. The rest are verified exactly on their shingle sets.

Equal texts are one node. ``digest`` counts every link: each pair of different texts is pruned and verified once, in a tile
of the first band that both share (bands with the same members are met once); a tile returns its nodes' counts of links,
whose sum is a node's degree, and links that span what it has joined, so that pairs are not written out.

``representatives`` needs classes only: first each text is verified against one leader, the least node of the bands they
share; what is then in one class needs no further pair. Second, in each band pairs of different classes are pruned and
verified, in tiles where a band is large, until links join them. So every link between texts that share a band either is
found or joins two texts that links already connect: classes are those of the whole join.

Texts meet in tasks of one leader and at most MEMBERS members, or in tiles of two TILEs; components, pairs and sets stay
on the executors.

Defined results: null and empty texts are equal and have no shingles; a null doc_id is last in order; equal rows each get
their result, and ``representatives`` keeps one; an empty table gives an empty result; columns of any other name are kept
by ``representatives`` (the operator's own names begin with ``_nj_``). Texts are equal if their MD5s are; a node's number
is its place in the table of different texts. Shingles are compared by 64-bit hashes over those of their words.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sceneloom import ship

from .common import Rolling, cut, slices, stored, text_bytes, token_hashes, tokens

SHINGLE = 5
THRESHOLD = (4, 5)
BANDS, ROWS = 32, 5
STEP = 32
TOLERANCE = 1e-6
MEMBERS = 256
TILE = 256
TILE_SHINGLES = 1 << 20


def shingles(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all shingles, with repeats, and the first of each row."""
    data, offsets = text_bytes(texts)
    starts, ends, first = tokens(data, offsets)
    over = Rolling(token_hashes(data, starts, ends))
    n = np.diff(first)
    size = np.minimum(n, SHINGLE)
    each = np.where(n > 0, n - size + 1, 0)
    at = np.concatenate([[0], np.cumsum(each)])
    inside = np.arange(at[-1]) - np.repeat(at[:-1], each)
    begin = np.repeat(first[:-1], each) + inside
    return over.spans(begin, begin + np.repeat(size, each)), at


def _constants() -> tuple[np.ndarray, np.ndarray]:
    draw = np.random.Generator(np.random.PCG64(20240229))
    n = BANDS * ROWS
    return draw.integers(0, 1 << 32, n, dtype=np.uint32), draw.integers(0, 1 << 32, n, dtype=np.uint32) | np.uint32(1)


FLIP, TIMES = _constants()


def minhashes(hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """One row of BANDS * ROWS values for each row with shingles; others stay 0."""
    out = np.zeros((len(first) - 1, BANDS * ROWS), np.uint32)
    full = np.diff(first) > 0
    if full.any():
        h, at = (hashes >> np.uint64(32)).astype(np.uint32) ^ hashes.astype(np.uint32), first[:-1][full]
        for j in range(BANDS * ROWS):
            out[full, j] = np.minimum.reduceat((h ^ FLIP[j]) * TIMES[j], at)
    return out


def signed(docs: DataFrame) -> DataFrame:
    """doc_id, key (the text's hash), n (shingles, with repeats), sig (16 bits of each MinHash), bands (null without shingles)."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch, "text"):
                hashes, first = shingles(piece.column("text"))
                m = minhashes(hashes, first)
                n = np.diff(first)
                wide = Rolling(m.ravel())
                at = np.arange(len(m) * BANDS) * ROWS
                keys = wide.spans(at, at + ROWS).reshape(-1, BANDS) + np.arange(BANDS, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95)
                low = ((m * np.uint32(0x9E3779B1)) >> np.uint32(16)).astype(np.uint16)
                bands = pa.array([list(b) if c else None for b, c in zip(keys.view(np.int64).tolist(), n, strict=True)], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([piece.column("doc_id"), piece.column("key"), pa.array(n), pa.array([r.tobytes() for r in low], pa.binary()), bands], ["doc_id", "key", "n", "sig", "bands"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    ship(docs.sparkSession)
    rows = docs.select("doc_id", "text", text_key().alias("key"))
    return rows.mapInArrow(sign, f"doc_id {kind}, key binary, n long, sig binary, bands array<long>")


def text_key() -> Column:
    return F.unhex(F.md5(F.coalesce(F.col("text"), F.lit(""))))


def least_agreeing(tolerance: float = TOLERANCE) -> list[tuple[int, int]]:
    """(values compared, how many must agree): fewer leave P(similarity >= THRESHOLD) below the tolerance."""
    t = THRESHOLD[0] / THRESHOLD[1]
    out = []
    for n in range(STEP, BANDS * ROWS + 1, STEP):
        m = 0
        # Beta(m + 1, n - m + 1) above t, as a binomial sum
        while sum(comb(n + 1, i) * t**i * (1 - t) ** (n + 1 - i) for i in range(m + 1)) < tolerance:
            m += 1
        out.append((n, m))
    return out


CHECKS = least_agreeing()


def likely(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which pairs of signatures (rows) outlast the incremental comparison."""
    left = np.arange(len(a))
    agree = np.zeros(len(a), np.int64)
    before = 0
    for n, least in CHECKS:
        agree[left] += (a[left, before:n] == b[left, before:n]).sum(axis=1)
        left = left[agree[left] >= least]
        before = n
        if not len(left):
            break
    out = np.zeros(len(a), bool)
    out[left] = True
    return out


def _signatures(column: pa.Array) -> np.ndarray:
    data, _ = text_bytes(column)
    return data.view(np.uint16).reshape(-1, BANDS * ROWS)


def pruned(pairs: DataFrame, sigs: DataFrame) -> DataFrame:
    """pairs (a, b) that the Bayesian comparison leaves."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                keep = likely(_signatures(batch.column("sa")), _signatures(batch.column("sb")))
                yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(keep))

    a, b = sigs.select(F.col("k").alias("ka"), F.col("sig").alias("sa")), sigs.select(F.col("k").alias("kb"), F.col("sig").alias("sb"))
    j = pairs.join(a, F.col("a") == F.col("ka")).join(b, F.col("b") == F.col("kb"))
    return j.select("a", "b", "sa", "sb").mapInArrow(compare, "a long, b long")


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """pairs (a, b) whose shingle sets are similar enough: members a stream past the set of their leader b."""
    counts = cut(pairs.groupBy("b").agg(F.count("*").alias("members")))
    salt = lambda n: F.greatest(F.lit(1), F.ceil(n / MEMBERS)).cast("int")
    m = pairs.join(counts, "b").select("b", F.pmod(F.xxhash64("a"), salt(F.col("members"))).cast("int").alias("salt"), F.col("a").alias("k"), F.lit(1).alias("role"))
    leaders = counts.select("b", F.explode(F.sequence(F.lit(0), salt(F.col("members")) - 1)).alias("salt"), F.col("b").alias("k"), F.lit(0).alias("role"))
    met = m.unionByName(leaders).join(sets, "k").select("b", "salt", "role", "k", "set")
    met = met.repartition("b", "salt").sortWithinPartitions("b", "salt", "role")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, leader = None, np.empty(0, np.uint64)
        for batch in batches:
            found = []
            for b, s, role, k, own in zip(*(batch.column(c) for c in ("b", "salt", "role", "k", "set")), strict=True):
                key, own = (b.as_py(), s.as_py()), np.frombuffer(own.as_buffer(), np.uint64)
                if role.as_py() == 0:
                    group, leader = key, own.copy()
                elif group == key:
                    both = len(np.intersect1d(own, leader, assume_unique=True))
                    if both * THRESHOLD[1] >= THRESHOLD[0] * (len(own) + len(leader) - both) > 0:
                        found.append((k.as_py(), key[0]))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], pa.int64()) for i in (0, 1)], ["a", "b"])

    return met.mapInArrow(verify, "a long, b long").distinct()


def components(links: DataFrame) -> DataFrame:
    """k, comp: the least node that links lead to, by least labels of neighbours and of labels.

    Both joins of a round are on keys that many rows share, a node's neighbours and a class's least node. Each stands on
    plain shuffles of checkpoints, so that Spark splits such a key's rows over tasks; least labels meet partly reduced.
    """
    both = cut(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))))
    labels = cut(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("k"), F.least("a", "m").alias("comp")))
    while True:
        near = both.join(labels.withColumnsRenamed({"k": "b", "comp": "c"}), "b").groupBy("a").agg(F.min("c").alias("c"))
        step = cut(labels.join(near, labels["k"] == near["a"]).select("k", "comp", F.least("comp", "c").alias("next")))
        jump = step.select(F.col("k").alias("j"), F.col("next").alias("jump"))
        new = cut(step.join(jump, F.col("next") == F.col("j"), "left").select("k", F.least("next", F.coalesce("jump", "next")).alias("new"), "comp"))
        changed = new.filter("new <> comp").limit(1).count()
        labels = new.select("k", F.col("new").alias("comp"))
        if not changed:
            return labels


def shingle_sets(nodes: DataFrame, docs: DataFrame) -> DataFrame:
    """nodes (k, key, rep): k, set (its shingles' hashes in order, as bytes)."""
    need = nodes.select("k", "key", "rep")
    texts = docs.select(F.col("doc_id").alias("d"), text_key().alias("t"), "text")
    met = texts.join(need, (F.col("t") == F.col("key")) & F.col("d").eqNullSafe(F.col("rep"))).select("k", "text")

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for batch in batches:
            for piece in slices(batch, "text"):
                k = piece.column("k").to_numpy()
                new = k != np.concatenate([[-1 if last is None else last], k[:-1]])  # rows equal in text and doc_id stand together
                last = int(k[-1])
                piece = piece.filter(pa.array(new))
                hashes, first = shingles(piece.column("text"))
                sets = [np.unique(hashes[first[r] : first[r + 1]]).tobytes() for r in range(piece.num_rows)]
                yield pa.RecordBatch.from_arrays([piece.column("k"), pa.array(sets, pa.binary())], ["k", "set"])

    # equal rows that Spark has dealt to several tasks are one
    return met.mapInArrow(gather, "k long, set binary").dropDuplicates(["k"])


def tiled(rows: DataFrame, compared: Callable[[pa.RecordBatch, tuple], pa.RecordBatch], schema: str) -> DataFrame:
    """What ``compared`` gives for each tile (bh, x, y) of rows (bh, k, size, weight, sig, bands, set, ...): two blocks of a
    band, of about TILE rows and TILE_SHINGLES shingles at most."""
    blocks = F.greatest(F.lit(1), F.ceil(F.col("size") / TILE), F.ceil(F.col("weight") / TILE_SHINGLES)).cast("int")
    own = F.pmod(F.xxhash64("k"), blocks).cast("int")
    tiles = rows.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    tiles = tiles.select("bh", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), "own", *[c for c in rows.columns if c not in ("bh", "size", "weight")])
    dealt = tiles.repartition("bh", "x", "y").sortWithinPartitions("bh", "x", "y", "k")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        now = None
        for batch in batches:
            keys = list(zip(*(batch.column(c).to_pylist() for c in ("bh", "x", "y")), strict=True))
            at = 0
            for i in range(1, len(keys) + 1):
                if i == len(keys) or keys[i] != keys[at]:
                    if now is not None and keys[at] != now:
                        yield compared(pa.Table.from_batches(held).combine_chunks().to_batches()[0], now)
                        held = []
                    now = keys[at]
                    held.append(batch.slice(at, i - at))
                    at = i
        if held:
            yield compared(pa.Table.from_batches(held).combine_chunks().to_batches()[0], now)

    return dealt.mapInArrow(each, schema)


def crossing(rows: DataFrame) -> DataFrame:
    """rows (bh, k, comp, size, weight, sig, bands, set): links (a, b), b < a, that join different comps of a band.

    A pair is met in the first band that both have. What the links of a tile already join is not compared again, so a
    tile of n rows gives n - 1 links at most.
    """

    def compared(group: pa.RecordBatch, key: tuple) -> pa.RecordBatch:
        k, root, own = (group.column(c).to_numpy() for c in ("k", "comp", "own"))
        root = root.copy()
        sig, sets = _signatures(group.column("sig")), [np.frombuffer(x, np.uint64) for x in group.column("set").to_pylist()]
        bands = group.column("bands").flatten().to_numpy().reshape(-1, BANDS)
        bh, x, y = key
        found: list[tuple[int, int]] = []
        for i in np.flatnonzero(own == x):
            j = np.flatnonzero((own == y) & (root != root[i]) & ((k < k[i]) | (x != y)))
            if not len(j):
                continue
            j = j[likely(np.broadcast_to(sig[i], (len(j), sig.shape[1])), sig[j])]
            if len(j):
                same = bands[j] == bands[i]
                j = j[bands[i][same.argmax(axis=1)] == bh]
            for r in j.tolist():
                if root[r] == root[i]:
                    continue
                both = len(np.intersect1d(sets[i], sets[r], assume_unique=True))
                if both * THRESHOLD[1] >= THRESHOLD[0] * (len(sets[i]) + len(sets[r]) - both):
                    found.append((max(k[i], k[r]), min(k[i], k[r])))
                    root[root == root[r]] = root[i]
        return pa.RecordBatch.from_arrays([pa.array([f[n] for f in found], pa.int64()) for n in (0, 1)], ["a", "b"])

    return tiled(rows, compared, "a long, b long").distinct()


def counted(rows: DataFrame) -> DataFrame:
    """rows (bh, k, size, weight, sig, bands, set): (a, null, n), n links of a in a tile, and (a, b, 0), links that span the tile's.

    Every pair is met in the first band that both have, and there in one tile. A tile of n rows gives n counts and n - 1
    links at most.
    """

    def compared(group: pa.RecordBatch, key: tuple) -> pa.RecordBatch:
        k, own = (group.column(c).to_numpy() for c in ("k", "own"))
        sig, sets = _signatures(group.column("sig")), [np.frombuffer(x, np.uint64) for x in group.column("set").to_pylist()]
        bands = group.column("bands").flatten().to_numpy().reshape(-1, BANDS)
        bh, x, y = key
        left, right = np.flatnonzero(own == x), np.flatnonzero(own == y)
        fresh = np.ones((len(left), len(right)), bool)
        if x == y:
            fresh = np.triu(fresh, 1)
        for c in range(int((bands[0] == bh).argmax())):
            fresh &= bands[left, c][:, None] != bands[right, c]
        length = np.array([len(v) for v in sets])
        ids: list[np.ndarray] = []
        held = np.empty(0, np.int64)
        n, root = np.zeros(len(k), np.int64), np.arange(len(k))
        found: list[tuple[int, int]] = []
        for i, new in zip(left, fresh, strict=True):
            j = right[new]
            if len(j):
                j = j[likely(np.broadcast_to(sig[i], (len(j), sig.shape[1])), sig[j])]
            if not len(j):
                continue
            if len(k) < 16:
                both = np.array([len(np.intersect1d(sets[i], sets[r], assume_unique=True)) for r in j])
            else:
                if not ids:
                    known, flat = np.unique(np.concatenate(sets), return_inverse=True)
                    ids, held = np.split(flat, np.cumsum(length)[:-1]), np.zeros(len(known), np.int64)
                held[ids[i]] = 1
                both = np.add.reduceat(held[np.concatenate([ids[r] for r in j])], np.concatenate([[0], np.cumsum(length[j])[:-1]]))
                held[ids[i]] = 0
            j = j[both * THRESHOLD[1] >= THRESHOLD[0] * (length[i] + length[j] - both)]
            n[i] += len(j)
            n[j] += 1
            for r in j[root[j] != root[i]]:
                if root[r] != root[i]:
                    found.append((max(k[i], k[r]), min(k[i], k[r])))
                    root[root == root[r]] = root[i]
        some = np.flatnonzero(n)
        a, b = [*k[some].tolist(), *(int(f[0]) for f in found)], [None] * len(some) + [int(f[1]) for f in found]
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array([*n[some].tolist(), *[0] * len(found)], pa.int64())], ["a", "b", "n"])

    return tiled(rows, compared, "a long, b long, n long")


def prepared(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Nodes (k, key, rep, copies, n, sig, bands), their bands (k, n, q, bh), those of several nodes (bh, leader, ...), and
    their sets (k, set)."""
    found = signed(docs).groupBy("key").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"), F.first("n").alias("n"), F.first("sig").alias("sig"), F.first("bands").alias("bands"))
    full = stored(found.withColumn("k", F.monotonically_increasing_id()), "signatures")
    bands = full.filter("bands is not null").select("k", "n", F.posexplode("bands").alias("q", "bh"))
    members = [F.bit_xor(F.xxhash64("k")).alias("x1"), F.bit_xor(F.xxhash64("k", F.lit(1))).alias("x2")]
    buckets = cut(bands.groupBy("bh").agg(F.min("k").alias("leader"), F.max("k").alias("last"), F.min("q").alias("q"), F.count("*").alias("size"), F.sum("n").alias("weight"), *members).filter("leader < last"))
    met = bands.select("k", "bh").join(buckets.select("bh"), "bh")
    sets = stored(shingle_sets(cut(met.select("k").distinct().join(full.select("k", "key", "rep"), "k")), docs), "sets")
    return full, bands, buckets, sets


def joined(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes (k, key, rep) and links (a, b) that span their classes."""
    full, bands, buckets, sets = prepared(docs)
    nodes, sigs, buckets = full.select("k", "key", "rep"), full.select("k", "sig"), buckets.select("bh", "leader")
    met = bands.select("k", "bh").join(buckets, "bh")
    meets = met.filter("k <> leader").groupBy("k", "leader").agg(F.count("*").alias("shared"))
    best = meets.groupBy("k").agg(F.max(F.struct("shared", (-F.col("leader")).alias("neg"))).alias("m"))
    first = cut(pruned(best.select(F.col("k").alias("a"), (-F.col("m.neg")).alias("b")), sigs))
    links = cut(verified(first, sets))
    comps = components(links)
    c = comps.withColumnRenamed("k", "ck")
    labelled = bands.join(buckets.select("bh"), "bh").join(c, F.col("k") == F.col("ck"), "left").select("bh", "k", "n", F.coalesce("comp", "k").alias("comp"))
    mixed = labelled.groupBy("bh").agg(F.min("comp").alias("c1"), F.max("comp").alias("c2"), F.count("*").alias("size"), F.sum("n").alias("weight")).filter("c1 <> c2").select("bh", "size", "weight")
    rest = cut(labelled.drop("n").join(mixed, "bh"))
    content = sets.join(full.select("k", "sig", "bands"), "k")
    links = cut(links.unionByName(crossing(rest.join(content, "k"))))
    return nodes, links


def linked(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nodes (k, key, rep, copies), links (a, b) that span their classes, and each linked node's number of links (lk, n)."""
    full, bands, buckets, sets = prepared(docs)
    # of the bands that have the same members the first: no pair is new in the others
    once = buckets.groupBy("size", "weight", "leader", "last", "x1", "x2").agg(F.min(F.struct("q", "bh")).alias("m")).select(F.col("m.bh").alias("bh"), "size", "weight")
    rest = cut(bands.select("k", "bh").join(once, "bh"))
    content = sets.join(full.select("k", "sig", "bands"), "k")
    found = cut(counted(rest.join(content, "k")))
    degree = found.filter("b is null").groupBy(F.col("a").alias("lk")).agg(F.sum("n").alias("n"))
    return full.select("k", "key", "rep", "copies"), found.filter("b is not null").select("a", "b"), degree


def classes(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """nodes with comp, the least node of their class."""
    c = components(links).withColumnRenamed("k", "ck")
    return nodes.join(c, F.col("k") == F.col("ck"), "left").select(*nodes.columns, F.coalesce("comp", "k").alias("comp"))


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, class_id (the least doc_id of the class), text_id (that of the equal texts), copies, n_links (the different
    texts that are similar enough), class_texts; one row for each row of docs."""
    nodes, links, degree = linked(docs)
    n = classes(nodes, links).join(degree, F.col("k") == F.col("lk"), "left")
    n = cut(n.select("key", "rep", "copies", "comp", F.coalesce("n", F.lit(0)).cast("long").alias("n_links")))
    # checkpoints, so that the joins on a class and on a text stand on plain shuffles, which Spark can split
    named = cut(n.groupBy("comp").agg(F.min("rep").alias("class_id"), F.count("*").alias("class_texts")))
    n = cut(n.join(named, "comp").select(F.col("key").alias("nk"), "class_id", F.col("rep").alias("text_id"), "copies", "n_links", "class_texts"))
    rows = docs.select("doc_id", text_key().alias("key"))
    return rows.join(n, F.col("key") == F.col("nk")).select("doc_id", "class_id", "text_id", "copies", "n_links", "class_texts")


def representatives(docs: DataFrame) -> DataFrame:
    """One row of docs for each class: that of the least doc_id, and of the least text hash for equal ids."""
    n = classes(*joined(docs))
    order = F.struct(F.col("rep").isNull().alias("none"), F.col("rep").alias("id"), F.col("key").alias("key"))
    kept = cut(n.groupBy("comp").agg(F.min(order).alias("r")).select(F.col("r.id").alias("_nj_id"), F.col("r.key").alias("_nj_k")))
    keyed = docs.withColumn("_nj_key", text_key())
    out = keyed.join(kept, (F.col("_nj_key") == F.col("_nj_k")) & F.col("doc_id").eqNullSafe(F.col("_nj_id")))
    nth = F.row_number().over(Window.partitionBy("_nj_key", "doc_id").orderBy("_nj_key"))
    return out.withColumn("_nj_nth", nth).filter("_nj_nth = 1").select(*[docs[c] for c in docs.columns])
