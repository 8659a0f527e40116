"""Benchmark decontamination by winnowing.

Words are runs of digits, letters a-z after lower-casing A-Z, and characters beyond ASCII. A window is WINDOW consecutive
words of a benchmark item; an item of fewer words, but not none, is one window of its length. Of the GRAM-word hashes in
each sliding window the least is kept as fingerprint (the last of equals), so that every shared span of WINDOW words has
a fingerprint in common at the same place: GRAM + grams per window - 1 = WINDOW. Documents' fingerprints are looked up
among the benchmark's, hits are extended to whole windows, and each window is compared byte by byte. Windows shorter
than WINDOW have a fingerprint of their own length at every place.

A benchmark whose windows take at most BLOCK_BYTES, the usual case, is broadcast, and documents stream past it without a
shuffle. A larger one stays on the executors: documents' fingerprints are joined with the benchmark's, the windows at those
that meet are joined with the benchmark's windows by their bytes, and what is found goes back to the documents by the MD5
of their texts. Both ways give the same; nothing is collected per document.

Defined results: null or empty texts have no words and no hits; items with a null id count as hits, not among the item
ids; equal rows each get their result; empty tables give empty or clean results; columns of any other name are kept
(the operator's own names begin with ``_dc_``).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sceneloom import ship

from .common import Rolling, cut, runs, sliding_least, slices, text_bytes, words

WINDOW, GRAM = 10, 5
BLOCK_BYTES = 16 << 20


def _spoken(texts: pa.Array) -> tuple:
    """Lower-cased bytes, word starts and ends, first word of each row, the row of each word, hashes over words."""
    data, offsets = text_bytes(texts)
    low, starts, ends, first = words(data, offsets)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    return low, starts, ends, first, row, Rolling(Rolling(low).spans(starts, ends))


def _prints(over: Rolling, n: int, m: int) -> np.ndarray:
    """The fingerprint of each window of m words among n."""
    if m < WINDOW:
        return over.spans(np.arange(n - m + 1), np.arange(n - m + 1) + m)
    grams = over.spans(np.arange(n - GRAM + 1), np.arange(n - GRAM + 1) + GRAM)
    return grams[sliding_least(grams, WINDOW - GRAM + 1)]


def _window(low: np.ndarray, starts: np.ndarray, ends: np.ndarray, i: int, m: int) -> bytes:
    return b" ".join(low[starts[j] : ends[j]].tobytes() for j in range(i, i + m))


def windows(benchmark: DataFrame) -> DataFrame:
    """size, window (words joined by a space), item_id as a string; distinct."""

    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            low, starts, ends, first, _, _ = _spoken(batch.column("text"))
            for row, item in enumerate(batch.column("item_id").to_pylist()):
                n = int(first[row + 1] - first[row])
                m = min(n, WINDOW)
                found = {_window(low, starts, ends, int(first[row]) + i, m) for i in range(n - m + 1)} if n else set()
                for at in range(0, len(found), 10_000):
                    part = sorted(found)[at : at + 10_000]
                    yield pa.RecordBatch.from_arrays([pa.array([m] * len(part), pa.int32()), pa.array(part, pa.binary()), pa.array([item] * len(part), pa.string())], ["size", "window", "item_id"])

    ship(benchmark.sparkSession)
    return benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text").mapInArrow(cut_up, "size int, window binary, item_id string").distinct()


class Block:
    """Windows by length, ready to be looked up: hashes in order, the windows' bytes and their items."""

    def __init__(self, rows: list[tuple[int, bytes, str | None]]):
        self.by_size: dict[int, tuple] = {}
        for m in sorted({r[0] for r in rows}):
            items: dict[bytes, list[str | None]] = {}
            for size, window, item in rows:
                if size == m:
                    items.setdefault(bytes(window), []).append(item)
            known = list(items)
            _, _, _, first, _, over = _spoken(pa.array(known, pa.binary()))
            hashes = over.spans(first[:-1], first[:-1] + m)
            order = np.argsort(hashes, kind="stable")
            prints = None
            if m == WINDOW:
                grams = over.spans(np.arange(first[-1] - GRAM + 1), np.arange(first[-1] - GRAM + 1) + GRAM)
                prints = np.unique(grams[sliding_least(grams, WINDOW - GRAM + 1)[first[:-1]]])
            self.by_size[m] = (hashes[order], [known[i] for i in order], [items[known[i]] for i in order], prints)

    def hits(self, low, starts, ends, row, over) -> Iterator[tuple[int, int, list]]:
        """(first word, number of words, items) of each occurrence of a window in a row's words."""
        n = len(starts)
        for m, (hashes, known, items, prints) in self.by_size.items():
            if n < m:
                continue
            if prints is not None:
                at = np.arange(n - GRAM + 1)
                grams = over.spans(at, at + GRAM)
                kept = sliding_least(grams, WINDOW - GRAM + 1)  # the fingerprint of each window
                places = np.unique(kept)
                hit = np.zeros(n, bool)
                hit[places[_among(grams[places], prints)]] = True
                i = np.flatnonzero(hit[kept])  # windows whose fingerprint is the benchmark's: the hits, extended
            else:
                i = np.arange(n - m + 1)
            i = i[row[i] == row[i + m - 1]]
            own = over.spans(i, i + m)
            left = np.searchsorted(hashes, own)
            found = left < len(hashes)
            found[found] = hashes[left[found]] == own[found]
            for j, k in zip(i[found].tolist(), left[found].tolist(), strict=True):
                seen, same = _window(low, starts, ends, j, m), hashes[k]
                while k < len(known) and hashes[k] == same:
                    if known[k] == seen:
                        yield j, m, items[k]
                        break
                    k += 1


def _among(values: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    at = np.searchsorted(ordered, values)
    at[at == len(ordered)] = 0
    return ordered[at] == values if len(ordered) else np.zeros(len(values), bool)


_FOUND = "_dc_n_words long, _dc_spans array<struct<first:int,until:int>>, _dc_items array<string>"
_SPAN = pa.list_(pa.struct([("first", pa.int32()), ("until", pa.int32())]))


def scanned(docs: DataFrame, benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """docs with _dc_n_words, _dc_spans (hit words, as [from, to) in words) and _dc_items (distinct item ids)."""
    known = cut(windows(benchmark))
    total = known.agg(F.sum(F.length("window") + 64)).first()[0] or 0
    if total > block_bytes:
        return joined(docs, known)
    sent = docs.sparkSession.sparkContext.broadcast(Block([tuple(r) for r in known.collect()]))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch, "text"):
                spoken = _spoken(piece.column("text"))
                low, starts, ends, first, row, over = spoken
                yield _told(piece, first, ((int(row[i]), i - first[row[i]], m, ids) for i, m, ids in sent.value.hits(low, starts, ends, row, over)))

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields) + ", " + _FOUND
    return docs.mapInArrow(scan, schema)


def _told(piece: pa.RecordBatch, first: np.ndarray, hits: Iterator[tuple]) -> pa.RecordBatch:
    """piece and what is found in it; hits: (row, first word in the row, number of words, items)."""
    change = np.zeros(int(first[-1]) + 1, np.int64)
    items: dict[int, set] = {}
    for r, i, m, ids in hits:
        change[first[r] + i] += 1
        change[first[r] + i + m] -= 1
        items.setdefault(r, set()).update(x for x in ids if x is not None)
    s, e, at = runs(np.cumsum(change[:-1]) > 0, first)
    spans = [[{"first": int(s[k] - first[r]), "until": int(e[k] - first[r])} for k in range(at[r], at[r + 1])] for r in range(piece.num_rows)]
    more = [pa.array(np.diff(first)), pa.array(spans, _SPAN), pa.array([sorted(items.get(r, ())) for r in range(piece.num_rows)], pa.list_(pa.string()))]
    return pa.RecordBatch.from_arrays([*piece.columns, *more], [*piece.schema.names, "_dc_n_words", "_dc_spans", "_dc_items"])


def joined(docs: DataFrame, known: DataFrame) -> DataFrame:
    """What ``scanned`` gives, for any number of windows. Tables that are met by a key that many rows share are checkpoints,
    so that the joins stand on plain shuffles, which Spark can split."""
    sizes = sorted(r[0] for r in known.select("size").distinct().collect())  # WINDOW of them at most
    n = len(docs.columns)
    key = F.md5(F.coalesce(F.col("text"), F.lit("")))

    def benchmark_prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, _, _, first, _, over = _spoken(batch.column("window"))
            for m in np.unique(m_all := batch.column("size").to_numpy()).tolist():
                at = first[:-1][m_all == m]
                yield pa.RecordBatch.from_arrays([pa.array([m] * len(at), pa.int32()), pa.array(_prints(over, int(first[-1]), m)[at].view(np.int64))], ["m", "print"])

    def text_prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch, "text"):
                _, starts, _, _, row, over = _spoken(piece.column("text"))
                for m in sizes:
                    if len(starts) >= m:
                        own = _prints(over, len(starts), m)
                        whole = row[: len(own)] == row[m - 1 :]
                        pairs = np.unique(np.stack([row[: len(own)][whole].astype(np.uint64), own[whole]]), axis=1)
                        yield pa.RecordBatch.from_arrays([piece.column("k").take(pa.array(pairs[0].astype(np.int64))), pa.array([m] * pairs.shape[1], pa.int32()), pa.array(pairs[1].view(np.int64))], ["k", "m", "print"])

    texts = docs.select(key.alias("k"), "text")
    prints = cut(known.mapInArrow(benchmark_prints, "m int, print long").distinct())
    met = texts.mapInArrow(text_prints, "k string, m int, print long").join(prints, ["m", "print"])
    lists = cut(met.groupBy("k").agg(F.collect_set(F.struct("m", "print")).alias("prints")).withColumnRenamed("k", "lk"))

    def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for batch in batches:
            for piece in slices(batch, "text"):
                low, starts, ends, first, row, over = _spoken(piece.column("text"))
                by_size = {m: _prints(over, len(starts), m).view(np.int64) for m in sizes if len(starts) >= m}
                for r, (k, wanted) in enumerate(zip(piece.column("k").to_pylist(), piece.column("prints").to_pylist(), strict=True)):
                    if k == last:  # equal texts stand together
                        continue
                    last, out = k, []
                    for m, own in by_size.items():
                        at = own[first[r] : max(first[r], first[r + 1] - m + 1)]
                        for i in np.flatnonzero(np.isin(at, [w["print"] for w in wanted if w["m"] == m])).tolist():
                            out.append((i, m, _window(low, starts, ends, int(first[r]) + i, m)))
                    if out:
                        yield pa.RecordBatch.from_arrays([pa.array([k] * len(out)), *(pa.array([o[j] for o in out], t) for j, t in enumerate((pa.int32(), pa.int32(), pa.binary())))], ["k", "i", "m", "w"])

    tried = texts.join(lists, F.col("k") == F.col("lk")).mapInArrow(candidates, "k string, i int, m int, w binary")
    hits = tried.join(known, (F.col("m") == F.col("size")) & (F.col("w") == F.col("window")))
    found = cut(hits.groupBy("k").agg(F.collect_set(F.struct("i", "m")).alias("_dc_hits"), F.collect_set("item_id").alias("_dc_ids")).withColumnRenamed("k", "_dc_k"))

    def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch, "text"):
                first = _spoken(piece.column("text"))[3]
                at, ids = (piece.column(c).to_pylist() for c in ("_dc_hits", "_dc_ids"))
                hit = ((r, x["i"], x["m"], ids[r]) for r, each in enumerate(at) for x in each or ())
                yield _told(piece.select(range(n)), first, hit)

    own = docs.withColumn("_dc_key", key)
    own = own.join(found, F.col("_dc_key") == F.col("_dc_k"), "left").select(*[docs[c] for c in docs.columns], "_dc_hits", "_dc_ids")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields) + ", " + _FOUND
    return own.mapInArrow(tell, schema)


def digest(docs: DataFrame, benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated; one row for each row of docs."""
    d = scanned(docs.select("doc_id", "text"), benchmark, block_bytes)
    n_hit = F.aggregate("_dc_spans", F.lit(0).cast("long"), lambda a, s: a + (s["until"] - s["first"]))
    d = d.select("doc_id", F.col("_dc_n_words").alias("n_words"), n_hit.alias("n_hit"), F.col("_dc_items").alias("items"))
    return d.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs without any hit word."""
    return scanned(docs, benchmark).filter(F.size("_dc_spans") == 0).drop("_dc_n_words", "_dc_spans", "_dc_items")
