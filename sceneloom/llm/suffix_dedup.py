"""Suffix-array dedup: every byte goes that is covered by a LENGTH-byte string which also starts anywhere else.

Texts are UTF-8 bytes; matches never cross documents; overlaps count; strings are judged on the input.

Suffix arrays decide every match, but only where one can be. Each LENGTH-byte window is assigned to the least of its
GRAM-byte hashes (its anchor; the last of equals), so that equal windows have equal anchors at equal places. Windows in a
row with one anchor form a run, whose bytes are a segment. Anchors that occur once need no more. The segments of the
others go to shards by their anchor: of equal segments, which one 64-bit hash of the bytes beside the anchor's tells, the
bytes at two of their places go there, and what is found holds at all of them. In a shard a suffix array over all
segments is sorted by Larsson-Sadakane refinement (ranks at multiplied distances, only groups that are still tied), Kasai's
pass gives the common prefixes of neighbours, and those of LENGTH bytes are repeats.

An anchor with more than SHARD_SEGMENTS different segments is spread over several shards. Each then lists its distinct
windows' hashes in order, cut into ranges of the hash whose number grows with the anchor's shards, and the lists of a range
are merged by binary search, two by two; so no window is missed and no task holds a hot anchor.

Rows move as hashes and places; texts move twice, by shuffles on their id and hash.

Defined results: null and empty texts, and texts of fewer bytes than LENGTH, keep all; a null doc_id is an id like any
other; equal rows repeat each other; an empty table gives an empty result; columns of any other name are kept by
``deduplicated`` (the operator's own names begin with ``_sa_``).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from sceneloom import ship

from .common import Rolling, cut, discard, runs, slices, sliding_least, stored, text_bytes

LENGTH = 400
GRAM = 160
SHARD_SEGMENTS = 64
SHARD_BYTES = 1 << 20
PART_SHARDS = 16  # shards whose windows fill a range of the merge, about

# ---- one shard


def pack(text: np.ndarray) -> np.ndarray:
    """Seven 9-bit letters from each place on, in one number."""
    n = len(text)
    wide = np.zeros(n + 7, np.uint64)
    wide[:n] = text
    out = np.zeros(n, np.uint64)
    for j in range(7):
        out = (out << np.uint64(9)) | wide[j : j + n]
    return out


_LETTERS = np.array([1 << (9 * j) for j in range(7)], np.uint64)  # a difference of at least the j-th lies in j + 1 letters


def suffix_array(text: np.ndarray, depth: int, packed: np.ndarray | None = None) -> np.ndarray:
    """Suffixes in the order of their first ``depth`` letters (letters below 512; 0 ends a segment)."""
    n = len(text)
    keys = pack(text) if packed is None else packed
    order = np.argsort(keys, kind="stable")
    ordered = keys[order]
    rank = np.empty(n, np.int32)

    def settle(slots: np.ndarray, new: np.ndarray) -> np.ndarray:
        """Ranks the suffixes in slots, whose groups begin where ``new``; gives the slots of groups of several."""
        begin = np.flatnonzero(new)
        size = np.diff(np.append(begin, len(slots)))
        rank[order[slots]] = np.repeat(slots[begin], size)
        return slots[np.repeat(size > 1, size)]

    new = np.empty(n, bool)
    if n:
        new[0], new[1:] = True, ordered[1:] != ordered[:-1]
    tied, h = settle(np.arange(n), new), 7
    wide = (n + 1).bit_length()
    times = min(63 // wide, 4) if n else 2  # ranks that fit into one number
    while len(tied) and h < depth:
        places = order[tied]
        if 4 * len(tied) > n:  # in text order, which reads memory in a row
            both = rank.astype(np.uint64)
            for j in range(1, times):
                both <<= np.uint64(wide)
                both[: max(0, n - j * h)] |= (rank[j * h :] + 1).astype(np.uint64)
            both = both[places]
        else:
            both = rank[places].astype(np.uint64)
            for j in range(1, times):
                ahead = places + j * h
                both = (both << np.uint64(wide)) | np.where(ahead < n, rank[np.minimum(ahead, n - 1)] + 1, 0).astype(np.uint64)
        by = np.argsort(both, kind="stable")
        order[tied] = places[by]
        both = both[by]
        tied, h = settle(tied, np.concatenate([[True], both[1:] != both[:-1]])), times * h
    return order


def common_prefixes(text: np.ndarray, order: np.ndarray, starts: np.ndarray, ends: np.ndarray, most: int, packed: np.ndarray) -> np.ndarray:
    """Kasai: the common prefix (up to ``most``) of each suffix in order with the one before it, 0 for the first and for
    suffixes of fewer than ``most`` letters.

    All segments go in step: from one place to the next a prefix loses one letter at most. That holds where what stood
    before goes on to stand before, which among suffixes tied beyond the sorted depth it may not; those start anew, or
    from the prefix found for the same two in the other order.
    """
    n = len(text)
    slot = np.empty(n, np.int64)
    slot[order] = np.arange(n)
    before = np.full(n, -1, np.int64)
    before[order[1:]] = order[:-1]
    until = np.repeat(ends, np.diff(np.append(starts, n)))  # of each place, the end of its segment
    found = np.zeros(n, np.int64)
    have, was = np.zeros(len(starts), np.int64), np.full(len(starts), -1, np.int64)
    length = np.maximum(ends - starts - most + 1, 0)
    by = np.argsort(-length, kind="stable")
    alive = len(by)
    for step in range(int(length.max()) if len(length) else 0):
        while alive and length[by[alive - 1]] <= step:
            alive -= 1
        own = by[:alive]
        i = starts[own] + step
        j = before[i]
        h = np.where(slot[np.minimum(was[own] + 1, n - 1)] < slot[i], np.maximum(have[own] - 1, 0), 0)
        if step:  # two neighbours may have changed places
            h = np.where((j > 0) & (before[j - 1] == i - 1), np.maximum(h, found[j - 1] - 1), h)
        room = np.minimum(np.minimum(until[i] - i, np.where(j >= 0, until[j] - j, 0)), most)
        h = np.minimum(h, room)
        go = np.flatnonzero(h < room)
        while len(go):
            a, b = i[go] + h[go], j[go] + h[go]
            differ = packed[a] ^ packed[b]
            # letters that agree at the front of the seven
            same = 7 - np.searchsorted(_LETTERS, differ, side="right")
            h[go] = np.minimum(h[go] + same, room[go])
            go = go[(same == 7) & (h[go] < room[go])]
        have[own], was[own] = h, j
        found[i] = h
    return found[order]


def repeats(segments: list[bytes], length: int = LENGTH) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """For each segment, which of its windows also start elsewhere in the shard; and the text with its segment starts."""
    sizes = np.array([len(s) for s in segments], np.int64)
    starts = np.concatenate([[0], np.cumsum(sizes + 1)[:-1]])
    text = np.zeros(int((sizes + 1).sum()), np.uint16)
    flat = np.frombuffer(b"".join(segments), np.uint8).astype(np.uint16) + 1
    text[np.arange(len(flat)) + np.repeat(np.arange(len(segments)), sizes)] = flat
    packed = pack(text)
    order = suffix_array(text, length, packed)
    prefix = common_prefixes(text, order, starts, starts + sizes, length, packed)
    hit = np.zeros(len(text), bool)
    long = np.flatnonzero(prefix >= length)
    hit[order[long]] = hit[order[long - 1]] = True
    return [hit[a : a + max(0, n - length + 1)] for a, n in zip(starts.tolist(), sizes.tolist(), strict=True)], text, starts


# ---- Spark


def keyed(docs: DataFrame) -> DataFrame:
    ship(docs.sparkSession)
    return docs.withColumn("_sa_t", F.xxhash64(F.coalesce(F.col("text"), F.lit(""))))


def anchored(docs: DataFrame, length: int, gram: int) -> DataFrame:
    """doc_id, t, h (anchor), s (segment), lo, hi (the run's first and last window) of each run of each text."""
    width = length - gram + 1

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch, "text"):
                data, offsets = text_bytes(piece.column("text"))
                n = len(data) - length + 1
                if n <= 0:
                    continue
                over = Rolling(data)
                at = np.arange(len(data) - gram + 1)
                grams = over.spans(at, at + gram)
                least = sliding_least(grams, width)
                row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[:n]
                whole = np.arange(n) + length <= offsets[row + 1]
                new = np.ones(n, bool)
                new[1:] = (least[1:] != least[:-1]) | (row[1:] != row[:-1]) | (whole[1:] != whole[:-1])
                lo = np.flatnonzero(new)
                hi = np.append(lo[1:], n) - 1
                full = whole[lo]
                lo, hi = lo[full], hi[full]
                r = row[lo]
                raw = memoryview(data)
                s = np.fromiter((xxh3_64_intdigest(raw[a:b]) for a, b in zip(lo.tolist(), (hi + length).tolist(), strict=True)), np.uint64, len(lo))
                take = pa.array(r)
                cols = [piece.column("doc_id").take(take), piece.column("_sa_t").take(take), pa.array(grams[least[lo]].view(np.int64)), pa.array(s.view(np.int64)), pa.array((lo - offsets[r]).astype(np.int32)), pa.array((hi - offsets[r]).astype(np.int32))]
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "t", "h", "s", "lo", "hi"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return keyed(docs.select("doc_id", "text")).mapInArrow(find, f"doc_id {kind}, t long, h long, s long, lo int, hi int")


def segments(docs: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """wanted (doc_id, t, h, s, lo, hi, first, shards): h, s, first, shards and each segment's bytes, cut from its text."""
    lists = wanted.groupBy("doc_id", "t").agg(F.collect_list(F.struct("h", "s", "lo", "hi", "first", "shards")).alias("wanted")).withColumnsRenamed({"doc_id": "d", "t": "w"})
    own = keyed(docs.select("doc_id", "text"))
    met = own.join(lists, (F.col("_sa_t") == F.col("w")) & F.col("doc_id").eqNullSafe(F.col("d"))).select("_sa_t", "doc_id", "text", "wanted")

    def cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for batch in batches:
            for piece in slices(batch, "text", 1 << 19):
                data, offsets = text_bytes(piece.column("text"))
                raw = data.tobytes()
                keys = list(zip(piece.column("_sa_t").to_pylist(), piece.column("doc_id").to_pylist(), strict=True))
                new = np.array([key != before for key, before in zip(keys, [last, *keys[:-1]], strict=True)])  # equal rows stand together
                last = keys[-1]
                wanted = piece.column("wanted")
                counts = np.diff(wanted.offsets.to_numpy())
                each = wanted.flatten().filter(pa.array(np.repeat(new, counts)))
                begin = np.repeat(offsets[:-1][new], counts[new])
                lo, hi = (each.field(c).to_numpy() for c in ("lo", "hi"))
                bytes_ = [raw[a:b] for a, b in zip((begin + lo).tolist(), (begin + hi + length).tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([each.field("h"), each.field("s"), each.field("first"), each.field("shards"), pa.array(bytes_, pa.binary())], ["h", "s", "first", "shards", "bytes"])

    return met.mapInArrow(cut_out, "h long, s long, first boolean, shards int, bytes binary")


def _groups(batches: Iterator[pa.RecordBatch], names: list[str], most: int, column: str) -> Iterator[pa.Table]:
    """Rows in groups of equal ``names``, which stand together; several groups at a time, up to ``most`` bytes."""
    held: list[pa.RecordBatch] = []
    size, last = 0, None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = list(zip(*(batch.column(c).to_pylist() for c in names), strict=True))
        lengths = pc.binary_length(batch.column(column)).to_pylist()
        at = 0
        for i, key in enumerate(keys):
            if key != last and size >= most:
                yield pa.Table.from_batches([*held, batch.slice(at, i - at)])
                held, size, at = [], 0, i
            last = key
            size += lengths[i]
        held.append(batch.slice(at))
    if held:
        yield pa.Table.from_batches(held)


_SPAN = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))
_SHARD = pa.schema([("h", pa.int64()), ("s", pa.int64()), ("spans", _SPAN), ("part", pa.int64()), ("hashes", pa.list_(pa.int64())), ("own", pa.list_(pa.int64())), ("at", pa.list_(pa.int32()))])


def sharded(rows: DataFrame, n: int, length: int) -> DataFrame:
    """rows (h, s, first, shards, bytes): h, s, spans (windows that repeat in the shard), and of anchors in several shards
    the lists of their windows by part: hashes in order, and for windows found once where they are."""
    shard = F.pmod(F.xxhash64("s"), F.col("shards")).cast("int")
    parts = max(1, n * 650 // (16 * SHARD_BYTES) + 1)
    dealt = rows.withColumn("shard", shard).repartition(parts, "h", "shard").sortWithinPartitions("h", "shard")

    def refine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(batches, ["h", "shard"], SHARD_BYTES, "bytes"):
            h, s, first, shards = (group.column(c).to_pylist() for c in ("h", "s", "first", "shards"))
            hits, text, starts = repeats(group.column("bytes").to_pylist(), length)
            out = []
            for k, hit in enumerate(hits):
                if first[k] and hit.any():
                    a, b, _ = runs(hit, np.array([0, len(hit)]))
                    out.append({"h": h[k], "s": s[k], "spans": [{"a": int(x), "b": int(y) - 1} for x, y in zip(a, b, strict=True)]})
            yield pa.RecordBatch.from_pylist(out, _SHARD)
            spread: dict[int, list[int]] = {}
            for k, m in enumerate(shards):
                if m > 1 and first[k]:
                    spread.setdefault(h[k], []).append(k)
            over = Windows(text, length) if spread else None
            for anchor, ks in spread.items():
                where = np.concatenate([np.arange(len(hits[k])) + starts[k] for k in ks])
                own = np.concatenate([np.full(len(hits[k]), s[k], np.int64) for k in ks])
                at = np.concatenate([np.where(hits[k], -1, np.arange(len(hits[k]))) for k in ks])
                window, one = np.unique(over.hashes(where), return_index=True)
                n_parts = -(-shards[ks[0]] // PART_SHARDS)
                part = ((window >> np.uint64(31)).astype(np.int64) * n_parts) >> 31
                bounds = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1], [True]])).tolist()
                lists = [(int(part[x]), one[x:y], window[x:y]) for x, y in zip(bounds, bounds[1:])]
                yield pa.RecordBatch.from_pylist([{"h": anchor, "part": p, "hashes": w.view(np.int64), "own": own[i], "at": at[i]} for p, i, w in lists], _SHARD)

    return dealt.mapInArrow(refine, "h long, s long, spans array<struct<a:int,b:int>>, part long, hashes array<long>, own array<long>, at array<int>")


class Windows:
    """Hashes of the LENGTH letters from any place on: polynomials modulo two primes, 31 bits each."""

    def __init__(self, text: np.ndarray, length: int):
        self.length, self.sums = length, []
        for prime, base in (((1 << 31) - 1, 1_220_703_125), ((1 << 31) - 19, 1_162_261_467)):
            powers, inverse = _prime_powers(len(text) + 1, base, prime), _prime_powers(len(text) + 1, pow(base, -1, prime), prime)
            sums = np.zeros(len(text) + 1, np.uint64)
            np.cumsum((text.astype(np.uint64) + np.uint64(1)) * powers[:-1] % np.uint64(prime), out=sums[1:])
            self.sums.append((np.uint64(prime), sums, inverse))

    def hashes(self, where: np.ndarray) -> np.ndarray:
        out = np.zeros(len(where), np.uint64)
        for prime, sums, inverse in self.sums:
            out = (out << np.uint64(31)) | ((sums[where + self.length] - sums[where]) % prime * inverse[where] % prime)
        return out


def _prime_powers(n: int, base: int, prime: int) -> np.ndarray:
    out = np.ones(1, np.uint64)
    while len(out) < n:
        out = np.concatenate([out, out * np.uint64(pow(base, len(out), prime)) % np.uint64(prime)])
    return out[:n]


def two_merged(a: tuple, b: tuple, found: list) -> tuple:
    """Two lists (hashes in order, own, at, twice) as one, by binary search of the shorter one's hashes in the longer. Of a
    window that both have one place stays in the list, as found twice; another place is added to found."""
    a, b = (a, b) if len(a[0]) >= len(b[0]) else (b, a)
    place = np.searchsorted(a[0], b[0])
    there = np.minimum(place, len(a[0]) - 1)
    met = a[0][there] == b[0]
    keys, own, at, twice = a[0], a[1].copy(), a[2].copy(), a[3].copy()
    twice[there[met]] = True
    for i, j in zip(np.flatnonzero(met & (b[2] >= 0)).tolist(), there[met & (b[2] >= 0)].tolist(), strict=True):
        if at[j] >= 0:
            found.append((int(b[1][i]), int(b[2][i])))
        else:
            own[j], at[j] = b[1][i], b[2][i]
    new = ~met
    return tuple(np.insert(x, place[new], y[new]) for x, y in zip((keys, own, at, twice), b, strict=True))


def merged(lists: DataFrame, parts: int) -> DataFrame:
    """Lists (h, part, hashes, own, at) of several shards: h, s, spans of windows that more than one shard has."""
    dealt = lists.select("h", "part", "hashes", "own", "at").repartition(parts, "h", "part").sortWithinPartitions("h", "part")

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []

        def flush() -> pa.RecordBatch:
            found: list[tuple[int, int]] = []
            waiting: list[tuple] = []  # of each size about one, so that no list is merged often
            for one in held:
                while waiting and len(waiting[-1][0]) <= 2 * len(one[0]):
                    one = two_merged(waiting.pop(), one, found)
                waiting.append(one)
            one = waiting.pop()
            while waiting:
                one = two_merged(waiting.pop(), one, found)
            keep = np.flatnonzero(one[3] & (one[2] >= 0))
            found += zip(one[1][keep].tolist(), one[2][keep].tolist(), strict=True)
            return pa.RecordBatch.from_pylist([{"h": now[0], "s": s, "spans": [{"a": w, "b": w}]} for s, w in found], pa.schema([_SHARD.field(i) for i in range(3)]))

        for batch in batches:
            for h, p, hashes, own, at in zip(*batch.columns, strict=True):
                key = (h.as_py(), p.as_py())
                if key != now:
                    if held:
                        yield flush()
                    now, held = key, []
                new = hashes.values.to_numpy().view(np.uint64)
                held.append((new, own.values.to_numpy(), at.values.to_numpy(), np.zeros(len(new), bool)))
        if held:
            yield flush()

    return dealt.mapInArrow(merge, "h long, s long, spans array<struct<a:int,b:int>>")


def covered(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, shard_segments: int = SHARD_SEGMENTS) -> DataFrame:
    """doc_id, t, windows: for each text with repeated windows, ranges of them as first << 32 | last."""
    found = stored(anchored(docs, length, gram), "anchors")
    # counts are cut from what follows, so that a join on a hot anchor stands on plain shuffles, which Spark can split
    again = cut(found.groupBy("h").agg(F.count("*").alias("n")).filter("n > 1").select("h"))
    places = stored(found.join(again, "h"), "places")
    discard(found)
    place = F.struct("t", "doc_id", "lo", "hi")
    kinds = cut(places.groupBy("h", "s").agg(F.count("*").alias("n"), F.min(place).alias("one"), F.max(place).alias("other")))
    hot = kinds.groupBy("h").agg(F.count("*").alias("kinds")).filter(F.col("kinds") > shard_segments)
    hot = cut(hot.select(F.col("h").alias("hot"), F.ceil(F.col("kinds") / shard_segments).cast("int").alias("shards")))
    both = F.when(F.col("n") > 1, F.array(F.struct(F.lit(True).alias("first"), F.col("one").alias("p")), F.struct(F.lit(False).alias("first"), F.col("other").alias("p")))).otherwise(F.array(F.struct(F.lit(True).alias("first"), F.col("one").alias("p"))))
    wanted = kinds.join(hot, F.col("h") == F.col("hot"), "left").select("h", "s", F.coalesce("shards", F.lit(1)).alias("shards"), F.explode(both).alias("w"))
    wanted = cut(wanted.select("h", "s", "shards", "w.first", "w.p.*"))
    results = sharded(segments(docs, wanted, length), wanted.count(), length)
    n = hot.agg(F.sum("shards")).first()[0]
    if n:
        results = stored(results, "shards")
        spans = results.filter("spans is not null").select("h", "s", "spans").unionByName(merged(results.filter("part is not null"), max(1, n // PART_SHARDS)))
    else:
        spans = results.select("h", "s", "spans")
    hits = cut(spans.groupBy("h", "s").agg(F.flatten(F.collect_list("spans")).alias("spans")).withColumnsRenamed({"h": "hh", "s": "hs"}))
    met = places.join(hits, (F.col("h") == F.col("hh")) & (F.col("s") == F.col("hs")))
    each = F.transform("spans", lambda x: F.shiftleft((F.col("lo") + x["a"]).cast("long"), 32) + F.col("lo") + x["b"])
    return met.select("doc_id", "t", F.explode(each).alias("w")).groupBy("doc_id", "t").agg(F.collect_set("w").alias("windows"))


def spanned(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, shard_segments: int = SHARD_SEGMENTS) -> DataFrame:
    """docs with _sa_windows (null where nothing repeats)."""
    c = cut(covered(docs, length, gram, shard_segments).withColumnsRenamed({"doc_id": "_sa_d", "t": "_sa_w", "windows": "_sa_windows"}))
    own = keyed(docs)
    j = own.join(c, (F.col("_sa_t") == F.col("_sa_w")) & F.col("doc_id").eqNullSafe(F.col("_sa_d")), "left")
    return j.select(*[own[x] for x in docs.columns], "_sa_windows")


def spans_of(windows: list[int] | None, n: int, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of bytes that the windows cover."""
    if not windows:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    w = np.array(windows, np.int64)
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, w >> 32, 1)
    np.add.at(change, (w & 0xFFFFFFFF) + length, -1)
    a, b, _ = runs(np.cumsum(change[:-1]) > 0, np.array([0, n]))
    return a, b


def _kept(raw: bytes, a: np.ndarray, b: np.ndarray) -> bytes:
    bounds = [0, *np.stack([a, b], 1).ravel().tolist(), len(raw)]
    return b"".join(raw[x:y] for x, y in zip(bounds[::2], bounds[1::2], strict=True))


def digest(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, shard_segments: int = SHARD_SEGMENTS) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256; one row for each row of docs."""
    s = spanned(docs.select("doc_id", "text"), length, gram, shard_segments)

    def sum_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch, "text"):
                data, offsets = text_bytes(piece.column("text"))
                raw, out = data.tobytes(), []
                for k, windows in enumerate(piece.column("_sa_windows").to_pylist()):
                    text = raw[offsets[k] : offsets[k + 1]]
                    a, b = spans_of(windows, len(text), length)
                    out.append((len(text), int((b - a).sum()), len(a), hashlib.sha256(_kept(text, a, b) if len(a) else text).hexdigest()))
                cols = [piece.column("doc_id"), *(pa.array([o[i] for o in out]) for i in range(4))]
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return s.mapInArrow(sum_up, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def deduplicated(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, shard_segments: int = SHARD_SEGMENTS) -> DataFrame:
    """docs with what is left of each text; bytes of characters that are cut in two are left out."""
    s = spanned(docs, length, gram, shard_segments)

    def strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch, "text"):
                texts = piece.column("text").to_pylist()
                for k, windows in enumerate(piece.column("_sa_windows").to_pylist()):
                    if windows:
                        raw = texts[k].encode()
                        texts[k] = _kept(raw, *spans_of(windows, len(raw), length)).decode("utf-8", "ignore")
                at = piece.schema.names.index("text")
                cols = [pa.array(texts, pa.string()) if i == at else c for i, c in enumerate(piece.columns) if piece.schema.names[i] != "_sa_windows"]
                yield pa.RecordBatch.from_arrays(cols, [x for x in piece.schema.names if x != "_sa_windows"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return s.mapInArrow(strip, fields)
