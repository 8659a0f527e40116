"""Shared pieces of the training-data operators: tables, the shared folder, and byte-level numpy over Arrow text columns.

Text columns are handled as UTF-8 bytes in one flat array with row offsets, so that a batch costs a few numpy passes
and never one Python object a row. A null text counts as the empty text in every operator that uses these helpers.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from sceneloom import ship
from sceneloom.shared import drop_at_exit, shared_dir

U64 = np.uint64
BASE = 0x9E3779B97F4A7C15 | 1  # odd, so it has an inverse modulo 2**64
SLICE_BYTES = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut(df: DataFrame) -> DataFrame:
    """The rows as a reliable checkpoint in the shared folder: computed once, without the lineage before it."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder for a table or for archives; it is deleted when the driver ends."""
    path = f"{shared_dir(spark).rstrip('/')}/sceneloom-{name}-{uuid.uuid4().hex}"
    drop_at_exit(spark, path)
    return path


def stored(df: DataFrame, name: str) -> DataFrame:
    """Like ``cut``, as a Parquet table: several times smaller, for wide rows."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def discard(df: DataFrame) -> None:
    """Deletes what ``stored`` wrote, once nothing that is still to run reads it."""
    spark = df.sparkSession
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(df._stored_at)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def ascii_lower(c) -> F.Column:
    """Lower-cases A-Z only. Texts without other letters take Spark's fast path, which gives the same there."""
    plain = F.octet_length(c) == F.char_length(c)
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.when(plain, F.lower(c)).otherwise(F.translate(c, upper, lower))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string or binary column in one array, and the rows' offsets; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    n = len(column)
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64, count=column.offset + n + 1)[column.offset :]
    data = np.frombuffer(column.buffers()[2], dtype=np.uint8) if column.buffers()[2] is not None else np.empty(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batch: pa.RecordBatch, column: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in runs of whole rows, each of about ``most`` bytes of text; a longer row is a run of its own."""
    lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.cumsum(lengths)
    at = 0
    while at < batch.num_rows:
        before = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, before + most, side="right")))
        yield batch.slice(at, to - at)
        at = to


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values (splitmix64's finaliser)."""
    h = h.astype(U64, copy=True)
    h ^= h >> U64(30)
    h *= U64(0xBF58476D1CE4E5B9)
    h ^= h >> U64(27)
    h *= U64(0x94D049BB133111EB)
    h ^= h >> U64(31)
    return h


class Rolling:
    """Hashes of any spans of one array in constant time each: prefix sums of v[i] * BASE**i modulo 2**64."""

    def __init__(self, values: np.ndarray, base: int = BASE):
        n = len(values)
        powers = _powers(n + 1, base)
        self.inverse = _powers(n + 1, pow(base, -1, 1 << 64))
        self.sums = np.zeros(n + 1, U64)
        np.cumsum((values.astype(U64) + U64(1)) * powers[:n], out=self.sums[1:])

    def spans(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        h = (self.sums[ends] - self.sums[starts]) * self.inverse[starts]
        return mix(h + (ends - starts).astype(U64) * U64(0xD6E8FEB86659FD93))


_TABLES: dict[int, np.ndarray] = {}


def _powers(n: int, base: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, kept and grown by doubling."""
    have = _TABLES.get(base)
    if have is None:
        have = np.ones(1, U64)
    while len(have) < n:
        have = np.concatenate([have, have * U64(pow(base, len(have), 1 << 64))])
    _TABLES[base] = have
    return have[:n]


_PLACE = 24  # bits that carry the place; the others are the value, the same at every array length


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """For each full window of ``width`` values, the place of its least (by the upper 40 bits); the last of equals."""
    n, most = len(values) - width + 1, 1 << (_PLACE - 1)
    if n <= 0:
        return np.empty(0, np.int64)
    if n > most:
        return np.concatenate([at + sliding_least(values[at : at + most + width - 1], width) for at in range(0, n, most)])
    low = U64((1 << _PLACE) - 1)
    size = -(-len(values) // width) * width
    packed = np.full(size, np.iinfo(np.uint64).max, U64)
    packed[: len(values)] = (values & ~low) | (low - np.arange(len(values), dtype=U64))
    blocks = packed.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    least = np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])
    return (low - (least & low)).astype(np.int64)


_WORD = np.zeros(256, bool)  # bytes of a word in lower-cased text: digits, a-z, and every byte of a character beyond ASCII
_WORD[0x30:0x3A] = _WORD[0x61:0x7B] = _WORD[0x80:] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20
_DARK = np.ones(256, bool)  # bytes that are no white space
_DARK[[0x20, 9, 10, 11, 12, 13]] = False


def runs(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of maximal runs of true bytes that cross no row's end, and the first run of each row (one more)."""
    n = len(inside)
    if not n:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.zeros(len(offsets), np.int64)
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = inside[:-1]
    cuts = offsets[(offsets > 0) & (offsets < n)]
    first = inside & ~before
    first[cuts] = inside[cuts]
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = inside[1:]
    last = inside & ~after
    last[cuts - 1] = inside[cuts - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The lower-cased bytes, and runs of word bytes as in ``runs``."""
    low = _LOWER[data]
    return low, *runs(_WORD[low], offsets)


def token_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of what ``tokens`` finds; each different token is hashed once."""
    dark = data[_DARK[data]]
    bounds = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int64)
    found = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(bounds), pa.py_buffer(dark)]).dictionary_encode()
    each, at = text_bytes(found.dictionary)
    each, at = each.tobytes(), at.tolist()
    hashes = np.fromiter((xxh3_64_intdigest(each[a:b]) for a, b in zip(at, at[1:])), U64, len(at) - 1)
    return hashes[found.indices.to_numpy()]


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of bytes that are no white space."""
    return runs(_DARK[data], offsets)
