"""Vector code compression: product quantisation whose codebooks are trained by delta-maintained Lloyd rounds.

A vector's components become integers floor(256 x) and are cut into PARTS equal parts; each part position has a codebook of
up to ENTRIES integer entries. A round stores every vector's assignments beside the ones before. Running integer sums and
counts of each (part, entry) stay with the driver: PARTS * ENTRIES * (part length + 1) numbers. After a round only parts
whose assignment changed give their plus to the new entry and their minus to the old one; a task sums them before they
shuffle, so that a shuffle has at most that many numbers a task. All arithmetic is in integers and exact.

Defined results: rows with a null vector or a null or non-finite component are dropped, and so are those whose length is not
that of the kept vector with the smallest vec_id (nulls last; its length a positive multiple of PARTS). Seeds are ordered by
vec_id (nulls last), then by the vector; rows of one vec_id each count. Components whose integer is beyond LARGEST count as
LARGEST, so that errors stay longs at 64 components. Ties of distance go to the lower entry; an entry without parts stays.
Fewer rows than ENTRIES give as many entries; an empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sceneloom import ship

from .common import discard, stored

PARTS = 16
ENTRIES = 64
ROUNDS = 2
SCALE = 256
LARGEST = 1 << 27
_EXACT = 1 << 53  # of integers in a double


@dataclass(frozen=True)
class Codebooks:
    """entries: (parts, entries, part length) integers."""

    entries: np.ndarray

    def sha256(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()

    def nearest(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each row its parts' nearest entries, and the sum of their squared distances."""
        parts, entries, length = self.entries.shape
        x = vectors.reshape(len(vectors), parts, length)
        codes, errors = np.empty((len(x), parts), np.uint8), np.zeros(len(x), np.int64)
        top = int(max(np.abs(x).max(initial=0), np.abs(self.entries).max(initial=0)))
        for p in range(parts):
            if length * (2 * top) ** 2 < _EXACT:
                own, book = x[:, p].astype(np.float64), self.entries[p].astype(np.float64)
                far = (own * own).sum(1)[:, None] - 2 * (own @ book.T) + (book * book).sum(1)
            else:
                far = np.zeros((len(x), entries), np.int64)
                for k in range(length):
                    far += (x[:, p, k].astype(np.int64)[:, None] - self.entries[p, :, k]) ** 2
            codes[:, p] = far.argmin(axis=1)
            errors += far[np.arange(len(x)), codes[:, p]].astype(np.int64)
        return codes, errors

    def decoded(self, codes: np.ndarray) -> np.ndarray:
        """The vectors that codes stand for, in the scale of the input."""
        return (self.entries[np.arange(len(self.entries)), codes].reshape(len(codes), -1) + 0.5) / SCALE


def finite(v: Column) -> Column:
    return v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))


def integers(v: Column) -> Column:
    each = lambda x: F.greatest(F.lit(-LARGEST), F.least(F.lit(LARGEST), F.floor(x.cast("double") * SCALE))).cast("int")
    return F.transform(v, each)


def kept(vectors: DataFrame, parts: int = PARTS) -> DataFrame:
    """vec_id, label and the integers ``q`` of the rows that count."""
    rows = vectors.select("vec_id", "label", "embedding").filter(finite(F.col("embedding")) & (F.size("embedding") > 0) & (F.size("embedding") % parts == 0))
    first = rows.agg(F.min(F.struct(F.col("vec_id").isNull().alias("last"), "vec_id", F.size("embedding").alias("n"))).alias("f")).first()["f"]
    return rows.filter(F.size("embedding") == F.lit(first["n"] if first else 0)).select("vec_id", "label", integers(F.col("embedding")).alias("q"))


def matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 1)


def _codes(column: pa.Array, parts: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, parts)


def assigned(rows: DataFrame, books: Codebooks, final: bool = False) -> DataFrame:
    """rows with each one's new ``code`` and the former as ``before`` (null in the first round); in the end code and error."""
    sent, parts = rows.sparkSession.sparkContext.broadcast(books), len(books.entries)
    names = ["vec_id", "label"] + ([] if final else ["q"])
    types = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    schema = ", ".join(f"{n} {types[n]}" for n in names) + (", code binary, error long" if final else ", code binary, before binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            codes, errors = sent.value.nearest(matrix(batch.column("q")))
            data = codes.tobytes()
            code = pa.array([data[i : i + parts] for i in range(0, len(data), parts)], pa.binary())
            last = pa.array(errors) if final else batch.column("code") if "code" in batch.schema.names else pa.nulls(batch.num_rows, pa.binary())
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), code, last], [*names, "code", "error" if final else "before"])

    return rows.mapInArrow(run, schema)


def changes(rows: DataFrame, shape: tuple[int, int, int]) -> DataFrame:
    """(part, entry, place, value): what the sums (places of the part) and counts (place -1) change by; moved parts only."""
    parts, entries, length = shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((parts, entries, length + 1), np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            x = matrix(batch.column("q")).reshape(-1, parts, length)
            new, before = _codes(batch.column("code"), parts), batch.column("before")
            first = before.null_count == batch.num_rows
            old = new if first else _codes(before, parts)
            for p in range(parts):
                moved = np.arange(len(x)) if first else np.flatnonzero(new[:, p] != old[:, p])
                own = np.column_stack([x[moved, p].astype(np.int64), np.ones(len(moved), np.int64)])
                np.add.at(total[p], new[moved, p], own)
                if not first:
                    np.subtract.at(total[p], old[moved, p], own)
        at = np.nonzero(total)
        place = np.where(at[2] == length, -1, at[2])
        yield pa.RecordBatch.from_arrays([pa.array(at[0].astype(np.int32)), pa.array(at[1].astype(np.int32)), pa.array(place.astype(np.int32)), pa.array(total[at])], ["part", "entry", "place", "value"])

    moved = rows.filter(F.col("before").isNull() | (F.col("code") != F.col("before"))).select("q", "code", "before")
    each = moved.mapInArrow(run, "part int, entry int, place int, value long")
    return each.groupBy("part", "entry", "place").agg(F.sum("value").alias("value"))


def trained(rows: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[Codebooks, DataFrame]:
    """The codebooks after ``rounds`` rounds, and the rows with the assignments of the last one (a stored table)."""
    ship(rows.sparkSession)
    seeds = np.array([r["q"] for r in rows.orderBy(F.col("vec_id").asc_nulls_last(), "q").limit(entries).select("q").collect()], np.int64)
    if not len(seeds):
        return Codebooks(np.empty((parts, 0, 1), np.int64)), rows
    books = np.ascontiguousarray(seeds.reshape(len(seeds), parts, -1).transpose(1, 0, 2))
    sums, state = np.zeros((*books.shape[:2], books.shape[2] + 1), np.int64), rows
    for _ in range(rounds):
        after = stored(assigned(state, Codebooks(books)), "codes")
        if state is not rows:
            discard(state)
        state = after
        for c in changes(state, books.shape).collect():  # at most PARTS * ENTRIES * (part length + 1)
            sums[c["part"], c["entry"], c["place"]] += c["value"]
        used = sums[:, :, -1] > 0
        books = books.copy()
        books[used] = sums[used][:, :-1] // sums[used][:, -1:]
    return Codebooks(books), state


def digest(vectors: DataFrame) -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256; one row for each vector that counts."""
    rows = kept(vectors)
    books, state = trained(rows)
    if not books.entries.size:
        none = rows.select("vec_id", F.lit("").alias("code"), F.lit(0).cast("long").alias("error"), F.lit(0).cast("long").alias("label_error"))
        return none.withColumn("codebooks_sha256", F.lit(books.sha256()))
    out = stored(assigned(state, books, final=True), "coded")
    discard(state)
    # labels may be many or hot: a stored table of their sums, so that Spark broadcasts it by its size or splits the join
    sums = stored(out.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "of_label"), "labels")
    met = out.join(sums, F.col("label").eqNullSafe(F.col("of_label")))
    return met.select("vec_id", F.lower(F.hex("code")).alias("code"), "error", "label_error", F.lit(books.sha256()).alias("codebooks_sha256"))
