"""Exact dedup in two passes over a Bloom filter: the first finds filter slots that two rows share, the second lets rows
outside a filter of these pass straight through; only the others are shuffled by their hash.

Everything here is DataFrame operations. Texts never move: a row is its doc_id and the SHA-256 of its text with A-Z
lower-cased. The first pass's filter has SLOTS_PER_ROW slots for each row, so that at any number of rows one row in 64
shares a slot by chance; slots and how often they are met are summed in each task before they shuffle, spread by slot. The
shared slots go into a second filter of BITS_PER_SLOT bits for each, PROBES of them in one 64-bit word, which lets about
one other row in a hundred through. It is broadcast in parts of at most PART_WORDS words by ranges of the word; rows probe
PARTS_AT_ONCE parts in one pass, so the number of passes grows with the number of repeated texts, and no part does.

Defined results: null and empty texts are equal; a null doc_id is smaller than any other; of rows equal in text and
doc_id one is kept; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, cut

SLOTS_PER_ROW = 64
BITS_PER_SLOT = 16
PROBES = 4
PART_WORDS = 1 << 21  # of two longs each: 32 MB
PARTS_AT_ONCE = 8


def hashed(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.sha2(ascii_lower(F.coalesce(F.col("text"), F.lit(""))), 256).alias("text_sha256"))


def slot(slots: int) -> Column:
    """A row's slot in the first filter: 60 bits of its SHA-256."""
    return (F.conv(F.substring("text_sha256", 1, 15), 16, 10).cast("long") % F.lit(slots)).cast("long")


def place(slot: Column, words: int) -> tuple[Column, Column]:
    """A slot's word in the second filter, and its bits there: PROBES times six bits of its hash choose them."""
    h = F.xxhash64(slot)
    one = lambda i: F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftright(h, 6 * i).bitwiseAND(F.lit(63)).cast("int"))
    bits = one(0)
    for i in range(1, PROBES):
        bits = bits.bitwiseOR(one(i))
    return (F.shiftrightunsigned(h, 6 * PROBES) % F.lit(words)).cast("long"), bits


def power(n: int) -> int:
    """The least power of two that is not below n."""
    return 1 << max(0, n - 1).bit_length()


def possible(rows: DataFrame) -> DataFrame:
    """rows with ``maybe``: false only where no other row has the text."""
    slots = power(SLOTS_PER_ROW * rows.count())
    shared = cut(rows.select(slot(slots).alias("slot")).groupBy("slot").count().filter("count > 1").select("slot"))
    words = power(shared.count() * BITS_PER_SLOT // 64)
    at, bits = place(F.col("slot"), words)
    bloom = cut(shared.select(at.alias("word"), bits.alias("bits")).groupBy("word").agg(F.bit_or("bits").alias("bits")))
    at, bits = place(slot(slots), words)
    out = rows.withColumns({"word": at, "own": bits, "maybe": F.lit(False)})
    for n, first in enumerate(range(0, words, PART_WORDS), 1):
        part = bloom.filter(F.col("word").between(first, first + PART_WORDS - 1)).select(F.col("word").alias("w"), "bits")
        hit = F.coalesce(F.col("bits").bitwiseAND(F.col("own")) == F.col("own"), F.lit(False))
        out = out.join(F.broadcast(part), F.col("word") == F.col("w"), "left").withColumn("maybe", F.col("maybe") | hit).drop("w", "bits")
        if n % PARTS_AT_ONCE == 0 and first + PART_WORDS < words:
            out = cut(out)
    return out.drop("word", "own")


def exact_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256; one row for each row of docs."""
    flagged = possible(cut(hashed(docs)))
    alone = flagged.filter(~F.col("maybe")).select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "text_sha256")
    maybe = flagged.filter("maybe").drop("maybe")
    # rows equal in both are counted first, so that the join on a hot text is all that its group's rows meet in
    each = maybe.groupBy("text_sha256", "doc_id").agg(F.count("*").alias("times"))
    groups = each.groupBy("text_sha256").agg(F.max("doc_id").alias("keep_id"), F.sum("times").alias("group_size")).withColumnRenamed("text_sha256", "g_sha")
    groups = cut(groups)  # so that the join stands on plain shuffles, which Spark can split
    met = each.join(groups, each["text_sha256"] == F.col("g_sha")).drop("g_sha")
    run = F.lit(4096)
    met = met.withColumn("first", F.explode(F.sequence(F.lit(0).cast("long"), F.col("times") - 1, F.lit(4096).cast("long"))))
    met = met.withColumn("nth", F.explode(F.sequence(F.col("first"), F.least(F.col("times"), F.col("first") + run) - 1)))
    met = met.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("nth") == 0))
    names = ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    return alone.select(names).unionByName(met.select(names))
