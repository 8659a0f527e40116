"""Token counts by prefix dynamic programming over a byte-level BPE vocabulary.

A text is cut into pieces as the vocabulary's pre-tokenizer does. For each prefix of a piece exactly one token can come
last in its encoding: that one which is compatible with the last token of what stands before it, two tokens being
compatible if merging their joined bytes gives them back. So one pass stores, for every prefix of every piece, its last
token and its exact token count, and whole texts add up the pieces. ``Prefixes`` keeps the ends of a text's tokens: the
count at any prefix, and the longest prefix within a budget, are then a binary search and need no encoding.

Texts are cut at ASCII white space into units (the white space and the word after it), which never share a piece. A
slice's units are told apart by their bytes (Arrow's dictionary), and a worker keeps the counts of units that it has met
by their bytes. Texts with a special token's string or with white space beyond ASCII are cut as wholes. Each text is
counted whole, in memory of a few times a slice.

Defined results: null and empty texts have 0 bytes and 0 tokens; special strings count as one token, as is the library's
default; equal rows each get their result; an empty table gives an empty result; ``token_counts`` reads no other column,
``prefix_table`` keeps all but one of the name token_ends, which its own takes the place of.
"""

from __future__ import annotations

import json
import re
import unicodedata
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sceneloom import ship

from .common import slices, text_bytes, tokens

SPACE = r"\t-\r \x85\xa0  -     　"


def pieces(letter: str, number: str, other: str) -> regex.Pattern:
    return regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?{letter}+| ?{number}+| ?{other}+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+", regex.V1)


PIECE = pieces(r"\p{L}", r"\p{N}", rf"[^{SPACE}\p{{L}}\p{{N}}]")
WIDE_SPACE = re.compile(rb"\xc2[\x85\xa0]|\xe1\x9a\x80|\xe2\x80[\x80-\x8a\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80")
KEPT_PIECES, KEPT_UNITS = 1 << 18, 1 << 20


def byte_alphabet() -> dict[str, int]:
    """The letters by which byte-level vocabularies write bytes: printable ones stand for themselves, others follow from 256."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


def unassigned(text: str) -> bool:
    """Whether a text has code points that Python's tables do not know: only there do two libraries' letters differ."""
    return not text.isascii() and any(unicodedata.category(c) == "Cn" for c in set(text))


def by_library(path: str) -> regex.Pattern:
    """The pattern of pieces with the letters and numbers of the vocabulary's library, which is asked about each code point
    that is a letter or number here and unknown to Python."""
    from tokenizers import Tokenizer

    cut = Tokenizer.from_file(path).pre_tokenizer
    known = "".join(map(chr, [*range(0x80, 0xD800), *range(0xE000, 0x110000)]))
    asked = [c for c in regex.findall(r"[\p{L}\p{N}]", known) if unicodedata.category(c) == "Cn"]
    alone = set(range(len(asked)))
    for before in "a1":  # a letter stands in one piece with a letter, a number with a number
        begins = {at for _, (at, _) in cut.pre_tokenize_str("".join(f"\n{before}{c}" for c in asked))}
        alone &= {i for i in alone if 3 * i + 2 in begins}
    if not alone:
        return PIECE
    out = "".join(f"\\U{ord(asked[i]):08x}" for i in sorted(alone))
    return pieces(rf"[\p{{L}}--[{out}]]", rf"[\p{{N}}--[{out}]]", rf"[[^{SPACE}\p{{L}}\p{{N}}]||[{out}]]")


class PrefixCounter:
    def __init__(self, path: str):
        self.path, self.exact = path, None
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = byte_alphabet()
        vocabulary = spec["model"]["vocab"]
        raw = lambda token: bytes(letters[c] for c in token)
        self.special = [t["content"] for t in spec["added_tokens"]]
        special = set(self.special)
        self.ids = {raw(t): i for t, i in vocabulary.items() if t not in special}
        self.bytes_of = {i: b for b, i in self.ids.items()}
        self.ranks: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(spec["model"]["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.ranks[vocabulary[a], vocabulary[b]] = (rank, vocabulary[a + b])
        # a trie of the tokens' bytes from the last to the first: (node, byte) -> node, node -> token
        self.before: dict[int, int] = {}
        self.token_at: list[int] = [-1]
        for token, i in self.ids.items():
            node = 0
            for byte in reversed(token):
                key = node << 8 | byte
                if (to := self.before.get(key)) is None:
                    to = self.before[key] = len(self.token_at)
                    self.token_at.append(-1)
                node = to
            self.token_at[node] = i
        self.parts_of: dict[int, tuple[int, int, int]] = {}
        for (a, b), (rank, t) in self.ranks.items():
            if t not in self.parts_of or rank < self.parts_of[t][2]:
                self.parts_of[t] = (a, b, rank)
        self.spines: tuple[dict, dict] = ({}, {})
        self.whole: dict[int, bool] = {}
        self.pairs: dict[int, bool] = {}
        self.pieces: dict[str, int] = {}
        self.cut_special = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None

    def cut(self, text: str) -> list[str]:
        """A text's pieces, as the library's pre-tokenizer gives them."""
        if not unassigned(text):
            return PIECE.findall(text)
        if self.exact is None:
            self.exact = by_library(self.path)
        return self.exact.findall(text)

    def merged(self, word: bytes) -> list[int]:
        """BPE as defined: the pair of least rank first, the leftmost of equals. For short strings."""
        ids = [self.ids[word[i : i + 1]] for i in range(len(word))]
        while len(ids) > 1:
            best = min(((self.ranks[p][0], i) for i, p in enumerate(zip(ids, ids[1:])) if p in self.ranks), default=None)
            if best is None:
                break
            i = best[1]
            ids[i : i + 2] = [self.ranks[ids[i], ids[i + 1]][1]]
        return ids

    def reachable(self, t: int) -> bool:
        if (found := self.whole.get(t)) is None:
            found = self.whole[t] = self.merged(self.bytes_of[t]) == [t]
        return found

    def spine(self, t: int, side: int) -> list[tuple[int, float]]:
        """What stands at the left (0) or right (1) edge of a token while it is merged, from its byte up to itself, each
        with the rank of the merge that ends it."""
        if (found := self.spines[side].get(t)) is None:
            found, ended, x = [], float("inf"), t
            while True:
                found.append((x, ended))
                if x not in self.parts_of:
                    break
                ended = self.parts_of[x][2]
                x = self.parts_of[x][side]
            found.reverse()
            self.spines[side][t] = found
        return found

    def compatible(self, a: int, b: int) -> bool:
        """Whether BPE over the joined bytes of two tokens gives them back: no two edges that meet merge before they end."""
        key = a << 32 | b
        if (found := self.pairs.get(key)) is None:
            left, right, i, j, found = self.spine(a, 1), self.spine(b, 0), 0, 0, True
            while True:
                (x, x_ends), (y, y_ends) = left[i], right[j]
                across = self.ranks.get((x, y))
                if across is not None and across[0] < x_ends and across[0] <= y_ends:
                    found = False
                    break
                if x_ends <= y_ends and i + 1 < len(left):
                    i += 1
                elif j + 1 < len(right):
                    j += 1
                else:
                    break
            self.pairs[key] = found
        return found

    def table(self, piece: bytes) -> tuple[list[int], list[int]]:
        """For every prefix of a piece: its last token, and its exact token count."""
        n, known, whole, before, token_at = len(piece), self.pairs, self.whole, self.before, self.token_at
        last, count = [-1] * (n + 1), [0] * (n + 1)
        for i in range(1, n + 1):
            node, j, ending = 0, i, []
            while j:
                node = before.get(node << 8 | piece[j - 1])
                if node is None:
                    break
                j -= 1
                if token_at[node] >= 0:
                    ending.append((j, token_at[node]))
            while ending:  # only one fits; the longest is tried first
                j, t = ending.pop()
                fits = whole.get(t)
                if fits is None:
                    fits = self.reachable(t)
                if fits and j:
                    fits = known.get(last[j] << 32 | t)
                    if fits is None:
                        fits = self.compatible(last[j], t)
                if fits:
                    last[i], count[i] = t, count[j] + 1
                    break
        return last, count

    def ends(self, piece: bytes) -> list[int]:
        """Where the tokens of a piece end."""
        last, _ = self.table(piece)
        out, i = [], len(piece)
        while i:
            out.append(i)
            i -= len(self.bytes_of[last[i]])
        return out[::-1]

    def count(self, text: str) -> int:
        total, pieces = 0, self.pieces
        for part in self.parts(text):
            if part in self.special:
                total += 1
                continue
            for piece in self.cut(part):
                n = pieces.get(piece)
                if n is None:
                    if len(pieces) >= KEPT_PIECES:
                        pieces.clear()
                    n = self.table(piece.encode())[1][-1]
                    pieces[piece] = n
                total += n
        return total

    def parts(self, text: str) -> list[str]:
        return [p for p in self.cut_special.split(text) if p] if self.cut_special else [text]


class Prefixes:
    """A text's token ends in bytes: exact counts at every token boundary, without encoding again."""

    def __init__(self, counter: PrefixCounter, text: str):
        self.ends: list[int] = []
        at = 0
        for part in counter.parts(text):
            if part in counter.special:
                at += len(part.encode())
                self.ends.append(at)
                continue
            for piece in counter.cut(part):
                raw = piece.encode()
                self.ends += [at + e for e in counter.ends(raw)]
                at += len(raw)

    def complete(self, n_bytes: int) -> int:
        """Tokens of the whole text that end within its first n_bytes."""
        return bisect_right(self.ends, n_bytes)

    def within(self, budget: int) -> int:
        """Bytes of the longest run of leading tokens that keeps the budget."""
        return self.ends[min(budget, len(self.ends)) - 1] if budget > 0 and self.ends else 0


_COUNTERS: dict[str, PrefixCounter] = {}
_UNITS: dict[str, dict[bytes, int]] = {}


def counter(path: str) -> PrefixCounter:
    """A worker's own counter for a vocabulary file, read once."""
    if path not in _COUNTERS:
        _COUNTERS[path] = PrefixCounter(path)
        _UNITS[path] = {}
    return _COUNTERS[path]


def counts(texts: pa.Array, path: str) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and tokens of each text."""
    own = counter(path)
    data, offsets = text_bytes(texts)
    n_bytes = np.diff(offsets)
    if not len(data):
        return n_bytes, np.zeros(len(n_bytes), np.int64)
    raw = data.tobytes()
    odd = {int(np.searchsorted(offsets, m.start(), side="right")) - 1 for m in WIDE_SPACE.finditer(raw)}
    for s in own.special:
        odd |= {int(np.searchsorted(offsets, m.start(), side="right")) - 1 for m in re.finditer(re.escape(s.encode()), raw)}
    _, word_ends, _ = tokens(data, offsets)
    stop = np.zeros(len(data) + 1, bool)
    stop[word_ends] = stop[offsets] = True
    bounds = np.flatnonzero(stop)
    first = np.searchsorted(bounds[:-1], offsets)
    units = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(bounds) - 1, [None, pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(raw)]).dictionary_encode()
    known = _UNITS[path]
    if len(known) >= KEPT_UNITS:
        known.clear()
    fresh, ends = text_bytes(units.dictionary)
    fresh, ends = fresh.tobytes(), ends.tolist()
    each = [known.get(unit := fresh[a:b]) or known.setdefault(unit, own.count(unit.decode("utf-8", "replace"))) for a, b in zip(ends, ends[1:])]
    sums = np.concatenate([[0], np.cumsum(np.array(each, np.int64)[units.indices.to_numpy()])])
    total = sums[first[1:]] - sums[first[:-1]]
    for r in odd:
        total[r] = own.count(raw[offsets[r] : offsets[r + 1]].decode("utf-8", "replace"))
    return n_bytes, total


def token_counts(docs: DataFrame, path: str, limit: int = 1024) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit; one row for each row of docs."""
    ship(docs.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch, "text"):
                n_bytes, n_tokens = counts(piece.column("text"), path)
                yield pa.RecordBatch.from_arrays([piece.column("doc_id"), pa.array(n_bytes), pa.array(n_tokens)], ["doc_id", "n_bytes", "n_tokens"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    out = docs.select("doc_id", "text").mapInArrow(count, f"doc_id {kind}, n_bytes long, n_tokens long")
    return out.withColumn("over_limit", F.col("n_tokens") > limit)


def prefix_table(docs: DataFrame, path: str) -> DataFrame:
    """docs with ``token_ends``: for each text the ends in bytes of its tokens, from which every prefix's count follows."""
    ship(docs.sparkSession)
    docs = docs.drop("token_ends")

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = counter(path)
        for batch in batches:
            for piece in slices(batch, "text"):
                found = [Prefixes(own, t or "").ends for t in piece.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([*piece.columns, pa.array(found, pa.list_(pa.int64()))], [*piece.schema.names, "token_ends"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInArrow(ends, f"{schema}, token_ends array<long>")


def tokens_in(n_bytes: F.Column) -> F.Column:
    """Tokens that end within the first n_bytes of a text, from token_ends."""
    return F.size(F.filter("token_ends", lambda e: e <= n_bytes))


def truncated(budget: int) -> F.Column:
    """Bytes of the longest run of leading tokens within a budget, from token_ends."""
    size = F.size("token_ends")
    return F.when((size == 0) | F.lit(budget <= 0), F.lit(0).cast("long")).otherwise(F.element_at("token_ends", F.greatest(F.lit(1), F.least(size, F.lit(budget)))))
