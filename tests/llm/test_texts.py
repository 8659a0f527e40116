"""WARC, suffix arrays, decontamination, quality, near join, tokens, HTML: brute force, round trips, accuracy, edge cases."""

from __future__ import annotations

import hashlib
import io
import random
import re
import struct
import time
import zipfile
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from sceneloom.llm import decontamination as D
from sceneloom.llm import html_text as H
from sceneloom.llm import near_join as N
from sceneloom.llm import quality as Q
from sceneloom.llm import queries
from sceneloom.llm import suffix_dedup as S
from sceneloom.llm import token_counts as T
from sceneloom.llm import warc as A
from sceneloom.llm.common import sliding_least

# ---- WARC


def _archive(data: bytes) -> A.Archive:
    return A.Archive(lambda at, n: data[at : at + n], len(data))


def test_zip_directories():
    plain, wide = io.BytesIO(), io.BytesIO()
    with zipfile.ZipFile(plain, "w") as z:
        z.writestr("a.txt", b"hello")
        z.writestr(zipfile.ZipInfo("packed.txt"), b"x" * 1000, zipfile.ZIP_DEFLATED)
        z.comment = b"a comment PK\x05\x06 inside"
    with zipfile.ZipFile(wide, "w") as z:
        for i in range(66_000):  # more members than 16 bits count: a ZIP64 directory
            z.writestr(f"m{i}", b"%d" % i)
        with z.open("big", "w", force_zip64=True) as f:
            f.write(b"range read")
    a, b = _archive(plain.getvalue()), _archive(wide.getvalue())
    assert a.stored("a.txt") == b"hello"
    with pytest.raises(ValueError, match="compressed"):
        a.start("packed.txt")
    assert len(b.members) == 66_001 and b.stored("m65999") == b"65999" and b.stored("big") == b"range read"
    with pytest.raises(ValueError, match="end of central directory"):
        _archive(b"no archive")


def test_zip64_fields_are_read():
    """An entry whose sizes and place are in the ZIP64 extra field, behind a ZIP64 end record."""
    body = b"payload"
    local = struct.pack("<IHHHHHIIIHH", 0x04034B50, 45, 0, 0, 0, 0, zlib.crc32(body), 0xFFFFFFFF, 0xFFFFFFFF, 1, 20) + b"x" + struct.pack("<HHQQ", 1, 16, len(body), len(body)) + body
    extra = struct.pack("<HHQQQ", 1, 24, len(body), len(body), 0)
    central = struct.pack("<IHHHHHHIIIHHHHHII", 0x02014B50, 45, 45, 0, 0, 0, 0, zlib.crc32(body), 0xFFFFFFFF, 0xFFFFFFFF, 1, len(extra), 0, 0, 0, 0, 0xFFFFFFFF) + b"x" + extra
    end64 = struct.pack("<IQHHIIQQQQ", 0x06064B50, 44, 45, 45, 0, 0, 1, 1, len(central), len(local))
    locator = struct.pack("<IIQI", 0x07064B50, 0, len(local) + len(central), 1)
    end = struct.pack("<IHHHHIIH", 0x06054B50, 0, 0, 0xFFFF, 0xFFFF, 0xFFFFFFFF, 0xFFFFFFFF, 0)
    assert _archive(local + central + end64 + locator + end).stored("x") == body


def test_warc_round_trip_and_edges(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(A, "RANGE_BYTES", 5000)
    long = "<p>" + "y" * 300_000
    rows = [(1, "u", long), (2, "u\r\nEvil: 1", long), (3, None, None), (4, "u", ""), (5, "é", "short"), (6, "u", "short"), (None, "u", long), (1, "u", long), (7, None, "ü" * 60), (8, "u", "ü" * 60)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    out = A.round_trip(df.select("*", *[df["url"].alias(c) for c in ("payload", "digest", "kind")])).collect()
    assert len(out) == len(rows)
    for r in out:
        if r["record_type"] == "response":
            assert hashlib.sha256(bytes(r["payload"])).hexdigest() == r["payload_digest"] and len(r["payload"]) == r["payload_bytes"]
    got = Counter((r["page_id"], r["payload_bytes"], r["record_type"], r["refers_to"]) for r in out)
    n = len(long)
    assert got == Counter([(1, n, "response", None), (1, n, "response", None), (2, n, "revisit", 1), (None, n, "revisit", 1), (3, 0, "response", None), (4, 0, "response", None), (5, 5, "response", None), (6, 5, "response", None), (7, 120, "response", None), (8, 120, "revisit", 7)])
    assert next(r for r in out if r["page_id"] == 2)["url"] == "u Evil: 1"
    assert A.round_trip(df.limit(0)).count() == 0


def test_damaged_records_are_found():
    raw = A.record(1, "u", b"abc" * 50, hashlib.sha256(b"abc" * 50).hexdigest(), "response", None)
    assert A.parsed(raw)[2] == b"abc" * 50
    with pytest.raises(ValueError, match="damaged"):
        A.parsed(raw.replace(b"abcabc", b"abcabd", 1))


# ---- suffix arrays


def _covered(rows, length):
    seen, raw = Counter(), [(i, (t or "").encode()) for i, t in rows]
    for _, b in raw:
        seen.update(b[i : i + length] for i in range(len(b) - length + 1))
    out = []
    for i, b in raw:
        gone = bytearray(len(b))
        for j in range(len(b) - length + 1):
            if seen[b[j : j + length]] > 1:
                gone[j : j + length] = b"\1" * length
        kept = bytes(x for x, y in zip(b, gone, strict=True) if not y)
        out.append((i, len(b), sum(gone), sum(1 for j in range(len(gone)) if gone[j] and (not j or not gone[j - 1])), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def _texts(seed: int):
    rnd = random.Random(seed)
    word = lambda n, letters="abcdefgh ": "".join(rnd.choice(letters) for _ in range(n))
    base, rows = word(3000), []
    for i in range(200):
        k = rnd.random()
        if k < 0.3:
            p = rnd.randrange(2500)
            rows.append((i, word(rnd.randrange(150)) + base[p : p + rnd.randrange(10, 250)] + word(rnd.randrange(90))))
        elif k < 0.4:
            rows.append((i, "ab" * rnd.randrange(60)))
        elif k < 0.5 and rows:
            rows.append((i, rows[rnd.randrange(len(rows))][1]))
        elif k < 0.6:
            b = list(base[:500])
            b[rnd.randrange(500)], b[rnd.randrange(500)] = "Z", "é"
            rows.append((i, "".join(b)))
        else:
            rows.append((rnd.choice([i, None]), rnd.choice([None, "", word(rnd.randrange(300))])))
    return rows


@pytest.mark.parametrize(("seed", "length", "gram", "shard"), [(1, 40, 16, 4096), (2, 40, 16, 5), (3, 20, 5, 20), (4, 20, 20, 3)])
def test_suffix_dedup_is_brute_force(spark, seed, length, gram, shard):
    rows = _texts(seed)
    got = S.digest(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), length, gram, shard).collect()
    assert sorted(map(tuple, got), key=str) == _covered(rows, length)


def test_suffix_dedup_with_one_hot_anchor(spark):
    """One passage in every text, each time in other company: its anchors are spread over shards and merged."""
    rnd = random.Random(8)
    word = lambda n: "".join(rnd.choice("abcdefgh ") for _ in range(n))
    passage = word(70)
    rows = [(i, word(rnd.randrange(60)) + passage + word(rnd.randrange(60))) for i in range(150)]
    rows += rows[:5] + [(None, rows[9][1])] * 3
    got = S.digest(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), 40, 16, 2).collect()
    assert sorted(map(tuple, got), key=str) == _covered(rows, 40)


def test_suffix_dedup_of_texts_that_polynomial_hashes_confuse(spark):
    """Thue-Morse words and their complements, which have one polynomial hash modulo 2**64, in parts that do not repeat."""
    rnd = random.Random(3)
    rows = []
    for n in (512, 1024):
        bits = [bin(i).count("1") % 2 for i in range(n)]
        for flip in (0, 1):
            rows.append((len(rows), "".join("th"[b ^ flip] for b in bits)))
            rows.append((len(rows), "".join(rnd.choice("abc") for _ in range(300)) + "".join("qz"[b ^ flip] for b in bits)))
    got = S.digest(spark.createDataFrame(rows, "doc_id long, text string").repartition(2)).collect()
    assert sorted(map(tuple, got), key=str) == _covered(rows, 400)


def test_repeats_in_one_shard():
    rnd = random.Random(7)
    for _ in range(400):
        length = rnd.choice([5, 8, 13, 20, 25])
        base = bytes(rnd.choice(b"abcd ") for _ in range(80))
        segs = []
        for _ in range(rnd.randrange(1, 12)):
            at = rnd.randrange(50)
            b = bytearray(base[at : at + length + rnd.randrange(16)])
            if rnd.random() < 0.4 and b:
                b[rnd.randrange(len(b))] = rnd.randrange(256)
            segs.append(bytes(b))
        hits, _, _ = S.repeats(segs, length)
        seen = Counter(s[i : i + length] for s in segs for i in range(len(s) - length + 1))
        for s, h in zip(segs, hits, strict=True):
            assert [seen[s[i : i + length]] > 1 for i in range(len(s) - length + 1)] == h.tolist()


def test_suffix_dedup_edge_cases(edge, nothing):
    rows = [(r["doc_id"], r["text"]) for r in edge.collect()]
    assert sorted(map(tuple, S.digest(edge).collect()), key=str) == _covered(rows, 400)
    d = S.deduplicated(edge)
    assert d.columns == edge.columns and d.count() == len(rows)
    assert S.digest(nothing).count() == 0 and S.deduplicated(nothing).count() == 0


def test_least_of_windows_is_the_last_of_equals():
    v = np.random.default_rng(1).integers(0, 6, 500).astype(np.uint64) << np.uint64(40)
    for width in (1, 2, 7, 50, 500, 501):
        want = [max(j for j in range(i, i + width) if v[j] == v[i : i + width].min()) for i in range(500 - width + 1)]
        assert sliding_least(v, width).tolist() == want


# ---- decontamination


def _words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))


def _hits(docs, items):
    windows = defaultdict(set)
    for i, t in items:
        w = _words(t)
        m = min(10, len(w))
        for j in range(len(w) - m + 1 if w else 0):
            windows[tuple(w[j : j + m])].add(i)
    out = []
    for i, t in docs:
        w, hit, ids = _words(t), set(), set()
        for m in {len(x) for x in windows}:
            for j in range(len(w) - m + 1):
                if tuple(w[j : j + m]) in windows:
                    hit |= set(range(j, j + m))
                    ids |= windows[tuple(w[j : j + m])]
        told = sorted(str(x) for x in ids if x is not None)
        out.append((i, len(w), len(hit), len(told), hashlib.sha256(",".join(told).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


@pytest.mark.parametrize("block", [D.BLOCK_BYTES, 3000])
def test_decontamination_is_brute_force(spark, edge, nothing, block):
    rnd = random.Random(11)
    vocab = [f"w{i}" for i in range(30)] + ["Ünder", "A1", "x"]
    say = lambda n: " ".join(rnd.choice(vocab) + rnd.choice(["", ",", "."]) for _ in range(n))
    items = [(i, say(rnd.choice([1, 2, 3, 8, 10, 11, 30]) if i % 9 == 0 else rnd.randrange(10, 40))) for i in range(60)] + [(3, None), (None, say(12)), (61, ""), (61, "A-b")]
    docs = []
    for i in range(120):
        parts = [say(rnd.randrange(20))]
        for _ in range(rnd.randrange(3)):
            w = rnd.choice(items)[1] or ""
            cut = w.split(" ")
            at = rnd.randrange(max(1, len(cut)))
            parts += [" ".join(cut[at : at + rnd.randrange(1, 25)]).upper(), say(rnd.randrange(5))]
        docs.append((i, "\n".join(parts)))
    docs += [(r["doc_id"], r["text"]) for r in edge.collect()]
    bench = spark.createDataFrame(items, "item_id long, text string")
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    assert sorted(map(tuple, D.digest(df, bench, block).collect()), key=str) == _hits(docs, items)
    assert D.clean(edge, bench).columns == edge.columns
    assert D.digest(nothing, bench, block).count() == 0
    assert D.digest(df, bench.limit(0), block).where("contaminated").count() == 0


# ---- quality


def test_quality_on_held_out_rows(spark, sf_dir):
    sf = sf_dir.replace("sf0.001", "sf0.01")
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    out = Q.digest(docs, labels)
    r = out.join(labels, "doc_id").where("held_out").select("score", "quality", "predicted").collect()
    ones, zeros = [x["score"] for x in r if x["quality"] == 1], [x["score"] for x in r if x["quality"] == 0]
    assert sum(a > b for a in ones for b in zeros) / (len(ones) * len(zeros)) > 0.95
    assert sum(x["predicted"] == x["quality"] for x in r) / len(r) > 0.95
    again = Q.digest(docs.repartition(7), labels.repartition(3))
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, again.collect()))
    for x in out.collect():
        assert x["held_out"] == (zlib.crc32(str(x["doc_id"]).encode()) % 5 == 0) and 0 <= x["score"] <= 1


def test_quality_edge_cases(spark, edge, nothing, sf_dir):
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 0), (2, 0, None), (None, 1, 1), (9, None, 0)], "doc_id long, quality int, toxic int")
    out = Q.digest(edge, labels).collect()
    assert len(out) == edge.count() and all(0 <= r["score"] <= 1 for r in out)
    assert {r["score"] for r in Q.digest(edge, labels.limit(0)).collect()} == {0.5}
    assert Q.digest(nothing, labels).count() == 0
    assert Q.kept(edge, labels).columns == edge.columns


def test_learner_separates():
    rnd = np.random.default_rng(2)
    rows = [(np.array([y, 2 + rnd.integers(50)]), np.ones(2), int(y)) for y in rnd.integers(0, 2, 400)]
    m = Q.Model(bits=8).fit(rows)
    assert m.weights[1] > 1 > -1 > m.weights[0]


# ---- near join


def _jaccard_classes(rows):
    sets, texts = {}, defaultdict(list)
    for n, (_, t) in enumerate(rows):
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        sets[n] = frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()
        texts[t or ""].append(n)
    lead = list(range(len(rows)))

    def find(x):
        while lead[x] != x:
            x = lead[x]
        return x

    for group in texts.values():
        for x in group[1:]:
            lead[find(x)] = find(group[0])
    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and both * 5 >= 4 * (len(sets[a]) + len(sets[b]) - both):
                lead[find(a)] = find(b)
    classes = defaultdict(list)
    for n in range(len(rows)):
        classes[find(n)].append(n)
    return classes


def test_near_join_classes_are_brute_force(spark, monkeypatch, edge, nothing):
    monkeypatch.setattr(N, "TILE", 8)
    monkeypatch.setattr(N, "MEMBERS", 5)
    rnd = random.Random(5)
    rows = []
    for g in range(14):
        base = [f"g{g}w{rnd.randrange(400)}" for _ in range(rnd.choice([3, 6, 40, 80, 150]))]
        for _ in range(rnd.choice([1, 2, 5, 40])):
            w = list(base)
            for _ in range(rnd.choice([0, 1, 1, 2, 3, 6])):
                w[rnd.randrange(len(w))] = f"n{rnd.randrange(10**6)}"
            rows.append((len(rows), " ".join(w)))
    rows += [(r["doc_id"], r["text"]) for r in edge.collect()]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    want = Counter()
    for members in _jaccard_classes(rows).values():
        ids = [rows[n][0] for n in members]
        least = min((i for i in ids if i is not None), default=None)
        want.update((i, least) for i in ids)
    assert Counter((r["doc_id"], r["class_id"]) for r in N.digest(df).collect()) == want
    kept = N.representatives(df)
    assert kept.count() == len(_jaccard_classes(rows))
    assert N.digest(nothing).count() == 0 and N.representatives(nothing).count() == 0
    assert N.representatives(edge).columns == edge.columns


def test_near_join_counts_every_link(spark, monkeypatch):
    """n_links is the number of different texts that are similar enough, in dense groups too."""
    monkeypatch.setattr(N, "TILE", 8)
    rnd = random.Random(6)
    texts = []
    for g, copies in enumerate((5, 2, 60, 24)):
        base = [f"g{g}w{i}" for i in range(120)]
        for _ in range(copies):
            w = list(base)
            for _ in range(rnd.choice([1, 1, 2, 3])):
                w[rnd.randrange(len(w))] = f"n{rnd.randrange(10**6)}"
            texts.append(" ".join(w))
    sets = [{tuple(t.split()[i : i + 5]) for i in range(116)} for t in texts]
    want = [sum(a != b and len(sets[a] & sets[b]) * 5 >= 4 * len(sets[a] | sets[b]) for b in range(len(texts))) for a in range(len(texts))]
    rows = [*enumerate(texts), (len(texts), texts[0])]
    got = {r["doc_id"]: (r["n_links"], r["copies"]) for r in N.digest(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    assert got == {n: (want[0 if n == len(texts) else n], 2 if n in (0, len(texts)) else 1) for n, _ in rows}
    assert sum(want) > 4 * len(texts)


def test_near_join_links_of_documents(spark, sf_dir):
    """Links, classes and copies of whole documents are brute force's; rows equal in text and doc_id are no new links."""
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    rows += rows[:60]
    first = {}
    for i, t in rows:
        first.setdefault(t or "", []).append(i)
    words = {t: t.split() for t in first}
    sets = {t: {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set() for t, w in words.items()}
    links = Counter()
    texts = list(first)
    for a, x in enumerate(texts):
        for y in texts[:a]:
            both = len(sets[x] & sets[y])
            if both and both * 5 >= 4 * (len(sets[x]) + len(sets[y]) - both):
                links[x] += 1
                links[y] += 1
    got = Counter((r["doc_id"], r["n_links"], r["copies"], r["text_id"]) for r in N.digest(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect())
    assert got == Counter((i, links[t or ""], len(first[t or ""]), min(first[t or ""])) for i, t in rows) and links


def test_pruning_keeps_what_is_similar():
    """Signatures of similarity 0.8 outlast the comparison all but never; those of 0.3 are dropped at once."""
    rng = np.random.default_rng(4)
    a = rng.integers(0, 1 << 16, (4000, 160)).astype(np.uint16)
    flip = lambda s: np.where(rng.random(a.shape) < s, a, a ^ np.uint16(1))
    assert N.likely(a, flip(0.8)).mean() > 0.9995 and N.likely(a, flip(0.3)).mean() < 0.001


# ---- tokens


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(queries.tokenizer_path())


def test_counts_are_the_library_s(spark, sf_dir, library, edge, nothing):
    path = queries.tokenizer_path()
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()] + [(r["doc_id"], r["text"]) for r in edge.collect()]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = Counter(map(tuple, T.token_counts(df, path).collect()))
    count = [len(e.ids) for e in library.encode_batch([t or "" for _, t in rows], add_special_tokens=False)]
    assert got == Counter((i, len((t or "").encode()), n, n > 1024) for (i, t), n in zip(rows, count, strict=True))
    assert T.token_counts(nothing, path).count() == 0


def test_counts_on_odd_texts(library):
    rnd = random.Random(1)
    bits = ["a", "the", " ", "  ", "\n", "\t", "\xa0", " ", "'s", "'ll", "1", "½", "é", "漢", "🙂", "!", "--", "<|endoftext|>", "\x1c", "\x85", "İ", "_", "\r\n", "​", "don't", "²", "<|endof"]
    texts = ["".join(rnd.choice(bits) for _ in range(rnd.randrange(14))) for _ in range(4000)]
    want = [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]
    assert T.counts(pa.array(texts), queries.tokenizer_path())[1].tolist() == want


def test_counts_of_words_that_polynomial_hashes_confuse(library):
    """Thue-Morse words and their complements have one polynomial hash for every odd base, and counts of their own."""
    for pair, n in (("th", 2048), ("iq", 1024), ("aZ", 4096)):
        word = "".join(pair[bin(i).count("1") % 2] for i in range(n))
        texts = [word, "".join(pair[1 - bin(i).count("1") % 2] for i in range(n)), f"a {word}", word]
        want = [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]
        assert T.counts(pa.array(texts), queries.tokenizer_path())[1].tolist() == want


def test_every_prefix_count_is_exact(library, spark):
    """A prefix of a piece has the count that the library gives for it by itself; budgets cut at token ends."""
    c = T.counter(queries.tokenizer_path())
    for word in ("internationalisation", " tokenization", "xqzzkw", "éèê"):
        raw = word.encode()
        _, counts = c.table(raw)
        for n in range(1, len(raw) + 1):
            assert counts[n] == len(c.merged(raw[:n]))
    text = "The internationalisation of tokens<|endoftext|> isn't easy."
    p = T.Prefixes(c, text)
    e = library.encode(text, add_special_tokens=False)
    ends = [len(text[: o[1]].encode()) for o in e.offsets]
    assert p.ends == ends and p.within(3) == ends[2] and p.complete(ends[4]) == 5 and p.within(0) == 0
    df = T.prefix_table(spark.createDataFrame([(1, text, 5), (2, None, 6)], "doc_id long, text string, token_ends int"), queries.tokenizer_path())
    from pyspark.sql import functions as F

    r = df.orderBy("doc_id").select(T.truncated(3).alias("b"), T.tokens_in(F.lit(ends[4])).alias("n")).collect()
    assert [tuple(x) for x in r] == [(ends[2], 5), (0, 0)]


# ---- HTML


def test_tokens_of_all_letters(library):
    """Each code point that some library takes for a letter or number, and a share of the others, in words and alone."""
    import unicodedata

    import regex

    every = "".join(map(chr, [*range(0x80, 0xD800), *range(0xE000, 0x110000)]))
    unsure = {c for c in regex.findall(r"[\p{L}\p{N}]", every) if unicodedata.category(c) == "Cn"}
    texts = [f"a{c}1 {c}{c}x" for c in [*sorted(unsure), *every[::53]]]
    want = [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]
    got = T.counts(pa.array(texts), queries.tokenizer_path())[1].tolist()
    assert got == want and len(unsure) > 1000
    one = "x".join(sorted(unsure)[:500])
    assert len(T.Prefixes(T.counter(queries.tokenizer_path()), one).ends) == len(library.encode(one, add_special_tokens=False).ids)


def test_html_parts():
    page = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="</p><p>no";</script></head><body>
    <header><h1>Site</h1></header><nav><ul><li><a href=x>Home</a></ul></nav><div class="cookie-notice">We use cookies &amp; more.</div>
    <article><h1>Head &amp; line</h1><p>First <b>bold</b>word<br>next.<p>Second&nbsp;one &#233;.
    <aside>Side</aside><div class="ad">Buy</div><form><label>Mail</label><input></form><blockquote>Quote.</blockquote>
    <table><tr><td>Cell</td></tr></table><section id="comments"><p>Nice post, a reader wrote this long comment here.</p></section></article>
    <div id="sidebar"><p>Related words that are long enough to be read as prose by themselves.</p></div><footer>&copy; 2024</footer><!-- end --></body></html>"""
    assert H.main_text(page) == "Head & line First boldword next. Second one é. Quote. Cell"


def test_html_without_article_tags():
    prose = "This is a paragraph of plain prose that goes on for a good many words, so that it can only be content of the page."
    page = f"<body><div class=menu><a href=1>One</a> <a href=2>Two</a></div><div><p>{prose}</p><p>Short line.</p><p>{prose}</p></div><div><a href=3>More</a> <a href=4>Links</a></div></body>"
    assert H.main_text(page) == f"{prose} Short line. {prose}"


def test_html_unclosed_and_foreign_elements():
    """What is closed at once or never closed does not take the text after it; formulas and objects are text."""
    for tag in ('<svg class="icon"/>', "<svg />", "<math/>", "<button>", "<select>", "<object data=x>", "<svg>", "<noscript>", "<iframe src=x>", "<template>", '<svg><path d="M0"/><title/></svg>'):
        assert H.main_text(f"<article><p>One.</p>{tag}<p>Two.</p><p>Three.</p></article>") == "One. Two. Three.", tag
        assert H.main_text(f"<article><p>One.</p>{tag}<p>Two.</p></article><nav><button>Go</button><svg><text>n</text></svg></nav>") == "One. Two.", tag
    assert H.main_text("<article><p>So <math><mi>x</mi><mo>=</mo><mn>2</mn></math> holds <object>as shown</object>.</p></article>") == "So x=2 holds as shown."
    assert H.main_text("<article><p>One.</p><button>Share</button><svg><text>n</text></svg><script>a</script><textarea>b</textarea><p>Two.</p></article>") == "One. Two."


def test_html_wrappers_named_after_other_parts():
    """A word of class, id or role on a wrapper does not take the article in it."""
    prose = "This is a paragraph of plain prose that goes on for a good many words, so that it can only be content of the page."
    aside = '<div class="sidebar"><p>Related words that are long enough to be read as prose by themselves.</p></div>'
    for name in ("content-sidebar-wrap", "with-sidebar", "has-header", "article-bottom", "social", "overlay notice"):
        for kind in ("class", "id", "role"):
            assert H.main_text(f'<body><div {kind}="{name}"><article><h1>Head</h1><p>{prose}</p></article>{aside}</div></body>') == f"Head {prose}", (name, kind)
            if name not in ("social", "overlay notice"):
                assert H.main_text(f'<body><div {kind}="{name}"><p>{prose}</p><p>{prose}</p></div>{aside}</body>') == f"{prose} {prose}", (name, kind)
                assert H.main_text(f'<article><p>One.</p><div {kind}="{name}"><p>Two.</p></div></article>') == "One. Two.", (name, kind)
    assert H.main_text(f'<article><p>{prose}</p><section id="comments"><p>{prose}</p></section></article>') == prose
    words = H.blocks('<div class="social"><p>Text.</p></div>')
    assert -H.SURE < H.leaning(*words[0]) < 0
    # loose words do not take prose, whole pages in a form, or a headline
    assert H.main_text(f'<article><p>{prose}</p><section id="discussion"><h2>Discussion</h2><p>{prose}</p></section></article>') == f"{prose} Discussion {prose}"
    assert H.main_text(f'<body><nav><a href=1>One</a></nav><div class="legal"><h1>Court ruling</h1><p>{prose}</p><p>{prose}</p></div></body>') == f"Court ruling {prose} {prose}"
    assert H.main_text(f'<article><div class="entry-header"><h1>Head</h1></div><p>{prose}</p></article>') == f"Head {prose}"
    assert H.main_text(f'<form id="page"><nav><a href=1>One</a></nav><article><p>{prose}</p></article><footer>{prose}</footer></form>') == prose
    # prose and neighbours outweigh the word
    assert H.main_text(f'<article><p>{prose}</p><p class="social">{prose}</p><p>{prose}</p></article>') == f"{prose} {prose} {prose}"


def test_html_cut_decides(sf_dir):
    """The article of each page is what its tags say, and a real share of the labels is not that of the block's own costs."""
    import duckdb

    pages = [r[0] for r in duckdb.sql(f"SELECT html FROM '{sf_dir.replace('sf0.001', 'sf0.01')}/pages.parquet'").fetchall()]
    blocks = changed = 0
    for page in pages:
        found = H.blocks(page or "")
        capacity, edges = H.graph(found)
        side = H.max_flow_side(capacity, edges)
        blocks += len(found)
        changed += sum((c > 0) != s for c, s in zip(capacity[: len(found)], side))
        for (text, element, _), s in zip(found, side):
            tags = set()
            while element is not None:
                tags.add(element.tag)
                element = element.parent
            assert s == ("article" in tags and not tags & {"aside", "form", "nav", "footer"}) or not tags & {"article", "nav", "footer", "head", "form", "aside"} or s is False, text
    print(f"labels that the cut changes: {changed} of {blocks}")
    assert changed > 0.05 * blocks


def test_html_short_paragraphs_without_telling_tags():
    prose = "Prose that runs on for long enough to be read as the body of a page. " * 4
    assert H.main_text("<div><p>Short one.</p><p>Short two.</p><p>Short three.</p></div>") == "Short one. Short two. Short three."
    assert H.main_text(f'<div class="legal"><h1>Court ruling</h1><p>{prose}</p></div>') == f"Court ruling {prose.strip()}"
    assert H.main_text("<p>Four words are here.</p>" * 500).count("Four") == 500
    assert H.main_text('<div class="cookies"><p>We use cookies.</p></div>') == ""


def test_html_deep_pages_take_time_in_proportion():
    deep = 100_000
    text = "Some text that is long enough to count as prose here."
    assert H.main_text("<div>" * 997 + text) == text and H.main_text("<div>" * deep + text + "</div>" * deep) == text
    for page in ("<div>" * deep, "<b>" * deep + "</i>" * deep, "<i><div>" + "<b>" * deep + "</i>" * deep, "<ul><li>" * deep, "<div><p>a b c.</p>" * 30_000, "<article>" * 20_000 + "x", "<svg>" * deep + "<a/>" * deep):
        began = time.perf_counter()
        assert isinstance(H.main_text(page), str) and time.perf_counter() - began < 30


def test_html_edge_cases(spark):
    for page in (None, "", "   ", "<", "<p", "plain", "<!-- never closed", "<script>never closed", "<a href='never closed>x", "</p></div>", "<div " * 2000, "a<b>c" * 5000, "<p>" * 3000):
        assert isinstance(H.main_text(page), str)
    df = spark.createDataFrame([(1, None, None, "x"), (None, "u", "<article>a &lt; b</article>", None), (1, "u", "<article>a &lt; b</article>", "y")], "page_id long, url string, html string, text string")
    assert sorted((r["page_id"] or 0, r["text"], r["n_chars"]) for r in H.extracted(df).collect()) == [(0, "a < b", 5), (1, "", 0), (1, "a < b", 5)]
    assert H.extracted(df.limit(0)).count() == 0


def test_cut_is_minimal():
    rnd = random.Random(9)
    for _ in range(150):
        n = rnd.randrange(1, 8)
        cap = [rnd.uniform(-2, 2) for _ in range(n)]
        edges = [(i, j, rnd.uniform(0, 2)) for i in range(n) for j in range(i) if rnd.random() < 0.5]
        cost = lambda side: sum(max(0, c) for c, s in zip(cap, side, strict=True) if not s) + sum(max(0, -c) for c, s in zip(cap, side, strict=True) if s) + sum(w for a, b, w in edges if side[a] != side[b])  # noqa: E731, B023
        best = min(cost([bool(m >> i & 1) for i in range(n)]) for m in range(1 << n))
        assert cost(H.max_flow_side(cap, edges)) == pytest.approx(best)
