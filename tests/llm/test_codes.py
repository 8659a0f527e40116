"""Vector codes: a plain Lloyd in Python integers, exactness, what moves, edge cases."""

from __future__ import annotations

import hashlib
import math
from collections import Counter, defaultdict

import numpy as np

from sceneloom.llm import vector_codes as v

SCHEMA = "vec_id long, embedding array<double>, label int, q string, code int"


def brute(rows, entries=64, parts=16, rounds=2):
    """rows: (vec_id, vector, label); what the contract says, in plain integers."""
    ok = [(i, [math.floor(256 * x) for x in e], y) for i, e, y in rows if e and all(x is not None and math.isfinite(x) for x in e)]
    ok.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    if not ok:
        return []
    d = len(ok[0][1]) // parts
    cut = [[r[1][p * d : (p + 1) * d] for p in range(parts)] for r in ok]
    books = [[c[p] for c in cut[:entries]] for p in range(parts)]

    def nearest(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, c)), e) for e, c in enumerate(book))

    for _ in range(rounds):
        for p in range(parts):
            own = defaultdict(list)
            for c in cut:
                own[nearest(c[p], books[p])[1]].append(c[p])
            books[p] = [[sum(k) // len(own[e]) for k in zip(*own[e])] if e in own else c for e, c in enumerate(books[p])]
    found = [[nearest(c[p], books[p]) for p in range(parts)] for c in cut]
    errors = [sum(f[0] for f in row) for row in found]
    labels = Counter()
    for r, e in zip(ok, errors):
        labels[r[2]] += e
    sha = hashlib.sha256(",".join(str(x) for b in books for c in b for x in c).encode()).hexdigest()
    return [(r[0], "".join(f"{f[1]:02x}" for f in row), e, labels[r[2]], sha) for r, row, e in zip(ok, found, errors)]


def table(spark, rows):
    return spark.createDataFrame([(i, e, y, "q", 1) for i, e, y in rows], SCHEMA).repartition(3)


def test_plain_lloyd(spark):
    rng = np.random.default_rng(5)
    rows = [(int(i), [float(x) for x in rng.normal(0, 1, 32)], [None, 1, 2][i % 3]) for i in rng.permutation(300)]
    rows += rows[:20] + [(None, rows[3][1], 1), (7, None, 1), (8, [None] * 32, 1), (9, [math.nan] + [0.0] * 31, 2), (10, [math.inf] * 32, 2), (11, [1.0] * 16, 1), (12, [], 3), (13, [1.0] * 7, 3)]
    want = brute([r for r in rows if r[1] is not None and len(r[1]) == 32])
    assert Counter(map(tuple, v.digest(table(spark, rows)).collect())) == Counter(want)


def test_few_rows_and_none(spark):
    for rows in ([], [(3, None, 1)], [(3, [0.5] * 16, None)], [(3, [0.5] * 16, 1), (2, [-0.25] * 16, 1), (2, [-0.25] * 16, 1)]):
        assert Counter(map(tuple, v.digest(table(spark, rows)).collect())) == Counter(brute([r for r in rows if r[1]]))


def test_large_components_are_exact(spark):
    rows = [(i, [(-1.0) ** i * (1000.0 + i * k) for k in range(16)], 1) for i in range(80)]
    assert Counter(map(tuple, v.digest(table(spark, rows)).collect())) == Counter(brute(rows))
    beyond = v.digest(table(spark, rows + [(90, [1e300] * 16, 2), (91, [-1e300] * 16, 2)])).collect()
    assert len(beyond) == 82 and all(r["error"] >= 0 for r in beyond)


def test_only_moved_parts_change_sums(spark):
    """Sums kept by pluses and minuses are those of all rows, and the second round has fewer contributions than parts."""
    rng = np.random.default_rng(6)
    rows = v.kept(table(spark, [(i, [float(x) for x in rng.normal(0, 1, 16)], 1) for i in range(500)]))
    books, state = v.trained(rows)
    got = state.collect()
    moved = sum(a != b for r in got for a, b in zip(r["code"], r["before"]))
    assert 0 < moved < 0.7 * 500 * 16
    total, count = np.zeros((16, 64, 1), np.int64), np.zeros((16, 64, 1), np.int64)
    for r in got:
        for p, e in enumerate(r["code"]):
            total[p, e, 0] += r["q"][p]
            count[p, e] += 1
    used = count > 0
    assert (books.entries[used] == total[used] // count[used]).all()


def test_decoded_is_near(spark, sf_dir):
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    rows = v.kept(vectors)
    books, state = v.trained(rows)
    got = {r["vec_id"]: np.frombuffer(r["code"], np.uint8) for r in v.assigned(state, books, final=True).collect()}
    true = {r["vec_id"]: np.array(r["embedding"]) for r in vectors.collect()}
    ids = sorted(got)
    back = books.decoded(np.stack([got[i] for i in ids]))
    real = np.stack([true[i] for i in ids])
    assert ((back - real) ** 2).sum() < 0.5 * (real**2).sum()
