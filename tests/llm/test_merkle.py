"""Merkle manifest: a plain tree in Python, groups that cross many partitions, single leaves, equal rows, tampering."""

from __future__ import annotations

import random
import zlib
from collections import Counter, defaultdict
from hashlib import sha256

import pytest

from sceneloom.llm import merkle

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, g string, pid int, level int, tampered string"


def h(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def leaf(doc_id, text, lang, source, n):
    one = lambda x: "-" if x is None else f"{len(str(x).encode())}:{x}"
    return h(*(one(x) for x in (doc_id, source, lang, n, text)))


def tree(nodes):
    """The root, and each leaf's steps: (left, right) of what its node is hashed with."""
    steps, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for r, i in enumerate(at):
            other = nodes[i ^ 1] if i ^ 1 < len(nodes) else ""
            steps[r].append((other, "") if i % 2 else ("", other))
        nodes = [h(*nodes[i : i + 2]) for i in range(0, len(nodes), 2)]
        at = [i // 2 for i in at]
    return nodes[0], steps


def brute(rows):
    groups = defaultdict(list)
    for r in rows:
        groups[r[2]].append((r[0] is not None, r[0] or 0, leaf(*r[:5]), r))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: tree([x[2] for x in sorted(groups[g], key=lambda x: x[:3])]) for g in names}
    root, tops = tree([trees[g][0] for g in names]) if names else (None, [])
    out = []
    for g, top in zip(names, tops):
        for (_, _, own, r), steps in zip(sorted(groups[g], key=lambda x: x[:3]), trees[g][1]):
            steps, now = steps + top, own
            if r[0] is not None and r[4] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0:
                now = leaf(*r[:4], r[4] + 1)
            for left, right in steps:
                now = h(left, now, right)
            out.append((r[0], own, trees[g][0], root, h(*(a + b for a, b in steps)), now, now == root))
    return out


def check(spark, rows, parts=5):
    df = spark.createDataFrame([(*r, "g", 1, 2, "t") for r in rows], SCHEMA).repartition(parts)
    got = merkle.digest(df)
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert Counter(map(tuple, got.collect())) == Counter(brute(rows))


@pytest.mark.parametrize("n", [0, 1, 2, 3, 5, 64, 65])
def test_sizes(spark, n):
    check(spark, [(i, f"text {i}", "en", "s", 5) for i in range(n)])


def test_groups_over_many_partitions(spark):
    """One group holds most rows, some are alone; more partitions than some groups have rows."""
    spark.conf.set("spark.sql.shuffle.partitions", "23")
    try:
        rng = random.Random(4)
        rows = [(rng.randrange(900), f"t{i % 50}", rng.choice(["en"] * 12 + ["de", "fr", None, "é", "ž"]), rng.choice(["a", None, ""]), rng.choice([None, 1, 2**63 - 1])) for i in range(700)]
        rows += [(7, "same", "en", "a", 1)] * 300 + [(None, None, None, None, None)] * 4 + [(1, "x", "only", "s", 3), (2, "", "", "", 0)]
        rows += [(i, "t", f"lang{i}", "s", 1) for i in range(41)]
        check(spark, rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_edge_table(edge, nothing):
    rows = [tuple(r) for r in edge.select("doc_id", "text", "lang", "source", "n_chars").collect()]
    assert Counter(map(tuple, merkle.digest(edge).collect())) == Counter(brute(rows))
    assert merkle.digest(nothing).count() == 0


@pytest.mark.parametrize("total", [1, 2, 7, 8, 37, 100])
def test_subtrees_are_aligned(total):
    """Any cut of the leaves into runs: what runs build and what meets by coordinate is the whole tree, nothing twice."""
    import numpy as np

    rng = random.Random(total)
    nodes = [h(str(i)) for i in range(total)]
    for _ in range(20):
        bounds = sorted({0, total, *(rng.randrange(total + 1) for _ in range(rng.randrange(6)))})
        known = {}
        for a, z in zip(bounds, bounds[1:]):
            own = np.frombuffer("".join(nodes[a:z]).encode(), np.uint8).reshape(-1, merkle.WIDTH)
            most = list(merkle.maximal(merkle.subtrees(own, a, total)))
            assert len(most) <= 2 * (merkle.height(total) + 1)
            for k, i, d in most:
                assert (k, i) not in known
                known[k, i] = d
        for low in range(0, merkle.height(total), 2):
            list(merkle.joined(known, low, low + 2, total))
        assert known[merkle.height(total), 0].decode() == tree(nodes)[0]
