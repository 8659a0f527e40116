"""Mixing, exact dedup, sharding: SQL, laws, edge cases."""

from __future__ import annotations

import hashlib
import zlib
from collections import Counter, defaultdict

import pytest

from oracle import same
from sceneloom.llm import exact_dedup, mixing, queries, sharding

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_same_as_sql(name, spark, sf_dir, duck):
    same(queries.QUERIES[name](spark, sf_dir), duck, queries.ORACLES[name])


def test_mix_reaches_targets(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    m = mixing.mixture(docs).join(docs.select("doc_id", "source"), "doc_id").collect()
    taken, target, biggest = Counter(), {}, Counter()
    for r in m:
        taken[r["source"]] += r["size"] * r["reps"]
        target[r["source"]] = r["target"]
        biggest[r["source"]] = max(biggest[r["source"]], r["size"])
        assert 0 <= r["reps"] <= 3 and r["target"] <= 3 * r["source_size"]
    assert all(abs(taken[s] - target[s]) <= biggest[s] / 2 + 1 for s in target)
    assert sum(target.values()) == pytest.approx(sum(r["size"] for r in m))
    assert sorted(map(tuple, m)) == sorted(map(tuple, mixing.mixture(docs.repartition(5)).join(docs.select("doc_id", "source"), "doc_id").collect()))


def test_water_filling_clamps(spark):
    s = spark.createDataFrame([("a", 10, 1.0), ("b", 1000, 1.0), ("c", 100, 2.0)], "source string, source_size long, weight double")
    got = {r["source"]: r["target"] for r in mixing.fill(s).collect()}
    assert got == {"a": 30.0, "b": pytest.approx(780.0), "c": 300.0}


def test_mix_edge_cases(edge, nothing):
    out = mixing.mixed_digest(edge).collect()
    assert len(out) == edge.count() and all(r["taken"] <= 3 * r["size"] for r in out)
    assert mixing.mixed_digest(nothing).count() == 0 and mixing.mixed_rows(nothing).count() == 0
    rows = mixing.mixed_rows(edge)
    assert rows.columns == edge.columns and rows.count() == sum(r["reps"] for r in mixing.mixture(edge).collect())


def test_mix_of_equal_rows(spark, tmp_path):
    """Of equal rows as many are taken as fit: a source of 40 equal rows has a target of 60, and 60 are taken."""
    import duckdb

    rows = [(1, "word", "a", i) for i in range(40)] + [(i, f"b{i}", "b", 0) for i in range(170)] + [(i, f"c{i}", "c", 0) for i in range(150)]
    more = [(2, "x " * 30, "d", 1)] * 50 + [(None, None, "d", 2)] * 9 + [(3, "", "d", 2)] * 9 + [(None, "z z", None, 3)] * 30
    for some in (rows, rows + more, more):
        df = spark.createDataFrame(some, "doc_id long, text string, source string, n int").repartition(5)
        at = str(tmp_path / f"d{len(some)}")
        df.write.parquet(at)
        con = duckdb.connect()
        con.execute(f"CREATE VIEW documents AS SELECT * FROM '{at}/*.parquet'")
        same(mixing.mixed_digest(df), con, queries.ORACLES["op4_mixing"])
        size = lambda t: len((t or "").split())
        taken, target, largest = Counter(), {}, Counter()
        for r in mixing.mixed_rows(df).collect():
            taken[r["source"]] += size(r["text"])
        sizes = Counter()
        for _, text, source, _ in some:
            sizes[source] += size(text)
            largest[source] = max(largest[source], size(text))
        for r in mixing.mixed_digest(df).collect():
            target[r["source_size"]] = r["target"]
        for source, n in sizes.items():
            assert abs(taken[source] - target[n]) <= largest[source] / 2 + 1e-6
        if len(some) == 360:
            assert taken["a"] == 60 == target[40]


def test_exact_dedup_edge_cases(edge, nothing):
    out = exact_dedup.exact_duplicates(edge).collect()
    rows = edge.select("doc_id", "text").collect()
    sha = lambda t: hashlib.sha256((t or "").translate(FOLD).encode()).hexdigest()
    groups = defaultdict(list)
    for r in rows:
        groups[sha(r["text"])].append(r["doc_id"])
    assert Counter((r["doc_id"], r["text_sha256"]) for r in out) == Counter((r["doc_id"], sha(r["text"])) for r in rows)
    for s, ids in groups.items():
        mine = [r for r in out if r["text_sha256"] == s]
        keep = max((i for i in ids if i is not None), default=None)
        assert all(r["keep_id"] == keep and r["group_size"] == len(ids) for r in mine)
        assert [r["doc_id"] for r in mine if r["kept"]] == [keep]
    assert exact_dedup.exact_duplicates(nothing).count() == 0


def test_exact_dedup_in_many_parts(spark, monkeypatch):
    """A second filter in many parts, over several passes, gives the same rows."""
    monkeypatch.setattr(exact_dedup, "PART_WORDS", 64)
    monkeypatch.setattr(exact_dedup, "PARTS_AT_ONCE", 3)
    df = spark.createDataFrame([(i, f"text {i % 3000}") for i in range(5000)], "doc_id long, text string")
    out = exact_dedup.exact_duplicates(df).collect()
    assert len(out) == 5000 and sum(r["kept"] for r in out) == 3000 and all(r["keep_id"] >= r["doc_id"] for r in out)
    assert sum(r["group_size"] == 2 for r in out) == 4000


@pytest.mark.parametrize("n", [2_000, 60_000])
def test_few_single_rows_shuffle(spark, n):
    """At any number of rows fewer than one single row in twenty goes the long way; no repeated one passes."""
    from pyspark.sql import functions as F

    docs = spark.range(n).select(F.col("id").alias("doc_id"), F.concat(F.lit("t"), F.when(F.col("id") % 5 == 0, F.floor(F.col("id") / 10)).otherwise(-F.col("id"))).alias("text"))
    rows = exact_dedup.possible(exact_dedup.cut(exact_dedup.hashed(docs)))
    found = rows.select("maybe", (F.col("doc_id") % 5 == 0).alias("twice")).groupBy("twice").agg(F.avg(F.col("maybe").cast("double")).alias("share")).collect()
    share = {r["twice"]: r["share"] for r in found}
    assert share[True] == 1.0 and share[False] < 0.05


@pytest.mark.parametrize("shards", [1, 2, 7, 8, 13])
def test_shards_keep_the_law(spark, monkeypatch, shards):
    monkeypatch.setattr(sharding, "RANGE_ROWS", 300)
    monkeypatch.setattr(sharding, "RUN", 7)
    df = spark.createDataFrame([(i, f"t{i}") for i in range(3000)], "doc_id long, text string")
    root = sharding.tree(shards)
    out = sharding.sharded(df, shards, root).collect()
    slots = defaultdict(list)
    for r in out:
        slots[r["shard"]].append(r["slot"])
        assert r["grown_shard"] in (r["shard"], shards)
        assert r["size"] == len(f"t{r['doc_id']}") + 1 and r["text_crc32"] == zlib.crc32(f"t{r['doc_id']}".encode())
    assert all(sorted(v) == list(range(len(v))) for v in slots.values()) and set(slots) == set(range(shards))
    assert all(abs(len(v) - 3000 / shards) < 0.35 * 3000 / shards + 20 for v in slots.values())
    twice = sharding.sharded(df, shards + 1, sharding.grow(root, shards)).collect()
    assert {r["doc_id"]: r["grown_shard"] for r in out} == {r["doc_id"]: r["shard"] for r in twice}


def test_slots_of_a_hot_key(spark, monkeypatch, tmp_path):
    """Half of all rows share a doc_id, and many of them the text too: slots are the SQL's."""
    import duckdb

    monkeypatch.setattr(sharding, "RANGE_ROWS", 20)
    monkeypatch.setattr(sharding, "RUN", 7)
    rows = [(None, f"t{i % 40}") for i in range(300)] + [(7, None)] * 60 + [(i, f"u{i}") for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    df.write.parquet(str(tmp_path / "d"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/d/*.parquet'")
    same(sharding.sharded(df), con, queries.ORACLES["op7_sharding"])


def test_weights_move_rows_only_where_they_change(spark):
    """More weight in one rack: rows that move between regions go into its region only."""
    from pyspark.sql import functions as F

    one = sharding.tree(8)
    heavy = sharding.Node("root", children=tuple(sharding.Node(r.name, children=tuple(sharding.Node(k.name, children=tuple(sharding.Node(x.name, 3.0 if k.name == "rack1" else 1.0, shard=x.shard) for x in k.children)) for k in r.children)) for r in one.children))
    key = F.col("id").cast("string")
    moves = spark.range(4000).select(sharding.place(key, one).alias("a"), sharding.place(key, heavy).alias("b")).where("a <> b").collect()
    assert moves and all(r["b"] in (2, 3) or r["b"] in (0, 1) and r["a"] >= 4 for r in moves)


def test_shards_edge_cases(edge, nothing):
    out = sharding.sharded(edge).collect()
    assert len(out) == edge.count() and all(r["size"] >= 1 for r in out)
    per = defaultdict(list)
    for r in out:
        per[r["shard"]].append(r["slot"])
    assert all(sorted(v) == list(range(len(v))) for v in per.values())
    assert sharding.sharded(nothing).count() == 0


def test_mix_of_many_sources(spark, monkeypatch):
    """Beyond the broadcast's bound the join shuffles, and the mix is the same."""
    df = spark.createDataFrame([(i, "word " * (i % 50), f"s{i % 37}") for i in range(2000)], "doc_id long, text string, source string")
    one = sorted(map(tuple, mixing.mixed_digest(df).collect()))
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 0)
    assert sorted(map(tuple, mixing.mixed_digest(df).collect())) == one
