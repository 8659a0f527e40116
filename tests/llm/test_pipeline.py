"""The pipeline's stages against brute force on their own inputs, and on edge cases."""

from __future__ import annotations

import re
from collections import Counter

import corpus_pipeline
from sceneloom.llm import queries
from test_texts import _hits, _jaccard_classes


def _sql(docs, tmp_path, name, sql):
    """What SQL gives over a stage's input."""
    import duckdb

    docs.write.parquet(str(tmp_path / name))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path / name}/*.parquet'")
    found = con.execute(sql)
    names = [c[0] for c in found.description]
    return [dict(zip(names, r, strict=True)) for r in found.fetchall()]


def test_stages(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = docs.columns
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    for name, stage in corpus_pipeline.STAGES:
        before = docs.collect()
        out = stage(spark, docs, sf_dir)
        after = out.collect()
        rows = [(r["doc_id"], r["text"]) for r in before]
        if name == "sharding":
            want = _sql(docs, tmp_path, name, queries.ORACLES["op7_sharding"])
            assert Counter(tuple(r[c] for c in out.columns) for r in after) == Counter(tuple(r[c] for c in out.columns) for r in want)
            break
        assert out.columns == columns and set(after) <= set(before)
        kept = {r["doc_id"] for r in after}
        if name == "quality":
            wrong = [i for i, q in labels.items() if (i in kept) != (q == 1)]
            assert len(wrong) <= 0.03 * len(labels)
        elif name == "near_duplicates":
            assert kept == {min(rows[n][0] for n in c) for c in _jaccard_classes(rows).values()}
        elif name == "decontamination":
            items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
            assert kept == {r[0] for r in _hits(rows, items) if not r[-1]}
        elif name == "mixing":
            taken = Counter()
            for r in after:
                taken[r["doc_id"]] += len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or ""))
            want = {r["doc_id"]: r["taken"] for r in _sql(docs, tmp_path, name, queries.ORACLES["op4_mixing"])}
            assert {i: taken[i] for i in want} == want and max(Counter(r["doc_id"] for r in after).values()) <= 3
        docs = spark.createDataFrame(after, docs.schema)
    assert corpus_pipeline.run(spark, sf_dir).count() == len(after)


def test_stages_on_edge_cases(spark, sf_dir, edge, nothing):
    for docs in (edge, nothing):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, sf_dir)
            if name != "sharding":
                assert out.columns == docs.columns
            assert out.count() >= 0


def test_stages_keep_columns_of_clashing_names(spark, sf_dir):
    """Columns that are named as the operators name theirs inside, but for the reserved prefixes, go through every stage."""
    from pyspark.sql import functions as F

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    own = ("k", "key", "set", "bh", "rep", "word", "draw", "u", "rank", "reps", "h", "s", "t", "slot", "shard", "size", "part", "times", "first", "score", "hit", "n")
    docs = docs.withColumns({c: F.concat(F.lit(c), F.col("doc_id").cast("string")) for c in own})
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf_dir)
        assert out.columns == docs.columns, name
        rows = out.collect()
        assert rows and all(r[c] == f"{c}{r['doc_id']}" for r in rows for c in own)
