"""Quality rules: counts against plain Python, the learner against a plain sequential covering, edge cases."""

from __future__ import annotations

import math
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from sceneloom.llm import quality_rules as q

SPACE = " \t\n\x0b\x0c\r"


def plain(text):
    """The contract's counts of one text."""
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if line.strip(SPACE):
            dup += line in seen
            seen.add(line)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    times = Counter(windows)
    inside = {i + k for i, w in enumerate(windows) if times[w] > 1 for k in range(3)}
    failed = len(words) < 50 or 100 * len(inside) > 50 * len(words)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(inside), failed


def check(df):
    texts = df.select("doc_id", "text").collect()
    got = q.digest(df, df.sparkSession.createDataFrame([], "doc_id long, quality int")).collect()
    assert Counter((r["doc_id"], *plain(r["text"]), not plain(r["text"])[-1]) for r in texts) == Counter(map(tuple, got))


def test_counts_of_documents(spark, sf_dir):
    check(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def test_counts_of_odd_texts(spark, edge, nothing):
    check(edge)
    odd = ["a b c a b c a b c", "x\ny\nx\n x\n\n\nx", "a b a b a b", "€ é b ÿ c #|<>", "\x0b\x0c\ta\r\nb\r\na\r", "1 2 3 " * 30 + "1 2", "日本 語 " * 40, "\x00 \x00 \x00 \x00 \x00"]
    check(spark.createDataFrame(list(enumerate(odd)), "doc_id long, text string"))
    assert q.digest(nothing, nothing.select("doc_id", F.col("rank").alias("quality"))).count() == 0


def covering(rows, cuts):
    """Plain sequential covering over rows of bins."""
    names, rules, left = list(cuts), [], rows
    ok = lambda r, rule: all((r[f"_qr_{n}"] > b) == above for n, above, b in rule)
    while len(rules) < q.RULES:
        rule = []
        while len(rule) < q.CONDITIONS:
            mine = [r for r in left if r["grow"] and ok(r, rule)]
            bad = sum(r["bad"] for r in mine)
            if not bad or bad == len(mine):
                break
            best, most = None, 1e-9
            for n in names:
                for b in range(len(cuts[n])):
                    for above in (True, False):
                        part = [r["bad"] for r in mine if (r[f"_qr_{n}"] > b) == above]
                        p = sum(part)
                        if p and (gain := p * (math.log2(p / len(part)) - math.log2(bad / len(mine)))) > most:
                            best, most = (n, above, b), gain
            if best is None:
                break
            rule.append(best)
        worth = []
        for k in range(1, len(rule) + 1):
            part = [r["bad"] for r in left if not r["grow"] and ok(r, rule[:k])]
            if len(part) >= q.LEAST and sum(part) >= q.PRECISE * len(part):
                worth.append(((2 * sum(part) - len(part)) / len(part), -k, rule[:k]))
        if not worth:
            break
        rules.append(max(worth)[2])
        left = [r for r in left if not ok(r, rules[-1])]
    return rules


def mixed(spark, n=900):
    """Documents of which two kinds are bad: many symbols, or long words in capitals; a tenth of the labels is wrong."""
    rows, labels = [], []
    for i in range(n):
        words = [f"word{(i * 31 + k * k) % 9973}" for k in range(60 + i % 40)]
        kind = i % 5
        if kind == 3:
            words = [w + "#" * (1 + i % 3) for w in words]
        if kind == 4:
            words = [w.upper() * 2 for w in words]
        rows.append((i, " ".join(words) + "."))
        labels.append((i, int(kind < 3) ^ (i % 41 == 0)))
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int")


def test_learner_is_sequential_covering(spark):
    docs, labels = mixed(spark)
    rows, cuts = q.binned(docs, labels, q.TRAIN_ROWS)
    want = covering([r.asDict() for r in rows.collect()], cuts)
    got = q.learned(docs, labels)
    assert len(want) >= 2 and [[(c.name, c.above, c.bin) for c in r] for r in got.rules] == want
    assert str(got).startswith("1. reject if ")
    # thresholds moved midway part the learning rows as the bins do
    flagged = q.judged(docs, got)
    wrong = flagged.join(labels, "doc_id").filter((F.col("quality") == 0) == F.col("kept")).count()
    assert wrong <= 900 / 41 + 2
    assert {r["rule"] for r in flagged.collect()} >= {None, 1, 2}


def test_held_out(spark, sf_dir):
    """Labelled documents outside the learning fold: what is good stays, but for the base rules; most of the bad goes."""
    big = sf_dir.replace("sf0.001", "sf0.01")
    docs, labels = spark.read.parquet(f"{big}/documents.parquet"), spark.read.parquet(f"{big}/labels.parquet")
    out = q.digest(docs, labels).join(labels, "doc_id").filter(q.held_out(F.col("doc_id"))).collect()
    good, bad = [r for r in out if r["quality"] == 1], [r for r in out if r["quality"] == 0]
    assert all(r["kept"] or r["base_failed"] for r in good) and sum(r["kept"] for r in bad) <= 0.1 * len(bad)


@pytest.mark.parametrize("labels", [[], [(1, 1)], [(1, None), (None, 0)], [(i, 1) for i in range(200)]])
def test_without_both_labels(spark, edge, labels):
    rules = q.learned(edge, spark.createDataFrame(labels, "doc_id long, quality int"))
    assert rules.rules == () and str(rules) == ""
    out = q.judged(edge, rules)
    assert set(edge.columns) <= set(out.columns) and out.count() == edge.count()


def test_native(spark, sf_dir):
    plan = q.digest(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan) and "Exchange" not in plan
