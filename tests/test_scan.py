"""The prefix scan: the same at every block width, against plain loops; no task's rows grow with a sequence."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from sceneloom.operators import scan


def votes(seed, n=400, sequences=3):
    rng, rows = random.Random(seed), []
    for s in range(sequences):
        now = "kitchen"
        for f in range(n):
            if rng.random() < 0.04:
                continue
            if rng.random() < 0.08:
                now = rng.choice(["kitchen", "office", "bath", "attic"])
            rows.append((s, f, rng.choice([now] * 6 + ["unknown", "office"]), rng.choice([0.95, 0.95, 0.95, 0.5, None])))
    return rows


def plain_switches(rows, times, cooldown):
    out, state = [], {}
    for s, f, scene, c in sorted(rows):
        locked, other, run, last = state.get(s, (None, None, 0, None))
        good = scene != "unknown" and c is not None and c >= 0.9
        if good and locked is None:
            locked, other, run = scene, None, 0
        elif good and scene != locked:
            run = run + 1 if other == scene else 1
            other = scene
            if run >= times and (last is None or f - last >= cooldown):
                locked, other, run, last = scene, None, 0, f
                out.append((s, f, scene))
        else:
            other, run = None, 0
        state[s] = (locked, other, run, last)
    return out


@pytest.mark.parametrize("width,times,cooldown", [(7, 2, 20), (64, 2, 20), (5, 3, 9), (1, 2, 4), (4096, 2, 20)])
def test_switches(spark, width, times, cooldown):
    rows = votes(width)
    df = spark.createDataFrame(rows, "sequence long, frame_idx long, scene string, confidence double").repartition(3)
    got = scan.scene_switches(df, times=times, cooldown=cooldown, width=width).collect()
    want = plain_switches(rows, times, cooldown)
    assert sorted(map(tuple, got)) == sorted(want) and len(want) > 5


@pytest.mark.parametrize("width", [1, 5, 50, 4096])
def test_streaks_and_averages(spark, width):
    rows = votes(3)
    df = spark.createDataFrame(rows, "sequence long, frame_idx long, scene string, confidence double").repartition(3)
    got = scan.streaks(df, ["sequence"], "frame_idx", "scene", (F.col("scene") != "unknown") & (F.col("confidence") >= 0.9), width)
    want, ema, run = {}, {}, {}
    for s, f, scene, c in sorted(rows):
        good = scene != "unknown" and c is not None and c >= 0.9
        before = run.get(s, (None, 0))
        run[s] = (scene, before[1] + 1 if before[0] == scene else 1) if good else (None, 0)
        want[s, f] = run[s][1]
        ema.setdefault(s, []).append(f % 17 / 3.0)
    assert {(r["sequence"], r["frame_idx"]): r["streak"] for r in got.collect()} == want
    assert got.columns == [*df.columns, "streak"]
    ends = scan.averages(df.withColumn("v", F.col("frame_idx") % 17 / 3.0), ["sequence"], "frame_idx", "v", 0.25, width).collect()
    for r in ends:
        x = None
        for v in ema[r["sequence"]]:
            x = v if x is None else 0.75 * x + 0.25 * v
        assert r["n"] == len(ema[r["sequence"]]) and r["ema"] == pytest.approx(x, abs=1e-12)


def test_nothing(spark):
    none = spark.createDataFrame([], "sequence long, frame_idx long, scene string, confidence double")
    assert scan.scene_switches(none).count() == 0 and scan.averages(none, ["sequence"], "frame_idx", "confidence", 0.5).count() == 0
    assert scan.streaks(none, ["sequence"], "frame_idx", "scene", F.lit(True)).count() == 0
