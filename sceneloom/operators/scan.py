"""Folds over long sequences as a parallel prefix scan: a sequence is cut into blocks of frames, each block is summed up as the
function from the state before it to the state after it, the functions are composed in order, and the blocks are gone
through again from their own start states, at once.

Blocks are ranges of the order column, so that a key's rows spread over tasks and none holds a sequence; the composition
reads one small row a block. The order column is an integer and unique within a key.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

WIDTH = 4096


def block_of(order: str, width: int = WIDTH) -> Column:
    return F.floor(F.col(order) / F.lit(width)).cast("long")


def blocks(df: DataFrame, by: list[str], order: str, values: list[str], width: int = WIDTH) -> DataFrame:
    """by, block, ``steps``: the values of each key's blocks in order."""
    return df.groupBy(*by, block_of(order, width).alias("block")).agg(F.array_sort(F.collect_list(F.struct(order, *values))).alias("steps"))


def carried(summaries: DataFrame, by: list[str], advance: Callable[[object, object], object], state: Callable[[object], tuple], schema: str) -> DataFrame:
    """by, block and the state before each block (columns of ``schema``): ``advance`` takes a state (None before the first)
    and a block's summary; ``state`` gives a state's columns."""
    names = [c.split()[0] for c in schema.split(", ")]
    kinds = dict(summaries.dtypes)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, now = None, None
        for batch in batches:
            rows = []
            for r in batch.itertuples(index=False):
                own = tuple(getattr(r, c) for c in by)
                if own != key:
                    key, now = own, None
                rows.append((*own, r.block, *(state(now))))
                now = advance(now, r)
            yield pd.DataFrame(rows, columns=[*by, "block", *names])

    keys = ", ".join(f"{c} {kinds[c]}" for c in by)
    return summaries.repartition(*by).sortWithinPartitions(*by, "block").mapInPandas(run, f"{keys}, block long, {schema}")


def averages(df: DataFrame, by: list[str], order: str, value: str, alpha: float, width: int = WIDTH) -> DataFrame:
    """by, n, ema: the moving average after each key's last row, from its first value on. A block is the affine map
    ``scale * state + shift``."""
    v = lambda s: s[value].cast("double")
    fold = lambda steps, start: F.aggregate(steps, start, lambda a, s: (1 - alpha) * a + alpha * v(s))
    rest = F.slice("steps", 2, F.greatest(F.size("steps"), F.lit(1)))
    sums = blocks(df, by, order, [value], width).select(
        *by, "block", F.size("steps").cast("long").alias("n"), F.pow(F.lit(1 - alpha), F.size("steps")).alias("scale"), fold(F.col("steps"), F.lit(0.0)).alias("shift"), fold(rest, v(F.get("steps", F.lit(0)))).alias("begun")
    )

    def step(now, r):
        return (r.n, r.begun) if now is None else (now[0] + r.n, r.scale * now[1] + r.shift)

    # one more block after the last, so that its start state is the key's end
    last = sums.groupBy(*by).agg((F.max("block") + 1).alias("block")).select(*by, "block", F.lit(0).cast("long").alias("n"), F.lit(1.0).alias("scale"), F.lit(0.0).alias("shift"), F.lit(0.0).alias("begun"), F.lit(True).alias("end"))
    ends = carried(sums.withColumn("end", F.lit(False)).unionByName(last), by, step, lambda now: now or (0, None), "n long, ema double")
    return ends.join(last.select(*by, "block"), [*by, "block"], "left_semi").select(*by, "n", "ema")


def streaks(votes: DataFrame, by: list[str], order: str, value: str, ok: Column, width: int = WIDTH) -> DataFrame:
    """Length so far of the run of equal good votes; a bad vote breaks it and has 0. A block of one run lengthens what comes
    in if that has its value; any other gives its last run, whatever comes in."""
    w = Window.partitionBy(*by, "_block").orderBy(order)
    v = votes.withColumns({"_ok": F.coalesce(ok, F.lit(False)), "_block": block_of(order, width)})
    breaks = F.when(~F.col("_ok") | ~F.coalesce(F.lag("_ok").over(w), F.lit(False)) | (F.col(value) != F.coalesce(F.lag(value).over(w), F.lit(""))), 1).otherwise(0)
    v = v.withColumn("_b", breaks).withColumn("_run", F.sum("_b").over(w))
    v = v.withColumn("_n", F.sum(F.col("_ok").cast("int")).over(Window.partitionBy(*by, "_block", "_run").orderBy(order)))
    end = F.max_by(F.struct("_ok", F.col(value).alias("v"), "_n"), order)
    sums = v.groupBy(*by, F.col("_block").alias("block")).agg(end.alias("e"), (F.max("_run") == 1).alias("one")).select(*by, "block", "one", F.col("e._ok").alias("ok"), F.col("e.v").alias("v"), F.col("e._n").alias("n"))

    def step(now, r):
        if not r.ok:
            return None
        return (r.v, now[1] + r.n) if r.one and now is not None and now[0] == r.v else (r.v, r.n)

    starts = carried(sums, by, step, lambda now: now or (None, 0), "_before string, _length long").withColumnRenamed("block", "_block")
    goes_on = F.col("_ok") & (F.col("_run") == 1) & F.coalesce(F.col(value) == F.col("_before"), F.lit(False))
    out = v.join(starts, [*by, "_block"]).withColumn("streak", F.col("_n") + F.when(goes_on, F.col("_length")).otherwise(0))
    return out.drop("_ok", "_block", "_b", "_run", "_n", "_before", "_length")


# scene switches

NONE, SAME, OTHER = -1, -2, -3  # no scene; the scene or frame that came in; a scene that the block's votes do not name


def vote(locked, other, run, last, frame, scene, good, times, cooldown):
    """One vote's change of many states."""
    first = (locked == NONE) & good
    differs = (locked != NONE) & good & (locked != scene)
    run = np.where(differs, np.where(other == scene, np.minimum(run + 1, times), 1), 0)
    go = differs & (run >= times) & (frame - last >= cooldown)
    return np.where(first | go, scene, locked), np.where(differs & ~go, scene, NONE), np.where(go, 0, run), np.where(go, frame, last)


def table(frames: np.ndarray, scenes: np.ndarray, good: np.ndarray, count: int, times: int, cooldown: int) -> np.ndarray:
    """For every state before a block, in the order of ``place``, the state after it: locked, other, run, last frame. States
    that have become one are carried on as one."""
    known = np.array([NONE, OTHER, *range(count)])
    pending = np.array([(NONE, 0), *((s, r) for s in range(count) for r in range(1, times + 1))])
    ages = np.arange(cooldown)  # frames since the last switch, 0 for long enough
    i, j, k = (x.ravel() for x in np.meshgrid(np.arange(len(known)), np.arange(len(pending)), ages, indexing="ij"))
    locked, other, run = known[i], pending[j, 0], pending[j, 1]
    rested = frames[0] - 10 * cooldown
    last = np.where(ages[k] > 0, frames[0] - ages[k], rested)
    states = np.stack([locked, other, run, last], axis=1)
    at = np.arange(len(states))
    for n, (f, s, g) in enumerate(zip(frames, scenes, good)):
        states = np.stack(vote(*states.T, f, s, g, times, cooldown), axis=1)
        if n < 4 or n % 32 == 0:
            states[:, 3] = np.where(f + 1 - states[:, 3] >= cooldown, np.where(states[:, 3] < frames[0], rested, states[:, 3]), states[:, 3])
            states, to = np.unique(states, axis=0, return_inverse=True)
            at = to.ravel()[at]
    out = states[at]
    out[:, 3] = np.where(out[:, 3] < frames[0], SAME, out[:, 3])
    return out


def place(state: tuple, names: list[str], first: int, times: int, cooldown: int) -> int:
    """Where a state (locked, other, run, last) stands in a block's table."""
    locked, other, run, last = state
    i = 0 if locked is None else 2 + names.index(locked) if locked in names else 1
    j = 1 + names.index(other) * times + run - 1 if other in names and run else 0
    age = 0 if last is None or first - last >= cooldown else first - last
    return (i * (1 + len(names) * times) + j) * cooldown + age


def scene_switches(votes: DataFrame, times: int = 2, confidence: float = 0.9, cooldown: int = 20, width: int = WIDTH) -> DataFrame:
    """sequence, frame_idx, scene: switches of a scene that is locked at the first good vote and switched by ``times`` good
    votes in a row for another one, not within ``cooldown`` frames of the last switch.

    votes: sequence, frame_idx, scene, confidence. A block's function is the table of an automaton: its states are the locked
    scene, the scene that would follow and its votes so far, and the frames since the last switch."""
    cut = votes.select("sequence", "frame_idx", "scene", F.coalesce((F.col("scene") != "unknown") & (F.col("confidence") >= confidence), F.lit(False)).alias("good"), block_of("frame_idx", width).alias("block"))
    kind = dict(votes.dtypes)["sequence"]

    def coded(g: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[str]]:
        g = g.sort_values("frame_idx")
        good = g["good"].to_numpy(bool)
        names = sorted(set(g["scene"][good]))
        scenes = np.array([names.index(s) if ok else NONE for s, ok in zip(g["scene"], good)])
        return g["frame_idx"].to_numpy(np.int64), scenes, good, names

    def summed(g: pd.DataFrame) -> pd.DataFrame:
        frames, scenes, good, names = coded(g)
        t = table(frames, scenes, good, len(names), times, cooldown)
        return pd.DataFrame([(g["sequence"].iloc[0], g["block"].iloc[0], int(frames[0]), names, t.ravel().tolist())], columns=["sequence", "block", "first", "names", "cells"])

    sums = cut.groupBy("sequence", "block").applyInPandas(summed, f"sequence {kind}, block long, first long, names array<string>, cells array<long>")

    def step(now, r):
        locked, other, run, last = now or (None, None, 0, None)
        names = list(r.names)
        a, b, c, d = (int(x) for x in np.asarray(r.cells).reshape(-1, 4)[place((locked, other, run, last), names, r.first, times, cooldown)])
        name = lambda x: None if x == NONE else locked if x == OTHER else names[x]
        return name(a), name(b), c, last if d == SAME else d

    starts = carried(sums, ["sequence"], step, lambda now: now or (None, None, 0, None), "locked string, other string, run long, last long")

    after = F.struct(F.col("locked"), F.col("other"), F.col("run").cast("int").alias("run"), F.col("last"), F.array().cast("array<struct<frame_idx:bigint,scene:string>>").alias("rows"))

    def again(s: Column, v: Column) -> Column:
        differs = s["locked"].isNotNull() & v["good"] & (v["scene"] != s["locked"])
        run = F.when(differs, F.when(s["other"] == v["scene"], F.least(s["run"] + 1, F.lit(times))).otherwise(1)).otherwise(0)
        go = differs & (run >= times) & (s["last"].isNull() | (v["frame_idx"] - s["last"] >= cooldown))
        return F.struct(
            F.when((s["locked"].isNull() & v["good"]) | go, v["scene"]).otherwise(s["locked"]).alias("locked"),
            F.when(differs & ~go, v["scene"]).alias("other"),
            F.when(go, 0).otherwise(run).alias("run"),
            F.when(go, v["frame_idx"]).otherwise(s["last"]).alias("last"),
            F.when(go, F.concat(s["rows"], F.array(F.struct(v["frame_idx"].alias("frame_idx"), v["scene"].alias("scene"))))).otherwise(s["rows"]).alias("rows"),
        )

    steps = blocks(cut.drop("block"), ["sequence"], "frame_idx", ["scene", "good"], width)
    return steps.join(starts, ["sequence", "block"]).select("sequence", F.inline(F.aggregate("steps", after, again)["rows"]))
