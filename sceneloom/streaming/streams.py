"""Structured Streaming twins: windowed counts with a watermark, and state a key over micro-batches."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def events(spark: SparkSession, path: str, schema, files: int | None = None) -> DataFrame:
    """The files of a table as a stream, ``files`` of them a trigger."""
    r = spark.readStream.schema(schema)
    return (r.option("maxFilesPerTrigger", files) if files else r).parquet(path)


def window_counts(stream: DataFrame, time: str, by: list[str], length: str, late: str) -> DataFrame:
    """Rows a window and key; a row later than ``late`` behind the latest time is dropped."""
    w = F.window(time, length)
    return stream.withWatermark(time, late).groupBy(w, *by).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), *by, "n")


def sessions(stream: DataFrame, time: str, by: list[str], gap: str, late: str) -> DataFrame:
    return stream.withWatermark(time, late).groupBy(F.session_window(time, gap), *by).agg(F.count("*").alias("n")).select(F.col("session_window.start").alias("start"), *by, "n")


def averages(stream: DataFrame, key: str, order: str, value: str, alpha: float) -> DataFrame:
    """key, n, ema: a moving average a key, carried as state over micro-batches; inside one, rows go by ``order``."""

    def fold(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, ema = state.get if state.exists else (0, 0.0)
        for x in pd.concat(list(frames)).sort_values(order)[value]:
            ema = float(x) if not n else (1 - alpha) * ema + alpha * float(x)
            n += 1
        state.update((n, ema))
        yield pd.DataFrame({key: [k[0]], "n": [n], "ema": [ema]})

    kind = dict(stream.dtypes)[key]
    return stream.groupBy(key).applyInPandasWithState(fold, f"{key} {kind}, n long, ema double", "n long, ema double", "update", GroupStateTimeout.NoTimeout)


def drained(result: DataFrame, folder: str, mode: str, key: list[str] | None = None, newest: str | None = None) -> DataFrame:
    """Runs a stream over all there is now and gives its rows; with ``key`` the newest row of each by ``newest``.

    In complete mode the last trigger's table stands; in update and append mode triggers add to it.
    """
    spark = result.sparkSession

    def put(batch: DataFrame, i: int) -> None:
        batch.write.mode("overwrite" if mode == "complete" else "append").parquet(f"{folder}/rows")

    q = result.writeStream.outputMode(mode).foreachBatch(put).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    rows = spark.read.schema(result.schema).parquet(f"{folder}/rows")
    if not key:
        return rows
    cols = [c for c in rows.columns if c not in key]
    return rows.groupBy(*key).agg(F.max_by(F.struct(*cols), newest).alias("r")).select(*key, "r.*")
