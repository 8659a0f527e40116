"""Queries: streams, run over all that is there and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..fixtures import scene
from ..operators.fixpoint import saved
from ..registry import query
from ..streaming import streams as R


def _folder(spark) -> str:
    context = spark.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        saved(spark.range(1))
    return f"{context._jsc.sc().getCheckpointDir().get()}/stream-{uuid.uuid4().hex}"


@query("stream_window_counts", "SELECT epoch_us(time_bucket(INTERVAL 1 DAY, ts)) AS start_us, event_type, count(*) AS n FROM events GROUP BY ALL")
def stream_window_counts(spark, sf_dir):
    e = R.events(spark, f"{sf_dir}/events.parque[t]", scene(spark, sf_dir, "events").schema).withColumn("ts", F.col("ts").cast("timestamp"))
    w = R.drained(R.window_counts(e, "ts", ["event_type"], "1 day", "2 days"), _folder(spark), "complete")
    return w.select(F.unix_micros("start").alias("start_us"), "event_type", "n")


@query(
    "stream_state_fold",
    "WITH RECURSIVE o AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rn FROM events), f(user_id, rn, ema) AS (SELECT user_id, rn, value FROM o WHERE rn = 1 UNION ALL SELECT o.user_id, o.rn, 0.7::DOUBLE * f.ema + 0.3::DOUBLE * o.value FROM f JOIN o ON o.user_id = f.user_id AND o.rn = f.rn + 1) SELECT user_id, max(rn) AS n, round(arg_max(ema, rn), 6) AS ema FROM f GROUP BY user_id",
)
def stream_state_fold(spark, sf_dir):
    e = R.events(spark, f"{sf_dir}/events.parque[t]", scene(spark, sf_dir, "events").schema)
    s = R.drained(R.averages(e, "user_id", "event_id", "value", 0.3), _folder(spark), "update", ["user_id"], "n")
    return s.select("user_id", "n", F.round("ema", 6).alias("ema"))
