"""The folder that driver and executors share, for checkpoints and intermediate tables."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import SparkSession

from . import ship


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: spark.checkpoint.dir. Where that is unset the context's own is
    used, or in local mode a temporary one; on a cluster there is none to choose, and that is an error."""
    ship(spark)
    context = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    known = context._jsc.sc().getCheckpointDir()
    if not found and known.isDefined():
        found = known.get()
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("spark.checkpoint.dir is not set: it names the folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="sceneloom-")
    if not known.isDefined():
        context.setCheckpointDir(found)
        drop_at_exit(spark, context._jsc.sc().getCheckpointDir().get())
    return found


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; it is deleted when the driver ends."""
    path = f"{shared_dir(spark).rstrip('/')}/sceneloom-{name}-{uuid.uuid4().hex}"
    drop_at_exit(spark, path)
    return path


def drop_at_exit(spark: SparkSession, path: str) -> None:
    """Deletes a folder when the driver ends."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()

    def drop() -> None:
        try:
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(conf).delete(at, True)
        except Exception:  # noqa: BLE001  the session may have ended before
            pass

    atexit.register(drop)
