"""Scene-graph analytics on Spark."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import zipfile
from pathlib import Path


def ship(spark) -> None:
    """Makes this package importable in the session's Python workers: once a context, as a zip that Spark hands out."""
    context = spark.sparkContext
    if getattr(context, "_sceneloom_shipped", False):
        return
    root = Path(__file__).resolve().parent
    folder = tempfile.mkdtemp(prefix="sceneloom-")  # of the driver, which hands the file out
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    at = Path(folder) / "sceneloom_package.zip"
    with zipfile.ZipFile(at, "w", zipfile.ZIP_DEFLATED) as out:
        for file in sorted(root.rglob("*.py")):
            out.write(file, f"{root.name}/{file.relative_to(root)}")
    context.addPyFile(str(at))
    context._sceneloom_shipped = True
