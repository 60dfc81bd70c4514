"""Session helpers."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import SparkSession


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers, once per Spark context."""
    sc = spark.sparkContext
    if getattr(sc, "_weftwork_shipped", False):
        return
    root = os.path.dirname(os.path.abspath(__file__))
    target = os.path.join(tempfile.mkdtemp(prefix="weftwork-ship-"), "weftwork_ship.zip")
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as archive:
        for folder, _, names in os.walk(root):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    archive.write(full, os.path.relpath(full, os.path.dirname(root)))
    sc.addPyFile(target)
    sc._weftwork_shipped = True


def shared_folder(spark: SparkSession, label: str) -> str:
    """A new path in the folder that ``spark.checkpoint.dir`` names; without one only a local session gets a local folder."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        if not spark.sparkContext.master.startswith("local") or "cluster" in spark.sparkContext.master:
            raise ValueError("spark.checkpoint.dir names no folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="weftwork-")
    return f"{base.rstrip('/')}/weftwork-{label}-{uuid.uuid4().hex}"
