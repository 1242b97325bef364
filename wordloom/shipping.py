"""Sends this package to executors, which need not have it on their path to run Python functions."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def ship(spark: SparkSession | None = None) -> None:
    """Once a session, unless the Python path or the working folder has the package already.

    The zip stays in a folder of the driver's; Spark itself copies it to the executors.
    """
    spark = spark or SparkSession.active()
    root, sc = Path(__file__).resolve().parents[1], spark.sparkContext
    path = [os.getcwd(), *os.environ.get("PYTHONPATH", "").split(os.pathsep)]
    if getattr(sc, "_wordloom_shipped", False) or str(root) in map(os.path.abspath, filter(None, path)):
        return
    out = Path(tempfile.mkdtemp(prefix="wordloom-zip-")) / "wordloom.zip"
    with zipfile.ZipFile(out, "w") as z:
        for p in (root / "wordloom").rglob("*.py"):
            z.write(p, p.relative_to(root))
    sc.addPyFile(str(out))
    sc._wordloom_shipped = True
