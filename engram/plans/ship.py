"""Getting this package to the executors' Python where it is not on their path already."""

import functools
import os
import tempfile
import zipfile
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

ROOT = Path(__file__).resolve().parents[2]


def ship(spark: SparkSession) -> None:
    """Add the package as a zip to the session, once, unless PYTHONPATH names the folder that it lies in."""
    if any(p and Path(p).resolve() == ROOT for p in os.environ.get("PYTHONPATH", "").split(os.pathsep)):
        return
    context = spark.sparkContext
    if getattr(context, "_engram_shipped", False):
        return
    target = Path(tempfile.mkdtemp(prefix="engram-")) / "engram.zip"
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted((ROOT / "engram").rglob("*")):
            if p.suffix in (".py", ".npz"):
                z.write(p, p.relative_to(ROOT))
    context.addPyFile(str(target))
    context._engram_shipped = True


def shipped(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    @functools.wraps(query)
    def run(spark: SparkSession, folder: str) -> DataFrame:
        ship(spark)
        return query(spark, folder)

    return run
