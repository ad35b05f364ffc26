"""Cutting lineage with tables in the shared checkpoint folder.

Iterative operators write each round's result as Parquet where all executors can read it, so a lost
executor costs a re-read and never a restart, and plans stay as long as one round.
"""

import atexit
import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

_open: list["Scratch"] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where it is unset, one of this process, which only a local master can share."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        own = spark.sparkContext.getCheckpointDir()
        if own is None:
            master = spark.sparkContext.master
            if master != "local" and not master.startswith("local["):
                raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
            spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="engram-"))
            own = spark.sparkContext.getCheckpointDir()
        folder = own
    return folder.rstrip("/")


@contextlib.contextmanager
def scope() -> Iterator[None]:
    """Tables that operators write within the block go at its end: use their results before. Without a scope they stay until
    the process ends."""
    before = len(_open)
    try:
        yield
    finally:
        for scratch in _open[before:]:
            scratch.drop()


@atexit.register
def _drop_all() -> None:
    for scratch in list(_open):
        scratch.drop()


class Scratch:
    """Tables of one run of an iterative operator, in a folder of their own."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.folder = f"{shared_folder(spark)}/engram-{uuid.uuid4().hex}"
        self.n = 0
        self.paths: set[str] = set()
        _open.append(self)

    def write(self, df: DataFrame) -> DataFrame:
        """Write the rows and return a frame that reads them back."""
        self.n += 1
        path = f"{self.folder}/t{self.n}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._engram_path = path
        self.paths.add(path)
        return out

    def counted(self, df: DataFrame, **measures: Column) -> tuple[DataFrame, dict]:
        """Write the rows; also their number n, and what else is measured of them, in the same pass."""
        seen = Observation()
        given = df.observe(seen, F.count(F.lit(1)).alias("n"), *(c.alias(name) for name, c in measures.items()))
        return self.write(given), seen.get

    def keep(self, *frames: DataFrame) -> None:
        """Delete all tables but those of the given frames, as written."""
        for path in self.paths - {f._engram_path for f in frames}:
            self._delete(path)

    def drop(self, df: DataFrame | None = None) -> None:
        """Delete one written table, or the whole folder."""
        if df is None and self in _open:
            _open.remove(self)
        self._delete(self.folder if df is None else df._engram_path)

    def _delete(self, path: str) -> None:
        """A path that is gone is no error, nor is a session that has ended."""
        self.paths.discard(path)
        try:
            at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
        except Exception:
            pass
