import os
import subprocess
import sys

from engram.plans.lineage import Scratch, shared_folder


def test_written_tables_stay_until_they_are_dropped(spark):
    scratch = Scratch(spark)
    assert scratch.folder.startswith(shared_folder(spark))
    one, two = scratch.write(spark.range(3)), scratch.write(spark.range(5))
    folder = scratch.folder.removeprefix("file:")
    scratch.keep(two)
    assert two.count() == 5 and len(os.listdir(folder)) == 1 and not os.path.exists(one._engram_path.removeprefix("file:"))
    scratch.drop()
    assert not os.path.exists(folder)
    scratch.drop()  # what is gone is no error


def test_the_folder_of_the_session_is_used():
    """The setting is read from the session that a cluster makes; here a session of its own, as it is fixed at the start."""
    code = (
        "from pyspark.sql import SparkSession; from engram.plans.lineage import shared_folder\n"
        "s = SparkSession.builder.master('local[1]').config('spark.ui.enabled', 'false').config('spark.checkpoint.dir', '/tmp/engram-named').getOrCreate()\n"
        "print('FOLDER', shared_folder(s))"
    )
    said = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=120, env=os.environ).stdout
    assert "FOLDER /tmp/engram-named" in said


def test_publishing(spark, tmp_path):
    from engram.sources import store

    path = str(tmp_path / "t")
    for n in (3, 5):
        store.publish(spark.range(n), path)
        assert spark.read.parquet(path).count() == n
    assert sorted(p.name for p in tmp_path.iterdir()) == ["t"]
    kept, gone = store.delete(spark.createDataFrame([("a:1",), ("b:1",), (None,)], "k string"), "k", "a:*")
    assert {r.k for r in kept.collect()} == {"b:1", None} and [r.k for r in gone.collect()] == ["a:1"]


def test_scopes_end_tables(spark, monkeypatch):
    from pathlib import Path

    from engram.plans import lineage

    with lineage.scope():
        scratch = lineage.Scratch(spark)
        written, seen = scratch.counted(spark.range(7))
        assert seen["n"] == 7 == written.count() and Path(scratch.folder.removeprefix("file:")).exists()
    assert not Path(scratch.folder.removeprefix("file:")).exists()


def test_a_cluster_needs_a_shared_folder(monkeypatch):
    import pytest

    from engram.plans import lineage

    class Context:
        master = "spark://host:7077"

        def getConf(self):
            return {}

        def getCheckpointDir(self):
            return None

    class Session:
        conf, sparkContext = {}, Context()

    with pytest.raises(ValueError):
        lineage.shared_folder(Session())
