"""Event streams: the same counts and sessions as in batch, from files that arrive."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from engram.plans.lineage import Scratch


def source(spark: SparkSession, path: str, files_per_batch: int = 8) -> DataFrame:
    """Parquet files under a path, or the one file that it is, as a stream; the schema is that of the files."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    one = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(at).isFile()
    reader = spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", files_per_batch)
    # a stream reads folders: a single file is its folder seen through a filter
    return reader.option("pathGlobFilter", at.getName()).parquet(at.getParent().toString()) if one else reader.parquet(path)


def finished(stream: DataFrame, keys: list[str]) -> DataFrame:
    """Run an aggregated stream over all that is there, in update mode, and give its last state, one row per `keys`.

    Each batch appends the rows that it changed, numbered by the batch, so a batch that is run again writes the same folder
    again; the newest row of each key counts. State older than the watermark is dropped by Spark.
    """
    spark = stream.sparkSession
    scratch = Scratch(spark)

    def keep(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite").parquet(f"{scratch.folder}/changed/batch={n}")

    query = stream.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{scratch.folder}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    if not _there(spark, f"{scratch.folder}/changed"):
        return spark.createDataFrame([], stream.schema)
    changed = spark.read.parquet(f"{scratch.folder}/changed")
    rest = [c for c in stream.columns if c not in keys]
    return changed.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("_last")).select(*keys, "_last.*").select(stream.columns)


def closed(events: DataFrame, windowed: Callable[[DataFrame], DataFrame], at: str, flush: bool = True) -> DataFrame:
    """Run a windowed stream over all events that are there, in append mode: the windows that the watermark has closed, each once.

    flush: when the events are used up, one row of the far future, null but for its time, moves the watermark past all of
    them, so that the open windows close too.
    """
    spark = events.sparkSession
    scratch = Scratch(spark)
    out, ending = f"{scratch.folder}/closed", f"{scratch.folder}/ending"
    blank = [F.lit(None).cast(f.dataType).alias(f.name) for f in events.schema.fields if f.name != at]
    row = spark.range(1).select(*blank, F.expr("timestamp'9000-01-01 00:00:00'").cast(events.schema[at].dataType).alias(at)).select(events.columns)
    row.limit(0).write.parquet(ending)
    stream = windowed(events.unionByName(spark.readStream.schema(events.schema).parquet(ending)))

    def run() -> None:
        stream.writeStream.outputMode("append").format("parquet").option("path", out).option("checkpointLocation", f"{scratch.folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()

    run()
    if flush:
        row.write.mode("append").parquet(ending)
        run()
    return spark.read.schema(stream.schema).parquet(out) if _there(spark, out) else spark.createDataFrame([], stream.schema)


def _there(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def hourly(events: DataFrame, at: str, kind: str, late: str = "2 days") -> DataFrame:
    """Events per hour and kind, with a watermark."""
    timed = events.withColumn("_at", F.col(at).cast("timestamp")).withWatermark("_at", late)
    return timed.groupBy(F.window("_at", "1 hour").alias("w"), F.lower(kind).alias("kind")).agg(F.count("*").alias("events"))


def user_sessions(events: DataFrame, user: str, at: str, gap: str = "30 minutes", late: str = "2 days") -> DataFrame:
    """Sessions of a user's events; a gap of the whole length ends one."""
    timed = events.withColumn("_at", F.col(at).cast("timestamp")).withWatermark("_at", late)
    return timed.groupBy(F.session_window("_at", gap).alias("w"), F.col(user)).agg(F.count("*").alias("events"), F.min("_at").alias("first_at"), F.max("_at").alias("last_at"))


def each_batch(events: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str):
    """Call `handle` with every batch of events: alerts, further tables and the like."""
    return events.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
