"""Readers of the memory store's tables: one Parquet file or folder per table."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def micros(df: DataFrame, name: str) -> Column:
    """Microseconds since 1970-01-01 UTC of a timestamp column, whatever the session's zone.

    Columns without a zone mark hold UTC.
    """
    kind = dict(df.dtypes)[name]
    if kind == "timestamp_ntz":
        return F.expr(f"timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', `{name}`)")
    return F.unix_micros(F.col(name))
