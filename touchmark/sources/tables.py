"""Reading tables."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def load(spark: SparkSession, directory: str, name: str, fmt: str = "parquet") -> DataFrame:
    """One table of a directory; another columnar format is a change of ``fmt``."""
    path = f"{directory.rstrip('/')}/{name}{'.parquet' if fmt == 'parquet' else ''}"
    return spark.read.format(fmt).load(path)


def load_stream(spark: SparkSession, directory: str, name: str) -> DataFrame:
    """A table of the directory as a stream; where the table is a folder, new files in it are its appends."""
    schema = load(spark, directory, name).schema
    # Written as a pattern that only this name fits: a stream takes a single file only by a pattern.
    return spark.readStream.schema(schema).parquet(f"{directory.rstrip('/')}/{{{name}.parquet}}")


def load_range(df: DataFrame, column: str, low: dt.date, high: dt.date) -> DataFrame:
    """Rows with ``low <= column < high``: a partition column is pruned, any other pushed down."""
    return df.filter((F.col(column) >= F.lit(low)) & (F.col(column) < F.lit(high)))


def with_file(df: DataFrame, name: str = "source_file") -> DataFrame:
    return df.withColumn(name, F.col("_metadata.file_path"))


def appends(
    df: DataFrame, as_of: Column | dt.datetime, lookback_minutes: int = 10, ts: str = "event_ts"
) -> DataFrame:
    """Rows newer than ``as_of`` minus the lookback, up to ``as_of``."""
    end = F.lit(as_of) if isinstance(as_of, dt.datetime) else as_of
    start = end - F.make_dt_interval(mins=F.lit(lookback_minutes))
    return df.filter((F.col(ts) > start) & (F.col(ts) <= end))


# --- appends by the time they arrived ------------------------------------------------------

#: Folder names of arrivals: UTC, in the order of time.
_STAMP = "%Y%m%dT%H%M%S"


def append_batch(df: DataFrame, path: str, arrived_at: dt.datetime) -> None:
    """Appends a batch under the time it arrived; the same batch again replaces itself."""
    stamped = df.withColumn("arrived", F.lit(arrived_at.strftime(_STAMP)))
    append_stamped(stamped, path)


def append_stamped(df: DataFrame, path: str) -> None:
    """Appends rows that carry ``arrived``, as ``append_batch`` stamps them."""
    writer = df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.partitionBy("arrived").parquet(path)


def stamp(ts: Column) -> Column:
    return F.date_format(ts, "yyyyMMdd'T'HHmmss")


def arrivals(df: DataFrame, as_of: dt.datetime, lookback_minutes: int = 10) -> DataFrame:
    """Rows that arrived after ``as_of`` minus the lookback, up to ``as_of``, however old their events are.

    ``arrived`` is a partition, so only the folders of those batches are opened. A table without
    stamps can be read by ``recent_files``.
    """
    start = as_of - dt.timedelta(minutes=lookback_minutes)
    low, high = (t.astimezone(dt.timezone.utc).strftime(_STAMP) for t in (start, as_of))
    return df.filter((F.col("arrived") > low) & (F.col("arrived") <= high))


def recent_files(df: DataFrame, as_of: dt.datetime, lookback_minutes: int = 10) -> DataFrame:
    """Rows of the files that were written after ``as_of`` minus the lookback, up to ``as_of``."""
    written = F.col("_metadata.file_modification_time")
    start = as_of - dt.timedelta(minutes=lookback_minutes)
    return df.filter((written > F.lit(start)) & (written <= F.lit(as_of)))
