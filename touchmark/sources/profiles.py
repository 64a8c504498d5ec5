"""Stored column profiles with distinct-count sketches: one row per run and column, merged without the data."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from touchmark.operators.profile import value_key
from touchmark.sources.sinks import append_scan_results

#: Registers of a sketch, as a power of two; its standard error is about 1.04 over their root.
REGISTERS = 12
ERROR = 1.04 / (1 << REGISTERS) ** 0.5


def column_sketches(df: DataFrame) -> DataFrame:
    """(column_name, row_count, null_count, sketch) of every column, from one scan; sketches fold in each task."""
    aggregates, rows = [F.count("*").alias("row_count")], []
    for i, column in enumerate(df.columns):
        aggregates += [
            F.count_if(F.col(column).isNull()).alias(f"n{i}"),
            F.hll_sketch_agg(value_key(df, column).cast("string"), REGISTERS).alias(f"s{i}"),
        ]
        rows.append(
            F.struct(
                F.lit(column).alias("column_name"), F.col("row_count"), F.col(f"n{i}").alias("null_count"),
                F.col(f"s{i}").alias("sketch"),
            )
        )
    return df.agg(*aggregates).select(F.inline(F.array(*rows)))


def append_profile(df: DataFrame, path: str, table: str, run_id: str, scanned_at: dt.datetime) -> None:
    """Adds the profile of a run's rows to ``{table}_profile``; the same run again replaces itself."""
    append_scan_results(column_sketches(df), f"{path}/{table}_profile", run_id, scanned_at)


def merged_profile(spark: SparkSession, path: str, table: str, runs: list[str] | None = None) -> DataFrame:
    """Rows, nulls and estimated distinct values of every column over all runs, or these, from their sketches alone."""
    stored = spark.read.parquet(f"{path}/{table}_profile")
    stored = stored if runs is None else stored.filter(F.col("run_id").isin(runs))
    return stored.groupBy("column_name").agg(
        F.sum("row_count").alias("row_count"),
        F.sum("null_count").alias("null_count"),
        F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("distinct_estimate"),
    )
