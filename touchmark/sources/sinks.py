"""Writing results."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PROPOSAL_SCHEMA = (
    "glossary_term string, category string, description string, `table` string, `column` string,"
    " match_type string, via_synonym string, match_score int, match_rationale string"
)


def save_model(
    df: DataFrame, table: str, path: str | None = None, partition_by: tuple[str, ...] = ()
) -> None:
    """Materialise a model as a table, replacing an earlier run."""
    writer = df.write.mode("overwrite").format("parquet")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if path:
        writer = writer.option("path", path)
    writer.saveAsTable(table)


def append_scan_results(df: DataFrame, path: str, run_id: str, scanned_at: dt.datetime) -> None:
    """Append one run of a scan; a repeat of the same run replaces its own rows only."""
    stamped = df.withColumn("scanned_at", F.lit(scanned_at)).withColumn("run_id", F.lit(run_id))
    (
        stamped.write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("run_id")
        .parquet(path)
    )


def write_proposals(df: DataFrame, path: str) -> None:
    """Proposals as JSON lines, to be curated by hand; compressed, for their texts repeat from line to line."""
    df.write.mode("overwrite").json(path, compression="gzip")


def read_proposals(spark: SparkSession, path: str) -> DataFrame:
    """Curated proposals with ``is_valid`` and the name of the first missing field.

    A required field that is absent, NULL or empty makes the row invalid.
    """
    rows = spark.read.schema(PROPOSAL_SCHEMA).json(path)
    missing = F.coalesce(
        *[
            F.when(F.coalesce(F.col(name), F.lit("")) == "", F.lit(name))
            for name in ("glossary_term", "table", "column")
        ]
    )
    return rows.withColumn("missing_field", missing).withColumn(
        "is_valid", F.col("missing_field").isNull()
    )
