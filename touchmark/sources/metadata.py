"""Table metadata documents: one JSON document per table, read as three plain tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from touchmark.operators.quality import Rule

SCHEMA = (
    "table_id string, display_name string, description string, tags map<string, string>,"
    " columns array<struct<name: string, description: string, synonym_of: string>>,"
    " data_quality_rules array<struct<`column`: string, rule_type: string, threshold: double,"
    " dimension: string, `values`: array<string>, pattern: string, min: string, max: string,"
    " strict_min: boolean, strict_max: boolean>>"
)


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    """Documents that describe a table; others in the folder, such as a glossary, are passed over."""
    documents = spark.read.schema(SCHEMA).option("multiLine", True).json(path)
    return documents.filter(F.col("table_id").isNotNull())


def tables(metadata: DataFrame) -> DataFrame:
    return metadata.select(
        "table_id",
        F.coalesce("display_name", "table_id").alias("display_name"),
        F.trim(F.coalesce("description", F.lit(""))).alias("description"),
        "tags",
        F.coalesce(
            F.expr("try_cast(try_element_at(tags, 'row_count_approx') AS double)"), F.lit(0.0)
        ).alias("row_count_approx"),
    )


def columns(metadata: DataFrame) -> DataFrame:
    """Described columns in order; unnamed ones are dropped."""
    rows = metadata.select("table_id", F.posexplode("columns").alias("position", "c"))
    return rows.select(
        "table_id", "position", F.col("c.name").alias("column_name"),
        F.coalesce("c.description", F.lit("")).alias("description"), "c.synonym_of",
    ).filter(F.coalesce("column_name", F.lit("")) != "")


def synonyms(metadata: DataFrame) -> DataFrame:
    declared = columns(metadata).filter(F.coalesce("synonym_of", F.lit("")) != "")
    return declared.select("table_id", "column_name", "synonym_of")


def rules(metadata: DataFrame) -> DataFrame:
    """Quality rules with their defaults filled in; incomplete ones are dropped."""
    rows = metadata.select(
        F.col("table_id").alias("table"), F.posexplode("data_quality_rules").alias("position", "r")
    )

    def given(name: str, default):
        return F.coalesce(F.col(f"r.{name}"), F.lit(default))

    return rows.select(
        "table", "position", given("column", "").alias("column"),
        given("rule_type", "").alias("rule_type"),
        given("threshold", 1.0).alias("threshold"),
        given("dimension", "COMPLETENESS").alias("dimension"),
        F.transform(
            F.coalesce("r.values", F.array().cast("array<string>")), lambda v: F.trim(v)
        ).alias("values"),
        given("pattern", "").alias("pattern"),
        given("min", "").alias("min_value"), given("max", "").alias("max_value"),
        given("strict_min", False).alias("strict_min_enabled"),
        given("strict_max", False).alias("strict_max_enabled"),
    ).filter((F.col("column") != "") & (F.col("rule_type") != ""))


def rule_list(rules_of_all: DataFrame, table: str) -> list[Rule]:
    """One table's rules as the parameters of a scan."""
    rows = rules_of_all.filter(F.col("table") == table).orderBy("position").drop("table", "position")
    return [
        Rule(**{k: tuple(v) if k == "values" else v for k, v in row.asDict().items()})
        for row in rows.collect()
    ]
