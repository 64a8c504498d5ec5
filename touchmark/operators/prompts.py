"""Texts sent to a model or an embedder; a NULL part makes the whole text NULL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from touchmark.functions.scalars import rounded_text


def campaign_summary(campaigns: DataFrame, status: str = "completed") -> DataFrame:
    prompt = F.concat(
        F.lit("Summarise this campaign performance data in 3 bullet points: "),
        F.lit("Campaign: "), F.col("campaign_name"),
        F.lit(", Brand: "), F.col("brand"),
        F.lit(", Market: "), F.col("country_code"),
        F.lit(", Objective: "), F.col("objective"),
        F.lit(", Budget: $"), rounded_text(F.col("budget_usd")),
        F.lit(", Spend: $"), rounded_text(F.col("actual_spend_usd")),
        F.lit(", Status: "), F.col("status"),
    )
    chosen = campaigns.filter(F.col("status") == status)
    return chosen.select("campaign_id", prompt.alias("prompt"))


def classify_creative(creatives: DataFrame) -> DataFrame:
    prompt = F.concat(
        F.lit("Classify this creative asset into one of: Premium, Standard, Budget. "),
        F.lit("Return just the classification. "),
        F.lit("Creative: "), F.col("creative_name"),
        F.lit(", Format: "), F.col("format"),
        F.lit(", Channel: "), F.col("channel"),
        F.lit(", Brand: "), F.col("brand"),
    )
    return creatives.select("creative_id", prompt.alias("prompt"))


def recommend_theme(audience: DataFrame) -> DataFrame:
    prompt = F.concat(
        F.lit("Based on the following audience segment, recommend 3 ad creative themes "),
        F.lit("and explain why. Segment: "), F.col("segment_name"),
        F.lit(", Demographics: "), F.col("age_band"), F.lit(" "), F.col("gender"),
        F.lit(", Income: "), F.col("income_band"),
        F.lit(", Country: "), F.col("country_code"),
    )
    return audience.select("audience_id", prompt.alias("prompt"))


def segment_content() -> Column:
    return F.concat(
        F.lit("Segment: "), F.col("segment_name"),
        F.lit(". Age: "), F.col("age_band"),
        F.lit(". Gender: "), F.col("gender"),
        F.lit(". Income: "), F.col("income_band"),
        F.lit(". Country: "), F.col("country_code"),
    )


def ok_rows(df: DataFrame, status: str = "status") -> DataFrame:
    """Rows whose remote call left no error text."""
    return df.filter(F.length(status) == 0)
