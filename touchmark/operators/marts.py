"""Campaign, customer and market measures.

Events are summed per campaign before they meet the campaign table: the join then moves one row
per campaign, and a campaign holding a third of all events is merged map-side.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from touchmark.functions.scalars import safe_divide, whole_days
from touchmark.operators.attribution import last_touch

VIDEO_STEPS = ("video_start", "video_q1", "video_q2", "video_q3", "video_complete")


def _is(event_type: str) -> Column:
    return F.col("event_type") == event_type


def _count(event_type: str) -> Column:
    return F.count_if(_is(event_type))


def event_counts(events: DataFrame, *keys: str) -> DataFrame:
    """Counts, reach and spend per key; the base of every rate."""
    return events.groupBy(*keys).agg(
        _count("impression").alias("impressions"),
        _count("click").alias("clicks"),
        _count("video_start").alias("video_starts"),
        _count("video_complete").alias("video_completes"),
        _count("engagement").alias("engagements"),
        F.count_distinct(F.when(_is("impression"), F.col("cookie_id"))).alias("reach"),
        F.sum("spend_usd").cast("double").alias("spend_usd"),
    )


def join_campaign_events(campaigns: DataFrame, events: DataFrame) -> DataFrame:
    """Every campaign with its event counts; without events counts are 0 and spend NULL."""
    counts = event_counts(events.filter(F.col("campaign_id").isNotNull()), "campaign_id")
    zero = [
        "impressions", "clicks", "video_starts", "video_completes", "engagements", "reach",
    ]
    return campaigns.join(counts, "campaign_id", "left").na.fill(0, zero)


def campaign_performance(campaigns: DataFrame, events: DataFrame) -> DataFrame:
    c = F.col
    return join_campaign_events(campaigns, events).select(
        "campaign_id", "campaign_name", "brand", "country_code", "objective",
        "budget_usd", "actual_spend_usd", "impressions", "reach",
        safe_divide(c("impressions"), c("reach")).alias("frequency"),
        (safe_divide(c("spend_usd"), c("impressions")) * 1000).alias("cpm"),
        "clicks",
        (safe_divide(c("clicks"), c("impressions")) * 100).alias("ctr"),
        safe_divide(c("actual_spend_usd"), c("clicks")).alias("cpc"),
        safe_divide(c("video_completes"), c("video_starts")).alias("vtr"),
        safe_divide(c("engagements"), c("impressions")).alias("engagement_rate"),
    )


def _clicks(events: DataFrame) -> DataFrame:
    return events.filter(_is("click")).groupBy("campaign_id").agg(F.count("*").alias("clicks"))


def clicks_per_campaign(campaigns: DataFrame, events: DataFrame) -> DataFrame:
    ids = campaigns.select("campaign_id")
    return ids.join(_clicks(events), "campaign_id", "left").na.fill(0, "clicks")


def campaign_roas(
    campaigns: DataFrame, events: DataFrame, transactions: DataFrame, *, window_days: int = 30
) -> DataFrame:
    """Conversions and revenue of each campaign by last touch within the window.

    A transaction has one credited touch, so counting transactions counts distinct ids.
    """
    credited = (
        last_touch(events, transactions, window_days=window_days)
        .groupBy("campaign_id")
        .agg(
            F.count("txn_id").alias("conversions"),
            F.sum("amount_usd").cast("double").alias("attributed_revenue_usd"),
            F.count_distinct("pan_token").alias("unique_customers"),
        )
    )
    c = F.col
    return (
        campaigns.join(_clicks(events), "campaign_id", "left")
        .join(credited, "campaign_id", "left")
        .na.fill(0, ["conversions", "unique_customers"])
        .select(
            "campaign_id", "campaign_name", "brand", "country_code", "actual_spend_usd",
            "conversions",
            (safe_divide(c("conversions"), c("clicks")) * 100).alias("cvr"),
            safe_divide(c("actual_spend_usd"), c("conversions")).alias("cpa"),
            "attributed_revenue_usd",
            safe_divide(c("attributed_revenue_usd"), c("actual_spend_usd")).alias("roas"),
            "unique_customers",
        )
    )


def customer_ltv(
    transactions: DataFrame,
    keys: tuple[str, ...] = ("pan_token", "country_code"),
    *,
    amount: str = "amount_usd",
    ts: str = "txn_ts",
) -> DataFrame:
    total = F.sum(amount).cast("double")
    return transactions.groupBy(*keys).agg(
        F.count("*").alias("transaction_count"),
        total.alias("lifetime_value_usd"),
        F.min(ts).alias("first_transaction_ts"),
        F.max(ts).alias("last_transaction_ts"),
        whole_days(F.max(ts), F.min(ts)).alias("customer_tenure_days"),
        safe_divide(total, F.count("*")).alias("avg_transaction_value_usd"),
    )


def mer(campaigns: DataFrame, transactions: DataFrame) -> DataFrame:
    """Marketing efficiency: all revenue over all spend, both summed in one aggregate."""
    none = F.lit(None).cast("decimal(18,2)")
    both = transactions.select(
        F.col("amount_usd").alias("revenue"), none.alias("spend")
    ).unionByName(
        campaigns.select(none.alias("revenue"), F.col("actual_spend_usd").alias("spend"))
    )
    revenue, spend = F.sum("revenue").cast("double"), F.sum("spend").cast("double")
    return both.agg(
        revenue.alias("revenue_usd"), spend.alias("spend_usd"),
        safe_divide(revenue, spend).alias("mer"),
    )


def first_purchase(transactions: DataFrame) -> DataFrame:
    """First transaction of each customer; equal times go to the smaller id."""
    first = F.min(F.struct("txn_ts", "txn_id", "amount_usd")).alias("first")
    return transactions.groupBy("pan_token").agg(first).select(
        "pan_token",
        F.col("first.txn_id").alias("txn_id"),
        F.col("first.txn_ts").alias("first_transaction_ts"),
        F.col("first.amount_usd").cast("double").alias("first_amount_usd"),
    )


def cac(
    campaigns: DataFrame, events: DataFrame, transactions: DataFrame, *, window_days: int = 30
) -> DataFrame:
    """Spend per customer whose very first transaction the campaign is credited with."""
    firsts = first_purchase(transactions).select("txn_id")
    new = (
        last_touch(events, transactions, window_days=window_days)
        .join(firsts, "txn_id")
        .groupBy("campaign_id")
        .agg(F.count("*").alias("new_customers"))
    )
    return (
        campaigns.select("campaign_id", "actual_spend_usd")
        .join(new, "campaign_id", "left")
        .na.fill(0, "new_customers")
        .withColumn("cac", safe_divide(F.col("actual_spend_usd"), F.col("new_customers")))
    )


def roas_by_market(campaigns: DataFrame, credited: DataFrame) -> DataFrame:
    """Attributed revenue by campaign and the market of the transaction, over campaign spend."""
    markets = credited.groupBy("campaign_id", F.col("country_code").alias("market")).agg(
        F.count("*").alias("conversions"),
        F.sum("amount_usd").cast("double").alias("attributed_revenue_usd"),
    )
    spend = campaigns.select("campaign_id", "actual_spend_usd")
    return markets.join(spend, "campaign_id").withColumn(
        "roas", safe_divide(F.col("attributed_revenue_usd"), F.col("actual_spend_usd"))
    )


def video_funnel(events: DataFrame, *keys: str) -> DataFrame:
    """Plays reaching each quarter, and the share of each step that reaches the next."""
    counted = events.groupBy(*keys).agg(*[_count(s).alias(s) for s in VIDEO_STEPS])
    rates = [
        safe_divide(F.col(after), F.col(before)).alias(f"{after}_rate")
        for before, after in zip(VIDEO_STEPS, VIDEO_STEPS[1:])
    ]
    return counted.select("*", *rates)


def creative_performance(creatives: DataFrame, events: DataFrame) -> DataFrame:
    counts = events.filter(F.col("creative_id").isNotNull()).groupBy("creative_id").agg(
        _count("impression").alias("impressions"),
        _count("click").alias("clicks"),
        _count("video_start").alias("video_starts"),
        _count("video_complete").alias("video_completes"),
    )
    c = F.col
    return (
        creatives.select("creative_id", "campaign_id", "format", "duration_seconds")
        .join(counts, "creative_id", "left")
        .na.fill(0, ["impressions", "clicks", "video_starts", "video_completes"])
        .withColumn("ctr", safe_divide(c("clicks"), c("impressions")) * 100)
        .withColumn("vtr", safe_divide(c("video_completes"), c("video_starts")))
    )


def mcc_conversion(transactions: DataFrame) -> DataFrame:
    return transactions.groupBy("merchant_category_code").agg(
        F.count("*").alias("transaction_count"),
        F.sum("amount_usd").cast("double").alias("revenue_usd"),
    )


def panel_projection(audience: DataFrame, *keys: str) -> DataFrame:
    return audience.groupBy(*keys).agg(
        F.count("*").alias("segments"), F.sum("panel_weight").alias("projected_population")
    )


def fill_rate_by_market(
    df: DataFrame, market: str = "country_code", columns: tuple[str, ...] = ("cookie_id", "hem")
) -> DataFrame:
    rates = [
        safe_divide(F.count(c), F.count("*")).alias(f"{c}_fill_rate") for c in columns
    ]
    return df.groupBy(market).agg(F.count("*").alias("row_count"), *rates)


def completed_campaigns(campaigns: DataFrame, as_of: dt.date) -> DataFrame:
    return campaigns.filter((F.col("status") == "completed") & (F.col("end_date") < F.lit(as_of)))


def audience_discovery(
    audience: DataFrame, *, market: str, income_band: str, channel: str
) -> DataFrame:
    """Segments of a market and income that over-index on a channel; unknown channels drop."""
    return audience.filter(
        (F.col("country_code") == market)
        & (F.col("income_band") == income_band)
        & (F.try_element_at("channel_index", F.lit(channel)) > 1)
    ).select("segment_name", "age_band", "brand_affinity_scores")
