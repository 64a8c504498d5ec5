"""Queries over campaigns, events and transactions."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from touchmark.operators import attribution as at
from touchmark.operators import graph, presence
from touchmark.operators import marts, prompts
from touchmark.plans.oracle_views import with_views
from touchmark.plans.registry import register
from touchmark.session import new_path
from touchmark.sources import star
from touchmark.sources.tables import load

AS_OF_DATE = dt.date(2024, 1, 31)


def _plain_times(df: DataFrame, *columns: str) -> DataFrame:
    """Instants shown as zone-less UTC times, as DuckDB has them."""
    return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c in columns})


def _doubles(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("double") for c in columns})


# --- projections and filters ---------------------------------------------------------------


@register("completed_campaigns", with_views("""
SELECT campaign_id, campaign_name, CAST(budget_usd AS DOUBLE) AS budget_usd, end_date
FROM campaigns WHERE status = 'completed' AND end_date < DATE '2024-01-31'""", "campaigns"))
def completed_campaigns(spark: SparkSession, d: str) -> DataFrame:
    done = marts.completed_campaigns(star.campaigns(spark, d), AS_OF_DATE)
    return _doubles(done.select("campaign_id", "campaign_name", "budget_usd", "end_date"), "budget_usd")


@register("audience_discovery", with_views("""
SELECT segment_name, age_band, b.key AS affinity_brand, b.value AS affinity
FROM (SELECT segment_name, age_band, UNNEST(map_entries(brand_affinity_scores)) AS b FROM audience
      WHERE country_code = 'NATION_8' AND income_band = 'High' AND channel_index['meta'] > 1)""",
    "audience"))
def audience_discovery(spark: SparkSession, d: str) -> DataFrame:
    found = marts.audience_discovery(
        star.audience(spark, d), market="NATION_8", income_band="High", channel="meta"
    )
    return found.select(
        "segment_name", "age_band",
        F.explode("brand_affinity_scores").alias("affinity_brand", "affinity"),
    )


SUMMARY_SQL = """
SELECT campaign_id, 'Summarise this campaign performance data in 3 bullet points: Campaign: '
  || campaign_name || ', Brand: ' || brand || ', Market: ' || country_code || ', Objective: '
  || objective || ', Budget: $' || CAST(CAST(round(budget_usd, 0) AS BIGINT) AS VARCHAR)
  || ', Spend: $' || CAST(CAST(round(actual_spend_usd, 0) AS BIGINT) AS VARCHAR)
  || ', Status: ' || status AS prompt
FROM campaigns WHERE status = 'completed'"""
CLASSIFY_SQL = """
SELECT creative_id, 'Classify this creative asset into one of: Premium, Standard, Budget. '
  || 'Return just the classification. Creative: ' || creative_name || ', Format: ' || format
  || ', Channel: ' || channel || ', Brand: ' || brand AS prompt
FROM creatives"""
RECOMMEND_SQL = """
SELECT audience_id, 'Based on the following audience segment, recommend 3 ad creative themes '
  || 'and explain why. Segment: ' || segment_name || ', Demographics: ' || age_band || ' '
  || gender || ', Income: ' || income_band || ', Country: ' || country_code AS prompt
FROM audience"""


@register("prompt_campaign_summary", with_views(SUMMARY_SQL, "campaigns"))
def prompt_campaign_summary(spark: SparkSession, d: str) -> DataFrame:
    return prompts.campaign_summary(star.campaigns(spark, d))


@register("prompt_classify_creative", with_views(CLASSIFY_SQL, "creatives"))
def prompt_classify_creative(spark: SparkSession, d: str) -> DataFrame:
    return prompts.classify_creative(star.creatives(spark, d))


@register("prompt_recommend_theme", with_views(RECOMMEND_SQL, "audience"))
def prompt_recommend_theme(spark: SparkSession, d: str) -> DataFrame:
    return prompts.recommend_theme(star.audience(spark, d))


@register("limit_demo", with_views(f"""
SELECT 'campaign' AS kind, campaign_id AS id, prompt
FROM (SELECT * FROM ({SUMMARY_SQL}) a ORDER BY campaign_id LIMIT 3)
UNION ALL SELECT 'creative', creative_id, prompt
FROM (SELECT * FROM ({CLASSIFY_SQL}) b ORDER BY creative_id LIMIT 5)
UNION ALL SELECT 'audience', audience_id, prompt
FROM (SELECT * FROM ({RECOMMEND_SQL}) c ORDER BY audience_id LIMIT 3)""",
    "campaigns", "creatives", "audience"))
def limit_demo(spark: SparkSession, d: str) -> DataFrame:
    """The reference limits its demo prompts to 3, 5 and 3 rows; ordered by key here."""
    parts = (
        ("campaign", "campaign_id", 3, prompts.campaign_summary(star.campaigns(spark, d))),
        ("creative", "creative_id", 5, prompts.classify_creative(star.creatives(spark, d))),
        ("audience", "audience_id", 3, prompts.recommend_theme(star.audience(spark, d))),
    )
    first, *rest = [
        df.orderBy(key).limit(n).select(F.lit(kind).alias("kind"), F.col(key).alias("id"), "prompt")
        for kind, key, n, df in parts
    ]
    for part in rest:
        first = first.unionByName(part)
    return first


@register("segment_content", with_views("""
SELECT audience_id, segment_name, 'Segment: ' || segment_name || '. Age: ' || age_band
  || '. Gender: ' || gender || '. Income: ' || income_band || '. Country: ' || country_code AS content
FROM audience""", "audience"))
def segment_content(spark: SparkSession, d: str) -> DataFrame:
    return star.audience(spark, d).select(
        "audience_id", "segment_name", prompts.segment_content().alias("content")
    )


@register("null_key_filter", with_views("""
SELECT 'event' AS side, event_id AS id, cookie_id FROM pixel_events
WHERE event_type = 'click' AND cookie_id IS NOT NULL
UNION ALL SELECT 'transaction', txn_id, cookie_id FROM transactions WHERE cookie_id IS NOT NULL""",
    "pixel_events", "transactions"))
def null_key_filter(spark: SparkSession, d: str) -> DataFrame:
    events = at.with_join_key(at.clicks_of(star.pixel_events(spark, d)))
    buys = at.with_join_key(star.transactions(spark, d))
    return events.select(F.lit("event").alias("side"), F.col("event_id").alias("id"), "cookie_id").unionByName(
        buys.select(F.lit("transaction").alias("side"), F.col("txn_id").alias("id"), "cookie_id")
    )


@register("ok_rows", """
SELECT doc_id, lang FROM (SELECT d.doc_id, d.lang, CASE WHEN l.toxic = 1 THEN 'RESOURCE_EXHAUSTED'
  ELSE '' END AS status FROM documents d JOIN labels l ON l.doc_id = d.doc_id)
WHERE length(status) = 0""")
def ok_rows(spark: SparkSession, d: str) -> DataFrame:
    docs, labels = load(spark, d, "documents"), load(spark, d, "labels")
    status = F.when(F.col("toxic") == 1, "RESOURCE_EXHAUSTED").otherwise("")
    called = docs.join(labels, "doc_id").select("doc_id", "lang", status.alias("status"))
    return prompts.ok_rows(called).drop("status")


# --- joins and attribution -----------------------------------------------------------------

_EVENTS_LEFT = """
SELECT c.campaign_id, COUNT(*) FILTER (event_type = 'impression') AS impressions,
  COUNT(*) FILTER (event_type = 'click') AS clicks,
  COUNT(*) FILTER (event_type = 'video_start') AS video_starts,
  COUNT(*) FILTER (event_type = 'video_complete') AS video_completes,
  COUNT(*) FILTER (event_type = 'engagement') AS engagements,
  COUNT(DISTINCT CASE WHEN event_type = 'impression' THEN cookie_id END) AS reach,
  CAST(SUM(spend_usd) AS DOUBLE) AS spend_usd
FROM campaigns c LEFT JOIN pixel_events p ON p.campaign_id = c.campaign_id GROUP BY c.campaign_id"""


@register("join_campaign_events", with_views(_EVENTS_LEFT, "campaigns", "pixel_events"))
def join_campaign_events(spark: SparkSession, d: str) -> DataFrame:
    ids = star.campaigns(spark, d).select("campaign_id")
    return marts.join_campaign_events(ids, star.pixel_events(spark, d))


@register("attribution_candidates", with_views(
    "SELECT txn_id, COUNT(*) AS touch_count FROM touches GROUP BY txn_id", "touches"))
def attribution_candidates(spark: SparkSession, d: str) -> DataFrame:
    counted = at.attribution_candidates(star.pixel_events(spark, d), star.transactions(spark, d))
    return counted.select("txn_id", "touch_count")


@register("last_touch", with_views("""
SELECT txn_id, pan_token, country_code, CAST(amount_usd AS DOUBLE) AS amount_usd, txn_ts, event_id,
  event_ts, campaign_id FROM touches WHERE rn = 1""", "touches"))
def last_touch(spark: SparkSession, d: str) -> DataFrame:
    found = at.last_touch(star.pixel_events(spark, d), star.transactions(spark, d)).drop("cookie_id")
    return _doubles(_plain_times(found, "txn_ts", "event_ts"), "amount_usd")


def _last_touch_days(days: int):
    def query(spark: SparkSession, d: str) -> DataFrame:
        found = at.last_touch(
            star.pixel_events(spark, d), star.transactions(spark, d), window_days=days
        )
        return found.select("txn_id", "event_id", "campaign_id")

    return query


for _days in (1, 7):
    register(f"last_touch_{_days}d", with_views(f"""
SELECT txn_id, event_id, campaign_id FROM touches
WHERE rn = 1 AND txn_ts <= event_ts + INTERVAL {_days} DAY""", "touches"))(_last_touch_days(_days))


@register("rank_latest_touch", with_views(
    "SELECT txn_id, event_id, campaign_id, CAST(rn AS INTEGER) AS rn FROM touches WHERE rn <= 3",
    "touches"))
def rank_latest_touch(spark: SparkSession, d: str) -> DataFrame:
    ranked = at.ranked_touches(star.pixel_events(spark, d), star.transactions(spark, d), k=3)
    return ranked.select("txn_id", "event_id", "campaign_id", "rn")


@register("attribution_cookie_then_hem", with_views("""
SELECT txn_id, campaign_id, event_id, country_code, CAST(amount_usd AS DOUBLE) AS amount_usd,
  CASE priority WHEN 1 THEN 'cookie' ELSE 'hem' END AS matched_via FROM fallback""", "fallback"))
def attribution_cookie_then_hem(spark: SparkSession, d: str) -> DataFrame:
    found = at.attribute_with_fallback(
        star.pixel_events(spark, d), star.transactions(spark, d), star.cookie_registry(spark, d)
    )
    columns = ("txn_id", "campaign_id", "event_id", "country_code", "amount_usd", "matched_via")
    return _doubles(found.select(*columns), "amount_usd")


@register("left_join_ranked", with_views("""
SELECT c.campaign_id, t.txn_id, CAST(t.amount_usd AS DOUBLE) AS amount_usd
FROM campaigns c LEFT JOIN touches t ON t.campaign_id = c.campaign_id AND t.rn = 1""",
    "campaigns", "touches"))
def left_join_ranked(spark: SparkSession, d: str) -> DataFrame:
    """The credited touches are written once, for both the campaigns that have some and those that have none."""
    best, path = at.last_touch(star.pixel_events(spark, d), star.transactions(spark, d)), new_path(spark, "last-touch")
    best.select("campaign_id", "txn_id", "amount_usd").write.parquet(path)
    joined = at.left_join_hot(
        star.campaigns(spark, d).select("campaign_id"), spark.read.parquet(path), "campaign_id"
    )
    return _doubles(joined, "amount_usd")


@register("clicks_per_campaign", with_views("""
SELECT campaign_id, (SELECT COUNT(*) FROM pixel_events p WHERE p.event_type = 'click'
  AND p.campaign_id = c.campaign_id) AS clicks FROM campaigns c""", "campaigns", "pixel_events"))
def clicks_per_campaign(spark: SparkSession, d: str) -> DataFrame:
    return marts.clicks_per_campaign(star.campaigns(spark, d), star.pixel_events(spark, d))


@register("identity_resolve", with_views("""
SELECT t.txn_id, COALESCE(r.audience_id, h.audience_id) AS audience_id,
  CASE WHEN r.audience_id IS NOT NULL THEN 'cookie' WHEN h.audience_id IS NOT NULL THEN 'hem' END
    AS resolved_via
FROM transactions t LEFT JOIN cookie_registry r ON r.cookie_id = t.cookie_id
LEFT JOIN (SELECT hem, MIN(audience_id) AS audience_id FROM cookie_registry WHERE hem IS NOT NULL
           GROUP BY hem) h ON h.hem = t.hem""", "transactions", "cookie_registry"))
def identity_resolve(spark: SparkSession, d: str) -> DataFrame:
    rows = star.transactions(spark, d).select("txn_id", "cookie_id", "hem")
    resolved = at.identity_resolve(rows, star.cookie_registry(spark, d))
    return resolved.select("txn_id", "audience_id", "resolved_via")


REFERENCES = presence.declared(graph.EDGES)


def reference_sql(template: str) -> str:
    """The template once per declared reference, by its name, child and parent."""
    return " UNION ALL ".join(
        template.format(name=r.name, child=r.child, child_key=r.child_key, parent=r.parent, parent_key=r.parent_key)
        for r in REFERENCES
    )


REFERENCE_TABLES = tuple(dict.fromkeys(t for r in REFERENCES for t in (r.child, r.parent)))


@register("orphan_keys", with_views(reference_sql("""
SELECT '{name}' AS reference, CAST({child_key} AS VARCHAR) AS key, COUNT(*) AS child_rows FROM {child}
WHERE {child_key} IS NOT NULL AND {child_key} NOT IN (SELECT {parent_key} FROM {parent} WHERE {parent_key} IS NOT NULL)
GROUP BY {child_key}"""), *REFERENCE_TABLES))
def orphan_keys(spark: SparkSession, d: str) -> DataFrame:
    """Keys of all declared references that their parent does not have."""
    return presence.orphans(star.tables(spark, d), REFERENCES)


# --- aggregations --------------------------------------------------------------------------


PERFORMANCE_SQL = f"""
SELECT c.campaign_id, campaign_name, brand, country_code, objective,
  CAST(budget_usd AS DOUBLE) AS budget_usd, CAST(actual_spend_usd AS DOUBLE) AS actual_spend_usd,
  impressions, reach, impressions / CAST(NULLIF(reach, 0) AS DOUBLE) AS frequency,
  spend_usd / CAST(NULLIF(impressions, 0) AS DOUBLE) * 1000 AS cpm, clicks,
  clicks / CAST(NULLIF(impressions, 0) AS DOUBLE) * 100 AS ctr,
  CAST(actual_spend_usd AS DOUBLE) / NULLIF(clicks, 0) AS cpc,
  video_completes / CAST(NULLIF(video_starts, 0) AS DOUBLE) AS vtr,
  engagements / CAST(NULLIF(impressions, 0) AS DOUBLE) AS engagement_rate
FROM campaigns c JOIN ({_EVENTS_LEFT}) e ON e.campaign_id = c.campaign_id"""


@register("campaign_performance", with_views(PERFORMANCE_SQL, "campaigns", "pixel_events"))
def campaign_performance(spark: SparkSession, d: str) -> DataFrame:
    mart = marts.campaign_performance(star.campaigns(spark, d), star.pixel_events(spark, d))
    return _doubles(mart, "budget_usd", "actual_spend_usd")


@register("campaign_roas", with_views("""
SELECT c.campaign_id, campaign_name, brand, country_code,
  CAST(actual_spend_usd AS DOUBLE) AS actual_spend_usd, conversions,
  CAST(conversions AS DOUBLE) / NULLIF(clicks, 0) * 100 AS cvr,
  CAST(actual_spend_usd AS DOUBLE) / NULLIF(conversions, 0) AS cpa, attributed_revenue_usd,
  attributed_revenue_usd / NULLIF(CAST(actual_spend_usd AS DOUBLE), 0) AS roas, unique_customers
FROM campaigns c JOIN (
  SELECT c.campaign_id, COUNT(DISTINCT txn_id) AS conversions,
    CAST(SUM(amount_usd) AS DOUBLE) AS attributed_revenue_usd,
    COUNT(DISTINCT pan_token) AS unique_customers,
    (SELECT COUNT(*) FROM pixel_events p WHERE p.event_type = 'click'
       AND p.campaign_id = c.campaign_id) AS clicks
  FROM campaigns c LEFT JOIN touches a ON a.campaign_id = c.campaign_id AND a.rn = 1
  GROUP BY c.campaign_id) r ON r.campaign_id = c.campaign_id""",
    "campaigns", "pixel_events", "touches"))
def campaign_roas(spark: SparkSession, d: str) -> DataFrame:
    mart = marts.campaign_roas(
        star.campaigns(spark, d), star.pixel_events(spark, d), star.transactions(spark, d)
    )
    return _doubles(mart, "actual_spend_usd")


_LTV = """COUNT(*) AS transaction_count, CAST(SUM({amount}) AS DOUBLE) AS lifetime_value_usd,
  MIN({ts}) AS first_transaction_ts, MAX({ts}) AS last_transaction_ts,
  date_sub('day', MIN({ts}), MAX({ts})) AS customer_tenure_days,
  CAST(SUM({amount}) AS DOUBLE) / COUNT(*) AS avg_transaction_value_usd"""


@register("customer_ltv", with_views(f"""
SELECT pan_token, country_code, {_LTV.format(amount='amount_usd', ts='txn_ts')}
FROM transactions GROUP BY pan_token, country_code""", "transactions"))
def customer_ltv(spark: SparkSession, d: str) -> DataFrame:
    ltv = marts.customer_ltv(star.transactions(spark, d))
    return _plain_times(ltv, "first_transaction_ts", "last_transaction_ts")


@register("ltv_by_customer", with_views(f"""
SELECT pan_token, {_LTV.format(amount='amount_usd', ts='txn_ts')}
FROM transactions GROUP BY pan_token""", "transactions"))
def ltv_by_customer(spark: SparkSession, d: str) -> DataFrame:
    ltv = marts.customer_ltv(star.transactions(spark, d), ("pan_token",))
    return _plain_times(ltv, "first_transaction_ts", "last_transaction_ts")


@register("customer_ltv_orders", f"""
SELECT o_custkey, {_LTV.format(amount='CAST(o_totalprice AS DECIMAL(18,2))', ts='o_orderdate')}
FROM orders GROUP BY o_custkey""")
def customer_ltv_orders(spark: SparkSession, d: str) -> DataFrame:
    """The same measure over the order table, by far the larger one."""
    orders = load(spark, d, "orders").select(
        "o_custkey", F.col("o_totalprice").cast(star.MONEY).alias("price"),
        F.col("o_orderdate").cast("timestamp").alias("at"),
    )
    ltv = marts.customer_ltv(orders, ("o_custkey",), amount="price", ts="at")
    return _plain_times(ltv, "first_transaction_ts", "last_transaction_ts")


@register("mer", with_views("""
SELECT revenue_usd, spend_usd, revenue_usd / NULLIF(spend_usd, 0) AS mer FROM
  (SELECT CAST(SUM(amount_usd) AS DOUBLE) AS revenue_usd FROM transactions) r,
  (SELECT CAST(SUM(actual_spend_usd) AS DOUBLE) AS spend_usd FROM campaigns) s""",
    "campaigns", "transactions"))
def mer(spark: SparkSession, d: str) -> DataFrame:
    return marts.mer(star.campaigns(spark, d), star.transactions(spark, d))


@register("cac", with_views("""
SELECT c.campaign_id, CAST(actual_spend_usd AS DOUBLE) AS actual_spend_usd, COUNT(f.txn_id) AS new_customers,
  CAST(actual_spend_usd AS DOUBLE) / NULLIF(COUNT(f.txn_id), 0) AS cac
FROM campaigns c LEFT JOIN (
  SELECT t.campaign_id, t.txn_id FROM touches t JOIN (
    SELECT txn_id, ROW_NUMBER() OVER (PARTITION BY pan_token ORDER BY txn_ts, txn_id) AS n
    FROM transactions) o ON o.txn_id = t.txn_id AND o.n = 1
  WHERE t.rn = 1) f ON f.campaign_id = c.campaign_id
GROUP BY c.campaign_id, actual_spend_usd""", "campaigns", "touches"))
def cac(spark: SparkSession, d: str) -> DataFrame:
    result = marts.cac(
        star.campaigns(spark, d), star.pixel_events(spark, d), star.transactions(spark, d)
    )
    return _doubles(result, "actual_spend_usd")


@register("first_purchase", with_views("""
SELECT pan_token, txn_id, txn_ts AS first_transaction_ts, CAST(amount_usd AS DOUBLE) AS first_amount_usd
FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY pan_token ORDER BY txn_ts, txn_id) AS n
      FROM transactions) WHERE n = 1""", "transactions"))
def first_purchase(spark: SparkSession, d: str) -> DataFrame:
    return _plain_times(marts.first_purchase(star.transactions(spark, d)), "first_transaction_ts")


_MARKET_SQL = """
SELECT c.campaign_id, t.country_code AS market, COUNT(*) AS conversions,
  CAST(SUM(amount_usd) AS DOUBLE) AS attributed_revenue_usd,
  CAST(actual_spend_usd AS DOUBLE) AS actual_spend_usd,
  CAST(SUM(amount_usd) AS DOUBLE) / NULLIF(CAST(actual_spend_usd AS DOUBLE), 0) AS roas
FROM {source} JOIN campaigns c ON c.campaign_id = t.campaign_id
GROUP BY c.campaign_id, t.country_code, actual_spend_usd"""


@register("roas_by_market", with_views(
    _MARKET_SQL.format(source="(SELECT * FROM touches WHERE rn = 1) t"), "campaigns", "touches"))
def roas_by_market(spark: SparkSession, d: str) -> DataFrame:
    credited = at.last_touch(star.pixel_events(spark, d), star.transactions(spark, d))
    return _doubles(marts.roas_by_market(star.campaigns(spark, d), credited), "actual_spend_usd")


@register("roas_by_market_fallback", with_views(
    _MARKET_SQL.format(source="fallback t"), "campaigns", "fallback"))
def roas_by_market_fallback(spark: SparkSession, d: str) -> DataFrame:
    credited = at.attribute_with_fallback(
        star.pixel_events(spark, d), star.transactions(spark, d), star.cookie_registry(spark, d)
    )
    return _doubles(marts.roas_by_market(star.campaigns(spark, d), credited), "actual_spend_usd")


@register("video_funnel", with_views("""
SELECT *, video_q1 / CAST(NULLIF(video_start, 0) AS DOUBLE) AS video_q1_rate,
  video_q2 / CAST(NULLIF(video_q1, 0) AS DOUBLE) AS video_q2_rate,
  video_q3 / CAST(NULLIF(video_q2, 0) AS DOUBLE) AS video_q3_rate,
  video_complete / CAST(NULLIF(video_q3, 0) AS DOUBLE) AS video_complete_rate
FROM (SELECT campaign_id, COUNT(*) FILTER (event_type = 'video_start') AS video_start,
    COUNT(*) FILTER (event_type = 'video_q1') AS video_q1,
    COUNT(*) FILTER (event_type = 'video_q2') AS video_q2,
    COUNT(*) FILTER (event_type = 'video_q3') AS video_q3,
    COUNT(*) FILTER (event_type = 'video_complete') AS video_complete
  FROM pixel_events GROUP BY campaign_id)""", "pixel_events"))
def video_funnel(spark: SparkSession, d: str) -> DataFrame:
    return marts.video_funnel(star.pixel_events(spark, d), "campaign_id")


@register("creative_performance", with_views("""
SELECT c.creative_id, c.campaign_id, format, duration_seconds, COALESCE(impressions, 0) AS impressions,
  COALESCE(clicks, 0) AS clicks, COALESCE(starts, 0) AS video_starts,
  COALESCE(completes, 0) AS video_completes,
  clicks / CAST(NULLIF(impressions, 0) AS DOUBLE) * 100 AS ctr,
  completes / CAST(NULLIF(starts, 0) AS DOUBLE) AS vtr
FROM creatives c LEFT JOIN (SELECT creative_id,
    COUNT(*) FILTER (event_type = 'impression') AS impressions,
    COUNT(*) FILTER (event_type = 'click') AS clicks,
    COUNT(*) FILTER (event_type = 'video_start') AS starts,
    COUNT(*) FILTER (event_type = 'video_complete') AS completes
  FROM pixel_events GROUP BY creative_id) e ON e.creative_id = c.creative_id""",
    "creatives", "pixel_events"))
def creative_performance(spark: SparkSession, d: str) -> DataFrame:
    return marts.creative_performance(star.creatives(spark, d), star.pixel_events(spark, d))


@register("mcc_conversion", with_views("""
SELECT merchant_category_code, COUNT(*) AS transaction_count,
  CAST(SUM(amount_usd) AS DOUBLE) AS revenue_usd
FROM transactions GROUP BY merchant_category_code""", "transactions"))
def mcc_conversion(spark: SparkSession, d: str) -> DataFrame:
    return marts.mcc_conversion(star.transactions(spark, d))


@register("panel_projection", with_views("""
SELECT segment_name, income_band, COUNT(*) AS segments, SUM(panel_weight) AS projected_population
FROM audience GROUP BY segment_name, income_band""", "audience"))
def panel_projection(spark: SparkSession, d: str) -> DataFrame:
    return marts.panel_projection(star.audience(spark, d), "segment_name", "income_band")


@register("fill_rate_by_market", with_views("""
SELECT country_code, COUNT(*) AS row_count,
  CAST(COUNT(cookie_id) AS DOUBLE) / COUNT(*) AS cookie_id_fill_rate,
  CAST(COUNT(hem) AS DOUBLE) / COUNT(*) AS hem_fill_rate
FROM transactions GROUP BY country_code""", "transactions"))
def fill_rate_by_market(spark: SparkSession, d: str) -> DataFrame:
    return marts.fill_rate_by_market(star.transactions(spark, d))
