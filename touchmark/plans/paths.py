"""Queries over the property graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from touchmark.operators import graph as g
from touchmark.plans.oracle_views import with_views
from touchmark.plans.registry import register
from touchmark.sources import star

_TABLES = tuple(n.table for n in g.NODES)


def _graph(spark: SparkSession, d: str) -> g.Graph:
    return g.marketing_graph(star.tables(spark, d))


@register("graph_nodes", with_views(" UNION ALL ".join(
    f"SELECT '{n.table}' AS label, CAST({n.key} AS VARCHAR) AS id FROM {n.table}" for n in g.NODES),
    *_TABLES))
def graph_nodes(spark: SparkSession, d: str) -> DataFrame:
    return g.graph_nodes(_graph(spark, d))


@register("graph_edges", with_views(" UNION ALL ".join(
    f"SELECT '{e.label}' AS label, CAST({e.key} AS VARCHAR) AS edge_id, '{e.source}' AS source,"
    f" CAST({e.source_column} AS VARCHAR) AS source_key, '{e.target}' AS target,"
    f" CAST({e.target_column} AS VARCHAR) AS target_key FROM {e.table}"
    f" WHERE {e.source_column} IS NOT NULL" for e in g.EDGES), *_TABLES))
def graph_edges(spark: SparkSession, d: str) -> DataFrame:
    return g.graph_edges(_graph(spark, d), tuple(e.label for e in g.EDGES))


@register("match_pattern", with_views("""
SELECT c.campaign_name, cr.creative_name FROM campaigns c JOIN creatives cr
  ON cr.campaign_id = c.campaign_id""", "campaigns", "creatives"))
def match_pattern(spark: SparkSession, d: str) -> DataFrame:
    return g.match_pattern(
        _graph(spark, d),
        ("c", "campaigns"),
        [g.Hop("belongs_to", "cr", reverse=True)],
        {"c.campaign_name": "campaign_name", "cr.creative_name": "creative_name"},
    )


@register("path_campaign_creative_event", with_views("""
SELECT c.campaign_id, cr.creative_id, cr.format, e.event_id, e.event_type, e.event_date AS event_at
FROM campaigns c JOIN creatives cr ON cr.campaign_id = c.campaign_id
JOIN pixel_events e ON e.creative_id = cr.creative_id WHERE c.status = 'completed'""",
    "campaigns", "creatives", "pixel_events"))
def path_campaign_creative_event(spark: SparkSession, d: str) -> DataFrame:
    return g.match_pattern(
        _graph(spark, d),
        ("c", "campaigns"),
        [g.Hop("has_creative", "cr"), g.Hop("has_creative_event", "e", edge_alias="h")],
        {
            "c.campaign_id": "campaign_id", "cr.creative_id": "creative_id", "cr.format": "format",
            "e.event_id": "event_id", "h.event_type": "event_type", "h.event_at": "event_at",
        },
        where={"c": F.col("status") == "completed"},
    )


@register("path_audience_cookie_txn", with_views("""
SELECT a.audience_id, a.segment_name, r.cookie_id, t.txn_id, CAST(t.amount_usd AS DOUBLE) AS amount_usd
FROM audience a JOIN cookie_registry r ON r.audience_id = a.audience_id
JOIN transactions t ON t.cookie_id = r.cookie_id""", "audience", "cookie_registry", "transactions"))
def path_audience_cookie_txn(spark: SparkSession, d: str) -> DataFrame:
    paths = g.match_pattern(
        _graph(spark, d),
        ("a", "audience"),
        [g.Hop("has_cookie", "r"), g.Hop("has_transaction", "t", edge_alias="p")],
        {
            "a.audience_id": "audience_id", "a.segment_name": "segment_name",
            "r.cookie_id": "cookie_id", "t.txn_id": "txn_id", "p.amount_usd": "amount_usd",
        },
    )
    return paths.withColumn("amount_usd", F.col("amount_usd").cast("double"))


@register("path_hem_alternatives", with_views("""
SELECT * FROM (SELECT txn_id, concat_ws('+',
    CASE WHEN cookie_id IN (SELECT cookie_id FROM cookie_registry) THEN 'cookie' END,
    CASE WHEN hem IN (SELECT hem FROM audience WHERE hem IS NOT NULL) THEN 'audience_hem' END,
    CASE WHEN hem IN (SELECT hem FROM cookie_registry WHERE hem IS NOT NULL) THEN 'registry_hem' END)
    AS routes FROM transactions) WHERE routes <> ''""", "audience", "cookie_registry", "transactions"))
def path_hem_alternatives(spark: SparkSession, d: str) -> DataFrame:
    tables = star.tables(spark, d)
    routes = g.purchase_routes(
        tables["transactions"], tables["audience"], tables["cookie_registry"]
    )
    return routes.withColumn("routes", F.array_join("routes", "+"))


@register("edge_fill_rates", with_views(" UNION ALL ".join(
    f"SELECT '{e.label}' AS label, COUNT(*) AS row_count,"
    f" COUNT({e.source_column}) / CAST(COUNT(*) AS DOUBLE) AS fill_rate FROM {e.table}"
    for e in g.EDGES), *_TABLES))
def edge_fill_rates(spark: SparkSession, d: str) -> DataFrame:
    return g.edge_fill_rates(_graph(spark, d))
