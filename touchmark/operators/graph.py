"""Property graph over DataFrames: a description of node and edge keys, no copy of the data.

A path pattern becomes a chain of equi joins. An edge table usually is one of its node tables, so
a hop then needs one join instead of two.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from touchmark.functions.scalars import safe_divide
from touchmark.operators.attribution import left_join_spread


@dataclass(frozen=True)
class Node:
    """A node table with its key; its label is the table name."""

    table: str
    key: str


@dataclass(frozen=True)
class Edge:
    """Rows of ``table`` whose ``source_column`` and ``target_column`` point at two node tables."""

    label: str
    table: str
    key: str
    source: str
    source_column: str
    source_reference: str
    target: str
    target_column: str
    target_reference: str
    properties: dict[str, str] = field(default_factory=dict)


@dataclass(frozen=True)
class Hop:
    """``-[edge]->`` or, with ``reverse``, ``<-[edge]-`` to the node called ``alias``."""

    edge: str
    alias: str
    reverse: bool = False
    edge_alias: str = ""


@dataclass(frozen=True)
class Graph:
    tables: dict[str, DataFrame]
    nodes: tuple[Node, ...]
    edges: tuple[Edge, ...]

    def node(self, label: str) -> Node:
        return next(n for n in self.nodes if n.table == label)

    def edge(self, label: str) -> Edge:
        return next(e for e in self.edges if e.label == label)


def _event(label: str, source: str, column: str) -> Edge:
    return Edge(label, "pixel_events", "event_id", source, column, column, "pixel_events",
                "event_id", "event_id", {"event_date": "event_at", "event_type": "event_type"})


def _purchase(label: str, source: str, column: str) -> Edge:
    return Edge(label, "transactions", "txn_id", source, column, column, "transactions",
                "txn_id", "txn_id", {"partition_date": "purchased_at", "amount_usd": "amount_usd"})


NODES = (
    Node("audience", "audience_id"), Node("campaigns", "campaign_id"),
    Node("cookie_registry", "cookie_id"), Node("creatives", "creative_id"),
    Node("pixel_events", "event_id"), Node("transactions", "txn_id"),
)
EDGES = (
    Edge("has_creative", "creatives", "creative_id", "campaigns", "campaign_id", "campaign_id",
         "creatives", "creative_id", "creative_id"),
    _event("has_campaign_event", "campaigns", "campaign_id"),
    _event("has_creative_event", "creatives", "creative_id"),
    Edge("has_cookie", "cookie_registry", "cookie_id", "audience", "audience_id", "audience_id",
         "cookie_registry", "cookie_id", "cookie_id"),
    _event("has_pixel_event", "cookie_registry", "cookie_id"),
    _purchase("has_transaction", "cookie_registry", "cookie_id"),
    _purchase("has_purchase", "audience", "hem"),
    _purchase("has_purchase_identity", "cookie_registry", "hem"),
)
# The same relation told from the creative's side.
BELONGS_TO = Edge("belongs_to", "creatives", "creative_id", "creatives", "creative_id",
                  "creative_id", "campaigns", "campaign_id", "campaign_id")


def marketing_graph(tables: dict[str, DataFrame]) -> Graph:
    return Graph(tables, NODES, (*EDGES, BELONGS_TO))


def graph_nodes(graph: Graph) -> DataFrame:
    parts = [
        graph.tables[n.table].select(
            F.lit(n.table).alias("label"), F.col(n.key).cast("string").alias("id")
        )
        for n in graph.nodes
    ]
    return reduce(DataFrame.unionByName, parts)


def graph_edges(graph: Graph, labels: tuple[str, ...] | None = None) -> DataFrame:
    """``(label, edge_id, source, source_key, target, target_key)``; a NULL key makes no edge."""
    text = lambda c: F.col(c).cast("string")
    by_table: dict[str, list[Column]] = {}
    for e in graph.edges:
        if labels is None or e.label in labels:
            edge = F.struct(
                F.lit(e.label).alias("label"), text(e.key).alias("edge_id"),
                F.lit(e.source).alias("source"), text(e.source_column).alias("source_key"),
                F.lit(e.target).alias("target"), text(e.target_column).alias("target_key"),
            )
            by_table.setdefault(e.table, []).append(edge)
    # All edges that a table holds come from one scan of it.
    parts = [graph.tables[t].select(F.inline(F.array(*edges))) for t, edges in by_table.items()]
    return reduce(DataFrame.unionByName, parts).filter("source_key IS NOT NULL AND target_key IS NOT NULL")


def _named(df: DataFrame, alias: str) -> DataFrame:
    return df.select(*[F.col(c).alias(f"{alias}__{c}") for c in df.columns])


def match_pattern(
    graph: Graph,
    start: tuple[str, str],
    hops: list[Hop],
    returns: dict[str, str],
    where: dict[str, Column] | None = None,
) -> DataFrame:
    """Rows of a path pattern.

    ``start`` is (alias, label); ``returns`` maps ``alias.column`` to an output name; ``where`` is
    a condition per node alias, applied to the node table before any join.
    """
    where = where or {}

    def node_rows(alias: str, label: str) -> DataFrame:
        df = graph.tables[label]
        return _named(df.filter(where[alias]) if alias in where else df, alias)

    at, label = start
    rows = node_rows(at, label)
    for hop in hops:
        e = graph.edge(hop.edge)
        near, near_ref = (e.source_column, e.source_reference)
        far, far_ref, far_label = e.target_column, e.target_reference, e.target
        if hop.reverse:
            near, far, near_ref, far_ref = far, near, far_ref, e.source_reference
            far_label = e.source
        expected = e.target if hop.reverse else e.source
        if expected != label:
            raise ValueError(f"{hop.edge} does not leave {label} in that direction")
        target = node_rows(hop.alias, far_label)
        if _is_own_row(graph, e, far_label, far, far_ref):
            # The far node's row is the edge.
            on = F.col(f"{at}__{near_ref}") == F.col(f"{hop.alias}__{near}")
            rows, owner = rows.join(target, on), hop.alias
        elif _is_own_row(graph, e, label, near, near_ref):
            # The near node's row is the edge.
            on = F.col(f"{at}__{far}") == F.col(f"{hop.alias}__{far_ref}")
            rows, owner = rows.join(target, on), at
        else:
            owner = f"{hop.edge}_{hop.alias}"
            edge = _named(graph.tables[e.table], owner)
            rows = rows.join(edge, F.col(f"{at}__{near_ref}") == F.col(f"{owner}__{near}"))
            rows = rows.join(target, F.col(f"{owner}__{far}") == F.col(f"{hop.alias}__{far_ref}"))
        if hop.edge_alias:
            rows = rows.withColumns(
                {f"{hop.edge_alias}__{p}": F.col(f"{owner}__{c}") for c, p in e.properties.items()}
            )
        at, label = hop.alias, far_label
    return rows.select(*[F.col(k.replace(".", "__")).alias(v) for k, v in returns.items()])


def _is_own_row(graph: Graph, edge: Edge, label: str, column: str, reference: str) -> bool:
    return edge.table == label and column == reference == graph.node(label).key


def purchase_routes(
    transactions: DataFrame, audience: DataFrame, cookie_registry: DataFrame
) -> DataFrame:
    """The routes that lead to each transaction; ones without a route are left out.

    A route counts once however many identities share the key, so the identities are made
    distinct before they meet the transactions.
    """
    routes = (
        ("cookie", "cookie_id", cookie_registry),
        ("audience_hem", "hem", audience),
        ("registry_hem", "hem", cookie_registry),
    )
    rows = transactions.select("txn_id", "cookie_id", "hem")
    for name, column, identities in routes:
        keys = identities.select(column).distinct().withColumn(name, F.lit(name))
        rows = left_join_spread(rows, keys, column, column, "txn_id")
    names = F.array_compact(F.array(*[F.col(name) for name, _, _ in routes]))
    return rows.select("txn_id", names.alias("routes")).filter(F.size("routes") > 0)


def edge_fill_rates(graph: Graph) -> DataFrame:
    """Share of edge-table rows whose source key is filled, all edges of a table in one pass."""
    parts = []
    for table in dict.fromkeys(e.table for e in graph.edges):
        edges = [e for e in graph.edges if e.table == table and e.source != table]
        filled = graph.tables[table].agg(
            F.count("*").alias("n"),
            *[F.count(e.source_column).alias(f"f{i}") for i, e in enumerate(edges)],
        )
        rows = [
            F.struct(
                F.lit(e.label).alias("label"), F.col("n").alias("row_count"),
                safe_divide(F.col(f"f{i}"), F.col("n")).alias("fill_rate"),
            )
            for i, e in enumerate(edges)
        ]
        parts.append(filled.select(F.inline(F.array(*rows))))
    return reduce(DataFrame.unionByName, parts)
