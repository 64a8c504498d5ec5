"""Queries over rules, profiles and discovered keys."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from touchmark.operators import discover, heavy, presence, profile
from touchmark.operators import quality as dq
from touchmark.operators.quality import Rule
from touchmark.plans.oracle_views import TABLE_COLUMNS, VIEWS, discovery_views, with_views
from touchmark.plans.measures import REFERENCE_TABLES, REFERENCES, reference_sql
from touchmark.plans.registry import register
from touchmark.session import new_path
from touchmark.sources import star
from touchmark.sources.profiles import ERROR, append_profile, merged_profile
from touchmark.sources.sinks import append_scan_results
from touchmark.sources.tables import load

TABLES = tuple(TABLE_COLUMNS)


def _all_tables(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    return {t: load(spark, d, t) for t in TABLES}


# --- rules ---------------------------------------------------------------------------------

RULES = {
    "pixel_events": [
        Rule("event_id", "non_null"),
        Rule("campaign_id", "non_null"),
        Rule("creative_id", "non_null"),
        Rule("cookie_id", "non_null", threshold=0.79),
        Rule("event_type", "set", dimension="VALIDITY", threshold=0.9,
             values=("impression", "click", "engagement", "video_start", "video_complete")),
        Rule("channel", "regex", dimension="VALIDITY", threshold=0.5, pattern="[a-z]{4,7}"),
        Rule("spend_usd", "range", dimension="VALIDITY", threshold=0.9, min_value="0",
             max_value="50", strict_max_enabled=True),
    ],
    "transactions": [
        Rule("txn_id", "non_null"),
        Rule("pan_token", "non_null"),
        Rule("amount_usd", "range", dimension="VALIDITY", threshold=0.95, min_value="0",
             strict_min_enabled=True),
        Rule("brand", "regex", dimension="VALIDITY", threshold=0.8, pattern="Brand#[0-9]"),
        Rule("hem", "regex", dimension="VALIDITY", threshold=0.2, pattern="[0-9a-f]{64}"),
    ],
    "cookie_registry": [
        Rule("cookie_id", "non_null"),
        Rule("audience_id", "non_null", threshold=0.37),
        Rule("hem", "non_null", threshold=0.32),
    ],
    "campaigns": [
        Rule("campaign_id", "non_null"),
        Rule("brand", "non_null"),
        Rule("advertiser", "non_null"),
        Rule("status", "set", values=("planned", "active", "completed", "paused")),
        Rule("actual_spend_usd", "range", threshold=0.99, min_value="0", strict_min_enabled=True),
    ],
    "audience": [
        Rule("audience_id", "non_null"),
        Rule("segment_name", "non_null"),
        Rule("hem", "non_null", threshold=0.57),
        Rule("lat", "non_null"),
    ],
    "creatives": [Rule("creative_id", "non_null"), Rule("duration_seconds", "non_null", 0.7)],
}


def _condition(rule: Rule) -> str:
    """The rule as SQL, NULL counting as broken."""
    c = rule.column
    if rule.rule_type == "non_null":
        return f"{c} IS NOT NULL"
    if rule.rule_type == "set":
        test = f"CAST({c} AS VARCHAR) IN ({', '.join(repr(v) for v in rule.values)})"
    elif rule.rule_type == "regex":
        test = f"regexp_full_match(CAST({c} AS VARCHAR), '{rule.pattern}')"
    else:
        tests = [f"{c} IS NOT NULL"]
        if rule.min_value:
            tests.append(f"{c} {'>' if rule.strict_min_enabled else '>='} {rule.min_value}")
        if rule.max_value:
            tests.append(f"{c} {'<' if rule.strict_max_enabled else '<='} {rule.max_value}")
        test = " AND ".join(tests)
    return f"COALESCE({test}, FALSE)"


def _scan_sql(table: str, rules: list[Rule]) -> str:
    parts = [
        f"SELECT '{table}' AS table_name, '{r.name}' AS rule, '{r.column}' AS column_name,"
        f" '{r.dimension}' AS dimension, CAST({r.threshold} AS DOUBLE) AS threshold,"
        f" COUNT(*) AS evaluated, COUNT(*) FILTER ({_condition(r)}) AS passed FROM {table}"
        for r in rules
    ]
    return (
        "SELECT *, passed / CAST(NULLIF(evaluated, 0) AS DOUBLE) AS ratio,"
        " COALESCE(passed / CAST(NULLIF(evaluated, 0) AS DOUBLE) >= threshold, TRUE) AS ok"
        f" FROM ({' UNION ALL '.join(parts)})"
    )


def _rules_of_type(rule_type: str) -> dict[str, list[Rule]]:
    chosen = {t: [r for r in rules if r.rule_type == rule_type] for t, rules in RULES.items()}
    return {t: rules for t, rules in chosen.items() if rules}


def _scan_query(rules: dict[str, list[Rule]]):
    def query(spark: SparkSession, d: str) -> DataFrame:
        makers = {t: getattr(star, t) for t in rules}
        return dq.scan_tables({t: (makers[t](spark, d), rs) for t, rs in rules.items()})

    return query


def _scan_oracle(rules: dict[str, list[Rule]]) -> str:
    return with_views(" UNION ALL ".join(_scan_sql(t, rs) for t, rs in rules.items()), *rules)


for _type in ("non_null", "set", "regex", "range"):
    register(f"dq_{_type}", _scan_oracle(_rules_of_type(_type)))(_scan_query(_rules_of_type(_type)))

_EVENT_RULES = {"pixel_events": RULES["pixel_events"]}
register("dq_scan", _scan_oracle(_EVENT_RULES))(_scan_query(_EVENT_RULES))
register("dq_fill_contract", _scan_oracle(RULES))(_scan_query(RULES))


@register("dq_table_status", with_views(
    "SELECT table_name, bool_and(ok) AS passed, COUNT(*) AS rules_evaluated,"
    " COUNT(*) FILTER (NOT ok) AS rules_failed FROM ("
    + " UNION ALL ".join(f"({_scan_sql(t, rs)})" for t, rs in RULES.items())
    + ") GROUP BY table_name", *RULES))
def dq_table_status(spark: SparkSession, d: str) -> DataFrame:
    return dq.dq_table_status(_scan_query(RULES)(spark, d))


def _failing_sql(table: str, key: str) -> str:
    names = " || ".join(
        f"CASE WHEN {_condition(r)} THEN '' ELSE '{r.name},' END" for r in RULES[table]
    )
    return f"SELECT * FROM (SELECT {key}, {names} AS failed_rules FROM {table}) WHERE failed_rules <> ''"


@register("dq_failing_rows", with_views(_failing_sql("transactions", "txn_id"), "transactions"))
def dq_failing_rows(spark: SparkSession, d: str) -> DataFrame:
    rows = dq.dq_failing_rows(star.transactions(spark, d), RULES["transactions"])
    names = F.concat(F.array_join("failed_rules", ","), F.lit(","))
    return rows.select("txn_id", names.alias("failed_rules"))


@register("dq_referential", with_views(reference_sql("""
SELECT '{name}' AS reference, COUNT(*) AS evaluated, COUNT(*) FILTER (found) AS passed,
  COUNT(DISTINCT key) AS child_keys, COUNT(DISTINCT key) FILTER (NOT found) AS orphan_keys,
  (SELECT COUNT(DISTINCT {parent_key}) FROM {parent} WHERE {parent_key} NOT IN (
    SELECT {child_key} FROM {child} WHERE {child_key} IS NOT NULL)) AS unused_parent_keys,
  COUNT(*) FILTER (found) / CAST(NULLIF(COUNT(*), 0) AS DOUBLE) AS ratio, COUNT(*) FILTER (NOT found) = 0 AS ok
FROM (SELECT {child_key} AS key, {child_key} IN (SELECT {parent_key} FROM {parent} WHERE {parent_key} IS NOT NULL) AS found
  FROM {child} WHERE {child_key} IS NOT NULL)"""), *REFERENCE_TABLES))
def dq_referential(spark: SparkSession, d: str) -> DataFrame:
    """All declared references of the marketing tables, their orphans and coverage."""
    return presence.coverage(star.tables(spark, d), REFERENCES)


_RULE_SETS = """
SELECT p_brand AS "table", {column} AS "column", kind AS rule_type,
  translate(kind || '-' || {column}, '_', '-') AS rule, {threshold} AS threshold,
  CASE WHEN kind = 'set' THEN list_sort([p_type, p_brand]) END AS vals,
  CASE WHEN kind = 'regex' THEN p_type END AS pattern,
  CASE WHEN kind = 'range' THEN '0|' || p_size || '|' || (p_size % 8 = 3) || '|false' END AS bounds,
  p_partkey AS position
FROM (SELECT *, ['non_null', 'set', 'regex', 'range'][p_size % 4 + 1] AS kind,
        replace(p_name, ' ', '_') AS snake FROM part) q"""
_SHARE = "CAST(p_size % 10 AS DOUBLE) / 10"
_RULE_VIEWS = {
    "declared": _RULE_SETS.format(column="snake", threshold=_SHARE),
    "active": _RULE_SETS.format(
        column="CASE WHEN p_partkey % 11 = 0 THEN 'old_' || snake ELSE snake END",
        threshold=f"CASE WHEN p_partkey % 7 = 0 THEN 1.0 ELSE {_SHARE} END",
    ),
    "diff": """
SELECT COALESCE(w."table", h."table") AS "table", COALESCE(w.rule, h.rule) AS rule,
  COALESCE(w."column", h."column") AS "column",
  CASE WHEN h.rule IS NULL THEN 'add' WHEN w.rule IS NULL THEN 'remove'
    WHEN w.threshold = h.threshold AND w.vals IS NOT DISTINCT FROM h.vals
      AND w.pattern IS NOT DISTINCT FROM h.pattern AND w.bounds IS NOT DISTINCT FROM h.bounds
    THEN 'same' ELSE 'changed' END AS change
FROM (SELECT * FROM declared QUALIFY ROW_NUMBER() OVER (PARTITION BY "table", rule, "column" ORDER BY position DESC) = 1) w
FULL OUTER JOIN
  (SELECT * FROM active QUALIFY ROW_NUMBER() OVER (PARTITION BY "table", rule, "column" ORDER BY position DESC) = 1) h
ON w."table" = h."table" AND w.rule = h.rule AND w."column" = h."column" """,
}


@register("dq_rule_name", with_views(
    'SELECT DISTINCT "column", rule_type, rule FROM active', extra={"active": _RULE_VIEWS["active"]}))
def dq_rule_name(spark: SparkSession, d: str) -> DataFrame:
    from touchmark.functions.scalars import rule_name

    _, active = star.quality_rules(spark, d)
    return active.select(
        "column", "rule_type", rule_name(F.col("rule_type"), F.col("column")).alias("rule")
    ).distinct()


@register("dq_rule_diff", with_views("SELECT * FROM diff", extra=_RULE_VIEWS))
def dq_rule_diff(spark: SparkSession, d: str) -> DataFrame:
    return dq.dq_rule_diff(*star.quality_rules(spark, d))


@register("dq_in_sync", with_views("""
SELECT "table", COUNT(*) FILTER (change <> 'remove') AS declared_count,
  COUNT(*) FILTER (change <> 'add') AS active_count, COUNT(*) FILTER (change = 'add') AS to_add,
  COUNT(*) FILTER (change = 'remove') AS to_remove, COUNT(*) FILTER (change = 'changed') AS changed,
  bool_and(change = 'same') AS in_sync
FROM diff GROUP BY "table" """, extra=_RULE_VIEWS))
def dq_in_sync(spark: SparkSession, d: str) -> DataFrame:
    return dq.dq_in_sync(dq.dq_rule_diff(*star.quality_rules(spark, d)))


# --- profiling -----------------------------------------------------------------------------


def _columns(table: str, kinds: str) -> list[str]:
    return [c for c, kind in TABLE_COLUMNS[table].items() if kind in kinds.split()]


def _each(tables, part) -> str:
    return " UNION ALL ".join(part(t, c) for t in tables for c in TABLE_COLUMNS[t])


def _nulls_sql(table: str) -> str:
    return " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, COUNT(*) FILTER ({c} IS NULL) AS null_count,"
        f" COUNT(*) FILTER ({c} IS NULL) / CAST(COUNT(*) AS DOUBLE) AS null_fraction FROM {table}"
        for c in TABLE_COLUMNS[table]
    )


@register("profile_row_count", " UNION ALL ".join(
    f"SELECT '{t}' AS table_name, COUNT(*) AS row_count,"
    f" CAST({len(TABLE_COLUMNS[t])} AS BIGINT) AS column_count FROM {t}" for t in TABLES))
def profile_row_count(spark: SparkSession, d: str) -> DataFrame:
    first, *rest = [
        profile.row_count(df).select(F.lit(t).alias("table_name"), "*")
        for t, df in _all_tables(spark, d).items()
    ]
    for part in rest:
        first = first.unionByName(part)
    return first


@register("profile_nulls", with_views(" UNION ALL ".join(
    f"SELECT '{c}' AS column_name, COUNT(*) FILTER ({c} IS NULL) AS null_count,"
    f" COUNT(*) FILTER ({c} IS NULL) / CAST(COUNT(*) AS DOUBLE) AS null_fraction FROM pixel_events"
    for c in ("event_id", "event_type", "cookie_id", "campaign_id", "creative_id", "channel",
              "country_code", "device_type", "spend_usd", "event_ts", "event_date",
              "partition_date")), "pixel_events"))
def profile_nulls(spark: SparkSession, d: str) -> DataFrame:
    return profile.nulls(star.pixel_events(spark, d))


@register("profile_distinct", " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, COUNT(DISTINCT {c}) AS distinct_count FROM lineitem"
    for c in TABLE_COLUMNS["lineitem"]))
def profile_distinct(spark: SparkSession, d: str) -> DataFrame:
    return profile.distinct(load(spark, d, "lineitem"))


@register("profile_distinct_approx", " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, COUNT(DISTINCT {c}) AS distinct_count, TRUE AS estimate_is_close FROM lineitem"
    for c in TABLE_COLUMNS["lineitem"]))
def profile_distinct_approx(spark: SparkSession, d: str) -> DataFrame:
    """The estimate next to the exact count: within four of its standard errors of 5 %."""
    rows = load(spark, d, "lineitem")
    estimated = profile.distinct(rows, approximate=True).withColumnRenamed("distinct_count", "estimate")
    close = F.abs(F.col("estimate") - F.col("distinct_count")) <= 0.2 * F.col("distinct_count")
    return profile.distinct(rows).join(estimated, "column_name").select(
        "column_name", "distinct_count", close.alias("estimate_is_close")
    )


@register("profile_sketches", " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, COUNT(*) AS row_count, COUNT(*) - COUNT({c}) AS null_count,"
    f" COUNT(DISTINCT {c}) AS distinct_count, TRUE AS estimate_is_close FROM lineitem"
    for c in TABLE_COLUMNS["lineitem"]))
def profile_sketches(spark: SparkSession, d: str) -> DataFrame:
    """Profiles of four runs, one of them written twice, merged from ``lineitem_profile`` next to the exact counts."""
    rows, path = load(spark, d, "lineitem"), new_path(spark, "profiles")
    for run in (0, 1, 2, 3, 1):
        part = rows.filter(F.col("l_orderkey") % 4 == run)
        append_profile(part, path, "lineitem", f"run-{run}", dt.datetime(2024, 2, 1 + run))
    merged = merged_profile(spark, path, "lineitem")
    close = F.abs(F.col("distinct_estimate") - F.col("distinct_count")) <= F.ceil(4 * ERROR * F.col("distinct_count"))
    return merged.join(profile.distinct(rows), "column_name").select(
        "column_name", "row_count", "null_count", "distinct_count", close.alias("estimate_is_close")
    )


def _min_max_sql(table: str) -> str:
    parts = []
    for c, kind in TABLE_COLUMNS[table].items():
        if kind == "nested":
            continue
        number = kind in ("integer", "double")
        text = f"strftime({c}, '%Y-%m-%d %H:%M:%S.%f')" if kind == "time" else c
        none = "CAST(NULL AS DOUBLE)", "CAST(NULL AS VARCHAR)"
        lo, hi = f"CAST(MIN({c}) AS DOUBLE)", f"CAST(MAX({c}) AS DOUBLE)"
        parts.append(
            f"SELECT '{c}' AS column_name, {lo if number else none[0]} AS min_number,"
            f" {hi if number else none[0]} AS max_number,"
            f" {none[1] if number else f'MIN({text})'} AS min_text,"
            f" {none[1] if number else f'MAX({text})'} AS max_text FROM {table}"
        )
    return " UNION ALL ".join(parts)


@register("profile_min_max", _min_max_sql("orders"))
def profile_min_max(spark: SparkSession, d: str) -> DataFrame:
    return profile.min_max(load(spark, d, "orders"))


#: Columns of the event table by kind, as the SQL spells their values.
_EVENT_COLUMNS = {
    "event_id": "integer", "event_type": "string", "cookie_id": "integer", "campaign_id": "integer",
    "creative_id": "integer", "channel": "string", "country_code": "string", "device_type": "string",
    "spend_usd": "decimal", "event_ts": "time", "event_date": "date", "partition_date": "date",
}


def _top_sql(table: str, columns: dict[str, str], n: int) -> str:
    text = lambda c, kind: f"strftime({c}, '%Y-%m-%d %H:%M:%S.%f')" if kind == "time" else f"CAST({c} AS VARCHAR)"
    counts = " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, {text(c, kind)} AS value, COUNT(*) AS value_count"
        f" FROM {table} WHERE {c} IS NOT NULL GROUP BY {c}"
        for c, kind in columns.items()
    )
    return f"""
SELECT * FROM (SELECT *, CAST(ROW_NUMBER() OVER (PARTITION BY column_name
    ORDER BY value_count DESC, value) AS INTEGER) AS value_rank FROM ({counts}))
WHERE value_rank <= {n}"""


@register("profile_top_n", _top_sql("lineitem", TABLE_COLUMNS["lineitem"], 5))
def profile_top_n(spark: SparkSession, d: str) -> DataFrame:
    return heavy.top_n(load(spark, d, "lineitem"), 5)


@register("topn_per_column", with_views(_top_sql("pixel_events", _EVENT_COLUMNS, 3), "pixel_events"))
def topn_per_column(spark: SparkSession, d: str) -> DataFrame:
    return heavy.top_n(star.pixel_events(spark, d), 3)


@register("topn_documents", _top_sql("documents", TABLE_COLUMNS["documents"], 4))
def topn_documents(spark: SparkSession, d: str) -> DataFrame:
    """Long texts are counted by their hash and shown whole."""
    return heavy.top_n(load(spark, d, "documents"), 4)


_NUMBERS = _columns("lineitem", "integer double")


@register("profile_histogram", " UNION ALL ".join(f"""
SELECT '{c}' AS column_name, bucket, MIN(low + bucket * width) AS bucket_low, COUNT(*) AS value_count
FROM (SELECT low, (high - low) / 10 AS width, CAST(LEAST(COALESCE(FLOOR((v - low)
        / NULLIF((high - low) / 10, 0)), 0), 9) AS INTEGER) AS bucket
      FROM (SELECT CAST({c} AS DOUBLE) AS v FROM lineitem) a,
           (SELECT CAST(MIN({c}) AS DOUBLE) AS low, CAST(MAX({c}) AS DOUBLE) AS high FROM lineitem) b)
GROUP BY bucket""" for c in _NUMBERS))
def profile_histogram(spark: SparkSession, d: str) -> DataFrame:
    return profile.histogram(load(spark, d, "lineitem"), 10, _NUMBERS)


@register("profile_distribution", " UNION ALL ".join(f"""
SELECT '{c}' AS column_name, COUNT({c}) AS value_count, round(AVG(CAST({c} AS DOUBLE)), 4) AS mean,
  round(STDDEV_SAMP(CAST({c} AS DOUBLE)), 4) AS stddev,
  round(quantile_cont(CAST({c} AS DOUBLE), 0.25), 6) AS q1,
  round(quantile_cont(CAST({c} AS DOUBLE), 0.5), 6) AS q2,
  round(quantile_cont(CAST({c} AS DOUBLE), 0.75), 6) AS q3 FROM lineitem""" for c in _NUMBERS))
def profile_distribution(spark: SparkSession, d: str) -> DataFrame:
    found = profile.distribution(load(spark, d, "lineitem"), _NUMBERS)
    return found.select(
        "column_name", "value_count",
        *[F.round(c, 4).alias(c) for c in ("mean", "stddev")],
        *[F.round(c, 6).alias(c) for c in ("q1", "q2", "q3")],
    )


def _anomaly_sql(table: str, columns: dict[str, str]) -> str:
    parts = [f"""
SELECT '{c}' AS column_name, CASE WHEN MIN(v) IS NULL THEN 'all_null' WHEN MIN(v) = MAX(v)
    THEN 'constant' WHEN COUNT(*) FILTER (v < lo OR v > hi) > 0 THEN 'outliers' END AS anomaly,
  COUNT(*) FILTER (v < lo OR v > hi) AS outlier_count
FROM (SELECT CAST({expression} AS DOUBLE) AS v FROM {table}) a,
  (SELECT q1 - (q3 - q1) * 1.5 AS lo, q3 + (q3 - q1) * 1.5 AS hi FROM (
     SELECT quantile_cont(CAST({expression} AS DOUBLE), 0.25) AS q1,
       quantile_cont(CAST({expression} AS DOUBLE), 0.75) AS q3 FROM {table})) b"""
        for c, expression in columns.items()]
    return f"SELECT * FROM ({' UNION ALL '.join(parts)}) WHERE anomaly IS NOT NULL"


@register("profile_anomalies", with_views(_anomaly_sql("pixel_events", {
    c: c for c, kind in _EVENT_COLUMNS.items() if kind in ("integer", "decimal")}), "pixel_events"))
def profile_anomalies(spark: SparkSession, d: str) -> DataFrame:
    return profile.anomalies(star.pixel_events(spark, d))


def _profile_sql(table: str) -> str:
    counts = " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, COUNT(DISTINCT {c}) AS distinct_count FROM {table}"
        for c in TABLE_COLUMNS[table]
    )
    return f"""
SELECT '{table}' AS table_name, n.column_name, null_count, null_fraction, distinct_count,
  min_number, max_number, min_text, max_text
FROM ({_nulls_sql(table)}) n JOIN ({counts}) c ON c.column_name = n.column_name
LEFT JOIN ({_min_max_sql(table)}) m ON m.column_name = n.column_name"""


@register("profile_all", " UNION ALL ".join(_profile_sql(t) for t in TABLES))
def profile_all(spark: SparkSession, d: str) -> DataFrame:
    return profile.profile_all(_all_tables(spark, d))


# --- keys and relationships ----------------------------------------------------------------

@register("discover_primary_keys", with_views(
    "SELECT table_name, column_name, row_count FROM pk", extra=discovery_views(TABLE_COLUMNS)))
def discover_primary_keys(spark: SparkSession, d: str) -> DataFrame:
    return discover.primary_keys(_all_tables(spark, d))


@register("discover_foreign_keys", with_views("SELECT * FROM fk", extra=discovery_views(TABLE_COLUMNS, 0.9)))
def discover_foreign_keys(spark: SparkSession, d: str) -> DataFrame:
    return discover.foreign_keys(_all_tables(spark, d), min_coverage=0.9)


@register("relationship_graph", with_views("""
SELECT parent_table, child_table, COUNT(*) AS column_pairs,
  CASE WHEN bool_or(child_unique) THEN 'one-to-one' ELSE 'one-to-many' END AS cardinality,
  MAX(fill_rate) AS fill_rate
FROM fk GROUP BY parent_table, child_table""", extra=discovery_views(TABLE_COLUMNS)))
def relationship_graph(spark: SparkSession, d: str) -> DataFrame:
    return discover.relationship_graph(discover.foreign_keys(_all_tables(spark, d)))


@register("dataset_overview", with_views(
    f"SELECT 'tables' AS measure, CAST({len(TABLES)} AS BIGINT) AS value UNION ALL "
    f"SELECT 'columns', {sum(len(c) for c in TABLE_COLUMNS.values())} UNION ALL SELECT 'rows', "
    + " + ".join(f"(SELECT COUNT(*) FROM {t})" for t in TABLES)
    + " UNION ALL SELECT 'joinable_pairs', (SELECT COUNT(*) FROM fk)", extra=discovery_views(TABLE_COLUMNS)))
def dataset_overview(spark: SparkSession, d: str) -> DataFrame:
    return discover.dataset_overview(_all_tables(spark, d))


_SYNONYMS = [("visitor_id", "cookie_id"), ("device_id", "cookie_id"), ("hashed_email", "hem"),
             ("audience_id", "cookie_id")]


@register("synonym_columns_check", with_views(" UNION ALL ".join(
    f"SELECT '{a}' AS column_name, '{b}' AS synonym_of,"
    f" COUNT(*) FILTER ({a} IS DISTINCT FROM {b}) AS mismatches FROM cookie_registry"
    for a, b in _SYNONYMS), "cookie_registry"))
def synonym_columns_check(spark: SparkSession, d: str) -> DataFrame:
    return discover.synonym_columns_check(star.cookie_registry(spark, d), _SYNONYMS)


_SAME_TYPE = [("cookie_id", "visitor_id"), ("cookie_id", "device_id"), ("cookie_id", "audience_id"),
              ("visitor_id", "device_id"), ("visitor_id", "audience_id"),
              ("device_id", "audience_id"), ("hem", "hashed_email"), ("hem", "device_type"),
              ("hashed_email", "device_type")]


@register("synonym_columns_discover", with_views(
    "SELECT column_a, column_b FROM (" + " UNION ALL ".join(
        f"SELECT '{a}' AS column_a, '{b}' AS column_b,"
        f" bool_and({a} IS NOT DISTINCT FROM {b}) AND COUNT({a}) > 0 AS same FROM cookie_registry"
        for a, b in _SAME_TYPE) + ") WHERE same", "cookie_registry"))
def synonym_columns_discover(spark: SparkSession, d: str) -> DataFrame:
    return discover.synonym_columns_discover(star.cookie_registry(spark, d))


@register("sink_scan_results", with_views(f"""
SELECT rule, column_name, dimension, threshold, evaluated, passed, ratio, ok, table_name, run_id,
  scanned_at
FROM ({_scan_sql("pixel_events", RULES["pixel_events"])}) s CROSS JOIN (VALUES
  ('run-1', TIMESTAMP '2024-02-01'), ('run-2', TIMESTAMP '2024-02-02')) r(run_id, scanned_at)""",
    "pixel_events"))
def sink_scan_results(spark: SparkSession, d: str) -> DataFrame:
    """Two runs appended, the first written twice: it is there once."""
    path = new_path(spark, "dq-results")
    scan = _scan_query(_EVENT_RULES)(spark, d)
    for run, day in (("run-1", 1), ("run-1", 1), ("run-2", 2)):
        append_scan_results(scan, path, run, dt.datetime(2024, 2, day))
    stored = spark.read.parquet(path)
    return stored.withColumn("scanned_at", F.col("scanned_at").cast("timestamp_ntz"))


assert set(RULES) <= set(VIEWS)
