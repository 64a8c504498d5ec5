"""The six marketing tables, and a metadata catalog, over the star-schema test tables.

Every row of the test tables takes part: campaigns are parts, cookies are customers, events are
split into pixel events and (purchases) transactions. Identity keys are left NULL for a share of
the rows, as in production.
"""

from __future__ import annotations

import datetime as dt
from decimal import Decimal

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from touchmark.functions.scalars import hash_email
from touchmark.sources.tables import load

MONEY = "decimal(18,2)"
CHANNELS = ("meta", "youtube", "tiktok", "display", "ctv", "search")
SEGMENTS = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD")


def _pick(index: Column, values: tuple[str, ...]) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index + 1).cast("int"))


def _audience_id() -> Column:
    segment = F.lit(len(SEGMENTS))
    for i, name in enumerate(SEGMENTS):
        segment = F.when(F.col("c_mktsegment") == name, i).otherwise(segment)
    return (F.col("c_nationkey") * 10 + segment).cast("bigint")


def _utc(ts: str) -> Column:
    return F.col(ts).cast("timestamp")


def campaigns(spark: SparkSession, directory: str) -> DataFrame:
    part = load(spark, directory, "part")
    nation = load(spark, directory, "nation")
    key, size = F.col("p_partkey"), F.col("p_size")
    budget = F.col("p_retailprice").cast(MONEY)
    start = F.date_add(F.lit(dt.date(2023, 10, 1)), size)
    return part.join(nation, F.col("n_nationkey") == key % 25).select(
        key.alias("campaign_id"),
        F.col("p_name").alias("campaign_name"),
        F.col("p_brand").alias("brand"),
        F.col("p_brand").alias("advertiser"),
        F.col("p_type").alias("product_category"),
        F.col("n_name").alias("country_code"),
        F.array(_pick(size % 6, CHANNELS), _pick((size + 1) % 6, CHANNELS)).alias("channels"),
        _pick(size % 4, ("awareness", "consideration", "conversion", "retention")).alias(
            "objective"
        ),
        budget.alias("budget_usd"),
        F.when(key % 25 == 0, F.lit(Decimal("0.00")))
        .otherwise((budget * F.lit(Decimal("0.5"))).cast(MONEY))
        .cast(MONEY)
        .alias("actual_spend_usd"),
        start.alias("start_date"),
        F.date_add(start, (key % 90 + 30).cast("int")).alias("end_date"),
        _pick(key % 4, ("planned", "active", "completed", "paused")).alias("status"),
    )


def creatives(spark: SparkSession, directory: str) -> DataFrame:
    owner = campaigns(spark, directory)
    tags = F.split(F.concat_ws(" ", "campaign_name", F.lower("product_category")), " ")
    return owner.select("*", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("k")).select(
        (F.col("campaign_id") * 3 + F.col("k")).alias("creative_id"),
        "campaign_id",
        F.concat_ws(" ", "brand", _pick(F.col("k"), ("video", "film", "banner")), "campaign_name")
        .alias("creative_name"),
        _pick(F.col("k"), ("video_15s", "video_30s", "static_banner")).alias("format"),
        _pick((F.col("campaign_id") + F.col("k")) % 6, CHANNELS).alias("channel"),
        F.when(F.col("k") == 0, 15).when(F.col("k") == 1, 30).alias("duration_seconds"),
        "brand",
        F.array_distinct(tags).alias("theme_tags"),
    )


def shape_pixel_events(events: DataFrame) -> DataFrame:
    """Row-wise, so it serves a static table and a stream alike."""
    event_id, kind = F.col("event_id"), F.col("event_type")
    number = F.regexp_extract("props", "([0-9]+)", 1).cast("bigint")
    video = (
        F.when(event_id % 8 < 3, "video_start")
        .when(event_id % 8 < 5, "video_q1")
        .when(event_id % 8 == 5, "video_q2")
        .when(event_id % 8 == 6, "video_q3")
        .otherwise("video_complete")
    )
    day = F.to_date(_utc("ts"))
    return events.filter(kind != "purchase").select(
        "event_id",
        F.when(kind == "view", "impression")
        .when(kind == "click", "click")
        .when(kind == "signup", "engagement")
        .otherwise(video)
        .alias("event_type"),
        F.when(event_id % 100 >= 18, F.col("user_id")).alias("cookie_id"),
        number.alias("campaign_id"),
        (number * 3 + event_id % 3).alias("creative_id"),
        _pick(event_id % 6, CHANNELS).alias("channel"),
        F.concat(F.lit("NATION_"), (F.col("user_id") % 25).cast("string")).alias("country_code"),
        _pick(event_id % 4, ("desktop", "mobile", "tablet", "ctv")).alias("device_type"),
        F.when(kind == "view", F.col("value")).otherwise(0.0).cast(MONEY).alias("spend_usd"),
        _utc("ts").alias("event_ts"),
        day.alias("event_date"),
        day.alias("partition_date"),
    )


def pixel_events(spark: SparkSession, directory: str) -> DataFrame:
    return shape_pixel_events(load(spark, directory, "events"))


def transactions(spark: SparkSession, directory: str) -> DataFrame:
    buys = load(spark, directory, "events").filter(F.col("event_type") == "purchase")
    customer = load(spark, directory, "customer")
    nation = load(spark, directory, "nation")
    event_id = F.col("event_id")
    rows = buys.join(customer, F.col("c_custkey") == F.col("user_id")).join(
        nation, F.col("n_nationkey") == F.col("c_nationkey")
    )
    return rows.select(
        event_id.alias("txn_id"),
        F.col("user_id").alias("pan_token"),
        F.when(event_id % 10 < 3, F.col("user_id")).alias("cookie_id"),
        F.when(event_id % 4 == 0, hash_email(F.col("c_name"))).alias("hem"),
        F.concat(F.lit("merchant "), (F.col("user_id") % 40).cast("string")).alias("merchant_name"),
        (F.col("user_id") % 20 + 5000).cast("string").alias("merchant_category_code"),
        F.when(
            event_id % 5 != 0, F.concat(F.lit("Brand#"), (event_id % 25 + 1).cast("string"))
        ).alias("brand"),
        F.col("value").cast(MONEY).alias("amount_usd"),
        F.col("n_name").alias("country_code"),
        _pick(event_id % 3, ("in_store", "online", "contactless")).alias("channel"),
        _utc("ts").alias("txn_ts"),
        F.to_date(_utc("ts")).alias("partition_date"),
    )


def cookie_registry(spark: SparkSession, directory: str) -> DataFrame:
    key = F.col("c_custkey")
    hem = F.when(key % 20 < 7, hash_email(F.col("c_name")))
    return load(spark, directory, "customer").select(
        key.alias("cookie_id"),
        key.alias("visitor_id"),
        key.alias("device_id"),
        F.when(key % 10 < 4, _audience_id()).alias("audience_id"),
        hem.alias("hem"),
        hem.alias("hashed_email"),
        _pick(key % 4, ("desktop", "mobile", "tablet", "ctv")).alias("device_type"),
    )


def audience(spark: SparkSession, directory: str) -> DataFrame:
    nation = load(spark, directory, "nation")
    groups = (
        load(spark, directory, "customer")
        .withColumn("audience_id", _audience_id())
        .groupBy("audience_id", "c_nationkey", "c_mktsegment")
        .agg(F.count("*").alias("panel_weight"), F.min("c_name").alias("member"))
    )
    n = F.col("c_nationkey")
    ratio = lambda shift: ((n + shift) % 5).cast("double") / 2
    return groups.join(nation, F.col("n_nationkey") == n).select(
        "audience_id",
        F.col("c_mktsegment").alias("segment_name"),
        F.col("n_name").alias("country_code"),
        _pick(n % 5, ("18-24", "25-34", "35-44", "45-54", "55+")).alias("age_band"),
        _pick(n % 4, ("M", "F", "NB", "Unknown")).alias("gender"),
        _pick(n % 3, ("Low", "Mid", "High")).alias("income_band"),
        F.create_map(
            F.lit("meta"), ratio(0), F.lit("tiktok"), ratio(1), F.lit("youtube"), ratio(2)
        ).alias("channel_index"),
        F.create_map(
            F.lit("Brand#1"), ((n % 10).cast("double") / 10),
            F.lit("Brand#2"), ((n % 7).cast("double") / 8),
        ).alias("brand_affinity_scores"),
        F.when(n % 5 < 3, hash_email(F.col("member"))).alias("hem"),
        n.cast("double").alias("lat"),
        n.cast("double").alias("location_lat"),
        F.col("panel_weight").cast("double").alias("panel_weight"),
    )


def tables(spark: SparkSession, directory: str) -> dict[str, DataFrame]:
    makers = (audience, cookie_registry, campaigns, creatives, pixel_events, transactions)
    return {make.__name__: make(spark, directory) for make in makers}


# --- metadata derived from the same tables -------------------------------------------------


def catalog_entries(spark: SparkSession, directory: str) -> DataFrame:
    """One described catalog entry per part, its fields nested in a schema aspect.

    Parts are a small file whose rows fan out into wide ones, so they are dealt to tasks first.
    """
    brand = F.lower(F.regexp_replace("p_brand", "#", "_"))
    kind = F.lower("p_type")
    path = F.concat(
        F.lit("catalog.example.com/projects/demo/locations/us/catalogs/lake/namespaces/"),
        brand, F.lit("/tables/"), kind, F.lit("_"), F.col("p_partkey").cast("string"),
    )
    field = lambda name, text: F.struct(name.alias("name"), text.alias("description"))
    fields = F.array(
        field(
            F.translate("p_name", " ", "_"),
            F.when(F.col("p_size") % 3 != 0, F.concat(F.lit("Stock of "), F.col("p_name"))),
        ),
        field(
            F.concat(kind, F.lit("_size")),
            F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("Size class "), kind)),
        ),
        field(F.concat(brand, F.lit("-Price")), F.lit("Listed price")),
    )
    return load(spark, directory, "part").repartition("p_partkey").select(
        F.concat(
            F.lit("projects/demo/locations/us/entryGroups/@lake/entries/"), path
        ).alias("name"),
        F.lit("table").alias("entry_type"),
        F.concat(F.lit("tables.example.com/projects/demo/tables/"), kind).alias("resource"),
        F.create_map(
            F.lit("demo.us.schema"), F.struct(F.struct(fields.alias("fields")).alias("data"))
        ).alias("aspects"),
        F.col("p_partkey").alias("table_ord"),
    )


def glossary_tree(spark: SparkSession, directory: str, owner: str = "nation") -> DataFrame:
    """One glossary per row of ``owner`` (nation or supplier), categories and terms nested.

    Four terms each: one named like a column, one described as a synonym of it, one whose
    description must be matched word by word, and one known by its synonym list only.
    """
    prefix = owner[0]
    key = f"{prefix}_nationkey" if owner == "nation" else f"{prefix}_suppkey"
    own = load(spark, directory, owner)
    rows = own.join(load(spark, directory, "part"), F.col("p_partkey") == F.col(key))
    if owner != "nation":
        rows = rows.join(
            load(spark, directory, "nation"), F.col("n_nationkey") == F.col("s_nationkey")
        )
    number = F.col(key).cast("string")
    snake = F.translate("p_name", " ", "_")
    kind = F.lower("p_type")
    none = F.array().cast("array<string>")

    def term(name, display, description, synonyms, related, table_names):
        return F.struct(
            name.alias("name"), display.alias("display_name"), description.alias("description"),
            synonyms.alias("synonyms"), related.alias("related"), table_names.alias("tables"),
            F.lit("stock").alias("business_context"),
        )

    hyphened = F.translate(F.initcap("p_name"), " ", "-")
    first = F.array(
        term(
            F.lower(hyphened), hyphened, F.concat(F.lit("Stock of "), F.col("p_name")),
            F.array(F.concat(F.lit("alt_"), snake), F.concat(F.lit("Item "), number)),
            F.array(F.concat(kind, F.lit(" range"))), F.array(kind, F.lit("stock")),
        ),
        term(
            F.concat(F.lit("alias-"), number), F.concat(F.lit("Alias "), number),
            F.concat(F.lit("Synonym for "), snake), none, none, F.array(kind),
        ),
    )
    second = F.array(
        term(
            F.concat(F.lit("metric-"), number), F.concat(F.lit("Metric "), number),
            F.concat(
                F.lit("Share of the "), F.col("p_name"), F.lit(" in "), kind, F.lit(" and "),
                F.col("p_name"), F.lit(" per "), snake,
            ),
            none, F.array(F.concat(F.lit("Alias "), number)), F.array(kind, F.lit("sales")),
        ),
        term(
            F.concat(F.lit("code-"), number), F.concat(F.lit("Code "), number), F.lit(""),
            F.array(F.concat(F.lit("alias "), number), snake), none, none,
        ),
    )

    def category(name, display, terms):
        return F.struct(name.alias("name"), display.alias("display_name"), terms.alias("terms"))

    region = F.translate(F.lower("n_name"), "_", "-")
    return rows.select(
        F.concat(F.lit("glossary-"), number).alias("glossary_id"),
        F.col(key).cast("bigint").alias("glossary_ord"),
        F.array(
            category(region, F.col("n_name"), first),
            category(F.lit("marketing-metrics"), F.lit("Marketing Metrics"), second),
        ).alias("categories"),
    )


def quality_rules(spark: SparkSession, directory: str) -> tuple[DataFrame, DataFrame]:
    """Declared and active rule sets, one rule per part and table."""
    key, size = F.col("p_partkey"), F.col("p_size")
    snake = F.translate("p_name", " ", "_")
    kind = _pick(size % 4, ("non_null", "set", "regex", "range"))
    base = load(spark, directory, "part")

    def rules(column: Column, threshold: Column, values: Column) -> DataFrame:
        return base.select(
            F.col("p_brand").alias("table"),
            column.alias("column"),
            kind.alias("rule_type"),
            threshold.alias("threshold"),
            F.lit("COMPLETENESS").alias("dimension"),
            values.alias("values"),
            F.col("p_type").alias("pattern"),
            F.lit("0").alias("min_value"),
            size.cast("string").alias("max_value"),
            (size % 8 == 3).alias("strict_min_enabled"),
            F.lit(False).alias("strict_max_enabled"),
            key.alias("position"),
        )

    share = (size % 10).cast("double") / 10
    declared = rules(snake, share, F.array("p_type", "p_brand"))
    active = rules(
        F.when(key % 11 == 0, F.concat(F.lit("old_"), snake)).otherwise(snake),
        F.when(key % 7 == 0, 1.0).otherwise(share),
        F.array("p_brand", "p_type"),
    )
    return declared, active
