"""Queries over readers, writers and streams."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from touchmark.operators import marts
from touchmark.plans.measures import PERFORMANCE_SQL
from touchmark.plans.oracle_views import with_views
from touchmark.plans.registry import register
from touchmark.session import new_path
from touchmark.sources import sinks, star
from touchmark.sources import tables as src
from touchmark.streaming import ctr as stream

_TEN_DAYS = 10 * 24 * 60
AS_OF = dt.datetime(2024, 1, 31, tzinfo=dt.timezone.utc)


@register("scan_table", "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders")
def scan_table(spark: SparkSession, d: str) -> DataFrame:
    return src.load(spark, d, "orders").select(
        "o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice"
    )


@register("scan_partition_range", """
SELECT event_id, event_type, CAST(ts AS DATE) AS partition_date FROM events
WHERE ts >= DATE '2024-01-08' AND ts < DATE '2024-01-15'""")
def scan_partition_range(spark: SparkSession, d: str) -> DataFrame:
    """One week of a day-partitioned copy of the events; only its folders are read."""
    path = new_path(spark, "events-by-day")
    events = src.load(spark, d, "events").withColumn("partition_date", F.to_date("ts"))
    # One file per day and task would be many small files: bring a day's rows together first,
    # with a few tasks per day so that a heavy day is not written by one task.
    spread = F.pmod(F.xxhash64("event_id"), F.lit(4))
    events = events.repartition("partition_date", spread)
    events.write.partitionBy("partition_date").parquet(path)
    week = src.load_range(
        spark.read.parquet(path), "partition_date", dt.date(2024, 1, 8), dt.date(2024, 1, 15)
    )
    return week.select("event_id", "event_type", "partition_date")


@register("scan_with_file", "SELECT p_partkey, 'part.parquet' AS source_file FROM part")
def scan_with_file(spark: SparkSession, d: str) -> DataFrame:
    """The file of each row, without its folder."""
    rows = src.with_file(src.load(spark, d, "part"))
    return rows.select("p_partkey", F.substring_index("source_file", "/", -1).alias("source_file"))


#: Events arrive up to three days late: a day's batch holds events of four days.
_LATENESS = 4


@register("scan_appends", with_views(f"""
SELECT event_id, event_ts, CAST(CAST(event_ts AS DATE) + CAST(event_id % {_LATENESS} AS INTEGER) AS DATE) AS arrived_on
FROM pixel_events WHERE CAST(event_ts AS DATE) + CAST(event_id % {_LATENESS} AS INTEGER) > DATE '2024-01-21'
  AND CAST(event_ts AS DATE) + CAST(event_id % {_LATENESS} AS INTEGER) <= DATE '2024-01-31'""", "pixel_events"))
def scan_appends(spark: SparkSession, d: str) -> DataFrame:
    """What arrived in ten days, by the stamp of its batch: late events are found, older batches not opened."""
    path, day = new_path(spark, "events-by-arrival"), F.to_date("event_ts")
    arrived = F.date_add(day, (F.col("event_id") % _LATENESS).cast("int"))
    events = star.pixel_events(spark, d).select("event_id", "event_ts", src.stamp(arrived.cast("timestamp")).alias("arrived"))
    # A batch's rows together, with a few tasks each, as a writer of batches would have them.
    src.append_stamped(events.repartition("arrived", F.pmod(F.xxhash64("event_id"), F.lit(4))), path)
    table = spark.read.schema("event_id long, event_ts timestamp, arrived string").parquet(path)
    recent = src.arrivals(table, AS_OF, _TEN_DAYS)
    return recent.select(
        "event_id", F.col("event_ts").cast("timestamp_ntz").alias("event_ts"),
        F.to_date(F.substring("arrived", 1, 8), "yyyyMMdd").alias("arrived_on"),
    )


_CTR = """
SELECT {keys}campaign_id, channel, country_code,
  COUNT(*) FILTER (event_type = 'impression') AS impressions,
  COUNT(*) FILTER (event_type = 'click') AS clicks,
  COUNT(*) FILTER (event_type = 'click')
    / CAST(NULLIF(COUNT(*) FILTER (event_type = 'impression'), 0) AS DOUBLE) AS ctr,
  MIN(event_ts) AS window_start, MAX(event_ts) AS window_end
FROM pixel_events {where} GROUP BY {groups}campaign_id, channel, country_code"""
_BUCKET = (
    "time_bucket(INTERVAL 10 MINUTE, event_ts) AS bucket_start,"
    " time_bucket(INTERVAL 10 MINUTE, event_ts) + INTERVAL 10 MINUTE AS bucket_end, "
)
_WINDOWED = _CTR.format(
    keys=_BUCKET, groups="time_bucket(INTERVAL 10 MINUTE, event_ts), ", where=""
)


def _plain(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c in columns})


@register("ctr_batch", with_views(_CTR.format(
    keys="", groups="", where="WHERE event_ts > TIMESTAMP '2024-01-21' AND event_ts <= TIMESTAMP '2024-01-31'"),
    "pixel_events"))
def ctr_batch(spark: SparkSession, d: str) -> DataFrame:
    recent = src.appends(star.pixel_events(spark, d), AS_OF, _TEN_DAYS)
    return _plain(stream.ctr(recent), "window_start", "window_end")


_TIMES = ("bucket_start", "bucket_end", "window_start", "window_end")


@register("stream_ctr_batch_twin", with_views(_WINDOWED, "pixel_events"))
def stream_ctr_batch_twin(spark: SparkSession, d: str) -> DataFrame:
    return _plain(stream.windowed_ctr(star.pixel_events(spark, d)), *_TIMES)


def _event_stream(spark: SparkSession, d: str) -> DataFrame:
    return star.shape_pixel_events(src.load_stream(spark, d, "events"))


@register("stream_ctr", with_views(f"""
SELECT * FROM ({_WINDOWED}) w
WHERE bucket_end <= (SELECT MAX(event_ts) - INTERVAL 10 MINUTE FROM pixel_events)""",
    "pixel_events"))
def stream_ctr(spark: SparkSession, d: str) -> DataFrame:
    """The stream drained: all windows the watermark has closed."""
    found = stream.drain(
        stream.windowed_ctr(_event_stream(spark, d)),
        new_path(spark, "ctr"), new_path(spark, "ctr-checkpoint"),
    )
    return _plain(found.drop("batch_id"), *_TIMES)


@register("stream_dedup", with_views(
    "SELECT event_id, event_type, campaign_id FROM pixel_events", "pixel_events"))
def stream_dedup(spark: SparkSession, d: str) -> DataFrame:
    """Every event sent twice, and written once."""
    twice = _event_stream(spark, d).withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2))))
    found = stream.drain(
        stream.dedup(twice.drop("copy")).select("event_id", "event_type", "campaign_id"),
        new_path(spark, "dedup"), new_path(spark, "dedup-checkpoint"),
    )
    return found.drop("batch_id")


@register("stream_sink_idempotent", with_views(
    _CTR.format(keys="", groups="", where=""), "pixel_events"))
def stream_sink_idempotent(spark: SparkSession, d: str) -> DataFrame:
    """One batch written twice under the same id leaves its rows once."""
    path = new_path(spark, "replayed")
    write = stream.batch_writer(path)
    rates = stream.ctr(star.pixel_events(spark, d))
    write(rates, 0)
    write(rates, 0)
    stored = spark.read.parquet(path).drop("batch_id")
    return _plain(stored, "window_start", "window_end")


@register("sink_stream_append", with_views("""
SELECT event_id, channel, campaign_id FROM pixel_events""", "pixel_events"))
def sink_stream_append(spark: SparkSession, d: str) -> DataFrame:
    """A row-wise stream appended to a table."""
    found = stream.drain(
        _event_stream(spark, d).select("event_id", "channel", "campaign_id"),
        new_path(spark, "appended"), new_path(spark, "appended-checkpoint"),
    )
    return found.drop("batch_id")


@register("sink_model", with_views(PERFORMANCE_SQL, "campaigns", "pixel_events"))
def sink_model(spark: SparkSession, d: str) -> DataFrame:
    """The campaign mart as a table, read back."""
    mart = marts.campaign_performance(star.campaigns(spark, d), star.pixel_events(spark, d))
    path = new_path(spark, "campaign-performance")
    name = "touchmark_" + path.rsplit("-", 1)[-1]
    sinks.save_model(mart, name, path)
    money = ("budget_usd", "actual_spend_usd")
    return spark.table(name).withColumns({c: F.col(c).cast("double") for c in money})
