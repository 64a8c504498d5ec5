"""Click-through rate over the latest appends, in batch and as a stream."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from touchmark.functions.scalars import safe_divide

KEYS = ("campaign_id", "channel", "country_code")


def ctr(events: DataFrame, *extra_keys) -> DataFrame:
    """Impressions, clicks, their ratio (not times 100) and the observed time bounds."""
    clicks = F.count_if(F.col("event_type") == "click")
    impressions = F.count_if(F.col("event_type") == "impression")
    return events.groupBy(*KEYS, *extra_keys).agg(
        impressions.alias("impressions"),
        clicks.alias("clicks"),
        safe_divide(clicks, impressions).alias("ctr"),
        F.min("event_ts").alias("window_start"),
        F.max("event_ts").alias("window_end"),
    )


def windowed_ctr(
    events: DataFrame, *, width: str = "10 minutes", watermark: str = "10 minutes"
) -> DataFrame:
    """The same per tumbling window; works on a stream and on a static table."""
    source = events.withWatermark("event_ts", watermark) if events.isStreaming else events
    return ctr(source, F.window("event_ts", width).alias("bucket")).select(
        F.col("bucket.start").alias("bucket_start"),
        F.col("bucket.end").alias("bucket_end"),
        *KEYS, "impressions", "clicks", "ctr", "window_start", "window_end",
    )


def dedup(events: DataFrame, *, key: str = "event_id", watermark: str = "10 minutes") -> DataFrame:
    """One row per key, remembering keys only as long as the watermark allows."""
    return events.withWatermark("event_ts", watermark).dropDuplicatesWithinWatermark([key])


def batch_writer(path: str) -> Callable[[DataFrame, int], None]:
    """For ``foreachBatch``: each batch owns a partition, so a replayed batch replaces itself."""

    def write(batch: DataFrame, batch_id: int) -> None:
        (
            batch.withColumn("batch_id", F.lit(batch_id).cast("bigint"))
            .write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic")
            .partitionBy("batch_id")
            .parquet(path)
        )

    return write


def start(df: DataFrame, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Write a stream to a table, for example ``start(ctr, p, c, processingTime="1 minute")``."""
    return (
        df.writeStream.outputMode("append")
        .option("checkpointLocation", checkpoint)
        .trigger(**trigger)
        .foreachBatch(batch_writer(path))
        .start()
    )


def drain(df: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Run a stream over what its source holds now and return the table it wrote."""
    start(df, path, checkpoint, availableNow=True).awaitTermination()
    schema = f"{_ddl(df)}, batch_id bigint"
    return df.sparkSession.read.schema(schema).parquet(path)


class LateRows(StreamingQueryListener):
    """Counts the rows of each stream that were dropped for arriving behind the watermark.

    Add it with ``spark.streams.addListener`` before the streams start: a query itself remembers its
    latest reports only. A restart under the same checkpoint goes on with the same count.
    """

    def __init__(self) -> None:
        self._dropped: Counter[str] = Counter()

    def of(self, query: StreamingQuery) -> int:
        """Rows reported so far; reports arrive shortly after their batch."""
        return self._dropped[str(query.id)]

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        states = event.progress.stateOperators
        self._dropped[str(event.progress.id)] += sum(s.numRowsDroppedByWatermark for s in states)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
