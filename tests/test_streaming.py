import datetime as dt
import os
import time
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from touchmark.session import shared_dir
from touchmark.streaming import ctr as stream

SCHEMA = "event_id long, event_type string, campaign_id long, channel string, country_code string, event_ts timestamp"


def minute(m):
    return dt.datetime(2024, 1, 1, 10, tzinfo=dt.timezone.utc) + dt.timedelta(minutes=m)


def put(spark, folder, name, rows):
    """One parquet file of (event_id, event_type, minute)."""
    full = [(i, kind, 1, "meta", "US", minute(m)) for i, kind, m in rows]
    path = os.path.join(folder, name)
    spark.createDataFrame(full, SCHEMA).coalesce(1).write.parquet(path)


def source(spark, folder):
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{folder}/*")


def test_ctr_by_window_with_a_late_row(spark, tmp_path):
    inbox, out, check = (str(tmp_path / n) for n in ("in", "out", "check"))
    put(spark, inbox, "1", [(1, "impression", 0), (2, "click", 3), (3, "impression", 5)])
    put(spark, inbox, "2", [(4, "impression", 40)])
    query = stream.start(stream.windowed_ctr(source(spark, inbox)), out, check, availableNow=True)
    query.awaitTermination()
    put(spark, inbox, "3", [(5, "impression", 1), (6, "click", 70)])  # the first is too late
    late = stream.LateRows()
    spark.streams.addListener(late)
    query = stream.start(stream.windowed_ctr(source(spark, inbox)), out, check, availableNow=True)
    query.awaitTermination()
    for _ in range(100):
        if late.of(query):
            break
        time.sleep(0.1)
    spark.streams.removeListener(late)
    assert late.of(query) == 1
    rows = spark.read.parquet(out).orderBy("bucket_start").collect()
    assert [(r["impressions"], r["clicks"], r["ctr"]) for r in rows] == [(2, 1, 0.5), (1, 0, 0.0)]
    first = rows[0]
    assert first["window_end"] - first["window_start"] == dt.timedelta(minutes=5)


def test_late_rows_of_many_batches():
    late = stream.LateRows()
    for batch in range(250):
        states = [SimpleNamespace(numRowsDroppedByWatermark=n) for n in (1, batch % 2)]
        late.onQueryProgress(SimpleNamespace(progress=SimpleNamespace(id="q", stateOperators=states)))
    assert late.of(SimpleNamespace(id="q")) == 375 and late.of(SimpleNamespace(id="other")) == 0


def test_restart_adds_nothing_twice(spark, tmp_path):
    inbox, out, check = (str(tmp_path / n) for n in ("in", "out", "check"))
    put(spark, inbox, "1", [(1, "click", 0), (2, "click", 1)])
    for _ in range(2):
        stream.drain(source(spark, inbox).select("event_id", "event_ts"), out, check)
    assert spark.read.parquet(out).count() == 2


def test_dedup_across_batches(spark, tmp_path):
    inbox, out, check = (str(tmp_path / n) for n in ("in", "out", "check"))
    put(spark, inbox, "1", [(1, "click", 0), (1, "click", 0)])
    put(spark, inbox, "2", [(1, "click", 0), (2, "click", 1)])
    found = stream.drain(stream.dedup(source(spark, inbox)), out, check)
    assert sorted(r["event_id"] for r in found.collect()) == [1, 2]


def test_stream_equals_batch(spark, tmp_path):
    inbox = str(tmp_path / "in")
    put(spark, inbox, "1", [(i, "click" if i % 3 else "impression", i) for i in range(60)])
    live = stream.drain(
        stream.windowed_ctr(source(spark, inbox)), str(tmp_path / "out"), str(tmp_path / "check")
    ).drop("batch_id")
    batch = stream.windowed_ctr(spark.read.schema(SCHEMA).parquet(f"{inbox}/*"))
    closed = batch.filter(F.col("bucket_end") <= F.lit(minute(59 - 10)))
    assert live.exceptAll(closed).count() == 0 and closed.exceptAll(live).count() == 0


def session_like(master, **conf):
    """The two things of a session that decide about the shared folder."""
    return SimpleNamespace(
        conf=SimpleNamespace(get=lambda key, default=None: conf.get(key.replace(".", "_"), default)),
        sparkContext=SimpleNamespace(master=master, applicationId=f"app-{master}"),
    )


def test_shared_dir_comes_from_the_session():
    named = session_like("yarn", spark_checkpoint_dir="hdfs://lake/tmp/")
    assert shared_dir(named) == "hdfs://lake/tmp"
    with pytest.raises(ValueError):
        shared_dir(session_like("yarn"))
    assert shared_dir(session_like("local[2]")).startswith("/")


@pytest.mark.parametrize("name", ["with_file", "appends"])
def test_reader_helpers(spark, data, name):
    from touchmark.sources import star
    from touchmark.sources import tables as src

    if name == "with_file":
        row = src.with_file(src.load(spark, data, "region")).head()
        assert row["source_file"].endswith("region.parquet")
    else:
        recent = src.appends(star.pixel_events(spark, data), dt.datetime(2024, 1, 10, tzinfo=dt.timezone.utc))
        low, high = recent.agg(F.min("event_ts"), F.max("event_ts")).head()
        assert low is None or high - low <= dt.timedelta(minutes=10)


def test_stream_of_a_folder_takes_its_appends_and_no_other_table(spark, tmp_path):
    from touchmark.sources.tables import load_stream

    put(spark, str(tmp_path), "part.parquet", [(1, "click", 0)])
    put(spark, str(tmp_path), "partsupp.parquet", [(2, "click", 0)])
    out, check = str(tmp_path / "out"), str(tmp_path / "check")
    for rows in ([1], [1, 3]):
        found = stream.drain(load_stream(spark, str(tmp_path), "part"), out, check)
        assert sorted(r["event_id"] for r in found.collect()) == rows
        spark.createDataFrame([(3, "click", 1, "meta", "US", minute(0))], SCHEMA).write.mode("append").parquet(
            str(tmp_path / "part.parquet")
        )
