"""Appends by the time they arrived."""

import datetime as dt
import os

import pytest

from touchmark.sources import tables as src

NOW = dt.datetime(2024, 3, 1, 12, tzinfo=dt.timezone.utc)
SCHEMA = "id long, event_ts timestamp"


def batch(spark, *rows):
    return spark.createDataFrame([(i, NOW - dt.timedelta(days=age)) for i, age in rows], SCHEMA)


def spoil(folder, older):
    """Turns all but the newest files into something no reader can open."""
    for name in os.listdir(folder):
        if older(name) and not name.startswith((".", "_")):
            path = os.path.join(folder, name)
            for file in [path] if os.path.isfile(path) else [os.path.join(path, f) for f in os.listdir(path)]:
                times = os.stat(file)
                with open(file, "wb") as out:
                    out.write(b"x")
                os.utime(file, (times.st_atime, times.st_mtime))


def test_late_events_of_a_new_batch(spark, tmp_path):
    path = str(tmp_path / "t")
    src.append_batch(batch(spark, (1, 0), (2, 1)), path, NOW - dt.timedelta(minutes=30))
    src.append_batch(batch(spark, (3, 0), (4, 400)), path, NOW - dt.timedelta(minutes=5))
    src.append_batch(batch(spark, (3, 0), (4, 400)), path, NOW - dt.timedelta(minutes=5))  # written twice
    src.append_batch(batch(spark, (5, 0)), path, NOW + dt.timedelta(minutes=1))
    late = (NOW - dt.timedelta(minutes=5)).strftime("%Y%m%dT%H%M%S")
    spoil(path, lambda name: late not in name)
    table = spark.read.schema(f"{SCHEMA}, arrived string").parquet(path)
    assert {r["id"] for r in src.arrivals(table, NOW).collect()} == {3, 4}
    with pytest.raises(Exception):  # noqa: B017
        src.arrivals(table, NOW, 60).collect()


def test_recent_files_are_the_only_ones_opened(spark, tmp_path):
    path = str(tmp_path / "t")
    for i, minutes in enumerate((90, 5)):
        before = set(os.listdir(path)) if i else set()
        batch(spark, (i, 400)).coalesce(1).write.mode("append").parquet(path)
        at = (NOW - dt.timedelta(minutes=minutes)).timestamp()
        for name in set(os.listdir(path)) - before:
            os.utime(os.path.join(path, name), (at, at))
    spoil(path, lambda name: os.stat(os.path.join(path, name)).st_mtime < (NOW - dt.timedelta(minutes=60)).timestamp())
    table = spark.read.schema(SCHEMA).parquet(path)
    assert [r["id"] for r in src.recent_files(table, NOW).collect()] == [1]
