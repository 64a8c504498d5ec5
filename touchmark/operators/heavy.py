"""The most frequent values of every column: a counter sketch in one scan, an exact recount of its candidates in another."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from touchmark.operators.profile import LONG_TEXT, atomic_columns, value_text

#: Values of a column that a task keeps counting.
CAPACITY = 4096


def _key(df: DataFrame, column: str) -> Column:
    """A value as text, a long one by its SHA-256; zero has one sign."""
    text = value_text(df, column)
    if isinstance(df.schema[column].dataType, (T.FloatType, T.DoubleType)):
        text = F.when(F.col(column) == 0, F.lit(0.0).cast("string")).otherwise(text)
    if isinstance(df.schema[column].dataType, T.StringType):
        return F.when(F.length(text) > LONG_TEXT, F.concat(F.lit("sha256:"), F.sha2(text, 256))).otherwise(text)
    return text


class Counters:
    """Counts of the values of one column, the greatest ``capacity`` of them kept.

    Whatever is dropped at once has at most the count ``lost`` grows by: a value not held has been seen at most
    ``lost`` times, and one that is held at most ``lost`` times more than it is counted for.
    """

    def __init__(self, capacity: int) -> None:
        self.capacity, self.lost, self.waiting = capacity, 0, 0
        self.parts: list[pa.Table] = []

    def add(self, values: pa.Array) -> None:
        found = pc.value_counts(values.drop_null())
        if len(found):
            self.parts.append(pa.table({"key": found.field("values"), "n": found.field("counts")}))
            self.waiting += len(found)
        if self.waiting > 8 * self.capacity:
            self.fold()

    def fold(self) -> pa.Table | None:
        if not self.parts:
            return None
        whole = pa.concat_tables(self.parts).group_by("key", use_threads=False).aggregate([("n", "sum")])
        whole = whole.select(["key", "n_sum"]).rename_columns(["key", "n"])
        if len(whole) > self.capacity:
            order = pc.sort_indices(whole["n"], sort_keys=[("", "descending")])
            self.lost += whole["n"][order[self.capacity].as_py()].as_py()
            whole = whole.take(order[: self.capacity])
        self.parts, self.waiting = [whole], len(whole)
        return whole


def sketches(df: DataFrame, columns: list[str], capacity: int = CAPACITY) -> DataFrame:
    """(column_id, key, n, lost) per task: its counters of each column; the row without a key has what they lost."""
    texts = df.select(*[_key(df, c).alias(f"c{i}") for i, c in enumerate(columns)])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counters = [Counters(capacity) for _ in columns]
        for batch in batches:
            for own, values in zip(counters, batch.columns):
                own.add(values)
        for i, own in enumerate(counters):
            held = own.fold()
            keys = [] if held is None else held["key"].to_pylist()
            counts = [] if held is None else held["n"].to_pylist()
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([i] * (len(keys) + 1), pa.int32()), pa.array([*keys, None], pa.string()),
                    pa.array([*counts, 0], pa.int64()), pa.array([0] * len(keys) + [own.lost], pa.int64()),
                ],
                ["column_id", "key", "n", "lost"],
            )

    return texts.mapInArrow(count, "column_id int, key string, n long, lost long")


def _values(df: DataFrame, columns: list[tuple[int, str]]) -> DataFrame:
    """(column_id, key, value) of several columns from one scan; ``value`` is a long text itself, else null."""
    rows = [
        F.struct(
            F.lit(i).alias("column_id"), _key(df, c).alias("key"),
            F.when(F.length(value_text(df, c)) > LONG_TEXT, value_text(df, c)).alias("value"),
        )
        for i, c in columns
    ]
    return df.select(F.inline(F.array(*rows))).filter("key IS NOT NULL")


def _counted(rows: DataFrame) -> DataFrame:
    return rows.groupBy("column_id", "key").agg(F.count("*").alias("value_count"), F.any_value("value").alias("value"))


def _best(counts: DataFrame, n: int) -> DataFrame:
    text = counts.withColumn("value", F.coalesce("value", "key")).drop("key")
    order = Window.partitionBy("column_id").orderBy(F.desc("value_count"), "value")
    return text.withColumn("value_rank", F.row_number().over(order)).filter(F.col("value_rank") <= n)


def top_n(df: DataFrame, n: int, columns: list[str] | None = None, *, capacity: int = CAPACITY) -> DataFrame:
    """The ``n`` most frequent values of each column, exactly; equal counts go to the smaller text.

    The first scan sketches all columns in every task, and sends at most ``capacity`` values a column and
    task. The second counts the values exactly that can be among the ``n`` best. A column is settled if its n-th count
    is above all that a sketch may have lost; the values of the others, which have no frequent ones, are
    counted whole, folded in each task before the shuffle. So hot columns shuffle nothing but candidates.
    """
    columns = columns or atomic_columns(df)
    spark = df.sparkSession
    merged = sketches(df, columns, capacity).groupBy("column_id", "key").agg(F.sum("n").alias("n"), F.sum("lost").alias("lost"))
    ranked = Window.partitionBy("column_id").orderBy(F.desc("n"), "key")
    held = merged.withColumn("at", F.row_number().over(ranked))
    # At most two rows more than the capacity a column: the sums of all tasks are cut like those of one.
    held = held.filter((F.col("at") <= capacity + 1) | F.col("key").isNull()).toPandas()
    every, unseen, likely = list(enumerate(columns)), {}, []
    for i, _ in every:
        own = held[held["column_id"] == i]
        lost, own = int(own["lost"].sum()), own[own["key"].notna()].sort_values("at")
        unseen[i] = lost + (int(own["n"].iloc[capacity]) if len(own) > capacity else 0)
        own = own.iloc[:capacity]
        # A value counted n times at least and n + lost at most must reach the n-th best lower bound.
        floor = int(own["n"].iloc[n - 1]) if len(own) >= n else 0
        likely += [(i, key) for key in own["key"][own["n"] + lost >= floor]]
    can = F.broadcast(spark.createDataFrame(likely, "column_id int, key string"))
    found = _best(_counted(_values(df, every).join(can, ["column_id", "key"])), n)
    found = found.collect()  # n rows a column
    rows: dict[int, list] = {i: [] for i, _ in every}
    for r in found:
        rows[r["column_id"]].append(r)
    settled = {
        i for i, _ in every
        if not unseen[i] or (len(rows[i]) == n and min(r["value_count"] for r in rows[i]) > unseen[i])
    }
    schema = "column_id int, value_count long, value string, value_rank int"
    done = [(r["column_id"], r["value_count"], r["value"], r["value_rank"]) for i in settled for r in rows[i]]
    result = spark.createDataFrame(done, schema)
    rest = [(i, c) for i, c in every if i not in settled]
    if rest:
        result = result.unionByName(_best(_counted(_values(df, rest)), n))
    names = F.array(*[F.lit(c) for c in columns])
    return result.select(F.get(names, F.col("column_id")).alias("column_name"), "value", "value_count", "value_rank")
