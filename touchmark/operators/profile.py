"""Column profiling in long format: one row per table column, value or bucket.

Columns are turned into (column, value) rows once; equal values are merged map-side before any
shuffle, so a column with one dominant value costs no more than any other.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from touchmark.functions.scalars import safe_divide

LONG_TEXT = 64
NESTED = (T.ArrayType, T.MapType, T.StructType)


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def atomic_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if not isinstance(f.dataType, NESTED)]


def value_text(df: DataFrame, column: str) -> Column:
    """A value as text; times with all their microseconds."""
    if isinstance(df.schema[column].dataType, (T.TimestampType, T.TimestampNTZType)):
        return F.date_format(column, "yyyy-MM-dd HH:mm:ss.SSSSSS")
    return F.col(column).cast("string")


def value_key(df: DataFrame, column: str) -> Column:
    """What identifies a value: long texts by their SHA-256, so whole texts are not shuffled."""
    data_type = df.schema[column].dataType
    if isinstance(data_type, (T.StringType, *NESTED)):
        text = F.col(column).cast("string")
        long = F.length(text) > LONG_TEXT
        return F.when(long, F.concat(F.lit("sha256:"), F.sha2(text, 256))).otherwise(text)
    return F.col(column)


def long_values(df: DataFrame, columns: list[str], value) -> DataFrame:
    """``(column_name, value)`` rows, ``value`` mapping a column name to an expression."""
    return df.select(*[value(c).alias(c) for c in columns]).unpivot(
        [], columns, "column_name", "value"
    )


def _one_pass(df: DataFrame, columns: list[str], measures: dict) -> DataFrame:
    """All measures of all columns in one aggregate, one row per column."""
    aggregates, rows = [], []
    for i, column in enumerate(columns):
        fields = [F.lit(column).alias("column_name")]
        for name, measure in measures.items():
            aggregates.append(measure(column).alias(f"{name}_{i}"))
            fields.append(F.col(f"{name}_{i}").alias(name))
        rows.append(F.struct(*fields))
    return df.agg(*aggregates).select(F.inline(F.array(*rows)))


def row_count(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("row_count")).withColumn(
        "column_count", F.lit(len(df.columns)).cast("bigint")
    )


def _null_measures() -> dict:
    missing = lambda c: F.count_if(F.col(c).isNull())
    return {
        "null_count": missing,
        "null_fraction": lambda c: safe_divide(missing(c), F.count("*")),
    }


def nulls(df: DataFrame) -> DataFrame:
    return _one_pass(df, df.columns, _null_measures())


def _cell(df: DataFrame, i: int, column: str) -> Column:
    """A value in one of three narrow fields, by its type, under the number of its column."""
    kind, value = df.schema[column].dataType, F.col(column)
    number = real = text = None
    if isinstance(kind, (T.IntegralType, T.BooleanType)):
        number = value.cast("bigint")
    elif isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        number = F.unix_micros(value.cast("timestamp"))
    elif isinstance(kind, (T.FloatType, T.DoubleType)):
        real = value.cast("double")
    elif isinstance(kind, T.DecimalType):
        text = value.cast("string")
    else:
        text = value_key(df, column)
    fields = {"number": (number, "bigint"), "real": (real, "double"), "text": (text, "string")}
    typed = [(F.lit(None).cast(t) if c is None else c).alias(name) for name, (c, t) in fields.items()]
    return F.struct(F.lit(i).alias("column_id"), *typed)


def distinct(df: DataFrame, columns: list[str] | None = None, *, approximate: bool = False) -> DataFrame:
    """Distinct non-NULL values per column; ``approximate`` needs no shuffle of values.

    All columns become rows of one narrow type in a single scan, folded in each task before the shuffle.
    """
    columns = columns or df.columns
    if approximate:
        return _one_pass(df, columns, {"distinct_count": lambda c: F.approx_count_distinct(value_key(df, c))})
    cells = df.select(F.inline(F.array(*[_cell(df, i, c) for i, c in enumerate(columns)])))
    none = F.col("number").isNull() & F.col("real").isNull() & F.col("text").isNull()
    counts = cells.distinct().groupBy("column_id").agg(F.count_if(~none).alias("distinct_count"))
    names = F.array(*[F.lit(c) for c in columns])
    return counts.select(F.get(names, F.col("column_id")).alias("column_name"), "distinct_count")


def _bound_measures(df: DataFrame) -> dict:
    """Numbers as doubles, other plain values as text, nested ones not at all."""
    numbers, plain = set(numeric_columns(df)), set(atomic_columns(df))
    no_number, no_text = F.max(F.lit(None).cast("double")), F.max(F.lit(None).cast("string"))

    def number(fold):
        return lambda c: fold(F.col(c)).cast("double") if c in numbers else no_number

    def text(fold):
        return lambda c: fold(value_text(df, c)) if c in plain - numbers else no_text

    return {
        "min_number": number(F.min), "max_number": number(F.max),
        "min_text": text(F.min), "max_text": text(F.max),
    }


def min_max(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Smallest and largest value of each column."""
    return _one_pass(df, columns or atomic_columns(df), _bound_measures(df))


def _bounds(df: DataFrame, columns: list[str]) -> DataFrame:
    return _one_pass(
        df, columns,
        {
            "low": lambda c: F.min(F.col(c).cast("double")),
            "high": lambda c: F.max(F.col(c).cast("double")),
        },
    )


def histogram(df: DataFrame, buckets: int, columns: list[str] | None = None) -> DataFrame:
    """Equal-width counts between the column's own minimum and maximum; empty buckets are absent."""
    columns = columns or numeric_columns(df)
    values = long_values(df, columns, lambda c: F.col(c).cast("double"))
    width = (F.col("high") - F.col("low")) / buckets
    place = F.floor(F.try_divide(F.col("value") - F.col("low"), width))
    bucket = F.least(F.coalesce(place, F.lit(0)), F.lit(buckets - 1)).cast("int")
    return (
        values.filter(F.col("value").isNotNull())
        # One row per column: the schema bounds what is broadcast.
        .join(F.broadcast(_bounds(df, columns)), "column_name")
        .select("column_name", bucket.alias("bucket"), width.alias("width"), "low")
        .groupBy("column_name", "bucket")
        .agg(
            F.min(F.col("low") + F.col("bucket") * F.col("width")).alias("bucket_low"),
            F.count("*").alias("value_count"),
        )
    )


QUARTILES = (0.25, 0.5, 0.75)


def quantiles(
    df: DataFrame, columns: list[str] | None = None, *, at: tuple[float, ...] = QUARTILES,
    accuracy: int = 1_000, target: int = 100_000,
) -> DataFrame:
    """Exact quantiles with linear interpolation, one row per column, ``q1``, ``q2``, ...

    Selection by repeated counting: the values between two bounds are cut at their approximate quantiles,
    counted, and the bounds drawn in around the bin that holds a wanted rank, until no more than
    ``target`` rows lie between them or all are equal. A value that is a cut has a bin of its own, so one
    held by half of the rows is found by counting. Only what is left is put in order. The driver
    holds a row per column, wanted rank and bin, no values; approximations decide how fast the bounds close,
    not which values are found.
    """
    columns = columns or numeric_columns(df)
    spark = df.sparkSession
    each = [F.struct(F.lit(i).alias("c"), F.col(c).cast("double").alias("v")) for i, c in enumerate(columns)]
    values = df.select(F.inline(F.array(*each))).filter("v IS NOT NULL")
    ends = values.groupBy("c").agg(F.count("*").alias("n"), F.min("v").alias("low"), F.max("v").alias("high"))
    totals, open_, found = {}, {}, {}
    for r in ends.collect():
        totals[r["c"]] = r["n"]
        for p in at:
            for rank in (math.floor((r["n"] - 1) * p), math.ceil((r["n"] - 1) * p)):
                open_[r["c"], rank] = (r["low"], r["high"], 0, r["n"])  # bounds, rows below, rows between

    def between(slots: dict) -> tuple[DataFrame, dict]:
        """The values inside of the distinct bounds, numbered ``s``, and the numbers of the bounds."""
        number = {key: s for s, key in enumerate(sorted({(c, *bounds[:2]) for (c, _), bounds in slots.items()}))}
        frame = spark.createDataFrame([(s, *key) for key, s in number.items()], "s int, c int, low double, high double")
        # A row per column and wanted rank.
        return values.join(F.broadcast(frame), "c").filter("v BETWEEN low AND high").select("s", "v"), number

    while open_:
        for key, (low, high, _, _) in list(open_.items()):
            if low == high or (math.isnan(low) and math.isnan(high)):
                found[key] = low
                del open_[key]
        wide = {key: bounds for key, bounds in open_.items() if bounds[3] > target}
        if not wide:
            break
        inside, number = between(wide)
        points = [i / 32 for i in range(1, 32)]
        cuts = inside.groupBy("s").agg(F.array_distinct(F.percentile_approx("v", points, accuracy)).alias("cuts"))
        below = F.size(F.filter("cuts", lambda x: x < F.col("v")))
        place = 2 * below + F.array_contains("cuts", F.col("v")).cast("int")
        bins = inside.join(F.broadcast(cuts), "s").groupBy("s", place.alias("bin")).agg(
            F.count("*").alias("n"), F.min("v").alias("low"), F.max("v").alias("high")
        )
        counted: dict[int, list] = {}
        for r in sorted(bins.collect(), key=lambda r: (r["s"], r["bin"])):
            counted.setdefault(r["s"], []).append(r)
        for (c, rank), (low, high, before, _) in wide.items():
            for r in counted[number[c, low, high]]:
                if rank < before + r["n"]:
                    open_[c, rank] = (r["low"], r["high"], before, r["n"])
                    break
                before += r["n"]
    if open_:
        inside, number = between(open_)
        wanted = [(number[c, low, high], c, rank, rank - before) for (c, rank), (low, high, before, _) in open_.items()]
        frame = spark.createDataFrame(wanted, "s int, c int, rank long, at long")
        upto = F.sum("n").over(Window.partitionBy("s").orderBy("v"))
        ordered = inside.groupBy("s", "v").agg(F.count("*").alias("n")).select("s", "v", "n", upto.alias("upto"))
        held = ordered.join(F.broadcast(frame), "s").filter("at >= upto - n AND at < upto")
        found |= {(r["c"], r["rank"]): r["v"] for r in held.select("c", "rank", "v").collect()}
    rows = []
    for c, n in totals.items():
        row = [columns[c]]
        for p in at:
            low, high = (found[c, rank((n - 1) * p)] for rank in (math.floor, math.ceil))
            row.append(low + (high - low) * ((n - 1) * p - math.floor((n - 1) * p)))
        rows.append(tuple(row))
    return spark.createDataFrame(rows, ", ".join(["column_name string", *(f"q{i + 1} double" for i in range(len(at)))]))


def distribution(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Count, mean, sample standard deviation and quartiles of each numeric column."""
    columns = columns or numeric_columns(df)
    moments = _one_pass(
        df, columns,
        {
            "value_count": lambda c: F.count(c),
            "mean": lambda c: F.avg(F.col(c).cast("double")),
            "stddev": lambda c: F.stddev_samp(F.col(c).cast("double")),
        },
    )
    return moments.join(quantiles(df, columns), "column_name", "left")


def anomalies(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Flagged numeric columns: all NULL, constant, or with values beyond 1.5 quartile ranges."""
    columns = columns or numeric_columns(df)
    quartiles = quantiles(df, columns)
    spread = F.col("q3") - F.col("q1")
    fences = quartiles.select(
        "column_name",
        (F.col("q1") - spread * 1.5).alias("low_fence"),
        (F.col("q3") + spread * 1.5).alias("high_fence"),
    )
    values = long_values(df, columns, lambda c: F.col(c).cast("double"))
    outside = (F.col("value") < F.col("low_fence")) | (F.col("value") > F.col("high_fence"))
    # One row per column: the schema bounds what is broadcast.
    checked = (
        values.join(F.broadcast(fences), "column_name", "left")
        .groupBy("column_name")
        .agg(
            F.min("value").alias("low"),
            F.max("value").alias("high"),
            F.count_if(outside).alias("outlier_count"),
        )
    )
    kind = (
        F.when(F.col("low").isNull(), "all_null")
        .when(F.col("low") == F.col("high"), "constant")
        .when(F.col("outlier_count") > 0, "outliers")
    )
    return checked.select("column_name", kind.alias("anomaly"), "outlier_count").filter(
        F.col("anomaly").isNotNull()
    )


def profile(df: DataFrame) -> DataFrame:
    """Nulls, bounds and distinct values of every column, from two scans."""
    one_pass = _one_pass(df, df.columns, {**_null_measures(), **_bound_measures(df)})
    return one_pass.join(distinct(df), "column_name")


def profile_all(tables: dict[str, DataFrame]) -> DataFrame:
    parts = [profile(df).select(F.lit(t).alias("table_name"), "*") for t, df in tables.items()]
    return reduce(DataFrame.unionByName, parts)
