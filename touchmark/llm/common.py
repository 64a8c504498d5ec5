"""Registry and helpers of the text-corpus operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from touchmark.session import stored as stored

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

#: White space of the word definitions, as a trim set and as a pattern.
BLANK = " \t\n\x0b\f\r"
BLANKS = "[ \\t-\\r]+"


def register(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    def add(query: Query) -> Query:
        QUERIES[name] = query
        if oracle is not None:
            ORACLES[name] = oracle.strip()
        return query

    return add


def read(spark: SparkSession, directory: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{directory.rstrip('/')}/{name}.parquet")


def text_or_empty(text: str) -> Column:
    return F.coalesce(F.col(text), F.lit(""))


def digest(text: Column) -> Column:
    """16 bytes that stand for a text in shuffles and joins."""
    return F.unhex(F.md5(F.encode(text, "UTF-8")))


def words(text: Column) -> Column:
    """Runs of characters other than blanks, in order."""
    trimmed = F.btrim(text, F.lit(BLANK))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, BLANKS))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, computed once however often the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def ngrams(items: Column, n: int) -> Column:
    """64-bit hashes of all runs of n items; empty when there are fewer."""

    def hashes(w: Column) -> Column:
        runs = F.transform(
            F.sequence(F.lit(0), F.size(w) - n), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(n)])
        )
        return F.when(F.size(w) >= n, runs).otherwise(F.array().cast("array<bigint>"))

    return let(items, hashes)


def fits(df: DataFrame, rows: int) -> bool:
    """Whether the table has at most so many rows; reads no more than one beyond them."""
    return df.limit(rows + 1).count() <= rows
