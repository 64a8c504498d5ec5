"""Embedding of texts: hashed words under document-frequency weights that are fitted once and kept."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DIMENSIONS = 256
_WORD = re.compile("[A-Za-z0-9_]+")
#: Words whose bucket a task remembers.
_KNOWN = 1 << 20


class Buckets:
    """The bucket of each word of a text: the first 32 bits of its MD5, modulo the dimensions.

    Words are runs of ASCII letters, digits and underscores, in lower case.
    """

    def __init__(self, dimensions: int) -> None:
        self.dimensions = dimensions
        self.known: dict[str, int] = {}

    def of(self, text: str) -> np.ndarray:
        words, known = _WORD.findall(text), self.known
        if len(known) > _KNOWN:
            known.clear()
        for word in set(words).difference(known):
            known[word] = int(hashlib.md5(word.lower().encode()).hexdigest()[:8], 16) % self.dimensions
        return np.fromiter(map(known.__getitem__, words), "int64", len(words))


def fit_weights(df: DataFrame, text: str = "content", dimensions: int = DIMENSIONS) -> DataFrame:
    """(bucket, weight): ln((n + 1) / (docs + 1)) for every bucket, from one pass over the texts that are not null.

    Tasks send one row per bucket; the result has as many rows as there are dimensions, at any size.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        buckets, docs, n = Buckets(dimensions), np.zeros(dimensions, "int64"), 0
        for batch in batches:
            for value in batch.column(0).to_pylist():
                if value is not None:
                    n += 1
                    docs[np.unique(buckets.of(value))] += 1
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(dimensions), pa.int32()), pa.array(docs), pa.array(np.full(dimensions, n))], ["bucket", "docs", "n"])

    parts = df.select(F.col(text).cast("string")).mapInArrow(count, "bucket int, docs long, n long")
    sums = parts.groupBy("bucket").agg(F.sum("docs").alias("docs"), F.sum("n").alias("n"))
    return sums.select("bucket", F.log((F.col("n") + 1) / (F.col("docs") + 1)).alias("weight"))


def save_weights(weights: DataFrame, path: str) -> None:
    weights.coalesce(1).write.mode("overwrite").parquet(path)


def load_weights(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("bucket int, weight double").parquet(path)


def embed_text(
    df: DataFrame,
    text: str = "content",
    *,
    weights: DataFrame | None = None,
    dimensions: int = DIMENSIONS,
    embed_fn: Callable[[pd.Series], list] | None = None,
) -> DataFrame:
    """Adds ``embedding`` and ``status`` (empty when the call succeeded).

    ``embed_fn`` maps a batch of texts to vectors and runs inside the tasks. Without it a text becomes the
    counts of its words by bucket times ``weights``, at length 1; the weights may come from other texts,
    and are fitted on these where none are given. A null text has no vector; one without words is all zeros.
    """
    if embed_fn is not None:
        return _embed_with(df, text, embed_fn)
    table = (fit_weights(df, text, dimensions) if weights is None else weights).toPandas()  # a row per dimension
    scale = np.zeros(len(table))
    scale[table["bucket"]] = table["weight"]

    @F.pandas_udf("array<double>")
    def embed(texts: pd.Series) -> pd.Series:
        buckets = Buckets(len(scale))

        def vector(value: str | None) -> np.ndarray | None:
            if value is None:
                return None
            v = np.bincount(buckets.of(value), minlength=len(scale)) * scale
            size = np.sqrt(v @ v)
            return v / size if size else v

        return texts.map(vector)

    status = F.when(F.col(text).isNull(), "no text").otherwise("")
    return df.select("*", embed(F.col(text).cast("string")).alias("embedding"), status.alias("status"))


def _embed_with(df: DataFrame, text: str, embed_fn: Callable[[pd.Series], list]) -> DataFrame:
    names = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            try:
                yield batch.assign(embedding=list(embed_fn(batch[text])), status="")
            except Exception:  # noqa: BLE001
                # One bad text must not fail its batch: try the rows one by one.
                yield _embed_rows(batch, text, embed_fn)

    return df.mapInPandas(run, f"{names}, embedding array<float>, status string")


def _embed_rows(batch: pd.DataFrame, text: str, embed_fn) -> pd.DataFrame:
    vectors, states = [], []
    for value in batch[text]:
        try:
            vectors.append(list(embed_fn(pd.Series([value])))[0])
            states.append("")
        except Exception as error:  # noqa: BLE001
            vectors.append(None)
            states.append(f"{type(error).__name__}: {error}")
    return batch.assign(embedding=vectors, status=states)
