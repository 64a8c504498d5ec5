"""Nearest-neighbour search by cosine distance: exact in blocks, and over a stored inverted file."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from touchmark.functions.vectors import cosine_distance, norm

# Distances are compared to nine decimals, equal ones by id.
DECIMALS = 9
#: Distances that a task holds at once.
MATRIX_VALUES = 1 << 22


@dataclass(frozen=True)
class Search:
    """Rows and queries that meet in one group of a search; more of a cell are dealt to several groups."""

    group_rows: int = 16_384
    group_queries: int = 4_096


# --- exact search --------------------------------------------------------------------------


def topk_distance(
    base: DataFrame, query: list[float], k: int = 10, *, vector: str = "embedding", key: str
) -> DataFrame:
    """The ``k`` rows nearest to one vector."""
    target = F.array(*[F.lit(float(x)) for x in query])
    distance = F.round(cosine_distance(F.col(vector), target), DECIMALS)
    scored = base.withColumn("distance", distance).filter(F.col("distance").isNotNull())
    return scored.orderBy("distance", key).limit(k)


def knn_exact(
    base: DataFrame,
    queries: DataFrame,
    k: int = 10,
    *,
    vector: str = "embedding",
    base_id: str = "vec_id",
    query_id: str = "query_id",
    search: Search = Search(),
) -> DataFrame:
    """The ``k`` nearest base rows of every query: ``(query_id, base_id, distance, rank)``.

    Vectors that are null or zero have no direction, and are neither found nor asked for. Both sides are
    dealt to blocks, and each pair of blocks is a group of its own, at any size of either.
    """
    b = base.select(F.col(base_id).alias("bid"), _usable(vector).alias("bv"), F.lit(0).alias("cell")).filter("bv IS NOT NULL")
    q = queries.select(F.col(query_id).alias("qid"), _usable(vector).alias("qv"), F.lit(0).alias("cell")).filter("qv IS NOT NULL")
    return _nearest(b, q, {0: b.count()}, k, base_id, query_id, search)


def _usable(vector: str) -> Column:
    """The vector in doubles, null when it has no direction."""
    return F.when(F.coalesce(norm(F.col(vector)) > 0, F.lit(False)), F.col(vector).cast("array<double>"))


def _nearest(
    b: DataFrame, q: DataFrame, sizes: dict[int, int], k: int, base_id: str, query_id: str, search: Search
) -> DataFrame:
    """Searches ``b`` (bid, bv, cell) for each ``q`` (qid, qv, cell), a row per cell that the query probes.

    ``sizes`` are the base rows of each cell; one row per cell is all that reaches the driver. A cell's
    rows and queries are dealt to parts, and each pair of parts yields the k best of its rows.
    """
    asked = {r["cell"]: r["count"] for r in q.groupBy("cell").count().collect()}
    dealt = [
        (c, -(-sizes[c] // search.group_rows), -(-n // search.group_queries))
        for c, n in asked.items() if sizes.get(c)
    ]
    parts = F.broadcast(b.sparkSession.createDataFrame(dealt, "cell int, rows int, queries int"))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    part = lambda c, n: F.pmod(F.xxhash64(c), F.col(n)).cast("int")
    left = b.filter(F.col("cell").isin([c for c, *_ in dealt])).join(parts, "cell")
    left = left.select("bid", "bv", "cell", part("bid", "rows").alias("i"), every("queries").alias("j"))
    right = q.join(parts, "cell").select(
        "qid", "qv", F.col("cell").alias("of"), part("qid", "queries").alias("j2"), every("rows").alias("i2")
    )

    def run(base: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        return _best(base, queries, k)

    qid, bid = (df.schema[c].dataType.simpleString() for df, c in ((q, "qid"), (b, "bid")))
    groups = left.groupBy("cell", "i", "j").cogroup(right.groupBy("of", "i2", "j2"))
    found = groups.applyInPandas(run, f"qid {qid}, bid {bid}, distance double")
    nearest = Window.partitionBy("qid").orderBy("distance", "bid")
    ranked = found.withColumn("rank", F.row_number().over(nearest)).filter(F.col("rank") <= k)
    return ranked.select(
        F.col("qid").alias(query_id), F.col("bid").alias(base_id), "distance", "rank"
    )


def _unit(vectors: pd.Series) -> np.ndarray:
    matrix = np.stack([np.asarray(v, dtype=np.float64) for v in vectors])
    return matrix / np.linalg.norm(matrix, axis=1, keepdims=True)


def _best(base: pd.DataFrame, queries: pd.DataFrame, k: int) -> pd.DataFrame:
    """The k best base rows of each query."""
    parts = [pd.DataFrame({"qid": [], "bid": [], "distance": []})]
    if len(base) and len(queries):
        bids, units = base["bid"].to_numpy(), _unit(base["bv"]).T
        kept, step = min(k, len(bids)), max(1, MATRIX_VALUES // len(bids))
        for at in range(0, len(queries), step):
            some = queries.iloc[at : at + step]
            # Adding zero turns -0.0 into 0.0.
            distances = np.round(1.0 - _unit(some["qv"]) @ units, DECIMALS) + 0.0
            for qid, row in zip(some["qid"], distances):
                # Ties at the edge of the best k are decided by id, so sort on both.
                near = np.flatnonzero(row <= np.partition(row, kept - 1)[kept - 1])
                order = near[np.lexsort((bids[near], row[near]))][:kept]
                parts.append(pd.DataFrame({"qid": qid, "bid": bids[order], "distance": row[order]}))
    return pd.concat(parts[1:] or parts, ignore_index=True)


# --- inverted file -------------------------------------------------------------------------

#: Rows that centroids are fitted on, the first by MD5 of their id; rounds of the fit; most cells.
SAMPLE_ROWS = 20_000
ROUNDS = 2
MAX_CELLS = 4_096


@dataclass(frozen=True)
class InvertedFile:
    """A stored index: its rows in a folder per cell, and a table of cells (cell, center, n)."""

    spark: SparkSession
    path: str

    @property
    def rows(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/rows")

    @property
    def cells(self) -> DataFrame:
        """At most ``MAX_CELLS`` rows."""
        return self.spark.read.parquet(f"{self.path}/cells")

    def centers(self) -> np.ndarray:
        cells = self.cells.orderBy("cell").toPandas()
        return np.stack([np.asarray(c) for c in cells["center"]]) if len(cells) else np.zeros((0, 0))


def fit_centers(units: np.ndarray, cells: int, rounds: int = ROUNDS) -> np.ndarray:
    """Centers of the unit vectors: the first rows, each moved to the mean of the rows nearest to it."""
    centers = units[:cells].copy()
    for _ in range(rounds):
        near = _cells(units, centers, 1)[:, 0]
        centers = np.stack([units[near == c].mean(0) if (near == c).any() else center for c, center in enumerate(centers)])
    return centers


def _cells(units: np.ndarray, centers: np.ndarray, n: int) -> np.ndarray:
    """The n cells nearest to each unit vector, by cosine distance to twelve decimals, then number."""
    sizes = np.linalg.norm(centers, axis=1)
    distances = np.round(1.0 - units @ (centers / np.where(sizes > 0, sizes, 1)[:, None]).T, 12)
    return np.argsort(distances, axis=1, kind="stable")[:, :n]


def build_ivf(
    df: DataFrame, path: str, *, key: str = "vec_id", vector: str = "embedding", cells: int | None = None
) -> InvertedFile:
    """Writes the rows by cell, all columns kept, and the table of cells.

    There are about as many cells as the root of the number of rows, at most ``MAX_CELLS``. Only the
    centers come from a sample; every vector with a direction is put into the cell of its nearest center.
    A cell of many rows is written in several files.
    """
    rows = df.withColumn("_v", _usable(vector)).filter("_v IS NOT NULL")
    total = rows.count()
    wanted = cells or max(1, min(MAX_CELLS, int(total**0.5)))
    order = (F.md5(F.col(key).cast("string")), key)
    sample = rows.select(key, "_v").orderBy(*order).limit(SAMPLE_ROWS).toPandas()
    centers = fit_centers(_unit(sample["_v"]), wanted) if total else np.zeros((0, 0))

    @F.pandas_udf("int")
    def cell(vectors: pd.Series) -> pd.Series:
        return pd.Series(_cells(_unit(vectors), centers, 1)[:, 0]) if len(vectors) else pd.Series([], dtype="int32")

    placed = rows.withColumn("cell", cell("_v")).drop("_v")
    # Adaptive execution cuts the rows of a large cell into several files.
    placed.hint("rebalance", "cell").write.mode("overwrite").partitionBy("cell").parquet(f"{path}/rows")
    spark = df.sparkSession
    counts = spark.read.schema(placed.schema).parquet(f"{path}/rows").groupBy("cell").agg(F.count("*").alias("n"))
    table = spark.createDataFrame(
        [(i, [float(x) for x in c]) for i, c in enumerate(centers)], "cell int, center array<double>"
    )
    table = table.join(counts, "cell", "left").fillna(0, ["n"])
    table.coalesce(1).write.mode("overwrite").parquet(f"{path}/cells")
    return InvertedFile(spark, path)


def probes(
    index: InvertedFile, queries: DataFrame, nprobe: int, *, vector: str = "embedding", query_id: str = "query_id"
) -> DataFrame:
    """(qid, qv, cell): the ``nprobe`` cells whose centers are nearest to each query."""
    centers = index.centers()
    asking = queries.select(F.col(query_id).alias("qid"), _usable(vector).alias("qv")).filter("qv IS NOT NULL")

    @F.pandas_udf("array<int>")
    def near(vectors: pd.Series) -> pd.Series:
        return pd.Series(list(_cells(_unit(vectors), centers, nprobe)) if len(vectors) and len(centers) else [[]] * len(vectors))

    return asking.select("qid", "qv", F.explode(near("qv")).alias("cell"))


def knn_ivf(
    index: InvertedFile,
    queries: DataFrame,
    k: int = 10,
    *,
    nprobe: int = 8,
    vector: str = "embedding",
    base_id: str = "vec_id",
    query_id: str = "query_id",
    search: Search = Search(),
) -> DataFrame:
    """Approximate ``knn_exact``: only the folders of the ``nprobe`` cells nearest to each query are read."""
    q = probes(index, queries, nprobe, vector=vector, query_id=query_id)
    sizes = {r["cell"]: r["n"] for r in index.cells.select("cell", "n").collect()}
    if not sum(sizes.values()):
        b = q.select(F.col("qid").alias("bid"), F.col("qv").alias("bv"), "cell").limit(0)
    else:
        b = index.rows.select(F.col(base_id).alias("bid"), _usable(vector).alias("bv"), "cell")
    return _nearest(b, q, sizes, k, base_id, query_id, search)


def recall(exact: DataFrame, approximate: DataFrame, *, query_id: str, base_id: str) -> DataFrame:
    """Share of the exact neighbours that the approximate search found, per query."""
    hits = approximate.select(query_id, base_id).withColumn("hit", F.lit(1))
    joined = exact.select(query_id, base_id).join(hits, [query_id, base_id], "left")
    return joined.groupBy(query_id).agg(
        F.count("*").alias("neighbours"),
        (F.count("hit") / F.count("*")).alias("recall"),
    )
