"""Exact top-k by inner product over a pivot-distance index: annuli around pivots, left out by the triangle inequality."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from touchmark.llm.common import read, register, stored
from touchmark.session import new_path

#: Sums of products below this are exact in doubles, and one order of summing gives what another gives.
_EXACT = float(1 << 53)
_LONG = 2**63 - 1
#: Scores that a task holds at once.
_SCORES = 1 << 21


@dataclass(frozen=True)
class IndexRules:
    """Sizes of the index. They decide how much work is saved, never what is found."""

    #: Rows that an annulus is meant to hold, and the most annuli of the index.
    annulus_rows: int = 2048
    max_annuli: int = 4096
    #: Rows that the pivots are fitted on, the least by hash of their vector, and rounds of the fit.
    sample_rows: int = 4096
    fit_rounds: int = 8
    #: Rows of an annulus, and queries, that meet in one group; more are dealt to several.
    group_rows: int = 16_384
    group_queries: int = 4096
    #: Annuli that a query visits in its first rounds; the last round takes all that its bound leaves.
    visits: tuple[int, ...] = (2, 8)


def scaled(vector: str | Column, factor: int = 1024) -> Column:
    """floor(factor * x) of each component as a whole double; null unless all components are finite numbers."""
    column = F.col(vector) if isinstance(vector, str) else vector
    values = F.transform(column, lambda x: F.floor(x.cast("double") * factor).cast("double"))
    # NaN is beyond infinity here.
    finite = F.forall(column, lambda x: x.isNotNull() & (F.abs(x.cast("double")) < float("inf")))
    return F.when(finite, values)


def _matrix(column: pa.ChunkedArray, dimensions: int) -> np.ndarray:
    """Rows of doubles, short ones filled with zeros."""
    lists = column.combine_chunks()
    sizes = lists.value_lengths().to_numpy()
    out = np.zeros((len(lists), dimensions))
    out[np.arange(dimensions) < sizes[:, None]] = lists.flatten().to_numpy()
    return out


def _products(queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Inner products of whole numbers, exact; beyond the range of long they stay at its ends."""
    most = np.abs(queries).max(initial=1) * np.abs(rows).max(axis=1, initial=1) * queries.shape[1]
    if most.max(initial=0) < _EXACT:
        return (queries @ rows.T).astype("int64")
    out = np.empty((len(queries), len(rows)), "int64")
    long = most < _LONG / 2
    out[:, long] = queries.astype("int64") @ rows[long].astype("int64").T if long.any() else 0
    for i in np.flatnonzero(~long):  # Python's whole numbers for components near the ends of long
        row = [int(x) for x in rows[i]]
        out[:, i] = [min(max(sum(int(a) * b for a, b in zip(q, row)), -_LONG), _LONG) for q in queries]
    return out


def fit_pivots(vectors: np.ndarray, count: int, rounds: int) -> np.ndarray:
    """Pivots: spread seeds, each the sample row farthest from those before, moved to the means of their rows."""
    pivots = vectors[:1]
    far = ((vectors - pivots[0]) ** 2).sum(1)
    while len(pivots) < count and far.max() > 0:
        pivots = np.vstack([pivots, vectors[far.argmax()]])
        far = np.minimum(far, ((vectors - pivots[-1]) ** 2).sum(1))
    for _ in range(rounds):
        near = _distances(vectors, pivots).argmin(1)
        pivots = np.stack([vectors[near == i].mean(0) if (near == i).any() else p for i, p in enumerate(pivots)])
    return pivots


def _distances(rows: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.stack([np.sqrt(((rows - p) ** 2).sum(1)) for p in pivots], 1)


@dataclass(frozen=True)
class PivotIndex:
    """Rows (id, v, annulus), a folder per annulus, and what a search needs to know of them."""

    rows: DataFrame
    pivots: np.ndarray
    #: One row per annulus: pivot, annulus, least, most (distance), norm (greatest), n. At most max_annuli.
    annuli: pa.Table
    rules: IndexRules


def build_index(
    vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", rules: IndexRules = IndexRules()
) -> PivotIndex | None:
    """Every vector keyed by its nearest pivot and its distance from it; None when no vector takes part.

    Only the pivots come from a sample. Annuli are cut at quantiles of the distances of a pivot, so equal
    distances, however many, share an annulus; a search deals its rows to several groups. Vectors that are
    null or hold null or non-finite components take no part; missing components of short ones count as zero.
    """
    base = vectors.select(F.col(key).cast("long").alias("id"), scaled(vector).alias("v")).filter("v IS NOT NULL")
    base = stored(base, "vectors")
    total, dimensions = base.agg(F.count("*"), F.max(F.size("v"))).first()
    if not total:
        return None
    dimensions = max(dimensions, 1)
    wanted = min(max(total // rules.annulus_rows, 1), rules.max_annuli)
    n_pivots = max(int(wanted**0.5), 1)
    sample = base.select("v").orderBy(F.xxhash64("v"), "v").limit(rules.sample_rows).toArrow()
    pivots = fit_pivots(_matrix(sample["v"], dimensions), n_pivots, rules.fit_rounds)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = _matrix(pa.chunked_array([batch.column("v")]), dimensions)
            away = _distances(rows, pivots)
            near = away.argmin(1) if len(rows) else np.zeros(0, int)
            columns = [*batch.columns, np.sqrt((rows**2).sum(1)), near.astype("int32"), away[np.arange(len(rows)), near]]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["id", "v", "norm", "pivot", "distance"])

    placed = stored(base.mapInArrow(place, "id long, v array<double>, norm double, pivot int, distance double"), "placed")
    # Quantiles come as mergeable summaries: one row per pivot, however many rows it has.
    rings = max(wanted // n_pivots, 1)
    marks = [i / rings for i in range(1, rings)]
    cuts = placed.groupBy("pivot").agg(
        (F.percentile_approx("distance", F.array(*map(F.lit, marks)), F.lit(1000)) if marks else F.array()).cast(
            "array<double>"
        ).alias("cuts")
    )
    cut = placed.join(F.broadcast(cuts), "pivot")
    ring = F.size(F.filter("cuts", lambda c: c < F.col("distance")))
    cut = cut.withColumn("annulus", F.col("pivot") * rings + ring)
    annuli = cut.groupBy("pivot", "annulus").agg(
        F.min("distance").alias("least"), F.max("distance").alias("most"), F.max("norm").alias("norm"), F.count("*").alias("n")
    )
    path, rows = new_path(vectors.sparkSession, "annuli"), cut.select("id", "v", "annulus")
    # Adaptive execution splits a crowded annulus into several files.
    rows.hint("rebalance", "annulus").write.partitionBy("annulus").parquet(path)
    return PivotIndex(vectors.sparkSession.read.schema(rows.schema).parquet(path), pivots, annuli.toArrow(), rules)


def _bounds(queries: np.ndarray, pivots: np.ndarray, annuli: pa.Table) -> np.ndarray:
    """An upper bound of the inner product of each query with any row of each annulus.

    With d the distance of q and x, 2 q.x = |q|^2 + |x|^2 - d^2, and d is at least the gap between q's
    distance from the pivot and those of the annulus. |q| |x| is a bound as well. Rounding is allowed for.
    """
    t = {c: annuli[c].to_numpy() for c in ("pivot", "least", "most", "norm")}
    size = np.sqrt((queries**2).sum(1))[:, None]
    away = _distances(queries, pivots)[:, t["pivot"]]
    gap = np.maximum(np.maximum(t["least"] - away, away - t["most"]), 0)
    slack = 1e-9 * (size + t["norm"] + away + 1) ** 2
    return np.minimum((size**2 + t["norm"] ** 2 - gap**2) / 2, size * t["norm"]) + slack


def _probes(asking: DataFrame, index: PivotIndex, dimensions: int, upto: int | None) -> DataFrame:
    """(query, qid, q, annulus, least): the next annuli of each query, best bound first, while they can hold a result.

    ``asking`` has seen the annuli up to ``done`` and has ``least``, the k-th best score so far or null.
    """
    pivots, annuli = index.pivots, index.annuli
    names = annuli["annulus"].to_numpy()

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            step = max(1, _SCORES // len(names))
            for part in (batch.slice(at, step) for at in range(0, batch.num_rows, step)):
                bounds = _bounds(_matrix(pa.chunked_array([part.column("q")]), dimensions), pivots, annuli)
                order = np.argsort(-bounds, axis=1, kind="stable")[:, :upto]
                ranked = np.take_along_axis(bounds, order, 1)
                least = part.column("least").cast("double").fill_null(-np.inf).to_numpy(zero_copy_only=False)
                done = part.column("done").to_numpy()
                # A score that equals the k-th best may win by its id.
                open_ = (ranked >= least[:, None]) & (np.arange(order.shape[1]) >= done[:, None])
                row, at = np.nonzero(open_)
                taken = part.take(pa.array(row))
                yield pa.RecordBatch.from_arrays(
                    [taken.column("query"), taken.column("qid"), taken.column("q"), pa.array(names[order[row, at]], pa.int32())],
                    ["query", "qid", "q", "annulus"],
                )

    return asking.mapInArrow(choose, "query long, qid long, q array<double>, annulus int")


def _best(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best, by falling score, then id."""
    if len(scores) > k:
        edge = np.partition(scores, len(scores) - k)[len(scores) - k]
        some = np.flatnonzero(scores >= edge)
    else:
        some = np.arange(len(scores))
    return some[np.lexsort((ids[some], -scores[some]))][:k]


def _visit(probes: DataFrame, index: PivotIndex, dimensions: int, k: int) -> DataFrame:
    """(query, id, score): the k best rows of each annulus that a query visits.

    Rows of an annulus and the queries that visit it meet in groups of bounded size; a crowded annulus
    is dealt to several groups, as are many queries of one.
    """
    rules, sizes = index.rules, dict(zip(index.annuli["annulus"].to_pylist(), index.annuli["n"].to_pylist()))
    # A row per annulus, at most max_annuli; those that no query visits are not read.
    asked = {r["annulus"]: r["count"] for r in probes.groupBy("annulus").count().collect()}
    dealt = [(a, -(-sizes[a] // rules.group_rows), -(-n // rules.group_queries)) for a, n in asked.items()]
    parts = probes.sparkSession.createDataFrame(dealt, "annulus int, row_parts int, query_parts int")
    parts = F.broadcast(parts)
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = probes.join(parts, "annulus").withColumn("i", F.pmod(F.xxhash64("query"), F.col("query_parts")).cast("int"))
    left = left.select(F.col("annulus").alias("of"), "i", every("row_parts").alias("j"), "query", "qid", "q")
    right = index.rows.filter(F.col("annulus").isin(list(asked))).join(parts, "annulus")
    right = right.withColumn("j", F.pmod(F.xxhash64("id", "v"), F.col("row_parts")).cast("int"))
    right = right.select("annulus", every("query_parts").alias("i2"), F.col("j").alias("j2"), "id", "v")

    def search(asking: pa.Table, rows: pa.Table) -> pa.Table:
        queries, vectors = _matrix(asking["q"], dimensions), _matrix(rows["v"], dimensions)
        own = asking["qid"].combine_chunks().to_numpy(zero_copy_only=False)
        given = rows["id"].combine_chunks()
        ids, null = given.fill_null(_LONG).to_numpy(), given.is_null().to_numpy(zero_copy_only=False)
        which, found, scores, step = [], [], [], max(1, _SCORES // max(len(ids), 1))
        for at in range(0, len(queries), step):
            for i, row in enumerate(_products(queries[at : at + step], vectors), at):
                other = np.flatnonzero((ids != own[i]) | null)
                best = other[_best(ids[other], row[other], k)]
                which.append(np.full(len(best), i))
                found.append(best)
                scores.append(row[best])
        which, found, scores = (np.concatenate(x).astype("int64") if x else np.zeros(0, "int64") for x in (which, found, scores))
        return pa.table({"query": asking["query"].take(pa.array(which)), "id": given.take(pa.array(found)), "score": scores})

    groups = left.groupBy("of", "i", "j").cogroup(right.groupBy("annulus", "i2", "j2"))
    return groups.applyInArrow(search, "query long, id long, score long")


def search_index(index: PivotIndex, queries: DataFrame, k: int = 10, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k rows of the greatest inner product with each query, exact.

    A query visits the annuli in the order of their bounds, some in each round, and stops once the next
    bound is below its k-th best score. Equal scores go to the smaller id, null ids last. Rows with the
    query's own id are no candidates; repeated rows are candidates each. Queries equal in id and vector are
    one; the same id with another vector asks on its own.
    """
    dimensions = index.pivots.shape[1]
    asking = queries.select(F.col(key).cast("long").alias("qid"), scaled(vector).alias("q"))
    asking = asking.filter("q IS NOT NULL AND qid IS NOT NULL").distinct()
    # Components beyond those of all rows meet zeros only.
    asking = asking.select(F.xxhash64("qid", "q").alias("query"), "qid", F.slice("q", 1, dimensions).alias("q"))
    asking = stored(asking.withColumns({"least": F.lit(None).cast("long"), "done": F.lit(0)}), "queries")
    ranking = Window.partitionBy("query").orderBy(F.desc("score"), F.col("id").isNull(), "id")
    best = None
    for upto in (*index.rules.visits, None):
        if upto is not None and upto >= index.annuli.num_rows:
            continue
        probes = stored(_probes(asking, index, dimensions, upto), "probes")
        found = _visit(probes, index, dimensions, k)
        found = found if best is None else found.union(best.drop("rank"))
        ranked = found.withColumn("rank", F.row_number().over(ranking)).filter(F.col("rank") <= k)
        best = stored(ranked, "best")
        if upto is not None:
            least = best.filter(F.col("rank") == k).select("query", F.col("score").alias("least"))
            asking = asking.select("query", "qid", "q", F.lit(upto).alias("done")).join(least, "query", "left")
            asking = stored(asking, "asking")
    return best.join(asking.select("query", "qid"), "query").select(
        F.col("qid").alias("query_id"), "rank", F.col("id").alias("vec_id"), "score"
    )


def top_k(
    vectors: DataFrame, queries: DataFrame, k: int = 10, key: str = "vec_id", vector: str = "embedding",
    rules: IndexRules = IndexRules(),
) -> DataFrame:
    """``search_index`` over an index of all rows; an empty table, or one without usable vectors, gives no rows."""
    index = build_index(vectors, key, vector, rules)
    if index is None:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    return search_index(index, queries, k, key, vector)


@register("op12_pivot_topk")
def op12_pivot_topk(spark: SparkSession, d: str) -> DataFrame:
    rows = read(spark, d, "embeddings")
    return top_k(rows, rows.filter("vec_id % 100 = 0"), 10)
