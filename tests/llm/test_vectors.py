"""Operators on vectors, against plain Python and numpy."""

import math
import random

import numpy as np
import pytest

from touchmark.llm import topk, whitening
from touchmark.llm.common import QUERIES, read


def usable(v):
    return v is not None and all(x is not None and math.isfinite(x) for x in v)


def rows_of(df):
    return [(r["vec_id"], r["embedding"]) for r in df.collect()]


# --- exact top-k


def plain_topk(rows, asking, k=10):
    """{(query, rank): (vec_id, score)} for queries of distinct ids."""
    known = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows if usable(v)]
    out = {}
    for qid, q in asking:
        if not usable(q):
            continue
        q = [math.floor(1024 * x) for x in q]
        found = [(sum(a * b for a, b in zip(q, v)), i) for i, v in known if i is None or i != qid]
        found.sort(key=lambda x: (-x[0], x[1] is None, x[1] or 0))
        out |= {(qid, rank): (i, score) for rank, (score, i) in enumerate(found[:k], 1)}
    return out


def found_topk(df):
    rows = df.collect()
    out = {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in rows}
    assert len(out) == len(rows)
    return out


def test_topk(spark, data):
    rows = rows_of(read(spark, data, "embeddings"))
    wanted = plain_topk(rows, [r for r in rows if r[0] % 100 == 0])
    assert found_topk(QUERIES["op12_pivot_topk"](spark, data)) == wanted and len(wanted) == 50


SMALL = topk.IndexRules(annulus_rows=6, max_annuli=30, sample_rows=50, group_rows=5, group_queries=3, visits=(1, 3))


@pytest.mark.parametrize("rules", [topk.IndexRules(), SMALL])
def test_topk_ties_and_clusters(spark, rules):
    """Equal vectors, a third of all rows on one of them, small whole numbers with many equal scores."""
    rng = random.Random(11)
    centers = [[rng.uniform(-5, 5) for _ in range(6)] for _ in range(5)]
    rows = [(i, [round(x + rng.gauss(0, 0.2), 2) for x in rng.choice(centers)]) for i in range(200)]
    rows += [(200 + i, [1.0, 0.0, 0.0, 0.0, 0.0, 0.0]) for i in range(150)]
    rows += [(350 + i, [float(rng.randint(-1, 1)) for _ in range(6)]) for i in range(100)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)
    asking = [r for r in rows if r[0] % 20 == 0]
    got = found_topk(topk.top_k(df, df.filter("vec_id % 20 = 0"), 10, rules=rules))
    assert got == plain_topk(rows, asking)


def test_topk_leaves_annuli_out(spark):
    """Far clusters are not visited, by queries that are no rows of the index."""
    rng = np.random.default_rng(2)
    centers = rng.normal(0, 30, (12, 8))
    vectors = centers[rng.integers(0, 12, 600)] + rng.normal(0, 0.3, (600, 8))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>")
    asking = [(1000 + i, v.tolist()) for i, v in enumerate(vectors[:30] + 0.01)]
    queries = spark.createDataFrame(asking, "vec_id long, embedding array<double>")
    index = topk.build_index(df, rules=SMALL)
    assert found_topk(topk.search_index(index, queries, 5)) == plain_topk(rows_of(df), asking, 5)
    first = plain_topk(rows_of(df), asking, 5)
    known = spark.createDataFrame([(i, first[i, 5][1]) for i, _ in asking], "qid long, least long")
    told = queries.select(topk.F.col("vec_id").alias("qid"), topk.scaled("embedding").alias("q")).join(known, "qid")
    told = told.select(topk.F.col("qid").alias("query"), "qid", "q", "least", topk.F.lit(0).alias("done"))
    probes = topk._probes(told, index, 8, None)
    assert probes.count() < 0.5 * len(asking) * index.annuli.num_rows


def test_topk_odd(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (0, [1.0, 2.0]), (20, None), (40, [nan, 1.0]), (60, [1.0, None]), (80, [inf, 0.0]), (100, []), (120, [3.0]),
        (140, [-1.0, -0.0004]), (None, [9.0, 9.0]), (7, [5.0, 5.0]), (7, [5.0, 5.0]), (160, [1e30, -1e30]), (180, [3e6, 1e7]),
    ]
    df = spark.createDataFrame([(*r, 1, "x", 2.0) for r in rows], "vec_id long, embedding array<double>, rank int, id string, score double")
    ends = lambda x: min(max(x, -(2**63) + 1), 2**63 - 1)
    limited = [(i, [min(max(x, -(2.0**53)), 2.0**53) for x in v] if usable(v) else v) for i, v in rows]
    wanted = plain_topk(limited, [r for r in limited if r[0] is not None and r[0] % 20 == 0], 20)
    for rules in (topk.IndexRules(), SMALL):
        got = found_topk(topk.top_k(df, df.filter("vec_id % 20 = 0"), 20, rules=rules))
        assert got.keys() == wanted.keys()
        # Scores beyond long stay at its ends; ids are as wanted where these are told apart.
        assert {k: v[1] for k, v in got.items()} == {k: ends(v[1]) for k, v in wanted.items()}
        assert all(got[k][0] == wanted[k][0] for k in got if k[0] in (0, 100, 140))
    assert topk.top_k(df.limit(0), df, 10).count() == 0
    assert topk.top_k(df, df.limit(0), 10).count() == 0
    assert topk.top_k(df.filter("vec_id = 20"), df, 10).count() == 0


# --- whitening


def plain_whitening(rows, upto=4):
    """n, sums and, of the covariance in plain numpy: eigenvalues, components, trace."""
    listed = sorted({tuple(math.floor(256 * c) for c in v) for _, v in rows if usable(v)})
    n, d = len(listed), max(map(len, listed))
    listed = [v + (0,) * (d - len(v)) for v in listed]
    sums = [sum(v[i] for v in listed) for i in range(d)]
    centred = np.array(listed, float) - np.array(sums) / n
    _, singular, components = np.linalg.svd(centred, full_matrices=False)
    return n, sums, singular[:upto] ** 2 / n, components[:upto], (centred**2).sum() / n


def check_whitening(rows, found, tolerance=1e-8):
    n, sums, values, components, trace = plain_whitening(rows)
    known = {i: [math.floor(256 * c) for c in v] for i, v in rows if usable(v)}
    got = {(r["vec_id"], r["component"]): r for r in found.collect()}
    kept = [k for k in range(len(values)) if values[k] > 1e-12 * values[0]]
    assert got.keys() == {(i, k + 1) for i in known for k in kept}
    for k in kept:
        signs = set()
        for i, x in known.items():
            x = x + [0] * (len(sums) - len(x))
            r = got[i, k + 1]
            assert r["n"] == n and r["deviation"] == sum((n * a - s) ** 2 for a, s in zip(x, sums))
            white = sum((a - s / n) * c for a, s, c in zip(x, sums, components[k])) / math.sqrt(values[k])
            assert abs(r["explained"] / (values[k] / trace) - 1) < 1e-9 and 0 <= r["identity_error"] < 1e-6
            if abs(white) > 1e-6:
                signs.add(white * r["whitened"] > 0)
            assert abs(abs(white) - abs(r["whitened"])) < tolerance * max(1, abs(white))
        assert len(signs) <= 1


def test_whitening(spark, data):
    rows = rows_of(read(spark, data, "embeddings"))
    check_whitening(rows, QUERIES["op13_cholesky_whitening"](spark, data))


def test_whitening_of_uneven_directions(spark):
    """Scales from 1 to 10^5, repeated vectors, a constant and a dependent dimension."""
    rng = np.random.default_rng(7)
    points = rng.normal(0, 1, (300, 6)) * [1, 10, 100, 1000, 1e4, 1e5] @ np.linalg.qr(rng.normal(size=(6, 6)))[0]
    points = np.hstack([points, np.full((300, 1), 3.0), points[:, :1]])
    rows = [(i, v.tolist()) for i, v in enumerate(points)]
    rows += [(300 + i, rows[i % 3][1]) for i in range(150)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(5)
    check_whitening(rows, whitening.whiten(df), 1e-6)


def test_whitening_of_few_rows(spark):
    rows = [(0, [1.0, 2.0, 3.0, 4.0]), (1, [1.0, 2.5, 3.0, 4.0]), (2, [4.0, 2.0, 3.0, 9.0]), (3, [1.0, 2.0, 3.0, 4.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    check_whitening(rows, whitening.whiten(df))


def test_whitening_odd(spark):
    nan, inf = float("nan"), float("inf")
    good = [(0, [1.0, 2.0]), (1, [-0.001, 7.0]), (2, [3.0]), (3, []), (4, [1e6, -1e6])]
    bad = [(5, None), (6, [nan, 1.0]), (7, [1.0, None]), (8, [inf, 0.0])]
    df = spark.createDataFrame([(*r, 1, 2.0) for r in good + bad], "vec_id long, embedding array<double>, n int, whitened double")
    check_whitening(good + bad, whitening.whiten(df))
    twice = whitening.whiten(df.union(df))
    assert twice.count() == 2 * whitening.whiten(df).count() and twice.filter("n != 5").count() == 0
    huge = spark.createDataFrame([(0, [1e30, 1.0]), (1, [-1e30, 2.0]), (2, [5.0, 9.0])], "vec_id long, embedding array<double>")
    assert whitening.whiten(huge).filter("whitened IS NULL OR isnan(whitened)").count() == 0
    assert whitening.whiten(df.filter("vec_id = 0")).count() == whitening.whiten(df.limit(0)).count() == 0
    assert whitening.whiten(df.filter("vec_id > 4")).count() == 0
