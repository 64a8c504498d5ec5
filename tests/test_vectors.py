import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from touchmark.operators import embedding, infer, set_join, vectors
from touchmark.operators import graph as g


@pytest.fixture(scope="module")
def points(spark):
    rng = np.random.default_rng(3)
    matrix = rng.normal(size=(300, 8))
    matrix[5] = matrix[6] * 2  # same direction: a tie
    matrix[7] = 0.0
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(matrix)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(5)


def brute_force(points, queries, k):
    base = {r["vec_id"]: np.array(r["embedding"], dtype=np.float64) for r in points.collect()}
    expected = {}
    for q in queries.collect():
        v = np.array(q["embedding"], dtype=np.float64)
        scored = [
            (round(1 - v @ b / np.linalg.norm(v) / np.linalg.norm(b), 9) + 0.0, i)
            for i, b in base.items() if np.linalg.norm(b) > 0
        ]
        expected[q["query_id"]] = [i for _, i in sorted(scored)[:k]]
    return expected


# One group for all, and both sides dealt to many.
@pytest.mark.parametrize("rows, asked, n_queries", [(16_384, 4_096, 20), (300, 7, 150), (40, 33, 120)])
def test_knn_exact_in_blocks(spark, points, rows, asked, n_queries):
    rng = np.random.default_rng(4)
    queries = spark.createDataFrame(
        [(i, [float(x) for x in rng.normal(size=8)]) for i in range(n_queries)] + [(999, None), (998, [0.0] * 8)],
        "query_id long, embedding array<float>",
    )
    found = {}
    for r in sorted(
        vectors.knn_exact(points, queries, 7, search=vectors.Search(rows, asked)).collect(),
        key=lambda r: (r["query_id"], r["rank"]),
    ):
        found.setdefault(r["query_id"], []).append(r["vec_id"])
    assert found == brute_force(points, queries.filter("query_id < 900"), 7)
    assert vectors.knn_exact(points.limit(0), queries, 7).count() == 0
    assert vectors.knn_exact(points, queries.limit(0), 7).count() == 0


def test_ivf_probing_all_cells_is_exact(points, tmp_path):
    queries = points.filter("vec_id in (1, 2, 5)").withColumnRenamed("vec_id", "query_id")
    index = vectors.build_ivf(points, str(tmp_path / "ivf"), cells=4)
    assert index.rows.count() == 299  # all but the zero vector
    exact = vectors.knn_exact(points, queries, 5)
    full = vectors.knn_ivf(index, queries, 5, nprobe=4, search=vectors.Search(20, 2))
    scores = vectors.recall(exact, full, query_id="query_id", base_id="vec_id").collect()
    assert [r["recall"] for r in scores] == [1.0, 1.0, 1.0]
    some = vectors.knn_ivf(index, queries, 5, nprobe=1)
    assert 0 < vectors.recall(exact, some, query_id="query_id", base_id="vec_id").agg(
        F.avg("recall")
    ).head()[0] <= 1.0


def test_ivf_reads_only_probed_cells(spark, points, tmp_path, monkeypatch):
    """The files of all other cells could be anything."""
    import os

    vectors.build_ivf(points, str(tmp_path / "ivf"), cells=12)
    index = vectors.InvertedFile(spark, str(tmp_path / "ivf"))  # opened anew, without a fit
    queries = points.filter("vec_id = 1").withColumnRenamed("vec_id", "query_id")
    probed = {r["cell"] for r in vectors.probes(index, queries, 2).collect()}
    before = vectors.knn_ivf(index, queries, 5, nprobe=2).collect()
    rows, spoilt = index.rows, 0
    monkeypatch.setattr(vectors.InvertedFile, "rows", rows)  # its columns are known before the files go
    for folder, _, files in os.walk(tmp_path / "ivf" / "rows"):
        if "cell=" in folder and int(folder.rsplit("=")[-1]) not in probed:
            for file in files:
                with open(os.path.join(folder, file), "wb") as out:
                    out.write(b"not a table")
                spoilt += 1
    assert len(probed) == 2 and spoilt >= 5
    found = vectors.knn_ivf(index, queries, 5, nprobe=2)
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, before))
    with pytest.raises(Exception):  # noqa: B017
        vectors.knn_ivf(index, queries, 5, nprobe=12).collect()


@pytest.mark.parametrize("d", ["sf0.01", "sf0.1"])
def test_recall_at_the_registered_probes(spark, d):
    from touchmark.plans import similarity

    scores = similarity.knn_ivf_recall(spark, f"/root/testdata/{d}").collect()
    assert len(scores) >= 25 and np.mean([r["recall"] for r in scores]) >= 0.9


def test_embed_fn_errors_land_in_status(spark):
    def embed(texts):
        if any(t == "bad" for t in texts):
            raise ValueError("no")
        return [[float(len(t)), 1.0] for t in texts]

    rows = spark.createDataFrame([(1, "abc"), (2, "bad")], "id long, content string").coalesce(1)
    found = {r["id"]: (r["embedding"], r["status"]) for r in embedding.embed_text(rows, embed_fn=embed).collect()}
    assert found == {1: ([3.0, 1.0], ""), 2: (None, "ValueError: no")}


def test_default_embedding_is_normalised(spark):
    rows = spark.createDataFrame([(1, "red shoe"), (2, "red hat"), (3, None)], "id long, content string")
    found = {r["id"]: r for r in embedding.embed_text(rows, dimensions=32).collect()}
    assert np.linalg.norm(found[1]["embedding"]) == pytest.approx(1.0, abs=1e-6)
    assert (found[3]["embedding"], found[3]["status"]) == (None, "no text")


def test_weights_serve_unseen_texts(spark, tmp_path):
    """Weights fitted on some texts, saved, and applied to others, against plain Python."""
    import hashlib
    import math
    import re

    fit = ["the red shoe", "the red hat", "the the blue hat", None, "", "Ünïted été_1"]
    new = ["The HAT, and a hat!", None, "", "nothing known here", "été_1 the"]
    fitted = spark.createDataFrame([(i, t) for i, t in enumerate(fit)], "id long, content string").repartition(3)
    embedding.save_weights(embedding.fit_weights(fitted, dimensions=16), str(tmp_path / "w"))
    weights = embedding.load_weights(spark, str(tmp_path / "w"))
    buckets = lambda t: [int(hashlib.md5(w.lower().encode()).hexdigest()[:8], 16) % 16 for w in re.findall(r"[A-Za-z0-9_]+", t)]
    known = [t for t in fit if t is not None]
    idf = [math.log((len(known) + 1) / (sum(b in buckets(t) for t in known) + 1)) for b in range(16)]
    assert {r["bucket"]: pytest.approx(r["weight"]) for r in weights.collect()} == dict(enumerate(idf))
    rows = spark.createDataFrame([(i, t, 1) for i, t in enumerate(new)], "id long, content string, bucket int")
    for r in embedding.embed_text(rows, weights=weights).collect():
        if r["content"] is None:
            assert (r["embedding"], r["status"]) == (None, "no text")
        else:
            v = np.array([buckets(r["content"]).count(b) * idf[b] for b in range(16)])
            assert r["embedding"] == pytest.approx(list(v / (np.linalg.norm(v) or 1)))
    assert embedding.embed_text(rows.limit(0), weights=weights).count() == 0


def test_similar_sets_against_all_pairs(spark):
    import random

    rng = random.Random(5)
    # A few tags that most sets have, many that few have, sets of one tag, empty and null ones.
    sets = [rng.sample(["a", "b", "c", "d"], rng.randint(0, 4)) + rng.sample([f"t{k}" for k in range(60)], rng.randint(0, 5)) for _ in range(150)]
    sets += [["a", None, "a"], [None], None] + [["a", "b", "c"]] * 40
    items = spark.createDataFrame(list(enumerate(sets)), "creative_id long, theme_tags array<string>")
    kinds = {}
    for tags in sets:
        kind = tuple(sorted({t for t in tags or [] if t}))
        kinds[kind] = kinds.get(kind, 0) + 1
    kinds.pop((), None)
    for threshold in (0.3, 0.5, 0.8, 1.0):
        wanted = {
            (x, y, kinds[x], kinds[y]): len({*x} & {*y}) / len({*x} | {*y})
            for x in kinds for y in kinds if x < y and len({*x} & {*y}) / len({*x} | {*y}) >= threshold
        }
        found = {
            (tuple(r["set_a"]), tuple(r["set_b"]), r["items_a"], r["items_b"]): r["similarity"]
            for r in set_join.similar_sets(items, threshold).collect()
        }
        assert found == wanted


def test_common_tags_alone_make_no_candidates(spark):
    """All sets share four tags, and no two share more: not one pair is formed for the threshold above that."""
    sets = [["a", "b", "c", "d", *(f"t{i}_{k}" for k in range(4))] for i in range(200)]
    items = spark.createDataFrame(list(enumerate(sets)), "creative_id long, theme_tags array<string>")
    kinds = set_join.tag_sets(items, key="creative_id", tags="theme_tags")
    assert set_join.candidates(kinds, 0.5).count() == 0
    assert set_join.candidates(kinds, 0.33).count() == 200 * 199 // 2


def test_batch_infer_keeps_going(spark):
    def answer(asked, *, max_output_tokens, temperature):
        if (asked == "bad").any():
            raise RuntimeError("quota")
        return [text.upper()[:max_output_tokens] for text in asked]

    rows = spark.createDataFrame([(1, "hello"), (2, "bad"), (3, None)], "id long, prompt string").coalesce(1)
    found = {r["id"]: (r["result"], r["status"]) for r in infer.batch_infer(rows, answer, max_output_tokens=3).collect()}
    assert found == {1: ("HEL", ""), 2: (None, "RuntimeError: quota"), 3: (None, "no prompt")}


def test_batch_infer_asks_whole_batches(spark):
    def sizes(asked, *, max_output_tokens, temperature):
        return [str(len(asked))] * len(asked)

    def short(asked, *, max_output_tokens, temperature):
        return []

    rows = spark.createDataFrame([(i, None if i % 5 == 0 else "x") for i in range(20)], "id long, prompt string")
    one = rows.repartition(1)
    answers = {r["result"] for r in infer.batch_infer(one, sizes).filter("prompt IS NOT NULL").collect()}
    assert answers == {"16"}
    states = {r["status"] for r in infer.batch_infer(one, short).filter("prompt IS NOT NULL").collect()}
    assert states == {"ValueError: 0 answers to 1 prompts"}
    assert infer.batch_infer(rows.filter("id < 0"), sizes).count() == 0


def test_best_in_slices(monkeypatch):
    rng = np.random.default_rng(5)
    points = list(rng.normal(size=(30, 4)))
    base = pd.DataFrame({"bid": range(40), "bv": points + points[:10]})  # ties, decided by id
    queries = pd.DataFrame({"qid": range(7), "qv": list(rng.normal(size=(7, 4)))})
    key = ["qid", "distance", "bid"]
    whole = vectors._best(base, queries, 6).sort_values(key).reset_index(drop=True)
    monkeypatch.setattr(vectors, "MATRIX_VALUES", 10)
    found = vectors._best(base, queries, 6)
    pd.testing.assert_frame_equal(found.sort_values(key).reset_index(drop=True), whole, check_dtype=False)
    assert vectors._best(base.iloc[:0], queries, 6).empty


@pytest.fixture(scope="module")
def graph(spark):
    tables = {
        "audience": spark.createDataFrame([(1, "s", "h1")], "audience_id long, segment_name string, hem string"),
        "cookie_registry": spark.createDataFrame(
            [(10, 1, "h1"), (11, None, "h2")], "cookie_id long, audience_id long, hem string"
        ),
        "transactions": spark.createDataFrame(
            [(100, 10, "h1"), (101, None, "h2"), (102, 12, None)], "txn_id long, cookie_id long, hem string"
        ).withColumn("amount_usd", F.lit(1.0)).withColumn("partition_date", F.current_date()),
        "campaigns": spark.createDataFrame([(1, "c")], "campaign_id long, campaign_name string"),
        "creatives": spark.createDataFrame([(5, 1)], "creative_id long, campaign_id long"),
        "pixel_events": spark.createDataFrame(
            [(7, 10, 1, 5)], "event_id long, cookie_id long, campaign_id long, creative_id long"
        ),
    }
    return g.marketing_graph(tables)


def test_paths(graph):
    hops = [g.Hop("has_cookie", "r"), g.Hop("has_transaction", "t")]
    found = g.match_pattern(graph, ("a", "audience"), hops, {"a.segment_name": "s", "t.txn_id": "t"})
    assert [tuple(r) for r in found.collect()] == [("s", 100)]
    back = g.match_pattern(
        graph, ("t", "transactions"), [g.Hop("has_transaction", "r", reverse=True)],
        {"t.txn_id": "t", "r.cookie_id": "c"},
    )
    assert [tuple(r) for r in back.collect()] == [(100, 10)]
    by_hem = g.match_pattern(
        graph, ("r", "cookie_registry"), [g.Hop("has_purchase_identity", "t")],
        {"r.cookie_id": "c", "t.txn_id": "t"},
    )
    assert {tuple(r) for r in by_hem.collect()} == {(10, 100), (11, 101)}
    with pytest.raises(ValueError):
        g.match_pattern(graph, ("a", "audience"), [g.Hop("has_transaction", "t")], {})


def test_null_keys_make_no_edge_and_routes(graph):
    edges = g.graph_edges(graph, ("has_cookie",)).collect()
    assert [(e["source_key"], e["target_key"]) for e in edges] == [("1", "10")]
    t = graph.tables
    routes = g.purchase_routes(t["transactions"], t["audience"], t["cookie_registry"]).collect()
    assert {r["txn_id"]: r["routes"] for r in routes} == {
        100: ["cookie", "audience_hem", "registry_hem"], 101: ["registry_hem"],
    }
    rates = {r["label"]: r["fill_rate"] for r in g.edge_fill_rates(graph).collect()}
    assert rates["has_cookie"] == 0.5 and rates["has_purchase"] == pytest.approx(2 / 3)
