"""Queries over vectors, prompts and labels."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from touchmark.functions.vectors import cosine_distance
from touchmark.operators import embedding, infer, prompts, set_join, vectors
from touchmark.plans.measures import CLASSIFY_SQL
from touchmark.plans.oracle_views import with_views
from touchmark.plans.registry import register
from touchmark.session import new_path
from touchmark.sources import star
from touchmark.sources.tables import load


def _anchors(spark: SparkSession, d: str) -> DataFrame:
    """One query per label: its vector with the smallest id."""
    first = F.min_by("embedding", "vec_id").alias("embedding")
    return load(spark, d, "embeddings").groupBy(F.col("label").alias("query_id")).agg(first)


_ANCHORS = "SELECT label AS query_id, arg_min(embedding, vec_id) AS qv FROM embeddings GROUP BY label"
_DISTANCE = "1 - list_cosine_similarity(CAST({0} AS DOUBLE[]), CAST({1} AS DOUBLE[]))"


@register("cosine_distance", f"""
SELECT vec_id, round({_DISTANCE.format('embedding', 'qv')}, 9) AS distance
FROM embeddings JOIN ({_ANCHORS}) a ON a.query_id = label""")
def cosine(spark: SparkSession, d: str) -> DataFrame:
    anchors = _anchors(spark, d).select(F.col("query_id").alias("label"), F.col("embedding").alias("qv"))
    distance = F.round(cosine_distance(F.col("embedding"), F.col("qv")), vectors.DECIMALS)
    return load(spark, d, "embeddings").join(anchors, "label").select(
        "vec_id", distance.alias("distance")
    )


@register("topk_distance", f"""
SELECT vec_id, round({_DISTANCE.format('embedding', '(SELECT arg_min(embedding, vec_id) FROM embeddings)')}, 9)
  AS distance
FROM embeddings ORDER BY distance, vec_id LIMIT 10""")
def topk_distance(spark: SparkSession, d: str) -> DataFrame:
    rows = load(spark, d, "embeddings")
    query = rows.agg(F.min_by("embedding", "vec_id").alias("q")).head()["q"]
    return vectors.topk_distance(rows, query, 10, key="vec_id").select("vec_id", "distance")


#: The query set of the searches: every twentieth vector, against all rows.
_QUERY_SET = "vec_id % 20 = 0"
_NEAREST = f"""
SELECT * FROM (SELECT *, CAST(ROW_NUMBER() OVER (PARTITION BY query_id ORDER BY distance, vec_id)
    AS INTEGER) AS rank
  FROM (SELECT q.vec_id AS query_id, e.vec_id, round({_DISTANCE.format('e.embedding', 'q.embedding')}, 9) AS distance
        FROM {{base}} e JOIN {{queries}} q ON {{on}})) WHERE rank <= {{k}}"""
_EXACT_SQL = _NEAREST.format(
    base="embeddings", queries=f"(SELECT * FROM embeddings WHERE {_QUERY_SET})", on="true", k=10
)


def _ivf_sql(rounds: int = vectors.ROUNDS) -> str:
    """CTEs ``u`` (unit vectors), ``cells`` (cell, center) and ``placed`` (vec_id, cell), as the index is fitted."""
    distance = "round(1 - list_cosine_similarity(unit, center), 12)"
    nearest = f"QUALIFY ROW_NUMBER() OVER (PARTITION BY vec_id ORDER BY {distance}, cell) = 1"
    parts = [
        """u AS (SELECT vec_id, embedding, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) AS unit
  FROM (SELECT vec_id, embedding, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)
  WHERE list_dot_product(v, v) > 0)""",
        f"""s AS (SELECT *, ROW_NUMBER() OVER (ORDER BY md5(CAST(vec_id AS VARCHAR)), vec_id) - 1 AS pos FROM u
  QUALIFY pos < {vectors.SAMPLE_ROWS})""",
        f"""c0 AS (SELECT pos AS cell, unit AS center FROM s
  WHERE pos < (SELECT greatest(1, least({vectors.MAX_CELLS}, floor(sqrt(COUNT(*))))) FROM u))""",
    ]
    for i in range(rounds):
        parts.append(f"a{i} AS (SELECT vec_id, unit, cell FROM s CROSS JOIN c{i} {nearest})")
        parts.append(f"""c{i + 1} AS (SELECT c.cell, coalesce(m.center, c.center) AS center FROM c{i} c LEFT JOIN (
  SELECT cell, list(x ORDER BY k) AS center FROM (SELECT cell, k, avg(x) AS x FROM (
    SELECT cell, UNNEST(unit) AS x, generate_subscripts(unit, 1) AS k FROM a{i}) GROUP BY cell, k)
  GROUP BY cell) m ON m.cell = c.cell)""")
    parts.append(f"cells AS (SELECT CAST(cell AS INTEGER) AS cell, center FROM c{rounds})")
    parts.append(f"placed AS (SELECT vec_id, embedding, cell FROM u CROSS JOIN cells {nearest})")
    return "WITH " + ",\n".join(parts)


#: Share of the cells that a query probes: the test vectors are mostly noise, with near neighbours in most cells.
_PROBED = 0.8


def _found_sql() -> str:
    distance = "round(1 - list_cosine_similarity(unit, center), 12)"
    probed = f"""(SELECT vec_id, embedding, cell FROM (SELECT * FROM u WHERE {_QUERY_SET}) CROSS JOIN cells
  QUALIFY ROW_NUMBER() OVER (PARTITION BY vec_id ORDER BY {distance}, cell) <= (SELECT ceil({_PROBED} * COUNT(*) - 1e-9) FROM cells))"""
    return _NEAREST.format(base="placed", queries=probed, on="q.cell = e.cell", k=10)


def _query_set(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "embeddings").filter(_QUERY_SET).withColumnRenamed("vec_id", "query_id")


def _index(spark: SparkSession, d: str) -> vectors.InvertedFile:
    return vectors.build_ivf(load(spark, d, "embeddings"), new_path(spark, "ivf"))


@register("knn_exact", _EXACT_SQL)
def knn_exact(spark: SparkSession, d: str) -> DataFrame:
    return vectors.knn_exact(load(spark, d, "embeddings"), _query_set(spark, d), 10)


@register("ivf_assign", f"{_ivf_sql()}\nSELECT vec_id, label, cell FROM placed JOIN embeddings USING (vec_id)")
def ivf_assign(spark: SparkSession, d: str) -> DataFrame:
    """The cell of every vector, from the stored index."""
    return _index(spark, d).rows.select("vec_id", "label", "cell")


@register("ivf_cells", f"""{_ivf_sql()}
SELECT cell, COUNT(p.vec_id) AS n, list_transform(any_value(center), lambda x: round(x, 9)) AS center
FROM cells LEFT JOIN placed p USING (cell) GROUP BY cell""")
def ivf_cells(spark: SparkSession, d: str) -> DataFrame:
    return _index(spark, d).cells.select("cell", "n", F.transform("center", lambda x: F.round(x, 9)).alias("center"))


@register("knn_ivf", f"{_ivf_sql()}\n{_found_sql()}")
def knn_ivf(spark: SparkSession, d: str) -> DataFrame:
    """The nearest rows in the probed cells."""
    index = _index(spark, d)
    nprobe = math.ceil(_PROBED * index.cells.count() - 1e-9)
    return vectors.knn_ivf(index, _query_set(spark, d), 10, nprobe=nprobe)


@register("knn_ivf_all_cells", _EXACT_SQL)
def knn_ivf_all_cells(spark: SparkSession, d: str) -> DataFrame:
    """With every cell probed the search is the exact one."""
    return vectors.knn_ivf(_index(spark, d), _query_set(spark, d), 10, nprobe=vectors.MAX_CELLS)


@register("knn_ivf_recall", f"""{_ivf_sql()}
SELECT e.query_id, COUNT(*) AS neighbours, COUNT(f.vec_id) / COUNT(*) AS recall
FROM ({_EXACT_SQL}) e LEFT JOIN ({_found_sql()}) f ON f.query_id = e.query_id AND f.vec_id = e.vec_id
GROUP BY e.query_id""")
def knn_ivf_recall(spark: SparkSession, d: str) -> DataFrame:
    """Recall of the probed search against the exact one, per query."""
    exact = vectors.knn_exact(load(spark, d, "embeddings"), _query_set(spark, d), 10)
    return vectors.recall(exact, knn_ivf(spark, d), query_id="query_id", base_id="vec_id")


def _embed_sql(fitted: str, rows: str) -> str:
    """CTEs ``weights`` of the texts ``fitted`` and ``embedded`` (id, content, embedding) of ``rows``; both (id, content)."""
    buckets = """SELECT id, CAST('0x' || substr(md5(word), 1, 8) AS BIGINT) % {n} AS bucket
    FROM (SELECT id, lower(UNNEST(regexp_extract_all(content, '[A-Za-z0-9_]+'))) AS word FROM {source})"""
    n = embedding.DIMENSIONS
    return f"""fitted AS ({fitted}), texts AS ({rows}), buckets AS (SELECT UNNEST(generate_series(0, {n - 1})) AS bucket),
weights AS (SELECT b.bucket, ln(((SELECT COUNT(content) FROM fitted) + 1) / (COUNT(DISTINCT id) + 1)) AS weight
  FROM buckets b LEFT JOIN ({buckets.format(n=n, source='fitted')}) f ON f.bucket = b.bucket GROUP BY b.bucket),
scaled AS (SELECT id, bucket, COUNT(*) * any_value(weight) AS x
  FROM ({buckets.format(n=n, source='texts')}) JOIN weights USING (bucket) GROUP BY id, bucket),
sizes AS (SELECT id, sqrt(SUM(x * x)) AS size FROM scaled GROUP BY id),
embedded AS (SELECT t.id, t.content, CASE WHEN t.content IS NOT NULL THEN v END AS embedding
  FROM texts t JOIN (SELECT t.id, list(coalesce(CASE WHEN size > 0 THEN x / size END, 0.0) ORDER BY b.bucket) AS v
    FROM texts t CROSS JOIN buckets b LEFT JOIN scaled s ON s.id = t.id AND s.bucket = b.bucket
    LEFT JOIN sizes z ON z.id = t.id GROUP BY t.id) USING (id))"""


_DOCS = "SELECT doc_id AS id, text AS content FROM documents"


@register("embed_weights", f"""WITH {_embed_sql(_DOCS, _DOCS)}
SELECT CAST(bucket AS INTEGER) AS bucket, round(weight, 9) AS weight FROM weights""")
def embed_weights(spark: SparkSession, d: str) -> DataFrame:
    """The weights of all documents, saved and read again."""
    path = new_path(spark, "weights")
    embedding.save_weights(embedding.fit_weights(load(spark, d, "documents"), "text"), path)
    return embedding.load_weights(spark, path).select("bucket", F.round("weight", 9).alias("weight"))


@register("embed_text", f"""WITH {_embed_sql(_DOCS, _DOCS)}
SELECT id AS doc_id, list_transform(embedding, lambda x: round(x, 9)) AS embedding,
  CASE WHEN content IS NULL THEN 'no text' ELSE '' END AS status FROM embedded""")
def embed_text(spark: SparkSession, d: str) -> DataFrame:
    docs = load(spark, d, "documents").select("doc_id", F.col("text").alias("content"))
    rows = embedding.embed_text(docs, "content")
    return rows.select("doc_id", F.transform("embedding", lambda x: F.round(x, 9)).alias("embedding"), "status")


_SEGMENTS = """SELECT CAST(audience_id AS VARCHAR) AS id, 'Segment: ' || segment_name || '. Age: ' || age_band ||
  '. Gender: ' || gender || '. Income: ' || income_band || '. Country: ' || country_code AS content FROM audience"""
_BRIEFS = """SELECT DISTINCT product_category || ' for ' || country_code AS id,
  'Country: ' || country_code || ', ' || lower(product_category) || ' for all income groups' AS content FROM campaigns"""
_TEXT_DISTANCE = "round(1 - list_cosine_similarity(q.embedding, b.embedding), 9)"


def _segments(spark: SparkSession, d: str) -> DataFrame:
    return star.audience(spark, d).select("audience_id", prompts.segment_content().alias("content"))


@register("text_search", with_views(f""", briefs AS ({_BRIEFS}), segments AS ({_SEGMENTS}),
base AS (WITH {_embed_sql('FROM segments', 'FROM segments')} FROM embedded),
asked AS (WITH {_embed_sql('FROM segments', 'FROM briefs')} FROM embedded)
SELECT q.id AS query_text, CAST(b.id AS BIGINT) AS audience_id, {_TEXT_DISTANCE} AS distance,
  CAST(ROW_NUMBER() OVER (PARTITION BY q.id ORDER BY {_TEXT_DISTANCE}, CAST(b.id AS BIGINT)) AS INTEGER) AS rank
FROM asked q CROSS JOIN base b WHERE list_dot_product(q.embedding, q.embedding) > 0
  AND list_dot_product(b.embedding, b.embedding) > 0
QUALIFY rank <= 5""", "audience", "campaigns"))
def text_search(spark: SparkSession, d: str) -> DataFrame:
    """Segments near to texts that the weights were not fitted on, through a stored index with all cells probed."""
    segments, path = _segments(spark, d), new_path(spark, "weights")
    embedding.save_weights(embedding.fit_weights(segments), path)
    weights = embedding.load_weights(spark, path)
    rows = prompts.ok_rows(embedding.embed_text(segments, weights=weights))
    index = vectors.build_ivf(rows, new_path(spark, "audience-ivf"), key="audience_id")
    briefs = star.campaigns(spark, d).select("product_category", "country_code").distinct().select(
        F.concat_ws(" for ", "product_category", "country_code").alias("query_text"),
        F.concat(F.lit("Country: "), "country_code", F.lit(", "), F.lower("product_category"), F.lit(" for all income groups"))
        .alias("content"),
    )
    asked = prompts.ok_rows(embedding.embed_text(briefs, weights=weights))
    return vectors.knn_ivf(
        index, asked, 5, nprobe=vectors.MAX_CELLS, base_id="audience_id", query_id="query_text"
    )


@register("theme_similarity", with_views(""", sets AS (SELECT list_sort(list_distinct(theme_tags)) AS tags, COUNT(*) AS items
  FROM creatives GROUP BY 1)
SELECT array_to_string(a.tags, '|') AS set_a, array_to_string(b.tags, '|') AS set_b, a.items AS items_a,
  b.items AS items_b, len(list_intersect(a.tags, b.tags)) / len(list_distinct(list_concat(a.tags, b.tags))) AS similarity
FROM sets a JOIN sets b ON a.tags < b.tags
WHERE len(list_intersect(a.tags, b.tags)) / len(list_distinct(list_concat(a.tags, b.tags))) >= 0.5 - 1e-12""", "creatives"))
def theme_similarity(spark: SparkSession, d: str) -> DataFrame:
    """Creatives with creatives, by the tags of their themes."""
    found = set_join.similar_sets(star.creatives(spark, d), 0.5)
    return found.withColumns({c: F.array_join(c, "|") for c in ("set_a", "set_b")})


@register("theme_sets", with_views("""
SELECT array_to_string(list_sort(list_distinct(theme_tags)), '|') AS tag_set, COUNT(*) AS item_count,
  MIN(creative_id) AS first_item FROM creatives GROUP BY 1""", "creatives"))
def theme_sets(spark: SparkSession, d: str) -> DataFrame:
    """The classes of creatives with equal tags, whose pairs ``theme_similarity`` has."""
    sets = set_join.tag_sets(star.creatives(spark, d), key="creative_id", tags="theme_tags")
    return sets.select(F.array_join("tag_set", "|").alias("tag_set"), "item_count", "first_item")


def _price_class(asked: pd.Series, *, max_output_tokens: int, temperature: float) -> list[str]:
    """Stands in for a hosted model: films are premium, banners budget."""
    banner = asked.str.contains("banner", regex=False).map({True: "Budget", False: "Standard"})
    answers = banner.mask(asked.str.contains("film", regex=False), "Premium")
    return answers.str.slice(0, max_output_tokens).tolist()


@register("batch_infer", with_views(f"""
SELECT creative_id, prompt, CASE WHEN contains(prompt, 'film') THEN 'Premium'
  WHEN contains(prompt, 'banner') THEN 'Budget' ELSE 'Standard' END AS result, '' AS status
FROM ({CLASSIFY_SQL}) p""", "creatives"))
def batch_infer(spark: SparkSession, d: str) -> DataFrame:
    asked = prompts.classify_creative(star.creatives(spark, d))
    return infer.batch_infer(asked, _price_class, max_output_tokens=32, temperature=0.0)


@register("classify_creatives")
def classify_creatives(spark: SparkSession, d: str) -> DataFrame:
    """Learns the classes from the labelled documents and applies them to all documents."""
    docs = load(spark, d, "documents").select("doc_id", "text")
    label = F.when(F.col("toxic") == 1, 2.0).when(F.col("quality") == 0, 1.0).otherwise(0.0)
    labels = load(spark, d, "labels").select("doc_id", label.alias("label"))
    model = infer.train_classifier(docs.join(labels, "doc_id"), text="text", label="label")
    return infer.classify(docs, model).select("doc_id", "classification")


_THEMES = """SELECT DISTINCT product_category || ' ' || country_code AS id,
  product_category || '. Country: ' || country_code AS content FROM campaigns"""


@register("recommend_themes", with_views(f""", both_texts AS (
  SELECT 'segment ' || id AS id, content FROM ({_SEGMENTS}) UNION ALL SELECT 'theme ' || id, content FROM ({_THEMES})),
{_embed_sql('FROM both_texts', 'FROM both_texts')}
SELECT CAST(q.id[9:] AS BIGINT) AS audience_id, b.id[7:] AS theme, {_TEXT_DISTANCE} AS distance,
  CAST(ROW_NUMBER() OVER (PARTITION BY q.id ORDER BY {_TEXT_DISTANCE}, b.id) AS INTEGER) AS rank
FROM embedded q CROSS JOIN embedded b WHERE q.id LIKE 'segment %' AND b.id LIKE 'theme %'
QUALIFY rank <= 3""", "audience", "campaigns"))
def recommend_themes(spark: SparkSession, d: str) -> DataFrame:
    """Three of the product themes for every audience segment, by the texts of both."""
    segments = _segments(spark, d).select(F.col("audience_id").cast("string").alias("id"), "content", F.lit("segment").alias("side"))
    themes = star.campaigns(spark, d).select("product_category", "country_code").distinct().select(
        F.concat_ws(" ", "product_category", "country_code").alias("id"),
        F.concat_ws(". Country: ", "product_category", "country_code").alias("content"),
        F.lit("theme").alias("side"),
    )
    both = embedding.embed_text(segments.unionByName(themes), "content")
    return infer.recommend_themes(
        both.filter("side = 'segment'").select(
            F.col("id").cast("bigint").alias("audience_id"), "embedding"
        ),
        both.filter("side = 'theme'").select(F.col("id").alias("theme"), "embedding"),
    )
