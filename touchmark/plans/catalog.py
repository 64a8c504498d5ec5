"""Queries over the metadata catalog and the glossary."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from touchmark.functions import scalars as s
from touchmark.operators import discover
from touchmark.operators import glossary as gl
from touchmark.plans.oracle_views import discovery_views, glossary_sql, with_views
from touchmark.plans.registry import register
from touchmark.session import new_path
from touchmark.sources import star
from touchmark.sources.links import LinkTable
from touchmark.sources.sinks import read_proposals, write_proposals
from touchmark.sources.tables import load


def _columns(spark: SparkSession, d: str) -> DataFrame:
    return gl.catalog_columns(star.catalog_entries(spark, d))


def _terms(spark: SparkSession, d: str, owner: str = "supplier") -> DataFrame:
    return gl.terms_flatten(star.glossary_tree(spark, d, owner))


_BLANK_SLUG = r"trim(regexp_replace(lower({0}), '[^a-z0-9]+', '-', 'g'), '-')"


def _slug(x: str) -> str:
    slug = _BLANK_SLUG.format(x)
    return f"CASE WHEN regexp_matches({slug}, '^[0-9]') THEN 't-' || {slug} ELSE {slug} END"


# --- scalar functions over whole columns ---------------------------------------------------


@register("normalize_name", r"""
SELECT p_partkey, trim(replace(lower(' ' || p_brand || '-' || p_name || ' '), '-', '_'), E' \t\n\r')
  AS normalized FROM part""")
def normalize_name(spark: SparkSession, d: str) -> DataFrame:
    text = F.concat(F.lit(" "), "p_brand", F.lit("-"), "p_name", F.lit(" "))
    return load(spark, d, "part").select("p_partkey", s.normalize_name(text).alias("normalized"))


@register("slugify", f"""
SELECT page_id, {_slug('url')} AS url_slug, {_slug("page_id || ' ' || url")} AS numbered_slug
FROM pages""")
def slugify(spark: SparkSession, d: str) -> DataFrame:
    numbered = F.concat_ws(" ", F.col("page_id").cast("string"), "url")
    return load(spark, d, "pages").select(
        "page_id", s.slugify(F.col("url")).alias("url_slug"),
        s.slugify(numbered).alias("numbered_slug"),
    )


@register("link_slug", "SELECT p_partkey, translate(lower(p_brand || ' ' || p_type || '_' || p_name),"
          " ' _', '--') AS slug FROM part")
def link_slug(spark: SparkSession, d: str) -> DataFrame:
    text = F.concat("p_brand", F.lit(" "), "p_type", F.lit("_"), "p_name")
    return load(spark, d, "part").select("p_partkey", s.link_slug(text).alias("slug"))


@register("synonym_target", glossary_sql(r"""
SELECT name, term_ord,
  NULLIF(regexp_extract(description, '^[Ss]ynonym\s+for\s+(\w[\w_-]*)', 1), '') AS target
FROM terms""", "terms", owner="supplier"))
def synonym_target(spark: SparkSession, d: str) -> DataFrame:
    target = s.synonym_target(F.col("description"))
    return _terms(spark, d, "supplier").select("name", "term_ord", target.alias("target"))


_STOP = ", ".join(f"'{w}'" for w in s.STOP_WORDS)
_TOKENS = (
    "list_filter(regexp_extract_all(lower({0}), '[a-z][a-z0-9_]*'),"
    f" lambda w: length(w) > 1 AND w NOT IN ({_STOP}))"
)


@register("tokenize_description", f"""
SELECT doc_id, word, COUNT(*) AS occurrences
FROM (SELECT doc_id, UNNEST({_TOKENS.format('text')}) AS word FROM documents)
GROUP BY doc_id, word""")
def tokenize_description(spark: SparkSession, d: str) -> DataFrame:
    words = F.explode(s.tokenize_description(F.col("text"))).alias("word")
    counted = load(spark, d, "documents").select("doc_id", words).groupBy("doc_id", "word")
    return counted.agg(F.count("*").alias("occurrences"))


@register("hash_email", "SELECT c_custkey, sha256(lower(trim(' ' || c_name || '@Example.com ')))"
          " AS hem FROM customer")
def hash_email(spark: SparkSession, d: str) -> DataFrame:
    email = F.concat(F.lit(" "), "c_name", F.lit("@Example.com "))
    return load(spark, d, "customer").select("c_custkey", s.hash_email(email).alias("hem"))


@register("parse_entry_id", """
SELECT p_partkey AS table_ord, 'demo' AS project, '@lake' AS entry_group,
  lower(replace(p_brand, '#', '_')) AS namespace, lower(p_type) || '_' || p_partkey AS table_name
FROM part""")
def parse_entry_id(spark: SparkSession, d: str) -> DataFrame:
    parts = F.split(s.entry_id(F.col("name")), "/").alias("parts")
    return star.catalog_entries(spark, d).select("*", parts).select(
        "table_ord",
        s.path_segment(F.col("resource"), "projects").alias("project"),
        s.path_segment(F.col("name"), "entryGroups").alias("entry_group"),
        s.entry_namespace(F.col("parts")).alias("namespace"),
        s.entry_table(F.col("parts")).alias("table_name"),
    )


# --- catalog and terms ---------------------------------------------------------------------


@register("catalog_columns", with_views(
    "SELECT namespace, table_name, CAST(position AS INTEGER) AS position, column_name, description"
    " FROM catalog", "catalog"))
def catalog_columns(spark: SparkSession, d: str) -> DataFrame:
    return _columns(spark, d).select(
        "namespace", "table_name", "position", "column_name", "description"
    )


@register("terms_flatten", glossary_sql("""
SELECT glossary_id, term_ord.category_ord AS category_ord, term_ord.term_position AS term_position, category,
  name, display_name, description, array_to_string(synonyms, '|') AS synonyms,
  array_to_string(related, '|') AS related, array_to_string(tables, '|') AS tables
FROM terms""", "terms", owner="supplier"))
def terms_flatten(spark: SparkSession, d: str) -> DataFrame:
    return _terms(spark, d, "supplier").select(
        "glossary_id", "term_ord.category_ord", "term_ord.term_position", "category", "name",
        "display_name", "description",
        *[F.array_join(c, "|").alias(c) for c in ("synonyms", "related", "tables")],
    )


_MENTIONS = f"""
SELECT glossary_id, name, display_name, category, term_ord, kind, mention_ord, mentioned,
  {_slug('mentioned')} AS slug
FROM (
  SELECT glossary_id, name, display_name, category, term_ord, 'synonym' AS kind, UNNEST(synonyms) AS mentioned,
    UNNEST(generate_series(0, len(synonyms) - 1)) AS mention_ord FROM terms WHERE len(synonyms) > 0
  UNION ALL
  SELECT glossary_id, name, display_name, category, term_ord, 'related', UNNEST(related),
    UNNEST(generate_series(len(synonyms), len(synonyms) + len(related) - 1)) FROM terms WHERE len(related) > 0
) q"""
_IMPLIED = f"""
SELECT glossary_id, slug AS name, mentioned AS display_name, category,
  CASE kind WHEN 'synonym' THEN 'Synonym of ' ELSE 'Related term of ' END || display_name AS description
FROM ({_MENTIONS}) m WHERE NOT EXISTS (
  SELECT 1 FROM terms k WHERE k.glossary_id = m.glossary_id AND k.name = m.slug)
QUALIFY ROW_NUMBER() OVER (PARTITION BY glossary_id, slug ORDER BY term_ord, mention_ord) = 1"""


@register("implied_terms", glossary_sql(_IMPLIED, "terms", owner="supplier"))
def implied_terms(spark: SparkSession, d: str) -> DataFrame:
    return gl.implied_terms(_terms(spark, d)).drop("first_mention")


@register("term_links", glossary_sql(f"""
SELECT DISTINCT m.glossary_id, kind AS link_type, least(m.name, slug) AS term_a, greatest(m.name, slug) AS term_b,
  kind || '-' || least(m.name, slug) || '-' || greatest(m.name, slug) AS link_id
FROM ({_MENTIONS}) m
JOIN (SELECT glossary_id, name FROM terms UNION SELECT glossary_id, name FROM ({_IMPLIED}) i) k
  ON k.glossary_id = m.glossary_id AND k.name = m.slug""",
    "terms", owner="supplier"))
def term_links(spark: SparkSession, d: str) -> DataFrame:
    terms = _terms(spark, d, "supplier")
    return gl.term_links(terms, gl.implied_terms(terms))


@register("table_terms", glossary_sql("""
SELECT glossary_id, tab AS "table", string_agg(display_name, ', ' ORDER BY term_ord) AS term_names,
  COUNT(*) AS term_count
FROM (SELECT glossary_id, UNNEST(tables) AS tab, display_name, term_ord FROM terms) GROUP BY ALL""",
    "terms", owner="supplier"))
def table_terms(spark: SparkSession, d: str) -> DataFrame:
    return gl.table_terms(_terms(spark, d, "supplier"))


# --- matching ------------------------------------------------------------------------------

# The matching rules once more, spelled out over all (term, column) pairs.
_MATCHING = {
    "uniq": """SELECT t.* FROM terms t WHERE NOT EXISTS (
  SELECT 1 FROM terms l WHERE l.glossary_id = t.glossary_id AND l.term_key = t.term_key AND l.term_ord > t.term_ord)""",
    "cols": "SELECT *, namespace || '/' || table_name AS full_table FROM catalog",
    "hit": "SELECT glossary_id, term_key FROM uniq WHERE term_key IN (SELECT column_key FROM cols)",
    "rest": "SELECT * FROM uniq WHERE (glossary_id, term_key) NOT IN (SELECT (glossary_id, term_key) FROM hit)",
    "prose": r"""SELECT *, lower(replace(via, '-', '_')) AS target FROM (
  SELECT *, regexp_extract(description, '^[Ss]ynonym\s+for\s+(\w[\w_-]*)', 1) AS via FROM rest) q
WHERE (glossary_id, lower(replace(via, '-', '_'))) IN (SELECT (glossary_id, term_key) FROM hit)""",
    "listed": """SELECT *, lower(replace(via, '-', '_')) AS target FROM (
  SELECT *, UNNEST(list_distinct(synonyms)) AS via FROM rest) q
WHERE lower(replace(via, '-', '_')) IN (SELECT column_key FROM cols)""",
    "unmatched": """SELECT * FROM rest WHERE (glossary_id, term_key) NOT IN (
  SELECT (glossary_id, term_key) FROM prose UNION ALL SELECT (glossary_id, term_key) FROM listed)""",
    "exact": """SELECT glossary_id, display_name AS glossary_term, category, u.description, full_table AS "table",
  column_name AS "column", 'exact' AS match_type, '' AS via_synonym, 100 AS match_score,
  'exact match' AS match_rationale, 0 AS phase, term_ord, table_ord, position
FROM uniq u JOIN cols c ON c.column_key = u.term_key""",
    **{
        name: f"""SELECT glossary_id, display_name AS glossary_term, category, v.description, full_table AS "table",
  column_name AS "column", 'synonym' AS match_type, via AS via_synonym, 100 AS match_score,
  'synonym for ' || via AS match_rationale, {phase} AS phase, term_ord, table_ord, position
FROM {source} v JOIN cols c ON c.column_key = v.target"""
        for name, source, phase in (("synonym", "prose", 1), ("synonym_list", "listed", 2))
    },
    "words": f"""SELECT glossary_id, term_key, UNNEST(ws) AS keyword, UNNEST(generate_series(0, len(ws) - 1)) AS pos
FROM (SELECT glossary_id, term_key, {_TOKENS.format('description')} AS ws FROM unmatched) q WHERE len(ws) > 0""",
    "hits": """SELECT w.glossary_id, w.term_key, keyword, pos, full_table, column_name, table_ord, position,
  CASE WHEN keyword = lower(column_name) THEN 'exact' WHEN contains(lower(column_name), keyword)
    THEN 'substr' WHEN contains(lower(full_table), keyword) THEN 'table' END AS kind
FROM words w CROSS JOIN cols""",
    "fuzzy": """SELECT u.glossary_id, display_name AS glossary_term, category, u.description, full_table AS "table",
  column_name AS "column", 'fuzzy' AS match_type, '' AS via_synonym,
  CAST(SUM(CASE kind WHEN 'exact' THEN 10 WHEN 'substr' THEN 5 ELSE 3 END) AS INTEGER) AS match_score,
  string_agg(kind || ':' || keyword, ', ' ORDER BY pos) AS match_rationale, 3 AS phase, term_ord,
  table_ord, position
FROM hits h JOIN unmatched u ON u.glossary_id = h.glossary_id AND u.term_key = h.term_key
WHERE kind IS NOT NULL GROUP BY ALL""",
}
_FIELDS = ("glossary_id", *gl.PROPOSAL_COLUMNS)
_NINE = ", ".join(f'"{c}"' for c in gl.PROPOSAL_COLUMNS)
_TEN = ", ".join(f'"{c}"' for c in _FIELDS)
#: Least score of a keyword proposal: a keyword equal to the column name, or two inside it.
_THRESHOLD = 10


def _matching_sql(sql: str, uniq: str = _MATCHING["uniq"]) -> str:
    """``sql`` after the matching views; they need the term and catalog views first."""
    prefix = glossary_sql("", "terms", "catalog", owner="supplier").rstrip()
    return prefix + ",\n" + ",\n".join(f"{n} AS ({v})" for n, v in (_MATCHING | {"uniq": uniq}).items()) + "\n" + sql


@register("related_entries", _matching_sql(
    "SELECT glossary_id, display_name AS glossary_term, project, full_table, column_name"
    " FROM uniq JOIN cols ON column_key = term_key"))
def related_entries(spark: SparkSession, d: str) -> DataFrame:
    return gl.related_entries(_terms(spark, d), _columns(spark, d))


@register("match_exact", _matching_sql(f"SELECT {_TEN} FROM exact"))
def match_exact(spark: SparkSession, d: str) -> DataFrame:
    return gl.match_exact(_terms(spark, d), _columns(spark, d)).select(*_FIELDS)


@register("match_synonym", _matching_sql(f"SELECT {_TEN} FROM synonym"))
def match_synonym(spark: SparkSession, d: str) -> DataFrame:
    return gl.match_synonym(_terms(spark, d), _columns(spark, d)).select(*_FIELDS)


@register("match_synonym_list", _matching_sql(f"SELECT {_TEN} FROM synonym_list"))
def match_synonym_list(spark: SparkSession, d: str) -> DataFrame:
    return gl.match_synonym_list(_terms(spark, d), _columns(spark, d)).select(*_FIELDS)


@register("terms_x_columns", _matching_sql("""
SELECT glossary_id, term_key, pos AS keyword_pos, keyword, kind, full_table, column_name FROM hits
WHERE kind IS NOT NULL"""))
def terms_x_columns(spark: SparkSession, d: str) -> DataFrame:
    """The scoring part of all (unmatched term, column) pairs, a row per keyword that hits."""
    columns = _columns(spark, d)
    hits = gl.keyword_hits(gl.unmatched_terms(_terms(spark, d), columns), columns)
    return hits.select("glossary_id", "term_key", "keyword_pos", "keyword", "kind", "full_table", "column_name")


@register("match_fuzzy", _matching_sql(f"SELECT {_TEN} FROM fuzzy"))
def match_fuzzy(spark: SparkSession, d: str) -> DataFrame:
    return gl.match_fuzzy(_terms(spark, d), _columns(spark, d), threshold=0).select(*_FIELDS)


@register("fuzzy_threshold", _matching_sql(f"SELECT {_TEN} FROM fuzzy WHERE match_score >= 10"))
def fuzzy_threshold(spark: SparkSession, d: str) -> DataFrame:
    found = gl.match_fuzzy(_terms(spark, d), _columns(spark, d), threshold=10)
    return found.select(*_FIELDS)


@register("rank_proposals", _matching_sql("""
SELECT term_ord.glossary_ord AS glossary_ord, term_ord.category_ord AS category_ord,
  term_ord.term_position AS term_position, "table", "column", match_score FROM fuzzy
ORDER BY term_ord, match_score DESC, table_ord, position"""))
def rank_proposals(spark: SparkSession, d: str) -> DataFrame:
    ranked = gl.rank_proposals(
        gl.match_fuzzy(_terms(spark, d), _columns(spark, d), threshold=0, written_out=False)
    )
    return ranked.select("term_ord.*", "table", "column", "match_score")


_ALL = " UNION ALL ".join(
    f"SELECT * FROM {n}"
    for n in ("exact", "synonym", "synonym_list", f"fuzzy WHERE match_score >= {_THRESHOLD}")
)


def _proposals(spark: SparkSession, d: str) -> DataFrame:
    return gl.proposals(_terms(spark, d), _columns(spark, d), _THRESHOLD)


@register("proposals", _matching_sql(f"SELECT {_TEN} FROM ({_ALL})"))
def proposals(spark: SparkSession, d: str) -> DataFrame:
    return _proposals(spark, d).select(*_FIELDS)


@register("proposal_rows", _matching_sql(
    f'SELECT phase, glossary_id, glossary_term, "table", "column" FROM ({_ALL})'))
def proposal_rows(spark: SparkSession, d: str) -> DataFrame:
    return _proposals(spark, d).select("phase", "glossary_id", "glossary_term", "table", "column")


def _known(spark: SparkSession, d: str) -> DataFrame:
    """The inventory without the tables of small parts, which are unknown to the catalog."""
    sizes = load(spark, d, "part").select(F.col("p_partkey").alias("table_ord"), "p_size")
    return _columns(spark, d).join(sizes, "table_ord").filter(F.col("p_size") > 5)


def _proposed(spark: SparkSession, d: str) -> tuple[gl.Matches, ...]:
    return gl.proposals(_terms(spark, d), _columns(spark, d), _THRESHOLD, rows=False)


def _apply(spark: SparkSession, d: str, found: tuple[gl.Matches, ...], table: LinkTable) -> tuple[gl.Matches, ...]:
    return gl.apply_links(found, _known(spark, d), table.links(), order=gl.APPLY_ORDER)


def _created(results: tuple[gl.Matches, ...]) -> tuple[gl.Matches, ...]:
    return tuple(part.of_pairs("status = 'created'") for part in results)


def _linked(spark: SparkSession, d: str) -> LinkTable:
    """A table with the links of an earlier run: the exact matches of promo tables, known or not."""
    table = LinkTable(spark, new_path(spark, "links"))
    found = gl.match_exact(_terms(spark, d), _columns(spark, d), rows=False).of_places(F.contains("full_table", F.lit("/promo")))
    done = gl.apply_links((found,), _columns(spark, d), table.links(), order=gl.APPLY_ORDER)
    table.upsert(_created(done), "run-1")
    return table


def _applied(spark: SparkSession, d: str) -> tuple[gl.Matches, ...]:
    """All proposals applied to a table that holds some of the links."""
    return _apply(spark, d, _proposed(spark, d), _linked(spark, d))


def _second_run(spark: SparkSession, d: str) -> tuple[tuple[gl.Matches, ...], LinkTable]:
    """All proposals, and the table after a second run applied them."""
    found, table = _proposed(spark, d), _linked(spark, d)
    table.upsert(_created(_apply(spark, d, found, table)), "run-2")
    return found, table


_READABLE = """'definition-' || translate(lower(glossary_term), ' _', '--') || '-' || split_part("table", '/', 1)
    || '-' || translate(split_part("table", '/', 2), '_', '-') || '-' || translate(lower("column"), ' _', '--')"""
_WHOLE = """concat_ws(chr(31), glossary_id, glossary_term, split_part("table", '/', 1), split_part("table", '/', 2),
    "column")"""
# A link that was made before, or is proposed earlier in the batch for the same term and column.
_APPLY_SQL = f"""
SELECT glossary_id, glossary_term, "table" || '.' || "column" AS table_column,
  left({_READABLE}, 30) || '-' || left(sha256({_WHOLE}), 32) AS link_id,
  CASE WHEN NOT known THEN 'error'
    WHEN (glossary_id, glossary_term, "table", "column") IN (
      SELECT (glossary_id, glossary_term, "table", "column") FROM exact WHERE contains("table", '/promo')) THEN 'skipped'
    WHEN ROW_NUMBER() OVER (PARTITION BY known, glossary_id, glossary_term, "table", "column"
      ORDER BY phase, term_ord, match_score DESC, table_ord, position, via_synonym) > 1 THEN 'skipped'
    ELSE 'created' END AS status
FROM (SELECT *, table_ord IN (SELECT p_partkey FROM part WHERE p_size > 5) AS known FROM ({_ALL}) a) b"""


@register("apply_links", _matching_sql(_APPLY_SQL))
def apply_links(spark: SparkSession, d: str) -> DataFrame:
    return gl.written_out(_applied(spark, d))


@register("apply_summary", _matching_sql(
    f"SELECT status, COUNT(*) AS result_count FROM ({_APPLY_SQL}) GROUP BY status"))
def apply_summary(spark: SparkSession, d: str) -> DataFrame:
    return gl.apply_summary(_applied(spark, d))


_AGAIN_SQL = f"""
SELECT glossary_id, glossary_term, table_column, link_id,
  CASE WHEN status = 'created' THEN 'skipped' ELSE status END AS status FROM ({_APPLY_SQL})"""


@register("apply_links_again", _matching_sql(_AGAIN_SQL))
def apply_links_again(spark: SparkSession, d: str) -> DataFrame:
    """A second run over the table that the first one wrote to makes no link."""
    found, table = _second_run(spark, d)
    return gl.written_out(_apply(spark, d, found, table))


@register("link_table", _matching_sql(f"""
SELECT link_id, glossary_id, glossary_term, table_column, 'run-2' AS run_id FROM ({_APPLY_SQL}) WHERE status = 'created'
UNION ALL SELECT DISTINCT left({_READABLE}, 30) || '-' || left(sha256({_WHOLE}), 32), glossary_id, glossary_term,
  "table" || '.' || "column", 'run-1' FROM exact WHERE contains("table", '/promo')"""))
def link_table(spark: SparkSession, d: str) -> DataFrame:
    """What is stored after two runs."""
    return _second_run(spark, d)[1].read().drop("bucket")


@register("apply_dry_run", _matching_sql(f"""
SELECT glossary_id, glossary_term, table_column, link_id, 'dry-run' AS status FROM ({_APPLY_SQL})"""))
def apply_dry_run(spark: SparkSession, d: str) -> DataFrame:
    """What would be linked; nothing is looked up and nothing written."""
    return gl.written_out(
        gl.apply_links(_proposed(spark, d), _columns(spark, d), (), order=gl.APPLY_ORDER, dry_run=True)
    )


# A term that is only mentioned has no synonyms of its own and stands where it is first mentioned.
_IMPLIED_TERMS = f"""SELECT *, lower(replace(display_name, '-', '_')) AS term_key, CAST([] AS VARCHAR[]) AS synonyms
FROM ({_IMPLIED.replace('SELECT glossary_id, slug', 'SELECT glossary_id, term_ord, slug', 1)})
QUALIFY ROW_NUMBER() OVER (PARTITION BY glossary_id, term_key ORDER BY term_ord DESC, name DESC) = 1"""


@register("match_implied", _matching_sql(f"SELECT {_TEN} FROM ({_ALL})", _IMPLIED_TERMS))
def match_implied(spark: SparkSession, d: str) -> DataFrame:
    """Proposals for the terms that others only mention."""
    terms = gl.implied_as_terms(gl.implied_terms(_terms(spark, d)))
    return gl.proposals(terms, _columns(spark, d), _THRESHOLD).select(*_FIELDS)


@register("sink_proposals", _matching_sql(f"""
SELECT * EXCLUDE (drop_) REPLACE (CASE WHEN drop_ = 0 THEN NULL ELSE glossary_term END AS glossary_term,
    CASE WHEN drop_ = 1 THEN '' ELSE "column" END AS "column"),
  CASE drop_ WHEN 0 THEN 'glossary_term' WHEN 1 THEN 'column' END AS missing_field, drop_ > 1 AS is_valid
FROM (SELECT {_NINE}, table_ord % 5 AS drop_ FROM exact)"""))
def sink_proposals(spark: SparkSession, d: str) -> DataFrame:
    """Exact matches written for curation, some of them spoilt by it, and read back with validation."""
    path = new_path(spark, "proposals")
    part = F.col("table_ord") % 5
    found = gl.match_exact(_terms(spark, d), _columns(spark, d)).withColumns(
        {
            "glossary_term": F.when(part != 0, F.col("glossary_term")),
            "column": F.when(part == 1, "").otherwise(F.col("column")),
        }
    )
    write_proposals(found.select(*gl.PROPOSAL_COLUMNS), path)
    return read_proposals(spark, path)


# --- metadata ------------------------------------------------------------------------------


@register("metadata_coverage", with_views("""
SELECT namespace || '/' || table_name AS full_table, COUNT(*) AS column_count,
  COUNT(description) AS described, COUNT(*) - COUNT(description) AS undescribed
FROM catalog GROUP BY ALL""", "catalog"))
def metadata_coverage(spark: SparkSession, d: str) -> DataFrame:
    columns = _columns(spark, d)
    return gl.metadata_coverage(columns, columns.filter(F.col("description").isNotNull()))


@register("description_diff", with_views("""
SELECT full_table, column_name, was AS old_description, new AS new_description,
  CASE WHEN was = new THEN 'unchanged' WHEN was = '(no description)' THEN 'new' ELSE 'changed' END AS change
FROM (SELECT namespace || '/' || table_name AS full_table, column_name,
    COALESCE(description, '(no description)') AS was,
    CASE position WHEN 0 THEN 'Stock of ' || replace(column_name, '_', ' ')
      WHEN 1 THEN 'Size of the part' ELSE '(no description)' END AS new FROM catalog)""", "catalog"))
def description_diff(spark: SparkSession, d: str) -> DataFrame:
    columns = _columns(spark, d)
    new = F.when(
        F.col("position") == 0, F.concat(F.lit("Stock of "), F.translate("column_name", "_", " "))
    ).when(F.col("position") == 1, "Size of the part")
    return gl.description_diff(columns, columns.withColumn("description", new))


_KEYED = {
    "campaigns": {"campaign_id": "integer", "advertiser": "string"},
    "creatives": {"creative_id": "integer", "campaign_id": "integer"},
    "cookie_registry": {"cookie_id": "integer", "visitor_id": "integer", "device_id": "integer"},
    "pixel_events": {"event_id": "integer", "cookie_id": "integer", "campaign_id": "integer"},
}


@register("semantic_discovery", with_views("""
SELECT t.table_name, t.column_name, t.word, e.own_key, e.other_table, e.other_key
FROM (VALUES ('cookie_registry', 'visitor_id', 'visitor'), ('campaigns', 'advertiser', 'advertiser'))
  t(table_name, column_name, word)
LEFT JOIN (
  SELECT child_table AS table_name, child_column AS own_key, parent_table AS other_table,
    parent_column AS other_key FROM fk
  UNION ALL SELECT parent_table, parent_column, child_table, child_column FROM fk
) e ON e.table_name = t.table_name""", extra=discovery_views(_KEYED)))
def semantic_discovery(spark: SparkSession, d: str) -> DataFrame:
    """Which tables hold visitor or advertiser data, and how do they join?"""
    tables = {t: getattr(star, t)(spark, d).select(*columns) for t, columns in _KEYED.items()}
    names = [(t, c) for t, columns in _KEYED.items() for c in columns]
    inventory = spark.createDataFrame(names, "table_name string, column_name string")
    inventory = inventory.withColumn("column_key", s.normalize_name(F.col("column_name")))
    return gl.semantic_discovery(
        ("visitor", "advertiser"), inventory, discover.foreign_keys(tables)
    )
