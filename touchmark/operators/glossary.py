"""Matching glossary terms to catalog columns.

Comparing every term with every column is avoided: names are equi-joined on their normal form, and
a keyword contained in a column or table name is found by joining the keyword with the name's own
substrings. Terms with equal keywords, and columns that hold the same keywords in the same way, are
classes: a pair of classes is matched once and its rows are written out last, from chunks of both sides,
so shuffles move chunks instead of pairs. Inventories are small files that fan out, so their estimates say
nothing of their rows; joins that have no bound are hinted to merge, which spills, instead of broadcasting.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from touchmark.functions import scalars as s
from touchmark.session import stored

PROPOSAL_COLUMNS = (
    "glossary_term", "category", "description", "table", "column", "match_type", "via_synonym",
    "match_score", "match_rationale",
)
EXACT_SCORE = 100
# Points of a keyword equal to the column name, inside it, inside the table name.
POINTS = {"exact": 10, "substr": 5, "table": 3}
#: Members of a chunk of terms and of columns: the rows of a pair of chunks come from one row of a shuffle.
TERM_CHUNK, PLACE_CHUNK = 1024, 4096
#: Rows that a task writes out, about.
TASK_ROWS = 4_000_000
#: Chunks of places that one range of ranked rows is made of, and places that are broadcast to the ranges.
RANGE_CHUNKS, BROADCAST_PLACES = 512, 500_000
#: Distinct keywords that are broadcast to the parts of the names.
BROADCAST_WORDS = 500_000
#: Tables that are broadcast to tell known from unknown ones.
BROADCAST_TABLES = 500_000
#: Longest readable part of a link id; with a hyphen and 32 hexadecimal digits it makes 63 characters.
LINK_HEAD = 30


# --- catalog -------------------------------------------------------------------------------


def catalog_columns(entries: DataFrame, namespace: str | None = None) -> DataFrame:
    """Column inventory of described catalog entries: one row per table column, all entries.

    ``entries`` has ``name`` (resource path), ``entry_type``, ``resource``, ``table_ord`` and
    ``aspects``, a map whose values hold ``data.fields``.
    """
    parts = F.split(s.entry_id(F.col("name")), "/").alias("parts")
    found = (
        entries.filter(F.contains(F.lower("entry_type"), F.lit("table")))
        .select("*", parts)
        .select(
            s.entry_namespace(F.col("parts")).alias("namespace"),
            s.entry_table(F.col("parts")).alias("table_name"),
            s.path_segment(F.col("resource"), "projects").alias("project"),
            "table_ord",
            F.posexplode(
                F.flatten(F.transform(F.map_values("aspects"), lambda a: a["data"]["fields"]))
            ).alias("position", "field"),
        )
        .select(
            "namespace", "table_name", "project", "table_ord", "position",
            F.col("field.name").alias("column_name"),
            F.col("field.description").alias("description"),
        )
        .filter(F.coalesce(F.col("column_name"), F.lit("")) != "")
        .withColumn("column_key", s.normalize_name(F.col("column_name")))
        .withColumn("full_table", full_table(F.col("namespace"), F.col("table_name")))
    )
    return found if namespace is None else found.filter(F.col("namespace") == namespace)


def full_table(namespace: Column, table: Column) -> Column:
    return F.when(namespace == "", table).otherwise(F.concat_ws("/", namespace, table))


# --- terms ---------------------------------------------------------------------------------


def terms_flatten(tree: DataFrame) -> DataFrame:
    """Glossary, category, term trees as one row per term, in order of appearance."""
    categories = tree.select(
        "glossary_id", "glossary_ord",
        F.posexplode("categories").alias("category_ord", "category_node"),
    )
    rows = categories.select(
        "glossary_id", "glossary_ord", "category_ord",
        s.title_case(F.translate(_node_name("category_node"), "-", " ")).alias("category"),
        F.posexplode("category_node.terms").alias("position", "term"),
    )
    order = F.struct("glossary_ord", "category_ord", F.col("position").alias("term_position"))
    return rows.select(
        "glossary_id", _node_name("term").alias("name"), "term.display_name", "term.description",
        "term.synonyms", "term.related", "term.tables", "term.business_context", "category", order.alias("term_ord"),
        s.normalize_name(F.col("term.display_name")).alias("term_key"),
    )


def _node_name(node: str) -> Column:
    """A node's name, by default the slug of its display name."""
    return F.coalesce(F.col(f"{node}.name"), s.slugify(F.col(f"{node}.display_name")))


def unique_terms(terms: DataFrame) -> DataFrame:
    """One term per glossary and normalised name: the last one's content."""
    row = F.struct(*terms.columns)
    return terms.groupBy("glossary_id", "term_key").agg(F.max_by(row, "term_ord").alias("t")).select("t.*")


def implied_terms(terms: DataFrame) -> DataFrame:
    """Terms that only exist as a synonym or related name in their glossary; the first mention names them."""
    mentions = _mentions(terms).withColumn("slug", s.slugify(F.col("mentioned")))
    known = terms.select("glossary_id", F.col("name").alias("slug")).distinct()
    kind = F.when(F.col("kind") == "synonym", "Synonym").otherwise("Related term")
    new = mentions.join(known, ["glossary_id", "slug"], "left_anti").select(
        "glossary_id", "slug",
        F.struct(
            "term_ord", "mention_ord", "mentioned", "category",
            F.concat(kind, F.lit(" of "), F.col("display_name")).alias("description"),
        ).alias("first"),
    )
    return new.groupBy("glossary_id", "slug").agg(F.min("first").alias("first")).select(
        "glossary_id",
        F.col("slug").alias("name"),
        F.col("first.mentioned").alias("display_name"),
        F.col("first.description").alias("description"),
        F.col("first.category").alias("category"),
        F.col("first.term_ord").alias("first_mention"),
    )


def implied_as_terms(implied: DataFrame) -> DataFrame:
    """Implied terms in the form that the matching takes: without synonyms, in the order of their first mention."""
    return implied.select(
        "glossary_id", "name", "display_name", "description", "category",
        F.array().cast("array<string>").alias("synonyms"), F.struct("first_mention", "name").alias("term_ord"),
        s.normalize_name(F.col("display_name")).alias("term_key"),
    )


def _mentions(terms: DataFrame) -> DataFrame:
    """Names a term lists: its synonyms, then its related terms."""
    tag = lambda names, kind: F.transform(
        F.coalesce(F.col(names), F.array()), lambda n: F.struct(F.lit(kind).alias("kind"), n.alias("mentioned"))
    )
    both = F.concat(tag("synonyms", "synonym"), tag("related", "related"))
    own = ("glossary_id", "name", "display_name", "category", "term_ord")
    return terms.select(*own, F.posexplode(both).alias("mention_ord", "m")).select(
        *own, "mention_ord", "m.kind", "m.mentioned"
    )


def term_links(terms: DataFrame, implied: DataFrame) -> DataFrame:
    """Undirected links between terms of one glossary, one per kind and pair."""
    known = terms.select("glossary_id", "name").unionByName(implied.select("glossary_id", "name")).distinct()
    known = known.withColumnRenamed("name", "other")
    links = _mentions(terms).withColumn("other", s.slugify(F.col("mentioned"))).join(known, ["glossary_id", "other"])
    low, high = F.least("name", "other"), F.greatest("name", "other")
    return links.select(
        "glossary_id", F.col("kind").alias("link_type"), low.alias("term_a"), high.alias("term_b"),
        F.concat_ws("-", "kind", low, high).alias("link_id"),
    ).distinct()


def table_terms(terms: DataFrame) -> DataFrame:
    """Display names of the terms of each table, joined by commas in order of appearance.

    The list goes into one metadata field of the table and is kept per glossary; all its members
    come from one glossary row, so no group is larger than that row.
    """
    rows = terms.select(
        "glossary_id", F.explode("tables").alias("table"), "term_ord", "display_name"
    )
    ordered = F.sort_array(F.collect_list(F.struct("term_ord", "display_name")))
    names = F.array_join(F.transform(ordered, lambda t: t["display_name"]), ", ")
    return rows.groupBy("glossary_id", "table").agg(names.alias("term_names"), F.count("*").alias("term_count"))


# --- classes and chunks --------------------------------------------------------------------


def _chunks(rows: DataFrame, key: str, size: int, name: str) -> DataFrame:
    """(key, <name>_chunk, <name>, <name>_n): the rows of each key dealt to chunks of about ``size``, as arrays; stored."""
    members = [c for c in rows.columns if c != key]
    counts = rows.groupBy(key).agg(F.ceil(F.count("*") / size).alias("chunks"))
    chunk = F.pmod(F.xxhash64(*members), "chunks").alias(f"{name}_chunk")
    # Dealt by the chunk, so that a key of very many rows is not one task's.
    dealt = rows.join(counts.hint("merge"), key).select(*rows.columns, chunk).repartition(key, f"{name}_chunk")
    held = F.sort_array(F.collect_list(F.struct(*members))).alias(name)
    chunks = dealt.groupBy(key, f"{name}_chunk").agg(held, F.count("*").alias(f"{name}_n"))
    return stored(chunks, f"{name}-chunks")


@dataclass(frozen=True)
class Matches:
    """Matches that are not written out: each term of a pair's ``term_class`` with each place of its ``place_class``.

    ``terms`` and ``places`` are read several times, so they should be stored. Rows get ``columns``, or all there are.
    """

    pairs: DataFrame
    terms: DataFrame
    places: DataFrame
    columns: tuple[Column, ...] = ()

    def of_pairs(self, condition: str) -> Matches:
        return replace(self, pairs=self.pairs.filter(condition))

    def of_places(self, condition: Column) -> Matches:
        return replace(self, places=self.places.filter(condition))

    def _chunked(self) -> tuple[list[str], DataFrame, dict[str, DataFrame]]:
        """The pairs' own columns, the pairs with the keys of their chunks, and the chunks."""
        kept = [c for c in self.pairs.columns if c not in ("term_class", "place_class")]
        held = {
            "place": _chunks(self.places, "place_class", PLACE_CHUNK, "place"),
            "term": _chunks(self.terms, "term_class", TERM_CHUNK, "term"),
        }
        each = self.pairs
        for name, chunks in held.items():
            each = each.join(chunks.select(f"{name}_class", f"{name}_chunk", f"{name}_n").hint("merge"), f"{name}_class")
        held = {name: chunks.drop(f"{name}_n") for name, chunks in held.items()}
        return kept, stored(each, "chunk-pairs"), held

    def rows(self) -> DataFrame:
        """All rows. Pairs meet the chunks of terms, then those of places; the rows are made in the last join's tasks.

        The bytes of chunks say nothing of the rows they become, so that join has a task for every ``TASK_ROWS`` of them.
        """
        kept, each, held = self._chunked()
        key = ["place_class", "place_chunk"]
        made, dealt = each.agg(F.sum(F.col("term_n") * F.col("place_n")), F.count_distinct(*key)).first()
        tasks = max(int(each.sparkSession.conf.get("spark.sql.shuffle.partitions")), min((made or 0) // TASK_ROWS + 1, dealt))
        each = each.join(held["term"].hint("merge"), ["term_class", "term_chunk"]).repartition(tasks, *key)
        each = each.join(held["place"].repartition(tasks, *key).hint("merge"), key)
        # Terms vary fastest, so rows that differ in little stand together.
        rows = each.select(*kept, "term", F.inline("place")).select("*", F.inline("term")).drop("term")
        return rows.select(*self.columns) if self.columns else rows

    def sorted_rows(self, first: tuple[str | Column, ...], then: tuple[str | Column, ...]) -> DataFrame:
        """All rows in the order of ``first``, columns of terms and pairs, and ``then``.

        Terms are dealt to ranges of ``first`` with chunks of places, and the rows are made and sorted in each range: a
        shuffle moves chunks, or only their keys if the places are few enough to be broadcast.
        """
        kept, each, held = self._chunked()
        few = self.places.limit(BROADCAST_PLACES + 1).count() <= BROADCAST_PLACES
        key = ["place_class", "place_chunk"]
        each = each.join(held["term"].hint("merge"), ["term_class", "term_chunk"]).select(*kept, *key, F.inline("term"))
        each = stored(each, "ranked-pairs")
        tasks = max(int(each.sparkSession.conf.get("spark.sql.shuffle.partitions")), each.count() // RANGE_CHUNKS + 1)
        if few:
            dealt = each.repartitionByRange(tasks, *first).sortWithinPartitions(*first).join(F.broadcast(held["place"]), key)
        else:
            dealt = each.join(held["place"].hint("merge"), key).repartitionByRange(tasks, *first).sortWithinPartitions(*first)
        rows = dealt.drop(*key).select("*", F.inline("place")).drop("place")
        return rows.select(*self.columns).sortWithinPartitions(*first, *then)


def _written_out(pairs: DataFrame, terms: DataFrame, places: DataFrame) -> DataFrame:
    """All rows of the pairs (term_class, place_class, ...): each term of the one with each place of the other."""
    return Matches(pairs, terms, places).rows()


def written_out(parts: tuple[Matches, ...]) -> DataFrame:
    """The rows of all parts."""
    return reduce(DataFrame.unionByName, [part.rows() for part in parts])


# --- matches by name -----------------------------------------------------------------------

EXACT, SYNONYM, LISTED, FUZZY = range(4)


def related_entries(terms: DataFrame, columns: DataFrame) -> DataFrame:
    """All columns whose normalised name equals a term's."""
    named = unique_terms(terms).select(
        F.col("term_key").alias("term_class"), "glossary_id", F.col("display_name").alias("glossary_term")
    )
    places = columns.select(F.col("column_key").alias("place_class"), "project", "full_table", "column_name")
    named, places = stored(named, "named-terms"), stored(places, "named-places")
    return _written_out(_same_name(named, places), named, places).select(
        "glossary_id", "glossary_term", "project", "full_table", "column_name"
    )


def _same_name(terms: DataFrame, places: DataFrame) -> DataFrame:
    """The classes that terms and places have in common."""
    held = places.select("place_class").distinct()
    wanted = terms.select("term_class").distinct()
    return wanted.join(held.hint("merge"), F.col("term_class") == F.col("place_class"))


def _proposal(kind: str | Column, via: Column, score: Column, why: Column) -> list[Column]:
    return [
        F.col("glossary_id"),
        F.col("display_name").alias("glossary_term"), F.col("category"), F.col("description"),
        F.col("full_table").alias("table"), F.col("column_name").alias("column"),
        (F.lit(kind) if isinstance(kind, str) else kind).alias("match_type"), via.alias("via_synonym"),
        score.cast("int").alias("match_score"), why.alias("match_rationale"),
        F.col("term_ord"), F.col("table_ord"), F.col("position"),
    ]


_PLACE = ("full_table", "column_name", "table_ord", "position")
# Chunks are sorted in this order: terms that differ only in their glossary stand together.
_TERM = ("display_name", "category", "description", "glossary_id", "term_ord")


def tagged_terms(terms: DataFrame, columns: DataFrame) -> DataFrame:
    """Unique terms with the names they may be found by: a row per ``phase``, ``via`` and ``target``.

    A term matches by its own name; only if no column has that, by the term of its glossary that its
    description calls it a synonym for, one step, and by its listed synonyms. ``matched`` tells the rows
    whose target is a column; ``open`` terms have none. All ways are joined with the columns at once.
    """
    way = lambda phase, via, target: F.struct(F.lit(phase).alias("phase"), via.alias("via"), target.alias("target"))
    described = s.synonym_target(F.col("description"))
    listed = F.transform(
        F.array_distinct(F.coalesce("synonyms", F.array().cast("array<string>"))),
        lambda n: way(LISTED, n, s.normalize_name(n)),
    )
    own = F.array(
        way(EXACT, F.lit(""), F.col("term_key")), way(SYNONYM, described, s.normalize_name(described))
    )
    rows = unique_terms(terms).select("*", F.inline(F.concat(own, listed)))
    rows = rows.filter((F.col("phase") == EXACT) | F.col("target").isNotNull())
    keys = columns.select(F.col("column_key").alias("target"), F.lit(True).alias("_held")).distinct()
    rows = rows.join(keys.hint("merge"), "target", "left").withColumn("_held", F.coalesce("_held", F.lit(False)))
    canonical = F.max(F.col("_held") & (F.col("phase") == EXACT)).over(Window.partitionBy("glossary_id", "target"))
    rows = rows.withColumn("_held", F.col("_held") & ((F.col("phase") != SYNONYM) | canonical))
    term = Window.partitionBy("glossary_id", "term_key")
    by_name = F.max(F.col("_held") & (F.col("phase") == EXACT)).over(term)
    return rows.select(
        *terms.columns, "phase", "via", "target",
        (F.col("_held") & ((F.col("phase") == EXACT) | ~by_name)).alias("matched"),
        (~F.max("_held").over(term)).alias("open"),
    )


def _stored_columns(columns: DataFrame) -> DataFrame:
    """What the matching takes of an inventory; every step reads it again, and its own plan is run once."""
    return stored(columns.select("column_key", *_PLACE), "columns")


def _match_named(tagged: DataFrame, columns: DataFrame) -> Matches:
    """Proposals of all terms that match by a name, with their phase."""
    terms = tagged.filter("matched").select(F.col("target").alias("term_class"), *_TERM, "phase", "via")
    terms = stored(terms, "matched-terms")
    places = columns.select(F.col("column_key").alias("place_class"), *_PLACE)
    exact = F.col("phase") == EXACT
    why = F.when(exact, "exact match").otherwise(F.concat(F.lit("synonym for "), F.col("via")))
    kind = F.when(exact, "exact").otherwise("synonym")
    rows = (*_proposal(kind, F.col("via"), F.lit(EXACT_SCORE), why), F.col("phase"))
    return Matches(_same_name(terms, places), terms, places, rows)


def _match_phase(terms: DataFrame, columns: DataFrame, phase: int) -> Matches:
    columns = _stored_columns(columns)
    return _match_named(tagged_terms(terms, columns).filter(F.col("phase") == phase), columns)


def match_exact(terms: DataFrame, columns: DataFrame, rows: bool = True) -> DataFrame | Matches:
    found = _match_phase(terms, columns, EXACT)
    return found.rows().drop("phase") if rows else found


def unmatched_terms(terms: DataFrame, columns: DataFrame) -> DataFrame:
    """Terms that match no column by name, as a described synonym or by a listed one."""
    return _open(tagged_terms(terms, columns)).select(*terms.columns)


def _open(tagged: DataFrame) -> DataFrame:
    return tagged.filter((F.col("phase") == EXACT) & F.col("open"))


def match_synonym(terms: DataFrame, columns: DataFrame) -> DataFrame:
    """Terms described as "Synonym for X" take the columns of the term X, one step only."""
    return _match_phase(terms, columns, SYNONYM).rows().drop("phase")


def match_synonym_list(terms: DataFrame, columns: DataFrame) -> DataFrame:
    """Terms that name no column take the columns named like one of their listed synonyms."""
    return _match_phase(terms, columns, LISTED).rows().drop("phase")


# --- keyword matches -----------------------------------------------------------------------


def _parts(names: DataFrame) -> DataFrame:
    """(name, keyword): all keyword-like parts of the names; names are short, so these are few, but may repeat.

    Keywords hold only ``[a-z0-9_]`` and start with a letter, so each run of these is taken apart
    on its own, from each of its letters on.
    """
    length = F.length("run")
    runs = names.select("name", F.explode(F.regexp_extract_all("name", F.lit("[a-z0-9_]{2,}"), F.lit(0))).alias("run"))
    starts = runs.select("name", "run", F.explode(F.sequence(F.lit(1), length - 1)).alias("i"))
    starts = starts.filter(F.substring("run", F.col("i"), F.lit(1)) >= "a")
    ends = starts.select("name", "run", "i", F.explode(F.sequence(F.lit(2), length - F.col("i") + 1)).alias("n"))
    return ends.select("name", F.substring("run", F.col("i"), F.col("n")).alias("keyword"))


def _class(texts: Column) -> Column:
    """16 bytes that stand for an array of texts without blanks."""
    return F.unhex(F.md5(F.array_join(texts, " ").cast("binary")))


def _word_classes(terms: DataFrame) -> DataFrame:
    """The terms that have keywords, by ``term_class``: terms of equal keywords in equal order are one class."""
    rows = terms.select("*", s.tokenize_description(F.col("description")).alias("keywords"))
    return rows.filter(F.size("keywords") > 0).withColumn("term_class", _class(F.col("keywords")))


def _place_classes(columns: DataFrame, keywords: DataFrame) -> DataFrame:
    """The columns that hold a keyword, with ``hits`` of (keyword, kind): equal, else inside it, else inside its table.

    Columns of equal hits are one ``place_class``. Rows that are equal as places are one, and ``copies`` tells how many.
    """
    # An inventory is a small file whose rows fan out into many hits: spread it first.
    tasks = int(columns.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    columns = columns.repartition(tasks, "full_table")
    places = columns.groupBy(*_PLACE).agg(F.count("*").alias("copies")).withColumns(
        {"_own": F.lower("column_name"), "_table": F.lower("full_table")}
    )
    # Each distinct name is taken apart once, and only parts that are keywords are kept.
    names = columns.select(F.explode(F.array(F.lower("column_name"), F.lower("full_table"))).alias("name")).distinct()
    parts = _parts(names)
    # A name has many more parts than keywords; few keywords are brought to them.
    few = keywords.limit(BROADCAST_WORDS + 1).count() <= BROADCAST_WORDS
    inside = parts.join(F.broadcast(keywords) if few else keywords.hint("merge"), "keyword")
    # Bounded by the parts of one name.
    found = inside.groupBy("name").agg(F.sort_array(F.collect_set("keyword")).alias("found"))
    held = lambda key, name: found.select(F.col("name").alias(key), F.col("found").alias(name)).hint("merge")
    none = F.array().cast("array<string>")
    placed = places.join(held("_own", "own"), "_own", "left").join(held("_table", "other"), "_table", "left")
    placed = placed.withColumns({"own": F.coalesce("own", none), "other": F.coalesce("other", none)})
    hit = lambda k, kind: F.struct(k.alias("keyword"), kind.alias("kind"))
    mine = F.transform("own", lambda k: hit(k, F.when(k == F.col("_own"), "exact").otherwise("substr")))
    others = F.transform(F.array_except("other", "own"), lambda k: hit(k, F.lit("table")))
    placed = placed.select(*_PLACE, "copies", F.concat(mine, others).alias("hits")).filter(F.size("hits") > 0)
    texts = F.transform("hits", lambda h: F.concat_ws(":", h["kind"], h["keyword"]))
    key = _class(F.concat(F.array(F.col("copies").cast("string")), texts))
    return placed.withColumn("place_class", key)


def _class_hits(terms: DataFrame, places: DataFrame) -> DataFrame:
    """(term_class, place_class, hits) of the classes that share a keyword, a hit per place of the keyword and copy."""
    words = terms.groupBy("term_class").agg(F.first("keywords").alias("keywords"))
    words = words.select("term_class", F.posexplode("keywords").alias("keyword_pos", "keyword"))
    held = places.groupBy("place_class").agg(F.first("hits").alias("hits"), F.first("copies").alias("copies"))
    held = held.select("place_class", F.col("copies").cast("int").alias("copies"), F.inline("hits"))
    hits = words.join(held.hint("merge"), "keyword")
    # Bounded by the keywords of one description.
    ordered = F.sort_array(F.collect_list(F.struct("keyword_pos", "kind", "keyword")))
    grouped = hits.groupBy("term_class", "place_class", "copies").agg(ordered.alias("hits"))
    repeated = F.flatten(F.transform("hits", lambda h: F.array_repeat(h, F.col("copies"))))
    each = F.when(F.col("copies") == 1, F.col("hits")).otherwise(repeated)
    return grouped.select("term_class", "place_class", each.alias("hits"))


def _points(kind: Column) -> Column:
    return F.when(kind == "exact", POINTS["exact"]).when(kind == "substr", POINTS["substr"]).otherwise(POINTS["table"])


def _classes(terms: DataFrame, columns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Terms and places by their classes, stored."""
    terms = stored(_word_classes(terms), "word-terms")
    keywords = terms.select(F.explode("keywords").alias("keyword")).distinct()
    return terms, stored(_place_classes(columns, keywords), "word-places")


def keyword_hits(terms: DataFrame, columns: DataFrame) -> DataFrame:
    """The keyword occurrences that hit a column: equal, else inside it, else inside its table."""
    terms, places = _classes(terms, columns)
    pairs = _class_hits(terms, places)
    members = terms.select("term_class", "glossary_id", "term_key")
    rows = _written_out(pairs, members, places.select("place_class", *_PLACE))
    return rows.select("glossary_id", "term_key", *_PLACE, F.inline("hits")).withColumn("points", _points(F.col("kind")))


def match_fuzzy(terms: DataFrame, columns: DataFrame, threshold: int, written_out: bool = True) -> DataFrame | Matches:
    """Scored proposals of at least ``threshold`` for unmatched terms, repeated keywords counting again.

    At 0 nearly every term is proposed for nearly every column that shares a word with it.
    """
    columns = _stored_columns(columns)
    found = _match_fuzzy(unmatched_terms(terms, columns), columns, threshold)
    return found.rows() if written_out else found


def _match_fuzzy(open_terms: DataFrame, columns: DataFrame, threshold: int) -> Matches:
    terms, places = _classes(open_terms.dropna(subset=["glossary_id", "term_key"]), columns)
    score = F.aggregate("hits", F.lit(0).cast("bigint"), lambda total, h: total + _points(h["kind"]))
    why = F.array_join(F.transform("hits", lambda h: F.concat_ws(":", h["kind"], h["keyword"])), ", ")
    pairs = _class_hits(terms, places).select(
        "term_class", "place_class", score.cast("int").alias("match_score"), why.alias("why")
    )
    # Pairs of classes below the threshold are never written out.
    pairs = fuzzy_threshold(pairs, threshold)
    rows = tuple(_proposal("fuzzy", F.lit(""), F.col("match_score"), F.col("why")))
    return Matches(pairs, terms.select("term_class", *_TERM), places.select("place_class", *_PLACE, "copies"), rows)


def fuzzy_threshold(proposals: DataFrame, threshold: int) -> DataFrame:
    """Keep scores of at least ``threshold``; zero or less keeps all."""
    return proposals.filter(F.col("match_score") >= threshold) if threshold > 0 else proposals


def rank_proposals(proposals: DataFrame | Matches) -> DataFrame:
    """Terms in order, best score first inside each; a range sort, so no term needs one task.

    Matches are dealt to the ranges before their rows are made, all of a term and score to one.
    """
    first, then = ("term_ord", F.col("match_score").desc()), ("table_ord", "position")
    return proposals.sorted_rows(first, then) if isinstance(proposals, Matches) else proposals.orderBy(*first, *then)


def proposals(
    terms: DataFrame, columns: DataFrame, threshold: int, rows: bool = True
) -> DataFrame | tuple[Matches, ...]:
    """Exact, synonym, synonym-list and keyword proposals in one schema, with their order of application."""
    columns = _stored_columns(columns)
    tagged = stored(tagged_terms(terms, columns), "tagged-terms")
    fuzzy = _match_fuzzy(_open(tagged), columns, threshold)
    fuzzy = replace(fuzzy, columns=(*fuzzy.columns, F.lit(FUZZY).alias("phase")))
    parts = (_match_named(tagged, columns), fuzzy)
    return written_out(parts) if rows else parts


# --- applying links ------------------------------------------------------------------------


def link_id(glossary: Column, term: Column, namespace: Column, table: Column, column: Column) -> Column:
    """A readable head and a hash of the whole target, so that no two targets share an id."""
    # Most heads end before the table or the column; a slug is no shorter than its name.
    start, length = F.lit("definition"), lambda name: F.coalesce(F.length(name), F.lit(0))
    room = LINK_HEAD - len("definition") - length(term) - length(namespace)
    tail = lambda name, left: F.when(left > 0, s.link_slug(name))
    readable = F.concat_ws(
        "-", start, s.link_slug(term), namespace, tail(table, room), tail(column, room - length(table))
    )
    whole = F.concat_ws("\x1f", glossary, term, namespace, table, column)
    return F.concat_ws("-", F.substring(readable, 1, LINK_HEAD), F.substring(F.sha2(whole, 256), 1, 32))


def _split_table(name: Column, default_namespace: str) -> tuple[Column, Column]:
    """Namespace and table of a full table name."""
    slash = F.contains(name, F.lit("/"))
    given = F.when(slash, F.substring_index(name, "/", 1)).otherwise(F.lit(""))
    namespace = F.when(given == "", F.lit(default_namespace)).otherwise(given)
    return namespace, F.when(slash, F.substr(name, F.locate("/", name) + 1)).otherwise(name)


def _known_tables(inventory: DataFrame) -> DataFrame:
    """(_namespace, _table, _known), to be joined: few ones are broadcast."""
    tables = inventory.select(
        F.col("namespace").alias("_namespace"), F.col("table_name").alias("_table")
    ).distinct().withColumn("_known", F.lit(True))
    tables = stored(tables, "tables")
    few = tables.limit(BROADCAST_TABLES + 1).count() <= BROADCAST_TABLES
    return F.broadcast(tables) if few else tables.hint("merge")


def apply_links(
    rows: DataFrame | tuple[Matches, ...],
    inventory: DataFrame,
    existing: DataFrame | tuple[Matches, ...],
    *,
    order: tuple[str, ...],
    default_namespace: str = "",
    dry_run: bool = False,
) -> DataFrame | tuple[Matches, ...]:
    """Outcome of linking each proposal: created, skipped or error (unknown table).

    ``existing`` holds the ``link_id``s made before. Inside a batch the first row of a target, by
    ``order``, creates the link and the others, found by another way, are skipped. Rows of one target
    that are equal in ``order`` too are one proposal and share its outcome.

    Parts of ``proposals`` in ``APPLY_ORDER``, held against links stored as such, get their outcome by classes and come
    back as parts, with ``status`` on each pair of classes; all else is decided row by row.
    """
    if isinstance(rows, tuple):
        if not isinstance(existing, DataFrame) and order == APPLY_ORDER:
            return _apply_matches(rows, inventory, existing, default_namespace, dry_run)
        rows = written_out(rows).withColumn("neg_score", -F.col("match_score"))
    namespace, table = _split_table(F.col("table"), default_namespace)
    target = F.concat_ws(".", "table", "column")
    asked = rows.withColumns({"table_column": target, "_namespace": namespace, "_table": table})
    id_of = link_id(*map(F.col, ("glossary_id", "glossary_term", "_namespace", "_table", "column")))
    if dry_run:
        return asked.select(
            "glossary_id", "glossary_term", "table_column", id_of.alias("link_id"), F.lit("dry-run").alias("status")
        )
    if isinstance(existing, tuple):
        none = rows.sparkSession.createDataFrame([], "link_id string")
        existing = written_out(existing) if existing else none
    made = existing.select("link_id").distinct().withColumn("_made", F.lit(True))
    checked = asked.join(_known_tables(inventory), ["_namespace", "_table"], "left").withColumn("link_id", id_of)
    checked = checked.join(made.hint("merge"), "link_id", "left")
    # The few ways to one target come together; the rows are made once.
    first = F.min(F.when(F.col("_known"), F.struct(*order))).over(Window.partitionBy("link_id"))
    placed = checked.withColumn("_first", first)
    is_first = F.struct(*order) == F.col("_first")
    status = (
        F.when(F.col("_known").isNull(), "error")
        .when(F.col("_made") | ~is_first, "skipped")
        .otherwise("created")
    )
    return placed.select("glossary_id", "glossary_term", "table_column", "link_id", status.alias("status"))


def apply_summary(results: DataFrame | tuple[Matches, ...]) -> DataFrame:
    """Results by status; those of parts are counted by the members of their classes, no row is made."""
    if isinstance(results, DataFrame):
        return results.groupBy("status").agg(F.count("*").alias("result_count"))
    members = lambda rows, key: rows.groupBy(key).agg(F.count("*").alias(f"{key}_n")).hint("merge")
    counted = [
        part.pairs.join(members(part.terms, "term_class"), "term_class")
        .join(members(part.places, "place_class"), "place_class")
        .select("status", (F.col("term_class_n") * F.col("place_class_n")).alias("n"))
        for part in results
    ]
    return reduce(DataFrame.unionByName, counted).groupBy("status").agg(F.sum("n").alias("result_count"))


# A link is a term with a place, so what decides on it splits into what holds for the term and what holds for the place.
# The term that comes first and the place that comes first make the first row of a target: the columns of a term key
# (its normal form) are the same for all its rows, and a place's score grows with its copies only. Terms and places are put
# into finer classes, by whether they come first, are known and by the stored classes they are in, so that all rows
# of a pair of classes have one outcome.

#: The order in which parts of ``proposals`` are applied; equal display names of a glossary are one term.
APPLY_ORDER = ("phase", "term_ord", "neg_score", "table_ord", "position", "via_synonym")
_LINK_TERM = ("glossary_id", "display_name", "term_head", "term_text")
_LINK_PLACE = ("table_column", "place_head", "place_text")


def link_columns(*more: Column) -> tuple[Column, ...]:
    """Columns of links from their terms and places; ``link_id`` is that of ``link_id()``, from parts made once a side."""
    head = F.substring(F.concat_ws("-", "term_head", "place_head"), 1, LINK_HEAD)
    whole = F.concat_ws("\x1f", "term_text", "place_text")
    return (
        F.col("glossary_id"), F.col("display_name").alias("glossary_term"), F.col("table_column"),
        F.concat_ws("-", head, F.substring(F.sha2(whole, 256), 1, 32)).alias("link_id"), *more,
    )


def _link_terms(terms: DataFrame) -> DataFrame:
    head = F.concat_ws("-", F.lit("definition"), s.link_slug(F.col("display_name")))
    text = F.concat_ws("\x1f", "glossary_id", "display_name")
    return terms.withColumns({"term_head": head, "term_text": text})


def _link_places(places: DataFrame, default_namespace: str) -> DataFrame:
    namespace, table = _split_table(F.col("full_table"), default_namespace)
    column = F.col("column_name")
    return places.withColumns({"_namespace": namespace, "_table": table}).withColumns(
        {
            "table_column": F.concat_ws(".", "full_table", column),
            "place_head": F.concat_ws("-", "_namespace", s.link_slug(F.col("_table")), s.link_slug(column)),
            "place_text": F.concat_ws("\x1f", "_namespace", "_table", column),
        }
    )


def _apply_matches(
    found: tuple[Matches, ...], inventory: DataFrame, existing: tuple[Matches, ...], default_namespace: str, dry_run: bool
) -> tuple[Matches, ...]:
    if dry_run:
        return tuple(
            Matches(
                part.pairs.select("term_class", "place_class", F.lit("dry-run").alias("status")),
                _link_terms(part.terms).select("term_class", *_LINK_TERM),
                _link_places(part.places, default_namespace).select("place_class", *_LINK_PLACE),
                link_columns(F.col("status")),
            )
            for part in found
        )
    tables = _known_tables(inventory)
    return tuple(_apply_part(part, tables, existing, default_namespace) for part in found)


def _apply_part(part: Matches, tables: DataFrame, existing: tuple[Matches, ...], default_namespace: str) -> Matches:
    # The few ways of one term to one target.
    way = F.struct(*[c for c in ("phase", "term_ord", "via") if c in part.terms.columns])
    of_term = Window.partitionBy("term_class", "term_text")
    terms = _link_terms(part.terms).withColumn("_first", way == F.min(way).over(of_term))
    places = _link_places(part.places, default_namespace).join(tables, ["_namespace", "_table"], "left")
    copies = [(-F.col("copies")).alias("copies")] if "copies" in places.columns else []
    at = F.struct(*copies, "table_ord", "position")
    best = places.filter("_known").groupBy("place_text").agg(F.min(at).alias("_best"))
    places = places.join(best.hint("merge"), "place_text", "left").withColumns(
        {"_known": F.coalesce("_known", F.lit(False)), "_first": F.coalesce(at == F.col("_best"), F.lit(False))}
    )
    terms, places = terms.select("term_class", "_first", *_LINK_TERM), places.select("place_class", "_known", "_first", *_LINK_PLACE)
    pairs, terms, places = _by_stored(part.pairs.select("term_class", "place_class"), terms, places, existing)
    status = (
        F.when(~F.col("_known"), "error")
        .when(F.col("_made") | ~F.col("_term_first") | ~F.col("_place_first"), "skipped")
        .otherwise("created")
    )
    pairs = stored(pairs.select("term_class", "place_class", status.alias("status")), "applied-pairs")
    terms, places = terms.select("term_class", *_LINK_TERM), places.select("place_class", *_LINK_PLACE)
    return Matches(pairs, terms, places, link_columns(F.col("status")))


def _by_stored(
    pairs: DataFrame, terms: DataFrame, places: DataFrame, existing: tuple[Matches, ...]
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Pairs, terms and places in finer classes, and whether the links of a pair are ``_made``: stored already.

    A class has equal flags (columns with an underscore), which its pairs get, and is in the same classes of ``existing``.
    """
    sides = {"term": terms, "place": places}
    for name, rows in sides.items():
        rows = _held_by(rows, existing, name)
        flags = [c for c in rows.columns if c.startswith("_")]
        finer = F.md5(F.to_json(F.struct(f"{name}_class", *flags)))
        rows = sides[name] = stored(rows.withColumn("_class", finer), f"{name}-links")
        named = [F.col(c).alias(f"_{name}{c}" if c in ("_class", "_first", "_held") else c) for c in (*flags, "_class")]
        pairs = pairs.join(rows.select(f"{name}_class", *named).distinct().hint("merge"), f"{name}_class")
        sides[name] = rows.withColumn(f"{name}_class", F.col("_class")).drop("_class", *flags)
    pairs = pairs.drop("term_class", "place_class").withColumnsRenamed({"_term_class": "term_class", "_place_class": "place_class"})
    if not existing:
        return pairs.withColumn("_made", F.lit(False)), sides["term"], sides["place"]
    pairs = stored(pairs, "finer-pairs")
    links = reduce(
        DataFrame.unionByName,
        [
            part.pairs.select(F.lit(i).alias("part"), F.col("term_class").alias("t"), F.col("place_class").alias("p"))
            for i, part in enumerate(existing)
        ],
    )
    key = ["term_class", "place_class"]
    asked = pairs.select(*key, F.explode("_term_held").alias("_t"), "_place_held").select(*key, "_t", F.explode("_place_held").alias("_p"))
    asked = asked.filter("_t.part = _p.part").select(*key, "_t.part", F.col("_t.class").alias("t"), F.col("_p.class").alias("p"))
    made = asked.join(links.hint("merge"), ["part", "t", "p"]).select(*key).distinct().withColumn("_made", F.lit(True))
    pairs = pairs.join(made.hint("merge"), key, "left").withColumn("_made", F.coalesce("_made", F.lit(False)))
    return pairs, sides["term"], sides["place"]


def _held_by(rows: DataFrame, existing: tuple[Matches, ...], name: str) -> DataFrame:
    """``rows`` with ``_held``: the classes of ``existing`` that hold the same term or place, a few for each part."""
    if not existing:
        return rows.withColumn("_held", F.array().cast("array<struct<part: int, class: string>>"))
    held = reduce(
        DataFrame.unionByName,
        [
            getattr(part, f"{name}s").select(f"{name}_text", F.struct(F.lit(i).alias("part"), F.col(f"{name}_class").alias("class")).alias("c"))
            for i, part in enumerate(existing)
        ],
    )
    held = held.groupBy(f"{name}_text").agg(F.sort_array(F.collect_set("c")).alias("_held"))
    none = F.array().cast("array<struct<part: int, class: string>>")
    return rows.join(held.hint("merge"), f"{name}_text", "left").withColumn("_held", F.coalesce("_held", none))


def new_links(parts: tuple[Matches, ...], existing: tuple[Matches, ...]) -> tuple[Matches, ...]:
    """The links that are not ``existing``, each term and place of a class once: the form in which links are stored."""
    out = []
    for part in parts:
        terms, places = part.terms.select("term_class", *_LINK_TERM), part.places.select("place_class", *_LINK_PLACE)
        pairs = part.pairs.select("term_class", "place_class")
        if existing:
            pairs, terms, places = _by_stored(pairs, terms, places, existing)
            pairs = pairs.filter("NOT _made").select("term_class", "place_class")
        out.append(Matches(pairs.distinct(), terms.distinct(), places.distinct()))
    return tuple(out)


# --- metadata ------------------------------------------------------------------------------


def metadata_coverage(inventory: DataFrame, declared: DataFrame) -> DataFrame:
    """Per table: columns, and how many have a declared description."""
    joined = inventory.select("full_table", "column_name").join(
        declared.select("full_table", "column_name", "description"),
        ["full_table", "column_name"], "left",
    )
    has = F.coalesce(F.col("description"), F.lit("")) != ""
    return joined.groupBy("full_table").agg(
        F.count("*").alias("column_count"),
        F.count_if(has).alias("described"),
        F.count_if(~has).alias("undescribed"),
    )


def description_diff(current: DataFrame, proposed: DataFrame) -> DataFrame:
    """Per current column: description new, changed or unchanged."""
    none = F.lit("(no description)")
    joined = current.select(
        "full_table", "column_name", F.col("description").alias("was")
    ).join(
        proposed.select("full_table", "column_name", F.col("description").alias("will_be")).hint("merge"),
        ["full_table", "column_name"], "left",
    )
    # An empty current description counts as none; a new one is taken as given.
    was = F.when(F.coalesce(F.col("was"), F.lit("")) == "", none).otherwise(F.col("was"))
    will_be = F.coalesce(F.col("will_be"), none)
    change = F.when(was == will_be, "unchanged").when(was == none, "new").otherwise("changed")
    return joined.select(
        "full_table", "column_name", was.alias("old_description"),
        will_be.alias("new_description"), change.alias("change"),
    )


def semantic_discovery(
    words: tuple[str, ...], columns: DataFrame, foreign: DataFrame
) -> DataFrame:
    """Tables with a column whose name holds one of the words, and how each joins to others."""
    matched = F.array_compact(
        F.array(*[F.when(F.contains("column_key", F.lit(w)), F.lit(w)) for w in words])
    )
    found = columns.select("table_name", "column_name", F.explode(matched).alias("word"))
    sides = foreign.select(
        F.inline(
            F.array(
                F.struct(
                    F.col("child_table").alias("table_name"), F.col("child_column").alias("own_key"),
                    F.col("parent_table").alias("other_table"),
                    F.col("parent_column").alias("other_key"),
                ),
                F.struct(
                    F.col("parent_table").alias("table_name"), F.col("parent_column").alias("own_key"),
                    F.col("child_table").alias("other_table"), F.col("child_column").alias("other_key"),
                ),
            )
        )
    )
    return found.join(sides, "table_name", "left")
