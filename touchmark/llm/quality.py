"""Quality rules: repetition counts and divergence from references learned per language."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from touchmark.llm.common import fits, let, ngrams, read, register, stored, text_or_empty, words

SYMBOLS = "[#*$%&|<>]"
CLASSES = ("upper", "digit", "point", "symbol", "other")


@dataclass(frozen=True)
class Rules:
    """Limits of the rules. A distance is a Jensen-Shannon distance to base 2, from 0 to 1."""

    min_words: int = 50
    max_repeat_percent: int = 50
    #: Texts of fewer words are not held against the reference of that kind.
    guard_class_words: int = 50
    guard_common_words: int = 100
    max_class_distance: float = 0.32
    max_common_distance: float = 0.4
    common_words: int = 8
    #: Words that a language needs for references of its own; smaller ones share a pooled one.
    min_reference_words: int = 1000
    #: Languages whose references are broadcast; more are shuffled.
    broadcast_languages: int = 5000


def _class_counts(text: Column, symbols: Column, n_chars: Column) -> dict[str, Column]:
    """Characters by class; ``other`` is what the rest leaves, lower-case letters mostly."""
    length = F.char_length(text)
    parts = {
        "upper": length - F.char_length(F.regexp_replace(text, "[A-Z]+", "")),
        "digit": length - F.char_length(F.regexp_replace(text, "[0-9]+", "")),
        "point": length - F.char_length(F.regexp_replace(text, "[.,;:!?'\"()/@_-]+", "")),
        "symbol": symbols,
    }
    return parts | {"other": n_chars - sum(parts.values(), F.lit(0))}


def references(docs: DataFrame, rules: Rules = Rules(), lang: str = "lang", text: str = "text") -> DataFrame:
    """Per language ``ref``: shares of the character classes, its commonest words and their shares.

    Both come from one count of words over all documents, summed in each task before the shuffle. The
    row with a null ``ref`` pools all languages, for documents without one or with one of too few words.
    """
    tokens = docs.select(F.col(lang).cast("string").alias("ref"), F.explode(words(text_or_empty(text))).alias("word"))
    tokens = stored(tokens.groupBy("ref", "word").agg(F.count("*").alias("n")), "word-counts")
    pooled = tokens.groupBy("word").agg(F.sum("n").alias("n"))
    every = tokens.filter("ref IS NOT NULL").union(pooled.select(F.lit(None).cast("string"), "word", "n"))

    symbols = F.regexp_count("word", F.lit(SYMBOLS))
    classes = _class_counts(F.col("word"), symbols, F.char_length("word"))
    shares = every.groupBy("ref").agg(
        F.sum("n").alias("total"),
        F.sum(F.col("n") * F.char_length("word")).alias("chars"),
        *[F.sum(F.col("n") * c).alias(name) for name, c in classes.items()],
    )
    shares = shares.filter(F.col("ref").isNull() | (F.col("total") >= rules.min_reference_words))
    # Spark keeps the first rows of each task before it shuffles for a row number below a limit.
    commonest = Window.partitionBy("ref").orderBy(F.desc("n"), "word")
    top = every.withColumn("rank", F.row_number().over(commonest)).filter(F.col("rank") <= rules.common_words)
    top = top.groupBy(F.col("ref").alias("t_ref")).agg(
        F.sort_array(F.collect_list(F.struct("rank", "word", "n"))).alias("top")
    )
    return stored(
        shares.join(top, F.col("ref").eqNullSafe(F.col("t_ref"))).select(
            "ref",
            F.array(*[F.col(c) / F.col("chars") for c in CLASSES]).alias("q_classes"),
            F.col("top.word").alias("q_words"),
            F.transform("top", lambda e: e["n"] / F.col("total")).alias("q_shares"),
        ),
        "references",
    )


def _distance(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance of two arrays of shares."""

    def part(a: Column, b: Column) -> Column:
        return F.when(a > 0, a * F.log2(2 * a / (a + b))).otherwise(0.0)

    parts = F.zip_with(p, q, lambda a, b: part(a, b) + part(b, a))
    divergence = F.aggregate(parts, F.lit(0.0), lambda total, x: total + x) / 2
    return F.sqrt(F.greatest(divergence, F.lit(0.0)))


def _rest(shares: Column) -> Column:
    """The shares and what they leave of the whole."""
    return F.concat(shares, F.array(F.lit(1.0) - F.aggregate(shares, F.lit(0.0), lambda total, x: total + x)))


def repeated_words(items: Column, n: int = 3) -> Column:
    """How many words stand in an n-word window that the text has twice or more, first ones included.

    Windows are compared by 64-bit hash; only a text with a repeated window sorts them.
    """

    def covered(hashes: Column) -> Column:
        placed = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def repeats(s: Column) -> Column:
            def again(e: Column, i: Column) -> Column:
                before, after = (F.get(s, i + step)["h"].eqNullSafe(e["h"]) for step in (-1, 1))
                return before | after

            return F.sort_array(F.transform(F.filter(s, again), lambda e: e["i"]))

        start = F.struct(F.lit(-n).alias("last"), F.lit(0).alias("total"))
        return F.aggregate(
            let(placed, repeats),
            start,
            lambda acc, i: F.struct(
                i.alias("last"), (acc["total"] + F.least(F.lit(n), i - acc["last"])).alias("total")
            ),
            lambda acc: acc["total"],
        )

    return let(
        ngrams(items, n), lambda h: F.when(F.size(F.array_distinct(h)) < F.size(h), covered(h)).otherwise(0)
    )


def score(
    docs: DataFrame, reference: DataFrame, rules: Rules = Rules(), lang: str = "lang", text: str = "text"
) -> DataFrame:
    """The documents with ``__q``, a struct of counts, distances and verdicts; one pass, no shuffle.

    A null text has no words, and so fails the base rules. A text too short for a reference, or without
    one, is not judged by it. Every row gets its own verdict, repeated or not; columns of any other name
    pass through, and an empty table stays empty.
    """
    own = reference.filter("ref IS NOT NULL").select(F.struct(*reference.columns).alias("__own"))
    own = F.broadcast(own) if fits(own, rules.broadcast_languages) else own
    pooled = reference.filter("ref IS NULL").first()
    body = text_or_empty(text)
    kind = own.schema["__own"].dataType
    shared = F.struct(*[F.lit(pooled[c]).cast(kind[c].dataType).alias(c) for c in reference.columns]) if pooled else F.lit(None)
    rows = docs.join(own, F.col(lang).cast("string") == F.col("__own.ref"), "left")
    rows = rows.withColumn("__r", F.coalesce("__own", shared.cast(kind))).drop("__own")
    rows = rows.withColumn("__w", words(body))
    lines = F.filter(F.split(body, "\n", -1), lambda line: line.rlike("[^ \\t-\\r]"))
    rows = rows.withColumns(
        {
            "__n": F.size("__w"),
            "__chars": F.char_length(F.concat_ws("", "__w")),
            "__symbols": F.regexp_count(body, F.lit(SYMBOLS)),
            "__dups": let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))),
            "__repeats": repeated_words(F.col("__w")),
        }
    )
    classes = _class_counts(body, F.col("__symbols"), F.col("__chars"))
    # Counts come first, as columns: shares use them more than once.
    rows = rows.withColumns({f"__c_{c}": classes[c] for c in CLASSES if c != "other"})
    rows = rows.withColumn(
        "__c_other", F.col("__chars") - sum((F.col(f"__c_{c}") for c in CLASSES if c != "other"), F.lit(0))
    )
    common = F.transform("__r.q_words", lambda x: (F.col("__n") - F.size(F.array_remove("__w", x))) / F.col("__n"))
    rows = rows.withColumns(
        {
            "__class": F.when(
                F.col("__n") >= rules.guard_class_words,
                F.array(*[F.col(f"__c_{c}") / F.col("__chars") for c in CLASSES]),
            ),
            "__common": F.when(F.col("__n") >= rules.guard_common_words, common),
        }
    )
    by_class = _distance(F.col("__class"), F.col("__r.q_classes"))
    by_words = let(F.col("__common"), lambda p: let(F.col("__r.q_shares"), lambda q: _distance(_rest(p), _rest(q))))
    judged = F.col("__r").isNotNull()
    rows = rows.withColumns(
        {
            "__by_class": F.when(judged & F.col("__class").isNotNull(), by_class),
            "__by_words": F.when(judged & F.col("__common").isNotNull(), by_words),
            "__failed": (F.col("__n") < rules.min_words)
            | (100 * F.col("__repeats") > rules.max_repeat_percent * F.col("__n")),
        }
    )
    near = (F.coalesce("__by_class", F.lit(0.0)) <= rules.max_class_distance) & (
        F.coalesce("__by_words", F.lit(0.0)) <= rules.max_common_distance
    )
    verdict = F.struct(
        *[
            F.col(f"__{c}").cast("long").alias(name)
            for c, name in (
                ("n", "n_words"), ("chars", "word_chars"), ("symbols", "n_symbols"),
                ("dups", "n_dup_lines"), ("repeats", "n_repeat_words"),
            )
        ],
        F.col("__failed").alias("base_failed"),
        (~F.col("__failed") & near).alias("kept"),
        F.col("__by_class").alias("class_distance"),
        F.col("__by_words").alias("common_distance"),
    )
    return rows.select(*docs.columns, verdict.alias("__q"))


def keep_good(docs: DataFrame, rules: Rules = Rules(), lang: str = "lang", text: str = "text") -> DataFrame:
    """The documents that pass, with their own columns."""
    scored = score(docs, references(docs, rules, lang, text), rules, lang, text)
    # No filter is pushed below a generator; below the projections it would repeat every count at each use.
    verdict = F.inline(F.array(F.struct(F.col("__q.kept").alias("__kept"))))
    return scored.select(*docs.columns, verdict).filter("__kept").drop("__kept")


@register("op5_quality_divergence")
def op5_quality_divergence(spark: SparkSession, d: str) -> DataFrame:
    docs = read(spark, d, "documents")
    return score(docs, references(docs)).select("doc_id", "__q.*")
