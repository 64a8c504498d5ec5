"""Benchmark decontamination: SimHash of item-sized windows, multi-index search, exact similarity."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from touchmark.llm.common import digest, fits, ngrams, read, register, stored, text_or_empty

BITS = 64


@dataclass(frozen=True)
class Match:
    """A window matches an item at a weighted Jaccard similarity, shingles weighing as often as they occur.

    At similarity 0.8 fingerprints differ in 10 bits on average, with a deviation of 3; the radius
    leaves three of those. Texts cut into ``blocks`` runs of bits that differ in at most
    ``blocks * (near + 1) - 1`` bits differ in at most ``near`` bits of some run: 19 for 4 and 4.
    """

    words: int = 5
    similarity: float = 0.8
    radius: int = 19
    blocks: int = 4
    #: Distinct (shingle, item length) rows that are broadcast; more are joined by shuffling.
    broadcast_shingles: int = 1_000_000

    @property
    def near(self) -> int:
        return self.radius // self.blocks


def plain_words(text: Column) -> Column:
    """Lower-case runs of characters other than ASCII, Latin-1, general and ideographic punctuation."""
    cut = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\xBF\\u2000-\\u206F\\u3000-\\u303F]+"
    return F.array_remove(F.split(F.lower(text), cut), "")


def _fingerprints(rows: DataFrame, key: str, hashes: str) -> DataFrame:
    """(key, code): bit b is 1 where over half of the hashes have it."""
    each = rows.select(key, F.explode(hashes).alias("h"))
    votes = [F.sum(F.shiftrightunsigned("h", b).bitwiseAND(F.lit(1))).alias(f"v{b}") for b in range(BITS)]
    counts = each.groupBy(key).agg(F.count("*").alias("n"), *votes)
    code = F.lit(0).cast("long")
    for b in range(BITS):
        bit = 1 << b if b < 63 else -(1 << 63)
        code = code.bitwiseOR(F.when(2 * F.col(f"v{b}") > F.col("n"), F.lit(bit).cast("long")).otherwise(0))
    return counts.select(key, code.alias("code"))


def _blocks(code: Column, n: int) -> Column:
    width = BITS // n
    mask = F.lit((1 << width) - 1).cast("long")
    parts = [
        F.struct(F.lit(b).alias("block"), F.shiftrightunsigned(code, b * width).bitwiseAND(mask).alias("value"))
        for b in range(n)
    ]
    return F.inline(F.array(*parts))


def _within(windows: DataFrame, items: DataFrame, match: Match) -> DataFrame:
    """(window, item) of equal length whose fingerprints differ in at most ``radius`` bits: all of them.

    Items spell out every value near each of their blocks, windows look their own blocks up.
    """
    width = BITS // match.blocks
    near = F.filter(F.sequence(F.lit(0), F.lit((1 << width) - 1)), lambda x: F.bit_count(x) <= match.near)
    spread = items.select("item", "length", F.col("code").alias("item_code"), _blocks(F.col("code"), match.blocks))
    spread = spread.withColumn("flip", F.explode(near)).select(
        "item", "length", "item_code", "block", F.col("value").bitwiseXOR(F.col("flip").cast("long")).alias("value")
    )
    looked = windows.select("window", "length", "code", _blocks(F.col("code"), match.blocks))
    # The spread is much larger than what it is made of, by which Spark would choose to broadcast it.
    found = looked.join(spread.hint("merge"), ["length", "block", "value"])
    return found.filter(F.bit_count(F.col("code").bitwiseXOR(F.col("item_code"))) <= match.radius).select(
        "window", "item"
    ).distinct()


def _weights(rows: DataFrame, key: str) -> DataFrame:
    return rows.select(key, F.explode("hashes").alias("h")).groupBy(key, "h").agg(F.count("*").alias("weight"))


def find_leaks(
    docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id",
    item_text: str = "text", match: Match = Match(),
) -> DataFrame:
    """(key, item, similarity, start_word, n_words): the best window of each document for each item it holds.

    A window has the item's number of words, or all words of a shorter text. Sliding a window right to
    its next shared shingle, or to the last place, loses no shared shingle; so the windows that start
    at one, or last, hold a best one, and only those are fingerprinted. Equal texts, windows and items
    are worked on once. Items and texts under five words match nothing; null texts are empty; every
    row of a repeated id is reported; empty tables give no rows. Other columns are ignored.
    """
    n = match.words
    source = benchmark.select(F.col(item), text_or_empty(item_text).alias("body"))
    source = source.withColumn("w", plain_words(F.col("body"))).filter(F.size("w") >= n)
    source = source.withColumn("__item", digest(F.array_join("w", " ")))
    items = source.dropDuplicates(["__item"]).select(
        F.col("__item").alias("item"), F.size("w").alias("length"), ngrams(F.col("w"), n).alias("hashes")
    )
    items = stored(items, "items")
    probes = items.select(F.explode("hashes").alias("h"), "length").distinct()

    body = text_or_empty(text)
    rows = docs.select(digest(body).alias("digest"), plain_words(body).alias("w"))
    grams = rows.select("digest", F.size("w").alias("n"), F.posexplode(ngrams(F.col("w"), n)).alias("at", "h"))
    small = fits(probes, match.broadcast_shingles)
    hits = grams.join(F.broadcast(probes) if small else probes, "h")
    start = F.greatest(F.lit(0), F.least(F.col("at"), F.col("n") - F.col("length")))
    starts = stored(hits.select("digest", "length", start.alias("start")).distinct(), "starts")

    # Texts with a start are read again, each once; a window is then known by its content.
    per_text = starts.groupBy(F.col("digest").alias("__d")).agg(
        F.collect_list(F.struct("length", "start")).alias("starts")
    )
    bodies = docs.select(digest(body).alias("digest"), body.alias("body"))
    held = bodies.join(per_text, F.col("digest") == F.col("__d")).dropDuplicates(["digest"])
    held = stored(held.select("digest", "starts", ngrams(plain_words(F.col("body")), n).alias("hashes")), "held")
    slices = F.transform(
        "starts",
        lambda s: F.struct(
            s["length"].alias("length"), s["start"].alias("start"),
            F.slice("hashes", s["start"] + 1, s["length"] - n + 1).alias("hashes"),
        ),
    )
    cut = held.select("digest", F.inline(slices))
    cut = cut.withColumn("window", digest(F.concat_ws(",", "length", F.array_join("hashes", ","))))
    windows = stored(cut.dropDuplicates(["window"]).select("window", "length", "hashes"), "windows")
    places = cut.select("digest", "length", "start", "window").distinct()

    lengths = windows.select("window", "length")
    codes = _fingerprints(windows, "window", "hashes").join(lengths, "window")
    item_codes = _fingerprints(items, "item", "hashes").join(items.select("item", "length"), "item")
    near = stored(_within(codes, item_codes, match), "candidates")

    left = near.join(_weights(windows, "window"), "window")
    right = _weights(items, "item").withColumnRenamed("weight", "item_weight")
    shared = left.join(right, ["item", "h"]).groupBy("window", "item").agg(
        F.sum(F.least("weight", "item_weight")).alias("shared")
    )
    sizes = shared.join(windows.select("window", F.size("hashes").alias("a")), "window").join(
        items.select("item", F.size("hashes").alias("b")), "item"
    )
    similarity = F.col("shared") / (F.col("a") + F.col("b") - F.col("shared"))
    matched = sizes.withColumn("similarity", similarity).filter(F.col("similarity") >= match.similarity)

    best = F.min(F.struct((-F.col("similarity")).alias("s"), "start", "length")).alias("best")
    leaks = places.join(matched.select("window", "item", "similarity"), "window").groupBy("digest", "item").agg(best)
    leaks = leaks.select(
        F.col("digest").alias("__digest"), F.col("item").alias("__of"), (-F.col("best.s")).alias("similarity"),
        F.col("best.start").alias("start_word"), F.col("best.length").alias("n_words"),
    )
    named = leaks.join(source.select("__item", item), F.col("__of") == F.col("__item"))
    ids = docs.select(F.col(key), digest(body).alias("__text"))
    return ids.join(named, F.col("__text") == F.col("__digest")).select(
        key, item, "similarity", "start_word", "n_words"
    )


def drop_leaks(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents without a window that matches an item, with their own columns."""
    tagged = docs.withColumn("__whole", digest(text_or_empty(text)))
    leaks = find_leaks(tagged.select("__whole", F.col(text).alias("text")), benchmark, "__whole")
    return tagged.join(leaks.select("__whole").distinct(), "__whole", "left_anti").select(*docs.columns)


@register("op2_decontamination")
def op2_decontamination(spark: SparkSession, d: str) -> DataFrame:
    return find_leaks(read(spark, d, "documents"), read(spark, d, "benchmark"))
