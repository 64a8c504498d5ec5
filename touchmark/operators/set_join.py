"""Similarity join of tag sets by prefix filtering."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def tag_sets(items: DataFrame, *, key: str, tags: str) -> DataFrame:
    """(set_id, tag_set, item_count, first_item): the distinct tag sets, tags in order; null and empty ones left out.

    A set that a third of all items carry is one row.
    """
    sets = items.select(F.col(key).alias("item"), F.sort_array(F.array_distinct(F.array_compact(tags))).alias("tag_set"))
    sets = sets.filter(F.size("tag_set") > 0).groupBy("tag_set")
    counted = sets.agg(F.count("*").alias("item_count"), F.min("item").alias("first_item"))
    # Each tag with its length before it, so that no two sets are written alike.
    written = F.array_join(F.transform("tag_set", lambda t: F.concat(F.length(t).cast("string"), F.lit(":"), t)), "")
    return counted.select(F.sha2(written, 256).alias("set_id"), "tag_set", "item_count", "first_item")


def _least(share: float, n):
    """The least whole number that is at least this share of n, whatever doubles make of it."""
    return F.ceil(share * n - 1e-9)


def prefixes(sets: DataFrame, threshold: float) -> DataFrame:
    """(set_id, tag, n, at): the rarest tags of each set, as many as a set of that similarity must share one of."""
    tags = sets.select("set_id", F.size("tag_set").alias("n"), F.explode("tag_set").alias("tag"))
    rarity = tags.groupBy("tag").agg(F.count("*").alias("f"))
    order = Window.partitionBy("set_id").orderBy("f", "tag")
    placed = tags.join(rarity, "tag").withColumn("at", F.row_number().over(order))
    return placed.filter(F.col("at") <= F.col("n") - _least(threshold, F.col("n")) + 1).select("set_id", "tag", "n", "at")


def candidates(sets: DataFrame, threshold: float) -> DataFrame:
    """(a, b), a < b: sets that share a rare tag, are of like sizes, and have enough tags after it."""
    chosen = prefixes(sets, threshold)
    x = chosen.select("tag", F.col("set_id").alias("a"), F.col("n").alias("n_a"), F.col("at").alias("at_a"))
    y = chosen.select("tag", F.col("set_id").alias("b"), F.col("n").alias("n_b"), F.col("at").alias("at_b"))
    sizes = F.least("n_a", "n_b") >= _least(threshold, F.greatest("n_a", "n_b"))
    shared = 1 + F.least(F.col("n_a") - F.col("at_a"), F.col("n_b") - F.col("at_b"))
    enough = shared >= _least(threshold / (1 + threshold), F.col("n_a") + F.col("n_b"))
    return x.join(y, "tag").filter((F.col("a") < F.col("b")) & sizes & enough).select("a", "b").distinct()


def similar_sets(items: DataFrame, threshold: float = 0.5, *, key: str = "creative_id", tags: str = "theme_tags") -> DataFrame:
    """Pairs of distinct tag sets with a Jaccard similarity of at least ``threshold``: (set_a, set_b, items_a, items_b, similarity).

    Exact, without forming pairs of sets that share only common tags: tags are ordered by the sets that
    hold them, and two sets can only reach the threshold if they share one of their first few, at a place
    that leaves enough tags to follow. What is left is verified on the whole sets. ``tag_sets`` tells which items
    carry a set.
    """
    sets = tag_sets(items, key=key, tags=tags)
    a = sets.select(F.col("set_id").alias("a"), F.col("tag_set").alias("set_a"), F.col("item_count").alias("items_a"))
    b = sets.select(F.col("set_id").alias("b"), F.col("tag_set").alias("set_b"), F.col("item_count").alias("items_b"))
    both = candidates(sets, threshold).join(a, "a").join(b, "b")
    common = F.size(F.array_intersect("set_a", "set_b"))
    similarity = common / (F.size("set_a") + F.size("set_b") - common)
    # The first of a pair is the first in the order of the tags.
    turned = F.col("set_a") <= F.col("set_b")
    found = both.withColumn("similarity", similarity).filter(F.col("similarity") >= threshold - 1e-12)
    return found.select(
        F.when(turned, F.col("set_a")).otherwise(F.col("set_b")).alias("set_a"),
        F.when(turned, F.col("set_b")).otherwise(F.col("set_a")).alias("set_b"),
        F.when(turned, F.col("items_a")).otherwise(F.col("items_b")).alias("items_a"),
        F.when(turned, F.col("items_b")).otherwise(F.col("items_a")).alias("items_b"),
        "similarity",
    )
