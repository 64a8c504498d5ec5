"""Fuzzy line deduplication: MinHash bands, exact Jaccard, one line per connected component."""

from __future__ import annotations

import random
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from touchmark.llm.common import BLANK, fits, read, register, stored, text_or_empty
from touchmark.llm.components import components


@dataclass(frozen=True)
class LineRules:
    """What makes lines alike: equal ones of any length, and Jaccard similarity of all their shingles.

    Bands come from the shingles that start where no letter a-z or A-Z comes before, or more than
    ``shingle`` of them in a row: at each word, at each character of scripts without such letters, and
    throughout long runs. Lines of similarity s in those share a band with probability
    1 - (1 - s^rows)^bands: 0.997 at 0.8, 0.99999 at 0.9. Every pair found is verified on all shingles.
    """

    shingle: int = 12
    similarity: float = 0.8
    bands: int = 8
    rows: int = 3
    #: Equal minima that a pair needs to be verified; 24 are expected to hold 19 at similarity 0.8.
    likely: int = 11
    #: Lines of a band whose pairs are all compared; larger bands are searched by rare shingles.
    crowd: int = 32
    #: Line ids that are broadcast to find the lines to compare.
    broadcast_lines: int = 2_000_000

    @property
    def minima(self) -> list[str]:
        return [f"m{k}" for k in range(self.bands * self.rows)]


def shingles(line: Column, rules: LineRules) -> Column:
    """The shingles that bands are made of. Few lines have a run of letters long enough for the longer pattern."""
    k = rules.shingle
    words = F.regexp_extract_all(line, F.lit(f"(?s)(?<![A-Za-z])(?=(.{{{k}}}))"), F.lit(1))
    runs = F.regexp_extract_all(line, F.lit(f"(?s)(?:(?<![A-Za-z])|(?<=[A-Za-z]{{{k}}}))(?=(.{{{k}}}))"), F.lit(1))
    return F.when(line.rlike(f"[A-Za-z]{{{2 * k}}}"), runs).otherwise(words)


def all_shingles(line: Column, rules: LineRules) -> Column:
    """Hashes of the distinct shingles at every character."""
    found = F.regexp_extract_all(line, F.lit(f"(?s)(?=(.{{{rules.shingle}}}))"), F.lit(1))
    return F.array_distinct(F.transform(found, lambda s: F.xxhash64(s)))


def _lines(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(doc, body, at, line, line_id, other) for lines that are not blank; ``body`` tells texts of one key apart.

    A line is known by two independent hashes, 128 bits; links use the first alone.
    """
    body = text_or_empty(text)
    lines = F.posexplode(F.split(body, "\n", -1)).alias("at", "line")
    rows = docs.select(F.col(key).alias("doc"), F.xxhash64(body).alias("body"), lines)
    rows = rows.filter(F.btrim("line", F.lit(BLANK)) != "")
    return rows.withColumn("line_id", F.xxhash64("line")).withColumn("other", F.xxhash64(F.lit(1), "line"))


def _signatures(lines: DataFrame, rules: LineRules) -> DataFrame:
    """(line_id, minima) of the lines that have a shingle.

    The k-th minimum is the least shingle hash after an exclusive or with a constant: any shingle of a
    union is as likely to be it as another. Minima form in each task, so copies of a line fold there.
    """
    rng = random.Random(20240607)
    masks = [rng.getrandbits(32) - (1 << 31) for _ in rules.minima]
    hashes = lines.select("line_id", F.explode(shingles(F.col("line"), rules)).alias("s"))
    hashes = hashes.select("line_id", F.shiftright(F.xxhash64("s"), 32).cast("int").alias("h"))
    return hashes.groupBy("line_id").agg(
        *[F.min(F.col("h").bitwiseXOR(F.lit(m))).alias(name) for name, m in zip(rules.minima, masks)]
    )


def _alike(pairs: DataFrame, texts: DataFrame, rules: LineRules) -> DataFrame:
    """The pairs (a, b) whose shingle sets have the wanted Jaccard similarity, exactly.

    Lines travel as text, which is shorter than their sets.
    """
    both = pairs.join(texts.toDF("a", "__x"), "a").join(texts.toDF("b", "__y"), "b")
    sets = both.select("a", "b", all_shingles(F.col("__x"), rules).alias("x"), all_shingles(F.col("__y"), rules).alias("y"))
    # A generator keeps the sets from being made again for each use.
    counted = sets.select("a", "b", F.inline(F.array(F.struct("x", "y"))))
    common = F.size(F.array_intersect("x", "y"))
    counted = counted.select("a", "b", F.inline(F.array(F.struct(common.alias("c"), (F.size("x") + F.size("y")).alias("n")))))
    return counted.filter(F.col("c") >= rules.similarity * (F.col("n") - F.col("c"))).select("a", "b")


def _packed(rules: LineRules) -> list[Column]:
    """The minima, eight to a whole number, a byte of each: enough to count equal ones, and a quarter of the room."""
    names = rules.minima
    packs = [names[at : at + 8] for at in range(0, len(names), 8)]
    byte = lambda m, k: F.shiftleft(F.col(m).bitwiseAND(F.lit(255)).cast("bigint"), 8 * k)
    return [
        reduce(Column.bitwiseOR, [byte(m, k) for k, m in enumerate(pack)]).alias(f"p{j}") for j, pack in enumerate(packs)
    ]


def _equal(x: str, y: str, rules: LineRules) -> Column:
    """How many minima two lines have in common, by their packs ``x0``, ``x1``, ... and ``y0``, ``y1``, ..."""
    n = len(rules.minima)
    differ = [F.col(f"{x}{j}").bitwiseXOR(F.col(f"{y}{j}")) for j in range(-(-n // 8))]
    same = [F.shiftright(differ[k // 8], 8 * (k % 8)).bitwiseAND(F.lit(255)) == 0 for k in range(n)]
    return sum((c.cast("int") for c in same), F.lit(0))


def _likely(pairs: DataFrame, packs: DataFrame, rules: LineRules) -> DataFrame:
    """The distinct pairs (a, b) whose signatures agree in enough minima."""
    names = packs.columns[1:]
    left = packs.select(F.col("line_id").alias("a"), *[F.col(p).alias(f"x{j}") for j, p in enumerate(names)])
    right = packs.select(F.col("line_id").alias("b"), *[F.col(p).alias(f"y{j}") for j, p in enumerate(names)])
    both = pairs.distinct().join(left, "a").join(right, "b")
    return both.filter(_equal("x", "y", rules) >= rules.likely).select("a", "b")


def _centers(members: DataFrame, signatures: DataFrame, rules: LineRules) -> DataFrame:
    """(line_id, center) for the lines of bands (band, n, line_id): the line that most agrees with its band's commonest minima.

    A line of several bands takes the center of the largest one.
    """
    minima = F.posexplode(F.array(*rules.minima)).alias("k", "m")
    rows = members.select("band", "line_id").join(signatures, "line_id").select("band", "line_id", minima)
    votes = rows.groupBy("band", "k", "m").agg(F.count("*").alias("v")).filter("v > 1")
    common = votes.groupBy("band", "k").agg(F.max_by("m", F.struct("v", "m")).alias("m"))
    agreed = rows.join(common, ["band", "k", "m"]).groupBy("band", "line_id").agg(F.count("*").alias("v"))
    centers = agreed.groupBy("band").agg(F.max_by("line_id", F.struct("v", "line_id")).alias("center"))
    # A band's minima are in common, so every band of two lines or more has a center.
    return members.join(centers, "band").groupBy("line_id").agg(F.max_by("center", F.struct("n", "center")).alias("center"))


def _around_centers(
    lost: DataFrame, centers: DataFrame, texts: DataFrame, rules: LineRules
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(line_id, hashes), (line_id, center, n, base, differs, near) and (line_id, root, center, apart) of the lines; stored.

    ``differs`` holds a shingle the line adds to its center as its hash, one it lacks as the hash's complement. ``n`` and
    ``base`` are the sizes of both sets; lines alike their center are ``near``. Lines of a component that has such a line
    are linked by the center, so they are one ``root``; ``apart`` are those not near and not of the center's root.
    """
    hubs = texts.join(centers.select(F.col("center").alias("line_id")).distinct(), "line_id")
    hubs = hubs.select(F.col("line_id").alias("center"), F.col("line").alias("__x"))
    both = lost.join(centers, "line_id").join(texts, "line_id").join(hubs, "center")
    sets = F.struct(all_shingles(F.col("__x"), rules).alias("x"), all_shingles(F.col("line"), rules).alias("y"))
    # A generator keeps the sets from being made again for each use.
    both = both.select("line_id", "root", "center", F.inline(F.array(sets)))
    first = stored(both.select("line_id", "root", "center", F.col("y").alias("hashes"), _change("y", "x").alias("differs")), "crowd-sets")
    # The line with most of what most lines have: it differs least from the changes that over half of them share.
    tokens = first.select("center", "line_id", F.size("differs").alias("d"), F.explode("differs").alias("h"))
    members = first.groupBy("center").agg(F.count("*").alias("all"))
    most = tokens.groupBy("center", "h").agg(F.count("*").alias("f")).join(members, "center").filter("2 * f > all")
    held = tokens.join(most.select("center", "h"), ["center", "h"]).groupBy("center", "line_id", "d").agg(F.count("*").alias("hits"))
    best = held.filter("2 * hits > d").groupBy("center").agg(F.min_by("line_id", F.struct(F.expr("d - 2 * hits"), "line_id")).alias("best"))
    moved = first.select(F.col("line_id").alias("best"), F.size("hashes").alias("base"), F.col("differs").alias("__x"))
    held_by = members.join(best, "center", "left").select("center", F.coalesce("best", "center").alias("best"))
    # The first center may be a line of another crowd's center; its own difference is none.
    own = first.select("center").distinct().join(first.select(F.col("line_id").alias("center"), F.size("hashes").alias("size")), "center")
    moved = held_by.join(own, "center").join(moved, "best").select(
        "center", "best", F.when(F.col("best") == F.col("center"), F.col("size")).otherwise(F.col("base")).alias("base"),
        F.when(F.col("best") == F.col("center"), F.array().cast("array<bigint>")).otherwise(F.col("__x")).alias("__x"),
    )
    placed = first.join(moved, "center").select(
        "line_id", "root", F.col("best").alias("center"), F.size("hashes").alias("n"), "base",
        _change("differs", "__x").alias("differs"),
    )
    common = (F.col("n") + F.col("base") - F.size("differs")) / 2
    near = common >= rules.similarity * (F.col("n") + F.col("base") - common)
    placed = stored(placed.withColumn("near", near), "crowd-places")
    linked = placed.filter("near").groupBy(F.col("root").alias("was")).agg(F.min("center").alias("linked"))
    roots = placed.join(linked, F.col("root") == F.col("was"), "left")
    roots = roots.select("line_id", F.coalesce("linked", "root").alias("root"), "center", "near")
    cores = roots.select(F.col("line_id").alias("center"), F.col("root").alias("core"))
    apart = F.expr("NOT near AND root != core").alias("apart")
    roots = roots.join(cores, "center").select("line_id", "root", "center", apart)
    return first.select("line_id", "hashes"), placed.drop("root"), stored(roots, "crowd-roots")


def _change(y: str, x: str) -> Column:
    """What leads from ``x`` to ``y``: hashes of ``y`` alone, complements of those of ``x`` alone."""
    return F.concat(F.array_except(y, x), F.transform(F.array_except(x, y), F.bitwise_not))


def _differences(places: DataFrame) -> DataFrame:
    """A row per shingle ``h`` in which a line differs from its center, with their number ``d``."""
    return places.select("line_id", F.size("differs").alias("d"), F.explode("differs").alias("h"))


def _pairs_of_crowds(
    sets: DataFrame, places: DataFrame, roots: DataFrame, packs: DataFrame, rules: LineRules
) -> DataFrame:
    """Candidates (a, b) among the lines around centers that are of different roots."""
    known = roots.join(places.select("line_id", "n", "base"), "line_id").join(packs, "line_id")
    around = _pairs_around(places, known, packs.columns[1:], rules)
    return around.union(_pairs_across(sets, known, packs.columns[1:], rules)).distinct()


def _sides(placed: DataFrame, taken: tuple[str, ...], packs: list[str]) -> list[list[Column]]:
    side = lambda s: [F.col(c).alias(f"{s}_{c}") for c in taken] + [F.col(p).alias(f"{s}{j}") for j, p in enumerate(packs)]
    return [side("x"), side("y")]


def _sizes(t: float) -> Column:
    return F.least("x_n", "y_n") >= F.ceil(t * F.greatest("x_n", "y_n") - 1e-9)


def _pair() -> list[Column]:
    return [F.least("x_line_id", "y_line_id").alias("a"), F.greatest("x_line_id", "y_line_id").alias("b")]


def _pairs_around(places: DataFrame, known: DataFrame, packs: list[str], rules: LineRules) -> DataFrame:
    """Candidates of one center, by the rarest of what they add to it and lack of it.

    With D a line's difference from the center, two lines differ by the difference of their D, so alike ones have
    (|D| + |D'| - g * (n + n')) / 2 shingles of D in common, where g = (1 - t) / (1 + t). One of a pair is not alike the center,
    |D| > g * (n + base), so this is above zero and more than about half of the other's D: sorted by rarity, the
    first halves must meet. Changes that each copy has to itself meet nothing.
    """
    t = rules.similarity
    g = (1 - t) / (1 + t)
    tokens = _differences(places).join(known.select("line_id", "center", "root"), "line_id")
    rarity = tokens.groupBy("center", "h").agg(F.count("*").alias("f"), F.min("root").alias("low"), F.max("root").alias("high"))
    order = Window.partitionBy("line_id").orderBy("f", "h")
    placed = tokens.select("line_id", "center", "d", "h").join(rarity, ["center", "h"]).withColumn("at", F.row_number().over(order))
    placed = placed.filter("low != high").select("line_id", "h", "d", "at").join(known, "line_id")
    first = lambda wanted: F.col("at") <= F.col("d") - F.ceil(F.greatest(wanted, F.lit(1.0)) - 1e-6) + 1
    asks = F.col("apart") & first((F.col("d") - g * (F.col("n") + F.col("base"))) / (1 + g))
    answers = first((F.col("d") - g * (F.col("n") - F.col("base"))) / 2)
    placed = placed.withColumns({"asks": asks, "answers": answers}).filter("asks OR answers")
    taken = ("line_id", "root", "apart", "n", "d", "at")
    placed = stored(placed.select(*taken, "center", "h", "asks", "answers", *packs), "crowd-differences", "zstd")
    x, y = _sides(placed, taken, packs)
    both = placed.filter("asks").select("center", "h", *x).join(placed.filter("answers").select("center", "h", *y), ["center", "h"])
    needed = (F.col("x_d") + F.col("y_d") - g * (F.col("x_n") + F.col("y_n"))) / 2 - 1e-6
    enough = 1 + F.least(F.col("x_d") - F.col("x_at"), F.col("y_d") - F.col("y_at")) >= needed
    likely = _equal("x", "y", rules) >= rules.likely
    once = F.expr("x_root != y_root AND (NOT y_apart OR x_line_id < y_line_id)")
    return both.filter(once & enough & _sizes(t) & likely).select(*_pair()).distinct()


def _pairs_across(sets: DataFrame, known: DataFrame, packs: list[str], rules: LineRules) -> DataFrame:
    """Candidates of different centers, by their rarest shingles.

    Sets sorted by rarity can only be alike if the first few of both have one in common, at a place that
    leaves enough to follow: few enough for the smaller set that text which a whole crowd shares is rarely
    among them. The lines of a shingle's largest center meet only those of others.
    """
    t = rules.similarity
    least = lambda x: F.ceil(x - 1e-9)
    tokens = sets.select("line_id", F.size("hashes").alias("n"), F.explode("hashes").alias("h"))
    tokens = tokens.join(known.select("line_id", "center"), "line_id")
    rarity = tokens.groupBy("h").agg(F.count("*").alias("f"), F.min("center").alias("low"), F.max("center").alias("high"))
    order = Window.partitionBy("line_id").orderBy("f", "h")
    placed = tokens.select("line_id", "n", "h").join(rarity, "h").withColumn("at", F.row_number().over(order))
    first = F.col("at") <= F.col("n") - least(t * F.col("n")) + 1
    short = F.col("at") <= F.col("n") - least(2 * t / (1 + t) * F.col("n")) + 1
    placed = placed.filter(first & (F.col("low") != F.col("high"))).select("line_id", "h", "at", short.alias("short"))
    taken = ("line_id", "root", "center", "n", "at", "short")
    placed = stored(placed.join(known, "line_id").select(*taken, "h", *packs), "crowd-prefixes", "zstd")
    crowded = placed.groupBy("h", "center").agg(F.count("*").alias("c")).groupBy("h").agg(F.max_by("center", "c").alias("largest"))
    x, y = _sides(placed, taken, packs)
    both = placed.join(crowded, "h").filter("center != largest").select("h", *x).join(placed.select("h", *y), "h")
    role = F.when(F.col("x_n") <= F.col("y_n"), F.col("x_short")).otherwise(F.col("y_short"))
    left = 1 + F.least(F.col("x_n") - F.col("x_at"), F.col("y_n") - F.col("y_at"))
    enough = left >= least(t / (1 + t) * (F.col("x_n") + F.col("y_n")))
    both = both.filter("x_center != y_center AND x_root != y_root").filter(role & _sizes(t) & enough)
    return both.filter(_equal("x", "y", rules) >= rules.likely).select(*_pair()).distinct()


def line_links(lines: DataFrame, rules: LineRules = LineRules()) -> DataFrame:
    """Links (a, b) of alike line ids, enough to join the groups of lines that share bands.

    Every line of a band is held against the band's least and greatest line first. Where that leaves a band in
    several components, all pairs between them are verified if it has up to ``crowd`` lines; the lines of larger bands are
    held against the line in their midst, and those left are joined on rare shingles of what tells them from it, which finds
    every alike pair. So a crowd around one text costs its size, and lines that share a passage meet only those that share more.
    """
    signatures = stored(_signatures(lines, rules), "line-signatures", "zstd")
    keys = [F.xxhash64(F.lit(b), *rules.minima[b * rules.rows : (b + 1) * rules.rows]) for b in range(rules.bands)]
    bands = signatures.select("line_id", F.explode(F.array(*keys)).alias("band"))
    hubs = bands.groupBy("band").agg(F.count("*").alias("n"), F.min("line_id").alias("least"), F.max("line_id").alias("most"))
    members = stored(bands.join(hubs.filter("n > 1"), "band"), "line-members", "zstd")
    wanted = stored(members.select("line_id").distinct(), "line-wanted")
    small = fits(wanted, rules.broadcast_lines)  # else the lines' texts are shuffled
    texts = lines.select("line_id", "line").join(F.broadcast(wanted) if small else wanted, "line_id", "left_semi")
    texts = stored(texts.dropDuplicates(["line_id"]), "line-texts", "zstd")

    packs = signatures.select("line_id", *_packed(rules))
    stars = members.select(F.explode(F.array("least", "most")).alias("x"), F.col("line_id").alias("y")).filter("x != y")
    stars = stars.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
    links = stored(_alike(_likely(stars, packs, rules), texts, rules), "line-links")

    roots = components(links).withColumnRenamed("node", "line_id")
    placed = members.filter("n > 2").select("band", "n", "line_id").join(roots, "line_id", "left")
    placed = placed.withColumn("root", F.coalesce("root", "line_id"))
    split = placed.groupBy("band").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low != high")
    placed = stored(placed.join(split, "band", "left_semi"), "line-split-bands")
    few = placed.filter(F.col("n") <= rules.crowd)
    x = few.select("band", F.col("line_id").alias("a"), F.col("root").alias("root_a"))
    y = few.select("band", F.col("line_id").alias("b"), F.col("root").alias("root_b"))
    pairs = x.join(y, "band").filter("a < b AND root_a != root_b").select("a", "b")
    crowds = placed.filter(F.col("n") > rules.crowd)
    lost = crowds.select("line_id", "root").distinct()
    sets, places, roots = _around_centers(lost, _centers(crowds, signatures, rules), texts, rules)
    near = places.filter("near AND line_id != center").select("center", "line_id")
    more = _likely(pairs, packs, rules).union(_pairs_of_crowds(sets, places, roots, packs, rules)).distinct()
    return links.union(near).union(_alike(more, texts, rules))


def _removed(docs: DataFrame, key: str, text: str, rules: LineRules) -> DataFrame:
    """(doc, body, gone): the places of the lines that go, for texts that lose any."""
    lines = _lines(docs, key, text)
    roots = components(line_links(lines, rules))
    places = stored(lines.drop("line"), "line-places", "zstd")
    place = F.struct(F.col("doc").isNull().alias("null"), "doc", "body", "at")
    kinds = places.groupBy("line_id", "other").agg(F.min(place).alias("first"), F.max(place).alias("last"))
    kinds = kinds.join(roots, F.col("line_id") == F.col("node"), "left")
    # Equal lines without a component of alike ones are a group of their own.
    own = F.when(F.col("root").isNull(), F.struct(F.col("line_id").alias("x"), F.col("other").alias("y")))
    groups = stored(kinds.select("line_id", "other", "first", "last", "root", own.alias("own")), "line-groups", "zstd")
    keep = groups.groupBy("root", "own").agg(F.min("first").alias("keep"), F.max("last").alias("most"))
    keep = keep.filter(F.col("keep") != F.col("most")).select(
        F.col("root").alias("__root"), F.col("own").alias("__own"), "keep"
    )
    same = F.col("root").eqNullSafe(F.col("__root")) & F.col("own").eqNullSafe(F.col("__own"))
    kept = groups.join(keep, same).select("line_id", "other", "keep")
    gone = places.join(kept, ["line_id", "other"]).filter(place != F.col("keep"))
    return gone.groupBy("doc", "body").agg(F.collect_set("at").alias("gone"))


def dedup_lines(
    docs: DataFrame, key: str = "doc_id", text: str = "text", rules: LineRules = LineRules(), counts: str | None = None
) -> DataFrame:
    """The documents without lines that equal or resemble an earlier one; all other columns as they were.

    Of each component of alike lines the first stays, by key (null last), text hash and place. Lines of
    white space always stay; those shorter than a shingle go only where they equal another. Rows equal in key and text lose the same lines. A null text stays null, a
    text that loses every line is empty, an empty table stays empty. ``counts`` names a struct of the
    number of lines and of removed ones to add.
    """
    gone = _removed(docs, key, text, rules).select(
        F.col("doc").alias("__doc"), F.col("body").alias("__body"), F.col("gone").alias("__gone")
    )
    keyed = docs.withColumn("__of", F.xxhash64(text_or_empty(text)))
    joined = keyed.join(
        gone, F.col(key).eqNullSafe(F.col("__doc")) & (F.col("__of") == F.col("__body")), "left"
    ).withColumn("__lines", F.split(text_or_empty(text), "\n", -1))
    left = F.array_except(F.sequence(F.lit(0), F.size("__lines") - 1), "__gone")
    rest = F.array_join(F.transform(left, lambda i: F.get("__lines", i)), "\n")
    body = F.when(F.col("__gone").isNull(), F.col(text)).otherwise(rest)
    added = []
    if counts:
        removed = F.coalesce(F.size("__gone"), F.lit(0))
        added = [F.struct(F.size("__lines").alias("n_lines"), removed.alias("n_removed")).alias(counts)]
    return joined.select(*[body.alias(text) if c == text else F.col(c) for c in docs.columns], *added)


@register("op8_line_minhash")
def op8_line_minhash(spark: SparkSession, d: str) -> DataFrame:
    rows = dedup_lines(read(spark, d, "documents"), counts="__counts")
    return rows.select("doc_id", "__counts.*", "text")
