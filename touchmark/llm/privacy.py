"""Personal data: patterns, and terms that give protected values away by their co-occurrence."""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from touchmark.llm.common import digest, fits, read, register, stored, text_or_empty

KINDS = ("email", "ip", "card", "phone")
TERM = "term"

_DOMAIN = r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"
_EMAIL_HERE = re.compile(r"[A-Za-z0-9._%+-]++" + _DOMAIN)
#: Starts only where a run starts, so a long run without an at sign is read once.
_EMAIL = re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++" + _DOMAIN)
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_WORD = re.compile(r"[^\W\d_]{3,}")
_DIGITS = re.compile("[0-9]")


@dataclass(frozen=True)
class Disclosure:
    """When a term gives a protected value away.

    With shares of different texts as probabilities, a term's disclosure of a value is their pointwise
    mutual information over the value's own information: 1 where the term occurs with that value alone.
    It counts if texts so often shared are unlikely by chance, however few they are.
    """

    #: Characters on each side of a value whose words count as near.
    reach: int = 100
    #: Chance, over all terms weighed for a value, of as many shared texts if they were independent.
    chance: float = 0.05
    generalise_at: float = 0.85
    remove_at: float = 0.97
    #: Terms that are broadcast to be counted; more are joined by shuffling.
    broadcast_terms: int = 500_000


def _emails(text: str) -> Iterator[tuple[int, int]]:
    at = 0
    while (found := _EMAIL_HERE.match(text, at) or _EMAIL.search(text, at)) is not None:
        yield found.span()
        at = found.end()


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) by kind as listed, then start; matches that fail their check are dropped."""
    spans: list[tuple[str, int, int]] = []
    if "@" in text:
        spans += [("email", *s) for s in _emails(text)]
    for found in _IP.finditer(text):
        parts = [p.lstrip("0") for p in found.group().split(".")]
        if all(len(p) <= 3 and int(p or "0") <= 255 for p in parts):
            spans.append(("ip", *found.span()))
    for found in _CARD.finditer(text):
        if found.end() - found.start() >= 13:
            digits = found.group().replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and _luhn(digits):
                spans.append(("card", *found.span()))
    if "+" in text:
        for found in _PHONE.finditer(text):
            if 9 <= len(_DIGITS.findall(found.group())) <= 15:
                spans.append(("phone", *found.span()))
    return spans


def _value(kind: str, found: str) -> str:
    return f"{kind}:{found.lower()}" if kind in ("email", "ip") else f"{kind}:{''.join(_DIGITS.findall(found))}"


def _words_outside(text: str, spans: list[tuple[str, int, int]], low: int, high: int) -> Iterator[tuple[int, int]]:
    """The words from low to high, whole and outside all spans."""
    covered = sorted((s, e) for _, s, e in spans)
    starts, last = [s for s, _ in covered], []
    for _, e in covered:
        last.append(max(e, last[-1] if last else 0))
    for found in _WORD.finditer(text, low, high):
        a, b = found.span()
        if (a == low and low and text[a - 1].isalpha()) or (b == high < len(text) and text[b].isalpha()):
            continue  # cut off at the edge
        i = bisect_right(starts, b - 1)
        if not (i and last[i - 1] > a):
            yield a, b


def near_terms(text: str, spans: list[tuple[str, int, int]], reach: int) -> list[dict]:
    """The distinct words within reach of each value, whole and outside all spans."""
    out: dict[tuple[str, str], None] = {}
    for kind, start, end in spans:
        value = _value(kind, text[start:end])
        for low, high in ((max(0, start - reach), start), (end, min(len(text), end + reach))):
            for a, b in _words_outside(text, spans, low, high):
                out[value, text[a:b].lower()] = None
    return [{"value": value, "term": term} for value, term in out]


def _scan(reach: int):
    @F.pandas_udf(
        "n_email long, n_ip long, n_card long, n_phone long, base array<string>, values array<string>, "
        "near array<struct<value: string, term: string>>"
    )
    def scan(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for text in texts:
            spans = base_spans(text)
            counts = [sum(k == kind for k, _, _ in spans) for kind in KINDS]
            values = sorted({_value(k, text[s:e]) for k, s, e in spans})
            rows.append((*counts, [f"{k}:{s}:{e}" for k, s, e in spans], values, near_terms(text, spans, reach)))
        return pd.DataFrame(rows, columns=["n_email", "n_ip", "n_card", "n_phone", "base", "values", "near"])

    return scan


def _all_terms(text: str) -> list[str]:
    """The distinct words of a whole text outside its spans."""
    return sorted({text[a:b].lower() for a, b in _words_outside(text, base_spans(text), 0, len(text))})


def _log_chance(k: Column, expected: Column) -> Column:
    """Logarithm of a bound, expected^k / k!, of the chance that a Poisson count is at least k."""
    return k * (F.log(expected) - F.log(k) + 1) - F.log(k * 2 * math.pi) / 2


def disclosing_terms(found: DataFrame, docs: DataFrame, text: str, rules: Disclosure) -> DataFrame:
    """(value, term, disclosure) of at least ``generalise_at``, from counts over all different texts.

    ``found`` has a row per document: digest of its text, ``values`` and ``near``. The words near a value
    are held against chance by all texts that show both. The words of a value's whole texts are too, by
    the texts after the first, for one text alone cannot tell which of its words belong to the value.
    Copies of a text say nothing new. A value in every text carries no information.
    """
    total = found.select("digest").distinct().count()
    holds = found.filter(F.size("values") > 0).select("digest", F.explode("values").alias("value")).distinct()
    holds = stored(holds, "value-texts")
    values = stored(holds.groupBy("value").agg(F.count("*").alias("n_value")), "values")
    near = found.filter(F.size("near") > 0).select("digest", F.explode("near").alias("x"))
    near = near.select("digest", "x.value", "x.term").distinct().groupBy("value", "term").agg(F.count("*").alias("n_near"))

    body = text_or_empty(text)
    copied = found.groupBy("digest").agg(F.count("*").alias("copies")).filter("copies > 1")
    copied = copied.select(F.col("digest").alias("__c"), "copies")
    few = fits(copied, rules.broadcast_terms)

    def shares(rows: DataFrame) -> DataFrame:
        """With the share of a text that each of its copies stands for."""
        joined = rows.join(F.broadcast(copied) if few else copied, F.col("digest") == F.col("__c"), "left")
        return joined.withColumn("share", 1 / F.coalesce("copies", F.lit(1))).drop("__c", "copies")

    @F.pandas_udf("array<string>")
    def all_terms(texts: pd.Series) -> pd.Series:
        return texts.map(_all_terms)

    several = holds.join(values.filter("n_value > 1"), "value").groupBy("digest").agg(F.collect_list("value").alias("own"))
    several = stored(several.select(F.col("digest").alias("__d"), "own"), "shared-values")
    small = fits(several, rules.broadcast_terms)
    whole = docs.select(digest(body).alias("digest"), body.alias("__body"))
    whole = shares(whole.join(F.broadcast(several) if small else several, F.col("digest") == F.col("__d")))
    whole = whole.select("share", "own", F.explode(all_terms("__body")).alias("term"))
    whole = whole.select("share", "term", F.explode("own").alias("value")).groupBy("value", "term").agg(
        F.round(F.sum("share")).cast("long").alias("n_all")
    )
    pairs = stored(near.join(whole, ["value", "term"], "full"), "value-terms")
    weighed = pairs.groupBy("value").agg(F.count("n_near").alias("near_terms"), F.count("n_all").alias("all_terms"))

    terms = pairs.select("term").distinct()
    tokens = F.regexp_extract_all(F.lower(body), F.lit("[\\p{L}]{3,}"), F.lit(0))
    words = shares(docs.select(digest(body).alias("digest"), F.array_distinct(tokens).alias("words")))
    words = words.select("share", F.explode("words").alias("term"))
    if fits(terms, rules.broadcast_terms):
        words = words.join(F.broadcast(terms), "term")
    counts = words.groupBy("term").agg(F.round(F.sum("share")).cast("long").alias("n_term"))

    both = F.coalesce("n_all", "n_near")
    information = F.log2(F.lit(float(total)) / F.col("n_value"))
    shared = F.log2(F.lit(float(total)) * both / (F.col("n_value") * F.col("n_term")))
    by_near = _log_chance(F.col("n_near"), F.col("n_value") * F.col("n_term") / F.lit(float(total)))
    later = _log_chance(both - 1, (F.col("n_value") - 1) * (F.col("n_term") - 1) / F.lit(float(total)))
    least = math.log(rules.chance)
    unlikely = F.coalesce(by_near + F.log("near_terms") <= least, F.lit(False)) | F.coalesce(
        (F.col("n_all") > 1) & (later + F.log("all_terms") <= least), F.lit(False)
    )
    scored = pairs.join(values, "value").join(weighed, "value").join(counts, "term")
    scored = scored.filter((F.col("n_value") < total) & unlikely)
    scored = scored.select("value", "term", (shared / information).alias("disclosure"))
    return stored(scored.filter(F.col("disclosure") >= rules.generalise_at), "disclosing")


def _term_spans(docs: DataFrame, text: str, flagged: DataFrame, rules: Disclosure) -> DataFrame:
    """(__d, terms): every occurrence of a flagged term, by digest of the text, outside its base spans."""
    terms = flagged.groupBy("term").agg((F.max("disclosure") >= rules.remove_at).alias("removed"))
    terms = stored(terms, "flagged-terms")
    body = text_or_empty(text)
    if fits(terms, rules.broadcast_terms):
        known = docs.sparkSession.sparkContext.broadcast(dict(map(tuple, terms.collect())))

        @F.pandas_udf("array<struct<start: long, end: long, removed: boolean>>")
        def spans(texts: pd.Series) -> pd.Series:
            removed, out = known.value, []
            for t in texts:
                found = []
                if removed and not removed.keys().isdisjoint(map(str.lower, _WORD.findall(t))):
                    for a, b in _words_outside(t, base_spans(t), 0, len(t)):
                        if (gone := removed.get(t[a:b].lower())) is not None:
                            found.append({"start": a, "end": b, "removed": gone})
                out.append(found)
            return pd.Series(out, dtype=object)

        rows = docs.select(digest(body).alias("__d"), spans(body).alias("terms")).filter(F.size("terms") > 0)
        return rows.dropDuplicates(["__d"])

    @F.pandas_udf("array<struct<term: string, start: long, end: long>>")
    def occurrences(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [
            {"term": t[a:b].lower(), "start": a, "end": b} for a, b in _words_outside(t, base_spans(t), 0, len(t))
        ])

    each = docs.select(digest(body).alias("__d"), F.explode(occurrences(body)).alias("x")).select("__d", "x.*")
    each = each.join(terms, "term").groupBy("__d").agg(F.collect_set(F.struct("start", "end", "removed")).alias("terms"))
    return each.select("__d", F.sort_array("terms").alias("terms"))


def find_private(
    docs: DataFrame, key: str = "doc_id", text: str = "text", rules: Disclosure = Disclosure(),
    carry: tuple[str, ...] = (),
) -> DataFrame:
    """Per document: counts of the four kinds, ``base`` spans, and ``terms`` (start, end, removed).

    Null texts are empty and hold nothing. A term that gives any value away is a span wherever it stands,
    near the value or not, in whatever text. Rows come back one for one, repeated or not; an empty table
    gives none. ``carry`` names columns to keep.
    """
    body = text_or_empty(text)
    found = docs.select(F.col(key), *carry, digest(body).alias("digest"), _scan(rules.reach)(body).alias("s"))
    found = stored(found.select(key, *carry, "digest", "s.*"), "private")
    flagged = disclosing_terms(found.select("digest", "values", "near"), docs, text, rules)
    spans = stored(_term_spans(docs, text, flagged, rules), "term-spans")
    none = F.array().cast("array<struct<start: bigint, end: bigint, removed: boolean>>")
    joined = found.join(spans, F.col("digest") == F.col("__d"), "left")
    return joined.select(
        key, *carry, "n_email", "n_ip", "n_card", "n_phone", "base", F.coalesce("terms", none).alias("terms")
    )


def sanitise(docs: DataFrame, key: str = "doc_id", text: str = "text", rules: Disclosure = Disclosure()) -> DataFrame:
    """(key, text): values become their kind in angle brackets, terms ``<term>`` or nothing.

    Where spans overlap, the one that starts first, or else ends last, stands for them. Null stays null.
    """

    @F.pandas_udf("string")
    def rewrite(texts: pd.Series, bases: pd.Series, terms: pd.Series) -> pd.Series:
        out = []
        for body, base, found in zip(texts, bases, terms):
            if body is None:
                out.append(None)
                continue
            spans = [(int(s), -int(e), f"<{k}>") for k, s, e in (b.split(":") for b in base)]
            spans += [(t["start"], -t["end"], "" if t["removed"] else f"<{TERM}>") for t in found]
            parts, at = [], 0
            for start, end, label in sorted(spans):
                if start >= at:
                    parts += [body[at:start], label]
                    at = -end
            out.append("".join([*parts, body[at:]]))
        return pd.Series(out, dtype=object)

    rows = find_private(docs.select(F.col(key), F.col(text)), key, text, rules, carry=(text,))
    return rows.select(key, rewrite(text, "base", "terms").alias(text))


@register("op4_private_terms")
def op4_private_terms(spark: SparkSession, d: str) -> DataFrame:
    rows = find_private(read(spark, d, "documents"))
    base = F.concat_ws(",", "base")
    terms = F.transform("terms", lambda t: F.concat_ws(":", F.lit(TERM), t["start"], t["end"]))
    return rows.select(
        "doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2(base, 256).alias("base_sha256"),
        F.concat_ws(",", "base", terms).alias("spans"),
    )
