"""Scalar expressions used across the operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The words a description keyword may not be.
STOP_WORDS = (
    "the", "a", "an", "is", "of", "for", "by", "in", "to", "with", "as", "and", "or", "that",
    "used", "from",
)

_BLANKS = " \t\n\r\x0b\x0c"


def safe_divide(numerator: Column, denominator: Column) -> Column:
    """Division in doubles; NULL when the denominator is zero."""
    return F.try_divide(numerator.cast("double"), denominator.cast("double"))


def non_negative_hash(column: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(column), F.lit(buckets))


def normalize_name(name: Column) -> Column:
    """Lower case, hyphens to underscores, outer blanks removed."""
    return F.btrim(F.translate(F.lower(name), "-", "_"), F.lit(_BLANKS))


def title_case(text: Column) -> Column:
    """Every run of letters starts with a capital, also after digits and signs."""
    runs = F.regexp_extract_all(text, F.lit(r"\p{L}+|[^\p{L}]+"), F.lit(0))
    return F.array_join(F.transform(runs, lambda run: F.initcap(run)), "")


def slugify(text: Column) -> Column:
    """Runs of anything but ``[a-z0-9]`` become one hyphen; a leading digit gets ``t-``."""
    slug = F.btrim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), F.lit("-"))
    return F.when(slug.rlike("^[0-9]"), F.concat(F.lit("t-"), slug)).otherwise(slug)


def link_slug(text: Column) -> Column:
    """The weaker slug of link ids: only blanks and underscores become hyphens."""
    return F.translate(F.lower(text), " _", "--")


def synonym_target(description: Column) -> Column:
    """The term named by "Synonym for <term>", else NULL."""
    target = F.regexp_extract(description, r"(?U)^[Ss]ynonym\s+for\s+(\w[\w_-]*)", 1)
    return F.nullif(target, F.lit(""))


def tokenize_description(description: Column) -> Column:
    """Keywords in order of appearance; repeats stay."""
    words = F.regexp_extract_all(F.lower(description), F.lit("[a-z][a-z0-9_]*"), F.lit(0))
    return F.filter(words, lambda w: (F.length(w) > 1) & ~w.isin(*STOP_WORDS))


def hash_email(email: Column) -> Column:
    return F.sha2(F.lower(F.trim(email)), 256)


def path_segment(path: Column, label: str) -> Column:
    """The segment after ``/label/``, or an empty string."""
    return F.regexp_extract(path, f"/{label}/([^/]+)", 1)


def entry_id(path: Column) -> Column:
    """Everything after ``/entries/``."""
    return F.regexp_extract(path, "/entries/(.+)$", 1)


def entry_table(parts: Column) -> Column:
    """Segment after ``tables``, of an entry id split at its slashes; else the last segment."""
    at = F.array_position(parts, "tables").cast("int")
    return F.when(at > 0, F.coalesce(F.get(parts, at), F.lit(""))).otherwise(
        F.element_at(parts, -1)
    )


def entry_namespace(parts: Column) -> Column:
    """Segment between ``namespaces`` and ``tables``; empty when the path has no namespace."""
    at = F.array_position(parts, "tables").cast("int")
    named = (at >= 3) & (F.get(parts, at - 3) == "namespaces")
    return F.when(named, F.get(parts, at - 2)).otherwise(F.lit(""))


def whole_days(later: Column, earlier: Column) -> Column:
    """Complete 24-hour days between two instants."""
    return F.timestamp_diff("DAY", earlier, later)


def rounded_text(amount: Column) -> Column:
    """Amount rounded to a whole number, as text without a fraction."""
    return F.round(amount, 0).cast("bigint").cast("string")


def rule_name(rule_type: Column, column: Column) -> Column:
    return F.translate(F.concat_ws("-", rule_type, column), "_", "-")
