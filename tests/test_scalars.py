import datetime as dt

import pytest
from pyspark.sql import functions as F

from touchmark.functions import scalars as s
from touchmark.functions.vectors import cosine_distance


def value(spark, column):
    return spark.range(1).select(column.alias("v")).head()["v"]


@pytest.mark.parametrize(
    "text, slug",
    [("Audience ID", "audience-id"), ("P&L Statement", "p-l-statement"),
     ("123 Column", "t-123-column"), ("", ""), ("--", "")],
)
def test_slugify(spark, text, slug):
    assert value(spark, s.slugify(F.lit(text))) == slug


@pytest.mark.parametrize(
    "text, title", [("marketing metrics", "Marketing Metrics"), ("3d o'neil ADS", "3D O'Neil Ads")]
)
def test_title_case(spark, text, title):
    assert value(spark, s.title_case(F.lit(text))) == title


def test_link_slug_keeps_other_signs(spark):
    assert value(spark, s.link_slug(F.lit("P&L Total_usd"))) == "p&l-total-usd"


@pytest.mark.parametrize(
    "text, name", [("Cookie-ID", "cookie_id"), (" brand\t", "brand"), ("a b", "a b")]
)
def test_normalize_name(spark, text, name):
    assert value(spark, s.normalize_name(F.lit(text))) == name


@pytest.mark.parametrize(
    "text, target",
    [("Synonym for country_code", "country_code"), ("synonym  for a-b c", "a-b"),
     ("Synonym of country_code", None), ("A Synonym for x", None)],
)
def test_synonym_target(spark, text, target):
    assert value(spark, s.synonym_target(F.lit(text))) == target


def test_tokenize(spark):
    tokens = lambda text: value(spark, s.tokenize_description(F.lit(text)))
    assert tokens("the a an is of") == []
    assert tokens("SUM of Amount_USD per PAN_TOKEN, sum x") == [
        "sum", "amount_usd", "per", "pan_token", "sum",
    ]


@pytest.mark.parametrize(
    "path, namespace, table",
    [
        ("catalog.example.com/projects/p/catalogs/c/namespaces/n/tables/t", "n", "t"),
        ("catalog.example.com/projects/p/catalogs/c/tables/t", "", "t"),
        ("something/else", "", "else"),
        ("a/tables", "", ""),
    ],
)
def test_entry_parts(spark, path, namespace, table):
    assert value(spark, s.entry_namespace(F.split(F.lit(path), "/"))) == namespace
    assert value(spark, s.entry_table(F.split(F.lit(path), "/"))) == table


def test_whole_days_needs_a_full_day(spark):
    at = lambda d, h: F.lit(dt.datetime(2024, 1, d, h, tzinfo=dt.timezone.utc))
    assert value(spark, s.whole_days(at(2, 1), at(1, 23))) == 0
    assert value(spark, s.whole_days(at(2, 23), at(1, 23))) == 1


def test_safe_divide_and_rounding(spark):
    assert value(spark, s.safe_divide(F.lit(1), F.lit(0))) is None
    assert value(spark, s.rounded_text(F.lit(1234.5))) == "1235"


def test_hash_email_normalises(spark):
    assert value(spark, s.hash_email(F.lit(" A@B.c "))) == value(spark, s.hash_email(F.lit("a@b.c")))


def test_rule_name(spark):
    assert value(spark, s.rule_name(F.lit("non_null"), F.lit("audience_id"))) == "non-null-audience-id"


def test_cosine_distance(spark):
    vector = lambda *xs: F.array(*[F.lit(x).cast("float") for x in xs])
    assert value(spark, cosine_distance(vector(1, 0), vector(0, 2))) == 1.0
    assert value(spark, cosine_distance(vector(1, 1), vector(2, 2))) == pytest.approx(0.0, abs=1e-12)
    assert value(spark, cosine_distance(vector(0, 0), vector(1, 0))) is None
