import pytest
from pyspark.sql import functions as F

from touchmark.functions import scalars as s
from touchmark.operators import glossary as gl

TERMS = (
    "name string, display_name string, description string, synonyms array<string>,"
    " related array<string>, category string, term_ord long, glossary_id string"
)


def terms(spark, *rows, glossary="g"):
    """(display name, description[, synonyms[, related]])"""
    full = []
    for i, (display, description, *lists) in enumerate(rows):
        synonyms, related = (*lists, [], [])[:2]
        name = display.lower().replace("_", "-").replace(" ", "-")
        full.append((name, display, description, synonyms, related, "Cat", i, glossary))
    df = spark.createDataFrame(full, TERMS)
    return df.withColumn("term_key", s.normalize_name(F.col("display_name")))


def columns(spark, *names):
    """``table.column`` names; a table may carry a namespace before a slash."""
    rows = []
    for i, name in enumerate(names):
        full, column = name.split(".")
        namespace, _, table = full.rpartition("/")
        rows.append((namespace, table, full, column, i, 0))
    df = spark.createDataFrame(
        rows,
        "namespace string, table_name string, full_table string, column_name string,"
        " table_ord int, position int",
    )
    return df.withColumn("column_key", s.normalize_name(F.col("column_name")))


def places(df):
    return {(r["glossary_term"], r["table"], r["column"]) for r in df.collect()}


def test_exact_ignores_case_and_hyphens(spark):
    found = gl.match_exact(
        terms(spark, ("Brand", ""), ("country-code", "")),
        columns(spark, "campaigns.brand", "creatives.BRAND", "campaigns.country_code", "x.other"),
    )
    assert places(found) == {
        ("Brand", "campaigns", "brand"), ("Brand", "creatives", "BRAND"),
        ("country-code", "campaigns", "country_code"),
    }


def test_last_of_equal_names_wins(spark):
    found = gl.match_exact(
        terms(spark, ("brand", "first"), ("Brand", "second")), columns(spark, "c.brand")
    ).collect()
    assert [r["description"] for r in found] == ["second"]


def test_synonym_takes_one_step(spark):
    t = terms(
        spark, ("country_code", "ISO code"), ("market", "Synonym for country_code"),
        ("place", "Synonym for market"),
    )
    c = columns(spark, "campaigns.country_code")
    (row,) = gl.match_synonym(t, c).collect()
    assert (row["glossary_term"], row["via_synonym"], row["match_score"]) == ("market", "country_code", 100)
    assert row["match_rationale"] == "synonym for country_code"
    left = [r["display_name"] for r in gl.unmatched_terms(t, c).collect()]
    assert left == ["place"]


def test_synonym_list(spark):
    t = terms(spark, ("hashed_email", "", ["hem"]), ("brand", "", ["hem"]))
    found = gl.match_synonym_list(t, columns(spark, "audience.hem", "campaigns.brand"))
    assert places(found) == {("hashed_email", "audience", "hem")}


@pytest.mark.parametrize(
    "column, description, score, why",
    [
        ("transactions.amount_usd", "amount_usd", 10, "exact:amount_usd"),
        ("transactions.amount_usd", "amount", 5, "substr:amount"),
        ("pixel_events.event_id", "pixel", 3, "table:pixel"),
        ("t.amount_usd", "amount usd", 10, "substr:amount, substr:usd"),
        ("pixel_events.event_type", "event pixel", 8, "substr:event, table:pixel"),
        ("t.amount_usd", "usd of the usd", 10, "substr:usd, substr:usd"),
        ("Pixel_Events.Event_ID", "Event_ID", 10, "exact:event_id"),
    ],
)
def test_fuzzy_score(spark, column, description, score, why):
    (row,) = gl.match_fuzzy(terms(spark, ("zz", description)), columns(spark, column), 0).collect()
    assert (row["match_score"], row["match_rationale"]) == (score, why)


def test_fuzzy_skips_empty_and_unrelated(spark):
    t = terms(spark, ("a1", ""), ("a2", None), ("a3", "nothing alike"))
    assert gl.match_fuzzy(t, columns(spark, "t.amount_usd"), 0).count() == 0


def test_threshold_and_order(spark):
    t = terms(spark, ("m1", "amount usd"), ("m0", "amount"))
    c = columns(spark, "t.amount", "t.amount_usd", "t.usd_total")
    every = gl.match_fuzzy(t, c, 0)
    ranked = [(r["glossary_term"], r["column"], r["match_score"]) for r in gl.rank_proposals(every).collect()]
    assert ranked == [
        ("m1", "amount", 10), ("m1", "amount_usd", 10), ("m1", "usd_total", 5),
        ("m0", "amount", 10), ("m0", "amount_usd", 5),
    ]
    assert gl.match_fuzzy(t, c, threshold=10).count() == 3
    assert gl.fuzzy_threshold(every, 0).count() == 5


def test_fuzzy_plan_has_no_cross_join(spark):
    plan = gl.match_fuzzy(terms(spark, ("a", "b c")), columns(spark, "t.b"), 0)
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in text and "NestedLoop" not in text


def test_implied_terms_and_links(spark):
    t = terms(
        spark, ("roas", "Return", ["Ad Return"], ["mer"]), ("mer", "Ratio", [], ["roas", "ad return"])
    )
    implied = gl.implied_terms(t)
    assert [tuple(r) for r in implied.select("name", "display_name", "description").collect()] == [
        ("ad-return", "Ad Return", "Synonym of roas")
    ]
    links = {r["link_id"] for r in gl.term_links(t, implied).collect()}
    assert links == {"synonym-ad-return-roas", "related-mer-roas", "related-ad-return-mer"}


def test_glossaries_keep_their_own_terms(spark):
    t = terms(spark, ("Brand", "first"), ("mark", "Synonym for brand"), ("amount", "", ["fee"]))
    t = t.unionByName(terms(spark, ("brand", "second"), ("sign", "Synonym for amount"), glossary="h"))
    c = columns(spark, "c.brand", "c.amount")
    assert {(r["glossary_id"], r["description"]) for r in gl.match_exact(t, c).collect()} == {
        ("g", "first"), ("g", ""), ("h", "second"),
    }
    assert [(r["glossary_id"], r["column"]) for r in gl.match_synonym(t, c).collect()] == [("g", "brand")]
    assert [r["display_name"] for r in gl.unmatched_terms(t, c).collect()] == ["sign"]
    t = t.unionByName(terms(spark, ("cost", "", ["Fee"]), ("fee", ""), glossary="i"))
    implied = gl.implied_terms(t)
    assert [(r["glossary_id"], r["name"]) for r in implied.collect()] == [("g", "fee")]
    links = {(r["glossary_id"], r["link_id"]) for r in gl.term_links(t, implied).collect()}
    assert links == {("g", "synonym-amount-fee"), ("i", "synonym-cost-fee")}


def test_listed_synonyms_are_proposed_and_not_matched_by_words(spark):
    t = terms(spark, ("mail", "hem of the audience", ["hem", "hem", "HEM"]), ("gone", "audience", ["nothing"]))
    found = gl.proposals(t, columns(spark, "audience.hem", "audience.other"), threshold=1).collect()
    assert sorted((r["phase"], r["glossary_term"], r["column"], r["via_synonym"]) for r in found) == [
        (2, "mail", "hem", "HEM"), (2, "mail", "hem", "hem"), (3, "gone", "hem", ""), (3, "gone", "other", ""),
    ]


def test_link_id(spark):
    def link(*target):
        return spark.range(1).select(gl.link_id(*map(F.lit, target)).alias("v")).head()["v"]

    assert link("g", "region", "m", "audience", "c").startswith("definition-region-m-audience-c-")
    long = ("g", "x" * 80, "marketing", "audience", "region")
    assert len(link(*long)) == 63
    others = [("h", *long[1:]), (*long[:-1], "market"), (*long[:-2], "other", "region")]
    assert len({link(*target) for target in (long, *others)}) == 4


def test_apply_links(spark):
    rows = spark.createDataFrame(
        [(0, "hem", "m/audience", "hem"), (1, "hem", "m/audience", "hem2"), (2, "hem", "m/nowhere", "c"),
         (3, "old", "m/audience", "c"), (4, "x" * 60, "m/audience", "a"), (5, "x" * 60, "m/other", "b"),
         (6, "hem", "m/audience", "hem")],
        "ord int, glossary_term string, `table` string, `column` string",
    ).withColumn("glossary_id", F.lit("g"))
    inventory = spark.createDataFrame(
        [("m", "audience"), ("m", "other")], "namespace string, table_name string"
    )
    old = gl.link_id(*map(F.lit, ("g", "old", "m", "audience", "c")))
    existing = spark.range(1).select(old.alias("link_id"))
    out = gl.apply_links(rows, inventory, existing, order=("ord",)).collect()
    assert sorted((r["glossary_term"][:3], r["table_column"], r["status"]) for r in out) == [
        ("hem", "m/audience.hem", "created"), ("hem", "m/audience.hem", "skipped"),
        ("hem", "m/audience.hem2", "created"), ("hem", "m/nowhere.c", "error"),
        ("old", "m/audience.c", "skipped"), ("xxx", "m/audience.a", "created"), ("xxx", "m/other.b", "created"),
    ]
    made = existing.unionByName(
        spark.createDataFrame([(r["link_id"],) for r in out if r["status"] == "created"], "link_id string")
    )
    again = gl.apply_links(rows, inventory, made, order=("ord",))
    assert {r["status"]: r["result_count"] for r in gl.apply_summary(again).collect()} == {
        "skipped": 6, "error": 1,
    }
    dry = gl.apply_links(rows, inventory, existing, order=("ord",), dry_run=True)
    assert [tuple(r) for r in gl.apply_summary(dry).collect()] == [("dry-run", 7)]


def test_proposal_files_are_validated(spark, tmp_path):
    from touchmark.sources.sinks import read_proposals

    (tmp_path / "p.json").write_text(
        '{"glossary_term": "a", "table": "t", "column": "c"}\n'
        '{"glossary_term": "", "table": "t", "column": "c"}\n'
        '{"glossary_term": "a", "table": "t"}\n'
    )
    rows = read_proposals(spark, str(tmp_path / "p.json")).collect()
    assert [r["missing_field"] for r in rows] == [None, "glossary_term", "column"]


def test_equal_terms_and_columns_are_matched_once(spark):
    t = terms(spark, *[(f"m{i}", "usd of the amount usd") for i in range(300)])
    names = [f"t{i}.amount_usd" for i in range(400)]
    c = columns(spark, *names).unionByName(columns(spark, names[0]))  # the first place comes twice
    words, places = gl._classes(t, c)
    classes = {len(r["hits"]) for r in gl._class_hits(words, places).collect()}
    assert gl._class_hits(words, places).count() == 2 and classes == {3, 6}
    found = gl.match_fuzzy(t, c, 0)
    scores = {(r["match_score"], r["match_rationale"], r["n"]) for r in found.groupBy("match_score", "match_rationale").agg(F.count("*").alias("n")).collect()}
    once, twice = "substr:usd, substr:amount, substr:usd", ", ".join(f"substr:{k}, substr:{k}" for k in ("usd", "amount", "usd"))
    assert scores == {(15, once, 300 * 399), (30, twice, 300)}
    hits = gl.keyword_hits(t, c)
    assert hits.count() == 300 * 401 * 3 and hits.agg(F.sum("points")).first()[0] == 300 * 401 * 15


def test_rows_of_equal_names_come_from_chunks(spark):
    """Chunks of terms and columns are shuffled, not the rows they make."""
    t = terms(spark, ("brand", "")).crossJoin(spark.range(400).select(F.concat(F.lit("g"), "id").alias("g")))
    t = t.drop("glossary_id").withColumnRenamed("g", "glossary_id")
    c = columns(spark, *[f"t{i}.Brand" for i in range(3000)])
    found = gl.match_exact(t, c)
    keys = F.xxhash64("glossary_id", "table")
    assert tuple(found.agg(F.count("*"), F.approx_count_distinct(keys) > 1_000_000).first()) == (400 * 3000, True)
    pairs = gl._same_name(t.selectExpr("term_key term_class"), c.selectExpr("column_key place_class"))
    assert pairs.count() == 1
    assert "BroadcastHashJoin" not in found._jdf.queryExecution().executedPlan().toString()


def test_proposals_are_written_compressed_and_read_back(spark, tmp_path):
    from touchmark.sources.sinks import PROPOSAL_SCHEMA, read_proposals, write_proposals

    row = ("term", "cat", "a description", "t", "c", "exact", "", 100, "exact match")
    write_proposals(spark.createDataFrame([row] * 2000, PROPOSAL_SCHEMA).coalesce(1), str(tmp_path / "p"))
    (file,) = (tmp_path / "p").glob("part-*")
    assert file.name.endswith(".json.gz") and file.stat().st_size < 20_000
    back = read_proposals(spark, str(tmp_path / "p"))
    assert back.count() == 2000 and [tuple(r) for r in back.distinct().collect()] == [(*row, None, True)]


def test_description_diff_does_not_broadcast(spark):
    """An inventory's estimate says nothing of its rows."""
    c = columns(spark, "t.a", "t.b").withColumn("description", F.lit("d"))
    diff = gl.description_diff(c, c.filter("column_name = 'a'"))
    assert "SortMergeJoin" in diff._jdf.queryExecution().executedPlan().toString()
    assert sorted(tuple(r)[1:] for r in diff.collect()) == [
        ("a", "d", "d", "unchanged"), ("b", "d", "(no description)", "changed"),
    ]


def test_steps_of_the_matching_are_planned_once(spark):
    found = gl.proposals(terms(spark, ("brand", "the usd", ["amount"])), columns(spark, "t.amount", "t.usd"), 0)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") <= 40  # the registered query had 161 on its tables
    assert places(found) == {("brand", "t", "amount")}


def test_heads_of_link_ids(spark):
    """Parts that the head has no room for need no slug; the others have theirs, a null has none."""
    rows = [("A_b", "n", "T_x", "Some Col"), ("x" * 30, "n", "t", "c"), ("Ab", "nnnnnnnnnnnnnn", "T_x", "C"), (None, "n", None, "A_B")]
    df = spark.createDataFrame(rows, "term string, namespace string, t string, c string")
    ids = df.select(gl.link_id(F.lit("g"), *map(F.col, ("term", "namespace", "t", "c"))).alias("v"))
    heads = [r["v"][:-33] for r in ids.collect()]
    assert heads == [
        "definition-a-b-n-t-x-some-col", "definition-" + "x" * 19, "definition-ab-nnnnnnnnnnnnnn-t", "definition-n-a-b",
    ]


@pytest.mark.parametrize("broadcast", [500_000, 0])
def test_rows_are_ranked_from_chunks(spark, monkeypatch, broadcast):
    """Matches that are not written out are dealt to ranges before their rows are made, in the same order."""
    monkeypatch.setattr(gl, "BROADCAST_PLACES", broadcast)
    monkeypatch.setattr(gl, "PLACE_CHUNK", 3)
    t = terms(spark, *[(f"m{i}", ("usd amount", "usd", "amount", "nothing")[i % 4]) for i in range(40)])
    t = t.withColumn("term_ord", F.floor(F.col("term_ord") / 2))  # two terms share a place in the order
    c = columns(spark, *[f"t{i}.{name}" for i in range(20) for name in ("amount", "usd_amount", "x_usd")])
    order = ("term_ord", F.col("match_score").desc(), "table_ord", "position")
    key = ("term_ord", "match_score", "table_ord", "position")
    rows = gl.match_fuzzy(t, c, 0)
    ranked = gl.rank_proposals(gl.match_fuzzy(t, c, 0, written_out=False))
    assert ranked.columns == rows.columns
    found, wanted = [tuple(r) for r in ranked.collect()], [tuple(r) for r in rows.orderBy(*order).collect()]
    assert sorted(found) == sorted(wanted) and len(found) == 10 * (60 + 40 + 40)
    assert [r[k] for r in ranked.collect() for k in key] == [r[k] for r in rows.orderBy(*order).collect() for k in key]
    plan = ranked._jdf.queryExecution().executedPlan().toString()
    assert plan.index("Generate inline(place") < plan.index("rangepartitioning")


def test_proposals_that_differ_in_little_are_written_together(spark, tmp_path):
    """Equal terms of many glossaries follow each other for each column, which the files' compression folds."""
    from touchmark.sources.sinks import read_proposals, write_proposals

    kind = F.concat(F.lit("Category "), (F.col("id") * 7919 % 5).cast("string"))
    t = terms(spark, ("brand", "the brand")).drop("glossary_id", "category").crossJoin(
        spark.range(400).select(F.concat(F.lit("g"), "id").alias("glossary_id"), kind.alias("category"))
    )
    c = columns(spark, *[f"t{i * 7919 % 500}.Brand" for i in range(500)])
    write_proposals(gl.match_exact(t, c).select(*gl.PROPOSAL_COLUMNS), str(tmp_path / "p"))
    assert read_proposals(spark, str(tmp_path / "p")).count() == 400 * 500
    assert sum(f.stat().st_size for f in (tmp_path / "p").glob("part-*")) < 400 * 500


def test_parts_are_dealt_before_their_columns(spark, tmp_path):
    """The small file of parts is not fanned out into columns by the task that reads it."""
    from touchmark.sources import star

    rows = [(1, "red bolt", "Brand#1", "SMALL", 1), (1, "red bolt", "Brand#1", "SMALL", 1), (None, None, "Brand#2", "LARGE", 2)]
    parts = spark.createDataFrame(rows, "p_partkey long, p_name string, p_brand string, p_type string, p_size int")
    parts.coalesce(1).write.parquet(str(tmp_path / "part.parquet"))
    found = gl.catalog_columns(star.catalog_entries(spark, str(tmp_path)))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.index("Generate") < plan.index("REPARTITION_BY_COL")
    assert [r["column_name"] for r in found.collect()].count("red_bolt") == 2


def test_links_are_applied_by_classes_as_by_rows(spark, tmp_path):
    """Parts of matches are decided, stored and counted without their rows, as the rows would be one by one."""
    from collections import Counter

    from touchmark.sources.links import LinkTable

    given = [("brand", ""), ("mark", "Synonym for brand", ["BRAND", "Brand"]), ("cost", "", ["usd"]), ("m1", "the usd amount"), ("m2", "amount usd_total")]
    t = terms(spark, *given).unionByName(terms(spark, *given[:4], glossary="h"))
    c = columns(spark, "n/a.brand", "n/a.Brand", "n/b.amount_usd", "n/x.usd", "promo.usd", "n/b.usd_total", "n/b.usd")
    # Places that come twice, and one column of a table at two positions, of which one comes twice.
    c = c.unionByName(c.filter("column_name IN ('brand', 'usd_total')")).unionByName(c.filter("column_name = 'usd_total'").withColumn("table_ord", F.lit(0)))
    inventory = c.selectExpr("split_part(full_table, '/', 1) namespace", "table_name").filter("table_name NOT IN ('x', 'promo')")
    count = lambda df: Counter(tuple(r) for r in df.collect())
    rows = gl.proposals(t, c, 1).withColumn("neg_score", -F.col("match_score"))
    parts = gl.proposals(t, c, 1, rows=False)
    by_id, by_class = LinkTable(spark, str(tmp_path / "a"), buckets=4), LinkTable(spark, str(tmp_path / "b"), buckets=4)
    order = gl.APPLY_ORDER
    early = gl.match_exact(t, c, rows=False).of_places(F.col("column_name") == "brand")
    for run, (asked, held) in {"run-1": (gl.match_exact(t, c).filter("column = 'brand'"), (early,)), "run-2": (rows, parts)}.items():
        asked = asked if run == "run-2" else asked.withColumns({"phase": F.lit(0), "neg_score": F.lit(0)})
        wanted = gl.apply_links(asked, inventory, by_id.read(), order=order)
        found = gl.apply_links(held, inventory, by_class.links(), order=order)
        assert isinstance(found, tuple) and count(gl.written_out(found)) == count(wanted)
        assert count(gl.apply_summary(found)) == count(gl.apply_summary(wanted))
        by_id.upsert(wanted.filter("status = 'created'"), run)
        assert by_class.upsert(tuple(part.of_pairs("status = 'created'") for part in found), run)
    assert count(by_class.read()) == count(by_id.read().select(*by_class.read().columns))
    assert len({r["status"] for r in wanted.collect()}) == 3
    again = gl.apply_links(parts, inventory, by_class.links(), order=order)
    assert {r["status"] for r in gl.apply_summary(again).collect()} == {"skipped", "error"}
    before = by_class.manifest(), by_class.version()
    created = tuple(part.of_pairs("status = 'created'") for part in found)
    assert by_class.upsert(created, "run-2") == [] and before == (by_class.manifest(), by_class.version())
    # A table with links by their ids takes parts as rows.
    assert by_id.upsert(created, "run-3") == []


def test_rows_are_dealt_by_their_number(spark, monkeypatch):
    """The join that makes rows has tasks by the rows, not by the bytes of their chunks."""
    monkeypatch.setattr(gl, "TASK_ROWS", 100)
    monkeypatch.setattr(gl, "PLACE_CHUNK", 10)
    found = gl.match_exact(terms(spark, ("brand", "")), columns(spark, *[f"t{i}.Brand" for i in range(3000)]))
    found.count()
    assert found.count() == 3000 and found.rdd.getNumPartitions() == 31


def test_parts_of_names_meet_few_keywords_unshuffled(spark):
    c = columns(spark, "Ab_c-1d.x_usd", "t.usd")
    names = spark.createDataFrame([("ab_c",), ("1d/a",), ("x",), (None,)], "name string")
    assert {tuple(r) for r in gl._parts(names).collect()} == {("ab_c", k) for k in ("ab", "ab_", "ab_c", "b_", "b_c")}
    words = spark.createDataFrame([("usd",), ("ab",)], "keyword string")
    placed = gl._place_classes(c, words)
    assert "BroadcastHashJoin" in placed._jdf.queryExecution().executedPlan().toString()
    assert sorted([tuple(h) for h in r["hits"]] for r in placed.collect()) == [
        [("usd", "exact")], [("usd", "substr"), ("ab", "table")],
    ]
