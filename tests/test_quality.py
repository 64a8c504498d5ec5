import datetime as dt

import pytest
from pyspark.sql import functions as F

from touchmark.operators import discover, heavy, profile
from touchmark.operators import quality as dq
from touchmark.operators.quality import Rule


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame(
        [(1, "ab", 1.0), (2, "abc", 2.0), (3, None, None), (4, "b", 4.0)],
        "id long, name string, amount double",
    )


def scan(df, *rules, **options):
    return [(r["passed"], r["ok"]) for r in dq.dq_scan(df, list(rules), **options).collect()]


def test_rules(rows):
    assert scan(rows, Rule("name", "non_null", 0.75), Rule("name", "non_null", 0.76)) == [
        (3, True), (3, False),
    ]
    assert scan(rows, Rule("name", "set", values=("ab", "b")), Rule("id", "set", values=("1",))) == [
        (2, False), (1, False),
    ]
    # A partial match is no match, and alternatives are kept together.
    assert scan(rows, Rule("name", "regex", pattern="ab"), Rule("name", "regex", pattern="ab|b")) == [
        (1, False), (2, False),
    ]


@pytest.mark.parametrize(
    "options, passed",
    [
        ({"min_value": "2"}, 2), ({"min_value": "2", "strict_min_enabled": True}, 1),
        ({"max_value": "2"}, 2), ({"max_value": "2", "strict_max_enabled": True}, 1),
        ({"min_value": "1", "max_value": "4"}, 3), ({}, 3),
    ],
)
def test_range(rows, options, passed):
    assert scan(rows, Rule("amount", "range", **options))[0][0] == passed


def test_bounds_are_not_rounded_to_the_column(rows):
    money = rows.select(F.col("amount").cast("decimal(18,2)").alias("amount"), "id")
    assert scan(money, Rule("amount", "range", min_value="1.995"))[0][0] == 2
    assert scan(money, Rule("id", "range", min_value="1.5"))[0][0] == 3


def test_nulls_can_be_ignored(rows):
    rules = [Rule("name", "regex", pattern="[a-c]+"), Rule("amount", "range", min_value="0")]
    assert scan(rows, *rules) == [(3, False), (3, False)]
    assert scan(rows, *rules, ignore_null=True) == [(4, True), (4, True)]
    assert scan(rows, Rule("name", "non_null"), ignore_null=True) == [(3, False)]


def test_empty_table_breaks_nothing(rows):
    result = dq.dq_scan(rows.filter("false"), [Rule("id", "non_null")]).head()
    assert (result["evaluated"], result["ratio"], result["ok"]) == (0, None, True)


def test_scan_is_one_pass(rows):
    rules = [Rule("id", "non_null"), Rule("name", "regex", pattern="a"), Rule("amount", "range")]
    plan = dq.dq_scan(rows, rules)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan ExistingRDD") == 1


def test_failing_rows(rows):
    rules = [Rule("name", "non_null"), Rule("amount", "range", max_value="2")]
    found = {r["id"]: r["failed_rules"] for r in dq.dq_failing_rows(rows, rules).collect()}
    assert found == {3: ["non-null-name", "range-amount"], 4: ["range-amount"]}


RULES = (
    "`table` string, `column` string, rule_type string, threshold double, dimension string,"
    " `values` array<string>, pattern string, min_value string, max_value string,"
    " strict_min_enabled boolean, strict_max_enabled boolean, position long"
)


def rule_rows(spark, *rows):
    full = [("t", c, kind, th, "COMPLETENESS", vs, p, "", "", False, False, i)
            for i, (c, kind, th, vs, p) in enumerate(rows)]
    return spark.createDataFrame(full, RULES)


def test_rule_diff(spark):
    declared = rule_rows(
        spark,
        ("a", "non_null", 1.0, [], ""), ("b", "set", 1.0, ["x", "y"], ""),
        ("c", "regex", 1.0, [], "p"), ("d", "non_null", 0.1, [], ""), ("d", "non_null", 1.0, [], ""),
    )
    active = rule_rows(
        spark,
        ("a", "non_null", 0.5, [], ""), ("b", "set", 1.0, ["y", "x"], ""),
        ("e", "non_null", 1.0, [], ""), ("d", "non_null", 1.0, [], "ignored"),
    )
    diff = dq.dq_rule_diff(declared, active)
    found = {r["rule"]: r["change"] for r in diff.collect()}
    assert found == {
        "non-null-a": "changed", "set-b": "same", "regex-c": "add", "non-null-e": "remove",
        "non-null-d": "same",
    }
    sync = dq.dq_in_sync(diff).head()
    assert (sync["declared_count"], sync["active_count"], sync["in_sync"]) == (4, 4, False)
    assert dq.dq_in_sync(dq.dq_rule_diff(active, active)).head()["in_sync"]


def test_referential(spark):
    child = spark.createDataFrame([(1,), (2,), (2,), (None,)], "k long")
    parent = spark.createDataFrame([(1,)], "id long")
    row = dq.dq_referential(child, parent, "k", "id").head()
    assert (row["evaluated"], row["passed"], row["ok"]) == (3, 1, False)
    assert dq.dq_referential(parent, parent, "id", "id").head()["ok"]


@pytest.mark.parametrize("accuracy", [4, 100, 10_000])
def test_quantiles_match_builtin(spark, accuracy):
    rows = spark.range(5000).select(
        (F.pmod(F.xxhash64("id"), F.lit(997))).cast("double").alias("spread"),
        F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 11).alias("hot"),
        F.when(F.col("id") < 10, F.col("id")).alias("sparse"),
        F.lit(None).cast("int").alias("missing"),
    )
    found = {r["column_name"]: tuple(r)[1:] for r in profile.quantiles(rows, accuracy=accuracy).collect()}
    for c in ("spread", "hot", "sparse"):
        exact = rows.agg(F.percentile(c, [0.25, 0.5, 0.75]).alias("p")).head()["p"]
        assert found[c] == pytest.approx(tuple(exact))
    assert "missing" not in found


@pytest.mark.parametrize("target", [1, 40, 2000])
def test_quantiles_by_repeated_counting(spark, target):
    """Half of the rows on one value, values over many powers of ten, and no number at all among some."""
    rows = spark.range(4000).select(
        F.when(F.col("id") % 2 == 0, 5.0).otherwise(F.pmod(F.xxhash64("id"), F.lit(1000)) / 100).alias("half"),
        F.exp(F.pmod(F.xxhash64("id"), F.lit(600)) - 300).alias("wide"),
        F.when(F.col("id") % 2 == 0, 5.0 + F.col("id") * 1e-9).otherwise(F.col("id")).alias("dense"),
        F.when(F.col("id") % 5 == 0, float("nan")).otherwise(F.col("id")).alias("nan"),
    )
    found = {r["column_name"]: tuple(r)[1:] for r in profile.quantiles(rows, at=(0.0, 0.1, 0.5, 0.77), target=target).collect()}
    for c in rows.columns:
        exact = rows.agg(F.percentile(c, [0.0, 0.1, 0.5, 0.77]).alias("p")).head()["p"]
        assert found[c] == pytest.approx(tuple(exact), rel=1e-12), c


def test_no_more_than_the_target_is_put_in_order(spark, monkeypatch):
    """The rows that the last step sorts, for half of all rows inside of a narrow bin."""
    rows = spark.range(20_000).select(F.when(F.col("id") % 2 == 0, 5.0 + F.col("id") * 1e-9).otherwise(F.col("id")).alias("v"))
    sorted_rows, plain = [], profile.Window.partitionBy

    def partition_by(*names):
        sorted_rows.append(names)
        return plain(*names)

    monkeypatch.setattr(profile.Window, "partitionBy", staticmethod(partition_by))
    (row,) = profile.quantiles(rows, at=(0.25,), target=500).collect()
    exact = rows.agg(F.percentile("v", 0.25)).head()[0]
    assert row["q1"] == pytest.approx(exact, rel=1e-15) and sorted_rows == [("s",)]


@pytest.mark.parametrize("capacity", [3, 20, 4096])
def test_top_values_against_plain_counts(spark, capacity):
    import random
    from collections import Counter

    rng = random.Random(3)
    rows = [
        (int(rng.paretovariate(0.7)) % 500, rng.choice(["a", "b", None]), float(i), "x" * 70 + str(i % 7), None, -0.0 if i % 2 else 0.0)
        for i in range(1500)
    ]
    names = ["skewed", "few", "unique", "long", "none", "zero"]
    df = spark.createDataFrame(rows, "skewed int, few string, unique double, long string, none int, zero double").repartition(6)
    found = {}
    for r in heavy.top_n(df, 4, capacity=capacity).collect():
        found.setdefault(r["column_name"], []).append((r["value_rank"], r["value"], r["value_count"]))
    for i, name in enumerate(names):
        counts = Counter(str(abs(r[i]) if name == "zero" else r[i]) for r in rows if r[i] is not None)
        best = sorted(counts.items(), key=lambda x: (-x[1], x[0]))[:4]
        assert sorted(found.get(name, [])) == [(k, v, c) for k, (v, c) in enumerate(best, 1)], name
    assert heavy.top_n(df.limit(0), 4).count() == 0


def test_counters_bound_what_they_lose():
    import random
    from collections import Counter

    import pyarrow as pa

    rng = random.Random(1)
    own, plain = heavy.Counters(5), Counter()
    for _ in range(60):
        values = [str(int(rng.paretovariate(0.6)) % 200) for _ in range(50)]
        plain.update(values)
        own.add(pa.array(values))
    held = dict(zip(*own.fold().to_pydict().values()))
    assert len(held) <= 5 and own.lost > 0
    assert all(held.get(v, 0) <= c <= held.get(v, 0) + own.lost for v, c in plain.items())


def test_frequent_values_shuffle_only_candidates(spark):
    """A settled column is never counted whole: its plan has the sketch and the recount, no third scan."""
    df = spark.range(5000).select((F.col("id") % 10).alias("digit"))
    assert "Union" not in heavy.top_n(df, 3)._jdf.queryExecution().optimizedPlan().toString()
    mixed = df.withColumn("id", F.monotonically_increasing_id())
    assert "Union" in heavy.top_n(mixed, 3, capacity=10)._jdf.queryExecution().optimizedPlan().toString()


def test_profile_of_empty_and_constant_columns(spark):
    rows = spark.createDataFrame([(1, None), (1, None)], "c int, n int")
    flagged = {r["column_name"]: r["anomaly"] for r in profile.anomalies(rows).collect()}
    assert flagged == {"c": "constant", "n": "all_null"}
    bars = [tuple(r) for r in profile.histogram(rows, 4).collect()]
    assert bars == [("c", 0, 1.0, 2)]
    assert {r["column_name"]: r["distinct_count"] for r in profile.distinct(rows).collect()} == {
        "c": 1, "n": 0,
    }


def test_approximate_distinct_is_close(spark):
    rows = spark.range(10000).select("id", (F.col("id") % 10).alias("digit"))
    found = {r["column_name"]: r["distinct_count"] for r in profile.distinct(rows, approximate=True).collect()}
    assert found["digit"] == 10 and abs(found["id"] - 10000) < 1500


def test_discovery(spark):
    parent = spark.createDataFrame([(i, f"n{i % 2}") for i in range(4)], "id long, name string")
    child = spark.createDataFrame([(0, 10), (0, 11), (1, 12), (None, 13)], "ref long, own long")
    tables = {"parent": parent, "child": child}
    keys = {(r["table_name"], r["column_name"]) for r in discover.primary_keys(tables).collect()}
    assert keys == {("parent", "id"), ("child", "own")}
    (edge,) = discover.foreign_keys(tables).collect()
    assert (edge["child_column"], edge["parent_column"]) == ("ref", "id")
    assert (edge["coverage"], edge["fill_rate"], edge["child_unique"]) == (1.0, 0.75, False)


def test_synonym_columns(spark):
    rows = spark.createDataFrame([(1, 1, None, None), (2, 2, None, 1)], "a long, b long, c long, d long")
    found = [tuple(r) for r in discover.synonym_columns_discover(rows).collect()]
    assert found == [("a", "b")]
    checked = discover.synonym_columns_check(rows, [("b", "a"), ("d", "c")]).collect()
    assert [r["mismatches"] for r in checked] == [0, 1]


def test_scan_results_are_kept_once_per_run(spark, rows, tmp_path):
    from touchmark.sources.sinks import append_scan_results

    scan_rows = dq.dq_scan(rows, [Rule("id", "non_null")])
    for run in ("a", "a", "b"):
        append_scan_results(scan_rows, str(tmp_path / "dq"), run, dt.datetime(2024, 1, 1))
    assert spark.read.parquet(str(tmp_path / "dq")).count() == 2


def test_profiles_merge_without_the_data(spark, tmp_path):
    """Runs that share values count them once; a repeated run replaces itself, and one run can be read alone."""
    from touchmark.sources.profiles import ERROR, append_profile, merged_profile

    rows = spark.range(20_000).select("id", (F.col("id") % 7).cast("double").alias("digit"), F.when(F.col("id") < 50, "x").alias("few"))
    for run, low in (("a", 0), ("b", 5000), ("a", 0)):
        part = rows.filter((F.col("id") >= low) & (F.col("id") < low + 10_000))
        append_profile(part, str(tmp_path), "t", run, dt.datetime(2024, 1, 1))
    found = {r["column_name"]: r for r in merged_profile(spark, str(tmp_path), "t").collect()}
    assert all(r["row_count"] == 20_000 for r in found.values())
    assert abs(found["id"]["distinct_estimate"] - 15_000) <= 4 * ERROR * 15_000
    assert (found["digit"]["distinct_estimate"], found["few"]["distinct_estimate"], found["few"]["null_count"]) == (7, 1, 19_950)
    (alone,) = merged_profile(spark, str(tmp_path), "t", ["b"]).filter("column_name = 'few'").collect()
    assert (alone["row_count"], alone["distinct_estimate"]) == (10_000, 0)
