import datetime as dt
import random

import pytest

from touchmark.operators import attribution as at
from touchmark.operators import marts

T0 = dt.datetime(2024, 3, 1, 12, tzinfo=dt.timezone.utc)
EVENTS = "event_id long, event_type string, cookie_id long, campaign_id long, spend_usd decimal(18,2), event_ts timestamp"
TXNS = "txn_id long, pan_token long, cookie_id long, hem string, country_code string, amount_usd decimal(18,2), txn_ts timestamp"


def after(**delta):
    return T0 + dt.timedelta(**delta)


def events(spark, rows):
    """(event_id, cookie_id, campaign_id, event_ts), all clicks."""
    return spark.createDataFrame([(e, "click", c, k, None, t) for e, c, k, t in rows], EVENTS)


def transactions(spark, rows):
    """(txn_id, cookie_id, hem, txn_ts)"""
    return spark.createDataFrame([(i, i, c, h, "US", None, t) for i, c, h, t in rows], TXNS)


def credit(df):
    return {r["txn_id"]: r["event_id"] for r in df.collect()}


def test_window_edges(spark):
    clicks = events(spark, [(1, 1, 9, T0), (2, 2, 9, T0), (3, 3, 9, T0), (4, 4, 9, after(seconds=1))])
    buys = transactions(
        spark,
        [
            (10, 1, None, after(days=30)),  # exactly 30 days: in
            (20, 2, None, after(days=30, microseconds=1)),  # one microsecond more: out
            (30, 3, None, T0),  # same instant: in
            (40, 4, None, T0),  # click after: out
        ],
    )
    assert credit(at.last_touch(clicks, buys)) == {10: 1, 30: 3}
    counts = {r["txn_id"]: r["touch_count"] for r in at.attribution_candidates(clicks, buys).collect()}
    assert counts == {10: 1, 30: 1}


def test_tie_goes_to_larger_id_and_null_never_matches(spark):
    clicks = events(spark, [(5, 1, 9, T0), (6, 1, 8, T0), (7, None, 9, T0)])
    buys = transactions(spark, [(10, 1, None, after(hours=1)), (20, None, None, after(hours=1))])
    assert credit(at.last_touch(clicks, buys)) == {10: 6}


def test_cookie_wins_over_hem(spark):
    registry = spark.createDataFrame(
        [(1, "h1", 100), (2, "h2", None), (3, "h1", 50)], "cookie_id long, hem string, audience_id long"
    )
    clicks = events(spark, [(1, 1, 9, T0), (2, 2, 8, after(hours=5)), (3, 3, 7, after(hours=2))])
    buys = transactions(
        spark,
        [
            (10, 1, "h2", after(days=1)),  # both: cookie, though the hem click is later
            (20, None, "h1", after(days=1)),  # hem only: the later of the two cookies behind it
            (30, 5, "h2", after(days=1)),  # cookie without clicks: hem
            (40, 5, None, after(days=1)),
        ],
    )
    found = at.attribute_with_fallback(clicks, buys, registry).collect()
    assert {r["txn_id"]: (r["event_id"], r["matched_via"]) for r in found} == {
        10: (1, "cookie"), 20: (3, "hem"), 30: (2, "hem"),
    }
    resolved = at.identity_resolve(buys.select("txn_id", "cookie_id", "hem"), registry).collect()
    assert {r["txn_id"]: (r["audience_id"], r["resolved_via"]) for r in resolved} == {
        10: (100, "cookie"), 20: (50, "hem"), 30: (None, None), 40: (None, None),
    }


@pytest.mark.parametrize("bucket_seconds", [600, 6 * 3600, 40 * 24 * 3600])
@pytest.mark.parametrize("days, segment_rows", [(1, 500_000), (30, 500_000), (1, 8), (30, 25)])
def test_matches_brute_force_with_a_hot_cookie(spark, bucket_seconds, days, segment_rows):
    """A third of all rows belong to one cookie; ties and long gaps occur."""
    rng = random.Random(bucket_seconds + days)
    cookie = lambda: 1 if rng.random() < 0.35 else rng.randrange(2, 20)
    moment = lambda: after(minutes=10 * rng.randrange(0, 9000))
    clicks = [(i, cookie(), rng.randrange(5), moment()) for i in range(600)]
    buys = [(1000 + i, cookie(), None, moment()) for i in range(300)]
    window = dt.timedelta(days=days)
    expected, counts = {}, {}
    for txn, who, _, at_ts in buys:
        seen = [(t, e) for e, c, _, t in clicks if c == who and t <= at_ts <= t + window]
        if seen:
            expected[txn] = [e for _, e in sorted(seen, reverse=True)[:3]]
            counts[txn] = len(seen)
    e, t = events(spark, clicks), transactions(spark, buys)
    options = {"within_days": days, "bucket_seconds": bucket_seconds, "segment_rows": segment_rows}
    ranked = at.latest_touches(t.select("txn_id", "cookie_id", "txn_ts"), e, k=3, **options).collect()
    found = {}
    for row in sorted(ranked, key=lambda r: (r["txn_id"], r["rn"])):
        found.setdefault(row["txn_id"], []).append(row["event_id"])
    assert found == expected
    assert credit(at.last_touch(e, t, window_days=days, bucket_seconds=bucket_seconds, segment_rows=segment_rows)) == {
        txn: ids[0] for txn, ids in expected.items()
    }
    counted = at.touch_counts(t.select("txn_id", "cookie_id", "txn_ts"), e, **options).collect()
    assert {r["txn_id"]: r["touch_count"] for r in counted} == counts


def test_a_busy_hour_is_cut_by_its_density(spark):
    """All clicks of one cookie inside one hour, most of them in its first minute: no segment is far above the median."""
    from pyspark.sql import functions as F

    n = 40_000
    clicks = spark.range(n).select(
        F.lit(1).alias("_key"), F.lit(0).alias("_bucket"),
        F.timestamp_micros((F.pow(F.rand(3), 4) * 3.6e9).cast("long")).alias("_at"),
    ).union(spark.range(1000).select(F.col("id") % 50 + 2, F.lit(0), F.timestamp_micros(F.col("id") * 1000)))
    cuts = at._cuts([clicks], 1000)
    sizes = at._with_segment(clicks, cuts).filter("_key = 1").groupBy("_sub").count().toPandas()["count"]
    assert len(sizes) >= 30 and sizes.sum() == n and sizes.max() <= 3 * sizes.median()
    assert [r["_key"] for r in cuts.collect()] == [1]
    assert at._cuts([clicks], n + 1000) is None and at._cuts([clicks.limit(0)], 10) is None


def test_equal_times_stay_together(spark):
    clicks = events(spark, [(i, 1, 9, T0) for i in range(60)] + [(100 + i, 1, 9, after(seconds=i)) for i in range(1, 40)])
    buys = transactions(spark, [(1000 + i, 1, None, after(seconds=i)) for i in range(50)])
    expected = {1000 + i: 59 if i == 0 else 100 + min(i, 39) for i in range(50)}
    assert credit(at.last_touch(clicks, buys, segment_rows=5)) == expected


def test_last_touch_plan_forms_no_pairs(spark):
    e = events(spark, [(1, 1, 9, T0)])
    t = transactions(spark, [(10, 1, None, after(hours=1))])
    plan = at.last_touch(e, t)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan


CAMPAIGNS = "campaign_id long, campaign_name string, brand string, country_code string, objective string, budget_usd decimal(18,2), actual_spend_usd decimal(18,2)"


def test_campaign_marts_on_empty_denominators(spark):
    from decimal import Decimal

    campaigns = spark.createDataFrame(
        [
            (1, "a", "x", "US", "o", Decimal(10), Decimal(5)),
            (2, "b", "x", "US", "o", Decimal(10), Decimal(0)),
            (3, "c", "x", "US", "o", Decimal(10), Decimal(5)),
        ],
        CAMPAIGNS,
    )
    rows = spark.createDataFrame(
        [
            (1, "impression", None, 1, Decimal("0.50"), T0),
            (2, "impression", None, 1, Decimal("0.25"), T0),
            (3, "click", 7, 2, Decimal(0), T0),
        ],
        EVENTS,
    )
    got = {r["campaign_id"]: r for r in marts.campaign_performance(campaigns, rows).collect()}
    assert (got[1]["impressions"], got[1]["reach"], got[1]["frequency"]) == (2, 0, None)
    assert (got[1]["cpm"], got[1]["ctr"], got[1]["cpc"]) == (375.0, 0.0, None)
    assert (got[2]["clicks"], got[2]["ctr"], got[2]["cpc"]) == (1, None, 0.0)
    assert (got[3]["impressions"], got[3]["clicks"], got[3]["cpm"]) == (0, 0, None)

    buys = spark.createDataFrame([(10, 4, 7, None, "US", Decimal("9.00"), after(hours=1))], TXNS)
    roas = {r["campaign_id"]: r for r in marts.campaign_roas(campaigns, rows, buys).collect()}
    assert (roas[2]["conversions"], roas[2]["cvr"], roas[2]["roas"]) == (1, 100.0, None)
    assert (roas[1]["conversions"], roas[1]["attributed_revenue_usd"], roas[1]["cpa"]) == (0, None, None)
    assert roas[2]["unique_customers"] == 1


def test_ltv_splits_by_country(spark):
    rows = spark.createDataFrame(
        [(1, "US", 1.0, dt.datetime(2024, 1, 1, 23, tzinfo=dt.timezone.utc)),
         (1, "US", 2.0, dt.datetime(2024, 1, 2, 1, tzinfo=dt.timezone.utc)),
         (1, "UK", 4.0, T0)],
        "pan_token long, country_code string, amount_usd double, txn_ts timestamp",
    )
    by_country = marts.customer_ltv(rows).collect()
    assert {r["country_code"]: r["customer_tenure_days"] for r in by_country} == {"US": 0, "UK": 0}
    whole = marts.customer_ltv(rows, ("pan_token",)).collect()
    assert [(r["transaction_count"], r["lifetime_value_usd"]) for r in whole] == [(3, 7.0)]


def test_audience_discovery_drops_unknown_channel(spark):
    rows = spark.createDataFrame(
        [("s1", "US", "18-24", "High", {"meta": 1.5}, {"b": 0.5}),
         ("s2", "US", "18-24", "High", {"tv": 1.5}, {"b": 0.5}),
         ("s3", "US", "18-24", "High", {"meta": 1.0}, {"b": 0.5})],
        "segment_name string, country_code string, age_band string, income_band string,"
        " channel_index map<string,double>, brand_affinity_scores map<string,double>",
    )
    found = marts.audience_discovery(rows, market="US", income_band="High", channel="meta").collect()
    assert [r["segment_name"] for r in found] == ["s1"]


def test_orphan_keys(spark):
    child = spark.createDataFrame([(1,), (2,), (2,), (None,)], "k long")
    parent = spark.createDataFrame([(1,)], "id long")
    assert [tuple(r) for r in at.orphan_keys(child, parent, "k", "id").collect()] == [(2, 2)]
