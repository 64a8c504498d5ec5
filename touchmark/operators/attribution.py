"""Touch attribution.

The rule is "the latest click before the purchase, at most N days old". Joining every click of a
cookie with every purchase of it would produce clicks x purchases rows, so a busy cookie would
blow up. Instead clicks and purchases are merged on one time line per cookie and read in order.
The time line is cut into buckets of fixed length, crowded ones into segments by measured density,
and what is known at the start of each segment comes from a small summary of those before it, so that no
task ever holds all rows of one cookie, nor all of one busy hour.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKET_SECONDS = 6 * 3600
#: Rows of a key's bucket from which it is cut, and the most cuts of all keys: with more rows, segments grow.
SEGMENT_ROWS = 500_000
MAX_CUTS = 10_000


def _bucket(ts: Column, seconds: int) -> Column:
    return F.floor(F.unix_seconds(ts) / seconds).cast("bigint")


def _cuts(parts: list[DataFrame], segment_rows: int) -> DataFrame | None:
    """(_key, _bucket, _cuts): times in microseconds that cut the crowded buckets; None where there are none.

    ``parts`` have (_key, _bucket, _at). Buckets are counted, and those of too many rows cut at approximate
    quantiles of their times, one for each ``segment_rows``. Equal times stay together.
    """
    rows = reduce(DataFrame.unionByName, [p.select("_key", "_bucket", "_at") for p in parts])
    total = rows.count()
    if total <= segment_rows:
        return None
    limit = max(segment_rows, total // MAX_CUTS)
    crowded = rows.groupBy("_key", "_bucket").agg(F.count("*").alias("_n")).filter(F.col("_n") > limit)
    # No more than total / limit rows, so at most MAX_CUTS.
    crowded = rows.sparkSession.createDataFrame(crowded.toPandas(), crowded.schema)
    most = crowded.agg(F.max("_n")).first()[0]
    if most is None:
        return None
    steps = -(-most // limit)
    at = F.percentile_approx(F.unix_micros("_at"), [i / steps for i in range(1, steps)], 10 * steps)
    quantiles = rows.join(F.broadcast(crowded), ["_key", "_bucket"]).groupBy("_key", "_bucket", "_n").agg(at.alias("_at"))
    # Of these, as many as the bucket has segments.
    wanted = F.ceil(F.col("_n") / limit)
    place = lambda i: F.least(F.floor(i * steps / wanted), F.lit(steps - 1)).cast("int") - 1
    chosen = F.transform(F.sequence(F.lit(1), wanted - 1), lambda i: F.get("_at", F.greatest(place(i), F.lit(0))))
    cuts = quantiles.select("_key", "_bucket", F.array_distinct(chosen).alias("_cuts"))
    return rows.sparkSession.createDataFrame(cuts.collect(), cuts.schema)


def _with_segment(rows: DataFrame, cuts: DataFrame | None) -> DataFrame:
    """Adds ``_sub``, the segment of the bucket that ``_at`` lies in."""
    if cuts is None:
        return rows.withColumn("_sub", F.lit(0))
    held = rows.join(F.broadcast(cuts), ["_key", "_bucket"], "left")
    below = F.size(F.filter("_cuts", lambda c: c < F.unix_micros("_at")))
    return held.withColumn("_sub", F.when(F.col("_cuts").isNull(), 0).otherwise(below)).drop("_cuts")


def _days(n: int) -> Column:
    return F.make_dt_interval(days=F.lit(n))


def latest_touches(
    probes: DataFrame,
    touches: DataFrame,
    *,
    key: str = "cookie_id",
    probe_ts: str = "txn_ts",
    touch_ts: str = "event_ts",
    touch_id: str = "event_id",
    touch_columns: tuple[str, ...] = ("campaign_id",),
    within_days: int = 30,
    k: int = 1,
    bucket_seconds: int = BUCKET_SECONDS,
    segment_rows: int = SEGMENT_ROWS,
) -> DataFrame:
    """The ``k`` latest touches at or before each probe with the same key, newest first (``rn``).

    Equal times are ordered by ``touch_id``, the larger one counting as later. Probes without a
    touch in the window give no row; NULL keys never match. Touches are matched in three steps:
    the ``k`` latest touches of each (key, segment); for each segment holding probes, the ``k``
    latest of all earlier segments; one ordered pass inside each (key, segment).
    """
    payload = [F.col(touch_ts).alias("ts"), F.col(touch_id).alias("id")]
    payload += [F.col(c) for c in touch_columns]
    points = touches.filter(F.col(key).isNotNull()).select(
        F.col(key).alias("_key"),
        _bucket(F.col(touch_ts), bucket_seconds).alias("_bucket"),
        F.col(touch_ts).alias("_at"),
        F.struct(*payload).alias("_touch"),
    )
    asked = probes.filter(F.col(key).isNotNull()).select(
        F.col(key).alias("_key"),
        _bucket(F.col(probe_ts), bucket_seconds).alias("_bucket"),
        F.col(probe_ts).alias("_at"),
        F.struct(*probes.columns).alias("_probe"),
    )
    cuts = _cuts([points, asked], segment_rows)
    points, asked = _with_segment(points, cuts).drop("_at"), _with_segment(asked, cuts).drop("_at")

    segment = ("_key", "_bucket", "_sub")
    if k == 1:
        tails = points.groupBy(*segment).agg(F.max("_touch").alias("_touch"))
    else:
        newest = Window.partitionBy(*segment).orderBy(F.col("_touch").desc())
        tails = points.withColumn("_n", F.row_number().over(newest)).filter(F.col("_n") <= k)
        tails = tails.drop("_n")
    no_touch = F.lit(None).cast(points.schema["_touch"].dataType)
    marks = asked.select(*segment).distinct().withColumn("_touch", no_touch)
    order = "PARTITION BY _key ORDER BY _bucket, _sub, _touch ASC NULLS FIRST"
    carried = tails.unionByName(marks).select(
        *segment,
        "_touch",
        F.array(
            *[F.expr(f"lag(_touch, {i + 1}) IGNORE NULLS OVER ({order})") for i in range(k)]
        ).alias("_earlier"),
    )
    carried = carried.filter(F.col("_touch").isNull()).select(
        *segment, F.explode(F.filter("_earlier", lambda t: t.isNotNull())).alias("_touch")
    )
    bucket_start = F.timestamp_seconds(F.col("_bucket") * bucket_seconds)
    carried = carried.filter(F.col("_touch.ts") + _days(within_days) >= bucket_start)

    no_probe = F.lit(None).cast(asked.schema["_probe"].dataType)
    line = (
        points.unionByName(carried)
        .select("*", no_probe.alias("_probe"), F.col("_touch.ts").alias("_at"))
        .unionByName(
            asked.select(
                *segment, no_touch.alias("_touch"), "_probe",
                F.col(f"_probe.{probe_ts}").alias("_at"),
            )
        )
    )
    in_order = "PARTITION BY _key, _bucket, _sub ORDER BY _at, _touch ASC NULLS LAST"
    seen = line.select(
        "_probe",
        F.array(
            *[F.expr(f"lag(_touch, {i + 1}) IGNORE NULLS OVER ({in_order})") for i in range(k)]
        ).alias("_seen"),
    ).filter(F.col("_probe").isNotNull())
    ranked = seen.select("_probe", F.posexplode("_seen").alias("_pos", "_touch")).filter(
        F.col("_touch.ts") + _days(within_days) >= F.col(f"_probe.{probe_ts}")
    )
    return ranked.select(
        "_probe.*",
        F.col("_touch.id").alias(touch_id),
        F.col("_touch.ts").alias(touch_ts),
        *[F.col(f"_touch.{c}").alias(c) for c in touch_columns],
        (F.col("_pos") + 1).cast("int").alias("rn"),
    )


def touch_counts(
    probes: DataFrame,
    touches: DataFrame,
    *,
    key: str = "cookie_id",
    probe_id: str = "txn_id",
    probe_ts: str = "txn_ts",
    touch_ts: str = "event_ts",
    within_days: int = 30,
    bucket_seconds: int = BUCKET_SECONDS,
    segment_rows: int = SEGMENT_ROWS,
    name: str = "touch_count",
) -> DataFrame:
    """How many touches lie in each probe's window, both ends included; zero counts are left out.

    A count over a window is the difference of two running counts, one read at the probe and one
    just before the window opens, so no (touch, probe) pair is ever formed.
    """
    # At equal times: window opens (0), touches (1), probe itself (2).
    points = touches.filter(F.col(key).isNotNull()).select(
        F.col(key).alias("_key"), F.col(touch_ts).alias("_at"), F.lit(1).alias("_kind"),
        F.lit(1).cast("bigint").alias("_weight"), F.lit(None).cast("int").alias("_sign"),
        *[F.lit(None).cast(probes.schema[c].dataType).alias(c) for c in probes.columns],
    )
    asked = probes.filter(F.col(key).isNotNull())
    reads = reduce(
        DataFrame.unionByName,
        [
            asked.select(
                F.col(key).alias("_key"), at.alias("_at"), F.lit(kind).alias("_kind"),
                F.lit(0).cast("bigint").alias("_weight"), F.lit(sign).alias("_sign"), *probes.columns,
            )
            for at, kind, sign in (
                (F.col(probe_ts), 2, 1),
                (F.col(probe_ts) - _days(within_days), 0, -1),
            )
        ],
    )
    line = points.unionByName(reads).withColumn("_bucket", _bucket(F.col("_at"), bucket_seconds))
    line, segment = _with_segment(line, _cuts([line], segment_rows)), ("_key", "_bucket", "_sub")
    per_segment = line.groupBy(*segment).agg(F.sum("_weight").alias("_weight"))
    before = Window.partitionBy("_key").orderBy("_bucket", "_sub").rowsBetween(
        Window.unboundedPreceding, -1
    )
    # A segment opens with the count of all before it: without a time, it comes first.
    opening = per_segment.select(
        "_key", F.lit(None).cast(line.schema["_at"].dataType).alias("_at"), F.lit(-1).alias("_kind"),
        F.coalesce(F.sum("_weight").over(before), F.lit(0)).alias("_weight"), F.lit(None).cast("int").alias("_sign"),
        *[F.lit(None).cast(probes.schema[c].dataType).alias(c) for c in probes.columns],
        "_bucket", "_sub",
    )
    running = Window.partitionBy(*segment).orderBy("_at", "_kind").rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    read = line.unionByName(opening).withColumn("_total", F.sum("_weight").over(running))
    counted = (
        read.filter(F.col("_sign").isNotNull())
        .groupBy(*probes.columns)
        .agg(F.sum(F.col("_total") * F.col("_sign")).alias(name))
    )
    return counted.filter(F.col(name) > 0)


def with_join_key(events: DataFrame, key: str = "cookie_id") -> DataFrame:
    return events.filter(F.col(key).isNotNull())


def clicks_of(pixel_events: DataFrame, event_type: str = "click") -> DataFrame:
    return pixel_events.filter(F.col("event_type") == event_type)


def last_touch(
    pixel_events: DataFrame,
    transactions: DataFrame,
    *,
    window_days: int = 30,
    event_type: str = "click",
    bucket_seconds: int = BUCKET_SECONDS,
    segment_rows: int = SEGMENT_ROWS,
) -> DataFrame:
    """The credited click of every attributable transaction, matched by cookie."""
    return latest_touches(
        transactions.select("txn_id", "pan_token", "country_code", "amount_usd", "cookie_id", "txn_ts"),
        clicks_of(pixel_events, event_type),
        within_days=window_days,
        bucket_seconds=bucket_seconds,
        segment_rows=segment_rows,
    ).drop("rn")


def ranked_touches(
    pixel_events: DataFrame, transactions: DataFrame, *, k: int, window_days: int = 30
) -> DataFrame:
    """The ``k`` latest clicks of every transaction with their rank."""
    return latest_touches(
        transactions.select("txn_id", "cookie_id", "txn_ts"),
        clicks_of(pixel_events),
        within_days=window_days,
        k=k,
    )


def attribution_candidates(
    pixel_events: DataFrame, transactions: DataFrame, *, window_days: int = 30
) -> DataFrame:
    """Size of each transaction's candidate set; the sets themselves are never spelled out."""
    return touch_counts(
        transactions.select("txn_id", "cookie_id", "txn_ts"),
        clicks_of(pixel_events),
        within_days=window_days,
    )


def attribute_with_fallback(
    pixel_events: DataFrame,
    transactions: DataFrame,
    cookie_registry: DataFrame,
    *,
    window_days: int = 30,
    bucket_seconds: int = BUCKET_SECONDS,
) -> DataFrame:
    """Last touch by cookie; where that finds none, by hashed email through the registry.

    Both routes run in one pass over keys tagged with their route.
    """
    columns = ("txn_id", "pan_token", "country_code", "amount_usd", "txn_ts")

    def tagged(tag: str, column: str) -> Column:
        return F.concat(F.lit(f"{tag}:"), F.col(column).cast("string"))

    routes = F.array(
        F.struct(F.lit(1).alias("priority"), tagged("cookie", "cookie_id").alias("key")),
        F.struct(F.lit(2).alias("priority"), tagged("hem", "hem").alias("key")),
    )
    probes = transactions.select(*columns, F.inline(routes))
    clicks = clicks_of(pixel_events).filter(F.col("cookie_id").isNotNull())
    hems = cookie_registry.filter(F.col("hem").isNotNull()).select("cookie_id", "hem")
    by_cookie = clicks.select(
        tagged("cookie", "cookie_id").alias("key"), "event_id", "event_ts", "campaign_id"
    )
    by_hem = clicks.join(hems, "cookie_id").select(
        tagged("hem", "hem").alias("key"), "event_id", "event_ts", "campaign_id"
    )
    found = latest_touches(
        probes,
        by_cookie.unionByName(by_hem),
        key="key",
        within_days=window_days,
        bucket_seconds=bucket_seconds,
    )
    credit = F.struct("priority", *columns, "event_id", "event_ts", "campaign_id")
    return (
        found.groupBy("txn_id")
        .agg(F.min_by(credit, "priority").alias("credit"))
        .select("credit.*")
        .withColumn(
            "matched_via", F.when(F.col("priority") == 1, "cookie").otherwise("hem")
        )
        .drop("priority")
    )


def left_join_spread(
    left: DataFrame, right: DataFrame, left_key: str, right_key: str, spread_by: str
) -> DataFrame:
    """Left join where many left keys are NULL.

    NULL keys would all hash to one partition; they get a random-like second key from
    ``spread_by``, which no right row carries, so they scatter and stay unmatched.
    """
    salt = F.when(F.col(left_key).isNull(), F.pmod(F.xxhash64(spread_by), F.lit(4096)) + 1)
    l = left.withColumn("_salt", F.coalesce(salt, F.lit(0)))
    r = right.filter(F.col(right_key).isNotNull()).withColumn("_rsalt", F.lit(0).cast("bigint"))
    r = r.withColumnRenamed(right_key, "_rkey")
    on = (F.col(left_key) == F.col("_rkey")) & (F.col("_salt") == F.col("_rsalt"))
    return l.join(r, on, "left").drop("_salt", "_rsalt", "_rkey")


def left_join_hot(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Left join of a table with unique keys to a far larger one in which a key may be hot.

    Spark can neither broadcast the left side of a left join nor split a hot key on its right, but
    does both for an inner join. Unmatched left rows are added from the distinct right keys.
    """
    matched = left.join(right, key)
    seen = right.select(key).distinct()
    unmatched = left.join(seen, key, "left_anti")
    return matched.unionByName(unmatched, allowMissingColumns=True)


def identity_resolve(
    rows: DataFrame, cookie_registry: DataFrame, *, row_id: str = "txn_id"
) -> DataFrame:
    """Audience of each row by its cookie, else by its hashed email, with the route taken.

    A hashed email shared by several cookies resolves to the smallest audience id.
    """
    by_cookie = cookie_registry.filter(F.col("audience_id").isNotNull()).select(
        "cookie_id", F.col("audience_id").alias("cookie_audience")
    )
    by_hem = (
        cookie_registry.filter(F.col("hem").isNotNull() & F.col("audience_id").isNotNull())
        .groupBy("hem")
        .agg(F.min("audience_id").alias("hem_audience"))
    )
    joined = left_join_spread(rows, by_cookie, "cookie_id", "cookie_id", row_id)
    joined = left_join_spread(joined, by_hem, "hem", "hem", row_id)
    return joined.select(
        *rows.columns,
        F.coalesce("cookie_audience", "hem_audience").alias("audience_id"),
        F.when(F.col("cookie_audience").isNotNull(), "cookie")
        .when(F.col("hem_audience").isNotNull(), "hem")
        .alias("resolved_via"),
    )


def orphan_keys(
    child: DataFrame, parent: DataFrame, child_key: str, parent_key: str
) -> DataFrame:
    """Child key values absent from the parent, with the number of child rows holding each."""
    counts = child.filter(F.col(child_key).isNotNull()).groupBy(child_key).agg(
        F.count("*").alias("child_rows")
    )
    parents = parent.select(F.col(parent_key).alias("_parent"))
    return counts.join(parents, F.col(child_key) == F.col("_parent"), "left_anti")
