"""Rule-based data quality.

All rules of a table are evaluated in one aggregate over one scan. A NULL fails the set, regex and
range rules unless ``ignore_null`` is set; an empty table breaks no rule.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from touchmark.functions.scalars import rule_name, safe_divide
from touchmark.operators.attribution import orphan_keys


@dataclass(frozen=True)
class Rule:
    column: str
    rule_type: str
    threshold: float = 1.0
    dimension: str = "COMPLETENESS"
    values: tuple[str, ...] = field(default=())
    pattern: str = ""
    min_value: str = ""
    max_value: str = ""
    strict_min_enabled: bool = False
    strict_max_enabled: bool = False

    @property
    def name(self) -> str:
        return f"{self.rule_type}-{self.column}".replace("_", "-")


def passes(df: DataFrame, rule: Rule, ignore_null: bool = False) -> Column:
    """Whether a row meets the rule; never NULL."""
    column = F.col(rule.column)
    if rule.rule_type == "non_null":
        return column.isNotNull()
    if rule.rule_type == "set":
        met = column.cast("string").isin(*rule.values)
    elif rule.rule_type == "regex":
        met = column.cast("string").rlike(rf"\A(?:{rule.pattern})\z")
    elif rule.rule_type == "range":
        met = _in_range(df, rule)
    else:
        raise ValueError(f"unknown rule type {rule.rule_type!r}")
    return F.coalesce(met, F.lit(ignore_null))


def _in_range(df: DataFrame, rule: Rule) -> Column:
    """Bounds are texts, cast to the type of the column; an empty one is open."""
    column = F.col(rule.column)
    data_type = df.schema[rule.column].dataType
    if isinstance(data_type, (T.IntegralType, T.DecimalType)):
        # The column's own type could round a bound, and with it the rule.
        data_type = T.DecimalType(38, 10)
    bound = lambda text: F.lit(text).cast(data_type)
    checks = [column.isNotNull()]
    if rule.min_value != "":
        low = bound(rule.min_value)
        checks.append(column > low if rule.strict_min_enabled else column >= low)
    if rule.max_value != "":
        high = bound(rule.max_value)
        checks.append(column < high if rule.strict_max_enabled else column <= high)
    # A NULL value must stay NULL here, for the caller to decide on.
    return F.when(column.isNotNull(), reduce(Column.__and__, checks))


def dq_scan(df: DataFrame, rules: list[Rule], *, ignore_null: bool = False) -> DataFrame:
    """One row per rule: evaluated and passed rows, their ratio, and whether it meets the threshold."""
    counts = df.agg(
        F.count("*").alias("evaluated"),
        *[F.count_if(passes(df, r, ignore_null)).alias(f"p{i}") for i, r in enumerate(rules)],
    )
    rows = [
        F.struct(
            F.lit(r.name).alias("rule"),
            F.lit(r.column).alias("column_name"),
            F.lit(r.dimension).alias("dimension"),
            F.lit(r.threshold).cast("double").alias("threshold"),
            F.col("evaluated"),
            F.col(f"p{i}").alias("passed"),
        )
        for i, r in enumerate(rules)
    ]
    ratio = safe_divide(F.col("passed"), F.col("evaluated"))
    return (
        counts.select(F.inline(F.array(*rows)))
        .withColumn("ratio", ratio)
        .withColumn("ok", F.coalesce(F.col("ratio") >= F.col("threshold"), F.lit(True)))
    )


def scan_tables(tables: dict[str, tuple[DataFrame, list[Rule]]]) -> DataFrame:
    """Scans of several tables as one result."""
    scans = [
        dq_scan(df, rules).select(F.lit(name).alias("table_name"), "*")
        for name, (df, rules) in tables.items()
    ]
    return reduce(DataFrame.unionByName, scans)


def dq_table_status(scan: DataFrame) -> DataFrame:
    """A table passes when all its rules do."""
    return scan.groupBy("table_name").agg(
        F.bool_and("ok").alias("passed"),
        F.count("*").alias("rules_evaluated"),
        F.count_if(~F.col("ok")).alias("rules_failed"),
    )


def dq_failing_rows(
    df: DataFrame, rules: list[Rule], *, name: str = "failed_rules", ignore_null: bool = False
) -> DataFrame:
    """Rows breaking at least one rule, with the names of the rules they break."""
    names = F.array_compact(
        F.array(*[F.when(~passes(df, r, ignore_null), F.lit(r.name)) for r in rules])
    )
    return df.withColumn(name, names).filter(F.size(name) > 0)


def dq_referential(
    child: DataFrame, parent: DataFrame, child_key: str, parent_key: str
) -> DataFrame:
    """Referential integrity reported like a rule; NULL child keys do not count."""
    keyed = child.filter(F.col(child_key).isNotNull())
    broken = orphan_keys(child, parent, child_key, parent_key)
    both = keyed.select(F.lit(1).alias("row"), F.lit(0).alias("orphan"))
    both = both.agg(F.sum("row").alias("evaluated"), F.sum("orphan").alias("orphans")).unionByName(
        broken.agg(F.lit(0).cast("bigint").alias("evaluated"), F.sum("child_rows").alias("orphans"))
    )
    totals = both.agg(
        F.coalesce(F.sum("evaluated"), F.lit(0)).alias("evaluated"),
        F.coalesce(F.sum("orphans"), F.lit(0)).alias("orphans"),
    )
    return totals.select(
        F.lit(f"referential-{child_key}".replace("_", "-")).alias("rule"),
        "evaluated",
        (F.col("evaluated") - F.col("orphans")).alias("passed"),
        (F.col("orphans") == 0).alias("ok"),
    )


RULE_KEY = ("table", "rule", "column")


def _comparable(rules: DataFrame) -> DataFrame:
    """Rules keyed by table and ``name:column`` (the last duplicate wins), with what is compared.

    Only the settings of a rule's own type count, and allowed values count in any order.
    """
    kind = F.col("rule_type")
    is_range = kind == "range"
    spec = F.struct(
        "dimension",
        "threshold",
        F.when(kind == "set", F.sort_array("values")).alias("values"),
        F.when(kind == "regex", F.col("pattern")).alias("pattern"),
        *[
            F.when(is_range, F.col(c)).alias(c)
            for c in ("min_value", "max_value", "strict_min_enabled", "strict_max_enabled")
        ],
    )
    named = rules.withColumn("rule", rule_name(kind, F.col("column"))).withColumn("spec", spec)
    return named.groupBy(*RULE_KEY).agg(F.max_by("spec", "position").alias("spec"))


def dq_rule_diff(declared: DataFrame, active: DataFrame) -> DataFrame:
    """Per rule of either set: ``add``, ``remove``, ``changed`` or ``same``."""
    want = _comparable(declared).withColumnRenamed("spec", "want").withColumn("wanted", F.lit(True))
    have = _comparable(active).withColumnRenamed("spec", "have").withColumn("held", F.lit(True))
    change = (
        F.when(F.col("held").isNull(), "add")
        .when(F.col("wanted").isNull(), "remove")
        .when(F.col("want").eqNullSafe(F.col("have")), "same")
        .otherwise("changed")
    )
    return want.join(have, list(RULE_KEY), "full_outer").select(*RULE_KEY, change.alias("change"))


def dq_in_sync(diff: DataFrame) -> DataFrame:
    """Per table: how many rules to add, remove and change, and whether none is left."""
    counted = diff.groupBy("table").agg(
        F.count_if(F.col("change") != "remove").alias("declared_count"),
        F.count_if(F.col("change") != "add").alias("active_count"),
        F.count_if(F.col("change") == "add").alias("to_add"),
        F.count_if(F.col("change") == "remove").alias("to_remove"),
        F.count_if(F.col("change") == "changed").alias("changed"),
    )
    left = F.col("to_add") + F.col("to_remove") + F.col("changed")
    return counted.withColumn("in_sync", left == 0)
