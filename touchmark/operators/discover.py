"""Key and relationship discovery from the data itself.

Everything starts from one aggregate: the rows of every distinct value of every column. Inclusions
are then found per value, not per pair of columns: each value yields the set of columns holding it
(at most as many as there are columns), equal sets are counted, and only the counted sets are
taken apart into pairs.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from touchmark.functions.scalars import safe_divide
from touchmark.operators.profile import value_key


def type_class(data_type: T.DataType) -> str | None:
    """Columns are compared within a class; floating and nested columns are never keys."""
    if isinstance(data_type, T.IntegralType):
        return "integer"
    if isinstance(data_type, T.StringType):
        return "string"
    if isinstance(data_type, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return "time"
    return None


def key_columns(df: DataFrame) -> list[tuple[str, str]]:
    classes = [(f.name, type_class(f.dataType)) for f in df.schema.fields]
    return [(name, cls) for name, cls in classes if cls]


def _all_columns(tables: dict[str, DataFrame]) -> list[tuple[str, str, str]]:
    """(table, column, class) of every possible key column; its place in the list is its id."""
    return [(t, c, cls) for t, df in tables.items() for c, cls in key_columns(df)]


def _name(columns: list[tuple[str, str, str]], part: int, column_id: str) -> Column:
    """Name of a column id, looked up in one constant list as long as the schemas."""
    names = F.split(F.lit("\x01".join(c[part] for c in columns)), "\x01")
    return F.get(names, F.col(column_id))


def _number(column: str, cls: str) -> Column:
    """Whole numbers as they are, times as microseconds."""
    if cls == "time":
        return F.unix_micros(F.col(column).cast("timestamp"))
    return F.col(column).cast("bigint")


def value_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """Rows per distinct value, NULL included, of all possible key columns.

    A value is held as a number or as a text, whichever its class calls for, next to its column id.
    """
    columns, parts = _all_columns(tables), []
    for table, df in tables.items():
        cells = [
            F.struct(
                F.lit(i).alias("column_id"), F.lit(cls).alias("type_class"),
                (F.lit(None).cast("bigint") if cls == "string" else _number(c, cls)).alias("number"),
                (value_key(df, c) if cls == "string" else F.lit(None).cast("string")).alias("text"),
            )
            for i, (t, c, cls) in enumerate(columns) if t == table
        ]
        if cells:  # all columns of a table from one scan
            parts.append(df.select(F.inline(F.array(*cells))))
    return (
        reduce(DataFrame.unionByName, parts)
        .groupBy("column_id", "type_class", "number", "text")
        .agg(F.count("*").alias("n"))
    )


def _has_value() -> Column:
    return F.col("number").isNotNull() | F.col("text").isNotNull()


def column_stats(counts: DataFrame) -> DataFrame:
    nulls = F.sum(F.when(~_has_value(), F.col("n")))
    return counts.groupBy("column_id").agg(
        F.sum("n").alias("row_count"),
        F.coalesce(nulls, F.lit(0)).alias("null_count"),
        F.count_if(_has_value()).alias("distinct_count"),
    )


def _is_key() -> Column:
    return (F.col("null_count") == 0) & (F.col("distinct_count") == F.col("row_count"))


def primary_keys(tables: dict[str, DataFrame]) -> DataFrame:
    """Columns that are unique and never NULL."""
    columns = _all_columns(tables)
    stats = column_stats(value_counts(tables))
    return stats.filter(_is_key()).select(
        _name(columns, 0, "column_id").alias("table_name"),
        _name(columns, 1, "column_id").alias("column_name"),
        "row_count",
    )


def _overlaps(counts: DataFrame) -> DataFrame:
    """Shared distinct values of every two columns, ``child`` and ``parent``.

    The pair of a column with itself carries the column's own counts. One chain of aggregates, so
    the tables are read once and the values shuffled twice; the result has a row per two columns.
    """
    has_value = _has_value()
    by_value = counts.groupBy("type_class", "number", "text").agg(
        F.collect_list(F.struct("column_id", "n")).alias("cells")
    )
    sets = (
        by_value.select(
            F.sort_array(F.col("cells.column_id")).alias("holders"),
            has_value.alias("has_value"),
            F.inline("cells"),
        )
        .groupBy("holders", "has_value", F.col("column_id").alias("child"))
        .agg(F.count("*").alias("shared"), F.sum("n").alias("n"))
    )
    own = F.col("child") == F.col("parent")
    total = lambda condition, c: F.coalesce(F.sum(F.when(condition, F.col(c))), F.lit(0))
    return (
        sets.select("has_value", "child", "shared", "n", F.explode("holders").alias("parent"))
        .groupBy("child", "parent")
        .agg(
            total(F.col("has_value"), "shared").alias("shared"),
            total(own, "n").alias("row_count"),
            total(own & ~F.col("has_value"), "n").alias("null_count"),
        )
    )


def foreign_keys(tables: dict[str, DataFrame], *, min_coverage: float = 1.0) -> DataFrame:
    """Columns whose values occur in a key column of another table, with the covered share.

    ``coverage`` is over the child's distinct non-NULL values, ``fill_rate`` over its rows.
    """
    columns = _all_columns(tables)
    own = F.col("child") == F.col("parent")
    # A row per two columns: the windows below see no more than the schemas hold.
    of = lambda side, c: F.max(F.when(own, F.col(c))).over(Window.partitionBy(side))

    def is_key(side: str) -> Column:
        return (of(side, "null_count") == 0) & (of(side, "shared") == of(side, "row_count"))

    rows = of("child", "row_count")
    return (
        _overlaps(value_counts(tables))
        .select(
            "child", "parent",
            safe_divide(F.col("shared"), of("child", "shared")).alias("coverage"),
            safe_divide(rows - of("child", "null_count"), rows).alias("fill_rate"),
            is_key("child").alias("child_unique"),
            is_key("parent").alias("parent_unique"),
        )
        .select(
            _name(columns, 0, "child").alias("child_table"),
            _name(columns, 1, "child").alias("child_column"),
            _name(columns, 0, "parent").alias("parent_table"),
            _name(columns, 1, "parent").alias("parent_column"),
            "coverage", "fill_rate", "child_unique", "parent_unique",
        )
        .filter(
            F.col("parent_unique")
            & (F.col("child_table") != F.col("parent_table"))
            & (F.col("coverage") >= min_coverage)
        )
        .drop("parent_unique")
    )


def relationship_graph(foreign: DataFrame) -> DataFrame:
    """One edge per pair of tables: how many column pairs join them, cardinality, best fill rate."""
    return foreign.groupBy("parent_table", "child_table").agg(
        F.count("*").alias("column_pairs"),
        F.when(F.bool_or("child_unique"), "one-to-one").otherwise("one-to-many").alias("cardinality"),
        F.max("fill_rate").alias("fill_rate"),
    )


def dataset_overview(tables: dict[str, DataFrame]) -> DataFrame:
    """Tables, rows, columns and joinable column pairs as (measure, value) rows."""
    columns = _all_columns(tables)
    pairs = _overlaps(value_counts(tables))
    # The counts of a table's first possible key column are the table's; a table without one is counted by itself.
    first = {t: i for i, (t, _, _) in reversed(list(enumerate(columns)))}
    own = (F.col("child") == F.col("parent")) & F.col("child").isin(list(first.values()))
    found = pairs.agg(
        F.coalesce(F.sum(F.when(own, F.col("row_count"))), F.lit(0)).alias("rows"), _joinable(columns).alias("pairs")
    )
    bare = [df.agg(F.count("*").alias("n")) for t, df in tables.items() if t not in first]
    for part in bare:
        found = found.crossJoin(F.broadcast(part)).withColumn("rows", F.col("rows") + F.col("n")).drop("n")  # one row each
    fixed = lambda name, value: F.struct(F.lit(name).alias("measure"), value.cast("bigint").alias("value"))
    return found.select(
        F.inline(
            F.array(
                fixed("tables", F.lit(len(tables))),
                fixed("columns", F.lit(sum(len(df.columns) for df in tables.values()))),
                fixed("rows", F.col("rows")), fixed("joinable_pairs", F.col("pairs")),
            )
        )
    )


def _joinable(columns: list[tuple[str, str, str]]) -> Column:
    """How many pairs of columns join fully, from all (child, parent) overlaps at once: no more rows than column pairs."""
    cell = F.struct("child", "parent", "shared", "row_count", "null_count")
    table = F.array(*[F.lit(t) for t, _, _ in columns])

    def count(cells: Column) -> Column:
        own = F.map_from_entries(F.transform(F.filter(cells, lambda x: x["child"] == x["parent"]), lambda x: F.struct(x["child"], x)))
        is_key = lambda x: (x["null_count"] == 0) & (x["shared"] == x["row_count"])
        joins = lambda x: (
            is_key(own[x["parent"]]) & (F.get(table, x["child"]) != F.get(table, x["parent"]))
            & (x["shared"] > 0) & (x["shared"] == own[x["child"]]["shared"])
        )
        return F.size(F.filter(cells, joins))

    return count(F.collect_list(cell))


def synonym_columns_check(df: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """Rows in which two columns declared to be equal differ."""
    differ = [
        F.count_if(~F.col(a).eqNullSafe(F.col(b))).alias(f"m{i}") for i, (a, b) in enumerate(pairs)
    ]
    rows = [
        F.struct(
            F.lit(a).alias("column_name"), F.lit(b).alias("synonym_of"),
            F.col(f"m{i}").alias("mismatches"),
        )
        for i, (a, b) in enumerate(pairs)
    ]
    return df.agg(*differ).select(F.inline(F.array(*rows)))


def synonym_columns_discover(df: DataFrame) -> DataFrame:
    """Pairs of columns of one type that are equal in every row and not NULL throughout."""
    names = [(f.name, f.dataType) for f in df.schema.fields if not isinstance(f.dataType, T.MapType)]
    pairs = [
        (a, b)
        for i, (a, type_a) in enumerate(names)
        for b, type_b in names[i + 1 :]
        if type_a == type_b
    ]
    if not pairs:
        return df.sparkSession.createDataFrame([], "column_a string, column_b string")
    same = [
        (F.bool_and(F.col(a).eqNullSafe(F.col(b))) & (F.count(a) > 0)).alias(f"s{i}")
        for i, (a, b) in enumerate(pairs)
    ]
    rows = [
        F.struct(
            F.lit(a).alias("column_a"), F.lit(b).alias("column_b"), F.col(f"s{i}").alias("same")
        )
        for i, (a, b) in enumerate(pairs)
    ]
    found = df.agg(*same).select(F.inline(F.array(*rows)))
    return found.filter("same").drop("same")
