"""Declared references of all tables checked at once, by a bit per side for every key value."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from touchmark.functions.scalars import safe_divide
from touchmark.operators.graph import Edge


@dataclass(frozen=True)
class Reference:
    """``child.child_key`` points at ``parent.parent_key``."""

    name: str
    child: str
    child_key: str
    parent: str
    parent_key: str


def declared(edges: Iterable[Edge]) -> list[Reference]:
    """The reference by which each edge finds its source node."""
    return [Reference(e.label, e.table, e.source_column, e.source, e.source_reference) for e in edges]


def presence(tables: dict[str, DataFrame], references: list[Reference]) -> DataFrame:
    """(reference, key, child_rows, in_parent) for every value on either side of every reference.

    A table is read once, whatever number of references it takes part in; a row yields its key
    values, as text, with the side they stand on. Equal values are folded in each task, so that one shuffle of
    (reference, value) with a count and a bit does it all, and a hot key is one row per task. NULL keys refer to nothing.
    """
    parts = []
    for name, df in tables.items():
        cells: list[Column] = []
        for i, r in enumerate(references):
            for table, key, child in ((r.child, r.child_key, True), (r.parent, r.parent_key, False)):
                if table == name:
                    cells.append(
                        F.struct(
                            F.lit(i).alias("reference_id"), F.col(key).cast("string").alias("key"),
                            F.lit(int(child)).cast("bigint").alias("child"), F.lit(not child).alias("parent"),
                        )
                    )
        if cells:
            parts.append(df.select(F.inline(F.array(*cells))))
    rows = reduce(DataFrame.unionByName, parts).filter("key IS NOT NULL")
    bits = rows.groupBy("reference_id", "key").agg(F.sum("child").alias("child_rows"), F.max("parent").alias("in_parent"))
    names = F.array(*[F.lit(r.name) for r in references])
    return bits.select(F.get(names, F.col("reference_id")).alias("reference"), "key", "child_rows", "in_parent")


def orphans(tables: dict[str, DataFrame], references: list[Reference]) -> DataFrame:
    """(reference, key, child_rows): key values of children that their parent does not have."""
    return presence(tables, references).filter("child_rows > 0 AND NOT in_parent").drop("in_parent")


def coverage(tables: dict[str, DataFrame], references: list[Reference]) -> DataFrame:
    """Per reference: child rows with a key, how many of them find it, distinct keys, orphaned keys, unused parent keys.

    A reference without any value on either side has no row.
    """
    bits = presence(tables, references)
    held = F.col("child_rows") > 0
    return bits.groupBy("reference").agg(
        F.sum("child_rows").alias("evaluated"),
        F.coalesce(F.sum(F.when(F.col("in_parent"), F.col("child_rows"))), F.lit(0)).alias("passed"),
        F.count_if(held).alias("child_keys"),
        F.count_if(held & ~F.col("in_parent")).alias("orphan_keys"),
        F.count_if(~held).alias("unused_parent_keys"),
    ).withColumns(
        {
            "ratio": safe_divide(F.col("passed"), F.col("evaluated")),
            "ok": F.col("orphan_keys") == 0,
        }
    )
