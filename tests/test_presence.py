"""References of several tables checked in one shuffle."""

from touchmark.operators import presence
from touchmark.operators.presence import Reference


def tables(spark):
    return {
        "people": spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "id long, code string"),
        "orders": spark.createDataFrame([(10, 1, "a"), (11, 1, None), (12, 9, "z"), (13, None, "z")], "id long, person long, code string"),
        "notes": spark.createDataFrame([], "id long, person long"),
        "unused": spark.createDataFrame([(1,)], "id long"),
    }


REFERENCES = [
    Reference("order-person", "orders", "person", "people", "id"),
    Reference("order-code", "orders", "code", "people", "code"),
    Reference("note-person", "notes", "person", "people", "id"),
    Reference("person-self", "people", "id", "people", "id"),
]


def test_orphans_and_coverage(spark):
    t = tables(spark)
    assert {tuple(r) for r in presence.orphans(t, REFERENCES).collect()} == {("order-person", "9", 1), ("order-code", "z", 2)}
    found = {r["reference"]: tuple(r)[1:] for r in presence.coverage(t, REFERENCES).collect()}
    assert found == {
        "order-person": (3, 2, 2, 1, 2, 2 / 3, False),
        "order-code": (3, 1, 2, 1, 1, 1 / 3, False),
        "note-person": (0, 0, 0, 0, 3, None, True),
        "person-self": (3, 3, 3, 0, 0, 1.0, True),
    }


def test_one_scan_a_table_and_one_shuffle(spark, data):
    from touchmark.plans.measures import REFERENCES as declared
    from touchmark.sources import star

    plan = presence.orphans(star.tables(spark, data), declared)._jdf.queryExecution()
    spark_plan = plan.sparkPlan().toString()
    assert len(declared) == 8 and spark_plan.count("Union") == 1
    # Two aggregates, before and after the one shuffle of key values.
    assert plan.optimizedPlan().toString().count("Aggregate [reference_id") == 1
    assert plan.optimizedPlan().toString().count("Generate inline") == 6  # one per table
