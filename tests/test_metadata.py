import json

import pytest

from touchmark.operators import quality as dq
from touchmark.sources import metadata as md

DOCUMENTS = {
    "audience.json": {
        "table_id": "audience", "description": " People. ", "tags": {"row_count_approx": "8000"},
        "columns": [
            {"name": "lat", "description": "Latitude"}, {"name": "location_lat", "synonym_of": "lat"},
            {"description": "nameless"},
        ],
        "data_quality_rules": [
            {"column": "lat", "rule_type": "range", "min": -90, "max": 90, "strict_max": True},
            {"column": "lat", "rule_type": "non_null", "threshold": 0.5},
            {"column": "kind", "rule_type": "set", "values": [" a", "b "]},
            {"column": "lat"},
        ],
    },
    "glossary.json": {"glossary_id": "g", "categories": []},
}


@pytest.fixture(scope="module")
def metadata(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("metadata")
    for name, document in DOCUMENTS.items():
        (folder / name).write_text(json.dumps(document, indent=1))
    return md.read_metadata(spark, str(folder)).cache()


def test_only_tables_are_read(metadata):
    (row,) = md.tables(metadata).collect()
    assert (row["table_id"], row["display_name"], row["description"]) == ("audience", "audience", "People.")
    assert row["row_count_approx"] == 8000.0


def test_columns_and_synonyms(metadata):
    assert [r["column_name"] for r in md.columns(metadata).orderBy("position").collect()] == ["lat", "location_lat"]
    assert [tuple(r) for r in md.synonyms(metadata).collect()] == [("audience", "location_lat", "lat")]


def test_rules_drive_a_scan(spark, metadata):
    rules = md.rule_list(md.rules(metadata), "audience")
    assert [(r.name, r.threshold) for r in rules] == [("range-lat", 1.0), ("non-null-lat", 0.5), ("set-kind", 1.0)]
    assert rules[2].values == ("a", "b")
    rows = spark.createDataFrame([(90.0, "a"), (None, "b")], "lat double, kind string")
    found = [(r["passed"], r["ok"]) for r in dq.dq_scan(rows, rules).collect()]
    assert found == [(0, False), (1, True), (2, True)]
