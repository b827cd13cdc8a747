"""Several values searched as one text: a short separator, the results of a wide one."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from spanveil.operators.dictionaries import Dictionaries
from spanveil.sources.apart import APART, NARROW, WIDE, with_joined
from spanveil.sources.json_values import anonymize_json
from spanveil.sources.nested_values import anonymize_nested

ROWS = [
    ["a@b.co", "10.0.0.1", "up", "4111111111111111", '{"k": 7}'], ["{", "at: 90210", "}"], ['say "', "90210, x", ","],
    ["social security", "123456789"], ["social security 123456789", "987654321", "passport", "1234567"],
    ["123456789", "ssn", "123456789 ssn"], ["build: ", "2024-01-05", 'date": "', "2024-02-06"], ["x, y", ", 2024-03-04", "90210"],
    ["dear", "Will", "dear Will", "Mary", "mary, NY", "Mary", ", NY"], ["call", "+1 555-010-4567", "call 555 010 4567"],
    ["12", "Main", "Street", "12 Main Street", "90210", " Main Street"], ["abandon " * 12, "ability " * 12, "zip"],
    ["", "a@b.co", "", " ", "c@d.co", "a@b.co"], ["a\x1eb", "a@b.co"], ["x\n\x1e\ny 90210", "{ 90210"], ["member", "123456", "order no", "4521 7"],
    [], ["\x1e"], ["😀 ssn", "123456789", "a@b.co"], ["+1 555-010-4567", "555-010-4567"], ["dob", "01/02/1990", "dob 01/02/1990"],
]


def both_ways(spark, function, column, df):
    """The results with the separator of the values' own and with the wide one, which a pattern that finds nothing brings."""
    idle = Dictionaries().add_patterns([{"regex": "QQQQ-QQQQ", "label": "none", "placeholder": "NONE"}])
    out = ["id", column, "entity_map", "count", "detected_types", "entities"]
    narrow, wide = (function(df, column, dictionaries=d).select(*out).orderBy("id").collect() for d in (None, idle))
    return narrow, wide


def test_same_results_as_the_wide_separator(spark):
    nested = spark.createDataFrame(list(enumerate(ROWS)), "id long, v array<string>")
    texts = [(k, json.dumps({f"k{i}": x for i, x in enumerate(row)})) for k, row in enumerate(ROWS)]
    texts += [(100, "no json ssn\n\x1e\n123456789"), (101, None), (102, "no json a@b.co")]
    for function, df in (
        (anonymize_nested, nested), (anonymize_json, spark.createDataFrame(texts, "id long, v string"))
    ):
        narrow, wide = both_ways(spark, function, "v", df)
        assert narrow == wide
        assert narrow[0]["count"] == 3 and sum(r["count"] for r in narrow) > 20


def test_text_is_hardly_longer_than_its_values(spark):
    df = spark.createDataFrame([(["ab"] * 50,), (["a\x1eb", "c"],)], "v array<string>")
    rows = with_joined(df, "t", F.col("v")).collect()
    assert len(rows[0].t) <= 50 * 5 and rows[0][APART] == NARROW and rows[1][APART] == WIDE
    wide = with_joined(df, "t", F.col("v"), Dictionaries().add_patterns([{"regex": "a.b", "label": "x", "placeholder": "X"}]))
    assert [r[APART] for r in wide.collect()] == [WIDE, WIDE]
