"""Counts that tell apart what looks alike: names of literals and tables, subtotals and NULL groups, rates per text."""

from __future__ import annotations

from dataclasses import replace

import pytest

from spanveil.operators import audit, evaluate, redact
from spanveil.operators.dictionaries import Dictionaries
from spanveil.operators.redact import anonymize, findings
from spanveil.operators.scope import position_bounds
from spanveil.streaming import jobs


def with_table(spark, names, *literal):
    table = spark.createDataFrame([(n,) for n in names], "name string")
    return replace(Dictionaries().add_names(literal), names_table=table)


def test_names_of_a_table_are_counted(spark):
    words = with_table(spark, ["Grok Wump", "grok wump ", "Fizzle", "  ", None, "Zorp"], "zorp", "Quux")
    assert words.stats() == {"customNames": 4, "customPatterns": 0}
    assert words.clear().stats()["customNames"] == 0


def test_small_and_large_name_tables_give_the_same(spark, monkeypatch):
    texts = spark.createDataFrame([(1, "Call Grok Wump, now"), (2, "xGrok Wump and fizzle"), (3, None)], "id long, text string")
    words = with_table(spark, ["Grok Wump", "Fizzle", None])
    few = {r.id: r.anonymized for r in anonymize(texts, dictionaries=words).collect()}
    monkeypatch.setattr(redact, "LITERAL_NAMES", 0)
    assert few == {r.id: r.anonymized for r in anonymize(texts, dictionaries=words).collect()}
    assert few == {1: "Call [PERSON_NAME], now", 2: "xGrok Wump and [PERSON_NAME]", 3: ""}


def test_name_tables_on_a_stream(spark, tmp_path, monkeypatch):
    spark.createDataFrame([(1, "Call Grok Wump, now")], "id long, text string").write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("id long, text string").parquet(f"{tmp_path}/in")
    words = with_table(spark, ["Grok Wump"])
    out = jobs.redact_stream(stream, dictionaries=words).select("id", "anonymized")
    job = out.writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/at").trigger(availableNow=True)
    job.start(f"{tmp_path}/out").awaitTermination()
    assert spark.read.schema(out.schema).parquet(f"{tmp_path}/out").first().anonymized == "Call [PERSON_NAME], now"
    monkeypatch.setattr(redact, "LITERAL_NAMES", 0)
    with pytest.raises(ValueError):
        jobs.redact_stream(stream, dictionaries=words)


def test_null_groups_are_no_subtotals(spark):
    texts = spark.createDataFrame(
        [(1, None, "a@b.co and c@d.co"), (2, "web", "x@y.co"), (3, "web", "none"), (4, None, None)], "id long, source string, text string"
    )
    found = findings(texts, ["id", "source"])
    rows = {(r.source, r.placeholder, r.level): r.n_found for r in audit.profile(found, ["source"]).collect()}
    assert rows == {(None, "EMAIL", 0): 2, (None, None, 1): 2, ("web", "EMAIL", 0): 1, ("web", None, 1): 1, (None, None, 3): 3}
    rates = {(r.source, r.level): tuple(r)[1:4] + (r.per_text,) for r in audit.rates(found, texts, ["id"], ["source"]).collect()}
    assert rates == {(None, 0): (2, 1, 2, 1.0), ("web", 0): (2, 1, 1, 0.5), (None, 1): (4, 2, 3, 0.75)}


def test_summary_by_template_alone(spark):
    done = spark.createDataFrame(
        [("c", "t", True, True), (None, "t", True, False), ("c", None, False, False)],
        "category string, template string, core_pass boolean, strict_pass boolean",
    )
    rows = {(r.category, r.template, r.level): (r.total, r.core_passed) for r in evaluate.summary(done, ["category", "template"]).collect()}
    assert rows[None, "t", 2] == (2, 2) and rows[None, None, 2] == (1, 0)
    assert rows["c", None, 1] == (2, 1) and rows["c", None, 0] == (1, 0) and rows[None, None, 3] == (3, 2)


def test_bucket_count_follows_the_rows(spark, monkeypatch):
    df = spark.range(1000)
    assert position_bounds(df, "id") == []
    monkeypatch.setattr("spanveil.operators.scope.BUCKET_ROWS", 100)
    assert len(position_bounds(df, "id")) == 9
