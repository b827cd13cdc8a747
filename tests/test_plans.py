"""The shape of the plans: narrow, pruned, nothing evaluated twice."""

from __future__ import annotations

from pyspark.sql import functions as F

import spanveil as sv

SF = "/root/testdata/sf0.001"


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_redaction_is_narrow_and_pruned(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    plan = plan_of(sv.anonymize(docs, detectors=["email", "us_zip"]).select("doc_id", "anonymized", "count"))
    assert "Exchange" not in plan and "Python" not in plan
    scan = plan[plan.index("FileScan"):]
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in scan


def test_filter_on_a_result_does_not_search_again(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang", "text")
    plain = plan_of(sv.anonymize(docs, detectors=["email"]))
    filtered = plan_of(sv.anonymize(docs, detectors=["email"]).where((F.col("count") > 0) & (F.col("lang") == "en")))
    assert filtered.count("regexp_replace") == plain.count("regexp_replace")
    assert "PushedFilters: [IsNotNull(lang), EqualTo(lang,en)]" in filtered


def test_findings_do_not_search_again(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    exploded = sv.findings(docs, ["doc_id"], detectors=["email"]).groupBy("placeholder").count()
    assert plan_of(exploded).count("regexp_replace") <= plan_of(sv.detect(docs, detectors=["email"])).count("regexp_replace")


def test_subset_builds_only_its_detectors(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    plan = plan_of(sv.anonymize(docs, detectors=["email"]))
    assert "0x[a-fA-F0-9]" not in plan and "@[A-Za-z0-9" in plan
