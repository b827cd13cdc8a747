"""Wider scopes, audits, evaluation, sources and configs, against plain Python."""

from __future__ import annotations

import json
import random

from pyspark.sql import functions as F

import spanveil as sv
from spanveil.operators import audit, evaluate, scope, skew
from spanveil.sources import texts as sources


def occurrences(spark, n=3000):
    rnd = random.Random(2)
    rows = []
    for doc in range(n):
        source = "hot" if doc % 3 else f"s{doc % 5}"
        for start in range(rnd.randint(0, 3)):
            value = "Same@X.org" if rnd.random() < 0.4 else f"u{rnd.randint(0, 400)}@x.org"
            kind, value = ("EMAIL", value) if rnd.random() < 0.7 else ("T2", f"{rnd.randint(0, 1)} -0")
            rows.append((doc, source, start * 20, kind, value))
    return rows, spark.createDataFrame(rows, "doc_id long, source string, start int, placeholder string, value string")


def norm(kind, value):
    return value.lower().strip() if kind == "EMAIL" else value.replace(" ", "").replace("-", "").lower()


def expected_numbers(rows, scoped):
    first, last, count = {}, {}, {}
    for doc, source, start, kind, value in sorted(rows, key=lambda r: (r[0], r[2])):
        key = (source if scoped else None, kind, norm(kind, value))
        first.setdefault(key, (doc, start))
        last[key] = value
        count[key] = count.get(key, 0) + 1
    out, seen = {}, {}
    for key in sorted(first, key=lambda k: first[k]):
        seen[key[:2]] = seen.get(key[:2], 0) + 1
        out[key] = (seen[key[:2]], last[key], count[key])
    return out, seen


def test_scope_numbering_in_buckets(spark):
    rows, df = occurrences(spark)
    for scoped in (True, False):
        want, totals = expected_numbers(rows, scoped)
        name = "source" if scoped else None
        found = scope.entities_in_scope(df, name, ["doc_id", "start"])
        for buckets in (1, 7, 100):
            bounds = scope.position_bounds(df, "doc_id", buckets)
            got = scope.number_entities(found, name, bounds).collect()
            assert len(got) == len(want)
            for r in got:
                key = (r.source if scoped else None, r.placeholder, r.norm)
                assert (r.n, r.value, r.occurrences) == want[key]
                plain = totals[key[:2]] == 1 and r.placeholder == "EMAIL"
                assert r.tag == (f"[{r.placeholder}]" if plain else f"[{r.placeholder}_{r.n}]")


def test_bucket_of_counts_bounds(spark):
    bounds = sorted(random.Random(1).sample(range(1000), 200))
    got = spark.range(1000).select("id", scope.bucket_of(F.col("id"), bounds).alias("b")).collect()
    assert all(r.b == sum(x <= r.id for x in bounds) for r in got)


def test_lookup_join_with_hot_keys(spark, monkeypatch):
    monkeypatch.setattr(skew, "HOT_ROWS", 50)
    monkeypatch.setattr(skew, "HOT_KEYS", 2)
    left = spark.range(2000).select("id", F.when(F.col("id") % 3 > 0, 0).otherwise(F.col("id") % 17).alias("k"))
    right = spark.range(12).select(F.col("id").alias("k"), (F.col("id") * 10).alias("v"))
    plain, split = left.join(right, "k"), skew.lookup_join(left, right, ["k"])
    assert split.count() == plain.count() > 0
    assert split.exceptAll(plain).isEmpty()


def test_redaction_and_restore_over_a_scope(spark):
    rows = [
        (1, "a", "x@y.org wrote to z@y.org"), (2, "a", "z@y.org again"), (3, "b", "only x@y.org, x@y.org"), (4, "b", "none"),
    ]
    df = spark.createDataFrame(rows, "doc_id int, source string, text string")
    found = skew.kept(sv.findings(df, ["doc_id", "source"], detectors=["email"]))
    numbered = skew.kept(scope.number_entities(scope.entities_in_scope(found, "source", ["doc_id", "start"]), "source"))
    done = scope.redact_in_scope(df, found, numbered, "doc_id", "source")
    got = {r.doc_id: r.anonymized for r in done.collect()}
    assert got == {1: "[EMAIL_1] wrote to [EMAIL_2]", 2: "[EMAIL_2] again", 3: "only [EMAIL], [EMAIL]", 4: "none"}
    back = sv.restore_from_scope_vault(
        done.select("doc_id", "source", "anonymized"), scope.vault(numbered, "source"), "doc_id", "source"
    )
    assert {r.doc_id: r.restored for r in back.collect()} == {r[0]: r[2] for r in rows}


def test_audit(spark):
    text = "Mary\nlives at\nx@y.org with 123-45-6789 and more words that go on and on"
    df = spark.createDataFrame([(1, text), (2, "nothing"), (3, "x@y.org"), (4, None)], "doc_id int, text string")
    done = sv.anonymize(df)
    report = {r.type: r for r in audit.entity_report(done, ["doc_id"]).where("doc_id = 1").collect()}
    assert (report["PERSON_NAME"].line, report["EMAIL"].line, report["SSN"].masked) == (1, 3, "***6789")
    assert report["EMAIL"].context == "Mary lives at x@y.org with 123-45-6789 and more wor..."
    verdicts = {r.doc_id: (r.severity, r.clean) for r in audit.with_verdict(done).collect()}
    assert verdicts == {1: ("HIGH", False), 2: (None, True), 3: ("MEDIUM", False), 4: (None, True)}
    clean, held = audit.gate(done, ["doc_id"])
    assert {r.doc_id for r in clean.collect()} == {2, 4} and {r.doc_id for r in held.collect()} == {1, 3}
    assert not audit.gate_passes(done) and audit.gate_passes(done.where("doc_id = 2"))
    assert {(r.type, r.n_entities) for r in audit.type_counts(done).collect()} == {("PERSON_NAME", 1), ("EMAIL", 2), ("SSN", 1)}
    summary = audit.text_summary(done, ["doc_id"]).where("doc_id = 1").first()
    assert summary.pii_count == 3 and [f.type for f in summary.findings] == ["PERSON_NAME", "EMAIL", "SSN"]
    groups = audit.grouped_by_type(done, ["doc_id"]).where("doc_id = 1").orderBy("position").collect()
    assert [(g.type, g.n_entities, g.masked) for g in groups][0] == ("PERSON_NAME", 1, ["M***"])
    shown = json.loads(done.where("doc_id = 3").select(sources.result_json()).first()[0])
    assert shown == {"anonymized": "[EMAIL]", "entityMap": {"[EMAIL]": "x@y.org"}, "piiCount": 1, "detectedTypes": ["EMAIL"]}


def test_evaluation(spark):
    expect = "array<struct<value:string,expected_type:string,semantic_type:string,allow_type_mismatch:boolean>>"
    text = "mail x@y.org on 2024-01-31 from 10.0.0.1 ok"
    ok = [("x@y.org", "EMAIL", "EMAIL", False), ("2024-01-31", "DATE", "DATE", False), ("10.0.0.1", "IP_ADDRESS", "IP_ADDRESS", False)]
    cases = [
        (1, text, ok, []),
        (2, text, [("y.org", "EMAIL", "EMAIL", False), *ok[1:]], ["overcapture"]),
        (3, text, ok[:2], ["unexpected_detection"]),
        (4, text, [*ok, ("gone", "SSN", "SSN", False)], ["missing_detection"]),
        (5, text, [ok[0], ("2024-01-31", "SSN", "SSN", False), ok[2]], ["type_mismatch"]),
        (6, text, [ok[0], ("2024-01-31", "SSN", "BIRTH", True), ok[2]], ["taxonomy_mismatch"]),
        (7, text, [ok[0], ("2024-01-31", "DATE", "BIRTH", False), ok[2]], ["taxonomy_mismatch"]),
        (8, "Mary, mary", [("mary", "PERSON_NAME", "PERSON_NAME", False)], ["restore_mismatch"]),
        (9, "plain words", [], []),
    ]
    df = spark.createDataFrame([(i, "c", "t", t, e) for i, t, e, _ in cases], f"case_id int, category string, template string, text string, expected {expect}")
    done = evaluate.evaluate_cases(df)
    rows = {r.case_id: r for r in done.collect()}
    for i, _, _, kinds in cases:
        assert [n.kind for n in rows[i].notes] == kinds, i
        assert rows[i].strict_pass == (not kinds)
        assert rows[i].core_pass == (not kinds or kinds[0] in ("overcapture", "taxonomy_mismatch"))
    total = evaluate.summary(done, ["category", "template"]).where("level = 3").first()
    assert (total.total, total.core_passed, total.strict_passed) == (9, 5, 2)
    assert [r.case_id for r in evaluate.failures(done, "case_id", 3).collect()] == [2, 3, 4]


def test_generated_cases(spark):
    values = spark.createDataFrame(
        [("x@y.org", "write to {}", ["EMAIL"]), ("123-45-6789", "number {}", ["SSN"])], "value string, carrier string, expected_types array<string>"
    )
    made = evaluate.carrier_cases(values, ["Note: ", "- "], [".", "", " today"], 6)
    assert made.select("text").distinct().count() == 12
    checks = made.select(
        "text", "expected_types", F.array(F.lit("IBAN")).alias("forbidden_types"), F.array("value").alias("sensitive_values"),
        F.lit(1).alias("expect_count"), F.lit(True).alias("expect_roundtrip"),
    )
    assert evaluate.check_texts(checks).where("NOT ok").isEmpty()


def test_sources_and_config(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("Mary\nx@y.org")
    (tmp_path / "in" / "b.csv").write_text("n\nnothing")
    read = sources.read_texts(spark, str(tmp_path / "in"))
    assert {(r.file.rsplit("/", 1)[1], r.text) for r in read.collect()} == {("a.txt", "Mary\nx@y.org"), ("b.csv", "n\nnothing")}
    done = sv.anonymize(read)
    sources.write_redacted(done, str(tmp_path / "red"), ["file"])
    sources.write_results(done, str(tmp_path / "full"), ["file"])
    sources.write_vault(scope.document_vault(done, "file"), str(tmp_path / "vault"))
    back = sv.restore_from_vault(
        spark.read.parquet(str(tmp_path / "red")), sources.read_vault(spark, str(tmp_path / "vault")), "file"
    )
    assert {r.restored for r in back.collect()} == {"Mary\nx@y.org", "n\nnothing"}

    config = {
        "names": ["Quibble", "Quibble"], "nameFiles": ["names.csv", "missing.txt"], "firstNameFiles": ["first.txt"],
        "patterns": [{"regex": "STAFF-\\d{6}", "placeholder": "EMPLOYEE_ID"}],
    }
    (tmp_path / "pii.json").write_text(json.dumps(config))
    (tmp_path / "names.csv").write_text("Fizzle, x ,Wump Bop\nGrok\n\n")
    (tmp_path / "first.txt").write_text("Zaphod\n")
    got = sources.load_config(spark, str(tmp_path / "pii.json"))
    assert (got.loaded, got.names_loaded, got.patterns_loaded, got.files_loaded) == (True, 5, 1, 1)
    assert got.dictionaries.names == {"quibble"} and "zaphod" in got.dictionaries.lists.first
    assert {r.name for r in got.dictionaries.names_table.collect()} == {"Fizzle", "Wump Bop", "Grok"}
    row = sv.anonymize(
        spark.createDataFrame([("Wump Bop and Zaphod, staff-123456",)], "text string"), dictionaries=got.dictionaries
    ).first()
    assert row.anonymized == "[PERSON_NAME_1] and [PERSON_NAME_2], [EMPLOYEE_ID]"
    assert not sources.load_config(spark, str(tmp_path / "none.json")).loaded
    (tmp_path / "bad.json").write_text("{")
    assert sources.load_config(spark, str(tmp_path / "bad.json")).error


def test_columns_of_a_table(spark):
    df = spark.createDataFrame([(1, "x@y.org", "Mary", None)], "id int, a string, b string, c string")
    row = sources.anonymize_columns(df, ["a", "b", "c"]).first()
    assert (row.a, row.b, row.c) == ("[EMAIL]", "[PERSON_NAME]", "") and len(row.a_entities) == 1
