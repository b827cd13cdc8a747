"""Numbering, rendering, maps, restore, custom dictionaries."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

import spanveil as sv
from spanveil.operators import custom_join, scope, skew
from spanveil.operators.restore import restore_text


def one(spark, text, **options):
    return sv.deanonymize(sv.anonymize(spark.createDataFrame([(text,)], "text string"), **options)).first()


def test_numbering_and_maps(spark):
    texts = [
        "Mary met Robert. mary and ROBERT left. Mary",
        "only Mary here, Mary",
        "Mary x@y.org Robert z@y.org x@Y.org",
        "123-45-6789 and 123–45-6789 and 987-65-4321",
    ]
    rows = {r.text: r for r in sv.anonymize(spark.createDataFrame([(t,) for t in texts], "text string")).collect()}
    a = rows[texts[0]]
    assert a.anonymized == "[PERSON_NAME_1] met [PERSON_NAME_2]. [PERSON_NAME_1] and [PERSON_NAME_2] left. [PERSON_NAME_1]"
    assert a.entity_map == {"[PERSON_NAME_1]": "Mary", "[PERSON_NAME_2]": "ROBERT"} and a["count"] == 5
    assert [e.tag for e in a.entities] == ["[PERSON_NAME_1]", "[PERSON_NAME_2]"]
    assert rows[texts[1]].anonymized == "only [PERSON_NAME] here, [PERSON_NAME]"
    c = rows[texts[2]]
    assert c.anonymized == "[PERSON_NAME_1] [EMAIL_1] [PERSON_NAME_2] [EMAIL_2] [EMAIL_1]"
    assert c.detected_types == ["PERSON_NAME", "EMAIL"] and c.entity_map["[EMAIL_1]"] == "x@Y.org"
    assert rows[texts[3]].anonymized.startswith("[SSN_1] and [SSN_2] and")  # an en dash is not stripped


def test_blank_and_lossy(spark):
    for text in (None, "", " \n\t "):
        row = one(spark, text)
        assert row.anonymized == "" and row.entity_map == {} and row["count"] == 0 and row.detected_types == []
    assert one(spark, "Mary and mary").restored == "mary and mary"  # same entity, last spelling wins


def test_many_entities(spark):
    """More entities and occurrences than one scan block, and more text than one chunk."""
    text = " ".join(f"u{i % 700}@example.org said {i}" for i in range(2100))
    row = one(spark, text, detectors=["email"])
    assert row["count"] == 2100 and len(row.entity_map) == 700 and row.restored == text
    want = " ".join(f"[EMAIL_{i % 700 + 1}] said {i}" for i in range(2100))
    assert row.anonymized == want


def test_restore_follows_the_replacement_rule(spark):
    def rule(text, entries):
        for tag, value in sorted(entries.items(), key=lambda e: -len(e[0])):
            text = text.replace(tag, value)
        return text

    rnd = random.Random(4)
    cases = []
    for i in range(120):
        many = rnd.choice([3, 40])
        entries = {f"[T_{k}]": rnd.choice(["v", "a b", "", "[T_1]", "x]", "é"]) if i % 3 == 0 else f"v{k}" for k in range(many)}
        text = "".join(rnd.choice(["[T_%d]" % rnd.randint(0, many + 3), " ", "word", "[", "]"] if i % 2 else ["[T_%d]" % rnd.randint(0, many + 3), " ", "w"]) for _ in range(60))
        cases.append((i, text, entries))
    listed = [(i, t, list(m.items())) for i, t, m in cases]  # as a list: a Python dict loses its order on the way
    df = spark.createDataFrame(listed, "id int, t string, m array<struct<k:string,v:string>>")
    for row in df.select("id", restore_text(F.col("t"), F.map_from_entries("m")).alias("r")).collect():
        assert row.r == rule(cases[row.id][1], cases[row.id][2])


def test_custom_dictionaries(spark):
    words = sv.Dictionaries().add_names(["Quentin Blackwood", "ops_admin_42", "ana maria ana"]).add_patterns(
        [
            {"regex": r"STAFF-\d{6}", "label": "Employee ID", "placeholder": "EMPLOYEE_ID"},
            {"regex": r"^T(\d)$", "flags": "gm", "placeholder": "T2"},
        ]
    )
    texts = [
        ("by QUENTIN blackwood, ok", "by [PERSON_NAME], ok"),
        ("by Quentin Blackwood.", "by Quentin Blackwood."),
        ("@ops_admin_42!", "@[PERSON_NAME]!"),
        ("ana maria ana maria ana", "[PERSON_NAME] maria ana"),
        ("xana maria ana maria ana", "xana maria ana maria ana"),
        ("staff-123456 x", "[EMPLOYEE_ID] x"),
        ("T1\nT1\nT3", "[T2_1]\n[T2_1]\n[T2_2]"),
        ("T1", "[T2_1]"),
    ]
    done = sv.anonymize(spark.createDataFrame(texts, "text string, want string"), detectors=[], dictionaries=words).collect()
    assert [(r.text, r.anonymized) for r in done if r.anonymized != r.want] == []


def brute_names(text, names):
    low, edge = text.lower(), set(" \t\n\r\v\f,;:!?()[]{}\"'<>/|\\^~`@#$%&*+=")
    out = []
    for name in names:
        at = low.find(name)
        while at != -1:
            stop = at + len(name)
            if (at == 0 or text[at - 1] in edge) and (stop == len(text) or text[stop] in edge):
                out.append((at, len(name)))
            at = low.find(name, stop)
    return sorted(out)


def test_name_table_join_equals_brute_force(spark, monkeypatch):
    rnd = random.Random(8)
    bits = ["ana", "Ana", "maria", " ", " ", ",", ".", "-", "bo", "@", "x", "(", ")"]
    texts = ["".join(rnd.choice(bits) for _ in range(rnd.randint(1, 30))) for _ in range(400)]
    names = ["ana", "ana maria", "ana maria ana", "bo", "@bo", "ana ana", "bo,bo", "maria-ana", "(ana)"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string").repartition(8, "doc_id")
    table = custom_join.prepare_names(spark.createDataFrame([(n.upper() + " ",) for n in names], "name string"))
    hits = {}
    for r in custom_join.custom_name_hits(df, "doc_id", table).collect():
        hits.setdefault(r.doc_id, []).append((r.start, r.len))
    for i, text in enumerate(texts):
        assert sorted(hits.get(i, [])) == brute_names(text, names), text
    with monkeypatch.context() as patch:  # the same by shuffle, with the heaviest pieces joined apart
        patch.setattr(custom_join, "BROADCAST_BYTES", 0)
        patch.setattr(skew, "HOT_ROWS", 100)
        patch.setattr(skew, "HOT_KEYS", 3)
        shuffled = custom_join.custom_name_hits(df, "doc_id", table).collect()
    assert sorted(map(tuple, shuffled)) == sorted((i, s, n) for i, found in hits.items() for s, n in found)
    joined = custom_join.with_custom_name_spans(df, "doc_id", table)
    via_join = sv.anonymize(joined, detectors=[], extra_spans=F.col("name_spans")).select("doc_id", "anonymized")
    in_plan = sv.anonymize(df, detectors=[], dictionaries=sv.Dictionaries().add_names(names)).select("doc_id", "anonymized")
    assert via_join.exceptAll(in_plan).isEmpty() and in_plan.exceptAll(via_join).isEmpty()


def test_vault_restore(spark):
    texts = [(1, "Mary met Robert"), (2, "nobody"), (3, "x@y.org and z@y.org and x@y.org"), (4, "")]
    done = sv.anonymize(spark.createDataFrame(texts, "doc_id int, text string"))
    vault = scope.document_vault(done, "doc_id")
    back = sv.restore_from_vault(done.select("doc_id", "anonymized"), vault, "doc_id")
    assert {r.doc_id: r.restored for r in back.collect()} == dict(texts)
