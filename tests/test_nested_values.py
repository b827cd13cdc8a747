"""Nested columns: strings at any depth redacted, all else and the type kept."""

from __future__ import annotations

from spanveil.sources.nested_values import anonymize_nested

SCHEMA = (
    "id long, anonymized string, doc struct<title: string, n: int, turns: array<struct<role: string, "
    "parts: array<string>, meta: map<string, string>>>, last: string>"
)


def test_strings_at_any_depth(spark):
    turn = lambda role, parts, meta: (role, parts, meta)
    rows = [
        (1, "mine", ("a@b.co wrote", 7, [
            turn("user", ["to c@d.co", None, ""], {"a@b.co": "A@b.co", "k": None}), None, turn(None, [], {}), turn("x", None, None),
        ], "c@d.co")),
        (2, None, (None, None, None, None)), (3, None, None), (4, None, ("plain", 1, [turn("user", ["  "], {"k": "v"})], " ")),
        (5, None, ("e@f.co", 1, [], None)),
    ]
    df = spark.createDataFrame(rows, SCHEMA)
    out = anonymize_nested(df, "doc", detectors=["email"])
    assert out.schema["doc"].dataType.simpleString() == df.schema["doc"].dataType.simpleString()
    got = {r.id: r for r in out.collect()}
    first = got[1].doc.asDict(recursive=True)
    assert first == {
        "title": "[EMAIL_1] wrote", "n": 7, "last": "[EMAIL_2]",
        "turns": [
            {"role": "user", "parts": ["to [EMAIL_2]", None, ""], "meta": {"a@b.co": "[EMAIL_1]", "k": None}}, None,
            {"role": None, "parts": [], "meta": {}}, {"role": "x", "parts": None, "meta": None},
        ],
    }
    assert got[1]["count"] == 4 and got[1].anonymized == "mine"
    before = {r.id: r.doc for r in df.collect()}
    assert all(got[k].doc == before[k] and got[k]["count"] == 0 for k in (2, 3, 4))
    assert got[5].doc.title == "[EMAIL]" and got[5].doc.turns == []


def test_many_strings_and_plain_types(spark):
    df = spark.createDataFrame([([f"u{k}@x.org" for k in range(3000)], 5)], "mails array<string>, n int")
    row = anonymize_nested(df, "mails", detectors=["email"]).first()
    assert row.mails == [f"[EMAIL_{k + 1}]" for k in range(3000)] and row["count"] == 3000
    assert anonymize_nested(df, "n").first().n == 5
