"""JSON texts: values redacted, structure and spelling of the rest kept."""

from __future__ import annotations

import json

from spanveil.sources.json_values import anonymize_json

CASES = {
    '{"a@key.co": "a@b.co", "n": [1, 2.5e3, {"x": "c@d.co and a@b.co"}], "t": true}': (
        '{"a@key.co": "[EMAIL_1]", "n": [1, 2.5e3, {"x": "[EMAIL_2] and [EMAIL_1]"}], "t": true}', 3),
    '{"esc": "tab\\t \\"q\\" \\u00e9", "mail" : "l1\\n\\"a@b.co\\""}': ('{"esc": "tab\\t \\"q\\" \\u00e9", "mail" : "l1\\n\\"[EMAIL]\\""}', 1),
    '{"card": 4111111111111111, "other": 4111111111111112}': ('{"card": "[CREDIT_CARD]", "other": 4111111111111112}', 1),
    '["call", "+1 555-010-4567 ."]': ('["call", "[PHONE_NUMBER] ."]', 1),
    '{"zip": "near", "code": "Dear"}': ('{"zip": "near", "code": "Dear"}', 0),
    '"a@b.co"': ('"[EMAIL]"', 1), "[]": ("[]", 0), '{"": ""}': ('{"": ""}', 0), '{"k": "   "}': ('{"k": "   "}', 0),
    '{broken: "a@b.co"': ('{broken: "[EMAIL]"', 1), "": ("", 0), "a:b": ("a:b", 0),
    '{"smile": "😀 a@b.co 日本"}': ('{"smile": "[EMAIL] 日本"}'.replace("[EMAIL]", "😀 [EMAIL]"), 1),
}


def test_values(spark):
    rows = [(k, t) for k, t in enumerate(CASES)] + [(-1, None)]
    got = {r.id: r for r in anonymize_json(spark.createDataFrame(rows, "id long, props string"), "props").collect()}
    for k, (text, (want, count)) in enumerate(CASES.items()):
        assert (got[k].props, got[k]["count"]) == (want, count), text
        try:
            whole = json.loads(text)
        except ValueError:
            continue
        assert type(json.loads(got[k].props)) is type(whole)
    assert got[-1].props is None and got[-1]["count"] == 0


def test_other_columns_and_long_texts(spark):
    body = json.dumps([{"k": f"u{i}@x.org", "v": i} for i in range(2000)])
    df = spark.createDataFrame([(body, "keep", 1)], "props string, anonymized string, count int")
    row = anonymize_json(df, "props").first()
    out = json.loads(row.props)
    assert [o["v"] for o in out] == list(range(2000)) and [o["k"] for o in out] == [f"[EMAIL_{i + 1}]" for i in range(2000)]
    assert row["count"] == 2000 and row.anonymized == "keep"
