"""Distinct entities by sketches: merged groups, increments and stored sketches against exact counts."""

from __future__ import annotations

from spanveil.operators import sketches
from spanveil.operators.redact import findings

DIMS = ["lang", "source"]


def made(spark, low, high):
    rows = [(k, "en" if k % 3 else None, f"s{k % 2}", f"Write to User{k % 4000}@mail.example or user{k % 4000}@MAIL.example") for k in range(low, high)]
    return findings(spark.createDataFrame(rows, "id long, lang string, source string, text string"), ["id", *DIMS], detectors=["email"])


def exact(low, high, group):
    seen = {}
    for k in range(low, high):
        seen.setdefault(group(k), set()).add(k % 4000)
    return {g: len(v) for g, v in seen.items()}


def test_sketches_merge_over_groups_and_increments(spark, tmp_path):
    sketches.entity_sketches(made(spark, 0, 5000), DIMS).write.parquet(str(tmp_path / "first"))
    stored = spark.read.parquet(str(tmp_path / "first"))
    both = sketches.with_increment(stored, made(spark, 3000, 7000), DIMS)
    got = {(r.lang, r.source): r.n_distinct for r in sketches.distinct_counts(both).collect()}
    want = exact(0, 7000, lambda k: ("en" if k % 3 else None, f"s{k % 2}"))
    assert got.keys() == want.keys()
    assert all(abs(got[g] - n) <= 0.03 * n for g, n in want.items())
    (all_,) = sketches.distinct_counts(sketches.united(both, [])).collect()
    assert all_.placeholder == "EMAIL" and abs(all_.n_distinct - 4000) <= 120


def test_nothing_found(spark):
    none = sketches.entity_sketches(made(spark, 0, 10).where("value IS NULL"), DIMS)
    assert none.count() == 0 and sketches.distinct_counts(sketches.united(none, ["lang"])).count() == 0
