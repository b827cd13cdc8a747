"""Generated cases: the same for the same key, in a seeded order, with valid values."""

from __future__ import annotations

from spanveil.operators import sweep


def keys(spark, n=12):
    return spark.range(n).selectExpr("CASE WHEN id = 3 THEN NULL ELSE id END AS k")


def luhn(digits):
    total = 0
    for place, c in enumerate(reversed(digits)):
        d = int(c) * (1 + place % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def test_profiles_are_valid_and_repeatable(spark):
    made = sweep.profiles(keys(spark), "k")
    rows = sorted(map(tuple, made.collect()), key=repr)
    assert rows == sorted(map(tuple, sweep.profiles(keys(spark).repartition(5), "k").collect()), key=repr)
    for r in made.collect():
        assert len(r.card) == 16 and luhn(r.card) and len(r.eth) == 42 and not r.ssn.startswith(("000", "666", "9"))
        assert len(r.account) == 9 and r.day[:2] == "19"


def test_cases_hold_what_they_expect_in_a_seeded_order(spark):
    cases = sweep.sweep_cases(sweep.profiles(keys(spark, 40), "k"))
    rows = cases.collect()
    assert len(rows) == 40 * (len(sweep.TEMPLATES) + len(sweep.NEGATIVES))
    orders = set()
    for r in rows:
        assert all(e.value in r.text for e in r.expected)
        places = [r.text.index(e.value) for e in r.expected]
        assert places == sorted(places) and bool(r.expected) == (r.category == "positive")
        if r.template == "infra_log":
            orders.add(tuple(e.expected_type for e in r.expected))
    assert len(orders) > 20
    other = {r.case_id: r.text for r in sweep.sweep_cases(sweep.profiles(keys(spark, 40), "k"), seed=5).collect()}
    assert sum(other[r.case_id] != r.text for r in rows if r.category == "positive") > 100


def test_floors(spark):
    made = sweep.profiles(spark.range(6), "id")
    rows = sweep.sweep_summary(made, {"positive": 1.01}).collect()
    assert {(r.category, r.reached) for r in rows} == {("positive", False), ("negative", True)}
    whole = {r.category: r.total for r in rows if r.level == 1}
    assert whole == {"positive": 6 * len(sweep.TEMPLATES), "negative": 6 * len(sweep.NEGATIVES)}
    assert all(r.core_passed == r.strict_passed == r.total for r in rows)
