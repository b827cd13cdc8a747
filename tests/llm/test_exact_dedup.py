from __future__ import annotations

import hashlib
import re
from collections import defaultdict

import pytest

from spanveil.llm.exact_dedup import digest_rows, exact_duplicates, merged_runs
from tests.llm.common import awkward, table


def norm(t):
    return re.sub(r"[\x20\x09-\x0D]+", " ", t or "")


def expected(pairs):
    groups = defaultdict(list)
    for i, t in pairs:
        groups[norm(t)].append(i)
    rows = []
    for text, ids in groups.items():
        some = [i for i in ids if i is not None]
        for i in ids:
            rows.append((i, min(some) if some else None, len(ids), hashlib.sha256(text.encode()).hexdigest()))
    return sorted(rows, key=repr)


@pytest.mark.parametrize("fan_in", [2, 3, 8])
def test_against_brute_force(spark, fan_in):
    pairs = awkward(spark) + [(100 + k, ("copy of one" if k % 3 else f"text {k % 40}") + "  \t x") for k in range(300)]
    docs = table(spark, pairs).repartition(23)
    got = exact_duplicates(docs, fan_in=fan_in).collect()
    assert sorted([(r.id, r.keep_id, r.group_size, r.sha) for r in got], key=repr) == expected(pairs)
    assert sum(r.kept for r in got) == len({norm(t) for _, t in pairs})
    assert all(r.id == r.keep_id for r in got if r.kept)


def test_digest_is_verified(spark):
    """Two texts with the same order digest but different SHA-256 stay apart at every level."""
    rows = spark.createDataFrame(
        [(k, k, k % 7, 5, "a" if k % 2 else "b") for k in range(40)], "id long, row long, run int, digest long, sha string"
    )
    got = {r.sha: (r.best.id, r.n) for r in merged_runs(rows, 2).collect()}
    assert got == {"b": (0, 20), "a": (1, 20)}


def test_empty(spark):
    docs = table(spark, [])
    assert exact_duplicates(docs).count() == 0
    assert digest_rows(docs).count() == 0


def test_plan_is_native(spark):
    plan = exact_duplicates(table(spark, [(1, "a")]))._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas", plan)
