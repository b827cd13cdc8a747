from __future__ import annotations

import re
from collections import defaultdict

import pytest

from spanveil.llm.mixing import mixed, mixing_plan, with_copies
from tests.llm.common import awkward, prose, table


def corpus():
    pairs = awkward(None) + [(1000 + k, prose(k, 1 + k % 50)) for k in range(900)]
    names = ["a", "b", "c", "d", None]
    return pairs, {k: names[min(4, (k * k) % 7)] for k in range(len(pairs))}


def targets(sizes):
    """Water level by plain repetition."""
    order = sorted([s for s in sizes if s is not None]) + ([None] if None in sizes else [])
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    total, full = 1.5 * sum(sizes.values()), {}
    while True:
        rest = [s for s in order if s not in full]
        level = (total - sum(full.values())) / sum(weight[s] for s in rest)
        over = [s for s in rest if weight[s] * level > 2 * sizes[s]]
        if not over:
            return full | {s: weight[s] * level for s in rest}
        full |= {s: 2 * sizes[s] for s in over}


def test_targets_and_words(spark):
    pairs, names = corpus()
    docs = table(spark, pairs, names).repartition(7)
    got = with_copies(docs, mixing_plan(docs)).select("doc.source", "doc.doc_id", "mix.*").collect()
    assert len(got) == len(pairs)
    sizes, taken, largest = defaultdict(int), defaultdict(int), defaultdict(int)
    for k, (_, t) in enumerate(pairs):
        sizes[names[k]] += len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    for r in got:
        taken[r.source] += r.size * r.copies
        largest[r.source] = max(largest[r.source], r.size)
        assert r.source_size == sizes[r.source] and 0 <= r.copies <= 2
    want = targets(dict(sizes))
    for s, words in want.items():
        assert [r.target for r in got if r.source == s] == pytest.approx([words] * sum(r.source == s for r in got))
        assert abs(taken[s] - words) <= largest[s] / 2 + 1e-6, (s, taken[s], words)


def test_reruns_and_copies_agree(spark):
    pairs, names = corpus()
    first = with_copies(*(lambda d: (d, mixing_plan(d)))(table(spark, pairs, names)))
    again = with_copies(*(lambda d: (d, mixing_plan(d)))(table(spark, pairs, names).repartition(11)))
    key = lambda df: sorted((repr(r.doc.doc_id), r.doc.text or "", r.mix.copies) for r in df.collect())
    assert key(first) == key(again)
    docs = table(spark, pairs, names)
    out = mixed(docs)
    assert out.columns == docs.columns
    assert out.count() == sum(c for _, _, c in key(first))


def test_empty_and_wordless(spark):
    assert mixed(table(spark, [])).count() == 0
    docs = table(spark, [(1, None), (2, "  ")])
    assert {tuple(r.mix) for r in with_copies(docs, mixing_plan(docs)).collect()} == {(0, 0, 0.0, 0)}
