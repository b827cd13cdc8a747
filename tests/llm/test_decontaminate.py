from __future__ import annotations

import random

import numpy as np
import pytest

from spanveil.llm import decontaminate as d
from tests.llm.common import awkward, prose, table, words


def plain_smith_waterman(item, text):
    best = 0.0
    row = [0.0] * (len(text) + 1)
    for a in item:
        new = [0.0]
        for j, b in enumerate(text, 1):
            new.append(max(0.0, row[j - 1] + (d.MATCH if a == b else d.MISS), row[j] + d.MISS, new[-1] + d.MISS))
        row = new
        best = max(best, *row)
    return best / (d.MATCH * max(1, len(item)))


def test_alignment_is_smith_waterman():
    rng = random.Random(5)
    for _ in range(80):
        item = [rng.randrange(6) for _ in range(rng.randrange(1, 14))]
        text = [rng.randrange(6) for _ in range(rng.randrange(1, 40))]
        score, end, start = d.align(np.array(item), np.array(text))
        assert score == pytest.approx(plain_smith_waterman(item, text))
        if score:
            assert plain_smith_waterman(item, text[start:end]) == pytest.approx(score)


def benchmark(spark):
    items = [(k, prose(7000 + k, 25 + k)) for k in range(12)] + [(90, ""), (91, None), (92, "just three words"), (None, prose(7100, 30))]
    return items, spark.createDataFrame(items, "item_id long, text string")


def corpus(items):
    rng, pairs, want = random.Random(2), awkward(None), set()
    for k, (item, text) in enumerate(items):
        w = words(text)
        if len(w) < 4:
            continue
        edited = [x if rng.random() > 0.12 else "edited" for x in w]
        for n, form in enumerate((w, edited, w[: len(w) // 2] + ["gap", "here"] + w[len(w) // 2 :])):
            pairs.append((1000 + 10 * k + n, prose(k, 50) + "\n" + " ".join(form).upper() + ". " + prose(k + 50, 40)))
            want.add((1000 + 10 * k + n, item))
    return pairs + [(3000 + k, prose(k + 300, 60)) for k in range(60)] + [(93, "Just THREE, words")], want | {(93, 92)}


def test_finds_copies_and_edits_and_nothing_else(spark, monkeypatch):
    items, bench = benchmark(spark)
    pairs, want = corpus(items)
    docs = table(spark, pairs).repartition(5)
    for words_at_once in (d.BLOCK_WORDS, 40):  # 40: many blocks of items
        monkeypatch.setattr(d, "BLOCK_WORDS", words_at_once)
        got = d.leaks(docs, bench).collect()
        assert {(r.id, r.item_id) for r in got} == want
        if words_at_once == 40:
            continue
        text = {i: words(t) for i, t in pairs if i is not None and i >= 1000}
        for r in got:
            if r.item_id != 92 and r.id >= 1000:
                item = words(dict(items)[r.item_id])
                assert plain_smith_waterman(item, text[r.id]) == pytest.approx(r.score)
        clean = d.without_leaks(docs, bench)
        assert clean.columns == docs.columns
        bad = {i for i, _ in want}
        assert sorted(repr(r.doc_id) for r in clean.collect()) == sorted(repr(i) for i, _ in pairs if i not in bad)


def test_a_group_of_edited_copies_beside_one_exact_copy(spark):
    item = [f"w{k}" for k in range(24)]
    edited = [w if k % 5 != 4 else "edited" for k, w in enumerate(item)]
    pairs = [(0, prose(1, 30) + " " + " ".join(item))] + [(k, prose(k, 30) + " " + " ".join(edited) + " " + prose(k + 50, 20)) for k in range(1, 9)]
    pairs += [(100 + k, prose(k + 200, 60) + " w5 w6 w7 w8") for k in range(40)]  # a stock phrase of the item
    bench = spark.createDataFrame([(7, " ".join(item))], "item_id long, text string")
    docs = table(spark, pairs).repartition(3)
    assert sorted(r.id for r in d.leaks(docs, bench).collect()) == list(range(9))
    assert sorted(r.doc_id for r in d.without_leaks(docs, bench).collect()) == list(range(100, 140))


def test_empty(spark):
    _, bench = benchmark(spark)
    docs = table(spark, [(1, "a b c d e")])
    assert d.leaks(table(spark, []), bench).count() == 0
    assert d.leaks(docs, bench.limit(0)).count() == 0
    assert d.without_leaks(docs, bench.limit(0)).count() == 1
