from __future__ import annotations

import itertools
import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa

from spanveil.llm import chosen_path as cp
from spanveil.llm import shingles as sh
from tests.llm.common import awkward, prose, shingles, table


def edited(text, seed, n):
    w, rng = text.split(), random.Random(seed)
    for _ in range(n):
        w[rng.randrange(len(w))] = f"new{seed}x{rng.randrange(99)}"
    return " ".join(w)


def corpus():
    pairs = awkward(None)
    base = prose(900, 300)
    pairs += [(100 + k, edited(base, k, 1 + k % 6)) for k in range(60)]
    for s in range(25):
        text = prose(s, 40 + s * 9)
        pairs += [(200 + 10 * s + k, edited(text, 31 * s + k, k)) for k in range(4)]
    return pairs + [(600 + k, prose(5000 + k, 30)) for k in range(60)] + [(99, base), (98, base.upper())]


def brute(pairs):
    sets = [shingles(t) for _, t in pairs]
    reps = sorted({s for s in sets if s}, key=lambda s: sorted(s))
    degree, parent = Counter(), {s: s for s in reps}

    def find(s):
        while parent[s] is not s:
            s = parent[s]
        return s

    for a, b in itertools.combinations(reps, 2):
        if len(a & b) * 5 >= 4 * len(a | b):
            degree[a] += 1
            degree[b] += 1
            parent[find(a)] = find(b)
    classes = defaultdict(list)
    for (i, _), s in zip(pairs, sets, strict=True):
        if s:
            classes[find(s)].append(i)
    out = []
    for (i, _), s in zip(pairs, sets, strict=True):
        own = classes[find(s)] if s else [i]
        known = [x for x in own if x is not None]
        out.append((i, min(known) if known else None, degree[s], sum(x == s for x in sets) if s else 1, len(own)))
    return sorted(out, key=repr)


def test_against_brute_force_with_deep_splits_and_small_tiles(spark, monkeypatch):
    pairs = corpus()
    docs = table(spark, pairs).repartition(4)
    monkeypatch.setattr(cp, "BLOCK", 16)
    monkeypatch.setattr("spanveil.llm.verify.BLOCK_ROWS", 8)
    rows = cp.near_copies(docs, small=4).collect()
    assert sorted([(r.id, r.class_id, r.n_links, r.n_copies, r.class_size) for r in rows], key=repr) == brute(pairs)
    kept = [r for r in rows if r.kept]
    assert len(kept) == len({(r.class_id, r.key if r.class_size == 1 else 0) for r in rows})
    stay = cp.without_near_copies(docs)
    assert stay.columns == docs.columns
    assert sorted(repr(r.doc_id) for r in stay.collect()) == sorted(repr(r.id) for r in kept)


def test_empty(spark):
    assert cp.near_copies(table(spark, [])).count() == 0
    assert cp.without_near_copies(table(spark, [])).count() == 0
    assert {r.n_links for r in cp.near_copies(table(spark, [(1, None), (2, ""), (3, None)])).collect()} == {0}


def test_runs_reach_the_recall():
    assert 1 - (1 - cp.together(3)) ** cp.runs_for(0.999, 3) >= 0.999
    assert abs(cp.together(1) - 0.632) < 0.001


def test_shingles_are_those_of_the_words():
    texts = ["", "a", "a b c d", "a b c d e", "A, b! c-d e f", "x" * 700 + " " + "y" * 700 + " é É", "...", "one two"]
    hashes, starts, ends, firsts = sh.hashed_words(pa.array(texts))
    from tests.llm.common import words

    assert np.diff(firsts).tolist() == [len(words(t)) for t in texts]
    flat = [w for t in texts for w in words(t)]
    assert len(set(zip(flat, hashes.tolist(), strict=True))) == len(set(flat)) == len(set(hashes.tolist()))
    data = "".join(texts).encode()
    assert [data[a:b].decode() for a, b in zip(starts, ends, strict=True)] == [w for t in texts for w in sh_words(t)]
    members, at = sh.distinct_sets(*sh.shingle_runs(hashes, firsts))
    assert np.diff(at).tolist() == [len(shingles(t)) for t in texts]


def sh_words(text):
    import re

    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", text)


def test_sketches_estimate_jaccard():
    rng = np.random.default_rng(1)
    for size, shared in ((3, 2), (40, 34), (900, 800), (5000, 4000)):
        hits = []
        for _ in range(30):
            x = rng.integers(0, 1 << 63, 2 * size - shared, dtype=np.uint64)
            a, b = np.sort(x[:size]), np.sort(x[size - shared :])
            t = sh.sketches(np.concatenate([a, b]), np.array([0, size, 2 * size]))
            hits.append((t[0] == t[1]).mean())
        assert abs(np.mean(hits) - shared / (2 * size - shared)) < 0.035
