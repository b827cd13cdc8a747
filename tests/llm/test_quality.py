from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa

from spanveil.llm import quality as q
from tests.llm.common import awkward, prose, table


def junk(seed):
    return " ".join(w + ("%%%", "###", "&&&")[k % 3] for k, w in enumerate(prose(seed, 60).split()))


def corpus(spark):
    pairs = awkward(None) + [(100 + k, prose(k, 60) if k % 4 else junk(k)) for k in range(400)]
    labels = [(100 + k, int(k % 4 > 0), 0) for k in range(0, 400, 2)] + [(None, 1, 0), (101, None, 0), (5, 1, None), (5, 0, 1)]
    return table(spark, pairs).repartition(4), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), dict(pairs[13:])


def test_held_out_accuracy_and_edges(spark):
    docs, labels, texts = corpus(spark)
    rows = q.scored(docs, q.fit(docs, labels)).collect()
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.doc_id in texts and zlib.crc32(str(r.doc_id).encode()) % 4 == 2]
    assert len(held) > 50
    assert np.mean([(r.score >= 0.7) == ((r.doc_id - 100) % 4 > 0) for r in held]) > 0.97
    empty = {r.score for r in rows if not (r.text or "")}
    assert len(empty) == 1
    kept = q.accepted(docs, labels)
    assert kept.columns == docs.columns
    assert kept.count() == sum(r.score >= 0.7 for r in rows)


def test_votes_equal_brute_force():
    rng = np.random.default_rng(3)
    texts = [prose(k, 30) if k % 3 else junk(k) for k in range(90)]
    table_ = q.counts(pa.array(texts))
    own = np.array([float(k % 3 > 0) for k in range(60)], np.float32)
    weights = rng.random(60).astype(np.float32)
    weights /= weights.sum()
    idf = np.ones(q.FEATURES, np.float32)
    m = q.fitted(table_[:60], own, weights, idf, 12, 7, 4)
    got = m.scores(table_[60:])
    for k in range(30):
        x = q.weighted(table_[60 + k : 61 + k], idf)[0] @ m.basis
        cos = m.vectors @ (x / np.linalg.norm(x))
        near = np.argsort(-cos)[:7]
        w = np.maximum(cos[near], 0).astype(float) ** 4 * weights[near]
        assert abs(got[k] - (w * own[near]).sum() / w.sum()) < 1e-4


def test_counts_do_not_cross_texts():
    both = q.counts(pa.array(["abcdef", "", None, "xyz!12 é"]))
    alone = np.concatenate([q.counts(pa.array([t])) for t in ("abcdef", "", "", "xyz!12 é")])
    assert (both == alone).all() and both[1].sum() == 0


def test_empty_tables(spark):
    docs, labels, _ = corpus(spark)
    none = q.fit(docs, labels.limit(0))
    assert {r.score for r in q.scored(docs, none).collect()} == {0.5}
    assert q.scored(docs.limit(0), q.fit(docs.limit(0), labels)).count() == 0
