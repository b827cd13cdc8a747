from __future__ import annotations

import hashlib
import math
import random

import numpy as np

import __spark_entry__ as entry
from spanveil.llm import centroids as ct

SCHEMA = "vec_id long, embedding array<float>, label int, id string, v string, cluster string, distance int, centroid long"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 1, "x", "y", "z", 2, 3) for i, v in rows], SCHEMA)


def plain(rows, clusters=40, dims=64, rounds=5):
    """(id, cluster, distance, cluster_inertia, inertia, sha) by trying every centroid, in Python integers."""
    own = []
    for i, v in rows:
        if v is None or len(v) != dims or any(x is None or not math.isfinite(x) for x in v):
            continue
        own.append((i, tuple(math.floor(256 * float(np.float32(x))) for x in v)))
    named = sorted((hashlib.sha256(f"2:{i}".encode()).hexdigest(), v) for i, v in own if i is not None)
    centres = [list(v) for _, v in named[:clusters]]

    def assign():
        out = []
        for _, v in own:
            d = [sum((a - b) ** 2 for a, b in zip(v, c, strict=True)) for c in centres]
            out.append((min(range(len(d)), key=lambda k: (d[k], k)), min(d)))
        return out

    for _ in range(rounds):
        found = assign()
        for k in range(len(centres)):
            mine = [v for (_, v), (c, _) in zip(own, found, strict=True) if c == k]
            if mine:
                centres[k] = [sum(x) // len(mine) for x in zip(*mine, strict=True)]
    found = assign()
    sums = {k: sum(d for c, d in found if c == k) for k in range(len(centres))}
    shas = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres]
    whole = sum(d for _, d in found)
    return sorted([(i, c, d, sums[c], whole, shas[c]) for (i, _), (c, d) in zip(own, found, strict=True)], key=repr)


def answer(spark, rows, parts=4, **options):
    out = ct.with_inertia(*ct.clustered(frame(spark, rows).repartition(parts), **options))
    cols = ("id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
    return sorted([tuple(r) for r in out.select(*cols).collect()], key=repr)


def vectors(n, seed, dims=64, spread=1.0):
    rng = random.Random(seed)
    centres = [[rng.gauss(0, spread) for _ in range(dims)] for _ in range(9)]
    return [(k, [x + rng.gauss(0, 0.2) for x in rng.choice(centres)]) for k in range(n)]


def test_threshold_algorithm_finds_the_nearest():
    rng = np.random.default_rng(3)
    for k, dims, size in ((1, 3, 9), (40, 64, 300), (40, 2, 300), (7, 1, 50), (300, 3, 60)):
        for spread in (2, 40, 100_000):
            centres = rng.integers(-spread, spread, (k, dims))
            own = rng.integers(-spread, spread, (size, dims))
            own[: min(k, size) : 2] = centres[: min(k, size) : 2]
            number, best = ct.nearest(own, centres)
            d = ((own[:, None, :] - centres[None]) ** 2).sum(2)
            assert (best == d.min(1)).all() and (number == d.argmin(1)).all()


def test_threshold_algorithm_stops_early(monkeypatch):
    """In few dimensions most centroids are never compared."""
    rng = np.random.default_rng(4)
    centres, own = rng.integers(-10_000, 10_000, (2000, 2)), rng.integers(-10_000, 10_000, (200, 2))
    seen = []
    real = np.nonzero
    monkeypatch.setattr(ct.np, "nonzero", lambda x: seen.append(int(x.sum())) or real(x))
    ct.nearest(own, centres)
    assert sum(seen) < 0.2 * 2000 * 200


def test_against_brute_force_with_awkward_rows(spark):
    rows = vectors(400, 1) + [(1000, None), (1001, []), (1002, [0.5] * 63), (1003, [0.5] * 65), (None, [0.25] * 64), (None, [0.5] * 64)]
    rows += [(1004, [None] + [0.1] * 63), (1005, [float("nan")] + [0.1] * 63), (1006, [float("inf")] * 64), (1007, [-0.0] * 64)]
    rows += [(7, [0.125] * 64), (7, [0.125] * 64), (8, [-1e-9] * 64)] + [(2000 + k, [0.75] * 64) for k in range(300)]
    assert answer(spark, rows) == plain(rows)


def test_fewer_vectors_than_clusters_and_empty_clusters(spark):
    rows = [(k, [float(k // 2)] * 64) for k in range(12)]  # pairs of equal vectors: one centroid of each pair stays empty
    assert answer(spark, rows) == plain(rows)
    assert answer(spark, []) == [] and answer(spark, [(1, None)]) == [] and answer(spark, [(None, [1.0] * 64)]) == []


def test_other_sizes(spark):
    rows = vectors(120, 6, dims=5)
    assert answer(spark, rows, clusters=3, dimensions=5, rounds=2) == plain(rows, 3, 5, 2)


def test_components_too_large_for_a_long_are_left_out(spark):
    rows = vectors(30, 2)
    assert answer(spark, rows + [(99, [3e38] * 64), (98, [float(1 << 20)] + [0.0] * 63)]) == plain(rows)


def test_query(spark, tmp_path):
    rows = vectors(150, 9) + [(None, [0.25] * 64), (5, None)]
    frame(spark, rows).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = entry.queries()["op11_centroids"](spark, str(tmp_path))
    assert sorted(map(tuple, got.collect()), key=repr) == plain(rows)
