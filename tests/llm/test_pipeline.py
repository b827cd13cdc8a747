"""The pipeline on a small corpus: every stage is held against a plain form on its own input."""

from __future__ import annotations

import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline as cp
from tests.llm.common import awkward, prose, shingles, table, words
from tests.llm.test_chosen_path import brute, edited
from tests.llm.test_quality import junk

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("sf"))
    items = [(k, prose(8000 + k, 40)) for k in range(6)]
    pairs = [p for p in awkward(spark) if len(p[1] or "") < 1000]
    pairs += [(100 + k, prose(k, 60) if k % 4 else junk(k)) for k in range(240)]
    pairs += [(400 + k, edited(prose(k * 4 + 1, 60), k, 1)) for k in range(20)] + [(450, prose(1, 60))]
    pairs += [(500 + k, prose(600 + k, 20) + " " + items[k][1].upper() + " " + prose(700 + k, 20)) for k in range(6)]
    docs = table(spark, pairs, {k: f"s{k % 3}" for k in range(len(pairs))})
    docs.select(*COLUMNS, "id", "key").write.parquet(f"{path}/documents.parquet")
    labels = [(100 + k, int(k % 4 > 0), 0) for k in range(240)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path, dict(items)


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_stages(spark, folder, tmp_path):
    path, items = folder
    docs, seen = spark.read.parquet(f"{path}/documents.parquet"), {}
    for name, stage in cp.STAGES:
        out = stage(spark, docs, path)
        if name != "token files":
            assert out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/{name}")
        after = spark.read.parquet(f"{tmp_path}/{name}")
        seen[name] = (docs, after)
        docs = after

    before, after = (rows_of(df) for df in seen["quality"])
    gone = {r[0] for r in before} - {r[0] for r in after}
    bad = {100 + k for k in range(0, 240, 4)}
    assert len(gone & bad) > 0.95 * len(bad) and not {i for i in gone if i and i >= 100} - bad

    before, after = (rows_of(df) for df in seen["near copies"])
    classes = {(i, c) for i, c, *_ in brute([(r[0], r[1]) for r in before])}
    assert {r[0] for r in after if r[0] is not None} == {c for _, c in classes if c is not None}
    assert len(after) == len({(shingles(r[1]) or repr(r)) for r in after})

    before, after = (rows_of(df) for df in seen["decontamination"])
    gone = [r for r in before if r not in after]
    text = {k: " ".join(words(t)) for k, t in items.items()}
    assert gone == [r for r in before if any(t in " ".join(words(r[1])) for t in text.values())]

    before, after = (rows_of(df) for df in seen["mixing"])
    assert set(after) <= set(before) and max(after.count(r) for r in set(after)) <= 2 * max(before.count(r) for r in before)
    size = lambda rows: sum(len((r[1] or "").split()) for r in rows)
    assert abs(size(after) - 1.5 * size(before)) < 0.05 * size(before)

    before, index = seen["token files"]
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = []
    for r in before.collect():
        ids = np.array([*library.encode(r.text or "", add_special_tokens=False).ids, 0], "<u4")
        want.append((r.doc_id, len(ids), zlib.crc32(ids.tobytes())))
    got = index.collect()
    assert sorted([(r.doc_id, r.n_tokens, r.ids_crc32) for r in got], key=repr) == sorted(want, key=repr)
    starts = sorted((r.start, r.n_tokens) for r in got)
    assert all(a + n == b for (a, n), (b, _) in zip(starts, starts[1:]))


def test_run_equals_the_stages_and_empty_tables_pass(spark, folder, tmp_path):
    path, _ = folder
    first, again = rows_of(cp.run(spark, path)), rows_of(cp.run(spark, path))
    assert first == again and first
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{path}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert cp.run(spark, str(tmp_path)).count() == 0
