from __future__ import annotations

import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
from tokenizers import Tokenizer

from spanveil.llm import token_files as tf
from tests.llm.common import awkward, prose, table

ODD = ["a  b", " lead", "trail ", "a\n\nb", "it's a 'x' b'll", "<|endoftext|> a <|endoftext|>", "x y z", "a b\tc", "12 3a !? ..", "\n",
       "x\x1cy z", "日本 語 　x", "a's 's b", "snow ☃ ☃☃", "é́ e", "a  b", "tail\n"]


def written(spark, tmp_path, pairs):
    path = str(tmp_path / "tokens")
    tf.write_token_files(table(spark, pairs).repartition(5), path)
    return path


def test_round_trip(spark, tmp_path):
    pairs = [p for p in awkward(spark)] + [(50 + k, t) for k, t in enumerate(ODD)] + [(500 - k, prose(k, k * 3)) for k in range(200)]
    path = written(spark, tmp_path, pairs)
    rows = tf.token_index(spark, path).collect()
    rows.sort(key=lambda r: r.start)
    library = Tokenizer.from_file(public_tokenizers.path(tf.TOKENIZER))

    def ids(text):
        return np.array([*library.encode(text or "", add_special_tokens=False).ids, 0], "<u4")

    assert [r.doc_id for r in rows] == sorted([i for i, _ in pairs], key=lambda i: (i is not None, i or 0))
    assert [r.start for r in rows] == np.cumsum([0, *[r.n_tokens for r in rows]])[:-1].tolist()
    want = sorted((repr(i), len(ids(t)), zlib.crc32(ids(t).tobytes())) for i, t in pairs)
    assert sorted((repr(r.doc_id), r.n_tokens, r.ids_crc32) for r in rows) == want
    stored = {r.doc_id: r.ids for r in tf.read_token_files(spark, path).collect()}
    assert stored[500] == ids(prose(0, 0)).tolist() and stored[310] == ids(prose(190, 570)).tolist()


def test_lookup_is_pushed_down(spark, tmp_path):
    path = written(spark, tmp_path, [(k, prose(k, 20)) for k in range(400)])
    found = tf.read_token_files(spark, path, [7, 311, 9999])
    assert sorted(r.doc_id for r in found.collect()) == [7, 311]
    assert "PushedFilters: [In(doc_id" in found._jdf.queryExecution().toString()


def test_empty(spark, tmp_path):
    assert tf.token_index(spark, written(spark, tmp_path, [])).count() == 0


def test_cuts_keep_the_library_ids():
    """Texts of every neighbourhood of letters, blanks, marks and digits, many to an array, with a table that overflows."""
    rng = random.Random(7)
    marks = ["a", "Bc", "é", "ß", "日本", "Ж", " ", " ", "  ", "\n", "\n\n", ".", ",", "'s", "'", "’", "1", "23", "<|", "<|endoftext|>", "\t", "\xa0", " ", "-", "_", "\x7f", "😀"]
    texts = ["".join(rng.choice(marks[:-9] if k % 2 else marks) for _ in range(rng.randrange(30))) for k in range(4000)]
    texts += ["", "a", " ", "\n", *ODD]
    library = Tokenizer.from_file(public_tokenizers.path(tf.TOKENIZER))
    coder = tf.Encoder(public_tokenizers.path(tf.TOKENIZER))
    for part in (pa.array(texts), pa.array(["skipped", *texts, "skipped"])[1:-1], pa.array([], pa.string())):
        values, ends = coder.ids(part, 0)
        want = [[*library.encode(t, add_special_tokens=False).ids, 0] for t in part.to_pylist()]
        assert ends.tolist() == np.cumsum([len(w) for w in want]).tolist() and values.tolist() == sum(want, [])


def test_the_table_of_pieces_is_bounded_and_keeps_frequent_pieces(monkeypatch):
    """Failed before: one table was emptied when full, and every frequent piece encoded anew."""
    monkeypatch.setattr(tf, "CACHED_PIECES", 200)
    coder, asked = tf.Encoder(public_tokenizers.path(tf.TOKENIZER)), []
    ids_of = coder.ids_of
    coder.ids_of = lambda piece: asked.append(piece) or ids_of(piece)
    for k in range(50):
        coder.ids(pa.array([f"often {k}word{k}", "often " * 3 + " ".join(f"x{'abcdefghij'[d]}{k}y" for d in range(10))] * 20), 0)
        assert len(coder.young) + len(coder.old) <= 200
    assert asked.count("often") == asked.count(" often") == 1


def test_few_rows_are_in_memory_at_once(spark, tmp_path, monkeypatch):
    """Failed before: batches of 10,000 whole texts stood in the executor and in its workers."""
    name, asked, encoded = "spark.sql.execution.arrow.maxRecordsPerBatch", [], tf.encoded
    before = spark.conf.get(name)
    monkeypatch.setattr(tf, "encoded", lambda *a: asked.append(int(spark.conf.get(name))) or encoded(*a))
    path = written(spark, tmp_path, [(k, prose(k, 3)) for k in range(2500)])
    assert asked == [tf.ROWS_AT_ONCE] and tf.ROWS_AT_ONCE <= 1000 and spark.conf.get(name) == before
    assert tf.token_index(spark, path).count() == 2500
