"""Files searched in chunks give what the whole text gives."""

from __future__ import annotations

import random

import pytest

from spanveil.operators.redact import findings
from spanveil.sources import texts
from spanveil.sources.large_files import file_chunks, file_findings, placed_pieces

WORDS = ["mail a{0}@x.org", "+1 555-01{0}-4567 ,", "10.0.0.{0}", "Dear Alice Johnson", "plain words here", "é日本", "order 4111 1111 1111 1111", "zip 9021{1}", "tab\tand\r"]


@pytest.fixture
def folder(spark, tmp_path):
    rng = random.Random(4)
    for k, (lines, glue) in enumerate([(400, "\n"), (30, "\n\n"), (900, " "), (0, ""), (1, "")]):
        body = glue.join(rng.choice(WORDS).format(rng.randint(10, 99), rng.randint(0, 9)) for _ in range(lines))
        (tmp_path / f"f{k}.txt").write_bytes((body + ("\n" if k % 2 else "")).encode())
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
    yield str(tmp_path)
    spark.conf.unset("spark.sql.files.maxPartitionBytes")


@pytest.mark.parametrize("raw", [True, False])
def test_same_as_whole_texts(spark, folder, raw):
    whole = texts.read_texts(spark, folder)
    bodies = {r.file: r.text for r in whole.collect()}
    want = {(r.file, r.start, r.end, r.detector, r.value) for r in findings(whole, ["file"], raw=raw).collect()}
    got = file_findings(spark, folder, chunk=500, overlap=400, raw=raw).collect()
    assert len(got) == len(want) > 500
    assert {(r.file, r.start, r.end, r.detector, r.value) for r in got} == want
    assert [] == [(r.file[-6:], r.start, r.line, 1 + bodies[r.file][: r.start].count("\n")) for r in got if r.line != 1 + bodies[r.file][: r.start].count("\n")][:9]


def test_pieces_and_chunks_are_bounded(spark, folder):
    blocks = spark.read.text(folder).selectExpr("_metadata.file_path AS f", "_metadata.file_block_start AS b").distinct()
    assert blocks.groupBy("f").count().where("count > 1").count() > 0
    bodies = {r.file: r.text for r in texts.read_texts(spark, folder).collect()}
    for r in placed_pieces(spark, folder, 100).collect():
        assert len(r.body) <= 100 and (bodies[r.file] + "\n")[r.at : r.at + len(r.body)] == r.body
    for r in file_chunks(spark, folder, chunk=500, overlap=400).collect():
        assert len(r.text) <= 500 + 4 * 400 and r.start <= r.chunk * 500
