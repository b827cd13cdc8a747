"""Numbers from keyed state: the same tags as a table gives, kept over restarts, forgotten after a pause."""

from __future__ import annotations

import os
import time

import pytest

from spanveil.operators import scope
from spanveil.operators.redact import findings
from spanveil.streaming import numbering

SCHEMA = "conv long, turn long, text string"
SETTING = "spark.sql.streaming.stateStore.providerClass"


@pytest.fixture
def rocks(spark):
    spark.conf.set(SETTING, numbering.PROVIDER)
    yield spark
    spark.conf.unset(SETTING)


def turns():
    rows = [
        (c, t, f"mail u{(c * t) % 5}@x.org and U{t % 2}@x.org" + (", +1 555-001-4567 ." if t % 3 else "")) for c in range(4) for t in range(6)
    ]
    return rows + [(None, 0, "z@z.co é😀 y@y.co"), (None, 1, None), (7, 0, " \t"), (7, 1, "nobody")]


def feed(spark, folder, batches, name):
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"{folder}/in/{name}{k}")


def run(spark, folder, **options):
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in/*")
    out = numbering.redact_scope_stream(stream, "conv", "turn", ["conv", "turn"], **options)
    job = out.writeStream.format("parquet").option("checkpointLocation", f"{folder}/at").trigger(availableNow=True)
    query = job.start(f"{folder}/out")
    query.awaitTermination(180)
    assert query.exception() is None
    return {(r.conv, r.turn): r for r in spark.read.schema(out.schema).parquet(f"{folder}/out").collect()}


def test_same_tags_as_on_a_table_over_batches_and_a_restart(rocks, tmp_path):
    rows = turns()
    by_turn = [[r for r in rows if r[1] in which] for which in ((0, 1), (2, 3, 4), (5,))]
    feed(rocks, tmp_path, by_turn[:2], "a")
    run(rocks, tmp_path)
    feed(rocks, tmp_path, by_turn[2:], "b")
    got = run(rocks, tmp_path)  # a new query that goes on from the checkpoint

    texts = rocks.createDataFrame([(k, *r) for k, r in enumerate(rows)], "id long, " + SCHEMA)
    found = findings(texts, ["id", "conv", "turn"])
    numbered = scope.number_entities(scope.entities_in_scope(found, "conv", ["turn", "start"]), "conv", always_numbered=True)
    want = {(r.conv, r.turn): r.anonymized for r in scope.redact_in_scope(texts, found, numbered, "id", "conv").collect()}
    assert {k: r.anonymized for k, r in got.items()} == want | {(7, 0): ""}
    assert [tuple(e) for e in got[None, 0].entities] == [("[EMAIL_1]", "EMAIL", "z@z.co"), ("[EMAIL_2]", "EMAIL", "y@y.co")]


def test_idle_scopes_are_forgotten(rocks, tmp_path):
    """Processing-time timers need a query that keeps running; it is stopped as soon as the second text is out."""
    feed(rocks, tmp_path, [[(1, 0, "a@b.co c@d.co")]], "a")
    stream = rocks.readStream.schema(SCHEMA).parquet(f"{tmp_path}/in/*")
    out = numbering.redact_scope_stream(stream, "conv", "turn", ["conv", "turn"], idle_ms=1)
    job = out.writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/at").trigger(processingTime="1 second")
    query = job.start(f"{tmp_path}/out")

    def wait_for(turn):
        for _ in range(90):
            time.sleep(1)
            assert query.exception() is None
            if os.path.exists(f"{tmp_path}/out/_spark_metadata"):
                found = rocks.read.schema(out.schema).parquet(f"{tmp_path}/out").where(f"turn = {turn}").collect()
                if found:
                    return found[0].anonymized
        raise AssertionError("nothing came out")

    try:
        assert wait_for(0) == "[EMAIL_1] [EMAIL_2]"
        batches = query.lastProgress["batchId"]
        for _ in range(60):  # a batch without data, in which the timer runs out
            time.sleep(1)
            if query.lastProgress["batchId"] >= batches + 2:
                break
        feed(rocks, tmp_path, [[(1, 1, "new@d.co")]], "c")
        assert wait_for(1) == "[EMAIL_1]"
    finally:
        query.stop()


def test_needs_the_state_store(spark, tmp_path):
    feed(spark, tmp_path, [[(1, 0, "a@b.co")]], "a")
    stream = spark.readStream.schema(SCHEMA).parquet(f"{tmp_path}/in/*")
    with pytest.raises(ValueError):
        numbering.redact_scope_stream(stream, "conv", "turn", ["conv", "turn"])
