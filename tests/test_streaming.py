"""The operators on streams read from files."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

import spanveil as sv
from spanveil.streaming import jobs

SCHEMA = "event_id long, ts timestamp, user_id long, text string"
T0 = dt.datetime(2024, 1, 1)


def stream_of(spark, tmp_path, batches):
    folder = str(tmp_path / "in")
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(folder)


def events(n=30):
    return [
        (i, T0 + dt.timedelta(minutes=7 * i), i % 2, f"mail u{i % 3}@x.org" if i % 3 else "nothing") for i in range(n)
    ]


def run(query_writer):
    query = query_writer.trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert query.exception() is None
    return query


def test_redaction_and_gate(spark, tmp_path):
    rows = events()
    stream = stream_of(spark, tmp_path, [rows[:15], rows[15:]])
    paths = [str(tmp_path / p) for p in ("clean", "held", "vault", "cp")]
    run(jobs.gate_stream(stream, "event_id", *paths, detectors=["email"]))
    clean, held, vault = (spark.read.parquet(p) for p in paths[:3])
    want = sv.anonymize(spark.createDataFrame(rows, SCHEMA), detectors=["email"])
    assert {r.event_id for r in clean.collect()} == {r[0] for r in rows if r[3] == "nothing"}
    got = {r.event_id: r.anonymized for r in held.collect()}
    assert got == {r.event_id: r.anonymized for r in want.where(F.col("count") > 0).collect()}
    back = sv.restore_from_vault(held, vault, "event_id")
    assert {r.event_id: r.restored for r in back.collect()} == {r[0]: r[3] for r in rows if r[3] != "nothing"}


def test_windows_and_sessions(spark, tmp_path):
    rows = events()
    table = sv.findings(spark.createDataFrame(rows, SCHEMA), ["event_id", "ts", "user_id"], detectors=["email"])
    stream = sv.findings(stream_of(spark, tmp_path, [rows]), ["event_id", "ts", "user_id"], detectors=["email"])
    for name, make in {
        "tumbling": lambda d: jobs.rate_per_window(d, "ts", "30 minutes"),
        "sliding": lambda d: jobs.rate_per_window(d, "ts", "30 minutes", "10 minutes"),
        "session": lambda d: jobs.rate_per_session(d, "ts", "user_id", "10 minutes"),
    }.items():
        mode = "complete" if name != "session" else "append"
        run(make(stream).writeStream.format("memory").queryName(f"t_{name}").outputMode(mode))
        batch = {tuple(r) for r in make(table).collect()}
        streamed = {tuple(r) for r in spark.table(f"t_{name}").collect()}
        assert streamed <= batch and (streamed == batch or name == "session") and streamed


def test_table_sessions_match_session_window(spark):
    rows = [(u, T0 + dt.timedelta(minutes=m)) for u in range(3) for m in (0, 5, 14, 24, 58, 61, 70, 119, 121, 500, 500)]
    df = spark.createDataFrame(rows, "user_id long, ts timestamp")
    mine = {tuple(r) for r in jobs.rate_per_session(df, "ts", "user_id", "10 minutes").collect()}
    spark_way = df.groupBy("user_id", F.session_window("ts", "10 minutes").alias("s")).count()
    theirs = {tuple(r) for r in spark_way.select("user_id", "s.start", "s.end", "count").collect()}
    assert mine == theirs


def test_first_findings_and_stable_tags(spark, tmp_path):
    rows = events()
    stream = sv.findings(stream_of(spark, tmp_path, [rows[:10], rows[10:]]), ["event_id", "ts", "user_id"], detectors=["email"])
    once = jobs.first_findings(stream, ["user_id", "value"], "ts", "10 hours")
    run(once.writeStream.format("memory").queryName("t_first"))
    got = [(r.user_id, r.value) for r in spark.table("t_first").collect()]
    assert len(got) == len(set(got)) == len({(r[2], r[3]) for r in rows if r[3] != "nothing"})
    tags = jobs.with_stable_tag(
        spark.createDataFrame([("X@y.org", "EMAIL"), ("x@Y.org ", "EMAIL"), ("z@y.org", "EMAIL")], "value string, placeholder string"), "salt"
    ).collect()
    assert tags[0].tag == tags[1].tag != tags[2].tag
