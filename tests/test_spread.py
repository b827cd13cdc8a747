"""Tables of many rows in few splits are spread over tasks; a row's spans skip steps that change nothing."""

from __future__ import annotations

from pyspark.sql import functions as F

import spanveil as sv
from spanveil.operators.spans import SPAN, resolve
from spanveil.sources import texts


def test_rows_of_a_task_are_bounded(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(texts, "ROWS_A_TASK", 100)
    # Keys repeat and are null: rows in turn, so they share no task.
    spark.range(3000).select(F.when(F.col("id") < 10, 1).alias("k"), "id").coalesce(1).write.parquet(f"{tmp_path}/t")
    got = texts.read_table(spark, f"{tmp_path}/t", "k")
    sizes = [r["count"] for r in got.groupBy(F.spark_partition_id()).count().collect()]
    assert got.rdd.getNumPartitions() == 30 and sum(sizes) == 3000 and max(sizes) <= 150
    assert sorted(r.id for r in got.collect()) == list(range(3000))
    spark.range(90).coalesce(1).write.parquet(f"{tmp_path}/small")
    assert texts.read_table(spark, f"{tmp_path}/small", "id").rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    assert texts.read_table(spark, f"{tmp_path}/t").rdd.getNumPartitions() < 30


def test_overlaps_by_hand(spark):
    lists = [
        [(0, 5), (5, 2), (9, 1)], [(0, 5), (4, 2), (5, 1)], [(3, 9), (0, 4), (12, 1)], [(0, 1), (0, 1)], [(7, 1)], [],
        [(0, 3), (1, 9), (3, 3), (5, 1), (6, 1)],
    ]
    rows = [(i, [(s, n, n, k) for k, (s, n) in enumerate(spans)]) for i, spans in enumerate(lists)]
    df = spark.createDataFrame(rows, f"id int, x array<{SPAN}>")
    for row in df.select("id", resolve(F.col("x")).alias("y")).collect():
        want, reach = [], 0
        for s, n, _, k in sorted(rows[row.id][1]):
            if s >= reach:
                want.append((s, n, k))
                reach = s + n
        assert [(y.start, y["len"], y.seq) for y in row.y] == want


def test_single_and_repeated_types(spark):
    cases = {
        "a@b.co 10.0.0.1": "[EMAIL] [IP_ADDRESS]", "a@b.co 10.0.0.1 A@b.co": "[EMAIL] [IP_ADDRESS] [EMAIL]",
        "10.0.0.2 a@b.co 10.0.0.1": "[IP_ADDRESS_1] [EMAIL] [IP_ADDRESS_2]", "none": "none", "a@b.co": "[EMAIL]",
    }
    df = spark.createDataFrame([(t,) for t in cases], "text string")
    for r in sv.anonymize(df, detectors=["email", "ipv4"]).collect():
        assert r.anonymized == cases[r.text]
        assert [e.first for e in r.entities] == sorted({min(r.text.lower().find(e.value.lower()), 99) for e in r.entities})
