"""Registered queries that go through storage or a stream and are read back: sinks, sources, configs, file scans.

Their files lie in new folders of ``spark.checkpoint.dir``; the results read them, so they are deleted with that folder.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanveil.operators import scope
from spanveil.operators.dictionaries import NameLists
from spanveil.operators.redact import anonymize, findings
from spanveil.operators.restore import restore_from_vault
from spanveil.operators.skew import shared_folder
from spanveil.plans import document_sql as sql
from spanveil.plans.queries import _EVENT_HITS, _EVENT_TEXT, _NAME_TEXT, _TURN_HITS, conversation_turns, register, table, texts
from spanveil.sources import large_files
from spanveil.sources import texts as sources
from spanveil.streaming import jobs, numbering


@register("sinks_read_back", (
    f"{sql.DOC_TAGS}, {sql.rendered()}, lossy AS (SELECT doc_id FROM tags GROUP BY doc_id, tag HAVING count(DISTINCT value) > 1) "
    f"SELECT r.doc_id, r.anonymized, r.n AS pii_count, coalesce(regexp_matches(d.text, '[^{sql.SPACES}]') OR d.text = '', false) "
    "AND r.doc_id NOT IN (SELECT doc_id FROM lossy) AS ok FROM red r JOIN documents d USING (doc_id)"
))
def sinks_read_back(spark, sf):
    """Redacted texts, full results and the vault written apart, read again, and the texts restored from the vault."""
    folder = shared_folder(spark, "sinks")
    done = anonymize(texts(spark, sf))
    sources.write_results(done, f"{folder}/results", ["doc_id"])
    sources.write_redacted(done, f"{folder}/redacted", ["doc_id"])
    sources.write_vault(scope.document_vault(done, "doc_id"), f"{folder}/vault")
    vault = sources.read_vault(spark, f"{folder}/vault")
    restored = restore_from_vault(spark.read.parquet(f"{folder}/redacted"), vault, "doc_id")
    results = spark.read.schema("doc_id bigint, result string").json(f"{folder}/results").select(
        "doc_id", F.get_json_object("result", "$.piiCount").cast("bigint").alias("pii_count")
    )
    return (
        restored.join(results, "doc_id").join(texts(spark, sf), "doc_id")
        .select("doc_id", "anonymized", "pii_count", F.col("restored").eqNullSafe(F.col("text")).alias("ok"))
    )


@register("config_names", (
    f"WITH s AS (SELECT c_custkey, c_name, {_NAME_TEXT} AS text FROM customer) SELECT c_custkey AS doc_id, CASE c_custkey % 4 "
    "WHEN 0 THEN 'Call [PERSON_NAME]; now' WHEN 1 THEN 'Call Customer#[USER_ID]. Now' WHEN 2 THEN '([PERSON_NAME])' ELSE 'xCustomer#[USER_ID] and [PERSON_NAME]' END "
    "AS anonymized, (SELECT count(*) FROM customer) + 1 AS names_loaded, 0 AS names_after_clear FROM s"
))
def config_names(spark, sf):
    """Every customer's name in a name file of a config that is loaded again and used."""
    folder, customers = shared_folder(spark, "config"), table(spark, sf, "customer")
    customers.select("c_name").write.text(f"{folder}/names")
    config = json.dumps({"names": ["Quentin Blackwood"], "nameFiles": ["names", "missing"]})
    spark.range(1).coalesce(1).select(F.lit(config)).write.text(f"{folder}/config")
    loaded = sources.load_config(spark, f"{folder}/config")
    about = customers.selectExpr("c_custkey AS doc_id", f"{_NAME_TEXT} AS text")
    done = anonymize(about, detectors=["ipv4"], dictionaries=loaded.dictionaries)
    cleared = loaded.dictionaries.clear().stats()["customNames"]
    return done.select(
        "doc_id", "anonymized", F.lit(loaded.names_loaded).cast("bigint").alias("names_loaded"),
        F.lit(cleared).alias("names_after_clear"),
    )


@register("file_scan", (
    "WITH s AS (SELECT unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM documents), "
    f"l AS (SELECT row_number() OVER () AS lid, line FROM s), {sql.raw_hits(NameLists(), 'l', 'lid', 'line')} "
    "SELECT detector, count(*) AS n_found FROM raw GROUP BY detector "
    "UNION ALL SELECT 'lines', count(*) FROM l"
))
def file_scan(spark, sf):
    """The corpus written as text files, scanned line by line as a directory."""
    folder = shared_folder(spark, "files")
    texts(spark, sf).select(F.coalesce("text", F.lit(""))).write.text(folder)
    lines = sources.read_texts(spark, folder, whole=False)
    found = findings(lines, ["file"], raw=True)
    counts = found.groupBy("detector").agg(F.count(F.lit(1)).alias("n_found"))
    return counts.union(lines.select(F.lit("lines").alias("detector")).groupBy("detector").agg(F.count(F.lit(1)).alias("n_found")))


def _event_stream(spark, sf) -> DataFrame:
    schema = spark.read.parquet(f"{sf}/events.parquet").schema
    stream = spark.readStream.schema(schema).parquet(f"{sf}/event[s].parquet")  # a pattern: the table can be one file
    return stream.selectExpr("event_id", "cast(ts AS timestamp) AS ts", "user_id", f"{_EVENT_TEXT} AS text")


def _through(stream: DataFrame, folder: str) -> DataFrame:
    """What an ``availableNow`` run of the stream appends to a table."""
    job = stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{folder}/progress")
    job.trigger(availableNow=True).start(f"{folder}/rows").awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{folder}/rows")


@register("stream_redaction", (
    "SELECT event_id, coalesce(props, '') || ' ' || CASE event_id % 3 WHEN 0 THEN 'mail [EMAIL]' WHEN 1 THEN 'host [IP_ADDRESS] up' "
    "ELSE 'nothing here' END AS anonymized, "
    "event_id % 3 = 2 AS clean FROM events"
))
def stream_redaction(spark, sf):
    """Events redacted and gated as a stream, then read as a table: both lanes of the gate."""
    folder = shared_folder(spark, "stream")
    job = jobs.gate_stream(
        _event_stream(spark, sf), "event_id", f"{folder}/clean", f"{folder}/quarantine", f"{folder}/vault", f"{folder}/progress"
    )
    job.trigger(availableNow=True).start().awaitTermination()
    lanes = [
        spark.read.parquet(f"{folder}/{lane}").select("event_id", "anonymized", F.lit(lane == "clean").alias("clean"))
        for lane in ("clean", "quarantine")
    ]
    return lanes[0].union(lanes[1])


@register("stream_first_findings", (
    f"WITH {_EVENT_HITS} SELECT DISTINCT user_id, placeholder, CASE placeholder WHEN 'EMAIL' THEN 'u' || cast(user_id as string) || '@example.com' "
    "ELSE '10.0.0.' || cast(user_id % 200 as string) END AS found FROM e"
))
def stream_first_findings(spark, sf):
    """Each finding of a user once, deduplicated while streaming (the lateness covers the whole table)."""
    found = findings(_event_stream(spark, sf), ["event_id", "ts", "user_id"])
    once = jobs.first_findings(found.withColumnRenamed("value", "found"), ["user_id", "placeholder", "found"], "ts", "4000 days")
    return _through(once.select("user_id", "placeholder", "found"), shared_folder(spark, "first"))


@register("stream_scope_numbering", (
    f"{_TURN_HITS}, {sql.tagged('conv_id', 'pos', always_numbered=True)}, {sql.rendered('cid', 'c')} "
    "SELECT conv_id, turn, anonymized, n AS n_found FROM red JOIN c USING (cid)"
))
def stream_scope_numbering(spark, sf):
    """Turns of a conversation share their numbering, handed out by keyed state while the turns stream in."""
    schema = table(spark, sf, "conversations").schema
    stream = conversation_turns(spark.readStream.schema(schema).parquet(f"{sf}/conversation[s].parquet"))
    setting = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(setting, None)
    spark.conf.set(setting, numbering.PROVIDER)
    try:
        done = _through(
            numbering.redact_scope_stream(stream, "conv_id", "turn", ["conv_id", "turn"]), shared_folder(spark, "numbers")
        )
    finally:
        spark.conf.unset(setting) if before is None else spark.conf.set(setting, before)
    found = F.size(F.regexp_extract_all("anonymized", F.lit(r"\[[A-Z_]+_[0-9]+\]"), F.lit(0)))
    return done.select("conv_id", "turn", "anonymized", found.cast("bigint").alias("n_found"))


FILE_TEXTS = 100


@register("large_file_findings", (
    f"WITH b AS (SELECT doc_id // {FILE_TEXTS} AS bucket, string_agg(coalesce(text, '') || chr(10), '' ORDER BY doc_id) AS body FROM documents GROUP BY 1), "
    f"{sql.raw_hits(NameLists(), 'b', 'bucket', 'body')} "
    "SELECT bucket, detector, start, value, 1 + length(substr(body, 1, start)) - length(replace(substr(body, 1, start), chr(10), '')) AS line "
    "FROM raw JOIN b USING (bucket)"
))
def large_file_findings(spark, sf):
    """The corpus as text files of many documents each, searched in overlapping chunks: places and lines in the whole file."""
    folder = shared_folder(spark, "large")
    lines = texts(spark, sf).select(F.floor(F.col("doc_id") / FILE_TEXTS).alias("bucket"), "doc_id", F.coalesce("text", F.lit("")).alias("value"))
    ordered = lines.repartition("bucket").sortWithinPartitions("bucket", "doc_id")
    ordered.select("bucket", "value").write.partitionBy("bucket").text(folder)
    found = large_files.file_findings(spark, f"{folder}/bucket=*/*.txt", raw=True)
    return found.select(
        F.regexp_extract("file", r"bucket=(-?[0-9]+)/", 1).cast("bigint").alias("bucket"), "detector", F.col("start").cast("bigint").alias("start"),
        "value", F.col("line").cast("bigint").alias("line"),
    )
