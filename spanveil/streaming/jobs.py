"""The operators on Structured Streaming. Redaction is stateless, so ``anonymize`` and ``findings`` work on a stream as
they are; here are the stateful parts and the sinks."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from spanveil.functions.checks import normal_value
from spanveil.operators.audit import with_verdict
from spanveil.operators.redact import anonymize
from spanveil.operators.scope import document_vault


def redact_stream(stream: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """Redact a stream row by row (append mode, no state)."""
    return anonymize(stream, text_col, **options)


def gate_stream(
    stream: DataFrame, key: str, clean_path: str, quarantine_path: str, vault_path: str, checkpoint: str,
    text_col: str = "text", **options,
) -> DataStreamWriter:
    """Split a stream into clean rows, quarantined rows and the vault. Each batch lands under its batch number, so a
    batch that is run again after a failure replaces its own output."""
    redacted = with_verdict(redact_stream(stream, text_col, **options)).drop(text_col)

    def write(batch: DataFrame, number: int) -> None:
        kept = batch.persist()
        try:
            part = f"batch={number}"
            columns = [key, "anonymized", "count", "detected_types", "severity"]
            kept.where("clean").select(*columns).write.mode("overwrite").parquet(f"{clean_path}/{part}")
            kept.where("NOT clean").select(*columns).write.mode("overwrite").parquet(f"{quarantine_path}/{part}")
            document_vault(kept, key).write.mode("overwrite").parquet(f"{vault_path}/{part}")
        finally:
            kept.unpersist()

    return redacted.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)


def rate_per_window(
    occurrences: DataFrame, time_col: str, width: str, slide: str | None = None, lateness: str = "10 minutes"
) -> DataFrame:
    """Findings per tumbling or sliding window and type; rows later than ``lateness`` are dropped on a stream."""
    window = F.window(time_col, width, slide) if slide else F.window(time_col, width)
    return (
        occurrences.withWatermark(time_col, lateness)
        .groupBy(window.alias("window"), "placeholder")
        .agg(F.count(F.lit(1)).alias("n_found"))
        .select(
            F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), "placeholder", "n_found"
        )
    )


def rate_per_session(
    occurrences: DataFrame, time_col: str, user_col: str, gap: str, lateness: str = "10 minutes"
) -> DataFrame:
    """Findings per user session (a session ends after ``gap`` without a finding).

    On a stream this is a session window. On a table a session window would bring all rows of a user to one task; there
    sessions are built per user and slice of time first, and only those partial sessions meet per user.
    """
    if occurrences.isStreaming:
        return (
            occurrences.withWatermark(time_col, lateness)
            .groupBy(F.session_window(time_col, gap).alias("session"), user_col)
            .agg(F.count(F.lit(1)).alias("n_found"))
            .select(
                user_col, F.col("session.start").alias("session_start"), F.col("session.end").alias("session_end"),
                "n_found",
            )
        )
    pause = F.expr(f"INTERVAL {gap}")

    def merged(rows: DataFrame, by: list[str]) -> DataFrame:
        """Join neighbouring partial sessions that are at most the gap apart, as a session window does."""
        order = Window.partitionBy(*by).orderBy("first_ts", "last_ts")
        before = order.rowsBetween(Window.unboundedPreceding, -1)
        fresh = (F.col("first_ts") > F.max("last_ts").over(before) + pause) | F.max("last_ts").over(before).isNull()
        marked = rows.withColumn("__no", F.sum(fresh.cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
        return marked.groupBy(*by, "__no").agg(
            F.min("first_ts").alias("first_ts"), F.max("last_ts").alias("last_ts"), F.sum("n").alias("n")
        ).drop("__no")

    points = occurrences.groupBy(user_col, F.col(time_col).alias("first_ts")).agg(F.count(F.lit(1)).alias("n"))
    sliced = points.withColumn("last_ts", F.col("first_ts")).withColumn("__slice", F.date_trunc("hour", "first_ts"))
    partial = merged(sliced, [user_col, "__slice"])
    return merged(partial.drop("__slice"), [user_col]).select(
        user_col, F.col("first_ts").alias("session_start"), (F.col("last_ts") + pause).alias("session_end"),
        F.col("n").alias("n_found"),
    )


def first_findings(occurrences: DataFrame, keys: list[str], time_col: str, lateness: str = "10 minutes") -> DataFrame:
    """Each (keys) once: on a stream the first to arrive within the watermark, on a table the earliest row.

    A table has no late rows, so ``lateness`` doesn't matter there; equal times are settled by the other columns.
    """
    if occurrences.isStreaming:
        return occurrences.withWatermark(time_col, lateness).dropDuplicatesWithinWatermark(keys)
    rest = [time_col, *[c for c in occurrences.columns if c not in (*keys, time_col)]]
    first = occurrences.groupBy(*keys).agg(F.min(F.struct(*rest)).alias("__first")).select(*keys, "__first.*")
    return first.select(*occurrences.columns)


def with_stable_tag(occurrences: DataFrame, secret: str) -> DataFrame:
    """A tag that needs no state and is the same for an entity everywhere: HMAC-SHA-256 under a secret, whole."""
    key = secret.encode() if len(secret.encode()) <= 64 else hashlib.sha256(secret.encode()).digest()
    key = key.ljust(64, b"\0")
    inner, outer = (F.lit(bytearray(b ^ pad for b in key)) for pad in (0x36, 0x5C))
    norm = normal_value(F.col("value"), F.col("placeholder"))
    message = F.concat(F.col("placeholder"), F.lit("|"), norm).cast("binary")
    digest = F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, message), 256))), 256)
    return occurrences.withColumn("tag", F.concat(F.lit("["), F.col("placeholder"), F.lit("_"), digest, F.lit("]")))
