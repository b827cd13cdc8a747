"""Exact duplicates by a tree merge of sorted digest runs. DataFrame functions only.

Every input partition is a run of digests. In each round a run goes to the partner whose number it shares without the
last digits in base ``fan_in`` (a binomial tree for 2; larger values merge several runs at once). The merge sorts by
digest and keeps, for each digest, the smallest identifier with its proof: a 64-bit digest orders the runs, and entries
are joined only where the SHA-256 of the text agrees too, at every level. A text that a third of all rows share has one
entry per run, and a ``fan_in``-th of that after each round, so no task ever holds its rows. The aggregate's buffer is a
struct, which Spark merges by sort: sorted partial runs, a sort shuffle, a merging aggregate.

Nulls and ties: a null text counts as empty; rows with a null id are kept only if their group has no id at all; of rows
that repeat both id and text one stays. An empty table gives an empty result. Only the id and the text are read, so
further columns of any name do no harm.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanveil.llm.common import column, kept, text_of

FAN_IN = 8


def normalised(text: Column) -> Column:
    """Each run of white space becomes one space."""
    return F.regexp_replace(text, r"[\x20\x09-\x0D]+", " ")


def digest_rows(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One narrow row per document: id, row (unique), run, digest, sha. No text leaves the scan."""
    return docs.select(
        column(id_column).alias("id"), normalised(text_of(text_column)).alias("text")
    ).select(
        "id",
        F.monotonically_increasing_id().alias("row"),
        F.spark_partition_id().alias("run"),
        F.xxhash64("text").alias("digest"),
        F.sha2("text", 256).alias("sha"),
    )


def merged_runs(rows: DataFrame, fan_in: int = FAN_IN) -> DataFrame:
    """digest, sha, best (the smallest identifier) and n (rows), by rounds of merging; ``rows`` is a kept table."""
    if fan_in < 2:
        raise ValueError("fan_in must be 2 or more")
    runs = (rows.agg(F.max("run")).first()[0] or 0) + 1
    level = rows.select(
        "run", "digest", "sha", F.struct(F.col("id").isNull().alias("no_id"), "id", "row").alias("best"),
        F.lit(1).cast("bigint").alias("n"),
    )
    while True:
        runs = -(-runs // fan_in)
        level = (
            level.withColumn("run", (F.col("run") / fan_in).cast("int"))
            .groupBy("run", "digest", "sha").agg(F.min("best").alias("best"), F.sum("n").alias("n"))
        )
        if runs == 1:
            return level.select("digest", "sha", "best", "n")


def exact_duplicates(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", fan_in: int = FAN_IN
) -> DataFrame:
    """One row per document: id, keep_id, group_size, kept, sha.

    The lookup of each row's group is a plain join, so that Spark's adaptive execution splits the rows of a hot digest
    among tasks (the other side has one row per digest).
    """
    rows = kept(digest_rows(docs, id_column, text_column))
    return rows.join(merged_runs(rows, fan_in), ["digest", "sha"]).select(
        F.col("id"),
        F.col("best.id").alias("keep_id"),
        F.col("n").alias("group_size"),
        (F.col("row") == F.col("best.row")).alias("kept"),
        "sha",
    )
