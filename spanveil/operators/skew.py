"""Joins whose left side may have a few keys with a large part of all rows, and intermediate tables that are kept."""

from __future__ import annotations

import tempfile
import uuid
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HOT_ROWS = 100_000
HOT_KEYS = 10_000


def shared_folder(spark, name: str) -> str:
    """A new folder below ``spark.checkpoint.dir``, which driver and executors share.

    A local session without that setting (tests) takes a temporary folder; a cluster session must set it.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="spanveil-shared-")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def kept(df: DataFrame) -> DataFrame:
    """The rows computed once and written to the checkpoint folder, which survives the loss of executors.

    The folder is the session's ``spark.checkpoint.dir``; where that is unset, a local session takes a new temporary
    folder and a cluster session must set it (a machine-local folder would be lost with its machine).
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="spanveil-checkpoint-"))
    return df.checkpoint(eager=True)


def null_safe_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner", small: bool = False) -> DataFrame:
    """Join on ``keys`` where NULL equals NULL; the columns of a ``join(right, keys, how)``."""
    names = {k: f"__same_{i}" for i, k in enumerate(keys)}
    other = right.select(
        *[F.col(k).alias(names[k]) for k in keys], *[F.col(c) for c in right.columns if c not in names]
    )
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(names[k])) for k in keys])
    joined = left.join(F.broadcast(other) if small else other, same, how)
    if how in ("left_semi", "left_anti"):
        return joined
    return joined.select(
        *[F.col(c) for c in keys], *[F.col(c) for c in left.columns if c not in names],
        *[F.col(c) for c in right.columns if c not in names],
    )


def of_unique_keys(per_text: DataFrame, texts: DataFrame, keys: list[str], column: str) -> DataFrame:
    """``per_text`` (what belongs to the texts with these keys), failing if a key is NULL or several texts have it.

    Otherwise one text's spans would be applied to another. Only the keys are counted and shuffled.
    """
    counts = texts.groupBy(*keys).agg(F.count(F.lit(1)).alias("__texts"))
    no_key = reduce(lambda a, b: a | b, [F.col(k).isNull() for k in keys])
    problem = F.raise_error(F.lit(f"texts need unique keys that are not NULL: {', '.join(keys)}"))
    checked = F.when((F.col("__texts") > 1) | no_key, problem.cast(per_text.schema[column].dataType)).otherwise(F.col(column))
    return null_safe_join(per_text, counts, keys).withColumn(column, checked).drop("__texts")


def lookup_join(
    left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner",
    hot_rows: int = HOT_ROWS, hot_keys: int = HOT_KEYS,
) -> DataFrame:
    """Join of ``left`` (any skew) to ``right`` (at most one row per key), inner or left; NULL keys meet NULL keys.
    ``left`` is read up to three times: pass a kept table, or one that is cheaper to compute again than to write.

    The heaviest keys are few by construction: at most ``hot_keys`` of them, each with ``hot_rows`` rows or more. Their
    rows of ``right`` (no more than ``hot_keys``) are broadcast, so their left rows stay where they are. Every other key
    has a small share of the rows and goes through a shuffled join.
    """
    hot = (
        left.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") >= hot_rows)
        .orderBy(F.desc("__n"), *keys).limit(hot_keys).select(*keys)
    )
    hot = kept(hot)
    if hot.isEmpty():
        return null_safe_join(left, right, keys, how)
    of_hot = null_safe_join(right, hot, keys, "left_semi", small=True)
    in_hot = null_safe_join(left, hot, keys, "left_semi", small=True)
    rest = null_safe_join(left, hot, keys, "left_anti", small=True)
    return null_safe_join(in_hot, of_hot, keys, how, small=True).unionByName(null_safe_join(rest, right, keys, how))


def drop_kept(spark) -> None:
    """Delete the session's kept tables (they hold raw values). Call it when the results that read them are written."""
    context = spark.sparkContext
    folder = context.getCheckpointDir()
    if folder is None:
        return
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    files.delete(path, True)
    context.setCheckpointDir(path.getParent().toString())  # a new empty folder for what comes next
