"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import re
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanveil.operators.skew import kept, shared_folder

__all__ = ["WORD", "column", "freed", "kept", "packed", "read_table", "removed", "setting", "shared_folder", "shuffles_freed", "text_of", "unpacked", "words_of"]

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"  # after A-Z became a-z: letters, digits and everything beyond ASCII
_UPPER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}
_WORDS = re.compile(WORD)


def column(name: str) -> Column:
    """A column by its exact name, dots and blanks included."""
    return F.col("`" + name.replace("`", "``") + "`")


def text_of(name: str) -> Column:
    """The whole text; null counts as empty."""
    return F.coalesce(column(name).cast("string"), F.lit(""))


def packed(docs: DataFrame) -> Column:
    """The whole row as one struct ``doc``, so that no column of it can clash with an operator's own."""
    return F.struct(*[column(c) for c in docs.columns]).alias("doc")


def unpacked(rows: DataFrame, columns: list[str]) -> DataFrame:
    return rows.select(*[F.col("doc")[c].alias(c) for c in columns])


def words_of(text: str | None) -> list[str]:
    """Lower-case words of one text, for Python workers."""
    return _WORDS.findall((text or "").translate(_UPPER) if not (text or "").isascii() else (text or "").lower())


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def removed(spark: SparkSession, folder: str) -> None:
    """Delete a folder that was made by ``shared_folder``."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def freed(rows: DataFrame) -> None:
    """Delete the files of a table that ``kept`` returned and nothing reads any more."""
    removed(rows.sparkSession, rows._jdf.queryExecution().analyzed().rdd().getCheckpointFile().get())


@contextmanager
def setting(spark: SparkSession, name: str, value: str):
    """Within it, the session's setting has this value."""
    before = spark.conf.get(name, None)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def shuffles_freed(spark: SparkSession):
    """Within it, Spark deletes the shuffle files of a job when the job ends. For chains of jobs that each end in a kept
    table: their shuffles are not read again, but otherwise stay on disk until the driver's next full collection."""
    return setting(spark, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")
