"""Reading texts and dictionaries, writing results."""

from __future__ import annotations

import json
from dataclasses import dataclass, replace

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanveil.operators.dictionaries import Dictionaries
from spanveil.operators.redact import anonymize


FEW_SPLITS = 8
ROWS_A_TASK = 500_000  # detectors take up to a millisecond a row, so a task takes minutes at most


def read_texts(spark: SparkSession, path: str, whole: bool = True) -> DataFrame:
    """One row per file (``whole``) or per line, with the file it came from. ``path`` may be a directory or glob."""
    return spark.read.text(path, wholetext=whole).select(
        F.col("_metadata.file_path").alias("file"), F.col("value").alias("text")
    )


def read_table(spark: SparkSession, path: str, key: str | None = None) -> DataFrame:
    """A parquet table; with ``key`` it is spread if its rows need more splits (one for each ``ROWS_A_TASK``, counted from the
    files' footers) or it has very few (``FEW_SPLITS``), so that text work is parallel and no task grows with the table: a
    split of narrow, well compressed rows can hold millions. Rows go by ``key``, or in turn where there are more tasks than
    cores, whatever the keys. All others, such as tables of long texts, are read as they are, without a shuffle.
    """
    df = spark.read.parquet(path)
    if key is None:
        return df
    cores, splits = spark.sparkContext.defaultParallelism, df.rdd.getNumPartitions()
    needed = -(-df.count() // ROWS_A_TASK)
    if splits >= max(needed, min(cores, FEW_SPLITS)):
        return df
    return df.repartition(needed) if needed > cores else df.repartition(cores, key)


def anonymize_columns(df: DataFrame, text_cols: list[str], **options) -> DataFrame:
    """Redact several string columns of a table; each gets ``<col>`` redacted in place and ``<col>_entities``."""
    for name in text_cols:
        kept = [c for c in df.columns]
        df = anonymize(df.withColumnRenamed(name, "__veil_in"), "__veil_in", **options)
        df = df.select(
            *[(F.col("anonymized").alias(name) if c == name else F.col(c)) for c in kept],
            F.col("entities").alias(f"{name}_entities"),
        )
    return df


def result_json() -> Column:
    """The full result of a row of ``anonymize`` as a JSON object."""
    return F.to_json(
        F.struct(
            "anonymized", F.col("entity_map").alias("entityMap"), F.col("count").alias("piiCount"),
            F.col("detected_types").alias("detectedTypes"),
        )
    )


def write_redacted(anonymized: DataFrame, path: str, keys: list[str]) -> None:
    """The redacted texts alone (no original, no map)."""
    anonymized.select(*keys, "anonymized").write.mode("errorifexists").parquet(path)


def write_results(anonymized: DataFrame, path: str, keys: list[str]) -> None:
    """Full results as JSON lines."""
    anonymized.select(*keys, result_json().alias("result")).write.mode("errorifexists").json(path)


def write_vault(vault: DataFrame, path: str) -> None:
    vault.write.mode("errorifexists").partitionBy("type").parquet(path)


def read_vault(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


# ------------------------------------------------------------------------------------------------ dictionary config
@dataclass(frozen=True)
class LoadedConfig:
    """What a config file held. Counts are lengths of the lists, not numbers of distinct entries."""

    loaded: bool
    dictionaries: Dictionaries
    names_loaded: int = 0
    patterns_loaded: int = 0
    files_loaded: int = 0
    error: str | None = None


def _beside(path: str, name: str) -> str:
    if name.startswith("/") or "://" in name:
        return name
    return path.rsplit("/", 1)[0] + "/" + name if "/" in path else name


def read_name_file(spark: SparkSession, path: str) -> DataFrame:
    """Names of a file with one name per line or separated by commas; shorter than two characters are left out."""
    return (
        spark.read.text(path)
        .select(F.explode(F.split("value", ",", -1)).alias("name"))
        .select(F.regexp_replace("name", r"^[\s\x{a0}\x{feff}]+|[\s\x{a0}\x{feff}]+$", "").alias("name"))
        .where(F.length("name") >= 2)
    )


def _word_list(spark: SparkSession, path: str) -> list[str]:
    """A word list for the plan, whole: it extends the built-in lists, which are literals."""
    return [r[0] for r in read_name_file(spark, path).collect()]


def load_config(spark: SparkSession, path: str, base: Dictionaries | None = None) -> LoadedConfig:
    """Load a JSON dictionary config: ``names``, ``nameFiles`` (relative to the config), ``patterns``.

    Names of files stay a table (``Dictionaries.names_table``), whatever their number, and are joined. Missing name
    files are skipped; a missing or malformed config, or one with a bad entry, gives ``loaded=False`` and the error, and
    none of it is used; a config that is no object holds nothing. Two further keys, ``firstNameFiles`` and
    ``lastNameFiles``, extend the word lists of the known-name detector.
    """
    dictionaries = base or Dictionaries()
    try:
        row = spark.read.text(path, wholetext=True).first()
        config = json.loads(row[0] if row else "")
        lists = {k: v for k, v in config.items() if isinstance(v, list)} if isinstance(config, dict) else {}
        names, patterns = lists.get("names", []), lists.get("patterns", [])
        dictionaries = dictionaries.add_names(names).add_patterns(patterns)
        merged, total, files = dictionaries.names_table, len(names), 0
        for name in lists.get("nameFiles", []):
            try:
                table = read_name_file(spark, _beside(path, name))
            except AnalysisException:
                continue
            total += table.count()
            files += 1
            merged = table if merged is None else merged.unionByName(table)
        more = {
            kind: [word for f in lists.get(key, []) for word in _word_list(spark, _beside(path, f))]
            for kind, key in (("first", "firstNameFiles"), ("last", "lastNameFiles"))
        }
        word_lists = dictionaries.lists.extended(more["first"], more["last"]) if any(more.values()) else dictionaries.lists
        dictionaries = replace(dictionaries, lists=word_lists, names_table=merged)
        return LoadedConfig(True, dictionaries, total, len(patterns), files)
    except (AnalysisException, AttributeError, TypeError, ValueError) as problem:
        return LoadedConfig(False, base or Dictionaries(), error=str(problem).split("\n")[0])
