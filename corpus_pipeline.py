"""From raw documents to token files: quality, near copies, benchmark leaks, mixing, token ids.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it works on all its predecessor kept. All but the last
return the columns of ``docs``. ``run`` writes every stage's rows as Parquet in the shared folder and reads them again,
so a lost executor costs a stage at most.

Nulls and ties are those of the operators: null texts count as empty; an empty text scores the share of good labels and
is in no class of near copies; rows that repeat id and text are one class; an empty table passes through as empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from spanveil.llm import chosen_path, decontaminate, mixing, quality, token_files
from spanveil.llm.common import read_table, shared_folder


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the nearest labelled neighbours hold good."""
    return quality.accepted(docs, read_table(spark, sf_dir, "labels"))


def near_copies_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies: the one with the smallest id."""
    return chosen_path.without_near_copies(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of the benchmark."""
    return decontaminate.without_leaks(docs, read_table(spark, sf_dir, "benchmark"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it."""
    return mixing.mixed(docs)


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files; per document their start, n_tokens and ids_crc32, read back from the files."""
    path = shared_folder(spark, "tokens")
    token_files.write_token_files(docs, path)
    return token_files.token_index(spark, path)


STAGES = [
    ("quality", quality_stage),
    ("near copies", near_copies_stage),
    ("decontamination", decontamination_stage),
    ("mixing", mixing_stage),
    ("token files", token_stage),
]

ORACLE_SQL = None  # the first stage learns a model; tests/llm compares the stages with brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = shared_folder(spark, "stage-" + name.replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
