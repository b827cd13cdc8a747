"""Distinct entities over any amount of text, by mergeable sketches.

A sketch (HyperLogLog) of a few KB stands for all entities of one type in one group of texts. Sketches are stored and
united: over other groupings, and with the sketches of texts that came later, so no text is read again. Two spellings of
an entity count once (its normal form); the sketches hold hashes, not values.

The relative standard error is about 1.04 / sqrt(2 ** lg_k), 0.8 % for 14. NULL dimensions are groups like any other; no
occurrences give no sketches.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanveil.functions.checks import normal_value

LG_K = 14


def entity_sketches(occurrences: DataFrame, dims: list[str], lg_k: int = LG_K) -> DataFrame:
    """dims, placeholder, sketch: one sketch per group and type. ``occurrences`` are those of ``findings``; each task
    makes its own sketches, so a group of any size moves a few KB for each task."""
    norm = normal_value(F.col("value"), F.col("placeholder"))
    return occurrences.groupBy(*dims, "placeholder").agg(F.hll_sketch_agg(norm, lg_k).alias("sketch"))


def united(sketches: DataFrame, dims: list[str]) -> DataFrame:
    """Sketches of fewer dimensions, or of several tables put together with ``unionByName``."""
    return sketches.groupBy(*dims, "placeholder").agg(F.hll_union_agg("sketch").alias("sketch"))


def with_increment(stored: DataFrame, occurrences: DataFrame, dims: list[str], lg_k: int = LG_K) -> DataFrame:
    """The stored sketches with those of new occurrences; texts already counted are not read."""
    return united(stored.select(*dims, "placeholder", "sketch").unionByName(entity_sketches(occurrences, dims, lg_k)), dims)


def distinct_counts(sketches: DataFrame) -> DataFrame:
    """``n_distinct`` (estimated) in place of the sketch."""
    return sketches.withColumn("n_distinct", F.hll_sketch_estimate("sketch")).drop("sketch")
