"""Audit: entities with line, context and mask, severity and gate, counts and profiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanveil.functions.checks import mask_value, severity

AROUND = 30


def line_of(text: Column, value: Column) -> Column:
    """Line (from 1) of the value's first occurrence in the text."""
    head = F.left(text, F.instr(text, value) - 1)
    return F.length(head) - F.length(F.replace(head, F.lit("\n"), F.lit(""))) + 1


def context_of(text: Column, value: Column) -> Column:
    """30 characters either side of the value's first occurrence, on one line, with ``...`` where the text goes on."""
    at = F.instr(text, value) - 1
    start = F.greatest(at - AROUND, F.lit(0))
    stop = F.least(at + F.length(value) + AROUND, F.length(text))
    window = F.replace(F.substring(text, start + 1, stop - start), F.lit("\n"), F.lit(" "))
    return F.concat(
        F.when(start > 0, "...").otherwise(""), window, F.when(stop < F.length(text), "...").otherwise("")
    )


def entity_report(anonymized: DataFrame, keys: list[str], text_col: str = "text") -> DataFrame:
    """One row per entity of a text: type, value, tag, line, masked value, context.

    Line and context are found before the rows multiply, so the text is not copied per entity.
    """
    text = F.col(text_col)
    rows = F.transform(
        F.col("entities"),
        lambda e: F.struct(
            e["type"].alias("type"), e["value"].alias("value"), e["tag"].alias("placeholder"),
            line_of(text, e["value"]).alias("line"),
            mask_value(e["value"], e["type"]).alias("masked"),
            context_of(text, e["value"]).alias("context"),
        ),
    )
    return (
        anonymized.select(*keys, F.explode_outer(rows).alias("e")).where(F.col("e").isNotNull()).select(*keys, "e.*")
    )


def entities(anonymized: DataFrame, keys: list[str]) -> DataFrame:
    """One row per entity of a text: type, value, tag."""
    return (
        anonymized.select(*keys, F.explode_outer("entities").alias("e")).where(F.col("e").isNotNull())
        .select(*keys, F.col("e.type").alias("type"), F.col("e.value").alias("value"), F.col("e.tag").alias("placeholder"))
    )


def grouped_by_type(anonymized: DataFrame, keys: list[str]) -> DataFrame:
    """Per text and type: number of entities and their masked values, in order of appearance (grouped in the row)."""
    names = F.array_distinct(F.transform(F.col("entities"), lambda e: e["type"]))
    grouped = F.transform(
        names,
        lambda kind, i: F.struct(
            kind.alias("type"), i.alias("position"),
            F.transform(
                F.filter(F.col("entities"), lambda e: e["type"] == kind), lambda e: mask_value(e["value"], e["type"])
            ).alias("masked"),
        ),
    )
    return (
        anonymized.select(*keys, F.explode_outer(grouped).alias("g")).where(F.col("g").isNotNull())
        .select(*keys, "g.type", "g.position", F.size("g.masked").alias("n_entities"), "g.masked")
    )


def type_counts(anonymized: DataFrame, keys: list[str] = ()) -> DataFrame:
    """Distinct entities (tags) per type, over the given keys; counted per text and summed, so the shuffle is small."""
    return (
        entities(anonymized, list(keys)).groupBy(*keys, "type").agg(F.count(F.lit(1)).alias("n_entities"))
    )


def with_verdict(anonymized: DataFrame) -> DataFrame:
    """Add ``severity`` (HIGH, MEDIUM or NULL) and ``clean``."""
    return anonymized.withColumns(
        {
            "severity": severity(F.col("detected_types"), F.col("count")),
            "clean": F.col("count") == 0,
        }
    )


def text_summary(anonymized: DataFrame, keys: list[str], text_col: str = "text") -> DataFrame:
    """One row per text: count, clean, detected types and the list of findings (type, value, tag, line)."""
    text = F.col(text_col)
    found = F.transform(
        F.col("entities"),
        lambda e: F.struct(
            e["type"].alias("type"), e["value"].alias("value"), e["tag"].alias("placeholder"),
            line_of(text, e["value"]).alias("line"),
        ),
    )
    return anonymized.select(
        *keys, F.col("count").alias("pii_count"), (F.col("count") == 0).alias("clean"), "detected_types",
        found.alias("findings"),
    )


def with_lane(anonymized: DataFrame) -> DataFrame:
    """Add the verdict and ``lane`` (clean or quarantine): write it with ``partitionBy("lane")`` to split in one pass."""
    return with_verdict(anonymized).withColumn("lane", F.when(F.col("clean"), "clean").otherwise("quarantine"))


def gate(anonymized: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """Clean rows and quarantined rows as two tables (both with the verdict). Using both from the same unwritten input
    computes it twice; ``with_lane`` does not."""
    judged = with_verdict(anonymized)
    columns = [*keys, "anonymized", "count", "detected_types", "severity"]
    return judged.where("clean").select(*columns), judged.where("NOT clean").select(*columns)


def gate_passes(anonymized: DataFrame) -> bool:
    """Whether no text holds personal data; stops at the first one that does."""
    return anonymized.where(F.col("count") > 0).select(F.lit(1)).isEmpty()


def profile(occurrences: DataFrame, dims: list[str]) -> DataFrame:
    """Occurrences per dimension and type with subtotals; ``level`` (the grouping id) tells a subtotal from a row whose
    dimension is NULL. Counted first, so that only totals are expanded for the subtotals and no source, however large,
    meets in one task."""
    counts = occurrences.groupBy(*dims, "placeholder").agg(F.count(F.lit(1)).alias("n"))
    return counts.rollup(*dims, "placeholder").agg(F.sum("n").alias("n_found"), F.grouping_id().alias("level"))


def rates(occurrences: DataFrame, texts: DataFrame, keys: list[str], dims: list[str]) -> DataFrame:
    """Per dimension, with subtotals (``level`` as above): texts, texts with a finding, findings, findings per text.

    Findings are counted per text first (``keys`` name a text), then both tables are added up before the subtotals, so
    only totals meet; NULL dimensions are groups like any other.
    """
    found = occurrences.groupBy(*dims, *keys).agg(F.count(F.lit(1)).alias("n")).groupBy(*dims).agg(
        F.sum("n").alias("n_found"), F.count(F.lit(1)).alias("n_hit"), F.lit(0).cast("bigint").alias("n_texts")
    )
    none = F.lit(0).cast("bigint")
    every = texts.groupBy(*dims).agg(F.count(F.lit(1)).alias("n_texts")).select(
        *dims, none.alias("n_found"), none.alias("n_hit"), "n_texts"
    )
    totals = found.select(*dims, "n_found", "n_hit", "n_texts").unionByName(every).rollup(*dims).agg(
        F.sum("n_texts").alias("n_texts"), F.sum("n_hit").alias("n_with_findings"), F.sum("n_found").alias("n_found"),
        F.grouping_id().alias("level"),
    )
    return totals.withColumn("per_text", F.col("n_found") / F.col("n_texts"))
