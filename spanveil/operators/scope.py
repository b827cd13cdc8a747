"""Numbering entities over a wider scope than one text (a conversation, a source, the whole corpus), the vault table,
and redaction with those numbers.

A scope may hold a third of all rows, so nothing here gathers a scope. Occurrences are first reduced to entities (a
partial aggregate runs before the shuffle). The rank of an entity within its scope and type is found in two steps: a
window per (scope, type, bucket of positions) and the running count of the buckets before it. Buckets are ranges of
the order column, so a window never holds more than one bucket's entities however large the scope.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanveil.functions.checks import normal_value
from spanveil.functions.text import chunks_of, slice_text
from spanveil.operators.skew import lookup_join, null_safe_join, of_unique_keys

BUCKET_ROWS, BUCKETS = 100_000, 8192


def position_bounds(df: DataFrame, order: str, buckets: int | None = None) -> list:
    """Split points of the order column: ``buckets - 1`` approximate quantiles, a small list whatever the data. Their
    number follows from the rows (``BUCKET_ROWS`` to a bucket), up to ``BUCKETS``.

    Any bounds give the same numbers; even ones only keep the buckets even.
    """
    if buckets is None:
        buckets = min(-(-df.count() // BUCKET_ROWS), BUCKETS)
    if buckets <= 1:
        return []
    probabilities = [i / buckets for i in range(1, buckets)]
    found = df.approxQuantile(order, probabilities, 1.0 / (4 * buckets))
    return sorted({int(x) for x in found})


def bucket_of(value: Column, bounds: list) -> Column:
    """Number of bounds at or below ``value``."""
    if not bounds:
        return F.lit(0)
    edges, group = _literal_array(bounds), 32
    group_ends = bounds[group - 1 :: group]
    whole = F.size(F.filter(_literal_array(group_ends), lambda end: end <= value)) if group_ends else F.lit(0)
    rest = F.slice(edges, whole * group + 1, F.lit(group))
    return whole * group + F.size(F.filter(rest, lambda edge: edge <= value))


def _literal_array(values: list) -> Column:
    return F.array(*[F.lit(v).cast("bigint") for v in values])


def entities_in_scope(occurrences: DataFrame, scope: str | None, order: list[str]) -> DataFrame:
    """One row per (scope, type, normal form): first position and the last raw value.

    ``occurrences`` has the scope column, the order columns (a position within the scope, such as doc_id and start),
    ``placeholder`` and ``value``.
    """
    keys = [scope] if scope else []
    position = F.struct(*[F.col(c) for c in order])
    return (
        occurrences.withColumn("norm", normal_value(F.col("value"), F.col("placeholder")))
        .groupBy(*keys, "placeholder", "norm")
        .agg(
            F.min(position).alias("first_at"),
            F.max_by("value", position).alias("value"),
            F.count(F.lit(1)).alias("occurrences"),
        )
    )


def number_entities(
    entities: DataFrame, scope: str | None, bounds: list | None = None, always_numbered: bool = False
) -> DataFrame:
    """Add ``n`` (rank by first position within scope and type), ``n_entities`` of the type, and ``tag``.

    ``always_numbered`` leaves the number on a type's only entity, as a stream must, which can't know what is to come.
    ``bounds`` are the split points for the leading order column (see ``position_bounds``); none means one bucket.
    """
    keys = ([scope] if scope else []) + ["placeholder"]
    lead = F.col("first_at").getField(entities.schema["first_at"].dataType.fieldNames()[0])
    placed = entities.withColumn("__bucket", bucket_of(lead, bounds or []))
    in_bucket = Window.partitionBy(*keys, "__bucket").orderBy("first_at")
    ranked = placed.withColumn("__rank", F.row_number().over(in_bucket))
    sizes = placed.groupBy(*keys, "__bucket").agg(F.count(F.lit(1)).alias("__size"))
    before = Window.partitionBy(*keys).orderBy("__bucket")
    offsets = sizes.select(
        *keys, "__bucket",
        (F.sum("__size").over(before) - F.col("__size")).alias("__offset"),
        F.sum("__size").over(Window.partitionBy(*keys)).alias("n_entities"),
    )
    name = F.col("placeholder")
    numbered = F.concat(F.lit("["), name, F.lit("_"), F.col("n").cast("string"), F.lit("]"))
    single = (F.col("n_entities") == 1) & name.rlike(r"\A[A-Z_]+\z") & F.lit(not always_numbered)
    return (
        null_safe_join(ranked, offsets, [*keys, "__bucket"])
        .withColumn("n", F.col("__offset") + F.col("__rank"))
        .withColumn("tag", F.when(single, F.concat(F.lit("["), name, F.lit("]"))).otherwise(numbered))
        .drop("__bucket", "__rank", "__offset")
    )


def vault(numbered: DataFrame, scope: str | None = None) -> DataFrame:
    """The table to restore from: (scope, tag, type, value). Keep it apart from the redacted text."""
    keys = [scope] if scope else []
    return numbered.select(*keys, "tag", F.col("placeholder").alias("type"), "value")


def document_vault(anonymized: DataFrame, key: str) -> DataFrame:
    """The vault of per-text redaction: one row per text and tag, with the position of the tag's first value."""
    return (
        anonymized.select(key, F.explode_outer("entities").alias("e"))
        .where(F.col("e").isNotNull())
        .select(
            key, F.col("e.tag").alias("tag"), F.col("e.type").alias("type"),
            F.col("e.value").alias("value"), F.col("e.first").alias("first"),
        )
    )


def redact_in_scope(
    texts: DataFrame,
    occurrences: DataFrame,
    numbered: DataFrame,
    key: str | list[str],
    scope: str | None,
    text_col: str = "text",
    out: str = "anonymized",
) -> DataFrame:
    """Replace every occurrence in ``texts`` by the tag of its entity in the scope.

    ``occurrences`` are the resolved spans (``findings`` with the key and scope columns); they meet the numbered
    entities on (scope, type, normal form), heavy entities apart (see ``lookup_join``), and are gathered per text, which
    bounds a group by one text. Pass a kept table of occurrences so that the texts are searched only once.

    It never fails open: NULL is a scope like any other; an occurrence without a number, a NULL key, or a key of several
    texts raises an error when the result is computed.
    """
    key = [key] if isinstance(key, str) else key
    scope_keys = [scope] if scope else []
    keyed = occurrences.select(
        *dict.fromkeys([*key, *scope_keys]), "start", "end", "placeholder",
        normal_value(F.col("value"), F.col("placeholder")).alias("norm"),
    )
    tagged = lookup_join(
        keyed, numbered.select(*scope_keys, "placeholder", "norm", "tag"), [*scope_keys, "placeholder", "norm"], "left"
    )
    no_tag = F.raise_error(F.lit("an occurrence has no numbered entity")).cast("string")
    tagged = tagged.withColumn("tag", F.coalesce("tag", no_tag))
    per_text = tagged.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("start", "end", "tag"))).alias("__spans"))
    per_text = of_unique_keys(per_text, texts, key, "__spans")
    joined = null_safe_join(texts, per_text, key, "left").withColumn("__chunks", chunks_of(F.col(text_col)))
    spans, chunks = F.col("__spans"), F.col("__chunks")

    def from_end(i: Column) -> Column:
        return F.when(i == 0, 0).otherwise(F.get(spans, i - 1)["end"])

    pieces = F.transform(
        spans,
        lambda s, i: F.concat(slice_text(chunks, from_end(i), s["start"] - from_end(i)), s["tag"]),
    )
    tail = from_end(F.size(spans))
    redacted = F.concat(F.array_join(pieces, ""), slice_text(chunks, tail, F.length(F.col(text_col)) - tail))
    return joined.withColumn(
        out, F.when(spans.isNull(), F.coalesce(F.col(text_col), F.lit(""))).otherwise(redacted)
    ).drop("__spans", "__chunks")
