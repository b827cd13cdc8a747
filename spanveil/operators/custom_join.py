"""User names as a table: the join form of the custom name detector, for lists too long for a literal set.

A name stands between neighbour characters, so it is a run of whole pieces of the lower-cased text cut at those
characters. Runs of the lengths that occur in the name table are joined to it on the run itself: a run meets at most
one name, and nothing is paired beyond that.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanveil.functions.text import chunks_of, empty_array, scan, slice_text, strip
from spanveil.operators.skew import lookup_join, of_unique_keys
from spanveil.operators.spans import NEIGHBOUR_CLASS, SPAN, same_length_lower

BROADCAST_BYTES = 128 << 20
ROW_OVERHEAD = 64


def prepare_names(names: DataFrame, name_col: str = "name") -> DataFrame:
    """Lower-cased, trimmed, distinct, non-blank names with the number of pieces and whether a name can overlap itself."""
    cleaned = names.select(strip(same_length_lower(F.col(name_col))).alias("name")).where("name <> ''").distinct()
    size = F.length("name")
    overlaps = F.when(
        size > 1,
        F.exists(F.sequence(F.lit(1), size - 1), lambda k: F.left("name", k) == F.right("name", k)),
    ).otherwise(False)
    pieces = F.size(F.split("name", NEIGHBOUR_CLASS, -1))
    return cleaned.select("name", pieces.alias("pieces"), ((pieces > 1) & overlaps).alias("self_overlap"))


def custom_name_hits(texts: DataFrame, key: str, names: DataFrame, text_col: str = "text") -> DataFrame:
    """Rows (key, start, len) of every accepted occurrence of a name of ``names`` (see ``prepare_names``)."""
    # The piece counts that occur: as many small integers as the longest name has pieces.
    lengths = [r[0] for r in names.select("pieces").distinct().collect()]
    if not lengths:
        return texts.select(key, F.lit(0).alias("start"), F.lit(0).alias("len")).where(F.lit(False))
    size = names.agg(
        F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(F.octet_length("name")), F.lit(0)).alias("bytes")
    ).first()
    fits = size["bytes"] + ROW_OVERHEAD * size["rows"] <= BROADCAST_BYTES

    low = texts.select(F.col(key), same_length_lower(F.coalesce(F.col(text_col), F.lit(""))).alias("low"))
    pieces = F.split("low", NEIGHBOUR_CLASS, -1)
    starts = scan(pieces, F.lit(0), emit=lambda pos, p: pos, step=lambda pos, p: pos + F.length(p) + 1)
    parts = F.zip_with(
        pieces, starts,
        lambda p, s: F.struct(s.cast("int").alias("s"), (s + F.length(p)).cast("int").alias("e")),
    )
    cut = low.withColumn("parts", parts).withColumn("chunks", chunks_of(F.col("low")))

    def runs(width: int) -> Column:
        return F.transform(
            F.slice("parts", 1, F.greatest(F.size("parts") - (width - 1), F.lit(0))),
            lambda p, i: F.struct(
                p["s"].alias("start"), F.lit(width).alias("pieces"),
                slice_text(F.col("chunks"), p["s"], F.get(F.col("parts"), i + (width - 1))["e"] - p["s"]).alias("name"),
            ),
        )

    candidates = cut.select(key, F.explode_outer(F.concat(*[runs(n) for n in sorted(lengths)])).alias("r")).where(
        F.col("r.name") != ""
    ).select(key, "r.*")
    # Without a broadcast, everyday words would be hot keys of the join; they are joined apart.
    keys = ["name", "pieces"]
    met = candidates.join(F.broadcast(names), keys) if fits else lookup_join(candidates, names, keys)
    found = met.select(
        key, "start", F.length("name").alias("len"), "name", "self_overlap"
    )
    simple = found.where("NOT self_overlap").select(key, "start", "len")

    # A name that can overlap itself: walk its occurrences in the text, boundaries or not, and keep those the walk meets.
    walk = scan(
        F.split("low", F.concat(F.lit("\\Q"), F.col("name"), F.lit("\\E")), -1), F.lit(0),
        emit=lambda pos, gap: pos + F.length(gap),
        step=lambda pos, gap: pos + F.length(gap) + F.length("name"),
    ).cast("array<int>")
    special = (
        found.where("self_overlap").groupBy(key, "name").agg(F.array_sort(F.collect_set("start")).alias("starts"))
        .join(low, key)
        .withColumn("met", F.array_intersect("starts", walk))
        .select(key, F.explode("met").alias("start"), F.length("name").alias("len"))
    )
    return simple.unionByName(special)


def with_custom_name_spans(
    texts: DataFrame, key: str, names: DataFrame, text_col: str = "text", out: str = "name_spans"
) -> DataFrame:
    """Add the accepted name occurrences of each text as spans, ready for ``anonymize(extra_spans=...)``."""
    hits = custom_name_hits(texts, key, names, text_col)
    per_text = hits.groupBy(key).agg(
        F.collect_list(
            F.struct(F.col("start"), F.col("len").alias("rank"), F.col("len"), F.lit(1).alias("seq"))
        ).alias(out)
    )
    per_text = of_unique_keys(per_text, texts, [key], out)
    return texts.join(per_text, key, "left").withColumn(
        out, F.coalesce(F.col(out).cast(f"array<{SPAN}>"), empty_array(SPAN))
    )
