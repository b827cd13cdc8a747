"""Text files of any size, searched in parallel with offsets and lines of the whole file.

A file is read line by line in as many splits as it has blocks, so no task holds it and no 2 GB limit applies. Sums of
characters and lines per split, added up over the few splits of a file, give every line its place. Lines (long ones in
pieces) are gathered into chunks of ``chunk`` characters with ``overlap`` characters of their neighbours on both sides; a span
belongs to the chunk whose core it starts in, so one that crosses an edge is found once.

The result is that of the whole text wherever detectors need no more than ``overlap`` characters around a span (the built-in
ones look at 200 at most) and no chain of overlapping spans is longer than that.

Nulls and ties: files have neither; an empty file has no findings. Lines end at line feeds; a carriage return stays a
character of its line.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spanveil.operators.redact import findings

CHUNK, OVERLAP, PIECE = 1 << 16, 1 << 12, 1 << 12


def placed_pieces(spark: SparkSession, path: str, piece: int = PIECE) -> DataFrame:
    """file, at (place of the first character in the file, from 0), line (from 1), body: lines, long ones cut, each but a cut one
    with its line feed."""
    rows = spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("no"), F.concat("value", F.lit("\n")).alias("body"),
    )
    size = F.length("body")
    blocks = rows.groupBy("file", "block").agg(F.sum(size).alias("chars"), F.count(F.lit(1)).alias("lines"))
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    bases = blocks.select(
        F.col("file").alias("f"), F.col("block").alias("b"), F.coalesce(F.sum("chars").over(earlier), F.lit(0)).alias("chars"),
        F.coalesce(F.sum("lines").over(earlier), F.lit(0)).alias("lines"),
    )
    here = Window.partitionBy("file", "block").orderBy("no").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    inside = rows.select("file", "block", "body", (F.sum(size).over(here) - size).alias("before"), F.count(F.lit(1)).over(here).alias("nth"))
    whole = inside.join(bases, (F.col("file") == F.col("f")) & (F.col("block") == F.col("b"))).select(
        "file", (F.col("chars") + F.col("before")).alias("at"), (F.col("lines") + F.col("nth")).alias("line"), "body"
    )
    cut = F.when(F.length("body") <= piece, F.array("body")).otherwise(F.regexp_extract_all("body", F.lit(r"(?s).{1,%d}" % piece), F.lit(0)))
    return whole.select("file", "at", "line", F.posexplode(cut).alias("k", "body")).select(
        "file", (F.col("at") + F.col("k") * piece).alias("at"), "line", "body"
    )


def file_chunks(spark: SparkSession, path: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """file, chunk (its number), start (place of the first character), first_line, text. No chunk is larger than its core, two
    overlaps and two pieces."""
    pieces = placed_pieces(spark, path, min(PIECE, overlap))
    end = F.col("at") + F.length("body")
    low = F.greatest(F.floor((F.col("at") - overlap) / chunk), F.lit(0))
    high = F.floor((end + overlap - 1) / chunk)
    dealt = pieces.withColumn("chunk", F.explode(F.sequence(low.cast("bigint"), high.cast("bigint"))))
    parts = dealt.groupBy("file", "chunk").agg(F.array_sort(F.collect_list(F.struct("at", "line", "body"))).alias("parts"))
    return parts.select(
        "file", "chunk", F.get("parts", F.lit(0))["at"].alias("start"), F.get("parts", F.lit(0))["line"].alias("first_line"),
        F.array_join(F.transform("parts", lambda p: p["body"]), "").alias("text"),
    )


def file_findings(spark: SparkSession, path: str, chunk: int = CHUNK, overlap: int = OVERLAP, **options) -> DataFrame:
    """What ``findings`` gives for each whole file: one row per occurrence with file, start and end in the file, and ``line`` (that
    of its first character). ``options`` are those of ``findings``; tags are numbered over a file by ``operators.scope``."""
    chunks = file_chunks(spark, path, chunk, overlap)
    breaks = F.split("text", "\n", -1)
    index = F.transform(breaks, lambda s: F.length(s) + 1)  # sizes of the lines, which the text need not be read again for
    keys = ["file", "chunk", "first", "first_line", "sizes"]
    found = findings(chunks.select("file", "chunk", F.col("start").alias("first"), "first_line", index.alias("sizes"), "text"), keys, **options)
    at = F.col("first") + F.col("start")
    core = found.where((at >= F.col("chunk") * chunk) & (at < (F.col("chunk") + 1) * chunk))
    walked = F.aggregate(
        "sizes", F.struct(F.lit(0).alias("left"), F.lit(0).alias("n")),
        lambda acc, size: F.struct(
            (acc["left"] + size).alias("left"), (acc["n"] + (acc["left"] + size <= F.col("start")).cast("int")).alias("n")
        ),
        lambda acc: acc["n"],
    )
    rest = [c for c in found.columns if c not in (*keys, "start", "end", "tag")]
    placed = core.withColumn("line", F.col("first_line") + walked)  # on its own: names in a lambda see the aliases beside them
    return placed.select("file", at.alias("start"), (F.col("first") + F.col("end")).alias("end"), "line", *rest)
