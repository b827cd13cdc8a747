"""Lines that many documents repeat are dropped from all of them but one. DataFrame functions only.

Every text is exploded into its lines. A line's key is the line without white space at its ends, ``A-Z`` in lower case;
128 bits of it stand for it (two xxhash64 of different seeds). Keys of ``least_chars`` code points or more are counted by
the distinct documents that hold them; a key of ``least_docs`` documents or more is dropped everywhere except in the
document with the largest id. What is left of a text is put together again by position.

Scale: lines travel as two hashes and an id, never as text. A document's key is one row however often it repeats there,
so a line of a third of all documents is spread over tasks by its documents' ids first, and arrives at its key as one
partial row per task. The lookup of dropped lines is a plain join (adaptive execution splits a hot line; the other side
has one row per key). Texts meet the places of their dropped lines once: by broadcast while these are proven to be at most
BROADCAST_BYTES, by a shuffled join beyond that. A text is cut at its dropped lines in one pass over their places.

Nulls and ties: a null or empty text is one empty line. A document is its id: rows that repeat an id are one document,
whose lines share one fate; rows with a null id are one document too, below all others. Lines of white space only have an
empty key. A line that repeats within the document that keeps it stays every time. An empty table gives no rows. Only id
and text are read; further columns of any name pass through as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanveil.functions.text import let
from spanveil.llm.common import column, kept, packed, text_of

LEAST_CHARS = 40
LEAST_DOCS = 5
BROADCAST_BYTES = 32 << 20  # of dropped lines' places, counted before they are broadcast
WHITE = " \t\n\x0b\f\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lowered(text: Column) -> Column:
    """A-Z in lower case, all else unchanged (``lower`` does just that while a text is ASCII, and is faster)."""
    return F.when(text.rlike(r"[^\x00-\x7F]"), F.translate(text, UPPER, LOWER)).otherwise(F.lower(text))


def line_rows(docs: DataFrame, id_column: str, text_column: str, least_chars: int) -> DataFrame:
    """One narrow row per line whose key is long enough: id, key (digest of the text), h1, h2, at (position from 0)."""
    texts = docs.select(column(id_column).cast("bigint").alias("id"), text_of(text_column).alias("text"))
    lines = texts.select(
        "id", F.xxhash64("text").alias("key"), F.posexplode(F.split(lowered(F.col("text")), "\n", -1)).alias("at", "line")
    )
    keys = lines.select("id", "key", "at", F.btrim(F.col("line"), F.lit(WHITE)).alias("line"))
    return keys.where(F.length("line") >= least_chars).select(
        "id", "key", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit("line"), "line").alias("h2"), "at"
    )


def repeated_keys(lines: DataFrame, least_docs: int) -> DataFrame:
    """h1, h2, last (the document that keeps the line): keys of so many distinct documents."""
    of_document = lines.groupBy("h1", "h2", "id").agg(F.count(F.lit(1)).alias("n"))
    return (
        of_document.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n_docs"), F.max("id").alias("last"))
        .where(F.col("n_docs") >= least_docs).select("h1", "h2", "last")
    )


def dropped_places(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text",
    least_chars: int = LEAST_CHARS, least_docs: int = LEAST_DOCS,
) -> DataFrame:
    """id, key, places: the positions of the lines that go, ascending, for each document that loses any."""
    lines = kept(line_rows(docs, id_column, text_column, least_chars))
    repeated = kept(repeated_keys(lines, least_docs))  # written, so that the join's sides are plain exchanges, which can be split
    gone = lines.join(repeated, ["h1", "h2"]).where(~F.col("id").eqNullSafe(F.col("last")))
    return gone.groupBy("id", "key").agg(F.array_sort(F.collect_set("at")).alias("places"))


def without_places(lines: Column, places: Column) -> Column:
    """The lines at other positions: the stretches between the places, each sliced once."""
    ends = F.concat(places, F.array(F.size(lines)))
    begins = F.concat(F.array(F.lit(0)), F.transform(places, lambda p: p + 1))
    return F.flatten(F.zip_with(begins, ends, lambda a, b: F.slice(lines, a + 1, b - a)))


def deduplicated(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text",
    least_chars: int = LEAST_CHARS, least_docs: int = LEAST_DOCS, broadcast_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """Per row: doc (the whole row), text (what is left), n_lines (before) and places (of the dropped lines, from 0)."""
    places = kept(dropped_places(docs, id_column, text_column, least_chars, least_docs))
    size = places.agg(F.sum(64 + 4 * F.size("places"))).first()[0] or 0
    rows = docs.select(packed(docs), column(id_column).cast("bigint").alias("own_id"), text_of(text_column).alias("text"))
    rows = rows.withColumn("own_key", F.xxhash64("text"))
    own = F.col("own_id").eqNullSafe(F.col("id")) & (F.col("own_key") == F.col("key"))
    joined = rows.join(F.broadcast(places) if size <= broadcast_bytes else places, own, "left")
    text, none = F.col("text"), F.expr("cast(array() as array<int>)")
    left = let(F.split(text, "\n", -1), lambda lines: F.array_join(without_places(lines, F.col("places")), "\n"))
    return joined.select(
        "doc",
        F.when(F.col("places").isNull(), text).otherwise(left).alias("text"),
        (F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1).cast("bigint").alias("n_lines"),
        F.coalesce("places", none).alias("places"),
    )


def without_repeated_lines(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", **options) -> DataFrame:
    """The same rows and columns, with repeated lines taken out of the text. A null text stays null."""
    found = deduplicated(docs, id_column, text_column, **options)
    same = F.col("doc")[text_column].isNull()
    return found.select(
        *[
            (F.when(same, None).otherwise(F.col("text")) if c == text_column else F.col("doc")[c]).alias(c)
            for c in docs.columns
        ]
    )
