"""Small Column helpers shared by all operators: let-binding, linear scans over arrays, slicing of long texts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanveil.functions.dialect import NON_SPACE_CLASS, SPACE_CLASS

CHUNK_BITS = 12  # texts are cut into chunks of 4096 characters for slicing
SCAN_BLOCK = 256
MARK = "\uffff"  # a Unicode non-character; texts that do contain it take the path without marks


def empty_array(element_type: str) -> Column:
    return F.expr(f"cast(array() as array<{element_type}>)")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and hand it to ``body`` however often ``body`` uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def compute_once(df: DataFrame, **columns: Column) -> DataFrame:
    """``withColumns`` whose values are computed exactly once per row, whatever is done with them later.

    Catalyst substitutes a projected expression into every filter above it, which would run all detectors again for
    a plain ``filter(count > 0)``. Values that come out of a one-row generator are opaque to that rewrite.
    """
    kept = [c for c in df.columns if c not in columns]
    packed = F.explode_outer(F.array(F.struct(*[v.alias(k) for k, v in columns.items()])))
    return df.select(*[F.col(f"`{c}`") for c in kept], packed.alias("__veil_once")).select(
        *[F.col(f"`{c}`") for c in kept], *[F.col(f"__veil_once.{k}").alias(k) for k in columns]
    )


def is_blank(text: Column) -> Column:
    """NULL, empty, or nothing but white space (Unicode white space included)."""
    return text.isNull() | ~text.rlike(NON_SPACE_CLASS)


def strip(text: Column) -> Column:
    """Trim Unicode white space on both ends (Spark's ``trim`` takes blanks only)."""
    return F.regexp_replace(F.regexp_replace(text, rf"\A{SPACE_CLASS}+", ""), rf"{SPACE_CLASS}+\z", "")


def scan(
    items: Column,
    init: Column,
    emit: Callable[[Column, Column], Column],
    step: Callable[[Column, Column], Column],
) -> Column:
    """Left-to-right pass over an array with carried state: one number (bigint) per item.

    ``emit(state, item)`` gives the item's number (before ``step``), ``step(state, item)`` the next state. A fold copies
    its accumulator at every step; that is why it holds plain numbers only, gathered per block of items, and callers zip
    them back to the items.
    """
    none = empty_array("bigint")

    def run_block(block: Column, state: Column) -> Column:
        return F.aggregate(
            block,
            F.struct(none.alias("out"), state.alias("state")),
            lambda acc, item: F.struct(
                F.array_append(acc["out"], emit(acc["state"], item).cast("bigint")).alias("out"),
                step(acc["state"], item).alias("state"),
            ),
        )

    def run(all_items: Column) -> Column:
        starts = F.when(
            F.size(all_items) > 0, F.sequence(F.lit(1), F.size(all_items), F.lit(SCAN_BLOCK))
        ).otherwise(empty_array("int"))
        return F.aggregate(
            starts,
            F.struct(none.alias("outs"), init.alias("state")),
            lambda acc, start: let(
                run_block(F.slice(all_items, start, F.lit(SCAN_BLOCK)), acc["state"]),
                lambda r: F.struct(F.concat(acc["outs"], r["out"]).alias("outs"), r["state"].alias("state")),
            ),
            lambda acc: acc["outs"],
        )

    return let(items, run)


def keep_where(items: Column, flags: Column) -> Column:
    """The items whose number in ``flags`` is not 0."""
    pairs = F.zip_with(items, flags, lambda x, flag: F.struct(x.alias("x"), flag.alias("flag")))
    return F.transform(F.filter(pairs, lambda p: p["flag"] != 0), lambda p: p["x"])


def chunks_of(text: Column) -> Column:
    """The text as an array of 4096-character pieces (one piece for a short text)."""
    return F.when(F.length(text) <= (1 << CHUNK_BITS), F.array(text)).otherwise(
        F.regexp_extract_all(text, F.lit(r"(?s).{1,%d}" % (1 << CHUNK_BITS)), F.lit(0))
    )


def slice_text(chunks: Column, start: Column, length: Column) -> Column:
    """``length`` characters from 0-based ``start``, touching only the chunks that hold them.

    ``substring`` walks a UTF-8 string from its first byte, which would make k slices of an n-character text cost k*n.
    """
    first = F.shiftright(start, CHUNK_BITS)
    last = F.shiftright(start + length - 1, CHUNK_BITS)
    return F.substring(
        F.array_join(F.slice(chunks, first + 1, F.greatest(last - first + 1, F.lit(0))), ""),
        start - F.shiftleft(first, CHUNK_BITS) + 1,
        length,
    )


class TextView:
    """A text column with the derived columns the detectors read."""

    def __init__(
        self, text: Column, lower: Column, chunks: Column, has_digit: Column, has_mark: Column, apart: Column | None = None
    ):
        self.text = text
        self.apart = apart  # what stands between values that are searched as one text; surroundings end there
        self.has_mark = has_mark
        self.lower = lower
        self.chunks = chunks
        self.has_digit = has_digit

    def slice(self, start: Column, length: Column) -> Column:
        return slice_text(self.chunks, start, length)

    def before(self, start: Column, width: int) -> Column:
        """Up to ``width`` characters that end right before ``start``."""
        found = self.slice(F.greatest(start - width, F.lit(0)), F.least(start, F.lit(width)))
        return found if self.apart is None else F.call_function("substring_index", found, self.apart, F.lit(-1))

    def after(self, end: Column, width: int) -> Column:
        """Up to ``width`` characters from ``end``."""
        found = self.slice(end, F.lit(width))
        return found if self.apart is None else F.call_function("substring_index", found, self.apart, F.lit(1))

    def mentions(self, *words: str) -> Column:
        """Cheap byte search: does the text hold one of ``words`` in any letter case?"""
        return _contains_any(self.lower, words)

    def holds(self, *words: str) -> Column:
        """The same in exactly this letter case."""
        return _contains_any(self.text, words)


def _contains_any(text: Column, words: tuple[str, ...]) -> Column:
    found = text.contains(words[0])
    for word in words[1:]:
        found = found | text.contains(word)
    return found
