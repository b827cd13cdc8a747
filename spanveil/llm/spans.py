"""Places of a pattern's matches as column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from spanveil.functions.text import let, scan


def match_spans(text: Column, pattern: str, keep: Callable[[Column], Column] | None = None) -> Column:
    """array<struct(start, end, value)>: the leftmost matches that don't overlap, in code points, end exclusive.

    One split gives what lies between the matches; a running sum over both gives the places. ``keep`` drops matches by
    their value; a dropped match still used up its characters.
    """

    def place(values: Column) -> Column:
        gaps = F.split(text, pattern, -1)
        sizes = F.zip_with(
            F.slice(gaps, 1, F.size(values)), values,
            lambda gap, v: F.struct(F.length(gap).alias("gap"), F.length(v).alias("own")),
        )
        starts = scan(
            sizes, F.lit(0).cast("bigint"), lambda at, s: at + s["gap"], lambda at, s: at + s["gap"] + s["own"]
        )
        spans = F.zip_with(
            starts, values, lambda at, v: F.struct(at.alias("start"), (at + F.length(v)).alias("end"), v.alias("value"))
        )
        return F.filter(spans, lambda s: keep(s["value"])) if keep else spans

    none = F.expr("cast(array() as array<struct<start:bigint,end:bigint,value:string>>)")
    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda v: F.when(F.size(v) > 0, place(v)).otherwise(none))


def guarded(condition: Column, spans: Column) -> Column:
    """No search where a cheap test says there can be no match."""
    return F.when(condition, spans).otherwise(F.expr("cast(array() as array<struct<start:bigint,end:bigint,value:string>>)"))


def named(kind: str, spans: Column) -> Column:
    """kind:start:end of each span."""
    return F.transform(spans, lambda s: F.concat_ws(":", F.lit(kind), s["start"], s["end"]))
