"""Several values of a row searched as one text: what stands between them, and the redacted values afterwards.

The separator is a control character between line breaks, which no format crosses; rules that look around a match stop at
it. So the text that every detector reads is hardly longer than the values. Where a value holds that character itself, or
user patterns and names are given that might cross it, a separator wider than any rule looks is taken instead.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanveil.functions.text import empty_array, let, scan
from spanveil.operators.redact import anonymize
from spanveil.operators.spans import APART

SIGN = "\x1e"
NARROW, WIDE = f"\n{SIGN}\n", "\n" + SIGN * 240 + "\n"


def _needs_wide(dictionaries) -> bool:
    return dictionaries is not None and bool(
        dictionaries.patterns or dictionaries.names_table is not None or any(SIGN in n for n in dictionaries.names)
    )


def with_joined(df: DataFrame, name: str, values: Column, dictionaries=None, alone: Column | None = None) -> DataFrame:
    """Add the values of a row as one text in column ``name`` (``alone``, NULL or a text, where the row has no values)."""
    joined, wide = F.array_join(values, NARROW), F.exists(values, lambda v: v.contains(SIGN))
    if alone is not None:
        wide = wide | alone.contains(SIGN)
    if _needs_wide(dictionaries):
        wide = F.lit(True)
    df = df.withColumn(APART, F.when(wide, F.lit(WIDE)).otherwise(F.lit(NARROW)))
    text = F.when(F.col(APART) == NARROW, joined).otherwise(F.array_join(values, WIDE))
    return df.withColumn(name, text if alone is None else F.when(values.isNull(), alone).otherwise(text))


def parts_of(text: Column) -> Column:
    """The values of a redacted text, in order."""
    cut = {sign: F.split(text, r"\Q" + sign + r"\E", -1) for sign in (NARROW, WIDE)}
    return F.when(F.col(APART) == NARROW, cut[NARROW]).otherwise(cut[WIDE])


def _wide_places(entities: Column, text: Column) -> Column:
    """Entities with ``first`` as if the wide separator stood between the values, so that it tells nothing of the choice."""
    more = len(WIDE) - len(NARROW)
    kind = "struct<first:int,entity:int>"

    def passed(parts: Column) -> Column:
        ends = scan(
            parts, F.lit(0), emit=lambda n, p: n + F.length(p), step=lambda n, p: n + F.length(p) + len(NARROW)
        )
        marks = F.transform(ends, lambda e: F.struct(e.cast("int").alias("first"), F.lit(0).alias("entity")))
        found = F.transform(entities, lambda e: F.struct(e["first"].alias("first"), F.lit(1).alias("entity")))
        return F.array_sort(F.concat(marks, found, empty_array(kind)))

    def shifted(ordered: Column) -> Column:
        counts = scan(
            ordered, F.lit(0), emit=lambda n, x: F.when(x["entity"] == 1, n).otherwise(-1),
            step=lambda n, x: n + 1 - x["entity"],
        )
        return F.zip_with(
            entities, F.filter(counts, lambda n: n >= 0),
            lambda e, n: F.struct(
                e["tag"].alias("tag"), e["type"].alias("type"), e["value"].alias("value"),
                (e["first"] + n * more).cast("int").alias("first"),
            ),
        )

    moved = let(let(F.split(text, r"\Q" + NARROW + r"\E", -1), passed), shifted)
    return F.when((F.col(APART) == NARROW) & (F.size(entities) > 0), moved).otherwise(entities)


def anonymize_joined(df: DataFrame, name: str, **options) -> DataFrame:
    """``anonymize`` over column ``name``, made by ``with_joined``."""
    done = anonymize(df, name, apart=True, **options)
    return done.withColumn("entities", _wide_places(F.col("entities"), F.col(name)))
