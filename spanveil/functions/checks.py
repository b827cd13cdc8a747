"""Value checks and value-level functions as Columns: Luhn, normal form, mask."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from spanveil.functions.dialect import SPACE
from spanveil.functions.fixed_values import HIGH_SEVERITY_TYPES, LAST_FOUR_TYPES
from spanveil.functions.text import let, strip


def digits_of(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn_ok(value: Column) -> Column:
    """Luhn check over the digits of ``value``; only 13 to 19 digits can pass."""

    def total(digits: Column) -> Column:
        codes = F.transform(F.split(F.reverse(digits), "(?<=.)(?=.)"), lambda d: d.cast("int"))
        return F.aggregate(
            F.transform(codes, lambda d, i: F.when(i % 2 == 0, d).otherwise(d * 2 - F.when(d > 4, 9).otherwise(0))),
            F.lit(0),
            lambda acc, d: acc + d,
        )

    return let(
        digits_of(value),
        lambda d: F.when(F.length(d).between(13, 19), total(d) % 10 == 0).otherwise(False),
    )


def normal_value(value: Column, kind: Column) -> Column:
    """The form under which two spellings of an entity are the same entity."""
    return F.when(kind.isin("PERSON_NAME", "EMAIL"), strip(F.lower(value))).otherwise(
        strip(F.lower(F.regexp_replace(value, f"[{SPACE}-]+", "")))
    )


def mask_value(value: Column, kind: Column) -> Column:
    """A value made safe to show, by kind of entity."""
    size = F.length(value)
    parts = F.split(value, "@", -1)
    return (
        F.when(kind == "PERSON_NAME", F.concat(F.left(value, F.lit(1)), F.repeat(F.lit("*"), size - 1)))
        .when(kind == "EMAIL", F.concat(F.left(parts[0], F.lit(1)), F.lit("***@"), F.get(parts, 1)))
        .when(kind == "PHONE_NUMBER", F.concat(F.left(value, F.lit(4)), F.lit("***"), F.right(value, F.lit(2))))
        .when(kind.isin(LAST_FOUR_TYPES), F.concat(F.lit("***"), F.right(digits_of(value), F.lit(4))))
        .when(size <= 4, F.lit("****"))
        .otherwise(F.concat(F.left(value, F.lit(2)), F.repeat(F.lit("*"), size - 4), F.right(value, F.lit(2))))
    )


def severity(kinds: Column, count: Column) -> Column:
    """HIGH, MEDIUM or NULL (nothing found) for an array of entity types."""
    high = F.array(*[F.lit(k) for k in HIGH_SEVERITY_TYPES])
    return F.when(count > 0, F.when(F.arrays_overlap(kinds, high), F.lit("HIGH")).otherwise(F.lit("MEDIUM")))
