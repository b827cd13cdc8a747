"""Redaction of nested columns: every string in structs, arrays and map values, to any depth, with the column's own type.

One expression lists the strings of a row in order; they are searched as one text with a separator that no detector's
surroundings reach across, so each is judged alone while all share the row's numbering. A second expression of the same
shape puts them back by their place, so the plan stays narrow and the cost linear in the number of strings.

Nulls and ties: null columns, structs, elements and strings stay null; empty arrays and maps stay; map keys and values of
other types are never changed. A column without strings keeps its value and has no entities.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanveil.functions.text import let, scan
from spanveil.sources.apart import anonymize_joined, parts_of, with_joined

LISTED, STRINGS, NESTED, OTHERS = "__veil_listed", "__veil_strings", "__veil_nested", "__veil_others"


def has_strings(kind: T.DataType) -> bool:
    if isinstance(kind, T.StructType):
        return any(has_strings(f.dataType) for f in kind.fields)
    if isinstance(kind, T.ArrayType):
        return has_strings(kind.elementType)
    return has_strings(kind.valueType) if isinstance(kind, T.MapType) else isinstance(kind, T.StringType)


def strings_of(value: Column, kind: T.DataType) -> Column:
    """The strings of a value in order, as an array without nulls."""
    none = F.array().cast("array<string>")
    if not has_strings(kind):
        return none
    if isinstance(kind, T.StructType):
        found = F.concat(*[strings_of(value[f.name], f.dataType) for f in kind.fields if has_strings(f.dataType)])
    elif isinstance(kind, T.ArrayType):
        found = F.flatten(F.transform(value, lambda x: strings_of(x, kind.elementType)))
    elif isinstance(kind, T.MapType):
        found = strings_of(F.map_values(value), T.ArrayType(kind.valueType))
    else:
        found = F.array(value.cast("string"))
    return F.when(value.isNull(), none).otherwise(found)


def put_back(value: Column, kind: T.DataType, strings: Column, at: Column) -> Column:
    """``value`` with its strings taken from ``strings``, the first of them at place ``at`` (from 0)."""
    if not has_strings(kind):
        return value
    if isinstance(kind, T.StructType):
        fields, place = [], at
        for f in kind.fields:
            fields.append(put_back(value[f.name], f.dataType, strings, place).alias(f.name))
            if has_strings(f.dataType):
                place = place + F.size(strings_of(value[f.name], f.dataType))
        new = F.struct(*fields)
    elif isinstance(kind, T.ArrayType):
        sizes = F.transform(value, lambda x: F.size(strings_of(x, kind.elementType)).cast("bigint"))
        places = scan(sizes, F.lit(0).cast("bigint"), emit=lambda n, size: n, step=lambda n, size: n + size)
        new = F.zip_with(value, places, lambda x, n: put_back(x, kind.elementType, strings, at + n))
    elif isinstance(kind, T.MapType):
        new = F.map_from_arrays(
            F.map_keys(value), put_back(F.map_values(value), T.ArrayType(kind.valueType), strings, at)
        )
    else:
        new = F.get(strings, at.cast("int"))
    return F.when(value.isNotNull(), new)


def anonymize_nested(df: DataFrame, column: str, **options) -> DataFrame:
    """``column`` (any type) redacted in place, and ``entity_map``, ``count``, ``detected_types`` and ``entities`` as
    ``anonymize`` adds them."""
    kind, made = df.schema[column].dataType, ["entity_map", "count", "detected_types", "entities"]
    others = F.struct(F.lit(0).alias("__veil"), *[F.col(f"`{c}`") for c in df.columns if c not in (column, *made)])
    value = F.col(NESTED)
    # A null string is no value: it is left out here and stays null where it is put back.
    listed = df.select(others.alias(OTHERS), F.col(f"`{column}`").alias(NESTED)).withColumn(LISTED, strings_of(value, kind))
    done = anonymize_joined(with_joined(listed, STRINGS, F.col(LISTED), options.get("dictionaries")), STRINGS, **options)
    back = let(
        parts_of(F.col("anonymized")),
        lambda parts: put_back(value, kind, parts, F.lit(0).cast("bigint")),
    )
    redacted = F.when(F.col("count") == 0, value).otherwise(back)
    return done.select(
        *[redacted.alias(c) if c == column else F.col(OTHERS)[c].alias(c) for c in df.columns if c not in made], *made
    )
