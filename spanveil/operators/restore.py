"""Restoring redacted text, from an entity map in the row or from a vault table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanveil.functions.text import empty_array, let, scan
from spanveil.operators.skew import kept, lookup_join, null_safe_join

TAG = r"\[[^\[\]]+\]"
FEW_TAGS = 16


def _one_after_another(text: Column, entity_map: Column) -> Column:
    """Longest tag first, each replaced everywhere, restored values included; equal lengths in map order."""
    entries = F.transform(
        F.map_entries(entity_map),
        lambda e, i: F.struct((-F.length(e["key"])).alias("k"), i.alias("i"), e["key"].alias("tag"), e["value"].alias("value")),
    )
    return F.aggregate(F.array_sort(entries), text, lambda acc, e: F.replace(acc, e["tag"], e["value"]))


def _in_one_pass(text: Column, entity_map: Column) -> Column:
    """Cut the text at tags and join it again with the values. Occurrences and entries meet by sorting, not by search."""
    item = "struct<tag:string,is_use:boolean,pos:int,value:string>"

    def build(z: Column) -> Column:
        entries = F.transform(
            F.map_entries(entity_map),
            lambda e: F.struct(
                e["key"].alias("tag"), F.lit(False).alias("is_use"), F.lit(-1).alias("pos"), e["value"].alias("value")
            ),
        )
        uses = F.transform(
            z["tags"],
            lambda t, i: F.struct(
                t.alias("tag"), F.lit(True).alias("is_use"), i.alias("pos"), F.lit(None).cast("string").alias("value")
            ),
        )

        def values_of(ordered: Column) -> Column:
            """The value of every use: the number of the last entry before it, if that entry has its tag."""
            entry_of = scan(
                ordered,
                F.struct(F.lit(0).alias("at"), F.lit(-1).alias("entry"), F.lit("").alias("tag")),
                emit=lambda st, x: F.when(x["is_use"] & (st["tag"] == x["tag"]), st["entry"]).otherwise(-1),
                step=lambda st, x: F.struct(
                    (st["at"] + 1).alias("at"),
                    F.when(x["is_use"], st["entry"]).otherwise(st["at"]).alias("entry"),
                    F.when(x["is_use"], st["tag"]).otherwise(x["tag"]).alias("tag"),
                ),
            )
            filled = F.zip_with(
                ordered, entry_of,
                lambda x, entry: F.struct(
                    x["pos"].alias("pos"),
                    F.when(entry < 0, x["tag"]).otherwise(F.get(ordered, entry.cast("int"))["value"]).alias("value"),
                ),
            )
            return F.transform(F.array_sort(F.filter(filled, lambda x: x["pos"] >= 0)), lambda x: x["value"])

        values = let(F.array_sort(F.concat(entries, uses, empty_array(item))), values_of)
        return F.array_join(
            F.zip_with(z["gaps"], values, lambda gap, value: F.concat(gap, F.coalesce(value, F.lit("")))), ""
        )

    return let(
        F.struct(
            F.regexp_extract_all(text, F.lit(TAG), F.lit(0)).alias("tags"), F.split(text, TAG, -1).alias("gaps")
        ),
        build,
    )


def restore_text(text: Column, entity_map: Column) -> Column:
    """Put the values of ``entity_map`` back in place of its tags.

    The rule is one replacement per tag, longest tag first. For many tags one pass does the same work unless a tag has
    an unusual shape or a value brings brackets into the text; those rare rows follow the rule literally.
    """
    entity_map = F.map_filter(entity_map, lambda k, v: v.isNotNull())  # an entry without a value restores nothing
    plain = F.forall(F.map_keys(entity_map), lambda k: k.rlike(rf"\A{TAG}\z")) & F.forall(
        F.map_values(entity_map), lambda v: ~v.rlike(r"[\[\]]")
    ) & ~text.rlike(r"\[[^\[\]]*\[|\][^\[\]]*\]|\A[^\[\]]*\]|\[[^\[\]]*\z")
    return F.when(F.size(entity_map) == 0, text).when(
        (F.size(entity_map) > FEW_TAGS) & plain, _in_one_pass(text, entity_map)
    ).otherwise(_one_after_another(text, entity_map))


def deanonymize(
    df: DataFrame, text_col: str = "anonymized", map_col: str = "entity_map", out: str = "restored"
) -> DataFrame:
    return df.withColumn(out, F.when(F.col(map_col).isNull(), F.col(text_col)).otherwise(
        restore_text(F.col(text_col), F.col(map_col))
    ))


def restore_from_vault(
    redacted: DataFrame, vault: DataFrame, key: str, text_col: str = "anonymized", out: str = "restored"
) -> DataFrame:
    """Restore texts from the vault of per-text redaction ``(key, tag, value, first)``; a text's map is gathered from
    its own vault rows. Rows without tags stay as they are."""
    maps = vault.groupBy(key).agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("first", "tag", "value"))), lambda e: F.struct(e["tag"], e["value"])
        ).alias("__veil_entries")
    )
    joined = null_safe_join(redacted, maps, [key], "left").withColumn("__veil_map", F.map_from_entries("__veil_entries"))
    return deanonymize(joined, text_col, "__veil_map", out).drop("__veil_map", "__veil_entries")


def restore_from_scope_vault(
    redacted: DataFrame,
    vault: DataFrame,
    key: str,
    scope: str,
    text_col: str = "anonymized",
    out: str = "restored",
) -> DataFrame:
    """Restore texts that were numbered over a scope, from its vault ``(scope, tag, value)``.

    A scope's vault is never gathered: only the tags a text uses are looked up by (scope, tag), heavily used tags apart
    (see ``lookup_join``), and grouped per text.
    """
    tags = F.array_distinct(F.regexp_extract_all(F.col(text_col), F.lit(TAG), F.lit(0)))
    uses = kept(
        redacted.select(F.col(key), F.col(scope), F.explode_outer(tags).alias("tag")).where(F.col("tag").isNotNull())
    )
    known = lookup_join(uses, vault.select(scope, "tag", "value"), [scope, "tag"])
    maps = known.groupBy(key).agg(
        F.map_from_entries(F.array_sort(F.collect_set(F.struct("tag", "value")))).alias("__veil_map")
    )
    joined = null_safe_join(redacted, maps, [key], "left")
    return deanonymize(joined, text_col, "__veil_map", out).drop("__veil_map")
