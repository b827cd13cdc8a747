"""Redaction of the values of JSON texts: strings and numbers anywhere in the tree; structure, keys and all else kept.

The values of a text are searched as one text with a separator that no detector's surroundings reach across (see
``apart.py``), so each is judged alone while all share the text's numbering (an entity has one tag in every leaf). The plan is narrow: one pass that
cuts the tokens, ``anonymize``, one pass that puts them back. Values in which nothing was found keep their very spelling,
escapes included; a number that was found becomes a string with its tag.

Nulls and ties: a NULL stays NULL (with no entities); a text that is no JSON is redacted as plain text; keys are never
changed, even where they hold personal data; true, false and null hold none. Repeated keys stay.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanveil.functions.text import let, scan
from spanveil.sources.apart import anonymize_joined, parts_of, with_joined

TOKEN = r'"(?:[^"\\]|\\.)*+"(?:\s*+:)?+|-?[0-9][0-9.eE+-]*+'  # strings (keys with their colon) and numbers
TOKENS, GAPS, LEAVES, RAW_TEXT = "__veil_tokens", "__veil_gaps", "__veil_leaves", "__veil_joined"
OTHERS = "__veil_others"  # the other columns, so that none clashes with those of a redaction


def _is_leaf(token: Column) -> Column:
    return ~token.endswith(":")


def _quoted(token: Column) -> Column:
    return F.when(token.startswith('"'), token).otherwise(F.concat(F.lit('"'), token, F.lit('"')))


def _put_back(parts: Column) -> Column:
    """Tokens with the redacted values (``parts``, in order) in place of those that changed."""
    flags = F.transform(TOKENS, lambda t: _is_leaf(t).cast("bigint"))
    places = scan(flags, F.lit(0).cast("bigint"), emit=lambda n, flag: n, step=lambda n, flag: n + flag)

    def token(pair: Column) -> Column:
        new = F.get(parts, pair["n"].cast("int"))
        same = ~_is_leaf(pair["t"]) | new.eqNullSafe(F.get(F.col(LEAVES), pair["n"].cast("int")))
        made = F.to_json(F.array(new))
        return F.when(same, pair["t"]).otherwise(F.substring(made, F.lit(2), F.length(made) - 2))

    pairs = F.zip_with(TOKENS, places, lambda t, n: F.struct(t.alias("t"), n.alias("n")))
    glued = F.zip_with(GAPS, F.transform(pairs, token), lambda gap, t: F.concat(gap, F.coalesce(t, F.lit(""))))
    return F.array_join(glued, "")


def anonymize_json(df: DataFrame, json_col: str, **options) -> DataFrame:
    """``json_col`` redacted in place, and ``entity_map``, ``count``, ``detected_types`` and ``entities`` as ``anonymize`` adds them."""
    text = F.col(f"`{json_col}`")
    valid = F.try_parse_json(text).isNotNull()
    made = ["entity_map", "count", "detected_types", "entities"]
    others = [F.col(f"`{c}`") for c in df.columns if c not in (json_col, *made)]
    cut = df.select(
        F.struct(F.lit(0).alias("__veil"), *others).alias(OTHERS), text.alias("__veil_json"),
        F.when(valid, F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))).alias(TOKENS),
        F.when(valid, F.split(text, TOKEN, -1)).alias(GAPS),
    )
    literal = F.array_join(F.transform(F.filter(TOKENS, _is_leaf), _quoted), ",")
    leaves = F.from_json(F.concat(F.lit("["), literal, F.lit("]")), "array<string>")
    plain = F.when(F.col(TOKENS).isNull(), F.col("__veil_json"))
    cut = with_joined(cut.withColumn(LEAVES, leaves), RAW_TEXT, F.col(LEAVES), options.get("dictionaries"), alone=plain)
    done = anonymize_joined(cut, RAW_TEXT, **options)
    back = let(parts_of(F.col("anonymized")), _put_back)
    redacted = (
        F.when(F.col("__veil_json").isNull(), None)
        .when(F.col("count") == 0, F.col("__veil_json"))
        .when(F.col(TOKENS).isNull(), F.col("anonymized"))
        .otherwise(back)
    )
    columns = [redacted.alias(c) if c == json_col else F.col(OTHERS)[c].alias(c) for c in df.columns if c not in made]
    return done.select(*columns, *made)
