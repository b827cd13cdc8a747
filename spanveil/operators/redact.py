"""Redaction: numbering, rendering, entity map.

Per text, spans of one type are numbered by the first appearance of their normal form; a type with a single entity
loses its number. All steps sort or scan arrays (no pairwise comparison), so a text with very many spans stays cheap.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanveil.functions.checks import normal_value
from spanveil.functions.text import TextView, compute_once, empty_array, let, scan
from spanveil.operators.custom_join import prepare_names, with_custom_name_spans
from spanveil.operators.dictionaries import Dictionaries
from spanveil.operators.skew import kept
from spanveil.operators.spans import RAW, SPANS, RuleSet, resolve, rules_for, with_raw_spans

TAGGED = "struct<start:int,len:int,seq:int,kind:int,first:int,n:int,value:string>"
LITERAL_NAMES, LITERAL_BYTES = 2000, 1 << 17
TAGS, ENTITIES, MULTI = "__veil_tags", "__veil_entities", "__veil_multi"


def numbered(view: TextView, rules: RuleSet, spans: Column) -> Column:
    """Spans with ``first`` (start of the first span of the same entity) and ``n`` (number within the type), by start."""
    keyed = F.transform(
        spans,
        lambda s: let(
            F.struct(rules.kind_index(s["seq"]).alias("kind"), view.slice(s["start"], s["len"]).alias("value")),
            lambda z: F.struct(
                z["kind"].alias("kind"),
                normal_value(z["value"], rules.kind_name(z["kind"])).alias("norm"),
                s["start"].alias("start"), s["len"].alias("len"), s["seq"].alias("seq"), z["value"].alias("value"),
            ),
        ),
    )
    nothing = F.struct(
        F.lit(-1).alias("kind"), F.lit("").alias("norm"), F.lit(-1).alias("first")
    )

    def first_of(st: Column, x: Column) -> Column:
        return F.when((st["kind"] == x["kind"]) & (st["norm"] == x["norm"]), st["first"]).otherwise(x["start"])

    def with_first(ordered: Column) -> Column:
        firsts = scan(
            ordered, nothing, emit=first_of,
            step=lambda st, x: F.struct(
                x["kind"].alias("kind"), x["norm"].alias("norm"), first_of(st, x).alias("first")
            ),
        )
        return F.zip_with(
            ordered, firsts,
            lambda x, first: F.struct(
                x["kind"].alias("kind"), first.cast("int").alias("first"), x["start"].alias("start"),
                x["len"].alias("len"), x["seq"].alias("seq"), x["value"].alias("value"),
            ),
        )

    def number(st: Column, x: Column) -> Column:
        return (
            F.when(st["kind"] != x["kind"], 1).when(st["first"] == x["first"], st["n"]).otherwise(st["n"] + 1)
        )

    def with_number(ordered: Column) -> Column:
        numbers = scan(
            ordered, F.struct(F.lit(-1).alias("kind"), F.lit(-1).alias("first"), F.lit(0).alias("n")), emit=number,
            step=lambda st, x: F.struct(
                x["kind"].alias("kind"), x["first"].alias("first"), number(st, x).alias("n")
            ),
        )
        return F.zip_with(
            ordered, numbers,
            lambda x, n: F.struct(
                x["start"].alias("start"), x["len"].alias("len"), x["seq"].alias("seq"), x["kind"].alias("kind"),
                x["first"].alias("first"), n.cast("int").alias("n"), x["value"].alias("value"),
            ),
        )

    def alone(ordered: Column) -> Column:
        return F.transform(
            ordered,
            lambda s: F.struct(
                s["start"].alias("start"), s["len"].alias("len"), s["seq"].alias("seq"), rules.kind_index(s["seq"]).alias("kind"),
                s["start"].alias("first"), F.lit(1).alias("n"), view.slice(s["start"], s["len"]).alias("value"),
            ),
        )

    grouped = let(F.array_sort(keyed), with_first)
    kinds = F.array_distinct(F.transform(spans, lambda s: rules.kind_index(s["seq"])))
    # The only span of its type is the first of its entity and number 1: nothing to group.
    return F.when(F.size(kinds) == F.size(spans), alone(F.array_sort(spans))).otherwise(
        F.array_sort(let(F.array_sort(grouped), with_number))
    )


def tag_text(rules: RuleSet, kind: Column, n: Column, multi: Column) -> Column:
    """``[TYPE_n]``, or ``[TYPE]`` for the only entity of a type written in capitals and underscores."""
    name = rules.kind_name(kind)
    keeps_number = F.array_contains(multi, kind) | ~name.rlike(r"\A[A-Z_]+\z")
    return F.when(keeps_number, F.concat(F.lit("["), name, F.lit("_"), n.cast("string"), F.lit("]"))).otherwise(
        F.concat(F.lit("["), name, F.lit("]"))
    )


def entity_list(rules: RuleSet) -> Column:
    """One entry per entity in order of appearance; an entity's last raw value counts."""

    # By (first, start) an entity's spans stand together, the last one closing the group.
    def lasts(runs: Column) -> Column:
        closing = F.filter(
            runs, lambda x, i: (i == F.size(runs) - 1) | (F.get(runs, i + 1)["first"] != x["first"])
        )
        return F.transform(
            closing,
            lambda x: F.struct(
                tag_text(rules, x["kind"], x["n"], F.col(MULTI)).alias("tag"),
                rules.kind_name(x["kind"]).alias("type"),
                x["value"].alias("value"),
                x["first"].alias("first"),
            ),
        )

    by_entity = F.array_sort(
        F.transform(
            F.col(TAGS),
            lambda x: F.struct(
                x["first"].alias("first"), x["start"].alias("start"), x["kind"].alias("kind"), x["n"].alias("n"),
                x["value"].alias("value"),
            ),
        )
    )
    return let(by_entity, lasts)


def with_entities(df: DataFrame, view: TextView, rules: RuleSet) -> DataFrame:
    """Numbered spans, the types with several entities, and one entry per entity (tag, type, last raw value)."""
    several = lambda: F.array_distinct(
        F.transform(F.filter(F.col(TAGS), lambda x: x["n"] > 1), lambda x: x["kind"])
    )
    tags = lambda: F.when(F.size(SPANS) > 0, numbered(view, rules, F.col(SPANS))).otherwise(empty_array(TAGGED))
    df = df.withColumn(SPANS, rules.once("resolved", lambda: resolve(F.col(RAW))))
    df = df.withColumn(TAGS, rules.once("tags", tags)).withColumn(MULTI, rules.once("multi", several))
    return compute_once(df, **{
        TAGS: F.col(TAGS), MULTI: F.col(MULTI), ENTITIES: rules.once("entities", lambda: entity_list(rules)),
    })


def rendered(view: TextView, rules: RuleSet, tags: Column, multi: Column) -> Column:
    """The text with every span replaced by its tag: gaps and tags joined once."""

    def end_before(i: Column) -> Column:
        return F.when(i == 0, 0).otherwise(F.get(tags, i - 1)["start"] + F.get(tags, i - 1)["len"])

    pieces = F.transform(
        tags,
        lambda x, i: F.concat(
            view.slice(end_before(i), x["start"] - end_before(i)), tag_text(rules, x["kind"], x["n"], multi)
        ),
    )
    tail_start = end_before(F.size(tags))
    tail = view.slice(tail_start, F.length(view.text) - tail_start)
    return F.when(F.size(tags) == 0, view.text).otherwise(
        F.concat(F.array_join(pieces, ""), tail)
    )


def _prepared(df, text_col, detectors, dictionaries, extra=None, apart=False):
    before = df.columns
    df, dictionaries, extra = _with_joined_names(df, text_col, dictionaries, extra)
    rules = rules_for(detectors, dictionaries, apart)
    df, view = with_raw_spans(df, text_col, rules, extra)
    return with_entities(df, view, rules), view, rules, before


def _with_joined_names(df, text_col, dictionaries, extra=None):
    """Spans of the names of a table, if there is one.

    A table of few names (LITERAL_NAMES, LITERAL_BYTES, both counted first) becomes part of the plan: no text moves, no copy
    is written, and streams take it too. Beyond that the rows get numbers and are written once, so that the join finds them
    again whatever keys they have; a stream can't be joined back and raises an error.
    """
    if dictionaries is None or dictionaries.names_table is None:
        return df, dictionaries, extra
    few = dictionaries.names_table.select("name").where("name IS NOT NULL")
    size = few.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.octet_length("name")), F.lit(0)).alias("bytes")).first()
    if size["n"] <= LITERAL_NAMES and size["bytes"] <= LITERAL_BYTES:
        return df, replace(dictionaries, names_table=None).add_names([r[0] for r in few.collect()]), extra
    if df.isStreaming:
        raise ValueError(f"a stream takes a table of at most {LITERAL_NAMES} names ({LITERAL_BYTES} bytes)")
    numbered = kept(df.withColumn("__veil_row", F.monotonically_increasing_id()))
    names = kept(prepare_names(dictionaries.names_table))
    found = F.col("__veil_names")
    return (
        with_custom_name_spans(numbered, "__veil_row", names, text_col, "__veil_names"),
        replace(dictionaries, names_table=None),
        found if extra is None else F.concat(extra, found),
    )


def anonymize(
    df: DataFrame,
    text_col: str = "text",
    detectors: list[str] | None = None,
    dictionaries: Dictionaries | None = None,
    extra_spans: Column | None = None,
    apart: bool = False,
) -> DataFrame:
    """Add ``anonymized``, ``entity_map``, ``count``, ``detected_types`` and ``entities`` to every row.

    Blank text gives an empty text, an empty map, 0 and an empty list. ``entities`` is the map as an array of
    ``struct<tag, type, value, first>`` in order of first appearance. The plan is a chain of narrow projections.
    ``apart``: the texts hold several values (see ``sources/apart.py``), and no rule looks beyond its value.
    """
    df, view, rules, before = _prepared(df, text_col, detectors, dictionaries, extra_spans, apart)
    tags, multi, entities = F.col(TAGS), F.col(MULTI), F.col(ENTITIES)
    out = {
        "anonymized": rules.once("anonymized", lambda: rendered(view, rules, tags, multi)),
        "entity_map": F.map_from_entries(
            F.transform(entities, lambda e: F.struct(e["tag"].alias("key"), e["value"].alias("value")))
        ),
        "count": F.size(tags),
        "detected_types": F.array_distinct(F.transform(entities, lambda e: e["type"])),
        "entities": entities,
    }
    return df.select(*[F.col(f"`{c}`") for c in before if c not in out], *[v.alias(k) for k, v in out.items()])


def _public_spans(rules: RuleSet) -> Column:
    return F.transform(
        F.col(TAGS),
        lambda x: F.struct(
            x["start"].alias("start"),
            (x["start"] + x["len"]).alias("end"),
            x["seq"].alias("det_seq"),
            rules.per_source([s.id for s in rules.sources], x["seq"]).alias("detector"),
            rules.per_source([s.label for s in rules.sources], x["seq"]).alias("label"),
            rules.kind_name(x["kind"]).alias("placeholder"),
            x["value"].alias("value"),
            tag_text(rules, x["kind"], x["n"], F.col(MULTI)).alias("tag"),
        ),
    )


def detect(
    df: DataFrame,
    text_col: str = "text",
    detectors: list[str] | None = None,
    dictionaries: Dictionaries | None = None,
    extra_spans: Column | None = None,
) -> DataFrame:
    """Add ``spans``: the resolved spans with offsets (in characters), source, type, value and tag."""
    df, view, rules, before = _prepared(df, text_col, detectors, dictionaries, extra_spans)
    spans = rules.once("public_spans", lambda: _public_spans(rules))
    return df.select(*[F.col(f"`{c}`") for c in before if c != "spans"], spans.alias("spans"))


def _public_raw_spans(rules: RuleSet, view: TextView) -> Column:
    return F.transform(
        F.array_sort(F.col(RAW)),
        lambda x: F.struct(
            x["start"].alias("start"),
            (x["start"] + x["len"]).alias("end"),
            x["seq"].alias("det_seq"),
            rules.per_source([s.id for s in rules.sources], x["seq"]).alias("detector"),
            rules.per_source([s.label for s in rules.sources], x["seq"]).alias("label"),
            rules.placeholder(x["seq"]).alias("placeholder"),
            view.slice(x["start"], x["len"]).alias("value"),
        ),
    )


def findings(
    df: DataFrame,
    keys: list[str],
    text_col: str = "text",
    detectors: list[str] | None = None,
    dictionaries: Dictionaries | None = None,
    raw: bool = False,
) -> DataFrame:
    """One row per occurrence: the key columns and the span's fields; the text itself is not carried along.

    ``raw`` lists every span of every detector, overlapping ones included (without tags).
    """
    if raw:
        df, dictionaries, extra = _with_joined_names(df, text_col, dictionaries)
        rules = rules_for(detectors, dictionaries)
        out, view = with_raw_spans(df, text_col, rules, extra)
        spans = rules.once("raw_spans", lambda: _public_raw_spans(rules, view))
        out = out.select(*keys, F.explode_outer(spans).alias("span"))
    else:
        out = detect(df, text_col, detectors, dictionaries).select(*keys, F.explode_outer("spans").alias("span"))
    return out.where(F.col("span").isNotNull()).select(*keys, "span.*")
