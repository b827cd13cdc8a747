"""Information-theoretic sanitisation of personal data. DataFrame functions only.

Protected entities are the values of four formats (e-mail, IP address, card, phone). A term discloses an entity if
knowing the term tells most of what there is to know about the entity: the pointwise mutual information
PMI(c; t) = log2(N n(c,t) / (n(c) n(t))) against the entity's information IC(c) = log2(N / n(c)), all counted over the
lines of the whole corpus. A term with PMI of at least ``generalise`` * IC is generalised in the lines that hold the
entity, one with ``remove`` * IC or more is removed, provided the two meet in two different lines at least (a chance
neighbour tells nothing). The entities themselves are replaced by their kind.

Scale: counts are pre-aggregated by (entity, term); terms are counted over the corpus only for the candidates, by a join
that Spark broadcasts while they are few and shuffles otherwise. Lines with an entity are the only text that is kept.

Nulls and ties: null and empty texts have no entities; null ids are matched like any other; rows that repeat id and text
get the same spans. An empty table gives no rows. Only the id and text columns are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanveil.functions.text import compute_once, let, scan
from spanveil.llm.common import column, kept, packed, text_of
from spanveil.llm.spans import guarded, match_spans, named

# The formats. Each is written so that Java neither recurses per character nor restarts in a run it has failed on;
# the matches are those of the plain formats email, ip, card and phone.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
OCTETS = r"\A0*+(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{0,2})(?:\.0*+(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{0,2})){3}\z"
KINDS = ("email", "ip", "card", "phone")
ANY_CASE_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
GENERALISE, REMOVE = 0.7, 0.9
TERM_ROWS = 500_000  # candidate terms that are broadcast (about 40 MB); more are joined by shuffle


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Luhn's check over a string of digits."""

    def step(acc: Column, i: Column) -> Column:
        d = F.substring(digits, F.length(digits) - i, F.lit(1)).cast("int")
        twice = F.when(d > 4, d * 2 - 9).otherwise(d * 2)
        return acc + F.when(i % 2 == 1, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0), step) % 10 == 0


def entity_spans(text: Column) -> dict[str, Column]:
    """The spans of each kind."""
    digit = text.rlike("[0-9]")

    def card(value: Column) -> Column:
        return let(_digits(value), lambda d: F.when(F.length(d).between(13, 19), luhn(d)).otherwise(F.lit(False)))

    return {
        "email": guarded(text.contains("@"), match_spans(text, EMAIL)),
        "ip": guarded(digit & text.contains("."), match_spans(text, IP, lambda v: v.rlike(OCTETS))),
        "card": guarded(digit, match_spans(text, CARD, card)),
        "phone": guarded(
            text.contains("+"), match_spans(text, PHONE, lambda v: F.length(_digits(v)).between(9, 15))
        ),
    }


def with_entities(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """id, key (digest of the text), and one array of spans for each kind."""
    narrow = docs.select(column(id_column).alias("id"), text_of(text_column).alias("text"))
    found = compute_once(narrow, **entity_spans(F.col("text")))
    return found.select("id", F.xxhash64("text").alias("key"), *KINDS)


def entity_lines(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The lines that hold an entity: id, key, line_key, ents (lower-case values), words (start, end, value; those
    inside an entity are left out)."""
    narrow = docs.select(column(id_column).alias("id"), text_of(text_column).alias("text")).where(
        F.col("text").contains("@") | F.col("text").contains("+") | F.col("text").rlike(r"[0-9][\x20.-]?[0-9]")
    )
    lines = F.split("text", "\n", -1)
    starts = scan(lines, F.lit(0).cast("bigint"), lambda at, s: at, lambda at, s: at + F.length(s) + 1)
    rows = narrow.select(
        "id", F.xxhash64("text").alias("key"),
        F.explode(F.arrays_zip(lines.alias("line"), starts.alias("at"))).alias("part"),
    ).select("id", "key", F.col("part.line").alias("line"), F.col("part.at").alias("at"))
    rows = rows.where(F.col("line").rlike(r"@|[0-9][\x20.-]?[0-9]|\+[0-9]"))
    rows = compute_once(rows, **entity_spans(F.col("line")))
    rows = rows.withColumn("spans", F.concat(*KINDS)).where(F.size("spans") > 0)
    words = F.filter(
        match_spans(F.col("line"), ANY_CASE_WORD),
        lambda w: ~F.exists("spans", lambda s: (s["start"] < w["end"]) & (w["start"] < s["end"])),
    )
    return rows.select(
        "id", "key", F.xxhash64("line").alias("line_key"),
        F.array_distinct(F.transform("spans", lambda s: F.lower(s["value"]))).alias("ents"),
        F.transform(
            words, lambda w: F.struct((w["start"] + F.col("at")).alias("start"), (w["end"] + F.col("at")).alias("end"), F.lower(w["value"]).alias("value"))
        ).alias("words"),
    )


def disclosing_terms(
    docs: DataFrame, lines: DataFrame, text_column: str = "text", generalise: float = GENERALISE, remove: float = REMOVE
) -> DataFrame:
    """entity, term, pmi, ic, action ("general" or "removed"); ``lines`` from ``entity_lines``, kept."""
    each = lines.select("line_key", F.explode("ents").alias("entity"), F.array_distinct(F.transform("words", lambda w: w["value"])).alias("terms"))
    n_entity = each.groupBy("entity").agg(F.count(F.lit(1)).alias("n_c"))
    pairs = kept(
        each.select("line_key", "entity", F.explode("terms").alias("term")).groupBy("entity", "term")
        .agg(F.count(F.lit(1)).alias("n_ct"), F.min("line_key").alias("a"), F.max("line_key").alias("b"))
        .where("a <> b").select("entity", "term", "n_ct")
    )
    candidates = pairs.select("term").distinct()
    if candidates.count() <= TERM_ROWS:
        candidates = F.broadcast(candidates)
    corpus = docs.select(F.split(text_of(text_column), "\n", -1).alias("lines"))
    total = corpus.agg(F.sum(F.size("lines"))).first()[0] or 0
    words = F.flatten(
        F.transform("lines", lambda s: F.array_distinct(F.split(F.lower(s), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+")))
    )
    n_term = corpus.select(F.explode(words).alias("term")).join(candidates, "term").groupBy("term").agg(F.count(F.lit(1)).alias("n_t"))
    n = F.lit(float(max(1, total)))
    pmi = F.log2(n * F.col("n_ct") / (F.col("n_c").cast("double") * F.col("n_t")))
    ic = F.log2(n / F.col("n_c"))
    scored = pairs.join(n_entity, "entity").join(n_term, "term").select("entity", "term", pmi.alias("pmi"), ic.alias("ic"))
    return scored.where(F.col("pmi") >= generalise * F.col("ic")).withColumn(
        "action", F.when(F.col("pmi") >= remove * F.col("ic"), "removed").otherwise("general")
    )


def personal_spans(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    generalise: float = GENERALISE,
    remove: float = REMOVE,
) -> DataFrame:
    """id, key, email, ip, card, phone (spans), general and removed (spans of disclosing terms)."""
    lines = kept(entity_lines(docs, id_column, text_column))
    terms = disclosing_terms(docs, lines, text_column, generalise, remove)
    each = lines.select("id", "key", F.explode("ents").alias("entity"), "words").select(
        "id", "key", "entity", F.explode("words").alias("w")
    )
    hits = each.join(terms, (each["entity"] == terms["entity"]) & (F.col("w.value") == F.col("term"))).select(
        "id", "key", "w", "action"
    )
    one = hits.groupBy("id", "key", "w").agg(F.max("action").alias("action"))  # "removed" wins
    extra = one.groupBy("id", "key").agg(
        F.array_sort(F.collect_list(F.when(F.col("action") == "general", F.col("w")))).alias("general"),
        F.array_sort(F.collect_list(F.when(F.col("action") == "removed", F.col("w")))).alias("removed"),
    ).select(F.col("id").alias("__id"), F.col("key").alias("__key"), "general", "removed")
    base = with_entities(docs, id_column, text_column)
    own = F.col("id").eqNullSafe(F.col("__id")) & (F.col("key") == F.col("__key"))
    none = F.expr("cast(array() as array<struct<start:bigint,end:bigint,value:string>>)")
    return base.join(extra, own, "left").select(
        "id", "key", *KINDS, F.coalesce("general", none).alias("general"), F.coalesce("removed", none).alias("removed")
    )


def sanitised(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", **options) -> DataFrame:
    """``docs`` with the text column rewritten: entities become [EMAIL], [IP], [CARD] or [PHONE], generalised terms
    become [NUMBER], [NAME] or [TERM] by their shape, removed terms go. Where spans overlap, the earlier and longer
    one counts."""
    spans = personal_spans(docs, id_column, text_column, **options)

    def tagged(name: str, tag) -> Column:
        return F.transform(name, lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("minus_end"), tag(s["value"]).alias("tag")))

    def shape(value: Column) -> Column:
        return F.when(value.rlike(r"\A[0-9]+\z"), "[NUMBER]").otherwise("[TERM]")

    every = F.array_sort(
        F.concat(
            *[tagged(k, lambda v, k=k: F.lit(f"[{k.upper()}]")) for k in KINDS], tagged("general", shape),
            tagged("removed", lambda v: F.lit("")),
        )
    )
    one = spans.groupBy("id", "key").agg(F.first(every).alias("all_spans"))
    text = F.col("text")
    done = F.aggregate(
        "all_spans",
        F.struct(F.lit("").alias("out"), F.lit(0).cast("bigint").alias("at")),
        lambda acc, s: F.when(s["start"] < acc["at"], acc).otherwise(
            F.struct(
                F.concat(acc["out"], F.substring(text, (acc["at"] + 1).cast("int"), (s["start"] - acc["at"]).cast("int")), s["tag"]).alias("out"),
                (-s["minus_end"]).alias("at"),
            )
        ),
        lambda acc: F.concat(acc["out"], F.substring(text, (acc["at"] + 1).cast("int"), F.length(text))),
    )
    rows = docs.select(packed(docs), column(id_column).alias("own_id"), text_of(text_column).alias("text"))
    rows = rows.withColumn("own_key", F.xxhash64("text"))
    joined = rows.join(one, F.col("own_id").eqNullSafe(F.col("id")) & (F.col("own_key") == F.col("key")), "left")
    new = F.when(F.col("doc")[text_column].isNotNull(), F.coalesce(done, text))
    return joined.select(*[new.alias(c) if c == text_column else F.col("doc")[c].alias(c) for c in docs.columns])


def digest_columns(spans: DataFrame) -> DataFrame:
    """The query's columns from ``personal_spans``."""
    base = F.concat(*[named(k, F.col(k)) for k in KINDS])
    more = F.concat(named("general", F.col("general")), named("removed", F.col("removed")))
    return spans.select(
        F.col("id").alias("doc_id"), *[F.size(k).cast("bigint").alias(f"n_{k}") for k in KINDS],
        F.sha2(F.array_join(base, ","), 256).alias("base_sha256"),
        F.array_join(F.concat(base, more), ",").alias("spans"),
    )
