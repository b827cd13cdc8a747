"""The registered queries: Spark plans over the given tables and the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanveil.functions.checks import luhn_ok, normal_value
from spanveil.functions.dialect import java_regex
from spanveil.functions.fixed_values import CATALOGUE, FORMATS, SEED_WORDS
from spanveil.functions.text import compute_once
from spanveil.operators import audit, custom_join, evaluate, scope, sketches, sweep
from spanveil.operators.detectors import detector_catalogue
from spanveil.operators.dictionaries import Dictionaries, NameLists
from spanveil.operators.redact import anonymize, findings
from spanveil.operators.restore import deanonymize, restore_from_scope_vault, restore_from_vault
from spanveil.operators.skew import kept, null_safe_join
from spanveil.operators.spans import RAW, rules_for, with_raw_spans
from spanveil.plans import document_sql as sql
from spanveil.plans.sentences import SENTENCE_SETS, digits, luhn_sql
from spanveil.sources.json_values import anonymize_json
from spanveil.sources.nested_values import anonymize_nested
from spanveil.sources.texts import anonymize_columns, read_table
from spanveil.streaming import jobs

Query = Callable[[SparkSession, str], DataFrame]
CORE = sql.CORE_IDS
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def register(name: str, oracle: str | None = None):
    def add(fn: Query) -> Query:
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn

    return add


def documents(spark: SparkSession, sf: str) -> DataFrame:
    return read_table(spark, f"{sf}/documents.parquet", "doc_id")


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def texts(spark: SparkSession, sf: str) -> DataFrame:
    return documents(spark, sf).select("doc_id", "text")


def longs(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("bigint") for c in columns})


# ------------------------------------------------------------------------------------------------ detectors on sentences
CUSTOM_DICTIONARIES = Dictionaries().add_names(["Quentin Blackwood", "ops_admin", "maria de maria"]).add_patterns(
    [
        {"regex": r"STAFF-\d{6}", "label": "Employee ID", "placeholder": "EMPLOYEE_ID"},
        {"regex": r"\bTASK-\d{4}\b", "flags": "g", "label": "Project Code", "placeholder": "PROJECT_ID"},
    ]
)


def _sentence_query(name: str) -> Query:
    made = SENTENCE_SETS[name]
    words = CUSTOM_DICTIONARIES if name == "custom_dictionaries" else None

    def run(spark: SparkSession, sf: str) -> DataFrame:
        source = read_table(spark, f"{sf}/{made.table}.parquet", made.key).selectExpr(
            f"{made.key} AS doc_id", f"{made.text_sql} AS text"
        )
        found = findings(source, ["doc_id"], detectors=made.detectors, dictionaries=words)
        return longs(found.select("doc_id", "detector", "placeholder", "start", "value"), "start")

    return run


for _name, _set in SENTENCE_SETS.items():
    register(_name, _set.oracle())(_sentence_query(_name))


SEED_TEXT = " ".join(SEED_WORDS)
_SEED_PICK = [f"(o_orderkey * {7 + 2 * j} + {j}) % {len(SEED_WORDS)}" for j in range(12)]


def _seed_line(element: Callable[[str], str]) -> str:
    half = " || ' ' || ".join(element(i) for i in _SEED_PICK[:6])
    rest = " || ' ' || ".join(element(i) for i in _SEED_PICK[6:])
    junk = "'zebra quilt zoom jolly vivid mixer'"
    return (
        f"CASE o_orderkey % 4 WHEN 0 THEN {half} || ' ' || {rest} WHEN 1 THEN '  ' || {half} || ' ' || {junk} "
        f"WHEN 2 THEN {half} || ' ' || {rest} || ' extra' "
        f"ELSE {half.split(' || ')[0]} || ' zoo zip zap zed zig zag zone zinc zen zero zest' END"
    )


_SEED_DUCK = _seed_line(lambda i: f"string_split('{SEED_TEXT}', ' ')[CAST({i} AS BIGINT) + 1]")


@register(
    "seed_phrases",
    f"WITH s AS (SELECT o_orderkey AS doc_id, {_SEED_DUCK} AS line FROM orders) "
    "SELECT doc_id, 6 AS start, line AS value FROM s WHERE doc_id % 4 IN (0, 1)",
)
def seed_phrases(spark, sf):
    line = _seed_line(lambda i: f"split('{SEED_TEXT}', ' ')[cast({i} as int)]")
    source = read_table(spark, f"{sf}/orders.parquet", "o_orderkey").selectExpr(
        "o_orderkey AS doc_id", f"'words' || chr(10) || {line} || chr(10) || 'keep safe' AS text"
    )
    found = findings(source, ["doc_id"], detectors=[]).where("detector = 'seed_phrase'")
    return longs(found.select("doc_id", "start", "value"), "start")


# ------------------------------------------------------------------------------------------------ raw detection
@register(
    "pii_counts_by_doc",
    f"WITH {sql.raw_hits(NameLists())} SELECT doc_id, "
    + ", ".join(f"CAST(count(*) FILTER (detector = '{det}') AS BIGINT) AS n_{det}" for det, *_ in CATALOGUE)
    + " FROM documents LEFT JOIN raw USING (doc_id) GROUP BY doc_id",
)
def pii_counts_by_doc(spark, sf):
    """Raw hits per text of every built-in detector; a plain projection, no shuffle. The text is searched once."""
    rules = rules_for(None)
    df, _ = with_raw_spans(texts(spark, sf), "text", rules)
    df = compute_once(df, seqs=F.transform(RAW, lambda s: s["seq"]))
    place = {s.id: k for k, s in enumerate(rules.sources)}

    def count_of(det_id: str):
        return F.size(F.filter("seqs", lambda s: s == place[det_id])).cast("bigint").alias(f"n_{det_id}")

    return df.select("doc_id", *[count_of(d) for d, *_ in CATALOGUE])


@register(
    "email_spans",
    f"SELECT doc_id, start, start + length(value) AS \"end\", value FROM ({sql.hits('documents', 'doc_id', sql.EMAIL_RE)})",
)
def email_spans(spark, sf):
    found = findings(texts(spark, sf), ["doc_id"], detectors=["email"], raw=True).where("detector = 'email'")
    return longs(found.select("doc_id", "start", "end", "value"), "start", "end")


@register("document_names", sql.names_sql(NameLists()))
def document_names(spark, sf):
    found = findings(texts(spark, sf), ["doc_id"], detectors=["name_dictionary"], raw=True)
    return longs(found.where("detector = 'name_dictionary'").select("doc_id", "start", "value"), "start")


@register(
    "luhn_cards",
    f"SELECT doc_id, value, {luhn_sql('value')} AS valid FROM (SELECT doc_id, unnest(regexp_extract_all(text, '{sql.CARD_RE}', 1)) AS value FROM documents)",
)
def luhn_cards(spark, sf):
    shaped = java_regex(FORMATS["credit_card"], word_start=True)
    return (
        texts(spark, sf)
        .select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(shaped), F.lit(0))).alias("value"))
        .select("doc_id", "value", luhn_ok(F.col("value")).alias("valid"))
    )


_PAGE_HITS = f"{sql.raw_hits(NameLists(), 'pages', 'page_id', 'html')}, h AS (SELECT * FROM raw)"


@register(
    "page_findings",
    f"WITH {_PAGE_HITS} SELECT detector, count(*) AS n_found, count(DISTINCT page_id) AS n_pages FROM h GROUP BY detector",
)
def page_findings(spark, sf):
    pages = read_table(spark, f"{sf}/pages.parquet", "page_id").select("page_id", "html")
    found = findings(pages, ["page_id"], text_col="html", raw=True)
    per_page = found.groupBy("detector", "page_id").agg(F.count(F.lit(1)).alias("n"))
    return per_page.groupBy("detector").agg(F.sum("n").alias("n_found"), F.count(F.lit(1)).alias("n_pages"))


@register(
    "detector_usage",
    f"WITH {sql.raw_hits(NameLists())}, c(position, id, tier) AS (VALUES "
    + ", ".join(f"({i}, '{d[0]}', '{d[2]}')" for i, d in enumerate(CATALOGUE))
    + ") SELECT c.position, c.id, c.tier, count(h.doc_id) AS n_found FROM c LEFT JOIN raw h ON h.detector = c.id GROUP BY ALL",
)
def detector_usage(spark, sf):
    """The catalogue with the number of findings of each detector."""
    found = findings(texts(spark, sf), ["doc_id"], raw=True).groupBy("detector").agg(
        F.count(F.lit(1)).alias("n")
    )
    catalogue = detector_catalogue(spark)
    return catalogue.join(found, F.col("id") == F.col("detector"), "left").select(
        "position", "id", "tier", F.coalesce("n", F.lit(0)).alias("n_found")
    )


# ------------------------------------------------------------------------------------------------ redaction
def all_anonymized(spark, sf, *extra: str) -> DataFrame:
    return anonymize(documents(spark, sf).select("doc_id", "text", *extra))


@register(
    "document_findings",
    f"{sql.DOC_TAGS} SELECT doc_id, start, start + length(value) AS \"end\", detector, placeholder, value, tag FROM tags",
)
def document_findings(spark, sf):
    found = findings(texts(spark, sf), ["doc_id"])
    return longs(found.select("doc_id", "start", "end", "detector", "placeholder", "value", "tag"), "start", "end")


@register(
    "redact_documents",
    f"{sql.DOC_TAGS}, {sql.rendered()} SELECT doc_id, anonymized, n AS n_found FROM red",
)
def redact_documents(spark, sf):
    return all_anonymized(spark, sf).select("doc_id", "anonymized", F.col("count").cast("bigint").alias("n_found"))


@register("vault", f"{sql.DOC_TAGS}, {sql.ENTITIES} SELECT doc_id, tag, type, value, first FROM ents")
def vault(spark, sf):
    return longs(scope.document_vault(all_anonymized(spark, sf), "doc_id"), "first")


@register("roundtrip_ok", sql.ROUND_TRIP)
def roundtrip_ok(spark, sf):
    done = deanonymize(all_anonymized(spark, sf))
    return done.select("doc_id", F.col("restored").eqNullSafe(F.col("text")).alias("ok"))


@register("vault_restore", sql.ROUND_TRIP)
def vault_restore(spark, sf):
    """Redact, keep only the redacted texts and the vault, and restore them by a join."""
    done = kept(all_anonymized(spark, sf).select("doc_id", "anonymized", "entities"))
    restored = restore_from_vault(done.select("doc_id", "anonymized"), scope.document_vault(done, "doc_id"), "doc_id")
    return (
        restored.join(texts(spark, sf), "doc_id")
        .select("doc_id", F.col("restored").eqNullSafe(F.col("text")).alias("ok"))
    )


@register("masked_findings", (
    f"{sql.DOC_TAGS}, {sql.ENTITIES} SELECT e.doc_id, e.type, e.tag, {sql.MASK} AS masked, "
    "CAST(len(string_split(substr(d.text, 1, strpos(d.text, e.value) - 1), chr(10))) AS BIGINT) AS line "
    "FROM ents e JOIN documents d USING (doc_id)"
))
def masked_findings(spark, sf):
    report = audit.entity_report(all_anonymized(spark, sf), ["doc_id"])
    return longs(report.select("doc_id", "type", F.col("placeholder").alias("tag"), "masked", "line"), "line")


@register("context_snippets", (
    f"{sql.DOC_TAGS}, {sql.ENTITIES}, p AS (SELECT e.*, d.text, strpos(d.text, e.value) - 1 AS spot FROM ents e JOIN documents d USING (doc_id)) "
    "SELECT doc_id, tag, CASE WHEN spot > 30 THEN '...' ELSE '' END || replace(substr(text, greatest(spot - 30, 0) + 1, "
    "least(spot + length(value) + 30, length(text)) - greatest(spot - 30, 0)), chr(10), ' ') || "
    "CASE WHEN spot + length(value) + 30 < length(text) THEN '...' ELSE '' END AS context FROM p"
))
def context_snippets(spark, sf):
    report = audit.entity_report(all_anonymized(spark, sf), ["doc_id"])
    return report.select("doc_id", F.col("placeholder").alias("tag"), "context")


@register("grouped_by_type", (
    f"{sql.DOC_TAGS}, {sql.ENTITIES}, m AS (SELECT *, {sql.MASK} AS masked FROM ents) "
    "SELECT doc_id, type, count(*) AS n_entities, string_agg(masked, '|' ORDER BY first) AS masked FROM m GROUP BY doc_id, type"
))
def grouped_by_type(spark, sf):
    grouped = audit.grouped_by_type(all_anonymized(spark, sf), ["doc_id"])
    return grouped.select("doc_id", "type", F.col("n_entities").cast("bigint"), F.array_join("masked", "|").alias("masked"))


@register("text_summary", (
    f"{sql.DOC_TAGS}, {sql.ENTITIES}, k AS (SELECT doc_id, type, min(first) AS f, count(*) AS n FROM ents GROUP BY doc_id, type), "
    "a AS (SELECT doc_id, string_agg(type, ',' ORDER BY f) AS types FROM k GROUP BY doc_id), "
    "m AS (SELECT doc_id, string_agg(type || ' ' || tag || ' ' || value, '|' ORDER BY first) AS findings FROM ents GROUP BY doc_id), "
    "c AS (SELECT doc_id, count(*) AS n FROM tags GROUP BY doc_id) "
    "SELECT d.doc_id, CAST(coalesce(c.n, 0) AS BIGINT) AS pii_count, c.n IS NULL AS clean, coalesce(a.types, '') AS types, "
    "coalesce(m.findings, '') AS findings FROM documents d LEFT JOIN a USING (doc_id) LEFT JOIN c USING (doc_id) LEFT JOIN m USING (doc_id)"
))
def text_summary(spark, sf):
    made = audit.text_summary(all_anonymized(spark, sf), ["doc_id"])
    return made.select(
        "doc_id", F.col("pii_count").cast("bigint"), "clean", F.array_join("detected_types", ",").alias("types"),
        F.array_join(F.transform("findings", lambda f: F.concat_ws(" ", f["type"], f["placeholder"], f["value"])), "|").alias("findings"),
    )


# ------------------------------------------------------------------------------------------------ audits
@register("type_counts", (
    f"{sql.DOC_TAGS}, {sql.ENTITIES} SELECT d.source, e.type, count(*) AS n_entities FROM ents e JOIN documents d USING (doc_id) GROUP BY ALL"
))
def type_counts(spark, sf):
    return audit.type_counts(all_anonymized(spark, sf, "source"), ["source"])


@register("pii_profile_by_source", (
    f"{sql.DOC_TAGS} SELECT d.source, t.placeholder, count(*) AS n_found, GROUPING(d.source, t.placeholder) AS level "
    "FROM tags t JOIN documents d USING (doc_id) GROUP BY ROLLUP (d.source, t.placeholder)"
))
def pii_profile_by_source(spark, sf):
    found = findings(documents(spark, sf).select("doc_id", "source", "text"), ["doc_id", "source"])
    return audit.profile(found, ["source"])


@register("pii_rates_by_source", (
    f"{sql.DOC_TAGS}, n AS (SELECT doc_id, count(*) AS n FROM tags GROUP BY doc_id) "
    "SELECT lang, source, count(*) AS n_texts, count(n) AS n_with_findings, CAST(coalesce(sum(n), 0) AS BIGINT) AS n_found, "
    "GROUPING(lang, source) AS level, coalesce(sum(n), 0) / count(*) AS per_text "
    "FROM documents LEFT JOIN n USING (doc_id) GROUP BY ROLLUP (lang, source)"
))
def pii_rates_by_source(spark, sf):
    """Texts, texts with findings and findings per text, by language and source with subtotals."""
    source = documents(spark, sf).select("doc_id", "lang", "source", "text")
    return audit.rates(findings(source, ["doc_id", "lang", "source"]), source, ["doc_id"], ["lang", "source"])


@register("top_sources", (
    f"{sql.DOC_TAGS} SELECT d.source, count(*) AS n_found FROM tags t JOIN documents d USING (doc_id) GROUP BY d.source "
    "ORDER BY n_found DESC, d.source LIMIT 10"
))
def top_sources(spark, sf):
    found = findings(documents(spark, sf).select("source", "text"), ["source"])
    return found.groupBy("source").agg(F.count(F.lit(1)).alias("n_found")).orderBy(F.desc("n_found"), "source").limit(10)


@register("distinct_entities", (
    f"{sql.DOC_TAGS} SELECT d.source, t.placeholder, count(DISTINCT t.norm) AS n_distinct, true AS estimate_close "
    "FROM tags t JOIN documents d USING (doc_id) GROUP BY d.source, t.placeholder"
))
def distinct_entities(spark, sf):
    """Different entities by source and type, and whether sketches made by language and source, then united, come within
    3 % of the exact count."""
    found = findings(documents(spark, sf).select("lang", "source", "text"), ["lang", "source"])
    found = kept(found.select("lang", "source", "placeholder", "value"))
    norm = normal_value(F.col("value"), F.col("placeholder"))
    exact = found.groupBy("source", "placeholder").agg(F.count_distinct(norm).alias("n_distinct"))
    by_both = sketches.entity_sketches(found, ["lang", "source"])
    close = sketches.distinct_counts(sketches.united(by_both, ["source"])).withColumnRenamed("n_distinct", "estimate")
    return null_safe_join(exact, close, ["source", "placeholder"]).select(
        "source", "placeholder", "n_distinct",
        (F.abs(F.col("estimate") - F.col("n_distinct")) <= 0.03 * F.col("n_distinct")).alias("estimate_close"),
    )


_SEVERITY = (
    f"{sql.DOC_TAGS}, v AS (SELECT doc_id, CASE WHEN bool_or(placeholder IN ('SSN', 'CREDIT_CARD', 'BANK_ACCOUNT', "
    "'ROUTING_NUMBER', 'ACCESS_TOKEN')) THEN 'HIGH' ELSE 'MEDIUM' END AS severity FROM tags GROUP BY doc_id)"
)


@register(
    "severity_gate",
    f"{_SEVERITY} SELECT d.doc_id, l.quality, l.toxic, v.severity, v.severity IS NULL AS clean "
    "FROM documents d JOIN labels l USING (doc_id) LEFT JOIN v USING (doc_id)",
)
def severity_gate(spark, sf):
    """Verdicts for the labelled texts; only those are searched."""
    labels = table(spark, sf, "labels")
    labelled = texts(spark, sf).join(labels.select("doc_id").distinct(), "doc_id", "left_semi")
    judged = audit.with_verdict(anonymize(labelled)).select("doc_id", "severity", "clean")
    return judged.join(labels, "doc_id").select("doc_id", "quality", "toxic", "severity", "clean")


@register(
    "gate_split",
    f"{_SEVERITY} SELECT d.lang, CASE WHEN v.doc_id IS NULL THEN 'clean' ELSE 'quarantine' END AS lane, count(*) AS n_docs "
    "FROM documents d LEFT JOIN v USING (doc_id) GROUP BY ALL",
)
def gate_split(spark, sf):
    judged = audit.with_lane(all_anonymized(spark, sf, "lang"))
    return judged.groupBy("lang", "lane").agg(F.count(F.lit(1)).alias("n_docs"))


# ------------------------------------------------------------------------------------------------ wider scopes
def _occurrences(spark, sf) -> DataFrame:
    return kept(findings(documents(spark, sf).select("doc_id", "source", "text"), ["doc_id", "source"]))


_BY_SOURCE = (
    f"WITH h0 AS (WITH RECURSIVE {sql.resolved_hits(NameLists())} SELECT h.*, d.source, h.doc_id * 10000000 + h.start AS pos FROM h JOIN documents d USING (doc_id)), "
    f"h AS (SELECT * FROM h0), {sql.tagged('source', 'pos')}"
)
_CORPUS = (
    f"WITH h0 AS (WITH RECURSIVE {sql.resolved_hits(NameLists())} SELECT h.*, h.doc_id * 10000000 + h.start AS pos FROM h), "
    f"h AS (SELECT * FROM h0), {sql.tagged('', 'pos')}"
)


@register(
    "scope_numbering",
    f"{_BY_SOURCE} SELECT source, placeholder, norm, CAST(any_value(n) AS BIGINT) AS n, any_value(tag) AS tag, "
    "arg_max(value, pos) AS value, count(*) AS occurrences FROM tags GROUP BY source, placeholder, norm",
)
def scope_numbering(spark, sf):
    """Entities numbered per source; buckets of text ids keep every window small."""
    found = scope.entities_in_scope(_occurrences(spark, sf), "source", ["doc_id", "start"])
    bounds = scope.position_bounds(table(spark, sf, "documents"), "doc_id")
    numbered = scope.number_entities(found, "source", bounds)
    return numbered.select(
        "source", "placeholder", "norm", F.col("n").cast("bigint"), "tag", "value", "occurrences"
    )


@register(
    "corpus_numbering",
    f"{_CORPUS} SELECT placeholder, norm, CAST(any_value(n) AS BIGINT) AS n, any_value(tag) AS tag FROM tags GROUP BY placeholder, norm",
)
def corpus_numbering(spark, sf):
    found = scope.entities_in_scope(_occurrences(spark, sf), None, ["doc_id", "start"])
    bounds = scope.position_bounds(table(spark, sf, "documents"), "doc_id")
    return scope.number_entities(found, None, bounds).select("placeholder", "norm", F.col("n").cast("bigint"), "tag")


@register(
    "scope_redaction",
    f"{_BY_SOURCE}, {sql.rendered()} SELECT doc_id, anonymized FROM red",
)
def scope_redaction(spark, sf):
    """Texts redacted with numbers that are consistent over their source."""
    found = _occurrences(spark, sf)
    bounds = scope.position_bounds(found, "doc_id")
    numbered = scope.number_entities(scope.entities_in_scope(found, "source", ["doc_id", "start"]), "source", bounds)
    done = scope.redact_in_scope(
        documents(spark, sf).select("doc_id", "source", "text"), found, numbered, "doc_id", "source"
    )
    return done.select("doc_id", F.when(F.col("text").rlike(r"\S"), F.col("anonymized")).otherwise("").alias("anonymized"))


@register("scope_restore", (
    f"{_BY_SOURCE}, lossy AS (SELECT source, tag FROM tags GROUP BY source, tag HAVING count(DISTINCT value) > 1), "
    "last AS (SELECT source, tag, arg_max(value, pos) AS value FROM tags GROUP BY source, tag), "
    "off AS (SELECT DISTINCT t.doc_id FROM tags t JOIN last l USING (source, tag) WHERE t.value <> l.value) "
    "SELECT doc_id, doc_id NOT IN (SELECT doc_id FROM off) AS ok FROM documents"
))
def scope_restore(spark, sf):
    """Texts redacted over their source and restored from the source's vault."""
    found = _occurrences(spark, sf)
    bounds = scope.position_bounds(found, "doc_id")
    numbered = kept(
        scope.number_entities(scope.entities_in_scope(found, "source", ["doc_id", "start"]), "source", bounds)
    )
    source = documents(spark, sf).select("doc_id", "source", "text")
    done = scope.redact_in_scope(source, found, numbered, "doc_id", "source")
    restored = restore_from_scope_vault(done, scope.vault(numbered, "source"), "doc_id", "source")
    return restored.select("doc_id", F.col("restored").eqNullSafe(F.coalesce("text", F.lit(""))).alias("ok"))


_TURN = (
    "coalesce(text, '') || ' reply to ' || role || cast(conv_id % 7 as string) || '@example.com or +1 555-' || "
    f"{digits('conv_id % 3 + turn % 2', 3)} || '-4567 .'"
)
_TURN_HITS = (
    f"WITH RECURSIVE c AS (SELECT conv_id * 100000 + turn AS cid, conv_id, turn, {_TURN} AS text FROM conversations), "
    f"hits AS (WITH RECURSIVE {sql.resolved_hits(NameLists(), 'c', 'cid')} SELECT h.*, c.conv_id, c.turn, c.turn * 10000000 + h.start AS pos "
    "FROM h JOIN c USING (cid)), h AS (SELECT * FROM hits)"
)


def conversation_turns(df: DataFrame) -> DataFrame:
    """Turns of a table or stream with a sentence behind each real text, so that every turn holds something to number."""
    return df.selectExpr("conv_id", "turn", f"{_TURN} AS text")


@register("conversation_scope", (
    f"{_TURN_HITS}, {sql.tagged('conv_id', 'pos')}, {sql.rendered('cid', 'c')} "
    "SELECT conv_id, turn, anonymized FROM red JOIN c USING (cid)"
))
def conversation_scope(spark, sf):
    """Turns of a conversation share their numbering."""
    turns = conversation_turns(read_table(spark, f"{sf}/conversations.parquet", "conv_id"))
    found = kept(findings(turns, ["conv_id", "turn"]))
    bounds = scope.position_bounds(found, "turn")
    numbered = scope.number_entities(scope.entities_in_scope(found, "conv_id", ["turn", "start"]), "conv_id", bounds)
    done = scope.redact_in_scope(turns, found, numbered, ["conv_id", "turn"], "conv_id")
    return done.select("conv_id", "turn", "anonymized")


# ------------------------------------------------------------------------------------------------ custom names by join
_NAME_TEXT = (
    "CASE c_custkey % 4 WHEN 0 THEN 'Call ' || upper(c_name) || '; now' WHEN 1 THEN 'Call ' || c_name || '. Now' "
    "WHEN 2 THEN '(' || c_name || ')' ELSE 'x' || c_name || ' and ' || c_name END"
)


@register("custom_names_join", (
    f"WITH s AS (SELECT c_custkey, c_name, {_NAME_TEXT} AS text FROM customer) "
    "SELECT c_custkey AS doc_id, CAST(CASE c_custkey % 4 WHEN 0 THEN 5 WHEN 2 THEN 1 ELSE length(text) - length(c_name) END AS BIGINT) AS start, "
    "CAST(length(c_name) AS BIGINT) AS len FROM s WHERE c_custkey % 4 <> 1"
))
def custom_names_join(spark, sf):
    """Every customer's name as a dictionary over sentences about customers."""
    customers = table(spark, sf, "customer")
    names = custom_join.prepare_names(customers.select(F.col("c_name").alias("name")))
    about = customers.selectExpr("c_custkey AS doc_id", f"{_NAME_TEXT} AS text")
    return longs(custom_join.custom_name_hits(about, "doc_id", names), "start", "len")


# ------------------------------------------------------------------------------------------------ overlaps
_OVERLAP = (
    "'tel 4' || lpad(cast(o_orderkey % 100 as string), 2, '0') || '-12-' || lpad(cast(o_orderkey % 10000 as string), 4, '0') || "
    "' at 10.1.' || cast(o_orderkey % 200 as string) || '.9 routing: ' || lpad(cast(o_orderkey as string), 9, '0') || '.'"
)
_OVERLAP_RULES = [
    ("routing_number", 8, 0, r"(?i)\brouting[#:\s]*(\d{9})\b", "ROUTING_NUMBER"),
    ("ssn", 11, 1000, r"(\b(?:[1-57-9]\d\d|0(?:[1-9]\d|0[1-9])|6(?:[0-57-9]\d|6[0-57-9]))-\d{2}-\d{4}\b)", "SSN"),
    ("ipv4", 15, 1000, sql.IPV4_RE, "IP_ADDRESS"),
    ("phone_contextual", 19, 0, r"(?i)\b(?:tel|phone|ph|mobile|mob|cell|fax|contact|call|number|no)\s*[:\-#]?\s*(\(?\+?\d[\d\s.\-()]{6,19}[\d)])", "PHONE_NUMBER"),
    ("us_zip", 21, 0, r"(\b\d{5}(?:-\d{4})?\b)", "ZIP_CODE"),
]


@register("overlap_resolved", (
    f"WITH RECURSIVE s AS (SELECT o_orderkey AS doc_id, {_OVERLAP} AS text FROM orders), raw AS ("
    + " UNION ALL ".join(
        f"SELECT doc_id, '{p}' AS placeholder, v AS value, strpos(text, v) - 1 AS start, length(v) AS len, length(v) - {bonus} AS rank, {seq} AS seq "
        f"FROM (SELECT doc_id, text, unnest(regexp_extract_all(text, '{regex}', 1)) AS v FROM s)"
        for _, seq, bonus, regex, p in _OVERLAP_RULES
    )
    + "), o AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY start, rank, len, seq) AS i FROM raw), "
    "walk AS (SELECT doc_id, i, placeholder, value, start, start + len AS reach, true AS kept FROM o WHERE i = 1 UNION ALL "
    "SELECT o.doc_id, o.i, o.placeholder, o.value, o.start, CASE WHEN o.start >= w.reach THEN o.start + o.len ELSE w.reach END, o.start >= w.reach "
    "FROM walk w JOIN o ON o.doc_id = w.doc_id AND o.i = w.i + 1) "
    "SELECT doc_id, CAST(start AS BIGINT) AS start, placeholder, value FROM walk WHERE kept"
))
def overlap_resolved(spark, sf):
    """Sentences whose detectors clash (a phone number that is also an SSN and reaches into an address)."""
    source = read_table(spark, f"{sf}/orders.parquet", "o_orderkey").selectExpr("o_orderkey AS doc_id", f"{_OVERLAP} AS text")
    found = findings(source, ["doc_id"], detectors=[r[0] for r in _OVERLAP_RULES])
    return longs(found.select("doc_id", "start", "placeholder", "value"), "start")


# ------------------------------------------------------------------------------------------------ the whole engine
_PROFILE = (
    "'Customer Mary Johnson' || chr(10) || 'Email mary.' || cast(c_custkey as string) || '@example.org' || chr(10) || "
    f"'SSN: 4' || {digits('c_custkey % 100', 2)} || '-55-' || {digits('c_custkey % 10000', 4)} || chr(10) || "
    f"'Call me at +1 555-' || {digits('c_custkey % 1000', 3)} || '-4567' || chr(10) || 'Ship to ' || cast(c_custkey + 1 as string) || ' Oak Street' || chr(10) || "
    f"'Wallet 0x' || {'md5(cast(c_custkey as string))'} || '00000000' || chr(10) || 'again Mary, MARY and Johnson' || chr(10)"
)
_REDACTED = (
    "'Customer [PERSON_NAME_1] [PERSON_NAME_2]' || chr(10) || 'Email [EMAIL]' || chr(10) || 'SSN: [SSN]' || chr(10) || "
    "'Call me at [PHONE_NUMBER]' || chr(10) || 'Ship to [STREET_ADDRESS]' || chr(10) || 'Wallet [CRYPTO_ADDRESS]' || chr(10) || "
    "'again [PERSON_NAME_1], [PERSON_NAME_1] and [PERSON_NAME_2]' || chr(10)"
)


@register("profiles_anonymized", (
    f"SELECT c_custkey AS doc_id, {_REDACTED} AS anonymized, CAST(10 AS BIGINT) AS n_found, "
    "'PERSON_NAME,EMAIL,SSN,PHONE_NUMBER,STREET_ADDRESS,CRYPTO_ADDRESS' AS types, 'MARY' AS last_name_value FROM customer"
))
def profiles_anonymized(spark, sf):
    """All detectors at once over one profile per customer."""
    source = read_table(spark, f"{sf}/customer.parquet", "c_custkey").selectExpr("c_custkey AS doc_id", f"{_PROFILE} AS text")
    done = anonymize(source)
    return done.select(
        "doc_id", "anonymized", F.col("count").cast("bigint").alias("n_found"),
        F.array_join("detected_types", ",").alias("types"),
        F.col("entity_map")["[PERSON_NAME_1]"].alias("last_name_value"),
    )


@register("anonymize_all_documents", (
    f"WITH RECURSIVE {sql.resolved_hits(NameLists())}, {sql.tagged('doc_id')}, {sql.rendered()} "
    "SELECT doc_id, anonymized, n AS n_found FROM red"
))
def anonymize_all_documents(spark, sf):
    """Every detector over the whole corpus. The SQL knows the detectors that find something in it."""
    done = anonymize(texts(spark, sf))
    return done.select("doc_id", "anonymized", F.col("count").cast("bigint").alias("n_found"))


@register("redact_columns", (
    "SELECT s_suppkey, 'mail [EMAIL]' AS mail, 'call [PHONE_NUMBER]' AS phone, CAST(1 AS BIGINT) AS n_mail, "
    "CAST(1 AS BIGINT) AS n_phone FROM supplier"
))
def redact_columns(spark, sf):
    """Several text columns of one table."""
    source = table(spark, sf, "supplier").selectExpr(
        "s_suppkey", "'mail s' || cast(s_suppkey as string) || '@example.com' AS mail",
        f"'call +1 555-' || {digits('s_suppkey % 1000', 3)} || '-4567' AS phone",
    )
    done = anonymize_columns(source, ["mail", "phone"], detectors=["email", "phone_intl"])
    return done.select(
        "s_suppkey", "mail", "phone", F.size("mail_entities").cast("bigint").alias("n_mail"),
        F.size("phone_entities").cast("bigint").alias("n_phone"),
    )


# ------------------------------------------------------------------------------------------------ evaluation
_E = "'u' || cast(o_orderkey as string) || '@example.com'"
_CASE_TEXT = f"'Mail ' || {_E} || ' on ' || cast(cast(o_orderdate as date) as string) || ' at 10.0.0.' || cast(o_orderkey % 200 as string) || ' .'"


def _cases(spark, sf) -> DataFrame:
    """Cases with planted faults: by ``o_orderkey % 6`` all right, a partial value, a missing value, a wrong type, an
    allowed other type, and one value left out."""
    orders = read_table(spark, f"{sf}/orders.parquet", "o_orderkey").selectExpr(
        "o_orderkey AS case_id", "o_orderkey % 6 AS fault", "o_orderstatus AS category", "o_orderpriority AS template",
        f"{_CASE_TEXT} AS text", f"{_E} AS mail", "cast(cast(o_orderdate as date) as string) AS day",
        "'10.0.0.' || cast(o_orderkey % 200 as string) AS ip",
    )

    def expect(value, kind, semantic=None, allow=F.lit(False)):
        return F.struct(
            value.alias("value"), F.lit(kind).alias("expected_type"), F.lit(semantic or kind).alias("semantic_type"),
            allow.alias("allow_type_mismatch"),
        )

    fault = F.col("fault")
    mail = F.when(fault == 1, F.regexp_replace("mail", "@.*", "")).when(fault == 2, F.lit("nobody@nowhere")).otherwise(F.col("mail"))
    listed = F.array(
        expect(mail, "EMAIL"),
        F.when(fault == 3, expect(F.col("day"), "SSN")).when(fault == 4, expect(F.col("day"), "SSN", "DATE_OF_ORDER", F.lit(True)))
        .otherwise(expect(F.col("day"), "DATE")),
    )
    expected = F.when(fault == 5, listed).otherwise(F.concat(listed, F.array(expect(F.col("ip"), "IP_ADDRESS"))))
    return orders.select("case_id", "category", "template", "text", expected.alias("expected"))


def _evaluated(spark, sf) -> DataFrame:
    return evaluate.evaluate_cases(_cases(spark, sf), ["email", "date_full", "ipv4"])


@register("eval_issues", (
    f"WITH s AS (SELECT o_orderkey AS case_id, o_orderkey % 6 AS fault, {_E} AS mail, cast(cast(o_orderdate as date) as string) AS day, "
    "'10.0.0.' || cast(o_orderkey % 200 as string) AS ip FROM orders) "
    "SELECT case_id, 'overcapture' AS kind, split_part(mail, '@', 1) AS value, mail AS actual_value FROM s WHERE fault = 1 "
    "UNION ALL SELECT case_id, 'missing_detection', 'nobody@nowhere', NULL FROM s WHERE fault = 2 "
    "UNION ALL SELECT case_id, 'unexpected_detection', NULL, mail FROM s WHERE fault = 2 "
    "UNION ALL SELECT case_id, 'type_mismatch', day, NULL FROM s WHERE fault = 3 "
    "UNION ALL SELECT case_id, 'taxonomy_mismatch', day, NULL FROM s WHERE fault = 4 "
    "UNION ALL SELECT case_id, 'unexpected_detection', NULL, ip FROM s WHERE fault = 5"
))
def eval_issues(spark, sf):
    return evaluate.issues(_evaluated(spark, sf), ["case_id"]).select("case_id", "kind", "value", "actual_value")


@register("eval_summary", (
    "SELECT o_orderstatus AS category, o_orderpriority AS template, count(*) AS total, GROUPING(o_orderstatus, o_orderpriority) AS level, "
    "CAST(sum(CASE WHEN o_orderkey % 6 IN (0, 1, 4) THEN 1 ELSE 0 END) AS BIGINT) AS core_passed, "
    "CAST(sum(CASE WHEN o_orderkey % 6 = 0 THEN 1 ELSE 0 END) AS BIGINT) AS strict_passed "
    "FROM orders GROUP BY GROUPING SETS ((o_orderstatus, o_orderpriority), (o_orderstatus), (o_orderpriority), ())"
))
def eval_summary(spark, sf):
    return evaluate.summary(_evaluated(spark, sf), ["category", "template"])


@register("eval_issue_counts", (
    "SELECT kind, is_warning, count(*) AS n FROM (SELECT o_orderkey % 6 AS fault FROM orders) o JOIN (VALUES (1, 'overcapture', false), "
    "(2, 'missing_detection', false), (2, 'unexpected_detection', false), (3, 'type_mismatch', false), "
    "(4, 'taxonomy_mismatch', true), (5, 'unexpected_detection', false)) k(fault, kind, is_warning) USING (fault) GROUP BY kind, is_warning"
))
def eval_issue_counts(spark, sf):
    return evaluate.issue_counts(_evaluated(spark, sf))


@register("eval_failure_sample", (
    "SELECT o_orderkey AS case_id FROM orders WHERE o_orderkey % 6 <> 0 ORDER BY o_orderkey LIMIT 200"
))
def eval_failure_sample(spark, sf):
    return evaluate.failures(_evaluated(spark, sf), "case_id").select("case_id")


_SWEEP_ROWS = ", ".join(
    f"('{category}', '{name}')" for category, names in (("positive", sweep.TEMPLATES), ("negative", sweep.NEGATIVES)) for name in names
)


@register("sweep_summary", (
    f"WITH t AS (SELECT * FROM (VALUES {_SWEEP_ROWS}) v(category, template), customer) "
    "SELECT category, template, count(*) AS total, count(*) AS core_passed, count(*) AS strict_passed, "
    "GROUPING(category, template) AS level, true AS reached FROM t GROUP BY GROUPING SETS ((category, template), (category))"
))
def sweep_summary(spark, sf):
    """A profile for every customer in every template, and negatives: all values found, nothing else, all texts restored."""
    return sweep.sweep_summary(sweep.profiles(table(spark, sf, "customer"), "c_custkey"), {"positive": 0.9933, "negative": 0.9333})


@register("leak_checks", (
    "SELECT o_orderkey AS case_id, o_orderkey % 4 IN (0) AS ok, CASE o_orderkey % 4 WHEN 0 THEN '' WHEN 1 THEN 'count' "
    "WHEN 2 THEN 'leaked order' ELSE 'missing SSN,unexpected EMAIL' END AS failed FROM orders"
))
def leak_checks(spark, sf):
    """Expected and forbidden types, exact counts, leaks and round trips, checked row by row."""
    fault = F.col("case_id") % 4
    source = read_table(spark, f"{sf}/orders.parquet", "o_orderkey").selectExpr(
        "o_orderkey AS case_id", f"'your order by ' || {_E} || ' came' AS text", f"{_E} AS mail"
    )
    checks = source.select(
        "case_id", "text",
        F.when(fault == 3, F.array(F.lit("SSN"))).otherwise(F.array(F.lit("EMAIL"))).alias("expected_types"),
        F.when(fault == 3, F.array(F.lit("EMAIL"))).otherwise(F.array(F.lit("IBAN"))).alias("forbidden_types"),
        F.when(fault == 2, F.array(F.col("mail"), F.lit("order"))).otherwise(F.array(F.col("mail"))).alias("sensitive_values"),
        F.when(fault == 1, 2).otherwise(1).alias("expect_count"),
        F.lit(True).alias("expect_roundtrip"),
    )
    done = evaluate.check_texts(checks, ["email"])
    return done.select("case_id", "ok", F.array_join("failed", ",").alias("failed"))


# ------------------------------------------------------------------------------------------------ events over time
_EVENT_TEXT = (
    "coalesce(props, '') || ' ' || CASE WHEN event_id % 3 = 0 THEN 'mail u' || cast(user_id as string) || '@example.com' "
    "WHEN event_id % 3 = 1 THEN 'host 10.0.0.' || cast(user_id % 200 as string) || ' up' ELSE 'nothing here' END"
)
_EVENT_HITS = (
    "e AS (SELECT *, CASE event_id % 3 WHEN 0 THEN 'EMAIL' ELSE 'IP_ADDRESS' END AS placeholder FROM events WHERE event_id % 3 < 2)"
)


def _event_findings(spark, sf) -> DataFrame:
    events = read_table(spark, f"{sf}/events.parquet", "event_id").selectExpr(
        "event_id", "ts", "user_id", f"{_EVENT_TEXT} AS text"
    )
    return findings(events, ["event_id", "ts", "user_id"])


_EVENT_JSON = (
    """'{"who": {"mail": "u' || cast(user_id as string) || '@example.com", "seen at": ["10.0.0.' || cast(user_id % 200 as string) """
    """|| '", "up"]}, "card": 4111111111111111, "props": ' || coalesce(props, 'null') || '}'"""
)


@register("props_redacted", (
    """SELECT event_id, '{"who": {"mail": "[EMAIL]", "seen at": ["[IP_ADDRESS]", "up"]}, "card": "[CREDIT_CARD]", "props": ' """
    """|| coalesce(props, 'null') || '}' AS props, CAST(3 AS BIGINT) AS n_found FROM events"""
))
def props_redacted(spark, sf):
    """The values of a JSON column redacted, its structure and keys kept."""
    events = read_table(spark, f"{sf}/events.parquet", "event_id").selectExpr("event_id", f"{_EVENT_JSON} AS props")
    return longs(anonymize_json(events, "props").select("event_id", "props", F.col("count").alias("n_found")), "n_found")


@register("nested_redacted", (
    "SELECT event_id, '[EMAIL]' AS mail, '[IP_ADDRESS]|up' AS seen, '[CREDIT_CARD]' AS card, props, event_id AS n, "
    "CAST(3 AS BIGINT) AS n_found FROM events"
))
def nested_redacted(spark, sf):
    """The strings of a nested column redacted in place, at every depth, all else kept."""
    events = read_table(spark, f"{sf}/events.parquet", "event_id").selectExpr(
        "event_id",
        "named_struct('who', named_struct('mail', 'u' || user_id || '@example.com', 'seen', array('10.0.0.' || (user_id % 200), 'up')), "
        "'more', map('card', '4111111111111111', 'props', props), 'n', event_id) AS event",
    )
    event = F.col("event")
    return longs(anonymize_nested(events, "event").select(
        "event_id", event["who"]["mail"].alias("mail"), F.array_join(event["who"]["seen"], "|").alias("seen"),
        event["more"]["card"].alias("card"), event["more"]["props"].alias("props"), event["n"].alias("n"),
        F.col("count").alias("n_found"),
    ), "n_found")


@register("windowed_pii", (
    f"WITH {_EVENT_HITS} SELECT time_bucket(INTERVAL '1 hour', ts) AS window_start, time_bucket(INTERVAL '1 hour', ts) + INTERVAL '1 hour' AS window_end, "
    "placeholder, count(*) AS n_found FROM e GROUP BY ALL"
))
def windowed_pii(spark, sf):
    return jobs.rate_per_window(_event_findings(spark, sf), "ts", "1 hour")


@register("sliding_pii", (
    f"WITH {_EVENT_HITS}, w AS (SELECT time_bucket(INTERVAL '30 minutes', ts) - k * INTERVAL '30 minutes' AS window_start, placeholder "
    "FROM e CROSS JOIN (VALUES (0), (1)) s(k)) SELECT window_start, window_start + INTERVAL '1 hour' AS window_end, placeholder, "
    "count(*) AS n_found FROM w GROUP BY ALL"
))
def sliding_pii(spark, sf):
    return jobs.rate_per_window(_event_findings(spark, sf), "ts", "1 hour", "30 minutes")


@register("session_pii", (
    f"WITH {_EVENT_HITS}, g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) <= INTERVAL '2 hours' "
    "THEN 0 ELSE 1 END AS fresh FROM e), n AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM g) "
    "SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL '2 hours' AS session_end, count(*) AS n_found FROM n GROUP BY user_id, s"
))
def session_pii(spark, sf):
    return jobs.rate_per_session(_event_findings(spark, sf), "ts", "user_id", "2 hours")


@register("first_findings", (
    f"WITH {_EVENT_HITS}, v AS (SELECT *, CASE placeholder WHEN 'EMAIL' THEN 'u' || cast(user_id as string) || '@example.com' "
    "ELSE '10.0.0.' || cast(user_id % 200 as string) END AS found FROM e) "
    "SELECT user_id, placeholder, found AS value, min(ts) AS first_ts FROM v GROUP BY user_id, placeholder, found"
))
def first_findings(spark, sf):
    found = jobs.first_findings(_event_findings(spark, sf), ["user_id", "placeholder", "value"], "ts")
    return found.select("user_id", "placeholder", "value", F.col("ts").alias("first_ts"))


from spanveil.plans import round_trips  # noqa: E402, F401  (registers its queries)
