"""Secret scan with character Markov models. DataFrame functions only.

Base formats: assignments to password-like names, access keys, long hexadecimal runs. Beyond them, every long token of
the text is scored: two first-order Markov models over characters, one of random strings and one of ordinary
identifiers, give a log-likelihood ratio per transition. A token of 12 characters or more is reported if both the mean
(``least_ratio``) and the sum (``least_evidence``, so short tokens must be the clearer ones) are large enough. Words may stand
in capitals, so the lesser ratio of a token and its lower-case form counts.

Training: labelled samples of both kinds come from the corpus. Random: digests of documents of the sample, written as
base64 and as hexadecimal, and the values of base secrets found in it. Ordinary: the words and identifiers that two
different texts of the sample share and that are no such values. The sample is about ``sample_docs`` different texts (a
documented bound), those with the smallest digests; it is chosen where the texts lie, without a sort. Transition counts are
pre-aggregated by Spark, and 65 x 65 log ratios, whatever the sample, become a literal.

Nulls and ties: null and empty texts have no secrets; null ids are carried; repeated rows get equal results; an empty
table gives no rows (both models are then uniform). Only the id and text columns are read.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanveil.functions.text import compute_once, let
from spanveil.llm.common import column, kept, text_of
from spanveil.llm.spans import guarded, match_spans

ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
KINDS = ("assign", "access", "hex")
TOKEN = r"[A-Za-z0-9+/_-]{12,}={0,2}"
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
STATES = len(ALPHABET) + 1  # state 0: any other character
SAMPLE_DOCS = 2000
LEAST_RATIO = 0.7  # nats per transition
LEAST_EVIDENCE = 14.0  # nats over the whole token
LEAST_CHARACTERS = 6  # different ones
BACK_OFF = 5.0


def base_spans(text: Column) -> dict[str, Column]:
    value = lambda v: F.regexp_extract(v, ASSIGN, 2)
    return {
        "assign": guarded(
            text.rlike("(?i)password|passwd|secret|token|api_?key"), match_spans(text, ASSIGN, lambda v: F.length(value(v)) >= 12)
        ),
        "access": guarded(text.contains("AKIA"), match_spans(text, ACCESS)),
        "hex": match_spans(text, HEX),
    }


def codes(token: Column) -> Column:
    """A token's characters as states."""
    return F.transform(F.split(token, ""), lambda c: F.instr(F.lit(ALPHABET), c))


def transitions(tokens: DataFrame, label: str) -> DataFrame:
    """(label, pair, n) of a table of distinct ``token``."""
    pair = let(
        codes(F.col("token")),
        lambda c: F.zip_with(F.slice(c, 1, F.size(c) - 1), F.slice(c, 2, F.size(c) - 1), lambda a, b: a * STATES + b),
    )
    each = tokens.where(F.length("token") >= 2).select(F.explode(pair).alias("pair"))
    return each.groupBy("pair").agg(F.count(F.lit(1)).alias("n")).select(F.lit(label).alias("label"), "pair", "n")


def labelled_tokens(docs: DataFrame, text_column: str = "text", sample_docs: int = SAMPLE_DOCS) -> tuple[DataFrame, DataFrame]:
    """(random, ordinary) tokens of the sample."""
    share = min(1.0, sample_docs / max(1, docs.count()))
    last = -(1 << 63) + min((1 << 64) - 1, int(share * (1 << 64)))
    texts = docs.select(text_of(text_column).alias("text")).withColumn("at", F.xxhash64("text"))
    sample = kept(texts.where(F.col("at") <= F.lit(last)).dropDuplicates(["at"]))
    digest = F.sha2(F.concat("text", F.lit(":random")), 512)
    made = F.array(
        F.regexp_replace(F.base64(F.unhex(digest)), "[\r\n=]", ""), F.sha2("text", 256), F.md5("text"), F.upper(F.sha1("text"))
    )
    spans = base_spans(F.col("text"))
    secret = F.concat(
        F.transform(spans["assign"], lambda s: F.regexp_extract(s["value"], ASSIGN, 2)),
        F.transform(spans["access"], lambda s: s["value"]), F.transform(spans["hex"], lambda s: s["value"]),
    )
    random = sample.select(F.explode(F.array_union(made, secret)).alias("token")).distinct()
    words = F.array_distinct(F.regexp_extract_all("text", F.lit("[A-Za-z0-9+/_-]{3,}"), F.lit(0)))
    plain = sample.select("at", F.explode(words).alias("token")).where(~F.col("token").rlike(r"[0-9a-f]{16}|AKIA[A-Z0-9]{14}"))
    usual = plain.groupBy("token").agg(F.min("at").alias("a"), F.max("at").alias("b")).where("a <> b").select("token")
    return random, usual.join(random, "token", "left_anti")


def log_ratios(random: DataFrame, ordinary: DataFrame) -> list[float]:
    """STATES * STATES values: log P(b | a) of random strings over that of ordinary identifiers.

    P(b | a) = (n(ab) + BACK_OFF P(b)) / (n(a) + BACK_OFF) with P(b) = (n(b) + 1) / (n + STATES): what a kind of token
    hardly ever holds stays improbable after characters it hardly ever holds.
    """
    counted = transitions(random, "random").union(transitions(ordinary, "ordinary")).collect()  # 2 * STATES^2 at most
    counts = {"random": [0] * STATES**2, "ordinary": [0] * STATES**2}
    for r in counted:
        counts[r["label"]][r["pair"]] += r["n"]
    logs = {}
    for label, n in counts.items():
        single = [(sum(n[b::STATES]) + 1) / (sum(n) + STATES) for b in range(STATES)]
        logs[label] = [
            math.log((n[a * STATES + b] + BACK_OFF * single[b]) / (sum(n[a * STATES : (a + 1) * STATES]) + BACK_OFF))
            for a in range(STATES)
            for b in range(STATES)
        ]
    return [round(x - y, 6) for x, y in zip(logs["random"], logs["ordinary"], strict=True)]


def ratio(token: Column, ratios: Column) -> Column:
    """Mean log-likelihood ratio of a token's transitions."""

    def over(c: Column) -> Column:
        each = F.zip_with(
            F.slice(c, 1, F.size(c) - 1), F.slice(c, 2, F.size(c) - 1), lambda a, b: F.element_at(ratios, a * STATES + b + 1)
        )
        return F.aggregate(each, F.lit(0.0), lambda s, x: s + x) / (F.size(c) - 1)

    return let(codes(token), over)


def secret_spans(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    least_ratio: float = LEAST_RATIO,
    sample_docs: int = SAMPLE_DOCS,
    least_evidence: float = LEAST_EVIDENCE,
) -> DataFrame:
    """id, assign, access, hex (spans of the base formats) and markov (spans of random tokens outside of them)."""
    values = log_ratios(*labelled_tokens(docs, text_column, sample_docs))
    ratios = F.from_json(F.lit(json.dumps(values)), "array<double>")
    narrow = docs.select(column(id_column).alias("id"), text_of(text_column).alias("text"))
    found = compute_once(narrow, **base_spans(F.col("text")), tokens=match_spans(F.col("text"), TOKEN))
    base = F.concat(*KINDS)
    apart = F.filter("tokens", lambda t: ~F.exists(base, lambda s: (s["start"] < t["end"]) & (t["start"] < s["end"])))
    # A number alone is no random string, nor is one of few different characters (12 random letters have 10 on average).
    apart = F.filter(
        apart, lambda t: t["value"].rlike("[A-Za-z]") & (F.size(F.array_distinct(F.split(t["value"], ""))) >= LEAST_CHARACTERS)
    )

    def random(span: Column) -> Column:
        own = ratio(span["value"], ratios)
        any_case = F.when(span["value"].rlike("[a-z]"), own).otherwise(F.least(own, ratio(F.lower(span["value"]), ratios)))
        return let(any_case, lambda r: (r >= least_ratio) & (r * (F.length(span["value"]) - 1) >= least_evidence))

    return found.select("id", *KINDS, F.filter(apart, random).alias("markov"))


def digest_columns(spans: DataFrame) -> DataFrame:
    """The query's columns from ``secret_spans``."""

    def tagged(kind: str, rank: int) -> Column:
        return F.transform(kind, lambda s: F.struct(s["start"].alias("start"), F.lit(rank).alias("rank"), F.concat_ws(":", F.lit(kind), s["start"], s["end"]).alias("text")))

    def joined(kinds) -> Column:
        every = F.array_sort(F.concat(*[tagged(k, n) for n, k in enumerate(kinds)]))
        return F.array_join(F.transform(every, lambda s: s["text"]), ",")

    return spans.select(
        F.col("id").alias("doc_id"), *[F.size(k).cast("bigint").alias(f"n_{k}") for k in KINDS],
        F.sha2(joined(KINDS), 256).alias("base_sha256"), joined((*KINDS, "markov")).alias("spans"),
    )
