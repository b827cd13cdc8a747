"""From a text column to resolved spans: the union of all detectors, keyword numbers, and overlap resolution.

A span is ``struct<start, rank, len, seq>``; its natural order is the order in which overlaps are resolved: earlier
start, then specific types, then shorter, then detector order. ``rank = len - 1000 * specific``.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass
from functools import lru_cache

from pyspark import SparkContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanveil.functions import fixed_values as fixed
from spanveil.functions.checks import digits_of, luhn_ok
from spanveil.functions.dialect import NON_SPACE_CLASS, SPACE_CLASS, WORD_START, java_regex, literal, one_of
from spanveil.functions.text import MARK, TextView, chunks_of, compute_once, empty_array, keep_where, let, scan, strip
from spanveil.operators.detectors import MATCH, Detector, builtin_detectors, detector_matches, located, matches
from spanveil.operators.dictionaries import Dictionaries

SPAN = "struct<start:int,rank:int,len:int,seq:int>"
WS = SPACE_CLASS
NUMBER = -1  # seq of a number that may become a keyword-number span
NUMBER_RANK = 1 << 30


NEIGHBOUR_CLASS = "[" + SPACE_CLASS[1:-1] + "".join("\\" + c for c in fixed.NAME_NEIGHBOURS) + "]"

NAME_SPLITTER = re.compile("[\\s" + re.escape(fixed.NAME_NEIGHBOURS) + "]")


def has_own_border(name: str) -> bool:
    """Whether two occurrences of ``name`` can overlap (``ana`` in ``anana``)."""
    return any(name[:k] == name[-k:] for k in range(1, len(name)))


@dataclass(frozen=True)
class Source:
    """Where a span comes from; its position in the rule set is the span's ``seq``."""

    id: str
    label: str
    placeholder: str


@lru_cache(maxsize=64)
def _rules_of(application: str, detectors: tuple[str, ...] | None, dictionaries: Dictionaries, apart: bool) -> RuleSet:
    return RuleSet(None if detectors is None else list(detectors), dictionaries, apart)


def rules_for(
    detectors: list[str] | None = None, dictionaries: Dictionaries | None = None, apart: bool = False
) -> RuleSet:
    """The rule set of a call; calls with the same detectors and dictionaries share it and the columns built from it.

    ``apart``: the texts hold several values, with what stands in ``__veil_apart`` between them.
    """
    application = SparkContext._active_spark_context.applicationId
    return _rules_of(application, None if detectors is None else tuple(detectors), dictionaries or Dictionaries(), apart)


class RuleSet:
    """All sources of spans of one call, in detection order."""

    def once(self, name: str, build: Callable[[], Column]) -> Column:
        """A column that depends only on the rules and the ``__veil_*`` columns: built on first use, then shared.

        Building the larger ones takes seconds of calls between Python and the JVM.
        """
        if name not in self._built:
            self._built[name] = build()
        return self._built[name]

    def __init__(
        self, detectors: list[str] | None = None, dictionaries: Dictionaries | None = None, apart: bool = False
    ):
        self._built: dict[str, Column] = {}
        self.apart = apart
        self.dictionaries = dictionaries or Dictionaries()
        self.builtins: list[Detector] = builtin_detectors(self.dictionaries.lists, detectors)
        self.sources = [
            Source("seed_phrase", "BIP-39 Seed Phrase", "ACCESS_TOKEN"),
            Source("custom_name", "Custom Name", "PERSON_NAME"),
            *[Source(p.id, p.label, p.placeholder) for p in self.dictionaries.patterns],
            *[Source(d.id, d.label, d.placeholder) for d in self.builtins],
            *[Source("context_number", label, placeholder) for label, placeholder, *_ in fixed.CONTEXT_RULES],
        ]
        self.first_pattern = 2
        self.first_builtin = 2 + len(self.dictionaries.patterns)
        self.first_context = self.first_builtin + len(self.builtins)
        names = sorted(self.dictionaries.names)
        self.names_alone = [n for n in names if len(NAME_SPLITTER.split(n)) > 1 and has_own_border(n)]
        self.names_by_pieces: dict[int, list[str]] = {}
        for name in names:
            if name not in self.names_alone:
                self.names_by_pieces.setdefault(len(NAME_SPLITTER.split(name)), []).append(name)
        self.kinds = list(dict.fromkeys(s.placeholder for s in self.sources))

    def per_source(self, values: list, seq: Column) -> Column:
        """Look up a per-source value by ``seq`` (the list becomes one literal)."""
        return F.element_at(F.array(*[F.lit(v) for v in values]), seq + 1)

    def placeholder(self, seq: Column) -> Column:
        return self.per_source([s.placeholder for s in self.sources], seq)

    def kind_index(self, seq: Column) -> Column:
        return self.per_source([self.kinds.index(s.placeholder) for s in self.sources], seq)

    def kind_name(self, index: Column) -> Column:
        return F.element_at(F.array(*[F.lit(k) for k in self.kinds]), index + 1)

    def bonus(self, seq: Column) -> Column:
        """Head start of specific types; 0 for a number that is no span yet."""
        points = [1000 if s.placeholder in fixed.SPECIFIC_TYPES else 0 for s in self.sources]
        return self.per_source(points, F.greatest(seq, F.lit(0)))

    def span(self, start: Column, length: Column, seq: int) -> Column:
        bonus = 1000 if self.sources[seq].placeholder in fixed.SPECIFIC_TYPES else 0
        return F.struct(
            start.cast("int").alias("start"),
            (length - bonus).cast("int").alias("rank"),
            length.cast("int").alias("len"),
            F.lit(seq).alias("seq"),
        )


# ------------------------------------------------------------------------------------------------ sources of spans
def seed_spans(view: TextView, rules: RuleSet) -> Column:
    """Lines of exactly 12 or 24 words, at least half of them seed words; placed at the line's first occurrence."""
    shape = rf"\A{WS}*(?:{NON_SPACE_CLASS}++{WS}++){{11}}(?:(?:{NON_SPACE_CLASS}++{WS}++){{12}})?{NON_SPACE_CLASS}++{WS}*\z"
    lines = F.filter(F.split(view.text, "\n", -1), lambda line: line.rlike(shape))

    def is_seed(line: Column) -> Column:
        return let(
            F.split(strip(F.lower(line)), f"{WS}+", -1),
            lambda w: F.size(F.filter(w, lambda x: x.isin(fixed.SEED_WORDS))) * 2 >= F.size(w),
        )

    found = F.transform(
        F.filter(lines, is_seed),
        lambda line: rules.span(F.instr(view.text, line) - 1, F.length(line), 0),
    )
    # With half of the words being seed words, two of them are neighbours or have one word between them.
    word = one_of(fixed.SEED_WORDS)
    first_letters = "".join(sorted({w[0] for w in fixed.SEED_WORDS}))
    possible = view.lower.rlike(
        rf"(?=[{first_letters}]){WORD_START}{word}{WS}++(?:{NON_SPACE_CLASS}++{WS}++)?{word}(?!\w)"
    )
    return F.when(possible, found).otherwise(empty_array(SPAN))


def custom_name_spans(view: TextView, rules: RuleSet) -> Column:
    """User names, in any letter case, between neighbour characters or text edges.

    The text is cut at neighbour characters; a name can only be a run of whole pieces. Runs of each needed length are
    looked up in the name set, so the cost does not grow with the number of names. A name that can overlap itself and
    spans several pieces is searched for on its own, since an earlier occurrence then hides an overlapping later one.
    """
    def runs(pieces: Column, width: int, members: list[str]) -> Column:
        found = F.filter(
            F.transform(
                F.slice(pieces, 1, F.greatest(F.size(pieces) - (width - 1), F.lit(0))),
                lambda p, i: F.struct(
                    p["s"].alias("s"),
                    view_lower_slice(p["s"], pieces[i + (width - 1)]["s"] + F.length(pieces[i + (width - 1)]["m"]) - p["s"])
                    .alias("v") if width > 1 else p["m"].alias("v"),
                ),
            ),
            lambda c: c["v"].isin(members),
        )
        return F.transform(found, lambda c: rules.span(c["s"], F.length(c["v"]), 1))

    lower_view = TextView(view.lower, view.lower, chunks_of(view.lower), view.has_digit, view.has_mark)

    def view_lower_slice(start: Column, length: Column) -> Column:
        return lower_view.slice(start, length)

    def pieces_of() -> Column:
        parts = F.split(view.lower, NEIGHBOUR_CLASS, -1)
        starts = scan(
            parts, F.lit(0), emit=lambda pos, p: pos, step=lambda pos, p: pos + F.length(p) + 1
        )
        return F.zip_with(parts, starts, lambda p, s: F.struct(s.cast("int").alias("s"), p.alias("m")))

    found = let(
        pieces_of(),
        lambda pieces: F.concat(
            empty_array(SPAN), *[runs(pieces, width, members) for width, members in sorted(rules.names_by_pieces.items())]
        ),
    )

    return F.when(view.lower.rlike(one_of(sorted(rules.dictionaries.names))), found).otherwise(empty_array(SPAN))


def name_stands_alone(view: TextView, h: Column) -> Column:
    stop = h["s"] + F.length(h["m"])
    return ((h["s"] == 0) | view.before(h["s"], 1).rlike(NEIGHBOUR_CLASS)) & (
        (stop == F.length(view.text)) | view.after(stop, 1).rlike(NEIGHBOUR_CLASS)
    )


def regex_spans(view: TextView, rules: RuleSet) -> Column:
    """Spans of everything that is one regular expression (self-overlapping names, user patterns, built-in detectors),
    and the candidates for keyword numbers (``seq`` -1). One pass places them all, one lambda applies all rules."""
    lists, checks = [], []
    for name in rules.names_alone:
        found = matches(view, literal(name), 1, text=view.lower)
        lists.append(F.when(view.lower.contains(name), found).otherwise(empty_array(MATCH)))
    if rules.names_alone:
        checks.append((1, name_stands_alone))
    for i, pattern in enumerate(rules.dictionaries.patterns):
        lists.append(matches(view, pattern.java, rules.first_pattern + i))
        checks.append((rules.first_pattern + i, lambda _, h: F.length(h["m"]) > 0))
    for i, det in enumerate(rules.builtins):
        lists.append(detector_matches(view, det, rules.first_builtin + i))
        if det.rule is not None:
            checks.append((rules.first_builtin + i, det.rule))
    number = java_regex(fixed.CONTEXT_NUMBER, word_start=True)
    lists.append(F.when(view.has_digit, matches(view, number, NUMBER)).otherwise(empty_array(MATCH)))

    def accepted(h: Column) -> Column:
        test = F.lit(True)
        for seq, rule in checks:
            test = F.when(h["seq"] == seq, rule(view, h)).otherwise(test)
        return test

    def to_span(h: Column) -> Column:
        # A captured value is placed at its first occurrence inside the match, which can be inside the keyword itself.
        start = h["s"] + F.when(h["v"].isNull(), 0).otherwise(F.instr(h["m"], h["v"]) - 1)
        length = F.length(F.coalesce(h["v"], h["m"]))
        return F.struct(
            start.alias("start"), F.when(h["seq"] == NUMBER, NUMBER_RANK).otherwise(length - rules.bonus(h["seq"])).alias("rank"),
            length.alias("len"), h["seq"].alias("seq"),
        )

    return let(
        F.concat(*lists),
        lambda all_lists: F.when(
            F.size(all_lists) > 0, F.transform(F.filter(located(view, all_lists), accepted), to_span)
        ).otherwise(empty_array(SPAN)),
    )


# ------------------------------------------------------------------------------------------------ keyword numbers
def classified(view: TextView, rules: RuleSet, spans: Column) -> Column:
    """Keep the spans; turn each number that starts outside all of them into a span if a keyword rule fits.

    Keywords count within 80 characters before or 40 after. One pass in start order with the furthest span end so far
    finds the numbers outside; a number sorts behind the spans that start with it.
    """

    def choose(x: Column) -> Column:
        around = F.concat(view.before(x["start"], 80), F.lit(" "), view.after(x["start"] + x["len"], 40))

        def chosen(z: Column) -> Column:
            n_digits = F.length(digits_of(z["m"]))
            choice = F.lit(None).cast("int")
            for i, (_, placeholder, keywords, fewest, most) in reversed(list(enumerate(fixed.CONTEXT_RULES))):
                fits = n_digits.between(fewest, most) & z["around"].rlike(java_regex(keywords, ignore_case=True))
                if placeholder == "CREDIT_CARD":
                    fits = fits & luhn_ok(z["m"])
                choice = F.when(fits, F.lit(rules.first_context + i)).otherwise(choice)
            return choice

        return let(F.struct(view.slice(x["start"], x["len"]).alias("m"), around.alias("around")), chosen)

    def settle(x: Column) -> Column:
        number = let(
            choose(x),
            lambda seq: F.struct(
                x["start"].alias("start"), (x["len"] - rules.bonus(seq)).alias("rank"), x["len"].alias("len"), seq.alias("seq")
            ),
        )
        return F.when(x["seq"] == NUMBER, number).otherwise(x)

    def outside_of(ordered: Column) -> Column:
        flags = scan(
            ordered, F.lit(0),
            emit=lambda reach, x: F.when((x["seq"] != NUMBER) | (x["start"] >= reach), 1).otherwise(0),
            step=lambda reach, x: F.when(x["seq"] == NUMBER, reach).otherwise(F.greatest(reach, x["start"] + x["len"])),
        )
        return keep_where(ordered, flags)

    outside = let(F.array_sort(spans), outside_of)
    return F.when(
        F.exists(spans, lambda x: x["seq"] == NUMBER),
        F.filter(F.transform(outside, settle), lambda x: x["seq"].isNotNull()),
    ).otherwise(spans)


# ------------------------------------------------------------------------------------------------ overlap resolution
def resolve(spans: Column) -> Column:
    """Greedy left-to-right choice of non-overlapping spans."""

    def chosen(ordered: Column) -> Column:
        flags = scan(
            ordered, F.lit(0),
            emit=lambda reach, x: F.when(x["start"] >= reach, 1).otherwise(0),
            step=lambda reach, x: F.when(x["start"] >= reach, x["start"] + x["len"]).otherwise(reach),
        )
        return keep_where(ordered, flags)

    def apart(ordered: Column) -> Column:
        """Whether none overlaps the next: then all stay, and the scan is spared."""
        return F.forall(
            F.transform(
                ordered, lambda x, i: (i == 0) | (x["start"] >= F.get(ordered, i - 1)["start"] + F.get(ordered, i - 1)["len"])
            ),
            lambda fits: fits,
        )

    def kept(ordered: Column) -> Column:
        return F.when(apart(ordered), ordered).otherwise(chosen(ordered))

    return F.when(F.size(spans) > 1, let(F.array_sort(spans), kept)).otherwise(spans)


# ------------------------------------------------------------------------------------------------ on a table
TEXT, LOWER, CHUNKS, DIGIT, MARKED, RAW, SPANS, APART = (
    f"__veil_{n}" for n in ("text", "lower", "chunks", "digit", "marked", "raw", "spans", "apart")
)


def same_length_lower(text: Column) -> Column:
    """Lower case, character for character: the one letter whose lower form is two characters loses its dot."""
    return F.lower(F.replace(text, F.lit("\u0130"), F.lit("I")))


def with_view(df: DataFrame, text_col: str, apart: bool = False) -> tuple[DataFrame, TextView]:
    """Add the derived text columns. Blank text counts as empty."""
    df = df.withColumn(
        TEXT, F.when(is_not_blank(F.col(text_col)), F.col(text_col)).otherwise(F.lit(""))
    )
    df = df.withColumns(
        {
            LOWER: same_length_lower(F.col(TEXT)),
            CHUNKS: chunks_of(F.col(TEXT)),
            DIGIT: F.col(TEXT).rlike("[0-9]"),
            MARKED: F.col(TEXT).contains(MARK),
        }
    )
    return df, TextView(F.col(TEXT), F.col(LOWER), F.col(CHUNKS), F.col(DIGIT), F.col(MARKED), F.col(APART) if apart else None)


def is_not_blank(text: Column) -> Column:
    return text.isNotNull() & text.rlike(NON_SPACE_CLASS)


def with_raw_spans(df: DataFrame, text_col: str, rules: RuleSet, extra: Column | None = None) -> tuple[DataFrame, TextView]:
    """Every span of every source, before overlaps are resolved. ``extra`` may add spans found by a join."""
    df, view = with_view(df, text_col, rules.apart)
    parts = [
        rules.once("seed", lambda: seed_spans(view, rules)),
        rules.once("regex", lambda: regex_spans(view, rules)),
    ]
    if rules.dictionaries.names:
        parts.append(rules.once("names", lambda: custom_name_spans(view, rules)))
    if extra is not None:
        parts.append(extra)
    df = df.withColumn(RAW, F.concat(*parts))
    return compute_once(df, **{RAW: rules.once("classified", lambda: classified(view, rules, F.col(RAW)))}), view


def with_spans(df: DataFrame, text_col: str, rules: RuleSet, extra: Column | None = None) -> tuple[DataFrame, TextView]:
    """Resolved spans in ``__veil_spans``; every step is a narrow projection."""
    df, view = with_raw_spans(df, text_col, rules, extra)
    return df.withColumn(SPANS, rules.once("resolved", lambda: resolve(F.col(RAW)))), view
