"""The built-in detectors: each is a format, a cheap test whether a text can hold it, and an acceptance rule.

``matches`` lists a format's matches and the gaps between them; ``located`` turns the lists of all detectors into hits
``struct<s, m, v, csv, seq>`` (0-based start, whole match, captured value, "line starts like a CSV record", detector
number) in one pass. Acceptance rules then look at each hit and its surroundings. Everything stays inside the JVM.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from spanveil.functions import fixed_values as fixed
from spanveil.functions.checks import digits_of, luhn_ok
from spanveil.functions.dialect import BOUNDARY, NON_SPACE_CLASS, SPACE_CLASS, WORD_START, java_regex, one_of
from spanveil.functions.text import MARK, TextView, empty_array, let, scan
from spanveil.operators.dictionaries import NameLists

MATCH = "struct<seq:int,gap:int,m:string,v:string,line:int>"
SAME_LINE, PLAIN_LINE, RECORD_LINE, OPEN_LINE = range(4)  # what the gap before a match says about the line's start
WS = SPACE_CLASS
STREET_END = rf"{WS}+(?:{'|'.join(fixed.STREET_KINDS)}){BOUNDARY}"

TITLES = "Mr Ms Miss Dr Prof Sir Dame Lady Rev Capt Sgt".split()  # every title contains one of these

Guard = Callable[[TextView], Column]
Rule = Callable[[TextView, Column], Column]


@dataclass(frozen=True)
class Detector:
    id: str
    label: str
    tier: str
    placeholder: str
    description: str
    regex: str
    captures: bool = False
    guard: Guard | None = None
    rule: Rule | None = None
    reads_lines: bool = False


def matches(
    view: TextView, regex: str, seq: int, captures: bool = False, reads_lines: bool = False, text: Column | None = None
) -> Column:
    """Every non-overlapping match with the length of the gap before it; one more entry without match for the tail.

    Empty if nothing matches. The matches are wrapped in marks by one replacement and the text is then cut at the
    marks: one regular-expression pass, and Spark keeps the compiled pattern from row to row (``split`` would not).
    """
    text = view.text if text is None else text
    per_match = 3 if captures else 2
    marked = F.regexp_replace(text, F.lit(regex), F.lit(f"{MARK}$0{MARK}$1{MARK}" if captures else f"{MARK}$0{MARK}"))
    whole = F.regexp_extract_all(text, F.lit(regex), F.lit(0))
    values = F.regexp_extract_all(text, F.lit(regex), F.lit(1)) if captures else whole

    def entry(gap: Column, match: Column, value: Column) -> Column:
        return F.struct(
            F.lit(seq).alias("seq"), F.length(gap).alias("gap"), match.alias("m"),
            (value if captures else F.lit(None).cast("string")).alias("v"),
            (_line_start(gap) if reads_lines else F.lit(SAME_LINE)).alias("line"),
        )

    def cut(parts: Column) -> Column:
        places = F.sequence(F.lit(0), F.size(parts) - 1, F.lit(per_match))
        return F.when(
            F.size(parts) > 1,
            F.transform(
                places, lambda i: entry(parts[i], F.get(parts, i + 1), F.get(parts, i + (per_match - 1)))
            ),
        ).otherwise(empty_array(MATCH))

    def listed() -> Column:
        pairs = F.arrays_zip(whole.alias("m"), values.alias("v"))
        return F.zip_with(F.split(text, regex, -1), pairs, lambda gap, pair: entry(gap, pair["m"], pair["v"]))

    return F.when(view.has_mark, listed()).otherwise(
        let(F.split(marked, MARK, -1), cut)
    )


def _line_start(gap: Column) -> Column:
    """How the current line starts, as far as the gap before the match tells (SAME_LINE: no line break in it)."""
    piece = F.substring_index(gap, "\n", -1)
    kind = (
        F.when(piece.rlike(rf"\A{WS}*\w+,"), RECORD_LINE).when(piece.rlike(NON_SPACE_CLASS), PLAIN_LINE)
        .otherwise(OPEN_LINE)
    )
    return F.when(gap.contains("\n"), kind).otherwise(kind * 4)


def located(view: TextView, entries: Column) -> Column:
    """Hits with their starts: a running sum over gaps and matches that restarts after each detector's tail entry.

    Along with the position it carries whether the current line starts like a CSV record, for the rules that ask.
    """

    def csv(st: Column, x: Column) -> Column:
        kind = F.when(x["line"] < 4, x["line"]).when(st["pos"] == 0, F.shiftright(x["line"], 2)).otherwise(SAME_LINE)
        next_char = view.slice(st["pos"] + x["gap"] + F.length(x["m"]), F.lit(1))
        return (
            F.when(x["line"] == SAME_LINE, st["csv"])
            .when(kind == SAME_LINE, st["csv"])
            .when(kind == OPEN_LINE, x["m"].rlike(r"\A\w+\z") & (next_char == ","))
            .otherwise(kind == RECORD_LINE)
        )

    def place(listed: Column) -> Column:
        codes = scan(
            listed,
            F.struct(F.lit(0).alias("pos"), F.lit(False).alias("csv")),
            emit=lambda st, x: (st["pos"] + x["gap"]) * 2 + F.when(x["m"].isNotNull() & csv(st, x), 1).otherwise(0),
            step=lambda st, x: F.struct(
                F.when(x["m"].isNull(), 0).otherwise(st["pos"] + x["gap"] + F.length(x["m"])).alias("pos"),
                F.when(x["m"].isNull(), False).otherwise(csv(st, x)).alias("csv"),
            ),
        )
        found = F.zip_with(
            listed, codes,
            lambda x, code: F.struct(
                F.shiftright(code, 1).cast("int").alias("s"), x["m"].alias("m"), x["v"].alias("v"),
                (code % 2 == 1).alias("csv"), x["seq"].alias("seq"),
            ),
        )
        return F.filter(found, lambda h: h["m"].isNotNull())

    return let(entries, place)


def detector_matches(view: TextView, det: Detector, seq: int) -> Column:
    """The detector's match list, or an empty array without looking where a byte search rules out a match."""
    found = matches(view, det.regex, seq, det.captures, det.reads_lines)
    return found if det.guard is None else F.when(det.guard(view), found).otherwise(empty_array(MATCH))


# ------------------------------------------------------------------------------------------------ acceptance rules
def end_of(h: Column) -> Column:
    return h["s"] + F.length(h["m"])


def _luhn(view: TextView, h: Column) -> Column:
    return luhn_ok(h["m"])


def _routable_ip(view: TextView, h: Column) -> Column:
    return ~h["m"].startswith("0.")


def _phone_intl(view: TextView, h: Column) -> Column:
    return F.length(digits_of(h["m"])).between(7, 15) & ~h["m"].contains("\n")


def _phone_contextual(view: TextView, h: Column) -> Column:
    strong = java_regex(r"\b(?:tel|phone|ph|mobile|mob|cell|fax|contact|call)\b", ignore_case=True)
    weak = java_regex(r"\b(?:number|no)\b", ignore_case=True)
    plain = ~h["m"].rlike(rf"[-+().]|\d{WS}+\d")
    return F.length(digits_of(h["m"])).between(7, 15) & ~(plain & h["m"].rlike(weak) & ~h["m"].rlike(strong))


def _uk_postcode(view: TextView, h: Column) -> Column:
    code = F.upper(F.regexp_replace(h["m"], WS, ""))
    reserved = code.rlike(r"\A(?:ZZ|XX|QQ|BF1)")
    doubled = code.rlike(r"\A([A-Z])\1\d") & ~code.rlike(r"\A(?:EE|LL|NN|SS|WW)")
    return ~reserved & ~doubled


def _in_csv_record(before: Column, h: Column) -> Column:
    return before.rlike(rf",{WS}*\z") & h["csv"]


def _us_zip(view: TextView, h: Column) -> Column:
    before, after = view.before(h["s"], 30), view.after(end_of(h), 40)
    json_number = before.rlike(rf'[":]{WS}*\z') & before.rlike("[{,]")
    json_tail = after.rlike(rf"\A{WS}*[,}}]") & before.rlike('[{"]')
    house_number = after.rlike(rf"\A{WS}+[A-Z][a-z]+(?:{WS}+[A-Z][a-z]+)*{STREET_END}")
    return ~(json_number | _in_csv_record(before, h) | json_tail | house_number)


def _date_full(view: TextView, h: Column) -> Column:
    before = view.before(h["s"], 40)
    json_date = (
        rf'(?i)"(?:build|date|created|updated|timestamp|version|window|released?|published)"{WS}*:{WS}*"?\z'
    )
    build_tag = rf'(?i)(?:build|version|release|window|slug)[=:]{WS}*"?\z'
    return ~(before.rlike(json_date) | before.rlike(build_tag) | _in_csv_record(before, h))


def _session_id(view: TextView, h: Column) -> Column:
    parts = F.split(F.lower(F.regexp_replace(h["m"], r"\A[a-zA-Z]+[_-]", "")), "[_-]", -1)
    return ~F.arrays_overlap(parts, F.array(*[F.lit(w) for w in fixed.SESSION_COMMON_PARTS]))


def _known_name(lists: NameLists) -> Rule:
    leads = java_regex(
        "(?:" + "|".join(fixed.NAME_LEADS) + r")\s*[:,]?\s*$"
        "|" + '"(?:' + "|".join(fixed.NAME_KEYS) + r')"\s*:\s*"$',
        ignore_case=True,
    )
    previous_word = java_regex(r"\b([A-Z][a-z]+)\s+$")

    def rule(view: TextView, h: Column) -> Column:
        word = F.lower(h["m"])
        previous = F.lower(F.regexp_extract(view.before(h["s"], 30), previous_word, 1))
        in_context = view.before(h["s"], 60).rlike(leads) | previous.isin(sorted(lists.first))
        city_and_state = view.after(end_of(h), 10).rlike(rf"\A,{WS}*[A-Z]{{2}}{BOUNDARY}")
        return ~city_and_state & (~word.isin(sorted(lists.ambiguous)) | in_context)

    return rule


# ------------------------------------------------------------------------------------------------ the set
def _street_regex() -> str:
    """Number, capitalised words, and the last street kind of the run.

    Written with possessive loops: the plain form recurses once per word in Java and overflows the stack on a long run
    of capitalised words. Each loop turn ends on a street kind, so the match still ends on the last one in the run.
    """
    word = rf"{WS}+[A-Z][a-z]++"
    kind = rf"(?:{'|'.join(fixed.STREET_KINDS)}){BOUNDARY}"
    plain_word = rf"{WS}++(?!{kind})[A-Z][a-z]++"
    return rf"{WORD_START}\d++{word}(?:(?:{plain_word})*+{WS}++{kind})++"


def _email_regex() -> str:
    """The e-mail format, tried once per run of address characters.

    Whether a match can start in such a run depends only on how the run ends, so a failed first start makes the later
    ones pointless; trying them all takes quadratic time on a long dotted run. A start is skipped if a word character
    stands before it in the run (the end of the previous match counts as a fresh start).
    """
    first_in_run = r"(?:\G|(?<![A-Za-z0-9._%+-])|(?<=[.%+-])(?<!\w[.%+-]{1,64}))"
    return first_in_run + java_regex(fixed.FORMATS["email"]).replace("]+@", "]++@", 1)


def _digit(view: TextView) -> Column:
    return view.has_digit


def _mentions(*words: str) -> Guard:
    return lambda view: view.mentions(*words)


def _mentions_and_digit(*words: str) -> Guard:
    return lambda view: view.has_digit & view.mentions(*words)


_GUARDS: dict[str, Guard] = {
    "eth_address": _mentions("0x"),
    "btc_bech32": _mentions("bc1"),
    "jwt_token": _mentions("eyj"),
    "api_key_secret": _mentions("sk_", "pk_", "sk-", "ghp_", "github_pat_", "glpat-", "xox"),
    "routing_number": _mentions_and_digit("routing"),
    "account_number": _mentions_and_digit("account", "acct"),
    "passport": _mentions("passport"),
    "drivers_license": _mentions("dl", "driver"),
    "mac_address": lambda view: view.mentions(":", "-"),
    "email": _mentions("@"),
    "phone_intl": _mentions_and_digit("+"),
    "date_dob": _mentions_and_digit("dob", "birth", "born"),
    "name_title": lambda view: view.holds(*TITLES),
    "name_dictionary": None,
    "device_id": _mentions("dev"),
    "session_id": _mentions("sess", "token"),
    "user_id": _mentions("usr", "user"),
    "uuid": _mentions("-"),
}
_RULES: dict[str, Rule] = {
    "credit_card": _luhn,
    "ipv4": _routable_ip,
    "phone_intl": _phone_intl,
    "phone_contextual": _phone_contextual,
    "uk_postcode": _uk_postcode,
    "us_zip": _us_zip,
    "date_full": _date_full,
    "session_id": _session_id,
}
_CAPTURES = {"routing_number", "account_number", "passport", "drivers_license", "phone_contextual", "date_dob"}
_READS_LINES = {"us_zip", "date_full"}


def builtin_detectors(lists: NameLists, only: list[str] | None = None) -> list[Detector]:
    """The detectors in detection order; ``only`` keeps the named ones (unknown ids are ignored)."""
    made = []
    for det_id, label, tier, placeholder, case_matters, description in fixed.CATALOGUE:
        if only is not None and det_id not in only:
            continue
        rule = _RULES.get(det_id)
        if det_id == "name_dictionary":
            if not lists.candidates:
                continue
            regex = rf"{WORD_START}(?i:{one_of(lists.candidates)})(?!\w)"
            rule = _known_name(lists)
        elif det_id == "street_address":
            regex = _street_regex()
        elif det_id == "email":
            regex = _email_regex()
        else:
            regex = java_regex(fixed.FORMATS[det_id], ignore_case=not case_matters, word_start=True)
        made.append(
            Detector(
                det_id, label, tier, placeholder, description, regex,
                captures=det_id in _CAPTURES,
                guard=_GUARDS.get(det_id, _digit),
                rule=rule,
                reads_lines=det_id in _READS_LINES,
            )
        )
    return made


def detector_catalogue(spark):
    """Table of the built-in detectors: position, id, label, tier, placeholder, description."""
    rows = [(i, d[0], d[1], d[2], d[3], d[5]) for i, d in enumerate(fixed.CATALOGUE)]
    return spark.createDataFrame(
        rows, "position int, id string, label string, tier string, placeholder string, description string"
    )
