"""Formats, scans, slices, overlap resolution and value functions against plain Python."""

from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from spanveil.functions.checks import luhn_ok, mask_value, normal_value
from spanveil.functions.dialect import java_regex, one_of
from spanveil.functions.fixed_values import FORMATS, LAST_NAMES
from spanveil.functions.text import chunks_of, scan, slice_text
from spanveil.operators.detectors import builtin_detectors, matches, located
from spanveil.operators.dictionaries import CustomPattern, Dictionaries, NameLists
from spanveil.operators.spans import SPAN, classified, resolve, rules_for, with_view

PIECES = [
    "12345", "1", "-", " ", "\n", "4111", "1111-", "a", "Bob", "Mary ", "x@y.org", "@", ".com", "10.0.0.1", "+44 20 7946 0958",
    "é", "\U0001f600", " ", "12/03/2020", "2020-03-12", "SW1A 1AA", "user_", "abc123", "Street", " Oak", "Mr ", ",", "passport ",
]


def random_texts(n, seed, longest=60):
    rnd = random.Random(seed)
    return ["".join(rnd.choice(PIECES) for _ in range(rnd.randint(0, longest))) for _ in range(n)]


def python_form(pattern):
    return pattern.replace(r"\s", r"[\s  　﻿]").replace("[[", "[").replace("$", r"\Z")


def test_formats_agree_with_python(spark):
    """The Java form finds what an ASCII regular expression finds, at the same place (offsets count characters)."""
    texts = random_texts(400, 1) + ["x" * 5000 + " x@y.org " + "é" * 5000 + " 12345 and Bob"]
    df, view = with_view(spark.createDataFrame(list(enumerate(texts)), "id int, text string").repartition(8), "text")
    plain = {
        d.id: d for d in builtin_detectors(NameLists())
        if d.id in ("credit_card", "ipv4", "us_zip", "date_full", "uuid", "user_id", "mac_address", "email", "uk_sortcode")
    }
    found = df.select(
        "id",
        *[
            F.transform(located(view, matches(view, d.regex, 7)), lambda h: F.struct(h["s"], h["m"])).alias(name)
            for name, d in plain.items()
        ],
    ).collect()
    total = 0
    for row in found:
        for name in plain:
            flags = re.ASCII
            want = [(m.start(), m.group(0)) for m in re.finditer(FORMATS[name], texts[row.id], flags)]
            assert [tuple(x) for x in row[name]] == want, (name, texts[row.id])
            total += len(want)
    assert total > 300


def test_street_form_agrees_with_plain_form(spark):
    rnd = random.Random(3)
    words = ["Oak", "Street", "St", "Stone", "Road", "road", "McOak", "Way,", "Lane", "12", "7", "\n", "A"]
    texts = [" ".join(rnd.choice(words) for _ in range(rnd.randint(2, 14))) for _ in range(3000)]
    kinds = "Street|St|Avenue|Ave|Road|Rd|Boulevard|Blvd|Lane|Ln|Drive|Dr|Court|Ct|Place|Pl|Way|Close|Terrace|Ter|Crescent|Cres"
    plain = re.compile(rf"\b\d+\s+[A-Z][a-z]+(?:\s+[A-Z][a-z]+)*\s+(?:{kinds})\b", re.ASCII)
    regex = next(d.regex for d in builtin_detectors(NameLists(), ["street_address"]))
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    for row in df.select("id", F.regexp_extract_all("text", F.lit(regex), F.lit(0)).alias("x")).collect():
        assert row.x == [m.group(0) for m in plain.finditer(texts[row.id])], texts[row.id]


def test_one_of_matches_exactly_its_words():
    words = sorted(set(LAST_NAMES))
    made = re.compile(one_of(words))
    assert all(made.fullmatch(w) for w in words)
    others = [w + "x" for w in words] + [w[:-1] for w in words if w[:-1] not in words]
    assert not any(made.fullmatch(w) for w in others)


def test_java_regex_spells_out_differences():
    assert java_regex(r"a$") == r"a\z"
    assert java_regex(r"[$\s]").startswith("[$\\s\\x{a0}")
    assert r"(?<!\w)" in java_regex(r"\bfoo\b", word_start=True)
    assert java_regex(r"[[&]") == r"[\[\&]"


def test_scan_and_slices_on_long_input(spark):
    text = "".join(chr(97 + i % 26) if i % 7 else "é" for i in range(20001))
    df = spark.createDataFrame([(text, list(range(1000)))], "t string, a array<int>")
    sums = scan(F.col("a"), F.lit(0), lambda st, x: st + x, lambda st, x: st + x)
    spots = [(0, 5), (4090, 20), (4096, 4096), (8191, 1), (19990, 100), (5, 0), (0, 20001)]
    row = df.withColumn("c", chunks_of(F.col("t"))).select(
        sums.alias("s"), *[slice_text(F.col("c"), F.lit(a), F.lit(n)).alias(f"p{i}") for i, (a, n) in enumerate(spots)]
    ).first()
    assert row.s == [i * (i + 1) // 2 for i in range(1000)]
    for i, (a, n) in enumerate(spots):
        assert row[f"p{i}"] == text[a : a + n]


def test_resolution_against_brute_force(spark):
    rnd = random.Random(9)
    cases = []
    for i in range(300):
        spans = []
        for _ in range(rnd.randint(0, 400 if i % 50 == 0 else 12)):
            start, size, special = rnd.randint(0, 60 if i % 50 else 3000), rnd.randint(1, 12), rnd.choice([0, 1000])
            spans.append((start, size - special, size, rnd.randint(0, 9)))
        cases.append((i, spans))
    df = spark.createDataFrame(cases, f"id int, spans array<{SPAN}>")
    for row in df.select("id", resolve(F.col("spans")).alias("kept")).collect():
        reach, want = 0, []
        for s in sorted(cases[row.id][1]):
            if s[0] >= reach:
                want.append(s)
                reach = s[0] + s[2]
        assert [tuple(x) for x in row.kept] == want


def test_numbers_inside_losing_hits_stay_out(spark):
    """A number is only looked at if it starts outside every raw span, also those that lose."""
    df, view = with_view(spark.createDataFrame([(1, "order 12345678 and order 87654321")], "id int, text string"), "text")
    rules = rules_for([])
    number = lambda at: F.struct(F.lit(at).alias("start"), F.lit(1 << 30).alias("rank"), F.lit(8).alias("len"), F.lit(-1).alias("seq"))
    cover = F.struct(F.lit(0).alias("start"), F.lit(10).alias("rank"), F.lit(10).alias("len"), F.lit(1).alias("seq"))
    row = df.select(classified(view, rules, F.array(number(6), cover, number(25))).alias("x")).first()
    assert [(s.start, s.seq >= rules.first_context) for s in row.x] == [(0, False), (25, True)]


def test_value_functions(spark):
    cards = ["4111111111111111", "4111 1111 1111 1112", "378282246310005", "123", "0" * 13, "0" * 20, "4" + "1" * 17 + "8"]
    df = spark.createDataFrame([(c,) for c in cards], "v string")

    def luhn(value):
        ds = [int(x) for x in re.sub(r"\D", "", value)]
        if not 13 <= len(ds) <= 19:
            return False
        return sum(d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d) for i, d in enumerate(reversed(ds))) % 10 == 0

    assert [r[0] for r in df.select(luhn_ok(F.col("v"))).collect()] == [luhn(c) for c in cards]
    masks = [
        ("John", "PERSON_NAME", "J***"), ("jane@x.org", "EMAIL", "j***@x.org"), ("+1 555 123 4567", "PHONE_NUMBER", "+1 5***67"),
        ("123-45-6789", "SSN", "***6789"), ("abcd", "USER_ID", "****"), ("user_42", "USER_ID", "us***42"),
    ]
    df = spark.createDataFrame(masks, "v string, k string, want string")
    assert df.where(~mask_value(F.col("v"), F.col("k")).eqNullSafe(F.col("want"))).count() == 0
    norms = [(" John ", "PERSON_NAME", "john"), ("12 34-5\n", "SSN", "12345"), ("A-B c", "ZIP_CODE", "abc"), ("A-B c", "EMAIL", "a-b c")]
    df = spark.createDataFrame(norms, "v string, k string, want string")
    assert df.where(~normal_value(F.col("v"), F.col("k")).eqNullSafe(F.col("want"))).count() == 0


def test_dictionaries_are_values():
    words = Dictionaries().add_names([" Ann ", "ANN", "", "  "]).add_patterns([{"regex": "A-1"}])
    assert words.stats() == {"customNames": 1, "customPatterns": 1}
    assert words.patterns[0].flags == "gi" and words.patterns[0].label == "Custom Pattern" and words.patterns[0].placeholder == "CUSTOM_PII"
    assert words.clear().stats() == {"customNames": 0, "customPatterns": 0} and words.stats()["customNames"] == 1
    for bad in ("a*", "x?", "", "(?=a)"):
        with pytest.raises(ValueError):
            CustomPattern(bad)
    more = NameLists().extended(first=["Zaphod"], last=["Beeblebrox"])
    assert "zaphod" in more.candidates and "beeblebrox" in more.candidates and "zaphod" not in NameLists().candidates
