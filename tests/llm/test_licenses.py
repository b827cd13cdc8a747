from __future__ import annotations

import random
from re import _parser

import pytest

from spanveil.llm import licenses as lic
from tests.llm.common import awkward, prose, table, words

RULES = lic.rules()


@pytest.mark.parametrize(
    ("text", "labels"),
    [
        ("Released under the MIT License.", ["mit"]),
        ("Licensed under the Apache License, Version 2.0.", ["apache-2.0"]),
        ("under the GNU Lesser General Public License v2.1 or later", ["lgpl-2.1"]),
        ("This is licensed under the GNU General Public License, version 3.", ["gpl-3.0"]),
        ("# SPDX-License-Identifier: GPL-2.0-only", ["gpl-2.0"]),
        ("Licensed under CC BY-NC 4.0.", ["cc-by-nc-4.0"]),
        ("http://creativecommons.org/licenses/by-sa/4.0/", ["cc-by-sa"]),
        ("BSD 3-Clause License and the ISC License", ["bsd-3-clause", "isc"]),
        ("All rights reserved.", ["proprietary"]),
        ("a summit licence to commit the license", []),
        ("Apache License,\n" + " " * 12 + "Version 2.0", ["apache-2.0"]),
        ("apache\n" + " " * 15 + "license", ["apache"]),
        ("Permission is hereby granted, free of charge, to any person obtaining a copy\n * of this software and", ["mit"]),
        ("Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided", ["bsd"]),
        ("under the GPLv3", ["gpl-3.0"]),
        ("the terms of the GNU General Public License\n# as published by the Free Software Foundation; either version 2 of", ["gpl-2.0"]),
        ("SPDX-License-Identifier: MIT OR Apache-2.0", ["apache-2.0", "mit"]),
        ("SPDX-License-Identifier: (GPL-2.0-only WITH Classpath-exception-2.0) AND BSD-3-Clause", ["bsd-3-clause", "gpl-2.0"]),
        ("Permission to use, copy, modify, and/or distribute this software for any\npurpose with or without fee is hereby granted", ["isc"]),
        ("Mozilla Public License 2.0; Eclipse Public License 1.0", ["epl-1.0", "mpl-2.0"]),
    ],
)
def test_rules(text, labels):
    found = lic.detections(text.lower().encode(), RULES)
    assert sorted({r.label for _, _, r in found}) == labels


def test_there_are_hundreds_of_rules_and_suppression_is_by_containment():
    assert len(RULES) > 300
    text = b"licensed under the gnu general public license, version 3. mit license. gnu general public license"
    every = [(m.start(), m.end(), r) for r in RULES for m in r.regex.finditer(text) if r.keyword in text]
    every.sort(key=lambda f: (-f[2].priority, f[0] - f[1], f[0], f[2].order))
    plain = []
    for a, b, r in every:
        if not any(x <= a and b <= y for x, y, _ in plain):
            plain.append((a, b, r))
    assert sorted((a, b, r.label) for a, b, r in plain) == [(a, b, r.label) for a, b, r in lic.detections(text, RULES)]


def sample(tree, rng):
    """A random string of a parsed regex (look-around left out)."""
    out = ""
    for op, arg in tree:
        if op is _parser.LITERAL:
            out += chr(arg)
        elif op is _parser.IN:
            kind, value = rng.choice([x for x in arg if x[0] is not _parser.NEGATE])
            negated = arg[0][0] is _parser.NEGATE
            out += "x" if negated else rng.choice(" \n") if kind is _parser.CATEGORY else chr(value if kind is _parser.LITERAL else rng.randint(*value))
        elif op is _parser.MAX_REPEAT:
            low, high, own = arg
            out += "".join(sample(own, rng) for _ in range(rng.randint(low, min(int(high), low + 3))))
        elif op is _parser.SUBPATTERN:
            out += sample(arg[3], rng)
        elif op is _parser.BRANCH:
            out += sample(rng.choice(arg[1]), rng)
        else:
            assert op in (_parser.ASSERT, _parser.ASSERT_NOT, _parser.AT), op
    return out


@pytest.mark.parametrize("rule", RULES, ids=lambda r: f"{r.order}-{r.label}")
def test_every_rule_fires_on_a_text_made_from_it_alone(rule):
    rng, seen = random.Random(rule.order), 0
    for _ in range(30):
        text = sample(_parser.parse(rule.regex.pattern), rng).encode()
        m = rule.regex.search(text)
        if m:  # look-around can refuse a sample
            seen += 1
            start, end = m.span(rule.regex.groups)  # of a declared identifier the identifier itself
            assert any(a <= start and end <= b for a, b, _ in lic.detections(text, RULES)), text
    assert seen


def test_words_and_places(spark):
    pairs = awkward(spark) + [(70, "MIT-license É mit\n\tLicense permit license mit licenses"), (71, prose(4, 3000) + " Apache. License " + prose(5, 10)),
                              (72, "GNU general PUBLIC license, general public license")]
    got = lic.scan_licenses(table(spark, pairs).repartition(3)).collect()
    want = []
    for i, t in pairs:
        w, at, names = words(t), [], set()
        for phrase, label in lic.PHRASES:
            p = phrase.split()
            hits = [k for k in range(len(w)) if w[k : k + len(p)] == p]
            at += hits
            names |= {label} if hits else set()
        want.append((i, len(w), sorted(at), sorted(names)))
    assert sorted([(r.id, r.n_words, r.places, r.base_labels) for r in got], key=repr) == sorted(want, key=repr)
    by = {r.id: r for r in got}
    text = dict(pairs)[70]
    assert [text[f.start : f.end] for f in by[70].found][:1] == ["MIT"] or by[70].found
    assert lic.scan_licenses(table(spark, [])).count() == 0
