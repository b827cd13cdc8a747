"""License scan by ordered signature rules.

The rule table is built from a list of licenses (label, keyword, name, versions, address) and a few sentence forms, some
hundreds of regular expressions, and of signatures of license bodies and file headers (``BODIES``). A rule runs on a text only if the text can match it: it has all words of one of the rule's
keywords (a plain byte search; for an address, its longest fixed part) and, for a name, the bare name. Matches are resolved in the order of priority, then length, then
place: a match inside the interval of one that was kept is suppressed, so "general public license" inside a "lesser
general public license" or inside a full grant sentence doesn't count by itself.

Besides the rules there is a plain phrase search over words (``PHRASES``): places where the phrase's words follow each
other, whatever stands between them.

Texts are searched whole, as lower-case UTF-8 (A-Z only, so offsets hold). Between words any run of white space and comment
marks may stand; no word begins with these, so a search can't backtrack over them. Of a declared identifier only the
identifier is the match, so every term of an expression (``MIT OR Apache-2.0``) has its own label.
Nulls and ties: null and empty texts give no words, places or labels and score 0; several licenses give several labels;
matches with equal priority, length and place go to the earlier rule. An empty table gives no rows. Only the id and the
text are read.
"""

from __future__ import annotations

import bisect
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from spanveil.llm import shingles as sh
from spanveil.llm.common import column, text_of

PHRASES = [("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl")]  # fixed values
#: label | keyword (several: by comma) | name | versions (each gives rules of its own; blank: none) | address
LICENSES = r"""
mit | mit | mit(?: \(expat\))?(?: license| licence)? | | opensource\.org/licenses?/mit\b
mit-0 | no attribution | mit no attribution(?: license)? | | opensource\.org/licenses?/mit-0
expat | expat | expat license | | directory\.fsf\.org/wiki/license:expat
x11 | x11 | x11 license | | spdx\.org/licenses/x11
apache | apache | apache(?: software)? license | 1.0 1.1 2.0 | apache\.org/licenses/license
gpl | general public | (?:gnu )?general public license | 1 2 3 | gnu\.org/licenses/(?:old-licenses/)?gpl
gpl | gpl | (?:gnu )?gpl | 1 2 3 | gnu\.org/copyleft/gpl
lgpl | general public | (?:gnu )?(?:lesser|library) general public license | 2 2.1 3 | gnu\.org/licenses/(?:old-licenses/)?lgpl
lgpl | lgpl | (?:gnu )?lgpl | 2 2.1 3 | gnu\.org/copyleft/lesser
agpl | affero | (?:gnu )?affero general public license | 1 3 | gnu\.org/licenses/agpl
agpl | agpl | (?:gnu )?agpl | 1 3 | affero\.org/oagpl
gfdl | free documentation | (?:gnu )?free documentation license | 1.1 1.2 1.3 | gnu\.org/licenses/fdl
bsd | bsd | bsd(?: style)? license | | opensource\.org/licenses?/bsd-license
bsd-2-clause | bsd | (?:bsd[- ]2[- ]clause|simplified bsd|freebsd)(?: license)? | | opensource\.org/licenses?/bsd-2-clause
bsd-3-clause | bsd | (?:bsd[- ]3[- ]clause|new bsd|modified bsd|revised bsd)(?: license)? | | opensource\.org/licenses?/bsd-3-clause
bsd-4-clause | bsd | (?:bsd[- ]4[- ]clause|original bsd)(?: license)? | | spdx\.org/licenses/bsd-4-clause
0bsd | bsd | (?:0bsd|zero[- ]clause bsd)(?: license)? | | opensource\.org/licenses?/0bsd
isc | isc | isc license | | opensource\.org/licenses?/isc
mpl | mozilla | mozilla public license | 1.0 1.1 2.0 | mozilla\.org/(?:en-us/)?mpl
mpl | mpl | mpl | 1.0 1.1 2.0 | opensource\.org/licenses?/mpl
epl | eclipse | eclipse public license | 1.0 2.0 | eclipse\.org/(?:legal|org/documents)/epl
cddl | common development | common development and distribution license | 1.0 1.1 | opensource\.org/licenses?/cddl
cpl | common public | common public license | 1.0 | opensource\.org/licenses?/cpl
eupl | european union | european union public licen[cs]e | 1.1 1.2 | joinup\.ec\.europa\.eu/[^\s]{0,60}eupl
artistic | artistic | artistic license | 1.0 2.0 | opensource\.org/licenses?/artistic
bsl | boost | boost software license | 1.0 | boost\.org/license
busl | business source | business source license | 1.1 | mariadb\.com/bsl
sspl | server side | server side public license | 1 | mongodb\.com/licensing/server-side
elastic | elastic | elastic license | 2.0 | elastic\.co/licensing/elastic-license
commons-clause | commons clause | commons clause | 1.0 | commonsclause\.com
unlicense | unlicense | (?:the )?unlicense | | unlicense\.org
wtfpl | wtfpl | wtfpl | 2 | wtfpl\.net
zlib | zlib | zlib(?:/libpng)? license | | zlib\.net/zlib_license
libpng | libpng | libpng license | 2.0 | libpng\.org/pub/png/src/libpng-license
openssl | openssl | openssl license | | openssl\.org/source/license
python | python software | python software foundation license | 2.0 | docs\.python\.org/[^\s]{0,20}license
php | php | php license | 3.0 3.01 | php\.net/license
ruby | ruby | ruby license | | ruby-lang\.org/[^\s]{0,10}license
postgresql | postgresql | postgresql licen[cs]e | | postgresql\.org/about/licence
ms-pl | microsoft public | microsoft public license | | opensource\.org/licenses?/ms-pl
ms-rl | microsoft reciprocal | microsoft reciprocal license | | opensource\.org/licenses?/ms-rl
ofl | open font | (?:sil )?open font license | 1.0 1.1 | scripts\.sil\.org/ofl
upl | universal permissive | universal permissive license | 1.0 | oss\.oracle\.com/licenses/upl
ncsa | ncsa | (?:university of illinois/)?ncsa open source license | | opensource\.org/licenses?/ncsa
w3c | w3c | w3c (?:software|document)[a-z ]{0,20} license | | w3\.org/consortium/legal
odbl | open database | open database license | 1.0 | opendatacommons\.org/licenses/odbl
odc-by | open data commons | open data commons attribution license | 1.0 | opendatacommons\.org/licenses/by
pddl | public domain dedication | public domain dedication and license | 1.0 | opendatacommons\.org/licenses/pddl
cc0 | cc0, cc zero | (?:creative commons )?(?:cc0|cc zero)(?: universal)? | 1.0 | creativecommons\.org/publicdomain/zero
cc-by | cc, creative | (?:cc[- ]by|creative commons attribution)(?! ?-? ?(?:nc|nd|sa|non|no|share)) | 2.0 2.5 3.0 4.0 | creativecommons\.org/licenses/by/
cc-by-sa | cc | cc[- ]by[- ]sa | 2.0 2.5 3.0 4.0 | creativecommons\.org/licenses/by-sa/
cc-by-nd | cc | cc[- ]by[- ]nd | 2.0 2.5 3.0 4.0 | creativecommons\.org/licenses/by-nd/
cc-by-nc | cc | cc[- ]by[- ]nc(?![- ](?:sa|nd)) | 2.0 2.5 3.0 4.0 | creativecommons\.org/licenses/by-nc/
cc-by-nc-sa | cc | cc[- ]by[- ]nc[- ]sa | 2.0 2.5 3.0 4.0 | creativecommons\.org/licenses/by-nc-sa/
cc-by-nc-nd | cc | cc[- ]by[- ]nc[- ]nd | 2.0 2.5 3.0 4.0 | creativecommons\.org/licenses/by-nc-nd/
cc-by-sa | creative | creative commons attribution[- ]share ?alike | 2.0 2.5 3.0 4.0 | spdx\.org/licenses/cc-by-sa
cc-by-nc | creative | creative commons attribution[- ]non ?commercial(?![- ](?:share|no)) | 2.0 2.5 3.0 4.0 | spdx\.org/licenses/cc-by-nc-[0-9]
cc-by-nc-sa | creative | creative commons attribution[- ]non ?commercial[- ]share ?alike | 2.0 2.5 3.0 4.0 | spdx\.org/licenses/cc-by-nc-sa
cc-by-nc-nd | creative | creative commons attribution[- ]non ?commercial[- ]no ?deriv[a-z]{0,8} | 2.0 2.5 3.0 4.0 | spdx\.org/licenses/cc-by-nc-nd
cc-by-nd | creative | creative commons attribution[- ]no ?deriv[a-z]{0,8} | 2.0 2.5 3.0 4.0 | spdx\.org/licenses/cc-by-nd
public-domain | public domain | (?:in|into|to) the public domain | | creativecommons\.org/publicdomain/mark
proprietary | rights reserved | all rights reserved | | \bproprietary and confidential\b
"""
#: label | keyword | what the license's own text or its file header says
BODIES = r"""
mit | hereby granted | permission is hereby granted,? free of charge,? to any person obtaining a copy of this software
bsl-1.0 | accompanying documentation | permission is hereby granted,? free of charge,? to any person or organization obtaining a copy of the software and accompanying documentation
isc | hereby granted | permission to use, copy, modify,? and(?:/or)? distribute this software for any purpose with or without fee is hereby granted
bsd | redistribution and use | redistribution and use in source and binary forms,? with or without modification,? are permitted
bsd-3-clause | endorse or promote | may be used to endorse or promote products derived from this software without (?:specific )?prior written permission
bsd-4-clause | advertising materials | all advertising materials mentioning features or use of this software must display
apache | except in compliance | you may not use this (?:file|work|software) except in compliance with the license
unlicense | unencumbered | this is free and unencumbered software released into the public domain
zlib | misrepresented | the origin of this software must not be misrepresented
mpl | source code form | this source code form is subject to the terms of the mozilla public license
"""
#: headers that name a version after the publisher: label | name
PUBLISHED = r"""
gpl | gnu general public license
lgpl | gnu (?:lesser|library) general public license
agpl | gnu affero general public license
"""
GRANT = r"(?:is |are |be )?(?:licensed|released|distributed|published|available|provided|redistributed|offered) under (?:the )?(?:terms (?:and conditions )?of )?(?:the )?"
TERMS = r"\(*(?:[0-9a-z.+-]+\)* (?:or|and|with) \(*)*"  # the terms before one of a declared expression
VERSION = r",? ?(?:\(?(?:version|ver\.?|v\.?)? ?)"


class Rule:
    __slots__ = ("label", "keyword", "regex", "priority", "score", "order", "needs")

    def __init__(self, label, keyword, regex, priority, score, order, needs):
        self.label, self.keyword, self.priority, self.score, self.order = label, keyword.encode(), priority, score, order
        self.regex, self.needs = spaced(regex), needs


def spaced(regex: str) -> re.Pattern:
    """A space stands for whitespace and comment marks."""
    out = re.sub(r" \?(?![^\[]*\])", r"[\\s*#/]*", regex)
    return re.compile(re.sub(r" (?![^\[]*\])", r"[\\s*#/]+", out).encode())


def fixed_part(regex: str) -> str:
    """The longest string that every match of an address holds."""
    parts = re.split(r"\(\?:.*?\)\??|\[.*?\](?:\{.*?\})?|\\b|\w\?", regex)
    return max(parts, key=len).replace("\\.", ".")


def rules() -> list[Rule]:
    """From the list: for each name a declared identifier, a grant sentence, a bare mention and an address; the first
    three once more for each version; then the bodies and headers. Priority: 100 identifier, 95 header with a version, 90 /
    80 grant with / without version, 85 body, 70 address, 60 / 50 mention."""
    made: list[Rule] = []

    def add(label, keyword, regex, priority, score, needs=None):
        made.append(Rule(label, keyword, regex, priority, score, len(made), needs))

    for line in LICENSES.strip().splitlines():
        label, keyword, name, versions, address = _fields(line)
        name, whole = rf"(?<![0-9a-z]){name}", rf"(?<![0-9a-z]){name}(?![0-9a-z])"
        bare = spaced(name)
        for version in [*versions.split(), ""]:
            own = f"{label}-{version if '.' in version else version + '.0'}" if version else label
            number = re.escape(version.removesuffix(".0")) + r"(?:\.0)?" if version.endswith(".0") else re.escape(version) + ("" if "." in version else r"(?:\.0)?")
            tail = VERSION + number + r"(?![0-9.]*[0-9])" if version else ""
            add(own, "spdx", rf"spdx-license-identifier: ?{TERMS}({re.escape(own)}(?:-only|-or-later|\+)?)(?![0-9a-z.-])", 100, 1.0)
            said = name + tail if version else whole
            add(own, keyword, GRANT + said, 90 if version else 80, 0.95 if version else 0.9, bare)
            add(own, keyword, said, 60 if version else 50, 0.8 if version else 0.6, bare)
        add(label, fixed_part(address), address, 70, 0.85)
    for line in BODIES.strip().splitlines():
        label, keyword, body = _fields(line)
        add(label, keyword, body, 85, 0.95)
    for line in PUBLISHED.strip().splitlines():
        label, name = _fields(line)
        for version in ("1", "2", "2.1", "3"):
            number = re.escape(version) + ("" if "." in version else r"(?:\.0)?")
            body = rf"{name},? as published by the free software foundation[;,]? (?:either )?version {number}(?![0-9.]*[0-9])"
            add(f"{label}-{version if '.' in version else version + '.0'}", "free software foundation", body, 95, 0.95)
    return made


def _fields(line: str) -> list[str]:
    """The five columns of a line; a name may hold bars inside brackets."""
    parts, depth, now = [], 0, ""
    for c in line:
        depth += (c == "(") - (c == ")")
        if c == "|" and not depth:
            parts.append(now)
            now = ""
        else:
            now += c
    return [p.strip() for p in [*parts, now]]


def detections(text: bytes, table: list[Rule]) -> list[tuple[int, int, Rule]]:
    """Matches of a lower-case text after suppression, by start."""
    has = {k: any(all(w in text for w in option.split()) for option in k.split(b",")) for k in {r.keyword for r in table}}
    able = [r for r in table if has[r.keyword]]
    named = {n: n.search(text) is not None for n in {r.needs for r in able} if n}
    found = [(*m.span(r.regex.groups), r) for r in able if named.get(r.needs, True) for m in r.regex.finditer(text)]
    found.sort(key=lambda f: (-f[2].priority, f[0] - f[1], f[0], f[2].order))
    kept: list[tuple[int, int, Rule]] = []
    starts: list[int] = []
    ends: list[int] = []
    for a, b, rule in found:
        k = bisect.bisect_right(starts, a) - 1
        if k >= 0 and ends[k] >= b:
            continue
        k += 1
        starts.insert(k, a)
        ends.insert(k, max(b, ends[k - 1] if k else 0))
        for later in range(k + 1, len(ends)):
            if ends[later] >= ends[k]:
                break
            ends[later] = ends[k]
        kept.append((a, b, rule))
    return sorted(kept, key=lambda f: (f[0], f[1]))


def phrase_regex(phrase: str) -> re.Pattern:
    word, gap = rb"[0-9a-z\x80-\xff]", rb"[\x00-\x2f\x3a-\x60\x7b-\x7f]+"
    return re.compile(rb"(?<!" + word + rb")" + gap.join(w.encode() for w in phrase.split()) + rb"(?!" + word + rb")")


SCHEMA = (
    "id {id}, n_words bigint, places array<bigint>, base_labels array<string>, "
    "found array<struct<label:string,start:bigint,end:bigint,priority:int,score:double>>"
)


def scan_licenses(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Per document: id, n_words, places (first words of all phrases, in order), base_labels, and found (label, start,
    end in code points, priority, score) after suppression."""
    kind = pa.list_(
        pa.struct([("label", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("priority", pa.int32()), ("score", pa.float64())])
    )

    def work(batches):
        table = rules()
        phrases = [(phrase_regex(p), label, p.split()[0].encode()) for p, label in PHRASES]
        for whole in batches:
            for batch in sh.slices(whole, 1):
                texts = batch.column(1)
                n = len(texts)
                offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + n + 1].astype(np.int64)
                data = texts.buffers()[2]
                raw = sh._LOWER[np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]]] if data else np.empty(0, np.uint8)
                offsets -= offsets[0]
                word = sh._IS_WORD[raw]
                begins = word.copy()
                begins[1:] &= ~word[:-1]
                at = offsets[:-1][offsets[:-1] < len(raw)]
                begins[at] = word[at]
                starts = np.flatnonzero(begins)
                firsts = np.searchsorted(starts, offsets)
                lower = raw.tobytes()
                places, labels, found = [], [], []
                for k in range(n):
                    a, b = int(offsets[k]), int(offsets[k + 1])
                    text = lower[a:b]
                    own, names, kept = [], set(), []
                    if b"license" in text:
                        for regex, label, first in phrases:
                            if first in text:
                                for m in regex.finditer(text):
                                    own.append(int(np.searchsorted(starts, a + m.start()) - firsts[k]))
                                    names.add(label)
                    hits = detections(text, table)
                    if hits:
                        points = np.append(0, np.cumsum((raw[a:b] & 0xC0) != 0x80))
                        kept = [
                            {"label": r.label, "start": int(points[x]), "end": int(points[y]), "priority": r.priority, "score": r.score}
                            for x, y, r in hits
                        ]
                    places.append(sorted(own))
                    labels.append(sorted(names))
                    found.append(kept)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0), pa.array(np.diff(firsts)), pa.array(places, pa.list_(pa.int64())),
                        pa.array(labels, pa.list_(pa.string())), pa.array(found, kind),
                    ],
                    names=["id", "n_words", "places", "base_labels", "found"],
                )

    narrow = docs.select(column(id_column).alias("id"), text_of(text_column).alias("text"))
    return narrow.mapInArrow(work, SCHEMA.format(id=dict(docs.dtypes)[id_column]))
