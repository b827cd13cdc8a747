from __future__ import annotations

import hashlib
import math
import re
from collections import Counter, defaultdict

from spanveil.llm import private_terms as pt
from tests.llm.common import awkward, prose, table


def luhn(d):
    total = 0
    for k, c in enumerate(reversed(d)):
        c = int(c) * (1 + k % 2)
        total += c - 9 if c > 9 else c
    return total % 10 == 0


def digits(v):
    return re.sub("[^0-9]", "", v)


FORMATS = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda v: True),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda v: all(int(x) <= 255 for x in v.split("."))),
    ("card", r"[0-9]([\x20-]?[0-9])+", lambda v: 13 <= len(digits(v)) <= 19 and luhn(digits(v))),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda v: 9 <= len(digits(v)) <= 15),
]
EDGES = [
    "a" * 30000, "a." * 20000 + "@b.c", "1." * 9000, "1 " * 9000, "+1" + " 2" * 7 + " x +12345678901", "a@b.c.d@e.f", "a@b.c_d@e.f.g",
    "é1.2.3.4.5.6.7.8 256.1.1.1 001.002.003.0255", "4539 1488 0343 6467 4539148803436467", "x+y@z-.a.b", "a@b.c\n4539148803436467",
    "😀 me@x.yz +1 (743) 555-3824 10.0.0.1", "+" * 5000 + "1", "-".join("9" * 40), "a@b@c.d@e.f",
]


def base(text):
    return [[(k, m.start(), m.end(), m[0]) for m in re.finditer(p, text) if ok(m[0])] for k, p, ok in FORMATS]


def spelled(spans):
    return ",".join(f"{k}:{a}:{b}" for k, a, b, _ in spans)


def test_base_formats(spark):
    pairs = awkward(spark) + [(100 + k, t) for k, t in enumerate(EDGES)]
    rows = pt.digest_columns(pt.personal_spans(table(spark, pairs).repartition(5))).collect()
    want = []
    for i, t in pairs:
        found = base(t or "")
        text = spelled([s for kind in found for s in kind])
        want.append((i, *map(len, found), hashlib.sha256(text.encode()).hexdigest(), text))
    got = [(r.doc_id, r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256, r.spans) for r in rows]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def telling(spark):
    """One entity whose neighbours 'Nightjar' and 'Tern' tell it, among many lines of other words."""
    pairs = [(k, prose(k, 12) + f"\nwrite to jo@x.org or Nightjar, {'Tern ' if k % 2 else ''}{prose(900 + k, 3)} now\n" + prose(50 + k, 12)) for k in range(6)]
    pairs += [(20 + k, f"write to us or now {'tern' if k < 9 else 'gull'}\n" + prose(k + 200, 25)) for k in range(40)]
    return pairs


def brute_terms(pairs, general, remove):
    lines = [line for _, t in pairs for line in (t or "").split("\n")]
    word = re.compile(pt.ANY_CASE_WORD)
    n_t, n_c, n_ct, where = Counter(), Counter(), Counter(), defaultdict(set)
    for line in lines:
        n_t.update({w.lower() for w in word.findall(line)})
        found = [s for kind in base(line) for s in kind]
        inside = lambda m: any(a < m.end() and m.start() < b for _, a, b, _ in found)
        terms = {m[0].lower() for m in word.finditer(line) if not inside(m)}
        for c in {v.lower() for *_, v in found}:
            n_c[c] += 1
            for t in terms:
                n_ct[c, t] += 1
                where[c, t].add(line)
    out = {}
    for (c, t), n in n_ct.items():
        if len(where[c, t]) < 2:
            continue
        pmi, ic = math.log2(len(lines) * n / (n_c[c] * n_t[t])), math.log2(len(lines) / n_c[c])
        if pmi >= general * ic:
            out[c, t] = "removed" if pmi >= remove * ic else "general"
    return out


def test_terms_against_brute_force(spark):
    pairs = telling(spark)
    docs = table(spark, pairs)
    for general, remove in ((pt.GENERALISE, pt.REMOVE), (0.2, 0.6)):
        lines = pt.kept(pt.entity_lines(docs))
        got = {(r.entity, r.term): r.action for r in pt.disclosing_terms(docs, lines, generalise=general, remove=remove).collect()}
        assert got == brute_terms(pairs, general, remove)
        assert got[("jo@x.org", "nightjar")] == "removed"
        assert general < 0.5 or ("jo@x.org", "write") not in got


def test_sanitised_text(spark):
    pairs = [*telling(spark), (90, None), (91, "")]
    docs = table(spark, pairs)
    done = pt.sanitised(docs)
    assert done.columns == docs.columns
    by = {r.doc_id: r.text for r in done.collect()}
    assert by[90] is None and by[91] == "" and by[25] == dict(pairs)[25]
    assert "write to [EMAIL] or , " in by[0] and "Nightjar" not in "".join(t or "" for t in by.values())
    assert by[0].split("\n")[0] == pairs[0][1].split("\n")[0]


def test_empty_and_native(spark):
    assert pt.personal_spans(table(spark, [])).count() == 0
    plan = pt.personal_spans(table(spark, [(1, "a@b.c")]))._jdf.queryExecution().toString()
    assert not re.search("Python|ArrowEval|Pandas", plan)
