from __future__ import annotations

import hashlib
import random
import re
from collections import defaultdict

import pytest

from spanveil.llm.line_dedup import deduplicated, dropped_places, without_repeated_lines
from tests.llm.common import LOWER, awkward, table

ENDS = " \t\n\x0b\f\r"


def key(line):
    return line.strip(ENDS).translate(LOWER)


def brute(pairs, chars=40, least=5):
    holders = defaultdict(set)
    for i, t in pairs:
        for line in (t or "").split("\n"):
            holders[key(line)].add(i)
    low = lambda i: (i is not None, i or 0)
    last = {k: max(ids, key=low) for k, ids in holders.items() if len(k) >= chars and len(ids) >= least}
    out = []
    for i, t in pairs:
        lines = (t or "").split("\n")
        stay = [x for x in lines if key(x) not in last or last[key(x)] == i]
        out.append((i, len(lines), len(lines) - len(stay), "\n".join(stay)))
    return sorted(out, key=repr)


def corpus():
    rng = random.Random(3)
    stock = ["Shared line %d: " % k + "words and more words " * (1 + k % 3) for k in range(12)] + ["short line", "", " \t ", "É" * 40, "é" * 40]
    pairs = awkward(None)
    for k in range(60):
        lines = []
        for _ in range(rng.randint(0, 9)):
            line = rng.choice(stock)
            line = line.upper() if rng.random() < 0.3 and line.isascii() else line
            lines.append(rng.choice(["", " ", "\t", "\r", "\x0b"]) + line + rng.choice(["", " \r", "\f"]))
            if rng.random() < 0.4:
                lines.append(f"own line {k} {rng.random()} " + "x" * 50)
        pairs.append((100 + k // (2 if k > 50 else 1), "\n".join(lines)))
    return pairs + [(None, "\n".join(stock[:4])), (7000, "\n".join([stock[0]] * 3 + [""])), (7000, stock[0])]


@pytest.mark.parametrize("bound", [0, 32 << 20])
def test_against_brute_force(spark, bound):
    pairs = corpus()
    got = deduplicated(table(spark, pairs).repartition(5), broadcast_bytes=bound).collect()
    rows = sorted([(r.doc.doc_id, r.n_lines, len(r.places), r.text) for r in got], key=repr)
    assert rows == brute(pairs)
    assert sum(r[2] for r in rows) > 100


def test_columns_stay(spark):
    pairs = corpus()
    docs = table(spark, pairs)
    out = without_repeated_lines(docs)
    assert out.columns == docs.columns and out.schema.simpleString() == docs.schema.simpleString()
    got = sorted([(r.doc_id, r.text or "") for r in out.collect()], key=repr)
    assert got == sorted([(i, t) for i, _, _, t in brute(pairs)], key=repr)
    assert out.where("text is null").count() == sum(t is None for _, t in pairs)
    assert {(r.id, r.key, r.row) for r in out.collect()} == {("x", None, "y")}


def test_thresholds_and_kept_line(spark):
    line, brink = "L" * 40, "m" * 39
    pairs = [(k, f"{line}\n{brink}\n{line}") for k in range(5)] + [(9, "q" * 40), (8, "q" * 40), (8, "Q" * 40), (10, "q" * 40), (11, " " + "q" * 40)]
    got = {(r.doc.doc_id, r.text) for r in deduplicated(table(spark, pairs)).collect()}
    assert {t for i, t in got if i < 4} == {brink} and (4, f"{line}\n{brink}\n{line}") in got
    assert (8, "Q" * 40) in got and (11, " " + "q" * 40) in got  # four documents: rows of one id are one


def test_long_text_with_many_dropped_lines(spark):
    same = "\n".join(f"line number {k} of a very long text that others hold as well" for k in range(20_000))
    got = {r.doc.doc_id: r for r in deduplicated(table(spark, [(k, same + f"\nend {k}") for k in range(6)])).collect()}
    assert all(got[k].text == f"end {k}" and len(got[k].places) == 20_000 for k in range(5))
    assert hashlib.sha256(got[5].text.encode()).hexdigest() == hashlib.sha256((same + "\nend 5").encode()).hexdigest()


def test_empty_and_native(spark):
    assert deduplicated(table(spark, [])).count() == 0
    docs = table(spark, [(1, "a")])
    for df in (deduplicated(docs), dropped_places(docs)):
        assert not re.search("Python|Arrow|Pandas", df._jdf.queryExecution().toString())
