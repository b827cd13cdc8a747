from __future__ import annotations

import hashlib
import itertools
import random
import time
import zlib
from collections import defaultdict
from functools import lru_cache

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from spanveil.llm import conversation_repair as cr

ENDS = " \t\n\x0b\f\r"
SCHEMA = "conv_id long, turn long, role string, text string, part int, audit string, o0 string, d1 string, fault string"


def brute_edits(rows):
    """(cost, audit) by trying all edits from the end on; ``rows``: (initial, fault)."""

    @lru_cache(None)
    def best(at, said, inserts):
        ways = []
        if at == len(rows) and said in ("", "a"):
            ways.append((0, ""))
        if inserts < 2:
            cost, audit = best(at, "a" if said == "u" else "u", inserts + 1)
            ways.append((cost + 2, "I" + audit))
        if at < len(rows):
            initial, fault = rows[at]
            cost, audit = best(at + 1, said, 0)
            ways.append((cost + 3, "D" + audit))
            if fault in (0, 3):
                cost, audit = best(at + 1, "a" if said == "u" else "u", 0)
                ways.append((cost + 2 + (fault == 3), "R" + audit))
                if (said, initial) in {("", "s"), ("", "u"), ("s", "u"), ("u", "a"), ("a", "u")}:
                    cost, audit = best(at + 1, initial, 0)
                    ways.append((cost + (fault == 3), "K" + audit))
        return min(ways, default=(10**9, ""))

    return best(0, "", 0)


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        hit = zlib.crc32(key.encode()) % 20
        if hit == 0:
            continue
        text = "" if hit == 1 else text.translate({ord(c): None for c in ".!?"}) if hit == 2 else text
        out += [(conv, turn, "user" if hit == 4 else role, text)] * (2 if hit == 3 else 1)
    return out


def in_order(row):
    return row[1] is not None, row[1] or 0, row[2], hashlib.md5(row[3].encode()).digest()


def expected(rows):
    groups = defaultdict(list)
    for r in damage(rows):
        groups[r[0]].append(r)
    out = []
    for conv in {r[0] for r in rows}:
        own = sorted(groups[conv], key=in_order)
        turns = {r[1] for r in own if r[1] is not None}
        coded, seen = [], set()
        for _, _, role, text in own:
            bare = text.rstrip(ENDS)
            fault = 1 if not bare else 2 if (role, text) in seen else 3 if bare[-1] not in ".!?" else 0
            seen.add((role, text))
            coded.append((role[:1], fault))
        cost, audit = brute_edits(tuple(coded))
        illegal = sum(a + b not in ("su", "ua", "au") for (a, _), (b, _) in itertools.pairwise(coded))
        lines, said, left = [], "", iter(own)
        for e in audit:
            row = None if e == "I" else next(left)
            if e == "D":
                continue
            if e == "K":
                said = row[2][:1]
                lines.append(f"{row[2]}:{row[3]}")
            else:
                said = "a" if said == "u" else "u"
                lines.append(f"{'assistant' if said == 'a' else 'user'}:{'' if row is None else row[3]}")
        faults = [sum(f == k for _, f in coded) for k in (1, 2, 3)]
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        out.append((conv, gaps, *faults, illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(out, key=repr)


def corpus(convs=120, most=9):
    rng = random.Random(11)
    texts = ["Fine.", "And so on", "", " \t", "Why?", "A line\nof two lines!", "tail. \n", None, "é日本。", "x" * 50_000 + "."]
    roles = ["user", "assistant", "user", "assistant", "system", "tool", "", None, "User"]
    rows = []
    for conv in range(convs):
        for turn in range(rng.randint(1, most)):
            role = ("user", "assistant")[turn % 2] if rng.random() < 0.6 else rng.choice(roles)
            rows.append((conv, turn + (rng.random() < 0.1) * 3, role, rng.choice(texts) if rng.random() < 0.5 else f"Said {conv % 7} {turn}."))
    rows += [(None, k, "user", f"t{k}.") for k in range(4)] + [(900, None, "user", "No turn."), (900, None, "user", "No turn."), (900, 1, "user", "One.")]
    rows += [(901, 5, r, t) for r, t in (("user", "b."), ("assistant", "a."), ("user", "a."), ("user", "a."))]
    gone = next(k for k in itertools.count(1000) if zlib.crc32(f"{k}:0".encode()) % 20 == 0)
    return rows + [(gone, 0, "user", "This row is dropped.")]


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "x", "y", "z", "w") for r in rows], SCHEMA)


def repaired(spark, rows, segment=cr.SEGMENT, parts=5):
    hurt = cr.damaged(cr.turns(frame(spark, rows).repartition(parts)))
    plans = cr.kept(cr.repair_plans(hurt, segment))
    digests = {r.conv_id: r.repaired_sha256 for r in cr.repaired_digests(hurt, plans).collect()}
    found = sorted([(*r, digests[r.conv_id]) for r in plans.collect()], key=repr)
    return found, hurt, plans


def test_search_against_all_edits():
    rng = random.Random(5)
    cr.best_edits.cache_clear()
    for _ in range(3000):
        rows = tuple((rng.choice(["s", "u", "a", "", "u", "a"]), rng.choice([0, 0, 0, 1, 2, 3])) for _ in range(rng.randint(0, 9)))
        found = cr.best_edits(rows, cr.START, cr.GOALS)
        assert found == brute_edits(rows), rows


@pytest.mark.parametrize("size", [1, 2, 3, 7])
def test_tables_of_segments_give_the_same(size):
    rng = random.Random(size)
    for _ in range(150):
        rows = tuple((rng.choice(["s", "u", "a", "", "u", "a"]), rng.choice([0, 0, 1, 2, 3])) for _ in range(rng.randint(1, 14)))
        cuts = [cr.table_of(rows[k : k + size], cr.STATES, cr.STATES) for k in range(0, len(rows), size)]
        assert cr.goal_of(cr.joined_all(cuts)) == brute_edits(rows)


def test_bounds_never_exceed_the_cost():
    rng = random.Random(8)
    for _ in range(2000):
        rows = tuple((rng.choice(["s", "u", "a", ""]), rng.choice([0, 0, 0, 1, 3])) for _ in range(rng.randint(0, 7)))
        rest, first = cr.bounds(rows)
        for state in cr.STATES:
            least = min(e[0] for g in cr.GOALS if (e := cr.best_edits(rows, state, (g,))) is not None)
            assert (first if state == cr.START else rest)[0] <= least


def test_search_stays_small():
    rng = random.Random(2)
    started = time.process_time()
    for k in range(20):
        choose = (["u"], ["u", "a"], ["s", "u", "a", ""], ["s"], [""])[k % 5]
        rows = tuple((rng.choice(choose), rng.choice([0, 3, 0, 1])) for _ in range(cr.SEGMENT))
        cr.table_of(rows, cr.STATES, cr.STATES)
    assert time.process_time() - started < 20


@pytest.mark.parametrize("segment, parts", [(cr.SEGMENT, 5), (2, 7)])
def test_against_brute_force(spark, segment, parts):
    rows = corpus()
    found, _, _ = repaired(spark, rows, segment, parts)
    want = expected(rows)
    assert found == [w for w in want if w[0] in {f[0] for f in found}]
    assert {w[0] for w in want} - {f[0] for f in found} == {w[0] for w in want if not any(r[0] == w[0] for r in damage(rows))}


def test_conversation_over_many_partitions(spark):
    rng = random.Random(1)
    rows = [(5, t, rng.choice(["user", "assistant"]), f"Text {t % 900}" + rng.choice([".", "", "!"])) for t in range(4000)]
    rows += [(k, t, "user", f"{k} {t}.") for k in (4, 6) for t in range(3)]
    hurt = cr.damaged(cr.turns(frame(spark, rows)))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert cr.conversation_parts(cr.kept(cr.narrow_rows(hurt))).where("conv_id = 5").count() > 1
        found, _, _ = repaired(spark, rows)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    got = {f[0]: f for f in found}[5]
    own = sorted(damage([r for r in rows if r[0] == 5]), key=in_order)
    seen, coded = set(), []
    for _, _, role, text in own:
        coded.append((role[0], 1 if not text.strip() else 2 if (role, text) in seen else 3 if text[-1] not in ".!?" else 0))
        seen.add((role, text))
    cuts = [cr.table_of(tuple(coded[k : k + 10]), cr.STATES, cr.STATES) for k in range(0, len(coded), 10)]
    assert got[1] == max(r[1] for r in own) - min(r[1] for r in own) + 1 - len({r[1] for r in own})
    assert got[6:8] == cr.goal_of(cr.joined_all(cuts))
    assert got[2:5] == tuple(sum(f == k for _, f in coded) for k in (1, 2, 3))


def test_repaired_turns_are_legal(spark):
    rows = corpus(40)
    _, hurt, plans = repaired(spark, rows)
    out = cr.repaired_turns(hurt, plans).orderBy("conv_id", "place").collect()
    groups = defaultdict(list)
    for r in out:
        groups[r.conv_id].append(r)
    audits = {r.conv_id: r.audit for r in plans.collect()}
    for conv, own in groups.items():
        assert [r.place for r in own] == list(range(len(own)))
        assert "".join(r.edit for r in own) == audits[conv].replace("D", "")
        initials = "".join(r.role[0] for r in own)
        assert initials.removeprefix("s") == "ua" * (len(initials.removeprefix("s")) // 2) and initials != "s"


def test_query_on_awkward_rows(spark, tmp_path):
    rows = corpus(30)
    frame(spark, rows).write.parquet(f"{tmp_path}/conversations.parquet")
    got = entry.queries()["op12_conversations"](spark, str(tmp_path))
    assert got.columns[0] == "conv_id"
    assert sorted(map(tuple, got.collect()), key=repr) == expected(rows)


def test_empty(spark, tmp_path):
    frame(spark, []).write.parquet(f"{tmp_path}/conversations.parquet")
    assert entry.queries()["op12_conversations"](spark, str(tmp_path)).count() == 0
    assert cr.turns(frame(spark, [])).where(F.lit(True)).count() == 0
