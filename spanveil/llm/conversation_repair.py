"""Cheapest repair of a conversation's turn structure, by depth-first branch and bound.

A repaired conversation's role initials are ``(s?(ua)+)?``: perhaps a system turn, then user and assistant in turns.
Edits, in row order: Keep costs 0, Rerole (to user or assistant) 2, Delete 3, Insert (an empty user or assistant turn,
anywhere) 2; a truncated row that is not deleted adds 1; blank and duplicate rows must be deleted. Of all cheapest edits
the one whose string of initials (the audit) is least in ASCII order counts. An audit fixes the roles, since after an
optional kept system turn they alternate.

The search (``best_edits``) keeps an explicit stack of prefixes. A prefix is dropped when its cost plus a lower bound of
the rows to come exceeds the incumbent, when it ties with the incumbent but its audit is already greater, or when the
dominance table of its node (rows done, last role) holds a prefix that is no worse in (cost, audit). That is exact: two
prefixes of one node that cost the same are never a true prefix of one another (the longer one would have more inserts,
so cost more), hence the lesser one stays the lesser whatever follows. The search ends when the stack is empty.

Scale: conversations may be of any length. Narrow rows (a code for each row, no text) are range-partitioned by
conversation and turn, so one conversation may lie in many partitions. Each task cuts its rows into segments of
SEGMENT rows and searches each from every role it may begin with to every role it may end with; such tables of (cost,
audit) are joined like matrices, two by two. A task hands on one row per conversation, and these few are joined per
conversation. No task holds a conversation's texts: the second pass streams the sorted turns behind the audit.

Nulls and ties: a null role or text counts as one space (so the text is blank and the role no legal one); turns are taken
by turn, nulls first, rows of one turn by role, then by the MD5 of the text; a null conversation id is an id. Rows that
repeat role and text within a conversation are duplicates, wherever they stand. Roles count by their first character; an
empty role has none and is never legal. Texts may be empty or of any length. An empty table gives no rows. Only the four
columns are read, so others of any name do no harm.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanveil.llm.common import column, kept

SEGMENT = 16  # rows that one search works on
START, SYSTEM, USER, ASSISTANT = range(4)  # the last role so far
STATES, GOALS = (START, SYSTEM, USER, ASSISTANT), (START, ASSISTANT)
INITIALS = "sua"
NO_FAULT, BLANK, DUPLICATE, TRUNCATED = range(4)
CODES = {(initial, fault): (initial, fault) for initial in ("", *INITIALS) for fault in range(4)}  # one object each
WHITE = " \t\n\x0b\f\r"
Edits = tuple[int, str]


def after_keep(state: int, initial: str) -> int | None:
    """The state after a row with this initial is kept, or None where it may not follow."""
    if initial == "s":
        return SYSTEM if state == START else None
    if initial == "u":
        return None if state == USER else USER
    return ASSISTANT if initial == "a" and state == USER else None


def other(state: int) -> int:
    """The state after the one user or assistant turn that may come next."""
    return ASSISTANT if state == USER else USER


@lru_cache(20_000)
def bounds(rows: tuple[tuple[str, int], ...]) -> tuple[tuple[int, ...], tuple[int, ...]]:
    """Lower bounds of the cost from each row on: after the start, and before any turn.

    Each row costs its cheapest edit; a system turn is kept once at most, and only before all others. Where two legal rows
    that follow each other have the same initial, at least 1 is added: an insert (2) mends one such place, a rerole (2) two,
    a delete (at least 2 more than the row's cheapest edit) one.
    """
    rest, saved, last = [0], [0], None
    for initial, fault in reversed(rows):
        truncated = int(fault == TRUNCATED)
        if fault in (BLANK, DUPLICATE):
            rest.append(rest[-1] + 3)
            saved.append(saved[-1])
        elif initial in ("u", "a"):
            rest.append(rest[-1] + truncated + (initial == last))
            saved.append(saved[-1])
            last = initial
        else:
            cost = min(3, 2 + truncated)
            rest.append(rest[-1] + cost)
            saved.append(max(saved[-1], cost - truncated) if initial == "s" else saved[-1])
            last = None
    rest.reverse()
    saved.reverse()
    return tuple(rest), tuple(r - s for r, s in zip(rest, saved, strict=True))


@lru_cache(20_000)
def best_edits(rows: tuple[tuple[str, int], ...], start: int, goals: tuple[int, ...]) -> Edits | None:
    """The least (cost, audit) that takes the rows from one state to one of the goals; None if none can."""
    n = len(rows)
    rest, first = bounds(rows)
    best: Edits | None = None
    seen: dict[tuple[int, int], Edits] = {}
    stack: list[tuple[int, int, int, str]] = [(0, start, 0, "")]
    while stack:
        at, state, cost, audit = stack.pop()
        if best is not None:
            least = cost + (first if state == START else rest)[at]
            if least > best[0] or least == best[0] and audit > best[1][: len(audit)]:
                continue
        known = seen.get((at, state))
        if known is not None and known <= (cost, audit):
            continue
        seen[at, state] = cost, audit
        if at == n and state in goals and (best is None or (cost, audit) < best):
            best = cost, audit
        stack.append((at, other(state), cost + 2, audit + "I"))
        if at == n:
            continue
        initial, fault = rows[at]
        stack.append((at + 1, state, cost + 3, audit + "D"))
        if fault in (BLANK, DUPLICATE):
            continue
        cost += fault == TRUNCATED
        stack.append((at + 1, other(state), cost + 2, audit + "R"))
        following = after_keep(state, initial)
        if following is not None:
            stack.append((at + 1, following, cost, audit + "K"))
    return best


Table = tuple[tuple[Edits | None, ...], ...]


def joined(a: Table, b: Table) -> Table:
    """The table of two stretches of rows in a row."""
    out = []
    for own in a:
        line = []
        for end in STATES:
            ways = [
                (own[mid][0] + b[mid][end][0], mid) for mid in STATES if own[mid] is not None and b[mid][end] is not None
            ]
            least = min((c for c, _ in ways), default=None)
            line.append(None if least is None else (least, min(own[mid][1] + b[mid][end][1] for c, mid in ways if c == least)))
        out.append(tuple(line))
    return tuple(out)


def joined_all(tables: list[Table]) -> Table:
    """Neighbours are joined two by two, so that long audits are copied a logarithm of times."""
    while len(tables) > 1:
        pairs = [joined(a, b) for a, b in zip(tables[::2], tables[1::2])]  # noqa: B905
        tables = pairs + (tables[-1:] if len(tables) % 2 else [])
    return tables[0]


def table_of(rows: tuple[tuple[str, int], ...], starts: tuple[int, ...], ends: tuple[int, ...]) -> Table:
    """The cheapest edits from each of these states to each of those; None elsewhere."""
    return tuple(
        tuple(best_edits(rows, start, (end,)) if start in starts and end in ends else None for end in STATES)
        for start in STATES
    )


def goal_of(table: Table) -> Edits:
    """The cheapest edits of a whole conversation."""
    return min(e for e in (table[START][goal] for goal in GOALS) if e is not None)


def digest(text: str = "text") -> Column:
    return F.unhex(F.md5(text))


def ordered(turn: str = "turn") -> list[Column]:
    return [F.col(turn).isNotNull(), F.coalesce(turn, F.lit(0))]


def turns(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """The four columns by their own names, null roles and texts as one space."""
    blank = F.lit(" ")
    return conversations.select(
        column(conv).cast("bigint").alias("conv_id"), column(turn).cast("bigint").alias("turn"),
        F.coalesce(column(role).cast("string"), blank).alias("role"), F.coalesce(column(text).cast("string"), blank).alias("text"),
    )


def narrow_rows(rows: DataFrame) -> DataFrame:
    """conv_id, o0 and o1 (order of the turn), role, initial, digest (of the text), blank, truncated, later (an earlier turn has
    the same role and text). No text leaves the scan."""
    tail = F.substring(F.rtrim(F.col("text"), F.lit(WHITE)), -1, 1)
    found = rows.select(
        "conv_id", "turn", F.substring("role", 1, 1).alias("initial"), "role", digest().alias("digest"),
        (F.length(tail) == 0).alias("blank"), (~tail.isin(".", "!", "?")).alias("truncated"),
    )
    order = F.struct(*[c.alias(f"o{k}") for k, c in enumerate(ordered())])
    firsts = found.groupBy("conv_id", "role", "digest").agg(F.min(order).alias("first"))
    same = firsts.select(F.col("conv_id").alias("c"), F.col("role").alias("r"), F.col("digest").alias("d"), "first")
    own = F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("role") == F.col("r")) & (F.col("digest") == F.col("d"))
    return found.join(same, own).select(
        "conv_id", *[c.alias(f"o{k}") for k, c in enumerate(ordered())], "role", "initial", "digest", "blank", "truncated",
        (order > F.col("first")).alias("later"),
    )


def names_of(schema: str) -> list[str]:
    return [f.split()[0] for f in schema.split(", ")]


PART = (
    "conv_id long, part int, n_blank long, n_duplicate long, n_truncated long, illegal long, first string, last string, "
    "least long, most long, n_turns long, edits array<struct<cost:long,audit:string>>"
)


def conversation_parts(rows: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """One row per conversation and partition of the sorted rows: counts of its stretch and its table of edits."""

    def work(batches):
        out = _Parts(segment)
        for batch in batches:
            out.add(batch)
            if len(out.rows) >= 512:
                yield out.batch()
        out.close(ends=STATES)
        yield out.batch()

    order = [F.col("conv_id").isNotNull(), F.col("conv_id"), "o0", "o1", "role", "digest"]
    sorted_rows = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    flat = sorted_rows.select(
        "conv_id", F.spark_partition_id().alias("part"), F.when(F.col("o0"), F.col("o1")).alias("turn"), "initial", "digest",
        "role", F.when(F.col("blank"), BLANK).when(F.col("later"), DUPLICATE).when(F.col("truncated"), TRUNCATED)
        .otherwise(NO_FAULT).alias("fault"),
    )
    return flat.mapInArrow(work, PART)


class _Parts:
    """Folds sorted rows into one record per conversation, holding one segment's rows and the tables of those before it.

    Only a partition's first conversation may have begun before it, and only its last one may go on beyond it.
    """

    def __init__(self, segment: int):
        self.rows: list[tuple] = []
        self.size, self.conv, self.open, self.starts = segment, None, False, STATES

    def add(self, batch: pa.RecordBatch) -> None:
        names = ("conv_id", "part", "turn", "initial", "digest", "role", "fault")
        for conv, part, turn, initial, digest, role, fault in zip(*(batch.column(c).to_pylist() for c in names), strict=True):
            if not self.open or conv != self.conv:
                self.close(ends=GOALS)
                self.conv, self.part, self.open = conv, part, True
                self.faults, self.illegal, self.first, self.last = [0] * 4, 0, initial, None
                self.least = self.most = None
                self.turns, self.segment, self.tables, self.same = 0, [], [], None
            if (turn, role, digest) == self.same and fault != BLANK:  # the same row again, at the same turn
                fault = DUPLICATE
            self.same = turn, role, digest
            self.faults[fault] += 1
            self.illegal += self.last is not None and self.last + initial not in ("su", "ua", "au")
            self.last = initial
            if turn is not None and turn != self.most:
                self.least = turn if self.least is None else self.least
                self.most, self.turns = turn, self.turns + 1
            self.segment.append(CODES[initial if initial in INITIALS else "", fault])
            if len(self.segment) == self.size:
                self.search(STATES)

    def search(self, ends: tuple[int, ...]) -> None:
        self.tables.append(table_of(tuple(self.segment), STATES if self.tables else self.starts, ends))
        self.segment = []

    def close(self, ends: tuple[int, ...]) -> None:
        if not self.open:
            return
        if self.segment:
            self.search(ends)
        self.starts = (START,)  # of the next conversation, which begins here
        table = joined_all(self.tables)
        edits = [None if e is None else {"cost": e[0], "audit": e[1]} for line in table for e in line]
        self.rows.append(
            (self.conv, self.part, *self.faults[1:], self.illegal, self.first, self.last, self.least, self.most, self.turns, edits)
        )
        self.open = False

    def batch(self) -> pa.RecordBatch:
        kinds = [pa.int64(), pa.int32(), *[pa.int64()] * 4, *[pa.string()] * 2, *[pa.int64()] * 3]
        kinds.append(pa.list_(pa.struct([("cost", pa.int64()), ("audit", pa.string())])))
        names = names_of(PART)
        columns = list(zip(*self.rows, strict=True)) or [()] * len(kinds)
        self.rows = []
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)


PLAN = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"


def repair_plans(rows: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """Per conversation of ``turns``: gaps, blank, duplicate, truncated, illegal, cost and audit.

    A conversation has one part, or one per partition that it spreads over.
    """
    parts = conversation_parts(kept(narrow_rows(rows)), segment)
    fields = names_of(PART)[1:]
    grouped = parts.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("parts"))

    def work(batches):
        for batch in batches:
            found = [plan_of(c, p) for c, p in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
            yield _batch(found, PLAN)

    return grouped.mapInArrow(work, PLAN)


def plan_of(conv: int | None, parts: list[dict]) -> tuple:
    known = [p for p in parts if p["least"] is not None]
    gaps = 0
    if known:
        shared = sum(a["most"] == b["least"] for a, b in zip(known, known[1:]))  # noqa: B905
        gaps = known[-1]["most"] - known[0]["least"] + 1 - sum(p["n_turns"] for p in known) + shared
    illegal = sum(p["illegal"] for p in parts)
    illegal += sum(a["last"] + b["first"] not in ("su", "ua", "au") for a, b in zip(parts, parts[1:]))  # noqa: B905
    tables = [
        tuple(tuple(None if e is None else (e["cost"], e["audit"]) for e in p["edits"][4 * k : 4 * k + 4]) for k in STATES)
        for p in parts
    ]
    cost, audit = goal_of(joined_all(tables))
    counts = [sum(p[f"n_{kind}"] for p in parts) for kind in ("blank", "duplicate", "truncated")]
    return conv, gaps, *counts, illegal, cost, audit


def _edited(batches) -> Iterator[tuple]:
    """Sorted rows, each conversation's audit before its turns, to (conv_id, edit, role, text, last), turn by turn.

    Deleted turns come with the edit D; ``last`` marks the end of a conversation, whose row has no edit of its own.
    """
    conv, audit, at, state = None, None, 0, START

    def inserts():
        nonlocal at, state
        while at < len(audit) and audit[at] == "I":
            at, state = at + 1, other(state)
            yield conv, "I", "user" if state == USER else "assistant", "", False

    for batch in batches:
        names = ("conv_id", "audit", "role", "text")
        for own, plan, role, text in zip(*(batch.column(c).to_pylist() for c in names), strict=True):
            if plan is not None:
                if audit is not None:
                    yield from inserts()
                    yield conv, None, None, None, True
                conv, audit, at, state = own, plan, 0, START
                continue
            yield from inserts()
            edit, at = audit[at], at + 1
            if edit == "R":
                state = other(state)
                role = "user" if state == USER else "assistant"
            elif edit == "K":
                state = after_keep(state, role[:1])
            yield conv, edit, role, text, False
    if audit is not None:
        yield from inserts()
        yield conv, None, None, None, True


def _with_audits(rows: DataFrame, plans: DataFrame) -> DataFrame:
    """Turns in the plan's order behind their conversation's audit; each conversation is read as a stream by one task."""
    none = F.lit(None).cast("string")
    heads = plans.select("conv_id", F.lit(False).alias("o0"), F.lit(0).cast("bigint").alias("o1"), "audit", none.alias("role"), none.alias("text"))
    tails = rows.select("conv_id", *[c.alias(f"o{k}") for k, c in enumerate(ordered())], none.alias("audit"), "role", "text")
    both = heads.unionByName(tails.withColumn("o1", F.col("o1").cast("bigint")))
    keyed = both.withColumns({"turn_row": F.col("audit").isNull(), "digest": digest()})
    order = ["conv_id", "turn_row", "o0", "o1", "role", "digest"]
    return keyed.repartition("conv_id").sortWithinPartitions(*order).select("conv_id", "audit", "role", "text")


def repaired_turns(rows: DataFrame, plans: DataFrame) -> DataFrame:
    """The repaired conversations: conv_id, place (from 0), edit (K, R or I), role, text."""

    def work(batches):
        out, place = [], 0
        for conv, edit, role, text, last in _edited(batches):
            if last:
                place = 0
            elif edit != "D":
                out.append((conv, place, edit, role, text))
                place += 1
            if len(out) >= 1024:
                yield _batch(out, TURNS)
                out = []
        yield _batch(out, TURNS)

    return _with_audits(rows, plans).mapInArrow(work, TURNS)


TURNS = "conv_id long, place long, edit string, role string, text string"
DIGESTS = "conv_id long, repaired_sha256 string"


def repaired_digests(rows: DataFrame, plans: DataFrame) -> DataFrame:
    """conv_id, repaired_sha256: digest of the repaired ``role:text``, joined by line feeds. Memory does not grow with it."""

    def work(batches):
        out, digest, begun = [], hashlib.sha256(), False
        for conv, edit, role, text, last in _edited(batches):
            if last:
                out.append((conv, digest.hexdigest()))
                digest, begun = hashlib.sha256(), False
            elif edit != "D":
                digest.update(f"{'\n' if begun else ''}{role}:{text}".encode())
                begun = True
            if len(out) >= 1024:
                yield _batch(out, DIGESTS)
                out = []
        yield _batch(out, DIGESTS)

    return _with_audits(rows, plans).mapInArrow(work, DIGESTS)


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    fields = [f.split() for f in schema.split(", ")]
    columns = list(zip(*rows, strict=True)) or [()] * len(fields)
    kinds = {"long": pa.int64(), "string": pa.string()}
    return pa.RecordBatch.from_arrays(
        [pa.array(c, kinds[kind]) for c, (_, kind) in zip(columns, fields, strict=True)], names=[name for name, _ in fields]
    )


def damaged(rows: DataFrame) -> DataFrame:
    """Rows of ``turns`` with faults put in by a checksum of conversation and turn, for trials of the repair.

    Of 20 classes, 0 drops the row, 1 empties its text, 2 takes ``.``, ``!`` and ``?`` out, 3 repeats it, 4 makes it a user's.
    """
    blank = F.lit(" ")
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), blank), F.lit(":"), F.coalesce(F.col("turn").cast("string"), blank))
    hit = rows.withColumn("hit", F.crc32(key.cast("binary")) % 20).where("hit <> 0")
    text = F.when(F.col("hit") == 1, "").when(F.col("hit") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    times = F.when(F.col("hit") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    return hit.select(
        "conv_id", "turn", F.when(F.col("hit") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"),
        F.explode(times).alias("time"),
    ).drop("time")
