"""Repair of conversation structure: a recursive DuckDB query inside hash-partitioned batches.

Spark damages and classifies rows and deals whole conversations to partitions by hash. In each batch
one recursive query advances all its conversations by a row a step, and keeps for each grammar state
the least (cost, audit). A long conversation is cut into pieces: the states carry over, edits that all
states agree on are settled, and their rows go into the running hash, so that a task holds a piece
and not a conversation.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Grammar (s?(ua)+)?: nothing yet, after s, after u, after a. The first and the last may end.
START, AFTER_S, AFTER_U, AFTER_A = range(4)
#: Role initials that a state takes as they are, and the state after.
TAKES = {(START, "s"): AFTER_S, (START, "u"): AFTER_U, (AFTER_S, "u"): AFTER_U, (AFTER_U, "a"): AFTER_A, (AFTER_A, "u"): AFTER_U}
#: The state after a user or assistant row, whichever fits.
FILLED = {START: AFTER_U, AFTER_S: AFTER_U, AFTER_U: AFTER_A, AFTER_A: AFTER_U}
INITIALS = ["s", "u", "a", ""]
#: Faults of a row, in order of precedence, and rows that damage drops.
SOUND, BLANK, DUPLICATE, TRUNCATED, DROPPED = range(5)
REROLE, DELETE, INSERT, UNFINISHED = 1, 2, 5, 5
#: What a state can save at most in all that follows, against the state after an a: its s row, nothing, an insert.
SAVES = {START: DELETE, AFTER_S: 0, AFTER_U: INSERT, AFTER_A: 0}
#: Rows of a piece, and rows of one conversation after which a piece is cut.
PIECE, STRIDE = 8_192, 512


def moves() -> list[tuple[int, int, str, int, str, int]]:
    """(state, fault, initial, state after, letters, cost): an edit of one row and up to two inserts behind it.

    More inserts than two never pay: from any state, two reach all that inserts can reach.
    """
    out = []
    for fault in (SOUND, BLANK, DUPLICATE, TRUNCATED, DROPPED):
        for initial in INITIALS:
            for state in range(4):
                if fault == DROPPED:
                    out.append((state, fault, initial, state, "", 0))
                    continue
                edits = [(state, "D", DELETE)]
                if fault in (SOUND, TRUNCATED):
                    more = UNFINISHED if fault == TRUNCATED else 0
                    edits.append((FILLED[state], "R", REROLE + more))
                    if (state, initial) in TAKES:
                        edits.append((TAKES[state, initial], "K", more))
                for after, letter, cost in edits:
                    out += [(state, fault, initial, a, letter + i, cost + c) for a, i, c in inserts(after)]
    return out


def inserts(state: int) -> list[tuple[int, str, int]]:
    once = FILLED[state]
    return [(state, "", 0), (once, "I", INSERT), (FILLED[once], "II", 2 * INSERT)]


#: One step a row of every conversation; ``best`` orders by cost, then by audit as bytes.
WALK = """
with recursive walk as (
  select g, 0 as k, state, cost, audit from starts
  union all
  select g, k, state, best.cost as cost, best.audit as audit from (
    select w.g, w.k + 1 as k, m.after as state, min({'cost': w.cost + m.cost, 'audit': w.audit || m.letters}) as best
    from walk w join piece p on p.g = w.g and p.k = w.k + 1
    join moves m on m.state = w.state and m.fault = p.fault and m.initial = p.initial
    group by w.g, w.k, m.after
  )
)
select w.g, w.state, w.cost, w.audit from walk w join (select g, max(k) as k from piece group by g) last using (g, k) order by w.g, w.state
"""


class Walker:
    """A DuckDB connection of one task with the table of moves."""

    def __init__(self) -> None:
        import duckdb

        self.duck = duckdb.connect(":memory:", config={"threads": 1, "memory_limit": "256MB", "autoinstall_known_extensions": False, "autoload_known_extensions": False})
        state, fault, initial, after, letters, cost = zip(*moves(), strict=True)
        codes = [INITIALS.index(i) for i in initial]
        self.duck.register("moves_in", pa.table({"state": state, "fault": fault, "initial": codes, "after": after, "letters": letters, "cost": cost}))
        self.duck.execute("create table moves as select state::int as state, fault::int as fault, initial::int as initial, after::int as after, letters, cost::bigint as cost from moves_in")

    def walk(self, piece: pa.Table, starts: pa.Table) -> dict[int, dict[int, tuple[int, str]]]:
        """For each conversation of the piece: state -> (cost, audit) behind its last row."""
        for name, rows in (("piece", piece), ("starts", starts)):
            self.duck.register("rows_in", rows)
            self.duck.execute(f"create or replace temp table {name} as select * from rows_in")
        out: dict[int, dict[int, tuple[int, str]]] = {}
        for g, state, cost, audit in self.duck.execute(WALK).fetchall():
            out.setdefault(g, {})[state] = (cost, audit)
        return out


@dataclass
class Conversation:
    """What is known of a conversation so far; ``rows`` are those whose edit isn't settled."""

    conv_id: Any
    states: dict[int, tuple[int, str]] = field(default_factory=lambda: {s: (c, i) for s, i, c in inserts(START)})
    audit: list[str] = field(default_factory=list)
    settled: int = START
    lines: int = 0
    rows: list[tuple[str, str]] = field(default_factory=list)
    counts: np.ndarray = field(default_factory=lambda: np.zeros(5, np.int64))
    turns: tuple[int, int] | None = None
    sha: Any = field(default_factory=hashlib.sha256)

    def settle(self, letters: str) -> None:
        """Apply edits to the first rows that wait: they go into the hash, and are forgotten."""
        state, used, out = self.settled, 0, []
        for letter in letters:
            if letter == "D":
                used += 1
                continue
            role, text = ("assistant" if state == AFTER_U else "user", "") if letter == "I" else self.rows[used]
            if letter == "R":
                role = "assistant" if state == AFTER_U else "user"
            used += letter != "I"
            state = TAKES[state, role[:1]] if letter == "K" else FILLED[state]
            out.append(f"{role}:{text}")
        if out:
            self.sha.update((("\n" if self.lines else "") + "\n".join(out)).encode("utf-8", "surrogatepass"))
        self.lines, self.settled, self.rows = self.lines + len(out), state, self.rows[used:]
        self.audit.append(letters)

    def settle_common(self) -> None:
        """Drop states that can no longer win, and settle what the others' audits begin with."""
        if AFTER_A in self.states:
            most = self.states[AFTER_A][0]
            self.states = {s: v for s, v in self.states.items() if v[0] <= most + SAVES[s]}
        common = os.path.commonprefix([audit for _, audit in self.states.values()])
        if common:
            self.settle(common)
            self.states = {s: (c, a[len(common):]) for s, (c, a) in self.states.items()}

    def result(self) -> tuple[Any, ...]:
        cost, rest = min(self.states[s] for s in (START, AFTER_A) if s in self.states)
        self.settle(rest)
        gaps = self.turns[1] - self.turns[0] + 1 - int(self.counts[4]) if self.turns else 0
        return (self.conv_id, gaps, *self.counts[:4].tolist(), cost, "".join(self.audit), self.sha.hexdigest())


def pieces(first: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of rows: ``PIECE`` at most, and cut where one conversation has gone on for ``STRIDE`` rows."""
    begin = run = 0
    for i in range(len(first)):
        run = 0 if first[i] else run + 1
        if i > begin and (i - begin >= PIECE or run >= STRIDE):
            yield begin, i
            begin, run = i, 0
    if begin < len(first):
        yield begin, len(first)


NAMES = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def repair_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows by conversation, in order, with columns conv_id, first, fault, initial, illegal, new_turn, turn, role, text."""
    walker, now, kind = None, None, None
    for batch in batches:
        walker, kind = walker or Walker(), batch.schema.field(0).type
        column = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
        first, fault, initial, illegal, new_turn = (column[n].to_numpy(zero_copy_only=False) for n in ("first", "fault", "initial", "illegal", "new_turn"))
        done: list[tuple[Any, ...]] = []
        for a, b in pieces(first):
            begun = np.flatnonzero(first[a:b])
            carried = now is not None and not first[a]
            if now is not None and not carried:
                done.append(now.result())
            own = ([now] if carried else []) + [Conversation(i) for i in column["conv_id"].slice(a, b - a).take(pa.array(begun)).to_pylist()]
            edges = np.concatenate([[0] if carried else [], begun, [b - a]]).astype(np.int64)
            g = np.repeat(np.arange(len(own)), np.diff(edges))
            k = np.arange(b - a) - edges[:-1][g] + 1
            starts = [(i, s, c, t) for i, v in enumerate(own) for s, (c, t) in v.states.items()]
            found = walker.walk(pa.table({"g": g, "k": k, "fault": fault[a:b], "initial": initial[a:b]}), pa.table(dict(zip(("g", "state", "cost", "audit"), zip(*starts, strict=True), strict=True))))
            roles, texts = column["role"].slice(a, b - a).to_pylist(), column["text"].slice(a, b - a).to_pylist()
            turn, dropped = column["turn"].slice(a, b - a), fault[a:b] == DROPPED
            turns = np.where(dropped, None, turn.to_pandas(integer_object_nulls=True).to_numpy(object))
            marks = np.stack([fault[a:b] == BLANK, fault[a:b] == DUPLICATE, fault[a:b] == TRUNCATED, illegal[a:b] == 1, new_turn[a:b] == 1], 1).astype(np.int64)
            sums = np.add.reduceat(marks, edges[:-1], axis=0)
            for i, v in enumerate(own):
                x, y = edges[i], edges[i + 1]
                v.states = found[i]
                v.rows += [(roles[j], texts[j]) for j in range(x, y) if not dropped[j]]
                v.counts = v.counts + sums[i]
                known = [t for t in turns[x:y] if t is not None]
                if known:  # rows stand in order of their turns
                    v.turns = (v.turns[0] if v.turns else known[0], known[-1])
            done += [v.result() for v in own[:-1]]
            now = own[-1]
            now.settle_common()
        if done:
            yield packed(done, kind)
    if now is not None:
        yield packed([now.result()], kind)


def packed(done: list[tuple[Any, ...]], kind: pa.DataType) -> pa.RecordBatch:
    kinds = [kind, *[pa.int64()] * 6, pa.string(), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done, strict=True), kinds, strict=True)], names=NAMES)


def damaged(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, dropped: a fixed damage by the hash of id and turn, one case in twenty each.

    Nulls count as one space. Dropped rows stay as marks, so that no conversation goes missing.
    """
    space = F.lit(" ")
    case = F.crc32(F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space)).cast("binary")) % 20
    text = F.coalesce("text", space)
    out = rows.select("conv_id", "turn", F.coalesce("role", space).alias("role"), text.alias("text"), case.alias("case"))
    out = out.withColumns({"text": F.when(F.col("case") == 1, "").when(F.col("case") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")),
                           "role": F.when(F.col("case") == 4, "user").otherwise(F.col("role")), "dropped": F.col("case") == 0})
    return out.withColumn("copy", F.explode(F.when(F.col("case") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))).drop("case", "copy")


def classified(rows: DataFrame) -> DataFrame:
    """Adds each row's first fault, its role's initial as a code, and marks against the row before it.

    Order in a conversation: turn, null first, then role and text; rows of equal turn have no other order.
    """
    order = [F.col("dropped").desc(), F.col("turn").asc_nulls_first(), F.col("role").asc(), F.col("text").asc(), F.col("again").asc()]
    dealt = rows.repartition("conv_id")
    again = F.row_number().over(Window.partitionBy("conv_id", "dropped", "role", "text").orderBy(F.col("turn").asc_nulls_first())) > 1
    line = Window.partitionBy("conv_id").orderBy(*order)
    initial = F.substring("role", 1, 1)
    pair = F.concat(F.lag(initial).over(line), initial)
    was_dropped = F.coalesce(F.lag("dropped").over(line), F.lit(True))
    fault: Column = F.when(F.col("dropped"), DROPPED).when(~F.rlike("text", F.lit(r"[^\x20\x09-\x0D]")), BLANK).when(F.col("again"), DUPLICATE)
    fault = fault.when(F.rlike("text", F.lit(r"[^.!?\x20\x09-\x0D][\x20\x09-\x0D]*\z")), TRUNCATED).otherwise(SOUND)
    code = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3)
    out = dealt.withColumn("again", again).withColumns({
        "first": F.row_number().over(line) == 1,
        "illegal": (~was_dropped & ~pair.isin("su", "ua", "au")).cast("int"),
        "new_turn": (~F.col("dropped") & F.col("turn").isNotNull() & (was_dropped | ~F.col("turn").eqNullSafe(F.lag("turn").over(line)))).cast("int")})
    return out.select("conv_id", "first", fault.alias("fault"), code.alias("initial"), "illegal", "new_turn", F.col("turn").cast("long").alias("turn"), "role", "text")


def repair(conversations: DataFrame, damage: bool = False) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 of every conversation.

    The audit is the cheapest row of edits (Keep, Rerole, Delete, Insert) that makes the roles' initials
    ``(s?(ua)+)?``, the ASCII-least of equals. Nulls: a null role or text is one space, null turns come
    first and are no turn, null ids are one conversation. Ties of a turn stand by role and text,
    repeated rows are duplicates. A conversation of which no row is left has zeros, an empty audit
    and the hash of nothing; an empty table gives an empty one. Other columns are not read. A role
    whose initial is none of s, u, a (an empty one too) can't be kept. A conversation is one hash and
    so one task's work, however long: it streams through in pieces (``STRIDE``), and only its audit
    and the rows that its states do not agree on are held.
    """
    rows = conversations.select("conv_id", "turn", "role", "text")
    space = F.lit(" ")
    rows = damaged(rows) if damage else rows.select("conv_id", "turn", F.coalesce("role", space).alias("role"), F.coalesce("text", space).alias("text"), F.lit(False).alias("dropped"))
    kind = rows.schema["conv_id"].dataType.simpleString()
    schema = f"conv_id {kind}, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
    return classified(rows).mapInArrow(repair_batches, schema)
