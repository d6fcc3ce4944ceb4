"""Conversation repair against a search over all edits, and the damage against the rule's words."""

import hashlib
import itertools
import re
import zlib

import numpy as np
import pytest

from eonmap.llm import chatrepair

GRAMMAR = re.compile(r"(s?(ua)+)?")


def faults(rows):
    out, seen = [], set()
    for _, role, text in rows:
        last = re.findall(r"[^\x20\x09-\x0D]", text)
        out.append("blank" if not last else "duplicate" if (role, text) in seen else "truncated" if last[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def brute(rows, most_inserts=2):
    """Least (cost, audit) and its lines over all edits, up to so many inserts at each place."""
    found = faults(rows)
    best = (10**9, "", [])
    gaps = [[x for n in range(most_inserts + 1) for x in itertools.product(("user", "assistant"), repeat=n)]] * (len(rows) + 1)
    edits = []
    for (_, role, text), fault in zip(rows, found, strict=True):
        own = [(2, "D", None)]
        if fault in ("", "truncated"):
            more = 5 if fault else 0
            own += [(more, "K", (role, text)), (1 + more, "R", ("user", text)), (1 + more, "R", ("assistant", text))]
        edits.append(own)
    for chosen in itertools.product(*edits):
        for added in itertools.product(*gaps):
            lines, letters, cost = [], "", 0
            for i in range(len(rows) + 1):
                for role in added[i]:
                    lines.append((role, ""))
                    letters, cost = letters + "I", cost + 5
                if i < len(rows):
                    cost, letters = cost + chosen[i][0], letters + chosen[i][1]
                    lines += [chosen[i][2]] if chosen[i][2] else []
            initials = "".join(r[:1] or "?" for r, _ in lines)
            if GRAMMAR.fullmatch(initials) and (cost, letters) < best[:2]:
                best = (cost, letters, lines)
    return best


def expected(conv_id, rows):
    """rows: (turn, role, text) in order."""
    found = faults(rows)
    cost, audit, lines = brute(rows, 1 if len(rows) > 3 else 2)
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(rows))
    digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in lines).encode()).hexdigest()
    return (conv_id, gaps, *(found.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, digest)


def result(df):
    return sorted((tuple(r) for r in df.select(*chatrepair.NAMES).collect()), key=str)


SCHEMA = "conv_id long, turn long, role string, text string, cost string"


def test_equals_search_over_all_edits(spark):
    rng = np.random.default_rng(5)
    roles, texts = ["user", "assistant", "system", "tool", "", "u2"], ["Yes.", "no", " \t", "", "What? ", "So!\n"]
    rows, want = [], []
    for conv in range(120):
        n = int(rng.choice(4, p=[.2, .3, .4, .1])) + 1
        own = [(int(rng.integers(0, 9)) if rng.random() < 0.9 else None, roles[rng.choice(6, p=[.35, .35, .1, .1, .05, .05])], texts[rng.integers(0, 6)]) for _ in range(n)]
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        want.append(expected(conv, own))
        rows += [(conv, *r, "x") for r in own]
    rng.shuffle(rows)
    got = result(chatrepair.repair(spark.createDataFrame([tuple(r) for r in rows], SCHEMA)))
    assert got == sorted(want, key=str)


def test_nulls_and_empty_tables(spark):
    rows = [(None, 1, "user", "Hi.", ""), (None, 2, "assistant", "Ho.", ""), (1, None, None, None, ""), (1, None, "user", "A.", ""), (1, 3, "assistant", "B.", "")]
    got = result(chatrepair.repair(spark.createDataFrame(rows, SCHEMA)))
    assert got == sorted([expected(None, [(1, "user", "Hi."), (2, "assistant", "Ho.")]), expected(1, [(None, " ", " "), (None, "user", "A."), (3, "assistant", "B.")])], key=str)
    none = spark.createDataFrame([], SCHEMA)
    assert result(chatrepair.repair(none)) == result(chatrepair.repair(none, damage=True)) == []


def test_damage_follows_the_hash(spark):
    rows = [(c, t, "system" if t == 0 else "user" if t % 2 else "assistant", f"Well. No {c} {t}!") for c in range(30) for t in range(3)] + [(None, None, None, None), (4, None, "user", "Eh?")]
    kept = {}
    for c, t, role, text in rows:
        role, text = role or " ", text or " "
        case = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        own = kept.setdefault(c, [])
        if case:
            text = "" if case == 1 else re.sub("[.!?]", "", text) if case == 2 else text
            own += [(t, "user" if case == 4 else role, text)] * (2 if case == 3 else 1)
    want = []
    for c, own in kept.items():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        want.append(expected(c, own))
    got = result(chatrepair.repair(spark.createDataFrame([(*r, "") for r in rows], SCHEMA), damage=True))
    assert got == sorted(want, key=str)
    gone = [w for w in want if w[1:] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]
    assert len(kept) == len(got) and all(not kept[w[0]] for w in gone if w[7] == "" and not kept[w[0]])


def test_long_conversations_go_in_pieces(spark, monkeypatch):
    """Pieces change nothing: one conversation of 3,000 rows against a plain dynamic programme."""
    rng = np.random.default_rng(8)
    rows = [(9, t, ["user", "assistant", "user", "tool"][rng.integers(0, 4)], f"No {t}" + (".", "")[int(rng.random() < 0.1)]) for t in range(3000)]
    states = {s: (c, i) for s, i, c in chatrepair.inserts(0)}
    for _, _, role, text in rows:
        step = {}
        fault = chatrepair.SOUND if text[-1] == "." else chatrepair.TRUNCATED
        initial = role[0] if role[0] in "sua" else ""
        for s, f, i, after, letters, cost in chatrepair.moves():
            if f == fault and i == initial and s in states:
                mine = (states[s][0] + cost, states[s][1] + letters)
                step[after] = min(step.get(after, mine), mine)
        states = step
    cost, audit = min(states[0], states[3])
    got = result(chatrepair.repair(spark.createDataFrame([(*r, "") for r in rows], SCHEMA).repartition(3)))
    assert [(g[0], g[6], g[7]) for g in got] == [(9, cost, audit)]


def test_settled_rows_are_forgotten():
    import pyarrow as pa

    held = []
    n = 6000
    batch = pa.RecordBatch.from_pydict({"conv_id": pa.array([1] * n), "first": pa.array([i == 0 for i in range(n)]), "fault": pa.array([0] * n, pa.int32()), "initial": pa.array([1, 2] * (n // 2), pa.int32()),
                                        "illegal": pa.array([0] * n, pa.int32()), "new_turn": pa.array([1] * n, pa.int32()), "turn": pa.array(range(n)), "role": ["user", "assistant"] * (n // 2), "text": ["x."] * n})
    keep = chatrepair.Conversation.settle_common
    try:
        chatrepair.Conversation.settle_common = lambda self: (keep(self), held.append(len(self.rows)))[0]
        out = list(chatrepair.repair_batches(iter([batch])))
    finally:
        chatrepair.Conversation.settle_common = keep
    assert len(held) > 5 and max(held) < 20
    assert out[0].to_pydict()["audit"] == ["K" * n]


@pytest.mark.parametrize("state", range(4))
def test_two_inserts_reach_all(state):
    reached = {s for s, _, _ in chatrepair.inserts(state)}
    more = {s for r in reached for s, _, _ in chatrepair.inserts(r)}
    assert more == reached
