"""Repair of conversations against a search over all repairs."""

import functools
import hashlib
import random
import re
import zlib

import pytest

from evalweave.llm import dialogues as D
from evalweave.llm import queries

STATES = {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}


def plain_repair(rows):
    """rows: (initial, role, text, must_go, too_short) -> (cost, audit, repaired lines) by a search over all edits."""

    @functools.cache
    def go(i, state, inserted):
        ways = [(0, "")] if i == len(rows) and state in ("", "a") else []
        if i < len(rows):
            initial, _, _, must_go, too_short = rows[i]
            cost, audit = go(i + 1, state, 0)
            ways.append((cost + 2, "D" + audit))
            if not must_go:
                for c, to in STATES[state].items():
                    if c == initial or c != "s":
                        cost, audit = go(i + 1, to, 0)
                        ways.append((cost + (c != initial) + 5 * too_short, ("K" if c == initial else "R") + audit))
        if inserted < 3:
            for c, to in STATES[state].items():
                if c != "s":
                    cost, audit = go(i, to, inserted + 1)
                    ways.append((cost + 5, "I" + audit))
        return min(ways, default=(10**9, ""))

    cost, audit = go(0, "", 0)
    lines, i, state = [], 0, ""
    for letter in audit:
        c = None
        if letter == "K":
            c = rows[i][0]
            lines.append(f"{rows[i][1]}:{rows[i][2]}")
        elif letter in "IR":
            c = next(x for x in STATES[state] if x != "s")
            lines.append({"u": "user", "a": "assistant"}[c] + ":" + (rows[i][2] if letter == "R" else ""))
        state = STATES[state][c] if c else state
        i += letter != "I"
    assert re.fullmatch("(s?(ua)+)?", "".join(x[0] for x in lines))
    return cost, audit, lines


def plain(table):
    """What the query returns, by conversation."""
    damaged = {}
    for conv, turn, role, text in table:
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        fault = zlib.crc32(key.encode()) % 20
        role, text = (" " if x is None else x for x in (role, text))
        rows = damaged.setdefault(conv, [])
        if fault == 1:
            text = ""
        if fault == 2:
            text = re.sub("[.!?]", "", text)
        if fault == 4:
            role = "user"
        rows += [(turn, role, text)] * (0 if fault == 0 else 2 if fault == 3 else 1)
    out = {}
    for conv, rows in damaged.items():
        rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).digest()))
        seen, marked, faults = set(), [], [0, 0, 0]
        for _, role, text in rows:
            solid = re.sub(r"[\x20\x09-\x0D]", "", text)
            fault = 0 if not solid else 1 if (role, text) in seen else 2 if solid[-1] not in ".!?" else 3
            if fault < 3:
                faults[fault] += 1
            seen.add((role, text))
            marked.append((role[:1], role, text, fault < 2, fault == 2))
        turns = [t for t, _, _ in rows if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        wrong = sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in zip(marked, marked[1:]))
        cost, audit, lines = plain_repair(tuple(marked))
        out[conv] = (gaps, *faults, wrong, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


COLUMNS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def kinds(rng, n):
    return bytes(rng.choices(range(12), [9, 1, 1, 30, 4, 4, 30, 4, 4, 3, 1, 1], k=n))


def rows_of(ks):
    return tuple(("suax"[k // 3], "suax"[k // 3], "t", k % 3 == 1, k % 3 == 2) for k in ks)


def test_alignment_is_the_least():
    rng = random.Random(1)
    for i in range(3000):
        ks = kinds(rng, rng.randrange(0, 12)) if i % 2 else bytes(rng.randrange(12) for _ in range(rng.randrange(0, 9)))
        if ks:
            assert D.whole(ks) == plain_repair(rows_of(ks))[:2], ks


def test_long_alignment():
    rng = random.Random(2)
    for n in (60, 150, 300):
        ks = kinds(rng, n)
        assert D.whole(ks) == plain_repair(rows_of(ks))[:2]


def chained(ks, size):
    parts = [ks[i : i + size] for i in range(0, len(ks), size)]
    onward, behind = D.ENDS, []
    for i in range(len(parts) - 1, -1, -1):
        behind.append(onward)
        costs = D.transitions(parts[i], i == len(parts) - 1)
        onward = [min(D.INF, *(costs[4 * e + x] + onward[x] for x in range(4))) for e in range(4)]
    state, total, audits = D.START, 0, []
    for i, (p, v) in enumerate(zip(parts, reversed(behind))):
        cost, audit, state = D.align(p, state, i == len(parts) - 1, v)
        total += cost
        audits.append(audit)
    return total, "".join(audits), onward[D.START]


def test_segments_as_one():
    rng = random.Random(3)
    for i in range(600):
        ks = kinds(rng, rng.randrange(2, 40)) if i % 3 else bytes(rng.randrange(12) for _ in range(rng.randrange(2, 14)))
        total, audit, ahead = chained(ks, rng.choice((1, 2, 3, 7)))
        assert (total, audit) == D.whole(ks) and ahead == total, ks


def odd_table(seed, n):
    rng = random.Random(seed)
    roles = ["user", "assistant", "system", "user", "assistant", None, "", "tool", "User", "uncle"]
    texts = ["Yes.", "No!", "Really?", "open end", "", None, " \t\n", "a.b \n", "x" * 2000 + ".", "é。", "Yes. ", "y "]
    rows = []
    for conv in [None, *range(n)]:
        for turn in range(rng.choice((1, 1, 2, 5, 9, 14))):
            if rng.random() < 0.9:
                rows.append((conv, rng.choice((turn, turn, turn, turn + 3, None)), rng.choice(roles), rng.choice(texts) if rng.random() < 0.5 else f"t{rng.random()}."))
                if rng.random() < 0.1:
                    rows.append(rows[-1])
    return rows


def as_files(spark, tmp_path, rows):
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    df.selectExpr("*", "1 AS place", "role AS conv", "turn AS at").write.parquet(str(tmp_path / "conversations.parquet"))
    return str(tmp_path)


@pytest.mark.parametrize("segment", [2048, 2])
def test_query(spark, tmp_path, monkeypatch, segment):
    rows = odd_table(4, 120)
    folder = as_files(spark, tmp_path, rows)
    monkeypatch.setattr(D, "repair_conversations", functools.partial(D.repair_conversations, segment=segment))
    got = {r["conv_id"]: tuple(r[c] for c in COLUMNS) for r in queries.op12_conversation_repair(spark, folder).collect()}
    want = plain(rows)
    assert got.keys() == want.keys()
    for conv in want:
        assert got[conv] == want[conv], (conv, [r for r in rows if r[0] == conv])


def test_one_conversation_in_many_segments(spark, tmp_path, monkeypatch):
    rng = random.Random(9)
    rows = [(5, i, rng.choice(("user", "assistant")) if rng.random() < 0.3 else ("user", "assistant")[i % 2], f"t{i % 170}.") for i in range(220)]
    rows += [(i + 10, 0, "user", "Hi.") for i in range(30)]
    folder = as_files(spark, tmp_path, rows)
    monkeypatch.setattr(D, "repair_conversations", functools.partial(D.repair_conversations, segment=16))
    got = {r["conv_id"]: tuple(r[c] for c in COLUMNS) for r in queries.op12_conversation_repair(spark, folder).collect()}
    assert got == plain(rows)


def test_empty(spark, tmp_path):
    assert queries.op12_conversation_repair(spark, as_files(spark, tmp_path, [])).collect() == []


def test_op12(spark, sf_dir):
    table = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = {r["conv_id"]: tuple(r[c] for c in COLUMNS) for r in queries.op12_conversation_repair(spark, sf_dir).collect()}
    assert got == plain(table)
