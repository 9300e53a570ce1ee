"""Repair of conversations: turns are aligned to the roles a conversation may have, system? (user assistant)+ or nothing at all.

The target strings of all lengths end alike, so one Wagner-Fischer matrix of turns against the alternating string, read from
its end, holds the alignment to every length. Cells that cost more than the incumbent, the cost of a plain greedy repair,
are left out on both sides of the diagonal (Ukkonen's band). The edits of each length that costs least are traced back, and the
audits, one letter an edit, compared.

A conversation is cut into segments of bounded length. Between segments only the cost of getting from one grammar state
to another matters, so long conversations are aligned in many tasks and the segments joined by two streaming scans.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from evalweave.llm.common import claim, small_batches, stored, worker_cache

# Turns that are aligned together.
SEGMENT = 2048
# Conversations whose result a worker remembers by the kinds of their turns.
REMEMBERED = 100_000
# Bytes of text that a task hands on together.
HANDED = 2 << 20

BLANK = r" \t\n\x0B\f\r"

# Costs of edits.
REROLE, DELETE, INSERT, CUT = 1, 2, 5, 5

# Kinds of turns: initial of the role (s, u, a or another) times 3, plus whether it must go (1) or ends too early (2).
S, U, A, OTHER = range(4)
MUST_GO, TOO_SHORT = 1, 2

# Kinds travel as letters from A on.
_LETTER = ord("A")
_KINDS = bytes(max(0, c - _LETTER) for c in range(256))

# Grammar states: nothing yet, after system, after user, after assistant. The first and the last may end a conversation.
START, AFTER_S, AFTER_U, AFTER_A = range(4)
INF = 1 << 40
NEXT = {START: U, AFTER_S: U, AFTER_U: A, AFTER_A: U}
ROLE = {U: "user", A: "assistant"}
LEGAL = {(S, U), (U, A), (A, U)}


def kinds_of(letters: str) -> bytes:
    return letters.encode().translate(_KINDS)


def place_cost(kind: int, role: int) -> int:
    """Of letting a turn stand as ``role``, under a new role if need be."""
    initial, fault = divmod(kind, 3)
    if fault == MUST_GO or (role == S and initial != S):
        return INF
    return (initial != role) * REROLE + (fault == TOO_SHORT) * CUT


def greedy(kinds: bytes, state: int) -> int:
    """Cost of a repair that lets each turn stand where that costs no more than to delete it: the first incumbent."""
    total = 0
    for kind in kinds:
        role = S if state == START and kind // 3 == S else NEXT[state]
        stands = place_cost(kind, role)
        if stands <= DELETE:
            total, state = total + stands, {S: AFTER_S, U: AFTER_U, A: AFTER_A}[role]
        else:
            total += DELETE
    return total + {START: 0, AFTER_S: 2 * INSERT, AFTER_U: INSERT, AFTER_A: 0}[state]


class Matrix:
    """Least costs of aligning the turns from i on to the last m characters of the alternating string that ends in ``role``.

    ``rows[i]`` holds m from ``lows[i]`` on. Inside the band the costs up to ``limit`` are exact. Characters are inserted before
    turns, behind the last one only if ``last``.
    """

    def __init__(self, kinds: bytes, role: int, last: bool, limit: int):
        self.kinds, self.role, self.last = kinds, role, last
        n, fewer, more = len(kinds), limit // DELETE, limit // INSERT
        self.lows = [max(0, n - i - fewer) for i in range(n + 1)]
        row = np.arange(more + 1) * INSERT if last else np.r_[0, np.full(more, INF)]
        self.rows = [row]
        for i in range(n - 1, -1, -1):
            low = self.lows[i]
            diagonal = row if low else np.r_[INF, row]
            down = np.r_[row[1:], INF] if low else np.r_[row, INF]
            m = np.arange(low, low + len(diagonal))
            costs = np.array([place_cost(kinds[i], self.character(0)), place_cost(kinds[i], self.character(1))])
            row = np.minimum(DELETE + down, costs[m % 2] + diagonal)
            row = np.minimum(np.minimum.accumulate(row - m * INSERT) + m * INSERT, INF)
            self.rows.append(row)
        self.rows.reverse()

    def character(self, m: int) -> int:
        """The m-th character from the end."""
        return self.role if m % 2 else (U + A - self.role)

    def at(self, i: int, m: int) -> int:
        k = m - self.lows[i]
        return int(self.rows[i][k]) if 0 <= k < len(self.rows[i]) else INF

    def lengths(self, i: int, first: int) -> tuple[np.ndarray, np.ndarray]:
        """(costs, lengths m) of the strings in the band that begin with ``first``, other than the empty one."""
        m = np.arange(self.lows[i], self.lows[i] + len(self.rows[i]))
        good = (m > 0) & (m % 2 == (1 if self.role == first else 0))
        return self.rows[i][good], m[good]

    def trace(self, i: int, m: int) -> str:
        """The ASCII-least audit of aligning the turns from i on to the last m characters at the least cost."""
        letters, n = [], len(self.kinds)
        while i < n or m:
            here = self.at(i, m)
            if i < n and DELETE + self.at(i + 1, m) == here:
                letters.append("D")
                i += 1
            elif m and (i < n or self.last) and INSERT + self.at(i, m - 1) == here:
                letters.append("I")
                m -= 1
            else:
                letters.append("K" if self.kinds[i] // 3 == self.character(m) else "R")
                i, m = i + 1, m - 1
        return "".join(letters)


class Segment:
    """Alignments of one run of turns from a grammar state to another."""

    def __init__(self, kinds: bytes, last: bool, limit: int):
        self.kinds, self.last, self.n = kinds, last, len(kinds)
        self.ends = {AFTER_A: Matrix(kinds, A, last, limit)}
        if not last:
            self.ends[AFTER_U] = Matrix(kinds, U, last, limit)
        # Beyond the band's limit no system turn is worth the turns deleted before it.
        self.systems = [p for p, k in enumerate(kinds[: limit // DELETE + 1]) if place_cost(k, S) < INF]

    def least(self, entry: int, exit_: int) -> tuple[int, list[tuple[int, int, int]]]:
        """(cost, alignments of that cost); an alignment: turns deleted at the start, 1 if then one stands as system, length."""
        found, none = [], np.zeros(1, np.int64)  # (costs, lengths, turns deleted, stands as system)
        if entry == exit_:
            found.append((none + self.n * DELETE, none, self.n, 0))
        if entry == START and exit_ == AFTER_S and not self.last:
            found += [(none + (self.n - 1) * DELETE + place_cost(self.kinds[p], S), none, p, 1) for p in self.systems]
        if exit_ in self.ends:
            matrix = self.ends[exit_]
            found.append((*matrix.lengths(0, NEXT[entry]), 0, 0))
            if entry == START:
                for p in self.systems:
                    costs, m = matrix.lengths(p + 1, U)
                    found.append((costs + p * DELETE + place_cost(self.kinds[p], S), m, p, 1))
        cost = min((int(f[0].min()) for f in found if len(f[0])), default=INF)
        return cost, [(p, system, m) for costs, lengths, p, system in found for m in lengths[costs == cost].tolist() if cost < INF]

    def audit(self, exit_: int, deleted: int, system: int, m: int) -> str:
        begin = "D" * deleted + "K" * system
        if m == 0:
            return begin + "D" * (self.n - len(begin))
        return begin + self.ends[exit_].trace(len(begin), m)

    def best(self, entry: int, onward: list[int]) -> tuple[int, str, int]:
        """(cost in the segment, audit, state behind) of the ASCII-least of the cheapest ways on, given the costs behind."""
        found = {x: self.least(entry, x) for x in range(4) if onward[x] < INF}
        total = min((cost + onward[x] for x, (cost, _) in found.items()), default=INF)
        ways = [(self.audit(x, *a), cost, x) for x, (cost, many) in found.items() if cost + onward[x] == total < INF for a in many]
        if not ways:
            return INF, "", entry
        audit, cost, exit_ = min(ways)
        return cost, audit, exit_


ENDS = [0, INF, INF, 0]  # costs behind the last segment, by state


def align(kinds: bytes, entry: int, last: bool, onward: list[int]) -> tuple[int, str, int]:
    """(cost, audit, state behind). The band widens until what it left out cannot cost less than what it holds."""
    most = DELETE * len(kinds) + 3 * INSERT
    limit = min(greedy(kinds, entry), most)
    while True:
        cost, audit, exit_ = Segment(kinds, last, limit).best(entry, onward)
        needed = cost + onward[exit_] - min(onward) if cost < INF else 2 * limit + 8
        if needed <= limit or limit >= most:
            return cost, audit, exit_
        limit = min(most, needed)


def transitions(kinds: bytes, last: bool) -> list[int]:
    """Least costs from each state to each, as 16 numbers."""
    most = DELETE * len(kinds) + 3 * INSERT
    limit = min(max(greedy(kinds, e) for e in range(4)), most)
    while True:
        segment = Segment(kinds, last, limit)
        costs = [segment.least(e, x)[0] for e in range(4) for x in range(4)]
        if limit >= most or all(c <= limit for e in range(4) for x, c in zip(range(4), costs[4 * e :]) if x in segment.ends):
            return costs
        limit = min(most, 2 * limit + 8)


def whole(kinds: bytes) -> tuple[int, str]:
    cost, audit, _ = align(kinds, START, True, ENDS)
    return cost, audit


# ---- tasks -------------------------------------------------------------------------------------------------


def _whole_segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(conv, seg, kinds) of conversations of one segment -> (conv, seg, entry, cost, audit)."""
    claim()
    kept = worker_cache("dialogues")
    for batch in batches:
        out = []
        for kinds in batch.column(2).to_pylist():
            if kinds not in kept:
                if len(kept) > REMEMBERED:
                    kept.clear()
                kept[kinds] = whole(kinds_of(kinds))
            out.append(kept[kinds])
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array([START] * len(out), pa.int32()), pa.array([c for c, _ in out], pa.int64()), pa.array([a for _, a in out], pa.string())],
            names=["conv", "seg", "entry", "cost", "audit"],
        )


def _segment_costs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(conv, seg, kinds, last) -> with the costs between states."""
    claim()
    for batch in batches:
        costs = [transitions(kinds_of(k), last) for k, last in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(costs, pa.list_(pa.int64()))], names=["conv", "seg", "kinds", "last", "costs"])


def _costs_behind(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Segments of a conversation from the last to the first -> with the least costs behind each, by state."""
    onward = ENDS
    for batch in batches:
        out = []
        for last, costs in zip(batch.column(3).to_pylist(), batch.column(4).to_pylist()):
            if last:
                onward = ENDS
            out.append(onward)
            onward = [min(INF, *(costs[4 * e + x] + onward[x] for x in range(4))) for e in range(4)]
        yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(out, pa.list_(pa.int64()))], names=["conv", "seg", "kinds", "last", "onward"])


def _ways(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per segment the best way from each state."""
    claim()
    for batch in batches:
        out = [
            [dict(zip(("cost", "audit", "exit"), align(kinds_of(k), e, last, onward))) for e in range(4)]
            for k, last, onward in zip(*(batch.column(i).to_pylist() for i in (2, 3, 4)))
        ]
        kind = pa.list_(pa.struct([("cost", pa.int64()), ("audit", pa.string()), ("exit", pa.int32())]))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, kind)], names=["conv", "seg", "ways"])


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Segments of a conversation in order -> the way taken through each."""
    conv, state = object(), START
    for batch in batches:
        out = []
        for key, ways in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
            if key != conv:
                conv, state = key, START
            out.append((state, ways[state]["cost"], ways[state]["audit"]))
            state = ways[state]["exit"]
        columns = [pa.array(c, t) for c, t in zip(zip(*out) if out else ([], [], []), (pa.int32(), pa.int64(), pa.string()))]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], names=["conv", "seg", "entry", "cost", "audit"])


def edits_of(kinds: bytes, audit: str, entry: int) -> list[tuple[int, list[str], str, str | None, list[str]]]:
    """Per turn that stands or has inserted ones before it: its index, roles inserted before, K or R or nothing, its new role, and
    roles inserted behind."""
    out, i, state, before = [], 0, entry, []
    for letter in audit:
        if letter == "I":
            before.append(ROLE[NEXT[state]])
            state = AFTER_U if NEXT[state] == U else AFTER_A
            continue
        if letter == "D":
            if before:
                out.append((i, before, "", None, []))
        else:
            role = S if letter == "K" and kinds[i] // 3 == S else NEXT[state]
            out.append((i, before, letter, None if letter == "K" else ROLE[role], []))
            state = {S: AFTER_S, U: AFTER_U, A: AFTER_A}[role]
        if letter != "D" or before:
            before = []
        i += 1
    if before and out and out[-1][0] == i - 1:
        out[-1][4].extend(before)
    elif before:
        out.append((i - 1, before, "", None, []))
    return out


def _edits(turn: str) -> tuple:
    """(conv, seg, kinds, items, entry, audit) -> one row per edit, with the key of its turn."""
    names = ["conv", "turn", "role", "digest", "at", "before", "op", "new_role", "behind"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim()
        for batch in batches:
            rows = []
            columns = [batch.column(i).to_pylist() for i in (2, 4, 5)]
            for r, (kinds, entry, audit) in enumerate(zip(*columns)):
                found = edits_of(kinds_of(kinds), audit, entry)
                items = batch.column(3)[r].as_py() if found else []
                rows += [(r, items[i], *rest) for i, *rest in found]
            at = pa.array([r for r, *_ in rows], pa.int64())
            item = [x[1] for x in rows]
            texts = pa.list_(pa.string())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(at),
                    pa.array([x["turn"] for x in item], batch.column(3).type.value_type.field("turn").type),
                    pa.array([x["role"] for x in item], pa.string()),
                    pa.array([x["digest"] for x in item], pa.binary()),
                    pa.array([x["at"] for x in item], pa.int64()),
                    pa.array([x[2] for x in rows], texts),
                    pa.array([x[3] for x in rows], pa.string()),
                    pa.array([x[4] for x in rows], pa.string()),
                    pa.array([x[5] for x in rows], texts),
                ],
                names=names,
            )

    return run, f"turn {turn}, role string, digest binary, at bigint, before array<string>, op string, new_role string, behind array<string>"


def _repaired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edits and texts of conversations, in order, edits before the text of their turn -> turns of the repaired conversations."""
    claim()
    conv, key, place = object(), None, 0
    held: list[tuple] = []
    text = None
    convs, roles, texts, places, size = [], [], [], [], 0

    def emit(role, content):
        nonlocal place, size
        convs.append(conv)
        roles.append(role)
        texts.append(content)
        places.append(place)
        place += 1
        size += len(content) + 64

    def close():
        for before, op, role, behind in held:
            for r in before:
                emit(r, "")
            if op:
                emit(role, text)
            for r in behind:
                emit(r, "")
        held.clear()

    kind = None
    for batch in batches:
        kind = batch.column(0).type
        names, turns, own, digests, sides = (batch.column(i).to_pylist() for i in range(5))
        for i, now in enumerate(zip(names, turns, own, digests)):
            if now != key:
                close()
                text = None
                if key is None or now[0] != conv:
                    conv, place = now[0], 0
                key = now
            if sides[i] == 0:
                op = batch.column(7)[i].as_py()
                held.append((batch.column(6)[i].as_py(), op, own[i] if op == "K" else batch.column(8)[i].as_py(), batch.column(9)[i].as_py()))
            elif held and text is None:
                text = batch.column(10)[i].as_py()
            if size > HANDED:
                yield _turns(kind, convs, places, roles, texts)
                for x in (convs, roles, texts, places):
                    x.clear()
                size = 0
    close()
    if convs:
        yield _turns(kind, convs, places, roles, texts)


def _turns(kind, convs, places, roles, texts) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(convs, kind), pa.array(places, pa.int64()), pa.array(roles, pa.string()), pa.array(texts, pa.string())],
        names=["conv", "place", "role", "text"],
    )


# ---- operator ----------------------------------------------------------------------------------------------


def _kind(role: Column, must_go: Column, too_short: Column) -> Column:
    """The kind of a turn as a character."""
    initial = F.substring(role, 1, 1)
    code = F.when(initial == "s", S).when(initial == "u", U).when(initial == "a", A).otherwise(OTHER) * 3
    return F.char(_LETTER + code + F.when(must_go, MUST_GO).when(too_short, TOO_SHORT).otherwise(0))


def repair_conversations(
    df: DataFrame, conv: str, turn: str, role: str, text: str, segment: int = SEGMENT
) -> tuple[DataFrame, DataFrame]:
    """Repair conversations at the least cost. Returns (conversations, turns).

    conversations, one row per conversation: conv, gaps (turn numbers missing between the smallest and the largest), blank,
    duplicate and truncated turns (the first that holds: no character but blanks; role and text seen before; the last such
    character is not one of ``.!?``), illegal (neighbours other than system-user, user-assistant, assistant-user, by initials), cost
    and audit (D, I, K, R in order: delete 2, insert an empty turn 5, keep 0, give a new role 1, a truncated turn that stays 5
    more; blank and duplicate turns must go). Of the cheapest repairs the ASCII-least audit is taken.

    turns: conv, place (from 0), role, text of the repaired conversations, in this order inside a partition; conversations that are
    empty after repair have none.

    Turns are ordered by ``turn`` (null first), then role, then a hash of the text; rows may repeat (the later ones are duplicates).
    Null roles and texts count as one space; a null ``conv`` is a conversation of its own. Other columns are left out. Empty
    tables give empty results.

    What is shuffled for the alignment is a hash and a few bytes a turn; texts travel once, to be put together by
    conversation. A conversation may hold any share of all turns: order, duplicates and alignment are dealt out by segments.
    """
    small_batches(df.sparkSession)
    none = F.lit(" ")
    base = df.select(F.col(conv).alias("conv"), F.col(turn).alias("turn"), F.coalesce(role, none).alias("role"), F.coalesce(text, none).alias("text"))
    base = base.withColumn("digest", F.unhex(F.sha2("text", 256)))
    end = F.right(F.regexp_replace("text", f"[{BLANK}]+$", ""), F.lit(1))
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = ["conv", "turn", "role", "digest"]
    # Where a range begins is sampled, so the order is written before it is read twice.
    ordered = stored(
        base.select(*order, (end == "").alias("blank"), (~end.isin(".", "!", "?")).alias("short"))
        .repartitionByRange(parts, *order)
        .sortWithinPartitions(*order)
        .withColumn("at", F.monotonically_increasing_id()),
        "turns",
    )
    seen = ordered.where("NOT blank").groupBy("conv", "role", "digest").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    seen = seen.select(F.col("conv").alias("c"), F.col("role").alias("r"), F.col("digest").alias("d"), "first")
    same = ordered["conv"].eqNullSafe(seen["c"]) & (ordered["role"] == seen["r"]) & (ordered["digest"] == seen["d"])
    again = ~F.col("blank") & F.coalesce(F.col("at") > F.col("first"), F.lit(False))
    flagged = ordered.join(seen, same, "left").select(*order, "at", "blank", again.alias("again"), (~F.col("blank") & ~again & F.col("short")).alias("cut"))
    items = F.sort_array(F.collect_list(F.struct("at", "turn", "role", "digest", _kind(F.col("role"), F.col("blank") | F.col("again"), F.col("cut")).alias("kind"))))

    def number(name: str) -> Column:
        return F.sum(F.col(name).cast("bigint")).alias(name)

    segments = stored(
        flagged.groupBy("conv", F.expr(f"at DIV {segment}").alias("seg"))
        .agg(items.alias("items"), number("blank"), number("again"), number("cut"))
        .withColumn("kinds", F.array_join(F.transform("items", lambda x: x["kind"]), "")),
        "segments",
    )
    kind = df.schema[conv].dataType.simpleString()
    aligned = stored(_aligned(segments, kind), "aligned")
    return _conversations(ordered, segments, aligned), _repaired_turns(base, segments, aligned, kind, df.schema[turn].dataType.simpleString())


def _aligned(segments: DataFrame, kind: str) -> DataFrame:
    """(conv, seg, entry, cost, audit)."""
    slim = segments.select("conv", "seg", "kinds")
    many = segments.groupBy("conv").agg(F.count(F.lit(1)).alias("n"), F.max("seg").alias("final")).where("n > 1").select(F.col("conv").alias("c"), "final")
    result = f"conv {kind}, seg bigint, entry int, cost bigint, audit string"
    same = slim["conv"].eqNullSafe(many["c"])
    out = slim.join(many, same, "left_anti").mapInArrow(_whole_segments, result)
    long = stored(slim.join(many, same).select("conv", "seg", "kinds", (F.col("seg") == F.col("final")).alias("last")), "long")
    if long.isEmpty():
        return out
    head = f"conv {kind}, seg bigint, kinds string, last boolean"
    # The scans read one short row per segment in order, and keep four numbers.
    costs = stored(long.mapInArrow(_segment_costs, f"{head}, costs array<bigint>"), "costs")
    behind = costs.repartition("conv").sortWithinPartitions("conv", F.desc("seg")).mapInArrow(_costs_behind, f"{head}, onward array<bigint>")
    ways = stored(behind.repartition("conv", "seg").mapInArrow(_ways, f"conv {kind}, seg bigint, ways array<struct<cost:bigint,audit:string,exit:int>>"), "ways")
    walked = ways.repartition("conv").sortWithinPartitions("conv", "seg").mapInArrow(_walk, result)
    return out.unionByName(walked)


def _conversations(ordered: DataFrame, segments: DataFrame, aligned: DataFrame) -> DataFrame:
    turns = ordered.where("turn IS NOT NULL").select("conv", "turn").distinct()
    gaps = turns.groupBy("conv").agg((F.max("turn") - F.min("turn") + 1 - F.count(F.lit(1))).cast("bigint").alias("gaps"))

    def initial(end: int) -> Column:
        return F.floor((F.ascii(F.substring("kinds", end, 1)) - _LETTER) / 3).cast("int")

    def pair(a: Column, b: Column) -> Column:
        return F.array_contains(F.array(*[F.lit(4 * x + y) for x, y in sorted(LEGAL)]), (4 * a + b).cast("int"))

    codes = F.transform("items", lambda x: F.floor((F.ascii(x["kind"]) - _LETTER) / 3).cast("int"))
    inner = F.size(F.filter(F.zip_with(F.slice("codes", 1, F.size("codes") - 1), F.slice("codes", 2, F.size("codes")), lambda a, b: ~pair(a, b)), lambda x: x))
    before = F.lag("final").over(Window.partitionBy("conv").orderBy("seg"))  # one row per segment
    bounds = (
        segments.withColumn("codes", codes)
        .select("conv", "seg", "blank", "again", "cut", F.when(F.size("codes") > 1, inner).otherwise(0).alias("inner"), initial(1).alias("head"), initial(-1).alias("final"))
        .withColumn("across", F.when(before.isNotNull() & ~pair(before, F.col("head")), 1).otherwise(0))
    )
    faults = bounds.groupBy("conv").agg(
        F.sum("blank").alias("blank"), F.sum("again").alias("duplicate"), F.sum("cut").alias("truncated"), F.sum(F.col("inner") + F.col("across")).alias("illegal")
    )
    audits = aligned.groupBy("conv").agg(
        F.sum("cost").alias("cost"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("seg", "audit"))), lambda x: x["audit"]), "").alias("audit")
    )
    faults, audits, gaps = (x.withColumnRenamed("conv", f"c{i}") for i, x in enumerate((faults, audits, gaps)))
    return (
        faults.join(audits, F.col("c0").eqNullSafe(F.col("c1")))
        .join(gaps, F.col("c0").eqNullSafe(F.col("c2")), "left")
        .select(F.col("c0").alias("conv"), F.coalesce("gaps", F.lit(0)).cast("bigint").alias("gaps"), "blank", "duplicate", "truncated", "illegal", "cost", "audit")
    )


def _repaired_turns(base: DataFrame, segments: DataFrame, aligned: DataFrame, kind: str, turn: str) -> DataFrame:
    run, rest = _edits(turn)
    a = aligned.select(F.col("conv").alias("c"), F.col("seg").alias("s"), "entry", "audit")
    both = segments.join(a, segments["conv"].eqNullSafe(a["c"]) & (segments["seg"] == a["s"])).select("conv", "seg", "kinds", "items", "entry", "audit")
    edits = both.mapInArrow(run, f"conv {kind}, {rest}").withColumn("side", F.lit(0)).withColumn("text", F.lit(None).cast("string"))
    texts = base.withColumn("side", F.lit(1))
    columns = ["conv", "turn", "role", "digest", "side", "at", "before", "op", "new_role", "behind", "text"]
    rows = edits.unionByName(texts, allowMissingColumns=True).select(columns)
    merged = rows.repartition("conv").sortWithinPartitions("conv", "turn", "role", "digest", "side", "at")
    return merged.mapInArrow(_repaired, f"conv {kind}, place bigint, role string, text string")


def digests(turns: DataFrame, conv: str) -> DataFrame:
    """(conv, sha256) of ``role:text`` of the turns, joined by newlines, one turn after the other in the order in which
    ``repair_conversations`` gives them (so the turns must come straight from there)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim()
        now, state, kind = None, None, None
        done: list[tuple] = []

        def handed():
            out = pa.RecordBatch.from_arrays([pa.array([c for c, _ in done], kind), pa.array([d for _, d in done], pa.string())], names=[conv, "sha256"])
            done.clear()
            return out

        for batch in batches:
            kind = batch.column(0).type
            for name, place, role, text in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if place == 0:
                    if state:
                        done.append((now, state.hexdigest()))
                    now, state = name, hashlib.sha256()
                else:
                    state.update(b"\n")
                state.update(f"{role}:{text}".encode())
            if len(done) > 10_000:
                yield handed()
        if state:
            done.append((now, state.hexdigest()))
            yield handed()

    kind = turns.schema[conv].dataType.simpleString()
    return turns.select(conv, "place", "role", "text").mapInArrow(run, f"`{conv}` {kind}, sha256 string")
