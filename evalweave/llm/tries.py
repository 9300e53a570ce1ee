"""Exact duplicates by compressed radix (Patricia) tries of whole byte strings.

Texts are dealt by length and content hash, so equal texts meet in one part. A task inserts whole byte strings into the trie
of a part; an edge holds all bytes that the texts below share, so a text is compared byte by byte and equality is never left to a
hash. The node where a text ends keeps its owner, the smallest identifier. What exceeds the memory of a trie leaves it by subtree
and meets again, one subtree a part, in the next round.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalweave.llm.common import claim, small_batches, stored

BLANKS = b" \t\n\x0b\x0c\r"

# Bytes of text and nodes that one trie may hold before a subtree leaves, and what a node counts besides its bytes.
BUDGET = 96 << 20
NODE = 400
# Bytes (with NODE for each text) that go to one part, and parts that a task works on, one after the other.
PART_BYTES = 32 << 20
PARTS_PER_TASK = 8
# Bytes of text that a scan task gathers before it hands on the different ones.
GATHERED = 16 << 20
# Entries of one length and hash that go to one part; more are dealt over several parts and meet again.
FAN_IN = 2048
# Parts up to which a table of hot lengths and hashes is broadcast: 24 bytes a row.
BROADCAST_KEYS = 500_000


class Node:
    """``edge``: the bytes between the parent and here; ``owner``: the smallest identifier that ends here; ``left``: the number
    of the subtree that began or lay here and has left the trie."""

    __slots__ = ("edge", "children", "owner", "left")

    def __init__(self, edge: bytes, owner=None):
        self.edge, self.owner, self.left = edge, owner, 0
        self.children: dict[int, Node] = {}


def shared_prefix(a: bytes, b: bytes) -> int:
    """Length of the common beginning: the range in which the first difference lies is halved."""
    low, high = 0, min(len(a), len(b))
    while low < high:
        middle = (low + high + 1) // 2
        if a[low:middle] == b[low:middle]:
            low = middle
        else:
            high = middle - 1
    return low


class Trie:
    """Byte strings with their smallest identifiers; subtrees leave when the weight exceeds a budget."""

    def __init__(self, budget: int = BUDGET):
        self.root, self.weight, self.budget, self.departed = Node(b""), 0, budget, 0

    def insert(self, text: bytes, owner) -> Node:
        """The node where ``text`` ends, with the smaller of its owner and this one; or a node whose subtree has left."""
        node, at = self.root, 0
        while at < len(text):
            child = node.children.get(text[at])
            if child is None:
                node.children[text[at]] = node = Node(text[at:], owner)
                self._grow(NODE + len(node.edge))
                return node
            if text.startswith(child.edge, at):
                node, at = child, at + len(child.edge)
                if node.left:
                    return node
                continue
            cut = shared_prefix(child.edge, text[at : at + len(child.edge)])
            above = Node(child.edge[:cut])
            child.edge = child.edge[cut:]
            above.children[child.edge[0]] = child
            node.children[text[at]] = node = above
            at += cut
            self._grow(NODE)
        if node.owner is None or owner < node.owner:
            node.owner = owner
        return node

    def _grow(self, weight: int) -> None:
        self.weight += weight
        if self.weight > self.budget:
            self._shed()

    def _shed(self) -> None:
        """The heaviest subtree below the first fork leaves. Its first byte stays as a stub that marks what belongs to it."""
        node = self.root
        while len(node.children) == 1 and node.owner is None:
            node = next(iter(node.children.values()))
        inner = {byte: below(child) for byte, child in node.children.items() if not child.left}
        if not inner or (len(node.children) == 1 and node.owner is None):
            return  # a single text: it fits as a whole or not at all
        byte = max(inner, key=lambda b: (sum(NODE + len(n.edge) for n in inner[b]), -b))
        self.departed += 1
        for n in inner[byte]:
            self.weight -= NODE + len(n.edge)
            n.edge, n.children, n.owner, n.left = b"", {}, None, self.departed
        stub = node.children[byte] = Node(bytes([byte]))
        stub.left = self.departed
        self.weight += NODE


def below(node: Node) -> list[Node]:
    found, at = [node], 0
    while at < len(found):
        found += found[at].children.values()
        at += 1
    return found


def _entries(kind: pa.DataType, limit: int):
    """Rows (row, text, order) -> (body, order, n, best, members): the different bodies of a stretch of rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim()
        held: list[pa.Array] = []
        trie, ends, orders, size, rows = Trie(1 << 62), [], [], 0, 0
        bodies: dict[int, bytes] = {}

        def close():
            numbers = {}
            of = np.array([numbers.setdefault(id(n), len(numbers)) for n in ends], np.int64)
            by = np.argsort(of, kind="stable")
            starts = np.searchsorted(of[by], np.arange(len(numbers) + 1))
            owners = [n for n in dict.fromkeys(ends)]
            members = pa.concat_arrays(held).take(pa.array(by))
            best = [n.owner[1] for n in owners]
            place = np.empty(len(by), np.int64)
            place[by] = np.arange(len(by))
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([bodies[id(n)] for n in owners], pa.binary()),
                    pa.array([n.owner[0] for n in owners], pa.list_(pa.int64())),
                    pa.array(np.diff(starts)),
                    pa.array(place[best] - starts[:-1], pa.int32()),
                    pa.ListArray.from_arrays(pa.array(starts, pa.int32()), members),
                ],
                names=["body", "order", "n", "best", "members"],
            )

        for batch in batches:
            texts, order = batch.column(1), batch.column(2).to_pylist()
            start = 0
            for i in range(batch.num_rows):
                raw = texts[i].as_py()
                body = (raw or "").encode().translate(None, BLANKS)
                node = trie.insert(body, (order[i], rows))
                bodies.setdefault(id(node), body)
                ends.append(node)
                rows += 1
                size += len(body) + NODE
                if size > limit:
                    held.append(batch.column(0).slice(start, i + 1 - start))
                    yield close()
                    held.clear()
                    trie, ends, bodies, size, rows, start = Trie(1 << 62), [], {}, 0, 0, i + 1
            if start < batch.num_rows:
                held.append(batch.column(0).slice(start))
        if ends:
            yield close()

    return run


def _round(budget: int):
    """Rows (part, entry, order, body), sorted by part -> (entry, root, part): the entry of the smallest identifier of equal
    bodies; or no root, and the part of the next round that the subtree of the row has left for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim()
        part, trie, ends, entries = None, None, [], []

        def close():
            for at in range(0, len(ends), 65_536):
                nodes = ends[at : at + 65_536]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(entries[at : at + 65_536], pa.int64()),
                        pa.array([None if n.left else n.owner[1] for n in nodes], pa.int64()),
                        # Two subtrees that get one number share a part: a matter of memory only.
                        pa.array([hash((part, n.left)) >> 1 if n.left else None for n in nodes], pa.int64()),
                    ],
                    names=["entry", "root", "part"],
                )

        for batch in batches:
            parts, own = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            order, bodies = batch.column(2).to_pylist(), batch.column(3)
            for i in range(batch.num_rows):
                if parts[i] != part or trie is None:
                    yield from close()
                    part, trie, ends, entries = parts[i], Trie(budget), [], []
                ends.append(trie.insert(bodies[i].as_py(), (order[i], own[i])))
                entries.append(own[i])
        yield from close()

    return run


def _roots(entries: DataFrame, budget: int, fan_in: int, part_bytes: int) -> DataFrame:
    """(entry, root) for entries (entry, order, body, length, hash)."""
    keys = ["length", "hash"]
    total = entries.agg(F.sum(F.col("length").cast("bigint") + NODE)).first()[0] or 0
    parts = max(1, -(-total // part_bytes))
    hot = stored(entries.groupBy(*keys).agg(F.count(F.lit(1)).alias("copies")).where(F.col("copies") > fan_in), "hot_keys")
    n_hot = hot.count()
    dealt = entries
    salt = F.lit(0)
    if n_hot:
        dealt = entries.join(F.broadcast(hot) if n_hot <= BROADCAST_KEYS else hot, keys, "left")
        salt = F.pmod(F.xxhash64("entry"), F.coalesce(F.ceil(F.col("copies") / fan_in), F.lit(1)))
    tasks = max(int(entries.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-parts // PARTS_PER_TASK))
    waiting = dealt.select(F.pmod(F.xxhash64(*keys, salt), F.lit(parts)).alias("part"), "entry", "order", "body")
    answers = None
    while True:
        found = stored(
            waiting.repartition(tasks, "part").sortWithinPartitions("part").mapInArrow(_round(budget), "entry bigint, root bigint, part bigint"),
            "owners",
        )
        done = found.where("root IS NOT NULL").select("entry", "root")
        answers = done if answers is None else answers.unionByName(done)
        late = found.where("root IS NULL").select("part", "entry")
        if late.isEmpty():
            break
        waiting = late.join(entries.select("entry", "order", "body"), "entry").select("part", "entry", "order", "body")
    if not n_hot:
        return answers
    # Copies of a hot text have one root for each part they were dealt to; the roots meet in another round.
    first = entries.join(F.broadcast(hot) if n_hot <= BROADCAST_KEYS else hot, keys, "left_semi").join(
        answers.select(F.col("root").alias("entry")).distinct(), "entry", "left_semi"
    )
    again = _roots(stored(first, "again"), budget, 2 * fan_in, part_bytes).select(F.col("entry").alias("root"), F.col("root").alias("last"))
    return answers.join(again, "root", "left").select("entry", F.coalesce("last", "root").alias("root"))


def exact_duplicates(
    df: DataFrame, text: str, prefer: list[Column], budget: int = BUDGET, fan_in: int = FAN_IN, part_bytes: int = PART_BYTES, gathered: int = GATHERED
) -> DataFrame:
    """Per row of ``df``: ``row`` (the other columns as a struct, so no names clash), ``owner`` (that of the row that stays),
    ``group_size``, ``kept`` (true for exactly one row of a group) and ``text_sha256`` (lowercase hex of the normalised text).

    Texts are equal if they are identical without the six ASCII blanks; null is the empty text. Of equal texts the row with the
    smallest values of ``prefer`` (integer columns, nulls last) stays, among ties the first read.

    A scan task hands on each different text of a stretch of rows once, with the rows that have it, so a text in a third of all
    rows hardly travels. If it still comes from more than ``fan_in`` stretches, they are dealt over several parts and their
    owners meet in a further round. Every round is written to the shared folder. An empty table gives an empty result.
    """
    small_batches(df.sparkSession)
    keep = df.drop(text) if len(df.columns) > 1 else df
    order = F.array(*[x for c in prefer for x in (F.isnull(c).cast("bigint"), F.coalesce(c.cast("bigint"), F.lit(0)))])
    slim = df.select(F.struct(*[df[c] for c in keep.columns]).alias("row"), F.col(text).alias("_text"), order.alias("order"))
    kind = slim.schema["row"].dataType
    gathered_rows = slim.mapInArrow(
        _entries(kind, gathered), f"body binary, order array<bigint>, n bigint, best int, members array<{kind.simpleString()}>"
    )
    entries = stored(gathered_rows.withColumn("entry", F.monotonically_increasing_id()), "entries")
    bodies = entries.select("entry", "order", "body", F.octet_length("body").alias("length"), F.xxhash64("body").alias("hash"))
    roots = stored(_roots(bodies, budget, fan_in, part_bytes), "roots")
    sizes = roots.join(entries.select("entry", "n"), "entry").groupBy("root").agg(F.sum("n").alias("group_size"))
    owners = entries.select(F.col("entry").alias("root"), F.element_at("members", F.col("best") + 1).alias("owner"))
    named = roots.join(sizes.join(owners, "root"), "root")
    return (
        entries.select("entry", "best", F.sha2("body", 256).alias("text_sha256"), F.posexplode("members").alias("place", "row"))
        .join(named, "entry")
        .select("row", "owner", "group_size", ((F.col("entry") == F.col("root")) & (F.col("place") == F.col("best"))).alias("kept"), "text_sha256")
    )
