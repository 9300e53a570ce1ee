"""SimHash near-duplicates with covering locality-sensitive hashing.

Fingerprints of 64 bits are compared under 2^(r+1) - 1 bit masks. Each bit position i gets a vector v(i) of r + 1 bits; mask
m (a vector other than zero) keeps the positions with an odd <v(i), m>. The v of up to r differing positions span at
most r dimensions, so some m is orthogonal to all of them: under it the pair is equal. Every pair within the radius
therefore collides in some table, for certain and not only probably.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalweave.llm.common import claim, small_batches, stored, texts_of, worker_cache
from evalweave.llm.graph import components

# Different fingerprints with one masked value that one task compares; more are cut into blocks.
BLOCK = 1024


def _fingerprint(text: str, words: int) -> int:
    parts = text.encode().lower().split()  # bytes: A-Z only, and exactly the six ASCII blanks
    if not parts:
        return 0
    if len(parts) <= words:
        hashes = [xxhash.xxh64_intdigest(b" ".join(parts), 42)]
    else:
        lengths = np.fromiter(map(len, parts), np.int64, len(parts)) + 1
        ends = np.cumsum(lengths) - 1
        starts = (ends - lengths + 1)[: len(parts) - words + 1].tolist()
        joined, digest = b" ".join(parts), xxhash.xxh64_intdigest
        hashes = [digest(joined[a:b], 42) for a, b in zip(starts, ends[words - 1 :].tolist())]
    # Set bits by byte of the hashes: counts of byte values, then of the bits in them.
    raw = np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8)
    counts = np.bincount((raw + _lanes()).ravel(), minlength=2048).reshape(8, 256) @ _bits()
    return int.from_bytes(np.packbits((2 * counts > len(hashes)), axis=1, bitorder="little").tobytes(), "little")


def _lanes() -> np.ndarray:
    return np.arange(8, dtype=np.int64) * 256


def _bits() -> np.ndarray:
    kept = worker_cache("bits")
    if "bits" not in kept:
        kept["bits"] = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)
    return kept["bits"]


def fingerprints(df: DataFrame, id_col: str, text: str, words: int = 4) -> DataFrame:
    """(id, fp): fp is the 64-bit fingerprint as a signed long.

    A-Z is lower-cased, words are ``[^\\x20\\x09-\\x0D]+``, shingles are ``words`` consecutive ones, repeats included (fewer
    words: the whole sequence); a bit is 1 if it is set in more than half of the XXH64 values (seed 42). Null, empty and
    blank texts have fingerprint 0. The whole text is read, one text at a time.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim()
        for batch in batches:
            fps = np.array([_fingerprint(t, words) for t in texts_of(batch, "_text")], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps)], names=[id_col, "fp"])

    small_batches(df.sparkSession)
    kind = df.schema[id_col].dataType.simpleString()
    return df.select(F.col(id_col), F.col(text).alias("_text")).mapInArrow(run, f"`{id_col}` {kind}, fp bigint")


def masks(radius: int, seed: int = 7) -> list[int]:
    """The 2^(radius + 1) - 1 masks as signed longs. The vectors are dealt evenly, so each mask keeps about half of the bits."""
    dims = radius + 1
    vectors = 1 + np.arange(64) % (2**dims - 1)
    np.random.default_rng(seed).shuffle(vectors)
    out = []
    for m in range(1, 2**dims):
        keep = sum(1 << i for i, v in enumerate(vectors) if bin(int(v) & m).count("1") % 2)
        out.append(keep - (1 << 64) if keep >= 1 << 63 else keep)
    return out


def _near_tree(own: np.ndarray, other: np.ndarray | None, radius: int) -> list[tuple[int, int]]:
    """Links that connect what the fingerprints within the radius connect (a forest, not every pair).

    Breadth first: each fingerprint reached is compared with those not reached yet, so a tight cluster is linked in
    about as many comparisons as it has members.
    """
    if other is None:
        nodes, side = own, None
    else:  # between two blocks only
        nodes = np.concatenate([own, other])
        side = np.r_[np.zeros(len(own), bool), np.ones(len(other), bool)]
    left, links = np.arange(len(nodes)), []
    while len(left):
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            at = queue.pop()
            near = np.bitwise_count(nodes[left] ^ nodes[at]) <= radius
            if side is not None:
                near &= side[left] != side[at]
            if near.any():
                found = left[near]
                links += [(int(nodes[at]), int(nodes[j])) for j in found]
                queue += found.tolist()
                left = left[~near]
    return links


def _link_runs(radius: int):
    """Rows (key, block pair, fp) sorted by the first three columns -> links inside each run of equal ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim()
        held: list[np.ndarray] = []
        held_key = None

        def close():
            if not held:
                return []
            rows = np.concatenate(held)
            own, other = rows[rows[:, 1] == 0, 0], rows[rows[:, 1] == 1, 0]
            return _near_tree(own.view(np.uint64), other.view(np.uint64) if len(other) else None, radius)

        for batch in batches:
            if not batch.num_rows:
                continue
            cols = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(5)]
            table, value, pair, fp, second = cols
            cuts = np.flatnonzero((np.diff(table) != 0) | (np.diff(value) != 0) | (np.diff(pair) != 0)) + 1
            links = []
            for a, b in zip(np.r_[0, cuts], np.r_[cuts, len(fp)]):
                key = (table[a], value[a], pair[a])
                if key != held_key:
                    links += close()
                    held.clear()
                    held_key = key
                held.append(np.stack([fp[a:b], second[a:b]], axis=1))
            yield _pairs(links)
        yield _pairs(close())

    return run


def _pairs(links: list[tuple[int, int]]) -> pa.RecordBatch:
    a = np.array([x for x, _ in links], np.uint64).view(np.int64)
    b = np.array([y for _, y in links], np.uint64).view(np.int64)
    return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])


def fingerprint_links(fps: DataFrame, radius: int, block: int = BLOCK) -> DataFrame:
    """(a, b): links between different fingerprints (column ``fp``, distinct) that join all those within ``radius`` bits.

    Work grows with the number of different fingerprints, however often each occurs. A masked value shared by more than
    ``block`` of them is cut into blocks by hash, and pairs of blocks are compared in different tasks; nothing is
    dropped and no task holds more than two blocks of one value.
    """
    keyed = fps.select(
        F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m)) for m in masks(radius)])).alias("table", "value"), "fp"
    )
    counts = stored(keyed.groupBy("table", "value").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "masked")
    shared = keyed.join(counts, ["table", "value"])
    blocks = F.ceil(F.col("n") / block).cast("int")
    own = F.pmod(F.xxhash64("fp", "table"), blocks).cast("int")
    # Block i meets every block j >= i, as the first of the pair, and every j < i as the second; pair = low * blocks + high.
    dealt = shared.withColumns({"blocks": blocks, "own": own}).select(
        "table",
        "value",
        "fp",
        F.explode(
            F.transform(
                F.sequence(F.lit(0), F.col("blocks") - 1),
                lambda j: F.struct(
                    (F.least(j, F.col("own")).cast("bigint") * F.col("blocks") + F.greatest(j, F.col("own"))).alias("pair"),
                    F.when(j < F.col("own"), F.lit(1)).otherwise(F.lit(0)).cast("bigint").alias("second"),
                ),
            )
        ).alias("x"),
    )
    rows = dealt.select("table", "value", "x.pair", "fp", "x.second")
    links = (
        rows.repartition("table", "value", "pair")
        .sortWithinPartitions("table", "value", "pair")
        .mapInArrow(_link_runs(radius), "a bigint, b bigint")
    )
    return links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def near_duplicates(df: DataFrame, id_col: str, text: str, words: int = 4, radius: int = 4) -> DataFrame:
    """(id, fp, component_id): the smallest id reachable over links of at most ``radius`` differing bits.

    Fingerprints are the nodes: documents of one fingerprint are one node, so copies cost nothing beyond the first. An id is a
    name, not a link: rows that share an id but not a fingerprint are connected only if their fingerprints are. A null id
    connects like any other and is the smallest of its component only if there is no other (then component_id is null).
    Ids can be of any ordered type. Repeated rows stay.
    """
    prints = stored(fingerprints(df, id_col, text, words), "fingerprints")
    nodes = stored(prints.groupBy("fp").agg(F.min(id_col).alias("first")), "nodes")
    links = stored(fingerprint_links(nodes.select("fp"), radius), "links")
    rooted = nodes.join(components(links), nodes["fp"] == F.col("node"), "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    of_print = rooted.join(least, "root").select("fp", "component_id")
    return prints.join(of_print, "fp", "left").select(id_col, "fp", "component_id")
