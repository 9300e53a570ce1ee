"""Byte-level BPE: overlapping chunks are pre-tokenised in parallel, stitched where their boundaries agree, then encoded.

A match of the splitting pattern depends on the text from its start on (no look-behind) and on at most one
character after its end. So once two neighbouring chunks share one boundary, they agree from there on, except near the
end of the earlier chunk. A long text is therefore cut into chunks with overlaps, each chunk is pre-tokenised for
itself, the first boundary that a chunk shares with the one before is its seam, and the pieces between two seams are
encoded in parallel. A text without a shared boundary in some overlap (a run of letters or blanks longer than the overlap)
is encoded as a whole.
"""

from __future__ import annotations

import base64
import heapq
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window
from pyspark.sql.types import BinaryType, StructField, StructType, _parse_datatype_string

from evalweave.llm.common import WHITE, claim, slices, small_batches, worker_cache

CHUNK = 32_768
OVERLAP = 1_024

# Units whose ids a worker remembers, in each of two generations: about 80 MB together.
REMEMBERED = 200_000

# A boundary always stands before a blank after a non-blank, and between a letter or digit and one of these marks. What lies
# between two such places splits the same alone as in its text, so its ids can be remembered.
_LETTER = "A-Za-z0-9À-ÖØ-öø-ÿ"
UNIT = re.compile(rf"[{WHITE}]*[{_LETTER}]+(?=[{WHITE}.,;:!?]|\Z)|[{WHITE}]*[^{WHITE}]+|[{WHITE}]+")


class Vocabulary:
    """Ranks of a byte-level BPE and the pattern that splits texts before the merges."""

    def __init__(self, ranks_file: bytes, pattern: str):
        lines = [line.split() for line in ranks_file.splitlines() if line.strip()]
        self.ranks = {base64.b64decode(token): int(rank) for token, rank in lines}
        self.pattern = regex.compile(pattern)
        self.tokens = {rank: token for token, rank in self.ranks.items()}
        self.packed = {token: rank.to_bytes(4, "little") for token, rank in self.ranks.items()}
        self.remembered = _Remembered(self)

    def merge(self, piece: bytes) -> bytes:
        """Ids of one piece: the pair with the lowest rank is merged, the leftmost of equals, until none is left."""
        whole = self.packed.get(piece)
        if whole is not None:
            return whole
        if len(piece) > 48:
            return b"".join([self.ranks[p].to_bytes(4, "little") for p in self._merge_long(piece)])
        rank, none = self.ranks.get, 1 << 40
        cuts = list(range(len(piece) + 1))
        pairs = [rank(piece[i : i + 2], none) for i in cuts[:-2]]
        while pairs and (low := min(pairs)) != none:
            i = pairs.index(low)
            del pairs[i], cuts[i + 1]
            if i:
                pairs[i - 1] = rank(piece[cuts[i - 1] : cuts[i + 1]], none)
            if i < len(pairs):
                pairs[i] = rank(piece[cuts[i] : cuts[i + 2]], none)
        packed = self.packed
        return b"".join([packed[piece[a:b]] for a, b in zip(cuts, cuts[1:])])

    def _merge_long(self, piece: bytes) -> list[bytes]:
        """The tokens of a long piece, with a heap and a linked list: n log n."""
        ranks, n = self.ranks, len(piece)
        end, before, after = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
        heapq.heapify(heap)
        alive = [True] * n
        while heap:
            _, i, stop = heapq.heappop(heap)
            j = after[i] if alive[i] else n
            if j >= n or end[j] != stop:
                continue  # one of the two has been merged meanwhile
            alive[j], end[i], after[i] = False, end[j], after[j]
            if after[i] < n:
                before[after[i]] = i
                if (r := ranks.get(piece[i : end[after[i]]])) is not None:
                    heapq.heappush(heap, (r, i, end[after[i]]))
            k = before[i]
            if k >= 0 and (r := ranks.get(piece[k : end[i]])) is not None:
                heapq.heappush(heap, (r, k, end[i]))
        out, i = [], 0
        while i < n:
            out.append(piece[i : end[i]])
            i = after[i]
        return out

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        return b"".join(map(self.remembered.__getitem__, UNIT.findall(text)))

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


class _Remembered(dict):
    """unit -> ids, filled on demand. When full it becomes the older generation, and what is asked for again comes back."""

    def __init__(self, vocabulary: Vocabulary):
        super().__init__()
        self.vocabulary, self.older = vocabulary, {}

    def __missing__(self, unit: str) -> bytes:
        ids = self.older.get(unit)
        if ids is None:
            v = self.vocabulary
            if unit.isascii() and (unit.isalpha() or unit[:1] == " " and unit[1:].isalpha()):
                ids = v.merge(unit.encode())  # one match of the pattern
            else:
                ids = b"".join([v.merge(piece.encode()) for piece in v.pattern.findall(unit)])
        if len(unit) <= 40:
            if len(self) >= REMEMBERED:
                self.older = dict(self)
                self.clear()
            self[unit] = ids
        return ids


def _vocabulary(file: Broadcast, pattern: str) -> Vocabulary:
    claim("bpe")
    kept = worker_cache("bpe")
    key = (hash(file.value), pattern)
    if key not in kept:
        if len(kept) >= 2:
            kept.clear()
        kept[key] = Vocabulary(file.value, pattern)
    return kept[key]


def _ids(vocabulary: Vocabulary, row: pa.Array, ids: list[bytes], decoded: bool) -> pa.RecordBatch:
    """Rows with their ids and, if asked for, the bytes that these decode to."""
    names, columns = ["row", "ids"], [row, pa.array(ids, pa.binary())]
    if decoded:
        names.append("decoded")
        columns.append(pa.array([vocabulary.decode(i) for i in ids], pa.binary()))
    return pa.RecordBatch.from_arrays(columns, names=names)


def _encode_whole(file: Broadcast, pattern: str, decoded: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = _vocabulary(file, pattern)
        for batch in (part for whole in batches for part in slices(whole, "text")):
            ids = [vocabulary.encode(t) if t else b"" for t in batch.column("text").to_pylist()]
            yield _ids(vocabulary, batch.column("row"), ids, decoded)

    return run


def _chunks(chunk: int, overlap: int):
    """Rows (row, doc, text) -> rows (doc, k, from, core, row, text): chunk k has its core and ``overlap`` more on either side."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, text in enumerate(batch.column("text").to_pylist()):
                cores = range(0, len(text), chunk)
                starts = [max(0, c - overlap) for c in cores]
                n = len(starts)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([batch.column("doc")[i].as_py()] * n, pa.int64()),
                        pa.array(range(n), pa.int32()),
                        pa.array(starts, pa.int64()),
                        pa.array(list(cores), pa.int64()),
                        pa.array([c + chunk >= len(text) for c in cores], pa.bool_()),
                        batch.column("row").take(pa.array([i] * n)),
                        pa.array([text[s : c + chunk + overlap] for s, c in zip(starts, cores)], pa.string()),
                    ],
                    names=["doc", "k", "from", "core", "last", "row", "text"],
                )

    return run


def boundaries(pattern: regex.Pattern, text: str, last: bool) -> list[int]:
    """Starts of the matches that more text to the right cannot change; all of them, and the end, in the last chunk."""
    n, out = len(text), []
    for m in pattern.finditer(text):
        a, b = m.span()
        if not last and (b >= n or a + 3 > n):
            out.append(a)  # where it starts is certain, where it ends is not
            return out
        out.append(a)
    out.append(n)
    return out


def _pretokenise(file: Broadcast, pattern: str, chunk: int, overlap: int):
    """Adds the boundaries around both ends of the core, as places in the whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, blank = regex.compile(pattern), regex.compile(r"\s")
        for batch in batches:
            left, right = [], []
            for at, core, last, text in zip(*[batch.column(c).to_pylist() for c in ("from", "core", "last", "text")]):
                found = np.array(boundaries(split, text, last), np.int64) + at
                # A run of blanks splits by what follows it, so no seam stands behind a blank.
                near = found[(found > at) & (found >= core - overlap) & (found <= core + overlap)]
                left.append([p for p in near.tolist() if not blank.match(text, p - at - 1)])
                right.append(found[found >= core + chunk - overlap] if not last else found[:0])
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(left, pa.list_(pa.int64())), pa.array(right, pa.list_(pa.int64()))],
                names=[*batch.schema.names, "left", "right"],
            )

    return run


def _encode_pieces(file: Broadcast, pattern: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = _vocabulary(file, pattern)
        for batch in (part for whole in batches for part in slices(whole, "text")):
            ids, rest = [], []
            for at, core, a, b, synced, text in zip(
                *[batch.column(c).to_pylist() for c in ("from", "core", "seam", "next", "synced", "text")]
            ):
                if synced:
                    ids.append(vocabulary.encode(text[a - at : len(text) if b is None else b - at]))
                    rest.append(None)
                else:
                    ids.append(None)
                    rest.append(text[core - at : len(text) if b is None else b - at])
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in ("doc", "k", "row")], pa.array(ids, pa.binary()), pa.array(rest, pa.string())],
                names=["doc", "k", "row", "ids", "rest"],
            )

    return run


def _join_pieces(file: Broadcast, pattern: str, decoded: bool):
    """Rows sorted by (doc, k) -> one row per document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = _vocabulary(file, pattern)
        doc, row, parts, texts = None, None, [], []

        def done() -> pa.RecordBatch:
            ids = vocabulary.encode("".join(texts)) if texts else b"".join(parts)
            return _ids(vocabulary, row, [ids], decoded)

        for batch in batches:
            for i in range(batch.num_rows):
                if (this := batch.column("doc")[i].as_py()) != doc:
                    if doc is not None:
                        yield done()
                    doc, row, parts, texts = this, batch.column("row").slice(i, 1), [], []
                if (ids := batch.column("ids")[i].as_py()) is not None:
                    parts.append(ids)
                else:
                    texts.append(batch.column("rest")[i].as_py())
        if doc is not None:
            yield done()

    return run


def encode(
    df: DataFrame, text: str, ranks_file: bytes, pattern: str, chunk: int = CHUNK, overlap: int = OVERLAP, decoded: bool = False
) -> DataFrame:
    """(row, ids): the ids of every whole text as little-endian unsigned 32-bit integers; ``row`` is a struct of the other columns.

    The result is that of splitting the text by ``pattern`` and merging each match by the ranks, without special tokens.
    Null and empty texts have no ids. Texts of up to ``chunk`` characters are one chunk and are not moved; only longer
    ones are cut, spread over tasks and joined again, so no task works on one text alone except to concatenate its ids.
    Repeated rows stay apart. With ``decoded`` a third column has the bytes that the ids decode to, as ``decode`` gives them, from
    the same worker: a worker of its own would hold the vocabulary once more for each core. ``ranks_file`` (one "base64 rank" a line, a megabyte) is broadcast; its size is that of the vocabulary.
    """
    if overlap < 8 or chunk < 2 * overlap:
        raise ValueError("overlap must be at least 8 characters and at most half a chunk")
    small_batches(df.sparkSession)
    file = df.sparkSession.sparkContext.broadcast(bytes(ranks_file))
    others = [c for c in df.columns if c != text]
    row = F.struct(*[F.col(f"`{c}`") for c in others]) if others else F.struct(F.lit(0).alias("_none"))
    docs = df.select(row.alias("row"), F.col(f"`{text}`").alias("text"))
    kind = docs.schema["row"].dataType
    out = _schema(row=kind, ids="binary", **({"decoded": "binary"} if decoded else {}))
    long = F.coalesce(F.length("text") > chunk, F.lit(False))
    whole = docs.where(~long).mapInArrow(_encode_whole(file, pattern, decoded), out)
    cut = (
        docs.where(long)
        .withColumn("doc", F.monotonically_increasing_id())
        .mapInArrow(
            _chunks(chunk, overlap),
            _schema(doc="bigint", k="int", **{"from": "bigint"}, core="bigint", last="boolean", row=kind, text="string"),
        )
        .repartition("doc", "k")
        .mapInArrow(
            _pretokenise(file, pattern, chunk, overlap),
            _schema(
                doc="bigint", k="int", **{"from": "bigint"}, core="bigint", last="boolean", row=kind, text="string",
                left="array<bigint>", right="array<bigint>",
            ),
        )
    )
    in_doc = Window.partitionBy("doc").orderBy("k")
    whole_doc = Window.partitionBy("doc")
    seams = (
        cut.withColumn(
            "seam",
            F.when(F.col("k") == 0, F.lit(0).cast("bigint")).otherwise(
                F.array_min(F.array_intersect("left", F.lag("right").over(in_doc)))
            ),
        )
        .withColumn("synced", F.count(F.when(F.col("seam").isNull(), 1)).over(whole_doc) == 0)
        .withColumn("next", F.lead(F.when(F.col("synced"), F.col("seam")).otherwise(F.col("core"))).over(in_doc))
        .drop("left", "right", "last")
    )
    pieces = seams.mapInArrow(
        _encode_pieces(file, pattern), _schema(doc="bigint", k="int", row=kind, ids="binary", rest="string")
    )
    joined = pieces.repartition("doc").sortWithinPartitions("doc", "k").mapInArrow(_join_pieces(file, pattern, decoded), out)
    return whole.unionByName(joined)


def _schema(**types):
    return StructType([StructField(n, _parse_datatype_string(t) if isinstance(t, str) else t) for n, t in types.items()])


def decode(df: DataFrame, ids: str, ranks_file: bytes, name: str = "decoded") -> DataFrame:
    """Add the bytes of the tokens, concatenated; bytes, as a sequence of ids need not be valid UTF-8. Null ids give null.

    An id outside of the vocabulary raises an error.
    """
    small_batches(df.sparkSession)
    file = df.sparkSession.sparkContext.broadcast(bytes(ranks_file))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = _vocabulary(file, "")
        for batch in (part for whole in batches for part in slices(whole, ids)):
            decoded = [None if i is None else vocabulary.decode(i) for i in batch.column(ids).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(decoded, pa.binary())], names=[*batch.schema.names, name]
            )

    source = df.drop(name)
    return source.mapInArrow(run, StructType([*source.schema.fields, StructField(name, BinaryType())]))
