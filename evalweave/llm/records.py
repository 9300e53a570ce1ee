"""Token ids in length-delimited binary records with masked checksums, and a separate offset index.

A data file is a row of records:

    length   uint64  bytes of the payload
    crc      uint32  masked CRC-32 of the 8 bytes of the length
    payload  flag uint8 (1: the id is set), id int64, ids as uint16 or uint32
    crc      uint32  masked CRC-32 of the payload

All numbers are little-endian. A mask rotates a checksum right by 15 bits and adds a constant, so a checksum of data that
holds checksums is not degenerate. The index of a data file has 16 bytes a record, in the same order: the offset of the
record (uint64) and its number of ids (uint64); with it a reader can fetch records in any order.
"""

from __future__ import annotations

import os
import re
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from evalweave.llm.common import WHITE, claim, shared_path, small_batches, stored, worker_cache

MASK = 0xA282EAD8  # fixed value of the format
HEAD, OWNER, ENTRY = "<QI", "<Bq", "<QQ"
HEAD_SIZE, OWNER_SIZE, ENTRY_SIZE = map(struct.calcsize, (HEAD, OWNER, ENTRY))

# Words whose ids a worker remembers, in each of two generations: about 300 MB together.
REMEMBERED = 800_000
# Bytes that a writer holds before it hands them to the file system.
BUFFER = 1 << 20

# The tokenizer drops blanks and never joins characters across them, nor a letter or digit and one of these marks.
_LETTER = "A-Za-z0-9À-ÖØ-öø-ÿ"
UNIT = re.compile(rf"[{_LETTER}]+(?=[{WHITE}.,;:!?]|\Z)|[^{WHITE}]+")
NO_BLANKS = "\x1c\x1d\x1e\x1f"


def masked(data: bytes) -> int:
    crc = zlib.crc32(data)
    return (((crc >> 15) | (crc << 17)) + MASK) & 0xFFFFFFFF


def frame(owner: int | None, ids: bytes) -> bytes:
    """One record."""
    payload = struct.pack(OWNER, owner is not None, owner or 0) + ids
    length = struct.pack("<Q", len(payload))
    return b"".join((length, struct.pack("<I", masked(length)), payload, struct.pack("<I", masked(payload))))


def unframe(data: bytes) -> tuple[int | None, bytes]:
    """The id and the ids of one record; raises if a checksum does not hold."""
    length, crc = struct.unpack_from(HEAD, data)
    payload = data[HEAD_SIZE : HEAD_SIZE + length]
    if masked(data[:8]) != crc or len(payload) != length or masked(payload) != struct.unpack_from("<I", data, HEAD_SIZE + length)[0]:
        raise ValueError("corrupt record")
    known, owner = struct.unpack_from(OWNER, payload)
    return (owner if known else None), payload[OWNER_SIZE :]


class WordEncoder:
    """Ids of a text by a tokenizer that drops blanks: each different word is asked for once, many words at a time."""

    def __init__(self, file: bytes, dtype: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks are the parallelism
        from tokenizers import Tokenizer

        # Special strings in a text get their ids, as the library gives them; they hold no blank, so no unit cuts one.
        self.tokenizer = Tokenizer.from_str(file.decode())
        self.dtype = dtype
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def _ask(self, words: list[str]) -> None:
        """Encode words in one call, a blank between them, and deal the ids out by where their tokens begin."""
        found = self.tokenizer.encode(" ".join(words), add_special_tokens=False)
        ids = np.array(found.ids, self.dtype)
        begins = np.fromiter((a for a, _ in found.offsets), np.int64, len(ids))
        lengths = np.fromiter(map(len, words), np.int64, len(words)) + 1
        cuts = np.searchsorted(begins, np.cumsum(lengths) - lengths).tolist()
        raw, size = ids.tobytes(), ids.itemsize
        for word, a, b in zip(words, cuts, [*cuts[1:], len(ids)]):
            self.known[word] = raw[a * size : b * size]

    def encode(self, texts: list[str]) -> list[bytes]:
        # What stands between blanks is looked up whole; only what is new is cut into units. U+001C to U+001F are blanks for
        # split() alone.
        split = [UNIT.findall(t) if any(c in t for c in NO_BLANKS) else t.split() for t in texts]
        if len(self.known) > REMEMBERED:
            self.known, self.older = {}, self.known
        known, older, missing, cut = self.known, self.older, {}, []
        for word in set().union(*split).difference(known):
            ids = older.get(word)
            if ids is not None:
                known[word] = ids
                continue
            units = UNIT.findall(word)
            if len(units) > 1:
                cut.append((word, units))
            for unit in units:
                if unit not in known:
                    if (ids := older.get(unit)) is None:
                        missing[unit] = None
                    else:
                        known[unit] = ids
        new = list(missing)
        for at in range(0, len(new), 2048):
            self._ask(new[at : at + 2048])
        for word, units in cut:
            known[word] = b"".join(map(known.__getitem__, units))
        return [b"".join(map(known.__getitem__, words)) for words in split]


def _encoder(file: Broadcast, dtype: str) -> WordEncoder:
    claim("words")
    kept = worker_cache("words")
    key = (hash(file.value), dtype)
    if key not in kept:
        kept.clear()
        kept[key] = WordEncoder(file.value, dtype)
    return kept[key]


def _parts(texts: list[str], limit: int = 2 << 20) -> Iterator[list[str]]:
    part, size = [], 0
    for t in texts:
        part.append(t)
        size += len(t)
        if size > limit:
            yield part
            part, size = [], 0
    if part:
        yield part


def _write(file: Broadcast, dtype: str, end: bytes, folder: str):
    """Rows in order -> files of one task, and one row that names them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = None
        for batch in batches:
            if not batch.num_rows:
                continue
            if encoder is None:
                encoder, part = _encoder(file, dtype), batch.column("part")[0].as_py()
                where, root = fs.FileSystem.from_uri(folder)
                # Every attempt has names of its own; only the names that a finished task returns are read.
                name = f"{part:06d}-{uuid.uuid4().hex}"
                data, index = where.open_output_stream(f"{root}/{name}.rec"), where.open_output_stream(f"{root}/{name}.idx")
                offset = n = total = 0
                held, entries = [], []
            owners, at = batch.column("id").to_pylist(), 0
            for texts in _parts(["" if t is None else t for t in batch.column("text").to_pylist()]):
                for ids in encoder.encode(texts):
                    record = frame(owners[at], ids + end)
                    tokens = (len(ids) + len(end)) // np.dtype(dtype).itemsize
                    held.append(record)
                    entries.append(struct.pack(ENTRY, offset, tokens))
                    offset += len(record)
                    total += tokens
                    n += 1
                    at += 1
                data.write(b"".join(held))
                index.write(b"".join(entries))
                held, entries = [], []
        if encoder is not None:
            data.close()
            index.close()
            yield pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([name]), pa.array([n], pa.int64()), pa.array([total], pa.int64()), pa.array([offset], pa.int64())],
                names=["part", "file", "records", "tokens", "bytes"],
            )

    return run


def dtype_for(vocabulary: int) -> str:
    return "<u2" if vocabulary <= 1 << 16 else "<u4"


def write_records(
    df: DataFrame, id_col: str, text: str, tokenizer_file: bytes, vocabulary: int, end_id: int | None = None, folder: str | None = None
) -> tuple[str, DataFrame]:
    """Encode every whole text and write the records in ascending id order; returns the folder and its manifest.

    The manifest has one row per data file: (part, file, records, tokens, bytes, first): files in the order of ``part``
    hold the rows in order, ``first`` is the number of ids before the file. Files of attempts that failed are not in
    it. Texts travel once, to the range of their id; within a task two megabytes of text are worked on at a time (or one
    text). ``id_col`` is an integer; null ids come first; equal ids stand side by side in any order. A null text is
    empty and has only the end id. An empty table gives no files. ``folder`` must be reachable by all executors (default:
    a new folder below spark.checkpoint.dir).
    """
    spark = df.sparkSession
    small_batches(spark)
    if folder is None:
        folder = shared_path(spark, "records")
    if "://" not in folder and not folder.startswith("file:"):
        folder = f"file://{folder}"
    folder = re.sub(r"^file:/(?!/)", "file:///", folder)
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(path)
    file = spark.sparkContext.broadcast(bytes(tokenizer_file))
    dtype = dtype_for(vocabulary)
    end = b"" if end_id is None else np.array([end_id], dtype).tobytes()
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = (
        df.select(F.col(id_col).cast("bigint").alias("id"), F.col(text).alias("text"))
        .repartitionByRange(parts, "id")
        .sortWithinPartitions("id")
        .withColumn("part", F.spark_partition_id())
    )
    manifest = stored(
        ordered.mapInArrow(_write(file, dtype, end, folder), "part int, file string, records bigint, tokens bigint, bytes bigint"),
        "manifest",
    )
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row per file
    return folder, manifest.withColumn("first", F.coalesce(F.sum("tokens").over(before), F.lit(0)))


def _read(folder: str, dtype: str, want: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, root = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for name, first in zip(batch.column("file").to_pylist(), batch.column("first").to_pylist()):
                with where.open_input_stream(f"{root}/{name}.rec", buffer_size=BUFFER) as data, where.open_input_stream(
                    f"{root}/{name}.idx", buffer_size=BUFFER
                ) as index:
                    rows: list[tuple] = []
                    while entry := index.read(ENTRY_SIZE):
                        _, tokens = struct.unpack(ENTRY, entry)
                        head = data.read(HEAD_SIZE)
                        owner, ids = unframe(head + data.read(struct.unpack(HEAD, head)[0] + 4))
                        wide = np.frombuffer(ids, dtype).astype("<u4").tobytes()
                        rows.append((owner, first, tokens, zlib.crc32(wide) if want == "crc" else wide))
                        first += tokens
                        if len(rows) >= 2000:
                            yield _rows(rows, want)
                            rows = []
                    yield _rows(rows, want)

    return run


def _rows(rows: list[tuple], want: str) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64() if want == "crc" else pa.binary())
    return pa.RecordBatch.from_arrays(
        [pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)],
        names=["id", "start", "n_tokens", "ids_crc32" if want == "crc" else "ids"],
    )


def read_records(spark: SparkSession, folder: str, manifest: DataFrame, vocabulary: int, want: str = "ids") -> DataFrame:
    """(id, start, n_tokens, ids) of every record; ``start`` counts the ids of all records before it. With ``want="crc"``
    the CRC-32 of the ids as unsigned 32-bit integers instead of the ids. Every checksum is verified."""
    if want not in ("ids", "crc"):
        raise ValueError("want must be ids or crc")
    last = "ids_crc32 bigint" if want == "crc" else "ids binary"
    files = manifest.select("file", "first")
    parts = max(1, manifest.count())
    return files.repartition(parts, "file").mapInArrow(
        _read(folder, dtype_for(vocabulary), want), f"id bigint, start bigint, n_tokens bigint, {last}"
    )


def shuffled_reader(folder: str, name: str, vocabulary: int, seed: int) -> Iterator[tuple[int | None, np.ndarray]]:
    """Records of one data file in a seeded random order, each fetched by its offset: the index alone is held in memory."""
    where, root = fs.FileSystem.from_uri(folder)
    with where.open_input_stream(f"{root}/{name}.idx") as index:
        offsets = np.frombuffer(index.read(), "<u8").reshape(-1, 2)[:, 0].copy()
    np.random.default_rng(seed).shuffle(offsets)
    with where.open_input_file(f"{root}/{name}.rec") as data:
        for at in offsets.tolist():
            data.seek(at)
            head = data.read(HEAD_SIZE)
            owner, ids = unframe(head + data.read(struct.unpack(HEAD, head)[0] + 4))
            yield owner, np.frombuffer(ids, dtype_for(vocabulary))
