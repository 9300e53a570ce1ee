"""Shared helpers: stored intermediate results, worker caches, vectorised word hashes."""

from __future__ import annotations

import gc
import re
import sys
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evalweave.session import checkpoint_dir

# White_Space of Unicode: what \s matches in the patterns of the tokenizers.
WHITE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new folder below ``spark.checkpoint.dir``, removed when the session's JVM ends."""
    path = f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return path


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write an intermediate result as Parquet to the shared folder and read it back.

    It is computed once however often it is read, and survives lost executors. Unlike ``checkpoint()`` it is
    compressed, columnar, and does not run the plan twice.
    """
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


# Caches of tens of megabytes.
LARGE_CACHES = ("bpe", "words")

# Bytes of an Arrow batch that goes to a Python worker. A batch exists several times over, in the JVM and in the worker, for each
# core; with the engine's 64 MB, two cores' batches take half a gigabyte more than with 4 MB.
BATCH_BYTES = 4 << 20


def small_batches(spark: SparkSession) -> None:
    """Ask the session for Arrow batches of ``BATCH_BYTES``, unless it asks for a size of its own."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key) == f"{64 << 20}b":
        spark.conf.set(key, f"{BATCH_BYTES}b")


def worker_cache(name: str) -> dict:
    """A dictionary that lives as long as the Python worker, across tasks."""
    return vars(sys).setdefault("_evalweave_caches", {}).setdefault(name, {})


def claim(*names: str) -> None:
    """Drop the large caches that other operators have left in this worker; called where a task begins."""
    caches = vars(sys).get("_evalweave_caches", {})
    for name in LARGE_CACHES:
        if name not in names and caches.pop(name, None):
            gc.collect()


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased, every other character unchanged; ``lower`` does the same on plain ASCII, and faster."""
    upper = "".join(map(chr, range(65, 91)))
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(
        F.translate(text, upper, upper.lower())
    )


def buckets_for(df: DataFrame, text: str, target_bytes: int) -> int:
    """Number of buckets so that one holds about ``target_bytes`` of text."""
    total = df.agg(F.sum(F.octet_length(text).cast("bigint"))).first()[0] or 0
    return max(1, -(-total // target_bytes))


# ---- words and window hashes, vectorised -------------------------------------------------------------------

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BLOCK = 1 << 21


def mix(h: np.ndarray) -> np.ndarray:
    """Spread 64-bit values evenly (xor-shift and multiply)."""
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def powers(base: np.uint64, n: int) -> np.ndarray:
    """1, base, base^2, ... modulo 2^64; grown on demand and kept by the worker."""
    kept = worker_cache("powers")
    have = kept.get(int(base))
    if have is None or len(have) < n:
        out = np.full(max(n, 4096), base, np.uint64)
        out[0] = 1
        have = kept[int(base)] = np.multiply.accumulate(out)
    return have[:n]


def word_hashes(data: bytes) -> np.ndarray:
    """A 64-bit hash of every word ``[^\\x20\\x09-\\x0D]+`` of a text, in order; block by block, so temporary memory
    is bounded unless a single word is longer than a block."""
    out, at = [], 0
    while at < len(data):
        end = min(len(data), at + _BLOCK)
        if end < len(data):
            cut = max(data.rfind(c, at, end) for c in (b" ", b"\n", b"\t", b"\r", b"\x0b", b"\x0c"))
            if cut > at:
                end = cut
            else:  # one word longer than a block: go on to its end
                found = re.compile(rb"[\x20\x09-\x0D]").search(data, end)
                end = found.start() if found else len(data)
        out.append(_hash_block(np.frombuffer(data, np.uint8, end - at, at)))
        at = end
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def _hash_block(raw: np.ndarray) -> np.ndarray:
    space = _SPACE[raw]
    edge = np.diff(space, prepend=True, append=True)
    marks = np.flatnonzero(edge)
    starts, ends = marks[0::2], marks[1::2]
    if not len(starts):
        return np.zeros(0, np.uint64)
    lengths = ends - starts
    letters = raw[~space].astype(np.uint64)
    firsts = np.cumsum(lengths) - lengths
    offset = np.arange(len(letters)) - np.repeat(firsts, lengths)
    letters += np.uint64(1)
    letters *= powers(_BASE, int(lengths.max()))[offset]
    return mix(np.add.reduceat(letters, firsts))


_Q = np.uint64(0xD6E8FEB86659FD93)
_Q_INVERSE = np.uint64(pow(int(_Q), -1, 1 << 64))


def window_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """A hash of every run of n consecutive words; empty if there are fewer."""
    if len(words) < n:
        return np.zeros(0, np.uint64)
    sums = np.zeros(len(words) + 1, np.uint64)
    np.cumsum(words * powers(_Q, len(words)), out=sums[1:])
    k = len(words) - n + 1
    return mix((sums[n:] - sums[:-n]) * powers(_Q_INVERSE, k))


def sliding(values: np.ndarray, width: int, op=np.minimum) -> np.ndarray:
    """Minimum (or maximum) of every run of ``width`` values, by doubling."""
    out, have = values, 1
    while have < width:
        step = min(have, width - have)
        out = op(out[: len(out) - step], out[step:])
        have += step
    return out


def texts_of(batch, name: str = "text") -> list[str]:
    """Texts of an Arrow batch, null as the empty text."""
    return ["" if t is None else t for t in batch.column(name).to_pylist()]


def slices(batch, name: str, limit: int = 4 << 20):
    """An Arrow batch in pieces of about ``limit`` bytes of one string or binary column (at least one row each), so that what a
    worker makes of a piece is handed on before the next."""
    lengths = pc.fill_null(pc.binary_length(batch.column(name)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    part = np.cumsum(lengths) // limit
    for at, end in zip(np.flatnonzero(np.diff(part, prepend=-1)), [*np.flatnonzero(np.diff(part)) + 1, len(part)]):
        yield batch.slice(int(at), int(end - at))


def row_groups(texts: list[bytes], limit: int = 1 << 21) -> Iterator[tuple[int, int]]:
    """Slices of consecutive texts of at most ``limit`` bytes together (at least one text each)."""
    start, size = 0, 0
    for i, t in enumerate(texts):
        if i > start and size + len(t) > limit:
            yield start, i
            start, size = i, 0
        size += len(t)
    if start < len(texts):
        yield start, len(texts)
