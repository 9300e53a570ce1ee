"""Removal of passages that occur more than once, located by Aho-Corasick automata.

Documents are dealt into buckets of a few MB by a hash. Three passes, each linear in the text:

1. Anchors. Of every window of ``length`` words the smallest hash among its short phrases is its anchor; equal windows have
   equal anchors. Per bucket the different anchors are counted, and anchors that occur once in the corpus are dropped.
2. Confirmed windows. Windows with a recurring anchor are hashed and counted over the corpus; those that start at least
   twice recur.
3. Automata. Per bucket, the recurring windows that its documents need (every ``length``-th of a run, and the last) are
   compiled into one automaton over word numbers, and each document of the bucket is streamed through it. A match covers
   its words. So the automata are sharded by bucket, each holds only phrases of its bucket, and every document is read
   by exactly one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, LongType, StringType, StructField, StructType

from evalweave.llm.common import (
    buckets_for,
    claim,
    row_groups,
    sliding,
    small_batches,
    stored,
    window_hashes,
    word_hashes,
)

BUCKET_BYTES = 4 << 20
PHRASE = 8


def _anchors(words: np.ndarray, length: int, phrase: int) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of the short phrases, and for every window the smallest of them."""
    grams = window_hashes(words, phrase)
    return grams, sliding(grams, length - phrase + 1)


def _chosen(grams: np.ndarray, lows: np.ndarray, length: int, phrase: int) -> np.ndarray:
    """Hashes at the places that are the anchor of some window (one entry per place)."""
    width = length - phrase + 1
    padded = np.concatenate([np.zeros(width - 1, np.uint64), lows, np.zeros(width - 1, np.uint64)])
    return grams[grams == sliding(padded, width, np.maximum)]


def _count(values: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    return np.unique(np.concatenate(values) if values else np.zeros(0, np.uint64), return_counts=True)


def _encoded(batch, name: str) -> list[bytes]:
    return [b"" if t is None else t.encode() for t in batch.column(name).to_pylist()]


def _hash_batch(bucket: int, hashes: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(np.full(len(hashes), bucket, np.int32)), pa.array(hashes.view(np.int64)), pa.array(counts.astype(np.int64))],
        names=["bucket", "h", "n"],
    )


def _anchor_rows(length: int, phrase: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim()
        for batch in batches:
            texts, buckets = _encoded(batch, "text"), batch.column("bucket").to_pylist()
            for lo, hi in row_groups(texts, 1 << 23):
                by_bucket: dict[int, list[np.ndarray]] = {}
                for bucket, data in zip(buckets[lo:hi], texts[lo:hi]):
                    words = word_hashes(data)
                    if len(words) >= length:
                        by_bucket.setdefault(bucket, []).append(_chosen(*_anchors(words, length, phrase), length, phrase))
                rows = [(b, *_count(v)) for b, v in by_bucket.items()]
                if rows:
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(np.concatenate([np.full(len(h), b, np.int32) for b, h, _ in rows])),
                            pa.array(np.concatenate([h for _, h, _ in rows]).view(np.int64)),
                            pa.array(np.concatenate([n for _, _, n in rows]).astype(np.int64)),
                        ],
                        names=["bucket", "h", "n"],
                    )

    return run


def recurring(counted: DataFrame) -> DataFrame:
    """(bucket, h) of the hashes whose counts add up to two or more over all buckets.

    A hash has at most one row per bucket and task, however often it occurs, so none is hot.
    """
    per_bucket = counted.groupBy("h", "bucket").agg(F.sum("n").alias("n"))
    total = F.sum("n").over(Window.partitionBy("h"))
    return per_bucket.withColumn("all", total).where(F.col("all") >= 2).select("bucket", "h")


def _known(table: pa.Table) -> np.ndarray:
    return np.sort(table.column("h").combine_chunks().to_numpy(zero_copy_only=False).view(np.uint64))


def _among(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    if not len(known):
        return np.zeros(len(values), bool)
    at = np.searchsorted(known, values)
    at[at == len(known)] = 0
    return known[at] == values


def _candidates(length: int, phrase: int, with_text: bool):
    """Documents of a bucket and its recurring anchors -> the hashes of windows with such an anchor."""

    def run(docs: pa.Table, anchors: pa.Table) -> pa.Table:
        claim()
        known, hits = _known(anchors), []
        texts = [b"" if t is None else t.encode() for t in docs.column("text").to_pylist()]
        n_words = []
        for data in texts:
            words = word_hashes(data)
            n_words.append(len(words))
            found = np.zeros(0, np.uint64)
            if len(known) and len(words) >= length:
                mask = _among(_anchors(words, length, phrase)[1], known)
                if mask.any():
                    found = window_hashes(words, length)[mask]
            hits.append(found)
        keep = [len(h) > 0 for h in hits]
        whole = [None if k else hashlib.sha256(b" ".join(t.split())).hexdigest() for k, t in zip(keep, texts)]
        texts_out = docs.column("text")
        return pa.table(
            {
                "bucket": docs.column("bucket"),
                "row": docs.column("row"),
                "text": texts_out if with_text else pc.if_else(pa.array(keep, pa.bool_()), texts_out, None),
                "n_words": pa.array(n_words, pa.int64()),
                "kept_sha256": pa.array(whole, pa.string()),
                "hashes": pa.array([h.tobytes() if k else None for k, h in zip(keep, hits)], pa.binary()),
            }
        )

    return run


def _window_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        by_bucket: dict[int, list[np.ndarray]] = {}
        for bucket, raw in zip(batch.column("bucket").to_pylist(), batch.column("hashes").to_pylist()):
            by_bucket.setdefault(bucket, []).append(np.frombuffer(raw, np.uint64))
        for bucket, values in by_bucket.items():
            yield _hash_batch(bucket, *_count(values))


def _needed(starts: np.ndarray, length: int) -> np.ndarray:
    """Of sorted window starts, those that cover the same words: every ``length``-th of a run of consecutive ones, and the last."""
    if not len(starts):
        return starts
    first = np.r_[True, np.diff(starts) > 1]
    last = np.r_[first[1:], True]
    offset = starts - starts[first][np.cumsum(first) - 1]
    return starts[(offset % length == 0) | last]


def _locate(length: int):
    """Documents of a bucket and its recurring windows -> spans that an automaton of these windows covers."""

    def run(docs: pa.Table, windows: pa.Table) -> pa.Table:
        claim()
        known = _known(windows)
        texts = [t.encode().split() for t in docs.column("text").to_pylist()]
        numbers: dict[bytes, int] = {}
        coded = [tuple(numbers.setdefault(w, len(numbers)) for w in words) for words in texts]
        automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        for raw, words in zip(docs.column("text").to_pylist(), coded):
            starts = np.flatnonzero(_among(window_hashes(word_hashes(raw.encode()), length), known))
            for s in _needed(starts, length).tolist():
                automaton.add_word(words[s : s + length], True)
        spans = []
        if len(automaton):
            automaton.make_automaton()
        for words in coded:
            found: list[int] = []  # start, end, start, end ... of merged spans
            if len(automaton):
                for end, _ in automaton.iter(words):
                    start = end + 1 - length
                    if found and start <= found[-1]:
                        found[-1] = end + 1
                    else:
                        found += (start, end + 1)
            spans.append(found)
        return pa.table(
            {
                "row": docs.column("row"),
                "text": docs.column("text"),
                "n_words": docs.column("n_words"),
                "spans": pa.array(spans, pa.list_(pa.int32())),
            }
        )

    return run


def _kept(words: list[bytes], spans: list[int]) -> list[bytes]:
    out, at = [], 0
    for start, end in zip(spans[0::2], spans[1::2]):
        out += words[at:start]
        at = end
    return out + words[at:]


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        kept, removed, digests = [], [], []
        for text, spans in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist()):
            words = text.encode().split()
            rest = _kept(words, spans)
            removed.append(len(words) - len(rest))
            joined = b" ".join(rest)
            digests.append(hashlib.sha256(joined).hexdigest())
            kept.append(joined.decode() if spans else text)
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("row"),
                pa.array(kept, pa.string()),
                batch.column("n_words"),
                pa.array(removed, pa.int64()),
                pa.array(digests, pa.string()),
                batch.column("spans"),
            ],
            names=["row", "text", "n_words", "n_removed", "kept_sha256", "spans"],
        )


def repeated_passages(
    df: DataFrame, text: str, length: int = 35, phrase: int = PHRASE, with_text: bool = True
) -> DataFrame:
    """Cut out every window of ``length`` words whose sequence also starts elsewhere, in the same document too.

    Words are ``[^\\x20\\x09-\\x0D]+``, unchanged; windows are judged on the input. One row per input row:

    * ``row``: a struct of the other columns of the input, whatever their names;
    * ``text``: the text without the covered words, which are then joined by one space; as it was (null included) if nothing
      is covered. Null throughout for rows without candidates if ``with_text`` is False (a digest is all that is needed);
    * ``n_words``, ``n_removed``, ``kept_sha256``: counts, and the SHA-256 of the kept words joined by one space;
    * ``spans``: the covered word ranges [start, end) as a flat list.

    A null text has no words; a text of fewer than ``length`` words loses none; repeated rows count each (so copies lose
    every word if they have ``length`` or more). An empty table gives an empty result.
    """
    if not 1 <= phrase <= length:
        raise ValueError("phrase must be between 1 and length")
    small_batches(df.sparkSession)
    count = buckets_for(df, text, BUCKET_BYTES)
    others = [c for c in df.columns if c != text]
    row = F.struct(*[F.col(f"`{c}`") for c in others]) if others else F.struct(F.lit(0).alias("_none"))
    docs = df.select(
        F.pmod(F.xxhash64(row, F.col(f"`{text}`")), F.lit(count)).cast("int").alias("bucket"),
        row.alias("row"),
        F.col(f"`{text}`").alias("text"),
    )
    kind = docs.schema["row"].dataType
    anchors = recurring(docs.select("bucket", "text").mapInArrow(_anchor_rows(length, phrase), "bucket int, h bigint, n bigint"))

    def schema(*names: str) -> StructType:
        types = {
            "bucket": IntegerType(),
            "row": kind,
            "text": StringType(),
            "n_words": LongType(),
            "n_removed": LongType(),
            "kept_sha256": StringType(),
            "hashes": BinaryType(),
            "spans": ArrayType(IntegerType()),
        }
        return StructType([StructField(n, types[n]) for n in names])

    first = stored(
        docs.groupBy("bucket")
        .cogroup(anchors.groupBy("bucket"))
        .applyInArrow(
            _candidates(length, phrase, with_text), schema("bucket", "row", "text", "n_words", "kept_sha256", "hashes")
        ),
        "candidates",
    )
    candidates = first.where(F.col("hashes").isNotNull())
    windows = recurring(candidates.select("bucket", "hashes").mapInArrow(_window_rows, "bucket int, h bigint, n bigint"))
    located = (
        candidates.select("bucket", "row", "text", "n_words")
        .groupBy("bucket")
        .cogroup(windows.groupBy("bucket"))
        .applyInArrow(_locate(length), schema("row", "text", "n_words", "spans"))
    )
    result = schema("row", "text", "n_words", "n_removed", "kept_sha256", "spans")
    whole = first.where(F.col("hashes").isNull()).select(
        "row", "text", "n_words", F.lit(0).cast("bigint").alias("n_removed"), "kept_sha256", F.array().cast("array<int>").alias("spans")
    )
    return located.mapInArrow(_cut, result).unionByName(whole)


def remove_repeats(df: DataFrame, text: str, length: int = 35, phrase: int = PHRASE) -> DataFrame:
    """``df`` with every repeated passage cut out of ``text``; rows and other columns stay as they are."""
    out = repeated_passages(df, text, length, phrase)
    return out.select(*[F.col("text").alias(text) if c == text else F.col(f"row.`{c}`").alias(c) for c in df.columns])
