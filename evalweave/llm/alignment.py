"""Alignment of two tokenizers' tokens over the same bytes, by galloping intersection of their end offsets.

Both tokenizers cut one byte string into consecutive tokens, so each gives an ascending list of end offsets. The shorter list
drives: from a cursor in the longer list the step doubles until it passes an end, then a binary search closes in. The rank of
each end in the longer list tells everything else: ends found there cut the text into groups, and differences of ranks
give the range of tokens each token overlaps.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from itertools import chain, islice

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalweave.llm.common import WHITE, claim, slices, small_batches, stored, texts_of, worker_cache
from evalweave.llm.records import dtype_for

# Units whose tokens a worker remembers, and their characters together; beyond either, those met only once are forgotten.
REMEMBERED = 600_000
REMEMBERED_CHARS = 32 << 20
# Units that are worked on together, and tokens of both sides that are linked together.
UNITS, TOKENS = 200_000, 400_000
# Pairs of ids whose counts are broadcast: the most frequent ones, 24 bytes each. All others are joined by shuffle.
BROADCAST_PAIRS = 500_000
# Neighbours in the shorter list that start galloping from one place.
STRIDE = 8

# A stretch of blanks and what follows. Tokens of neither kind reach from a character that is no blank into a blank, so a text
# can be cut before a space that follows such a character; blanks behind other blanks stay with them.
UNIT = re.compile(rf" *[^ ]+(?:(?<=[{WHITE}]) +[^ ]*)*| +")


def byte_level_alphabet() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable ones themselves, others from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(other)}


def _piece_bytes(piece: str) -> bytes:
    code = re.fullmatch("<0x([0-9A-F]{2})>", piece)
    return bytes([int(code[1], 16)]) if code else piece.replace("▁", " ").encode()


def ragged(flat: np.ndarray, offsets: np.ndarray, which: np.ndarray) -> np.ndarray:
    """The stretches ``which`` of ``flat``, one after the other; stretch k lies between offsets k and k + 1."""
    starts, counts = offsets[which], offsets[which + 1] - offsets[which]
    ends = np.cumsum(counts)
    return flat[np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - ends + counts, counts)]


class TokenPair:
    """Ids of texts by both tokenizers; each different unit is asked for once, many units at a time."""

    def __init__(self, byte_level: bytes, pieces: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks are the parallelism
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_str(byte_level.decode())
        self.a.encode_special_tokens = True  # their strings in a text are ordinary text
        self.b = sentencepiece.SentencePieceProcessor(model_proto=pieces)
        alphabet = byte_level_alphabet()
        names = {i: t for t, i in self.a.get_vocab(with_added_tokens=False).items()}
        self.a_bytes = [bytes(map(alphabet.__getitem__, names.get(i, ""))) for i in range(max(names) + 1)]
        self.b_bytes = [_piece_bytes(self.b.id_to_piece(i)) for i in range(self.b.get_piece_size())]
        self.space = self.b.piece_to_id("▁")
        self.a_lengths, self.b_lengths = self.lengths()
        self._forget({}, np.zeros(0, np.int64))

    def _forget(self, known: dict[str, int], keep: np.ndarray) -> None:
        """Only the units of ``known`` at the places ``keep`` stay."""
        old = (self.a_flat, self.a_at, self.b_flat, self.b_at, self.wrong) if len(keep) else None
        units = list(known)
        self.known = {units[k]: i for i, k in enumerate(keep.tolist())}
        self.chars = sum(map(len, self.known))
        self.seen = np.zeros(len(keep), np.int64)
        self.a_flat, self.a_at, self.b_flat, self.b_at, self.wrong = (
            (np.zeros(0, "<u4"), np.zeros(1, np.int64), np.zeros(0, "<u4"), np.zeros(1, np.int64), np.zeros(0, bool))
            if old is None
            else (
                ragged(old[0], old[1], keep), np.r_[0, np.cumsum(np.diff(old[1])[keep])],
                ragged(old[2], old[3], keep), np.r_[0, np.cumsum(np.diff(old[3])[keep])], old[4][keep],
            )
        )

    def _together(self, units: list[str]):
        """(ids, tokens per unit) of both sides for units asked for as one text, or None if that does not come apart again."""
        text = "".join(units)
        raw = text.encode()
        ends = np.cumsum([len(u.encode()) for u in units])
        out = []
        for ids, spell, lengths in (
            (self.a.encode(text, add_special_tokens=False).ids, self.a_bytes, self.a_lengths),
            (self.b.encode(text[1:]) or [self.space], self.b_bytes, self.b_lengths),  # it puts a space before
        ):
            if b"".join(map(spell.__getitem__, ids)) != raw:
                return None
            ids = np.array(ids, "<u4")
            token_ends = np.cumsum(lengths[ids])
            cuts = np.searchsorted(token_ends, ends) + 1
            if not (token_ends[cuts - 1] == ends).all():
                return None
            out += [ids, np.diff(cuts, prepend=0)]
        return out

    def _ask(self, units: list[str]) -> None:
        """Learn new units. Those that end in a blank are asked for alone, as it could join what follows."""
        closed = [u for u in units if not u[-1].isspace()]
        groups = [closed[i : i + 512] for i in range(0, len(closed), 512)] + [[u] for u in units if u[-1].isspace()]
        while groups:
            group = groups.pop()
            found = self._together(group)
            if found is None and len(group) > 1:  # somewhere a unit is not spelled by its tokens
                half = len(group) // 2
                groups += [group[:half], group[half:]]
                continue
            none = np.zeros(0, "<u4"), np.zeros(len(group), np.int64)
            a, a_counts, b, b_counts = found or (*none, *none)
            first = len(self.known)
            self.known.update(zip(group, range(first, first + len(group))))
            self.chars += sum(map(len, group))
            self.fresh.append((a, a_counts, b, b_counts, np.full(len(group), found is None)))

    def _learn(self, units: list[str]) -> None:
        missing = list(set(units).difference(self.known))
        if not missing:
            return
        if len(self.known) + len(missing) > REMEMBERED or self.chars > REMEMBERED_CHARS:
            self._forget(self.known, np.flatnonzero(self.seen > 1))
            if len(self.known) > REMEMBERED // 2 or self.chars > REMEMBERED_CHARS // 2:
                self._forget({}, np.zeros(0, np.int64))
            missing = list(set(units).difference(self.known))
        self.fresh: list[tuple] = []
        self._ask(missing)
        a, a_counts, b, b_counts, wrong = (np.concatenate(x) for x in zip(*self.fresh))
        self.a_flat, self.b_flat = np.concatenate([self.a_flat, a]), np.concatenate([self.b_flat, b])
        self.a_at = np.r_[self.a_at, self.a_at[-1] + np.cumsum(a_counts)]
        self.b_at = np.r_[self.b_at, self.b_at[-1] + np.cumsum(b_counts)]
        self.wrong = np.r_[self.wrong, wrong]
        self.seen = np.r_[self.seen, np.zeros(len(wrong), np.int64)]

    def _stretch(self, units: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Ids of both sides, tokens per unit of both, and which units their tokens do not spell."""
        self._learn(units)
        which = np.fromiter(map(self.known.__getitem__, units), np.int64, len(units))
        self.seen += np.bincount(which, minlength=len(self.seen))
        counts = (self.a_at[which + 1] - self.a_at[which], self.b_at[which + 1] - self.b_at[which])
        return ragged(self.a_flat, self.a_at, which), ragged(self.b_flat, self.b_at, which), *counts, self.wrong[which]

    def encode(self, texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Per text the ids of a space and the text by each tokenizer; none if the text is empty, or either side's tokens do not
        spell it. Long texts are worked on by stretches."""
        held: list[list[str]] = []
        size = 0
        for text in texts:
            if len(text) < 1 << 20:
                units = UNIT.findall(" " + text) if text else []
                held.append(units)
                size += len(units)
                if size > UNITS:
                    yield from self._several(held)
                    held, size = [], 0
            else:
                yield from self._several(held)
                held, size = [], 0
                found = (m[0] for m in UNIT.finditer(" " + text))
                parts = [self._stretch(units) for units in iter(lambda: list(islice(found, UNITS)), [])]
                good = not any(p[4].any() for p in parts)
                yield tuple(np.concatenate([p[side] for p in parts]) if good else np.zeros(0, "<u4") for side in (0, 1))
        yield from self._several(held)

    def _several(self, held: list[list[str]]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        if not held:
            return
        a, b, a_counts, b_counts, wrong = self._stretch(list(chain.from_iterable(held)))
        ends = np.r_[0, np.cumsum(list(map(len, held)))]
        a_at, b_at, bad = (np.r_[0, np.cumsum(x)][ends].tolist() for x in (a_counts, b_counts, wrong))
        for i in range(len(held)):
            good = bad[i] == bad[i + 1]
            yield (a[a_at[i] : a_at[i + 1]], b[b_at[i] : b_at[i + 1]]) if good else (a[:0], b[:0])

    def lengths(self) -> tuple[np.ndarray, np.ndarray]:
        return np.array(list(map(len, self.a_bytes)), np.int64), np.array(list(map(len, self.b_bytes)), np.int64)


def gallop(short: np.ndarray, long: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each value of the ascending list ``short``: how many values of ``long`` are smaller, and whether it is in ``long``.

    Every value starts from the rank of the first of its ``STRIDE`` neighbours, found in the same way, doubles its step until it
    has passed the value, and halves the range left. All values still on their way move together.
    """
    n, end = len(short), len(long)
    if not n or not end:
        return np.zeros(n, np.int64), np.zeros(n, bool)
    low = np.zeros(n, np.int64) if n <= STRIDE else np.repeat(gallop(short[::STRIDE], long)[0], STRIDE)[:n]
    high, going, value, at, step = low.copy(), np.arange(n), short, low, 1
    while len(going):  # exponential: all before ``at`` are smaller
        probe = at + step - 1
        smaller = (probe < end) & (long[np.minimum(probe, end - 1)] < value)
        stop = ~smaller
        low[going[stop]], high[going[stop]] = at[stop], np.minimum(probe[stop], end)
        going, value, at, step = going[smaller], value[smaller], probe[smaller] + 1, step * 2
    going = np.flatnonzero(low < high)
    value, at, to = short[going], low[going], high[going]
    while len(going):  # binary, between the last two steps
        middle = (at + to) >> 1
        smaller = long[middle] < value
        at, to = np.where(smaller, middle + 1, at), np.where(smaller, to, middle)
        low[going] = at
        open_ = at < to
        going, value, at, to = going[open_], value[open_], at[open_], to[open_]
    return low, (low < end) & (long[np.minimum(low, end - 1)] == short)


class Names:
    """Decimal ids with the mark behind them: row 0 inside a group, row 1 at its end."""

    def __init__(self, a: int, b: int):
        self.a = np.array([[f"{i}{mark}" for i in range(a)] for mark in ",|"], object)
        self.b = np.array([[f"{i}{mark}" for i in range(b)] for mark in ",;"], object)


class Aligned:
    """The groups and links of texts, given the end offsets of their tokens. Texts stand one after the other: where one ends, both
    lists have an end, so they are aligned in one go."""

    def __init__(self, a_ends: np.ndarray, b_ends: np.ndarray):
        self.swapped = len(b_ends) < len(a_ends)
        short, long = (b_ends, a_ends) if self.swapped else (a_ends, b_ends)
        self.ranks, self.found = gallop(short, long)
        own = np.flatnonzero(self.found)
        cuts = (own + 1, self.ranks[own] + 1)
        # Tokens of each side up to the end of each group.
        self.a_cuts, self.b_cuts = cuts[::-1] if self.swapped else cuts

    def pieces(self, limit: int = TOKENS) -> Iterator[tuple[int, int]]:
        """Ranges of groups of about ``limit`` tokens of both sides (at least one group each)."""
        total = self.a_cuts + self.b_cuts
        start = 0
        while start < len(total):
            end = max(start + 1, int(np.searchsorted(total, (total[start - 1] if start else 0) + limit)))
            yield start, end
            start = end

    def tokens(self, start: int, end: int) -> tuple[int, int, int, int]:
        """First and last token, exclusive, of both sides in the groups from ``start`` to ``end``."""
        a, b = (int(c[start - 1]) if start else 0 for c in (self.a_cuts, self.b_cuts))
        return a, int(self.a_cuts[end - 1]), b, int(self.b_cuts[end - 1])

    def links(self, start: int, end: int) -> tuple[np.ndarray, np.ndarray]:
        """Positions of the tokens of each A-B pair that overlaps in these groups; ascending on both sides."""
        a, a_end, b, b_end = self.tokens(start, end)
        low, high, other = (b, b_end, a) if self.swapped else (a, a_end, b)
        # A token begins where the one before ends: at the longer list's tokens that end by then.
        first = np.r_[other, (self.ranks + self.found)[low : high - 1]]
        counts = self.ranks[low:high] - first + 1
        own = np.repeat(np.arange(len(counts)), counts)
        far = np.arange(len(own)) - np.repeat(np.cumsum(counts) - counts, counts) + first[own]
        return (far, own + low) if self.swapped else (own + low, far)

    def spelled(self, start: int, end: int, a: np.ndarray, b: np.ndarray, names: Names) -> np.ndarray:
        """`a1,` `a2|` `b1;` ...: the ids in these groups as strings, each with the mark behind it; in the order in which they are
        written, group by group, A before B."""
        a0, a1, b0, b1 = self.tokens(start, end)
        a_last, b_last = np.zeros(a1 - a0, np.int64), np.zeros(b1 - b0, np.int64)
        a_last[self.a_cuts[start:end] - 1 - a0] = 1
        b_last[self.b_cuts[start:end] - 1 - b0] = 1
        a_group, b_group = np.cumsum(a_last) - a_last, np.cumsum(b_last) - b_last
        out = np.empty(a1 - a0 + b1 - b0, object)
        out[np.arange(a1 - a0) + np.r_[0, self.b_cuts[start:end] - b0][a_group]] = names.a[a_last, a[a0:a1]]
        out[np.arange(b1 - b0) + (self.a_cuts[start:end] - a0)[b_group]] = names.b[b_last, b[b0:b1]]
        return out


def _pair(files: Broadcast) -> TokenPair:
    claim("words")
    kept = worker_cache("words")
    key = ("pair", *map(hash, files.value))
    if key not in kept:
        kept.clear()
        kept[key] = TokenPair(*files.value)
    return kept[key]


def token_pairs(df: DataFrame, text: str, byte_level: bytes, pieces: bytes) -> DataFrame:
    """(at, row, a, b): every row of ``df`` as a struct, a number of its own, and the ids of a space and its text by a
    byte-level tokenizer (a JSON file) and by a piece tokenizer (a model file that puts the space before by itself), as
    little-endian unsigned numbers of 16 bits (32 for a vocabulary beyond that). Special strings in texts are plain text. Null and empty texts, and texts that either
    side's tokens do not spell, have no ids. Rows may repeat; the result is written, so a row keeps its number.

    Long texts are tokenized unit by unit (about a word); only a single stretch without spaces is handled as a whole.
    """
    files = df.sparkSession.sparkContext.broadcast((byte_level, pieces))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = None
        for batch in batches:
            pair = pair or _pair(files)
            kinds = [dtype_for(len(x)) for x in (pair.a_bytes, pair.b_bytes)]
            for part in slices(batch, "_text"):
                coded = [[x.astype(k).tobytes() for x, k in zip(ids, kinds)] for ids in pair.encode(texts_of(part, "_text"))]
                arrays = [pa.array([c[i] for c in coded], pa.binary()) for i in (0, 1)]
                yield pa.RecordBatch.from_arrays([part.column(0), *arrays], names=["row", "a", "b"])

    small_batches(df.sparkSession)
    keep = df.drop(text) if len(df.columns) > 1 else df
    slim = df.select(F.struct(*[df[c] for c in keep.columns]).alias("row"), F.col(text).alias("_text"))
    kind = slim.schema["row"].dataType.simpleString()
    coded = slim.mapInArrow(run, f"row {kind}, a binary, b binary")
    return stored(coded.withColumn("at", F.monotonically_increasing_id()), "token_pairs")


def _lengths(spark, byte_level: bytes, pieces: bytes) -> Broadcast:
    return spark.sparkContext.broadcast(TokenPair(byte_level, pieces).lengths())


class Texts:
    """The tokens of a batch of texts, one text after the other, aligned."""

    def __init__(self, batch, lengths: tuple[np.ndarray, np.ndarray]):
        ids, ends, self.counts = [], [], []
        for name, length in zip("ab", lengths):
            kind = np.dtype(dtype_for(len(length)))
            raw = batch.column(name).to_pylist()
            ids.append(np.frombuffer(b"".join(raw), kind))
            ends.append(np.cumsum(length[ids[-1]]))
            self.counts.append(np.fromiter(map(len, raw), np.int64, len(raw)) // kind.itemsize)
        self.a, self.b = ids
        self.aligned = Aligned(*ends)

    def pieces(self) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """Ranges of groups, with the position of the A token of each link and its id pair as a * 2^32 + b."""
        for start, end in self.aligned.pieces():
            i, j = self.aligned.links(start, end)
            yield start, end, i, self.a[i].astype(np.int64) << 32 | self.b[j].astype(np.int64)


def pair_counts(tokens: DataFrame, lengths: Broadcast) -> DataFrame:
    """(pair, n, best): how many links of all texts join an id pair, and whether no other pair of its B id has more. Counts are
    added up in each task before they travel."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim()
        held: list[tuple[np.ndarray, np.ndarray]] = []
        waiting = 0

        def merged():
            at, pairs = pd.factorize(np.concatenate([k for k, _ in held]))
            return pairs, np.bincount(at, np.concatenate([n for _, n in held]), len(pairs)).astype(np.int64)

        for batch in batches:
            for _, _, _, keys in Texts(batch, lengths.value).pieces():
                at, pairs = pd.factorize(keys)
                held.append((pairs, np.bincount(at, minlength=len(pairs))))
                waiting += len(pairs)
                if waiting > 1 << 20:
                    held = [merged()]
                    waiting = len(held[0][0])
                    if waiting > 1 << 19:
                        yield pa.RecordBatch.from_arrays([pa.array(x) for x in held[0]], names=["pair", "n"])
                        held, waiting = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in merged()], names=["pair", "n"])

    counted = tokens.select("a", "b").mapInArrow(run, "pair bigint, n bigint")
    pairs = stored(counted.groupBy("pair").agg(F.sum("n").alias("n")), "pairs")
    second = F.col("pair").bitwiseAND(F.lit(0xFFFFFFFF))
    # One row per id of the second vocabulary.
    highest = pairs.groupBy(second.alias("second")).agg(F.max("n").alias("top"))
    return stored(
        pairs.withColumn("second", second).join(F.broadcast(highest), "second").select("pair", "n", (F.col("n") == F.col("top")).alias("best")),
        "pair_counts",
    )


def _frequent(pairs: DataFrame, limit: int) -> int:
    """The smallest power of two such that at most ``limit`` pairs have a count that high."""
    level = F.floor(F.log2("n") + 1e-9).cast("int")
    total = 0
    for row in sorted(pairs.groupBy(level.alias("level")).count().collect(), reverse=True):  # one row per power of two
        total += row["count"]
        if total > limit:
            return 1 << (row["level"] + 1)
    return 1


def align_tokenizers(
    df: DataFrame, text: str, byte_level: bytes, pieces: bytes, broadcast_pairs: int = BROADCAST_PAIRS, digest: bool = False
) -> DataFrame:
    """Per row: ``row`` (the other columns as a struct, so no names clash), n_a, n_b, n_groups, n_links, n_best, count_sum, groups.

    Groups are cut at byte offsets where tokens of both sides end; ``groups`` spells their ids (`a1,a2|b1;a3|b2,b3`). A link is a
    pair of tokens whose byte ranges overlap; the count of an id pair is the number of links of all texts that join it.
    count_sum adds the counts over a text's links, n_best counts the links whose pair has the highest count of its B id, ties
    included. Texts without tokens (null, empty, not spelled by either side) give zeros and an empty string. Rows that repeat
    count each time; an empty table gives an empty result. With ``digest``, groups_sha256 (lowercase hex; an empty string stays
    one) takes the place of ``groups``, which is several times as long as the text.

    Texts are tokenized once. The counts of the most frequent pairs (at most ``broadcast_pairs``) are looked up in the tasks; a
    text's other pairs, none of which is frequent, are joined by shuffle.
    """
    spark = df.sparkSession
    tokens = token_pairs(df, text, byte_level, pieces)
    lengths = _lengths(spark, byte_level, pieces)
    pairs = pair_counts(tokens, lengths)
    border = _frequent(pairs, broadcast_pairs)
    frequent = pairs.where(F.col("n") >= border).toArrow().sort_by("pair")
    table = spark.sparkContext.broadcast(
        (frequent["pair"].to_numpy(), frequent["n"].to_numpy(), frequent["best"].to_numpy().astype(bool))
    )
    counts = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")
    name = "groups_sha256" if digest else "groups"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim()
        known, sums, best = table.value
        names = Names(*map(len, lengths.value))
        pair_type = pa.list_(pa.struct([("pair", pa.int64()), ("times", pa.int64())]))
        for batch in batches:
            texts = Texts(batch, lengths.value)
            a_at, b_at = (np.r_[0, np.cumsum(c)] for c in texts.counts)
            n = len(texts.counts[0])
            numbers = np.zeros((3, n), np.int64)  # links, best ones, sum of counts
            spelled: list[list[str]] = [[] for _ in range(n)]
            hashes = [hashlib.sha256() for _ in range(n)] if digest else None
            groups = np.zeros(n, np.int64)
            others: list[list[dict]] = [[] for _ in range(n)]
            for start, end, i, keys in texts.pieces():
                at, pairs = pd.factorize(keys)
                place = np.minimum(np.searchsorted(known, pairs), max(0, len(known) - 1))
                hit = known[place] == pairs if len(known) else np.zeros(len(pairs), bool)
                value = np.where(hit, sums[place], 0) if len(known) else np.zeros(len(pairs), np.int64)
                top = hit & best[place] if len(known) else hit
                doc = np.searchsorted(a_at, i, "right") - 1
                first = np.flatnonzero(np.diff(doc, prepend=-1))  # links stand text by text
                for row, values in enumerate((np.ones(len(at), np.int64), top[at].astype(np.int64), value[at])):
                    numbers[row, doc[first]] += np.add.reduceat(values, first)
                if not hit.all():
                    rare = ~hit[at]
                    apart, times = np.unique(np.stack([doc[rare], keys[rare]]), axis=1, return_counts=True)
                    for d, p, t in zip(*apart.tolist(), times.tolist()):
                        others[d].append({"pair": p, "times": t})
                words = texts.aligned.spelled(start, end, texts.a, texts.b, names)
                a0, _, b0, _ = texts.aligned.tokens(start, end)
                own = np.searchsorted(a_at, texts.aligned.a_cuts[start:end] - 1, "right") - 1
                np.add.at(groups, own, 1)
                for d in np.unique(own).tolist():
                    low = max(0, int(a_at[d]) - a0) + max(0, int(b_at[d]) - b0)
                    high = min(len(words), int(a_at[d + 1]) - a0 + int(b_at[d + 1]) - b0)
                    text = "".join(words[low:high].tolist())
                    if digest:  # the mark behind the last group is not part of it
                        hashes[d].update((text if groups[d] and high < int(a_at[d + 1]) - a0 + int(b_at[d + 1]) - b0 else text[:-1]).encode())
                    else:
                        spelled[d].append(text)
            has = texts.counts[0] > 0
            last = [h.hexdigest() if x else "" for h, x in zip(hashes, has)] if digest else ["".join(x)[:-1] for x in spelled]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("at"), batch.column("row"), *[pa.array(c) for c in (*texts.counts, groups, *numbers)],
                    pa.array(last, pa.string()), pa.array(others, pair_type),
                ],
                names=["at", "row", *counts, name, "rest"],
            )

    kind = tokens.schema["row"].dataType.simpleString()
    schema = f"at bigint, row {kind}, {', '.join(f'{c} bigint' for c in counts)}, {name} string, rest array<struct<pair:bigint,times:bigint>>"
    out = tokens.select("at", "row", "a", "b").mapInArrow(run, schema)
    if border == 1:
        return out.drop("at", "rest")
    out = stored(out, "aligned")
    rare = pairs.where(F.col("n") < border)
    added = (
        out.select("at", F.explode("rest").alias("x"))
        .select("at", "x.pair", "x.times")
        .join(rare, "pair")
        .groupBy("at")
        .agg(
            F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("more_best"),
            F.sum(F.col("times") * F.col("n")).alias("more_sum"),
        )
    )
    return (
        out.drop("rest")
        .join(added, "at", "left")
        .withColumn("n_best", F.col("n_best") + F.coalesce("more_best", F.lit(0)))
        .withColumn("count_sum", F.col("count_sum") + F.coalesce("more_sum", F.lit(0)))
        .drop("at", "more_best", "more_sum")
    )

