"""Benchmark decontamination with a positional inverted index, in DataFrame operations only.

1. Windows of the test items are cut; of every window the rarest terms are chosen by their counts in the corpus.
2. The corpus is read once more, and the postings of those terms are stored: (document, term, position).
3. The lists of a window are intersected after subtracting each term's offset: a place is left if all of them meet there.
4. What is left, and nothing else, is compared with the text word by word. Documents without such a place are dropped by a
   Bloom filter where the corpus is scanned.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from evalweave.llm.common import ascii_lower, stored
from evalweave.operators.bloom import bloom_filter

# A-Z have been lower-cased before; everything above 7F belongs to words.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

# Terms that the pass over the corpus looks up in a broadcast table; more of them meet what a Bloom filter lets through by shuffle.
TERMS_PER_PASS = 200_000

# Windows of the test items up to which they are broadcast (a window is a few hundred bytes).
BROADCAST_WINDOWS = 200_000

# Shares into which the rows of a term are dealt where they meet a table that is too large to broadcast.
SHARES = 32


def with_words(df: DataFrame, text: str, *keep: Column) -> DataFrame:
    """The columns of ``keep`` and ``w``, the words of the text, A-Z lower-cased; null and blank texts have none."""
    names = df.select(*keep).columns
    cut = df.select(*keep, F.split(F.coalesce(ascii_lower(F.col(text)), F.lit("")), SEPARATORS).alias("_parts"))
    # Only the first and the last part can be empty.
    head = F.when(F.element_at("_parts", 1) == "", 1).otherwise(0)
    tail = F.when((F.size("_parts") > 1) & (F.element_at("_parts", -1) == ""), 1).otherwise(0)
    ends = cut.withColumns({"_head": head, "_tail": tail})
    inner = F.slice("_parts", F.col("_head") + 1, F.size("_parts") - F.col("_head") - F.col("_tail"))
    return ends.select(*names, F.when(F.col("_head") + F.col("_tail") > 0, inner).otherwise(F.col("_parts")).alias("w"))


def item_windows(items: DataFrame, item_id: str, text: str, n: int) -> DataFrame:
    """(win, item_id, terms): every run of n words of an item; an item of fewer words, but not none, is one run.

    Equal word sequences of different items are separate rows with the same ``win`` (a hash of the sequence).
    """
    runs = (
        with_words(items, text, F.col(item_id).alias("item_id"))
        .where(F.size("w") > 0)
        .select(
            "item_id",
            F.explode(
                F.transform(
                    F.sequence(F.lit(1), F.greatest(F.size("w") - (n - 1), F.lit(1))),
                    lambda i: F.slice("w", i, F.least(F.lit(n), F.size("w"))),
                )
            ).alias("terms"),
        )
    )
    return runs.select(F.xxhash64("terms").alias("win"), "item_id", "terms").distinct()


def _small(df: DataFrame, rows: int, limit: int) -> DataFrame:
    """Broadcast only what has been counted."""
    return F.broadcast(df) if rows <= limit else df


def _by_term(rows: DataFrame, right: DataFrame, size: int, limit: int, how: str = "inner") -> DataFrame:
    """Join on ``term``; ``rows`` has ``pos``. One term may hold much of the rows, so a right side of more than ``limit`` rows is
    repeated for each share of them."""
    if size <= limit:
        return rows.join(F.broadcast(right), "term", how)
    repeated = right.withColumn("_share", F.explode(F.sequence(F.lit(0), F.lit(SHARES - 1))))
    return rows.withColumn("_share", F.pmod("pos", F.lit(SHARES))).join(repeated, ["term", "_share"], how).drop("_share")


def term_counts(docs_words: DataFrame, vocabulary: DataFrame, size: int) -> DataFrame:
    """(term, n): how often each vocabulary term occurs in the corpus; absent terms are left out."""
    # explode() would add a filter on the size of the array, which evaluates the splitting again below the projection.
    words = docs_words.select(F.explode_outer("w").alias("term"))
    if size <= BROADCAST_WINDOWS:
        words = words.join(F.broadcast(vocabulary), "term", "left_semi")
    counts = words.groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    return counts if size <= BROADCAST_WINDOWS else counts.join(vocabulary, "term", "left_semi")


def rarest_terms(windows: DataFrame, counts: DataFrame, keep: int) -> DataFrame:
    """(win, len, rank, ranks, term, offset): the ``keep`` rarest different terms of each window, rank 1 the rarest.

    Windows with a term that the corpus lacks cannot occur and are left out.
    """
    spelled = windows.select("win", "terms").distinct()
    placed = spelled.select("win", F.size("terms").alias("len"), F.posexplode("terms").alias("offset", "term"))
    known = placed.join(counts, "term")
    whole = known.groupBy("win", "len").agg(F.count(F.lit(1)).alias("have")).where("have = len").select("win")
    firsts = known.groupBy("win", "len", "term", "n").agg(F.min("offset").alias("offset"))
    in_window = Window.partitionBy("win")
    ranked = firsts.withColumn("rank", F.row_number().over(in_window.orderBy("n", "term"))).where(F.col("rank") <= keep)
    return (
        ranked.withColumn("ranks", F.max("rank").over(in_window))
        .join(whole, "win", "left_semi")
        .select("win", "len", "rank", "ranks", "term", "offset")
    )


def _postings(docs: DataFrame, key: str, text: str, terms: DataFrame, size: int) -> DataFrame:
    """(key, pos, term) of every occurrence of ``terms`` (distinct) in the corpus, by one pass over it."""
    words = with_words(docs, text, F.col(key)).select(key, F.posexplode_outer("w").alias("pos", "term"))
    if size > TERMS_PER_PASS:
        possible = bloom_filter(terms.select(F.xxhash64("term").alias("h")), "h", size)
        words = words.where(possible(F.xxhash64("term")))
    return _by_term(words, terms, size, TERMS_PER_PASS, "left_semi")


class PhraseIndex:
    """Postings of the rarest test terms over a corpus, stored in the shared folder.

    ``documents``: one row per document with ``n_words``; rows of the corpus are told apart by ``key``, which must be
    unique. ``postings``: (key, pos, term). ``keep`` rarest terms of a window are indexed. Null texts have no words; an empty
    corpus or an empty list of items gives no matches. Other columns are not read.
    """

    def __init__(self, docs: DataFrame, key: str, text: str, items: DataFrame, item_id: str, item_text: str, n: int = 13, keep: int = 2):
        self.key, self.text, self.docs = key, text, docs.select(key, text)
        self.windows = stored(item_windows(items, item_id, item_text, n), "windows")
        self.n_windows = self.windows.count()
        vocabulary = stored(self.windows.select(F.explode("terms").alias("term")).distinct(), "vocabulary")
        counts = stored(term_counts(with_words(docs, text), vocabulary, vocabulary.count()), "counts")
        self.rarest = stored(rarest_terms(self.windows, counts, keep), "rarest")
        self.n_rarest = self.rarest.count()
        terms = stored(self.rarest.select("term").distinct(), "terms")
        self.postings = stored(_postings(docs, key, text, terms, terms.count()), "postings")
        self.documents = with_words(docs, text, F.col(key)).select(key, F.size("w").alias("n_words"))

    def lists(self) -> DataFrame:
        """(key, win, len, rank, ranks, start): the postings of each window's terms, less the offset of the term."""
        met = _by_term(self.postings, self.rarest, self.n_rarest, BROADCAST_WINDOWS)
        return met.select(self.key, "win", "len", "rank", "ranks", (F.col("pos") - F.col("offset")).alias("start"))

    def meetings(self) -> DataFrame:
        """(key, win, len, start): places where the lists of all rarest terms of a window meet."""
        return (
            self.lists()
            .where("start >= 0")
            .groupBy(self.key, "win", "len", "start", "ranks")
            .agg(F.count_distinct("rank").alias("have"))
            .where("have = ranks")
            .select(self.key, "win", "len", "start")
        )

    def phrases(self) -> DataFrame:
        """(key, win, start, len): every exact occurrence of a window, once."""
        # A document's list has no more places than the document has words, for each window that shares its rare terms.
        met = stored(self.meetings().groupBy(self.key).agg(F.collect_list(F.struct("win", "len", "start")).alias("_met")), "meetings")
        possible = bloom_filter(met.select(F.xxhash64(self.key).alias("h")), "h", met.count())
        near = self.docs.where(possible(F.xxhash64(self.key))).join(met, self.key)
        w = F.col("w")
        spelled = F.transform(
            "_met",
            lambda m: F.struct(
                m["win"].alias("win"),
                m["start"].alias("start"),
                F.when(m["start"] + m["len"] <= F.size(w), F.slice(w, m["start"] + 1, m["len"])).alias("terms"),
            ),
        )
        places = with_words(near, self.text, F.col(self.key), F.col("_met")).select(self.key, F.explode(spelled).alias("m")).select(self.key, "m.*")
        windows = _small(self.windows.select("win", "terms").distinct(), self.n_windows, BROADCAST_WINDOWS)
        return places.join(windows, ["win", "terms"]).select(self.key, "win", "start", F.size("terms").alias("len")).distinct()

    def proximity(self, slop: int) -> DataFrame:
        """(key, win, start, spread): places where the rarest terms of a window all stand within ``slop`` words of
        their place in it, one row per place of the rarest term; ``spread`` is the largest shift."""
        lists = self.lists().select(self.key, "win", "rank", "start")
        first = lists.where("rank = 1").select(self.key, "win", "start")
        # Terms are looked for in blocks of slop + 1 starts and the blocks beside them, so a document's list is not
        # paired with itself as a whole.
        width = slop + 1
        near = first.withColumn(
            "block", F.explode(F.array(*[F.floor(F.col("start") / width) + d for d in (-1, 0, 1)]))
        )
        others = lists.withColumnRenamed("start", "at").withColumn("block", F.floor(F.col("at") / width))
        needed = self.rarest.select("win", "ranks").distinct()
        return (
            near.join(others, [self.key, "win", "block"])
            .withColumn("shift", F.abs(F.col("at") - F.col("start")))
            .where(F.col("shift") <= slop)
            .groupBy(self.key, "win", "start", "rank")
            .agg(F.min("shift").alias("shift"))
            .groupBy(self.key, "win", "start")
            .agg(F.count(F.lit(1)).alias("have"), F.max("shift").alias("spread"))
            .join(_small(needed, self.n_windows, BROADCAST_WINDOWS), "win")
            .where("have = ranks")
            .select(self.key, "win", "start", "spread")
        )


def contamination(
    docs: DataFrame, key: str, text: str, items: DataFrame, item_id: str, item_text: str, n: int = 13, keep: int = 2
) -> DataFrame:
    """(key, n_words, n_hit, item_ids): of every document the words inside any occurrence of a window, and the items
    whose windows occur in it (sorted as strings; empty if none).

    A document without words, a null text and an empty benchmark give 0 hits. ``key`` must be unique; repeated texts are
    counted one by one. Items with equal windows are all listed. A null item id is left out of the list.
    """
    index = PhraseIndex(docs, key, text, items, item_id, item_text, n, keep)
    spots = stored(index.phrases(), "phrases")
    # Lists are bounded by the words of one document and by the items.
    covered = (
        spots.groupBy(key)
        .agg(F.sort_array(F.collect_set(F.struct("start", (F.col("start") + F.col("len")).alias("end")))).alias("s"))
        .select(
            key,
            F.aggregate(
                "s",
                F.struct(F.lit(0).alias("n"), F.lit(0).alias("to")),
                lambda a, x: F.struct(
                    (a["n"] + F.greatest(x["end"] - F.greatest(x["start"], a["to"]), F.lit(0))).alias("n"),
                    F.greatest(x["end"], a["to"]).alias("to"),
                ),
                lambda a: a["n"],
            ).alias("n_hit"),
        )
    )
    named = (
        spots.select(key, "win")
        .distinct()
        .join(_small(index.windows.select("win", "item_id"), index.n_windows, BROADCAST_WINDOWS), "win")
        .groupBy(key)
        .agg(F.sort_array(F.collect_set(F.col("item_id").cast("string"))).alias("item_ids"))
    )
    return (
        index.documents.join(covered, key, "left")
        .join(named, key, "left")
        .select(
            key,
            F.col("n_words").cast("bigint").alias("n_words"),
            F.coalesce("n_hit", F.lit(0)).cast("bigint").alias("n_hit"),
            F.coalesce("item_ids", F.array().cast("array<string>")).alias("item_ids"),
        )
    )
