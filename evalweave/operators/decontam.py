"""Word n-gram contamination: index, detect, remove, report, clean."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from evalweave.functions import text as T
from evalweave.functions.arrays import let, total
from evalweave.functions.hashing import gram_hasher, text_slices
from evalweave.operators.bloom import bloom_filter
from evalweave.operators.broadcasts import BROADCAST_ROWS, fits_broadcast, ngrams_fit, spread
from evalweave.session import cut_lineage

# Bytes of text that are hashed at a time.
HASH_BYTES = 1 << 20
# Hashes that a task gathers before it counts and hands them on, and bytes of text whose hashes share a bucket.
HASHES_GATHERED = 1 << 21
BUCKET_BYTES = 8 << 20
# Bits of the map of frequent hashes, as powers of two: at most 16 MB, and of a bucket's part of it. With more such hashes it
# loses force, never one of them.
MAP_BITS, BUCKET_MAP_BITS = 27, 22
# Distinct strings that a task counts before it hands them on.
STRINGS_GATHERED = 200_000


def normalized_ngrams(text: Column, n: int) -> Column:
    """Distinct n-grams of the lower-cased, whitespace-normalised text."""
    return F.array_distinct(T.ngrams(T.words(F.lower(text)), n))


def folded_ngrams(text: Column, n: int) -> Column:
    """Distinct n-grams of the text without ASCII upper case and punctuation."""
    return F.array_distinct(T.ngrams(T.words(T.ascii_fold(text)), n))


def ngram_rows(df: DataFrame, id_col: str, text: Column, n: int, grams=normalized_ngrams) -> DataFrame:
    """One row per (id, distinct n-gram). Null text gives no rows."""
    return spread(df, id_col).select(F.col(id_col), F.explode(grams(text, n)).alias("ngram"))


def build_ngram_index(df: DataFrame, id_col: str, text: Column, n: int) -> DataFrame:
    """Long index (ngram, id). Distinct per row already, so no shuffle as ids are unique."""
    return ngram_rows(df, id_col, text, n).select("ngram", id_col)


def _small(rows: DataFrame) -> DataFrame:
    """Rows of an expensive query, written once and broadcast if they turn out to be few."""
    written = cut_lineage(rows)
    return F.broadcast(written) if fits_broadcast(written) else written


def postings(corpus: DataFrame, id_col: str, tokens: Column, n: int, keys: DataFrame) -> DataFrame:
    """(id, pos, h): hash and position of the corpus n-grams whose hash is among those of ``keys`` (column ``h``, distinct).

    A Bloom filter of the keys is probed where the corpus is scanned. Only what passes it, 24 bytes for each hit and for about
    one in a hundred other n-grams, is shuffled to meet the keys.
    """
    keys = cut_lineage(keys)
    n_keys = keys.count()
    possible = bloom_filter(keys, "h", n_keys)
    rows = spread(corpus, id_col).select(F.col(id_col), F.posexplode(T.ngram_hashes(tokens, n)).alias("pos", "h"))
    passed = rows.where(possible(F.col("h")))
    return passed.join(F.broadcast(keys) if fits_broadcast(keys) else keys, "h", "left_semi")




def _scan_hits(corpus: DataFrame, id_col: str, text: Column, n: int, ngrams: DataFrame, fold: bool) -> DataFrame:
    """(id, ngram) of every row's distinct n-grams whose hash is among those of ``ngrams``, which are few and sent to the scan."""
    hasher, slices = gram_hasher(n, fold), text_slices(HASH_BYTES)
    plain, id_type = gram_hasher(n), corpus.schema[id_col].dataType.simpleString()

    def hashes(batches):
        import pyarrow as pa

        for batch in batches:
            found = plain(batch.column(0).to_pylist())[1].view("int64")
            yield pa.RecordBatch.from_arrays([pa.array(found)], names=["h"])

    keys = [r.h for r in ngrams.select("ngram").mapInArrow(hashes, "h bigint").collect()]
    shared = corpus.sparkSession.sparkContext.broadcast(keys)

    def run(batches):
        import numpy as np
        import pyarrow as pa

        wanted = np.unique(np.array(shared.value, np.int64).view(np.uint64))
        # The first 20 bits of a hash rule out most.
        first = np.zeros(1 << 20, bool)
        first[wanted >> np.uint64(44)] = True
        for batch in batches:
            for part in slices(batch, 1):
                words, h, row, place = hasher([t or "" for t in part.column(1).to_pylist()])
                near = np.flatnonzero(first[h >> np.uint64(44)])
                near = near[np.isin(h[near], wanted)]
                pairs = {(r, " ".join(words[r][p : p + n])): None for r, p in zip(row[near].tolist(), place[near].tolist())}
                if pairs:
                    rows, grams = zip(*pairs)
                    yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(rows)), pa.array(grams)], names=["id", "ngram"])

    rows = spread(corpus, id_col).select(F.col(id_col).alias("id"), text.alias("text"))
    return rows.mapInArrow(run, f"id {id_type}, ngram string").withColumnRenamed("id", id_col)


def corpus_hits(
    corpus: DataFrame, id_col: str, text: Column, n: int, ngrams: DataFrame, small: bool, fold: bool = False
) -> DataFrame:
    """(id, ngram) of the corpus n-grams that are among ``ngrams`` (distinct), once for each row and n-gram; ids are unique.

    Texts are lower-cased, or folded as by ``folded_ngrams``. ``small`` n-grams are broadcast to the scan, first by hash: strings
    are built only where one meets. Others meet the corpus by hash and position, and strings are built again, from
    the text, only at positions with a hit; comparing these settles hash collisions.
    """
    if small:
        rows = _scan_hits(corpus, id_col, text if fold else F.lower(text), n, ngrams, fold)
        return rows.join(F.broadcast(ngrams), "ngram", "left_semi").select(id_col, "ngram")
    tokens = T.words(T.ascii_fold(text) if fold else F.lower(text))
    hits = postings(corpus, id_col, tokens, n, ngrams.select(T.ngram_hash(F.col("ngram")).alias("h")).distinct())
    places = _small(hits.groupBy(id_col).agg(F.collect_list("pos").alias("_places")))

    def strings(words: Column) -> Column:
        return F.array_distinct(F.transform("_places", lambda p: F.array_join(F.slice(words, p + 1, F.lit(n)), " ")))

    spelled = corpus.join(places, id_col).select(F.col(id_col), F.explode(let(tokens, strings)).alias("ngram"))
    return spelled.join(ngrams, "ngram", "left_semi").select(id_col, "ngram")


def find_contaminated(
    train: DataFrame,
    bench: DataFrame,
    id_col: str,
    text: Column,
    bench_text: Column,
    n: int = 20,
    broadcast_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """Ids of training rows that share an n-gram with the benchmark.

    A benchmark index that fits, in rows and bytes, is broadcast and the corpus is read once without a shuffle. A larger one is
    met by hash behind a Bloom filter (see ``postings``), and only the candidates are compared by string.
    """
    dirty = bench.select(F.explode(normalized_ngrams(bench_text, n)).alias("ngram")).distinct()
    small = ngrams_fit(bench, T.words(F.lower(bench_text)), n, broadcast_rows)
    return corpus_hits(train, id_col, text, n, dirty, small).select(id_col).distinct()


def decontaminate(train: DataFrame, contaminated_ids: DataFrame, id_col: str) -> DataFrame:
    """Training rows whose id is not contaminated.

    The ids are written once, so their size can be checked without a second scan of the corpus.
    """
    return train.join(_small(contaminated_ids.select(id_col)), id_col, "left_anti")


def _shared(
    train: DataFrame, bench: DataFrame, id_col: str, text: Column, bench_id: str, bench_text: Column, n: int, rows: int
):
    """Train and benchmark index rows restricted to the n-grams both sides have."""
    bench_index = build_ngram_index(bench, bench_id, bench_text, n)
    small = ngrams_fit(bench, T.words(F.lower(bench_text)), n, rows)
    keys = bench_index.select("ngram").distinct()
    return corpus_hits(train, id_col, text, n, keys, small), bench_index


def overlap_report(
    train: DataFrame,
    bench: DataFrame,
    id_col: str,
    text: Column,
    bench_id: str,
    bench_text: Column,
    n: int,
    part_size: int = 10_000,
    broadcast_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """Per shared n-gram the benchmark and training ids, as sorted lists.

    An n-gram with more than ``part_size`` ids is dealt into parts by a hash of the id,
    so one found in a large share of the corpus gives more rows instead of one huge
    list. Only such n-grams need a second look; all others are one row.
    """
    train_hits, bench_index = _shared(train, bench, id_col, text, bench_id, bench_text, n, broadcast_rows)
    # The hits are read several times below (shared n-grams, sample, count, numbering); the corpus scan runs once.
    train_hits = cut_lineage(train_hits)
    shared = train_hits.select("ngram").distinct()
    sides = train_hits.select("ngram", F.lit("train").alias("side"), F.col(id_col).alias("id")).unionByName(
        bench_index.join(shared, "ngram", "left_semi").select(
            "ngram", F.lit("test").alias("side"), F.col(bench_id).alias("id")
        )
    )
    many = sides.groupBy("ngram").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > part_size)
    parts = many.select("ngram", F.ceil(2 * F.col("_n") / part_size).alias("_parts"))  # half full on average
    dealt = sides.join(_small(parts), "ngram", "left").withColumn(
        "part", F.when(F.col("_parts").isNull(), 0).otherwise(F.pmod(F.xxhash64("id"), F.col("_parts")))
    )

    def ids(side: str) -> Column:
        listed = F.sort_array(F.collect_list(F.when(F.col("side") == side, F.col("id"))))
        return F.when(F.size(listed) > 0, listed).alias(f"{side}_doc_ids")

    return dealt.groupBy("ngram", F.col("part").cast("bigint").alias("part")).agg(ids("test"), ids("train"))


def contamination_summary(
    train: DataFrame,
    bench: DataFrame,
    id_col: str,
    text: Column,
    bench_id: str,
    bench_text: Column,
    n: int,
    broadcast_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """One row: training rows, contaminated rows, matched n-grams."""
    hits, _ = _shared(train, bench, id_col, text, bench_id, bench_text, n, broadcast_rows)
    # The corpus is scanned once; the hits are few and written, and each distinct count is an aggregation of its own over them.
    hits = cut_lineage(hits)
    ids = hits.select(id_col).distinct().agg(F.count(F.lit(1)))
    grams = hits.select("ngram").distinct().agg(F.count(F.lit(1)))
    total = train.agg(F.count(F.lit(1)).alias("original_rows"))
    return total.select("original_rows", ids.scalar().alias("contaminated_rows"), grams.scalar().alias("matched_ngrams"))


def ngram_doc_frequency(
    df: DataFrame, id_col: str, text: Column, n: int = 13, min_docs: int = 10, fold: bool = True
) -> DataFrame:
    """N-grams found in more than ``min_docs`` documents, with the document count.

    First pass: count documents per 64-bit hash of the n-gram; the hashes travel, packed, the strings do not. What is
    frequent becomes a map of bits of fixed size. Second pass: only n-grams that the map lets through are counted by
    string, which settles hash collisions and what else has the same bit.
    """
    text = text if fold else F.lower(text)
    counts, bits = hash_counts(df, id_col, text, n, fold, once=True)
    by_bucket, width = _by_bucket(), min(BUCKET_MAP_BITS, MAP_BITS - bits)
    hasher, slices, enough = gram_hasher(n, fold), text_slices(HASH_BYTES), STRINGS_GATHERED
    shift = 64 - bits - width

    def frequent(batches):
        import zlib

        import numpy as np
        import pyarrow as pa

        for bucket, h, c in by_bucket(batches):
            marked = np.zeros(1 << width, bool)
            marked[(h[c > min_docs] >> np.uint64(shift)).astype(np.int64) - (bucket << width)] = True
            if marked.any():
                packed = zlib.compress(np.packbits(marked, bitorder="little").tobytes(), 1)
                yield pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), pa.array([packed], pa.binary())], names=["bucket", "bits"])

    # 16 MB at most, whatever the data.
    shared = df.sparkSession.sparkContext.broadcast([tuple(r) for r in counts.mapInArrow(frequent, "bucket int, bits binary").collect()])

    def strings(batches):
        import zlib

        import numpy as np
        import pyarrow as pa

        marked = np.zeros((1 << bits, (1 << width) // 8), np.uint8)
        for bucket, packed in shared.value:
            marked[bucket] = np.frombuffer(zlib.decompress(bytes(packed)), np.uint8)
        marked = marked.ravel()
        counted = {}

        def done():
            out = pa.RecordBatch.from_arrays([pa.array(list(counted), pa.string()), pa.array(list(counted.values()), pa.int64())], names=["ngram", "c"])
            counted.clear()
            return out

        for batch in batches:
            for part in slices(batch, 0):
                words, h, row, place = hasher([t or "" for t in part.column(0).to_pylist()])
                at = (h >> np.uint64(shift)).astype(np.int64)
                kept = np.flatnonzero((marked[at >> 3] >> (at & 7).astype(np.uint8)) & 1)
                for _, gram in {(r, " ".join(words[r][p : p + n])) for r, p in zip(row[kept].tolist(), place[kept].tolist())}:
                    counted[gram] = counted.get(gram, 0) + 1
                if len(counted) >= enough:
                    yield done()
        if counted:
            yield done()

    rows = spread(df, id_col).select(text.alias("text")).mapInArrow(strings, "ngram string, c bigint")
    return rows.groupBy("ngram").agg(F.sum("c").alias("n_docs")).where(F.col("n_docs") > min_docs)


def train_overlap(
    corpus: DataFrame,
    corpus_id: str,
    corpus_text: Column,
    tasks: DataFrame,
    task_text: Column,
    n: int = 13,
    broadcast_rows: int = BROADCAST_ROWS,
) -> tuple[DataFrame, DataFrame]:
    """Which evaluation documents overlap the training corpus, per (task, set).

    ``tasks`` has the columns task, set, doc_id. Returns the contaminated
    (task, set, doc_id) rows and, per (task, set), how many distinct n-grams
    occur in the corpus and how many do not.
    """
    index = tasks.select("task", "set", "doc_id", F.explode(folded_ngrams(task_text, n)).alias("ngram"))
    keys = index.select("ngram").distinct()
    small = ngrams_fit(tasks, T.words(T.ascii_fold(task_text)), n, broadcast_rows)
    found = corpus_hits(corpus, corpus_id, corpus_text, n, keys, small, fold=True)
    matched = found.select("ngram").distinct().withColumn("hit", F.lit(True))
    tagged = index.join(matched, "ngram", "left")
    dirty = tagged.where("hit").select("task", "set", "doc_id").distinct()
    grams = tagged.groupBy("task", "set", "ngram").agg(F.max("hit").alias("hit"))
    counts = grams.groupBy("task", "set").agg(
        F.count("hit").alias("matching"), (F.count(F.lit(1)) - F.count("hit")).alias("non_matching")
    )
    return dirty, counts


def hash_counts(df: DataFrame, id_col: str, text: Column, n: int, fold: bool, once: bool) -> tuple[DataFrame, int]:
    """(bucket, hashes, counts) packed by ``bucket``, the first bits of a hash, and the number of those bits.

    Rows are sorted by bucket, each bucket within one partition. With ``once`` a row counts an n-gram once.
    """
    size = df.agg(F.sum(F.octet_length(text).cast("bigint"))).first()[0] or 0
    bits = min(MAP_BITS - 3, max(0, (size // BUCKET_BYTES).bit_length()))
    hasher, slices, enough = gram_hasher(n, fold), text_slices(HASH_BYTES), HASHES_GATHERED

    def run(batches):
        import numpy as np
        import pyarrow as pa

        def packed(parts):
            found, counts = np.unique(np.concatenate(parts), return_counts=True)
            bucket = (found >> np.uint64(64 - bits) if bits else np.zeros(len(found))).astype(np.int32)
            at = np.flatnonzero(np.diff(bucket, prepend=-1))
            raw, numbers = found.tobytes(), counts.astype("<u4").tobytes()
            ends = [*at[1:].tolist(), len(found)]
            return pa.RecordBatch.from_arrays(
                [
                    pa.array(bucket[at]),
                    pa.array([raw[8 * a : 8 * b] for a, b in zip(at.tolist(), ends)], pa.binary()),
                    pa.array([numbers[4 * a : 4 * b] for a, b in zip(at.tolist(), ends)], pa.binary()),
                ],
                names=["bucket", "hashes", "counts"],
            )

        parts, held = [], 0
        for batch in batches:
            for part in slices(batch, 0):
                _, h, row, _ = hasher([t or "" for t in part.column(0).to_pylist()])
                if once and len(h):
                    order = np.lexsort((h, row))
                    h, row = h[order], row[order]
                    h = h[np.concatenate([[True], (h[1:] != h[:-1]) | (row[1:] != row[:-1])])]
                parts.append(h)
                held += len(h)
                if held >= enough:
                    yield packed(parts)
                    parts, held = [], 0
        if held:
            yield packed(parts)

    rows = spread(df, id_col).select(text.alias("text")).mapInArrow(run, "bucket int, hashes binary, counts binary")
    return rows.repartition("bucket").sortWithinPartitions("bucket"), bits


def _by_bucket():
    """A function from batches of ``hash_counts`` to (bucket, hashes, counts), each hash once."""

    def run(batches):
        import numpy as np

        def summed():
            h, c = np.concatenate(hashes), np.concatenate(counts).astype(np.int64)
            order = np.argsort(h)
            h, c = h[order], c[order]
            at = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
            return this, h[at], np.add.reduceat(c, at)

        this, hashes, counts = None, [], []
        for batch in batches:
            for bucket, h, c in zip(*(column.to_pylist() for column in batch.columns)):
                if bucket != this:
                    if hashes:
                        yield summed()
                    this, hashes, counts = bucket, [], []
                hashes.append(np.frombuffer(h, "<u8"))
                counts.append(np.frombuffer(c, "<u4"))
        if hashes:
            yield summed()

    return run


def corpus_unique_counts(corpus: DataFrame, id_col: str, corpus_text: Column, n: int = 13) -> DataFrame:
    """Total and distinct n-grams of the corpus, by hash (12 bytes per distinct n-gram of a task travel, packed)."""
    counts, _ = hash_counts(corpus, id_col, corpus_text, n, fold=True, once=False)
    by_bucket = _by_bucket()

    def run(batches):
        import pyarrow as pa

        for _, h, c in by_bucket(batches):
            yield pa.RecordBatch.from_arrays([pa.array([int(c.sum())]), pa.array([len(h)])], names=["total", "unique"])

    return counts.mapInArrow(run, "total bigint, unique bigint").agg(
        F.sum("total").alias("total_ngrams"), F.coalesce(F.sum("unique"), F.lit(0)).cast("bigint").alias("unique_ngrams")
    )


# Spans that a task hands on at a time.
SPAN_ROWS = 20_000


def ngram_spans(df: DataFrame, id_col: str, text_col: str, n: int) -> DataFrame:
    """N-grams of the raw text with 0-based start and inclusive end character offsets."""

    id_type = df.schema[id_col].dataType.simpleString()
    names, at_most = ["id", "pos", "ngram", "start", "end"], SPAN_ROWS

    def run(batches):
        import re

        import numpy as np
        import pyarrow as pa

        word = re.compile(r"\S+")  # of a Python string: the same blanks as those of T.words
        for batch in batches:
            for row in range(batch.num_rows):
                text = batch.column(1)[row].as_py() or ""
                starts = np.fromiter((m.start() for m in word.finditer(text)), np.int64)
                tokens = text.split()
                lengths = np.fromiter(map(len, tokens), np.int64, len(tokens))
                ends = starts + lengths
                # An n-gram is a slice of the words joined by one blank.
                joined, stops = " ".join(tokens), np.cumsum(lengths + 1) - 1
                for a in range(0, len(tokens) - n + 1, at_most):
                    b = min(a + at_most, len(tokens) - n + 1)
                    cuts = zip((stops - lengths)[a:b].tolist(), stops[a + n - 1 : b + n - 1].tolist())
                    columns = [
                        pa.repeat(batch.column(0)[row], b - a),
                        pa.array(np.arange(a, b, dtype=np.int32)),
                        pa.array([joined[x:y] for x, y in cuts], pa.string()),
                        pa.array(starts[a:b]),
                        pa.array(ends[a + n - 1 : b + n - 1] - 1),
                    ]
                    yield pa.RecordBatch.from_arrays(columns, names=names)

    rows = spread(df, id_col).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    spans = rows.mapInArrow(run, f"id {id_type}, pos int, ngram string, start bigint, end bigint")
    return spans.withColumnRenamed("id", id_col)


def dirty_positions(
    docs: DataFrame, id_col: str, text_col: str, dirt: DataFrame, n: int, cutoff: int
) -> DataFrame:
    """Per document the number of dirty n-grams, counted up to the cutoff, and, below it, their word positions.

    No more than ``cutoff`` positions of a document leave its task or are ever listed together.
    """
    tokens = F.regexp_extract_all(F.col(text_col), F.lit(f"{T.NOT_WS}+"), F.lit(0))
    folded = F.transform(tokens, lambda w: T.ascii_fold(w))
    grams = spread(docs, id_col).select(id_col, F.posexplode(T.ngrams(folded, n)).alias("pos", "ngram"))
    hits = grams.join(dirt, "ngram", "left_semi").select(id_col, "pos")
    first = Window.partitionBy(id_col).orderBy("pos")
    return (
        hits.withColumn("_at", F.row_number().over(first))
        .where(F.col("_at") <= max(1, cutoff))
        .groupBy(id_col)
        .agg(F.count(F.lit(1)).alias("n_hits"), F.sort_array(F.collect_list("pos")).alias("hits"))
        .withColumn("hits", F.when(F.col("n_hits") < cutoff, F.col("hits")))
    )


def clean_chunks(
    text: Column, hits: Column, n: int, window: int, min_slice: int
) -> Column:
    """Clean parts of a text, given the word positions of its dirty n-grams (not too many)."""

    def spans(parts: Column) -> Column:
        lengths = F.transform(parts, lambda p: F.length(p))

        def offsets(ls: Column) -> Column:
            return F.transform(
                hits,
                lambda p: F.struct(
                    (
                        total(F.slice(ls, 1, p + 1), "int")
                        - F.length(T.lstrip(F.get(parts, p)))
                    ).alias("start"),
                    (total(F.slice(ls, 1, p + n), "int") - 1).alias("end"),
                ),
            )

        return let(lengths, offsets)

    size = F.length(text)

    def chunks(s: Column) -> Column:
        widened = F.transform(
            s,
            lambda x: F.struct(
                F.greatest(F.lit(0), x["start"] - window).alias("start"),
                F.least(size, x["end"] + window).alias("end"),
            ),
        )

        def cut(w: Column) -> Column:
            inner = F.filter(
                F.transform(
                    w,
                    lambda x, i: F.struct(
                        F.coalesce(F.get(w, i - 1)["end"], F.lit(0)).alias("from"), x["start"].alias("to")
                    ),
                ),
                lambda c: c["to"] - c["from"] > min_slice,
            )
            last = F.coalesce(F.get(w, F.size(w) - 1)["end"], F.lit(-1))
            tail = F.when(
                last < size - min_slice, F.array(F.substring(text, last + 2, size))
            ).otherwise(F.array().cast("array<string>"))
            return F.concat(
                F.transform(inner, lambda c: F.substring(text, c["from"] + 1, c["to"] - c["from"])), tail
            )

        return let(widened, cut)

    return let(T.pieces(text), lambda parts: let(spans(parts), chunks))


def janitor_clean(
    docs: DataFrame,
    id_col: str,
    text_col: str,
    contaminants: DataFrame,
    contaminant_text: Column,
    n: int = 13,
    window: int = 200,
    cutoff: int = 10,
    min_slice: int = 200,
) -> DataFrame:
    """Cut ``window`` characters around every contaminated span; one row per clean chunk.

    A document with ``cutoff`` or more dirty n-grams is dropped whole, so spans are
    only worked out for documents with a handful of hits; documents without hits
    are kept whole if they are long enough, without looking at their words again.
    """
    dirt = contaminants.select(F.explode(folded_ngrams(contaminant_text, n)).alias("ngram")).distinct()
    if ngrams_fit(contaminants, T.words(T.ascii_fold(contaminant_text)), n):
        dirt = F.broadcast(dirt)
    hits = dirty_positions(docs, id_col, text_col, dirt, n, cutoff)
    joined = docs.select(id_col, text_col).join(_small(hits), id_col, "left")
    whole = F.when(
        F.length(text_col) > min_slice - 1, F.array(F.col(text_col))
    ).otherwise(F.array().cast("array<string>"))
    chunks = (
        F.when(F.col("n_hits").isNull(), whole)
        .when(F.col("n_hits") >= cutoff, F.array().cast("array<string>"))
        .otherwise(clean_chunks(F.col(text_col), F.col("hits"), n, window, min_slice))
    )
    return joined.select(id_col, F.posexplode(chunks).alias("chunk_idx", "chunk"))


def decontaminated_metric(
    scored: DataFrame, dirty_ids: DataFrame, id_col: str, groups: list[str], value: str, suffix: str = "decontaminate"
) -> DataFrame:
    """Mean per group over all rows and over clean rows only (metric name + suffix)."""
    ids = dirty_ids.select(id_col).distinct().withColumn("_dirty", F.lit(True))
    flagged = scored.join(_small(ids), id_col, "left")
    both = flagged.groupBy(*groups).agg(
        F.avg(value).alias("all"),
        F.count(F.lit(1)).alias("n_all"),
        F.avg(F.when(F.col("_dirty").isNull(), F.col(value))).alias("clean"),
        F.count(F.when(F.col("_dirty").isNull(), F.lit(1))).alias("n_clean"),
    )
    variants = F.array(
        F.struct(F.lit("value").alias("metric"), F.col("all").alias("value"), F.col("n_all").alias("n")),
        F.struct(F.lit(f"value_{suffix}").alias("metric"), F.col("clean").alias("value"), F.col("n_clean").alias("n")),
    )
    return both.select(*groups, F.explode(variants).alias("v")).select(*groups, "v.metric", "v.value", "v.n")


def corpus_stats(df: DataFrame, source: str, text_col: str) -> DataFrame:
    """Documents and characters per source with the running start offset (sources are few)."""
    per_source = df.groupBy(source).agg(
        F.count(F.lit(1)).alias("n_docs"), F.sum(F.length(text_col).cast("bigint")).alias("n_chars")
    )
    # One row per source file; the running sum sees the aggregate, not the documents.
    before = Window.orderBy(source).rowsBetween(Window.unboundedPreceding, -1)
    return per_source.withColumn("start_offset", F.coalesce(F.sum("n_docs").over(before), F.lit(0)).cast("bigint"))
