"""Contamination operators against plain Python, both physical paths, and invariants."""

import re
import string
from collections import Counter

import pytest
from pyspark.sql import functions as F

from evalweave.functions import text as T
from evalweave.operators import bloom
from evalweave.operators import decontam as D
from evalweave.operators.broadcasts import ngrams_fit
from evalweave.streaming.incremental import incremental_decontaminate, read_clean


def grams(text, n):
    w = text.lower().split()
    return [" ".join(w[i : i + n]) for i in range(len(w) - n + 1)]


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@pytest.fixture(scope="module")
def bench(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/benchmark.parquet")


def test_ngrams_match_plain_python(spark):
    text = "The quick  brown fox\tjumps over　the lazy dog \n and runs away from the other dog again"
    df = spark.createDataFrame([(text,)], "t string")
    for n in (1, 2, 3, 5, 13):
        got = df.select(T.ngrams(T.words(F.lower("t")), n).alias("g")).first().g
        assert got == grams(text, n)
    short = spark.createDataFrame([("a b",), (None,), ("",)], "t string")
    rows = short.select(F.size(F.coalesce(T.ngrams(T.words(F.col("t")), 3), F.array())).alias("n")).collect()
    assert [r.n for r in rows] == [0, 0, 0]


def test_words_agree_with_python_whitespace(spark):
    blanks = [chr(i) for i in range(0x3100) if chr(i).isspace()]
    text = "".join(f"a{c}" for c in blanks) + "b"
    got = spark.createDataFrame([(text,)], "t string").select(T.words(F.col("t")).alias("w")).first().w
    assert got == text.split()


def naive_contaminated(docs, bench, n):
    dirty = {g for r in bench.collect() for g in grams(r.text, n)}
    return {r.doc_id for r in docs.collect() if dirty & set(grams(r.text, n))}


@pytest.mark.parametrize("n", [8, 13, 20])
def test_find_contaminated_both_paths(docs, bench, n):
    want = naive_contaminated(docs, bench, n)
    assert want
    x = F.col("text")
    small = D.find_contaminated(docs, bench, "doc_id", x, x, n)
    large = D.find_contaminated(docs, bench, "doc_id", x, x, n, broadcast_rows=0)
    assert {r.doc_id for r in small.collect()} == want
    assert {r.doc_id for r in large.collect()} == want


def test_decontaminate_splits_the_input(docs, bench):
    x = F.col("text")
    dirty = D.find_contaminated(docs, bench, "doc_id", x, x, 13)
    clean = D.decontaminate(docs, dirty, "doc_id")
    assert clean.count() + dirty.count() == docs.count()
    assert clean.join(dirty, "doc_id").count() == 0


def test_result_does_not_depend_on_partitions(spark, docs, bench):
    x = F.col("text")
    results = []
    for n in ("1", "7"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        rows = D.overlap_report(docs.repartition(int(n)), bench, "doc_id", x, "item_id", x, 13).collect()
        results.append(sorted((r.ngram, r.part, r.test_doc_ids, r.train_doc_ids) for r in rows))
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert results[0] == results[1]


def test_overlap_report_cuts_hot_ngrams_into_parts(spark):
    train = spark.range(500).select(F.col("id"), F.lit("one two three four").alias("text"))
    bench = spark.createDataFrame([(7, "zero one two three")], "item long, text string")
    x = F.col("text")
    rows = D.overlap_report(train, bench, "id", x, "item", x, 3, part_size=64).collect()
    assert {r.ngram for r in rows} == {"one two three"}
    assert max(len(r.train_doc_ids or []) for r in rows) <= 64
    assert sorted(i for r in rows for i in r.train_doc_ids or []) == list(range(500))
    assert [r.test_doc_ids for r in rows if r.test_doc_ids] == [[7]]


FOLD = str.maketrans(string.ascii_uppercase, string.ascii_lowercase, string.punctuation)


def naive_clean(text, dirt, n, window, cutoff, min_slice):
    """Independent cleaner: cut points are gathered first, chunks afterwards."""
    tokens = [(m.group(), m.start(), m.end()) for m in re.finditer(r"\S+", text)]
    hits = []
    for i in range(len(tokens) - n + 1):
        gram = " ".join(t[0] for t in tokens[i : i + n]).translate(FOLD)
        if gram in dirt:
            hits.append((tokens[i][1], tokens[i + n - 1][2] - 1))
    if len(hits) >= cutoff:
        return []
    cuts = [(max(0, s - window), min(len(text), e + window)) for s, e in hits]
    chunks, at = [], 0
    for s, e in cuts:
        if s - at > min_slice:
            chunks.append(text[at:s])
        at = e
    last = cuts[-1][1] if cuts else -1
    if last < len(text) - min_slice:
        chunks.append(text[last + 1 :])
    return chunks


def cleaning_texts():
    clean = "This is a long enough line of harmless words that nobody would want removed. "
    bad = "Seven rainy Sundays, one by one, drowned the quiet old harbour town completely! "
    return bad, [
        clean * 20,
        clean * 8 + bad + clean * 8,
        bad + clean * 10,
        clean * 10 + bad,
        clean * 6 + bad + clean * 2 + bad.upper() + clean * 9,
        (clean * 3 + bad) * 12,
        "short",
        clean,
        "",
        "- " + clean * 5 + bad.replace(" ", "  \n") + clean * 7,
    ]


@pytest.mark.parametrize("n,window,cutoff,min_slice", [(6, 200, 10, 200), (6, 20, 100, 50), (8, 0, 4, 1)])
def test_janitor_clean(spark, n, window, cutoff, min_slice):
    bad, texts = cleaning_texts()
    docs = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    dirt_df = spark.createDataFrame([(bad,)], "text string")
    folded = bad.translate(FOLD).split()
    dirt = {" ".join(folded[i : i + n]) for i in range(len(folded) - n + 1)}
    got = D.janitor_clean(docs, "id", "text", dirt_df, F.col("text"), n, window, cutoff, min_slice).collect()
    for i, text in enumerate(texts):
        chunks = [r.chunk for r in sorted((r for r in got if r.id == i), key=lambda r: r.chunk_idx)]
        assert chunks == naive_clean(text, dirt, n, window, cutoff, min_slice), i


def test_ngram_spans(spark):
    text = "  alpha beta\n\ngamma   delta epsilon "
    df = spark.createDataFrame([(1, text)], "id long, text string")
    got = D.ngram_spans(df, "id", "text", 3).orderBy("pos").collect()
    tokens = [(m.group(), m.start(), m.end() - 1) for m in re.finditer(r"\S+", text)]
    want = [(" ".join(t[0] for t in tokens[i : i + 3]), tokens[i][1], tokens[i + 2][2]) for i in range(3)]
    assert [(r.ngram, r.start, r.end) for r in got] == want


def test_ngram_doc_frequency_counts_documents(spark):
    docs = spark.createDataFrame(
        [(i, "common words here " * 3 + f"own{i} text{i} only{i}") for i in range(30)], "id long, text string"
    )
    got = {r.ngram: r.n_docs for r in D.ngram_doc_frequency(docs, "id", F.col("text"), 3, 10).collect()}
    assert got["common words here"] == 30
    assert all(not g.split()[-1].startswith("only") for g in got)


def test_stream_equals_batch_and_resumes(spark, docs, bench, tmp_path):
    source, out, state = (str(tmp_path / p) for p in ("in", "out", "state"))
    first, second = docs.where("doc_id % 2 = 0"), docs.where("doc_id % 2 = 1")

    def run():
        x = F.col("text")
        incremental_decontaminate(
            spark, source, docs.schema, bench, "doc_id", x, x, out, state, 13, files_per_batch=1
        ).awaitTermination()

    first.coalesce(2).write.mode("append").parquet(source)
    run()
    half = read_clean(spark, out).count()
    second.coalesce(1).write.mode("append").parquet(source)
    run()
    run()
    x = F.col("text")
    dirty = D.find_contaminated(docs, bench, "doc_id", x, x, 13)
    want = {r.doc_id for r in D.decontaminate(docs, dirty, "doc_id").collect()}
    got = [r.doc_id for r in read_clean(spark, out).collect()]
    assert half < len(got)
    assert len(got) == len(set(got)) and set(got) == want


def test_stream_reads_a_table_of_several_files(spark, docs, bench, tmp_path):
    from evalweave.plans.catalog import QUERIES

    docs.repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    bench.write.parquet(str(tmp_path / "benchmark.parquet"))
    got = QUERIES["incremental_decontaminate"](spark, str(tmp_path))
    assert as_rows(got) == as_rows(QUERIES["decontaminate"](spark, str(tmp_path))) != []


def test_bloom_filter_keeps_every_key(spark):
    numbers = spark.range(0, 60_000).select("id", F.xxhash64("id").alias("h"))
    keys = numbers.where("id < 20000").select("h")
    possible = bloom.bloom_filter(keys, "h", 20_000)
    passed = numbers.where(possible(F.col("h")))
    assert passed.where("id < 20000").count() == 20_000
    assert passed.where("id >= 20000").count() < 40_000 * 0.04
    assert numbers.where(bloom.bloom_filter(keys.limit(0), "h", 0)(F.col("h"))).count() == 0
    assert bloom.filter_bits(0) == 1 << bloom.SMALLEST and bloom.filter_bits(10**12) == 1 << bloom.LARGEST


def test_crowded_bloom_filter_loses_no_key(spark, monkeypatch):
    monkeypatch.setattr(bloom, "LARGEST", bloom.SMALLEST)
    keys = spark.range(0, 20_000).select(F.xxhash64("id").alias("h"))
    assert keys.where(bloom.bloom_filter(keys, "h", 20_000)(F.col("h"))).count() == 20_000


def test_hash_of_a_string_is_that_of_its_words(spark):
    df = spark.createDataFrame([("the quick brown fox",), ("é ü 日本 x",)], "t string")
    for n in (1, 2, 4):
        row = df.select(T.ngram_hashes(T.words(F.col("t")), n).alias("h"), F.transform(T.ngrams(T.words(F.col("t")), n), T.ngram_hash).alias("s")).collect()
        assert all(r.h == r.s for r in row)


def test_little_of_the_corpus_is_shuffled(spark, docs, bench, monkeypatch):
    """Beyond the broadcast bound, what meets the benchmark's hashes by shuffle is numbers, and hardly more than the hits."""
    n, x = 13, F.col("text")
    monkeypatch.setattr(D, "fits_broadcast", lambda *_: False)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        tokens = T.words(F.lower(x))
        keys = bench.select(F.explode(T.ngram_hashes(T.words(F.lower("text")), n)).alias("h")).distinct()
        hits = D.postings(docs, "doc_id", tokens, n, keys)
        assert [t for _, t in hits.dtypes] == ["bigint", "bigint", "int"]
        plan = hits._jdf.queryExecution().executedPlan().toString()
        shuffles = [i for i, line in enumerate(plan.splitlines()) if "hashpartitioning(h" in line]
        probes = [i for i, line in enumerate(plan.splitlines()) if "Filter" in line and "getbit" in line]
        assert shuffles and probes and min(shuffles) < probes[0]  # the filter lies below the exchange
        assert "ngram" not in plan
        total = docs.select(F.explode(T.ngram_hashes(tokens, n))).count()
        possible = bloom.bloom_filter(keys, "h", keys.count())
        shuffled = docs.select(F.explode(T.ngram_hashes(tokens, n)).alias("h")).where(possible(F.col("h"))).count()
        assert 0 < hits.count() <= shuffled < hits.count() + 0.04 * total
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def as_rows(df):
    return sorted(map(str, df.collect()))


@pytest.mark.parametrize("n", [2, 13])
def test_reports_both_paths(spark, docs, bench, n):
    x = F.col("text")
    some = docs.where("doc_id < 60") if n == 2 else docs
    odd = spark.createDataFrame([(-1, None), (-2, ""), (-3, "one"), (-4, "the the the the")], "doc_id bigint, text string")
    both = some.select("doc_id", "text").unionByName(odd)
    reports = [D.overlap_report(both, bench, "doc_id", x, "item_id", x, n, broadcast_rows=r) for r in (10**6, 0)]
    assert as_rows(reports[0]) == as_rows(reports[1]) != []
    sums = [D.contamination_summary(both, bench, "doc_id", x, "item_id", x, n, broadcast_rows=r).first() for r in (10**6, 0)]
    assert sums[0] == sums[1] and sums[0].matched_ngrams > 0
    tasks = bench.select(F.lit("t").alias("task"), (F.col("item_id") % 2).alias("set"), F.col("item_id").alias("doc_id"), "text")
    pairs = [D.train_overlap(both, "doc_id", x, tasks, x, n, broadcast_rows=r) for r in (10**6, 0)]
    for small, large in zip(*pairs):
        assert as_rows(small) == as_rows(large) != []


def test_bound_counts_bytes(bench):
    tokens = T.words(F.lower("text"))
    assert ngrams_fit(bench, tokens, 13)
    assert not ngrams_fit(bench, tokens, 13, rows=0) and not ngrams_fit(bench, tokens, 13, size=1000)


def test_no_more_positions_than_the_cutoff(spark):
    docs = spark.createDataFrame([(1, "a b " * 500), (2, "a b c")], "doc_id bigint, text string")
    dirt = spark.createDataFrame([("a b",)], "ngram string")
    got = {r.doc_id: (r.n_hits, r.hits) for r in D.dirty_positions(docs, "doc_id", "text", dirt, 2, 3).collect()}
    assert got == {1: (3, None), 2: (1, [0])}


def test_tokens_and_spans_of_odd_rows(spark):
    """Spans are made in tasks of Python, a bounded number at a time; ids may be null."""
    texts = [None, "", "  a\x1cb\u3000c é日本 d ", "x " * 7]
    df = spark.createDataFrame([(i or None, t) for i, t in enumerate(texts)], "id int, text string")
    got = sorted(map(tuple, D.ngram_spans(df, "id", "text", 3).collect()))
    want = []
    for i, text in enumerate(texts):
        tokens = list(re.finditer(r"\S+", text or ""))
        want += [(i, k, " ".join(t.group() for t in tokens[k : k + 3]), tokens[k].start(), tokens[k + 2].end() - 1) for k in range(len(tokens) - 2)]
    assert got == sorted(want) and D.ngram_spans(df, "id", "text", 3).schema["id"].dataType.simpleString() == "int"


def test_spans_take_no_quadratic_expression(spark):
    plan = D.ngram_spans(spark.createDataFrame([(1, "a")], "id long, text string"), "id", "text", 3)._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "lambda" not in plan


@pytest.mark.parametrize("fold", [True, False])
def test_hashed_ngrams_are_those_of_the_words(fold):
    from evalweave.functions.hashing import gram_hasher

    texts = ["The  quick,brown fox the quick brown fox", "", "a b", "Ünï \x1c x!日本 ' y"]
    words, h, row, place = gram_hasher(2, fold)(texts)
    clean = [t.translate(str.maketrans(string.ascii_uppercase, string.ascii_lowercase, string.punctuation)) if fold else t for t in texts]
    assert words == [t.split() for t in clean]
    spelled = [" ".join(words[r][p : p + 2]) for r, p in zip(row, place)]
    assert spelled == [" ".join(w[i : i + 2]) for w in words for i in range(len(w) - 1)]
    assert len(set(spelled)) == len(set(h.tolist())) == len(set(zip(spelled, h.tolist())))


def test_counts_over_many_buckets(spark, docs, monkeypatch):
    x = F.col("text")
    grams = [g for r in docs.select(T.ngrams(T.words(T.ascii_fold(x)), 5).alias("g")).collect() for g in r.g]
    per_row = [g for r in docs.select(D.folded_ngrams(x, 5).alias("g")).collect() for g in r.g]
    want = {g: c for g, c in Counter(per_row).items() if c > 3}
    for name, value in (("BUCKET_BYTES", 1 << 16), ("HASHES_GATHERED", 5_000), ("HASH_BYTES", 1 << 14), ("STRINGS_GATHERED", 10)):
        monkeypatch.setattr(D, name, value)
    assert D.corpus_unique_counts(docs, "doc_id", x, 5).first() == (len(grams), len(set(grams)))
    assert {r.ngram: r.n_docs for r in D.ngram_doc_frequency(docs, "doc_id", x, 5, 3).collect()} == want != {}
    monkeypatch.setattr(D, "BUCKET_MAP_BITS", 3)  # a crowded map loses nothing
    assert {r.ngram: r.n_docs for r in D.ngram_doc_frequency(docs, "doc_id", x, 5, 3).collect()} == want
    empty = docs.where("false")
    assert D.corpus_unique_counts(empty, "doc_id", x, 5).first() == (None, 0)
    assert D.ngram_doc_frequency(empty, "doc_id", x, 5, 3).count() == 0


def test_counting_shuffles_packed_hashes(spark, docs):
    """No row for each n-gram meets a shuffle, and strings meet one only where they may be frequent."""
    for df in (D.corpus_unique_counts(docs, "doc_id", F.col("text"), 13), D.ngram_doc_frequency(docs, "doc_id", F.col("text"), 5, 10)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Generate" not in plan and "MapInArrow" in plan


def test_overlap_by_hash_is_settled_by_string(spark, docs, bench, monkeypatch):
    tasks = bench.select(F.lit("t").alias("task"), F.lit("s").alias("set"), F.col("item_id").alias("doc_id"), "text")
    x = F.col("text")
    plain = [as_rows(df) for df in D.train_overlap(docs, "doc_id", x, tasks, x, 13)]
    made = D.gram_hasher

    def weak(n, fold=False):
        run = made(n, fold)

        def coarse(texts):
            words, h, row, place = run(texts)
            return words, h >> h.dtype.type(50) << h.dtype.type(50), row, place

        return coarse

    monkeypatch.setattr(D, "gram_hasher", weak)
    found = D.train_overlap(docs, "doc_id", x, tasks, x, 13)
    assert [as_rows(df) for df in found] == plain
    assert "MapInArrow" in found[1]._jdf.queryExecution().executedPlan().toString()
