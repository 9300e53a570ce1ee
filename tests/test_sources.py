"""Readers and writers on files."""

import json
import os

from pyspark.sql import functions as F

from evalweave.sources import archives as A
from evalweave.sources import logs as L


def test_archive_line_shapes(spark, tmp_path):
    lines = [json.dumps("bare é"), json.dumps({"text": "t", "meta": {"a": "1"}}), json.dumps({"text": ["p", "q"], "meta": {}}), "not json"]
    (tmp_path / "x.jsonl").write_text("\n".join(lines), encoding="utf-8")
    got = A.read_text_archive(spark, str(tmp_path / "x.jsonl")).collect()
    assert sorted((r.text or "") for r in got) == ["", "bare é", "p\n\nq", "t"]
    assert {tuple((r.meta or {}).items()) for r in got} == {(), (("a", "1"),)}


def test_archive_roundtrip(spark, tmp_path):
    df = spark.createDataFrame([(1, "one\ntwo"), (2, "drei ß")], "id long, t string")
    A.write_text_archive(df, F.col("t"), F.create_map(F.lit("id"), F.col("id").cast("string")), str(tmp_path / "o"))
    back = A.read_text_archive(spark, str(tmp_path / "o")).select(F.col("meta")["id"].alias("i"), "text").collect()
    assert {(r.i, r.text) for r in back} == {("1", "one\ntwo"), ("2", "drei ß")}


def test_latest_files_and_rows(spark, tmp_path):
    for model in ("m1", "m2"):
        os.makedirs(tmp_path / model)
        for task in ("arc_easy", "x"):
            for stamp in ("2024-01-01T00-00-00.1", "2024-03-01T00-00-00.2", "2023-12-31T00-00-00.3"):
                line = {"doc_id": 1, "target": f"{model}/{task}/{stamp}"}
                (tmp_path / model / f"samples_{task}_{stamp}.jsonl").write_text(json.dumps(line) + "\n")
        (tmp_path / model / "results_2024.json").write_text("{}")
    got = L.read_latest_samples(spark, f"file:{tmp_path}").collect()
    assert {r.target for r in got} == {f"{m}/{t}/2024-03-01T00-00-00.2" for m in ("m1", "m2") for t in ("arc_easy", "x")}


def test_sample_logs_walk_folders(spark, tmp_path):
    os.makedirs(tmp_path / "a" / "b")
    doc = {"doc": {"id": "1/A", "rating": None, "tags": ["dp"], "official_tests": [{"input": "1", "output": "2"}]}, "resps": [["r0", "r1"]]}
    (tmp_path / "a" / "b" / "s.jsonl").write_text(json.dumps(doc) + "\n")
    (tmp_path / "a" / "ignored.txt").write_text("x")
    got = L.attempts_of(L.read_sample_logs(spark, str(tmp_path))).orderBy("attempt_idx").collect()
    assert [(r.problem_id, r.attempt_idx, r.response, r.rating) for r in got] == [("1/A", 0, "r0", None), ("1/A", 1, "r1", None)]


def test_grader_log_roundtrip(spark, tmp_path):
    rows = [(1, 0, 900, ["dp"], "r", True, None), (1, 1, 900, ["dp"], "s", False, "WA, TLE")]
    schema = "problem_id long, attempt_idx long, rating int, tags array<string>, response string, accepted boolean, failure_reasons string"
    L.write_grader_log(spark.createDataFrame(rows, schema), str(tmp_path / "g"))
    back = L.read_grader_log(spark, str(tmp_path / "g")).orderBy("attempt_idx").collect()
    assert [tuple(r) for r in back] == [(r[0], r[1], r[2], r[3], r[4], r[5], r[6]) for r in rows]


def test_more_files_where_a_range_would_be_large(spark, tmp_path, monkeypatch):
    from pyspark.sql import functions as F

    from evalweave.sources import archives

    monkeypatch.setattr(archives, "RANGE_BYTES", 2_000)
    df = spark.createDataFrame([(i, " ".join(f"w{i}x{j}" for j in range(30))) for i in range(20)], "id long, text string")
    archives.write_ngram_buckets(df, "id", F.col("text"), 3, 2, str(tmp_path / "b"))
    files = sorted((tmp_path / "b").glob("*.parquet"))
    assert len(files) > 4 and all(".zstd." in f.name for f in files)
    rows = [tuple(r) for f in files for r in spark.read.parquet(str(f)).collect()]
    assert len(rows) == 20 * 28 and rows == sorted(rows)


def folded_grams(text, n):
    import string

    words = (text or "").translate(str.maketrans(string.ascii_uppercase, string.ascii_lowercase, string.punctuation)).split()
    return {" ".join(words[i : i + n]) for i in range(len(words) - n + 1)}


def odd_texts():
    """Texts with repeats, control characters within words, blanks of many kinds, and copies under other ids."""
    import random

    r = random.Random(4)
    words = ["a", "a\x01", "a\x01b", "A!", "ä", "ab", "Über", "中", "\U0001f600x", "\x00", "b", "the", "The", "...", "longer" * 9]
    blanks = [" ", "  ", "\n", "\t", "\x1f", "\x85", "\u3000", "\u2003"]
    texts = ["".join(r.choice(words) + r.choice(blanks) for _ in range(r.choice([0, 2, 3, 40, 90]))) for _ in range(60)]
    return [*texts, *texts[:20], *["one two three four"] * 70, None, "", "a b", "x y z"]


def test_index_in_passes(spark, tmp_path, monkeypatch):
    import pyarrow.parquet as pq

    from evalweave.sources import archives

    texts = odd_texts()
    order = lambda i: (i is not None, i if not isinstance(i, dict) else tuple(map(order, i.values())))
    for n, kind, ids in (
        (3, "bigint", [None if i % 29 == 3 else (i * 7919) % 150 - 70 for i in range(len(texts))]),
        (1, "int", list(range(len(texts)))),
        (14, "struct<a:int,b:string>", [{"a": i % 5, "b": None if i % 3 else str(i)} for i in range(len(texts))]),
    ):
        df = spark.createDataFrame(list(zip(ids, texts)), f"id {kind}, text string")
        want = sorted((g, order(i)) for i, t in zip(ids, texts) for g in folded_grams(t, n))
        for passes in (1, 3) if n == 3 else (3,):
            monkeypatch.setattr(archives, "RANGE_BYTES", 12_000)
            monkeypatch.setattr(archives, "PASS_BYTES", 1 if passes > 1 else 1 << 40)
            path = tmp_path / f"{n}-{passes}"
            archives.write_ngram_buckets(df, "id", F.col("text"), n, 5, str(path))
            files = sorted(path.glob("*.parquet"))
            assert len(files) > 4 and (path / "_SUCCESS").exists()
            assert [(r["ngram"], order(r["id"])) for f in files for r in pq.read_table(f).to_pylist()] == want
            assert dict(spark.read.parquet(str(path)).dtypes) == {"ngram": "string", "id": kind}


def test_index_of_nothing(spark, tmp_path):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "a b")], "id long, text string")
    A.write_ngram_buckets(df, "id", F.col("text"), 3, 2, str(tmp_path / "b"))
    back = spark.read.parquet(str(tmp_path / "b"))
    assert back.dtypes == [("ngram", "string"), ("id", "bigint")] and back.count() == 0


def test_ngrams_travel_packed():
    import random
    from types import SimpleNamespace

    import pyarrow as pa

    from evalweave.functions import packing

    r = random.Random(1)
    words = ["".join(r.choice("abcdefghij") for _ in range(r.randint(3, 9))) for _ in range(3000)]
    texts = [" ".join(r.choice(words) if r.random() < 0.95 else f"once{r.random()}" for _ in range(400)) for _ in range(100)]
    want = sorted((g, i) for i, t in enumerate(texts) for g in folded_grams(t, 13))
    bound = (want[len(want) // 3][0].encode(), (True, want[len(want) // 3][1]))
    shared = SimpleNamespace(value=(words, [bound]))
    batch = pa.RecordBatch.from_arrays([pa.array(range(100), pa.int64()), pa.array(texts)], names=["id", "text"])
    for sort_bytes, packed_rows in ((1 << 30, 1 << 30), (50_000, 700)):
        got = []
        for begin, end in ((0, 1), (1, 2)):
            packed = list(packing.gram_packer(13, shared, begin, end, sort_bytes, packed_rows)(iter([batch.slice(0, 30), batch.slice(30)])))
            rows = [x for b in packing.gram_unpacker(13, shared, "id")(iter(packed)) for x in zip(*(c.to_pylist() for c in b.columns))]
            assert {k for b in packed for k in b.column(0).to_pylist()} == {begin}
            assert sum(b.nbytes for b in packed) < 0.4 * sum(len(g) + 8 for g, _ in rows)
            got += sorted(rows)
        assert got == want


def test_index_is_delta_coded(spark, tmp_path):
    import pyarrow.parquet as pq

    df = spark.createDataFrame([(i, " ".join(f"w{i}x{j}" for j in range(300))) for i in range(5)], "id long, text string")
    A.write_ngram_buckets(df, "id", F.col("text"), 13, 1, str(tmp_path / "b"))
    column = pq.read_metadata(next((tmp_path / "b").glob("*.parquet"))).row_group(0).column(0)
    assert column.path_in_schema == "ngram" and "DELTA_BYTE_ARRAY" in column.encodings
