"""Byte-level BPE and token records against the libraries."""

import base64
import hashlib
import random
import struct
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from evalweave.llm import bpe, queries, records

RANKS = open(queries.BYTE_RANKS, "rb").read()
WORDS = open(queries.WORD_TOKENIZER, "rb").read()

ODD = [
    "", " ", "\n\n  word", "a", "it's we'll I'd they're '", "x" * 5000, " " * 4000 + "end", "tab\t\tnew\n\n\nline  \r\n end ",
    "naïve Élan für über ß ñandú", "日本語のテキスト。漢字カナ", "🙂👩‍👩‍👧 emoji‍", "1234 12.5% $9,99 a_b-c", "'s 't 're don''t 'LL", "\x1c\x1d\x85\xa0 x",
    "wait...what?!  (yes) [no] {a}; b: c", "#%&*** ab&&& THE!! | x |", "é combining ̸ marks!̸", "ΣΑΣ ΟΔΟΣ. İstanbul",
]


@pytest.fixture(scope="module")
def reference():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, RANKS.splitlines())}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def random_texts(n, seed=1):
    rng = random.Random(seed)
    pool = [c for t in ODD for c in t] + list(" \n\t.,'!?-") * 30 + list("abcdefghijklmnopqrstuvwxyz") * 20
    return ["".join(rng.choice(pool) for _ in range(rng.randrange(1, 400))) for _ in range(n)]


def test_vocabulary_as_library(reference):
    v = bpe.Vocabulary(RANKS, public_tokenizers.PATTERN)
    for text in ODD + random_texts(400):
        ids = np.frombuffer(v.encode(text), "<u4").tolist()
        assert ids == reference.encode_ordinary(text), repr(text)
        assert v.decode(v.encode(text)) == text.encode()


def test_generations_of_the_cache(reference, monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED", 5)
    v = bpe.Vocabulary(RANKS, public_tokenizers.PATTERN)
    for text in random_texts(50, 9):
        assert np.frombuffer(v.encode(text), "<u4").tolist() == reference.encode_ordinary(text)
    assert len(v.remembered) <= 5 and len(v.remembered.older) <= 5


def test_single_characters_as_library(reference):
    """Blanks and letters are the same to both, for every character of the first plane."""
    v = bpe.Vocabulary(RANKS, public_tokenizers.PATTERN)
    chars = [chr(c) for c in range(1, 0x3100) if chr(c).isspace() or c < 0x600 or not c % 7]
    text = "".join(f"a{c}{c}b .{c}" for c in chars)
    assert np.frombuffer(v.encode(text), "<u4").tolist() == reference.encode_ordinary(text)


def test_long_merge_equals_short(reference):
    v = bpe.Vocabulary(RANKS, public_tokenizers.PATTERN)
    for piece in (b"thethethe" * 9, b"abababcab" * 12, bytes(range(128, 256)), b"aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa"):
        assert [v.ranks[t] for t in v._merge_long(piece)] == reference._encode_single_piece(piece)
        assert np.frombuffer(v.merge(piece[:48]), "<u4").tolist() == reference._encode_single_piece(piece[:48])


def test_chunks_are_stitched(spark, reference):
    rng = random.Random(3)
    texts = [" ".join(random_texts(30, seed)) for seed in range(5)] + ["y" * 900 + " z", " \n" * 300 + "end", "a" * 70, None, ""]
    texts.append("".join(rng.choice("ab  \n'.") for _ in range(4000)))
    rows = [(i if i else None, t, "x") for i, t in enumerate(texts)] + [(1, texts[1], "again")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, ids string")
    out = bpe.encode(df, "text", RANKS, public_tokenizers.PATTERN, chunk=64, overlap=16)
    got = sorted((r["row"]["ids"], r["row"]["doc_id"] or 0, bytes(r["ids"])) for r in out.collect())
    want = sorted(
        (x, i or 0, np.array(reference.encode_ordinary(t or ""), "<u4").tobytes()) for i, t, x in rows
    )
    assert got == want


def test_op1_digests(spark, sf_dir, reference):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = queries.op1_byte_bpe(spark, sf_dir).collect()
    assert len(rows) == len(docs)
    for r in rows:
        ids = np.array(reference.encode_ordinary(docs[r["doc_id"]]), "<u4")
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), hashlib.sha256(ids.tobytes()).hexdigest())
        assert r["decoded_sha256"] == hashlib.sha256(docs[r["doc_id"]].encode()).hexdigest()


def test_words_as_library():
    library = Tokenizer.from_str(WORDS.decode())
    own = records.WordEncoder(WORDS, "<u2")
    texts = ODD + random_texts(400, 5)
    for text, ids in zip(texts, own.encode(texts)):
        assert np.frombuffer(ids, "<u2").tolist() == library.encode(text, add_special_tokens=False).ids, repr(text)


def test_special_strings_as_library():
    library, own = Tokenizer.from_str(WORDS.decode()), records.WordEncoder(WORDS, "<u2")
    rng = random.Random(6)
    pool = ["<|endoftext|>", "<|startoftext|>", "<|EndOfText|>", "<|", "|>", "endoftext", "é", "\u0301", "A", "b", "7", ".", ",", "'s", " ", " ", "\n", "\xa0", "<"]
    texts = ["".join(rng.choice(pool) for _ in range(rng.randrange(1, 25))) for _ in range(4000)]
    for text, ids in zip(texts, own.encode(texts)):
        assert np.frombuffer(ids, "<u2").tolist() == library.encode(text, add_special_tokens=False).ids, repr(text)
    assert np.frombuffer(own.encode(["a<|endoftext|>b"])[0], "<u2").tolist() == [320, 49407, 321]


def test_words_remembered_in_generations(monkeypatch):
    monkeypatch.setattr(records, "REMEMBERED", 3)
    library, own = Tokenizer.from_str(WORDS.decode()), records.WordEncoder(WORDS, "<u2")
    for text in random_texts(60, 11) + ["\x00 \x1f a", "\u200b", "a\u0301 e\u0301x"]:
        assert np.frombuffer(own.encode([text])[0], "<u2").tolist() == library.encode(text, add_special_tokens=False).ids, repr(text)


def test_frames():
    record = records.frame(-5, b"\x01\x00\x02\x00")
    assert struct.unpack("<Q", record[:8])[0] == 13
    assert records.unframe(record) == (-5, b"\x01\x00\x02\x00")
    assert records.unframe(records.frame(None, b"")) == (None, b"")
    for i in range(len(record)):
        with pytest.raises((ValueError, struct.error)):
            records.unframe(record[:i] + bytes([record[i] ^ 1]) + record[i + 1 :])


def test_records_round_trip(spark):
    library = Tokenizer.from_str(WORDS.decode())
    rows = [(9, "the end", 1), (None, "no id", 2), (3, None, 3), (3, "", 4), (7, "word " * 3000, 5), (9, "the end", 6)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, start int")
    folder, manifest = records.write_records(df, "doc_id", "text", WORDS, queries.WORD_VOCABULARY, 2)
    got = records.read_records(spark, folder, manifest, queries.WORD_VOCABULARY).orderBy("start").collect()
    assert [r["id"] for r in got] == [None, 3, 3, 7, 9, 9]
    texts = sorted((r[0] is not None, r[0] or 0, r[1] or "") for r in rows)
    at = 0
    for r, (_, _, text) in zip(got, texts):
        ids = [*library.encode(text, add_special_tokens=False).ids, 2]
        assert (r["start"], r["n_tokens"], bytes(r["ids"])) == (at, len(ids), np.array(ids, "<u4").tobytes())
        at += len(ids)
    names = [r["file"] for r in manifest.collect()]
    shuffled = [owner for n in names for owner, _ in records.shuffled_reader(folder, n, queries.WORD_VOCABULARY, 1)]
    assert sorted(shuffled, key=str) == sorted([r[0] for r in rows], key=str)
    empty = df.limit(0)
    folder, manifest = records.write_records(empty, "doc_id", "text", WORDS, queries.WORD_VOCABULARY, 2)
    assert records.read_records(spark, folder, manifest, queries.WORD_VOCABULARY).count() == 0


def test_op4_crc(spark, sf_dir):
    library = Tokenizer.from_str(WORDS.decode())
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").orderBy("doc_id").collect()
    got = {r["doc_id"]: r for r in queries.op4_token_records(spark, sf_dir).collect()}
    at = 0
    for d in docs:
        ids = [*library.encode(d["text"], add_special_tokens=False).ids, 2]
        r = got[d["doc_id"]]
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    assert len(got) == len(docs)


def test_empty_tables(spark):
    df = spark.createDataFrame([], "doc_id bigint, text string")
    assert bpe.decode(bpe.encode(df, "text", RANKS, public_tokenizers.PATTERN), "ids", RANKS).count() == 0
    assert F.col("x") is not None


def test_marks_and_separators_as_library():
    """Words are looked up with the marks behind them; U+001C to U+001F are no blanks to the tokenizer."""
    library, encoder = Tokenizer.from_str(WORDS.decode()), records.WordEncoder(WORDS, "<u2")
    for text in ("one, two. a.b,c two; two", "x\x1cy z\x85q (baz) é日本.", "a\x1d\x1e \x1f b.", ""):
        assert encoder.encode([text])[0] == np.array(library.encode(text, add_special_tokens=False).ids, "<u2").tobytes()
    assert "two;" in encoder.known
