"""SimHash groups and repeated passages against brute force."""

import hashlib
import itertools
import random
import re

import numpy as np
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from evalweave.llm import graph, passages, queries, simhash


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(n, links):
    root = list(range(n))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return [find(i) for i in range(n)]


def test_fingerprint():
    texts = ["", None, " \n", "one", "One two THREE four", "a b c d e f", "É é ß ÉÉ x y", "w\x0bx\x0cy\x1cz q r", "the " * 50, "x" * 10000 + " y z w v"]
    for t in texts:
        assert simhash._fingerprint(t or "", 4) == plain_fingerprint(t), repr(t)


def test_masks_cover():
    """Every pair of fingerprints within the radius agrees under some mask: checked on all single and random error sets."""
    rng, ms = random.Random(1), [m & (2**64 - 1) for m in simhash.masks(4)]
    assert len(ms) == 31 and all(24 <= bin(m).count("1") <= 40 for m in ms)
    sets = [list(c) for c in itertools.combinations(range(64), 2)] + [rng.sample(range(64), 4) for _ in range(20000)]
    for s in sets:
        e = sum(1 << i for i in s)
        assert any(not e & m for m in ms)


def near_words(rng, base, edits):
    words = base.split()
    for _ in range(edits):
        words[rng.randrange(len(words))] = f"w{rng.randrange(999)}"
    return " ".join(words)


def test_groups(spark):
    rng = random.Random(2)
    texts = []
    for g in range(30):
        base = " ".join(f"w{rng.randrange(5000)}" for _ in range(rng.choice((3, 5, 40, 300))))
        texts += [base, base.upper(), near_words(rng, base, 1), near_words(rng, base, 2)][: rng.randrange(1, 5)]
    texts += ["", None, " ", "one", "one"]
    rows = [(i * 3 + 5, t, i) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, fp int")
    fps = [plain_fingerprint(t) for t in texts]
    links = [(i, j) for i in range(len(fps)) for j in range(i) if bin(fps[i] ^ fps[j]).count("1") <= 4]
    want = {rows[i][0]: rows[c][0] for i, c in enumerate(plain_components(len(rows), links))}
    got = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(df, "doc_id", "text").collect()}
    assert got == want
    assert simhash.near_duplicates(df.limit(0), "doc_id", "text").count() == 0


def test_large_buckets_in_blocks(spark):
    """A cluster around one value, cut into blocks of 16, connects as by brute force."""
    rng = random.Random(4)
    fps = sorted({sum(1 << b for b in rng.sample(range(64), rng.choice((1, 3, 5)))) for _ in range(200)})
    signed = [int(np.uint64(f).astype(np.int64)) for f in fps]
    df = spark.createDataFrame([(f,) for f in signed], "fp bigint")
    got = {(r["a"], r["b"]) for r in simhash.fingerprint_links(df, 4, block=16).collect()}
    assert all(bin((a ^ b) & (2**64 - 1)).count("1") <= 4 for a, b in got)
    at = {f: i for i, f in enumerate(signed)}
    links = [(i, j) for i in range(len(fps)) for j in range(i) if bin(fps[i] ^ fps[j]).count("1") <= 4]
    assert plain_components(len(fps), [(at[a], at[b]) for a, b in got]) == plain_components(len(fps), links)
    assert len(got) < len(links)


def test_null_ids(spark):
    df = spark.createDataFrame([(None, "a b c d e"), (4, "a b c d e"), (None, "p q r s t")], "doc_id bigint, text string")
    got = sorted((str(r["doc_id"]), str(r["component_id"])) for r in simhash.near_duplicates(df, "doc_id", "text").collect())
    assert got == [("4", "4"), ("None", "4"), ("None", "None")]


def test_null_and_repeated_ids_as_bridges(spark, monkeypatch):
    """Fingerprints A-B-C four bits apart each; ids are names of them, not links."""
    a, b, c, far = 0, 0b1111, 0b11111111, (1 << 63) - 1

    def groups(rows):
        df = spark.createDataFrame(rows, "doc_id bigint, fp bigint")
        monkeypatch.setattr(simhash, "fingerprints", lambda *_: df)
        return sorted(map(tuple, simhash.near_duplicates(df.withColumn("text", F.lit("")), "doc_id", "text").select("doc_id", "fp", "component_id").collect()), key=str)

    assert groups([(3, a), (None, b), (9, c)]) == sorted([(3, a, 3), (None, b, 3), (9, c, 3)], key=str)
    for other in ([], [(2, far)]):  # id 4 on two fingerprints far apart: two groups, whatever else stands in one
        got = groups([(4, a), (4, far), (5, a), (6, far), *other])
        low = 2 if other else 4
        assert got == sorted([(4, a, 4), (5, a, 4), (4, far, low), (6, far, low), *[(2, far, 2) for _ in other]], key=str)


def test_op7(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").orderBy("doc_id").collect()
    fps = [plain_fingerprint(d["text"]) for d in docs]
    links = [(i, j) for i in range(len(fps)) for j in range(i) if bin(fps[i] ^ fps[j]).count("1") <= 4]
    comp = plain_components(len(fps), links)
    want = {d["doc_id"]: (f"{f:016x}", docs[c]["doc_id"]) for d, f, c in zip(docs, fps, comp)}
    assert {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in queries.op7_simhash(spark, sf_dir).collect()} == want


def test_components(spark):
    rng = random.Random(5)
    for edges in ([(i, i + 1) for i in range(40)], [(0, i) for i in range(1, 50)], [(rng.randrange(90), rng.randrange(90)) for _ in range(60)], []):
        df = spark.createDataFrame(edges, "a bigint, b bigint")
        got = {r["node"]: r["root"] for r in graph.components(df).collect()}
        want = plain_components(90, edges)
        assert got == {n: want[n] for e in edges for n in e if any(a != b and n in (a, b) for a, b in edges)}


def plain_passages(texts, length):
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts]
    starts = {}
    for d, w in enumerate(words):
        for s in range(len(w) - length + 1):
            starts.setdefault(tuple(w[s : s + length]), []).append((d, s))
    gone = {(d, s + i) for places in starts.values() if len(places) > 1 for d, s in places for i in range(length)}
    return [[x for i, x in enumerate(w) if (d, i) not in gone] for d, w in enumerate(words)], words


def check_passages(spark, texts, length, phrase):
    rows = [(i, t, "s") for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, spans string")
    kept, words = plain_passages(texts, length)
    got = {r["row"]["doc_id"]: r for r in passages.repeated_passages(df, "text", length, phrase).collect()}
    assert len(got) == len(texts)
    for i, (k, w) in enumerate(zip(kept, words)):
        r = got[i]
        assert (r["n_words"], r["n_removed"]) == (len(w), len(w) - len(k)), i
        assert r["kept_sha256"] == hashlib.sha256(" ".join(k).encode()).hexdigest()
        assert r["text"] == (texts[i] if len(k) == len(w) else " ".join(k))


def test_passages(spark):
    rng = random.Random(6)
    shared = [[f"s{rng.randrange(50)}" for _ in range(rng.choice((11, 12, 13, 30)))] for _ in range(6)]
    texts = [None, "", "  \n", "a b", "x " * 40, "copy " + " ".join(shared[3]) + " of all", "copy " + " ".join(shared[3]) + " of all"]
    for _ in range(60):
        parts = []
        for _ in range(rng.randrange(1, 5)):
            parts += [f"u{rng.randrange(400)}" for _ in range(rng.randrange(0, 30))] + (rng.choice(shared) if rng.random() < 0.5 else [])
        texts.append(rng.choice((" ", "\n", " \t ")).join(parts))
    check_passages(spark, texts, 12, 4)


def test_passages_long_text(spark):
    rng = random.Random(8)
    passage = " ".join(f"p{rng.randrange(9)}" for _ in range(50))
    long = " ".join(f"v{rng.randrange(10**6)}" for _ in range(60_000))
    check_passages(spark, [long + " " + passage, "é" * 3_000_000 + " " + passage, long[:2000]], 35, 8)


def test_remove_repeats_keeps_columns(spark):
    text = " ".join(f"w{i}" for i in range(40))
    df = spark.createDataFrame([(1, text, "a", 3), (2, "y " + text, None, 4), (None, None, "c", None)], "doc_id bigint, text string, `row` string, n_words int")
    out = passages.remove_repeats(df, "text")
    assert out.columns == df.columns
    assert sorted(map(tuple, out.collect()), key=str) == sorted([(1, "", "a", 3), (2, "y", None, 4), (None, None, "c", None)], key=str)
    assert passages.remove_repeats(df.limit(0), "text").count() == 0


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 200), unique=True).map(sorted), st.integers(1, 9))
def test_needed_covers_the_same(starts, length):
    need = passages._needed(np.array(starts, np.int64), length).tolist()
    cover = lambda ss: {s + i for s in ss for i in range(length)}
    assert set(need) <= set(starts) and cover(need) == cover(starts)
