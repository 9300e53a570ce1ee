"""Exact duplicates by tries against plain grouping."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from evalweave.llm import tries


def grouped(rows):
    """(doc_id, text) -> sorted (doc_id, keep_id, group_size, kept, sha); of rows that tie, one is kept."""
    groups = {}
    for doc_id, text in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", text or ""), []).append((-len(text or ""), doc_id is None, doc_id or 0, doc_id))
    out = []
    for body, members in groups.items():
        members.sort(key=lambda m: m[:3])
        for i, m in enumerate(members):
            out.append((m[3], members[0][3], len(members), i == 0, hashlib.sha256(body.encode()).hexdigest()))
    return sorted(out, key=str)


def found(df, **limits):
    out = tries.exact_duplicates(df, "text", [-F.coalesce(F.length("text"), F.lit(0)), F.col("doc_id")], **limits)
    rows = out.select("row.doc_id", F.col("owner.doc_id").alias("keep_id"), "group_size", "kept", "text_sha256").collect()
    return sorted(map(tuple, rows), key=str)


def texts(seed, n):
    rng = random.Random(seed)
    pool = ["", None, " ", "\n\t", "a", "aa", "aaa", "aab", "a b", "é", "É", "é", "x" * 3000, "x" * 2999 + "y", "x" * 5000, " x" * 3000, "日本 語", "日本語"]
    pool += ["".join(rng.choice("ab \n") for _ in range(rng.randrange(1, 9))) for _ in range(40)]
    return [rng.choice(pool) for _ in range(n)]


def test_trie_keeps_smallest():
    rng = random.Random(2)
    words = [bytes(rng.choice(b"ab") for _ in range(rng.randrange(0, 12))) for _ in range(3000)]
    trie, least = tries.Trie(), {}
    nodes = [trie.insert(w, (i * 7919) % 3000) for i, w in enumerate(words)]
    for i, w in enumerate(words):
        least[w] = min(least.get(w, 9999), (i * 7919) % 3000)
    assert [n.owner for n in nodes] == [least[w] for w in words]
    # Compressed: every inner node is a fork or the end of a text.
    for n in tries.below(trie.root)[1:]:
        assert n.edge and (len(n.children) != 1 or n.owner is not None)
    assert len({id(n) for n in nodes}) == len(set(words))


def test_shared_prefix():
    for a, b, n in ((b"", b"", 0), (b"abc", b"abd", 2), (b"abc", b"abc", 3), (b"abc", b"ab", 2), (b"xbc", b"abc", 0)):
        assert tries.shared_prefix(a, b) == n


def test_subtrees_leave():
    rng = random.Random(3)
    words = [b"common" + bytes(rng.choice(b"abc") for _ in range(rng.randrange(0, 9))) for _ in range(500)]
    trie = tries.Trie(20 * tries.NODE)
    nodes = [trie.insert(w, i) for i, w in enumerate(words)]
    assert trie.departed and trie.weight <= 22 * tries.NODE + 200
    left = [w for w, n in zip(words, nodes) if n.left]
    stay = [w for w, n in zip(words, nodes) if not n.left]
    assert left and not set(left) & set(stay)  # a text leaves or stays with all its copies
    for w in set(stay):
        assert {n.owner for v, n in zip(words, nodes) if v == w} == {words.index(w)}


@pytest.mark.parametrize(
    "limits",
    [{}, {"gathered": 1}, {"gathered": 1, "fan_in": 3}, {"gathered": 3000, "budget": 4000}, {"gathered": 1, "fan_in": 2, "budget": 1200, "part_bytes": 1 << 30}],
)
def test_duplicates(spark, limits):
    rng = random.Random(5)
    rows = [(rng.choice((None, i, 7)), t) for i, t in enumerate(texts(4, 200))]
    df = spark.createDataFrame([(i, t, "e", 1.5, [i]) for i, t in rows], "doc_id bigint, text string, entry string, n double, order array<bigint>").repartition(4)
    assert found(df, **limits) == grouped(rows)
    kept = tries.exact_duplicates(df, "text", [F.col("doc_id")], **limits)
    assert kept.where("kept").count() == kept.select("text_sha256").distinct().count()


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id bigint, text string")
    assert found(df) == []


def test_hash_does_not_decide(spark, monkeypatch):
    """With one hash for all texts of a length, the tries alone tell texts apart."""
    monkeypatch.setattr(F, "xxhash64", lambda *c: F.lit(1).cast("bigint"))
    rows = [(i, t) for i, t in enumerate(texts(6, 120))]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert found(df, gathered=1, fan_in=50) == grouped(rows)
