"""Alignment of two tokenizers against the libraries and plain loops."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
import sentencepiece
from tokenizers import Tokenizer

from evalweave.llm import alignment, queries

A_FILE, B_FILE = queries.content(queries.BYTE_TOKENIZER), queries.content(queries.PIECE_TOKENIZER)

ODD = [
    None, "", " ", "\n", "  two  blanks ", "a", "x" * 3000, " " * 500 + "end", "tab\t\tnew\n\n\nline  \r\n end \n  ", "a\n b", "a \n  b　 c\xa0 d ",
    "日本語のテキスト。漢字", "🙂👩‍👩‍👧 emoji‍", "<|endoftext|> </s> <s> <unk> <0x41>", "x▁z", "\x00 \x01", "naïve ﬁ é", "it's 'll 12.5% #$&  ??",
]


@pytest.fixture(scope="module")
def libraries():
    a = Tokenizer.from_str(A_FILE.decode())
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_proto=B_FILE)


def random_texts(n, seed=1):
    rng = random.Random(seed)
    pool = [c for t in ODD if t for c in t if c != "▁"] + list("  \n\t.,'!?-") * 30 + list("abcdefghijklmnopqrstuvwxyz") * 20
    return ["".join(rng.choice(pool) for _ in range(rng.randrange(1, 300))) for _ in range(n)]


def token_bytes(libraries):
    a, b = libraries
    unit = {c: x for c, x in alignment.byte_level_alphabet().items()}
    first = {i: bytes(unit[c] for c in t) for t, i in a.get_vocab(with_added_tokens=False).items()}
    second = {}
    for i in range(b.get_piece_size()):
        p = b.id_to_piece(i)
        second[i] = bytes([int(p[3:5], 16)]) if re.fullmatch("<0x..>", p) else p.replace("▁", " ").encode()
    return first, second


def plain(libraries, texts):
    """(n_a, n_b, n_groups, n_links, n_best, count_sum, groups) by loops over all token pairs."""
    a_lib, b_lib = libraries
    first, second = token_bytes(libraries)
    docs, counts = [], Counter()
    for text in texts:
        a = a_lib.encode(" " + text, add_special_tokens=False).ids if text else []
        b = b_lib.encode(text) if text else []
        raw = (" " + text).encode() if text else b""
        if b"".join(first[i] for i in a) != raw or b"".join(second[i] for i in b) != raw:
            a, b = [], []
        a_ends, b_ends = (np.cumsum([len(x[i]) for i in ids]).tolist() if ids else [] for x, ids in ((first, a), (second, b)))
        links = []
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                if max([0, *a_ends][i], [0, *b_ends][j]) < min(a_ends[i], b_ends[j]):
                    links.append((x, y))
        counts.update(links)
        groups, i, j = [], 0, 0
        for end in sorted(set(a_ends) & set(b_ends)):
            i2, j2 = a_ends.index(end) + 1, b_ends.index(end) + 1
            groups.append(",".join(map(str, a[i:i2])) + "|" + ",".join(map(str, b[j:j2])))
            i, j = i2, j2
        docs.append((a, b, groups, links))
    top = Counter()
    for (_, y), n in counts.items():
        top[y] = max(top[y], n)
    return [
        (len(a), len(b), len(g), len(ls), sum(counts[p] == top[p[1]] for p in ls), sum(counts[p] for p in ls), ";".join(g))
        for a, b, g, ls in docs
    ]


def test_units_as_libraries(libraries):
    pair = alignment.TokenPair(A_FILE, B_FILE)
    a, b = libraries
    texts = [t for t in ODD if t and "▁" not in t] + random_texts(1500)
    texts.append("long " + "  ".join(random_texts(9000, 7)).strip())  # worked on by stretches
    assert len(texts[-1]) > 1 << 20
    for text, (first, second) in zip(texts, pair.encode(texts), strict=True):
        assert first.tolist() == a.encode(" " + text, add_special_tokens=False).ids, repr(text[:500])
        assert second.tolist() == b.encode(text), repr(text[:500])
    assert [len(x) for x in next(pair.encode(["x▁z"]))] == [0, 0]
    assert [[len(x) for x in ids] for ids in pair.encode(["", "x▁z y", "y"])] == [[0, 0], [0, 0], [1, 1]]


@pytest.mark.parametrize("limit", [5, 60])
def test_units_met_once_are_forgotten(monkeypatch, libraries, limit):
    monkeypatch.setattr(alignment, "REMEMBERED", limit)
    monkeypatch.setattr(alignment, "UNITS", 20)
    pair = alignment.TokenPair(A_FILE, B_FILE)
    texts = random_texts(60, 5) + ["the end of the end"] * 5 + random_texts(20, 5)
    for text, ids in zip(texts, pair.encode(texts), strict=True):
        assert ids[0].tolist() == libraries[0].encode(" " + text, add_special_tokens=False).ids
        assert ids[1].tolist() == libraries[1].encode(text)


@pytest.mark.parametrize("stride", [2, 3, 8])
def test_gallop(monkeypatch, stride):
    monkeypatch.setattr(alignment, "STRIDE", stride)
    rng = np.random.default_rng(stride)
    for n, m in ((0, 0), (0, 5), (5, 0), (1, 1), (3, 200), (200, 3), (300, 300), (500, 499), (20, 500)):
        short, long = (np.sort(rng.choice(500, k, replace=False)) for k in (n, m))
        ranks, found = alignment.gallop(short, long)
        assert ranks.tolist() == np.searchsorted(long, short).tolist()
        assert found.tolist() == np.isin(short, long).tolist()


COLUMNS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")


@pytest.mark.parametrize("broadcast", [10**6, 20, 0])
def test_alignment(spark, libraries, monkeypatch, broadcast):
    # Also by pieces of a few tokens; the functions travel to the workers with their module's values.
    monkeypatch.setattr(alignment.Aligned.pieces, "__defaults__", (alignment.TOKENS if broadcast else 7,))
    texts = ODD + random_texts(30, 3) + ["the the the end"] * 3
    rows = [(i if i else None, t, "x", 1.5) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, groups string, at double")
    got = alignment.align_tokenizers(df, "text", A_FILE, B_FILE, broadcast)
    found = {r["row"]["doc_id"] or 0: (*[r[c] for c in COLUMNS], r["groups"]) for r in got.collect()}
    assert found == dict(enumerate(plain(libraries, texts)))
    got = alignment.align_tokenizers(df, "text", A_FILE, B_FILE, broadcast, digest=True).collect()
    for r in got:
        spelled = found[r["row"]["doc_id"] or 0][-1]
        assert r["groups_sha256"] == (hashlib.sha256(spelled.encode()).hexdigest() if spelled else "")
    empty = df.limit(0)
    assert alignment.align_tokenizers(empty, "text", A_FILE, B_FILE, broadcast).count() == 0


def test_op11(spark, sf_dir, libraries):
    docs = sorted(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect())
    want = plain_by_ranges(libraries, [d["text"] for d in docs])
    got = {r["doc_id"]: r for r in queries.op11_token_alignment(spark, sf_dir).collect()}
    assert len(got) == len(docs)
    for d, w in zip(docs, want):
        r = got[d["doc_id"]]
        assert tuple(r[c] for c in COLUMNS) == w[:-1]
        assert r["groups_sha256"] == (hashlib.sha256(w[-1].encode()).hexdigest() if w[-1] else "")


def plain_by_ranges(libraries, texts):
    """As ``plain``, with one merge over both lists instead of all pairs of tokens."""
    a_lib, b_lib = libraries
    first, second = token_bytes(libraries)
    docs, counts = [], Counter()
    for text in texts:
        a, b = a_lib.encode(" " + text, add_special_tokens=False).ids, b_lib.encode(text)
        raw = (" " + text).encode()
        if not text or b"".join(first[i] for i in a) != raw or b"".join(second[i] for i in b) != raw:
            a, b = [], []
        links, groups, i, j, at, bt = [], [], 0, 0, 0, 0
        own, other = [], []
        while i < len(a):
            links.append((a[i], b[j]))
            x, y = at + len(first[a[i]]), bt + len(second[b[j]])
            if x <= y:
                own.append(str(a[i]))
                i, at = i + 1, x
            if y <= x:
                other.append(str(b[j]))
                j, bt = j + 1, y
            if x == y:
                groups.append(",".join(own) + "|" + ",".join(other))
                own, other = [], []
        counts.update(links)
        docs.append((a, b, groups, links))
    top = Counter()
    for (_, y), n in counts.items():
        top[y] = max(top[y], n)
    return [
        (len(a), len(b), len(g), len(ls), sum(counts[p] == top[p[1]] for p in ls), sum(counts[p] for p in ls), ";".join(g))
        for a, b, g, ls in docs
    ]
