"""Quality and toxicity: gradients, held-out accuracy, odd inputs."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from evalweave.llm import quality, queries, toxicity


def held_out(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 5 == 0


@pytest.fixture(scope="module")
def larger():
    return "/root/testdata/sf0.01"


def test_bradley_terry_ranks():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(400, 3))
    y = (x @ [2.0, -1.0, 0.0] + rng.normal(size=400) * 0.1 > -1).astype(int)
    pairs = quality.preference_pairs(x, y, 4, 1)
    w = quality.fit_bradley_terry(pairs)
    assert w[0] > 0 > w[1] and abs(w[2]) < abs(w[1])
    # At the minimum the gradient of loss and ridge is zero.
    p = 1 / (1 + np.exp(-pairs @ w))
    assert np.abs(w - pairs.T @ (1 - p)).max() < 1e-6
    assert not quality.fit_bradley_terry(quality.preference_pairs(x, np.ones(400, int), 4, 1)).any()


def test_op2_held_out(spark, larger):
    rows = {r["doc_id"]: r for r in queries.op2_quality_ranking(spark, larger).collect()}
    labels = spark.read.parquet(f"{larger}/labels.parquet").collect()
    assert len(rows) == spark.read.parquet(f"{larger}/documents.parquet").count()
    for i, r in rows.items():
        assert r["held_out"] == held_out(i) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3)
    mine = [(rows[x["doc_id"]]["predicted"], x["quality"]) for x in labels if held_out(x["doc_id"])]
    assert np.mean([p == y for p, y in mine]) >= 0.95
    # Nearly no good document is rejected.
    good = [rows[x["doc_id"]]["predicted"] for x in labels if x["quality"] == 1]
    assert np.mean(good) >= 0.99


def test_cut_agrees_best(spark):
    """Against every strength tried as a cut; ties of strengths stand on one side, a tie of cuts goes to the lower one."""
    rng = np.random.default_rng(3)
    strength = np.round(rng.normal(size=300), 1)
    label = (strength + rng.normal(size=300) > 0.4).astype(int)
    rows = spark.createDataFrame([(float(a), int(b)) for a, b in zip(strength, label)], "strength double, label int")
    at, gap = quality.cut_at_quantile(rows, rows)
    tried = {c: int(((strength >= c) == (label == 1)).sum()) for c in np.unique(strength)}
    best = min(c for c, n in tried.items() if n == max(tried.values()))
    assert at <= best < at + 2 * gap + 1e-9 and ((strength >= at) == (strength >= best)).all()
    assert quality.cut_at_quantile(rows.where("false"), rows.where("false")) == (0.0, 1.0)


def test_quality_odd_inputs(spark):
    docs = spark.createDataFrame([(1, None, 1.0), (2, "", 2.0), (2, "x*** y***", 0.0), (None, "a b", 0.0), (5, "é" * 200000, 0.0)], "doc_id bigint, text string, features double")
    labels = spark.createDataFrame([(1, None), (2, 1), (None, 0), (77, 0)], "doc_id bigint, quality int")
    model, prints = quality.fit_quality(docs, "doc_id", "text", labels, "doc_id", "quality", F.lit(True))
    scores = [r["s"] for r in prints.select(model.score(F.col("features")).alias("s")).collect()]
    assert len(scores) == 5 and all(abs(s - 0.3) < 1e-9 for s in scores)
    kept = quality.keep_good(docs, "text", model)
    assert kept.columns == docs.columns and kept.count() == 5
    model, prints = quality.fit_quality(docs.limit(0), "doc_id", "text", labels, "doc_id", "quality", F.lit(True))
    assert prints.count() == 0 and quality.keep_good(docs.limit(0), "text", model).count() == 0


def test_keep_good_agrees_with_scores(spark, larger):
    docs = spark.read.parquet(f"{larger}/documents.parquet")
    model, prints = queries.quality_model(spark, docs.select("doc_id", "text"), larger)
    want = {r["doc_id"] for r in prints.where(model.score(F.col("features")) >= 0.3 - 1e-9).collect()}
    assert {r["doc_id"] for r in quality.keep_good(docs, "text", model).collect()} == want


def test_gradients():
    rng = np.random.default_rng(3)
    net = toxicity.Network(np.arange(1, 12, dtype=np.uint64), width=4, hidden=3, seed=1)
    for n in net.NAMES:
        setattr(net, n, getattr(net, n).astype(np.float64) + rng.normal(size=getattr(net, n).shape) * 0.3)
    vectors = rng.normal(size=(7, 4))
    index = np.array([[0, 1, 2, 3, 4], [5, 6, 0, -1, -1], [2, -1, -1, -1, -1]])
    slope = np.array([0.7, -1.2, 0.4])

    def value():
        gates = np.einsum("nw,dwg->dng", vectors, net.W) + net.b[:, None]
        gates = np.concatenate([gates, np.zeros((2, 1, gates.shape[2]))], axis=1)
        return gates, float(net.forward(gates, index) @ slope)

    gates, _ = value()
    _, kept = net.forward(gates, index, keep=True)
    g = net.backward(slope, kept)
    flat, by_place = np.zeros((2, 8, 9)), g.pop("gates")
    for way in (0, 1):
        np.add.at(flat[way], index.T.ravel(), by_place[way].reshape(-1, 9))
    g["b"], g["W"] = flat[:, :-1].sum(axis=1), np.einsum("nw,dng->dwg", vectors, flat[:, :-1])
    for n in ("U", "b", "W", "A", "c", "v", "o", "d"):
        p = getattr(net, n)
        for at in [tuple(rng.integers(s) for s in p.shape) for _ in range(6)]:
            old = p[at]
            p[at] = old + 1e-3
            up = value()[1]
            p[at] = old - 1e-3
            down = value()[1]
            p[at] = old
            assert abs((up - down) / 2e-3 - g[n][at]) < 2e-3 * max(1, abs(g[n][at])), (n, at)


def test_windows_cover_every_word():
    counts = np.array([0, 1, 23, 24, 25, 40, 41, 1000])
    text, start = toxicity.windows(counts)
    for i, n in enumerate(counts):
        own = start[text == i]
        assert len(own) >= 1 and set(range(n)) <= {s + j for s in own for j in range(toxicity.WINDOW)}
        assert len(own) == 1 or (np.diff(own) == toxicity.STRIDE).all()


def test_words_do_not_depend_on_neighbours():
    words = ["idiot", "naïve", "x", "abc123", "longerword" * 9]
    _, number, together = toxicity.word_inputs(" ".join(words).encode())
    for w, k in zip(words, number):
        assert (toxicity.word_inputs(w.encode())[2][0] == together[k]).all()


def test_learns_planted_words():
    rng = random.Random(2)
    pool = [f"{a}{b}" for a in ("al", "be", "ga", "de") for b in ("pha", "ta", "mma", "lta", "ps", "ze")]

    def text(toxic):
        words = [rng.choice(pool) for _ in range(rng.randrange(5, 120))]
        if toxic:
            words[rng.randrange(len(words))] = rng.choice(("vilex", "vilexes", "nastyz"))
        return " ".join(words)

    y = np.array([i % 3 == 0 for i in range(900)], int)
    texts = [text(t) for t in y]
    net = toxicity.train(texts[:700], y[:700])
    scores = toxicity.score_texts(net, texts[700:])
    assert np.mean((scores >= 0.5) == y[700:]) >= 0.97
    # A text scores the same alone, and in whatever company.
    assert np.allclose(toxicity.score_texts(net, texts[705:706]), scores[5:6], atol=1e-5)


def test_op3_held_out(spark, larger):
    rows = {r["doc_id"]: r for r in queries.op3_toxicity(spark, larger).collect()}
    labels = [x for x in spark.read.parquet(f"{larger}/labels.parquet").collect() if held_out(x["doc_id"])]
    assert all(r["held_out"] == held_out(i) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for i, r in rows.items())
    # 320 labelled rows teach little; more than the share of the larger label nevertheless.
    assert np.mean([rows[x["doc_id"]]["predicted"] == x["toxic"] for x in labels]) >= 0.85


def test_excerpts_come_from_the_whole_text():
    words = [f"w{i}" for i in range(40_000)]
    text = " ".join(words)
    short = toxicity.excerpt(text, 65_536)
    assert len(short.encode()) <= 65_536 and short == toxicity.excerpt(text, 65_536)
    kept = [int(w[1:]) for w in short.split()]
    assert kept == sorted(set(kept)) and all(any(a <= k < a + 2000 for k in kept) for a in range(0, 40_000, 2000))
    assert all(text[: 10 * i] == toxicity.excerpt(text[: 10 * i], 65_536) for i in (0, 1, 600))
    assert toxicity.excerpt("é" * 70_000, 1000).strip("é\n") == "" and 0 < len(toxicity.excerpt("é" * 70_000, 1000).encode()) <= 1000


def test_cues_of_long_texts_are_learnt(spark):
    """Label 1 stands only on texts of more than the bytes that are learnt from; the cue stands nowhere else."""
    rng = random.Random(12)
    pool = [f"{a}{b}" for a in ("lor", "ips", "dol", "sit", "am", "con") for b in ("em", "um", "or", "it", "et", "ect")]

    def text(words, cue):
        own = [rng.choice(pool) for _ in range(words)]
        for at in range(rng.randrange(30), words if cue else 0, 40):
            own[at] = "vilecue"
        return " ".join(own)

    rows = [(i, text(1200 if i % 2 or i % 4 == 0 else 60, i % 2 == 1), i % 2) for i in range(240)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id bigint, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id bigint, toxic int")
    scores = toxicity.toxicity_scores(docs, "doc_id", "text", labels, "doc_id", "toxic", F.col("doc_id") < 180, sample_bytes=2000)
    got = {r["doc_id"]: r["score"] for r in scores.collect()}
    held = [(got[i], y) for i, _, y in rows if i >= 180]
    assert sum((s >= 0.5) == (y == 1) for s, y in held) >= 0.95 * len(held)


def test_toxicity_odd_inputs(spark):
    docs = spark.createDataFrame([(1, None, 1.0), (2, "", 2.0), (2, "so bad", 0.0), (None, "a b", 0.0), (5, "é" * 200000, 0.0)], "doc_id bigint, text string, score double")
    for pairs, low, high in (([(1, 1), (2, None)], 0, 0.1), ([(2, 1)], 0.9, 1), ([(2, 0), (5, 0)], 0, 0.1), ([], 0, 0.1)):
        labels = spark.createDataFrame(pairs, "doc_id bigint, toxic int")
        scores = [r["score"] for r in toxicity.toxicity_scores(docs, "doc_id", "text", labels, "doc_id", "toxic", F.lit(True)).collect()]
        assert len(scores) == 5 and all(low <= s <= high for s in scores)
    assert toxicity.toxicity_scores(docs.limit(0), "doc_id", "text", labels, "doc_id", "toxic", F.lit(True)).count() == 0


def test_long_words_are_read_whole():
    """Runs without blanks: every byte counts, and what stands beside a text does not."""
    rng = random.Random(4)
    pool = [chr(c) for c in range(0x4E00, 0x4E28)]

    def text(toxic):
        chars = [rng.choice(pool) for _ in range(rng.randrange(60, 200))]
        if toxic:
            chars[rng.randrange(20, len(chars) - 5)] = "毒"
        return "".join(chars)

    y = np.array([i % 3 == 0 for i in range(600)], int)
    texts = [text(t) for t in y]
    net = toxicity.train(texts[:450], y[:450])
    assert np.mean((toxicity.score_texts(net, texts[450:]) >= 0.5) == y[450:]) >= 0.95
    pair = [texts[0][:40] + "甲" * 30 + "毒乙丙", texts[0][:40] + "甲" * 30 + "乙丙丁"]
    assert np.allclose(toxicity.score_texts(net, pair), [toxicity.score_texts(net, [t])[0] for t in pair], atol=1e-5)
    for raw in ("x" * 100 + "é" * 30, "a" * 41, "ab " + "日本" * 20 + "z9" * 9 + " c", "q" * 40):
        raw = raw.encode()
        starts, ends = toxicity._starts(np.frombuffer(raw, np.uint8))
        assert b"".join(raw[a:b] for a, b in zip(starts, ends)) == raw.replace(b" ", b"")
        assert all(raw[a:b].decode() and b - a <= 40 for a, b in zip(starts, ends))
