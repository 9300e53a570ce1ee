"""Phrase index, URL filter, top-k, shards and the pipeline against brute force."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from check import compare, connect
from evalweave.llm import hostrank, phraseindex, queries, sharding, simhash, topk


@pytest.mark.parametrize("name", list(queries.ORACLES))
def test_sql(spark, sf_dir, name):
    assert compare(connect(sf_dir), spark, sf_dir, queries.QUERIES[name], queries.ORACLES[name]) is None


def plain_words(text):
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)


def plain_contamination(texts, items, n):
    windows = {}
    for item, text in items:
        w = plain_words(text)
        for s in range(max(1, len(w) - n + 1)) if w else ():
            windows.setdefault(tuple(w[s : s + n]), set()).add(item)
    out = []
    for text in texts:
        w, hit, found = plain_words(text), set(), set()
        for size in {len(k) for k in windows}:
            for s in range(len(w) - size + 1):
                if (k := tuple(w[s : s + size])) in windows:
                    hit.update(range(s, s + size))
                    found |= windows[k]
        out.append((len(w), len(hit), sorted(map(str, found))))
    return out


def test_contamination(spark):
    rng = random.Random(1)
    word = lambda: rng.choice(("the", "of", "Ab", "x1", "é", "É", "zzz"))
    items = [(i, " ".join(word() for _ in range(rng.choice((1, 3, 5, 9))))) for i in range(10)] + [(50, None), (51, "  !"), (3, "the of")]
    texts = [None, "", "...", "the " * 300, "É-é", "Ab,AB;ab"] + [rng.choice((" ", "-", "\n")).join(word() for _ in range(rng.randrange(60))) for _ in range(50)]
    rows = [(i, t, "w") for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, w string")
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    want = plain_contamination(texts, items, 4)
    for keep in (1, 3):
        got = {r["doc_id"]: (r["n_words"], r["n_hit"], r["item_ids"]) for r in phraseindex.contamination(docs, "doc_id", "text", bench, "item_id", "text", 4, keep).collect()}
        assert got == dict(enumerate(want))
    none = phraseindex.contamination(docs, "doc_id", "text", bench.limit(0), "item_id", "text", 4).collect()
    assert len(none) == len(texts) and all(r["n_hit"] == 0 and r["item_ids"] == [] for r in none)
    assert phraseindex.contamination(docs.limit(0), "doc_id", "text", bench, "item_id", "text", 4).count() == 0


def test_terms_in_several_passes(spark, monkeypatch):
    monkeypatch.setattr(phraseindex, "TERMS_PER_PASS", 2)
    docs = spark.createDataFrame([(1, "a b c d e"), (2, "x a b c"), (3, "e d c b a")], "doc_id bigint, text string")
    bench = spark.createDataFrame([(7, "a b c"), (8, "d e"), (9, "x y")], "item_id bigint, text string")
    got = {r["doc_id"]: (r["n_hit"], r["item_ids"]) for r in phraseindex.contamination(docs, "doc_id", "text", bench, "item_id", "text", 3).collect()}
    assert got == {1: (5, ["7", "8"]), 2: (3, ["7"]), 3: (0, [])}


def test_lists_meet_before_texts_are_read(spark):
    """The intersection decides which places are compared: rare terms beside their places never meet, whatever stands around them."""
    docs = spark.createDataFrame(
        [(1, "the rare of odd"), (2, "the rare of the odd"), (3, "odd of rare the"), (4, "no rare of odd"), (5, "rare of odd"), (6, "the rare of")],
        "doc_id bigint, text string",
    )
    more = spark.range(20, 60).select(F.col("id").alias("doc_id"), F.lit("the of no").alias("text"))
    bench = spark.createDataFrame([(7, "the rare of odd")], "item_id bigint, text string")
    index = phraseindex.PhraseIndex(docs.unionByName(more), "doc_id", "text", bench, "item_id", "text", 4, keep=2)
    assert {r["term"] for r in index.rarest.collect()} == {"rare", "odd"}
    assert {r["doc_id"] for r in index.postings.collect()} == {1, 2, 3, 4, 5, 6}
    # Document 4 meets with another first word and 5 would start before its text; only the text rules out 4.
    assert sorted((r["doc_id"], r["start"]) for r in index.meetings().collect()) == [(1, 0), (4, 0)]
    assert [(r["doc_id"], r["start"], r["len"]) for r in index.phrases().collect()] == [(1, 0, 4)]
    # Without postings nothing is found: no other path looks at the texts.
    index.postings = index.postings.limit(0)
    assert index.phrases().count() == 0


def test_tables_of_items_beyond_the_broadcast(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "a b c d e"), (2, "x a b c"), (3, "e d c b a"), (4, None), (4, "the " * 99 + "a b c")], "doc_id bigint, text string")
    keyed = docs.select(F.struct("doc_id", F.xxhash64("text").alias("h")).alias("key"), "text")
    bench = spark.createDataFrame([(7, "a b c"), (8, "d e"), (9, "x y"), (10, "the the the")], "item_id bigint, text string")

    def rows():
        out = phraseindex.contamination(keyed, "key", "text", bench, "item_id", "text", 3).collect()
        return sorted((r["key"]["doc_id"], r["n_words"], r["n_hit"], tuple(r["item_ids"])) for r in out)

    want = [(1, 5, 5, ("7", "8")), (2, 4, 3, ("7",)), (3, 5, 0, ()), (4, 0, 0, ()), (4, 102, 102, ("10", "7"))]
    assert rows() == want
    for limit in ("TERMS_PER_PASS", "BROADCAST_WINDOWS"):
        monkeypatch.setattr(phraseindex, limit, 0)
    assert rows() == want


def test_proximity(spark):
    docs = spark.createDataFrame([(1, "alpha beta gamma"), (2, "alpha x beta gamma"), (3, "gamma beta alpha"), (4, "alpha beta x x x x x x gamma")], "doc_id bigint, text string")
    bench = spark.createDataFrame([(7, "alpha beta gamma")], "item_id bigint, text string")
    index = phraseindex.PhraseIndex(docs, "doc_id", "text", bench, "item_id", "text", 3, keep=3)
    assert {r["doc_id"] for r in index.phrases().collect()} == {1}
    assert {r["doc_id"] for r in index.proximity(1).collect()} == {1, 2}
    assert {r["doc_id"] for r in index.proximity(4).collect()} == {1, 2, 3}


def pages_of(spark, rows):
    return spark.createDataFrame([(i, u, h, "x") for i, (u, h) in enumerate(rows)], "page_id bigint, url string, html string, host string")


def test_url_parts_and_rules(spark):
    urls = [None, "", "no scheme", "http://", "HTTP://A.Example.NET", "http://a.example.net/en/x?y#z", "x://example.net/EN/", "http://b.net?q=/en/", "a://b://c/d",
            "http://badexample.com/de/1", "http://www.example.com/de/", "http://fr.org/fr/", "http://org/fr/a", "http://x.org/fr", "http://É.net/\n/p"]
    got = {r["page_id"]: r for r in hostrank.filter_urls(pages_of(spark, [(u, None) for u in urls]), "page_id", "url", "html", queries.URL_RULES).collect()}
    for i, u in enumerate(urls):
        m = re.search(r"://([^/?#]*)([^?#]*)", u or "")
        host, path = (re.sub("[A-Z]", lambda c: c[0].lower(), m[1]), m[2]) if m else ("", "")
        fits = [r for r in queries.URL_RULES if (host == r.split("/", 1)[0] or host.endswith("." + r.split("/", 1)[0])) and path.startswith("/" + r.split("/", 1)[1])]
        rule = max(fits, key=len, default=None)
        assert (got[i]["host"], got[i]["path"], got[i]["rule"]) == (host, path, rule), u
        assert got[i]["verdict"] == (queries.URL_RULES[rule] if rule else "allow")


def test_distrust_follows_links_backwards(spark):
    to = lambda *hosts: "".join(f'<a HREF="https://{h}/p">x</a><img src=//{h}/i>' for h in hosts)
    rows = [("http://bad.net/a", to("bad2.com"))] * 3 + [("http://farm.com/x", to("bad.net", "bad.net"))] * 2
    rows += [("http://fan.com/x", to("farm.com"))] + [("http://good.org/fr/1", to("friend.com"))] * 4 + [("http://friend.com/x", '<a href="/local">')] * 2
    rows += [("http://lone.com/x", None)]
    got = {r["host"]: r["verdict"] for r in hostrank.filter_urls(pages_of(spark, rows), "page_id", "url", "html", queries.URL_RULES).collect()}
    # One step away most of what arrives is distrusted, two steps away no longer.
    assert got == {"bad.net": "block", "farm.com": "block", "fan.com": "allow", "good.org": "allow", "friend.com": "allow", "lone.com": "allow"}


def test_pagerank_against_loop(spark):
    rng = random.Random(3)
    names = [f"h{i}" for i in range(12)]
    edges = {(rng.choice(names[:9]), rng.choice(names)): float(rng.randrange(1, 5)) for _ in range(25)}
    edges = {e: w for e, w in edges.items() if e[0] != e[1]}
    seeds = {n: float(rng.randrange(3)) for n in names}
    mass = dict(seeds)
    for _ in range(5):
        out = {n: 0.15 * seeds[n] for n in names}
        for n in names:
            links = {b: w for (a, b), w in edges.items() if a == n}
            for b, w in (links or {n: 1.0}).items():
                out[b] += 0.85 * mass[n] * w / sum(links.values() or [1.0])
        mass = out
    got = hostrank.pagerank(
        spark.createDataFrame([(n, s, 2 * s) for n, s in seeds.items()], "host string, s double, s2 double"),
        spark.createDataFrame([(a, b, w) for (a, b), w in edges.items()], "src string, dst string, weight double"), ["s", "s2"], 0.85, 5,
    )
    rows = got.collect()
    assert {r["host"]: pytest.approx(r["s"]) for r in rows} == mass and all(r["s2"] == pytest.approx(2 * r["s"]) for r in rows)


def test_links_in_sql(spark, tmp_path):
    """The SQL agrees on pages that link to each other, which those of the test tables do not."""
    rng = random.Random(7)
    hosts = [f"h{i}.{d}" for i in range(6) for d in ("net", "example.net", "example.com", "org", "com")]
    rows = []
    for _ in range(200):
        links = "".join(rng.choice((f'<a href="http://{h}/x">', f"<img SRC=//{h.upper()}?q>", "<a href='/own'>")) for h in rng.choices(hosts, k=rng.randrange(5)))
        rows.append((f"http://{rng.choice(hosts)}/{rng.choice(('en', 'de', 'fr'))}/", links))
    pages_of(spark, rows).write.parquet(f"{tmp_path}/pages")
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{tmp_path}/pages/*.parquet')")
    want = sorted(con.execute(queries.ORACLES["op6_url_filter"]).fetchall())
    got = hostrank.filter_urls(spark.read.parquet(f"{tmp_path}/pages"), "page_id", "url", "html", queries.URL_RULES)
    assert sorted(map(tuple, got.collect())) == want and {"allow", "block"} == {r[4] for r in want}


def test_empty_pages(spark):
    assert hostrank.filter_urls(pages_of(spark, [("a", "b")]).limit(0), "page_id", "url", "html", queries.URL_RULES).count() == 0


def test_topk_against_loop(spark, monkeypatch):
    rng = random.Random(4)
    monkeypatch.setattr(topk, "CANDIDATES", 64)
    monkeypatch.setattr(topk, "QUERIES", 3)
    vec = lambda n: [rng.choice((-1.5, -0.3, 0.0, 0.25, 0.9, 1e-4)) for _ in range(n)]
    rows = [(i, vec(40), "s") for i in range(300)] + [(900, vec(8), "s"), (901, vec(8), "s"), (1000, [], "s"), (1001, [], "s")]
    rows += [(i, v, "s") for i, v in ((1100, None), (1200, [None] * 40), (1201, [float("nan")] * 40), (1202, [float("inf")] + [0.0] * 39), (None, vec(40)))]
    rows += [(300 + i, rows[7][1], "s") for i in range(20)]  # ties
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, score string")
    vectors = topk.quantised(df, "vec_id", "embedding")
    quantised = {r["id"]: r["v"] for r in vectors.collect()}
    assert set(quantised) == {r[0] for r in rows} - {1100, 1200, 1201, 1202, None}
    got = {}
    for r in topk.exact_topk(vectors, vectors.where("id % 100 = 0"), 10).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    want = {}
    for q in (i for i in quantised if i % 100 == 0):
        scores = [(-sum(a * b for a, b in zip(quantised[q], v)), i) for i, v in quantised.items() if i != q and len(v) == len(quantised[q])]
        want[q] = [(i, -s) for s, i in sorted(scores)[:10]]
    assert got == {q: w for q, w in want.items() if w}
    assert topk.exact_topk(vectors.limit(0), vectors.limit(0), 10).count() == 0


def test_bounds_prune():
    import numpy as np

    rng = np.random.default_rng(1)
    block = np.round(rng.normal(size=(64, 2000)) * np.exp(-np.arange(64) / 6)[:, None] * 500)
    query = block[:, 5] * 3
    rests = topk._rests(block)
    places, scores = topk.branch_and_bound(query, topk._rests(query[:, None])[:, 0], block, rests, -np.inf, 10)
    exact = query @ block
    assert len(places) < 1000 and set(np.argsort(-exact)[:10]) <= set(places) and (exact[places] == scores).all()


def test_shards(spark):
    rng = random.Random(5)
    rows = [(rng.randrange(40) if i % 9 else None, rng.choice((1, 1, 5, 80, None)), i) for i in range(500)] + [(3, 900, 7)] * 3
    df = spark.createDataFrame(rows, "k bigint, bytes bigint, slot bigint")
    got = sharding.shard_by_bytes(df, [F.col("k")], F.col("bytes"), 8).collect()
    assert len(got) == len(rows)
    got.sort(key=lambda r: (r["shard"], r["slot"]))
    keys = [(r["k"] is not None, r["k"] or 0) for r in got]
    assert keys == sorted(keys)
    total, at = sum(r[1] or 0 for r in rows), 0
    for j in range(8):
        own = [r for r in got if r["shard"] == j]
        assert [r["slot"] for r in own] == list(range(len(own)))
    for r in got:
        assert r["shard"] == min(7, at * 8 // total)
        at += r["bytes"] or 0
    assert sharding.shard_by_bytes(df.limit(0), [F.col("k")], F.col("bytes"), 8).count() == 0
    assert {(r["shard"], r["slot"]) for r in sharding.shard_by_bytes(df.limit(1), [F.col("k")], F.lit(0), 8).collect()} == {(0, 0)}


def test_shards_are_exact_at_borders(spark):
    """A row that starts one byte before a border belongs to the shard before it, however large the total."""
    for total, k in ((8_000_000_000, 8), (10**16 + 7, 7), (10**17, 3)):
        starts = sorted({0, *(max(0, total * j // k + d) for j in range(1, k) for d in (-1, 0, 1))})
        sizes = [b - a for a, b in zip(starts, [*starts[1:], total])]
        rows = [(i, s, "a", "b") for i, s in enumerate(sizes)]
        df = spark.createDataFrame(rows, "i bigint, _size bigint, _k0 string, row string")
        got = {r["i"]: (r["shard"], r["_size"], r["_k0"], r["row"]) for r in sharding.shard_by_bytes(df, [F.col("i")], F.col("_size"), k).collect()}
        assert got == {i: (min(k - 1, at * k // total), s, "a", "b") for i, (at, s) in enumerate(zip(starts, sizes))}


def test_pipeline(spark, sf_dir):
    """Each stage against a plain version on what the stage before kept."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    names = docs.columns
    scored = {r["doc_id"]: r["predicted"] for r in queries.op2_quality_ranking(spark, sf_dir).collect()}
    kept = corpus_pipeline.good_quality(spark, docs, sf_dir)
    rows = {r["doc_id"]: r.asDict() for r in kept.collect()}
    assert kept.columns == names and set(rows) == {i for i, p in scored.items() if p}

    second = corpus_pipeline.one_of_each_group(spark, kept, sf_dir)
    ids = sorted(rows)
    fps = [simhash._fingerprint(rows[i]["text"], 4) for i in ids]
    root = list(range(len(ids)))
    for _ in range(len(ids)):
        low = [min([root[j] for j in range(len(ids)) if bin(fps[i] ^ fps[j]).count("1") <= 4]) for i in range(len(ids))]
        if low == root:
            break
        root = low
    assert second.columns == names and {r["doc_id"] for r in second.collect()} == {ids[i] for i in set(root)}

    third = corpus_pipeline.without_repeats(spark, second, sf_dir)
    assert third.columns == names and third.count() == second.count()
    assert all(r["n_chars"] == len(r["text"]) for r in third.collect())

    fourth = corpus_pipeline.not_contaminated(spark, third, sf_dir)
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    texts = {r["doc_id"]: r["text"] for r in third.collect()}
    judged = dict(zip(texts, plain_contamination(texts.values(), items, 13)))
    assert fourth.columns == names
    assert {r["doc_id"] for r in fourth.collect()} == {i for i, (n, hit, _) in judged.items() if not (hit > 0 and 20 * hit >= n)}

    last = {r["doc_id"]: r for r in corpus_pipeline.run(spark, sf_dir).collect()}
    final = {r["doc_id"]: r["text"] for r in fourth.collect()}
    assert {i: r["decoded_sha256"] for i, r in last.items()} == {i: hashlib.sha256(t.encode()).hexdigest() for i, t in final.items()}


def test_pipeline_odd_rows(spark, tmp_path):
    long = " ".join(f"w{i}" for i in range(200))
    rows = [(1, None, "en", "s", None), (2, "", None, "s", 0), (None, "short text here", "en", None, 5), (4, long, "en", "s", 9), (4, long, "en", "s", 9), (5, "é" * 100000, "fr", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    for name, part in (("documents", docs), ("labels", spark.createDataFrame([(4, 1), (5, None)], "doc_id bigint, quality int")),
                       ("benchmark", spark.createDataFrame([(1, "some other words"), (2, None)], "item_id bigint, text string"))):
        part.write.parquet(f"{tmp_path}/{name}.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted(r["doc_id"] or 0 for r in got) == [0, 1, 4, 4, 5]
    docs.limit(0).write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_groups_by_id_and_text(spark):
    """Rows are told apart by id and text: what goes from one group stays in another, and repeated rows keep their text."""
    text = lambda k: " ".join(f"{k}{i}" for i in range(60))
    rows = [(None, text("x")), (4, text("x")), (None, text("y")), (2, text("z")), (5, text("z")), (5, text("u")), (7, text("v")), (7, text("v")),
            (8, text("r") + " one"), (9, text("r") + " " + " ".join(f"s{i}" for i in range(300)))]
    docs = spark.createDataFrame([(i, t, i, 0) for i, t in rows], "doc_id bigint, text string, source string, n_chars int")
    kept = corpus_pipeline.one_of_each_group(spark, docs, "")
    at = lambda df: sorted(((r["doc_id"] or 0), r["text"][:2], len(r["text"].split())) for r in df.collect())
    assert at(kept) == [(0, "y0", 60), (2, "z0", 60), (4, "x0", 60), (5, "u0", 60), (7, "v0", 60), (7, "v0", 60), (8, "r0", 61), (9, "r0", 360)]
    out = corpus_pipeline.without_repeats(spark, kept, "")
    assert out.columns == docs.columns and all(r["n_chars"] == len(r["text"]) for r in out.collect())
    assert at(out) == [(0, "y0", 60), (2, "z0", 60), (4, "x0", 60), (5, "u0", 60), (7, "v0", 60), (7, "v0", 60), (8, "on", 1), (9, "s0", 300)]


def test_repeated_rows_keep_columns_of_any_name(spark):
    text = lambda k: " ".join(f"{k}{i}" for i in range(60))
    rows = [(7, text("v"), "a", 1, 2, "b", "c"), (7, text("v"), "d", 3, 4, None, "e"), (8, text("v") + " x", "f", 5, 6, "g", "h"), (None, None, "i", 7, 8, "j", "k")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, _text string, bad_id int, _hash bigint, row string, h string")
    for some in (docs, docs.where("doc_id <> 8 OR doc_id IS NULL")):
        out = corpus_pipeline.without_repeats(spark, some, "")
        assert out.columns == docs.columns
        got = sorted(map(tuple, out.collect()), key=str)
        alone = some is not docs
        want = [r if r[0] is None or alone else (r[0], "x" if r[0] == 8 else "", *r[2:]) for r in rows if r[0] != 8 or not alone]
        assert got == sorted(want, key=str)


def test_distrust_travels_far(spark):
    """Nine hops to a blocked host of many pages, and a circle: shares as solved exactly."""
    names = [f"c{i}.com" for i in range(9)] + ["bad.net", "r1.com", "r2.com"]
    links = {f"c{i}.com": [f"c{i + 1}.com"] for i in range(8)} | {"c8.com": ["bad.net"], "r1.com": ["r2.com", "bad.net"], "r2.com": ["r1.com"]}
    pages = {n: 5000 if n == "bad.net" else 1 for n in names}
    rows = [(f"http://{n}/", "".join(f'<a href="http://{t}/">' for t in links.get(n, []))) for n in names for _ in range(pages[n])]
    at = {n: i for i, n in enumerate(names)}

    def solved(edges, seed):
        move = np.zeros((12, 12))
        for a, b in edges:
            move[at[b], at[a]] += 1 / sum(x == a for x, _ in edges)
        for a in {*names} - {x for x, _ in edges}:
            move[at[a], at[a]] = 1
        return np.linalg.solve(np.eye(12) - 0.85 * move, 0.15 * seed)

    whole = np.array([pages[n] for n in names], float)
    back = [(b, a) for a, bs in links.items() for b in bs]
    want = solved(back, whole * [n == "bad.net" for n in names]) / solved(back, whole)
    judged = hostrank.host_verdicts(
        pages_of(spark, rows).withColumn("host", hostrank.host_of(F.col("url"))).withColumn("rule", F.when(F.col("host") == "bad.net", "net/")),
        "html", queries.URL_RULES,
    )
    got = {r["host"]: r for r in judged.collect()}
    assert all(got[n]["distrust"] == pytest.approx(want[at[n]], abs=1e-4) for n in names)
    assert got["c0.com"]["blocked"] and want[0] > 0.9
