"""Curation, ranks, requests, filters, scoring and metrics against plain Python."""

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from evalweave.functions import answers as A
from evalweave.functions import mathnorm as N
from evalweave.functions import scoring as S
from evalweave.functions import text as T
from evalweave.functions.arrays import cumulative, multiset_overlap
from evalweave.operators import analytics as Y
from evalweave.operators import curate as C
from evalweave.operators import fewshot as W
from evalweave.operators import filters as R
from evalweave.operators import evaluate as E
from evalweave.operators import metrics as M
from evalweave.operators import prompts as P
from evalweave.operators import requests as Q
from evalweave.operators.ranks import (
    collect_in_parts, keep_first, keep_smallest, with_group_position, with_position, with_running_total,
)


def value(spark, column, **cols):
    names = list(cols)
    schema = ", ".join(f"{n} {t}" for n, (t, _) in cols.items())
    row = spark.createDataFrame([tuple(v for _, v in cols.values())], schema) if names else spark.range(1)
    return row.select(column.alias("x")).first().x


# --- arrays and ranks ------------------------------------------------------------


def test_multiset_overlap(spark):
    rnd = random.Random(1)
    rows = [
        ([rnd.choice(["a", "b", "a0", "10", "0", "x1"]) for _ in range(rnd.randint(0, 30))],
         [rnd.choice(["a", "b", "a0", "10", "00", "x1"]) for _ in range(rnd.randint(0, 30))])
        for _ in range(60)
    ]
    df = spark.createDataFrame(rows, "a array<string>, b array<string>")
    got = [r.x for r in df.select(multiset_overlap(F.col("a"), F.col("b")).alias("x")).collect()]
    assert got == [sum((Counter(a) & Counter(b)).values()) for a, b in rows]


def test_cumulative(spark):
    values = [random.Random(2).randint(0, 9) for _ in range(1000)]
    got = value(spark, cumulative(F.col("v")), v=("array<int>", values))
    assert got == [sum(values[: i + 1]) for i in range(1000)]


def hot_rows(spark):
    """A third of the rows share one key."""
    return spark.range(3000).select(
        F.col("id"), F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 50).alias("k"),
        F.pmod(F.xxhash64("id"), F.lit(97)).alias("v"),
    )


def test_positions_with_hot_keys(spark):
    df = hot_rows(spark)
    rows = df.collect()
    got = {r.id: r.pos for r in with_position(df, [F.col("k"), F.col("id")]).collect()}
    assert got == {r.id: i for i, r in enumerate(sorted(rows, key=lambda r: (r.k, r.id)))}
    per_group = with_group_position(df, ["k"], [F.col("v"), F.col("id")]).collect()
    for k in (0, 1, 49):
        inside = sorted((r for r in per_group if r.k == k), key=lambda r: (r.v, r.id))
        assert [r.pos for r in inside] == list(range(len(inside)))


def test_running_total(spark):
    rows = sorted(hot_rows(spark).collect(), key=lambda r: (r.k, r.id))
    want, run = {}, 0
    for r in rows:
        run += r.v
        want[r.id] = run
    got = with_running_total(hot_rows(spark), [F.col("k"), F.col("id")], "v", "run").collect()
    assert {r.id: r.run for r in got} == want


def test_lists_are_cut_but_whole(spark):
    parts = collect_in_parts(hot_rows(spark), ["k"], [F.col("id")], F.col("id"), "ids", 100).collect()
    assert max(len(r.ids) for r in parts) <= 100
    hot = [i for r in sorted((r for r in parts if r.k == 0), key=lambda r: r.part) for i in r.ids]
    assert hot == sorted(r.id for r in hot_rows(spark).collect() if r.k == 0)


def test_keep_smallest_and_first(spark):
    df = hot_rows(spark)
    want = sorted((r.v, r.id) for r in df.collect())
    assert sorted((r.v, r.id) for r in keep_smallest(df, [F.col("v"), F.col("id")], 10).collect()) == want[:10]
    assert sorted((r.v, r.id) for r in keep_first(df, [F.col("v"), F.col("id")], 700).collect()) == want[:700]
    assert keep_smallest(df, [F.col("id")], 10**6).count() == 3000
    assert keep_first(df, [F.col("id")], 10**6).count() == 3000
    assert keep_smallest(df.where("id < 0"), [F.col("id")], 5).count() == 0


# --- curation ----------------------------------------------------------------------


def messages(spark):
    rows = [(i, f"q{i}", f"pre <think> t{i} </think> a{i} " if i % 4 else f"plain {i}", (i * 7) % 50, None) for i in range(60)]
    return spark.createDataFrame(rows, "id long, question string, response string, num_tokens long, source string")


def test_topk_before_tag_check(spark):
    got = C.curate_sft(messages(spark), 20, 45).collect()
    ranked = sorted((r for r in messages(spark).collect() if r.num_tokens < 45), key=lambda r: -r.num_tokens)[:20]
    want = {r.id for r in ranked if "<think>" in r.response}
    assert {r.id for r in got} == want and len(want) < 20
    one = next(r for r in got if r.id in want)
    assert (one.thinking_trace, one.answer, one.source) == (f"t{one.id}", f"a{one.id}", "")


def test_validation_split_is_exact_and_complete(spark):
    got = C.curate_sft(messages(spark), 20, 45, val_size=5, seed=3)
    counts = {r.split: r.n for r in got.groupBy("split").agg(F.count("*").alias("n")).collect()}
    assert counts["val"] == 5
    again = C.curate_sft(messages(spark).repartition(5), 20, 45, val_size=5, seed=3)
    assert {(r.id, r.split) for r in got.collect()} == {(r.id, r.split) for r in again.collect()}


@pytest.mark.parametrize("text", ["a<think>b</think>c<think>d</think>e", "<think>x<think>y</think>z", "</think>q<think>r"])
def test_trace_and_answer_like_python_split(spark, text):
    want = (text.split("<think>")[1].split("</think>")[0].strip(), text.split("</think>")[1].strip())
    got = spark.createDataFrame([(text,)], "r string").select(
        C.thinking_trace(F.col("r")).alias("t"), C.final_answer(F.col("r")).alias("a")
    ).first()
    assert (got.t, got.a) == want


def test_template_with_unknown_column_fails_early():
    with pytest.raises(ValueError):
        T.render_template("{{nope}}", ["text"])


def test_sample_size():
    assert C.sample_size(0.1, 101) == 11 and C.sample_size(5, 101) == 5 and C.sample_size(None, 7) == 7


def test_fewshot_random(spark):
    pool = spark.range(40).select("id", F.col("id").cast("string").alias("q"), F.lit("a").alias("a"))
    picks = W.fewshot_random(pool, pool, "id", 5, 1).collect()
    per = Counter(r.id for r in picks)
    assert set(per.values()) == {5} and len(per) == 40
    assert all(r.id != r.example_id for r in picks)
    assert len({(r.id, r.example_id) for r in picks}) == len(picks)
    other = W.fewshot_random(pool, pool, "id", 5, 1, same_split=False).collect()
    assert Counter(Counter(r.id for r in other).values()) == {5: 40}


def test_fewshot_first_n_needs_enough(spark):
    pool = spark.range(3)
    assert [r.id for r in W.fewshot_first_n(pool, "id", 2).collect()] == [0, 1]
    with pytest.raises(Exception, match="few-shot examples"):
        W.fewshot_first_n(pool, "id", 4).collect()


def test_permute_choices_always_moves_gold(spark):
    df = spark.range(200).select(
        "id", F.array(*[F.lit(c) for c in "abcd"]).alias("choices"), (F.col("id") % 4).cast("int").alias("gold")
    )
    for r in P.permute_choices(df, "id", "choices", "gold", 5).collect():
        assert r.gold != r.id % 4 and r.choices[r.gold] == "abcd"[r.id % 4] and sorted(r.choices) == list("abcd")


# --- requests -----------------------------------------------------------------------


def windows(tokens, prefix, max_len, context):
    """Independent statement: the first window predicts up to max_len tokens, later ones the next step tokens."""
    out, done = [], min(max_len, len(tokens))
    if not tokens:
        return out
    padded = [prefix] + tokens
    out.append((padded[:done], tokens[:done]))
    while done < len(tokens):
        end = min(len(tokens), done + max_len - context + 1)
        out.append((padded[end - max_len : end], tokens[done:end]))
        done = end
    return out


@pytest.mark.parametrize("max_len,context", [(10, 1), (10, 5), (10, 10), (4, 2), (100, 7)])
def test_rolling_windows(spark, max_len, context):
    for n in (0, 1, 9, 10, 11, 33, 34):
        tokens = [str(i) for i in range(n)]
        df = spark.createDataFrame([(1, tokens)], "id long, t array<string>")
        got = Q.rolling_token_windows(df, "id", F.col("t"), "<s>", max_len, context).orderBy("window").collect()
        assert [(r.input, r.predict) for r in got] == windows(tokens, "<s>", max_len, context)
        assert [x for r in got for x in r.predict] == tokens
        apart = Q.rolling_token_windows(df, "id", F.col("t"), "<s>", max_len, context).select(
            "window", Q.disjoint_context(F.col("input"), F.col("predict")).alias("c"), "input", "predict"
        )
        assert all(r.c + r.predict[:-1] == r.input for r in apart.collect())


def test_cache_never_serves_sampled_requests(spark):
    r = spark.createDataFrame([(1, "a", False), (2, "b", False), (3, "a", True)], "id long, arg string, sampled boolean")
    key = Q.request_key(F.lit("generate_until"), F.col("arg"))
    cache = r.where("id = 1").select(key.alias("cache_key"), F.lit("hit").alias("response"))
    got = {x.id: (x.source, x.response) for x in Q.response_cache_join(r, cache, key, F.col("sampled")).collect()}
    assert got == {1: ("cache", "hit"), 2: ("miss", None), 3: ("sampled", None)}


def test_batches_spread_over_settings(spark):
    df = hot_rows(spark)
    got = Q.length_bucket_batches(df, ["k"], F.col("v"), "id", 7).collect()
    assert max(Counter((r.k, r.batch) for r in got).values()) <= 7
    hot = sorted((r for r in got if r.k == 0), key=lambda r: r["rank"])
    assert [r.v for r in hot] == sorted((r.v for r in hot), reverse=True)


def test_task_hash_is_over_part_hashes(spark):
    import hashlib

    df = spark.createDataFrame([("t", i, str(i), "p", "g") for i in range(5)], "task string, id long, a string, b string, c string")
    s = df.select("task", "id", *Q.sample_hashes(F.col("a"), F.col("b"), F.col("c")))

    def h(x):
        return hashlib.sha256(x.encode()).hexdigest()

    each = [h(str(i)) + h("p") + h("g") for i in range(5)]
    assert Q.task_hashes(s, "task", "id").first().task_hash == h(h("".join(each)))
    parts = [h("".join(each[i : i + 2])) for i in (0, 2, 4)]
    assert Q.task_hashes(s, "task", "id", part_size=2).first().task_hash == h("".join(parts))


# --- filters ---------------------------------------------------------------------------


def test_take_first_k_fails_on_short_documents(spark):
    df = spark.createDataFrame([(1, 0, "a"), (1, 1, "b"), (2, 0, "c")], "doc_id long, idx int, response string")
    with pytest.raises(Exception, match="fewer than 2"):
        df.transform(R.take_first_k(2)).collect()


def test_majority_tie_goes_to_the_first(spark):
    df = spark.createDataFrame([(1, i, x) for i, x in enumerate("baabc")], "doc_id long, idx int, response string")
    assert df.transform(R.majority_vote()).first().response == "b"


@pytest.mark.parametrize(
    "text,want",
    [
        (r"so \boxed{\frac{1}{2}} ok", r"\boxed{\frac{1}{2}}"),
        (r"\boxed{1} then \boxed{{2}} x}", r"\boxed{{2}}"),
        (r"\boxed 7$ done", r"\boxed 7"),
        (r"\fbox{9}", r"\fbox{9}"),
        (r"\boxed{{1}", None),
        ("none", None),
    ],
)
def test_extract_boxed(spark, text, want):
    assert value(spark, A.extract_boxed(F.col("t")), t=("string", text)) == want


@pytest.mark.parametrize(
    "raw,want",
    [
        ("x=5 dollars", "5"),
        ("\\frac12", "\\frac{1}{2}"),
        ("\\sqrt3", "\\sqrt{3}"),
        ("10,000", "10000"),
        ("\\text{yes}", "yes"),
        ("the $7$ units", "7"),
        ("\\boxed{3}", "3"),
        ("30^\\circ", "30"),
    ],
)
def test_normalize_math_answer(spark, raw, want):
    assert value(spark, N.normalize_math_answer(F.col("t")), t=("string", raw)) == want


@pytest.mark.parametrize(
    "a,b,want",
    [
        ("\\frac12", "\\frac{1}{2}", True),
        ("0.5", "\\frac{1}{2}", True),
        ("3/4", "\\frac{3}{4}", True),
        ("x = 2", "2", True),
        ("\\tfrac{1}{3}", "\\frac13", True),
        (".5", "\\frac{1}{2}", True),
        ("5\\%", "5", True),
        ("\\sqrt2", "\\sqrt{2}", True),
        ("1", "2", False),
        (None, None, True),
        (None, "1", False),
    ],
)
def test_math_equal(spark, a, b, want):
    assert value(spark, N.math_equal(F.col("a"), F.col("b")), a=("string", a), b=("string", b)) is want


@pytest.mark.parametrize(
    "response,want",
    [
        ("The answer is (B).", "(B)"),
        ("I would say blue, certainly", "(B)"),
        ("Answer: C", "(C)"),
        ("dunno", "[invalid]"),
    ],
)
def test_multi_choice_extract(spark, response, want):
    col = A.multi_choice_extract(F.col("r"), F.col("c"), r"(\([A-Z]\))")
    assert value(spark, col, r=("string", response), c=("array<string>", ["red", "blue", "green"])) == want


def test_code_block_and_fences(spark):
    text = "```cpp\nint a;\n``` text ```cpp\nint b;\n"
    assert value(spark, A.extract_code_block(F.col("t")), t=("string", text)) == "int b;"
    assert value(spark, A.extract_code_block(F.col("t")), t=("string", "no code")) is None


def test_parse_open(spark):
    p = value(spark, A.parse_open_numbers(F.col("t")), t=("string", "Working.\nSo the answer is 1,234 apples\nThus x = 5e3."))
    assert 1234.0 in p["numbers"] and 5000.0 in p["numbers"]


# --- scoring and metrics ---------------------------------------------------------------


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def test_lcs(spark):
    rnd = random.Random(3)
    rows = [([rnd.choice("abc") for _ in range(rnd.randint(0, 90))], [rnd.choice("abc") for _ in range(rnd.randint(0, 90))]) for _ in range(40)]
    df = spark.createDataFrame(rows, "a array<string>, b array<string>")
    assert [r.x for r in df.select(S.lcs_length("a", "b").alias("x")).collect()] == [lcs(a, b) for a, b in rows]


@pytest.mark.parametrize(
    "pred,golds,em,f1",
    [
        ("The 5 cats", ["5 cats"], 1.0, 1.0),
        ("5.0 cats", ["5 cats"], 1.0, 1.0),
        ("6 cats", ["5 cats"], 0.0, 0.0),
        ("black cats", ["white cats", "black dogs"], 0.0, 0.5),
        ("x", ["", "y"], 0.0, 0.0),
    ],
)
def test_drop(spark, pred, golds, em, f1):
    got = value(spark, S.drop_em_f1(F.col("p"), F.col("g")), p=("string", pred), g=("array<string>", golds))
    assert (got["em"], got["f1"]) == (em, f1)


def test_gold_out_of_range_is_wrong(spark):
    cols = S.multiple_choice(F.col("l"), F.col("n"), F.col("g"), F.lit(5))
    df = spark.createDataFrame([([-1.0, -2.0], [1, 1], [True, True])], "l array<double>, n array<int>, g array<boolean>")
    assert df.select(*[c.alias(k) for k, c in cols.items()]).first().asDict() == {"acc": 0.0, "acc_norm": 0.0, "exact_match": 0}


def test_compare_outputs_modes(spark):
    df = spark.createDataFrame([("1\n2\n", "1\r\n2"), ("1\n2", "1\n2"), ("1", "2")], "a string, e string")
    both = df.select(S.compare_outputs(F.col("a"), F.col("e"), "reference").alias("r"), S.compare_outputs(F.col("a"), F.col("e")).alias("n"))
    assert [(x.r, x.n) for x in both.collect()] == [(True, True), (False, True), (False, False)]


def test_json_valid(spark):
    cases = {'{"a": 1}': True, "```json\n[1, 2]\n```": True, '{"a": 1}}': False, "{": False, "7": True, "": False, "1 2": False}
    df = spark.createDataFrame([(k,) for k in cases], "t string")
    assert {r.t: r.v for r in df.select("t", S.json_valid(F.col("t")).alias("v")).collect()} == cases


def test_subtask_means_and_pooled_stderr(spark):
    t = spark.createDataFrame([(0.3, 20, 0.1), (0.2, 40, 0.2), (0.4, 100, 0.05)], "mean double, n long, se double")
    r = t.agg(M.group_mean(F.col("mean"), F.col("n")).alias("w"), M.group_mean(F.col("mean"), F.col("n"), False).alias("u")).first()
    assert (round(r.w, 6), round(r.u, 6)) == (0.3375, 0.3)
    rnd = random.Random(5)
    samples = [[rnd.randint(0, 1) for _ in range(n)] for n in (100, 60, 80)]

    def se(xs):
        m = sum(xs) / len(xs)
        return math.sqrt(sum((x - m) ** 2 for x in xs) / (len(xs) - 1) / len(xs))

    df = spark.createDataFrame([(se(s), len(s)) for s in samples], "se double, n long")
    pooled = df.agg(M.pooled_stderr(F.col("se"), F.col("n")).alias("x")).first().x
    assert abs(pooled - se(sum(samples, []))) < 1e-3


def test_bootstrap_near_closed_form(spark):
    df = spark.createDataFrame(
        [(i, random.Random(i).random()) for i in range(1000)], "id long, v double"
    )
    boot = E.resampled_stderr(df, [], {"x": F.col("v")}, lambda s: s["x"] / s["weight"], 400, 2).first().stderr
    closed = df.agg(M.stderr_mean(F.col("v")).alias("x")).first().x
    assert abs(boot - closed) < 1e-3


def test_bootstrap_of_counted_cells(spark):
    """A 0/1 metric has two cells, whose weights are drawn at once."""
    df = spark.range(5000).select(((F.col("id") % 10) < 3).cast("double").alias("v"))
    boot = E.resampled_stderr(df, [], {"x": F.col("v")}, lambda s: s["x"] / s["weight"], 400, 3).first().stderr
    assert abs(boot - math.sqrt(0.3 * 0.7 / 5000)) < 8e-4


def test_poisson_has_mean_and_variance(spark):
    for n in (1, 7, 30, 31, 1000):
        x = spark.range(4000).select(E.poisson(1, F.lit(n), F.col("id")).alias("w")).agg(F.avg("w").alias("m"), F.var_samp("w").alias("v")).first()
        assert abs(x.m - n) < 5 * math.sqrt(n / 4000) and 0.85 < x.v / n < 1.15


def test_unknown_metric_is_averaged(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 0.0), ("b", 1.0)], "task string, v double")
    got = {(r.task, r.metric): (r.value, r.stderr) for r in E.metrics_with_stderr(df, ["task"], {"mean": "v", "odd": "v", "perplexity": "v"}, 20).collect()}
    assert got["a", "odd"] == (0.5, None) and got["a", "mean"][1] == 0.5 and got["b", "mean"] == (1.0, None)
    assert got["a", "perplexity"][1] > 0 and got["b", "perplexity"][1] is None


def test_registry(spark):
    E.register_aggregation("double_mean_of_tests", E.Aggregation(value=lambda s: 2 * s["x"] / s["weight"]))
    df = spark.createDataFrame([("a", 1.0), ("a", 0.0)], "task string, v double")
    assert E.metrics_with_stderr(df, ["task"], {"double_mean_of_tests": "v"}).first().value == 1.0
    with pytest.raises(ValueError):
        E.register_aggregation("f1", E.Aggregation())
    with pytest.raises(ValueError):
        E.register_filter("regex", lambda: None)


def test_multi_choice_ignores_regexes(spark):
    got = A.multi_choice_extract(F.col("r"), F.array(F.lit("red ~1"), F.lit("blue ~2")), r"(\([A-Z]\))", regexes_to_ignore=(r"\s*~\d", "big "))
    assert value(spark, got, r=("string", "the big blue ~7 one")) == "(B)"


def test_fewshot_targets(spark):
    pool = spark.createDataFrame([(1, "q1", ["x", "y"], 1), (2, "q2", ["z"], 0)], "id long, q string, a array<string>, gold int")
    picks = spark.createDataFrame([(1, 0, 2), (2, 0, 1)], "id long, rank int, example_id long")
    by_list = {r.id: r.context for r in W.fewshot_context(pool, picks, pool, "id", "q", "a").collect()}
    assert by_list == {1: "q2 z\n\nq1", 2: "q1 x\n\nq2"}
    by_place = {r.id: r.context for r in W.fewshot_context(pool, picks, pool, "id", "q", "gold", choices="a").collect()}
    assert by_place == {1: "q2 z\n\nq1", 2: "q1 y\n\nq2"}


def test_every_metric_with_an_error_has_its_own_aggregation(monkeypatch):
    assert {*M.BOOTSTRAPPED, "mean", "acc_all"} <= set(E.AGGREGATIONS)
    monkeypatch.delitem(E.AGGREGATIONS, "chrf")
    with pytest.raises(ValueError, match="chrf"):
        E.aggregation_for("chrf")
    assert E.aggregation_for("some new metric") is E.AGGREGATIONS["mean"]


def test_metrics_by_name_equal_the_plain_ones(spark):
    rnd = random.Random(4)
    words = [" ".join(rnd.choice("the cat sat on a mat and it is so".split()) for _ in range(12)) for _ in range(60)]
    rows = [(i % 2, i, float(rnd.randrange(100)), w, " ".join(w.split()[: rnd.randrange(6, 13)]), i % 4, i % 7, rnd.random() < 0.9) for i, w in enumerate(words)]
    df = spark.createDataFrame(rows, "task long, i long, v double, gold string, pred string, p long, q long, ok boolean").repartition(3)
    scored = df.select(
        "task", F.struct(F.col("i").alias("order"), F.col("v").alias("value")).alias("m"), F.struct("pred", "gold").alias("t"),
        F.struct(F.col("p").alias("paragraph"), F.col("q").alias("question"), F.col("ok").alias("correct")).alias("a"),
    )
    got = {(r.task, r.metric): r for r in E.metrics_with_stderr(scored, ["task"], {"median": "m", "bleu": "t", "chrf": "t", "acc_all": "a"}, 300).collect()}
    middle = {r.task: r.middle for r in M.middle_element(df, ["task"], "i", "v").collect()}
    bleu = {r.task: r.bleu for r in M.corpus_bleu(df, ["task"], F.col("pred"), F.col("gold")).collect()}
    chrf = {r.task: r.chrf for r in M.corpus_chrf(df, ["task"], F.col("pred"), F.col("gold")).collect()}
    for task in (0, 1):
        all_ = M.acc_all(df.where(F.col("task") == task), "p", "q", F.col("ok")).first()
        want = {"median": middle[task], "bleu": bleu[task], "chrf": chrf[task], "acc_all": all_.acc_all}
        assert all(abs(got[task, m].value - v) < 1e-9 and got[task, m].n == 30 for m, v in want.items())
        assert abs(got[task, "acc_all"].stderr - all_.stderr) < 1e-12
        # In the middle of a resample stands any sample: the error is their spread.
        values = [r[2] for r in rows if r[0] == task]
        mean = sum(values) / 30
        spread = math.sqrt(sum((x - mean) ** 2 for x in values) / 30)
        assert abs(got[task, "median"].stderr / spread - 1) < 0.15
        assert 0 < got[task, "bleu"].stderr < 15 and 0 < got[task, "chrf"].stderr < 10


def test_resamples_without_a_number_are_left_out(spark):
    df = spark.createDataFrame([("a", None), ("a", float("nan")), ("a", 2.0), ("b", None), ("b", None)], "task string, v double")
    got = {r.task: r for r in E.metrics_with_stderr(df, ["task"], {"nanmean": "v"}, 50).collect()}
    assert got["a"].value == 2.0 and got["a"].stderr == 0.0
    assert math.isnan(got["b"].value) and got["b"].stderr is None


def test_samples_are_scored_once(spark):
    """However many metrics are resampled, the plan reads the stored samples and not what they were made from."""
    df = spark.range(100).select(F.lit("t").alias("task"), F.rand(1).alias("v"), F.struct((F.col("id") % 2).alias("gold"), (F.col("id") % 3).alias("pred")).alias("c"))
    out = E.metrics_with_stderr(df, ["task"], {"mean": "v", "perplexity": "v", "nanmean": "v", "f1": "c", "mcc": "c"}, 20)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Range (0, 100" not in plan and out.count() == 5


def test_fewshot_pool_too_small(spark):
    pool = spark.createDataFrame([(i,) for i in range(3)], "id long")
    with pytest.raises(ValueError, match="10 examples"):
        W.fewshot_random(pool, pool, "id", 10)


def funnels(df):
    """Steps of a plan in which all partitions meet in one task."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [line for line in plan.splitlines() if "TakeOrderedAndProject" in line or "SinglePartition" in line]


def test_no_funnel_for_large_k(spark, monkeypatch):
    from evalweave.operators import ranks

    taken = []
    original = ranks._slice_column
    monkeypatch.setattr(ranks, "_slice_column", lambda df, keys, n: taken.append(n) or original(df, keys, n))
    df = spark.range(20000).select(F.col("id"), F.xxhash64("id").alias("v"))
    kept = keep_smallest(df, [F.col("v"), F.col("id")], 5000)
    assert kept.count() == 5000 and taken
    assert {r.v for r in kept.collect()} == {r.v for r in sorted(df.collect(), key=lambda r: r.v)[:5000]}
    # Only rows of the slice with the cut are ordered, and the offsets of slices are the only rows that meet in one task.
    assert not [x for x in funnels(df.where("v > 0")) if x]
    assert not [x for x in funnels(with_position(df, [F.col("v")])) if "TakeOrdered" in x]


@pytest.mark.parametrize("tied", [False, True])
def test_any_k_orders_few_rows(spark, monkeypatch, tied):
    import re

    from evalweave.operators import ranks

    monkeypatch.setattr(ranks, "DIRECT_TOP_K", 20)
    monkeypatch.setattr(ranks, "SAMPLES_PER_SLICE", 2)
    value = F.when(F.col("id") % 3 > 0, F.lit(7)).otherwise(F.col("id") % 50) if tied else F.xxhash64("id") % 10**9
    df = spark.range(3000).select("id", F.when(F.col("id") % 17 > 0, value).alias("v"))
    order = sorted(((r.v is not None, r.v or 0) for r in df.collect()))
    for k in (1, 20, 21, 700, 1501, 2990, 3000, 5000):
        cut = ranks.smallest_cut(df, [F.col("v")], k)
        rows = df if cut is None else df.where(cut)
        last = order[min(k, 3000) - 1]
        assert rows.count() == sum(x <= last for x in order)
        limits = re.findall(r"limit=(\d+)|Limit (\d+)", rows._jdf.queryExecution().executedPlan().toString())
        assert all(int(a or b) <= 20 for a, b in limits)


def test_broadcast_check_counts_bytes(spark):
    from evalweave.operators.broadcasts import fits_broadcast

    df = spark.range(100).select(F.repeat(F.lit("x"), 1000).alias("s"))
    assert fits_broadcast(df) and not fits_broadcast(df, rows=99) and not fits_broadcast(df, size=50_000)


def test_squad_best_threshold(spark):
    rnd = random.Random(11)
    rows = [(i, float(rnd.random() < 0.5), 0.0, rnd.random() < 0.6, rnd.random() < 0.2, round(rnd.random(), 2)) for i in range(300)]
    rows = [(i, e if h else float(empty), e if h else float(empty), h, empty, p) for i, e, _, h, empty, p in rows]
    df = spark.createDataFrame(rows, "id long, exact double, f1 double, has_answer boolean, pred_empty boolean, p_na double")
    cur = best = sum(not r[3] for r in rows)
    for r in sorted(rows, key=lambda r: (r[5], r[0])):
        cur += r[1] if r[3] else (0 if r[4] else -1)
        best = max(best, cur)
    got = M.squad_v2_scores(df, "id").first()
    assert abs(got.best_exact - 100 * best / 300) < 1e-9


def test_pass_at_k_grows(spark):
    rows = [(p, i, i >= p % 20) for p in range(50) for i in range(16)]
    df = spark.createDataFrame(rows, "problem_id long, attempt_idx long, accepted boolean")
    acc = [r.accuracy for r in Y.pass_at_k(df, list(range(1, 17))).orderBy("k").collect()]
    assert acc == sorted(acc) and acc[-1] == sum(p % 20 < 16 for p in range(50)) / 50
    one = {r.k: r.pass_at_k for r in Y.pass_at_k_unbiased(df, [1, 16]).collect()}
    assert abs(one[1] - sum(a for *_, a in rows) / len(rows)) < 1e-9 and one[16] == acc[-1]


def test_consistency_without_pairs(spark):
    from itertools import combinations

    answers = {q: [random.Random(q * 10 + i).choice("abc") for i in range(q + 1)] for q in range(8)}
    df = spark.createDataFrame([(q, a) for q, xs in answers.items() for a in xs], "q long, a string")
    pairs = [(x, y) for xs in answers.values() for x, y in combinations(xs, 2)]
    want = sum(x == y for x, y in pairs) / len(pairs)
    assert abs(M.consistency_rate(df, ["q"], F.col("a")).first().consistency_rate - want) < 1e-12


def test_erfc(spark):
    for z in (0.0, 0.3, 1.96, 4.0):
        assert abs(value(spark, Y.erfc(F.lit(z))) - math.erfc(z)) < 2e-7


def test_chrf_and_bleu_bounds(spark):
    df = spark.createDataFrame([("the cat sat on the mat today", "the cat sat on the mat today"), ("a b c d e", "a b c d e")], "p string, g string")
    assert abs(M.corpus_bleu(df, [], F.col("p"), F.col("g")).first().bleu - 100) < 1e-9
    assert abs(M.corpus_chrf(df, [], F.col("p"), F.col("g")).first().chrf - 100) < 1e-9
    assert M.corpus_bleu(df, [], F.lit("zzz yyy xxx www vvv"), F.col("g")).first().bleu == 0.0


# --- entities ---------------------------------------------------------------------------


def test_entity_pairs(spark):
    schema = "p array<struct<text:string,type:string>>, g array<struct<text:string,type:string>>"
    rows = [
        ([("a", "PER")], [("a", "PER"), ("b", "LOC")]),
        ([("a", "PER"), ("x", "ORG")], [("a", "PER")]),
        ([], []),
        ([("x", "LOC")], [("b", "LOC")]),
    ]
    df = spark.createDataFrame(rows, schema)
    got = [[tuple(x) for x in r.x] for r in df.select(S.entity_label_pairs(F.col("p"), F.col("g")).alias("x")).collect()]
    assert got == [[(0, 0), (3, 1)], [(0, 0), (2, 3)], [(3, 3)], [(3, 1)]]


def test_group_by_context_with_a_hot_context(spark, monkeypatch):
    """Half of all rows share a context; they stay in the partitions they are in, and every row finds its representative."""
    monkeypatch.setattr(Q, "HOT_CONTEXTS", 10)
    n = 8000
    context = F.when(F.col("id") % 2 == 0, F.lit("hot")).otherwise(F.concat(F.lit("c"), F.col("id") % 1000))
    rows = spark.range(0, n, 1, 8).select("id", F.array(context, F.lit("x"), F.col("id").cast("string")).alias("t"))
    out = Q.group_by_context(rows, F.col("t"), ["id"])
    got = {r["id"]: (r["scored"]["id"], r["group_size"]) for r in out.collect()}
    assert got == {i: (0, n // 2) if i % 2 == 0 else (i % 1000, n // 1000) for i in range(n)}
    sizes = out.where("group_size > 100").groupBy(F.spark_partition_id()).count().collect()
    assert max(r["count"] for r in sizes) <= n // 2 // 8
    none = Q.group_by_context(rows.limit(0), F.col("t"), ["id"])
    assert none.columns == out.columns and none.isEmpty()


def test_tokens_of_a_batch_are_handed_on_in_parts(spark, monkeypatch):
    """A batch of many long texts is encoded a part at a time, whatever its size."""
    import pyarrow as pa

    from evalweave.operators import requests as Q

    made = []
    df = spark.createDataFrame([(1, "aé"), (2, "")], "id long, text string")
    monkeypatch.setattr(Q, "ENCODE_BYTES", 100)
    rows = {r.id: (list(r.input_ids), list(r.attention_mask)) for r in Q.tokenize_corpus(df, "id", "text", Q.byte_tokenizer()).collect()}
    assert [len(x) for x in rows[1]] == [3, 3] and rows[2] == ([], [])
    monkeypatch.setattr(type(df), "mapInArrow", lambda self, run, schema: made.append(run) or self)
    Q.tokenize_corpus(df, "id", "text", Q.byte_tokenizer())
    batch = pa.RecordBatch.from_arrays([pa.array(range(50)), pa.array(["x" * 60] * 50)], names=["id", "text"])
    taken = list(made[0](iter([batch])))
    assert max(b.num_rows for b in taken) <= 2 and sum(b.num_rows for b in taken) == 50
    assert all(b.column(2)[0].as_py() == b.column(2)[b.num_rows - 1].as_py() and len(b.column(3)[0]) == 60 for b in taken)


def test_emotions_of_a_batch(spark):
    rows = [("a: 1\nb: 2\nc: 3\nd: 4\na: 9",), (None,), ("a: 1 b: 2",), ("\x00a: 1\x00 b: 2 c: 3 d: 4",), ("a: 1 b: 2 c: 3 d: x",)]
    df = spark.createDataFrame(rows, "t string").coalesce(1)
    names, scores = F.array(*map(F.lit, "abcd")), F.array(*[F.lit(float(x)) for x in (9, 2, 3, 4)])
    m = S.emotion_distance(F.col("t"), names, scores)
    got = df.select(m["score"].alias("s"), m["percent_parseable"].alias("p")).collect()
    assert [r.p for r in got] == [100, 0, 0, 100, 0] and got[0].s == 100 and got[1].s == 0 and 0 < got[3].s < 100
    plan = df.select(*m.values())._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and "regexp" not in plan
