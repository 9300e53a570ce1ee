"""Aggregation, standard error and group queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from evalweave.functions import scoring as S
from evalweave.functions import text as T
from evalweave.operators import evaluate as E
from evalweave.operators import metrics as M
from evalweave.operators import prompts as P
from evalweave.plans.fixtures import (
    ATTEMPTS_SQL, MC_SQL, PAIRS_SQL, ROLLING_SQL, SCORED_SQL, TASKS_SQL, W, attempts, mc, mc_docs, pairs, rolling,
    scored, sql_ngrams, sql_words, tasks,
)
from evalweave.plans.q_score import (
    BEST, EN, ENTITY_PAIRS, ENTITY_SQL, F1_SQL, PROB, bbq_answers, entities, norm_sql, overlap_sql,
)
from evalweave.plans.registry import query, table


def r6(x):
    return F.round(x, 6)


SC = f"WITH {SCORED_SQL}"


@query("agg_mean", f"{SC} SELECT task, round(avg(value), 6) AS value FROM scored GROUP BY task")
def agg_mean(spark, d):
    return scored(spark, d).groupBy("task").agg(r6(M.mean(F.col("value"))).alias("value"))


@query(
    "agg_nanmean",
    f"""{SC} SELECT task, coalesce(round(avg(CASE WHEN doc_id % 3 = 0 OR grp = 'g1' THEN NULL ELSE value END), 6), CAST('nan' AS DOUBLE)) AS value FROM scored GROUP BY task""",
)
def agg_nanmean(spark, d):
    x = F.when((F.col("doc_id") % 3 == 0) | (F.col("grp") == "g1"), float("nan")).otherwise(F.col("value"))
    return scored(spark, d).groupBy("task").agg(r6(M.nanmean(x)).alias("value"))


@query(
    "agg_middle_element",
    f"""{SC}, r AS (SELECT task, value, row_number() OVER (PARTITION BY task ORDER BY doc_id) - 1 AS pos, count(*) OVER (PARTITION BY task) AS n FROM scored)
    SELECT task, value AS middle, n FROM r WHERE pos = n // 2""",
)
def agg_middle_element(spark, d):
    return M.middle_element(scored(spark, d), ["task"], "doc_id", "value")


@query("agg_perplexity", f"WITH {MC_SQL} SELECT category, round(exp(-avg(ll)), 6) AS perplexity FROM mc GROUP BY category")
def agg_perplexity(spark, d):
    return mc(spark, d).groupBy("category").agg(r6(M.perplexity(F.col("ll"))).alias("perplexity"))


@query(
    "agg_weighted_perplexity",
    f"""WITH {ROLLING_SQL} SELECT task, round(exp(-sum(ll) / sum(len(regexp_split_to_array(text, '{W}+')))), 6) AS word_perplexity,
    round(exp(-sum(ll) / sum(octet_length(encode(text)))), 6) AS byte_perplexity FROM rolling GROUP BY task""",
)
def agg_weighted_perplexity(spark, d):
    n_words = F.size(F.split("text", f"{T.WS}+"))
    return rolling(spark, d).groupBy("task").agg(
        r6(M.weighted_perplexity(F.col("ll"), n_words)).alias("word_perplexity"),
        r6(M.weighted_perplexity(F.col("ll"), F.octet_length("text"))).alias("byte_perplexity"),
    )


@query(
    "agg_bits_per_byte",
    f"WITH {ROLLING_SQL} SELECT task, round(-sum(ll) / sum(octet_length(encode(text))) / ln(2), 6) AS bits_per_byte FROM rolling GROUP BY task",
)
def agg_bits_per_byte(spark, d):
    return rolling(spark, d).groupBy("task").agg(r6(M.bits_per_byte(F.col("ll"), F.octet_length("text"))).alias("bits_per_byte"))


CLS = """cls AS (SELECT DISTINCT task, c FROM (SELECT task, gold AS c FROM scored UNION ALL SELECT task, pred FROM scored) u),
pc AS (SELECT cls.task, c, sum(CASE WHEN gold = c AND pred = c THEN 1 ELSE 0 END) AS tp, sum(CASE WHEN gold = c THEN 1 ELSE 0 END) AS sup,
  sum(CASE WHEN pred = c THEN 1 ELSE 0 END) AS prd FROM cls JOIN scored s ON s.task = cls.task GROUP BY cls.task, c),
f AS (SELECT *, CAST(2 * tp AS DOUBLE) / (sup + prd) AS f1 FROM pc)"""


@query(
    "agg_f1",
    f"""{SC}, {CLS} SELECT task, round(coalesce(max(CASE WHEN c = 1 THEN f1 END), 0), 6) AS f1, round(avg(f1), 6) AS f1_macro,
    round(CAST(sum(f1 * sup) / sum(sup) AS DOUBLE), 6) AS f1_weighted FROM f GROUP BY task""",
)
def agg_f1(spark, d):
    f = M.f1_scores(scored(spark, d), ["task"], "gold", "pred")
    return f.select("task", *[r6(F.col(c)).alias(c) for c in ("f1", "f1_macro", "f1_weighted")])


@query("agg_f1_micro", f"{SC}, {CLS} SELECT task, round(CAST(2 * sum(tp) AS DOUBLE) / sum(sup + prd), 6) AS f1_micro FROM f GROUP BY task")
def agg_f1_micro(spark, d):
    return M.f1_scores(scored(spark, d), ["task"], "gold", "pred").select("task", r6(F.col("f1_micro")).alias("f1_micro"))


@query("agg_f1_classes", f"{SC}, {CLS} SELECT task, round(avg(CASE WHEN c IN (0) THEN f1 END), 6) AS f1_classes FROM f GROUP BY task")
def agg_f1_classes(spark, d):
    f = M.f1_scores(scored(spark, d), ["task"], "gold", "pred", classes=[0])
    return f.select("task", r6(F.col("f1_classes")).alias("f1_classes"))


@query(
    "agg_matthews",
    f"""{SC}, x AS (SELECT task, CAST(sum(gold * pred) AS DOUBLE) AS tp, CAST(sum((1 - gold) * (1 - pred)) AS DOUBLE) AS tn, CAST(sum((1 - gold) * pred) AS DOUBLE) AS fp,
      CAST(sum(gold * (1 - pred)) AS DOUBLE) AS fn FROM scored GROUP BY task), y AS (SELECT *, sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)) AS den FROM x)
    SELECT task, CASE WHEN den > 0 THEN round((tp * tn - fp * fn) / den, 6) ELSE CAST(0 AS DOUBLE) END AS mcc FROM y""",
)
def agg_matthews(spark, d):
    return M.matthews(scored(spark, d), ["task"], "gold", "pred").select("task", r6(F.col("mcc")).alias("mcc"))


@query(
    "agg_micro_partial_credit",
    f"{SC} SELECT grp, round(sum(value * (1 + doc_id % 3)) / sum(1 + doc_id % 3), 6) AS value FROM scored GROUP BY grp",
)
def agg_micro_partial_credit(spark, d):
    parts = 1 + F.col("doc_id") % 3
    rows = M.micro_partial_credit(scored(spark, d), ["grp"], F.col("value") * parts, parts)
    return rows.select("grp", r6(F.col("value")).alias("value"))


@query(
    "agg_group_difference",
    f"""WITH {TASKS_SQL}, b AS (SELECT grp, min(task) AS lo, max(task) AS hi FROM tasks GROUP BY grp)
    SELECT b.grp, round(max(CASE WHEN task = lo THEN mean END) - max(CASE WHEN task = hi THEN mean END), 6) AS difference FROM tasks t JOIN b ON t.grp = b.grp GROUP BY b.grp""",
)
def agg_group_difference(spark, d):
    from pyspark.sql import Window

    # A few task rows per group.
    w = Window.partitionBy("grp")
    t = tasks(spark, d).withColumn("lo", F.min("task").over(w)).withColumn("hi", F.max("task").over(w))
    rows = M.group_difference(t, ["grp"], "task", "mean", F.col("task") == F.col("lo"), F.col("task") == F.col("hi"))
    return rows.select("grp", r6(F.col("difference")).alias("difference"))


def mt_sql(x):
    """The machine-translation tokenisation as nested SQL calls."""
    x = f"concat(' ', regexp_replace({x}, '^{W}+|{W}+$', '', 'g'), ' ')"
    for kind, a, b in S.MT_STEPS:
        a, b = a.replace("'", "''"), b.replace("'", "''")
        if kind == "lit":
            a = "'" + a.replace("\n", "' || chr(10) || '") + "'"
            x = f"replace({x}, {a}, '{b}')"
        else:
            b = b.replace("$1", "\\1").replace("$2", "\\2")
            x = f"regexp_replace({x}, '{a}', '{b}', 'g')"
    return sql_words(x)


def ngram_ctes(tok, group, src="pairs", key="doc_id"):
    """t1..t4: per order the per-row matches and sizes; b: everything per row."""
    out = [f"tk AS MATERIALIZED (SELECT {key} AS k, {group} AS grp, {tok('pred')} AS pw, {tok('gold')} AS gw FROM {src})"]
    for n in range(1, 5):
        g = (lambda w: w) if n == 1 else (lambda w, n=n: sql_ngrams(w, n))
        out.append(f"s{n} AS (SELECT k, {g('pw')} AS p, {g('gw')} AS g FROM tk)")
        out.append(f"a{n} AS (SELECT k, t, count(*) AS c FROM (SELECT k, unnest(p) AS t FROM s{n}) x GROUP BY k, t)")
        out.append(f"c{n} AS (SELECT k, t, count(*) AS c FROM (SELECT k, unnest(g) AS t FROM s{n}) x GROUP BY k, t)")
        out.append(f"m{n} AS (SELECT a{n}.k, CAST(sum(least(a{n}.c, c{n}.c)) AS BIGINT) AS m FROM a{n} JOIN c{n} ON a{n}.k = c{n}.k AND a{n}.t = c{n}.t GROUP BY a{n}.k)")
    cols = ", ".join(f"coalesce(m{n}.m, 0) AS m{n}, greatest(len(pw) - {n - 1}, 0) AS c{n}" for n in range(1, 5))
    joins = " ".join(f"LEFT JOIN m{n} ON m{n}.k = tk.k" for n in range(1, 5))
    out.append(f"b AS (SELECT tk.k, grp, len(pw) AS pl, len(gw) AS gl, {cols} FROM tk {joins})")
    return ", ".join(out)


@query(
    "agg_bleu",
    f"""WITH {PAIRS_SQL}, {ngram_ctes(mt_sql, 'task')},
    z AS (SELECT grp, {', '.join(f'sum(m{n}) AS m{n}, sum(c{n}) AS c{n}' for n in range(1, 5))}, sum(pl) AS pl, sum(gl) AS gl FROM b GROUP BY grp)
    SELECT grp AS task, round(CASE WHEN pl < gl THEN exp(1 - CAST(gl AS DOUBLE) / pl) ELSE 1 END * exp((ln(100.0 * m1 / c1) + ln(100.0 * m2 / c2) + ln(100.0 * m3 / c3) + ln(100.0 * m4 / c4)) / 4), 6) AS bleu FROM z""",
)
def agg_bleu(spark, d):
    return M.corpus_bleu(pairs(spark, d), ["task"], F.col("pred"), F.col("gold")).select("task", r6(F.col("bleu")).alias("bleu"))


def code_tok_sql(x):
    return rf"regexp_extract_all(lower(regexp_replace({x}, '^{W}+|{W}+$', '', 'g')), '[\p{{L}}\p{{N}}_]+|[^\p{{L}}\p{{N}}_\s]')"


TINY = "2.2250738585072014e-308"


@query(
    "agg_smoothed_bleu4",
    f"""WITH {PAIRS_SQL}, {ngram_ctes(code_tok_sql, 'task')},
    l AS (SELECT grp, (ln(m1 + {TINY}) - ln(c1 + {TINY}) + ln(m2 + 1.0) - ln(c2 + 1.0) + ln(m3 + 1.0) - ln(c3 + 1.0) + ln(m4 + 1.0) - ln(c4 + 1.0)) / 4
      + least(0, 1 - CAST(gl + 1 AS DOUBLE) / (pl + 1)) AS lg FROM b)
    SELECT grp AS task, round(100 * avg(exp(lg)), 6) AS bleu FROM l GROUP BY grp""",
)
def agg_smoothed_bleu4(spark, d):
    return M.smoothed_bleu4(pairs(spark, d), ["task"], F.col("pred"), F.col("gold")).select("task", r6(F.col("bleu")).alias("bleu"))


def chrf_sql(order=6):
    out = [f"ch AS MATERIALIZED (SELECT doc_id AS k, task, regexp_replace(pred, '{W}+', '', 'g') AS p, regexp_replace(gold, '{W}+', '', 'g') AS g FROM pairs)"]
    for n in range(1, order + 1):
        gram = lambda s, n=n: f"unnest(list_transform(range(1, CAST(length({s}) AS BIGINT) - {n - 2}), lambda i: substring({s}, i, {n})))"
        out.append(f"x{n} AS (SELECT k, t, count(*) AS c FROM (SELECT k, {gram('p')} AS t FROM ch) q GROUP BY k, t)")
        out.append(f"y{n} AS (SELECT k, t, count(*) AS c FROM (SELECT k, {gram('g')} AS t FROM ch) q GROUP BY k, t)")
        out.append(f"z{n} AS (SELECT x{n}.k, sum(least(x{n}.c, y{n}.c)) AS m FROM x{n} JOIN y{n} ON x{n}.k = y{n}.k AND x{n}.t = y{n}.t GROUP BY x{n}.k)")
    per = ", ".join(
        f"CAST(sum(coalesce(z{n}.m, 0)) AS DOUBLE) / sum(greatest(length(p) - {n - 1}, 0)) AS p{n}, CAST(sum(coalesce(z{n}.m, 0)) AS DOUBLE) / sum(greatest(length(g) - {n - 1}, 0)) AS r{n}"
        for n in range(1, order + 1)
    )
    joins = " ".join(f"LEFT JOIN z{n} ON z{n}.k = ch.k" for n in range(1, order + 1))
    out.append(f"pr AS (SELECT task, {per} FROM ch {joins} GROUP BY task)")
    ps = " + ".join(f"p{n}" for n in range(1, order + 1))
    rs = " + ".join(f"r{n}" for n in range(1, order + 1))
    out.append(f"av AS (SELECT task, ({ps}) / {order} AS p, ({rs}) / {order} AS r FROM pr)")
    return ", ".join(out)


@query("agg_chrf", f"WITH {PAIRS_SQL}, {chrf_sql()} SELECT task, round(100 * 5 * p * r / (4 * p + r), 6) AS chrf FROM av")
def agg_chrf(spark, d):
    return M.corpus_chrf(pairs(spark, d), ["task"], F.col("pred"), F.col("gold")).select("task", r6(F.col("chrf")).alias("chrf"))


@query(
    "agg_brier",
    f"""WITH {MC_SQL}, {PROB}, s AS (SELECT doc_id, category, sum(power(p - CASE WHEN idx = gold THEN 1 ELSE 0 END, 2)) AS b FROM prob GROUP BY doc_id, category)
    SELECT category, round(avg(b), 6) AS brier FROM s GROUP BY category""",
)
def agg_brier(spark, d):
    return mc_docs(spark, d).groupBy("category").agg(r6(F.avg(S.brier(F.col("lls"), F.col("gold")))).alias("brier"))


@query(
    "agg_acc_all",
    f"""{SC}, a AS (SELECT task, doc_id % 3 AS q, CAST(bool_and(gold = pred) AS INT) AS em FROM scored GROUP BY task, doc_id % 3),
    b AS (SELECT doc_id % 3 AS q, CAST(bool_and(gold = pred) AS INT) AS em FROM scored GROUP BY doc_id % 3)
    SELECT round(avg(em), 6) AS acc_all, (SELECT round(stddev_samp(em) / sqrt(count(*)), 6) FROM b) AS stderr FROM a""",
)
def agg_acc_all(spark, d):
    rows = scored(spark, d).withColumn("q", F.col("doc_id") % 3)
    return M.acc_all(rows, "task", "q", F.col("gold") == F.col("pred")).select(
        r6(F.col("acc_all")).alias("acc_all"), r6(F.col("stderr")).alias("stderr")
    )


@query("group_em", f"{SC} SELECT task, doc_id % 3 AS q, CAST(bool_and(gold = pred) AS INT) AS em FROM scored GROUP BY task, doc_id % 3")
def group_em(spark, d):
    rows = scored(spark, d).withColumn("q", F.col("doc_id") % 3)
    return M.group_em(rows, ["task", "q"], F.col("gold") == F.col("pred"))


@query("stderr_mean", f"{SC} SELECT task, round(stddev_samp(value) / sqrt(count(*)), 6) AS stderr FROM scored GROUP BY task")
def stderr_mean(spark, d):
    return scored(spark, d).groupBy("task").agg(r6(M.stderr_mean(F.col("value"))).alias("stderr"))


def boot_sql(name, group, source, terms, value, reps, seed):
    """CTEs for the resampled stderr of a statistic: cells, draws and sums, as the operator has them, in SQL."""
    names = list(terms)
    cols = ", ".join(f"CAST({e} AS DOUBLE) AS {n}" for n, e in terms.items())
    key = ", ".join(f"CAST({c} AS VARCHAR)" for c in [group, *names, "rep"])

    def u(kind):
        return f"((CAST(concat('0x', substring(md5(concat_ws('|', '{seed}', '{kind}', {key})), 1, 13)) AS BIGINT) + 0.5) / 4503599627370496.0)"

    return f"""{name}_cells AS (SELECT {group}, {', '.join(names)}, count(*) AS cnt FROM (SELECT {group}, {cols} FROM {source}) x GROUP BY ALL),
    {name}_u AS (SELECT *, {u('u')} AS u, {u('v')} AS v FROM {name}_cells, (SELECT unnest(range({reps})) AS rep) r),
    {name}_w AS (SELECT *, CASE WHEN cnt <= 30 THEN CAST((SELECT count(*) FROM pois WHERE pois.n = cnt AND u >= pois.c) AS DOUBLE)
      ELSE greatest(floor(cnt + sqrt(CAST(cnt AS DOUBLE)) * (sqrt(-2 * ln(u)) * cos(2 * pi() * v)) + 0.5), 0) END AS w FROM {name}_u),
    {name}_s AS (SELECT {group}, rep, sum(w) AS weight, {', '.join(f'sum(w * {n}) AS {n}' for n in names)} FROM {name}_w GROUP BY {group}, rep),
    {name} AS (SELECT {group}, stddev_samp({value}) AS stderr FROM {name}_s GROUP BY {group})"""


POIS = """pois(n, k, p, c) AS (SELECT range + 1, 0, exp(-CAST(range + 1 AS DOUBLE)), exp(-CAST(range + 1 AS DOUBLE)) FROM range(30)
    UNION ALL SELECT n, k + 1, p * n / (k + 1), c + p * n / (k + 1) FROM pois WHERE k + 1 < 20 + 3 * n)"""


@query(
    "stderr_bootstrap",
    f"""WITH RECURSIVE {SCORED_SQL}, {POIS}, {boot_sql('b', 'grp', 'scored', {'x': 'value'}, 'x / nullif(weight, 0)', 200, 1)}
    SELECT grp, round(stderr, 6) AS stderr FROM b""",
)
def stderr_bootstrap(spark, d):
    r = E.resampled_stderr(scored(spark, d), ["grp"], {"x": F.col("value")}, lambda s: F.try_divide(s["x"], s["weight"]), 200, 1)
    return r.select("grp", r6(F.col("stderr")).alias("stderr"))


# metric -> terms, value over all samples of a task, and the terms' names in the resampled statistic
TP, FN, FP, TN = (f"CAST({g} AND {p} AS DOUBLE)" for g in ("gold = 1", "gold <> 1") for p in ("pred = 1", "pred <> 1"))
TWO = {"tp": TP, "fp": FP, "fn": FN, "tn": TN}
F1_VALUE = "CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0 END"
MCC_BELOW = "(tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)"
MCC_VALUE = f"CASE WHEN {MCC_BELOW} > 0 THEN (tp * tn - fp * fn) / sqrt({MCC_BELOW}) ELSE 0 END"
SOME = "CASE WHEN doc_id % 3 = 0 THEN NULL ELSE value END"
DISPATCH = {
    "mean": ({"x": "value"}, "x / nullif(weight, 0)"),
    "exact_match": ({"x": "value"}, "x / nullif(weight, 0)"),
    "brier": ({"x": "(value - 0.25) * (value - 0.25)"}, "x / nullif(weight, 0)"),
    "nanmean": ({"x": f"coalesce({SOME}, 0)", "n": f"CASE WHEN {SOME} IS NULL THEN 0 ELSE 1 END"}, "CASE WHEN n > 0 THEN x / n ELSE CAST('nan' AS DOUBLE) END"),
    "perplexity": ({"x": "-1 - gold * 2 - pred"}, "exp(-x / nullif(weight, 0))"),
    "f1": (TWO, F1_VALUE),
    "mcc": (TWO, MCC_VALUE),
}


def dispatch_sql(metric):
    terms, value = DISPATCH[metric]
    sums = ", ".join(f"sum(CAST({e} AS DOUBLE)) AS {n}" for n, e in terms.items())
    error = "CASE WHEN cnt > 1 THEN round(b_" + metric + ".stderr, 6) END"
    join = f"LEFT JOIN b_{metric} USING (task)"
    if metric == "mean":
        error, join = "round(closed, 6)", ""
    elif metric in ("exact_match", "brier"):
        error, join = "NULL", ""
    return f"""SELECT task, '{metric}' AS metric, round({value}, 6) AS value, {error} AS stderr, cnt AS n FROM
    (SELECT task, count(*) AS cnt, CAST(count(*) AS DOUBLE) AS weight, stddev_samp(value) / sqrt(count(*)) AS closed, {sums} FROM scored GROUP BY task) t {join}"""


RESAMPLED = ("nanmean", "perplexity", "f1", "mcc")
ITERS = 50

# Text metrics by name: what each pair adds to the sums, and the metric of the sums.
BLEU_TERMS = {f"{x}{n}": f"{x}{n}" for x in "mc" for n in range(1, 5)} | {"p_len": "pl", "g_len": "gl"}
BLEU_PRECISIONS = [
    f"ln(CASE WHEN m{n} = 0 THEN 100.0 / (power(2, {' + '.join(f'CAST(m{i} = 0 AS INT)' for i in range(1, n + 1))}) * greatest(c{n}, 1)) ELSE 100.0 * m{n} / greatest(c{n}, 1) END)"
    for n in range(1, 5)
]
BLEU_VALUE = f"""CASE WHEN {' OR '.join(f'c{n} = 0' for n in range(1, 5))} OR m1 = 0 THEN 0
    ELSE CASE WHEN p_len < g_len THEN exp(1 - g_len / nullif(p_len, 0)) ELSE 1 END * exp(({' + '.join(BLEU_PRECISIONS)}) / 4) END"""
CHRF_TERMS = {f"{x}{n}": f"{x}{n}" for n in range(1, 7) for x in "hrm"}
CHRF_USED = [f"(h{n} > 0 AND r{n} > 0)" for n in range(1, 7)]


def chrf_mean(below):
    parts = " + ".join(f"CASE WHEN {u} THEN m{n} / nullif({below}{n}, 0) ELSE 0 END" for n, u in enumerate(CHRF_USED, 1))
    return f"(({parts}) / greatest({' + '.join(f'CAST({u} AS INT)' for u in CHRF_USED)}, 1))"


CHRF_VALUE = f"CASE WHEN {chrf_mean('h')} + {chrf_mean('r')} > 0 THEN 100.0 * 5 * {chrf_mean('h')} * {chrf_mean('r')} / (4 * {chrf_mean('h')} + {chrf_mean('r')}) ELSE 0 END"
CHRF_ROWS = "chs AS (SELECT ch.task AS grp, " + ", ".join(
    f"CASE WHEN length(g) >= {n} THEN greatest(length(p) - {n - 1}, 0) ELSE 0 END AS h{n}, greatest(length(g) - {n - 1}, 0) AS r{n}, coalesce(z{n}.m, 0) AS m{n}"
    for n in range(1, 7)
) + " FROM ch " + " ".join(f"LEFT JOIN z{n} ON z{n}.k = ch.k" for n in range(1, 7)) + ")"


def text_dispatch_sql(metric, source, terms, value):
    sums = ", ".join(f"sum(CAST({e} AS DOUBLE)) AS {n}" for n, e in terms.items())
    return f"""SELECT grp AS task, '{metric}' AS metric, round({value}, 6) AS value, CASE WHEN cnt > 1 THEN round(b_{metric}.stderr, 6) END AS stderr, cnt AS n
    FROM (SELECT grp, count(*) AS cnt, {sums} FROM {source} GROUP BY grp) t LEFT JOIN b_{metric} USING (grp)"""


MEDIAN_CTES = f"""med_r AS (SELECT task, value, row_number() OVER (PARTITION BY task ORDER BY doc_id) - 1 AS pos, count(*) OVER (PARTITION BY task) AS n FROM scored),
    med_d AS (SELECT task, CAST(floor((CAST(concat('0x', substring(md5(concat_ws('|', '0', 'middle', task, CAST(rep AS VARCHAR))), 1, 13)) AS BIGINT) + 0.5) / 4503599627370496.0 * n) AS BIGINT) AS pos
      FROM (SELECT DISTINCT task, n FROM med_r) x, (SELECT unnest(range({ITERS})) AS rep) r),
    med AS (SELECT d.task, stddev_samp(r.value) AS stderr FROM med_d d JOIN med_r r ON r.task = d.task AND r.pos = d.pos GROUP BY d.task),
    all_q AS (SELECT task, doc_id % 5 AS q, CAST(bool_and(gold = pred) AS INT) AS em FROM scored GROUP BY ALL),
    all_pq AS (SELECT task, doc_id % 3 AS p, doc_id % 5 AS q, CAST(bool_and(gold = pred) AS INT) AS em FROM scored GROUP BY ALL)"""
MEDIAN_ROWS = """SELECT r.task, 'median' AS metric, round(r.value, 6) AS value, CASE WHEN n > 1 THEN round(med.stderr, 6) END AS stderr, n
    FROM med_r r LEFT JOIN med ON med.task = r.task WHERE pos = n // 2"""
ALL_ROWS = """SELECT task, 'acc_all' AS metric, (SELECT round(avg(em), 6) FROM all_pq WHERE all_pq.task = t.task) AS value,
    CASE WHEN cnt > 1 THEN (SELECT round(stddev_samp(em) / sqrt(count(*)), 6) FROM all_q WHERE all_q.task = t.task) END AS stderr, cnt AS n
    FROM (SELECT task, count(*) AS cnt FROM scored GROUP BY task) t"""


@query(
    "stderr_dispatch",
    f"WITH RECURSIVE {SCORED_SQL}, {PAIRS_SQL}, {POIS}, {ngram_ctes(mt_sql, 'task')}, {chrf_sql()}, {CHRF_ROWS}, {MEDIAN_CTES}, "
    + ", ".join(boot_sql(f"b_{m}", "task", "scored", *DISPATCH[m], ITERS, 0) for m in RESAMPLED)
    + f", {boot_sql('b_bleu', 'grp', 'b', BLEU_TERMS, BLEU_VALUE, ITERS, 0)}, {boot_sql('b_chrf', 'grp', 'chs', CHRF_TERMS, CHRF_VALUE, ITERS, 0)} "
    + " UNION ALL ".join(
        [dispatch_sql(m) for m in DISPATCH]
        + [MEDIAN_ROWS, ALL_ROWS, text_dispatch_sql("bleu", "b", BLEU_TERMS, BLEU_VALUE), text_dispatch_sql("chrf", "chs", CHRF_TERMS, CHRF_VALUE)]
    ),
)
def stderr_dispatch(spark, d):
    v = F.col("value")
    rows = scored(spark, d).withColumns(
        {
            "s_brier": (v - 0.25) * (v - 0.25),
            "s_nanmean": F.when(F.col("doc_id") % 3 != 0, v),
            "s_perplexity": (-1 - F.col("gold") * 2 - F.col("pred")).cast("double"),
            "s_pair": F.struct("gold", "pred"),
            "s_median": F.struct(F.col("doc_id").alias("order"), "value"),
            "s_all": F.struct((F.col("doc_id") % 3).alias("paragraph"), (F.col("doc_id") % 5).alias("question"), (F.col("gold") == F.col("pred")).alias("correct")),
        }
    )
    scores = {"mean": "value", "exact_match": "value", "brier": "s_brier", "nanmean": "s_nanmean", "perplexity": "s_perplexity", "f1": "s_pair", "mcc": "s_pair"}
    numbers = E.metrics_with_stderr(rows, ["task"], scores | {"median": "s_median", "acc_all": "s_all"}, ITERS)
    texts = pairs(spark, d).select("task", F.struct("pred", "gold").alias("texts"))
    both = numbers.unionByName(E.metrics_with_stderr(texts, ["task"], {"bleu": "texts", "chrf": "texts"}, ITERS))
    return both.select("task", "metric", r6(F.col("value")).alias("value"), r6(F.col("stderr")).alias("stderr"), "n")


PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
CHAIN_TREE = {"urgent": PRIORITIES[:2], "other": PRIORITIES[2:], "all": ["urgent", "other"]}
CHAIN_LEAVES = ", ".join(
    f"('{g}', '{t}')" for g, ts in {"urgent": PRIORITIES[:2], "other": PRIORITIES[2:], "all": PRIORITIES}.items() for t in ts
)


@query(
    "evaluation_chain",
    f"""WITH RECURSIVE {MC_SQL}, {POIS}, want AS (SELECT doc_id, choice AS target FROM mc WHERE idx = gold),
    votes AS (SELECT doc_id, lower(choice) AS response, count(*) AS n, min(idx) AS first FROM mc GROUP BY doc_id, lower(choice)),
    voted AS (SELECT doc_id, response FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, first) AS i FROM votes) v WHERE i = 1),
    picked AS (SELECT doc_id, choice AS response, 'first' AS filter FROM mc WHERE idx = 0 UNION ALL SELECT doc_id, response, 'vote' FROM voted),
    scored AS (SELECT concat(o_orderpriority, '|', filter) AS task, CAST(response = CASE filter WHEN 'vote' THEN lower(target) ELSE target END AS DOUBLE) AS value,
      length(target) % 2 AS gold, length(response) % 2 AS pred, -length(response) / 10.0 AS ll
      FROM picked JOIN want USING (doc_id) JOIN orders ON o_orderkey = doc_id),
    {boot_sql('b_f1', 'task', 'scored', TWO, F1_VALUE, 20, 0)}, {boot_sql('b_perplexity', 'task', 'scored', {'x': 'll'}, 'exp(-x / nullif(weight, 0))', 20, 0)},
    sums AS (SELECT task, count(*) AS cnt, avg(value) AS acc, stddev_samp(value) / sqrt(count(*)) AS err, exp(-sum(ll) / count(*)) AS ppl,
      sum({TP}) AS tp, sum({FP}) AS fp, sum({FN}) AS fn FROM scored GROUP BY task),
    res AS (SELECT task, 'mean' AS metric, acc AS value, err AS stderr, cnt FROM sums
      UNION ALL SELECT task, 'f1', {F1_VALUE}, b_f1.stderr, cnt FROM sums JOIN b_f1 USING (task)
      UNION ALL SELECT task, 'perplexity', ppl, b_perplexity.stderr, cnt FROM sums JOIN b_perplexity USING (task)),
    named AS (SELECT split_part(task, '|', 1) AS task, metric, split_part(task, '|', 2) AS filter, value, stderr, cnt FROM res),
    leaves(g, task) AS (VALUES {CHAIN_LEAVES}),
    up AS (SELECT g AS task, metric, filter, sum(value * cnt) / sum(cnt) AS value, sqrt(sum((cnt - 1) * stderr * stderr * cnt) / (sum(cnt) - count(*)) / sum(cnt)) AS stderr,
      CAST(sum(cnt) AS BIGINT) AS cnt FROM named JOIN leaves USING (task) GROUP BY g, metric, filter)
    SELECT task, metric, filter, round(value, 6) AS value, round(stderr, 6) AS stderr, cnt AS n FROM (SELECT * FROM named UNION ALL SELECT * FROM up) z""",
)
def evaluation_chain(spark, d):
    questions = mc_docs(spark, d).select("doc_id", F.col("category").alias("task"), F.get("choices", F.col("gold")).alias("target"))
    responses = mc(spark, d).select("doc_id", "idx", F.col("choice").alias("response"))
    pipelines = {"first": E.named_steps([("take_first", {})]), "vote": E.named_steps([("lowercase", {}), ("majority_vote", {})])}
    target = F.when(F.col("filter") == "vote", F.lower("target")).otherwise(F.col("target"))
    process = {
        "mean": (F.col("response") == target).cast("double"),
        "f1": F.struct((F.length("target") % 2).alias("gold"), (F.length("response") % 2).alias("pred")),
        "perplexity": -F.length("response") / 10.0,
    }
    out = E.evaluate(questions, responses, pipelines, process, CHAIN_TREE, iters=20)
    return out.select("task", "metric", "filter", r6(F.col("value")).alias("value"), r6(F.col("stderr")).alias("stderr"), "n")


@query(
    "stderr_pooled",
    f"""WITH {TASKS_SQL} SELECT grp, round(sqrt(sum((n - 1) * stderr * stderr * n) / (sum(n) - count(*)) / sum(n)), 6) AS stderr FROM tasks GROUP BY grp""",
)
def stderr_pooled(spark, d):
    return tasks(spark, d).groupBy("grp").agg(r6(M.pooled_stderr(F.col("stderr"), F.col("n"))).alias("stderr"))


@query(
    "stderr_combined",
    f"""WITH RECURSIVE {TASKS_SQL}, o AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY task) AS i FROM tasks),
    f AS (SELECT grp, i, CAST(n AS DOUBLE) AS n0, CAST(stderr * stderr AS DOUBLE) AS var, CAST(mean AS DOUBLE) AS score FROM o WHERE i = 1
      UNION ALL
      SELECT f.grp, o.i, f.n0, CAST(((f.n0 - 1) * f.var + (o.n - 1) * o.stderr * o.stderr) / (f.n0 + o.n - 1)
        + f.n0 * o.n / ((f.n0 + o.n) * (f.n0 + o.n - 1)) * power((f.score * f.n0 + o.mean * o.n) / (f.n0 + o.n) - o.mean, 2) AS DOUBLE),
        CAST((f.score * f.n0 + o.mean * o.n) / (f.n0 + o.n) AS DOUBLE) FROM f JOIN o ON o.grp = f.grp AND o.i = f.i + 1)
    SELECT grp, round(sqrt(arg_max(var, i)), 6) AS stderr FROM f GROUP BY grp""",
)
def stderr_combined(spark, d):
    return M.combined_stderr(tasks(spark, d), ["grp"], "task").select("grp", r6(F.col("stderr")).alias("stderr"))


@query(
    "group_mean",
    f"WITH {TASKS_SQL} SELECT grp, round(sum(mean * n) / sum(n), 6) AS weighted, round(avg(mean), 6) AS unweighted FROM tasks GROUP BY grp",
)
def group_mean(spark, d):
    m, n = F.col("mean"), F.col("n")
    return tasks(spark, d).groupBy("grp").agg(
        r6(M.group_mean(m, n)).alias("weighted"), r6(M.group_mean(m, n, False)).alias("unweighted")
    )


def long_results(spark, d):
    """Long results: two metrics per task, one of them without a stderr."""
    t = tasks(spark, d)
    cells = F.array(
        F.struct(F.lit("acc").alias("metric"), F.col("mean").alias("value"), F.col("stderr").alias("stderr")),
        F.struct(F.lit("em").alias("metric"), (F.col("mean") / 2).alias("value"), F.lit(None).cast("double").alias("stderr")),
    )
    return t.select("task", "grp", "n", F.lit("none").alias("filter"), F.explode(cells).alias("c")).select(
        "task", "grp", "n", "filter", "c.metric", "c.value", "c.stderr"
    )


LONG = f"""{TASKS_SQL}, res AS (SELECT task, grp, n, 'none' AS filter, 'acc' AS metric, mean AS value, stderr FROM tasks
  UNION ALL SELECT task, grp, n, 'none', 'em', mean / 2, NULL FROM tasks)"""
TREE = {"low": [f"src{i}" for i in range(10)], "high": [f"src{i}" for i in range(10, 20)], "all": ["low", "high"]}


@query(
    "group_rollup",
    f"""WITH {LONG}, leaf AS (SELECT DISTINCT task, CASE WHEN CAST(substring(task, 4) AS INT) < 10 THEN 'low' ELSE 'high' END AS g FROM tasks
      UNION ALL SELECT DISTINCT task, 'all' FROM tasks)
    SELECT g AS grp, metric, filter, round(sum(value * n) / sum(n), 6) AS value,
    CASE WHEN count(stderr) = count(*) THEN round(sqrt(sum((n - 1) * stderr * stderr * n) / (sum(n) - count(*)) / sum(n)), 6) END AS stderr, CAST(sum(n) AS BIGINT) AS n
    FROM res JOIN leaf ON res.task = leaf.task GROUP BY g, metric, filter""",
)
def group_rollup(spark, d):
    r = M.group_rollup(long_results(spark, d).drop("grp"), TREE)
    return r.select("grp", "metric", "filter", r6(F.col("value")).alias("value"), r6(F.col("stderr")).alias("stderr"), "n")


@query(
    "consolidate_results",
    f"""WITH {LONG} SELECT task, max(n) AS samples, round(max(CASE WHEN metric = 'acc' THEN value END), 6) AS acc, round(max(CASE WHEN metric = 'acc' THEN stderr END), 6) AS acc_stderr,
    round(max(CASE WHEN metric = 'em' THEN value END), 6) AS em, CAST(NULL AS DOUBLE) AS em_stderr, CASE WHEN task = 'src0' THEN 'Source zero' ELSE task END AS alias FROM res GROUP BY task""",
)
def consolidate_results(spark, d):
    w = M.consolidate_results(long_results(spark, d), ["acc", "em"], {"src0": "Source zero"})
    return w.select("task", "alias", "samples", *[r6(F.col(c)).alias(c) for c in ("acc", "acc_stderr", "em", "em_stderr")])


@query("sample_counts", "SELECT source, count(*) AS original, least(30, count(*)) AS effective FROM documents GROUP BY source")
def sample_counts(spark, d):
    return M.sample_counts(table(spark, d, "documents"), "source", 30)


@query(
    "higher_is_better",
    f"""WITH {TASKS_SQL}, t AS (SELECT grp, grp = 'g1' OR CAST(substring(task, 4) AS INT) % 2 = 0 AS higher FROM tasks)
    SELECT grp, CASE WHEN bool_and(higher) = bool_or(higher) THEN bool_and(higher) END AS higher FROM t GROUP BY grp""",
)
def higher_is_better(spark, d):
    flag = (F.col("grp") == "g1") | (F.expr("substring(task, 4)").cast("int") % 2 == 0)
    return M.higher_is_better(tasks(spark, d).withColumn("higher", flag), ["grp"], "higher")


BBQ = f"""{MC_SQL}, {BEST}, fl AS (SELECT doc_id, category, CAST(pred = gold AS DOUBLE) AS acc, CAST(pred = 1 AS DOUBLE) AS biased, CAST(pred <> n - 1 AS DOUBLE) AS non_unk, doc_id % 2 = 0 AS dis FROM best)"""


@query(
    "bbq_bias",
    f"""WITH {BBQ}, g AS (SELECT category, avg(CASE WHEN NOT dis THEN acc END) AS aa, avg(CASE WHEN dis THEN acc END) AS ad, sum(CASE WHEN dis THEN biased END) AS bd, sum(CASE WHEN dis THEN non_unk END) AS nd,
      sum(CASE WHEN NOT dis THEN biased END) AS ba, sum(CASE WHEN NOT dis THEN non_unk END) AS na FROM fl GROUP BY ROLLUP (category))
    SELECT category, round(aa, 6) AS accuracy_amb, round(ad, 6) AS accuracy_disamb, round((1 - aa) * CASE WHEN ba = 0 THEN 0 ELSE 2 * ba / na - 1 END, 6) AS amb_bias_score,
    round(CASE WHEN bd = 0 THEN 0 ELSE 2 * bd / nd - 1 END, 6) AS disamb_bias_score FROM g""",
)
def bbq_bias(spark, d):
    b = M.bbq_bias(M.bbq_flags(bbq_answers(spark, d)))
    return b.select("category", *[r6(F.col(c)).alias(c) for c in b.columns if c != "category"])


def pair_rate(src, q, a, extra=""):
    return f"""cnt AS (SELECT {q}, {a} AS a, count(*) AS c FROM {src} GROUP BY {q}, {a}),
    pq AS (SELECT {q}, sum(c * (c - 1) / 2) AS eq, sum(c) AS n FROM cnt GROUP BY {q}),
    rate AS (SELECT round(CAST(sum(eq) / sum(n * (n - 1) / 2) AS DOUBLE), 6) AS consistency_rate FROM pq)"""


@query("consistency_rate", f"WITH {ATTEMPTS_SQL}, {pair_rate('attempts', 'problem_id', 'answer')} SELECT * FROM rate")
def consistency_rate(spark, d):
    c = M.consistency_rate(attempts(spark, d), ["problem_id"], F.col("answer"))
    return c.select(r6(F.col("consistency_rate")).alias("consistency_rate"))


@query(
    "options_consistency_rate",
    f"""WITH {MC_SQL}, m AS (SELECT category, doc_id % 7 AS q, CASE WHEN is_greedy THEN gold WHEN idx = gold OR idx = n_choices - 1 THEN gold ELSE idx END AS ans FROM mc),
    {pair_rate('m', 'category, q', 'ans')} SELECT * FROM rate""",
)
def options_consistency_rate(spark, d):
    answer = F.when(F.col("is_greedy"), F.col("gold")).otherwise(F.col("idx"))
    mapped = M.map_swapped_option(answer, F.col("gold"), F.col("n_choices") - 1)
    rows = mc(spark, d).withColumn("q", F.col("doc_id") % 7).withColumn("ans", mapped)
    c = M.consistency_rate(rows, ["category", "q"], F.col("ans"))
    return c.select(r6(F.col("consistency_rate")).alias("consistency_rate"))


@query(
    "per_prompt_accuracy",
    f"WITH {ATTEMPTS_SQL} SELECT attempt_idx AS prompt_id, round(avg(CAST(status = 'AC' AS INT)), 4) AS accuracy FROM attempts GROUP BY attempt_idx",
)
def per_prompt_accuracy(spark, d):
    rows = attempts(spark, d).withColumnRenamed("attempt_idx", "prompt_id")
    return M.accuracy_by(rows, ["prompt_id"], F.col("status") == "AC")


@query(
    "per_option_accuracy",
    f"""WITH {MC_SQL}, m AS (SELECT doc_id, n_choices, gold, category, list(ll ORDER BY idx) AS lls FROM mc GROUP BY ALL),
    o AS (SELECT *, unnest(range(5)) AS slot FROM m),
    e AS (SELECT chr(CAST(65 + slot AS INT)) AS forced_option, CASE WHEN slot < n_choices THEN slot ELSE gold END AS place, list_position(lls, list_max(lls)) - 1 AS pick FROM o)
    SELECT forced_option, round(avg(CAST(pick = place AS INT)), 4) AS accuracy FROM e GROUP BY forced_option""",
)
def per_option_accuracy(spark, d):
    """The model prefers places by their log-likelihood; the gold option is moved to every place in turn."""
    rows = P.expand_option_orders(mc_docs(spark, d), "choices", "gold", ["A", "B", "C", "D", "E"])
    pick = F.array_position("lls", F.array_max("lls")) - 1
    return M.accuracy_by(rows.withColumnRenamed("always_same_option", "forced_option"), ["forced_option"], pick == F.col("gold"))


@query(
    "multi_seed_summary",
    f"""WITH {ATTEMPTS_SQL}, s AS (SELECT problem_id, attempt_idx + 1 AS seed, answer, status = 'AC' AS ok FROM attempts),
    k AS (SELECT * FROM s WHERE problem_id IN (SELECT problem_id FROM s GROUP BY problem_id HAVING count(DISTINCT seed) = 16)),
    {pair_rate('k', 'problem_id', 'answer')}
    SELECT seed, round(avg(CAST(ok AS INT)), 6) AS accuracy, (SELECT consistency_rate FROM rate) AS consistency_rate FROM k GROUP BY seed""",
)
def multi_seed_summary(spark, d):
    rows = attempts(spark, d).withColumn("seed", F.col("attempt_idx") + 1)
    m = M.multi_seed_summary(rows, ["problem_id"], list(range(1, 17)), "answer", F.col("status") == "AC")
    return m.select("seed", r6(F.col("accuracy")).alias("accuracy"), r6(F.col("consistency_rate")).alias("consistency_rate"))


@query(
    "length_bucket_score",
    f"WITH {PAIRS_SQL} SELECT max_length, round(avg((CAST(contains(lower(pred), 'the') AS INT) + CAST(contains(lower(pred), 'and') AS INT)) / CAST(2 AS DOUBLE)), 6) AS score, count(*) AS n FROM pairs GROUP BY max_length",
)
def length_bucket_score(spark, d):
    score = S.share_contained(F.col("pred"), F.array(F.lit("the"), F.lit("and")))
    return M.length_bucket_score(pairs(spark, d), "max_length", score).select("max_length", r6(F.col("score")).alias("score"), "n")


@query(
    "lexical_prf",
    f"""WITH {SCORED_SQL}, s AS (SELECT sum(value) AS t, greatest(sum(pred), 1) AS a, greatest(count(*), 1) AS g FROM scored), p AS (SELECT t / a AS precision, t / g AS recall FROM s)
    SELECT round(precision, 6) AS precision, round(recall, 6) AS recall, round(2 * precision * recall / (precision + recall), 6) AS f1 FROM p""",
)
def lexical_prf(spark, d):
    rows = scored(spark, d).withColumn("one", F.lit(1))
    p = M.lexical_prf(rows, "value", "pred", "one")
    return p.select(*[r6(F.col(c)).alias(c) for c in p.columns])


@query(
    "two_label_sentiment_f1",
    """WITH x AS (SELECT l_linenumber % 4 AS g, l_partkey % 4 AS p FROM lineitem),
    y AS (SELECT 'o' AS l, CAST(g IN (0, 3) AS INT) AS g, CAST(p IN (0, 3) AS INT) AS p FROM x UNION ALL SELECT 'n', CAST(g IN (1, 3) AS INT), CAST(p IN (1, 3) AS INT) FROM x),
    z AS (SELECT l, c, sum(CAST(g = c AND p = c AS INT)) AS tp, sum(CAST(g = c AS INT)) + sum(CAST(p = c AS INT)) AS s FROM y, (VALUES (0), (1)) v(c) GROUP BY l, c)
    SELECT round(avg(f), 6) AS f1 FROM (SELECT l, avg(2.0 * tp / s) AS f FROM z GROUP BY l) q""",
)
def two_label_sentiment_f1(spark, d):
    rows = table(spark, d, "lineitem").select((F.col("l_linenumber") % 4).alias("g"), (F.col("l_partkey") % 4).cast("int").alias("p"))
    return M.two_label_sentiment_f1(rows, "g", "p").select(r6(F.col("f1")).alias("f1"))


@query(
    "entity_macro_f1",
    f"""WITH {ENTITY_SQL}, {ENTITY_PAIRS}, e AS (SELECT unnest(string_split(labels, ' ')) AS t FROM lab), q AS (SELECT CAST(split_part(t, '/', 1) AS INT) AS p, CAST(split_part(t, '/', 2) AS INT) AS g FROM e),
    z AS (SELECT c, sum(CAST(g = c AND p = c AS INT)) AS tp, sum(CAST(g = c AS INT)) + sum(CAST(p = c AS INT)) AS s FROM q, (VALUES (0), (1), (2)) v(c) GROUP BY c)
    SELECT round(avg(2.0 * tp / s), 6) AS f1 FROM z""",
)
def entity_macro_f1(spark, d):
    labels = entities(spark, d).select(F.explode("pairs").alias("x")).select("x.pred", "x.gold")
    return M.entity_macro_f1(labels).select(r6(F.col("f1")).alias("f1"))


@query(
    "squad_v2_scores",
    f"""WITH {PAIRS_SQL}, {F1_SQL}, a AS (SELECT p.doc_id, p.doc_id % 3 <> 0 AS has, p.doc_id % 5 = 0 AS emp, (p.doc_id % 97) / CAST(97 AS DOUBLE) AS pna, {norm_sql('pred', EN)} = {norm_sql('gold', EN)} AS em, f1 FROM pairs p JOIN f1 ON p.doc_id = f1.doc_id),
    b AS (SELECT doc_id, has, emp, pna, CAST(CASE WHEN has THEN CASE WHEN em AND NOT emp THEN 1 ELSE 0 END ELSE CASE WHEN emp THEN 1 ELSE 0 END END AS DOUBLE) AS x,
      CAST(CASE WHEN has THEN CASE WHEN emp THEN 0 ELSE f1 END ELSE CASE WHEN emp THEN 1 ELSE 0 END END AS DOUBLE) AS f FROM a),
    r AS (SELECT sum(CASE WHEN has THEN x WHEN emp THEN 0 ELSE -1 END) OVER w AS rx, sum(CASE WHEN has THEN f WHEN emp THEN 0 ELSE -1 END) OVER w AS rf FROM b WINDOW w AS (ORDER BY pna, doc_id ROWS UNBOUNDED PRECEDING)),
    m AS (SELECT greatest(max(rx), 0) AS mx, greatest(max(rf), 0) AS mf FROM r)
    SELECT round(100 * avg(x), 6) AS exact, round(100 * avg(f), 6) AS f1, round(100 * avg(CASE WHEN has THEN x END), 6) AS HasAns_exact, round(100 * avg(CASE WHEN has THEN f END), 6) AS HasAns_f1,
    round(100 * avg(CASE WHEN NOT has THEN x END), 6) AS NoAns_exact, round(100 * avg(CASE WHEN NOT has THEN f END), 6) AS NoAns_f1, count(*) AS total,
    round(100 * (count(CASE WHEN NOT has THEN 1 END) + (SELECT mx FROM m)) / count(*), 6) AS best_exact, round(100 * (count(CASE WHEN NOT has THEN 1 END) + (SELECT mf FROM m)) / count(*), 6) AS best_f1 FROM b""",
)
def squad_v2_scores(spark, d):
    empty, has = F.col("doc_id") % 5 == 0, F.col("doc_id") % 3 != 0
    refused = empty.cast("double")
    em = S.answer_em(F.col("pred"), F.col("gold")).cast("double")
    f1 = S.token_f1(F.col("pred"), F.col("gold"))
    rows = pairs(spark, d).select(
        "doc_id",
        has.alias("has_answer"),
        empty.alias("pred_empty"),
        ((F.col("doc_id") % 97) / 97.0).alias("p_na"),
        F.when(has, F.when(empty, 0.0).otherwise(em)).otherwise(refused).alias("exact"),
        F.when(has, F.when(empty, 0.0).otherwise(f1)).otherwise(refused).alias("f1"),
    )
    s = M.squad_v2_scores(rows, "doc_id")
    return s.select("total", *[r6(F.col(c)).alias(c) for c in s.columns if c != "total"])
