"""Evaluation analytics queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from evalweave.functions import text as T
from evalweave.operators import analytics as Y
from evalweave.operators import curate as C
from evalweave.plans.fixtures import (
    ATTEMPTS_SQL, MC_SQL, MESSAGES_SQL, TASKS_SQL, attempts, mc, mc_docs, messages, sql_words, tasks,
)
from evalweave.plans.q_curate import TRACE
from evalweave.plans.q_metrics import LONG, long_results
from evalweave.plans.registry import query

KS = list(range(1, 17))
KS_SQL = f"(SELECT unnest(range(1, 17)) AS k)"


def r6(x):
    return F.round(x, 6)


def graded(spark, d):
    """Attempts with the accepted flag, tag array and a model name."""
    return (
        attempts(spark, d)
        .withColumn("accepted", F.col("status") == "AC")
        .withColumn("tags", F.split("tags_csv", ","))
        .withColumn("model", F.when(F.col("attempt_idx") % 2 == 0, "base").otherwise("sft"))
    )


GR = f"""WITH {ATTEMPTS_SQL}, graded AS (SELECT *, status = 'AC' AS accepted, string_split(tags_csv, ',') AS tags, CASE WHEN attempt_idx % 2 = 0 THEN 'base' ELSE 'sft' END AS model FROM attempts),
tagged AS (SELECT *, unnest(tags) AS tag FROM graded)"""


@query(
    "pass_at_k",
    f"""{GR}, f AS (SELECT problem_id, min(CASE WHEN accepted THEN attempt_idx END) AS a FROM graded GROUP BY problem_id)
    SELECT CAST(k AS INT) AS k, count(CASE WHEN a < k THEN 1 END) AS passed, count(*) AS total, round(count(CASE WHEN a < k THEN 1 END) / CAST(count(*) AS DOUBLE), 6) AS accuracy FROM f, {KS_SQL} ks GROUP BY k""",
)
def pass_at_k(spark, d):
    return Y.pass_at_k(graded(spark, d), KS).withColumn("accuracy", r6(F.col("accuracy")))


@query(
    "pass_at_k_tokens",
    f"{GR} SELECT CAST(k AS INT) AS k, CAST(sum(tokens) AS BIGINT) AS tokens FROM graded, {KS_SQL} ks WHERE attempt_idx < k GROUP BY k",
)
def pass_at_k_tokens(spark, d):
    return Y.pass_at_k_tokens(graded(spark, d), KS)


@query(
    "pass_at_k_unbiased",
    f"""{GR}, p AS (SELECT problem_id, count(*) AS n, count(CASE WHEN accepted THEN 1 END) AS c FROM graded GROUP BY problem_id),
    e AS (SELECT k, CASE WHEN n - c < k THEN CAST(1 AS DOUBLE) WHEN c = 0 THEN CAST(0 AS DOUBLE)
       ELSE 1 - list_product(list_transform(range(n - c + 1, n + 1), lambda i: 1.0 - k / CAST(i AS DOUBLE))) END AS v FROM p, (SELECT unnest([1, 4, 8, 16]) AS k) ks)
    SELECT k, round(avg(v), 6) AS pass_at_k FROM e GROUP BY k""",
)
def pass_at_k_unbiased(spark, d):
    return Y.pass_at_k_unbiased(graded(spark, d), [1, 4, 8, 16]).withColumn("pass_at_k", r6(F.col("pass_at_k")))


@query(
    "problems_solved",
    f"{GR} SELECT count(DISTINCT CASE WHEN accepted THEN problem_id END) AS solved, count(DISTINCT problem_id) AS total FROM graded",
)
def problems_solved(spark, d):
    return Y.problems_solved(graded(spark, d))


@query(
    "accuracy_by_rating",
    f"""{GR}, p AS (SELECT problem_id, max(rating) AS rating, bool_or(accepted) AS s FROM graded WHERE rating IS NOT NULL GROUP BY problem_id),
    b AS (SELECT CAST(rating // 200 * 200 AS BIGINT) AS bin, count(CASE WHEN s THEN 1 END) AS accepted, count(*) AS total FROM p GROUP BY 1),
    ax AS (SELECT unnest(range((SELECT min(bin) FROM b), (SELECT max(bin) FROM b) + 1, 200)) AS bin)
    SELECT ax.bin, coalesce(accepted, 0) AS accepted, coalesce(total, 0) AS total, round(100.0 * accepted / CAST(total AS DOUBLE), 6) AS accuracy FROM ax LEFT JOIN b ON ax.bin = b.bin""",
)
def accuracy_by_rating(spark, d):
    return Y.accuracy_by_rating(graded(spark, d)).withColumn("accuracy", r6(F.col("accuracy")))


@query(
    "accuracy_by_tag",
    f"""{GR}, s AS (SELECT model, problem_id, tag, bool_or(accepted) AS s FROM tagged GROUP BY model, problem_id, tag),
    p AS (SELECT model, tag, count(*) AS total, 100 * avg(CAST(s AS INT)) AS accuracy FROM s GROUP BY model, tag HAVING count(*) > 10),
    o AS (SELECT tag, CAST(row_number() OVER (ORDER BY accuracy DESC, tag) AS INT) AS tag_rank FROM p WHERE model = 'sft')
    SELECT tag_rank, p.tag, model, total, round(accuracy, 6) AS accuracy FROM p JOIN o ON p.tag = o.tag""",
)
def accuracy_by_tag(spark, d):
    return Y.accuracy_by_tag(graded(spark, d), "sft", 10).withColumn("accuracy", r6(F.col("accuracy")))


@query(
    "tag_model_tokens",
    f"""{GR}, top AS (SELECT tag FROM tagged GROUP BY tag ORDER BY count(*) DESC, tag LIMIT 15), r AS (SELECT tag, model, accepted, tokens FROM tagged WHERE tag IN (SELECT tag FROM top)
      UNION ALL SELECT 'overall', model, accepted, tokens FROM graded)
    SELECT tag, model, round(100 * avg(CAST(accepted AS INT)), 6) AS accuracy, round(avg(tokens), 6) AS avg_tokens FROM r GROUP BY tag, model""",
)
def tag_model_tokens(spark, d):
    t = Y.tag_model_tokens(graded(spark, d))
    return t.select("tag", "model", r6(F.col("accuracy")).alias("accuracy"), r6(F.col("avg_tokens")).alias("avg_tokens"))


@query(
    "thinking_token_mean",
    f"WITH {MESSAGES_SQL} SELECT coalesce(source, '') AS source, round(avg(len({sql_words(TRACE)})), 6) AS thinking_tokens FROM messages GROUP BY 1",
)
def thinking_token_mean(spark, d):
    n = F.size(T.words(C.thinking_trace(F.col("response"))))
    return messages(spark, d).groupBy(F.coalesce("source", F.lit("")).alias("source")).agg(r6(F.avg(n)).alias("thinking_tokens"))


@query("status_distribution", f"{GR} SELECT status, count(*) AS n FROM graded GROUP BY status")
def status_distribution(spark, d):
    return Y.status_distribution(graded(spark, d))


@query(
    "status_funnel",
    f"""{GR}, s AS (SELECT CASE status WHEN 'FE' THEN 1 WHEN 'CE' THEN 2 WHEN 'RE' THEN 3 WHEN 'MLE' THEN 4 WHEN 'TLE' THEN 4 WHEN 'WA' THEN 5 ELSE 6 END AS st FROM graded)
    SELECT CAST(i AS INT) AS stage, ['format', 'compile', 'runtime', 'limits', 'answer'][i] AS name, count(CASE WHEN st = i THEN 1 END) AS failed, count(CASE WHEN st > i THEN 1 END) AS passed
    FROM s, (SELECT unnest(range(1, 6)) AS i) x GROUP BY i""",
)
def status_funnel(spark, d):
    return Y.status_funnel(graded(spark, d))


COUNTS = ", ".join(f"count(CASE WHEN status = '{s}' THEN 1 END) AS {s}" for s in Y.STATUSES)


@query("tag_status_matrix", f"{GR} SELECT tag, count(*) AS total, {COUNTS} FROM tagged GROUP BY tag HAVING count(*) >= 20 ORDER BY count(*) DESC, tag LIMIT 15")
def tag_status_matrix(spark, d):
    return Y.tag_status_matrix(graded(spark, d))


@query("rating_status_matrix", f"{GR} SELECT CAST(rating // 300 * 300 AS BIGINT) AS bin, count(*) AS total, {COUNTS} FROM graded WHERE rating IS NOT NULL GROUP BY 1 HAVING count(*) >= 10")
def rating_status_matrix(spark, d):
    return Y.rating_status_matrix(graded(spark, d))


HEAT = f"""{GR}, top AS (SELECT tag FROM tagged GROUP BY tag ORDER BY count(*) DESC, tag LIMIT 15),
c AS (SELECT CAST(rating // 200 * 200 AS BIGINT) AS bin, tag, count(*) AS n, avg(CAST(status = 'WA' AS INT)) AS share FROM tagged WHERE rating IS NOT NULL AND tag IN (SELECT tag FROM top) GROUP BY 1, 2),
heat AS (SELECT b.bin, t.tag, coalesce(n, 0) AS n, CASE WHEN n >= 5 THEN round(share, 6) END AS share FROM (SELECT DISTINCT bin FROM c) b CROSS JOIN top t LEFT JOIN c ON c.bin = b.bin AND c.tag = t.tag)"""


@query("rating_tag_heatmap", f"{HEAT} SELECT * FROM heat")
def rating_tag_heatmap(spark, d):
    return Y.rating_tag_heatmap(graded(spark, d), "WA").withColumn("share", r6(F.col("share")))


@query("heatmap_peak", f"{HEAT} SELECT * FROM heat WHERE share IS NOT NULL ORDER BY share DESC, bin, tag LIMIT 1")
def heatmap_peak(spark, d):
    return Y.heatmap_peak(Y.rating_tag_heatmap(graded(spark, d), "WA").withColumn("share", r6(F.col("share"))))


@query(
    "token_length_histogram",
    f"""WITH {MESSAGES_SQL}, m AS (SELECT coalesce(source, '') AS source, num_tokens, min(num_tokens) OVER () AS lo, max(num_tokens) OVER () AS hi FROM messages),
    b AS (SELECT source, CAST(least(49, floor((num_tokens - lo) / ((hi - lo) / CAST(50 AS DOUBLE)))) AS INT) AS bin FROM m), c AS (SELECT source, bin, count(*) AS n FROM b GROUP BY source, bin),
    ax AS (SELECT source, CAST(unnest(range(50)) AS INT) AS bin FROM (SELECT DISTINCT source FROM c) s), f AS (SELECT ax.source, ax.bin, coalesce(n, 0) AS n FROM ax LEFT JOIN c ON c.source = ax.source AND c.bin = ax.bin)
    SELECT source, bin, n, CAST(sum(n) OVER (PARTITION BY bin ORDER BY source ROWS UNBOUNDED PRECEDING) AS BIGINT) AS stacked FROM f""",
)
def token_length_histogram(spark, d):
    rows = messages(spark, d).select(F.coalesce("source", F.lit("")).alias("source"), "num_tokens")
    return Y.token_length_histogram(rows, "source", "num_tokens")


@query(
    "token_length_summary",
    f"WITH {MESSAGES_SQL} SELECT coalesce(source, '') AS source, min(num_tokens) AS min, max(num_tokens) AS max, round(avg(num_tokens), 6) AS mean, CAST(median(num_tokens) AS DOUBLE) AS median FROM messages GROUP BY 1",
)
def token_length_summary(spark, d):
    rows = messages(spark, d).select(F.coalesce("source", F.lit("")).alias("source"), "num_tokens")
    return Y.token_length_summary(rows, "num_tokens", ["source"]).withColumn("mean", r6(F.col("mean")))


ERFC_SQL = "(t * exp(-x * x + " + "".join(f"{c} + t * (" for c in Y.ERFC[:-1]) + str(Y.ERFC[-1]) + ")" * (len(Y.ERFC) - 1) + "))"


@query(
    "compare_models_z",
    f"""WITH {TASKS_SQL}, o AS (SELECT task, mean AS a, stderr AS ea, mean * 0.9 + 0.02 AS b, stderr * 1.1 AS eb FROM tasks),
    z AS (SELECT *, (a - b) / nullif(sqrt(ea * ea + eb * eb), 0) AS z FROM o), q AS (SELECT *, abs(z) / sqrt(2) AS x, 1 / (1 + 0.5 * abs(z) / sqrt(2)) AS t FROM z)
    SELECT task, round(z, 6) AS z, round({ERFC_SQL}, 6) AS p_value, {ERFC_SQL} > 0.05 AS same FROM q""",
)
def compare_models_z(spark, d):
    t = tasks(spark, d)
    a = t.select("task", F.col("mean").alias("value"), "stderr")
    b = t.select("task", (F.col("mean") * 0.9 + 0.02).alias("value"), (F.col("stderr") * 1.1).alias("stderr"))
    c = Y.compare_models_z(a, b, ["task"])
    return c.select("task", r6(F.col("z")).alias("z"), r6(F.col("p_value")).alias("p_value"), "same")


@query(
    "regression_diff",
    f"""WITH {TASKS_SQL}, r AS (SELECT task, grp, n, CASE WHEN n % 2 = 0 THEN mean ELSE mean / 2 END AS base_v, CASE WHEN n % 2 = 0 THEN mean * 0.8 ELSE mean * 0.9 END AS new_v FROM tasks)
    SELECT 'main' AS branch, task, grp AS model, round(100 * base_v, 6) AS value, CAST(0 AS DOUBLE) AS diff FROM r
    UNION ALL SELECT 'new', task, grp, round(100 * new_v, 6), round(100 * new_v - 100 * base_v, 6) FROM r""",
)
def regression_diff(spark, d):
    t = tasks(spark, d)
    even = F.col("n") % 2 == 0
    rows = F.array(
        F.struct(F.lit("main").alias("branch"), F.lit("acc_norm").alias("metric"), F.when(even, F.col("mean")).alias("value")),
        F.struct(F.lit("main").alias("branch"), F.lit("acc").alias("metric"), (F.col("mean") / 2).alias("value")),
        F.struct(F.lit("new").alias("branch"), F.lit("acc_norm").alias("metric"), F.when(even, F.col("mean") * 0.8).alias("value")),
        F.struct(F.lit("new").alias("branch"), F.lit("acc").alias("metric"), (F.col("mean") * 0.9).alias("value")),
    )
    long = t.select("task", F.col("grp").alias("model"), F.explode(rows).alias("r")).select("task", "model", "r.*")
    diff = Y.regression_diff(long.where("value IS NOT NULL"), "main")
    return diff.select("branch", "task", "model", r6(F.col("value")).alias("value"), r6(F.col("diff")).alias("diff"))


@query(
    "results_table",
    f"""WITH {LONG}, o AS (SELECT *, row_number() OVER (PARTITION BY task ORDER BY filter, metric) AS i FROM res)
    SELECT task, CAST(i AS INT) AS "row", CASE WHEN i = 1 THEN task ELSE '' END AS tasks, CASE WHEN i = 1 THEN '1' ELSE '' END AS version, CASE WHEN i = 1 THEN 'none' ELSE '' END AS filter, 0 AS n_shot, metric,
    CASE WHEN metric = 'acc' THEN '↑' ELSE '↓' END AS direction, printf('%.4f', value) AS value, CASE WHEN stderr IS NULL THEN 'N/A' ELSE printf('%.4f', stderr) END AS stderr FROM o""",
)
def results_table(spark, d):
    rows = long_results(spark, d).select(
        "task", F.lit(1).alias("version"), "filter", F.lit(0).alias("n_shot"), "metric",
        (F.col("metric") == "acc").alias("higher_is_better"), "value", "stderr",
    )
    return Y.results_table(rows)


@query(
    "sample_export",
    f"""WITH {MC_SQL}, g AS (SELECT doc_id, concat('Q: ', max(category), chr(10), chr(10), string_agg(concat('- ', choice), chr(10) ORDER BY idx)) AS data,
      CAST(max(gold) AS VARCHAR) AS labels, string_agg(CAST(ll AS VARCHAR), ', ' ORDER BY idx) AS output, CAST(count(*) AS INT) AS num_answers FROM mc GROUP BY doc_id)
    SELECT CAST(doc_id AS VARCHAR) AS id, doc_id, data, CAST(length(data) AS INT) AS input_len, labels, 'multiple_choice' AS output_type, output, num_answers FROM g""",
)
def sample_export(spark, d):
    rows = mc_docs(spark, d).select(
        "doc_id", "choices", "lls", F.concat(F.lit("Q: "), "category").alias("prompt"), F.col("gold").cast("string").alias("target")
    )
    return Y.sample_export(rows, "multiple_choice")


@query(
    "sample_export_loglikelihood",
    f"""WITH {MC_SQL} SELECT CAST(doc_id AS VARCHAR) AS id, doc_id, category AS data, CAST(length(category) AS INT) AS input_len, choice AS labels, 'loglikelihood' AS output_type,
    CASE WHEN is_greedy THEN 'correct' ELSE 'incorrect' END AS output FROM mc""",
)
def sample_export_loglikelihood(spark, d):
    rows = mc(spark, d).select("doc_id", F.col("category").alias("prompt"), F.lit("").alias("target"), F.col("choice").alias("continuation"), "is_greedy")
    return Y.sample_export(rows, "loglikelihood")


@query(
    "sample_export_generation",
    f"""WITH {MESSAGES_SQL} SELECT concat(CAST(id AS VARCHAR), '.none') AS id, id AS doc_id, question AS data, CAST(length(question) AS INT) AS input_len, coalesce(source, '') AS labels,
    'generate_until' AS output_type, lower(response) AS output, CAST(length(response) AS INT) AS output_length FROM messages""",
)
def sample_export_generation(spark, d):
    rows = messages(spark, d).select(
        F.col("id").alias("doc_id"), F.col("question").alias("prompt"), F.coalesce("source", F.lit("")).alias("target"),
        F.array(F.lower("response")).alias("filtered_resps"),
    )
    return Y.sample_export(rows, "generate_until", "none")
