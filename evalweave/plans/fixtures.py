"""Views derived from the given tables, once as DataFrames and once as SQL CTEs.

Everything is derived row by row or by one aggregation, over whole tables and
whole texts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evalweave.operators.broadcasts import spread
from evalweave.plans.registry import table

# Whitespace class for the SQL side (the same characters as functions.text.WS).
W = r"[\t-\r\x1c-\x20\x{85}\p{Z}]"
NW = r"[^\t-\r\x1c-\x20\x{85}\p{Z}]"


def sql_words(expr: str) -> str:
    return f"list_filter(regexp_split_to_array({expr}, '{W}+'), lambda w: w <> '')"


def sql_ngrams(words: str, n: int) -> str:
    """List of n-grams of a list-of-words expression (evaluate the words in a CTE first)."""
    return (
        f"list_transform(range(1, len({words}) - {n - 2}), "
        f"lambda i: array_to_string(list_slice({words}, i, i + {n - 1}), ' '))"
    )


# --- messages: one reasoning record per conversation -------------------------

MESSAGES_SQL = """
first_user AS (SELECT conv_id, min_by(text, turn) AS q FROM conversations WHERE role = 'user' GROUP BY conv_id),
first_reply AS (SELECT conv_id, min_by(text, turn) AS r FROM conversations WHERE role = 'assistant' GROUP BY conv_id),
messages AS (
SELECT u.conv_id AS id, u.q AS question,
       CASE WHEN u.conv_id % 7 = 0 THEN a.r
            ELSE concat('<think> ', substring(a.r, 1, CAST(floor(length(a.r) / 2) AS INT)), ' </think> ',
                        substring(a.r, CAST(floor(length(a.r) / 2) AS INT) + 1, length(a.r))) END AS response,
       CAST(floor(length(a.r) / 4) AS BIGINT) AS num_tokens,
       CASE WHEN u.conv_id % 5 = 0 THEN NULL ELSE 'synthetic' END AS source
FROM first_user u JOIN first_reply a ON u.conv_id = a.conv_id)
"""


def messages(spark: SparkSession, d: str) -> DataFrame:
    """One aggregation over the turns: both first turns come from the same shuffle."""
    first = (
        table(spark, d, "conversations")
        .where(F.col("role").isin("user", "assistant"))
        .groupBy("conv_id")
        .agg(
            F.expr("min_by(text, turn) FILTER (WHERE role = 'user')").alias("question"),
            F.expr("min_by(text, turn) FILTER (WHERE role = 'assistant')").alias("r"),
        )
        .where("question IS NOT NULL AND r IS NOT NULL")
    )
    half = F.floor(F.length("r") / 2).cast("int")
    return first.select(
        F.col("conv_id").alias("id"),
        "question",
        F.when(F.col("conv_id") % 7 == 0, F.col("r"))
        .otherwise(
            F.concat(
                F.lit("<think> "), F.substring("r", F.lit(1), half), F.lit(" </think> "),
                F.substring("r", half + 1, F.length("r")),
            )
        )
        .alias("response"),
        F.floor(F.length("r") / 4).cast("bigint").alias("num_tokens"),
        F.when(F.col("conv_id") % 5 == 0, F.lit(None)).otherwise(F.lit("synthetic")).alias("source"),
    )


# --- attempts: every event is one graded attempt, 16 per problem -------------

ATTEMPTS_SQL = """
attempts AS (
SELECT problem_id, attempt_idx,
       CASE WHEN problem_id % 25 = 0 THEN NULL ELSE 800 + ((problem_id * 37) % 28) * 100 END AS rating,
       CASE problem_id % 4 WHEN 0 THEN 'dp,graphs' WHEN 1 THEN 'math' WHEN 2 THEN 'greedy,math,strings'
            ELSE 'dp' END AS tags_csv,
       CASE WHEN event_type = 'purchase' AND event_id % (1 + user_id % 9) = 0 THEN 'AC'
            WHEN event_id % 13 = 0 THEN 'MLE' WHEN event_id % 11 = 0 THEN 'CE'
            WHEN event_type = 'click' THEN 'TLE' WHEN event_type = 'signup' THEN 'RE'
            WHEN event_type = 'error' THEN 'FE' ELSE 'WA' END AS status,
       event_type AS answer, CAST(length(props) + event_id % 500 AS BIGINT) AS tokens, value
FROM (SELECT *, CAST(floor(event_id / 16) AS BIGINT) AS problem_id, event_id % 16 AS attempt_idx FROM events) e)
"""


def attempts(spark: SparkSession, d: str) -> DataFrame:
    e = F.col("event_id")
    p = F.col("problem_id")
    return (
        table(spark, d, "events")
        .withColumn("problem_id", F.floor(e / 16).cast("bigint"))
        .select(
            "problem_id",
            (e % 16).alias("attempt_idx"),
            F.when(p % 25 != 0, 800 + ((p * 37) % 28) * 100).alias("rating"),
            F.when(p % 4 == 0, "dp,graphs").when(p % 4 == 1, "math").when(p % 4 == 2, "greedy,math,strings")
            .otherwise("dp").alias("tags_csv"),
            F.when((F.col("event_type") == "purchase") & (e % (1 + F.col("user_id") % 9) == 0), "AC")
            .when(e % 13 == 0, "MLE").when(e % 11 == 0, "CE")
            .when(F.col("event_type") == "click", "TLE").when(F.col("event_type") == "signup", "RE")
            .when(F.col("event_type") == "error", "FE").otherwise("WA").alias("status"),
            F.col("event_type").alias("answer"),
            (F.length("props") + e % 500).cast("bigint").alias("tokens"),
            "value",
        )
    )


TESTS_SQL = ATTEMPTS_SQL + """,
tests AS (
SELECT problem_id, attempt_idx, t AS test_idx,
       CASE WHEN t = 1 + attempt_idx % 3 THEN status ELSE 'AC' END AS status
FROM (SELECT *, unnest([1, 2, 3]) AS t FROM attempts) x)
"""


def tests(spark: SparkSession, d: str) -> DataFrame:
    return (
        attempts(spark, d)
        .withColumn("test_idx", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))))
        .select(
            "problem_id",
            "attempt_idx",
            "test_idx",
            F.when(F.col("test_idx") == 1 + F.col("attempt_idx") % 3, F.col("status")).otherwise("AC").alias("status"),
        )
    )


# --- mc: multiple-choice documents, one per order, and their long form -------

MC_SQL = """
mc AS (
SELECT doc_id, CAST(idx AS INT) AS idx, CAST(n_choices AS INT) AS n_choices,
       concat(o_orderstatus, repeat('x', CAST(1 + (o_custkey + idx) % 7 AS INT)), CAST((o_custkey + idx * 31) % 1000 AS VARCHAR)) AS choice,
       -CAST((cents * (idx + 3)) % 9973 AS DOUBLE) / 1000.0 AS ll,
       -CAST((cents * (idx + 7) + o_custkey) % 7919 AS DOUBLE) / 1000.0 AS uncond_ll,
       (cents + idx) % 3 = 0 AS is_greedy, CAST(o_custkey % n_choices AS INT) AS gold, o_orderpriority AS category
FROM (SELECT *, unnest(range(n_choices)) AS idx FROM (
      SELECT o_orderkey AS doc_id, o_custkey, o_orderstatus, o_orderpriority, 2 + o_orderkey % 4 AS n_choices,
             CAST(round(o_totalprice * 100) AS BIGINT) AS cents FROM orders) o) x)
"""


def mc_docs(spark: SparkSession, d: str) -> DataFrame:
    """One row per document: choices and log-likelihoods as arrays, all derived in place."""
    o = (
        spread(table(spark, d, "orders"), "o_orderkey")
        .withColumn("cents", F.round(F.col("o_totalprice") * 100).cast("bigint"))
        .withColumn("n_choices", (2 + F.col("o_orderkey") % 4).cast("int"))
        .withColumn("i", F.sequence(F.lit(0), F.col("n_choices") - 1))
    )
    cents, cust = F.col("cents"), F.col("o_custkey")
    return o.select(
        F.col("o_orderkey").alias("doc_id"),
        "n_choices",
        F.transform(
            "i",
            lambda i: F.concat(
                F.col("o_orderstatus"),
                F.repeat(F.lit("x"), (1 + (cust + i) % 7).cast("int")),
                ((cust + i * 31) % 1000).cast("string"),
            ),
        ).alias("choices"),
        F.transform("i", lambda i: -((cents * (i + 3)) % 9973).cast("double") / 1000.0).alias("lls"),
        F.transform("i", lambda i: -((cents * (i + 7) + cust) % 7919).cast("double") / 1000.0).alias("uncond_lls"),
        F.transform("i", lambda i: (cents + i) % 3 == 0).alias("greedy"),
        (cust % F.col("n_choices")).cast("int").alias("gold"),
        F.col("o_orderpriority").alias("category"),
    )


def mc(spark: SparkSession, d: str) -> DataFrame:
    z = F.arrays_zip("choices", "lls", "uncond_lls", "greedy")
    return (
        mc_docs(spark, d)
        .select("doc_id", "n_choices", "gold", "category", F.posexplode(z).alias("idx", "z"))
        .select(
            "doc_id", "idx", "n_choices", F.col("z.choices").alias("choice"), F.col("z.lls").alias("ll"),
            F.col("z.uncond_lls").alias("uncond_ll"), F.col("z.greedy").alias("is_greedy"), "gold", "category",
        )
    )


# --- rolling: document log-likelihoods ---------------------------------------

ROLLING_SQL = """
rolling AS (SELECT doc_id, lang AS task, -CAST(length(text) * 0.5 + doc_id % 10 AS DOUBLE) AS ll, text FROM documents)
"""


def rolling(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select(
        "doc_id", F.col("lang").alias("task"),
        (-(F.length("text") * F.lit(0.5) + F.col("doc_id") % 10)).cast("double").alias("ll"), "text",
    )


# --- pairs: prediction and reference texts -----------------------------------

PAIRS_SQL = """
pairs AS (
SELECT conv_id * 100 + turn AS doc_id, role AS task, text AS gold,
       CASE turn % 3 WHEN 0 THEN lower(text) WHEN 1 THEN substring(text, 20, length(text))
                     ELSE replace(text, ' ', '  ') END AS pred,
       CASE WHEN length(text) < 200 THEN 4096 ELSE 8192 END AS max_length
FROM conversations)
"""


def pairs(spark: SparkSession, d: str) -> DataFrame:
    text = F.col("text")
    return spread(table(spark, d, "conversations"), "conv_id", "turn").select(
        (F.col("conv_id") * 100 + F.col("turn")).alias("doc_id"),
        F.col("role").alias("task"),
        text.alias("gold"),
        F.when(F.col("turn") % 3 == 0, F.lower(text))
        .when(F.col("turn") % 3 == 1, F.substring(text, F.lit(20), F.length(text)))
        .otherwise(F.replace(text, F.lit(" "), F.lit("  ")))
        .alias("pred"),
        F.when(F.length(text) < 200, 4096).otherwise(8192).alias("max_length"),
    )


# --- scored: per-sample metric values, and their task table ------------------

SCORED_SQL = """
scored AS (
SELECT d.doc_id, d.source AS task, concat('g', CAST(CAST(substring(d.source, 4, length(d.source)) AS INT) % 3 AS VARCHAR)) AS grp,
       CAST(l.quality AS DOUBLE) AS value, l.quality AS gold,
       CASE WHEN d.doc_id % 4 = 0 THEN 1 - l.quality ELSE l.quality END AS pred
FROM documents d JOIN labels l ON d.doc_id = l.doc_id)
"""


def scored(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "source")
    return docs.join(table(spark, d, "labels"), "doc_id").select(
        "doc_id",
        F.col("source").alias("task"),
        F.concat(F.lit("g"), (F.expr("substring(source, 4)").cast("int") % 3).cast("string")).alias("grp"),
        F.col("quality").cast("double").alias("value"),
        F.col("quality").alias("gold"),
        F.when(F.col("doc_id") % 4 == 0, 1 - F.col("quality")).otherwise(F.col("quality")).alias("pred"),
    )


TASKS_SQL = SCORED_SQL + """,
tasks AS (
SELECT grp, task, count(*) AS n, avg(value) AS mean, stddev_samp(value) / sqrt(count(*)) AS stderr
FROM scored GROUP BY grp, task)
"""


def tasks(spark: SparkSession, d: str) -> DataFrame:
    return scored(spark, d).groupBy("grp", "task").agg(
        F.count(F.lit(1)).alias("n"),
        F.avg("value").alias("mean"),
        (F.stddev_samp("value") / F.sqrt(F.count(F.lit(1)))).alias("stderr"),
    )
