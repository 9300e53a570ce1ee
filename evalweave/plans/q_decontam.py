"""Corpus reading, normalisation and decontamination queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from evalweave.functions import text as T
from evalweave.operators import decontam as D
from evalweave.plans.fixtures import NW, SCORED_SQL, W, scored, sql_ngrams, sql_words
from evalweave.plans.registry import query, table

N = 13
PUNCT = r"""!"#$%&''()*+,-./:;<=>?@[\]^_`{|}~"""
FOLD = (
    "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ" + PUNCT + "', 'abcdefghijklmnopqrstuvwxyz')"
)

# SQL building blocks: distinct (id, n-gram) rows of both sides.
INDEX = f"""
train_words AS (SELECT doc_id, {sql_words('lower(text)')} AS w FROM documents),
test_words AS (SELECT item_id, {sql_words('lower(text)')} AS w FROM benchmark),
train_index AS (SELECT DISTINCT doc_id, ngram FROM (SELECT doc_id, unnest({sql_ngrams('w', N)}) AS ngram FROM train_words) a),
test_index AS (SELECT DISTINCT item_id, ngram FROM (SELECT item_id, unnest({sql_ngrams('w', N)}) AS ngram FROM test_words) b)
"""
FOLDED = f"""
train_words AS (SELECT doc_id, {sql_words(FOLD)} AS w FROM documents),
test_words AS (SELECT item_id, {sql_words(FOLD)} AS w FROM benchmark),
train_index AS (SELECT DISTINCT doc_id, ngram FROM (SELECT doc_id, unnest({sql_ngrams('w', N)}) AS ngram FROM train_words) a),
test_index AS (SELECT DISTINCT item_id, ngram FROM (SELECT item_id, unnest({sql_ngrams('w', N)}) AS ngram FROM test_words) b)
"""
DIRTY = "SELECT DISTINCT doc_id FROM train_index WHERE ngram IN (SELECT ngram FROM test_index)"


def docs(spark, d):
    return table(spark, d, "documents")


def bench(spark, d):
    return table(spark, d, "benchmark")


@query("normalize_text", f"SELECT doc_id, trim(regexp_replace(lower(text), '{W}+', ' ', 'g'), ' ') AS norm FROM documents")
def normalize_text(spark, d):
    return docs(spark, d).select("doc_id", T.normalize_text(F.col("text")).alias("norm"))


@query("word_ngrams", f"WITH {INDEX} SELECT item_id, unnest({sql_ngrams('w', N)}) AS ngram FROM test_words")
def word_ngrams(spark, d):
    return bench(spark, d).select("item_id", F.explode(T.ngrams(T.words(F.lower("text")), N)).alias("ngram"))


@query("build_ngram_index", f"WITH {INDEX} SELECT ngram, item_id FROM test_index")
def build_ngram_index(spark, d):
    return D.build_ngram_index(bench(spark, d), "item_id", F.col("text"), N)


def contaminated(spark, d, **kw):
    return D.find_contaminated(docs(spark, d), bench(spark, d), "doc_id", F.col("text"), F.col("text"), N, **kw)


@query("find_contaminated", f"WITH {INDEX} {DIRTY}")
def find_contaminated(spark, d):
    return contaminated(spark, d)


@query("decontaminate", f"WITH {INDEX} SELECT * FROM documents WHERE doc_id NOT IN ({DIRTY})")
def decontaminate(spark, d):
    return D.decontaminate(docs(spark, d), contaminated(spark, d), "doc_id")


ORACLES_OVERLAP = f"""WITH {INDEX},
    a AS (SELECT ngram, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY item_id) AS test_doc_ids FROM test_index GROUP BY ngram),
    b AS (SELECT ngram, string_agg(CAST(doc_id AS VARCHAR), ',' ORDER BY doc_id) AS train_doc_ids FROM train_index
          WHERE ngram IN (SELECT ngram FROM test_index) GROUP BY ngram)
    SELECT a.ngram, CAST(0 AS BIGINT) AS part, test_doc_ids, train_doc_ids FROM a JOIN b ON a.ngram = b.ngram"""


@query("overlap_report", ORACLES_OVERLAP)
def overlap_report(spark, d):
    rows = D.overlap_report(
        docs(spark, d), bench(spark, d), "doc_id", F.col("text"), "item_id", F.col("text"), N
    )
    return rows.select(
        "ngram", "part", F.array_join("test_doc_ids", ",").alias("test_doc_ids"),
        F.array_join("train_doc_ids", ",").alias("train_doc_ids"),
    )


@query(
    "contamination_summary",
    f"""WITH {INDEX}, hits AS (SELECT doc_id, ngram FROM train_index WHERE ngram IN (SELECT ngram FROM test_index))
    SELECT (SELECT count(*) FROM documents) AS original_rows, count(DISTINCT doc_id) AS contaminated_rows,
           count(DISTINCT ngram) AS matched_ngrams FROM hits""",
)
def contamination_summary(spark, d):
    return D.contamination_summary(
        docs(spark, d), bench(spark, d), "doc_id", F.col("text"), "item_id", F.col("text"), N
    )


@query("janitor_normalize", f"SELECT doc_id, {FOLD} AS folded FROM documents")
def janitor_normalize(spark, d):
    return docs(spark, d).select("doc_id", T.ascii_fold(F.col("text")).alias("folded"))


@query(
    "ngram_spans",
    f"""WITH p AS (SELECT doc_id, regexp_extract_all(text, '{W}*{NW}+') AS parts FROM documents),
    x AS (SELECT doc_id, unnest(parts) AS part, generate_subscripts(parts, 1) AS k FROM p),
    y AS (SELECT doc_id, k, regexp_replace(part, '^{W}+', '') AS tok,
                 sum(length(part)) OVER (PARTITION BY doc_id ORDER BY k ROWS UNBOUNDED PRECEDING) AS e FROM x),
    z AS (SELECT doc_id, k, e - length(tok) AS s,
                 lead(e, {N - 1}) OVER (PARTITION BY doc_id ORDER BY k) AS last_end,
                 array_agg(tok) OVER (PARTITION BY doc_id ORDER BY k ROWS BETWEEN CURRENT ROW AND {N - 1} FOLLOWING) AS toks FROM y)
    SELECT doc_id, CAST(k - 1 AS INT) AS pos, array_to_string(toks, ' ') AS ngram, CAST(s AS BIGINT) AS start,
           CAST(last_end - 1 AS BIGINT) AS "end" FROM z WHERE last_end IS NOT NULL""",
)
def ngram_spans(spark, d):
    return D.ngram_spans(docs(spark, d), "doc_id", "text", N)


# Spans of hits widened by 200 characters; fewer than 10 hits leave the parts between them, none the whole text.
JANITOR_SQL = f"""WITH {FOLDED},
dirt AS (SELECT DISTINCT unnest({sql_ngrams('w', N)}) AS ngram FROM test_words),
x AS (SELECT doc_id, unnest(parts) AS part, generate_subscripts(parts, 1) AS k FROM (SELECT doc_id, regexp_extract_all(text, '{W}*{NW}+') AS parts FROM documents)),
y AS (SELECT doc_id, k, regexp_replace(part, '^{W}+', '') AS text, sum(length(part)) OVER (PARTITION BY doc_id ORDER BY k ROWS UNBOUNDED PRECEDING) AS e FROM x),
z AS (SELECT doc_id, k, e - length(text) AS s, lead(e, {N - 1}) OVER (PARTITION BY doc_id ORDER BY k) AS last_end,
  array_to_string(array_agg({FOLD}) OVER (PARTITION BY doc_id ORDER BY k ROWS BETWEEN CURRENT ROW AND {N - 1} FOLLOWING), ' ') AS ngram FROM y),
hit AS (SELECT doc_id, text, k, CAST(greatest(0, s - 200) AS BIGINT) AS s, CAST(least(length(text), last_end - 1 + 200) AS BIGINT) AS e, count(*) OVER (PARTITION BY doc_id) AS n
  FROM z JOIN dirt USING (ngram) JOIN documents USING (doc_id) WHERE last_end IS NOT NULL),
few AS (SELECT *, coalesce(lag(e) OVER (PARTITION BY doc_id ORDER BY k), 0) AS f, lead(e) OVER (PARTITION BY doc_id ORDER BY k) AS next FROM hit WHERE n < 10),
c AS (SELECT doc_id, 2 * k AS k, substring(text, f + 1, s - f) AS chunk FROM few WHERE s - f > 200
  UNION ALL SELECT doc_id, 2 * k + 1, substring(text, e + 2, length(text)) FROM few WHERE next IS NULL AND e < length(text) - 200
  UNION ALL SELECT doc_id, 0, text FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM hit) AND length(text) > 199)
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY k) - 1 AS INT) AS chunk_idx, chunk FROM c"""


@query("janitor_clean", JANITOR_SQL)
def janitor_clean(spark, d):
    return D.janitor_clean(docs(spark, d), "doc_id", "text", bench(spark, d), F.col("text"))


@query(
    "ngram_doc_frequency",
    f"""WITH train_words AS (SELECT doc_id, {sql_words(FOLD)} AS w FROM documents),
    g AS (SELECT DISTINCT doc_id, ngram FROM (SELECT doc_id, unnest({sql_ngrams('w', 5)}) AS ngram FROM train_words) a)
    SELECT ngram, count(*) AS n_docs FROM g GROUP BY ngram HAVING count(*) > 10""",
)
def ngram_doc_frequency(spark, d):
    return D.ngram_doc_frequency(docs(spark, d), "doc_id", F.col("text"), 5, 10)


TASK_INDEX = FOLDED + """,
tagged AS (SELECT concat('task', CAST(item_id % 3 AS VARCHAR)) AS task,
                  CASE WHEN item_id % 2 = 0 THEN 'test' ELSE 'validation' END AS set_name, item_id, ngram FROM test_index),
flagged AS (SELECT t.*, t.ngram IN (SELECT ngram FROM train_index) AS hit FROM tagged t)
"""


def _tasks(spark, d):
    return bench(spark, d).select(
        F.concat(F.lit("task"), (F.col("item_id") % 3).cast("string")).alias("task"),
        F.when(F.col("item_id") % 2 == 0, "test").otherwise("validation").alias("set"),
        F.col("item_id").alias("doc_id"),
        "text",
    )


@query(
    "train_overlap",
    f"""WITH {TASK_INDEX} SELECT task, set_name, count(DISTINCT CASE WHEN hit THEN item_id END) AS dirty_docs,
    count(DISTINCT CASE WHEN hit THEN ngram END) AS matching, count(DISTINCT CASE WHEN NOT hit THEN ngram END) AS non_matching
    FROM flagged GROUP BY task, set_name""",
)
def train_overlap(spark, d):
    dirty, counts = D.train_overlap(docs(spark, d), "doc_id", F.col("text"), _tasks(spark, d), F.col("text"), N)
    per_set = dirty.groupBy("task", "set").agg(F.count(F.lit(1)).alias("dirty_docs"))
    return counts.join(per_set, ["task", "set"], "left").select(
        "task", F.col("set").alias("set_name"), F.coalesce("dirty_docs", F.lit(0)).cast("bigint").alias("dirty_docs"),
        "matching", "non_matching",
    )


@query(
    "train_ngram_counts",
    f"""WITH {FOLDED}, g AS (SELECT unnest({sql_ngrams('w', N)}) AS ngram FROM train_words)
    SELECT count(*) AS total_ngrams, count(DISTINCT ngram) AS unique_ngrams FROM g""",
)
def train_ngram_counts(spark, d):
    return D.corpus_unique_counts(docs(spark, d), "doc_id", F.col("text"), N)


@query(
    "decontamination_query",
    "SELECT item_id, concat('Q: ', text, chr(10), 'A:') AS query FROM benchmark",
)
def decontamination_query(spark, d):
    from evalweave.operators.prompts import decontamination_query as chosen

    b = bench(spark, d)
    return b.select("item_id", chosen(b, "Q: {{text}}\nA:", prompt="text").alias("query"))


@query(
    "decontaminated_metric",
    f"""WITH {SCORED_SQL}, {INDEX}, f AS (SELECT s.*, s.doc_id IN ({DIRTY}) AS dirty FROM scored s)
    SELECT task, 'value' AS metric, round(avg(value), 6) AS value, count(*) AS n FROM f GROUP BY task
    UNION ALL
    SELECT task, 'value_decontaminate', round(avg(CASE WHEN NOT dirty THEN value END), 6), count(CASE WHEN NOT dirty THEN 1 END)
    FROM f GROUP BY task""",
)
def decontaminated_metric(spark, d):
    rows = D.decontaminated_metric(scored(spark, d), contaminated(spark, d), "doc_id", ["task"], "value")
    return rows.withColumn("value", F.round("value", 6))


@query(
    "corpus_stats",
    """WITH s AS (SELECT source, count(*) AS n_docs, CAST(sum(length(text)) AS BIGINT) AS n_chars FROM documents GROUP BY source)
    SELECT source, n_docs, n_chars, CAST(coalesce(sum(n_docs) OVER (ORDER BY source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT)
    AS start_offset FROM s""",
)
def corpus_stats(spark, d):
    return D.corpus_stats(docs(spark, d), "source", "text")
