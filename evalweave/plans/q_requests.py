"""Request-table and response-filter queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from evalweave.functions import answers as A
from evalweave.functions import mathnorm as M
from evalweave.functions import text as T
from evalweave.functions.arrays import let
from evalweave.operators import filters as R
from evalweave.operators import requests as Q
from evalweave.plans.fixtures import (
    ATTEMPTS_SQL, MC_SQL, MESSAGES_SQL, PAIRS_SQL, W, attempts, mc, mc_docs, messages, pairs, sql_words,
)
from evalweave.plans.q_curate import ANSWER, TRACE, q, strip_sql
from evalweave.plans.registry import query, table


def docs(spark, d):
    return table(spark, d, "documents")


@query(
    "build_mc_requests",
    f"""WITH {MC_SQL} SELECT doc_id, idx, 'loglikelihood' AS request_type, conditional,
    CASE WHEN conditional THEN concat('Q: ', category) ELSE '' END AS context, concat(' ', choice) AS continuation
    FROM (SELECT *, unnest([true, false]) AS conditional FROM mc) x""",
)
def build_mc_requests(spark, d):
    return Q.build_mc_requests(
        mc_docs(spark, d), F.concat(F.lit("Q: "), "category"), "choices", unconditional=True
    )


@query(
    "group_responses",
    f"""WITH {MC_SQL} SELECT doc_id, string_agg(concat(CAST(idx AS VARCHAR), ':', choice), ',' ORDER BY idx) AS resps, count(*) AS n FROM mc GROUP BY doc_id""",
)
def group_responses(spark, d):
    g = Q.group_responses(mc(spark, d), "doc_id", "idx", ["choice"])
    return g.select(
        "doc_id",
        F.array_join(F.transform("resps", lambda r: F.concat(r["idx"].cast("string"), F.lit(":"), r["choice"])), ",").alias("resps"),
        F.size("resps").cast("bigint").alias("n"),
    )


@query(
    "length_bucket_batches",
    """WITH x AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY length(text) DESC, doc_id) - 1 AS rank FROM documents)
    SELECT doc_id, lang, rank, CAST(floor(rank / 16) AS BIGINT) AS batch FROM x""",
)
def length_bucket_batches(spark, d):
    rows = docs(spark, d).select("doc_id", "lang", F.length("text").alias("len"))
    return Q.length_bucket_batches(rows, ["lang"], F.col("len"), "doc_id", 16).drop("len")


@query(
    "group_by_context",
    f"""WITH {MC_SQL}, r AS (SELECT doc_id, idx, o_context, choice FROM (SELECT *, concat('Q: ', category, ' n', CAST(n_choices AS VARCHAR)) AS o_context FROM mc) y),
    k AS (SELECT *, array_to_string(list_slice(w, 1, len(w) - 1), ' ') AS key FROM (SELECT *, {sql_words("concat(o_context, ' ', choice)")} AS w FROM r) z),
    g AS (SELECT key, min(doc_id * 10 + idx) AS rep, count(*) AS group_size FROM k GROUP BY key)
    SELECT doc_id, idx, sha256(key) AS context_key, CAST(rep // 10 AS BIGINT) AS scored_doc, CAST(rep % 10 AS INT) AS scored_idx, group_size FROM k JOIN g USING (key)""",
)
def group_by_context(spark, d):
    r = mc(spark, d).select(
        "doc_id", "idx", F.concat(F.lit("Q: "), "category", F.lit(" n"), F.col("n_choices").cast("string"), F.lit(" "), "choice").alias("full")
    )
    g = Q.group_by_context(r, T.words(F.col("full")), ["doc_id", "idx"])
    return g.select(
        "doc_id", "idx", "context_key", F.col("scored.doc_id").alias("scored_doc"), F.col("scored.idx").alias("scored_idx"), "group_size"
    )


@query("restore_order", "SELECT doc_id, length(text) AS len FROM documents ORDER BY doc_id")
def restore_order(spark, d):
    shuffled = docs(spark, d).select("doc_id", F.length("text").cast("bigint").alias("len")).orderBy(F.desc("len"))
    return Q.restore_order(shuffled, docs(spark, d), "doc_id")


MAXL, CTX = 64, 17
STEP = MAXL - CTX + 1
WINDOWS = f"""w AS (SELECT doc_id, {sql_words('text')} AS t FROM documents),
n AS (SELECT doc_id, t, len(t) AS n, least({MAXL}, len(t)) AS f FROM w WHERE len(t) > 0),
k AS (SELECT *, unnest(range(1 + CAST(ceil(greatest(n - {MAXL}, 0) / {STEP}.0) AS BIGINT))) AS k FROM n),
b AS (SELECT *, CASE WHEN k = 0 THEN 0 ELSE f + (k - 1) * {STEP} END AS s FROM k),
e AS (SELECT *, CASE WHEN k = 0 THEN f ELSE least(n, s + {STEP}) END AS e FROM b),
win AS (SELECT doc_id, CAST(k AS INT) AS "window",
  CASE WHEN k = 0 THEN list_prepend('<s>', list_slice(t, 1, f - 1)) ELSE list_slice(t, e - {MAXL}, e - 1) END AS inp,
  list_slice(t, s + 1, e) AS pred FROM e)"""


def _windows(spark, d):
    return Q.rolling_token_windows(docs(spark, d), "doc_id", T.words(F.col("text")), "<s>", MAXL, CTX)


@query(
    "rolling_token_windows",
    f"""WITH {WINDOWS} SELECT doc_id, "window", array_to_string(inp, ' ') AS input, array_to_string(pred, ' ') AS predict FROM win""",
)
def rolling_token_windows(spark, d):
    return _windows(spark, d).select(
        "doc_id", "window", F.array_join("input", " ").alias("input"), F.array_join("predict", " ").alias("predict")
    )


@query(
    "disjoint_windows",
    f"""WITH {WINDOWS} SELECT doc_id, "window", array_to_string(list_slice(inp, 1, len(inp) - (len(pred) - 1)), ' ') AS context, array_to_string(pred, ' ') AS predict FROM win""",
)
def disjoint_windows(spark, d):
    return _windows(spark, d).select(
        "doc_id", "window", F.array_join(Q.disjoint_context(F.col("input"), F.col("predict")), " ").alias("context"),
        F.array_join("predict", " ").alias("predict"),
    )


@query(
    "response_cache_join",
    f"""WITH {MC_SQL}, c AS (SELECT DISTINCT choice, concat('r:', choice) AS response FROM mc WHERE is_greedy)
    SELECT doc_id, idx, CASE WHEN category = '5-LOW' THEN NULL ELSE c.response END AS response,
    CASE WHEN category = '5-LOW' THEN 'sampled' WHEN c.choice IS NULL THEN 'miss' ELSE 'cache' END AS source
    FROM mc LEFT JOIN c ON mc.choice = c.choice""",
)
def response_cache_join(spark, d):
    r = mc(spark, d)
    key = Q.request_key(F.lit("loglikelihood"), F.col("choice"))
    cache = r.where("is_greedy").select(key.alias("cache_key"), F.concat(F.lit("r:"), "choice").alias("response")).distinct()
    return Q.response_cache_join(r, cache, key, F.col("category") == "5-LOW").select("doc_id", "idx", "response", "source")


HASHED = """s AS (SELECT doc_id, lang AS task, sha256(text) AS doc_hash, sha256(concat('Read: ', text)) AS prompt_hash, sha256(source) AS target_hash FROM documents)"""


def _hashed(spark, d):
    return docs(spark, d).select(
        "doc_id", F.col("lang").alias("task"), *Q.sample_hashes(F.col("text"), F.concat(F.lit("Read: "), "text"), F.col("source"))
    )


@query("request_hashes", f"WITH {HASHED} SELECT * FROM s")
def request_hashes(spark, d):
    return _hashed(spark, d)


@query(
    "task_hashes",
    f"""WITH {HASHED}, n AS (SELECT *, (row_number() OVER (PARTITION BY task ORDER BY doc_id) - 1) // 100 AS part FROM s),
    p AS (SELECT task, part, sha256(string_agg(concat(doc_hash, prompt_hash, target_hash), '' ORDER BY doc_id)) AS h FROM n GROUP BY task, part)
    SELECT task, sha256(string_agg(h, '' ORDER BY part)) AS task_hash FROM p GROUP BY task""",
)
def task_hashes(spark, d):
    return Q.task_hashes(_hashed(spark, d), "task", "doc_id", part_size=100)


@query(
    "token_cost_estimate",
    f"""WITH t AS (SELECT lang AS task, CAST(sum(len({sql_words('text')}) + CASE doc_id % 3 WHEN 0 THEN 0 WHEN 1 THEN 256 ELSE 2048 END) AS BIGINT) AS tokens
    FROM documents GROUP BY lang), u AS (SELECT * FROM t UNION ALL SELECT '**Total**', CAST(sum(tokens) AS BIGINT) FROM t)
    SELECT task, tokens, round(tokens / 1000 * 0.0008, 6) AS ada, round(tokens / 1000 * 0.0012, 6) AS babbage, round(tokens / 1000 * 0.006, 6) AS curie,
    round(tokens / 1000 * 0.06, 6) AS davinci FROM u""",
)
def token_cost_estimate(spark, d):
    kind = F.when(F.col("doc_id") % 3 == 0, "loglikelihood").when(F.col("doc_id") % 3 == 1, "generate_until").otherwise("loglikelihood_rolling")
    rows = docs(spark, d).select(F.col("lang").alias("task"), kind.alias("kind"), Q.count_words(F.col("text")).alias("n"))
    costs = Q.token_cost_estimate(rows, "task", "kind", F.col("n"))
    return costs.select("task", "tokens", *[F.round(p, 6).alias(p) for p in Q.PRICES])


@query(
    "tokenize_corpus",
    "SELECT doc_id, CAST(octet_length(encode(text)) AS BIGINT) AS n_tokens, CAST(octet_length(encode(text)) AS BIGINT) AS n_mask FROM documents",
)
def tokenize_corpus(spark, d):
    rows = Q.tokenize_corpus(docs(spark, d), "doc_id", "text", Q.byte_tokenizer())
    return rows.select(
        "doc_id", F.size("input_ids").cast("bigint").alias("n_tokens"),
        F.aggregate("attention_mask", F.lit(0).cast("bigint"), lambda a, x: a + x).alias("n_mask"),
    )


@query(
    "completion_only_labels",
    f"""WITH w AS (SELECT conv_id, turn, role, {sql_words('text')} AS w FROM conversations),
    x AS (SELECT conv_id, turn, role, unnest(w) AS t, generate_subscripts(w, 1) AS i FROM w)
    SELECT conv_id, string_agg(CASE WHEN role = 'assistant' THEN CAST(length(t) AS VARCHAR) ELSE '-100' END, ' ' ORDER BY turn, i) AS labels FROM x GROUP BY conv_id""",
)
def completion_only_labels(spark, d):
    ids = F.transform(T.words(F.col("text")), lambda x: F.length(x))
    nested = (
        table(spark, d, "conversations")
        .select("conv_id", "turn", "role", ids.alias("ids"))
        .groupBy("conv_id")
        .agg(F.sort_array(F.collect_list(F.struct("turn", "role", "ids"))).alias("turns"))
    )
    labels = Q.completion_only_labels(F.col("turns"))
    return nested.select("conv_id", F.array_join(labels.cast("array<string>"), " ").alias("labels"))


# --- response filters --------------------------------------------------------


@query(
    "regex_extract_nth",
    r"""WITH m AS (SELECT doc_id, regexp_extract_all(text, '([A-Z][a-z]+)[,.]', 1) AS m, regexp_extract_all(text, 'the ([a-z]+)|an ([a-z]+)') AS g FROM documents)
    SELECT doc_id, coalesce(m[3], '[invalid]') AS third, coalesce(m[-1], '[invalid]') AS last,
    coalesce(regexp_extract(g[1], '(the|an) ([a-z]+)', 2), '[invalid]') AS grouped FROM m""",
)
def regex_extract_nth(spark, d):
    x = F.col("text")
    return docs(spark, d).select(
        "doc_id",
        A.regex_extract_nth(x, "([A-Z][a-z]+)[,.]", 2).alias("third"),
        A.regex_extract_nth(x, "([A-Z][a-z]+)[,.]", -1).alias("last"),
        A.regex_extract_nth(x, "the ([a-z]+)|an ([a-z]+)", 0).alias("grouped"),
    )


@query(
    "strip_leading_ws",
    f"SELECT doc_id, regexp_replace(concat(chr(9), '  ', chr(10), text), '^{W}+', '') AS response FROM documents",
)
def strip_leading_ws(spark, d):
    rows = docs(spark, d).select("doc_id", F.concat(F.lit("\t  \n"), "text").alias("response"))
    return rows.transform(R.strip_leading_ws())


def _with_response(spark, d):
    """Two mentions of letters in the first form: another option before the gold one, or after it for odd multiples of four."""
    g = F.col("gold")
    letter, other = F.char(g + 65), F.char((g + 1) % F.col("n_choices") + 65)
    pick, flip = F.col("doc_id") % 4, F.col("doc_id") % 8 == 4
    first, last = F.when(flip, letter).otherwise(other), F.when(flip, other).otherwise(letter)
    resp = (
        F.when(pick == 0, F.concat(F.lit("I pick ("), first, F.lit("), no, wait ("), last, F.lit(").")))
        .when(pick == 1, F.concat(F.lit("It must be "), F.get("choices", g), F.lit(" surely, as I said")))
        .when(pick == 2, F.concat(F.lit("Answer: "), letter))
        .otherwise("no idea at all")
    )
    return mc_docs(spark, d).withColumn("response", resp)


MC_RESP = f"""{MC_SQL}, r AS (SELECT doc_id, max(gold) AS gold, string_agg(choice, '|' ORDER BY idx) AS all_choices, array_agg(choice ORDER BY idx) AS c FROM mc GROUP BY doc_id)"""


# The letters of the first form, in the order of mention.
MENTIONED = """m AS (SELECT *, CASE WHEN doc_id % 4 <> 0 THEN NULL WHEN doc_id % 8 = 4 THEN [gold, (gold + 1) % len(c)] ELSE [(gold + 1) % len(c), gold] END AS said FROM r)"""


@query(
    "multi_choice_extract",
    f"""WITH {MC_RESP}, {MENTIONED}, t AS (SELECT *, concat('(', chr(CAST(64 + len(c) - list_position(list_reverse(c), c[gold + 1]) + 1 AS INT)), ')') AS by_text,
      concat('(', chr(CAST(65 + gold AS INT)), ')') AS colon FROM m)
    SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN concat('(', chr(CAST(65 + said[1] AS INT)), ')') WHEN 1 THEN by_text WHEN 2 THEN colon ELSE '[invalid]' END AS answer,
    CASE doc_id % 4 WHEN 0 THEN concat('(', chr(CAST(65 + said[2] AS INT)), ')') WHEN 1 THEN by_text WHEN 2 THEN colon ELSE 'none' END AS last_answer,
    CASE doc_id % 4 WHEN 0 THEN concat('(', chr(CAST(65 + said[1] AS INT)), ')') WHEN 1 THEN by_text WHEN 2 THEN colon ELSE '[invalid]' END AS lenient FROM t""",
)
def multi_choice_extract(spark, d):
    rows = _with_response(spark, d)
    # Upper case and punctuation inside the response matter only without the two flags.
    shouted = F.when(F.col("doc_id") % 4 == 1, F.regexp_replace(F.upper("response"), "([0-9])", "$1,")).otherwise(F.col("response"))
    letters = r"(\([A-Z]\))"
    return rows.select(
        "doc_id",
        A.multi_choice_extract(F.col("response"), F.col("choices"), letters).alias("answer"),
        A.multi_choice_extract(F.col("response"), F.col("choices"), letters, -1, "none").alias("last_answer"),
        A.multi_choice_extract(shouted, F.col("choices"), letters, ignore_case=True, ignore_punctuation=True).alias("lenient"),
    )


@query(
    "parse_choice_lenient",
    f"""WITH {MC_RESP}, {MENTIONED} SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN chr(CAST(65 + said[2] AS INT)) WHEN 3 THEN NULL ELSE chr(CAST(65 + gold AS INT)) END AS letter FROM m""",
)
def parse_choice_lenient(spark, d):
    return _with_response(spark, d).select(
        "doc_id", A.parse_choice_lenient(F.col("response"), F.col("choices")).alias("letter")
    )


def _responses(spark, d):
    return attempts(spark, d).select(
        F.col("problem_id").alias("doc_id"), F.col("attempt_idx").alias("idx"), F.col("answer").alias("response")
    )


A_SQL = f"WITH {ATTEMPTS_SQL}"


@query("take_first", f"{A_SQL} SELECT problem_id AS doc_id, attempt_idx AS idx, answer AS response FROM attempts WHERE attempt_idx = 0")
def take_first(spark, d):
    return _responses(spark, d).transform(R.take_first())


@query("take_first_k", f"{A_SQL} SELECT problem_id AS doc_id, attempt_idx AS idx, answer AS response FROM attempts WHERE attempt_idx < 4")
def take_first_k(spark, d):
    return _responses(spark, d).transform(R.take_first_k(4))


VOTE = """v AS (SELECT doc_id, response, count(*) AS n, min(idx) AS f FROM r GROUP BY doc_id, response),
win AS (SELECT doc_id, response, n AS votes FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, f) AS rn FROM v) y WHERE rn = 1)"""


@query(
    "majority_vote",
    f"{A_SQL}, r AS (SELECT problem_id AS doc_id, attempt_idx AS idx, answer AS response FROM attempts), {VOTE} SELECT * FROM win",
)
def majority_vote(spark, d):
    return _responses(spark, d).transform(R.majority_vote())


@query(
    "majority_at_k",
    f"""{A_SQL}, r AS (SELECT problem_id AS doc_id, attempt_idx AS idx, substring(answer, 1, 1) AS response FROM attempts WHERE attempt_idx < 8), {VOTE}
    SELECT * FROM win""",
)
def majority_at_k(spark, d):
    steps = R.majority_at_k(8, R.regex("^([a-z])"))
    return R.filter_chain(_responses(spark, d), {"maj@8": steps}).select("doc_id", "response", "votes")


@query(
    "filter_chain",
    f"""{A_SQL}, r AS (SELECT problem_id AS doc_id, attempt_idx AS idx, answer AS response FROM attempts), {VOTE}
    SELECT doc_id, upper(response) AS response, 'first' AS filter FROM r WHERE idx = 0
    UNION ALL SELECT doc_id, response, 'vote' FROM win""",
)
def filter_chain(spark, d):
    pipelines = {"first": [R.take_first(), R.uppercase()], "vote": [R.majority_vote()]}
    return R.filter_chain(_responses(spark, d), pipelines).select("doc_id", "response", "filter")


@query("lowercase", "SELECT doc_id, lower(text) AS response FROM documents")
def lowercase(spark, d):
    return docs(spark, d).select("doc_id", F.col("text").alias("response")).transform(R.lowercase())


@query("uppercase", "SELECT event_id, upper(event_type) AS response FROM events")
def uppercase(spark, d):
    return table(spark, d, "events").select("event_id", F.col("event_type").alias("response")).transform(R.uppercase())


@query(
    "map_values",
    "SELECT event_id, CASE event_type WHEN 'click' THEN 'A' WHEN 'view' THEN 'B' ELSE 'none' END AS response FROM events",
)
def map_values(spark, d):
    rows = table(spark, d, "events").select("event_id", F.col("event_type").alias("response"))
    return rows.transform(R.map_values({"click": "A", "view": "B"}, "none"))


# Fenced code derived from every assistant turn.
CODE_SQL = """code AS (SELECT conv_id, turn, CASE turn % 4 WHEN 0 THEN text
  WHEN 1 THEN concat('Plan', chr(10), '```cpp', chr(10), text, chr(10), '```', chr(10), 'end')
  WHEN 2 THEN concat('```cpp', chr(10), 'old', chr(10), '```', chr(10), '```cpp', chr(10), text, ' ')
  ELSE concat('```cpp', text, '```', ' and ```py', chr(10), 'x') END AS response, text FROM conversations)"""


def _code(spark, d):
    t, x = F.col("turn") % 4, F.col("text")
    resp = (
        F.when(t == 0, x)
        .when(t == 1, F.concat(F.lit("Plan\n```cpp\n"), x, F.lit("\n```\nend")))
        .when(t == 2, F.concat(F.lit("```cpp\nold\n```\n```cpp\n"), x, F.lit(" ")))
        .otherwise(F.concat(F.lit("```cpp"), x, F.lit("``` and ```py\nx")))
    )
    return table(spark, d, "conversations").select("conv_id", "turn", "role", "text", resp.alias("response"))


@query(
    "extract_code_block",
    f"WITH {CODE_SQL} SELECT conv_id, turn, CASE WHEN turn % 4 = 0 THEN NULL ELSE {strip_sql('text')} END AS code FROM code",
)
def extract_code_block(spark, d):
    return _code(spark, d).select("conv_id", "turn", A.extract_code_block(F.col("response")).alias("code"))


@query(
    "complete_code",
    f"""WITH {CODE_SQL}, p AS (SELECT *, length(response) - length(list_last(string_split(response, '```'))) - 3 AS n FROM code)
    SELECT conv_id, turn, concat('def f():', chr(10), CASE WHEN contains(response, '```') THEN substring(response, 1, n) ELSE response END) AS program FROM p""",
)
def complete_code(spark, d):
    return _code(spark, d).select("conv_id", "turn", A.complete_code(F.lit("def f():\n"), F.col("response")).alias("program"))


# TeX answers derived from every order line.
TEX_SQL = r"""tex AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE l_partkey % 6
  WHEN 0 THEN concat('So \boxed{\frac{', CAST(l_partkey AS VARCHAR), '}{', CAST(l_suppkey AS VARCHAR), '}} is it')
  WHEN 1 THEN concat('Thus \boxed{', CAST(l_partkey AS VARCHAR), '} no, \boxed{x_{', CAST(l_suppkey AS VARCHAR), '}}.')
  WHEN 2 THEN concat('\boxed ', CAST(l_partkey AS VARCHAR), '$ done') WHEN 3 THEN concat('\fbox{', CAST(l_suppkey AS VARCHAR), '}')
  WHEN 4 THEN concat('\boxed{{', CAST(l_suppkey AS VARCHAR), '}') ELSE CAST(l_partkey AS VARCHAR) END AS t FROM lineitem)"""


def _tex(spark, d):
    p, s = F.col("l_partkey").cast("string"), F.col("l_suppkey").cast("string")
    k = F.col("l_partkey") % 6
    t = (
        F.when(k == 0, F.concat(F.lit("So \\boxed{\\frac{"), p, F.lit("}{"), s, F.lit("}} is it")))
        .when(k == 1, F.concat(F.lit("Thus \\boxed{"), p, F.lit("} no, \\boxed{x_{"), s, F.lit("}}.")))
        .when(k == 2, F.concat(F.lit("\\boxed "), p, F.lit("$ done")))
        .when(k == 3, F.concat(F.lit("\\fbox{"), s, F.lit("}")))
        .when(k == 4, F.concat(F.lit("\\boxed{{"), s, F.lit("}")))
        .otherwise(p)
    )
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", t.alias("t"))


@query(
    "extract_boxed",
    rf"""WITH {TEX_SQL} SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE l_partkey % 6
    WHEN 0 THEN regexp_extract(t, '\\boxed\{{\\frac\{{\d+\}}\{{\d+\}}\}}') WHEN 1 THEN regexp_extract(t, '\\boxed\{{x_\{{\d+\}}\}}')
    WHEN 2 THEN concat('\boxed ', CAST(l_partkey AS VARCHAR)) WHEN 3 THEN t ELSE NULL END AS boxed FROM tex""",
)
def extract_boxed(spark, d):
    return _tex(spark, d).withColumn("boxed", A.extract_boxed(F.col("t"))).drop("t")


@query(
    "extract_final_answer",
    f"""SELECT conv_id, turn, CASE WHEN turn % 2 = 1 THEN coalesce({strip_sql("nullif(regexp_extract(concat('Final Answer: The final answer is ', text, '. I hope it is correct.'), 'answer is([^' || chr(10) || ']*?)\\. I hope', 1), '')")}, '[invalidanswer]')
    ELSE '[invalidanswer]' END AS answer FROM conversations""",
)
def extract_final_answer(spark, d):
    t = F.when(
        F.col("turn") % 2 == 1, F.concat(F.lit("Final Answer: The final answer is "), "text", F.lit(". "))
    ).otherwise(F.col("text"))
    return table(spark, d, "conversations").select("conv_id", "turn", A.extract_final_answer(t).alias("answer"))


@query(
    "extract_best_answer",
    """SELECT event_id, CASE WHEN event_id % 3 = 0 THEN upper(event_type) ELSE ['A','B','C','D'][CAST(user_id % 4 + 1 AS INT)] END AS answer FROM events""",
)
def extract_best_answer(spark, d):
    numeral = (F.col("user_id") % 4 + 1).cast("string")
    t = F.when(F.col("event_id") % 3 == 0, F.col("event_type")).otherwise(
        F.concat(F.lit("Hm. The best answer is ("), numeral, F.lit(").\nThanks "), "props")
    )
    return table(spark, d, "events").select(
        "event_id", A.extract_best_answer(t, ["A", "B", "C", "D"], ["1", "2", "3", "4"]).alias("answer")
    )


@query(
    "clean_control_chars",
    f"""SELECT doc_id, {strip_sql(f"regexp_replace({strip_sql('text')}, '[' || chr(1) || '-' || chr(31) || ']', chr(10), 'g')")} AS clean FROM documents""",
)
def clean_control_chars(spark, d):
    return docs(spark, d).select("doc_id", A.clean_control_chars(F.col("text")).alias("clean"))


@query(
    "normalize_math_answer",
    r"""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN l_partkey % 2 = 0 THEN concat('\frac{', CAST((l_partkey % 90 + 10) // 10 AS VARCHAR), '}{', CAST((l_partkey % 90 + 10) % 10 AS VARCHAR), '}')
    ELSE CAST(CAST(floor(l_extendedprice) AS BIGINT) AS VARCHAR) END AS answer FROM lineitem""",
)
def normalize_math_answer(spark, d):
    fraction = F.concat(F.lit("x = \\frac"), (F.col("l_partkey") % 90 + 10).cast("string"), F.lit(" \\text{m} units"))
    amount = F.concat(F.lit("the total = $"), F.format_number(F.floor("l_extendedprice"), 0), F.lit("$ dollars"))
    x = F.when(F.col("l_partkey") % 2 == 0, fraction).otherwise(amount)
    return table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", M.normalize_math_answer(x).alias("answer")
    )


@query(
    "math_equal_normalized",
    r"""WITH x AS (SELECT *, l_partkey % 9 AS a, l_suppkey % 9 AS b, (l_partkey + l_orderkey % 2) % 9 AS c, (l_suppkey + l_orderkey // 2 % 2) % 9 AS e FROM lineitem)
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, a = c AND (l_linenumber % 4 = 2 OR b = e) AS equal FROM x""",
)
def math_equal_normalized(spark, d):
    """The same fraction, root or percentage in two notations, with a digit changed in some."""
    odd, half = F.col("l_orderkey") % 2, F.floor(F.col("l_orderkey") / 2) % 2
    a, c = [((F.col("l_partkey") + x) % 9 + 1).cast("string") for x in (F.lit(0), odd)]
    b, e = [((F.col("l_suppkey") + x) % 9 + 1).cast("string") for x in (F.lit(0), half)]
    k = F.col("l_linenumber") % 4
    left = (
        F.when(k == 0, F.concat(F.lit("\\dfrac"), a, b))
        .when(k == 1, F.concat(a, F.lit("/"), b))
        .when(k == 2, F.concat(F.lit("k = \\sqrt"), a, F.lit(" \\text{ cm}")))
        .otherwise(F.concat(a, b, F.lit("\\%")))
    )
    right = (
        F.when(k == 2, F.concat(F.lit("\\sqrt{"), c, F.lit("}")))
        .when(k == 3, F.concat(c, e))
        .otherwise(F.concat(F.lit("\\frac{"), c, F.lit("}{"), e, F.lit("}")))
    )
    return table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", M.math_equal(left, right).alias("equal")
    )


@query(
    "regex_map_value",
    """WITH m AS (SELECT doc_id, regexp_extract(text, 'the|eau|und|los') AS m FROM documents)
    SELECT doc_id, CASE m WHEN '' THEN '[invalid]' WHEN 'the' THEN 'english' WHEN 'eau' THEN 'french' WHEN 'und' THEN 'german' ELSE 'spanish' END AS value FROM m""",
)
def regex_map_value(spark, d):
    mapping = {"the": "english", "eau": "french", "und": "german", "los": "spanish"}
    return docs(spark, d).select("doc_id", A.regex_map_value(F.col("text"), mapping).alias("value"))


@query(
    "listed_word_order",
    r"""WITH p AS (SELECT conv_id, turn, regexp_extract_all(text, '[\p{L}\p{N}_]+') AS w FROM conversations),
    x AS (SELECT conv_id, turn, unnest(w) AS t, generate_subscripts(w, 1) AS i FROM p),
    l AS (SELECT conv_id, turn, t, max(i) AS i FROM x WHERE t IN ('the', 'of', 'and', 'le', 'der', 'que', 'in') GROUP BY conv_id, turn, t),
    a AS (SELECT conv_id, turn, string_agg(t, ' ' ORDER BY i) AS ordered FROM l GROUP BY conv_id, turn)
    SELECT c.conv_id, c.turn, coalesce(a.ordered, '') AS ordered FROM conversations c LEFT JOIN a ON a.conv_id = c.conv_id AND a.turn = c.turn""",
)
def listed_word_order(spark, d):
    words = F.array(*[F.lit(w) for w in ["the", "of", "and", "le", "der", "que", "in"]])
    return table(spark, d, "conversations").select(
        "conv_id", "turn", A.listed_word_order(F.col("text"), words).alias("ordered")
    )


# Open answers derived from every order line: a sentence with the line's numbers.
def _open(spark, d):
    price = F.format_string("%.2f", "l_extendedprice")
    qty = F.col("l_quantity").cast("int").cast("string")
    text = F.concat(
        F.lit("First we take "), qty, F.lit(" items.\nSo the total is $"), price, F.lit("\nThe status is "), "l_returnflag", F.lit(".")
    )
    return table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_returnflag", text.alias("response")
    )


@query(
    "parse_open_numbers",
    """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(l_extendedprice, 2) AS number,
    concat(' ', lower(l_returnflag), '|', lower(l_returnflag), ' ') AS last_strings FROM lineitem""",
)
def parse_open_numbers(spark, d):
    rows = _open(spark, d).withColumn("p", A.parse_open_numbers(F.col("response")))
    return rows.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.array_max("p.numbers").alias("number"),
        F.array_join(F.slice("p.strings", -2, 2), "|").alias("last_strings"),
    )


@query(
    "match_open",
    """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_suppkey % 3 <> 1 AS number_hit, l_partkey % 2 = 0 AS mixed_hit FROM lineitem""",
)
def match_open(spark, d):
    rows = _open(spark, d).withColumn("p", A.parse_open_numbers(F.col("response")))
    wrong = F.col("l_suppkey") % 3 == 1
    gold = F.array(F.format_string("%.2f", F.col("l_extendedprice") + F.when(wrong, 0.5).otherwise(0.0)))
    mixed = F.when(F.col("l_partkey") % 2 == 0, F.array(F.concat(F.lit("$"), F.format_string("%.2f", "l_extendedprice")))).otherwise(
        F.array(F.lit("nothing"))
    )
    return rows.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", A.match_open(F.col("p"), gold).alias("number_hit"),
        A.match_open(F.col("p"), mixed).alias("mixed_hit"),
    )
