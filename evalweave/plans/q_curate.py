"""Curation, shaping, split and sampling queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from evalweave.functions import text as T
from evalweave.operators import curate as C
from evalweave.operators import fewshot as S
from evalweave.operators import prompts as P
from evalweave.plans.fixtures import MC_SQL, MESSAGES_SQL, W, mc, mc_docs, messages, scored, sql_words, SCORED_SQL
from evalweave.plans.registry import query, table


def q(text: str) -> str:
    """A Python string as a SQL literal."""
    return "'" + text.replace("'", "''") + "'"


def strip_sql(x: str) -> str:
    return f"regexp_replace({x}, '^{W}+|{W}+$', '', 'g')"


def docs(spark, d):
    return table(spark, d, "documents")


MSG = f"WITH {MESSAGES_SQL}"
BUDGET = 300
TRACE = strip_sql("split_part(split_part(response, '<think>', 2), '</think>', 1)")
ANSWER = strip_sql("split_part(response, '</think>', 2)")


@query("filter_token_budget", f"{MSG} SELECT id, num_tokens FROM messages WHERE num_tokens < {BUDGET}")
def filter_token_budget(spark, d):
    return C.filter_token_budget(messages(spark, d), BUDGET).select("id", "num_tokens")


@query("topk_longest", f"{MSG} SELECT id, num_tokens, question FROM messages ORDER BY num_tokens DESC, id LIMIT 40")
def topk_longest(spark, d):
    return C.topk_longest(messages(spark, d), 40).select("id", "num_tokens", "question")


@query(
    "require_think_tags",
    f"{MSG} SELECT id, response FROM messages WHERE contains(response, '<think>') AND contains(response, '</think>')",
)
def require_think_tags(spark, d):
    return C.require_think_tags(messages(spark, d)).select("id", "response")


@query("split_thinking_trace", f"{MSG} SELECT id, {TRACE} AS thinking_trace, {ANSWER} AS answer FROM messages")
def split_thinking_trace(spark, d):
    r = F.col("response")
    return messages(spark, d).select(
        "id", C.thinking_trace(r).alias("thinking_trace"), C.final_answer(r).alias("answer")
    )


@query(
    "pick_turns",
    """SELECT conv_id, min_by(text, turn) FILTER (WHERE role = 'user') AS question,
    min_by(text, turn) FILTER (WHERE role = 'assistant') AS response FROM conversations GROUP BY conv_id""",
)
def pick_turns(spark, d):
    return C.pick_turns(table(spark, d, "conversations"))


@query("default_source", f"{MSG} SELECT id, coalesce(source, '') AS source FROM messages")
def default_source(spark, d):
    return C.default_source(messages(spark, d)).select("id", "source")


SEL = f"""{MSG}, top AS (SELECT * FROM messages WHERE num_tokens < {BUDGET} ORDER BY num_tokens DESC, id LIMIT 70),
sft AS (SELECT id, question, {TRACE} AS thinking_trace, {ANSWER} AS answer, num_tokens, coalesce(source, '') AS source
        FROM top WHERE contains(response, '<think>') AND contains(response, '</think>'))"""


@query(
    "curate_sft",
    f"""{SEL} SELECT *, CASE WHEN row_number() OVER (ORDER BY md5(concat_ws('|', '0', CAST(id AS VARCHAR))), id) <= 10
    THEN 'val' ELSE 'train' END AS split FROM sft""",
)
def curate_sft(spark, d):
    return C.curate_sft(messages(spark, d), 60, BUDGET, 10)


@query(
    "train_val_split",
    f"""{MSG} SELECT id, CASE WHEN row_number() OVER (ORDER BY md5(concat_ws('|', '7', CAST(id AS VARCHAR))), id) <= 20
    THEN 'val' ELSE 'train' END AS split FROM messages""",
)
def train_val_split(spark, d):
    return C.train_val_split(messages(spark, d), "id", 20, 7).select("id", "split")


@query("load_corpus", "SELECT doc_id, source, n_chars FROM documents WHERE lang = 'en'")
def load_corpus(spark, d):
    from evalweave.sources.datasets import load_corpus as load

    return load(spark, f"{d}/documents.parquet", lang="en").select("doc_id", "source", "n_chars")


@query("filter_equal", "SELECT doc_id, n_chars FROM documents WHERE lang = 'fr'")
def filter_equal(spark, d):
    return C.filter_equal(docs(spark, d), "lang", "fr").select("doc_id", "n_chars")


@query("filter_prefix", "SELECT doc_id, source FROM documents WHERE starts_with(source, 'src1')")
def filter_prefix(spark, d):
    return C.filter_prefix(docs(spark, d), "source", "src1").select("doc_id", "source")


@query("filter_membership", "SELECT doc_id, lang FROM documents WHERE lang IN ('de', 'es')")
def filter_membership(spark, d):
    return C.filter_membership(docs(spark, d), "lang", ["de", "es"]).select("doc_id", "lang")


@query(
    "filter_valid_choices",
    f"""WITH {MC_SQL} SELECT doc_id, max(gold) AS gold, string_agg(choice, '|' ORDER BY idx) AS choices FROM mc
    GROUP BY doc_id HAVING max(gold) IN (0, 1, 2) AND bool_or(choice <> '')""",
)
def filter_valid_choices(spark, d):
    rows = C.filter_valid_choices(mc_docs(spark, d), "gold", "choices", [0, 1, 2])
    return rows.select("doc_id", "gold", F.array_join("choices", "|").alias("choices"))


def general_sql(x):
    for a, b in [(" n't", "n't"), (" )", ")"), ("( ", "("), ('" ', '"'), (' "', '"')]:
        x = f"replace({x}, {q(a)}, {q(b)})"
    return f"regexp_replace({x}, ' ([''.,])', '\\1', 'g')"


PAIR_SQL = """pr AS (SELECT conv_id, turn, text AS first, reverse(text) AS second FROM conversations)"""


@query(
    "filter_nonempty_pair",
    f"""WITH {PAIR_SQL}, t AS (SELECT conv_id, turn, {strip_sql(general_sql('first'))} AS a, {strip_sql(general_sql('second'))} AS b
    FROM pr WHERE first <> '' AND second <> '')
    SELECT conv_id, turn, regexp_replace(a, '[.,;]$', '') AS first, concat(lower(substring(b, 1, 1)), substring(b, 2)) AS second FROM t""",
)
def filter_nonempty_pair(spark, d):
    rows = table(spark, d, "conversations").select("conv_id", "turn", F.col("text").alias("first"), F.reverse("text").alias("second"))
    return C.tidy_pair(rows, "first", "second")


@query(
    "mark_spans",
    f"""WITH w AS (SELECT conv_id, turn, string_split(text, ' ') AS w FROM conversations),
    x AS (SELECT conv_id, turn, len(w) AS n, unnest(w) AS tok, generate_subscripts(w, 1) - 1 AS i FROM w)
    SELECT conv_id, turn, string_agg(concat(CASE WHEN i = turn % n OR i = (turn + 3) % n THEN '*' ELSE '' END, tok,
      CASE WHEN i = turn % n + 1 OR i = (turn + 3) % n + 1 THEN '*' ELSE '' END), ' ' ORDER BY i) AS marked FROM x GROUP BY conv_id, turn""",
)
def mark_spans(spark, d):
    tokens = F.split("text", " ")
    n = F.size("tokens")
    spans = F.array(
        F.struct((F.col("turn") % n).alias("start"), F.lit(2).alias("length")),
        F.struct(((F.col("turn") + 3) % n).alias("start"), F.lit(2).alias("length")),
    )
    rows = table(spark, d, "conversations").withColumn("tokens", tokens)
    return rows.select("conv_id", "turn", C.mark_spans(F.col("tokens"), spans).alias("marked"))


@query(
    "head_fraction",
    "SELECT doc_id, n_chars FROM (SELECT *, row_number() OVER (ORDER BY doc_id) AS rn, count(*) OVER () AS n FROM documents) x WHERE rn <= ceil(n * 0.1)",
)
def head_fraction(spark, d):
    return C.limit_docs(docs(spark, d), "doc_id", 0.1).select("doc_id", "n_chars")


@query("limit_docs", "SELECT doc_id, text FROM documents ORDER BY doc_id LIMIT 25")
def limit_docs(spark, d):
    return C.limit_docs(docs(spark, d), "doc_id", 25).select("doc_id", "text")


@query(
    "select_by_index",
    "SELECT doc_id, pos FROM (SELECT doc_id, row_number() OVER (ORDER BY n_chars, doc_id) - 1 AS pos FROM documents) x WHERE pos IN (0, 3, 17, 100)",
)
def select_by_index(spark, d):
    rows = docs(spark, d).select("doc_id", "n_chars")
    return C.select_by_index(rows, "doc_id", [0, 3, 17, 100], [F.col("n_chars")]).select("doc_id", "pos")


@query(
    "shard_stride",
    "SELECT doc_id, pos FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS pos FROM documents) x WHERE pos % 4 = 1",
)
def shard_stride(spark, d):
    return C.shard_stride(docs(spark, d), "doc_id", 1, 4).select("doc_id", "pos")


@query(
    "prune_by_token_length",
    f"SELECT doc_id FROM (SELECT doc_id, len({sql_words('text')}) AS a, ceil(length(text) / 4) AS b FROM documents) x WHERE a <= 500 AND b <= 800",
)
def prune_by_token_length(spark, d):
    counters = [F.size(T.words(F.col("text"))), F.ceil(F.length("text") / 4)]
    limits = C.prune_by_token_length(docs(spark, d), counters[:1], 500)
    return C.prune_by_token_length(limits, counters[1:], 800).select("doc_id")


def steps_sql(x, steps):
    for kind, a, b in steps:
        if kind == "lit":
            x = f"replace({x}, {q(a)}, {q(b)})"
        else:
            x = f"regexp_replace({x}, {q(a)}, {q(b.replace('$1', chr(92) + '1'))}, 'g')"
    return x


# Corpus text with the marks the detokenisers undo, derived from every document.
NOISY_SQL = (
    "replace(replace(replace(text, ',', ' , '), '.', ' . '), 'the', '( the )')"
)


def noisy():
    x = F.replace(F.col("text"), F.lit(","), F.lit(" , "))
    x = F.replace(x, F.lit("."), F.lit(" . "))
    return F.replace(x, F.lit("the"), F.lit("( the )"))


for _name, _steps in [("wikitext", T.WIKI_STEPS), ("dialogue", T.DIALOGUE_STEPS), ("general", T.GENERAL_STEPS)]:

    def _run(spark, d, steps=_steps):
        return docs(spark, d).select("doc_id", T.apply_steps(noisy(), steps).alias("page"))

    query(f"detokenize_{_name}", f"SELECT doc_id, {steps_sql(NOISY_SQL, _steps)} AS page FROM documents")(_run)


@query(
    "flatten_qas",
    """WITH x AS (SELECT conv_id AS doc_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS INT) AS q_idx, text, turn, conv_id
    FROM conversations)
    SELECT doc_id, q_idx, role_text AS question, text AS answer, 'free form answer' AS answer_type
    FROM (SELECT doc_id, q_idx, concat('Q', CAST(turn AS VARCHAR)) AS role_text, text, (conv_id + turn) % 5 = 0 AS un, turn % 3 = 0 AS yn FROM x) y
    WHERE NOT un AND NOT yn AND text <> ''""",
)
def flatten_qas(spark, d):
    blob = F.struct(
        ((F.col("conv_id") + F.col("turn")) % 5 == 0).alias("unanswerable"),
        (F.col("turn") % 3 == 0).alias("yes_no"),
        F.col("text").alias("free_form_answer"),
        F.array(F.col("role")).alias("extractive_spans"),
    )
    # A conversation is one document; its turns are its questions.
    nested = (
        table(spark, d, "conversations")
        .groupBy(F.col("conv_id").alias("doc_id"))
        .agg(
            F.sort_array(
                F.collect_list(
                    F.struct(
                        "turn",
                        F.concat(F.lit("Q"), F.col("turn").cast("string")).alias("question"),
                        F.array(blob).alias("answers"),
                    )
                )
            ).alias("qas")
        )
    )
    return C.flatten_qas(nested, "free form answer")


@query(
    "merge_duplicate_ids",
    """SELECT user_id, CAST(0 AS BIGINT) AS part, min_by(event_type, event_id) AS event_type,
    string_agg(CAST(event_id AS VARCHAR), ',' ORDER BY event_id) AS outputs FROM events GROUP BY user_id""",
)
def merge_duplicate_ids(spark, d):
    rows = C.merge_duplicate_ids(table(spark, d, "events"), "user_id", "event_id", "event_id", ["event_type"])
    return rows.withColumn("outputs", F.array_join(F.col("outputs").cast("array<string>"), ","))


@query(
    "dedupe_answers",
    f"""WITH w AS (SELECT conv_id, turn, {sql_words('text')} AS w FROM conversations),
    x AS (SELECT conv_id, turn, unnest(w) AS t, generate_subscripts(w, 1) AS i FROM w),
    e AS (SELECT conv_id, turn, t, min(i) AS i FROM x GROUP BY conv_id, turn, t),
    c AS (SELECT conv_id, turn, lower(t) AS k, min_by(t, i) AS t, min(i) AS i FROM x GROUP BY conv_id, turn, lower(t)),
    ea AS (SELECT conv_id, turn, string_agg(t, ' ' ORDER BY i) AS exact FROM e GROUP BY conv_id, turn),
    ca AS (SELECT conv_id, turn, string_agg(t, ' ' ORDER BY i) AS nocase FROM c GROUP BY conv_id, turn),
    sa AS (SELECT conv_id, turn, string_agg(t, ' ' ORDER BY t) AS sorted FROM e GROUP BY conv_id, turn)
    SELECT conv_id, turn, exact, nocase, sorted FROM ea JOIN ca USING (conv_id, turn) JOIN sa USING (conv_id, turn)""",
)
def dedupe_answers(spark, d):
    w = T.words(F.col("text"))
    return (
        table(spark, d, "conversations")
        .select("conv_id", "turn", w.alias("w"))
        .select(
            "conv_id",
            "turn",
            F.array_join(C.dedupe_exact(F.col("w")), " ").alias("exact"),
            F.array_join(C.dedupe_case_insensitive(F.col("w")), " ").alias("nocase"),
            F.array_join(C.dedupe_sorted(F.col("w")), " ").alias("sorted"),
        )
    )


@query(
    "split_prepended_question",
    r"""WITH x AS (SELECT conv_id, turn, CASE WHEN turn % 4 = 3 THEN text ELSE concat(role, chr(10), chr(10), text) END AS t FROM conversations),
    y AS (SELECT *, strpos(t, chr(10) || chr(10)) AS br FROM x)
    SELECT conv_id, turn, CASE WHEN br > 0 THEN substring(t, 1, br - 1) ELSE substring(t, 1, length(t) - 1) END AS question,
    CASE WHEN br > 0 THEN substring(t, br + 2) ELSE substring(t, 2) END AS text FROM y""",
)
def split_prepended_question(spark, d):
    t = F.when(F.col("turn") % 4 == 3, F.col("text")).otherwise(F.concat("role", F.lit("\n\n"), "text"))
    rows = table(spark, d, "conversations").select("conv_id", "turn", t.alias("t"))
    question, rest = C.split_prepended_question(F.col("t"))
    return rows.select("conv_id", "turn", question.alias("question"), rest.alias("text"))


@query(
    "build_prompt",
    f"""SELECT doc_id, concat({q(P.CODE_INSTRUCTION)}, chr(10), source, ': ', text, chr(10), '## Input Format', chr(10), ' ', lang,
    chr(10), '## Output Format', chr(10), ' ', CAST(n_chars AS VARCHAR), chr(10), '## Examples', chr(10), '```input', chr(10),
    CASE WHEN doc_id % 3 = 0 THEN '' ELSE CAST(doc_id AS VARCHAR) END, chr(10), '```', chr(10), '```output', chr(10),
    CASE WHEN doc_id % 3 = 0 THEN '' ELSE lang END, chr(10), '```', chr(10), '## Constraints', chr(10), 'Time limit per test case: ',
    CAST(1 + doc_id % 4 AS VARCHAR), ' seconds', chr(10), 'Memory limit per test case: 256 MB', chr(10), '## Note', chr(10),
    CASE WHEN doc_id % 2 = 0 THEN source ELSE 'None' END) AS prompt FROM documents""",
)
def build_prompt(spark, d):
    problems = docs(spark, d).select(
        "doc_id",
        F.col("source").alias("title"),
        F.col("text").alias("description"),
        F.col("lang").alias("input_format"),
        F.col("n_chars").cast("string").alias("output_format"),
        F.when(
            F.col("doc_id") % 3 != 0,
            F.array(F.struct(F.col("doc_id").cast("string").alias("input"), F.col("lang").alias("output"))),
        ).alias("examples"),
        F.when(F.col("doc_id") % 2 == 0, F.col("source")).alias("note"),
        (1 + F.col("doc_id") % 4).alias("time_limit"),
        F.lit(256).alias("memory_limit"),
    )
    return problems.select("doc_id", P.build_prompt().alias("prompt"))


@query("render_template", "SELECT doc_id, concat('[', lang, '] ', text, ' (', source, ')') AS rendered FROM documents")
def render_template(spark, d):
    rows = docs(spark, d)
    return rows.select("doc_id", T.render_template("[{{lang}}] {{text}} ({{ source }})", rows.columns).alias("rendered"))


@query(
    "apply_chat_template",
    f"""{MSG} SELECT id, concat('<|im_start|>system', chr(10), {q(P.DEFAULT_SYSTEM)}, '<|im_end|>', chr(10), '<|im_start|>user', chr(10),
    {strip_sql('question')}, '<|im_end|>', chr(10), '<|im_start|>assistant', chr(10), '<|im_start|>think', chr(10), {TRACE}, chr(10),
    '<|im_start|>answer', chr(10), {ANSWER}, '<|im_end|>', chr(10)) AS text FROM messages""",
)
def apply_chat_template(spark, d):
    r = F.col("response")
    return messages(spark, d).select(
        "id", P.chat_text(F.col("question"), C.thinking_trace(r), C.final_answer(r)).alias("text")
    )


@query(
    "robust_prompt",
    f"""WITH {MC_SQL} SELECT doc_id, concat('Q: ', max(category), chr(10), string_agg(concat('(', chr(CAST(65 + idx AS INT)), '/',
    CAST(idx + 1 AS VARCHAR), '/', ['I','II','III','IV','V'][CAST(idx + 1 AS INT)], ') ', choice, chr(10)), '' ORDER BY idx), 'A:') AS prompt FROM mc GROUP BY doc_id""",
)
def robust_prompt(spark, d):
    fmt = "({letter}/{numeral}/{roman_numeral}) {option}\n"
    return mc_docs(spark, d).select(
        "doc_id",
        P.robust_prompt("Q: {question}\n{options}A:", F.col("category"), F.col("choices"), F.col("category"), fmt).alias("prompt"),
    )


@query("concat_datasets", f"{MSG} SELECT id, num_tokens FROM messages UNION ALL SELECT id + 1000000, num_tokens FROM messages")
def concat_datasets(spark, d):
    m = messages(spark, d).select("id", "num_tokens")
    return C.concat_datasets(m, m.withColumn("id", F.col("id") + 1000000))


@query(
    "join_splits",
    """SELECT doc_id, lang, 'train' AS split FROM documents WHERE lang = 'en'
    UNION ALL SELECT doc_id, lang, 'validation' FROM documents WHERE lang = 'fr'
    UNION ALL SELECT doc_id, lang, 'test' FROM documents WHERE lang NOT IN ('en', 'fr')""",
)
def join_splits(spark, d):
    x = docs(spark, d).select("doc_id", "lang")
    lang = F.col("lang")
    return C.join_splits({"train": x.where(lang == "en"), "validation": x.where(lang == "fr"), "test": x.where(~lang.isin("en", "fr"))})


@query(
    "task_intersection",
    f"""WITH {SCORED_SQL}, p AS (SELECT DISTINCT concat('m', CAST(gold AS VARCHAR)) AS model, task FROM scored)
    SELECT task FROM p GROUP BY task HAVING count(*) = (SELECT count(DISTINCT model) FROM p)""",
)
def task_intersection(spark, d):
    rows = scored(spark, d).withColumn("model", F.concat(F.lit("m"), F.col("gold").cast("string")))
    return C.task_intersection(rows, "model", "task")


@query("pattern_match", "SELECT DISTINCT source FROM documents WHERE source GLOB 'src1*' OR source GLOB 'src[2-4]'")
def pattern_match(spark, d):
    return C.pattern_match(docs(spark, d), "source", ["src1*", "src[2-4]"])


def h(seed, ids):
    return f"CAST(concat('0x', substring(md5(concat_ws('|', '{seed}', CAST({ids} AS VARCHAR))), 1, 15)) AS BIGINT)"


K = 3
FEWSHOT_SQL = f"""qa AS (SELECT conv_id AS id, min_by(text, turn) FILTER (WHERE role = 'user') AS question,
    min_by(text, turn) FILTER (WHERE role = 'assistant') AS response FROM conversations GROUP BY conv_id
    HAVING bool_or(role = 'user') AND bool_or(role = 'assistant')),
pool AS (SELECT *, row_number() OVER (ORDER BY md5(concat_ws('|', '5', CAST(id AS VARCHAR))), id) - 1 AS slot, count(*) OVER () AS n,
    {h('5/start', 'id')} AS hh FROM qa),
own AS (SELECT *, hh % n AS start, (slot - hh % n + n) % n AS own_j FROM pool),
draw AS (SELECT *, unnest(range({K + 1})) AS j FROM own),
kept AS (SELECT id, (start + j) % n AS want, CAST(row_number() OVER (PARTITION BY id ORDER BY j) - 1 AS INT) AS rank FROM draw
         WHERE j <> least(own_j, {K})),
picks AS (SELECT k.id, k.rank, p.id AS example_id, p.question AS q, p.response AS a FROM kept k JOIN pool p ON p.slot = k.want)"""


def qa(spark, d):
    return C.pick_turns(table(spark, d, "conversations")).withColumnRenamed("conv_id", "id").where("question IS NOT NULL AND response IS NOT NULL")


@query("fewshot_random", f"WITH {FEWSHOT_SQL} SELECT id, rank, example_id FROM picks")
def fewshot_random(spark, d):
    return S.fewshot_random(qa(spark, d), qa(spark, d), "id", K, 5)


@query(
    "fewshot_first_n",
    "SELECT conv_id, turn, text FROM conversations ORDER BY conv_id * 100 + turn LIMIT 5",
)
def fewshot_first_n(spark, d):
    pool = table(spark, d, "conversations").withColumn("id", F.col("conv_id") * 100 + F.col("turn"))
    return S.fewshot_first_n(pool, "id", 5).select("conv_id", "turn", "text")


@query(
    "fewshot_by_indices",
    "SELECT conv_id, turn FROM (SELECT *, row_number() OVER (ORDER BY conv_id * 100 + turn) - 1 AS pos FROM conversations) x WHERE pos IN (2, 5, 11)",
)
def fewshot_by_indices(spark, d):
    pool = table(spark, d, "conversations").withColumn("id", F.col("conv_id") * 100 + F.col("turn"))
    return S.fewshot_by_indices(pool, "id", [2, 5, 11]).select("conv_id", "turn")


@query(
    "fewshot_context",
    f"""WITH {FEWSHOT_SQL}, ex AS (SELECT id, string_agg(concat(q, ' ', a, chr(10), chr(10)), '' ORDER BY rank) AS ex FROM picks GROUP BY id)
    SELECT o.id, concat('Answer the question.', chr(10), coalesce(ex, ''), question) AS context FROM qa o LEFT JOIN ex ON o.id = ex.id""",
)
def fewshot_context(spark, d):
    y = qa(spark, d)
    picks = S.fewshot_random(y, y, "id", K, 5)
    return S.fewshot_context(y, picks, y, "id", "question", "response", "Answer the question.\n")


@query(
    "fewshot_chat_turns",
    f"""WITH {FEWSHOT_SQL} SELECT id, CAST(2 * rank AS INT) AS turn, 'user' AS role, q AS content FROM picks
    UNION ALL SELECT id, CAST(2 * rank + 1 AS INT), 'assistant', a FROM picks
    UNION ALL SELECT id, CAST({2 * K} AS INT), 'user', question FROM qa""",
)
def fewshot_chat_turns(spark, d):
    y = qa(spark, d)
    picks = S.fewshot_random(y, y, "id", K, 5)
    return S.fewshot_chat_turns(y, picks, y, "id", "question", "response").select(
        "id", F.posexplode("turns").alias("turn", "t")
    ).select("id", "turn", "t.role", "t.content")


@query(
    "permute_choices",
    f"""WITH {MC_SQL}, s AS (SELECT *, CAST((1 + {h('3', 'doc_id')} % greatest(n_choices - 1, 1)) % n_choices AS INT) AS step FROM mc)
    SELECT doc_id, string_agg(choice, '|' ORDER BY (idx + step) % n_choices) AS choices, CAST((max(gold) + max(step)) % max(n_choices) AS INT) AS gold
    FROM s GROUP BY doc_id""",
)
def permute_choices(spark, d):
    rows = P.permute_choices(mc_docs(spark, d), "doc_id", "choices", "gold", 3)
    return rows.select("doc_id", F.array_join("choices", "|").alias("choices"), "gold")


@query(
    "expand_prompts",
    """SELECT doc_id, CAST(prompt_id AS INT) AS prompt_id, concat(['Read: ', 'Summarise: ', 'Classify: '][prompt_id + 1], text) AS full_prompt
    FROM (SELECT *, unnest([0, 1, 2]) AS prompt_id FROM documents) x""",
)
def expand_prompts(spark, d):
    rows = P.expand_prompts(docs(spark, d), ["Read: ", "Summarise: ", "Classify: "])
    return rows.select("doc_id", "prompt_id", F.concat("prompt", "text").alias("full_prompt"))


@query(
    "expand_option_orders",
    f"""WITH {MC_SQL}, x AS (SELECT *, unnest([0, 1, 2]) AS slot FROM mc),
    y AS (SELECT *, CASE WHEN slot >= n_choices THEN idx WHEN idx = slot THEN gold WHEN idx = gold THEN slot ELSE idx END AS new_idx FROM x)
    SELECT doc_id, ['A', 'B', 'C'][slot + 1] AS always_same_option, string_agg(choice, '|' ORDER BY new_idx) AS choices,
    CAST(max(CASE WHEN slot < n_choices THEN slot ELSE gold END) AS INT) AS gold, max(gold) AS original_answer_index FROM y GROUP BY doc_id, slot""",
)
def expand_option_orders(spark, d):
    rows = P.expand_option_orders(mc_docs(spark, d), "choices", "gold", ["A", "B", "C"])
    return rows.select(
        "doc_id", "always_same_option", F.array_join("choices", "|").alias("choices"), "gold", "original_answer_index"
    )


@query(
    "repeat_requests",
    f"WITH {MC_SQL} SELECT doc_id, idx, CAST(unnest([0, 1, 2]) AS INT) AS repeat FROM mc",
)
def repeat_requests(spark, d):
    return P.repeat_requests(mc(spark, d), 3).select("doc_id", "idx", "repeat")
