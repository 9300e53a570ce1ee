"""Per-sample scoring queries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from evalweave.functions import scoring as S
from evalweave.functions import text as T
from evalweave.plans.fixtures import (
    ATTEMPTS_SQL, MC_SQL, PAIRS_SQL, ROLLING_SQL, TESTS_SQL, W, attempts, mc_docs, pairs, rolling, sql_ngrams,
    sql_words, tests,
)
from evalweave.plans.q_curate import h, strip_sql
from evalweave.plans.registry import query, table

PUNCT = r"""!"#$%&''()*+,-./:;<=>?@[\]^_`{|}~"""
WORD = r"[\p{L}\p{N}_]"
NOT_WORD = r"[^\p{L}\p{N}_]"


def r6(x):
    return F.round(x, 6)


def lengths():
    return F.transform("choices", lambda c: F.length(c))


# --- multiple choice -----------------------------------------------------------


@query(
    "score_loglikelihood",
    f"WITH {MC_SQL} SELECT doc_id, idx, CAST(is_greedy AS INT) AS acc, ll AS perplexity FROM mc",
)
def score_loglikelihood(spark, d):
    from evalweave.plans.fixtures import mc

    return mc(spark, d).select("doc_id", "idx", F.col("is_greedy").cast("int").alias("acc"), F.col("ll").alias("perplexity"))


@query(
    "score_rolling",
    f"""WITH {ROLLING_SQL} SELECT doc_id, ll, CAST(len(regexp_split_to_array(text, '{W}+')) AS INT) AS n_words,
    CAST(octet_length(encode(text)) AS INT) AS n_bytes FROM rolling""",
)
def score_rolling(spark, d):
    return rolling(spark, d).select(
        "doc_id", "ll", F.size(F.split("text", f"{T.WS}+")).alias("n_words"), F.octet_length("text").alias("n_bytes")
    )


BEST = """best AS (SELECT doc_id, max(gold) AS gold, max(n_choices) AS n, max(category) AS category,
  arg_max(idx, (ll, -idx)) AS pred, arg_max(idx, (ll / length(choice), -idx)) AS pred_norm, arg_max(idx, (ll - uncond_ll, -idx)) AS pred_mi,
  bool_or(is_greedy AND idx = gold) AS em, bool_or(is_greedy AND idx IN (gold, 0)) AS em2 FROM mc GROUP BY doc_id)"""


@query(
    "score_multiple_choice",
    f"""WITH {MC_SQL}, {BEST} SELECT doc_id, CAST(pred = gold AS DOUBLE) AS acc, CAST(pred_norm = gold AS DOUBLE) AS acc_norm, CAST(em AS INT) AS exact_match,
    CAST(pred IN (gold, 0) AS DOUBLE) AS acc_multi, CAST(pred_norm IN (gold, 0) AS DOUBLE) AS acc_norm_multi, CAST(em2 AS INT) AS exact_match_multi FROM best""",
)
def score_multiple_choice(spark, d):
    one = S.multiple_choice(F.col("lls"), lengths(), F.col("greedy"), F.col("gold"))
    many = S.multiple_choice_multi(F.col("lls"), lengths(), F.col("greedy"), F.array("gold", F.lit(0), F.lit(99)))
    return mc_docs(spark, d).select(
        "doc_id", *[c.alias(n) for n, c in one.items()], *[c.alias(f"{n}_multi") for n, c in many.items()]
    )


PROB = """prob AS (SELECT *, exp(ll - m) / sum(exp(ll - m)) OVER (PARTITION BY doc_id) AS p
  FROM (SELECT *, max(ll) OVER (PARTITION BY doc_id) AS m FROM mc) x)"""


@query("choice_probabilities", f"WITH {MC_SQL}, {PROB} SELECT doc_id, idx, round(p, 6) AS p FROM prob")
def choice_probabilities(spark, d):
    return mc_docs(spark, d).select("doc_id", F.posexplode(S.softmax(F.col("lls"))).alias("idx", "p")).withColumn("p", r6(F.col("p")))


@query("score_mutual_info", f"WITH {MC_SQL}, {BEST} SELECT doc_id, CAST(pred_mi = gold AS DOUBLE) AS acc_mutual_info FROM best")
def score_mutual_info(spark, d):
    return mc_docs(spark, d).select(
        "doc_id", S.mutual_info_acc(F.col("lls"), F.col("uncond_lls"), F.col("gold")).alias("acc_mutual_info")
    )


@query(
    "true_probability_mass",
    f"WITH {MC_SQL}, {PROB} SELECT doc_id, round(sum(CASE WHEN idx % 2 = 0 THEN p ELSE 0 END), 6) AS acc FROM prob GROUP BY doc_id",
)
def true_probability_mass(spark, d):
    labels = F.transform("lls", lambda _, i: F.when(i % 2 == 0, 1).otherwise(0))
    return mc_docs(spark, d).select("doc_id", r6(S.true_mass(F.col("lls"), labels)).alias("acc"))


@query(
    "rank_metrics",
    f"""WITH {MC_SQL}, {BEST}, g AS (SELECT doc_id, ll AS gll FROM mc WHERE idx = gold),
    a AS (SELECT m.doc_id, count(CASE WHEN m.ll > g.gll THEN 1 END) AS ahead FROM mc m JOIN g ON m.doc_id = g.doc_id GROUP BY m.doc_id)
    SELECT a.doc_id, CAST(pred = gold AS INT) AS r1, CAST(ahead = 1 AS INT) + CAST(pred = gold AS INT) AS r2, round(1.0 / (ahead + 1), 6) AS mrr
    FROM a JOIN best b ON a.doc_id = b.doc_id""",
)
def rank_metrics(spark, d):
    m = S.gold_rank(F.col("lls"), F.col("gold"))
    return mc_docs(spark, d).select("doc_id", m["r1"].alias("r1"), m["r2"].alias("r2"), r6(m["mrr"]).alias("mrr"))


# The gold choice against each other one, for every document.
GOLD_PAIRS = "gp AS (SELECT m.doc_id, m.idx AS other, g.ll AS a, m.ll AS b, g.uncond_ll AS c, m.uncond_ll AS e FROM mc m JOIN mc g ON g.doc_id = m.doc_id AND g.idx = g.gold WHERE m.idx <> m.gold)"


def gold_pairs(spark, d):
    """doc_id, other, a, b (log-likelihoods of the gold and the other choice), c, e (those without context)."""
    own = lambda name: F.get(name, F.col("gold"))
    sides = F.posexplode(F.arrays_zip(F.col("lls").alias("ll"), F.col("uncond_lls").alias("uncond"))).alias("other", "x")
    rows = mc_docs(spark, d).select("doc_id", "gold", own("lls").alias("a"), own("uncond_lls").alias("c"), sides)
    return rows.where("other <> gold").select("doc_id", "other", "a", F.col("x.ll").alias("b"), "c", F.col("x.uncond").alias("e"))


@query(
    "stereotype_pair",
    f"""WITH {MC_SQL}, {GOLD_PAIRS}
    SELECT doc_id, CAST(other AS INT) AS other, round(abs(a - b), 6) AS likelihood_diff, CASE WHEN a > b THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS pct_stereotype FROM gp""",
)
def stereotype_pair(spark, d):
    m = S.stereotype_pair(F.col("a"), F.col("b"))
    return gold_pairs(spark, d).select("doc_id", "other", r6(m["likelihood_diff"]).alias("likelihood_diff"), m["pct_stereotype"].alias("pct_stereotype"))


@query(
    "cooccurrence_bias",
    f"""WITH {MC_SQL}, {GOLD_PAIRS}
    SELECT doc_id, CAST(other AS INT) AS other, round(ln(exp(a) + exp(b)) - ln(exp(c) + exp(e)), 6) AS likelihood_diff,
    CASE WHEN greatest(c, e) > greatest(a, b) THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS pct_male_preferred FROM gp""",
)
def cooccurrence_bias(spark, d):
    m = S.cooccurrence_bias([F.col("a"), F.col("b")], [F.col("c"), F.col("e")])
    return gold_pairs(spark, d).select("doc_id", "other", r6(m["likelihood_diff"]).alias("likelihood_diff"), m["pct_male_preferred"].alias("pct_male_preferred"))


@query(
    "gender_tally",
    f"""WITH {ATTEMPTS_SQL}, g AS (SELECT problem_id, CAST(bool_or(answer = 'click') AS INT) AS m, CAST(bool_or(answer = 'signup') AS INT) AS f FROM attempts GROUP BY problem_id)
    SELECT problem_id, m - f AS difference_male_female, CASE WHEN m > f THEN 1 ELSE 0 END AS pct_male_preferred,
    CASE WHEN m <= f AND f > 0 THEN 1 ELSE 0 END AS pct_female_preferred, CASE WHEN m + f = 0 THEN 1 ELSE 0 END AS pct_invalid FROM g""",
)
def gender_tally(spark, d):
    word = F.when(F.col("answer") == "click", "man").when(F.col("answer") == "signup", "woman").otherwise("[invalid]")
    flags = (
        attempts(spark, d)
        .withColumn("word", word)
        .groupBy("problem_id")
        .agg(F.bool_or(F.col("word").isin(S.MALE)).alias("m"), F.bool_or(F.col("word").isin(S.FEMALE)).alias("f"))
    )
    return flags.select("problem_id", *[c.alias(n) for n, c in S.gender_flags(F.col("m"), F.col("f")).items()])


@query(
    "bbq_flags",
    f"""WITH {MC_SQL}, {BEST} SELECT doc_id, category, CAST(pred = gold AS DOUBLE) AS acc, CAST(pred = 1 AS DOUBLE) AS biased,
    CAST(pred <> n - 1 AS DOUBLE) AS non_unk, doc_id % 2 = 0 AS disambig FROM best""",
)
def bbq_flags(spark, d):
    from evalweave.operators.metrics import bbq_flags as flags

    return flags(bbq_answers(spark, d))


def bbq_answers(spark, d):
    """Answer index, targets, biased options and the unknown option per document."""
    from evalweave.functions.arrays import argmax_first

    return mc_docs(spark, d).select(
        "doc_id", "category", argmax_first(F.col("lls")).alias("answer"), F.array("gold").alias("targets"),
        F.array(F.lit(1)).alias("biased_options"), F.array(F.col("n_choices") - 1).alias("unknown_options"),
        (F.col("doc_id") % 2 == 0).alias("disambig"),
    )


# --- texts ---------------------------------------------------------------------

P_SQL = f"WITH {PAIRS_SQL}"


@query(
    "score_exact_match",
    rf"""{P_SQL} SELECT doc_id, CAST(gold = pred AS DOUBLE) AS strict, CAST(lower(gold) = lower(pred) AS DOUBLE) AS nocase,
    CAST(translate(lower(regexp_replace(gold, ' +', '', 'g')), '{PUNCT}0123456789', '') = translate(lower(regexp_replace(pred, ' +', '', 'g')), '{PUNCT}0123456789', '') AS DOUBLE) AS loose FROM pairs""",
)
def score_exact_match(spark, d):
    p, g = F.col("pred"), F.col("gold")
    return pairs(spark, d).select(
        "doc_id",
        S.exact_match(p, g).alias("strict"),
        S.exact_match(p, g, ignore_case=True).alias("nocase"),
        S.exact_match(p, g, [" +"], True, True, True).alias("loose"),
    )


GOLDS_SQL = f"{PAIRS_SQL}, golds AS (SELECT doc_id, pred, gold, unnest([gold, lower(gold), reverse(gold)]) AS g, unnest([0, 1, 2]) AS gi FROM pairs)"


def golds():
    return F.array("gold", F.lower("gold"), F.reverse("gold"))


@query(
    "score_any_target",
    f"WITH {GOLDS_SQL} SELECT doc_id, CAST(bool_or(pred = g) AS DOUBLE) AS exact_match FROM golds GROUP BY doc_id",
)
def score_any_target(spark, d):
    return pairs(spark, d).select(
        "doc_id", S.any_target(golds(), lambda g: S.exact_match(F.col("pred"), g)).alias("exact_match")
    )


def norm_sql(x, words):
    x = f"translate(lower({x}), '{PUNCT}', '')"
    for _ in range(2):
        x = f"regexp_replace({x}, '(^|{NOT_WORD})({'|'.join(words)})($|{NOT_WORD})', '\\1 \\3', 'g')"
    return f"trim(regexp_replace({x}, '{W}+', ' ', 'g'), ' ')"


def norm_unicode_sql(x, words):
    return norm_sql(rf"regexp_replace({x}, '\p{{P}}', '', 'g')", words)


@query(
    "normalize_answer",
    f"""SELECT doc_id, CASE lang WHEN 'en' THEN {norm_unicode_sql('text', S.ARTICLES['en'])} WHEN 'es' THEN {norm_unicode_sql('text', S.ARTICLES['es'])}
    WHEN 'de' THEN {norm_unicode_sql('text', S.ARTICLES['de'])} ELSE {norm_unicode_sql('text', S.ARTICLES['fr'])} END AS norm FROM documents""",
)
def normalize_answer(spark, d):
    return table(spark, d, "documents").select(
        "doc_id", S.normalize_answer_by(F.col("text"), F.col("lang"), ["en", "es", "de", "fr"]).alias("norm")
    )


def overlap_sql(source):
    """CTEs that count the multiset overlap of the token lists p and g of ``source`` (key k)."""
    return f"""pt AS (SELECT k, t, count(*) AS c FROM (SELECT k, unnest(p) AS t FROM {source}) a GROUP BY k, t),
    gt AS (SELECT k, t, count(*) AS c FROM (SELECT k, unnest(g) AS t FROM {source}) b GROUP BY k, t),
    ov AS (SELECT pt.k, sum(least(pt.c, gt.c)) AS same FROM pt JOIN gt ON pt.k = gt.k AND pt.t = gt.t GROUP BY pt.k)"""


EN = S.ARTICLES["en"]
F1_SQL = f"""toks AS (SELECT doc_id AS k, list_filter(string_split({norm_sql('pred', EN)}, ' '), lambda x: x <> '') AS p,
  list_filter(string_split({norm_sql('gold', EN)}, ' '), lambda x: x <> '') AS g FROM pairs), {overlap_sql('toks')},
f1 AS (SELECT toks.k AS doc_id, coalesce(2.0 * same / (len(p) + len(g)), 0) AS f1 FROM toks LEFT JOIN ov ON toks.k = ov.k)"""


@query(
    "token_f1",
    f"{P_SQL}, {F1_SQL} SELECT doc_id, round(CAST(f1 AS DOUBLE), 6) AS f1 FROM f1",
)
def token_f1(spark, d):
    return pairs(spark, d).select("doc_id", r6(S.token_f1(F.col("pred"), F.col("gold"))).alias("f1"))


@query("answer_em", f"{P_SQL} SELECT doc_id, CAST({norm_sql('pred', EN)} = {norm_sql('gold', EN)} AS INT) AS em FROM pairs")
def answer_em(spark, d):
    return pairs(spark, d).select("doc_id", S.answer_em(F.col("pred"), F.col("gold")).alias("em"))


GOLD_F1 = f"""toks AS (SELECT doc_id * 10 + gi AS k, list_filter(string_split({norm_sql('pred', EN)}, ' '), lambda x: x <> '') AS p,
  list_filter(string_split({norm_sql('g', EN)}, ' '), lambda x: x <> '') AS g FROM golds), {overlap_sql('toks')},
f1 AS (SELECT CAST(toks.k // 10 AS BIGINT) AS doc_id, toks.k % 10 AS gi, CAST(coalesce(2.0 * same / (len(p) + len(g)), 0) AS DOUBLE) AS f1 FROM toks LEFT JOIN ov ON toks.k = ov.k)"""


@query("max_over_golds", f"WITH {GOLDS_SQL}, {GOLD_F1} SELECT doc_id, round(max(f1), 6) AS f1 FROM f1 GROUP BY doc_id")
def max_over_golds(spark, d):
    return pairs(spark, d).select("doc_id", r6(S.max_over_golds(golds(), lambda g: S.token_f1(F.col("pred"), g))).alias("f1"))


@query(
    "leave_one_out_f1",
    f"""WITH {GOLDS_SQL}, {GOLD_F1}, l AS (SELECT a.doc_id, a.gi, max(b.f1) AS f FROM f1 a JOIN f1 b ON a.doc_id = b.doc_id AND a.gi <> b.gi GROUP BY a.doc_id, a.gi)
    SELECT doc_id, round(avg(f), 6) AS f1 FROM l GROUP BY doc_id""",
)
def leave_one_out_f1(spark, d):
    scores = F.transform(golds(), lambda g: S.token_f1(F.col("pred"), g))
    return pairs(spark, d).select("doc_id", r6(S.leave_one_out(scores)).alias("f1"))


@query(
    "contains_score",
    f"{P_SQL} SELECT doc_id, CAST(contains(lower(gold), 'the of') OR contains(lower(gold), 'in the') OR contains(lower(gold), lower(task)) AS INT) AS contains FROM pairs",
)
def contains_score(spark, d):
    labels = F.array(F.lit("The of"), F.lit("IN the"), F.col("task"))
    return pairs(spark, d).select("doc_id", S.contains_score(F.col("gold"), labels).alias("contains"))


@query(
    "drop_em_f1",
    """WITH x AS (SELECT *, CAST(l_quantity AS INT) AS q, CAST(l_quantity AS INT) + l_linenumber % 2 AS shown, l_suppkey % 3 AS extra FROM lineitem),
    f AS (SELECT *, 5 + extra AS words FROM x),
    g AS (SELECT *, CASE WHEN shown = q THEN 2 * (5 / words) / (5 / words + 1) ELSE 0 END AS one, CASE WHEN shown = l_linenumber + 20 THEN 2 * (2 / words) / (2 / words + 1) ELSE 0 END AS two FROM f)
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(shown = q AND extra = 0 AS DOUBLE) AS em, CAST(round(greatest(one, two), 2) AS DOUBLE) AS f1 FROM g""",
)
def drop_em_f1(spark, d):
    """Odd lines name a wrong number: no credit, unless it is the number of the second gold; up to two words too many."""
    shown = (F.col("l_quantity") + F.col("l_linenumber") % 2).cast("int").cast("string")
    extra = F.element_at(F.array(F.lit(""), F.lit(" roughly"), F.lit(" roughly speaking")), (F.col("l_suppkey") % 3 + 1).cast("int"))
    pred = F.concat(shown, F.lit(" the items, by-line "), "l_linestatus", extra)
    gold = F.array(
        F.concat(F.col("l_quantity").cast("string"), F.lit(" items by line "), "l_linestatus"),
        F.concat((F.col("l_linenumber") + 20).cast("string"), F.lit(" items")),
    )
    rows = table(spark, d, "lineitem").withColumn("s", S.drop_em_f1(pred, gold))
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "s.em", "s.f1")


@query(
    "number_match_score",
    """WITH x AS (SELECT event_id, props, CAST(event_id % 100 AS VARCHAR) AS gold, regexp_extract_all(concat(props, ' ', CAST(event_id % 100 AS VARCHAR), ' of ', CAST(user_id AS VARCHAR)), '\\d+') AS n FROM events)
    SELECT event_id, round(len(list_filter(n, lambda v: v = gold)) / CAST(len(n) AS DOUBLE), 6) AS score FROM x""".replace("\\\\", "\\"),
)
def number_match_score(spark, d):
    gold = (F.col("event_id") % 100).cast("string")
    pred = F.concat("props", F.lit(" "), gold, F.lit(" of "), F.col("user_id").cast("string"))
    return table(spark, d, "events").select("event_id", r6(S.number_match(pred, gold)).alias("score"))


@query(
    "retrieval_score",
    r"""WITH x AS (SELECT event_id, CAST(user_id AS VARCHAR) AS gold, regexp_extract_all(concat(props, ' Paragraph ', CAST(user_id AS VARCHAR)), '\d+') AS n FROM events)
    SELECT event_id, round(len(list_filter(n, lambda v: v = gold)) / CAST(len(n) AS DOUBLE), 6) AS score FROM x""",
)
def retrieval_score(spark, d):
    named = F.concat(F.lit("Paragraph "), F.col("user_id").cast("string"))
    return table(spark, d, "events").select(
        "event_id", r6(S.retrieval(F.concat("props", F.lit(" "), named), named)).alias("score")
    )


@query(
    "class_mention_score",
    """WITH x AS (SELECT event_id, event_type AS gold, concat(event_type, ' or ', CASE WHEN user_id % 2 = 0 THEN 'view' ELSE 'signup' END) AS pred FROM events),
    y AS (SELECT *, list_filter(['click', 'view', 'signup', 'purchase', 'error'], lambda c: contains(pred, c)) AS m FROM x)
    SELECT event_id, CASE WHEN list_contains(m, gold) THEN round(CAST(1 AS DOUBLE) / len(m), 6) ELSE CAST(0 AS DOUBLE) END AS score FROM y""",
)
def class_mention_score(spark, d):
    pred = F.concat("event_type", F.lit(" or "), F.when(F.col("user_id") % 2 == 0, "view").otherwise("signup"))
    classes = ["click", "view", "signup", "purchase", "error"]
    return table(spark, d, "events").select("event_id", r6(S.class_mention(pred, F.col("event_type"), classes)).alias("score"))


REFS = ["the", "and", "eau", "ung"]


@query(
    "string_match_all",
    f"{P_SQL} SELECT doc_id, (CAST(contains(lower(gold), 'the') AS INT) + CAST(contains(lower(gold), 'and') AS INT) + CAST(contains(lower(gold), 'eau') AS INT) + CAST(contains(lower(gold), 'ung') AS INT)) / CAST(4 AS DOUBLE) AS score FROM pairs",
)
def string_match_all(spark, d):
    refs = F.array(*[F.lit(x) for x in REFS])
    return pairs(spark, d).select("doc_id", S.share_contained(F.col("gold"), refs).alias("score"))


@query(
    "string_match_part",
    f"""{P_SQL}, s AS (SELECT task, (CAST(contains(lower(gold), 'the') AS INT) + CAST(contains(lower(gold), 'and') AS INT) + CAST(contains(lower(gold), 'eau') AS INT) + CAST(contains(lower(gold), 'ung') AS INT)) / CAST(4 AS DOUBLE) AS score FROM pairs)
    SELECT task, max(score) AS score FROM s GROUP BY task""",
)
def string_match_part(spark, d):
    refs = F.array(*[F.lit(x) for x in REFS])
    return pairs(spark, d).groupBy("task").agg(F.max(S.share_contained(F.col("gold"), refs)).alias("score"))


def rouge_sql(n, key="doc_id", src="pairs", pred="pred", gold="gold"):
    tok = lambda x: f"regexp_extract_all(lower({x}), '[a-z0-9]+')"
    grams = lambda w: w if n == 1 else sql_ngrams(w, n)
    return f"""w AS (SELECT {key} AS k, {tok(pred)} AS pw, {tok(gold)} AS gw FROM {src}),
    toks AS (SELECT k, {grams('pw')} AS p, {grams('gw')} AS g FROM w), {overlap_sql('toks')},
    rg AS (SELECT toks.k, coalesce(same, 0) AS same, len(p) AS np, len(g) AS ng FROM toks LEFT JOIN ov ON toks.k = ov.k)"""


for _n in (1, 2):

    def _rouge(spark, d, n=_n):
        r = S.rouge_n(F.col("pred"), F.col("gold"), n)
        rows = pairs(spark, d).select("doc_id", r.alias("r"))
        return rows.select("doc_id", *[r6(F.col(f"r.{c}")).alias(c) for c in ("precision", "recall", "f")])

    query(
        f"rouge_{_n}",
        f"""{P_SQL}, {rouge_sql(_n)} SELECT k AS doc_id, round(CAST(same AS DOUBLE) / greatest(np, 1), 6) AS precision, round(CAST(same AS DOUBLE) / greatest(ng, 1), 6) AS recall,
        round(CASE WHEN same > 0 THEN CAST(2 * same AS DOUBLE) / (np + ng) ELSE 0 END, 6) AS f FROM rg""",
    )(_rouge)


# The table of longest common subsequences by anti-diagonals: cell i of step d belongs to i words of p and d - i words of g.
LCS_SQL = """w AS (SELECT doc_id, list_filter(regexp_split_to_array(pred, '{W}+'), lambda x: x <> '') AS p, list_filter(regexp_split_to_array(gold, '{W}+'), lambda x: x <> '') AS g FROM pairs),
t AS (SELECT *, len(p) AS np, len(g) AS ng FROM w),
lcs AS (SELECT doc_id, CAST(0 AS BIGINT) AS d, list_transform(range(np + 1), lambda i: 0) AS cur, list_transform(range(np + 1), lambda i: 0) AS prev FROM t
  UNION ALL SELECT l.doc_id, d + 1, list_transform(range(np + 1), lambda i: CASE WHEN i = 0 OR d + 1 - i < 1 OR d + 1 - i > ng THEN 0 WHEN p[i] = g[d + 1 - i] THEN prev[i] + 1 ELSE greatest(cur[i], cur[i + 1]) END), cur
  FROM lcs l JOIN t ON l.doc_id = t.doc_id WHERE d < np + ng)""".replace("{W}", W)


@query(
    "rouge_l",
    f"""{P_SQL.replace("WITH ", "WITH RECURSIVE ", 1)}, {LCS_SQL}
    SELECT t.doc_id, CASE WHEN np + ng > 0 THEN round(CAST(2 * cur[np + 1] AS DOUBLE) / (np + ng), 6) ELSE CAST(0 AS DOUBLE) END AS f FROM lcs JOIN t ON lcs.doc_id = t.doc_id WHERE d = np + ng""",
)
def rouge_l(spark, d):
    rows = pairs(spark, d).select("doc_id", T.words(F.col("pred")).alias("p"), T.words(F.col("gold")).alias("g"))
    return rows.select("doc_id", r6(S.rouge_l(F.col("p"), F.col("g"))).alias("f"))


@query(
    "reference_contrast",
    f"""{P_SQL}, refs AS (SELECT doc_id, pred, unnest([gold, lower(gold), reverse(gold), replace(gold, 'e', 'x')]) AS ref, unnest([0, 1, 2, 3]) AS ri FROM pairs),
    {rouge_sql(1, 'doc_id * 10 + ri', 'refs', 'pred', 'ref')},
    s AS (SELECT CAST(k // 10 AS BIGINT) AS doc_id, k % 10 AS ri, CASE WHEN same > 0 THEN CAST(2 * same AS DOUBLE) / (np + ng) ELSE 0 END AS f FROM rg),
    m AS (SELECT doc_id, max(CASE WHEN ri < 2 THEN f END) AS t, max(CASE WHEN ri >= 2 THEN f END) AS u FROM s GROUP BY doc_id)
    SELECT doc_id, round(t, 6) AS best, round(t - u, 6) AS diff, CAST(t > u AS INT) AS acc FROM m""",
)
def reference_contrast(spark, d):
    from evalweave.operators.metrics import reference_contrast as contrast

    true_refs = F.array("gold", F.lower("gold"))
    false_refs = F.array(F.reverse("gold"), F.replace(F.col("gold"), F.lit("e"), F.lit("x")))
    c = contrast(true_refs, false_refs, lambda ref: S.rouge_n(F.col("pred"), ref, 1)["f"])
    return pairs(spark, d).withColumn("c", c).select("doc_id", r6(F.col("c.best")).alias("best"), r6(F.col("c.diff")).alias("diff"), "c.acc")


@query("json_validity", "SELECT event_id, json_valid(CASE WHEN event_id % 3 = 0 THEN concat(props, '}') ELSE props END) AS valid FROM events")
def json_validity(spark, d):
    text = (
        F.when(F.col("event_id") % 3 == 0, F.concat("props", F.lit("}")))
        .when(F.col("event_id") % 3 == 1, F.concat(F.lit("```json\n"), "props", F.lit("\n```")))
        .otherwise(F.col("props"))
    )
    return table(spark, d, "events").select("event_id", S.json_valid(text).alias("valid"))


@query(
    "emotion_distance",
    """WITH x AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, [l_partkey % 11, l_suppkey % 11, l_linenumber % 11, l_orderkey % 11] AS a,
      [l_suppkey % 10, l_linenumber % 10, l_orderkey % 10, l_partkey % 10] AS b FROM lineitem),
    y AS (SELECT *, list_transform(range(1, 5), lambda i: abs(a[i] - b[i])) AS gaps FROM x),
    z AS (SELECT *, list_sum(list_transform(gaps, lambda g: CASE WHEN g = 0 THEN 0 WHEN g <= 5 THEN 6.5 / (1 + exp(-1.2 * (g - 4))) ELSE g END)) AS tally FROM y)
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN l_linenumber % 5 = 4 THEN CAST(0 AS DOUBLE) ELSE round(CAST((10 - tally * 0.7477) * 10 AS DOUBLE), 6) END AS score,
    CASE WHEN l_linenumber % 5 = 4 THEN 0 ELSE 100 END AS percent_parseable FROM z""",
)
def emotion_distance(spark, d):
    names = ["joy", "anger", "fear", "calm"]
    given = ["l_partkey", "l_suppkey", "l_linenumber", "l_orderkey"]
    wanted = ["l_suppkey", "l_linenumber", "l_orderkey", "l_partkey"]
    lines = [
        F.concat(F.lit(f"{n}: "), (F.col(c) % 11).cast("string"), F.lit("\n")) for n, c in zip(names, given)
    ]
    full = F.concat(F.lit("Scores\n"), *lines)
    response = F.when(F.col("l_linenumber") % 5 == 4, F.concat(*lines[:3])).otherwise(full)
    m = S.emotion_distance(
        response, F.array(*[F.lit(n) for n in names]), F.array(*[(F.col(c) % 10).cast("double") for c in wanted])
    )
    return table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", r6(m["score"]).alias("score"), m["percent_parseable"].alias("percent_parseable")
    )


@query("toxicity_flag", "SELECT d.doc_id, CAST(coalesce(l.toxic, 0) >= 0.5 AS INT) AS toxic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def toxicity_flag(spark, d):
    docs = table(spark, d, "documents").select("doc_id")
    rows = docs.join(table(spark, d, "labels").select("doc_id", "toxic"), "doc_id", "left")
    return rows.select("doc_id", S.toxicity_flag(F.col("toxic").cast("double")).alias("toxic"))


@query(
    "referent_match",
    f"""{P_SQL}, c AS (SELECT doc_id, doc_id % 2 = 0 AS label, list_filter(string_split(lower({strip_sql('pred')}), ' '), lambda w: w NOT IN ('the', 'of', 'le')) AS p,
      list_filter(string_split(lower({strip_sql('gold')}), ' '), lambda w: w NOT IN ('the', 'of', 'le')) AS g FROM pairs),
    f AS (SELECT *, contains(array_to_string(p, ' '), '''') <> contains(array_to_string(g, ' '), '''') AS apo FROM c)
    SELECT doc_id, CAST((NOT apo AND (list_has_all(g, p) OR list_has_all(p, g))) = label AS DOUBLE) AS acc FROM f""",
)
def referent_match(spark, d):
    return pairs(spark, d).select(
        "doc_id", S.referent_match(F.col("pred"), F.col("gold"), F.col("doc_id") % 2 == 0, ["the", "of", "le"]).alias("acc")
    )


@query("length_words", f"{P_SQL} SELECT doc_id, CAST(len(list_filter(regexp_split_to_array(translate(pred, '{PUNCT}', ''), '{W}+'), lambda w: w <> '')) AS INT) AS n_words FROM pairs")
def length_words(spark, d):
    return pairs(spark, d).select("doc_id", F.size(T.words(S.remove_punctuation(F.col("pred")))).alias("n_words"))


@query(
    "dict_answer_scores",
    """SELECT event_id, CASE event_id % 3 WHEN 2 THEN CAST(0 AS DOUBLE) ELSE CAST(1 AS DOUBLE) END AS type_score, CAST(user_id % 2 = 0 AS DOUBLE) AS user_score, CAST(event_id % 5 = 0 AS DOUBLE) AS missing_score FROM events""",
)
def dict_answer_scores(spark, d):
    e = F.col("event_id") % 3
    user = F.col("user_id").cast("string")
    pred = (
        F.when(e == 0, F.concat(F.lit('Sure: {"type": "'), F.upper("event_type"), F.lit('.", "user": "'), user, F.lit('"')))
        .when(e == 1, F.concat(F.lit("'type': '"), F.col("event_type"), F.lit("', 'user': '"), user, F.lit("'}")))
        .otherwise(F.concat(F.lit('{"user": "'), user, F.lit('", "type": "nothing"}')))
    )
    refs = F.array(
        F.struct(F.lit("type").alias("key"), F.array(F.col("event_type"), F.lit("other")).alias("alternatives")),
        F.struct(F.lit("user").alias("key"), F.array((F.col("user_id") + F.col("user_id") % 2).cast("string")).alias("alternatives")),
        # A key that no answer has reads as empty.
        F.struct(F.lit("missing").alias("key"), F.array(F.when(F.col("event_id") % 5 == 0, "").otherwise("x")).alias("alternatives")),
    )
    s = table(spark, d, "events").select("event_id", S.dict_answer_scores(pred, refs).alias("s"))
    return s.select(
        "event_id", *[F.get("s", F.lit(i))["score"].alias(n) for i, n in enumerate(["type_score", "user_score", "missing_score"])]
    )


@query(
    "weighted_synonym_precision",
    f"""{P_SQL}, w AS (SELECT doc_id, list_slice({sql_words('lower(gold)')}, 1, 10) AS w FROM pairs), x AS (SELECT doc_id, unnest(w) AS t FROM w),
    hit AS (SELECT doc_id, sum(CASE t WHEN 'the' THEN 4 WHEN 'of' THEN 3 WHEN 'and' THEN 2 WHEN 'le' THEN 1 ELSE 0 END) AS h FROM x GROUP BY doc_id)
    SELECT p.doc_id, round(coalesce(h, 0) / CAST(10 AS DOUBLE), 6) AS prec, CAST(len(w.w) > 0 AS INT) AS has_answer, 1 AS has_annotation
    FROM pairs p JOIN w ON p.doc_id = w.doc_id LEFT JOIN hit ON hit.doc_id = p.doc_id""",
)
def weighted_synonym_precision(spark, d):
    words = F.array(*[F.lit(w) for w in ["the", "of", "and", "le"]])
    freqs = F.array(*[F.lit(x) for x in [4, 3, 2, 1]])
    m = S.synonym_precision(T.words(F.lower("gold")), words, freqs)
    return pairs(spark, d).select("doc_id", r6(m["prec"]).alias("prec"), m["has_answer"].alias("has_answer"), m["has_annotation"].alias("has_annotation"))


ENTITY_SQL = """ent AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_partkey % 3 AS gt, l_suppkey % 3 AS ht, l_linenumber % 4 AS k,
  l_partkey % 2 = 0 AS hit FROM lineitem)"""


def entities(spark, d):
    """Gold has one entity (none for k = 3); predictions have 0 to 2."""
    kinds = F.array(F.lit("PER"), F.lit("LOC"), F.lit("ORG"))

    def ent(text, t):
        return F.struct(text.alias("text"), F.get(kinds, t.cast("int")).alias("type"))

    none = F.array().cast("array<struct<text:string,type:string>>")
    k = F.col("l_linenumber") % 4
    right = ent(F.col("l_linestatus"), F.col("l_partkey") % 3)
    wrong = ent(F.lit("?"), F.col("l_suppkey") % 3)
    gold = F.when(k == 3, none).otherwise(F.array(right))
    first = F.when(F.col("l_partkey") % 2 == 0, right).otherwise(wrong)
    pred = F.when(k == 0, none).when(k == 1, F.array(first)).when(k == 2, F.array(wrong, first)).otherwise(none)
    return table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", S.entity_label_pairs(pred, gold).alias("pairs")
    )


ENTITY_PAIRS = """lab AS (SELECT *, CASE k WHEN 0 THEN concat('3/', gt) WHEN 1 THEN concat(CASE WHEN hit THEN gt ELSE 3 END, '/', gt)
  WHEN 2 THEN concat(CASE WHEN hit THEN gt ELSE 0 END, '/', gt, ' 2/3') ELSE '3/3' END AS labels FROM ent)"""


@query(
    "entity_label_pairs",
    f"WITH {ENTITY_SQL}, {ENTITY_PAIRS} SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, labels FROM lab",
)
def entity_label_pairs(spark, d):
    text = F.array_join(F.transform("pairs", lambda p: F.concat(p["pred"].cast("string"), F.lit("/"), p["gold"].cast("string"))), " ")
    return entities(spark, d).withColumn("labels", text).drop("pairs")


# --- graded programs -------------------------------------------------------------


@query(
    "classify_verdict",
    f"""WITH {ATTEMPTS_SQL}, n AS (SELECT *, problem_id * 16 + attempt_idx AS n FROM attempts)
    SELECT problem_id, attempt_idx, coalesce(CASE n % 11 WHEN 0 THEN 'FE' END, CASE n % 7 WHEN 0 THEN 'CE' END, CASE n % 5 WHEN 0 THEN 'TLE' END,
    CASE n % 4 WHEN 0 THEN 'MLE' END, CASE n % 3 WHEN 0 THEN 'RE' END, CASE WHEN status <> 'AC' THEN 'WA' END, 'AC') AS verdict FROM n""",
)
def classify_verdict(spark, d):
    """Outcomes overlap, so their precedence decides."""
    n = F.col("problem_id") * 16 + F.col("attempt_idx")
    verdict = S.classify_verdict(n % 11 != 0, n % 7 == 0, n % 5 == 0, n % 4 == 0, n % 3 == 0, F.col("status") == "AC")
    return attempts(spark, d).select("problem_id", "attempt_idx", verdict.alias("verdict"))


@query(
    "compare_outputs",
    f"""{P_SQL} SELECT doc_id, replace({strip_sql('pred')}, chr(10), '') = replace({strip_sql('gold')}, chr(13) || chr(10), '') AS same_reference,
    replace(replace({strip_sql('pred')}, chr(10), ''), chr(13), '') = translate({strip_sql('gold')}, chr(13) || chr(10), '') AS same_normalized FROM pairs""",
)
def compare_outputs(spark, d):
    p, g = F.col("pred"), F.col("gold")
    return pairs(spark, d).select(
        "doc_id", S.compare_outputs(p, g, "reference").alias("same_reference"), S.compare_outputs(p, g).alias("same_normalized")
    )


@query(
    "scale_limits",
    """SELECT event_id, CASE WHEN event_id % 3 = 0 THEN user_id ELSE 1 END * CAST(2.5 AS DOUBLE) AS time_limit, CASE WHEN event_id % 3 = 0 THEN user_id ELSE 1 END * 256 AS memory_limit FROM events""",
)
def scale_limits(spark, d):
    text = F.when(F.col("event_id") % 3 == 0, F.concat(F.col("user_id").cast("string"), F.lit("\n1 2 3"))).otherwise(F.col("props"))
    return table(spark, d, "events").select(
        "event_id", S.scale_limit(F.lit(2.5), text).alias("time_limit"), S.scale_limit(F.lit(256), text).alias("memory_limit")
    )


@query(
    "attempt_acceptance",
    f"""WITH {TESTS_SQL} SELECT problem_id, attempt_idx, bool_and(status = 'AC') AS accepted, string_agg(CASE WHEN status <> 'AC' THEN status END, ', ' ORDER BY test_idx) AS failure_reasons,
    count(*) AS n_tests FROM tests GROUP BY problem_id, attempt_idx""",
)
def attempt_acceptance(spark, d):
    from evalweave.operators.analytics import attempt_acceptance as accept

    return accept(tests(spark, d))


@query(
    "main_failure_reason",
    f"""WITH {TESTS_SQL}, f AS (SELECT problem_id, attempt_idx, min(CASE status WHEN 'FE' THEN 1 WHEN 'CE' THEN 2 WHEN 'RE' THEN 3 WHEN 'MLE' THEN 4 WHEN 'TLE' THEN 5 WHEN 'WA' THEN 6 END) AS p
      FROM tests WHERE status <> 'AC' GROUP BY problem_id, attempt_idx)
    SELECT problem_id, attempt_idx, ['FE', 'CE', 'RE', 'MLE', 'TLE', 'WA'][p] AS reason FROM f""",
)
def main_failure_reason(spark, d):
    from evalweave.operators.analytics import attempt_acceptance as accept

    failed = accept(tests(spark, d)).where(~F.col("accepted"))
    return failed.select("problem_id", "attempt_idx", S.main_failure(F.split("failure_reasons", ", ")).alias("reason"))
