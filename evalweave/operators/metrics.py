"""Aggregated metrics, standard errors and task groups."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalweave.functions import scoring as S
from evalweave.functions import text as T
from evalweave.functions.arrays import let2
from evalweave.operators.broadcasts import spread
from evalweave.operators.ranks import with_group_position, with_running_totals

# --- aggregate expressions -----------------------------------------------------


def mean(value: Column) -> Column:
    return F.avg(value)


def nanmean(value: Column) -> Column:
    """Mean of the values that are not NaN; NaN if there are none."""
    return F.coalesce(F.avg(F.nanvl(value, F.lit(None).cast("double"))), F.lit(float("nan")))


def perplexity(ll: Column) -> Column:
    return F.exp(-F.avg(ll))


def weighted_perplexity(ll: Column, weight: Column) -> Column:
    return F.exp(-F.sum(ll) / F.sum(weight))


def bits_per_byte(ll: Column, n_bytes: Column) -> Column:
    return -F.sum(ll) / F.sum(n_bytes) / math.log(2)


def stderr_mean(value: Column) -> Column:
    return F.stddev_samp(value) / F.sqrt(F.count(value))


def middle_element(df: DataFrame, group: list[str], order: str, value: str) -> DataFrame:
    """The element at position n div 2 in input order (the values are not sorted)."""
    numbered = with_group_position(df.select(*group, order, value), group, [F.col(order)], "_pos")
    sizes = df.groupBy(*group).agg(F.count(F.lit(1)).alias("n"))
    return (
        numbered.join(sizes, group)
        .where(F.col("_pos") == F.floor(F.col("n") / 2))
        .select(*group, F.col(value).alias("middle"), "n")
    )


# --- classification metrics from one confusion matrix --------------------------


def confusion(df: DataFrame, group: list[str], gold: str, pred: str) -> DataFrame:
    """Counts per (gold, pred): all class metrics need only these few rows."""
    return df.groupBy(*group, F.col(gold).alias("gold"), F.col(pred).alias("pred")).agg(
        F.count(F.lit(1)).alias("n")
    )


def class_counts(cells: DataFrame, group: list[str]) -> DataFrame:
    """Per class: true positives, gold count (support) and predicted count, with F1."""
    sides = F.array(
        F.struct(F.col("gold").alias("cls"), F.col("n").alias("support"), F.lit(0).cast("bigint").alias("predicted")),
        F.struct(F.col("pred").alias("cls"), F.lit(0).cast("bigint").alias("support"), F.col("n").alias("predicted")),
    )
    return (
        cells.select(*group, "gold", "pred", "n", F.posexplode(sides).alias("side", "x"))
        .groupBy(*group, F.col("x.cls").alias("cls"))
        .agg(
            F.sum("x.support").alias("support"),
            F.sum("x.predicted").alias("predicted"),
            F.coalesce(
                F.sum(F.when((F.col("gold") == F.col("pred")) & (F.col("side") == 0), F.col("n"))), F.lit(0)
            ).alias("tp"),
        )
        .withColumn("f1", 2.0 * F.col("tp") / (F.col("support") + F.col("predicted")))
    )


def f1_scores(df: DataFrame, group: list[str], gold: str, pred: str, positive=1, classes: list | None = None) -> DataFrame:
    """binary, macro, weighted and micro F1, and the mean over a chosen subset of classes."""
    per_class = class_counts(confusion(df, group, gold, pred), group)
    chosen = F.col("cls").isin(classes) if classes is not None else F.lit(True)
    return per_class.groupBy(*group).agg(
        F.coalesce(F.max(F.when(F.col("cls") == positive, F.col("f1"))), F.lit(0.0)).alias("f1"),
        F.avg("f1").alias("f1_macro"),
        (F.sum(F.col("f1") * F.col("support")) / F.sum("support")).alias("f1_weighted"),
        (2.0 * F.sum("tp") / F.sum(F.col("support") + F.col("predicted"))).alias("f1_micro"),
        F.avg(F.when(chosen, F.col("f1"))).alias("f1_classes"),
    )


def matthews(df: DataFrame, group: list[str], gold: str, pred: str) -> DataFrame:
    """Multi-class Matthews correlation; 0 when undefined."""
    per_class = class_counts(confusion(df, group, gold, pred), group)
    sums = per_class.groupBy(*group).agg(
        F.sum("tp").cast("double").alias("c"),
        F.sum("support").cast("double").alias("s"),
        F.sum(F.col("support") * F.col("predicted")).cast("double").alias("tp_sum"),
        F.sum(F.col("support") * F.col("support")).cast("double").alias("tt"),
        F.sum(F.col("predicted") * F.col("predicted")).cast("double").alias("pp"),
    )
    s2 = F.col("s") * F.col("s")
    below = F.sqrt((s2 - F.col("pp")) * (s2 - F.col("tt")))
    return sums.select(
        *group, F.when(below > 0, (F.col("c") * F.col("s") - F.col("tp_sum")) / below).otherwise(0.0).alias("mcc")
    )


def two_label_sentiment_f1(df: DataFrame, gold: str, pred: str) -> DataFrame:
    """Four sentiment classes read as two yes/no labels (positive, negative); F1 averaged over both.

    Class 0 is positive, 1 negative, 2 neither, 3 both; a label value nobody has scores 0.
    """
    # The four by four confusion first; the two binary ones are sums of its cells.
    cells = confusion(df, [], gold, pred).select(
        F.explode(
            F.transform(
                F.array(
                    F.struct(F.lit("opos").alias("label"), F.array(F.lit(0), F.lit(3)).alias("members")),
                    F.struct(F.lit("oneg").alias("label"), F.array(F.lit(1), F.lit(3)).alias("members")),
                ),
                lambda x: F.struct(
                    x["label"].alias("label"),
                    F.array_contains(x["members"], F.col("gold")).cast("int").alias("gold"),
                    F.array_contains(x["members"], F.col("pred")).cast("int").alias("pred"),
                    F.col("n").alias("n"),
                ),
            )
        ).alias("c")
    )
    binary = cells.groupBy("c.label", "c.gold", "c.pred").agg(F.sum("c.n").alias("n"))
    per_class = class_counts(binary, ["label"])
    per_label = per_class.groupBy("label").agg((F.sum("f1") / 2).alias("f1"))
    return per_label.agg(F.avg("f1").alias("f1"))


def entity_macro_f1(pairs: DataFrame, gold: str = "gold", pred: str = "pred") -> DataFrame:
    """Mean F1 over the classes but the last (largest) one."""
    per_class = class_counts(confusion(pairs, [], gold, pred), [])
    last = per_class.agg(F.max("cls"))
    return per_class.where(F.col("cls") < last.scalar()).agg(F.avg("f1").alias("f1"))


# --- corpus text metrics --------------------------------------------------------


def _token_stats(df: DataFrame, group: list[str], pred_tokens: Column, gold_tokens: Column) -> DataFrame:
    """Per-row n-gram statistics; small inputs are spread over the cores first."""
    tokens = spread(df).select(*group, pred_tokens.alias("_p"), gold_tokens.alias("_g"))
    return tokens.select(*group, *S.ngram_stats("_p", "_g"))


def corpus_bleu(df: DataFrame, group: list[str], pred: Column, gold: Column) -> DataFrame:
    """Corpus BLEU-4: clipped counts per row, one sum per group, then the closed form.

    Zero matches are smoothed by halving (exponential smoothing); no candidate
    n-gram of some order gives 0.
    """
    rows = _token_stats(df, group, S.mt_tokens(pred), S.mt_tokens(gold))
    names = [f"c{n}" for n in range(1, 5)] + ["p_len", "g_len"]
    sums = rows.groupBy(*group).agg(
        *[F.sum(F.get("m", F.lit(n - 1))).alias(f"m{n}") for n in range(1, 5)], *[F.sum(n).alias(n) for n in names]
    )
    return sums.select(*group, bleu_of({n: F.col(n) for n in sums.columns}).alias("bleu"))


def bleu_of(s: dict[str, Column]) -> Column:
    """BLEU-4 of summed m1..m4, c1..c4, p_len and g_len. Zero matches are smoothed by halving."""
    log_sum, smooth, zero = F.lit(0.0), F.lit(1.0), F.lit(False)
    for n in range(1, 5):
        m, c = s[f"m{n}"], s[f"c{n}"]
        smooth = F.when(m == 0, smooth * 2).otherwise(smooth)
        precision = F.when(m == 0, 100.0 / (smooth * F.greatest(c, F.lit(1)))).otherwise(100.0 * m / F.greatest(c, F.lit(1)))
        log_sum = log_sum + F.log(precision)
        zero = zero | (c == 0)
    penalty = F.when(s["p_len"] < s["g_len"], F.exp(1 - F.try_divide(s["g_len"], s["p_len"]))).otherwise(1.0)
    return F.when(zero | (s["m1"] == 0), 0.0).otherwise(penalty * F.exp(log_sum / 4))


def smoothed_bleu4(df: DataFrame, group: list[str], pred: Column, gold: Column) -> DataFrame:
    """Mean of sentence BLEU-4 with add-one smoothing, times 100."""
    rows = _token_stats(df, group, S.code_tokens(pred), S.code_tokens(gold))
    return rows.groupBy(*group).agg((100.0 * F.avg(S.smoothed_bleu())).alias("bleu"))


def corpus_chrf(df: DataFrame, group: list[str], pred: Column, gold: Column, beta: int = 2) -> DataFrame:
    """Corpus chrF: character n-grams up to order 6, whitespace removed."""
    bare = spread(df).select(
        *group,
        F.regexp_replace(pred, f"{T.WS}+", "").alias("_p"),
        F.regexp_replace(gold, f"{T.WS}+", "").alias("_g"),
    )
    terms = chrf_terms(F.length("_p"), F.length("_g"), F.col("_m"))
    sums = bare.withColumn("_m", S.char_matches(F.col("_p"), F.col("_g"))).groupBy(*group).agg(*[F.sum(c).alias(n) for n, c in terms.items()])
    return sums.select(*group, chrf_of({n: F.col(n) for n in terms}, beta).alias("chrf"))


# Fixed value: longest character n-gram of chrF.
CHRF_ORDER = 6


def chrf_terms(pred_length: Column, gold_length: Column, matches: Column) -> dict[str, Column]:
    """Per sample and order: n-grams of the prediction (if the reference has any), of the reference, and clipped matches."""
    terms = {}
    for n in range(1, CHRF_ORDER + 1):
        ref, hyp = F.greatest(gold_length - (n - 1), F.lit(0)), F.greatest(pred_length - (n - 1), F.lit(0))
        terms |= {f"h{n}": F.when(ref > 0, hyp).otherwise(0), f"r{n}": ref, f"m{n}": F.get(matches, F.lit(n - 1))}
    return terms


def chrf_of(s: dict[str, Column], beta: int = 2) -> Column:
    """chrF of the summed terms: mean precision and recall over the orders that both sides have."""
    orders, precision, recall = F.lit(0), F.lit(0.0), F.lit(0.0)
    for n in range(1, CHRF_ORDER + 1):
        h, r, m = s[f"h{n}"], s[f"r{n}"], s[f"m{n}"]
        used = (h > 0) & (r > 0)
        orders = orders + used.cast("int")
        precision = precision + F.when(used, F.try_divide(m, h)).otherwise(0.0)
        recall = recall + F.when(used, F.try_divide(m, r)).otherwise(0.0)
    p, r = precision / F.greatest(orders, F.lit(1)), recall / F.greatest(orders, F.lit(1))
    b2 = beta * beta
    return F.when(p + r > 0, 100.0 * (1 + b2) * p * r / (b2 * p + r)).otherwise(0.0)


# --- grouped items ----------------------------------------------------------------


def group_em(df: DataFrame, keys: list[str], correct: Column) -> DataFrame:
    """Per key whether every member is right."""
    return df.groupBy(*keys).agg(F.bool_and(correct).cast("int").alias("em"))


def acc_all(df: DataFrame, paragraph: str, question: str, correct: Column) -> DataFrame:
    """Share of (paragraph, question) groups that are right throughout; the stderr groups by question only."""
    acc = group_em(df, [paragraph, question], correct).agg(F.avg("em").alias("acc_all"))
    err = group_em(df, [question], correct).agg(stderr_mean(F.col("em")).alias("stderr"))
    return acc.select("acc_all", err.scalar().alias("stderr"))


# --- standard errors ----------------------------------------------------------------

# Metrics whose stderr is bootstrapped; text metrics use at most 100 resamples.
BOOTSTRAPPED = ["median", "mcc", "f1", "perplexity", "bleu", "chrf", "nanmean"]
TEXT_METRICS = ["bleu", "chrf"]


def stderr_plan(metric: str, iters: int) -> tuple[str | None, int]:
    """How a metric gets its stderr: ("closed" | "bootstrap" | None, resamples)."""
    if iters <= 0:
        return None, 0
    if metric in BOOTSTRAPPED:
        return "bootstrap", min(iters, 100) if metric in TEXT_METRICS else iters
    return ("closed", 0) if metric in ("mean", "acc_all") else (None, 0)


def pooled_stderr(stderr: Column, n: Column) -> Column:
    """Pooled over subtasks; null if any is null."""
    pooled = F.sum((n - 1) * stderr * stderr * n) / (F.sum(n) - F.count(F.lit(1)))
    return F.when(F.count(stderr) == F.count(F.lit(1)), F.sqrt(pooled / F.sum(n)))


def combined_stderr(tasks: DataFrame, group: list[str], order: str) -> DataFrame:
    """Sequential pairwise variance with mean shift over the subtasks of a group (few), in name order."""
    items = tasks.groupBy(*group).agg(F.sort_array(F.collect_list(F.struct(order, "n", "mean", "stderr"))).alias("t"))
    first = F.get("t", F.lit(0))
    size = first["n"].cast("double")
    start = F.struct((first["stderr"] * first["stderr"]).alias("var"), first["mean"].alias("score"))

    def step(acc: Column, x: Column) -> Column:
        n = x["n"].cast("double")
        score = (acc["score"] * size + x["mean"] * n) / (size + n)
        shift = score - x["mean"]
        var = ((size - 1) * acc["var"] + (n - 1) * x["stderr"] * x["stderr"]) / (size + n - 1) + size * n / (
            (size + n) * (size + n - 1)
        ) * shift * shift
        return F.struct(var.alias("var"), score.alias("score"))

    rest = F.slice("t", F.lit(2), F.size("t"))
    return items.select(*group, F.sqrt(F.aggregate(rest, start, step)["var"]).alias("stderr"))


def group_mean(value: Column, n: Column, weight_by_size: bool = True) -> Column:
    return F.sum(value * n) / F.sum(n) if weight_by_size else F.avg(value)


def leaf_pairs(tree: dict[str, list[str]]) -> list[tuple[str, str]]:
    """(group, leaf task) pairs of a nested group configuration."""

    def leaves(name: str) -> list[str]:
        return [x for child in tree[name] for x in (leaves(child) if child in tree else [child])]

    return [(g, t) for g in tree for t in leaves(g)]


def group_rollup(results: DataFrame, tree: dict[str, list[str]], weight_by_size: bool = True) -> DataFrame:
    """Group metric, pooled stderr and size per (group, metric, filter); groups may nest.

    ``results``: task, metric, filter, value, stderr, n. The tree is driver-side
    configuration, its closure is broadcast.
    """
    pairs = results.sparkSession.createDataFrame(leaf_pairs(tree), "grp string, task string")
    return (
        results.join(F.broadcast(pairs), "task")
        .groupBy("grp", "metric", "filter")
        .agg(
            group_mean(F.col("value"), F.col("n"), weight_by_size).alias("value"),
            pooled_stderr(F.col("stderr"), F.col("n")).alias("stderr"),
            F.sum("n").alias("n"),
        )
    )


def consolidate_results(results: DataFrame, metrics: list[str], aliases: dict[str, str] | None = None) -> DataFrame:
    """One row per task: alias, samples, and value and stderr of the named metrics."""
    alias = F.col("task")
    if aliases:
        table = F.create_map(*[F.lit(x) for kv in aliases.items() for x in kv])
        alias = F.coalesce(F.try_element_at(table, F.col("task")), F.col("task"))
    cells = []
    for m in metrics:
        hit = F.col("metric") == m
        cells += [F.max(F.when(hit, F.col("value"))).alias(m), F.max(F.when(hit, F.col("stderr"))).alias(f"{m}_stderr")]
    return results.groupBy("task").agg(F.max("n").alias("samples"), *cells).withColumn("alias", alias)


def sample_counts(docs: DataFrame, task: str, limit: int | None = None) -> DataFrame:
    n = F.count(F.lit(1))
    return docs.groupBy(task).agg(
        n.alias("original"), (F.least(F.lit(limit).cast("bigint"), n) if limit is not None else n).alias("effective")
    )


def higher_is_better(tasks: DataFrame, group: list[str], flag: str) -> DataFrame:
    """The common flag of the subtasks, null if they disagree or one has none."""
    same = (F.min(flag) == F.max(flag)) & (F.count(flag) == F.count(F.lit(1)))
    return tasks.groupBy(*group).agg(F.when(same, F.min(flag)).alias(flag))


def micro_partial_credit(df: DataFrame, group: list[str], score: Column, parts: Column) -> DataFrame:
    return df.groupBy(*group).agg((F.sum(score) / F.sum(parts)).alias("value"))


def group_difference(tasks: DataFrame, group: list[str], task: str, value: str, first: Column, second: Column) -> DataFrame:
    """Metric of one subtask minus that of another, per group."""
    return tasks.groupBy(*group).agg(
        (F.max(F.when(first, F.col(value))) - F.max(F.when(second, F.col(value)))).alias("difference")
    )


# --- bias and robustness --------------------------------------------------------------


def bbq_flags(answers: DataFrame) -> DataFrame:
    """Long rows (doc, category, acc, biased, non_unk, disambig) from chosen option indices."""

    def member(options: str) -> Column:
        return F.array_contains(options, F.col("answer"))

    return answers.select(
        "doc_id",
        "category",
        member("targets").cast("double").alias("acc"),
        member("biased_options").cast("double").alias("biased"),
        (~member("unknown_options")).cast("double").alias("non_unk"),
        "disambig",
    )


def bbq_bias(flags: DataFrame) -> DataFrame:
    """Accuracy and bias scores by context, overall (null category) and per category."""

    def side(when: Column):
        acc = F.avg(F.when(when, F.col("acc")))
        biased, known = F.sum(F.when(when, F.col("biased"))), F.sum(F.when(when, F.col("non_unk")))
        score = F.when(biased == 0, 0.0).when(biased.isNotNull(), 2.0 * biased / F.nullif(known, F.lit(0.0)) - 1)
        return acc, score

    acc_d, dis = side(F.col("disambig"))
    acc_a, amb = side(~F.col("disambig"))
    return flags.rollup("category").agg(
        acc_a.alias("accuracy_amb"),
        acc_d.alias("accuracy_disamb"),
        ((1 - acc_a) * amb).alias("amb_bias_score"),
        dis.alias("disamb_bias_score"),
    )


def consistency_rate(df: DataFrame, question: list[str], answer: Column, group: list[str] | None = None) -> DataFrame:
    """Share of equal pairs among the answers to a question, pooled; from counts, without forming pairs."""
    group = group or []
    counts = df.groupBy(*group, *question, answer.alias("_a")).agg(F.count(F.lit(1)).alias("c"))
    per_q = counts.groupBy(*group, *question).agg(
        F.sum(F.col("c") * (F.col("c") - 1) / 2).alias("equal"), F.sum("c").alias("n")
    )
    pairs = F.sum(F.col("n") * (F.col("n") - 1) / 2)
    return per_q.groupBy(*group).agg(
        F.when(pairs > 0, F.sum("equal") / pairs).otherwise(0.0).alias("consistency_rate")
    )


def map_swapped_option(answer: Column, original: Column, forced: Column) -> Column:
    """The original or the forced option both count as the original label."""
    return F.when((answer == original) | (answer == forced), original).otherwise(answer)


def accuracy_by(df: DataFrame, keys: list[str], correct: Column) -> DataFrame:
    return df.groupBy(*keys).agg(F.round(F.avg(correct.cast("int")), 4).alias("accuracy"))


def multi_seed_summary(df: DataFrame, question: list[str], seeds: list, answer: str, correct: Column) -> DataFrame:
    """Per-seed accuracy and cross-seed consistency over the questions every seed answered.

    ``df`` has a ``seed`` column and one answer per (question, seed).
    """
    complete = (
        df.where(F.col("seed").isin(seeds)).groupBy(*question).agg(F.countDistinct("seed").alias("_s")).where(
            F.col("_s") == len(seeds)
        )
    )
    kept = df.where(F.col("seed").isin(seeds)).join(complete.select(*question), question, "left_semi")
    accuracy = kept.groupBy("seed").agg(F.avg(correct.cast("int")).alias("accuracy"))
    rate = consistency_rate(kept, question, F.col(answer))
    return accuracy.withColumn("consistency_rate", rate.scalar())


def length_bucket_score(df: DataFrame, length: str, score: Column) -> DataFrame:
    return df.groupBy(length).agg(F.avg(score).alias("score"), F.count(F.lit(1)).alias("n"))


def lexical_prf(df: DataFrame, prec: str, answered: str, annotated: str) -> DataFrame:
    total = F.sum(prec)
    p = total / F.greatest(F.sum(answered), F.lit(1))
    r = total / F.greatest(F.sum(annotated), F.lit(1))
    return df.agg(p.alias("precision"), r.alias("recall")).withColumn(
        "f1",
        F.when(F.col("precision") + F.col("recall") != 0, 2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))).otherwise(0.0),
    )


def reference_contrast(true_refs: Column, false_refs: Column, score) -> Column:
    """Struct: best score over true references, its lead over the best false one, and whether it leads."""
    best = F.array_max(F.transform(true_refs, score))
    worst = F.array_max(F.transform(false_refs, score))
    return let2(
        best,
        worst,
        lambda t, f: F.struct(t.alias("best"), (t - f).alias("diff"), (t > f).cast("int").alias("acc")),
    )


def squad_v2_scores(df: DataFrame, id_col: str) -> DataFrame:
    """exact and F1 overall, with and without answer, and the best over no-answer thresholds, in percent.

    ``df``: exact, f1 (scores as answered), has_answer, pred_empty, p_na. The
    threshold search walks all questions by no-answer probability; the running
    sum is taken by slices, not in one task.
    """
    base = df.agg(
        (100 * F.avg("exact")).alias("exact"),
        (100 * F.avg("f1")).alias("f1"),
        (100 * F.avg(F.when(F.col("has_answer"), F.col("exact")))).alias("HasAns_exact"),
        (100 * F.avg(F.when(F.col("has_answer"), F.col("f1")))).alias("HasAns_f1"),
        (100 * F.avg(F.when(~F.col("has_answer"), F.col("exact")))).alias("NoAns_exact"),
        (100 * F.avg(F.when(~F.col("has_answer"), F.col("f1")))).alias("NoAns_f1"),
        F.count(F.lit(1)).alias("total"),
        F.count_if(~F.col("has_answer")).alias("_no"),
    )
    # Answering one more question gains its score, or loses the point for a right refusal.
    step = F.when(F.col("pred_empty"), 0.0).otherwise(-1.0)
    narrow = df.select(
        id_col,
        "p_na",
        F.when(F.col("has_answer"), F.col("exact")).otherwise(step).cast("double").alias("d_exact"),
        F.when(F.col("has_answer"), F.col("f1")).otherwise(step).cast("double").alias("d_f1"),
    )
    keys = [F.col("p_na"), F.col(id_col)]
    runs = with_running_totals(narrow, keys, {"d_exact": "run_exact", "d_f1": "run_f1"})
    best = runs.agg(F.max("run_exact").alias("run_exact"), F.max("run_f1").alias("run_f1"))  # one row
    return base.crossJoin(F.broadcast(best)).select(
        "exact", "f1", "HasAns_exact", "HasAns_f1", "NoAns_exact", "NoAns_f1", "total",
        (100 * (F.col("_no") + F.greatest("run_exact", F.lit(0.0))) / F.col("total")).alias("best_exact"),
        (100 * (F.col("_no") + F.greatest("run_f1", F.lit(0.0))) / F.col("total")).alias("best_f1"),
    )
