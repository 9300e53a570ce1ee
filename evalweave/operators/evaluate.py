"""Metrics, aggregations and filters by name, and the chain from responses to grouped results.

The aggregation of nearly every metric is a function of a few weighted sums over the samples (matches and lengths for corpus
BLEU and chrF). So all of them come from one aggregation of the scored samples, and a resample only changes the weights. The two
that are not, the middle element and the share of groups that are right throughout, read the scored samples in their own way.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalweave.functions import scoring as S
from evalweave.functions import text as T
from evalweave.operators.filters import FILTERS, Step, filter_chain
from evalweave.operators.metrics import bleu_of, chrf_of, chrf_terms, group_em, group_rollup, stderr_mean, stderr_plan
from evalweave.operators.ranks import with_group_position
from evalweave.session import cut_lineage

Sums = dict[str, Column]


@dataclass(frozen=True)
class Aggregation:
    """``terms`` are per-sample columns to be summed, ``value`` turns their weighted sums and ``weight`` into the metric.

    ``terms`` gets the name of the score column and returns name -> column; a null term does not count.
    """

    terms: Callable[[str], Sums] = field(default=lambda c: {"x": F.col(c)})
    value: Callable[[Sums], Column] = field(default=lambda s: F.try_divide(s["x"], s["weight"]))


def _valid(c: str) -> Sums:
    there = F.nanvl(F.col(c), F.lit(None).cast("double"))
    return {"x": F.coalesce(there, F.lit(0.0)), "n": there.isNotNull().cast("double")}


def _binary(c: str) -> Sums:
    """Cells of the two-by-two table; ``c`` is a struct of gold and pred, 1 is the positive class."""
    gold, pred = F.col(c)["gold"] == 1, F.col(c)["pred"] == 1
    return {
        "tp": (gold & pred).cast("double"),
        "fp": (~gold & pred).cast("double"),
        "fn": (gold & ~pred).cast("double"),
        "tn": (~gold & ~pred).cast("double"),
    }


def _f1(s: Sums) -> Column:
    below = 2 * s["tp"] + s["fp"] + s["fn"]
    return F.when(below > 0, 2 * s["tp"] / below).otherwise(0.0)


def _mcc(s: Sums) -> Column:
    below = (s["tp"] + s["fp"]) * (s["tp"] + s["fn"]) * (s["tn"] + s["fp"]) * (s["tn"] + s["fn"])
    return F.when(below > 0, (s["tp"] * s["tn"] - s["fp"] * s["fn"]) / F.sqrt(below)).otherwise(0.0)


def _weighted(c: str) -> Sums:
    return {"x": F.col(c)["ll"], "k": F.col(c)["weight"]}


def _bleu(c: str) -> Sums:
    """``c`` is a struct of the texts pred and gold."""
    pred, gold = (S.mt_tokens(F.col(c)[side]) for side in ("pred", "gold"))
    matches = S.token_matches(pred, gold)
    lengths = {f"c{n}": F.greatest(F.size(pred) - (n - 1), F.lit(0)) for n in range(1, 5)}
    return {f"m{n}": F.get(matches, F.lit(n - 1)) for n in range(1, 5)} | lengths | {"p_len": F.size(pred), "g_len": F.size(gold)}


def _chrf(c: str) -> Sums:
    pred, gold = (F.regexp_replace(F.col(c)[side], f"{T.WS}+", "") for side in ("pred", "gold"))
    return chrf_terms(F.length(pred), F.length(gold), S.char_matches(pred, gold))


@dataclass(frozen=True)
class Whole:
    """An aggregation that is no function of sums: ``results(df, group, column, draws, seed)`` gives (group, value, stderr)."""

    results: Callable[[DataFrame, list[str], str, int, int], DataFrame]


def _middle(df: DataFrame, group: list[str], c: str, draws: int, seed: int) -> DataFrame:
    """The sample in the middle of the input order; ``c`` is a struct of order (unique in a group) and value.

    In the middle of a resample with replacement stands any sample, all with one chance. So a resample draws one position, and
    the error is the spread of the samples at ``draws`` positions.
    """
    rows = df.select(*group, F.col(c)["order"].alias("_order"), F.col(c)["value"].cast("double").alias("_value"))
    sizes = rows.groupBy(*group).agg(F.count(F.lit(1)).alias("_n"))
    drawn = F.floor(uniform(seed, F.lit("middle"), *[F.col(g) for g in group], F.col("_draw")) * F.col("_n"))
    wanted = sizes.withColumn("_draw", F.explode(F.sequence(F.lit(-1), F.lit(draws - 1)))).select(
        *group, "_draw", F.when(F.col("_draw") < 0, F.floor(F.col("_n") / 2)).otherwise(drawn).alias("_pos")
    )
    numbered = with_group_position(rows, group, [F.col("_order")], "_pos")
    found = numbered.join(wanted, [*group, "_pos"])
    return found.groupBy(*group).agg(
        F.max(F.when(F.col("_draw") < 0, F.col("_value"))).alias("value"),
        F.stddev_samp(F.when(F.col("_draw") >= 0, F.col("_value"))).alias("stderr"),
    )


def _right_throughout(df: DataFrame, group: list[str], c: str, draws: int, seed: int) -> DataFrame:
    """Share of (paragraph, question) groups that are right throughout; the error is that of the groups by question only.
    ``c`` is a struct of paragraph, question and correct."""
    rows = df.select(*group, F.col(c)["paragraph"].alias("_p"), F.col(c)["question"].alias("_q"), F.col(c)["correct"].cast("boolean").alias("_ok"))
    value = group_em(rows, [*group, "_p", "_q"], F.col("_ok")).groupBy(*group).agg(F.avg("em").alias("value"))
    error = group_em(rows, [*group, "_q"], F.col("_ok")).groupBy(*group).agg(stderr_mean(F.col("em")).alias("stderr"))
    return value.join(error, group)


# Aggregations by name; a metric without one of its own name is averaged.
AGGREGATIONS: dict[str, Aggregation | Whole] = {
    "mean": Aggregation(),
    "nanmean": Aggregation(_valid, lambda s: F.coalesce(F.try_divide(s["x"], s["n"]), F.lit(float("nan")))),
    "perplexity": Aggregation(value=lambda s: F.exp(-F.try_divide(s["x"], s["weight"]))),
    "weighted_perplexity": Aggregation(_weighted, lambda s: F.exp(-F.try_divide(s["x"], s["k"]))),
    "bits_per_byte": Aggregation(_weighted, lambda s: -F.try_divide(s["x"], s["k"]) / math.log(2)),
    "brier": Aggregation(),
    "f1": Aggregation(_binary, _f1),
    "mcc": Aggregation(_binary, _mcc),
    "bleu": Aggregation(_bleu, bleu_of),
    "chrf": Aggregation(_chrf, chrf_of),
    "median": Whole(_middle),
    "acc_all": Whole(_right_throughout),
}


def register_aggregation(name: str, aggregation: Aggregation | Whole) -> None:
    if name in AGGREGATIONS:
        raise ValueError(f"{name} is registered twice")
    AGGREGATIONS[name] = aggregation


def register_filter(name: str, build: Callable[..., Step]) -> None:
    if name in FILTERS:
        raise ValueError(f"{name} is registered twice")
    FILTERS[name] = build


def named_steps(config: list[tuple[str, dict]]) -> list[Step]:
    """A pipeline of filters from (name, arguments)."""
    return [FILTERS[name](**arguments) for name, arguments in config]


def aggregation_for(metric: str) -> Aggregation | Whole:
    """The aggregation of that name, or the mean. A metric whose error is known must have one of its own."""
    if metric not in AGGREGATIONS and stderr_plan(metric, 1)[0]:
        raise ValueError(f"{metric} has a standard error but no aggregation")
    return AGGREGATIONS.get(metric, AGGREGATIONS["mean"])


# --- resampling -------------------------------------------------------------------

# Up to this expectation Poisson numbers are drawn exactly, beyond it as a rounded normal.
EXACT_POISSON = 30


def uniform(seed: int, *parts: Column) -> Column:
    """A number in (0, 1) from an MD5 of the seed and the parts, the same on every run and partitioning."""
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), *[p.cast("string") for p in parts]))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)


def poisson(seed: int, n: Column, *parts: Column) -> Column:
    """A Poisson number with expectation ``n`` (a count of at least 1)."""
    u = uniform(seed, F.lit("u"), *parts)
    start = F.struct(F.exp(-n.cast("double")).alias("p"), F.exp(-n.cast("double")).alias("c"), F.lit(0).alias("k"))

    def step(a: Column, i: Column) -> Column:
        p = a["p"] * n / i
        return F.struct(p.alias("p"), (a["c"] + p).alias("c"), (a["k"] + (u >= a["c"]).cast("int")).alias("k"))

    exact = F.aggregate(F.sequence(F.lit(1), (20 + 3 * n).cast("int")), start, step)["k"]
    z = F.sqrt(-2 * F.log(u)) * F.cos(2 * math.pi * uniform(seed, F.lit("v"), *parts))
    rounded = F.greatest(F.floor(n + F.sqrt(n.cast("double")) * z + 0.5), F.lit(0))
    return F.when(n <= EXACT_POISSON, exact.cast("double")).otherwise(rounded.cast("double"))


def resampled_stderr(
    df: DataFrame, group: list[str], terms: Sums, value: Callable[[Sums], Column], replicates: int, seed: int = 0
) -> DataFrame:
    """Spread of a statistic of weighted sums over ``replicates`` resamples.

    Equal samples are counted first, and a replicate draws one Poisson number per different sample instead of one per sample: two
    for a 0/1 metric, four for a two-by-two table, however many rows there are. What is shuffled after that is one row per
    group, replicate and partition. A replicate counts if the statistic is a number for it.
    """
    names = list(terms)
    cells = df.select(*group, *[c.cast("double").alias(n) for n, c in terms.items()]).groupBy(*group, *names).agg(
        F.count(F.lit(1)).alias("_n")
    )
    drawn = cells.withColumn("_rep", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1)))).withColumn(
        "_w", poisson(seed, F.col("_n"), *[F.col(g) for g in group], *[F.col(n) for n in names], F.col("_rep"))
    )
    sums = drawn.groupBy(*group, "_rep").agg(F.sum("_w").alias("weight"), *[F.sum(F.col("_w") * F.col(n)).alias(n) for n in names])
    drawn_value = F.nanvl(value({n: F.col(n) for n in [*names, "weight"]}), F.lit(None).cast("double"))
    return sums.groupBy(*group).agg(F.stddev_samp(drawn_value).alias("stderr"))


# --- metrics with their standard errors ----------------------------------------------


def metrics_with_stderr(
    df: DataFrame, group: list[str], scores: dict[str, str], iters: int = 100, seed: int = 0
) -> DataFrame:
    """(group, metric, value, stderr, n): every metric by its own aggregation with the standard error that goes with it.

    ``scores`` maps a metric to its column (a number, or the struct its aggregation reads). What the samples add to each sum is worked out
    once and stored if it is read again: all values and closed-form errors come from one aggregation of it, and each resampled
    metric reads its own few columns. Null for a metric without error, and for groups of one sample. An unknown metric is
    averaged and has no error.
    """
    plans = {m: (f"s{i}", aggregation_for(m), *stderr_plan(m, iters)) for i, m in enumerate(scores)}
    columns = []
    for metric, (name, how, plan, _) in plans.items():
        if isinstance(how, Whole) or plan == "closed":
            columns.append(F.col(scores[metric]).alias(name))
        if isinstance(how, Aggregation):
            columns += [c.cast("double").alias(f"{name}_{term}") for term, c in how.terms(scores[metric]).items()]
    samples = df.select(*group, *columns)
    if any(isinstance(how, Whole) or plan == "bootstrap" for _, how, plan, _ in plans.values()):
        samples = cut_lineage(samples)
    aggs, cells, others = [F.count(F.lit(1)).alias("_n")], [], []
    for metric, (name, how, plan, draws) in plans.items():
        if isinstance(how, Whole):
            others.append(how.results(samples, group, name, max(draws, 1), seed).select(*group, F.lit(metric).alias("metric"), "value", F.col("stderr") if plan else F.lit(None).cast("double").alias("stderr")))
            cells.append((metric, None, None))
            continue
        terms = {term: F.col(f"{name}_{term}") for term in how.terms(scores[metric])}
        sums = {t: F.sum(c) for t, c in terms.items()} | {"weight": F.count(F.lit(1)).cast("double")}
        aggs.append(how.value(sums).alias(f"{name}_value"))
        error = F.stddev_samp(name) / F.sqrt(F.count(name)) if plan == "closed" else F.lit(None).cast("double")
        aggs.append(error.alias(f"{name}_error"))
        cells.append((metric, f"{name}_value", f"{name}_error"))
        if plan == "bootstrap":
            drawn = resampled_stderr(samples, group, terms, how.value, draws, seed)
            others.append(drawn.select(*group, F.lit(metric).alias("metric"), F.lit(None).cast("double").alias("value"), "stderr"))
    number = F.lit(None).cast("double")
    rows = F.array(
        *[
            F.struct(
                F.lit(m).alias("metric"),
                (F.col(v) if v else number).cast("double").alias("value"),
                (F.col(e) if e else number).cast("double").alias("stderr"),
            )
            for m, v, e in cells
        ]
    )
    out = samples.groupBy(*group).agg(*aggs).select(*group, F.explode(rows).alias("c"), F.col("_n").alias("n")).select(*group, "c.*", "n")
    if others:
        found = reduce(lambda a, b: a.unionByName(b), others).select(*group, "metric", F.col("value").alias("_value"), F.col("stderr").alias("_stderr"))
        out = out.join(found, [*group, "metric"], "left").select(
            *group, "metric", F.coalesce("value", "_value").alias("value"), F.coalesce("stderr", "_stderr").alias("stderr"), "n"
        )
    return out.withColumn("stderr", F.when(F.col("n") > 1, F.col("stderr"))).select(*group, "metric", "value", "stderr", "n")


def evaluate(
    docs: DataFrame,
    responses: DataFrame,
    pipelines: dict[str, list[Step]],
    process: dict[str, Column],
    tree: dict[str, list[str]] | None = None,
    iters: int = 100,
    id_col: str = "doc_id",
    weight_by_size: bool = True,
) -> DataFrame:
    """Responses -> filter pipelines -> scores -> metrics -> groups: (task, metric, filter, value, stderr, n).

    ``docs`` has one row per document with ``task`` and what ``process`` reads; ``responses`` the long response table. ``process`` maps a metric
    to a column over a document joined with its filtered ``response``. Responses are filtered and joined once, whatever the
    number of metrics and resamples. Rows of a group of ``tree`` bear its name as task.
    """
    filtered = filter_chain(responses, pipelines)
    scored = filtered.join(docs, id_col).select(
        "task", "filter", *[c.alias(f"s{i}") for i, c in enumerate(process.values())]
    )
    results = metrics_with_stderr(scored, ["task", "filter"], {m: f"s{i}" for i, m in enumerate(process)}, iters)
    if not tree:
        return results
    results = cut_lineage(results)
    groups = group_rollup(results, tree, weight_by_size).withColumnRenamed("grp", "task")
    return results.unionByName(groups.select(results.columns))
