"""Filters and record shaping for reasoning corpora and evaluation documents."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalweave.functions import text as T
from evalweave.functions.arrays import let
from evalweave.operators.ranks import (
    collect_in_parts,
    keep_first,
    keep_smallest,
    seeded_order,
    smallest_cut,
    with_position,
)


def filter_token_budget(df: DataFrame, max_tokens: int, col: str = "num_tokens") -> DataFrame:
    return df.where(F.col(col) < max_tokens)


def topk_longest(df: DataFrame, k: int, id_col: str = "id", col: str = "num_tokens") -> DataFrame:
    """The k longest rows, ties in id order."""
    return keep_smallest(df, [-F.col(col), F.col(id_col)], k)


def require_think_tags(df: DataFrame, col: str = "response") -> DataFrame:
    return df.where(F.contains(F.col(col), F.lit("<think>")) & F.contains(F.col(col), F.lit("</think>")))


def thinking_trace(response: Column) -> Column:
    """Text between the first <think> and the next one, cut at its first </think>."""
    between = F.split_part(response, F.lit("<think>"), F.lit(2))
    return T.strip(F.split_part(between, F.lit("</think>"), F.lit(1)))


def final_answer(response: Column) -> Column:
    """Text between the first and second </think>."""
    return T.strip(F.split_part(response, F.lit("</think>"), F.lit(2)))


def pick_turns(turns: DataFrame) -> DataFrame:
    """First user and first assistant text per conversation; one aggregation with map-side combine."""
    return turns.groupBy("conv_id").agg(
        F.expr("min_by(text, turn) FILTER (WHERE role = 'user')").alias("question"),
        F.expr("min_by(text, turn) FILTER (WHERE role = 'assistant')").alias("response"),
    )


def default_source(df: DataFrame) -> DataFrame:
    return df.withColumn("source", F.coalesce("source", F.lit("")))


def train_val_split(df: DataFrame, id_col: str, val_size: int, seed: int = 0) -> DataFrame:
    """Add ``split``: exactly ``val_size`` rows (or all, if fewer) are "val"."""
    if val_size <= 0:
        return df.withColumn("split", F.lit("train"))
    last = smallest_cut(df, [seeded_order(seed, id_col), F.col(id_col)], val_size)
    if last is None:
        return df.withColumn("split", F.lit("val"))
    return df.withColumn("split", F.when(last, "val").otherwise("train"))


def curate_sft(
    messages: DataFrame, k: int, max_tokens: int, val_size: int | None = None, seed: int = 0
) -> DataFrame:
    """Token budget, top-k, tag check, trace/answer split, and optionally a validation split.

    As the validation rows come out of the selection, ``k + val_size`` rows are
    selected; rows without tags are dropped afterwards.
    """
    chosen = topk_longest(filter_token_budget(messages, max_tokens), k + (val_size or 0))
    rows = require_think_tags(chosen).select(
        "id",
        "question",
        thinking_trace(F.col("response")).alias("thinking_trace"),
        final_answer(F.col("response")).alias("answer"),
        "num_tokens",
        F.coalesce("source", F.lit("")).alias("source"),
    )
    if val_size is None:
        return rows
    return train_val_split(rows, "id", val_size, seed)


def filter_equal(df: DataFrame, col: str, value) -> DataFrame:
    return df.where(F.col(col) == value)


def filter_prefix(df: DataFrame, col: str, prefix: str) -> DataFrame:
    return df.where(F.col(col).startswith(prefix))


def filter_membership(df: DataFrame, col: str, values: list) -> DataFrame:
    return df.where(F.col(col).isin(values))


def filter_valid_choices(df: DataFrame, gold: str, choices: str, valid: list) -> DataFrame:
    """Drop rows whose gold label is not allowed or whose choices are all empty."""
    return df.where(F.col(gold).isin(valid) & F.exists(choices, lambda c: c != ""))


def tidy_pair(df: DataFrame, first: str, second: str) -> DataFrame:
    """Keep rows with both sentences; detokenise, drop the first one's end mark, lower the second one's initial."""
    a = T.strip(T.apply_steps(F.col(first), T.GENERAL_STEPS))
    b = T.strip(T.apply_steps(F.col(second), T.GENERAL_STEPS))
    return (
        df.where((F.col(first) != "") & (F.col(second) != ""))
        .withColumn(first, F.regexp_replace(a, r"[.,;]\z", ""))
        .withColumn(second, F.concat(F.lower(F.substring(b, 1, 1)), F.substring(b, F.lit(2), F.length(b))))
    )


def mark_spans(tokens: Column, spans: Column) -> Column:
    """Wrap token ranges in asterisks; ``spans`` is an array of (start, length), 0-based."""
    marked = F.transform(
        tokens,
        lambda w, i: F.concat(
            F.when(F.exists(spans, lambda s: s["start"] == i), "*").otherwise(""),
            w,
            F.when(F.exists(spans, lambda s: s["start"] + s["length"] - 1 == i), "*").otherwise(""),
        ),
    )
    return F.array_join(marked, " ")


def sample_size(limit: float | None, n: int) -> int:
    """A limit below 1 is a share of the rows (rounded up), otherwise a row count."""
    if limit is None:
        return n
    return -int(-(n * limit) // 1) if limit < 1.0 else int(limit)


def limit_docs(df: DataFrame, id_col: str, limit: float | None) -> DataFrame:
    """The first rows in id order, as many as ``limit`` says."""
    if limit is None:
        return df
    if limit >= 1.0:
        return keep_smallest(df, [F.col(id_col)], int(limit))
    return keep_first(df, [F.col(id_col)], sample_size(limit, df.count()))


def select_by_index(df: DataFrame, id_col: str, indices: list[int], order: list[Column] | None = None) -> DataFrame:
    """Rows at the given positions (an explicit, user-written list), in the order of ``order``, ties by id; by id alone if not given."""
    return with_position(df, [*(order or []), F.col(id_col)]).where(F.col("pos").isin(indices))


def shard_stride(df: DataFrame, id_col: str, rank: int, world: int, limit: int | None = None) -> DataFrame:
    """Every ``world``-th row starting at ``rank``, among the first ``limit`` rows."""
    rows = df if limit is None else keep_smallest(df, [F.col(id_col)], limit)
    return with_position(rows, [F.col(id_col)]).where(F.col("pos") % world == rank)


def prune_by_token_length(df: DataFrame, counters: list[Column], max_tokens: int) -> DataFrame:
    """Rows that are short enough under every token counter."""
    return df.where(reduce(lambda a, b: a & b, [c <= max_tokens for c in counters]))


def categorise_answer(blob: Column) -> Column:
    """(answer, answer_type) of one annotated answer; null when it has no content."""

    def typed(answer: Column, kind: str) -> Column:
        return F.struct(answer.alias("answer"), F.lit(kind).alias("answer_type"))

    return (
        F.when(blob["unanswerable"], typed(F.lit("unanswerable"), "unanswerable"))
        .when(blob["yes_no"], typed(F.lit("yes"), "bool"))
        .when(blob["free_form_answer"] != "", typed(blob["free_form_answer"], "free form answer"))
        .when(F.size(blob["extractive_spans"]) > 0, typed(F.array_join(blob["extractive_spans"], ", "), "extractive_spans"))
        .when(~blob["yes_no"], typed(F.lit("no"), "bool"))
    )


def flatten_qas(docs: DataFrame, answer_type: str) -> DataFrame:
    """One row per (question, answer) of one type, from nested ``qas`` (question, answers)."""
    return (
        docs.select("doc_id", F.posexplode("qas").alias("q_idx", "qa"))
        .select("doc_id", "q_idx", F.col("qa.question").alias("question"), F.explode("qa.answers").alias("blob"))
        .withColumn("a", categorise_answer(F.col("blob")))
        .where(F.col("a.answer_type") == answer_type)
        .select("doc_id", "q_idx", "question", "a.answer", "a.answer_type")
    )


def merge_duplicate_ids(
    df: DataFrame, id_col: str, order_col: str, output_col: str, keep: list[str], part_size: int = 10_000
) -> DataFrame:
    """First row per id plus all its outputs in order, in parts of at most ``part_size``."""
    firsts = df.groupBy(id_col).agg(*[F.min_by(c, order_col).alias(c) for c in keep])
    lists = collect_in_parts(
        df.select(id_col, order_col, output_col), [id_col], [F.col(order_col)], F.col(output_col), "outputs", part_size
    )
    return lists.join(firsts, id_col)


def dedupe_exact(values: Column) -> Column:
    return F.array_distinct(values)


def dedupe_case_insensitive(values: Column) -> Column:
    """First spelling of every answer, ignoring case; by sorting, so long lists stay n log n."""
    by_case = F.sort_array(
        F.transform(values, lambda x, i: F.struct(F.lower(x).alias("k"), i.alias("i"), x.alias("x")))
    )

    def firsts(s: Column) -> Column:
        kept = F.filter(s, lambda x, i: (i == 0) | (x["k"] != F.get(s, i - 1)["k"]))
        in_order = F.sort_array(F.transform(kept, lambda x: F.struct(x["i"].alias("i"), x["x"].alias("x"))))
        return F.transform(in_order, lambda x: x["x"])

    return let(by_case, firsts)


def dedupe_sorted(values: Column) -> Column:
    return F.array_sort(F.array_distinct(values))


def split_prepended_question(text: Column) -> tuple[Column, Column]:
    """(question, rest) at the first blank line.

    Without a blank line the question loses its last character and the rest starts
    at the second one, as slicing at index -1 does.
    """
    at = F.position(F.lit("\n\n"), text)
    found = at > 0
    question = F.when(found, F.substring(text, F.lit(1), at - 1)).otherwise(
        F.substring(text, F.lit(1), F.greatest(F.length(text) - 1, F.lit(0)))
    )
    rest = F.when(found, F.substring(text, at + 2, F.length(text))).otherwise(
        F.substring(text, F.lit(2), F.length(text))
    )
    return question, rest


def concat_datasets(*frames: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)


def join_splits(splits: dict[str, DataFrame]) -> DataFrame:
    return concat_datasets(*[df.withColumn("split", F.lit(name)) for name, df in splits.items()])


def task_intersection(results: DataFrame, model: str, task: str) -> DataFrame:
    """Tasks that every model has."""
    pairs = results.select(model, task).distinct()
    n_models = pairs.agg(F.countDistinct(model))
    return (
        pairs.groupBy(task).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") == n_models.scalar()).select(task)
    )


def pattern_match(df: DataFrame, col: str, patterns: list[str]) -> DataFrame:
    """Distinct names that match any glob."""
    hit = reduce(lambda a, b: a | b, [F.col(col).rlike(T.glob_to_regex(p)) for p in patterns])
    return df.where(hit).select(col).distinct().orderBy(col)
