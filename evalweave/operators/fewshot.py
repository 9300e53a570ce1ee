"""Few-shot example selection and the contexts built from it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegralType

from evalweave.operators.ranks import seeded_number, seeded_order, with_position


def fewshot_random(
    docs: DataFrame, pool: DataFrame, id_col: str, k: int, seed: int = 0, same_split: bool = True
) -> DataFrame:
    """``k`` examples per document, never the document itself: (id, rank, example_id).

    The pool is put into a seeded random order once; every document takes ``k``
    neighbours from a seeded start (one more if it meets itself). Each document
    makes ``k`` rows, never a pair with every candidate. A pool with fewer than ``k``
    examples besides the document is an error.
    """
    shuffled = with_position(pool.select(id_col), [seeded_order(seed, id_col), F.col(id_col)], "slot")
    n = pool.count()
    if k > (n - 1 if same_split else n):
        raise ValueError(f"{k} examples are asked for, and the pool has {n} rows")
    start = seeded_number(f"{seed}/start", id_col) % n
    if same_split:
        own = (F.col("slot") - F.col("start") + n) % n
        targets = docs.select(id_col).join(shuffled, id_col).withColumn("start", start).withColumn("own", own)
        skip = F.col("own")
    else:
        targets = docs.select(id_col).withColumn("start", start)
        skip = F.lit(k)
    picks = targets.select(
        id_col,
        F.col("start"),
        F.posexplode(F.filter(F.sequence(F.lit(0), F.lit(k)), lambda j: j != F.least(skip, F.lit(k)))).alias("rank", "j"),
    ).select(id_col, "rank", ((F.col("start") + F.col("j")) % n).alias("slot"))
    return picks.join(shuffled.withColumnRenamed(id_col, "example_id"), "slot").select(id_col, "rank", "example_id")


def fewshot_first_n(pool: DataFrame, id_col: str, n: int) -> DataFrame:
    """The first ``n`` pool rows in id order; an error if the pool is smaller."""
    first = pool.orderBy(id_col).limit(n)
    have = first.agg(F.count(F.lit(1)))
    return first.where(
        F.assert_true(have.scalar() >= n, f"fewer than {n} few-shot examples are available").isNull()
    )


def fewshot_by_indices(pool: DataFrame, id_col: str, indices: list[int]) -> DataFrame:
    """The pool restricted to the rows at the given positions in id order."""
    return with_position(pool, [F.col(id_col)]).where(F.col("pos").isin(indices)).drop("pos")


def example_target(pool: DataFrame, answer: str, choices: str | None = None) -> Column:
    """The text of an example's answer: a string, the first of a list of strings, or the place of a choice."""
    kind = pool.schema[answer].dataType
    if isinstance(kind, ArrayType):
        return F.get(answer, F.lit(0))
    if isinstance(kind, IntegralType) and choices is not None:
        return F.get(choices, F.col(answer).cast("int"))
    return F.col(answer).cast("string")


def _examples(
    picks: DataFrame, pool: DataFrame, id_col: str, question: str, answer: str, choices: str | None = None
) -> DataFrame:
    """Per document its k examples in rank order (k is the few-shot count, so the list is short)."""
    texts = pool.select(
        F.col(id_col).alias("example_id"), F.col(question).alias("q"), example_target(pool, answer, choices).alias("a")
    )
    return (
        picks.join(texts, "example_id")
        .groupBy(id_col)
        .agg(F.sort_array(F.collect_list(F.struct("rank", "q", "a"))).alias("examples"))
    )


def labelled_text(
    examples: Column, target_delimiter: str = " ", example_delimiter: str = "\n\n", prefix: str = ""
) -> Column:
    lead = prefix + " " if prefix else ""
    return F.array_join(
        F.transform(
            examples,
            lambda e: F.when(e["a"] == "", e["q"]).otherwise(
                F.concat(e["q"], F.lit(target_delimiter + lead), e["a"], F.lit(example_delimiter))
            ),
        ),
        "",
    )


def fewshot_context(
    docs: DataFrame,
    picks: DataFrame,
    pool: DataFrame,
    id_col: str,
    question: str,
    answer: str,
    description: str = "",
    choices: str | None = None,
    **delimiters,
) -> DataFrame:
    """Description, labelled examples and the document's own question as one prompt."""
    ex = _examples(picks, pool, id_col, question, answer, choices)
    return docs.join(ex, id_col, "left").select(
        id_col,
        F.concat(
            F.lit(description), F.coalesce(labelled_text(F.col("examples"), **delimiters), F.lit("")), F.col(question)
        ).alias("context"),
    )


def fewshot_chat_turns(
    docs: DataFrame,
    picks: DataFrame,
    pool: DataFrame,
    id_col: str,
    question: str,
    answer: str,
    multiturn: bool = True,
    prefix: str = "",
    choices: str | None = None,
) -> DataFrame:
    """The same examples as alternating chat turns, or all in one user turn."""
    lead = prefix + " " if prefix else ""
    ex = _examples(picks, pool, id_col, question, answer, choices)

    def turn(role: str, content: Column) -> Column:
        return F.struct(F.lit(role).alias("role"), content.alias("content"))

    if multiturn:
        history = F.flatten(
            F.transform(
                "examples",
                lambda e: F.array(turn("user", e["q"]), turn("assistant", F.concat(F.lit(lead), e["a"]))),
            )
        )
    else:
        history = F.array(turn("user", labelled_text(F.col("examples"), prefix=prefix)))
    return docs.join(ex, id_col, "left").select(
        id_col,
        F.concat(
            F.coalesce(history, F.array().cast("array<struct<role:string,content:string>>")),
            F.array(turn("user", F.col(question))),
        ).alias("turns"),
    )
