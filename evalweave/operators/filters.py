"""Response filters over the long response table (doc id, attempt index, response)."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalweave.functions import answers as A
from evalweave.functions import text as T

Step = Callable[[DataFrame], DataFrame]


def on_response(fn: Callable[[Column], Column], col: str = "response") -> Step:
    """A column function as a filter step."""
    return lambda df: df.withColumn(col, fn(F.col(col)))


def take_first(id_col: str = "doc_id", idx: str = "idx") -> Step:
    """Response 0 of every document (indices count from 0 within a document)."""
    return lambda df: df.where(F.col(idx) == 0)


def take_first_k(k: int, id_col: str = "doc_id", idx: str = "idx") -> Step:
    """The first k responses; an error if a document has fewer."""

    def run(df: DataFrame) -> DataFrame:
        fewest = df.groupBy(id_col).agg(F.count(F.lit(1)).alias("n")).agg(F.min("n"))
        enough = F.assert_true(fewest.scalar() >= k, f"a document has fewer than {k} responses").isNull()
        return df.where((F.col(idx) < k) & enough)

    return run


def majority_vote(id_col: str = "doc_id", idx: str = "idx", col: str = "response") -> Step:
    """Most frequent response per document, the one seen first on ties.

    Two aggregations with map-side combine; no window, so a document with very
    many responses is counted in parallel.
    """

    def run(df: DataFrame) -> DataFrame:
        votes = df.groupBy(id_col, col).agg(F.count(F.lit(1)).alias("_n"), F.min(idx).alias("_first"))
        return votes.groupBy(id_col).agg(
            F.max_by(col, F.struct("_n", -F.col("_first"))).alias(col), F.max("_n").alias("votes")
        )

    return run


def filter_chain(df: DataFrame, pipelines: dict[str, list[Step]]) -> DataFrame:
    """Every named pipeline applied to the responses; its name in the ``filter`` column."""
    outputs = [
        reduce(lambda d, step: d.transform(step), steps, df).withColumn("filter", F.lit(name))
        for name, steps in pipelines.items()
    ]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), outputs)


def regex(pattern: str, select: int = 0, fallback: str = A.INVALID) -> Step:
    return on_response(lambda c: A.regex_extract_nth(c, pattern, select, fallback))


def strip_leading_ws() -> Step:
    return on_response(T.lstrip)


def lowercase() -> Step:
    return on_response(F.lower)


def uppercase() -> Step:
    return on_response(F.upper)


def map_values(mapping: dict, default=None) -> Step:
    return on_response(lambda c: A.map_values(c, mapping, default))


# Filters by configuration name.
FILTERS: dict[str, Callable[..., Step]] = {
    "regex": regex,
    "remove_whitespace": strip_leading_ws,
    "lowercase": lowercase,
    "uppercase": uppercase,
    "map": map_values,
    "take_first": take_first,
    "take_first_k": take_first_k,
    "majority_vote": majority_vote,
}


def majority_at_k(k: int, extract: Step, id_col: str = "doc_id", idx: str = "idx") -> list[Step]:
    """First k responses, extract the answer, vote."""
    return [take_first_k(k, id_col, idx), extract, majority_vote(id_col, idx)]
