"""Helpers for array columns that stay linear (or n log n) in the array length."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once per row and hand it to ``body``.

    A plain Python variable would repeat the expression at every use; inside a
    lambda that means once per array element.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def let2(a: Column, b: Column, body: Callable[[Column, Column], Column]) -> Column:
    pair = F.struct(a.alias("a"), b.alias("b"))
    return let(pair, lambda p: body(p["a"], p["b"]))


def positions(n: Column) -> Column:
    """``[0, 1, ..., n-1]``, empty for n <= 0."""
    return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))


def total(values: Column, kind: str = "double") -> Column:
    return F.aggregate(values, F.lit(0).cast(kind), lambda acc, x: acc + x)


def multiset_overlap(left: Column, right: Column) -> Column:
    """Size of the multiset intersection of two string arrays.

    Every token gets a separator and its side (0 or 1) appended, both sides are
    sorted together and cut into runs of equal strings. Runs of one token are
    neighbours and contribute the smaller run length. One sort per row, no shuffle
    and no quadratic scan. Tokens must not contain the character U+0000.
    """
    tagged = F.sort_array(
        F.concat(
            F.transform(left, lambda x: F.concat(x, F.lit("\x000"))),
            F.transform(right, lambda x: F.concat(x, F.lit("\x001"))),
        )
    )

    def from_sorted(items: Column) -> Column:
        starts = F.filter(
            positions(F.size(items)),
            lambda i: (i == 0) | (F.get(items, i) != F.get(items, i - 1)),
        )

        def from_starts(cut: Column) -> Column:
            # The run at k holds cut[k+1] - cut[k] elements; a token on both sides has its runs at k and k+1.
            def smaller(s: Column, k: Column) -> Column:
                here, after = F.get(items, s), F.get(items, F.get(cut, k + 1))
                middle = F.get(cut, k + 1)
                end = F.coalesce(F.get(cut, k + 2), F.size(items))
                both = F.concat(F.rtrim(here, F.lit("0")), F.lit("1")) == after
                return F.when(here.endswith("\x000") & both, F.least(middle - s, end - middle)).otherwise(0)

            return total(F.transform(cut, smaller), "int")

        return let(starts, from_starts)

    return let(tagged, from_sorted)


def argmax_first(values: Column) -> Column:
    """0-based index of the largest element, the first one on ties."""
    return F.array_position(values, F.array_max(values)).cast("int") - 1


def cumulative(values: Column, block: int = 128) -> Column:
    """Running sums of an int array, by blocks so the work stays near linear."""

    def by_blocks(v: Column) -> Column:
        n_blocks = F.ceil(F.size(v) / block).cast("int")
        block_sums = F.transform(positions(n_blocks), lambda b: total(F.slice(v, b * block + 1, F.lit(block)), "int"))

        def offsets(sums: Column) -> Column:
            starts = F.transform(sums, lambda _, b: total(F.slice(sums, F.lit(1), b), "int"))
            return let(
                starts,
                lambda st: F.transform(
                    v,
                    lambda _, i: F.get(st, F.floor(i / block).cast("int"))
                    + total(F.slice(v, F.floor(i / block).cast("int") * block + 1, i % block + 1), "int"),
                ),
            )

        return let(block_sums, offsets)

    return let(values, by_blocks)
