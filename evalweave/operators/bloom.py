"""Bloom filters as a DataFrame aggregate, probed in the scan of a table ahead of a shuffle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalweave.session import cut_lineage

# Bits for each key, probes of a key, and the smallest and largest filter as powers of two. With more keys than the largest
# filter has room for, more rows pass it: it loses force, never a key.
BITS_PER_KEY = 10
PROBES = 4
SMALLEST, LARGEST = 12, 27


def filter_bits(n: int) -> int:
    return 1 << min(LARGEST, max(SMALLEST, (BITS_PER_KEY * max(1, n) - 1).bit_length()))


def _places(key: Column, bits: int) -> list[Column]:
    return [F.xxhash64(key, F.lit(i)).bitwiseAND(F.lit(bits - 1)) for i in range(PROBES)]


def bloom_filter(keys: DataFrame, key: str, n: int) -> Callable[[Column], Column]:
    """A condition that holds for every value among ``keys`` (about ``n`` numbers) and for about one in a hundred others.

    The bits are set by an aggregation over 64-bit words and kept as one array of at most 16 MB, a scalar subquery of the plan
    that probes it, so probing is a filter in place.
    """
    bits = filter_bits(n)
    place = F.explode(F.array(*_places(F.col(key), bits))).alias("place")
    words = (
        keys.select(place)
        .select(F.shiftright("place", 6).alias("word"), F.expr("shiftleft(1L, int(place & 63))").alias("bit"))
        .groupBy("word")
        .agg(F.bit_or("bit").alias("bits"))
    )
    every = keys.sparkSession.range(bits >> 6).join(words, F.col("id") == F.col("word"), "left")
    # One array for the whole filter: its size has a bound that does not depend on the data.
    ordered = F.sort_array(F.collect_list(F.struct("id", F.coalesce("bits", F.lit(0)).alias("bits"))))
    array = cut_lineage(every.agg(F.transform(ordered, lambda x: x["bits"]).alias("filter"))).scalar()

    def holds(value: Column) -> Column:
        found = F.lit(True)
        for p in _places(value, bits):
            word = F.get(array, F.shiftright(p, 6).cast("int"))
            found = found & (F.getbit(word, p.bitwiseAND(F.lit(63)).cast("int")) == 1)
        return found

    return holds
