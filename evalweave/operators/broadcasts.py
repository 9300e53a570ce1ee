"""Physical choices: broadcast what is known to be small, spread scans with too few splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Rows and bytes of a table that is broadcast.
BROADCAST_ROWS = 1_000_000
BROADCAST_BYTES = 200 * 1024 * 1024

# Number of partitions for scans with too few splits; unset, scans are left as they are.
SPREAD = "spark.evalweave.spread"


def fits_broadcast(df: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> bool:
    """Whether a written table is small in rows and in bytes: one parallel aggregation."""
    strings = [F.octet_length(c) for c, kind in df.dtypes if kind in ("string", "binary")]
    width = sum((F.coalesce(s, F.lit(0)) for s in strings), F.lit(16 * len(df.columns)))
    n, bytes_ = df.agg(F.count(F.lit(1)), F.sum(width.cast("bigint"))).first()
    return n <= rows and (bytes_ or 0) <= size


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Hash-partition a table by id where the session asks for it.

    Files with one row group cannot be split by the scan. Whoever starts the session
    knows the files, and sets ``spark.evalweave.spread`` to a number of partitions if
    heavy per-row work should be dealt out anew. Without it nothing is moved.
    """
    parts = df.sparkSession.conf.get(SPREAD, None)
    return df if not parts else df.repartition(int(parts), *keys)


def ngrams_fit(df: DataFrame, tokens: Column, n: int, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> bool:
    """Whether the distinct n-grams of a table surely fit a broadcast, in rows and in bytes.

    The total number of n-grams bounds the distinct ones from above, and each word is in at most n of them; it is one
    narrow pass without building them.
    """
    count = F.greatest(F.size(tokens) - (n - 1), F.lit(0)).cast("bigint")
    width = F.when(count > 0, (F.octet_length(F.array_join(tokens, " ")) + 1).cast("bigint") * n + 16 * count).otherwise(0)
    total, bytes_ = df.agg(F.sum(count), F.sum(width)).first()
    return (total or 0) <= rows and (bytes_ or 0) <= size
