"""Contiguous shards of near-equal bytes: global prefix sums from per-partition totals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from evalweave.llm.common import stored


def shard_by_bytes(df: DataFrame, order: list[Column], size: Column, shards: int, name: str = "shard") -> DataFrame:
    """Add ``shard`` (0 to shards - 1) and ``slot`` (gapless from 0 in the shard) to every row.

    Rows are put in the order of ``order``; a row belongs to the shard in whose byte range [j T / k, (j + 1) T / k) it
    starts, T being the sum of sizes. So shards are contiguous in the order, and the bytes of two shards differ by
    less than the two largest rows. A shard can be empty if there are fewer rows than shards or a row is larger than
    T / k.

    Only the columns given here travel: one range shuffle, then each partition is numbered on its own and shifted
    by the totals of the partitions before it (one row per partition, hence the broadcast is bounded by the number of
    shuffle partitions). Rows that tie in ``order`` are put in an arbitrary order among themselves; null keys come first;
    a null size counts as 0. An empty table gives an empty result. Columns of the input named ``shard`` or ``slot`` are
    replaced; all others keep their names, whatever they are.
    """
    if shards < 1:
        raise ValueError("shards must be at least 1")
    keys = [f"k{i}" for i in range(len(order))]
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # The row travels as one struct, so that its names meet none of those used here.
    columns = [c for c in df.columns if c not in (name, "slot")]
    row = F.struct(*[df[c] for c in columns]) if columns else F.struct(F.lit(0).alias("none"))
    keyed = df.select(
        row.alias("row"),
        *[c.alias(k) for k, c in zip(keys, order)],
        F.greatest(F.coalesce(size.cast("bigint"), F.lit(0)), F.lit(0)).alias("size"),
    )
    # Range borders are sampled, so the assignment is stored before it is read twice.
    ranged = stored(keyed.repartitionByRange(parts, *keys).withColumn("part", F.spark_partition_id()), "shards")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    totals = (
        ranged.groupBy("part")
        .agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows"))
        .select(
            "part",
            F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("bytes_before"),
            F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("rows_before"),
        )
    )
    total = ranged.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("total"))
    inside = Window.partitionBy("part").orderBy(*keys, "size")
    placed = (
        ranged.withColumns(
            {
                "at": F.row_number().over(inside) - 1,
                "start": F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size"),
            }
        )
        .join(F.broadcast(totals), "part")
        .crossJoin(F.broadcast(total))  # one row
        .withColumns(
            {
                "number": F.col("rows_before") + F.col("at"),
                # Whole decimals divided by `div`: exact, where a quotient would be rounded to a few decimal places.
                "shard": F.expr(
                    f"least({shards - 1}, (cast(bytes_before + start AS decimal(28,0)) * cast({shards} AS decimal(10,0)))"
                    " div cast(greatest(total, 1) AS decimal(20,0)))"
                ).cast("int"),
            }
        )
        .select("row", "number", "shard")
    )
    placed = stored(placed, "placed")
    # One row per shard.
    firsts = placed.groupBy("shard").agg(F.min("number").alias("first"))
    return (
        placed.join(F.broadcast(firsts), "shard")
        .select(*[F.col("row")[c].alias(c) for c in columns], F.col("shard").alias(name), (F.col("number") - F.col("first")).alias("slot"))
    )
