"""Global positions and order statistics without a single-task sort.

A row position over the whole table is a two-level numbering: rows are cut
into slices of about equal size at sampled key values, each slice is numbered
on its own, and the slice offsets (one row per slice) are added. The cut points
are literals, so a recomputed task sees the same slices.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window
from pyspark.sql.types import DoubleType, IntegralType, StringType, StructType

from evalweave.session import cut_lineage

SAMPLES_PER_SLICE = 16

# Rows up to which a fixed k goes through one top-k.
DIRECT_TOP_K = 1000


def slice_count(df: DataFrame) -> int:
    """As many slices as the session has shuffle partitions, whatever that number is."""
    return max(2, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def _key(keys: list[Column]) -> Column:
    return F.struct(*[k.alias(f"k{i}") for i, k in enumerate(keys)])


def _literal_rows(rows: list, row_type: StructType) -> Column:
    """A constant array of structs; as one JSON literal (folded by the optimizer) where the types allow it."""
    if all(isinstance(f.dataType, (StringType, IntegralType, DoubleType)) for f in row_type.fields):
        text = json.dumps([r.asDict() for r in rows])
        return F.from_json(F.lit(text), f"array<{row_type.simpleString()}>")
    return F.array(
        *[F.struct(*[F.lit(v).cast(f.dataType).alias(f.name) for v, f in zip(r, row_type.fields)]) for r in rows]
    )


def _slice_column(df: DataFrame, keys: list[Column], slices: int) -> Column:
    """Slice number of every row, by cut points from a sample.

    A row is in the sample if the hash of its keys is small enough for about
    ``slices * SAMPLES_PER_SLICE`` rows to be: a filter in place, without a sort or
    a single task. Only sampled keys reach the driver.
    """
    want = slices * SAMPLES_PER_SLICE
    narrow = df.select(_key(keys).alias("k"))
    rows = narrow.count()
    if rows > 2 * want:
        span = 1 << 40
        narrow = narrow.where(F.pmod(F.xxhash64("k"), F.lit(span)) < span * want // rows)
    sample = sorted(narrow.collect(), key=lambda r: tuple((v is not None, v) if v is not None else (False,) for v in r["k"]))
    step = max(1, len(sample) // slices)
    cuts = [row["k"] for row in sample][step::step]
    if not cuts:
        return F.lit(0)
    key_type = df.select(_key(keys).alias("k")).schema["k"].dataType
    # Two-step search: find the block of cuts first, then the place in the block.
    width = max(1, int(len(cuts) ** 0.5))
    all_cuts, heads = _literal_rows(cuts, key_type), _literal_rows(cuts[::width], key_type)
    key = _key(keys)
    block = F.size(F.filter(heads, lambda c: c <= key))
    return F.when(
        block > 0,
        (block - 1) * width
        + F.size(F.filter(F.slice(all_cuts, (block - 1) * width + 1, F.lit(width)), lambda c: c <= key)),
    ).otherwise(F.lit(0))


def with_position(df: DataFrame, keys: list[Column], name: str = "pos", slices: int | None = None) -> DataFrame:
    """Add the 0-based position of every row in ascending order of ``keys``.

    The keys together must identify a row. One shuffle of the rows (by slice)
    plus a count pass that reads the key columns only.
    """
    sliced = df.withColumn("_slice", _slice_column(df, keys, slices or slice_count(df)))
    # One row per slice: the un-partitioned running sum sees at most `slices` rows.
    offsets = (
        sliced.groupBy("_slice")
        .agg(F.count(F.lit(1)).alias("_n"))
        .select(
            "_slice",
            (F.sum("_n").over(Window.orderBy("_slice").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_n")).alias(
                "_offset"
            ),
        )
    )
    in_slice = F.row_number().over(Window.partitionBy("_slice").orderBy(*keys)) - 1
    return (
        sliced.withColumn("_in_slice", in_slice)
        .join(F.broadcast(offsets), "_slice")
        .withColumn(name, (F.col("_offset") + F.col("_in_slice")).cast("bigint"))
        .drop("_slice", "_in_slice", "_offset")
    )


def with_group_position(
    df: DataFrame, group: list[str], keys: list[Column], name: str = "pos", slices: int | None = None
) -> DataFrame:
    """0-based position inside each group; a group may hold any share of the rows.

    Numbered globally by (group, keys), then shifted by the first position of
    the group, so a hot group is spread over many slices.
    """
    numbered = with_position(df, [F.col(g) for g in group] + keys, "_gpos", slices)
    starts = numbered.groupBy(*group).agg(F.min("_gpos").alias("_start"))
    return (
        numbered.join(starts, group)
        .withColumn(name, F.col("_gpos") - F.col("_start"))
        .drop("_gpos", "_start")
    )


def collect_in_parts(
    df: DataFrame, group: list[str], keys: list[Column], value: Column, name: str, part_size: int = 10_000
) -> DataFrame:
    """Ordered lists per group, cut into parts of at most ``part_size`` elements.

    No element is dropped: a group larger than ``part_size`` becomes several
    rows numbered by ``part``.
    """
    numbered = with_group_position(df.withColumn("_value", value), group, keys, "_p")
    return (
        numbered.withColumn("part", F.floor(F.col("_p") / part_size))
        .groupBy(*group, "part")
        .agg(F.sort_array(F.collect_list(F.struct("_p", "_value"))).alias("_list"))
        .select(*group, "part", F.transform("_list", lambda x: x["_value"]).alias(name))
    )


def smallest_cut(df: DataFrame, keys: list[Column], k: int) -> Column | None:
    """A condition that holds for the ``k >= 1`` rows with the smallest keys (and ties at the last); None if for all.

    Beyond ``DIRECT_TOP_K`` the rows are counted by slices of the keys, and the slice with the k-th key is cut again in the
    same way until the place sought in it is small enough. So no task orders more than ``DIRECT_TOP_K`` rows, for any k.
    A slice that cannot be cut, as one key fills nearly all of it, loses its smallest key instead.
    """
    names = [f"k{i}" for i in range(len(keys))]
    columns = [F.col(n) for n in names]
    narrow = df.select(*[c.alias(n) for n, c in zip(names, keys)])
    slices, rows = slice_count(df), None
    while k > DIRECT_TOP_K:
        sliced = narrow.withColumn("_slice", _slice_column(narrow, columns, slices))
        counts = sorted((r["_slice"], r["count"]) for r in sliced.groupBy("_slice").count().collect())  # one row per slice
        if k >= sum(n for _, n in counts):
            if rows is None:
                return None
            return _key(keys) <= narrow.agg(F.max(_key(columns)).alias("_cut")).scalar()
        chosen, before = counts[0][0], 0
        for chosen, n in counts:
            if before + n >= k:
                break
            before += n
        k -= before
        narrow = cut_lineage(sliced.where(F.col("_slice") == chosen).drop("_slice"))
        if n == rows:
            least = narrow.agg(F.min(_key(columns)).alias("_least")).scalar()
            same = narrow.where(_key(columns) == least).count()
            if same >= k:
                return _key(keys) <= least
            k, narrow, n = k - same, cut_lineage(narrow.where(_key(columns) > least)), n - same
        rows = n
    cut = narrow.select(_key(columns).alias("_key")).orderBy("_key").limit(k).agg(F.max("_key").alias("_cut"))
    return _key(keys) <= cut.scalar()


def keep_smallest(df: DataFrame, keys: list[Column], k: int) -> DataFrame:
    """The ``k`` rows with the smallest keys, for any k up to all rows.

    Only keys are looked at; the wide rows are kept or dropped where they are.
    """
    if k <= 0:
        return df.where(F.lit(False))
    cut = smallest_cut(df, keys, k)
    return df if cut is None else df.where(cut)


def keep_first(df: DataFrame, keys: list[Column], n: int) -> DataFrame:
    """The first ``n`` rows by key."""
    return keep_smallest(df, keys, n)


def seeded_order(seed: int | str, *ids: str) -> Column:
    """A reproducible pseudo-random sort key, independent of partitioning."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(i).cast("string") for i in ids]))


def seeded_number(seed: int | str, *ids: str) -> Column:
    """A reproducible pseudo-random number in [0, 2^60)."""
    return F.conv(F.substring(seeded_order(seed, *ids), 1, 15), 16, 10).cast("bigint")


def with_running_totals(
    df: DataFrame, keys: list[Column], names: dict[str, str], slices: int | None = None
) -> DataFrame:
    """For each value -> name, the sum of the value over all rows up to and including each row in key order, by slices."""
    sliced = df.withColumn("_slice", _slice_column(df, keys, slices or slice_count(df)))
    # One row per slice.
    earlier = Window.orderBy("_slice").rowsBetween(Window.unboundedPreceding, 0)
    offsets = (
        sliced.groupBy("_slice")
        .agg(*[F.sum(value).alias(f"_s_{name}") for value, name in names.items()])
        .select("_slice", *[(F.sum(f"_s_{n}").over(earlier) - F.col(f"_s_{n}")).alias(f"_before_{n}") for n in names.values()])
    )
    inside = Window.partitionBy("_slice").orderBy(*keys).rowsBetween(Window.unboundedPreceding, 0)
    return (
        sliced.withColumns({f"_inside_{name}": F.sum(value).over(inside) for value, name in names.items()})
        .join(F.broadcast(offsets), "_slice")
        .withColumns({n: F.col(f"_before_{n}") + F.col(f"_inside_{n}") for n in names.values()})
        .drop("_slice", *[f"{part}_{n}" for part in ("_inside", "_before") for n in names.values()])
    )


def with_running_total(df: DataFrame, keys: list[Column], value: str, name: str, slices: int | None = None) -> DataFrame:
    return with_running_totals(df, keys, {value: name}, slices)
