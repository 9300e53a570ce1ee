"""A corpus pipeline in five stages: quality, near duplicates, repeated passages, benchmark contamination, tokens.

Each stage reads all rows that the one before kept, as Parquet, and its decisions take effect.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evalweave.llm import passages, quality, simhash
from evalweave.llm.common import stored
from evalweave.llm.queries import bpe_digests, contaminated, decontamination, quality_model

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

# Rows of (id, hash) up to which the rows to drop are broadcast: about 30 MB.
BROADCAST_KEYS = 1_000_000


def without(docs: DataFrame, bad: DataFrame, same) -> DataFrame:
    """The rows of ``docs`` that ``same`` finds no partner for in ``bad``; texts move only if ``bad`` is too large to broadcast."""
    bad = stored(bad, "dropped")
    return docs.join(F.broadcast(bad) if bad.count() <= BROADCAST_KEYS else bad, same(docs, bad), "left_anti")


def same_document(docs: DataFrame, bad: DataFrame) -> Column:
    """Equal ids (null equals null) and texts of equal hash; ``bad`` has bad_id and bad_hash."""
    return docs["doc_id"].eqNullSafe(bad["bad_id"]) & (F.xxhash64(docs["text"]) == bad["bad_hash"])


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below the quality threshold go."""
    model, _ = quality_model(spark, docs.select("doc_id", "text"), sf_dir)
    return quality.keep_good(docs, "text", model)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near duplicates stays; a null id stays only where its group has no
    other. Documents are told apart by id and text, so rows that repeat both are one document and stay; of different texts with
    one id at most one stays in a group, and an id that goes from one group does not go from another."""
    key = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", F.xxhash64("text").alias("h"))
    groups = simhash.near_duplicates(docs.select(key.alias("key"), "text"), "key", "text")
    bad = groups.where(F.col("key") != F.col("component_id")).select(
        F.col("key.doc_id").alias("bad_id"), F.col("key.h").alias("bad_hash")
    )
    return without(docs, bad.distinct(), same_document)


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 35 words or more that occur more than once are cut out of the texts; every document stays. Rows that repeat
    id and text are one document: its passages count once, and each row gets the text that is left."""
    key = docs.select(F.col("doc_id").alias("bad_id"), F.xxhash64("text").alias("bad_hash"))
    again = stored(key.groupBy("bad_id", "bad_hash").agg(F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"), "again")
    if again.isEmpty():
        out = passages.remove_repeats(docs, "text")
    else:
        hint = F.broadcast(again) if again.count() <= BROADCAST_KEYS else again
        # Rows travel as one struct, so that their names meet none of those used here.
        row = F.struct(*[docs[c] for c in docs.columns]).alias("row")
        repeated = docs.join(hint, same_document(docs, hint), "left_semi").select(row, F.xxhash64("text").alias("h"))
        once = repeated.groupBy(F.col("row.doc_id").alias("doc_id"), "h").agg(F.first("row.text").alias("text"))
        others = docs.join(hint, same_document(docs, hint), "left_anti").select(row, F.col("text"))
        single = others.select("row", "text", *[F.lit(None).cast(t).alias(c) for c, t in (("doc_id", once.schema["doc_id"].dataType), ("h", "bigint"))])
        every = single.unionByName(once.select(F.lit(None).cast(single.schema["row"].dataType).alias("row"), "text", "doc_id", "h"))
        cut = stored(passages.remove_repeats(every, "text"), "cut")
        left = cut.where("h IS NOT NULL").select(F.col("doc_id").alias("i"), F.col("h").alias("g"), F.col("text").alias("left"))
        rows = repeated.join(left, F.col("row.doc_id").eqNullSafe(F.col("i")) & (F.col("h") == F.col("g"))).select("row", F.col("left").alias("text"))
        whole = cut.where("h IS NULL").select("row", "text").unionByName(rows)
        out = whole.select(*[F.col("text") if c == "text" else F.col("row")[c].alias(c) for c in docs.columns])
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out


def not_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which a twentieth or more stands in phrases of the benchmark go."""
    bad = decontamination(docs.select("doc_id", "text"), spark, sf_dir).where(contaminated())
    return without(
        docs,
        bad.select(F.col("key.doc_id").alias("bad_id"), F.col("key.h").alias("bad_hash")).distinct(),
        same_document,
    )


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Byte-level BPE of what is left: doc_id, n_tokens, ids_sha256, decoded_sha256."""
    return bpe_digests(docs)


STAGES: list[tuple[str, Stage]] = [
    ("quality", good_quality),
    ("near_duplicates", one_of_each_group),
    ("repeated_passages", without_repeats),
    ("decontamination", not_contaminated),
    ("byte_bpe", tokens),
]

# Training, XXH64 and merges by rank cannot be expressed in SQL.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each one's rows are written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
