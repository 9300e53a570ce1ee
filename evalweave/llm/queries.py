"""The registered queries of the operators, and their SQL where there is any."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evalweave.llm import alignment, bpe, dialogues, hostrank, passages, phraseindex, quality, records, sharding, simhash, topk, toxicity, tries
from evalweave.llm import sql
from evalweave.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]

BYTE_RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
WORD_TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
WORD_VOCABULARY = 49_408
BYTE_TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
PIECE_TOKENIZER = public_tokenizers.path("piece_bpe_32k.model")
END_ID = 2

# Fixed values of the URL filter.
URL_RULES = {"net/": "block", "example.net/en/": "allow", "example.com/de/": "block", "org/fr/": "allow"}


def content(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def held_out(id_col: str) -> Column:
    """A fifth of the rows by a checksum of the id; never learnt from."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string")), F.lit(5)) == 0, F.lit(False))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "text")


def bpe_digests(docs: DataFrame) -> DataFrame:
    """docs: doc_id, text."""
    ranks = content(BYTE_RANKS)
    coded = bpe.encode(docs.select("doc_id", "text"), "text", ranks, public_tokenizers.PATTERN, decoded=True)
    return coded.select(
        F.col("row.doc_id").alias("doc_id"),
        (F.octet_length("ids") / 4).cast("bigint").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_digests(documents(spark, sf_dir))


def quality_model(spark: SparkSession, docs: DataFrame, sf_dir: str) -> tuple[quality.QualityModel, DataFrame]:
    return quality.fit_quality(docs, "doc_id", "text", table(spark, sf_dir, "labels"), "doc_id", "quality", ~held_out("doc_id"))


def op2_quality_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    model, prints = quality_model(spark, documents(spark, sf_dir), sf_dir)
    return prints.select("doc_id", held_out("doc_id").alias("held_out"), model.score(F.col("features")).alias("score")).withColumn(
        "predicted", (F.col("score") >= 0.3 - 1e-9).cast("int")
    ).withColumn("score", F.when(F.col("predicted") == 1, F.greatest("score", F.lit(0.3))).otherwise(F.col("score")))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = toxicity.toxicity_scores(
        documents(spark, sf_dir), "doc_id", "text", table(spark, sf_dir, "labels"), "doc_id", "toxic", ~held_out("doc_id")
    )
    return scores.select(
        "doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )


def op4_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder, manifest = records.write_records(
        documents(spark, sf_dir), "doc_id", "text", content(WORD_TOKENIZER), WORD_VOCABULARY, END_ID
    )
    return records.read_records(spark, folder, manifest, WORD_VOCABULARY, "crc").withColumnRenamed("id", "doc_id")


def op5_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = passages.repeated_passages(documents(spark, sf_dir), "text", 35, with_text=False)
    return out.select(F.col("row.doc_id").alias("doc_id"), "n_words", "n_removed", "kept_sha256")


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hostrank.filter_urls(table(spark, sf_dir, "pages"), "page_id", "url", "html", URL_RULES)


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(documents(spark, sf_dir), "doc_id", "text", 4, 4).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def op8_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = topk.quantised(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    return topk.exact_topk(vectors, vectors.where(F.col("id") % 100 == 0), 10)


def decontamination(docs: DataFrame, spark: SparkSession, sf_dir: str) -> DataFrame:
    """(key, n_words, n_hit, item_ids); the key is the id with a hash of the text, so repeated ids stay apart."""
    keyed = docs.select(F.struct("doc_id", F.xxhash64("text").alias("h")).alias("key"), "text")
    return phraseindex.contamination(keyed, "key", "text", table(spark, sf_dir, "benchmark"), "item_id", "text", 13)


def contaminated() -> Column:
    return (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))


def op9_phrase_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination(documents(spark, sf_dir), spark, sf_dir).select(
        F.col("key.doc_id").alias("doc_id"),
        "n_words",
        "n_hit",
        F.size("item_ids").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"),
        contaminated().alias("contaminated"),
    )


def op10_byte_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    slim = documents(spark, sf_dir).select(
        "doc_id", (F.octet_length(text) + 1).cast("bigint").alias("size"), F.crc32(text).alias("text_crc32")
    )
    return sharding.shard_by_bytes(slim, [F.col("doc_id"), F.col("text_crc32")], F.col("size"), 8).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        F.col("slot").cast("bigint").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    aligned = alignment.align_tokenizers(
        documents(spark, sf_dir), "text", content(BYTE_TOKENIZER), content(PIECE_TOKENIZER), digest=True
    )
    return aligned.select(F.col("row.doc_id").alias("doc_id"), *[c for c in aligned.columns if c != "row"])


def damaged(turns: DataFrame) -> DataFrame:
    """Conversations with faults put in by a checksum of conversation and turn; nulls are one space."""
    blank = F.lit(" ")
    key = F.concat_ws(":", F.coalesce(F.col("conv_id").cast("string"), blank), F.coalesce(F.col("turn").cast("string"), blank))
    fault, text = F.pmod(F.crc32(key), F.lit(20)), F.coalesce("text", blank)
    return (
        turns.withColumn("fault", fault)
        .where("fault <> 0")
        .select(
            "conv_id",
            "turn",
            F.when(F.col("fault") == 4, F.lit("user")).otherwise(F.coalesce("role", blank)).alias("role"),
            F.when(F.col("fault") == 1, F.lit("")).when(F.col("fault") == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"),
            F.explode(F.when(F.col("fault") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"),
        )
        .drop("copy")
    )


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    conversations, repaired = dialogues.repair_conversations(damaged(turns), "conv_id", "turn", "role", "text")
    digests = dialogues.digests(repaired, "conv").withColumnRenamed("conv", "d")
    every = turns.select("conv_id").distinct()
    numbers = [F.coalesce(c, F.lit(0)).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return (
        every.join(conversations, F.col("conv_id").eqNullSafe(F.col("conv")), "left")
        .join(digests, F.col("conv_id").eqNullSafe(F.col("d")), "left")
        .select(
            "conv_id",
            *numbers,
            F.coalesce("audit", F.lit("")).alias("audit"),
            F.coalesce("sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"),
        )
    )


def op13_trie_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    points = F.coalesce(F.length("text"), F.lit(0))
    return tries.exact_duplicates(docs, "text", [-points, F.col("doc_id")]).select(
        F.col("row.doc_id").alias("doc_id"), F.col("owner.doc_id").alias("keep_id"), "group_size", "kept", "text_sha256"
    )


QUERIES: dict[str, Query] = {
    q.__name__: q
    for q in (
        op1_byte_bpe,
        op2_quality_ranking,
        op3_toxicity,
        op4_token_records,
        op5_repeated_passages,
        op6_url_filter,
        op7_simhash,
        op8_exact_topk,
        op9_phrase_index,
        op10_byte_shards,
        op11_token_alignment,
        op12_conversation_repair,
        op13_trie_dedup,
    )
}

# Not expressible in SQL: merges by rank (1), training (2, 3), another library's tokenizer (4, 11), XXH64 (7),
# least strings of edits (12).
ORACLES: dict[str, str] = {
    "op5_repeated_passages": sql.REPEATED_PASSAGES,
    "op6_url_filter": sql.url_filter(URL_RULES, 0.85, 8, 0.5),
    "op8_exact_topk": sql.EXACT_TOPK,
    "op9_phrase_index": sql.PHRASES,
    "op10_byte_shards": sql.BYTE_SHARDS,
    "op13_trie_dedup": sql.EXACT_DUPLICATES,
}
