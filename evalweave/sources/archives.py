"""Corpus archives: JSON lines holding a string or {text, meta}, compressed text files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from evalweave.functions import text as T
from evalweave.functions.packing import NUMBERED_WORDS, PACKED, gram_packer, gram_sampler, gram_unpacker, order_key
from evalweave.operators.broadcasts import spread


def read_text_archive(spark: SparkSession, path: str) -> DataFrame:
    """(text, meta) rows. ``text`` may be a string or a list of paragraphs, joined by blank lines.

    Lines that are no JSON give null text, so they can be counted.
    """
    line = F.try_parse_json(F.col("value"))
    body = F.try_variant_get(line, "$.text", "string")
    paragraphs = F.try_variant_get(line, "$.text", "array<string>")
    bare = F.try_variant_get(line, "$", "string")
    is_object = F.schema_of_variant(line).startswith("OBJECT")
    is_list = F.schema_of_variant(line).startswith("OBJECT") & paragraphs.isNotNull()
    return spark.read.text(path).select(
        F.when(is_list, F.array_join(paragraphs, "\n\n")).when(is_object, body).otherwise(bare).alias("text"),
        F.when(is_object, F.try_variant_get(line, "$.meta", "map<string,string>")).alias("meta"),
    )


def write_text_archive(df: DataFrame, text: Column, meta: Column, path: str, compression: str = "gzip") -> None:
    """One {text, meta} object per line. The codec zstd needs Hadoop's native library on the cluster."""
    df.select(F.to_json(F.struct(text.alias("text"), meta.alias("meta"))).alias("value")).write.mode(
        "overwrite"
    ).option("compression", compression).text(path)


# Bytes of n-grams that one task sorts, so that it needs no disk for it.
RANGE_BYTES = 128 << 20
# Bytes of n-grams from which the index is written in several passes over the corpus, so that only a part of what is shuffled
# lies on disk at a time; and the most passes, whatever the size.
PASS_BYTES = 32 << 30
PASSES = 3
# N-grams looked at for each range to find where it begins, and bytes of text to find frequent words.
RANGE_SAMPLE = 100
WORDS_BYTES = 32 << 20
# Sorted n-grams share words with their neighbours: only what follows these is written, and zstd finds repeated words.
INDEX_OPTIONS = {
    "compression": "zstd",
    "parquet.writer.version": "v2",
    "parquet.enable.dictionary#ngram": "false",
}
# The file that says that all is written, after the last pass.
SUCCESS_FILE = "mapreduce.fileoutputcommitter.marksuccessfuljobs"
# Drops what a job has shuffled as soon as the job is over.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def write_ngram_buckets(
    df: DataFrame, id_col: str, text: Column, n: int, n_buckets: int, path: str
) -> None:
    """(ngram, id) rows range-partitioned into about ``n_buckets`` sorted Parquet files, or more where one would hold over
    ``RANGE_BYTES``.

    Ranges are cut by (ngram, id), so an n-gram found in a large share of the
    documents spreads over several neighbouring files instead of filling one;
    reading the files in order gives the globally sorted index. The n-grams
    travel packed (see ``functions.packing``). Random n-grams say where ranges
    are cut, and some of the texts which words get numbers; all rows are written.
    """
    spark = df.sparkSession
    rows = df.select(F.col(id_col), text.alias("_text"))
    total = rows.agg(F.sum(F.octet_length("_text").cast("bigint"))).first()[0] or 0
    # Each word is in at most n n-grams.
    wanted = max(n_buckets, -(-n * total // RANGE_BYTES))
    schema = StructType([StructField("ngram", StringType()), StructField(id_col, rows.schema[id_col].dataType)])
    taken = F.floor(F.octet_length("_text") * (RANGE_SAMPLE * wanted / max(total, 1)) + F.rand(0)).cast("int")
    sample = rows.withColumn("_wanted", taken).where("_wanted > 0").mapInArrow(gram_sampler(n), schema).toArrow()
    order = order_key()
    found = sorted((gram.encode(), order(id_)) for gram, id_ in zip(*(c.to_pylist() for c in sample.columns)))
    bounds = sorted({found[len(found) * k // wanted] for k in range(1, wanted)}) if found else []
    some = rows if total <= WORDS_BYTES else rows.sample(WORDS_BYTES / total, 0)
    words = some.select(F.explode(T.words(T.ascii_fold(F.col("_text")))).alias("word")).groupBy("word").count()
    frequent = [r[0] for r in words.orderBy(F.desc("count"), "word").limit(NUMBERED_WORDS).select("word").collect()]
    shared = spark.sparkContext.broadcast((frequent, bounds))

    ranges = len(bounds) + 1
    passes = min(PASSES, ranges, max(1, -(-n * total // PASS_BYTES)))
    cuts = [ranges * k // passes for k in range(passes + 1)]
    cleanup = spark.conf.get(CLEANUP)
    spark.conf.set(CLEANUP, "true")
    try:
        for begin, end in zip(cuts, cuts[1:]):
            packed = spread(rows, id_col).mapInArrow(gram_packer(n, shared, begin, end), PACKED)
            grams = packed.repartitionById(ranges, "range").mapInArrow(gram_unpacker(n, shared, id_col), schema)
            # A file's name begins with the number of its range, so the files of all passes sort by it.
            out = grams.sortWithinPartitions("ngram", id_col).write.mode("append" if begin else "overwrite")
            out.options(**INDEX_OPTIONS).option(SUCCESS_FILE, end == ranges).parquet(path)
    finally:
        spark.conf.set(CLEANUP, cleanup)
