"""Incremental decontamination of arriving document files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from evalweave.operators.decontam import decontaminate, find_contaminated


def incremental_decontaminate(
    spark: SparkSession,
    source: str,
    schema,
    benchmark: DataFrame,
    id_col: str,
    text: Column,
    bench_text: Column,
    out: str,
    checkpoint: str,
    n: int = 13,
    glob: str | None = None,
    files_per_batch: int | None = None,
) -> StreamingQuery:
    """Check new files against a static benchmark and append the clean rows, once per file.

    The checkpoint remembers the files already done. A batch overwrites its own
    ``batch=<id>`` folder, so a batch repeated after a failure leaves one copy.
    """
    stream = spark.readStream.schema(schema)
    if glob is not None:
        stream = stream.option("pathGlobFilter", glob)
    if files_per_batch is not None:
        stream = stream.option("maxFilesPerTrigger", files_per_batch)

    def run(batch: DataFrame, batch_id: int) -> None:
        dirty = find_contaminated(batch, benchmark, id_col, text, bench_text, n)
        decontaminate(batch, dirty, id_col).write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    return (
        stream.parquet(source)
        .writeStream.foreachBatch(run)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def read_clean(spark: SparkSession, out: str) -> DataFrame:
    """All clean rows written so far."""
    return spark.read.parquet(out).drop("batch")
