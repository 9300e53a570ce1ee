"""The streaming job as a query: the result equals the batch one."""

from __future__ import annotations

from pyspark.sql import functions as F

from evalweave.plans.q_decontam import DIRTY, INDEX, N
from evalweave.plans.q_sources import fresh
from evalweave.plans.registry import query, table
from evalweave.streaming.incremental import incremental_decontaminate as start
from evalweave.streaming.incremental import read_clean


@query("incremental_decontaminate", f"WITH {INDEX} SELECT * FROM documents WHERE doc_id NOT IN ({DIRTY})")
def incremental_decontaminate(spark, d):
    out = fresh(spark, "stream-out")
    # A table is one file or a folder of files. A stream takes a file only by a pattern, and below a pattern it reads folders too.
    job = start(
        spark, f"{d}/documents.parque[t]", table(spark, d, "documents").schema, table(spark, d, "benchmark"), "doc_id",
        F.col("text"), F.col("text"), out, fresh(spark, "stream-state"), N,
    )
    job.awaitTermination()
    return read_clean(spark, out)
