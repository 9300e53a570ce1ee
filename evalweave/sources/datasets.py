"""Parquet datasets: one split or subset in, split-partitioned datasets out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def load_corpus(spark: SparkSession, path: str, **equals) -> DataFrame:
    """Rows whose columns equal the given values, e.g. ``split="train", subset="code"``.

    The filters reach the scan: as partition pruning on partition columns, as
    pushed row-group filters otherwise.
    """
    df = spark.read.parquet(path)
    for col, value in equals.items():
        df = df.where(F.col(col) == value)
    return df


def save_dataset(df: DataFrame, path: str, split: str | None = "split") -> None:
    """Write Parquet, one folder per split when there is a split column."""
    writer = df.write.mode("overwrite")
    if split is not None and split in df.columns:
        writer = writer.partitionBy(split)
    writer.parquet(path)


def load_dataset_dir(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def write_overlap_report(report: DataFrame, path: str) -> None:
    """Overlap rows as JSON lines."""
    report.write.mode("overwrite").json(path)
