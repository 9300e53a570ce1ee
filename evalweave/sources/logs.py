"""Sample logs, grader logs and result files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# One line of a code-evaluation sample log.
SAMPLE_LOG = (
    "doc struct<id:string,rating:int,tags:array<string>,official_tests:array<struct<input:string,output:string>>,"
    "generated_checker:string,time_limit:double,memory_limit:double>, resps array<array<string>>"
)

# One line of a scored-sample log, without its metric columns.
SCORED_LOG = (
    "doc_id bigint, doc string, target string, arguments string, resps array<array<string>>, "
    "filtered_resps array<string>, filter string, metrics array<string>, doc_hash string, prompt_hash string, "
    "target_hash string"
)


def read_sample_logs(spark: SparkSession, path: str, schema: str = SAMPLE_LOG, names: str = "*.jsonl") -> DataFrame:
    """All files below a folder whose names match ``names``, with an explicit schema."""
    return spark.read.schema(schema).option("recursiveFileLookup", "true").option("pathGlobFilter", names).json(path)


def attempts_of(logs: DataFrame) -> DataFrame:
    """One row per (problem, attempt) of a sample log."""
    return logs.select(
        F.col("doc.id").alias("problem_id"),
        F.col("doc.rating").alias("rating"),
        F.col("doc.tags").alias("tags"),
        F.posexplode(F.get("resps", F.lit(0))).alias("attempt_idx", "response"),
    )


def latest_by_name(files: DataFrame) -> DataFrame:
    """Newest path per (model, task) by the timestamp in the file name; timestamps compare as strings.

    Paths end in ``<model>/samples_<task>_<timestamp>.jsonl``.
    """
    name = F.substring_index("path", "/", -1)
    parts = files.select(
        "path",
        F.element_at(F.split("path", "/"), -2).alias("model"),
        F.regexp_extract(name, r"^[^_]*_(.*)_[^_]*$", 1).alias("task"),
        F.regexp_extract(name, r"_([^_]*)\.jsonl$", 1).alias("stamp"),
    )
    return parts.groupBy("model", "task").agg(F.max_by("path", "stamp").alias("path"), F.max("stamp").alias("stamp"))


def write_sample_files(samples: DataFrame, path: str) -> DataFrame:
    """One file ``<model>/samples_<task>_<stamp>.jsonl`` below ``path`` per run; returns (model, task, stamp, samples) per file.

    ``samples`` has model, task, stamp and ``line`` (a JSON text). A run's lines are put together by its own three names; a file is
    written by one task, line by line, under the name that readers look for.
    """
    keys = ["model", "task", "stamp"]

    def run(batches):
        import pyarrow as pa
        from pyarrow import fs

        where, root = fs.FileSystem.from_uri(path)
        name, out, done = None, None, []
        for batch in batches:
            for row in batch.to_pylist():
                now = tuple(row[k] for k in keys)
                if now != name:
                    if out is not None:
                        out.close()
                    name = now
                    done.append([*now, 0])
                    where.create_dir(f"{root}/{now[0]}", recursive=True)
                    out = where.open_output_stream(f"{root}/{now[0]}/samples_{now[1]}_{now[2]}.jsonl")
                out.write(row["line"].encode() + b"\n")
                done[-1][3] += 1
        if out is not None:
            out.close()
        columns = list(zip(*done)) or [[], [], [], []]
        yield pa.RecordBatch.from_arrays(
            [*(pa.array(c, pa.string()) for c in columns[:3]), pa.array(columns[3], pa.int64())], names=[*keys, "samples"]
        )

    rows = samples.select(*keys, "line").repartition(*keys).sortWithinPartitions(*keys)
    return rows.mapInArrow(run, "model string, task string, stamp string, samples bigint")


def latest_result_files(spark: SparkSession, path: str) -> DataFrame:
    """``latest_by_name`` over the sample files below a folder; only names are read."""
    files = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", "samples_*.jsonl")
        .load(path)
        .select("path")
    )
    return latest_by_name(files)


def read_latest_samples(spark: SparkSession, path: str, schema: str = SCORED_LOG) -> DataFrame:
    """Rows of the newest sample file of every (model, task)."""
    rows = read_sample_logs(spark, path, schema).withColumn("path", F.col("_metadata.file_path"))
    latest = latest_result_files(spark, path)
    return rows.join(latest, "path")


def write_grader_log(attempts: DataFrame, path: str) -> None:
    """One JSON object per problem with its attempts by name (an attempt list is as long as the repeat count)."""
    entry = F.struct(
        F.concat(F.lit("attempt_"), F.col("attempt_idx").cast("string")).alias("key"),
        F.struct("response", "accepted", "failure_reasons").alias("value"),
    )
    (
        attempts.groupBy("problem_id")
        .agg(
            F.first("rating").alias("ratings"),
            F.first("tags").alias("tags"),
            F.map_from_entries(F.collect_list(entry)).alias("attempts"),
        )
        .write.mode("overwrite")
        .json(path)
    )


GRADER_LOG = (
    "problem_id bigint, ratings int, tags array<string>, "
    "attempts map<string,struct<response:string,accepted:boolean,failure_reasons:string>>"
)


def read_grader_log(spark: SparkSession, path: str) -> DataFrame:
    """Grader log back as (problem, attempt) rows."""
    return (
        spark.read.schema(GRADER_LOG)
        .json(path)
        .select("problem_id", "ratings", "tags", F.explode("attempts").alias("name", "a"))
        .select(
            "problem_id",
            F.regexp_extract("name", r"(\d+)$", 1).cast("bigint").alias("attempt_idx"),
            F.col("ratings").alias("rating"),
            "tags",
            "a.response",
            "a.accepted",
            "a.failure_reasons",
        )
    )


def write_results(results: DataFrame, path: str) -> None:
    """Aggregated results as JSON lines, one folder per model."""
    results.write.mode("overwrite").partitionBy("model").json(path)


def write_samples(samples: DataFrame, path: str) -> None:
    """Per-sample rows as JSON lines, one folder per model and task."""
    samples.write.mode("overwrite").partitionBy("model", "task").json(path)
