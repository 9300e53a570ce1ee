"""Evaluation analytics over graded attempts and result tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from evalweave.functions.arrays import positions

# Fixed value: verdicts in display order.
STATUSES = ["FE", "CE", "RE", "MLE", "TLE", "WA", "AC"]


def attempt_acceptance(tests: DataFrame) -> DataFrame:
    """Accepted iff every test is AC; failures in test order. An attempt has the tests of its problem."""
    failure = F.when(F.col("status") != "AC", F.struct("test_idx", "status"))
    return (
        tests.groupBy("problem_id", "attempt_idx")
        .agg(
            F.bool_and(F.col("status") == "AC").alias("accepted"),
            F.sort_array(F.collect_list(failure)).alias("_f"),
            F.count(F.lit(1)).alias("n_tests"),
        )
        .select(
            "problem_id",
            "attempt_idx",
            "accepted",
            F.when(~F.col("accepted"), F.array_join(F.transform("_f", lambda x: x["status"]), ", ")).alias("failure_reasons"),
            "n_tests",
        )
    )


def _per_problem(attempts: DataFrame, keys: list[str]) -> DataFrame:
    """First accepted attempt per problem; the attempts are combined map-side."""
    return attempts.groupBy(*keys).agg(
        F.min(F.when(F.col("accepted"), F.col("attempt_idx"))).alias("first_accepted")
    )


def pass_at_k(attempts: DataFrame, ks: list[int], keys: list[str] | None = None) -> DataFrame:
    """Problems with an accepted attempt among the first k; one pass for all k."""
    counts = _per_problem(attempts, keys or ["problem_id"]).agg(
        F.count(F.lit(1)).alias("total"), *[F.count_if(F.col("first_accepted") < k).alias(f"k{k}") for k in ks]
    )
    rows = F.array(*[F.struct(F.lit(k).alias("k"), F.col(f"k{k}").alias("passed")) for k in ks])
    return counts.select(F.explode(rows).alias("r"), "total").select(
        "r.k", "r.passed", "total", (F.col("r.passed") / F.col("total")).alias("accuracy")
    )


def pass_at_k_tokens(attempts: DataFrame, ks: list[int], tokens: str = "tokens") -> DataFrame:
    """Response tokens spent on the first k attempts of every problem: per index first, then cumulated."""
    per_index = attempts.where(F.col("attempt_idx") < max(ks)).groupBy("attempt_idx").agg(F.sum(tokens).alias("t"))
    sums = per_index.agg(*[F.sum(F.when(F.col("attempt_idx") < k, F.col("t"))).alias(f"k{k}") for k in ks])
    rows = F.array(*[F.struct(F.lit(k).alias("k"), F.col(f"k{k}").alias("tokens")) for k in ks])
    return sums.select(F.explode(rows).alias("r")).select("r.k", "r.tokens")


def unbiased_pass(n: Column, c: Column, k: int) -> Column:
    """1 - prod(1 - k/i) for i = n-c+1 .. n; 1 if fewer than k attempts failed."""
    miss = F.aggregate(
        positions(c.cast("int")), F.lit(1.0), lambda acc, j: acc * (1.0 - F.lit(float(k)) / (n - c + 1 + j))
    )
    return F.when(n - c < k, 1.0).otherwise(1.0 - miss)


def pass_at_k_unbiased(attempts: DataFrame, ks: list[int]) -> DataFrame:
    per = attempts.groupBy("problem_id").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("accepted")).alias("c")
    )
    sums = per.agg(*[F.avg(unbiased_pass(F.col("n"), F.col("c"), k)).alias(f"k{k}") for k in ks])
    rows = F.array(*[F.struct(F.lit(k).alias("k"), F.col(f"k{k}").alias("pass_at_k")) for k in ks])
    return sums.select(F.explode(rows).alias("r")).select("r.k", "r.pass_at_k")


def problems_solved(attempts: DataFrame) -> DataFrame:
    return _per_problem(attempts, ["problem_id"]).agg(
        F.count("first_accepted").alias("solved"), F.count(F.lit(1)).alias("total")
    )


def accuracy_by_rating(attempts: DataFrame, width: int = 200) -> DataFrame:
    """Solved share per rating bin; problems without rating are left out, empty bins are kept."""
    per = (
        attempts.where("rating IS NOT NULL")
        .groupBy("problem_id")
        .agg(F.max("rating").alias("rating"), F.bool_or("accepted").alias("solved"))
        .groupBy((F.floor(F.col("rating") / width) * width).alias("bin"))
        .agg(F.count_if("solved").alias("accepted"), F.count(F.lit(1)).alias("total"))
    )
    bins = per.agg(F.min("bin").alias("a"), F.max("bin").alias("b")).select(
        F.explode(F.sequence("a", "b", F.lit(width).cast("bigint"))).alias("bin")
    )
    filled = bins.join(per, "bin", "left")
    return filled.select(
        "bin",
        F.coalesce("accepted", F.lit(0)).alias("accepted"),
        F.coalesce("total", F.lit(0)).alias("total"),
        (100.0 * F.col("accepted") / F.col("total")).alias("accuracy"),
    )


def accuracy_by_tag(attempts: DataFrame, our_model: str, min_problems: int = 40) -> DataFrame:
    """Solved share per (model, tag) for tags with more than ``min_problems`` problems, ranked by one model."""
    solved = attempts.groupBy("model", "problem_id").agg(
        F.first("tags").alias("tags"), F.bool_or("accepted").alias("solved")
    )
    per = (
        solved.select("model", "solved", F.explode("tags").alias("tag"))
        .groupBy("model", "tag")
        .agg(F.count(F.lit(1)).alias("total"), (100.0 * F.avg(F.col("solved").cast("int"))).alias("accuracy"))
        .where(F.col("total") > min_problems)
    )
    # One row per tag below: tags are few.
    ours = per.where(F.col("model") == our_model).select(
        "tag", F.row_number().over(Window.orderBy(F.desc("accuracy"), "tag")).alias("tag_rank")
    )
    return per.join(ours, "tag").select("tag_rank", "tag", "model", "total", "accuracy")


def top_tags(df: DataFrame, k: int) -> DataFrame:
    """The k most frequent tags (k rows)."""
    return (
        df.select(F.explode("tags").alias("tag"))
        .groupBy("tag")
        .agg(F.count(F.lit(1)).alias("tag_total"))
        .orderBy(F.desc("tag_total"), "tag")
        .limit(k)
    )


def tag_model_tokens(attempts: DataFrame, k: int = 15) -> DataFrame:
    """Per top tag and model: accuracy and mean tokens; the tag "overall" counts every attempt once."""
    tags = top_tags(attempts, k).select("tag").unionByName(attempts.sparkSession.createDataFrame([("overall",)], "tag string"))
    return (
        attempts.select("model", "accepted", "tokens", F.explode(F.array_append("tags", F.lit("overall"))).alias("tag"))
        .join(F.broadcast(tags), "tag", "left_semi")
        .groupBy("tag", "model")
        .agg((100.0 * F.avg(F.col("accepted").cast("int"))).alias("accuracy"), F.avg("tokens").alias("avg_tokens"))
    )


def status_distribution(attempts: DataFrame) -> DataFrame:
    return attempts.groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def status_funnel(attempts: DataFrame) -> DataFrame:
    """Stage by stage how many attempts fail and how many are left."""
    stages = [("format", ["FE"]), ("compile", ["CE"]), ("runtime", ["RE"]), ("limits", ["MLE", "TLE"]), ("answer", ["WA"])]
    total = attempts.agg(
        F.count(F.lit(1)).alias("all"), *[F.count_if(F.col("status").isin(codes)).alias(name) for name, codes in stages]
    )
    left, rows = F.col("all"), []
    for i, (name, _) in enumerate(stages):
        left = left - F.col(name)
        rows.append(F.struct(F.lit(i + 1).alias("stage"), F.lit(name).alias("name"), F.col(name).alias("failed"), left.alias("passed")))
    return total.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def _status_counts() -> list[Column]:
    return [F.count_if(F.col("status") == s).alias(s) for s in STATUSES]


def tag_status_matrix(attempts: DataFrame, min_n: int = 20, k: int = 15) -> DataFrame:
    """Verdict counts of the most frequent tags with at least ``min_n`` attempts."""
    return (
        attempts.select("status", F.explode("tags").alias("tag"))
        .groupBy("tag")
        .agg(F.count(F.lit(1)).alias("total"), *_status_counts())
        .where(F.col("total") >= min_n)
        .orderBy(F.desc("total"), "tag")
        .limit(k)
    )


def rating_status_matrix(attempts: DataFrame, width: int = 300, min_n: int = 10) -> DataFrame:
    return (
        attempts.where("rating IS NOT NULL")
        .groupBy((F.floor(F.col("rating") / width) * width).alias("bin"))
        .agg(F.count(F.lit(1)).alias("total"), *_status_counts())
        .where(F.col("total") >= min_n)
    )


def rating_tag_heatmap(attempts: DataFrame, status: str, width: int = 200, min_n: int = 5, k: int = 15) -> DataFrame:
    """Share of one verdict per (rating bin, top tag); null below ``min_n``, absent cells included."""
    tags = top_tags(attempts, k).select("tag")
    cells = (
        attempts.where("rating IS NOT NULL")
        .select((F.floor(F.col("rating") / width) * width).alias("bin"), "status", F.explode("tags").alias("tag"))
        .join(F.broadcast(tags), "tag", "left_semi")
        .groupBy("bin", "tag")
        .agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("status") == status).cast("int")).alias("share"))
    )
    # All bins for every tag: both axes are short lists.
    bins = cells.agg(F.sort_array(F.collect_set("bin")))
    axes = tags.select("tag", F.explode(bins.scalar()).alias("bin"))
    return axes.join(cells, ["bin", "tag"], "left").select(
        "bin", "tag", F.coalesce("n", F.lit(0)).alias("n"), F.when(F.col("n") >= min_n, F.col("share")).alias("share")
    )


def heatmap_peak(heatmap: DataFrame) -> DataFrame:
    """The cell with the highest share, the first by (bin, tag) on ties."""
    return heatmap.where("share IS NOT NULL").orderBy(F.desc("share"), "bin", "tag").limit(1)


def token_length_histogram(df: DataFrame, source: str, tokens: str, bins: int = 50) -> DataFrame:
    """Counts per (source, bin) over the common range, empty bins included, with sums per bin over the sources."""
    span = df.agg(F.struct(F.min(tokens).alias("lo"), F.max(tokens).alias("hi"))).scalar()
    width = (span["hi"] - span["lo"]) / bins
    at = F.least(F.lit(bins - 1), F.floor((F.col(tokens) - span["lo"]) / F.nullif(width, F.lit(0.0))))
    counts = df.groupBy(source, F.coalesce(at, F.lit(0)).cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    axes = counts.select(source).distinct().select(source, F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    filled = axes.join(counts, [source, "bin"], "left").select(source, "bin", F.coalesce("n", F.lit(0)).alias("n"))
    stacked = F.sum("n").over(Window.partitionBy("bin").orderBy(source).rowsBetween(Window.unboundedPreceding, 0))
    return filled.select(source, "bin", "n", stacked.alias("stacked"))


def token_length_summary(df: DataFrame, tokens: str, group: list[str] | None = None) -> DataFrame:
    """Min, max, mean and median (exact; token counts repeat, so their distinct values are few)."""
    return df.groupBy(*(group or [])).agg(
        F.min(tokens).alias("min"),
        F.max(tokens).alias("max"),
        F.avg(tokens).alias("mean"),
        F.percentile(tokens, 0.5).alias("median"),
    )


# Coefficients of a published rational approximation of erfc.
ERFC = [
    -1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398, 1.48851587, -0.82215223,
    0.17087277,
]


def erfc(x: Column) -> Column:
    """Complementary error function for x >= 0, relative error below 1.2e-7."""
    t = 1.0 / (1.0 + 0.5 * x)
    poly = F.lit(0.0)
    for c in reversed(ERFC):
        poly = poly * t + c
    return t * F.exp(-x * x + poly)


def compare_models_z(a: DataFrame, b: DataFrame, key: list[str], alpha: float = 0.05) -> DataFrame:
    """Two-sided z test per task on values and standard errors of two models."""
    joined = a.select(*key, F.col("value").alias("a"), F.col("stderr").alias("ea")).join(
        b.select(*key, F.col("value").alias("b"), F.col("stderr").alias("eb")), key
    )
    z = (F.col("a") - F.col("b")) / F.nullif(F.sqrt(F.col("ea") * F.col("ea") + F.col("eb") * F.col("eb")), F.lit(0.0))
    p = erfc(F.abs(F.col("z")) / 2**0.5)
    return joined.withColumn("z", z).withColumn("p_value", p).withColumn("same", F.col("p_value") > alpha)


def regression_diff(results: DataFrame, base: str, prefer: list[str] = ("acc_norm", "acc", "word_perplexity")) -> DataFrame:
    """Preferred metric per (branch, task, model) times 100, and its difference to the base branch.

    ``results``: branch, task, model, metric, value. A task missing on the base counts as 0 there.
    """
    wide = results.groupBy("branch", "task", "model").agg(
        *[F.max(F.when(F.col("metric") == m, F.col("value"))).alias(m) for m in prefer]
    )
    picked = wide.select("branch", "task", "model", (100.0 * F.coalesce(*prefer, F.lit(0.0))).alias("value"))
    ref = picked.where(F.col("branch") == base).select("task", "model", F.col("value").alias("base_value"))
    return picked.join(ref, ["task", "model"], "left").withColumn(
        "diff", F.col("value") - F.coalesce("base_value", F.lit(0.0))
    )


def results_table(results: DataFrame) -> DataFrame:
    """Printable rows: repeated task, version and filter labels blank, values to four digits.

    ``results``: task, version, filter, n_shot, metric, higher_is_better, value, stderr.
    """
    row = Window.partitionBy("task").orderBy("filter", "metric")

    def once(col: str, extra: Column | None = None) -> Column:
        same = F.lag(F.col(col).cast("string")).over(row) == F.col(col).cast("string")
        return F.when(same, "").otherwise(F.col(col).cast("string"))

    arrow = F.when(F.col("higher_is_better"), "↑").when(~F.col("higher_is_better"), "↓").otherwise("")
    return results.select(
        "task",
        F.row_number().over(row).alias("row"),
        F.when(F.row_number().over(row) == 1, F.col("task")).otherwise("").alias("tasks"),
        once("version").alias("version"),
        once("filter").alias("filter"),
        F.col("n_shot").alias("n_shot"),
        "metric",
        arrow.alias("direction"),
        # Halves go to the even digit, as in printf.
        F.format_string("%.4f", F.bround("value", 4)).alias("value"),
        F.when(F.col("stderr").isNull(), "N/A").otherwise(F.format_string("%.4f", F.bround("stderr", 4))).alias("stderr"),
    )


def sample_export(samples: DataFrame, output_type: str, filter_name: str | None = None) -> DataFrame:
    """Flat per-sample rows for inspection: id, input text, its length, label and model output.

    ``samples`` has doc_id, prompt, target and, by output type: choices and lls
    (multiple_choice), continuation and is_greedy (loglikelihood), ll
    (loglikelihood_rolling), filtered_resps (generate_until).
    """
    data, label, extra = F.col("prompt"), F.col("target"), []
    if output_type == "multiple_choice":
        listed = F.array_join(F.transform("choices", lambda c: F.concat(F.lit("- "), c)), "\n")
        data = F.concat("prompt", F.lit("\n\n"), listed)
        output = F.array_join(F.col("lls").cast("array<string>"), ", ")
        extra = [F.size("lls").alias("num_answers")]
    elif output_type == "loglikelihood":
        label = F.col("continuation")
        output = F.when(F.col("is_greedy"), "correct").otherwise("incorrect")
    elif output_type == "loglikelihood_rolling":
        output = F.col("ll").cast("string")
    else:
        output = F.get("filtered_resps", F.lit(0))
        extra = [F.length(output).alias("output_length")]
    row_id = F.col("doc_id").cast("string")
    return samples.select(
        (row_id if filter_name is None else F.concat(row_id, F.lit(f".{filter_name}"))).alias("id"),
        "doc_id",
        data.alias("data"),
        F.length(data).alias("input_len"),
        label.alias("labels"),
        F.lit(output_type).alias("output_type"),
        output.alias("output"),
        *extra,
    )
