"""Request and response tables around a model that runs elsewhere."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalweave.functions import text as T
from evalweave.functions.arrays import let, positions
from evalweave.functions.hashing import text_slices
from evalweave.operators.broadcasts import spread
from evalweave.operators.ranks import collect_in_parts, with_group_position
from evalweave.session import cut_lineage

# Contexts that are broadcast at most, as each holds more than that share of all rows.
HOT_CONTEXTS = 10_000


def build_mc_requests(
    docs: DataFrame, context: Column, choices: str, delimiter: str = " ", unconditional: bool = False
) -> DataFrame:
    """One log-likelihood request per choice; with ``unconditional`` also one without context.

    The pair of a choice shares its ``idx``, so scoring pairs them by index.
    """
    kinds = [F.struct(F.lit(True).alias("conditional"), context.alias("context"))]
    if unconditional:
        kinds.append(F.struct(F.lit(False).alias("conditional"), F.lit("").alias("context")))
    return (
        docs.select("doc_id", F.posexplode(choices).alias("idx", "choice"), F.array(*kinds).alias("kinds"))
        .select("doc_id", "idx", "choice", F.explode("kinds").alias("k"))
        .select(
            "doc_id",
            "idx",
            F.lit("loglikelihood").alias("request_type"),
            "k.conditional",
            "k.context",
            F.concat(F.lit(delimiter), "choice").alias("continuation"),
        )
    )


def group_responses(responses: DataFrame, id_col: str, idx: str, fields: list[str]) -> DataFrame:
    """Responses of a document as one array ordered by request index.

    The requests of a document come from its own choices, so the array is as long
    as the choice list of that row was.
    """
    return responses.groupBy(id_col).agg(F.sort_array(F.collect_list(F.struct(idx, *fields))).alias("resps"))


def length_bucket_batches(
    df: DataFrame, settings: list[str], length: Column, id_col: str, batch_size: int
) -> DataFrame:
    """Batch number within equal settings, longest requests first.

    One settings value may cover most requests; the numbering is spread over
    slices of (settings, length), not one window per settings.
    """
    ranked = with_group_position(df.withColumn("_len", -length), settings, [F.col("_len"), F.col(id_col)], "rank")
    return ranked.drop("_len").withColumn("batch", F.floor(F.col("rank") / batch_size))


def group_by_context(requests: DataFrame, tokens: Column, id_cols: list[str]) -> DataFrame:
    """Requests with the representative that is scored for them.

    Requests share a forward pass when context plus continuation agree but for the
    last token. Long form: every request row names its group key and the smallest
    request id of the group, so no group is collected. Rows of frequent contexts are not shuffled: there are at most
    ``HOT_CONTEXTS`` contexts with more than that share of the rows, which are broadcast.
    """
    keyed = requests.withColumn(
        "context_key", F.sha2(F.array_join(F.slice(tokens, F.lit(1), F.size(tokens) - 1), " "), 256)
    )
    groups = cut_lineage(
        keyed.groupBy("context_key").agg(F.min(F.struct(*id_cols)).alias("scored"), F.count(F.lit(1)).alias("group_size"))
    )
    share = (groups.agg(F.sum("group_size")).first()[0] or 0) // HOT_CONTEXTS
    hot = groups.where(F.col("group_size") > share)
    rare = keyed.join(F.broadcast(hot.select("context_key")), "context_key", "left_anti")
    return keyed.join(F.broadcast(hot), "context_key").unionByName(
        rare.join(groups.where(F.col("group_size") <= share), "context_key")
    )


def restore_order(df: DataFrame, original: DataFrame, id_col: str) -> DataFrame:
    """Results joined back to the input and put in its order; the sort is for the sink."""
    return original.select(id_col).join(df, id_col).orderBy(id_col)


def rolling_token_windows(
    df: DataFrame, id_col: str, tokens: Column, prefix_token: str, max_len: int, context_len: int
) -> DataFrame:
    """Windows (input, predict) over a token list; together they predict every token once."""
    if not 1 <= context_len <= max_len:
        raise ValueError("context_len must lie between 1 and max_len")
    step = max_len - context_len + 1

    def build(t: Column) -> Column:
        n = F.size(t)
        first = F.least(F.lit(max_len), n)
        later = F.ceil(F.greatest(n - max_len, F.lit(0)) / step).cast("int")

        def window(k: Column) -> Column:
            start = first + (k - 1) * step
            end = F.least(n, start + step)
            return F.when(
                k == 0,
                F.struct(
                    F.concat(F.array(F.lit(prefix_token)), F.slice(t, F.lit(1), first - 1)).alias("input"),
                    F.slice(t, F.lit(1), first).alias("predict"),
                ),
            ).otherwise(
                F.struct(
                    F.slice(t, end - max_len, F.lit(max_len)).alias("input"),
                    F.slice(t, start + 1, end - start).alias("predict"),
                )
            )

        count = F.when(n > 0, later + 1).otherwise(F.lit(0))
        return F.transform(positions(count), window)

    return (
        spread(df, id_col)
        .select(id_col, F.posexplode(let(tokens, build)).alias("window", "w"))
        .select(id_col, "window", "w.input", "w.predict")
    )


def disjoint_context(context: Column, predict: Column) -> Column:
    """The part of the input that does not overlap the predicted tokens."""
    return F.slice(context, F.lit(1), F.size(context) - (F.size(predict) - 1))


def request_key(kind: Column, *args: Column) -> Column:
    return F.sha2(F.to_json(F.array(kind, *args)), 256)


def response_cache_join(requests: DataFrame, cache: DataFrame, key: Column, sampled: Column) -> DataFrame:
    """Requests with their cached response; ``source`` is cache, miss, or sampled (never cached)."""
    keyed = requests.withColumn("cache_key", F.when(~sampled, key))
    joined = keyed.join(cache.select("cache_key", "response").withColumn("_hit", F.lit(True)), "cache_key", "left")
    return joined.withColumn(
        "source",
        F.when(F.col("cache_key").isNull(), "sampled").when(F.col("_hit"), "cache").otherwise("miss"),
    ).drop("_hit")


def sample_hashes(doc: Column, prompt: Column, target: Column) -> list[Column]:
    return [
        F.sha2(doc, 256).alias("doc_hash"),
        F.sha2(prompt, 256).alias("prompt_hash"),
        F.sha2(target, 256).alias("target_hash"),
    ]


def task_hashes(samples: DataFrame, task: str, id_col: str, part_size: int = 100_000) -> DataFrame:
    """SHA-256 over the part hashes of a task.

    A part is ``part_size`` samples in id order, and its hash that of the concatenated
    sample hashes; one definition for tasks of every size, as one string of all
    hashes would not fit a task.
    """
    value = F.concat("doc_hash", "prompt_hash", "target_hash")
    parts = collect_in_parts(samples, [task], [F.col(id_col)], value, "hashes", part_size)
    hashed = parts.select(task, "part", F.sha2(F.array_join("hashes", ""), 256).alias("h"))
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("part", "h"))), lambda x: x["h"])
    return hashed.groupBy(task).agg(F.sha2(F.array_join(ordered, ""), 256).alias("task_hash"))


# Worst-case extra tokens per request type, and price tiers per 1,000 tokens.
EXTRA_TOKENS = {"loglikelihood": 0, "generate_until": 256, "loglikelihood_rolling": 2048}
PRICES = {"ada": 0.0008, "babbage": 0.0012, "curie": 0.006, "davinci": 0.06}


def token_cost_estimate(
    requests: DataFrame, task: str, request_type: str, tokens: Column, prices: dict[str, float] = PRICES
) -> DataFrame:
    """Tokens and cost per task with a total row, dearest first and the total last."""
    extra = F.try_element_at(
        F.create_map(*[F.lit(x) for kv in EXTRA_TOKENS.items() for x in kv]), F.col(request_type)
    )
    costs = requests.rollup(task).agg(F.sum((tokens + extra).cast("bigint")).alias("tokens"), F.grouping(task).alias("_t"))
    return (
        costs.withColumn(task, F.when(F.col("_t") == 1, "**Total**").otherwise(F.col(task)))
        .orderBy("_t", F.desc("tokens"), task)
        .select(task, "tokens", *[(F.col("tokens") / 1000 * p).alias(name) for name, p in prices.items()])
    )


# Bytes of text that are encoded at a time: an encoding takes hundreds of bytes for each token until its ids are read.
ENCODE_BYTES = 1 << 18


def tokenize_corpus(df: DataFrame, id_col: str, text_col: str, tokenizer_json: str) -> DataFrame:
    """Token ids and attention mask per row; the tokenizer is built once per task from its JSON.

    A worker holds the encodings of ``ENCODE_BYTES`` of text (at least one row), and hands their ids on before the next.
    """
    shared = df.sparkSession.sparkContext.broadcast(tokenizer_json)
    id_type = df.schema[id_col].dataType.simpleString()
    slices = text_slices(ENCODE_BYTES)

    def run(batches):
        import numpy as np
        import pyarrow as pa
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_str(shared.value)

        def lists(rows, kind):
            ends = np.cumsum([0, *map(len, rows)], dtype="int32")
            return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(rows) if rows else np.zeros(0, kind)))

        for batch in batches:
            for rows in slices(batch, 1):
                ids, masks = [], []
                for text in rows.column(1).to_pylist():
                    encoding = tokenizer.encode(text)
                    ids.append(np.array(encoding.ids, "int32"))
                    masks.append(np.array(encoding.attention_mask, "int8"))
                    del encoding
                yield pa.RecordBatch.from_arrays([*rows.columns, lists(ids, "int32"), lists(masks, "int8")], names=names)

    names = [id_col, text_col, "input_ids", "attention_mask"]
    return spread(df.select(id_col, text_col), id_col).mapInArrow(
        run, f"{id_col} {id_type}, {text_col} string, input_ids array<int>, attention_mask array<tinyint>"
    )


def byte_tokenizer() -> str:
    """A tokenizer with one token per UTF-8 byte, as JSON; needs no vocabulary file."""
    from tokenizers import Tokenizer, models, pre_tokenizers

    alphabet = sorted(pre_tokenizers.ByteLevel.alphabet())
    tokenizer = Tokenizer(models.BPE(vocab={c: i for i, c in enumerate(alphabet)}, merges=[]))
    tokenizer.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
    return tokenizer.to_str()


def completion_only_labels(turns: Column, ignore: int = -100) -> Column:
    """Token labels of a conversation: assistant tokens count, all others are ignored.

    ``turns`` is an array of structs with ``role`` and ``ids``.
    """
    return F.flatten(
        F.transform(
            turns,
            lambda t: F.when(t["role"] == "assistant", t["ids"]).otherwise(
                F.transform(t["ids"], lambda _: F.lit(ignore))
            ),
        )
    )


def count_words(text: Column) -> Column:
    return F.size(T.words(text))
