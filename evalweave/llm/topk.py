"""Exact top-k by inner product: columnar branch-and-bound.

Vectors are cut into blocks, held by dimension (one row of a block's matrix per dimension). A pair of a query block and
a candidate block adds up the products group of dimensions by group of dimensions. After each group, what a candidate can
still gain is at most the product of the lengths of the two remaining parts; candidates that cannot reach the query's
k-th score any more are dropped, and the survivors are compacted before the next group.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from evalweave.llm.common import small_batches, stored

QUERIES = 512
CANDIDATES = 4096
GROUP = 16


def quantised(df: DataFrame, id_col: str, vector: str, scale: int = 1024) -> DataFrame:
    """(id, v): floor(scale * x) of every component x as a double. Vectors that are null or hold a null or non-finite
    component, and rows without id, are left out."""
    x = F.col(vector)
    finite = ~F.exists(x, lambda c: c.isNull() | F.isnan(c.cast("double")) | (F.abs(c.cast("double")) == float("inf")))
    return df.where(x.isNotNull() & F.col(id_col).isNotNull() & finite).select(
        F.col(id_col).alias("id"), F.transform(x, lambda c: F.floor(c.cast("double") * scale)).alias("v")
    )


def _pack(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """Vectors -> blocks of at most ``size`` of one dimension: ids and the matrix, dimension by dimension."""
    for batch in batches:
        lists, ids = batch.column("v"), batch.column("id").to_numpy(zero_copy_only=False)
        lengths = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
        flat, ends = lists.flatten().to_numpy(zero_copy_only=False), np.cumsum(lengths)
        for dim in np.unique(lengths).tolist():
            rows = np.flatnonzero(lengths == dim)
            for at in range(0, len(rows), size):
                part = rows[at : at + size]
                matrix = np.stack([flat[ends[i] - dim : ends[i]] for i in part]).astype("<i8").T
                yield pa.RecordBatch.from_arrays(
                    [pa.array([dim], pa.int32()), pa.array([ids[part].astype("<i8").tobytes()]), pa.array([np.ascontiguousarray(matrix).tobytes()])],
                    names=["dim", "ids", "matrix"],
                )


def _blocks(df: DataFrame, size: int) -> DataFrame:
    return df.mapInArrow(lambda batches: _pack(batches, size), "dim int, ids binary, matrix binary")


def _better(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best: highest score first, ties to the smaller id."""
    return np.lexsort((ids, -scores))[:k]


def branch_and_bound(query: np.ndarray, rest: np.ndarray, block: np.ndarray, norms: np.ndarray, floor: float, k: int):
    """(places, scores) of a block's candidates that may be among the k best of one query.

    ``rest[g]`` and ``norms[g]`` are the lengths of what remains after g groups, of the query and of each candidate. ``floor``
    is a score that k candidates seen before reach. Sums are exact integers; the bounds are rounded outwards.
    """
    places, partial = np.arange(block.shape[1]), np.zeros(block.shape[1], np.int64)
    groups = range(0, len(query), GROUP)
    for g, at in enumerate(groups, 1):
        columns = block[at : at + GROUP] if len(places) == block.shape[1] else block[at : at + GROUP, places]
        partial = partial + query[at : at + GROUP] @ columns
        if g == len(groups):
            break
        slack = rest[g] * norms[g][places] * (1 + 1e-9) + 1
        if len(places) > k:
            # The k-th best of what each candidate has for certain.
            sure = np.partition(partial - slack, len(places) - k)[len(places) - k]
            floor = max(floor, sure)
        alive = partial + slack >= floor
        if not alive.all():
            places, partial = places[alive], partial[alive]
    return places, partial


def _rests(matrix: np.ndarray) -> np.ndarray:
    """Lengths of the remaining part after 0, 1, ... groups, one column per vector."""
    squares = matrix.astype(np.float64) ** 2
    return np.stack([np.sqrt(squares[at:].sum(axis=0)) for at in range(0, len(matrix), GROUP)])


def _search(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        held = None
        for batch in batches:
            for q, dim, q_ids, q_raw, c_ids, c_raw in zip(*[batch.column(i).to_pylist() for i in range(6)]):
                if q != held:  # rows are sorted by query block
                    yield _best_rows(best)
                    best, held = {}, q
                qid, cid = np.frombuffer(q_ids, "<i8"), np.frombuffer(c_ids, "<i8")
                queries, block = np.frombuffer(q_raw, "<i8").reshape(dim, len(qid)), np.frombuffer(c_raw, "<i8").reshape(dim, len(cid))
                # Doubles multiply faster and are exact where the sums stay below 2^53.
                limit = float(np.abs(queries).max(initial=0)) * float(np.abs(block).max(initial=0)) * max(dim, 1)
                if limit < 2**52:
                    queries, block = queries.astype(np.float64), block.astype(np.float64)
                q_rest, c_rest = (_rests(queries), _rests(block)) if dim else (None, None)
                for j, query_id in enumerate(qid.tolist()):
                    old_scores, old_ids = best.get(query_id, (np.zeros(0, np.int64), np.zeros(0, np.int64)))
                    floor = float(old_scores[-1]) if len(old_scores) == k else -np.inf
                    if dim:
                        # One more, as the query itself takes no part.
                        places, scores = branch_and_bound(np.ascontiguousarray(queries[:, j]), q_rest[:, j], block, c_rest, floor, k + 1)
                    else:
                        places, scores = np.arange(len(cid)), np.zeros(len(cid), np.int64)
                    other = cid[places] != query_id
                    scores = np.concatenate([old_scores, scores[other].astype(np.int64)])
                    ids = np.concatenate([old_ids, cid[places][other]])
                    keep = _better(scores, ids, k)
                    best[query_id] = scores[keep], ids[keep]
        yield _best_rows(best)

    return run


def _best_rows(best: dict[int, tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    none = [np.zeros(0, np.int64)]
    return pa.RecordBatch.from_arrays(
        [
            pa.array(np.concatenate(none + [np.full(len(ids), q, np.int64) for q, (_, ids) in best.items()])),
            pa.array(np.concatenate(none + [ids for _, ids in best.values()])),
            pa.array(np.concatenate(none + [scores for scores, _ in best.values()])),
        ],
        names=["query_id", "vec_id", "score"],
    )


def exact_topk(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best of ``vectors`` for each of ``queries`` (both: id, v), ties to the smaller id.

    A query's own id takes no part. Vectors of another dimension than the query's are no candidates. Every query block
    meets every candidate block once; blocks, not vectors, are dealt to tasks, and a task keeps k rows per query. Repeated
    ids: each row is a candidate; rows of one query id are taken as one query if equal. If there are fewer than k
    candidates, all are returned; no queries or no vectors give no rows.
    """
    small_batches(vectors.sparkSession)
    parts = max(1, int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    asked = stored(_blocks(queries.distinct(), QUERIES).withColumn("q", F.monotonically_increasing_id()), "queries")
    held = _blocks(vectors, CANDIDATES).withColumnsRenamed({"ids": "c_ids", "matrix": "c_matrix"})
    # Block against block: the query set is stated, and a block of it is a few hundred KB.
    names = asked.select("q", F.col("dim").alias("q_dim"))
    pairs = (
        held.join(F.broadcast(names), F.col("dim") == F.col("q_dim"))
        .drop("q_dim")
        .withColumn("salt", F.pmod(F.xxhash64("c_ids"), F.lit(parts)))
        .join(asked.drop("dim"), "q")
        .repartition(parts, "q", "salt")
        .sortWithinPartitions("q")
        .select("q", "dim", "ids", "matrix", "c_ids", "c_matrix")
    )
    found = pairs.mapInArrow(_search(k), "query_id bigint, vec_id bigint, score bigint")
    # Tasks give k rows a query each; a first cut by salt keeps what meets in one task small.
    order = [F.col("score").desc(), F.col("vec_id")]
    for by in (["query_id", F.pmod(F.col("vec_id"), F.lit(16))], ["query_id"]):
        found = found.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= k)
    return found.select("query_id", "rank", "vec_id", "score")
