"""Exact top-k search by inner product.

Method: MaxScore over shards. A shard's vectors are its postings, a dimension with its largest and smallest value a term
with a score bound. For each query the dimensions are split by falling bounds: the first, as many as it takes for the
others' bounds to sum to less than the score to beat, are essential and are scored for all vectors; the others are
probed only for vectors whose score so far can, with the bounds of what is left, still reach that score. The score to beat
is the k-th best so far: a task meets its shards one after another and carries each query's list on. Tasks' lists are merged.

Shards stay where they are read: no vector is shuffled. Queries are packed into blocks, and blocks go to all tasks in passes of
a bounded size; a task streams its vectors, one shard at a time, past the pass's queries, and reports the best of each.
What is shuffled is these lists. A pass reads the vectors once more, so there are as many readings as the queries fill
passes, and the driver holds one pass at a time.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelspark.llm.common import materialize, sliced

#: Vectors in a shard and queries in a block; bytes of queries in a pass.
SHARD_ROWS, QUERY_ROWS, PASS_BYTES = 4096, 1024, 32 << 20
_BLOCK = "block long, ids binary, dims int, cells binary"


def _blocks(rows: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, made = TaskContext.get().partitionId() << 32, 0
        held: list[tuple[int, list[int]]] = []

        def flush() -> pa.RecordBatch:
            nonlocal held, made
            dims = max(len(v) for _, v in held)
            cells = np.zeros((len(held), dims), "<i8")
            for r, (_, v) in enumerate(held):
                cells[r, : len(v)] = v
            row = [[base + made], [np.array([i for i, _ in held], "<i8").tobytes()], [dims], [cells.tobytes()]]
            held, made = [], made + 1
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(row, (pa.int64(), pa.binary(), pa.int32(), pa.binary()))], ["block", "ids", "dims", "cells"])

        for batch in sliced(batches):
            for i, v in zip(batch.column("_id").to_pylist(), batch.column("_vec").to_pylist()):
                held.append((i, v))
                if len(held) == rows:
                    yield flush()
        if held:
            yield flush()

    return run


def max_score(query: np.ndarray, own: int, ids: np.ndarray, cells: np.ndarray, high: np.ndarray, low: np.ndarray, k: int, beat: float = -np.inf, step: int = 16) -> tuple[np.ndarray, np.ndarray]:
    """(ids, scores) of the k best rows of cells with a score of ``beat`` at least, best first, ties to the smaller id; never
    the row ``own``. Whole numbers beyond 2**53 are multiplied as integers."""
    bound = np.maximum(query * high, query * low)
    order = np.argsort(-bound, kind="stable")
    left = np.concatenate((np.cumsum(bound[order][::-1])[::-1], [0]))
    least = np.concatenate((np.cumsum(np.minimum(query * high, query * low)[order][::-1])[::-1], [0]))
    # the essential dimensions: a vector that has nothing in them cannot beat the score
    essential = int(np.argmax(left < beat)) if left[-1] < beat else len(order) if beat > -np.inf else step
    first = min(len(order), max(1, essential))
    cuts = [*range(first, len(order), step), len(order)]
    alive = np.flatnonzero(ids != own)
    score = np.zeros(len(alive), cells.dtype)
    done = 0
    for end in cuts:
        dims = order[done:end]
        score = score + cells[np.ix_(alive, dims)] @ query[dims]
        done = end
        if len(alive) > k:  # what every row reaches for certain gives the k-th best of this shard
            beat = max(beat, np.partition(score, len(score) - k)[len(score) - k] + least[done])
        keep = score + left[done] >= beat
        alive, score = alive[keep], score[keep]
        if not len(alive):
            break
    best = np.lexsort((ids[alive], -score))[:k]
    return ids[alive][best], score[best]


class Lists:
    """The best of each query of a block, as shards go by."""

    def __init__(self, ids: bytes, dims: int, cells: bytes, k: int):
        self.ids, self.k = np.frombuffer(ids, "<i8"), k
        self.cells = np.frombuffer(cells, "<i8").reshape(len(self.ids), dims)
        self.best: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * len(self.ids)

    def meet(self, ids: np.ndarray, cells: np.ndarray) -> None:
        q = self.cells
        dims = min(cells.shape[1], q.shape[1])
        cells, q = cells[:, :dims], q[:, :dims]
        if dims and float(np.abs(cells).max()) * float(np.abs(q).max()) * dims < 2**53:
            cells, q = np.asfortranarray(cells, np.float64), q.astype(np.float64)
        high, low = (cells.max(axis=0), cells.min(axis=0)) if dims else (np.zeros(0), np.zeros(0))
        for i, v in enumerate(q):
            had, scores = self.best[i]
            new, more = max_score(v, int(self.ids[i]), ids, cells, high, low, self.k, scores[-1] if len(scores) == self.k else -np.inf)
            had, scores = np.concatenate((had, new)), np.concatenate((scores, more.astype(np.int64)))
            first = np.lexsort((had, -scores))[: self.k]
            self.best[i] = had[first], scores[first]

    def told(self) -> pa.RecordBatch:
        n = [len(b[0]) for b in self.best]
        return pa.RecordBatch.from_arrays([pa.array(np.repeat(self.ids, n)), pa.array(np.concatenate([b[0] for b in self.best])), pa.array(np.concatenate([b[1] for b in self.best]))], ["query_id", "vec_id", "score"])


def _search(blocks: Broadcast, k: int) -> Callable:
    """The task's vectors against all of a pass's queries: the best of each query."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lists = [Lists(*b, k) for b in blocks.value]
        for batch in _blocks(SHARD_ROWS)(batches):
            ids, dims, cells = (batch.column(c)[0].as_py() for c in ("ids", "dims", "cells"))
            n = np.frombuffer(ids, "<i8")
            for one in lists:
                one.meet(n, np.frombuffer(cells, "<i8").reshape(len(n), dims))
        for one in lists:
            yield one.told()

    return run


def exact_top_k(vectors: DataFrame, is_query: Column, k: int = 10, id_col: str = "vec_id", vec_col: str = "_vec") -> DataFrame:
    """(query_id, rank, vec_id, score): for each row that ``is_query`` selects, its k best other rows by inner
    product of integer vectors. Ties go to the smaller id. Vectors of unequal length are multiplied over the
    dimensions that both have. Rows with a null id or vector take no part; rows with the query's own id are no
    candidates for it. Repeated rows are candidates each, and repeated queries have one answer. Other columns are left.
    An empty table, or no query, gives no row."""
    spark = vectors.sparkSession
    rows = vectors.where(F.col(id_col).isNotNull() & F.col(vec_col).isNotNull()).select(F.col(id_col).cast("long").alias("_id"), F.col(vec_col).alias("_vec"), is_query.alias("_is_query"))
    asked = rows.where("_is_query").select("_id", "_vec").dropDuplicates(["_id", "_vec"])
    queries = materialize(asked.mapInArrow(_blocks(QUERY_ROWS), _BLOCK), "queries")
    # only numbers and sizes of blocks pass through one window
    upto = F.sum(F.octet_length("ids") + F.octet_length("cells")).over(Window.orderBy("block"))
    numbers = queries.select("block", F.floor(upto / PASS_BYTES).cast("int").alias("turn"))
    turns = sorted(r["turn"] for r in numbers.select("turn").distinct().collect())
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    found = spark.createDataFrame([], "query_id long, vec_id long, score long, rank int")
    for turn in turns:
        part = queries.join(numbers.where(F.col("turn") == turn), "block").select("ids", "dims", "cells").collect()
        sent = spark.sparkContext.broadcast([(bytes(r["ids"]), r["dims"], bytes(r["cells"])) for r in part])
        met = rows.select("_id", "_vec").mapInArrow(_search(sent, k), "query_id long, vec_id long, score long")
        met = met.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
        found = found.unionByName(materialize(met, "found") if len(turns) > 1 else met)
    if len(turns) > 1:  # an id that repeats with other vectors may be in two passes
        found = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return found.select("query_id", "rank", "vec_id", "score")


def op10_topk(spark, sf_dir: str) -> DataFrame:
    """The ten best of every vector whose id is divisible by 100."""
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    x = F.col("embedding")
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == F.lit(float("inf"))))
    table = table.where(x.isNotNull() & ~bad).select("vec_id", F.transform(x, lambda v: F.floor(v.cast("double") * 1024)).alias("_vec"))
    return exact_top_k(table, F.col("vec_id") % 100 == 0, 10)


OP10_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS q
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS query_id, b.vec_id, CAST(list_inner_product(CAST(a.q AS DOUBLE[]), CAST(b.q AS DOUBLE[])) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""
