"""Exact top-k by inner product, with pivot-table elimination.

Vectors are made integers. An extra coordinate that fills every row up to the longest one turns inner products into
distances: |q - x|^2 = |q|^2 + M - 2 <q, x> for rows x of length M^(1/2) and queries q with 0 there. A table holds each
row's distances to PIVOTS pivots, picked farthest-first from a sample of SAMPLE rows (the one thing fitted on a sample;
every row is in the table and every result is exact). By the triangle inequality |d(q, p) - d(x, p)| bounds d(q, x) from
below for every pivot p; the largest bound counts. A query takes a block's rows in order of their bounds and stops at
the first whose bound exceeds the distance that its k-th best score so far means.

Queries are broadcast in blocks of QUERIES rows, one pass over the table for each. A task keeps k rows a query, and only
those that reach a floor known from the sample, so what is shuffled is small. The rest is a window over each query's few
rows from each task.

Defined results: vectors that are null, empty or hold a null or non-finite component, and rows with a null id, take no
part; rows with the query's id are its own; repeated candidates each take a rank; repeated queries are asked once;
vectors of another length than the query's are no candidates; with fewer candidates than k all are returned; an empty
table gives no rows; other columns are not read. Components and scores beyond a 64-bit integer take its end; up to there
all are exact.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from roadlake.llm.shared import Scratch, table

SCALE = 64
PIVOTS = 32
SAMPLE = 2_000
QUERIES = 4_096
#: Rows of the table for each task.
TASK_ROWS = 8_192
#: Rows and queries whose bounds are compared at a time, and rows that are evaluated before the next stop test.
_ROWS, _ASK, _STEP = 4_096, 64, 512
_LOW, _HIGH = -(1 << 63), (1 << 63) - 1
#: The largest double below 2 ** 63.
_TOP = float((1 << 63) - 1024)


def _integers(scale: float):
    """For mapInArrow over (id, vector): (id, dims, v, norm) of the valid rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, dims, vs, norms = [], [], [], []
            vectors = b.column("vector")
            values = vectors.flatten()
            numbers, known = values.to_numpy(zero_copy_only=False).astype(np.float64), values.is_valid().to_numpy(zero_copy_only=False)
            sizes = pa.compute.fill_null(pa.compute.list_value_length(vectors), 0).to_numpy()
            ends = np.cumsum(sizes)
            for i, n, end in zip(b.column("id").to_pylist(), sizes.tolist(), ends.tolist(), strict=True):
                part = slice(end - n, end)
                if i is None or not n or not known[part].all() or not np.isfinite(numbers[part]).all():
                    continue
                with np.errstate(over="ignore"):
                    v = np.floor(scale * numbers[part])
                ints = np.where(v > _TOP, _HIGH, np.where(v < _LOW, _LOW, np.clip(v, _LOW, _TOP).astype("<i8")))
                ids.append(i)
                dims.append(n)
                vs.append(ints.tobytes())
                norms.append(float((np.clip(v, _LOW, -float(_LOW)) ** 2).sum()))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(dims, pa.int32()), pa.array(vs, pa.binary()), pa.array(norms, pa.float64())], ["id", "dims", "v", "norm"])

    return run


def _matrix(column, dims: int) -> np.ndarray:
    return np.frombuffer(b"".join(column), "<i8").reshape(-1, dims)


def _exact(top: float):
    """A type in which inner products of vectors of squared length up to ``top`` are exact: Python's integers at last."""
    return np.float32 if top < 1 << 23 else np.float64 if top < 1 << 52 else np.int64 if top < 1 << 62 else object


def _whole(scores: np.ndarray) -> np.ndarray:
    """Scores as 64-bit integers; those beyond take the end."""
    return np.clip(scores, _LOW, _HIGH).astype(np.int64) if scores.dtype == object else scores.astype(np.int64)


def _filled(v: np.ndarray, norms: np.ndarray, top: float) -> np.ndarray:
    return np.c_[v.astype(np.float64), np.sqrt(np.maximum(0, top - norms))]


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0, (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * a @ b.T))


def farthest_first(rows: np.ndarray, n: int) -> np.ndarray:
    """Up to n rows, each the farthest from those before it."""
    picked = [0]
    far = ((rows - rows[0]) ** 2).sum(1)
    while len(picked) < min(n, len(rows)):
        picked.append(int(far.argmax()))
        far = np.minimum(far, ((rows - rows[picked[-1]]) ** 2).sum(1))
    return rows[picked]


def _table(pivots: Broadcast, dims: int, top: int):
    """For mapInArrow over (id, v, norm): adds the row's distances to the pivots."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not len(b):
                continue
            d = _distances(_filled(_matrix(b.column("v").to_pylist(), dims), b.column("norm").to_numpy(), top), pivots.value)
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("v"), pa.array([x.tobytes() for x in d.astype("<f4")], pa.binary())], ["id", "v", "d"])

    return run


class Search:
    """The running top k of a block of queries over rows that come in blocks."""

    def __init__(self, ids: np.ndarray, v: np.ndarray, pivots: np.ndarray, top: int, k: int, floors: np.ndarray) -> None:
        self.ids, self.k, self.top = ids, k, top
        self.v = v.astype(_exact(top))
        self.norms = (v.astype(np.float64) ** 2).sum(1)
        self.d = _distances(np.c_[v.astype(np.float64), np.zeros(len(v))], pivots).astype(np.float32)
        self.floors = floors.copy()  # scores that a row must reach
        self.best: list[list[tuple[int, int]]] = [[] for _ in ids]  # (-score, id), sorted
        self.evaluated = self.offered = 0

    def _limits(self, q: slice) -> np.ndarray:
        """Distances beyond which no row reaches the floor; a margin covers the rounding of the table."""
        square = self.norms[q] + self.top - 2 * self.floors[q].astype(np.float64)
        return np.sqrt(np.maximum(0, square)) * (1 + 1e-5) + 1e-5 * (1 + self.d[q].max(1, initial=0))

    def offer(self, ids: np.ndarray, rows: np.ndarray, d: np.ndarray) -> None:
        rows = rows.astype(self.v.dtype)
        margin = 1e-5 * (1 + float(d.max(initial=0)))
        for at in range(0, len(self.ids), _ASK):
            q = slice(at, min(at + _ASK, len(self.ids)))
            bound = np.zeros((q.stop - q.start, len(ids)), np.float32)
            for p in range(d.shape[1]):
                np.maximum(bound, np.abs(self.d[q, p][:, None] - d[:, p][None, :]), out=bound)
            order = np.argsort(bound, axis=1)
            bound = np.take_along_axis(bound, order, 1) - margin
            self.offered += bound.size
            for begin in range(0, len(ids), _STEP):
                go = np.flatnonzero(bound[:, begin] <= self._limits(q))
                if not len(go):
                    break
                part = order[go, begin : begin + _STEP]
                scores = _whole(np.matmul(rows[part], self.v[q][go][:, :, None])[:, :, 0])
                self.evaluated += scores.size
                hit = (scores >= self.floors[q][go][:, None]) & (ids[part] != self.ids[q][go][:, None])
                for n in np.flatnonzero(hit.any(1)):
                    self._keep(at + int(go[n]), scores[n][hit[n]], ids[part[n][hit[n]]])

    def _keep(self, n: int, scores: np.ndarray, ids: np.ndarray) -> None:
        best = sorted([*self.best[n], *zip((-scores).tolist(), ids.tolist(), strict=True)])[: self.k]
        self.best[n] = best
        if len(best) == self.k:
            self.floors[n] = max(self.floors[n], -best[-1][0])


_PART = "q bigint, query_id bigint, vec_id bigint, score bigint"


def _search(asked: Broadcast, dims: int, top: int, k: int):
    """For mapInArrow over the table: each query's best rows of this task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = asked.value
        search = Search(a["ids"], a["v"], a["pivots"], top, k, a["floors"])
        for b in batches:
            for at in range(0, len(b), _ROWS):
                part = b.slice(at, _ROWS)
                d = np.frombuffer(b"".join(part.column("d").to_pylist()), "<f4").reshape(len(part), -1)
                search.offer(part.column("id").to_numpy(), _matrix(part.column("v").to_pylist(), dims), d)
        rows = [(a["first"] + n, int(a["ids"][n]), i, -s) for n, best in enumerate(search.best) for s, i in best]
        cols = list(zip(*rows, strict=True)) or [[]] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["q", "query_id", "vec_id", "score"])

    return run


def _blocks(queries: DataFrame, size: int) -> Iterator[list]:
    held: list = []
    for row in queries.toLocalIterator():
        held.append(row)
        if len(held) == size:
            yield held
            held = []
    if held:
        yield held


def top_k(
    spark: SparkSession, vectors: DataFrame, queries: DataFrame, k: int, id_col: str = "vec_id", vector_col: str = "embedding", scale: float = SCALE, pivots: int = PIVOTS, query_block: int = QUERIES
) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k best rows of ``vectors`` for each row of ``queries``, ties to the smaller id."""
    scratch = Scratch(spark, "topk")
    schema = "id bigint, dims int, v binary, norm double"

    def integers(df: DataFrame) -> DataFrame:
        return df.select(F.col(id_col).cast("bigint").alias("id"), F.col(vector_col).cast("array<double>").alias("vector")).mapInArrow(_integers(scale), schema)

    asked_all = scratch.cut(integers(queries).distinct())
    rows_all = scratch.cut(integers(vectors))
    parts: list[DataFrame] = []
    first = 0
    for (dims,) in sorted(asked_all.select("dims").distinct().collect()):  # lengths of vectors: one, as a rule
        asked, rows = asked_all.where(F.col("dims") == dims), rows_all.where(F.col("dims") == dims)
        n, top = rows.agg(F.count("*"), F.max("norm")).first()
        if not n:
            continue
        top = max(top, asked.agg(F.max("norm")).first()[0])
        sample = rows.orderBy(F.xxhash64("id", "v"), "id").limit(SAMPLE).collect()
        sample_ids, sample_v = np.array([r.id for r in sample]), _matrix([r.v for r in sample], dims)
        picked = farthest_first(_filled(sample_v, np.array([r.norm for r in sample]), top), pivots)
        spread = max(spark.sparkContext.defaultParallelism, n // TASK_ROWS + 1)
        held = scratch.cut(rows.select("id", "v", "norm").repartition(int(spread)).mapInArrow(_table(spark.sparkContext.broadcast(picked), dims, top), "id bigint, v binary, d binary"))
        kind = _exact(top)
        for block in _blocks(asked.orderBy("id", "v"), query_block):
            ids, v = np.array([r.id for r in block]), _matrix([r.v for r in block], dims)
            known = v.astype(kind) @ sample_v.astype(kind).T  # scores of rows that exist: the k-th of them is a floor
            known = np.where(ids[:, None] == sample_ids[None, :], _LOW, _whole(known))
            floors = np.partition(known, -k, axis=1)[:, -k] if known.shape[1] >= k else np.full(len(ids), _LOW)
            sent = spark.sparkContext.broadcast({"ids": ids, "v": v, "pivots": picked, "floors": floors, "first": first})
            found = held.mapInArrow(_search(sent, dims, top, k), _PART)
            parts.append(found if len(block) < query_block else scratch.cut(found))
            first += len(block)
    if not parts:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score bigint")
    place = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "vec_id"))
    return reduce(DataFrame.union, parts).withColumn("rank", place).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op4_pivot_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector whose id is divisible by 20, against all."""
    vectors = table(spark, sf_dir, "embeddings")
    return top_k(spark, vectors, vectors.where("vec_id % 20 = 0"), 20)


OP4_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 20 = 0
), r AS (
  SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INT AS rank, vec_id, score FROM s
)
SELECT * FROM r WHERE rank <= 20
"""
