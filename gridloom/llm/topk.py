"""Exact top-k inner products over norm-sorted vectors with rotated partial sums."""

from __future__ import annotations

from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridloom.llm.work import Work

#: Vectors that a task scores at a time, and queries that one pass carries to it.
CHUNK, QUERY_BLOCK = 2048, 4096
#: Longest vectors looked at first for a lower bound on every query's k-th score.
SEEDS = 2048
#: Largest sum that doubles hold exactly; beyond it scores are made of Python integers.
EXACT = float(1 << 53)


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.empty((0, 0))


def scaled(df: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """``(id, x)``, x the floored components; rows with null or non-finite parts or a null id are left out."""
    at = F.col(vector_col)
    parts = F.transform(at, lambda v: F.floor(v.cast("double") * scale).cast("double"))
    fine = F.forall(at, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v.cast("double")) < float("inf")))
    return df.where(at.isNotNull() & F.col(id_col).isNotNull() & fine & (F.size(at) > 0)).select(F.col(id_col).cast("long").alias("id"), parts.alias("x"))


class _Search:
    """One block of queries against vectors that come in any order."""

    def __init__(self, ids: np.ndarray, q: np.ndarray, rotation: np.ndarray, k: int, floor: np.ndarray):
        self.ids, self.q, self.k, self.rotation = ids, q, k, rotation
        self.length = np.sqrt((q * q).sum(1))
        self.turned = q @ rotation
        self.cut = max(1, q.shape[1] // 4)
        head = self.turned[:, : self.cut]
        self.rest = np.sqrt(np.maximum(self.length**2 - (head * head).sum(1), 0))
        self.floor = floor.copy()  # no score below it can be among the k best
        self.best: list[list[tuple]] = [[] for _ in ids]

    def scan(self, ids: np.ndarray, x: np.ndarray) -> None:
        if not len(ids) or not len(self.ids) or x.shape[1] != self.q.shape[1]:
            return
        length = np.sqrt((x * x).sum(1))
        order = np.argsort(-length, kind="stable")
        slack = 1 + 1e-9
        for at in range(0, len(order), CHUNK):
            rows = order[at : at + CHUNK]
            # everything from here on is no longer than the first: queries it cannot reach are done
            live = np.flatnonzero(self.length * length[rows[0]] * slack + 1e-6 >= self.floor)
            if not len(live):
                return
            part, own = x[rows], ids[rows]
            turned = part @ self.rotation[:, : self.cut]
            rest = np.sqrt(np.maximum(length[rows] ** 2 - (turned * turned).sum(1), 0))
            bound = self.turned[live, : self.cut] @ turned.T + np.outer(self.rest[live], rest)
            margin = 1e-9 * np.outer(self.length[live], length[rows]) + 1e-6
            hits = bound + margin >= self.floor[live][:, None]
            for row, q in enumerate(live):
                found = np.flatnonzero(hits[row])
                if len(found):
                    self._take(q, own[found], part[found])

    def _take(self, q: int, ids: np.ndarray, x: np.ndarray) -> None:
        keep = ids != self.ids[q]
        ids, x = ids[keep], x[keep]
        if not len(ids):
            return
        if np.abs(x).max(initial=0) * np.abs(self.q[q]).max(initial=0) * x.shape[1] < EXACT:
            scores = (x @ self.q[q]).astype(np.int64).tolist()
        else:
            own = [int(v) for v in self.q[q]]
            scores = [sum(int(a) * b for a, b in zip(row, own)) for row in x]
        merged = dict(((i, s) for s, i in self.best[q]))
        for i, s in zip(ids.tolist(), scores):
            if s >= self.floor[q] and (i not in merged or merged[i] < s):
                merged[i] = s
        self.best[q] = sorted(((s, i) for i, s in merged.items()), key=lambda p: (-p[0], p[1]))[: self.k]
        if len(self.best[q]) == self.k:
            self.floor[q] = max(self.floor[q], float(self.best[q][-1][0]))

    def rows(self) -> list[tuple[int, int, int]]:
        return [(int(q), i, max(-(1 << 63), min(s, (1 << 63) - 1))) for q, best in zip(self.ids, self.best) for s, i in best]


def top_k(vectors: DataFrame, queries, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 10, scale: int = 1024) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: each query's k highest inner products.

    ``queries`` is a condition that picks the query rows of ``vectors``;
    candidates are all rows but those of the query's own id. Scores are exact
    integers of the floored ``scale * x``; ties go to the smaller id. Vectors that
    are null, empty or hold a null or non-finite part take no part, nor do rows
    without an id; vectors of another dimension than the query's are no
    candidates of it; scores beyond a long become its limit. An id of several rows counts once, with its best score. An
    empty table gives an empty result; other columns are ignored.

    Queries go in blocks of ``QUERY_BLOCK`` (so a broadcast has a fixed bound) to
    all vectors where they lie: nothing is shuffled but each task's k best. A
    task takes its vectors by descending length and stops once length times
    length cannot reach the query's floor; within a chunk, a quarter of the
    SVD-rotated coordinates plus the product of the remaining lengths bounds each
    score, and only what may reach the floor is multiplied out. The first floor
    comes from the ``SEEDS`` longest vectors of all.
    """
    spark = vectors.sparkSession
    work = Work(spark, "topk")
    base = scaled(vectors, id_col, vector_col, scale)
    asked = scaled(vectors.where(queries), id_col, vector_col, scale)
    dims = sorted(r[0] for r in asked.select(F.size("x").alias("d")).distinct().collect())
    schema = T.StructType([T.StructField("query_id", T.LongType()), T.StructField("vec_id", T.LongType()), T.StructField("score", T.LongType())])
    parts = []
    for d in dims:
        rows = base.where(F.size("x") == d)
        rotation = _rotation(rows, d)
        seeds = rows.orderBy(F.aggregate("x", F.lit(0.0), lambda a, v: a + v * v).desc(), "id").limit(SEEDS).collect()
        seed_ids, seed_x = np.array([r.id for r in seeds], np.int64), np.array([r.x for r in seeds])
        block = []
        for row in chain(asked.where(F.size("x") == d).dropDuplicates(["id"]).toLocalIterator(), [None]):
            if row is not None:
                block.append(row)
            if block and (row is None or len(block) == QUERY_BLOCK):
                ids, q = np.array([r.id for r in block], np.int64), np.array([r.x for r in block])
                first = _Search(ids, q, rotation, k, np.full(len(ids), -np.inf))
                first.scan(seed_ids, seed_x)
                sent = spark.sparkContext.broadcast((ids, q, rotation, first.floor))
                name = f"best-{len(parts)}"
                work.table(rows.mapInArrow(_scanner(sent, k), schema), name)
                parts.append(work.path(name))
                sent.destroy()
                block = []
    if not parts:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    best = spark.read.schema(schema).parquet(*parts).groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return best.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _rotation(rows: DataFrame, d: int) -> np.ndarray:
    """The right singular vectors of all rows, strongest first, from the d x d sums of products."""

    def run(batches):
        total = np.zeros((d, d))
        for batch in batches:
            x = _matrix(batch.column(0))
            if len(x):
                total += (x / 1024).T @ (x / 1024)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(d), pa.int32()), pa.array(list(total))], names=["i", "sums"])

    sums = rows.select("x").mapInArrow(run, "i int, sums array<double>").select("i", F.posexplode("sums").alias("j", "v")).groupBy("i", "j").agg(F.sum("v").alias("v")).collect()
    gram = np.zeros((d, d))
    for i, j, v in sums:
        gram[i, j] = v
    gram = (gram + gram.T) / 2
    if not np.isfinite(gram).all():
        return np.eye(d)
    return np.linalg.eigh(gram)[1][:, ::-1].copy()


def _scanner(sent, k: int):
    def run(batches):
        ids, q, rotation, floor = sent.value
        search = _Search(ids, q, rotation, k, floor)
        for batch in batches:
            search.scan(batch.column(0).to_numpy(), _matrix(batch.column(1)))
        rows = search.rows()
        yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], pa.int64()) for c in range(3)], names=["query_id", "vec_id", "score"])

    return run
