"""Exact nearest neighbours."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import is_finite, l2

#: Most queries sent to the tasks at once; larger sets are answered block by block.
QUERY_BLOCK = 20_000
#: Pairs whose exact distances are taken at once.
PAIRS = 50_000


def ordered_distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances of matching rows, each a left-to-right sum of squares."""
    if not len(a):
        return np.zeros(0)
    return np.sqrt(np.add.accumulate((a - b) ** 2, axis=1)[:, -1])


def rounding(norm: np.ndarray | float, other: float, width: int) -> np.ndarray | float:
    """By how much two rough distances (squares, less a constant) can be apart when the exact ones tie."""
    return 8 * (width + 8) * np.finfo(np.float64).eps * (np.sqrt(norm) + np.sqrt(other)) ** 2


def matrix(column: pa.Array) -> np.ndarray:
    """Lists of one width as rows of doubles, without Python objects in between."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.astype(np.float64).reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def nearest_in_batch(ids: np.ndarray, x: np.ndarray, qids: np.ndarray, q: np.ndarray, k: int, keep_self: bool):
    """Per query the k nearest rows of a batch: a matrix product picks all rows that rounding does not
    tell from the k-th or nearer, exact distances and ids order them."""
    sq = (x * x).sum(axis=1)
    rough = sq[None, :] - 2.0 * (q @ x.T)
    if not keep_self:
        rough[qids[:, None] == ids[None, :]] = np.inf
    if k < len(ids):
        last = np.partition(rough, k - 1, axis=1)[:, k - 1] + rounding((q * q).sum(axis=1), sq.max(), x.shape[1])
        row, at = np.nonzero((rough <= last[:, None]) & (rough < np.inf))
    else:
        row, at = np.nonzero(rough < np.inf)
    steps = [slice(lo, lo + PAIRS) for lo in range(0, len(row), PAIRS)]
    dist = np.concatenate([np.zeros(0), *[ordered_distance(q[row[s]], x[at[s]]) for s in steps]])
    order = np.lexsort((ids[at], dist, row))
    row, at, dist = row[order], at[order], dist[order]
    first = np.searchsorted(row, np.arange(len(q)))
    keep = np.arange(len(row)) - first[row] < k
    return qids[row[keep]], ids[at[keep]], dist[keep]


def best(qid: np.ndarray, nid: np.ndarray, dist: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k first rows of each query by (distance, id)."""
    order = np.lexsort((nid, dist, qid))
    qid, nid, dist = qid[order], nid[order], dist[order]
    head = np.flatnonzero(np.concatenate([[True], qid[1:] != qid[:-1]])) if len(qid) else np.zeros(0, np.int64)
    place = np.arange(len(qid)) - np.repeat(head, np.diff(np.append(head, len(qid))))
    keep = place < k
    return qid[keep], nid[keep], dist[keep]


def exact(points: DataFrame, queries: DataFrame, k: int, vector: str = "embedding", keep_self: bool = True) -> DataFrame:
    """``qid, nid, dist, rank``: the k nearest points by (distance, id) for each query.

    Points are scanned in place; a block of at most ``QUERY_BLOCK`` queries goes to every task.
    A task sends k rows for a query to the ranking, whatever the number of its points.
    Rows without a finite vector are no neighbours and no queries.
    """
    spark = points.sparkSession
    q = queries.select("qid", "embedding").where(is_finite(F.col("embedding")))
    head = q.limit(QUERY_BLOCK + 1).collect()
    blocks = 1 if len(head) <= QUERY_BLOCK else -(-q.count() // QUERY_BLOCK)
    p = points.select(F.col("vec_id").alias("nid"), F.col(vector).alias("pv")).where(is_finite(F.col(vector)))
    out = None
    for b in range(blocks):
        # one bounded block at a time
        rows = head if blocks == 1 else q.where(F.pmod(F.xxhash64("qid"), F.lit(blocks)) == b).collect()
        block = spark.sparkContext.broadcast((np.array([r[0] for r in rows], np.int64), np.array([r[1] for r in rows], np.float64)))

        def run(batches, block=block):
            qids, qv = block.value
            held, rows = [], 0
            for batch in batches:
                for lo in range(0, len(batch), 4096):
                    part = batch.slice(lo, 4096)
                    x = matrix(part.column("pv"))
                    for at in range(0, len(qids), 512):
                        held.append(nearest_in_batch(part.column("nid").to_numpy(), x, qids[at : at + 512], qv[at : at + 512], k, keep_self))
                        rows += len(held[-1][0])
                    if rows > 4 * k * len(qids):
                        held = [best(*(np.concatenate(c) for c in zip(*held, strict=True)), k)]
                        rows = len(held[0][0])
            if held:
                made = best(*(np.concatenate(c) for c in zip(*held, strict=True)), k)
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in made], names=["qid", "nid", "dist"])

        pairs = p.mapInArrow(run, "qid long, nid long, dist double")
        out = pairs if out is None else out.unionByName(pairs)
    return top_k(out, k)


def top_k(pairs: DataFrame, k: int, group: str = "qid") -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(group).orderBy("dist", "nid"))
    return pairs.withColumn("rank", rank.cast("long")).where(F.col("rank") <= k)


def nearest(points: DataFrame, query: Column, k: int, vector: str = "embedding") -> DataFrame:
    """The k nearest points to one ad-hoc vector: a top-k plan, without a full sort."""
    return points.select(F.col("vec_id").alias("nid"), l2(F.col(vector), query).alias("dist")).orderBy("dist", "nid").limit(k)


def ranking(points: DataFrame, query: Column, vector: str = "embedding") -> DataFrame:
    return points.select(F.col("vec_id").alias("nid"), l2(F.col(vector), query).alias("dist")).orderBy("dist", "nid")
