"""Recall, compliance and statistics of an index."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import dequantize
from ..params import IndexParams
from . import knn
from .build import Index, membership


def recall(truth: DataFrame, found: DataFrame) -> DataFrame:
    """One row: hits, expected pairs and their ratio."""
    pairs = truth.select("qid", "nid").distinct()
    hit = found.select("qid", "nid", F.lit(1).alias("hit")).distinct()
    both = pairs.join(hit, ["qid", "nid"], "left")
    return both.agg(F.count("hit").alias("hits"), F.count("*").alias("expected"), (F.count("hit") / F.count("*")).alias("recall"))


def layer_degrees(index: Index) -> DataFrame:
    """``layer, node, degree`` with zero for nodes without edges."""
    n = index.edges.groupBy("layer", F.col("src").alias("node")).agg(F.count("*").alias("n"))
    return membership(index.points).join(n, ["layer", "node"], "left").select("layer", "node", F.coalesce("n", F.lit(0)).alias("degree"))


def violations(degrees: DataFrame, params: IndexParams) -> DataFrame:
    """Nodes over 110 % of the cap, or alone in a layer of several nodes."""
    size = degrees.groupBy("layer").agg(F.count("*").alias("nodes"))
    cap = F.when(F.col("layer") == 0, F.lit(params.mmax0)).otherwise(F.lit(params.mmax))
    both = degrees.join(F.broadcast(size), "layer")
    return both.where((F.col("degree") > F.ceil(cap * F.lit(1.1))) | ((F.col("degree") == 0) & (F.col("nodes") > 1))).select("layer", "node", "degree")


def degree_range(degrees: DataFrame) -> DataFrame:
    return degrees.groupBy("layer").agg(F.count("*").alias("nodes"), F.min("degree").alias("min_degree"), F.max("degree").alias("max_degree")).where("nodes > 1")


def errors_in_batch(ids: np.ndarray, x: np.ndarray, dx: np.ndarray, qids: np.ndarray, q: np.ndarray, dq: np.ndarray, least: float) -> tuple[int, float]:
    """Pairs at a distance of queries and rows (full, decoded), and the largest of ``least`` and their relative errors.

    Matrix products tell pairs that are apart and whose error cannot be the largest; exact distances, the others."""
    other = qids[:, None] != ids[None, :]

    def rough(a, b):
        norms = (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None, :]
        return norms - 2.0 * (a @ b.T), (1 << 20) * 16 * (a.shape[1] + 8) * np.finfo(np.float64).eps * norms

    def exact(row, at):
        n, top = 0, least
        for lo in range(0, len(row), knn.PAIRS):
            r, c = row[lo : lo + knn.PAIRS], at[lo : lo + knn.PAIRS]
            full, back = knn.ordered_distance(q[r], x[c]), knn.ordered_distance(dq[r], dx[c])
            apart = ~(full <= 0)  # NaN counts, as it does in SQL
            n += int(apart.sum())
            top = float(np.max(np.abs(full - back)[apart] / full[apart], initial=top))  # NaN is the largest
        return n, top

    with np.errstate(all="ignore"):
        (full, near), (back, near_back) = rough(q, x), rough(dq, dx)
        sure = (full > near) & (back > near_back) & (full < np.inf) & (back < np.inf)  # right to a millionth
        n, top = exact(*np.nonzero(other & ~sure))
        sure &= other
        error = np.where(sure, np.abs(1.0 - np.sqrt(back / full)), -1.0)
        if sure.any():
            least = top
            _, top = exact(*(np.array([i]) for i in np.unravel_index(np.argmax(error), error.shape)))
            least = top
            _, top = exact(*np.nonzero(error + 4e-6 * (1.0 + error) >= np.where(sure, top, np.inf)))
    return n + int(sure.sum()), top


def quantization_error(points: DataFrame, queries: DataFrame) -> DataFrame:
    """Relative error of distances between decoded vectors: the pairs asked for that are apart, and the largest error.

    Points are scanned in place; a block of at most ``knn.QUERY_BLOCK`` queries goes to every task, which returns a row.
    Vectors that are NULL or hold NULL, and pairs of different widths, have no distance."""
    spark, back = points.sparkSession, dequantize(F.col("q_min"), F.col("q_delta"), F.col("q_codes"))
    whole = F.col("embedding").isNotNull() & ~F.exists("embedding", lambda x: x.isNull()) & (F.size("embedding") > 0)
    p = points.where(whole & F.col("vec_id").isNotNull()).select(F.col("vec_id").alias("id"), F.col("embedding").alias("full"), back.alias("back"))
    q = p.join(queries.select(F.col("qid").alias("id")), "id")
    n = q.count()
    blocks, out = max(1, -(-n // knn.QUERY_BLOCK)), None
    for b in range(blocks):
        # one bounded block at a time
        by_width: dict[int, list] = {}
        for r in q.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == b).collect():
            by_width.setdefault(len(r["full"]), []).append(r)
        block = spark.sparkContext.broadcast({w: (np.array([r["id"] for r in rows], np.int64), np.array([r["full"] for r in rows], np.float64), np.array([r["back"] for r in rows], np.float64)) for w, rows in by_width.items()})

        def run(batches, block=block):
            pairs, top = 0, -1.0
            for batch in batches:
                for lo in range(0, len(batch), 2048):
                    part = batch.slice(lo, 2048)
                    width = np.array([len(v) for v in part.column("full")])
                    for w in np.unique(width):
                        if int(w) not in block.value:
                            continue
                        rows, (qids, full, back) = part.filter(pa.array(width == w)), block.value[int(w)]
                        ids, x, dx = rows.column("id").to_numpy(), knn.matrix(rows.column("full")), knn.matrix(rows.column("back"))
                        for at in range(0, len(qids), 512):
                            s = slice(at, at + 512)
                            more, top = errors_in_batch(ids, x, dx, qids[s], full[s], back[s], top)
                            pairs += more
            yield pa.RecordBatch.from_arrays([pa.array([pairs]), pa.array([top if pairs else None], pa.float64())], names=["pairs", "max_error"])

        found = p.mapInArrow(run, "pairs long, max_error double")
        out = found if out is None else out.unionByName(found)
    return out.agg(F.coalesce(F.sum("pairs"), F.lit(0)).alias("pairs"), F.max("max_error").alias("max_error"))


def statistics(index: Index) -> DataFrame:
    nodes = membership(index.points).groupBy("layer").agg(F.count("*").alias("nodes"))
    edges = index.edges.groupBy("layer").agg(F.count("*").alias("edges"))
    return nodes.join(edges, "layer", "left").select("layer", "nodes", F.coalesce("edges", F.lit(0)).alias("edges"))
