"""Index build as a relational dataflow over shards of bounded size.

A shard (hash of the id) holds at most about ``params.shard_rows`` rows, so the quadratic
neighbour step inside a shard stays bounded and the whole build is linear in the table.

1. every vector gets a level and 8-bit codes (``make_points``);
2. inside a shard and layer each node meets the nodes that precede it (batch, then level
   descending, then id) and keeps its ``ef_cons`` nearest: every node but the first has an
   earlier partner, which keeps a layer connected;
3. diverse selection keeps at most ``m`` of them;
4. edges are made symmetric and capped natively: both ends must rank the edge within the
   cap.  The edge to a node's nearest predecessor always stays (``tree``), a documented slack
   over the cap that guarantees connectivity.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..params import IndexParams
from .knn import ordered_distance, rounding
from .points import check_vectors, make_points

CANDIDATES = "shard int, layer int, node long, nid long, dist double, rank int, kept boolean"


@dataclass(frozen=True)
class Index:
    """points(shard, batch, vec_id, embedding, level, q_*); edges(shard, layer, src, dst, dist, tree)."""

    points: DataFrame
    edges: DataFrame
    params: IndexParams
    shards: int


def shard_of(vec_id: Column, shards: int) -> Column:
    return F.pmod(F.xxhash64(vec_id), F.lit(shards)).cast("int")


def nearest_before(vectors: np.ndarray, ids: np.ndarray, own: int, ef: int, block: int = 1024):
    """For rows ``own..`` the ``ef`` nearest rows of smaller position, by (distance, id).

    A blocked matrix product picks all that rounding does not tell from the ``ef``-th or nearer; exact
    distances settle the order.
    """
    sq = np.einsum("ij,ij->i", vectors, vectors)
    margin = rounding(sq, sq.max(initial=0.0), vectors.shape[1])
    for lo in range(own, len(vectors), block):
        hi = min(lo + block, len(vectors))
        d = sq[None, :hi] - 2.0 * (vectors[lo:hi] @ vectors[:hi].T)
        for i in range(lo, hi):
            if not i:
                continue
            row = d[i - lo, :i]
            take = np.flatnonzero(row <= np.partition(row, ef - 1)[ef - 1] + margin[i]) if i > ef else np.arange(i)
            dist = ordered_distance(np.broadcast_to(vectors[i], (len(take), vectors.shape[1])), vectors[take])
            best = np.lexsort((ids[take], dist))[:ef]
            yield i, take[best], dist[best]


def diverse(dist: np.ndarray, vectors: np.ndarray, m: int, refill: bool = True) -> np.ndarray:
    """Positions kept of candidates sorted by (distance, id).

    A candidate stays when it is nearer to the query than to every kept one; with ``refill``
    the nearest refused ones fill up to ``m``.
    """
    sq = np.einsum("ij,ij->i", vectors, vectors)
    between = np.sqrt(np.maximum(0.0, sq[:, None] + sq[None, :] - 2.0 * (vectors @ vectors.T)))
    kept: list[int] = []
    for i in range(len(dist)):
        if len(kept) == m:
            break
        if all(dist[i] < between[i, j] for j in kept):
            kept.append(i)
    if refill and len(kept) < m:
        kept += [i for i in range(len(dist)) if i not in set(kept)][: m - len(kept)]
    return np.array(sorted(kept), dtype=int)


def decode(pdf: pd.DataFrame) -> np.ndarray:
    codes = np.array(pdf["q_codes"].tolist(), dtype=np.float64).reshape(len(pdf), -1)
    return codes * pdf["q_delta"].to_numpy()[:, None] + pdf["q_min"].to_numpy()[:, None]


def candidates(points: DataFrame, params: IndexParams, since_batch: int = 0, quantized: bool = True, refill: bool = True) -> DataFrame:
    """``shard, layer, node, nid, dist, rank, kept`` for nodes of batches from ``since_batch`` on."""
    ef, m = params.ef_cons, params.m

    def of_shard(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.assign(new=pdf["batch"] >= since_batch).sort_values(["new", "level", "vec_id"], ascending=[True, False, True], ignore_index=True)
        every = decode(pdf) if quantized else np.array(pdf["embedding"].tolist(), dtype=np.float64)
        shard, rows = int(pdf["shard"].iloc[0]) if len(pdf) else 0, []
        for layer in range(int(pdf["level"].max()) + 1 if len(pdf) else 0):
            at = np.flatnonzero(pdf["level"].to_numpy() >= layer)
            vectors, ids = every[at], pdf["vec_id"].to_numpy()[at]
            own = int((~pdf["new"].to_numpy()[at]).sum())
            for i, near, dist in nearest_before(vectors, ids, own, ef):
                kept = np.zeros(len(near), bool)
                kept[diverse(dist, vectors[near], m, refill)] = True
                rows.append((np.full(len(near), ids[i]), ids[near], dist, np.arange(1, len(near) + 1), kept, np.full(len(near), layer)))
        cols = [np.concatenate(c) for c in zip(*rows, strict=True)] if rows else [np.zeros(0)] * 6
        return pd.DataFrame({"shard": shard, "layer": cols[5], "node": cols[0], "nid": cols[1], "dist": cols[2], "rank": cols[3], "kept": cols[4].astype(bool)})

    columns = ["shard", "batch", "vec_id", "level", *(["q_min", "q_delta", "q_codes"] if quantized else ["embedding"])]
    return points.select(*columns).groupBy("shard").applyInPandas(of_shard, CANDIDATES)


def symmetric(selected: DataFrame) -> DataFrame:
    """Selected candidates as edges stored both ways; an edge is ``tree`` if it was some node's nearest."""
    ends = F.explode(F.array(F.struct(F.col("node").alias("src"), F.col("nid").alias("dst")), F.struct(F.col("nid").alias("src"), F.col("node").alias("dst"))))
    return (
        selected.where("kept")
        .select("shard", "layer", ends.alias("e"), "dist", (F.col("rank") == 1).alias("tree"))
        .groupBy("shard", "layer", "e.src", "e.dst")
        .agg(F.min("dist").alias("dist"), F.max("tree").alias("tree"))
    )


def capped(edges: DataFrame, params: IndexParams) -> DataFrame:
    """Edges that both ends rank within the layer's cap by (distance, id), and tree edges."""
    rank = F.row_number().over(Window.partitionBy("shard", "layer", "src").orderBy("dist", "dst"))
    cap = F.when(F.col("layer") == 0, F.lit(params.mmax0)).otherwise(F.lit(params.mmax))
    ranked = edges.withColumn("within", rank <= cap)
    both = ranked.groupBy("shard", "layer", F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).agg(
        F.min("within").alias("within"), F.max("tree").alias("tree"), F.min("dist").alias("dist")
    )
    ends = F.explode(F.array(F.struct(F.col("a").alias("src"), F.col("b").alias("dst")), F.struct(F.col("b").alias("src"), F.col("a").alias("dst"))))
    return both.where("within or tree").select("shard", "layer", ends.alias("e"), "dist", "tree").select("shard", "layer", "e.src", "e.dst", "dist", "tree")


def build(vectors: DataFrame, params: IndexParams) -> Index:
    """Build over ``vec_id, embedding``.  Every row is checked: NULL, empty and non-finite vectors and
    vectors of another width than ``params.dim`` (or than the others) raise ``ValueError``."""
    rows, width = check_vectors(vectors, params.dim)
    params = replace(params, dim=width if params.dim is None else params.dim)
    shards = max(1, -(-rows // params.shard_rows))
    points = make_points(vectors, params).withColumns({"shard": shard_of(F.col("vec_id"), shards), "batch": F.lit(0)})
    return Index(points, capped(symmetric(candidates(points, params)), params), params, shards)


def insert(index: Index, vectors: DataFrame, batch: int) -> Index:
    """Add vectors with fresh ids, checked like those of ``build``.  They follow every older node in the order, so a
    newcomer of a higher level is linked downward and the older graph stays reachable from the new entry point."""
    _, width = check_vectors(vectors, index.params.dim)
    params = replace(index.params, dim=width if index.params.dim is None else index.params.dim)
    new = make_points(vectors, params).withColumns({"shard": shard_of(F.col("vec_id"), index.shards), "batch": F.lit(batch)})
    points = index.points.unionByName(new)
    fresh = symmetric(candidates(points, params, since_batch=batch))
    return Index(points, capped(index.edges.unionByName(fresh), params), params, index.shards)


def extended(edges: DataFrame) -> DataFrame:
    """``src, dst``: neighbours and their neighbours, the candidates that selection can be widened to."""
    e = edges.select("src", "dst")
    hop = e.join(e.select(F.col("src").alias("dst"), F.col("dst").alias("to")), "dst").where("src <> to").select("src", F.col("to").alias("dst"))
    return hop.union(e).distinct()


def layer(index: Index, number: int) -> DataFrame:
    """Edges of one layer; the predicate prunes folders of a stored index."""
    return index.edges.where(F.col("layer") == number)


def layer_count(index: Index) -> int:
    return int(index.points.agg(F.coalesce(F.max("level") + 1, F.lit(0))).first()[0])


def membership(points: DataFrame) -> DataFrame:
    """``layer, node``: a node of level L is in layers 0..L."""
    return points.select(F.explode(F.sequence(F.lit(0), F.col("level"))).alias("layer"), F.col("vec_id").alias("node"))


def layer_caps(points: DataFrame, params: IndexParams) -> DataFrame:
    top = points.agg(F.max("level").alias("top"))
    layer = F.explode(F.sequence(F.lit(0), F.col("top"))).alias("layer")
    return top.select(layer).select("layer", F.when(F.col("layer") == 0, 2 * params.m).otherwise(params.m).cast("int").alias("cap"))


def entry_point(points: DataFrame) -> DataFrame:
    """The first node of the top layer in insertion order, for each shard."""
    order = F.struct(-F.col("level"), F.col("batch"), F.col("vec_id"))
    return points.groupBy("shard").agg(F.min_by("vec_id", order).alias("ep"), F.max("level").alias("top"))


def first_point(points: DataFrame) -> DataFrame:
    """The first node of the top layer in insertion order, of all shards: one row, none of an empty table."""
    return points.orderBy(F.desc("level"), "batch", "vec_id").limit(1).select(F.col("vec_id").alias("ep"), F.col("level").alias("top"))
