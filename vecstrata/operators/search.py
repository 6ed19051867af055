"""Approximate search: beam search in every shard's graph, then a global top-k."""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import knn
from .build import Index, decode
from .knn import ordered_distance


def beam(vectors: np.ndarray, links: list, query: np.ndarray, entry: list[tuple[float, int]], ids: np.ndarray, ef: int) -> list[tuple[float, int, int]]:
    """Best-first search of one layer.  ``entry`` and the result hold (distance, id, position)."""
    seen = {p for _, _, p in entry}
    todo, kept = list(entry), [(-d, -i, p) for d, i, p in entry]
    heapq.heapify(todo)
    heapq.heapify(kept)
    while todo:
        d, _, p = heapq.heappop(todo)
        if len(kept) >= ef and d > -kept[0][0]:
            break
        fresh = [x for x in links[p] if x not in seen]
        if not fresh:
            continue
        seen.update(fresh)
        for x, dx in zip(fresh, np.sqrt(((vectors[fresh] - query) ** 2).sum(1)).tolist(), strict=True):
            i = int(ids[x])
            if len(kept) < ef:
                heapq.heappush(kept, (-dx, -i, x))
            elif (dx, i) < (-kept[0][0], -kept[0][1]):
                heapq.heapreplace(kept, (-dx, -i, x))
            else:
                continue
            heapq.heappush(todo, (dx, i, x))
    return sorted((-d, -i, p) for d, i, p in kept)


def search_shard(nodes: pd.DataFrame, queries: pd.DataFrame, k: int, ef: int) -> pd.DataFrame:
    nodes = nodes.sort_values(["level", "batch", "vec_id"], ascending=[False, True, True], ignore_index=True)
    vectors, ids = decode(nodes), nodes["vec_id"].to_numpy()
    place = {int(v): i for i, v in enumerate(ids)}
    top = int(nodes["level"].iloc[0])
    layers: list[list] = [[()] * len(nodes) for _ in range(top + 1)]
    for at, lists in enumerate(nodes["adjacency"]):
        for entry in lists if lists is not None else ():
            layers[entry["layer"]][at] = [place[int(x)] for x in entry["near"]]
    def entry(q):
        found = [(float(np.sqrt(((vectors[0] - q) ** 2).sum())), int(ids[0]), 0)]
        for layer in range(top, 0, -1):
            found = beam(vectors, layers[layer], q, found, ids, 1)[:1]
        return found

    if ef >= len(nodes):
        asked = np.array([quantized(np.asarray(q, dtype=np.float64)) for q in queries["embedding"]])
        return walked(vectors, ids, layers[0], queries["qid"].to_numpy(), asked, entry, k)
    out = []
    for qid, q in zip(queries["qid"], queries["embedding"], strict=True):
        q = quantized(np.asarray(q, dtype=np.float64))
        found = entry(q)
        best = [p for _, _, p in beam(vectors, layers[0], q, found, ids, ef)]
        dist = ordered_distance(np.broadcast_to(q, (len(best), len(q))), vectors[best])
        order = np.lexsort((ids[best], dist))[:k]
        out.append(pd.DataFrame({"qid": qid, "nid": ids[best][order], "dist": dist[order]}))
    return pd.concat(out) if out else pd.DataFrame({"qid": pd.Series(dtype="int64"), "nid": pd.Series(dtype="int64"), "dist": pd.Series(dtype="float64")})


def parts_of(links: list) -> np.ndarray:
    """For each node the number of its connected part of a layer."""
    part, number = np.full(len(links), -1), -1
    for first in range(len(links)):
        if part[first] < 0:
            number += 1
            part[first], todo = number, [first]
            while todo:
                fresh = [x for x in links[todo.pop()] if part[x] < 0]
                part[fresh] = number
                todo += fresh
    return part


def walked(vectors: np.ndarray, ids: np.ndarray, links: list, qids: np.ndarray, q: np.ndarray, entry, k: int) -> pd.DataFrame:
    """What a beam as wide as the layer returns.  It neither ends early nor drops a node, so it keeps the connected
    part of its entry: parts are walked once for all queries, and the nodes of a query's part are ranked in blocks."""
    part, place = parts_of(links), np.arange(len(q))
    own = np.zeros(len(q), int) if part.max() == 0 else np.array([part[entry(v)[0][2]] for v in q])
    held = [(place[:0], ids[:0], np.zeros(0))]
    for number in np.unique(own):
        nodes, asked = np.flatnonzero(part == number), np.flatnonzero(own == number)
        for lo in range(0, len(asked), 512):
            some, found = asked[lo : lo + 512], []
            for at in range(0, len(nodes), 4096):
                near = nodes[at : at + 4096]
                found.append(knn.nearest_in_batch(ids[near], vectors[near], some, q[some], k, keep_self=True))
            held.append(knn.best(*(np.concatenate(c) for c in zip(*found, strict=True)), k))
    row, nid, dist = (np.concatenate(c) for c in zip(*held, strict=True))
    return pd.DataFrame({"qid": qids[row], "nid": nid, "dist": dist})


def quantized(v: np.ndarray) -> np.ndarray:
    lo, hi = v.min(), v.max()
    if hi == lo:
        return np.full(len(v), lo)
    delta = (hi - lo) / 255.0
    return np.minimum(255, np.floor((v - lo) / delta + 0.5)) * delta + lo


def with_adjacency(index: Index) -> DataFrame:
    """Points with ``adjacency array<struct<layer, near>>``; lists are bounded by the caps."""
    near = index.edges.groupBy("shard", "layer", "src").agg(F.collect_list("dst").alias("near"))
    lists = near.groupBy("shard", F.col("src").alias("vec_id")).agg(F.collect_list(F.struct("layer", "near")).alias("adjacency"))
    return index.points.drop("embedding").join(lists, ["shard", "vec_id"], "left")


def ann(index: Index, queries: DataFrame, k: int, ef: int) -> DataFrame:
    """``qid, nid, dist, rank`` by approximate search; queries are quantized like points.

    Each query visits every shard; only k rows for each query and shard leave a task.  Where shards are
    fewer than tasks, queries are dealt in blocks and a shard is sent to the tasks of all its blocks.
    """
    if ef < k:
        raise ValueError("ef must be k or more, else a result can hold fewer than k rows")
    tasks = queries.sparkSession.sparkContext.defaultParallelism
    blocks = max(1, tasks // index.shards)
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    asked = queries.select("qid", "embedding", F.pmod(F.xxhash64("qid"), F.lit(blocks)).cast("int").alias("block")).withColumn("shard", every(index.shards))
    found = (
        with_adjacency(index)
        .withColumn("block", every(blocks))
        .groupBy("shard", "block")
        .cogroup(asked.groupBy("shard", "block"))
        .applyInPandas(lambda n, q: search_shard(n, q, k, ef) if len(n) and len(q) else pd.DataFrame({"qid": [], "nid": [], "dist": []}), "qid long, nid long, dist double")
    )
    return knn.top_k(found, k)


def words(found: DataFrame, named: DataFrame) -> DataFrame:
    """Attach the word of each found id; joined by id, so order does not matter."""
    return found.join(named.select(F.col("vec_id").alias("nid"), "word"), "nid", "left")
