"""What several operators need: written cuts of a lineage, connected components, SQL pieces."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..storage import columns, cut, drop_cut, quoted, unused
from .tokens import release

__all__ = ["Forest", "columns", "components", "cut", "drop_cut", "lower_ascii", "paired_blocks", "quoted", "shuffle_partitions", "spanning", "table", "unused", "with_made"]

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


class Forest:
    """Union-find that remembers only the links that joined two trees."""

    def __init__(self):
        self.up: dict[int, int] = {}
        self.links: list[tuple[int, int]] = []

    def find(self, x: int) -> int:
        up = self.up
        while (y := up.setdefault(x, x)) != x:
            up[x] = x = up[y]
        return x

    def join(self, a: int, b: int) -> None:
        x, y = self.find(a), self.find(b)
        if x != y:
            self.up[max(x, y)] = min(x, y)
            self.links.append((a, b))


def spanning(near: np.ndarray, a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """Links that join what the pairs of ``near`` join: rows have the ids ``a``, columns ``b``."""
    links, todo = [], near.any(axis=1)
    for first in np.flatnonzero(todo):
        if not todo[first]:
            continue
        rows, seen, new = [], np.zeros(len(b), bool), np.array([first])
        while len(new):
            todo[new] = False
            rows.append(new)
            cols = near[new].any(axis=0) & ~seen
            seen |= cols
            new = np.flatnonzero(near[:, cols].any(axis=1) & todo)
        ids = np.unique(np.concatenate([a[np.concatenate(rows)], b[seen]]))
        links += [(int(ids[0]), i) for i in ids[1:].tolist()]
    return links


def contracted(links: DataFrame) -> DataFrame:
    """``u, v``: links that join the same nodes, at most one for each node and task."""

    def run(batches):
        forest = Forest()
        for batch in batches:
            for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True):
                forest.join(a, b)
            if len(forest.up) > 500_000:
                yield from flat(forest)
                forest = Forest()
        yield from flat(forest)

    def flat(forest):
        pairs = [(x, forest.find(x)) for x in list(forest.up)]
        pairs = [p for p in pairs if p[0] != p[1]]
        if pairs:
            u, v = zip(*pairs, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])

    return links.select("a", "b").where("a <> b").mapInArrow(run, "u long, v long")


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """``id, label`` of all ends of ``links(a, b)``: label is the smallest id reachable.

    Tasks contract their links first.  Then alternating large-star and small-star rounds run until every
    node has one smaller neighbour that is itself a root.  Every round's edge list is written, the
    next one reads it, and both join sides are plain scans, so a hub's rows can be split by the engine.
    """
    edges = cut(contracted(links).distinct(), "links")
    for _ in range(rounds):
        several = edges.groupBy("u").agg(F.count("*").alias("c")).where("c > 1")
        if not edges.join(edges.select(F.col("u").alias("v")), "v", "left_semi").head(1) and not several.head(1):
            roots = edges.select(F.col("v").alias("id")).distinct()
            return edges.select(F.col("u").alias("id"), F.col("v").alias("label")).unionByName(roots.select("id", F.col("id").alias("label")))
        both = edges.select("u", "v").union(edges.select("v", "u"))
        low = cut(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "low")
        # v > u of every node go to the smallest neighbour of u; then every node keeps its smallest
        large = cut(both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct(), "large")
        low2 = cut(large.groupBy("u").agg(F.min("v").alias("m")), "low")
        small = large.join(low2, "u")
        moved = small.select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*")
        new = cut(moved.where("u <> v").distinct(), "links")
        for old in (edges, low, large, low2):
            drop_cut(old)
        edges = new
    raise RuntimeError(f"components did not settle in {rounds} rounds")


def with_made(df: DataFrame, column: str, to: str, kind: T.DataType, start) -> DataFrame:
    """Add ``to``, made of ``column`` by Python; a column of that name is replaced, others pass.

    ``start()`` gives a task its function from an Arrow column to (first row, end row, values) of its slices.
    Python functions are bound by names, which may hold dots, so columns have plain ones on the way."""
    rest = [c for c in df.columns if c != to]
    plain = [f"c{i}" for i in range(len(rest))]
    held = df.select(*[quoted(c).alias(n) for c, n in zip(rest, plain, strict=True)], quoted(column).alias("source"))
    schema = T.StructType([*[f for f in held.schema if f.name != "source"], T.StructField("made", kind)])

    def run(batches):
        work = start()
        for batch in batches:
            for lo, hi, made in work(batch.column("source")):
                yield pa.RecordBatch.from_arrays([*[batch.column(n).slice(lo, hi - lo) for n in plain], made], names=[*plain, "made"])
        release()

    return held.mapInArrow(run, schema).toDF(*rest, to)


def lower_ascii(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def paired_blocks(df: DataFrame, group: str, member: str, size: int) -> DataFrame:
    """Deal each group of two or more in blocks of about ``size`` rows; one row for each pair of blocks it is in.

    Adds ``own`` (the row's block), ``i <= j`` (the pair) and ``task``, a hash that deals pairs to tasks.
    """
    sizes = cut(df.groupBy(group).agg(F.count("*").alias("_n")).where("_n > 1"), "sizes")
    dealt = df.join(sizes, group).withColumn("_blocks", F.ceil(F.col("_n") / size)).withColumn("own", F.pmod(F.xxhash64(member), F.col("_blocks")))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("_blocks") - 1)).alias("_other")
    both = dealt.select("*", other).withColumns({"i": F.least("own", "_other"), "j": F.greatest("own", "_other")})
    tasks = 4 * shuffle_partitions(df.sparkSession)
    return both.withColumn("task", F.pmod(F.xxhash64(group, "i", "j"), F.lit(tasks))).drop("_n", "_blocks", "_other")
