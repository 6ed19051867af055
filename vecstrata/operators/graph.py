"""Undirected bounded-degree layers as edge tables ``src, dst`` stored both ways."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def both_ways(pairs: DataFrame) -> DataFrame:
    """Symmetric, distinct edges without self loops."""
    a, b = (F.col(c).cast("long") for c in ("src", "dst"))
    return pairs.select(F.explode(F.array(F.struct(a.alias("src"), b.alias("dst")), F.struct(b.alias("src"), a.alias("dst")))).alias("e")).select("e.*").where(
        "src <> dst"
    ).distinct()


def add_nodes(nodes: DataFrame, more: DataFrame) -> DataFrame:
    return nodes.select("node").union(more.select("node")).distinct()


def missing_nodes(nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    ends = pairs.select(F.explode(F.array("src", "dst")).alias("node")).distinct()
    return ends.join(nodes.select("node"), "node", "left_anti")


def add_edges(nodes: DataFrame, edges: DataFrame, pairs: DataFrame, check: bool = True) -> DataFrame:
    """Add pairs; raises ``ValueError`` on a self loop or an unknown node when ``check``."""
    if check:
        if pairs.where("src = dst").head(1):
            raise ValueError("an edge must join two nodes")
        if first := missing_nodes(nodes, pairs).head(1):
            raise ValueError(f"node {first[0][0]} is not in the graph")
    return edges.select("src", "dst").union(both_ways(pairs)).distinct()


def contains(nodes: DataFrame, asked: DataFrame) -> DataFrame:
    """``node, found`` for every node asked for."""
    return asked.select("node").distinct().join(nodes.select("node", F.lit(True).alias("found")).distinct(), "node", "left").select("node", F.coalesce("found", F.lit(False)).alias("found"))


def remove_edges(edges: DataFrame, pairs: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """Drop pairs both ways; with ``nodes`` an unknown end raises ``ValueError``."""
    if nodes is not None and (first := missing_nodes(nodes, pairs).head(1)):
        raise ValueError(f"node {first[0][0]} is not in the graph")
    return edges.join(both_ways(pairs), ["src", "dst"], "left_anti")


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    n = edges.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("n"))
    return nodes.select("node").join(n, "node", "left").select("node", F.coalesce("n", F.lit(0)).alias("degree"))


def neighbours(edges: DataFrame) -> DataFrame:
    return edges.groupBy(F.col("src").alias("node")).agg(F.sort_array(F.collect_set("dst")).alias("neighbours"))


def isolate(edges: DataFrame, node: int) -> DataFrame:
    """Drop the node's edges, save those to neighbours that have no other edge."""
    own = edges.where(F.col("src") == node).select("dst")
    n = edges.join(own.select(F.col("dst").alias("src")), "src", "left_semi").groupBy("src").agg(F.count("*").alias("n"))
    gone = n.where("n > 1").select(F.lit(node).cast("long").alias("src"), F.col("src").alias("dst"))
    return remove_edges(edges, gone)


def replace_neighbours(edges: DataFrame, node: int, targets: DataFrame) -> DataFrame:
    """``isolate`` and then edges to every ``dst`` of ``targets``."""
    new = targets.select(F.lit(node).cast("long").alias("src"), F.col("dst").cast("long").alias("dst"))
    return isolate(edges, node).select("src", "dst").union(both_ways(new)).distinct()


def random_graph(spark, n: int, picks: int) -> DataFrame:
    """Each node picks ``picks`` hashed partners; self picks are dropped."""
    pick = F.explode(F.sequence(F.lit(0), F.lit(picks - 1))).alias("i")
    pairs = spark.range(n).select(F.col("id").alias("src"), pick).select("src", F.pmod(F.xxhash64("src", "i"), F.lit(n)).alias("dst"))
    return both_ways(pairs)


def simple_graph(spark) -> tuple[DataFrame, DataFrame]:
    """Five nodes and the edges 0-1 0-2 1-2 2-3 3-4 4-1."""
    nodes = spark.range(5).select(F.col("id").alias("node"))
    pairs = spark.createDataFrame([(0, 1), (0, 2), (1, 2), (2, 3), (3, 4), (4, 1)], "src long, dst long")
    return nodes, both_ways(pairs)
