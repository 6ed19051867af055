"""An index on storage: points, edges (by layer) and params as Parquet tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.build import Index
from ..params import IndexParams


def save(index: Index, path: str) -> None:
    """Refuses to write over an index that is there."""
    spark = index.points.sparkSession
    index.points.write.mode("errorifexists").parquet(f"{path}/points")
    index.edges.write.mode("errorifexists").partitionBy("layer").parquet(f"{path}/edges")
    index.params.to_frame(spark).withColumn("shards", F.lit(index.shards)).coalesce(1).write.mode("errorifexists").parquet(f"{path}/params")


def load(spark: SparkSession, path: str) -> Index:
    """Layers must run from 0 without a gap; a missing table raises Spark's own error."""
    head = spark.read.parquet(f"{path}/params").first().asDict()
    shards = head.pop("shards")
    edges = spark.read.schema("shard int, src long, dst long, dist double, tree boolean, layer int").parquet(f"{path}/edges")
    layers = sorted(r[0] for r in edges.select("layer").distinct().collect())  # one row a layer
    if layers != list(range(len(layers))):
        raise ValueError(f"layers {layers} have a gap")
    return Index(spark.read.parquet(f"{path}/points"), edges.select("shard", "layer", "src", "dst", "dist", "tree"), IndexParams(**head), shards)


def lookup(spark: SparkSession, path: str, vec_id: int) -> DataFrame:
    """One point straight from storage; the predicate reaches the Parquet scan."""
    return spark.read.parquet(f"{path}/points").where(F.col("vec_id") == F.lit(vec_id))
