"""Vectors that arrive as a stream, added to a stored index one micro-batch at a time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import build
from ..params import IndexParams
from ..sources import store


def version_path(root: str, version: int) -> str:
    return f"{root}/v{version}"


def upsert(spark: SparkSession, root: str, batch: DataFrame, epoch: int, params: IndexParams) -> str:
    """Write version ``epoch`` from version ``epoch - 1`` and the batch; a repeated epoch is a no-op."""
    path = version_path(root, epoch)
    there = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/params/_SUCCESS")
    if there.getFileSystem(spark._jsc.hadoopConfiguration()).exists(there):
        return path
    for table in ("points", "edges", "params"):  # left by an attempt that was cut off
        part = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{table}")
        part.getFileSystem(spark._jsc.hadoopConfiguration()).delete(part, True)
    vectors = batch.select("vec_id", "embedding").dropDuplicates(["vec_id"])
    if epoch == 0:
        index = build.build(vectors, params)
    else:
        old = store.load(spark, version_path(root, epoch - 1))
        index = build.insert(old, vectors.join(old.points.select("vec_id"), "vec_id", "left_anti"), epoch)
    store.save(index, path)
    return path


def start(stream: DataFrame, root: str, checkpoint: str, params: IndexParams):
    """A query that keeps the index under ``root`` up to date."""

    def one(batch: DataFrame, epoch: int) -> None:
        upsert(batch.sparkSession, root, batch.where(F.col("embedding").isNotNull()), epoch, params)

    return stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
