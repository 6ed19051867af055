"""Ground truth kept as JSON objects that map a query id to neighbour ids."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def parse(df: DataFrame, column: str = "value") -> DataFrame:
    """``qid, rank, nid`` of JSON maps in a column."""
    entry = F.explode(F.from_json(F.col(column), "map<string,array<bigint>>"))
    return df.select(entry.alias("key", "ids")).select(F.col("key").cast("long").alias("qid"), F.posexplode("ids").alias("pos", "nid")).select(
        "qid", (F.col("pos") + 1).cast("long").alias("rank"), "nid"
    )


def read(spark: SparkSession, path: str) -> DataFrame:
    return parse(spark.read.text(path, wholetext=True))


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """A JSON list of ids."""
    return spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "array<bigint>")).alias("vec_id"))


def to_json(truth: DataFrame) -> DataFrame:
    """One JSON object a query, the inverse of ``parse``."""
    ids = truth.groupBy("qid").agg(F.sort_array(F.collect_list(F.struct("rank", "nid"))).alias("l"))
    return ids.select(F.to_json(F.map_from_arrays(F.array(F.col("qid").cast("string")), F.array(F.col("l.nid")))).alias("value"))
