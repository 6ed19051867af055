"""Sharding by weighted rendezvous hashing.

A record goes to the shard with the largest ``-weight / ln(u(key, shard))``.  The choice depends
on the key and the shard list alone, so one shard more takes records only into itself, and a
shard of weight w gets a share in proportion to w.

Nulls: a NULL key is hashed as a key of its own and NULL text has no bytes.  Equal keys get one
shard, and places of their own in it.  Ties of scores go to the larger shard number.  Only the length and
the checksum of a very long text travel.  An empty table gives an empty result.  Other columns pass;
those named like the shard or the place are replaced.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.points import gapless


def score(key: Column, shard: Column, weight: Column) -> Column:
    # xxhash64 skips NULLs, so the flag keeps a NULL key apart from the shard number alone
    h = F.xxhash64(key, F.isnull(key), shard)
    u = (F.shiftrightunsigned(h, 11).cast("double") + 0.5) / F.lit(float(2**53))
    return -weight / F.ln(u)


def choose(key: Column, weights: Sequence[float]) -> Column:
    """The shard 0..len(weights)-1 of a key; shards of weight 0 get nothing."""
    if not any(w > 0 for w in weights):
        raise ValueError("no shard has a weight")
    listed = F.array(*[F.lit(float(w)) for w in weights])
    ranked = F.transform(listed, lambda w, i: F.struct(F.when(w > 0, score(key, i, w)).otherwise(-1.0).alias("s"), i.alias("i")))
    return F.array_max(ranked)["i"]


def assign(df: DataFrame, key: str, weights: Sequence[float], name: str = "shard") -> DataFrame:
    """Add the shard of each row; a narrow projection, no shuffle."""
    return df.withColumn(name, choose(F.col(key), weights))


def numbered(df: DataFrame, key: str, shard: str = "shard", name: str = "slot") -> DataFrame:
    """Add gapless 0-based places inside each shard, in key order; a shard of any size is dealt over many parts."""
    return gapless(df, key, name, (shard,))


def moved(df: DataFrame, key: str, old: Sequence[float], new: Sequence[float]) -> DataFrame:
    """``old_shard, new_shard, rows``: what changing the shard list moves."""
    pairs = df.select(choose(F.col(key), old).alias("old_shard"), choose(F.col(key), new).alias("new_shard"))
    return pairs.groupBy("old_shard", "new_shard").agg(F.count("*").alias("rows"))


def documents_query(docs: DataFrame, shards: int = 24) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    full = docs.select(
        "doc_id",
        (F.octet_length(text) + 8).cast("long").alias("size"),
        F.crc32(text.cast("binary")).cast("long").alias("text_crc32"),
        F.lit("key").alias("law"),
        choose(F.col("doc_id"), [1.0] * shards).cast("int").alias("shard"),
        choose(F.col("doc_id"), [1.0] * (shards + 1)).cast("int").alias("grown_shard"),
    )
    return numbered(full, "doc_id").select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")
