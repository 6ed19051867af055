"""The corpus pipeline: five stages, each over everything that the one before it kept.

All stages but the last return the columns of their input, whatever their names.  NULL, empty and very
long texts:

* quality: NULL and empty texts get the score of the network's bias and stay or go by it;
* near duplicates: texts without words link with nothing, so they stay.  Of the rows of one doc_id with
  equal text (repeated rows) one stays.  Rows that give one doc_id to several texts go only where every
  one of them is a copy of a smaller id.  Rows without a doc_id are not compared, and stay;
* decontamination: judged row by row, NULL ids too; a row goes that holds a whole window of a benchmark
  item, or that 5 % of whose words are hit by shorter items;
* secrets: NULL stays NULL;
* BPE: NULL is encoded as the empty text.

Of a group of copies the smallest doc_id stays, so there are no ties.  An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vecstrata.llm import bpe, decontaminate, ngram_join, quality, secrets
from vecstrata.llm.shared import columns, cut, table, unused


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on the labelled training fold, accepts."""
    net = quality.train(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), quality.fold() != 1)
    name = unused(docs, "_score")
    return quality.classify(docs, net, name).where(F.col(name) >= 0.5).drop(name)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near duplicates the document with the smallest id stays, once."""
    mine = F.max(F.col("component_id") == F.col("doc_id"))
    others = ngram_join.join(docs).groupBy("doc_id").agg(mine.alias("mine")).where("not mine").select("doc_id")
    hashed, i, t, n = (unused(docs, x) for x in ("_text", "_id", "_same", "_n"))
    keyed = docs.join(others, "doc_id", "left_anti").withColumn(hashed, F.xxhash64("text"))
    again = keyed.groupBy(F.col("doc_id").alias(i), F.col(hashed).alias(t)).agg(F.count("*").alias(n)).where(F.col(n) > 1).drop(n)
    same = F.col("doc_id").eqNullSafe(F.col(i)) & (F.col(hashed) == F.col(t))
    repeated = keyed.join(again, same, "left_semi").dropDuplicates(["doc_id", hashed])
    return keyed.join(again, same, "left_anti").unionByName(repeated).select(*columns(docs))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents go that hold a whole window of a benchmark item, or too many words of short items."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All secrets found are replaced; ``n_chars`` follows the text."""
    held = docs.select(F.struct(*columns(docs)).alias("row"), "text")
    clean = secrets.redact(secrets.scan(held))
    made = {"text": F.col("text"), "n_chars": F.length("text").cast("long")}
    return clean.select(*[made.get(c, F.col("row").getField(c)).alias(c) for c in docs.columns])


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text and digests of the ids and of the text decoded from them."""
    return bpe.digests(docs, bpe.default_path())


STAGES = [
    ("quality", keep_quality),
    ("near_duplicates", drop_copies),
    ("decontamination", drop_contaminated),
    ("secrets", redact_secrets),
    ("bpe", tokenize),
]

#: SQL cannot state the classifier; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
