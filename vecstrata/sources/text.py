"""Text embeddings: one line holds a word and its components, separated by single spaces."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.points import gapless

#: Tokens that count as a number; suffixed literals such as 1f do not.
NUMBER = r"^[+-]?(\d+\.?\d*([eE][+-]?\d+)?|\.\d+([eE][+-]?\d+)?|inf|infinity|nan)$"


def parse_line(line: Column) -> tuple[Column, Column]:
    """(word, embedding): tokens that are no number are joined to the word without separator."""
    tokens = F.split(line, " ", -1)
    number = lambda t: F.lower(t).rlike(NUMBER)
    word = F.array_join(F.filter(tokens, lambda t: ~number(t)), "")
    return word, F.transform(F.filter(tokens, number), lambda t: t.try_cast("float"))


def parse(lines: DataFrame, column: str = "value") -> DataFrame:
    word, vector = parse_line(F.col(column))
    return lines.select(*[c for c in lines.columns if c != column], word.alias("word"), vector.alias("embedding"))


def read(spark: SparkSession, path: str, limit: int = 0) -> DataFrame:
    """``vec_id, word, embedding`` with dense ids in line order; ``limit`` 0 reads all."""
    lines = spark.read.text(path)
    lines = lines.limit(limit) if limit else lines
    numbered = gapless(lines.withColumn("_line", F.monotonically_increasing_id()), "_line", "vec_id").drop("_line")
    return parse(numbered)


def check_width(parsed: DataFrame) -> None:
    low, high = parsed.agg(F.min(F.size("embedding")), F.max(F.size("embedding"))).first()
    if low != high:
        raise ValueError(f"lines hold from {low} to {high} components")
