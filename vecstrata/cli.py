"""Command line: build an index from text embeddings, search it, report on it."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .operators import build, evaluate, knn, search
from .params import IndexParams
from .sources import store, text


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="vecstrata")
    sub = top.add_subparsers(dest="command", required=True)
    one = sub.add_parser("build")
    one.add_argument("text")
    one.add_argument("index")
    one.add_argument("--limit", type=int, default=0)
    one.add_argument("--m", type=int, default=12)
    one.add_argument("--ef-cons", type=int)
    for name in ("search", "truth"):
        one = sub.add_parser(name)
        one.add_argument("index")
        one.add_argument("--ids", type=int, nargs="+", required=True)
        one.add_argument("--k", type=int, default=10)
        one.add_argument("--ef", type=int, default=100)
    sub.add_parser("report").add_argument("index")
    return top


def main(argv: list[str] | None = None) -> None:
    args = parser().parse_args(argv)
    spark = SparkSession.builder.getOrCreate()
    if args.command == "build":
        named = text.read(spark, args.text, args.limit)
        text.check_width(named)
        store.save(build.build(named.select("vec_id", "embedding"), IndexParams(m=args.m, ef_cons=args.ef_cons)), args.index)
        return
    index = store.load(spark, args.index)
    if args.command == "report":
        evaluate.statistics(index).orderBy("layer").show()
        evaluate.degree_range(evaluate.layer_degrees(index)).orderBy("layer").show()
        return
    queries = index.points.where(F.col("vec_id").isin(args.ids)).select(F.col("vec_id").alias("qid"), "embedding")
    found = knn.exact(index.points, queries, args.k) if args.command == "truth" else search.ann(index, queries, args.k, args.ef)
    found.orderBy("qid", "rank").show(args.k * len(args.ids))


if __name__ == "__main__":
    main()
