"""Queries of this folder, with SQL where SQL can state them."""

from __future__ import annotations

from . import bpe, decontaminate, language_model, near_vectors, ngram_join, quality, secrets, sharding, sql, substrings, url_filter
from .shared import table

QUERIES = {
    "op1_near_vectors": lambda spark, sf: near_vectors.near_duplicates(table(spark, sf, "embeddings").select("vec_id", "embedding")),
    "op2_language_model": lambda spark, sf: language_model.documents_query(table(spark, sf, "documents")),
    "op3_rendezvous_sharding": lambda spark, sf: sharding.documents_query(table(spark, sf, "documents")),
    "op4_ngram_join": lambda spark, sf: ngram_join.join(table(spark, sf, "documents")),
    "op5_decontaminate": lambda spark, sf: decontaminate.contamination(table(spark, sf, "documents"), table(spark, sf, "benchmark")),
    "op6_bpe": lambda spark, sf: bpe.digests(table(spark, sf, "documents"), bpe.default_path()),
    "op7_url_filter": lambda spark, sf: url_filter.pages_query(table(spark, sf, "pages")),
    "op8_quality": lambda spark, sf: quality.documents_query(table(spark, sf, "documents"), table(spark, sf, "labels")),
    "op9_secret_scan": lambda spark, sf: secrets.documents_query(table(spark, sf, "documents")),
    "op10_substring_dedup": lambda spark, sf: substrings.documents_query(table(spark, sf, "documents")),
}

#: The others hash, train or tokenize in ways that SQL cannot state; tests hold them against brute force.
ORACLE = {
    "op1_near_vectors": sql.NEAR_VECTORS,
    "op4_ngram_join": sql.NGRAM_JOIN,
    "op5_decontaminate": sql.DECONTAMINATE,
    "op7_url_filter": url_filter.SQL,
    "op10_substring_dedup": sql.SUBSTRINGS,
}
