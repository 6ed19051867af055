"""Benchmark decontamination by winnowing.

A window is ``WINDOW`` consecutive words of an item (a shorter item is one window).  Both sides
hash all ``GRAM``-word grams and take the minimum over each run of WINDOW - GRAM + 1 grams: equal
windows have equal minima, so every shared window shares a fingerprint.

1. the benchmark becomes a table of fingerprints: length, minimum, hash of the whole window, and a
   class for each distinct set of items that hold a window;
2. one pass over the documents, in place, writes one row for each document with its words counted
   and its likely windows.  Likely is asked of ``1 << FLAGS`` flags, the only thing broadcast; their
   size is fixed, and a larger benchmark only makes more windows likely;
3. likely windows are joined with the table by fingerprint and extended to the whole window, whose
   hash has to be equal; hit words, classes and items follow by document.  Documents with one set of
   classes share one list of items, so a passage that many documents and many items hold is never
   paired out.

Rows are keyed by two hashes of id and text, so every row gets its own result whatever its doc_id is:
NULL ids, ids given to several texts and repeated rows stay rows, and no size of the benchmark changes
a result.  NULL and empty texts have no words and no hits; NULL or wordless items have no windows.
Items with equal text are counted each, items with one id once; an item without an id hits words but is
not listed.  A very long text is one row of one slice and holds its hits in one task.  Empty tables
give no rows, or no hits.  Other columns are not read; ``clean`` passes them whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import columns, cut, unused
from .tokens import ALNUM, U, Words, minimum_of, release, small_batches, text_slices, words

WINDOW, GRAM = 13, 6
FLAGS = 22
PRINTS = "size int, print long, win long, item string"
HIT = pa.struct([("size", pa.int32()), ("print", pa.int64()), ("win", pa.int64()), ("at", pa.int32())])
JUDGED = "k1 long, k2 long, doc_id long, n_words long, hits array<struct<size:int,print:long,win:long,at:int>>"
RESULT = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]


def row_keys(doc_id: Column, text: Column) -> tuple[Column, Column]:
    return F.xxhash64(doc_id, F.isnull(doc_id), text), F.xxhash64(F.lit(7), text, doc_id)


def windows_of(w: Words, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(positions, fingerprints, hashes) of all windows of ``size`` words."""
    at, h = w.windows(size)
    if size < WINDOW or not len(at):
        return at, h, h
    where, grams = w.windows(GRAM)
    gram_of = np.full(len(w.hash), ~U(0), U)
    gram_of[where] = grams
    return at, minimum_of(gram_of, WINDOW - GRAM + 1)[at], h


def fingerprints(benchmark: DataFrame) -> DataFrame:
    """``size, print, win, item`` of every window of every item."""

    def run(batches):
        for batch in batches:
            ids = batch.column("item_id")
            for lo, _, data, offsets in text_slices(batch.column("text")):
                w = words(data, offsets, ALNUM)
                sizes = np.diff(w.first)
                doc = w.doc
                for size in sorted({int(min(s, WINDOW)) for s in sizes if s}):
                    at, prints, h = windows_of(w, size)
                    own = sizes[doc[at]]
                    keep = own >= WINDOW if size == WINDOW else own == size
                    at, prints, h = at[keep], prints[keep], h[keep]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), size, np.int32)), pa.array(prints.view(np.int64)), pa.array(h.view(np.int64)), ids.take(pa.array(lo + doc[at]))], names=["size", "print", "win", "item"])

    return benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text").mapInArrow(run, PRINTS)


def likely_windows(docs: DataFrame, sizes: list[int], flags: np.ndarray) -> DataFrame:
    """One row of ``JUDGED`` for each document."""
    shared = docs.sparkSession.sparkContext.broadcast((sizes, flags))

    def run(batches):
        lengths, seen = shared.value
        low = U(len(seen) * 8 - 1)
        for batch in batches:
            for lo, hi, data, offsets in text_slices(batch.column("text")):
                w = words(data, offsets, ALNUM)
                found = []
                for size in lengths:
                    at, prints, h = windows_of(w, size)
                    bit = prints & low
                    ok = np.flatnonzero(seen[(bit >> U(3)).astype(np.int64)] >> (bit & U(7)).astype(np.uint8) & 1)
                    found.append((at[ok], prints[ok], h[ok], np.full(len(ok), size, np.int32)))
                at, prints, h, size = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64), np.zeros(0, U), np.zeros(0, U), np.zeros(0, np.int32))
                doc = w.doc[at]
                order = np.argsort(doc, kind="stable")
                at, prints, h, size, doc = at[order], prints[order], h[order], size[order], doc[order]
                values = [size, prints.view(np.int64), h.view(np.int64), (at - w.first[doc]).astype(np.int32)]
                hits = pa.StructArray.from_arrays([pa.array(v) for v in values], fields=list(HIT))
                cuts = pa.array(np.searchsorted(doc, np.arange(hi - lo + 1)), pa.int32())
                own = batch.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays(
                    [own.column("k1"), own.column("k2"), own.column("doc_id"), pa.array(np.diff(w.first), pa.int64()), pa.ListArray.from_arrays(cuts, hits)], names=["k1", "k2", "doc_id", "n_words", "hits"]
                )
        release()

    k1, k2 = row_keys(F.col("doc_id"), F.col("text"))
    return docs.select(k1.alias("k1"), k2.alias("k2"), F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, JUDGED)


def judge(docs: DataFrame, benchmark: DataFrame, flag_bits: int = FLAGS) -> DataFrame:
    """``k1, k2`` and the columns of ``RESULT`` for every row of ``docs``."""
    small_batches(docs.sparkSession)
    table = cut(
        fingerprints(benchmark).groupBy("size", "print", "win").agg(F.sort_array(F.collect_set("item")).alias("items")).withColumn("class", F.xxhash64("items", F.size("items"))), "fingerprints"
    )
    sizes = sorted(r[0] for r in table.select("size").distinct().collect())  # WINDOW at most
    flags = np.zeros(1 << flag_bits, bool)
    bits = table.select(F.col("print").bitwiseAND(F.lit((1 << flag_bits) - 1)).alias("b")).distinct().toArrow()  # as many as flags at most
    flags[bits.column("b").to_numpy()] = True
    judged = cut(likely_windows(docs, sizes, np.packbits(flags, bitorder="little")), "judged")
    likely = judged.where(F.size("hits") > 0).dropDuplicates(["k1", "k2"]).select("k1", "k2", F.explode("hits").alias("h")).select("k1", "k2", "h.*")
    hits = cut(cut(likely, "likely").join(table.select("size", "print", "win", "class"), ["size", "print", "win"]).select("k1", "k2", "at", (F.col("at") + F.col("size")).alias("end"), "class"), "hits")
    order = Window.partitionBy("k1", "k2").orderBy("at", "end")
    before = F.coalesce(F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    fresh = F.greatest(F.lit(0), F.col("end") - F.greatest("at", before))
    covered = hits.withColumn("fresh", fresh).groupBy("k1", "k2").agg(F.sum("fresh").alias("n_hit"), F.sort_array(F.collect_set("class")).alias("classes"))
    covered = cut(covered.withColumn("named", F.xxhash64("classes", F.size("classes"))), "covered")
    # documents with one set of classes share the list of their items
    sets = covered.select("named", "classes").dropDuplicates(["named"]).select("named", F.explode("classes").alias("class"))
    listed = sets.join(table.select("class", "items").dropDuplicates(["class"]), "class").select("named", F.explode("items").alias("item"))
    lists = listed.groupBy("named").agg(F.sort_array(F.collect_set("item")).alias("items")).select("named", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"))
    found = covered.select("k1", "k2", "n_hit", "named").join(lists, "named", "left")
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    return judged.select("k1", "k2", "doc_id", "n_words").join(found, ["k1", "k2"], "left").select(
        "k1", "k2", "doc_id", "n_words", n_hit.alias("n_hit"), F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"),
        F.coalesce("items_sha256", F.sha2(F.lit(""), 256)).alias("items_sha256"), ((n_hit > 0) & (20 * n_hit >= F.col("n_words"))).alias("contaminated"),
    )


def contamination(docs: DataFrame, benchmark: DataFrame, flag_bits: int = FLAGS) -> DataFrame:
    """One row for each document; see ``RESULT``."""
    return judge(docs, benchmark, flag_bits).select(*RESULT)


def clean(docs: DataFrame, benchmark: DataFrame, words_hit: int = WINDOW) -> DataFrame:
    """Rows of ``docs`` without those that are contaminated or in which ``words_hit`` words are hit: by
    default, those that hold a whole window of a benchmark item, however long they are."""
    k1, k2 = row_keys(F.col("doc_id"), F.col("text"))
    a, b = unused(docs, "_k1"), unused(docs, "_k2")
    bad = judge(docs, benchmark).where(F.col("contaminated") | (F.col("n_hit") >= words_hit)).select(F.col("k1").alias(a), F.col("k2").alias(b)).distinct()
    return docs.withColumns({a: k1, b: k2}).join(bad, [a, b], "left_anti").select(*columns(docs))
