"""Substring dedup over a compacted De Bruijn graph of word k-mers.

An edge is a window of ``k`` consecutive words, between its first and its last k - 1 words.  Its source
is the place where it starts in the smallest document; it is repeated where another document has it.

* Map: inside a part of the input, an edge that also starts in a smaller document of the part is
  repeated for certain; only the smallest document of an edge is sent on, so a passage that a
  third of all rows share costs one run for each part.
* Bucket: the others are dealt by their minimizer (the smallest hash of ``seed`` words inside), as graph
  assemblers do, so neighbouring edges mostly meet in one bucket and travel as one run of hashes.
* Graph: successors are taken from consecutive edges of documents.  A node is branching where more than
  one repeated edge follows, or more than one precedes.  Repeated edges between nodes that do not branch
  are compacted, in a part or bucket first, to pieces: a run of edges here and the run at their source.
  A part or bucket knows the successors that its own documents show: a node that branches only by what
  another part holds ends no piece there, which changes the paths and not the words that they cover.
* Join: pieces that follow each other in a document are joined by coordinates, the degrees of the nodes
  between them are counted over all pieces, and pieces are compacted to paths where the node does not
  branch and the sources follow each other too.
* Verification: a digest of the words of every path is compared with the digest of the words at its
  source coordinates.  Documents meet their paths by one join that also takes the words out; the documents
  in which some path fails (hashes of different words were equal) are made anew without it.

Nulls and oddities: NULL, empty and short texts, and rows without a doc_id, have no edges and keep all
words.  Rows are told apart by id and text: rows with one doc_id are not each other's copies (the id
must be smaller), whether their texts are equal or not.  Ties go to the first place of the smallest
document.  A very long text is one slice of one part.  An empty table gives no rows.  Other columns are
not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import cut
from .tokens import SPACED, U, binaries, heads_of, minimum_of, mix, release, small_batches, spread, text_bytes, text_slices, words

WINDOW, SEED = 50, 16
RUN = np.dtype([("doc", "<i8"), ("key", "<i8"), ("part", "<i8"), ("at", "<i4"), ("size", "<i4")])
#: Edges ``at ..`` of a document, and the place of the first at their source.
PIECE = np.dtype([("doc", "<i8"), ("key", "<i8"), ("at", "<i4"), ("size", "<i4"), ("src", "<i8"), ("src_key", "<i8"), ("src_at", "<i4"), ("part", "<i8")])
MAPPED = "bucket int, runs binary, edges binary, pieces binary"
PIECES = "doc_id long, key long, start int, size int, src long, src_key long, src_start int"
#: Pieces know the part that their document came from, so that repeated rows in several parts are not mixed up.
LOCAL = PIECES + ", part long"


def sources(edge: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row the group of its edge, and the row of the first place in the edge's smallest document."""
    order = np.argsort(edge, kind="stable")
    head = heads_of(edge[order])
    if not len(head):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    size = np.diff(np.append(head, len(edge)))
    d = doc[order]
    lowest = d == np.repeat(np.minimum.reduceat(d, head), size)
    first = np.minimum.reduceat(np.where(lowest, np.arange(len(edge)), len(edge)), head)
    group, source = np.empty(len(edge), np.int64), np.empty(len(edge), np.int64)
    group[order] = np.repeat(np.arange(len(head)), size)
    source[order] = np.repeat(order[first], size)
    return group, source


def branching(group: np.ndarray, follows: np.ndarray, repeated: np.ndarray) -> np.ndarray:
    """For each row whether the node after its edge branches among repeated edges.

    ``follows[i]`` tells that row i + 1 is the next edge of the same document."""
    at = np.flatnonzero(follows[:-1] & repeated[:-1] & repeated[1:]) if len(group) else np.zeros(0, np.int64)
    out = np.zeros(len(group), bool)
    if len(at):
        pairs = np.unique(np.stack([group[at], group[at + 1]]), axis=1)
        n = int(group.max()) + 1
        many_out, many_in = np.bincount(pairs[0], minlength=n) > 1, np.bincount(pairs[1], minlength=n) > 1
        out[at] = many_out[group[at]] | many_in[group[at + 1]]
    return out


def pieces_of(doc: np.ndarray, key: np.ndarray, part: np.ndarray, at: np.ndarray, edge: np.ndarray, follows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which rows lie in the smallest document of their edge, and the pieces of all others."""
    group, source = sources(edge, doc)
    lowest = doc[source] == doc if len(doc) else np.zeros(0, bool)
    repeated = np.zeros(int(group.max()) + 1 if len(group) else 0, bool)
    repeated[group[~lowest]] = True
    branch = branching(group, follows, repeated[group])
    rows = np.flatnonzero(~lowest)
    out = np.empty(0, PIECE)
    if len(rows):
        s = source[rows]
        on = (rows[1:] == rows[:-1] + 1) & follows[rows[:-1]] & ~branch[rows[:-1]]
        on &= (doc[s][1:] == doc[s][:-1]) & (key[s][1:] == key[s][:-1]) & (at[s][1:] == at[s][:-1] + 1)
        head = np.flatnonzero(np.concatenate([[True], ~on]))
        out = np.empty(len(head), PIECE)
        for name, values in (("doc", doc[rows]), ("key", key[rows]), ("part", part[rows]), ("at", at[rows]), ("src", doc[s]), ("src_key", key[s]), ("src_at", at[s])):
            out[name] = values[head]
        out["size"] = np.diff(np.append(head, len(rows)))
    return lowest, out


def mapped(docs: DataFrame, k: int, seed: int, buckets: int, entries: int) -> DataFrame:
    def part(number: int, held: list[tuple]) -> pa.RecordBatch:
        doc, key, at, edge, low = (np.concatenate(x) for x in zip(*held, strict=True))
        follows = np.zeros(len(doc), bool)
        follows[:-1] = (doc[1:] == doc[:-1]) & (key[1:] == key[:-1]) & (at[1:] == at[:-1] + 1)
        lowest, pieces = pieces_of(doc, key, np.full(len(doc), number), at, edge, follows)
        home = (mix(pieces["doc"].astype(U), 5) % U(buckets)).astype(np.int64)
        pieces, home = pieces[np.argsort(home, kind="stable")], np.sort(home)
        piece_head = heads_of(home)
        # runs of edges that stay together: of one document, one minimizer, all in their smallest document
        rows = np.flatnonzero(lowest)
        new = np.ones(len(rows), bool)
        new[1:] = (rows[1:] != rows[:-1] + 1) | ~follows[rows[:-1]] | (low[rows][1:] != low[rows][:-1])
        start = np.flatnonzero(new)
        r = np.empty(len(start), RUN)
        r["part"] = number
        r["doc"], r["key"], r["at"], r["size"] = doc[rows][start], key[rows][start], at[rows][start], np.diff(np.append(start, len(rows)))
        to = (mix(low[rows][start], 6) % U(buckets)).astype(np.int64)
        order = np.argsort(to, kind="stable")
        size = r["size"].astype(np.int64)[order]
        before = np.cumsum(size) - size
        pick = np.repeat(start[order] - before, size) + np.arange(size.sum())
        to, r, edge = to[order], r[order], edge[rows][pick]
        head = heads_of(to)
        runs = np.diff(np.append(head, len(to)))
        edges = np.add.reduceat(size, head) if len(head) else np.zeros(0, np.int64)
        sent = [pa.array(to[head], pa.int32()), binaries(r.view(np.uint8), runs * RUN.itemsize), binaries(edge.astype("<u8"), edges * 8), pa.nulls(len(head), pa.binary())]
        sure = [pa.array(home[piece_head], pa.int32()), *[pa.nulls(len(piece_head), pa.binary())] * 2, binaries(pieces.view(np.uint8), np.diff(np.append(piece_head, len(home))) * PIECE.itemsize)]
        return pa.RecordBatch.from_arrays([pa.concat_arrays([a, b]) for a, b in zip(sent, sure, strict=True)], names=["bucket", "runs", "edges", "pieces"])

    def run(batches):
        held, n, number = [], 0, TaskContext.get().partitionId() << 24
        for batch in batches:
            ids = np.asarray(batch.column("doc_id").cast(pa.int64()).to_numpy(zero_copy_only=False))
            keys = np.asarray(batch.column("key").to_numpy(zero_copy_only=False))
            for lo, _, data, offsets in text_slices(batch.column("text")):
                w = words(data, offsets, SPACED, fold=False)
                at, edge = w.windows(k)
                if not len(at):
                    continue
                where, grams = w.windows(seed)
                gram = np.full(len(w.hash), ~U(0), U)
                gram[where] = grams
                low = minimum_of(gram, k - seed + 1)[at]
                doc = w.doc[at]
                held.append((ids[lo + doc], keys[lo + doc], (at - w.first[doc]).astype(np.int32), edge, low))
                n += len(at)
                if n >= entries:
                    yield part(number, held)
                    held, n, number = [], 0, number + 1
                    release()
        if held:
            yield part(number, held)
        held = []
        release()

    return docs.where(F.col("doc_id").isNotNull()).select("doc_id", F.xxhash64("text").alias("key"), "text").mapInArrow(run, MAPPED)


def local_pieces(docs: DataFrame, k: int, seed: int) -> DataFrame:
    """``LOCAL`` pieces of all repeated edges whose document is not the smallest that has them, compacted inside parts and buckets."""
    buckets, entries = spread(text_bytes(docs))
    names = [x.split()[0] for x in LOCAL.split(", ")]

    def bucket(table: pa.Table) -> pa.Table:
        joined = lambda c: b"".join(x for x in table.column(c).to_pylist() if x is not None)
        r, edge, sure = np.frombuffer(joined("runs"), RUN), np.frombuffer(joined("edges"), "<u8"), np.frombuffer(joined("pieces"), PIECE)
        size = r["size"].astype(np.int64)
        end = np.cumsum(size)
        at = np.repeat(r["at"], size) + (np.arange(len(edge)) - np.repeat(end - size, size)).astype(np.int32)
        follows = np.ones(len(edge), bool)
        follows[end - 1] = False
        _, found = pieces_of(*(np.repeat(r[c], size) for c in ("doc", "key", "part")), at, edge, follows)
        found = np.concatenate([found, sure])
        return pa.table([pa.array(np.ascontiguousarray(found[c])) for c in PIECE.names], names=names)

    return mapped(docs, k, seed, buckets, entries).groupBy("bucket").applyInArrow(bucket, LOCAL).distinct()


def paths(pieces: DataFrame) -> DataFrame:
    """Pieces compacted over all documents, by joins: ``PIECES`` again, with longer runs."""
    a = pieces.select("doc_id", "key", "part", (F.col("start") + F.col("size")).alias("start"), F.col("src").alias("s1"), F.col("src_key").alias("k1"), (F.col("src_start") + F.col("size")).alias("e1"))
    b = pieces.select("doc_id", "key", "part", "start", F.col("src").alias("s2"), F.col("src_key").alias("k2"), F.col("src_start").alias("b2"))
    met = cut(a.join(b, ["doc_id", "key", "part", "start"]), "met")
    steps = met.select("s1", "k1", "e1", "s2", "k2", "b2").distinct()
    out = steps.groupBy("s1", "k1", "e1").agg(F.count("*").alias("n_out"))
    into = steps.groupBy("s2", "k2", "b2").agg(F.count("*").alias("n_in"))
    plain = steps.where("s1 = s2 and k1 = k2 and e1 = b2").join(out.where("n_out = 1"), ["s1", "k1", "e1"], "left_semi").join(into.where("n_in = 1"), ["s2", "k2", "b2"], "left_semi")
    joined = met.join(plain, ["s1", "k1", "e1", "s2", "k2", "b2"], "left_semi").select("doc_id", "key", "part", "start", F.lit(0).alias("new"))
    order = Window.partitionBy("doc_id", "key", "part").orderBy("start")
    marked = pieces.join(joined, ["doc_id", "key", "part", "start"], "left").withColumn("path", F.sum(F.coalesce("new", F.lit(1))).over(order))
    first = F.min(F.struct("start", "src", "src_key", "src_start")).alias("f")
    return marked.groupBy("doc_id", "key", "part", "path").agg(first, F.sum("size").cast("int").alias("size")).select("doc_id", "key", "f.start", "size", "f.src", "f.src_key", "f.src_start").distinct()


def repeated_paths(docs: DataFrame, k: int = WINDOW, seed: int = SEED) -> DataFrame:
    """``PIECES``: all paths of repeated edges, with the coordinates of their source."""
    small_batches(docs.sparkSession)
    return cut(paths(cut(local_pieces(docs, k, seed), "pieces")), "paths")


MADE = "doc_id long, key long, n_words long, n_removed long, kept string, sums array<struct<start:int,size:int,mine:boolean,sum:binary>>"


def taken_out(docs: DataFrame, found: DataFrame, k: int, emit: str) -> DataFrame:
    """Documents without the words of their paths, and digests of all runs of words that a path names here or as a source."""
    mine = found.select("doc_id", "key", "start", "size", F.lit(True).alias("mine"))
    source = found.select(F.col("src").alias("doc_id"), F.col("src_key").alias("key"), F.col("src_start").alias("start"), "size", F.lit(False).alias("mine"))
    listed = mine.unionByName(source).distinct().groupBy("doc_id", "key").agg(F.collect_list(F.struct("start", "size", "mine")).alias("_runs"))
    both = docs.select("doc_id", F.xxhash64("text").alias("key"), "text").join(listed, ["doc_id", "key"], "left")

    def run(batches):
        for batch in batches:
            runs = batch.column("_runs")
            for lo, hi, data, offsets in text_slices(batch.column("text")):
                w = words(data, offsets, SPACED, fold=False)
                raw = data.tobytes()
                n, gone, kept, sums = np.diff(w.first), [], [], []
                for i in range(hi - lo):
                    parts = raw[offsets[i] : offsets[i + 1]].split()
                    own = runs[lo + i].as_py() if runs[lo + i].is_valid else []
                    keep = np.ones(len(parts), bool)
                    for s in own:
                        a, z = s["start"], s["start"] + s["size"] + k - 1
                        s["sum"] = hashlib.blake2b(b" ".join(parts[a:z]), digest_size=16).digest()
                        if s["mine"]:
                            keep[a:z] = False
                    left = [p for p, ok in zip(parts, keep.tolist(), strict=True) if ok] if own else parts
                    gone.append(len(parts) - len(left))
                    out = b" ".join(left)
                    kept.append(hashlib.sha256(out).hexdigest() if emit == "digest" else out.decode())
                    sums.append(own)
                own = batch.slice(lo, hi - lo)
                kind = pa.list_(pa.struct([("start", pa.int32()), ("size", pa.int32()), ("mine", pa.bool_()), ("sum", pa.binary())]))
                yield pa.RecordBatch.from_arrays(
                    [own.column("doc_id").cast(pa.int64()), own.column("key"), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.string()), pa.array(sums, kind)], names=["doc_id", "key", "n_words", "n_removed", "kept", "sums"]
                )
            release()

    return both.mapInArrow(run, MADE)


def unequal(made: DataFrame, found: DataFrame) -> DataFrame:
    """Paths whose words are not those at their source."""
    sums = made.where(F.size("sums") > 0).select("doc_id", "key", F.explode("sums").alias("s")).select("doc_id", "key", "s.*").distinct()
    here = sums.where("mine").select("doc_id", "key", "start", "size", F.col("sum").alias("here"))
    there = sums.where("not mine").select(F.col("doc_id").alias("src"), F.col("key").alias("src_key"), F.col("start").alias("src_start"), "size", F.col("sum").alias("there"))
    both = found.join(here, ["doc_id", "key", "start", "size"], "left").join(there, ["src", "src_key", "src_start", "size"], "left")
    return both.where(~F.coalesce(F.col("here") == F.col("there"), F.lit(False))).select(*found.columns)


def remove(docs: DataFrame, found: DataFrame, k: int = WINDOW, emit: str = "digest") -> DataFrame:
    """Take the words of verified paths out.  ``emit`` is ``digest`` or ``text`` (kept words joined by one space)."""
    small_batches(docs.sparkSession)
    made = cut(taken_out(docs, found, k, emit), "made")
    last = "kept_sha256" if emit == "digest" else "kept"
    result = lambda df: df.select("doc_id", "n_words", "n_removed", F.col("kept").alias(last))
    wrong = cut(unequal(made, found), "unequal")
    if not wrong.head(1):
        return result(made)
    ids = wrong.select("doc_id", "key").distinct()
    again = docs.withColumn("key", F.xxhash64("text")).join(ids, ["doc_id", "key"], "left_semi").select("doc_id", "text")
    sure = found.join(wrong, found.columns, "left_anti")
    return result(made.join(ids, ["doc_id", "key"], "left_anti").drop("sums")).unionByName(result(taken_out(again, sure.join(ids, ["doc_id", "key"], "left_semi"), k, emit)))


def documents_query(docs: DataFrame) -> DataFrame:
    return remove(docs, repeated_paths(docs))
