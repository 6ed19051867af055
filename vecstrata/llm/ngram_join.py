"""N-gram Jaccard join by multiple-global-order filtering.

A document is its set of five-word shingles, known by 64-bit hashes.  Under any global token order, two
sets with Jaccard similarity of t or more share a token among their first ``n - ceil(t n) + 1``.
Candidates must share prefix tokens under each of ``ORDERS`` orders, all by document frequency first
and by a hash of their own next:

1. each part of the input sends its shingles to buckets by hash; a bucket counts in how many
   places a shingle occurs and answers with those that occur more than once.  Shingles that occur
   once come first in every order, so a document with enough of them has no candidates and ends here.
   Parts and buckets grow together with the root of the input, so a record between the two holds 16
   shingles or more on average and their number follows the input;
2. the others are candidates.  Under one order, documents that share prefix tokens get one label
   (connected components over tokens, a star for each token, never all pairs), and only documents
   whose labels agree under all orders are compared: the filters are intersected;
3. groups that remain are verified by exact intersection sizes in blocks of ``BLOCK``.  A group of
   several blocks has ``PIVOTS`` pivots, sets of its own that are compared with every block.  What is
   linked through them is one component and is not compared again, so a group of near copies costs
   as much as it has members.  Jaccard distance is a metric: two blocks of different components are
   compared only where their distances to every pivot allow a link.

Documents with equal sets are one class throughout; only classes are compared.  No pair is emitted but
spanning links.

NULL and empty texts, and texts without words, have no shingles and link with nothing; fewer words
than five make one shingle.  Rows without a doc_id have no result; rows that repeat one get a row each.
A very long text is one slice of one part.  Ties of frequency go by hash.  An empty table gives no rows.
Other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import components, cut, drop_cut, shuffle_partitions, spanning
from .tokens import SPACED, U, binaries, heads_of, mix, release, small_batches, spread, text_bytes, text_slices, words

SHINGLE, PERCENT, ORDERS = 5, 80, 3
BLOCK, PIVOTS, TASK_ROWS = 128, 8, 2000


def shingle_sets(w, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, hash) of the distinct shingles, by document, and the number of each document's."""
    docs = len(w.first) - 1
    at, h = w.windows(k)
    doc = w.doc[at]
    size = np.diff(w.first)
    short = np.flatnonzero((size > 0) & (size < k))
    if len(short):
        h, doc = np.concatenate([h, w.whole()[short]]), np.concatenate([doc, short])
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    keep = np.ones(len(h), bool)
    keep[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    h, doc = h[keep], doc[keep]
    return doc, h, np.bincount(doc, minlength=docs)


def signatures(doc: np.ndarray, h: np.ndarray, n: np.ndarray) -> np.ndarray:
    """A hash of each set, 0 for an empty one."""
    out = np.zeros(len(n), U)
    head = np.flatnonzero(n)
    with np.errstate(over="ignore"):
        if len(head):
            out[head] = mix(np.add.reduceat(mix(h, 9), np.cumsum(n)[head] - n[head]) + n[head].astype(U)) | U(1)
    return out


MAPPED = "bucket int, part long, entries int, gaps binary, owner binary, docs binary, sigs binary, sizes binary"
ANSWER = "part long, owner binary, token binary, places binary, docs binary, sigs binary, sizes binary"
CLASSES = "doc_id long, sig long, n long, tokens binary, prefixes array<array<long>>"


def names_of(schema: str) -> list[str]:
    return [x.split()[0] for x in schema.split(", ")]


def home_of(h: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket of each hash; ranges of hashes, so that sorted hashes are sorted by bucket."""
    return (((h >> U(32)) * U(buckets)) >> U(32)).astype(np.int64)


def floor_of(bucket: np.ndarray, buckets: int) -> np.ndarray:
    """The least hash of each bucket."""
    return ((bucket.astype(U) << U(32)) + U(buckets - 1)) // U(buckets) << U(32)


def packed_gaps(h: np.ndarray, home: np.ndarray, head: np.ndarray, buckets: int) -> pa.Array:
    """For each run of one bucket the gaps between sorted hashes: six bytes each where all fit, else eight."""
    gaps = np.diff(h, prepend=U(0))
    gaps[head] = h[head] - floor_of(home[head], buckets)
    size = np.diff(np.append(head, len(h)))
    wide = np.maximum.reduceat(gaps, head) >= U(1 << 48) if len(head) else np.zeros(0, bool)
    raw = gaps.astype("<u8").view(np.uint8).reshape(-1, 8)
    keep = np.ones(raw.shape, bool)
    keep[:, 6:] = np.repeat(wide, size)[:, None]
    return binaries(raw[keep], size * np.where(wide, 8, 6))


def unpacked_gaps(gaps: bytes, n: int, floor: np.uint64) -> np.ndarray:
    wide = np.zeros((n, 8), np.uint8)
    raw = np.frombuffer(gaps, np.uint8).reshape(n, -1)
    wide[:, : raw.shape[1]] = raw
    with np.errstate(over="ignore"):
        return np.cumsum(wide.view("<u8").ravel(), dtype=U) + floor


def mapped(docs: DataFrame, k: int, buckets: int, entries: int) -> DataFrame:
    def part(number: int, held: list[tuple]) -> pa.RecordBatch:
        ids, sigs, sizes, owner, h = (np.concatenate(x) for x in zip(*held, strict=True))
        _, first = np.unique(sigs, return_index=True)
        first_of_class = np.zeros(len(sigs), bool)
        first_of_class[first] = True
        mine = first_of_class[owner]
        h, owner = h[mine], owner[mine]
        order = np.argsort(h, kind="stable")
        h, owner = h[order], owner[order].astype("<u2" if len(ids) <= 65536 else "<u4")
        home = home_of(h, buckets)
        head = heads_of(home)
        size = np.diff(np.append(head, len(h)))
        runs = len(head)
        sent = [
            pa.array(home[head], pa.int32()), pa.array(np.full(runs, number)), pa.array(size, pa.int32()), packed_gaps(h, home, head, buckets), binaries(owner, size * owner.itemsize),
            *[pa.nulls(runs, pa.binary())] * 3,
        ]
        whole = [[number % buckets], [number], [0], [None], [None], [ids.astype("<i8").tobytes()], [sigs.tobytes()], [sizes.astype("<u4").tobytes()]]
        return pa.RecordBatch.from_arrays([pa.concat_arrays([c, pa.array(w, c.type)]) for c, w in zip(sent, whole, strict=True)], names=names_of(MAPPED))

    def run(batches):
        held, n, docs_held, number = [], 0, 0, TaskContext.get().partitionId() << 24
        for batch in batches:
            ids = batch.column("doc_id").cast(pa.int64()).to_numpy(zero_copy_only=False)
            for lo, hi, data, offsets in text_slices(batch.column("text")):
                doc, h, sizes = shingle_sets(words(data, offsets, SPACED), k)
                held.append((np.asarray(ids[lo:hi]), signatures(doc, h, sizes), sizes, doc + docs_held, h))
                n, docs_held = n + len(h), docs_held + hi - lo
                if n >= entries or docs_held >= 200_000:
                    yield part(number, held)
                    held, n, docs_held, number = [], 0, 0, number + 1
                    release()
        if held:
            yield part(number, held)
        held = []
        release()

    return docs.where(F.col("doc_id").isNotNull()).select("doc_id", "text").mapInArrow(run, MAPPED)


def answered(sent: DataFrame, buckets: int) -> DataFrame:
    """For each part the places of its shingles that occur more than once; eighths of powers of two tell how often."""

    def run(table: pa.Table) -> pa.Table:
        floor = floor_of(np.array([table.column("bucket")[0].as_py()]), buckets)[0]
        through = table.filter(pc.is_valid(table.column("docs")))
        table = table.filter(pc.is_valid(table.column("gaps")))
        q, who, where = [np.zeros(0, U)], [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)]
        for part, n, gaps, owner in zip(*(table.column(c).to_pylist() for c in ("part", "entries", "gaps", "owner")), strict=True):
            who.append(np.frombuffer(owner, "<u2" if len(owner) == 2 * n else "<u4").astype(np.uint32))
            q.append(unpacked_gaps(gaps, n, floor))
            where.append(np.full(n, part))
        q, who, where = (np.concatenate(x) for x in (q, who, where))
        order = np.argsort(q, kind="stable")
        size = np.diff(np.append(heads_of(q[order]), len(q)))
        again = np.repeat(size > 1, size)
        places = np.minimum(255, 8 * np.log2(np.repeat(size, size)[again])).astype(np.uint8)
        order = order[again]
        by_part = np.lexsort((who[order], where[order]))
        q, who, where, places = q[order][by_part], who[order][by_part], where[order][by_part], places[by_part]
        head = heads_of(where)
        size = np.diff(np.append(head, len(where)))
        who = who.astype("<u2") if not len(who) or who.max() < 65536 else who.astype("<u4")
        cols = [pa.array(where[head], pa.int64()), binaries(who, size * who.itemsize), binaries(q.astype("<u8"), size * 8), binaries(places, size), *[pa.nulls(len(head), pa.binary())] * 3]
        own = [through.column(c).combine_chunks() for c in ("part", "docs", "sigs", "sizes")]
        whole = [own[0], *[pa.nulls(len(through), pa.binary())] * 3, *own[1:]]
        return pa.table([pa.concat_arrays([c, w.cast(c.type)]) for c, w in zip(cols, whole, strict=True)], names=names_of(ANSWER))

    return sent.groupBy("bucket").applyInArrow(run, ANSWER)


def needed(n: np.ndarray, percent: int) -> np.ndarray:
    """Least intersection with any partner: ceil(percent n / 100)."""
    return (percent * n + 99) // 100


def classes(answers: DataFrame, percent: int, orders: int) -> DataFrame:
    """Rows of two kinds: one for each document (tokens NULL), one for each class with candidates."""

    def run(table: pa.Table) -> pa.Table:
        out = []
        owner, token, places, ids, sigs, sizes = [], [], [], None, None, None
        for o, t, p, d, s, n in zip(*(table.column(c).to_pylist() for c in ("owner", "token", "places", "docs", "sigs", "sizes")), strict=True):
            if d is not None:
                ids, sigs, sizes = np.frombuffer(d, "<i8"), np.frombuffer(s, "<u8"), np.frombuffer(n, "<u4").astype(np.int64)
                continue
            owner.append(np.frombuffer(o, "<u2" if len(o) == 2 * len(p) else "<u4").astype(np.uint32))
            token.append(np.frombuffer(t, "<u8"))
            places.append(np.frombuffer(p, np.uint8))
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.list_(pa.int64()))]
        if ids is None:
            return pa.table([pa.array([], k) for k in kinds], names=names_of(CLASSES))
        if owner:
            owner, token, places = (np.concatenate(x) for x in (owner, token, places))
            shared = np.bincount(owner, minlength=len(ids))
            room = sizes - needed(sizes, percent) + 1 - (sizes - shared)
            keep = (room > 0)[owner]
            owner, token, places = owner[keep], token[keep], places[keep]
            firsts = []
            for k in range(orders):
                order = np.lexsort((mix(token, 20 + k), places, owner))
                own = owner[order]
                firsts.append((order, heads_of(own), own))
            order, head, own = firsts[0]
            for g, a in enumerate(head.tolist()):
                z = int(head[g + 1]) if g + 1 < len(head) else len(own)
                d = int(own[a])
                out.append((None, int(sigs[d : d + 1].view(np.int64)[0]), int(sizes[d]), np.sort(token[order[a:z]]).tobytes(), [token[firsts[k][0][a : a + int(room[d])]].astype(np.int64).tolist() for k in range(orders)]))
        cols = list(zip(*out, strict=True)) or [[]] * 5
        heads = [ids, sigs.view(np.int64), sizes, [None] * len(ids), [None] * len(ids)]
        return pa.table([pa.concat_arrays([pa.array(h, k), pa.array(list(c), k)]) for h, c, k in zip(heads, cols, kinds, strict=True)], names=names_of(CLASSES))

    return answers.groupBy("part").applyInArrow(run, CLASSES)


def prefix_groups(candidates: DataFrame, orders: int) -> DataFrame:
    """``sig, label``: classes that share prefix tokens, directly or through others, under every order."""
    node = lambda k: F.xxhash64("sig", k)  # noqa: E731  one id for a class under an order, so that one run labels all orders
    rows = candidates.select("sig", F.posexplode("prefixes").alias("k", "tokens")).select(node("k").alias("node"), "k", F.explode("tokens").alias("token"))
    low = cut(rows.groupBy("k", "token").agg(F.min("node").alias("low"), F.max("node").alias("high")).where("low < high").drop("high"), "tokens")
    star = rows.join(low, ["k", "token"]).where("node <> low").select(F.col("node").alias("a"), F.col("low").alias("b")).distinct()
    labels = components(star)
    ks = F.explode(F.sequence(F.lit(0), F.lit(orders - 1))).alias("k")
    every = candidates.select("sig").distinct().select("sig", ks).select("sig", "k", node("k").alias("id")).join(labels, "id")
    # a class without a label under some order shares no prefix token there and drops out
    by_order = every.groupBy("sig").agg(F.sort_array(F.collect_list(F.struct("k", "label"))).alias("l")).where(F.size("l") == orders)
    return by_order.select("sig", F.xxhash64("l").alias("label"))


def intersections(a: list[np.ndarray], b: list[np.ndarray], chunk: int = 4096) -> np.ndarray:
    """Sizes of all intersections, over the tokens that two or more of the sets hold."""
    sets = a if a is b else a + b
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    token, count = np.unique(np.concatenate(sets), return_counts=True)
    at = np.searchsorted(token, np.concatenate(sets))
    keep = (count > 1)[at]
    place = (np.cumsum(count > 1) - 1)[at[keep]]
    owner, width = owner[keep], int((count > 1).sum())
    out = np.zeros((len(a), len(b)), np.float32)
    order = np.argsort(place, kind="stable")
    owner, place = owner[order], place[order]
    for lo in range(0, width, chunk):
        s, e = np.searchsorted(place, [lo, lo + chunk])
        m = np.zeros((len(sets), min(chunk, width - lo)), np.float32)
        m[owner[s:e], place[s:e] - lo] = 1
        out += m[: len(a)] @ (m if a is b else m[len(a) :]).T
    return out.astype(np.int64)


def found_links(part: pd.DataFrame, others: pd.DataFrame | None, percent: int) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """Similarities of the rows of ``part`` with themselves and with ``others``, and spanning links of both."""
    a = [np.frombuffer(t, "<u8") for t in part["tokens"]]
    n, ids = part["n"].to_numpy(), part["sig"].to_numpy()
    if others is None:
        both, total, ids_b = intersections(a, a), n, ids
    else:
        both = intersections(a, [np.frombuffer(t, "<u8") for t in others["tokens"]])
        total, ids_b = others["n"].to_numpy(), others["sig"].to_numpy()
    either = n[:, None] + total[None, :] - both
    return both / either, spanning(100 * both >= percent * either, ids, ids_b)


def in_blocks(sets: DataFrame, placed: DataFrame, tasks: int, percent: int) -> DataFrame:
    """``a, b`` for spanning links inside the blocks of all groups and with their pivots; for the rows of
    groups of several blocks also ``label, sig, n, far``: their distances to the pivots of the group.

    ``sets`` may hold a class more than once.  They are shuffled to the places of their classes and from there
    to their blocks; a pivot goes to every block of its group."""
    placed = placed.withColumn("own", F.pmod(F.xxhash64("sig"), F.col("blocks")))
    least = [F.min(F.struct(F.xxhash64("sig", F.lit(i)).alias("h"), "sig")).alias(f"p{i}") for i in range(PIVOTS)]
    several = placed.where("blocks > 1").groupBy("label").agg(*least)
    chosen = several.select(F.explode(F.array_distinct(F.array(*[F.col(f"p{i}.sig") for i in range(PIVOTS)]))).alias("sig"), F.lit(True).alias("chosen"))
    at = lambda own, pivot: F.struct(own.alias("own"), F.lit(pivot).alias("pivot"))
    everywhere = F.transform(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1), lambda i: at(i, 1))
    homes = F.concat(F.array(at(F.col("own"), 0)), F.when(F.col("chosen"), everywhere).otherwise(F.array().cast("array<struct<own:bigint,pivot:int>>")))
    once = sets.join(placed.join(chosen, "sig", "left"), "sig").dropDuplicates(["sig"])
    rows = once.select("label", F.explode(homes).alias("home"), "sig", "n", "tokens").select("label", "home.*", "sig", "n", "tokens")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for (label, _), part in pdf.groupby(["label", "own"], sort=False):
            rows, own = part[part["pivot"] == 0], part[part["pivot"] == 1].sort_values("sig")
            if not len(rows):
                continue
            _, links = found_links(rows, None, percent)
            if len(own):
                near, more = found_links(rows, own, percent)
                links = links + more
                out += [(None, None, label, sig, n, far) for sig, n, far in zip(rows["sig"].tolist(), rows["n"].tolist(), (1 - near).tolist(), strict=True)]
            out += [(a, b, None, None, None, None) for a, b in links]
        cols = list(zip(*out, strict=True)) or [[]] * 6
        kinds = ["Int64"] * 5 + ["object"]
        return pd.DataFrame({c: pd.Series(list(v), dtype=k) for c, v, k in zip(("a", "b", "label", "sig", "n", "far"), cols, kinds, strict=True)})

    return rows.withColumn("task", F.pmod(F.xxhash64("label", "own"), F.lit(tasks))).groupBy("task").applyInPandas(run, "a long, b long, label long, sig long, n long, far array<float>")


def across_blocks(sets: DataFrame, seen: DataFrame, labels: DataFrame, tasks: int, percent: int) -> DataFrame:
    """``a, b``: spanning links between blocks of different components of one group.

    ``seen`` are rows with their distances to the pivots.  A large component has blocks of its own, the rest
    of a group is dealt in blocks by the nearest pivot.
    """
    nearest = F.array_position("far", F.array_min("far"))
    rows = seen.join(labels.withColumnRenamed("id", "sig").withColumnRenamed("label", "comp"), "sig", "left").select("label", "sig", "n", "far", F.coalesce("comp", "sig").alias("comp"), nearest.alias("nearest"))
    rows = cut(rows, "placed")
    several = rows.groupBy("label", "comp").agg(F.count("*").alias("c"))
    open_groups = several.groupBy("label").agg(F.count("*").alias("comps")).where("comps > 1").select("label")
    rows = rows.join(open_groups, "label", "left_semi").join(several, ["label", "comp"])
    small = rows.where(F.col("c") <= BLOCK).groupBy("label", "nearest").agg(F.count("*").alias("s"))
    rows = rows.join(small, ["label", "nearest"], "left").withColumn("only", F.when(F.col("c") > BLOCK, F.col("comp")))
    parts = F.ceil(F.when(F.col("c") > BLOCK, F.col("c")).otherwise(F.col("s")) / BLOCK)
    key = F.when(F.col("c") > BLOCK, F.col("comp")).otherwise(F.col("nearest"))
    rows = cut(rows.select("label", "sig", "n", "far", "only", F.xxhash64("label", F.col("c") > BLOCK, key, F.pmod(F.xxhash64("sig", F.lit(3)), parts)).alias("unit")), "units")
    spread_of = [F.min(F.get("far", F.lit(i))).alias(f"lo{i}") for i in range(PIVOTS)] + [F.max(F.get("far", F.lit(i))).alias(f"hi{i}") for i in range(PIVOTS)]
    units = cut(rows.groupBy("label", "unit", "only").agg(F.min("n").alias("least"), F.max("n").alias("most"), *spread_of), "unit_bounds")
    u, v = units.alias("u"), units.alias("v")
    room = 1 - percent / 100 + 1e-4
    allowed = (F.col("u.unit") <= F.col("v.unit")) & ~F.coalesce(F.col("u.only") == F.col("v.only"), F.lit(False))
    allowed &= (100 * F.col("u.most") >= percent * F.col("v.least")) & (100 * F.col("v.most") >= percent * F.col("u.least"))
    for i in range(PIVOTS):
        allowed &= F.coalesce((F.col(f"u.lo{i}") - F.col(f"v.hi{i}") <= room) & (F.col(f"v.lo{i}") - F.col(f"u.hi{i}") <= room), F.lit(True))
    pairs = u.join(v, (F.col("u.label") == F.col("v.label")) & allowed).select(F.col("u.unit").alias("i"), F.col("v.unit").alias("j"))
    sides = F.explode(F.when(F.col("i") == F.col("j"), F.array("i")).otherwise(F.array("i", "j"))).alias("unit")
    dealt = cut(pairs, "pairs").select("i", "j", sides).join(rows.select("unit", "sig"), "unit").join(sets, "sig").dropDuplicates(["i", "j", "sig"])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple[int, int]] = []
        for (i, j), part in pdf.groupby(["i", "j"], sort=False):
            left, right = part[part["unit"] == i], part[part["unit"] == j] if i != j else None
            if len(left) and (right is None or len(right)):
                out += found_links(left, right, percent)[1]
        return pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    return dealt.withColumn("task", F.pmod(F.xxhash64("i", "j"), F.lit(tasks))).groupBy("task").applyInPandas(run, "a long, b long")


def linked(sets: DataFrame, groups: DataFrame, percent: int) -> DataFrame:
    """``id, label``: components of the classes ``sig, n, tokens`` by similarity, inside the groups ``sig, label``."""
    counted = groups.groupBy("label").agg(F.count("*").alias("c")).where("c > 1")
    sizes = cut(counted.withColumn("blocks", F.ceil(F.col("c") / BLOCK)), "sizes")
    total, most = sizes.agg(F.coalesce(F.sum("c"), F.lit(0)), F.coalesce(F.max("blocks"), F.lit(0))).first()
    tasks = max(4 * shuffle_partitions(sets.sparkSession), total // TASK_ROWS)
    first = cut(in_blocks(sets, groups.join(sizes.select("label", "blocks"), "label"), tasks, percent), "in_blocks")
    labels = components(first.where("a is not null").select("a", "b"))
    if most <= 1:
        return labels
    labels = cut(labels, "labels")
    more = across_blocks(sets, first.where("sig is not null").select("label", "sig", "n", "far"), labels, tasks, percent)
    return components(cut(more.unionByName(labels.select(F.col("id").alias("a"), F.col("label").alias("b"))), "across"))


def join(docs: DataFrame, k: int = SHINGLE, percent: int = PERCENT, orders: int = ORDERS) -> DataFrame:
    """``doc_id, n_shingles, component_id`` for every row with a doc_id."""
    small_batches(docs.sparkSession)
    buckets, entries = spread(text_bytes(docs))
    both = cut(classes(answered(mapped(docs, k, buckets, entries), buckets), percent, orders), "classes")
    rows = both.where("doc_id is not null").select("doc_id", "n", F.when(F.col("n") > 0, F.col("sig")).alias("sig"))
    candidates = both.where("doc_id is null")
    groups = cut(prefix_groups(candidates.select("sig", "prefixes"), orders), "groups")
    labels = linked(candidates.select("sig", "n", "tokens"), groups, percent)
    keyed = rows.join(labels.withColumnRenamed("id", "sig"), "sig", "left").select("doc_id", "n", F.coalesce("label", "sig").alias("key"))
    keyed = cut(keyed, "keyed")
    drop_cut(both)  # nothing reads the sets any more
    low = cut(keyed.where("key is not null").groupBy("key").agg(F.min("doc_id").alias("low")), "lowest")
    return keyed.join(low, "key", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("low", "doc_id").alias("component_id"))
