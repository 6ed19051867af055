"""Embedding near-dedup by sorted projection passes and an exact check of what they left apart.

Equal vectors are one representative with a count.  In each pass the representatives are ordered by
a code of 64 concatenated random hyperplane signs about the mean of all rows, and every vector is compared
with all in a window after it, across the ends of parts.  Pairs with cosine of at least the threshold are
links; the links of all passes are united into components.  Then every pair of representatives is settled
once: inside a component all pairs of blocks are compared and counted; between components the rows, packed
in blocks in the order of a pass, are compared unless the balls around two blocks rule all their pairs out.
So links, their number and components are exact whatever the passes found: passes and window only say how
much is left to the check, which is quadratic in what balls do not rule out.  Nothing comes from a sample.

``exact=False`` leaves out the check: then passes and window are planned from a sample to find the share
``RECALL`` of pairs at just the threshold, and pairs that no window shows are lost.

Vectors that are NULL, empty, zero or hold NULL or non-finite components link with nothing; vectors
of different width neither.  Equal rows link with each other.  Very long vectors are rows like others.
Rows without a vec_id get no links.  An empty table gives no rows.  Other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import is_finite
from .shared import components, cut, paired_blocks, shuffle_partitions, spanning

BLOCK, SEED = 256, 11
#: Passes and window before the exact check.
PASSES, WINDOW = 4, 256
#: The check: rows and values of a packed block at most, values of a file, joined blocks sent to Python at once, bytes a task reads of a side.
PACKED, PACKED_VALUES, FILE_VALUES = 2048, 1 << 18, 1 << 22
#: Components of at least this share of all rows lie in blocks of their own, which are not compared with each other again.
LARGE = 1 / 10_000
CHECK_CONF = {"spark.sql.execution.arrow.maxRecordsPerBatch": "8", "spark.sql.files.maxPartitionBytes": "32m"}
#: Without the check: share of the pairs at just the threshold that the passes have to find; what the plan is measured with.
RECALL, SAMPLE_VALUES, PROBES, TRIALS = 0.998, 1 << 20, 256, 48


def unit(column) -> np.ndarray:
    """Rows of equal width as double unit vectors."""
    x = np.array(column, dtype=np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def rows_of(column: pa.Array) -> np.ndarray:
    """Lists of one width as unit vectors, without Python objects in between."""
    return unit(column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1))


def near_pairs(x: np.ndarray, y: np.ndarray, threshold: float) -> np.ndarray:
    """Which rows of ``x`` and ``y`` have a cosine of the threshold or more: single precision tells all but
    those within its rounding of the threshold, which are taken again in double precision."""
    rough = x.astype(np.float32) @ y.astype(np.float32).T
    margin = 2.5e-7 * (x.shape[1] + 8)
    near = rough >= threshold - margin
    at = np.flatnonzero(near)  # of two dimensions at once it takes longer than the product
    r, c = np.divmod(at[rough.ravel()[at] < threshold + margin], len(y))
    near[r, c] = np.einsum("ij,ij->i", x[r], y[c]) >= threshold
    return near


def planes(p: int, width: int) -> np.ndarray:
    return np.random.default_rng((SEED, p, width)).standard_normal((width, 64))


def code(x: np.ndarray, p: int) -> np.ndarray:
    """64-bit sign codes of a pass, as integers whose order is the order of the bits."""
    bits = np.packbits(x @ planes(p, x.shape[1]) > 0, axis=1)
    return (bits.view(">u8").ravel().astype(np.uint64) ^ np.uint64(1 << 63)).view(np.int64)


def near_hits(sample: np.ndarray, mean: np.ndarray, rows: int, threshold: float, windows: list[int]) -> list[np.ndarray]:
    """For each window the chance, in one pass over ``rows`` rows like the sample, that a partner at
    just the threshold is inside the window of a row: one value for each of some sampled rows."""
    rng = np.random.default_rng(SEED)
    x = sample[rng.choice(len(sample), min(PROBES, len(sample)), replace=False)]
    u = rng.standard_normal(x.shape)
    u -= (u * x).sum(axis=1, keepdims=True) * x
    y = threshold * x + np.sqrt(1 - threshold**2) * u / np.maximum(1e-300, np.sqrt((u * u).sum(axis=1, keepdims=True)))
    gaps = []
    for p in range(TRIALS):
        order = np.sort(code(sample - mean, p))
        a, b = code(x - mean, p), code(y - mean, p)
        lo, hi = np.minimum(a, b), np.maximum(a, b)
        gaps.append(np.searchsorted(order, hi, "right") - np.searchsorted(order, lo, "left"))  # ties count as between
    gaps, scale = np.array(gaps), rows / len(sample)
    share = lambda w: (gaps <= w).mean()
    out = []
    for w in windows:
        fine = max(w / scale, 8.0)  # a window of fewer sampled rows is not seen: carried on as a power of the window
        slope = np.log2(max(share(2 * fine), 1e-6) / max(share(fine), 1e-6)) if w / scale < fine else 0.0
        out.append(((gaps <= fine).sum(axis=0) + 0.5) / (TRIALS + 1) * (w / scale / fine) ** slope)
    return out


def plan(sample: np.ndarray, mean: np.ndarray, rows: int, threshold: float, window: int | None = None) -> tuple[int, int]:
    """The cheapest ``passes, window`` that find the share ``RECALL`` of pairs at the threshold;
    ``1, rows`` (all pairs) where that is cheaper.  There is no upper bound on either.
    A given ``window`` is kept."""
    windows = [w for w in ([window] if window else (256, 512, 1024, 2048, 4096, 8192)) if w < rows]
    best = (np.inf if window and windows else 1.5 * rows), 1, rows
    for w, h in zip(windows, near_hits(sample, mean, rows, threshold, windows) if windows else [], strict=True):
        passes = 1
        while np.mean((1 - h) ** passes) > 1 - RECALL and passes * (1024 + 2 * w) < best[0]:
            passes += 1
        best = min(best, (passes * (1024 + 2 * w), passes, w))
    return best[1], best[2]


def planned(reps: DataFrame, threshold: float, own: int | None = None) -> tuple[dict[int, np.ndarray], int, int]:
    """For runs without the check: means of the sampled unit vectors by width, passes and window, the most that any width asks for."""
    means, passes, window = {}, 1, 2
    for width, n in reps.groupBy(F.size("embedding")).count().collect():
        some = min(n, max(1000, SAMPLE_VALUES // width))
        rows = reps.where(F.size("embedding") == width).orderBy(F.xxhash64("rep")).limit(some).select("embedding").collect()
        x = unit([r[0] for r in rows])
        means[width] = x.mean(axis=0)
        p, w = plan(x, means[width], n, threshold, own)
        passes, window = max(passes, p), max(window, w)
    return means, passes, window


def centers(reps: DataFrame) -> tuple[dict[int, np.ndarray], dict[int, int]]:
    """Means of the unit vectors and numbers of rows by width, from all rows."""

    def run(batches):
        sums, count = {}, {}
        for batch in batches:
            for lo in range(0, len(batch), 1000):
                column = batch.column("embedding").slice(lo, 1000)
                width = np.array([len(v) for v in column])
                for w in np.unique(width).tolist():
                    x = rows_of(column.filter(pa.array(width == w)))
                    sums[w], count[w] = sums.get(w, 0.0) + x.sum(axis=0), count.get(w, 0) + len(x)
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array(list(count.values()), pa.int64()), pa.array(list(sums.values()), pa.list_(pa.float64()))], names=["width", "n", "total"])

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"width": pdf["width"][:1], "n": pdf["n"].sum(), "total": [np.sum(pdf["total"].tolist(), axis=0)]})

    kind = "width int, n long, total array<double>"
    rows = reps.select("embedding").mapInArrow(run, kind).groupBy("width").applyInPandas(add, kind).collect()
    return {w: np.array(total) / n for w, n, total in rows}, {w: n for w, n, _ in rows}


def ordered(reps: DataFrame, passes: int, means: dict[int, np.ndarray]) -> DataFrame:
    """``pass, width, code, rep, embedding`` and the other columns of ``reps``: one row for each row and pass."""
    rest = [c for c in reps.columns if c not in ("rep", "embedding")]

    def run(batches):
        for batch in batches:
            for lo in range(0, len(batch), 1000):
                rows = batch.slice(lo, 1000)
                width = np.array([len(v) for v in rows.column("embedding")])
                for w in np.unique(width):
                    part = rows.filter(pa.array(width == w))
                    x, n = rows_of(part.column("embedding")) - means.get(int(w), 0.0), len(part)
                    for p in range(passes):
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(np.full(n, p, np.int32)), pa.array(np.full(n, w, np.int32)), pa.array(code(x, p)), *[part.column(c) for c in ("rep", "embedding", *rest)]],
                            names=["pass", "width", "code", "rep", "embedding", *rest],
                        )

    kind = reps.schema["embedding"].dataType.simpleString()
    more = "".join(f", {c} {reps.schema[c].dataType.simpleString()}" for c in rest)
    return reps.select("rep", "embedding", *rest).mapInArrow(run, f"pass int, width int, code long, rep long, embedding {kind}{more}")


def window_links(spread: DataFrame, threshold: float, window: int) -> DataFrame:
    """``a, b``: spanning links of what the windows verify.  Rows near an end of a sorted part are
    written too, and compared across the ends of parts."""
    kind = spread.schema["embedding"].dataType.simpleString()
    names = ["a", "b", "part", "pos", "total", "pass", "width", "rep", "embedding"]

    def run(batches):
        number, pos, key, ids, x = TaskContext.get().partitionId(), 0, None, np.zeros(0, np.int64), None
        tail = None
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64()]

        def made(n, vectors, **cols):
            every = [pa.array(cols[c], k) if c in cols else pa.nulls(n, k) for c, k in zip(names[:-1], kinds, strict=True)]
            return pa.RecordBatch.from_arrays([*every, vectors], names=names)

        def ends(rows, at):
            return made(len(rows), rows.column("embedding"), part=np.full(len(rows), number), pos=at, **{c: rows.column(c).to_pylist() for c in ("pass", "width", "rep")})

        vector_kind = None
        for whole in batches:
            for cut_at in range(0, len(whole), 4096):
                batch = whole.slice(cut_at, 4096)
                vector_kind, links = batch.schema.field("embedding").type, []
                head = batch.slice(0, max(0, window - pos))
                if len(head):
                    yield ends(head, np.arange(pos, pos + len(head)))
                table = pa.Table.from_batches([batch.select(["pass", "width", "rep", "embedding"])])
                tail = table if tail is None else pa.concat_tables([tail, table])
                tail = tail.slice(max(0, len(tail) - window))
                pos += len(batch)
                frame = batch.select(["pass", "width", "rep"]).to_pandas()
                for k, at in frame.groupby(["pass", "width"], sort=False).indices.items():
                    y, own = rows_of(batch.column("embedding").take(pa.array(at))), frame["rep"].to_numpy()[at]
                    old = len(ids) if k == key else 0
                    x, ids = (np.concatenate([x, y]), np.concatenate([ids, own])) if old else (y, own)
                    for lo in range(old, len(ids), 256):
                        hi, base = min(lo + 256, len(ids)), max(0, lo - window)
                        step = np.arange(lo, hi)[:, None] - np.arange(base, hi)[None, :]
                        near = near_pairs(x[lo:hi], x[base:hi], threshold) & (step > 0) & (step <= window)
                        links += spanning(near, ids[lo:hi], ids[base:hi])
                    key, x, ids = k, x[-window:], ids[-window:]
                if links:
                    a, b = zip(*links, strict=True)
                    yield made(len(a), pa.nulls(len(a), vector_kind), a=a, b=b)
        if pos:
            left = tail.combine_chunks().slice(max(0, len(tail) - max(0, pos - window)))
            for rows in left.to_batches():
                if len(rows):
                    yield ends(rows, np.arange(pos - len(rows), pos))
            yield made(1, pa.nulls(1, vector_kind), part=[number], total=[pos])

    keys = ["pass", "width", "code", "rep"]
    parts = shuffle_partitions(spread.sparkSession)
    found = cut(spread.repartitionByRange(parts, *keys).sortWithinPartitions(*keys).mapInArrow(run, f"a long, b long, part int, pos long, total long, pass int, width int, rep long, embedding {kind}"), "windows")
    sizes = dict(found.where("total is not null").select("part", "total").collect())  # one small row a task
    first, done = {}, 0
    for part in sorted(sizes):
        first[part], done = done, done + sizes[part]
    bounds = np.array(sorted(first.values())[1:], np.int64)

    def meet(batches):
        for batch in batches:
            g = np.array([first[p] for p in batch.column("part").to_pylist()], np.int64) + batch.column("pos").to_numpy()
            lo, hi = np.searchsorted(bounds, g - window, "right"), np.searchsorted(bounds, g + window, "right")
            at = np.repeat(np.arange(len(g)), hi - lo)
            bound = bounds[np.arange(len(at)) - np.repeat(np.cumsum(hi - lo) - (hi - lo), hi - lo) + lo[at]] if len(at) else np.zeros(0, np.int64)
            rows = batch.select(["pass", "width", "rep", "embedding"]).take(pa.array(at))
            yield pa.RecordBatch.from_arrays([pa.array(bound), pa.array(g[at]), *rows.columns], names=["bound", "g", "pass", "width", "rep", "embedding"])

    def across(pdf: pd.DataFrame) -> pd.DataFrame:
        links = []
        for _, rows in pdf.groupby(["pass", "width"], sort=False):
            left, right = rows[rows["g"] < rows["bound"]], rows[rows["g"] >= rows["bound"]]
            if len(left) and len(right):
                step = right["g"].to_numpy()[:, None] - left["g"].to_numpy()[None, :]
                near = near_pairs(unit(right["embedding"].tolist()), unit(left["embedding"].tolist()), threshold) & (step <= window)
                links += spanning(near, right["rep"].to_numpy(), left["rep"].to_numpy())
        return pd.DataFrame(links, columns=["a", "b"]).astype("int64")

    edges = found.where("pos is not null").select("part", "pos", "pass", "width", "rep", "embedding")
    met = edges.mapInArrow(meet, f"bound long, g long, pass int, width int, rep long, embedding {kind}").groupBy("bound").applyInPandas(across, "a long, b long")
    return found.where("a is not null").select("a", "b").unionByName(met)


def packed(members: DataFrame, means: dict[int, np.ndarray], rows: int, parts: int) -> DataFrame:
    """Rows of ``label, rep, copies, embedding`` in blocks of one width, in the order of a pass: a unit center, the angle
    to it that holds all rows, and the label where all rows have one, as the rows of large components do (10,000 labels at most, so they are broadcast)."""
    dtype = "<f4" if members.schema["embedding"].dataType.elementType.simpleString() == "float" else "<f8"

    def run(batches):
        at = TaskContext.get().partitionId() << 32
        for batch in batches:
            width, large = batch.column("width").to_numpy(), batch.column("large").to_numpy(zero_copy_only=False)
            start = np.flatnonzero(np.concatenate([[True], (width[1:] != width[:-1]) | (large[1:] != large[:-1])])) if len(batch) else []
            for lo, hi in zip(start, [*start[1:], len(batch)], strict=True):
                w = int(width[lo])
                pieces = -(-(hi - lo) // max(1, min(PACKED, PACKED_VALUES // w)))
                for piece in np.array_split(np.arange(lo, hi), pieces):
                    part = batch.slice(piece[0], len(piece))
                    vectors = part.column("embedding").flatten().to_numpy(zero_copy_only=False).astype(dtype)
                    x = unit(vectors.reshape(-1, w))
                    center = x.sum(axis=0)
                    center = unit((center if np.abs(center).max() > 1e-9 else x[0])[None])[0]
                    labels = part.column("label").to_numpy()
                    columns = {
                        "at": at, "width": w, "label": int(labels[0]) if (labels == labels[0]).all() else None,
                        "center": center, "angle": float(np.arccos(np.clip((x @ center).min(), -1, 1))),
                        "ids": part.column("rep").to_numpy().tobytes(), "labels": labels.tobytes(), "copies": part.column("copies").to_numpy().tobytes(), "vectors": vectors.tobytes(),
                    }
                    at += 1
                    yield pa.RecordBatch.from_pylist([columns], schema)

    schema = pa.schema(
        [("at", pa.int64()), ("width", pa.int32()), ("label", pa.int64()), ("center", pa.list_(pa.float64())), ("angle", pa.float64()), *[(c, pa.binary()) for c in ("ids", "labels", "copies", "vectors")]]
    )
    sizes = members.groupBy("label").agg(F.count("*").alias("c")).where(F.col("c") >= max(PACKED, LARGE * rows)).select("label", F.col("label").alias("large"))
    keyed = members.join(F.broadcast(sizes), "label", "left").withColumn("small", F.col("large").isNull()).withColumn("large", F.coalesce("large", F.lit(0).cast("long")))
    keys = ["width", "small", "large", "code", "rep"]
    spread = ordered(keyed, 1, means).repartitionByRange(parts, *keys).sortWithinPartitions(*keys)
    return spread.mapInArrow(run, "at long, width int, label long, center array<double>, angle double, ids binary, labels binary, copies binary, vectors binary")


def apart(threshold: float) -> Column:
    """Whether the balls of two blocks rule out a link between them."""
    dot = F.aggregate(F.zip_with("a_center", "b_center", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    return F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot))) > F.col("a_angle") + F.col("b_angle") + float(np.arccos(np.clip(threshold, -1, 1))) + 1e-6


def check(members: DataFrame, means: dict[int, np.ndarray], sizes: dict[int, int], threshold: float) -> DataFrame:
    """All links between rows of different labels: ``a, b`` spanning links, ``a, n`` how many a row has.

    Every pair of blocks meets once.  Neither side is shuffled or broadcast: a task reads a file of each."""

    def run(batches):
        held, x = None, None
        for batch in batches:
            for row in batch.to_pylist():
                w, same = row["a_width"], row["a_at"] == row["b_at"]
                kind = f"<f{len(row['a_vectors']) * 8 // (len(row['a_ids']) * w)}"
                if held != row["a_at"]:
                    held, x = row["a_at"], unit(np.frombuffer(row["a_vectors"], kind).reshape(-1, w))
                y = x if same else unit(np.frombuffer(row["b_vectors"], kind).reshape(-1, w))
                r, c = np.divmod(np.flatnonzero(near_pairs(x, y, threshold)), len(y))
                (ids, labels, copies), (ids2, labels2, copies2) = ([np.frombuffer(row[f"{side}_{k}"], np.int64) for k in ("ids", "labels", "copies")] for side in "ab")
                new = (labels[r] != labels2[c]) & ((r < c) if same else True)
                r, c = r[new], c[new]
                if not len(r):
                    continue
                near = np.zeros((len(ids), len(ids2)), bool)
                near[r, c] = True
                a, b = zip(*spanning(near, ids, ids2), strict=True)
                yield made(a, b, None)
                for own, i, other in ((ids, r, copies2[c]), (ids2, c, copies[r])):
                    n = np.zeros(len(own), np.int64)
                    np.add.at(n, i, other)
                    yield made(own[n > 0], None, n[n > 0])

    def made(a, b, n):
        return pa.RecordBatch.from_arrays([pa.nulls(len(a), pa.int64()) if c is None else pa.array(c, pa.int64()) for c in (a, b, n)], names=["a", "b", "n"])

    rows, values = sum(sizes.values()), sum(w * n for w, n in sizes.items())
    blocks = cut(packed(members, means, rows, max(1, min(16, rows // 1024), -(-values // FILE_VALUES))), "blocks")
    left, right = (blocks.toDF(*[f"{side}_{c}" for c in blocks.columns]) for side in "ab")
    # of (a, b) and (b, a) one is taken, for even sums the one and for odd sums the other: tasks get like shares
    once = (F.col("a_at") == F.col("b_at")) | ((F.col("a_at") < F.col("b_at")) != (F.pmod(F.col("a_at") + F.col("b_at"), F.lit(2)) == 1))
    one = F.coalesce(F.col("a_label") - F.col("b_label") == 0, F.lit(False))
    met = left.join(right.hint("shuffle_replicate_nl"), once & (F.col("a_width") - F.col("b_width") == 0) & ~one & ~apart(threshold))
    sides = [f"{side}_{c}" for side in "ab" for c in ("at", "width", "ids", "labels", "copies", "vectors")]
    spark = members.sparkSession
    before = {k: spark.conf.get(k) for k in CHECK_CONF}
    try:
        for k, v in CHECK_CONF.items():
            spark.conf.set(k, v)
        return cut(met.select(*sides).mapInArrow(run, "a long, b long, n long"), "checked")
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def count_links(members: DataFrame, threshold: float) -> DataFrame:
    """``rep, n``: links to other representatives of its component, weighted by their copies."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for (_, i, j), part in pdf.groupby(["label", "i", "j"], sort=False):
            a = part[part["own"] == i]
            x, ca = unit(a["embedding"].tolist()), a["copies"].to_numpy()
            b = a if i == j else part[part["own"] == j]
            if not len(b):
                continue
            y, cb = (x, ca) if i == j else (unit(b["embedding"].tolist()), b["copies"].to_numpy())
            near = near_pairs(x, y, threshold)
            if i == j:
                np.fill_diagonal(near, False)
            out.append(pd.DataFrame({"rep": a["rep"], "n": near @ cb}))
            if i != j:
                out.append(pd.DataFrame({"rep": b["rep"], "n": near.T @ ca}))
        return pd.concat(out) if out else pd.DataFrame({"rep": pd.Series(dtype="int64"), "n": pd.Series(dtype="int64")})

    pairs = paired_blocks(members, "label", "rep", BLOCK).select("task", "label", "i", "j", "own", "rep", "copies", "embedding")
    return pairs.groupBy("task").applyInPandas(run, "rep long, n long").groupBy("rep").agg(F.sum("n").alias("n"))


def near_duplicates(vectors: DataFrame, threshold: float = 0.9, passes: int | None = None, window: int | None = None, exact: bool = True) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for every row of ``vec_id, embedding``; ``passes`` and ``window`` replace
    the usual ones.  Without ``exact`` the check is left out and links that no window shows are lost."""
    v = F.col("embedding")
    usable = F.coalesce(is_finite(v) & F.exists(v, lambda x: x != 0), F.lit(False))
    keyed = vectors.select("vec_id", "embedding", F.when(usable, F.xxhash64(v)).alias("h1"), F.when(usable, F.xxhash64(F.lit(1), v)).alias("h2"))
    reps = cut(
        keyed.where("h1 is not null and vec_id is not null").groupBy("h1", "h2").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"), F.first("embedding").alias("embedding")), "reps"
    )
    means, sizes = centers(reps)
    most = max(sizes.values(), default=0)
    if not exact:
        means, planned_passes, planned_window = planned(reps, threshold, window)
        passes, window = passes or planned_passes, window or planned_window
        exact = window >= most  # all pairs are cheaper
    if exact:
        passes, window = passes or PASSES, WINDOW if window is None or window >= most else window
    if window >= most - 1:
        passes, exact = 1, False  # a window of all rows shows all pairs
    labels = components(cut(window_links(ordered(reps.select("rep", "embedding"), passes, means), threshold, window), "links")).withColumnRenamed("id", "rep")
    counts = count_links(reps.join(labels, "rep").select("label", "rep", "copies", "embedding"), threshold)
    if exact:
        found = check(reps.join(labels, "rep", "left").select("rep", "copies", "embedding", F.coalesce("label", "rep").alias("label")), means, sizes, threshold)
        counts = counts.unionByName(found.where("n is not null").select(F.col("a").alias("rep"), "n")).groupBy("rep").agg(F.sum("n").alias("n"))
        more = found.where("b is not null").select("a", "b")
        if more.head(1):
            labels = components(more.unionByName(labels.select(F.col("rep").alias("a"), F.col("label").alias("b")))).withColumnRenamed("id", "rep")
    known = reps.select("h1", "h2", "rep", "copies").join(labels, "rep", "left").join(counts, "rep", "left")
    known = cut(known.select("h1", "h2", "copies", F.coalesce("label", "rep").alias("label"), F.coalesce("n", F.lit(0)).alias("n")), "known")
    both = keyed.drop("embedding").join(known, ["h1", "h2"], "left")
    component = F.coalesce("label", "vec_id")
    return both.select("vec_id", F.coalesce(F.col("n") + F.col("copies") - 1, F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), (F.col("vec_id") == component).alias("kept"))
