"""The points table: ``vec_id, embedding, level, q_min, q_delta, q_codes``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import dequantize, draw_level, is_finite, l2, quantize
from ..params import IndexParams
from ..storage import cut, quoted, unused

PAGE_ROWS = 32


def invalid_rows(vectors: DataFrame, width: int | None = None) -> DataFrame:
    """Rows that an index refuses: no vector, non-finite components or another width than ``width``."""
    bad = ~is_finite(F.col("embedding"))
    if width is not None:
        bad = bad | (F.size("embedding") != width)
    return vectors.where(F.coalesce(bad, F.lit(True)))


def check_vectors(vectors: DataFrame, width: int | None = None) -> tuple[int, int | None]:
    """Rows and their width, in one pass.  Raises ``ValueError`` when a row has to be refused: no vector,
    non-finite components, or another width than ``width`` (by default, than the other rows)."""
    size, bad = F.size("embedding"), F.coalesce(~is_finite(F.col("embedding")), F.lit(True))
    if width is not None:
        bad = bad | (size != width)
    rows, refused, low, high = vectors.agg(F.count("*"), F.min(F.when(bad, F.struct("vec_id"))), F.min(size), F.max(size)).first()
    if refused is not None:
        raise ValueError(f"vector {refused[0]} is null, has non-finite components or is not of the index's dimension")
    if low != high:
        raise ValueError(f"vectors have from {low} to {high} components")
    return rows, low


def widths(vectors: DataFrame) -> DataFrame:
    size = F.size("embedding").cast("long")
    return vectors.agg(F.min(size).alias("min_dim"), F.max(size).alias("max_dim"), F.count("*").alias("n"))


def make_points(vectors: DataFrame, params: IndexParams) -> DataFrame:
    """Quantize every vector and draw its level; a narrow projection."""
    return vectors.select("vec_id", "embedding", draw_level(F.col("vec_id"), params.m).alias("level"), quantize(F.col("embedding")).alias("q")).select(
        "vec_id", "embedding", "level", "q.*"
    )


def decoded(points: DataFrame) -> DataFrame:
    """``vec_id, v``: the quantized vectors as doubles."""
    return points.select("vec_id", dequantize(F.col("q_min"), F.col("q_delta"), F.col("q_codes")).alias("v"))


def append(points: DataFrame, vectors: DataFrame) -> DataFrame:
    """``vectors`` (any ids) get the ids after the largest one present, in order of their own ``vec_id``.

    Ranks come from counts of ranges, not from one global window; see ``gapless``.
    """
    numbered = gapless(vectors, "vec_id", "rank")
    top = points.agg(F.coalesce(F.max("vec_id"), F.lit(-1)).alias("top"))
    return points.select("vec_id", "embedding").unionByName(
        numbered.crossJoin(F.broadcast(top)).select((F.col("top") + 1 + F.col("rank")).alias("vec_id"), "embedding")
    )


def gapless(df: DataFrame, key: str, name: str, groups: tuple[str, ...] = ()) -> DataFrame:
    """Add ``name``: 0-based ranks by ``key`` (NULL first) within ``groups``, for keys of any type and spread.

    Rows are dealt by ranges of group and key, which sampling makes even, sorted inside a range and written
    with their places; counts of the ranges, one row for each, move them to their ranks.  Rows with equal keys
    are ordered by a hash, so that a key with many rows can be split.  A column called ``name`` is replaced,
    all others pass.
    """
    df = df.drop(name)
    place, part, moved, start = (unused(df, x) for x in ("_place", "_range", "_moved", "_start"))
    flat = [quoted(c) for c, t in df.dtypes if "map<" not in t and "variant" not in t]
    order = [*[quoted(g) for g in groups], quoted(key), F.xxhash64(*flat)]
    dealt = cut(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(place, F.monotonically_increasing_id()), "ranges")
    number = F.shiftright(quoted(place), 33)
    counts = dealt.groupBy(number.alias(part)).agg(F.count("*").alias("n"))
    before = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)  # one row for each range
    offsets = counts.select(part, F.coalesce(F.sum("n").over(before), F.lit(0)).alias(moved))
    rank = F.col(moved) + quoted(place).bitwiseAND((1 << 33) - 1)
    ranked = dealt.withColumn(part, number).join(F.broadcast(offsets), part).withColumn(name, rank).drop(place, part, moved)
    if groups:
        first = ranked.groupBy(*[quoted(g) for g in groups]).agg(F.min(quoted(name)).alias(start))
        named = {g: unused(ranked, f"_{i}") for i, g in enumerate(groups)}
        first = first.select(start, *[quoted(g).alias(n) for g, n in named.items()])
        same = [quoted(g).eqNullSafe(quoted(n)) for g, n in named.items()]
        ranked = ranked.join(first, same).withColumn(name, quoted(name) - quoted(start)).drop(start, *named.values())
    return ranked


def lookup(points: DataFrame, vec_id: int) -> DataFrame:
    return points.where(F.col("vec_id") == F.lit(vec_id))


def lookup_many(points: DataFrame, ids: DataFrame, check: bool = False) -> DataFrame:
    """The points with these ids; with ``check`` an unknown id raises ``ValueError``."""
    asked = ids.select("vec_id").distinct()
    if check and (first := asked.join(points.select("vec_id"), "vec_id", "left_anti").head(1)):
        raise ValueError(f"no point has the id {first[0][0]}")
    return points.join(asked, "vec_id", "left_semi")


def distances(points: DataFrame, pairs: DataFrame, vector: str = "embedding") -> DataFrame:
    """``a, b, dist`` for stored id pairs; pairs with an unknown id have no row."""
    left = points.select(F.col("vec_id").alias("a"), F.col(vector).alias("va"))
    right = points.select(F.col("vec_id").alias("b"), F.col(vector).alias("vb"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", l2(F.col("va"), F.col("vb")).alias("dist"))


def page_stats(points: DataFrame, rows: int = PAGE_ROWS) -> DataFrame:
    """Fill of fixed-size pages: page id, rows and whether the page is full."""
    page = F.expr(f"vec_id div {rows}").alias("page")
    return points.groupBy(page).agg(F.count("*").alias("n"), F.min("vec_id").alias("first_id"), (F.count("*") >= rows).alias("is_full"))


def split_ranges(key: Column, n: Column, parts: int) -> Column:
    """Contiguous equal ranges of 0..n-1; what is left over goes to the last."""
    return F.least(F.floor(key / F.greatest(F.lit(1), F.floor(n / F.lit(parts)))), F.lit(parts - 1)).cast("long")
