"""Literal vectors, graph invariants, recall, persistence, streams: the engine beside its SQL oracle."""

import math
import time

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from oracle import differences
from vecstrata.cli import parser
from vecstrata.functions import dequantize, is_finite, l2, quantize
from vecstrata.operators import build, evaluate, graph, knn, points, search
from vecstrata.params import IndexParams
from vecstrata.plans import choose, queries
from vecstrata.sources import store, text, truth
from vecstrata.streaming import ingest

SF = "/root/testdata/sf0.001"
PARAMS = IndexParams(m=12)


def rows(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.fixture(scope="module")
def vectors(spark):
    return spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding").cache()


@pytest.fixture(scope="module")
def index(vectors):
    i = build.build(vectors, PARAMS)
    return build.Index(i.points.cache(), i.edges.cache(), i.params, i.shards)


LITERALS = [([0.5], [0.25], 0.25), ([0.75], [0.25], 0.5), ([0.0, 0.0], [0.0, 1.0], 1.0), ([1.0, 0.0], [0.0, 1.0], math.sqrt(2)), ([-1.0, 0.0], [0.0, 1.0], math.sqrt(2)), ([1.0, 0.0], [0.0, -1.0], math.sqrt(2)), ([0.3, 0.4], [0.3, 0.4], 0.0)]


def test_literal_distances(spark):
    df = spark.createDataFrame(LITERALS, "a array<float>, b array<float>, want double")
    q = lambda c: dequantize(F.col(c)["q_min"], F.col(c)["q_delta"], F.col(c)["q_codes"])
    both = df.withColumns({"qa": quantize(F.col("a")), "qb": quantize(F.col("b"))}).select(l2(F.col("a"), F.col("b")).alias("d"), l2(q("qa"), q("qb")).alias("dq"), "want")
    for r in both.collect():
        assert r["d"] == pytest.approx(r["want"], abs=1e-7) and r["dq"] == pytest.approx(r["want"], abs=1e-6)


def test_constant_vector_decodes_exactly(spark):
    df = spark.createDataFrame([([0.25] * 5,)], "v array<float>").select(quantize(F.col("v")).alias("q"))
    r = df.select("q.q_delta", dequantize(F.col("q.q_min"), F.col("q.q_delta"), F.col("q.q_codes")).alias("v")).first()
    assert r["q_delta"] == 0 and r["v"] == [0.25] * 5


def test_a_vector_is_coded_once_for_a_row(spark):
    """Of wide vectors too, where a filter reads the decoded vector: work grows with the width, not with its square."""
    df = spark.range(400).select(F.col("id").alias("vec_id"), F.transform(F.sequence(F.lit(0), F.lit(1999)), lambda i: F.hash(F.lit(1), i).cast("float")).alias("embedding")).localCheckpoint()
    p = points.decoded(points.make_points(df, PARAMS))
    began = time.perf_counter()
    assert p.where(is_finite(F.col("v"))).count() == 400
    assert time.perf_counter() - began < 20


def test_quantization_error_below_one_percent(spark):
    from vecstrata.functions import random_vector

    df = points.make_points(spark.range(200).select(F.col("id").alias("vec_id"), random_vector(F.col("id"), 128).alias("embedding")), PARAMS)
    assert evaluate.quantization_error(df, df.where("vec_id < 20").select(F.col("vec_id").alias("qid"))).first()["max_error"] < 0.01


def test_quantization_error_against_brute_force(spark, monkeypatch):
    """Equal, near and odd rows, two widths, several blocks of queries; no distance is taken by the plan's own functions."""
    monkeypatch.setattr(knn, "QUERY_BLOCK", 7)
    rng = np.random.default_rng(8)
    x = rng.normal(size=(90, 16)).astype(np.float32)
    x[30:40], x[40:50] = x[:10], x[:10] + np.float32(1e-6)
    data = [(i, v.tolist()) for i, v in enumerate(x)] + [(100, None), (102, [1.0, None]), (104, [1.0, 2.0, 3.0]), (105, [1.0, 2.5, 3.0]), (106, [])]
    p = points.make_points(spark.createDataFrame(data, "vec_id long, embedding array<float>"), PARAMS).localCheckpoint()
    back = dequantize(F.col("q_min"), F.col("q_delta"), F.col("q_codes"))
    a = p.where("vec_id % 2 = 0").select(F.col("vec_id").alias("a"), F.col("embedding").alias("fa"), back.alias("qa"))
    b = p.select(F.col("vec_id").alias("b"), F.col("embedding").alias("fb"), back.alias("qb"))
    d = a.join(b, F.col("a") != F.col("b")).select(l2(F.col("fa"), F.col("fb")).alias("f"), l2(F.col("qa"), F.col("qb")).alias("q")).where("f > 0")
    want = d.agg(F.count("*"), F.max(F.abs(F.col("f") - F.col("q")) / F.col("f"))).first()
    monkeypatch.setattr(evaluate, "l2", None, raising=False)
    queries = p.where("vec_id % 2 = 0").select(F.col("vec_id").alias("qid"))
    assert tuple(evaluate.quantization_error(p, queries).first()) == tuple(want)
    assert tuple(evaluate.quantization_error(p, queries.limit(0)).first()) == (0, None)


def test_params():
    p = IndexParams(m=12)
    assert (p.ef_cons, p.mmax, p.mmax0) == (24, 12, 24) and p.ml == pytest.approx(1 / math.log(12))
    with pytest.raises(ValueError):
        IndexParams(m=1)


def test_bad_vectors_are_refused(spark, vectors):
    bad = spark.createDataFrame([(0, None), (1, [math.nan, 1.0]), (2, []), (3, [1.0]), (4, [1.0, 2.0]), (5, [1.0, None])], "vec_id long, embedding array<float>")
    assert [r[0] for r in rows(points.invalid_rows(bad, 2).select("vec_id"))] == [0, 1, 2, 3, 5]
    with pytest.raises(ValueError):
        build.build(vectors, IndexParams(dim=63))
    with pytest.raises(ValueError):
        build.insert(build.build(vectors, IndexParams(dim=64)), bad, 1)


def test_invariants(index):
    e = index.edges
    assert e.where("src = dst").count() == 0
    assert e.join(e.select("layer", F.col("src").alias("dst"), F.col("dst").alias("src")), ["layer", "src", "dst"], "left_anti").count() == 0
    degrees = evaluate.layer_degrees(index)
    assert evaluate.violations(degrees, PARAMS).count() <= 1  # nearest-predecessor links may exceed the cap
    top = index.points.agg(F.max("level")).first()[0]
    ep = build.entry_point(index.points).first()
    assert ep["top"] == top and index.points.where(F.col("vec_id") == ep["ep"]).first()["level"] == top
    for layer in range(top + 1):
        nodes = {r[0] for r in rows(build.membership(index.points).where(F.col("layer") == layer).select("node"))}
        near = {n: set() for n in nodes}
        for a, b in rows(e.where(F.col("layer") == layer).select("src", "dst")):
            near[a].add(b)
        seen, todo = set(), [next(iter(nodes))]
        while todo:
            n = todo.pop()
            if n not in seen:
                seen.add(n)
                todo += near[n] - seen
        assert seen == nodes


def test_one_entry_point_for_all_shards(spark, vectors, tmp_path, monkeypatch):
    """Three copies of the table in shards of 500 rows, against SQL."""
    vectors.crossJoin(spark.range(3)).select((F.col("vec_id") + 500 * F.col("id")).alias("vec_id"), "embedding").write.parquet(str(tmp_path / "embeddings.parquet"))
    monkeypatch.setattr(queries, "PARAMS", IndexParams(m=12, shard_rows=500))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{tmp_path}/embeddings.parquet/*.parquet')")
    assert queries.index(spark, str(tmp_path)).shards == 3
    assert differences(queries.entry_point(spark, str(tmp_path)), con, queries.ORACLE["entry_point"]) == ""


def test_partitioning_does_not_matter(vectors, index):
    for n in (1, 4):
        assert rows(build.build(vectors.repartition(n), PARAMS).edges) == rows(index.edges)


def test_recall(vectors, index):
    q = vectors.where("vec_id % 20 = 0").select(F.col("vec_id").alias("qid"), "embedding")
    p = points.decoded(index.points)
    t = knn.exact(p, p.where("vec_id % 20 = 0").select(F.col("vec_id").alias("qid"), F.col("v").alias("embedding")), 10, "v")
    assert evaluate.recall(t, search.ann(index, q, 10, 100)).first()["recall"] >= 0.99


def test_shards_cover_all_points(vectors):
    i = build.build(vectors, IndexParams(m=12, shard_rows=150))
    assert i.shards == 4
    q = vectors.where("vec_id % 20 = 0").select(F.col("vec_id").alias("qid"), "embedding")
    found, t = search.ann(i, q, 10, 100), knn.exact(vectors, q, 10)
    assert evaluate.recall(t, found).first()["recall"] >= 0.95


def test_every_point_is_found_after_a_second_batch(vectors):
    i = build.insert(build.build(vectors.where("vec_id < 250"), PARAMS), vectors.where("vec_id >= 250"), 1)
    q = vectors.select(F.col("vec_id").alias("qid"), "embedding")
    assert search.ann(i, q, 1, 50).where("nid = qid").count() >= 0.99 * vectors.count()
    assert search.ann(i, q.where("qid < 250"), 1, 50).where("nid = qid").count() >= 0.99 * 250


def test_a_higher_newcomer_is_linked_downward(spark, vectors):
    """The newcomer becomes the entry point; what was there stays reachable."""
    low = points.make_points(vectors, PARAMS).where("level = 0").select("vec_id", "embedding")
    high = points.make_points(vectors, PARAMS).where("level >= 1").select("vec_id", "embedding")
    i = build.insert(build.build(low, PARAMS), high, 1)
    q = low.select(F.col("vec_id").alias("qid"), "embedding")
    assert search.ann(i, q, 1, 50).where("nid = qid").count() >= 0.99 * low.count()


def test_small_ef_is_refused(vectors, index):
    with pytest.raises(ValueError):
        search.ann(index, vectors.select(F.col("vec_id").alias("qid"), "embedding"), 10, 5)


def test_a_beam_as_wide_as_the_layer():
    """Nodes in two parts, ties and repeated queries: the same rows as the beam, which is not run."""
    rng = np.random.default_rng(4)
    x = rng.integers(0, 3, (60, 4)).astype(float)
    ids, q = rng.permutation(1000)[:60], np.concatenate([x[:5], x[:5]])
    links = [[y for y in (i - 1, i + 1) if 0 <= y < 60 and (y < 40) == (i < 40)] for i in range(60)]
    entry = lambda v: [(0.0, int(ids[0]), 0)] if v.sum() < 4 else [(0.0, int(ids[50]), 50)]
    qids, want = np.arange(10) // 2, []
    for i, v in zip(qids, q, strict=True):
        start = entry(v)[0][2]
        full = search.beam(x, links, v, [(float(np.sqrt(((x[start] - v) ** 2).sum())), int(ids[start]), start)], ids, 60)
        want += [(i, n, d) for d, n, _ in full[:7]]
    assert {entry(v)[0][2] for v in q} == {0, 50}
    assert sorted(search.walked(x, ids, links, qids, q, entry, 7).itertuples(index=False, name=None)) == sorted(want)


def test_a_wide_beam_is_walked_once(vectors, monkeypatch):
    p = build.make_points(vectors, PARAMS).toPandas().assign(batch=0)
    near = [[i - 1, i + 1] for i in range(len(p))]
    p["adjacency"] = [[{"layer": 0, "near": [int(p["vec_id"][y]) for y in n if 0 <= y < len(p)]}] for n in near]
    q = p[["vec_id", "embedding"]].rename(columns={"vec_id": "qid"}).head(20)
    monkeypatch.setattr(search, "beam", None)
    assert len(search.search_shard(p, q, 10, len(p))) == 200


def test_choice_of_plan(vectors, index):
    q = vectors.where("vec_id = 3").select(F.col("vec_id").alias("qid"), "embedding")
    assert rows(choose.nearest(index, q, 5, exact=True)) == rows(knn.exact(index.points, q, 5))
    assert rows(choose.nearest(index, q, 5, exact=False)) == rows(search.ann(index, q, 5, 100))


def test_exact_skips_what_is_no_vector(spark):
    df = spark.createDataFrame([(0, [0.0, 1.0]), (1, [0.0, 1.0]), (2, None), (3, [math.nan, 0.0])], "vec_id long, embedding array<float>")
    q = df.select(F.col("vec_id").alias("qid"), "embedding")
    assert rows(knn.exact(df, q, 2)) == [(0, 0, 0.0, 1), (0, 1, 0.0, 2), (1, 0, 0.0, 1), (1, 1, 0.0, 2)]
    assert rows(knn.exact(df, q, 2, keep_self=False)) == [(0, 1, 0.0, 1), (1, 0, 0.0, 1)]
    assert rows(knn.exact(df.limit(0), q, 2)) == []


def test_ties_go_by_id(spark):
    df = spark.createDataFrame([(0, 0.5), (1, 0.5), (2, 0.0), (4, 0.0)], "nid long, dist double").withColumn("qid", F.lit(0))
    assert [r["nid"] for r in knn.top_k(df, 4).orderBy("rank").collect()] == [2, 4, 0, 1]


def test_exact_far_from_the_origin(spark):
    """Points that differ by little at a billion: rough distances cancel, exact ones decide."""
    rng = np.random.default_rng(6)
    x = 1e9 + rng.normal(size=(9000, 8)) * 100
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").coalesce(1)
    q = df.where("vec_id % 1000 = 0").select(F.col("vec_id").alias("qid"), "embedding")
    want = []
    for i in range(0, 9000, 1000):
        dist = np.sqrt(((x - x[i]) ** 2).cumsum(axis=1)[:, -1])
        want += [(i, int(j)) for j in np.lexsort((np.arange(9000), dist))[:5]]
    assert sorted((r["qid"], r["nid"]) for r in knn.exact(df, q, 5).collect()) == sorted(want)


def test_graph_errors(spark):
    nodes, edges = graph.simple_graph(spark)
    with pytest.raises(ValueError):
        graph.add_edges(nodes, edges, spark.createDataFrame([(1, 1)], "src long, dst long"))
    with pytest.raises(ValueError):
        graph.add_edges(nodes, edges, spark.createDataFrame([(1, 9)], "src long, dst long"))


def test_gapless_ids(spark):
    """Keys at both ends of a long, ties, NULL, and columns with the names used inside."""
    keys = [-(2**63), 5, 5, 5, None, 2**63 - 1, 2**62, 0, -3]
    df = spark.createDataFrame([(k, i, i % 2, "x", "y", "z") for i, k in enumerate(keys)], "k long, i int, g int, _place string, _range string, _lo string").repartition(3)
    got = points.gapless(df, "k", "r").collect()
    assert sorted(r["r"] for r in got) == list(range(9)) and {"_place", "_range", "_lo"} <= set(got[0].asDict())
    assert [r["k"] for r in sorted(got, key=lambda r: r["r"])] == sorted(keys, key=lambda k: -(2**64) if k is None else k)
    for g in (0, 1):
        own = sorted(points.gapless(df, "k", "r", ("g",)).where(f"g = {g}").collect(), key=lambda r: r["r"])
        assert [r["r"] for r in own] == list(range(len(own)))
        assert [r["k"] for r in own] == sorted((k for i, k in enumerate(keys) if i % 2 == g), key=lambda k: -(2**64) if k is None else k)
    assert points.gapless(df.limit(0), "k", "r").count() == 0


def test_every_insert_is_checked(spark, vectors):
    """Default parameters: NULL, NaN, empty and other widths are refused when an index is built or extended."""
    kind = "vec_id long, embedding array<float>"
    good = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(5)], kind)
    built = build.build(good, PARAMS)
    assert built.params.dim == 2
    for odd in (None, [math.nan, 1.0], [], [1.0, 2.0, 3.0], [1.0, None]):
        bad = spark.createDataFrame([(9, odd)], kind)
        with pytest.raises(ValueError):
            build.build(good.unionByName(bad), PARAMS)
        with pytest.raises(ValueError):
            build.insert(built, bad, 1)


def test_missing_ids_are_refused_on_demand(spark, vectors):
    ids = spark.createDataFrame([(3,), (10**6,)], "vec_id long")
    assert points.lookup_many(vectors, ids).count() == 1
    with pytest.raises(ValueError):
        points.lookup_many(vectors, ids, check=True)
    nodes, edges = graph.simple_graph(spark)
    with pytest.raises(ValueError):
        graph.remove_edges(edges, spark.createDataFrame([(0, 77)], "src long, dst long"), nodes)


def test_layers(index):
    assert build.layer_count(index) == index.points.agg(F.max("level")).first()[0] + 1
    assert build.layer(index, 0).count() + build.layer(index, 1).count() <= index.edges.count()


def test_page_capacity(spark):
    stats = rows(points.page_stats(spark.range(70).select(F.col("id").alias("vec_id"))))
    assert stats == [(0, 32, 0, True), (1, 32, 32, True), (2, 6, 64, False)]


def test_text_source(spark, tmp_path):
    (tmp_path / "v.txt").write_text("the 0.5 -1e-3 2\nnew york 1 2 3\n")
    df = text.read(spark, str(tmp_path / "v.txt"))
    assert rows(df.select("vec_id", "word")) == [(0, "the"), (1, "newyork")]
    text.check_width(df)
    assert text.read(spark, str(tmp_path / "v.txt"), 1).count() == 1
    (tmp_path / "w.txt").write_text("a 1 2\nb 1\n")
    with pytest.raises(ValueError):
        text.check_width(text.read(spark, str(tmp_path / "w.txt")))


def test_truth_source(spark, tmp_path):
    (tmp_path / "t.json").write_text('{"3": [1, 2], "4": [9]}')
    assert rows(truth.read(spark, str(tmp_path / "t.json"))) == [(3, 1, 1), (3, 2, 2), (4, 1, 9)]
    (tmp_path / "ids.json").write_text("[5, 6]")
    assert rows(truth.read_ids(spark, str(tmp_path / "ids.json"))) == [(5,), (6,)]


def test_store(spark, index, tmp_path):
    path = str(tmp_path / "index")
    store.save(index, path)
    back = store.load(spark, path)
    assert rows(back.edges) == rows(index.edges) and back.params == index.params
    with pytest.raises(Exception, match="already exists"):
        store.save(index, path)
    plan = store.lookup(spark, path, 7)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(vec_id), EqualTo(vec_id,7)]" in plan


def test_store_refuses_a_gap_in_the_layers(spark, index, tmp_path):
    path = str(tmp_path / "gap")
    store.save(build.Index(index.points, index.edges.where("layer <> 0"), index.params, index.shards), path)
    with pytest.raises(ValueError):
        store.load(spark, path)


def test_stream(spark, vectors, tmp_path):
    source, root = tmp_path / "in", str(tmp_path / "root")
    for lo in (0, 250):
        vectors.where(F.col("vec_id").between(lo, lo + 249)).coalesce(1).write.mode("append").parquet(str(source))
    stream = spark.readStream.schema(vectors.schema).option("maxFilesPerTrigger", 1).parquet(str(source))
    ingest.start(stream, root, str(tmp_path / "check"), PARAMS).awaitTermination()
    last = store.load(spark, ingest.version_path(root, 1))
    assert last.points.count() == vectors.count() and last.points.agg(F.max("batch")).first()[0] == 1
    assert ingest.upsert(spark, root, vectors, 1, PARAMS) == ingest.version_path(root, 1)
    q = vectors.select(F.col("vec_id").alias("qid"), "embedding")
    assert search.ann(last, q, 1, 50).where("nid = qid").count() >= 0.99 * vectors.count()


def test_command_line():
    args = parser().parse_args(["search", "path", "--ids", "1", "2", "--k", "3"])
    assert (args.command, args.ids, args.k, args.ef) == ("search", [1, 2], 3, 100)


def test_diverse_selection_by_brute_force():
    rng = np.random.default_rng(4)
    for _ in range(20):
        x, q = rng.normal(size=(24, 8)), rng.normal(size=8)
        d = np.sqrt(((x - q) ** 2).sum(axis=1))
        order = np.argsort(d)
        x, d = x[order], d[order]
        kept = []
        for i in range(24):
            if len(kept) < 5 and all(d[i] < np.linalg.norm(x[i] - x[j]) for j in kept):
                kept.append(i)
        assert build.diverse(d, x, 5, refill=False).tolist() == kept
        full = build.diverse(d, x, 5)
        assert len(full) == 5 and set(kept) <= set(full.tolist())


def test_ties_at_the_cut_go_by_id():
    """Far more equal rows than k: the smallest ids win, as in the SQL."""
    rng = np.random.default_rng(6)
    x = rng.normal(size=(1500, 8))
    ids = rng.permutation(1500)
    same = rng.choice(1500, 500, replace=False)
    x[same] = x[same[0]]
    q = x[same[0]][None, :] + 0.01
    want = sorted(ids[same].tolist())[:10]
    _, got, _ = knn.nearest_in_batch(ids, x, np.array([-1]), q, 10, True)
    assert got.tolist() == want
    own = np.array([want[0]])
    _, got, _ = knn.nearest_in_batch(ids, x, own, q, 10, False)
    assert got.tolist() == sorted(ids[same].tolist())[1:11]
    x[-1] = q[0]
    before = [i for i in same.tolist() if i < 1499]
    (_, near, _), = build.nearest_before(x, ids, 1499, 10)
    assert ids[near].tolist() == sorted(ids[before].tolist())[:10]
