import brute
import corpus_pipeline
import numpy as np
import pytest

from vecstrata.llm import bpe, quality
from vecstrata.llm.shared import cut


@pytest.fixture(scope="module")
def stages(spark, sf):
    docs, out = spark.read.parquet(f"{sf}/documents.parquet"), []
    for name, f in corpus_pipeline.STAGES:
        new = cut(f(spark, docs, sf), name)
        out.append((name, docs, new))
        docs = new
    return out


def test_columns(stages, spark, sf):
    want = spark.read.parquet(f"{sf}/documents.parquet").dtypes
    assert all(new.dtypes == want for _, _, new in stages[:-1])
    assert {"doc_id", "n_tokens", "ids_sha256"} <= set(stages[-1][2].columns)


def test_near_duplicates_keep_one(stages):
    _, old, new = stages[1]
    groups = brute.near_groups(sorted((r["doc_id"], r["text"]) for r in old.collect()))
    assert sorted(r["doc_id"] for r in new.collect()) == sorted({g for _, _, g in groups})


def test_decontamination_removes_what_holds_a_window(stages, spark, sf):
    _, old, new = stages[2]
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    want = [r[0] for r in brute.decontaminated(sorted((r["doc_id"], r["text"]) for r in old.collect()), items) if not r[5] and r[2] < 13]
    assert sorted(r["doc_id"] for r in new.collect()) == want


def test_no_secret_stays(stages):
    _, old, new = stages[3]
    assert all(brute.base_spans(r["text"]) == "" for r in new.collect()) and old.count() == new.count()


def test_run_equals_stages(stages, spark, sf):
    assert sorted(map(tuple, corpus_pipeline.run(spark, sf).collect())) == sorted(map(tuple, stages[-1][2].collect()))


def test_quality_stage_follows_the_classifier(stages, spark, sf):
    """Kept are exactly the rows that the network, run on each text alone, gives a half or more."""
    _, old, new = stages[0]
    tables = [spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels")]
    net = quality.train(*tables, quality.fold() != 1)
    want = []
    for r in old.collect():
        raw = (r["text"] or "").encode()
        if net.scores(np.frombuffer(raw, np.uint8), np.array([0, len(raw)], np.int64))[0] >= 0.5:
            want.append(r["doc_id"])
    assert sorted(r["doc_id"] for r in new.collect()) == sorted(want)


def test_bpe_stage_against_the_library(stages):
    library = pytest.importorskip("tokenizers").Tokenizer.from_file(bpe.default_path())
    _, old, new = stages[4]
    ids = {r["doc_id"]: library.encode(r["text"] or "", add_special_tokens=False).ids for r in old.collect()}
    assert {r["doc_id"]: (r["n_tokens"], r["ids_sha256"]) for r in new.collect()} == {i: (len(x), brute.sha(np.array(x, "<u4").tobytes())) for i, x in ids.items()}


ODD = "doc_id long, text string, lang string, source string, n_chars long, `a.b` int, _score int, _text int, _n int, _k1 int, base int, spans int, row int, component_id int"


def odd_table(spark, texts):
    return spark.createDataFrame([(i, t, None, "s", None, *[k + 100 * j for j in range(9)]) for k, (i, t) in enumerate(texts)], ODD).repartition(3)


def test_odd_rows_pass_every_stage(spark, sf):
    """Nulls, empty and very long texts, ties, repeated rows, ids given twice, and columns with the names used inside."""
    item = spark.read.parquet(f"{sf}/benchmark.parquet").where("text is not null").first()["text"]
    copy = "one two three four five six seven eight nine ten eleven"
    long = " ".join(f"w{i % 997}x{i}" for i in range(30_000))
    texts = [(1, copy), (2, copy), (2, copy), (3, None), (3, None), (4, ""), (None, copy), (None, f"a b {item} c"), (7, f"filler {long} {item}"), (8, long), (9, "another text under nine"), (9, copy), (10, "x password=abcdefghijklmnop y")]
    docs = odd_table(spark, texts)
    held = lambda df: sorted(((r["doc_id"], r["text"]) for r in df.collect()), key=str)

    def passed(stage):
        out = stage(spark, docs, sf)
        assert out.dtypes == docs.dtypes
        # the other columns stay with their rows
        assert all(r["_score"] == r["a.b"] + 100 and r["component_id"] == r["a.b"] + 800 for r in out.collect())
        return out

    assert set(held(passed(corpus_pipeline.keep_quality))) <= set(texts)
    assert held(passed(corpus_pipeline.drop_copies)) == sorted([(1, copy), (3, None), (4, ""), (None, copy), (None, f"a b {item} c"), (7, f"filler {long} {item}"), (9, "another text under nine"), (9, copy), (10, texts[-1][1])], key=str)
    assert held(passed(corpus_pipeline.drop_contaminated)) == sorted([x for x in texts if item not in (x[1] or "")], key=str)
    redacted = passed(corpus_pipeline.redact_secrets)
    assert held(redacted) == sorted([(i, "x [SECRET] y" if i == 10 else t) for i, t in texts], key=str)
    assert {r["n_chars"] for r in redacted.where("text is null").collect()} == {None}
    assert corpus_pipeline.tokenize(spark, docs, sf).count() == len(texts)


def test_empty_tables_pass_every_stage(spark, sf):
    docs = odd_table(spark, [(1, "a")]).limit(0)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf)
        assert out.count() == 0 and (name == "bpe" or out.dtypes == docs.dtypes)


def test_a_benchmark_passage_in_a_long_text_is_caught(spark, sf):
    """13 words of an item inside 5,000 others: far below 5 %, and removed."""
    item = next(r["text"].split() for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect() if r["text"] and len(r["text"].split()) >= 20)
    filler = [f"filler{i}" for i in range(5000)]
    docs = odd_table(spark, [(1, " ".join(filler[:2000] + item[3:18] + filler[2000:])), (2, " ".join(filler))])
    assert [r["doc_id"] for r in corpus_pipeline.drop_contaminated(spark, docs, sf).collect()] == [2]
