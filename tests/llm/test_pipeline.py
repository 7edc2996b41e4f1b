"""The pipeline's stages against plain versions of what each must do."""

import hashlib
import tracemalloc
from collections import Counter

import pyarrow as pa
import pytest

import corpus_pipeline
from funnelscope.llm import pii, quality
from funnelscope.llm.store import written
from tests.llm.test_near_dup import brute_force

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def steps(spark, sf_dir):
    docs, out = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    out.append(docs)
    for name, stage in corpus_pipeline.STAGES:
        out.append(written(stage(spark, out[-1], sf_dir), f"test-{name}"))
    return out


def test_stages(spark, steps, sf_dir):
    documents, good, single, masked, mixed, encoded = steps
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_dedup", "personal_data", "mixing", "encode"]
    for df in steps[:-1]:
        assert df.columns == COLUMNS
        assert df.dtypes == documents.dtypes

    machine = quality.learned(documents, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scores = quality.score_texts(documents, machine).where("quality_score >= 0.3").collect()
    assert Counter(r["doc_id"] for r in scores) == Counter(r["doc_id"] for r in good.collect())

    rows = [(r["doc_id"], r["text"]) for r in good.collect()]
    roots = {i for i, (_, root) in brute_force(rows, 5, (80, 100)).items() if i == root}
    assert {r["doc_id"] for r in single.collect()} == roots and single.count() == len(roots)

    finder = pii.Finder()
    expected = {r["doc_id"]: r["text"] and pii.masked(r["text"], finder.spans(r["text"])) for r in single.collect()}
    assert {r["doc_id"]: r["text"] for r in masked.collect()} == expected
    assert all(r["n_chars"] == len(r["text"]) for r in masked.where("text is not null").collect())

    copies = Counter(r["doc_id"] for r in mixed.collect())
    assert set(copies) <= set(expected)
    texts = {r["doc_id"]: r["text"] for r in mixed.collect()}
    assert all(texts[i] == expected[i] for i in texts)
    assert Counter(r["doc_id"] for r in encoded.collect()) == copies
    for r in encoded.collect():
        text = texts[r["doc_id"]] or ""
        assert r["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()
        assert len(r["token_ids"]) == 4 * r["n_tokens"]


def test_encode_takes_one_worker_a_task(spark, steps, sf_dir, capsys):
    corpus_pipeline.encode(spark, steps[-2], sf_dir).explain()
    assert capsys.readouterr().out.count("ArrowEvalPython") == 1   # two in one plan are two Python workers for each core


def test_quality_takes_a_batch_in_parts():
    texts = [" ".join(f"w{(i * 7919 + j) % 100_003}" for j in range(700)) for i in range(1_000)]
    batch = pa.RecordBatch.from_arrays([pa.array([1] * len(texts)), pa.array(texts)], ["label", "text"])
    tracemalloc.start()
    try:
        rows = sum(part.num_rows for part in quality._features_of(iter([batch])))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert rows == len(texts)
    assert peak < 55e6   # 4 MB at once took 67 MB


def test_quality_stage_rejects_what_is_bad(spark, larger_dir):
    documents, labels = (spark.read.parquet(f"{larger_dir}/{t}.parquet") for t in ("documents", "labels"))
    good = written(corpus_pipeline.quality_filter(spark, documents, larger_dir), "test-quality")
    before, after = (dict(df.join(labels, "doc_id").groupBy("quality").count().collect()) for df in (documents, good))
    assert after[1] >= 0.97 * before[1] and after.get(0, 0) < 0.5 * before[0]


def test_odd_rows(spark, sf_dir):
    rows = [(None, "two words here", None, None, None), (None, "two words here", None, None, None), (1, None, "en", None, None),
            (2, "", None, "a", 0), (2, "same id", None, "a", 7), (3, " ", "", "", 1), (4, "x" * 300_000, "en", "a", 300_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int")
    once = corpus_pipeline.near_dedup(spark, docs, sf_dir)
    assert Counter(r["doc_id"] for r in once.collect()) == {None: 2, 1: 1, 2: 1, 3: 1, 4: 1}
    masked = corpus_pipeline.mask_personal_data(spark, once, sf_dir)
    assert masked.count() == 6
    encoded = corpus_pipeline.encode(spark, corpus_pipeline.mix_sources(spark, masked, sf_dir), sf_dir)
    assert encoded.columns == ["doc_id", "lang", "source", "token_ids", "n_tokens", "decoded_sha256"]
    encoded.collect()


def test_texts_that_share_an_id(spark, sf_dir):
    text = [" ".join(f"{t}{i}" for i in range(40)) for t in "abc"]
    rows = [(1, text[0]), (2, text[0]), (2, text[1]), (3, text[1]), (3, text[2]), (3, text[2]), (4, ""), (4, text[2]), (5, " "), (5, None)]
    docs = spark.createDataFrame([(i, t, "en", "a", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars int")
    once = [(r["doc_id"], (r["text"] or "").strip()) for r in corpus_pipeline.near_dedup(spark, docs, sf_dir).collect()]
    assert sorted(once) == [(1, text[0]), (2, text[1]), (3, text[2]), (4, ""), (5, "")]


def test_empty(spark, sf_dir):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars int")
    for _, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, sf_dir), "test-empty")
    assert docs.count() == 0


def test_clashing_names_and_maps(spark, sf_dir):
    """Columns named like the stages' own, and one that has no order, come through the first two stages as they are."""
    import corpus_pipeline
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    more = docs.selectExpr("*", "'q' as score", "'k' as key", "'r' as row", "'i' as id", "'b' as blank", "1 as component_id", "map('a', doc_id) as _quality")
    for stage in (corpus_pipeline.quality_filter, corpus_pipeline.near_dedup):
        plain, got = stage(spark, docs, sf_dir), stage(spark, more, sf_dir)
        assert got.columns == more.columns
        assert got.where("score = 'q' and key = 'k' and row = 'r' and id = 'i' and blank = 'b' and component_id = 1").count() == plain.count()
        assert sorted(r[0] for r in got.selectExpr("_quality['a']").collect()) == sorted(r[0] for r in plain.select("doc_id").collect())
