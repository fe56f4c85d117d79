"""The pipeline's stages, each against a plain version on its own input."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm import brute
from tesserae.llm import common

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def outputs(spark):
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        after = common.stage(stage(spark, docs, SF), name)
        out.append((name, docs, after))
        docs = after
    return out


def texts(df):
    return {r["doc_id"]: r["text"] for r in df.select("doc_id", "text").collect()}


def test_columns(outputs):
    for _, before, after in outputs[:-1]:
        assert after.columns == before.columns
        assert after.where("n_chars != length(text)").isEmpty()


def test_quality_keeps_what_is_good(spark, outputs):
    _, before, after = outputs[0]
    kept = {r["doc_id"] for r in after.collect()}
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    assert sum(i in kept for i, q in labels.items() if q) >= 0.95 * sum(labels.values())
    assert sum(i in kept for i, q in labels.items() if not q) <= 3
    assert texts(after) == {i: t for i, t in texts(before).items() if i in kept}


def test_lines(outputs):
    _, before, after = outputs[1]
    want = brute.deduped_all_lines(list(texts(before).items()))
    old = texts(before)
    assert texts(after) == {i: t for i, t in want.items() if t == old[i] or brute.WORD.search(t)}


def test_near_copies(outputs):
    _, before, after = outputs[2]
    groups = brute.components(list(texts(before).items()))
    assert set(texts(after)) == {i for i, (_, c) in groups.items() if c == i}


def test_substrings(outputs):
    _, before, after = outputs[3]
    old = texts(before)
    want = {i: (old[i] if not gone else kept) for i, (n, gone, kept) in brute.word_windows(list(old.items())).items() if not gone or gone < n}
    assert texts(after) == want


def test_packing(outputs):
    _, before, after = outputs[4]
    rows = after.collect()
    assert {r["doc_id"] for r in rows} == set(texts(before))
    assert sum(r["length"] for r in rows) == sum({r["doc_id"]: r["doc_tokens"] for r in rows}.values())


def test_run(spark, outputs):
    assert corpus_pipeline.run(spark, SF).count() == outputs[-1][2].count()


def test_stages_on_odd_rows(spark):
    """Null keys and texts, empty and very long texts, repeated rows, clashing names, and no rows at all."""
    passage = " ".join(f"w{i}" for i in range(120))
    rows = [(1, passage, "en", "s", 5), (1, passage, "en", "s", 5), (2, "own words here\n" + passage, None, "s", None), (None, passage, "en", None, 1), (None, None, None, None, None), (3, None, "en", "s", 0), (4, "", "en", "s", 0), (5, "v " * 60_000, "en", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for name in ("key", "tag", "n", "units", "score", "gone", "spans"):
        docs = docs.withColumn(name, F.lit("clash"))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns and out.count() <= len(rows)
        assert stage(spark, docs.limit(0), SF).count() == 0
    kept = {(r["doc_id"], r["text"]) for r in corpus_pipeline.line_dedup(spark, docs, SF).collect()}
    assert (1, passage) in kept and (2, "own words here") in kept and (None, passage) in kept and (3, None) in kept
    assert {r["doc_id"] for r in corpus_pipeline.near_dedup(spark, docs, SF).collect()} == {1, 3, 4, 5, None}  # 2 is 0.97 like 1
    cut = {(r["doc_id"], r["text"]) for r in corpus_pipeline.substring_dedup(spark, docs, SF).collect()}
    assert (2, "own words here") in cut and (1, passage) in cut and (None, passage) in cut
    assert {r["doc_id"] for r in corpus_pipeline.pack(spark, docs, SF).collect()} == {1, 2, 3, 4, 5, None}
