"""The pipeline: what each stage drops and keeps, and that the entry point works without the package."""

import os

import pytest

import corpus_pipeline
from tests.llm import plain

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    before = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "near_dedup", "decontamination", "packing"]
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SF).write.parquet(str(tmp_path / name))
        out = spark.read.parquet(str(tmp_path / name))
        if name == "packing":
            assert {r["doc_id"] for r in out.collect()} == set(before)
            break
        assert out.columns == COLUMNS
        after = {r["doc_id"]: r["text"] for r in out.collect()}
        assert out.count() == len(after) and set(after) <= set(before)
        if name == "line_dedup":
            want = {d: (n - k) for d, n, k, _ in plain.line_dedup(list(before.items()))}
            assert set(after) == set(before) and all(r["n_chars"] == len(r["text"]) for r in out.collect())
            assert all(len(after[d].split("\n")) == max(1, want[d]) for d in after)
        else:
            assert all(after[d] == before[d] for d in after)
        if name == "decontamination":
            items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
            clean = {d for d, *_, bad in plain.contamination(list(before.items()), items) if not bad}
            assert set(after) == clean
        if name == "near_dedup":
            texts = list(after.values())
            assert len(set(texts)) == len(texts)
        docs, before = out, after


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_run(spark):
    assert corpus_pipeline.run(spark, SF).columns[:3] == ["doc_id", "start", "length"]


def test_stages_on_odd_and_empty_rows(spark, table, empty):
    labels = spark.createDataFrame([(0, 1), (1, 0)], "doc_id long, toxic int")
    labels.write.mode("overwrite").parquet(f"{_folder(spark)}/labels.parquet")
    spark.createDataFrame([(1, "a b c")], "item_id long, text string").write.mode("overwrite").parquet(f"{_folder(spark)}/benchmark.parquet")
    for docs in (table.select("doc_id", "text", "lang", "source", "n_chars"), empty):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, _folder(spark))
            assert name == "packing" or out.columns == docs.columns
            out.count()


def _folder(spark):
    from tarnish.session import staging_dir

    return f"{staging_dir(spark)}/odd-rows"
