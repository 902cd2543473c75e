"""The pipeline's stages: what each keeps, whole and on odd tables."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from cellflux.llm.decontaminate import contamination
from cellflux.llm.jaccard_join import jaccard_components

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def test_stages_keep_the_columns_and_take_effect(spark, docs):
    sizes = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns, name
        out = spark.createDataFrame(out.collect(), docs.schema)
        sizes.append((docs.count(), out.count()))
        if name == "exact_dedup":
            texts = [t.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")) for (t,) in docs.select("text").collect()]
            assert out.count() == len(set(texts))
        if name == "near_dedup":
            least = jaccard_components(docs, 5, 4, 5).where("doc_id = component_id").count()
            assert out.count() == least
        if name == "decontamination":
            left = contamination(out, spark.read.parquet(f"{SF}/benchmark.parquet"))
            assert left.where(F.size("contamination.hits") > 0).count() == 0
        docs = out
    assert all(b <= a for a, b in sizes) and sizes[-1][1] < sizes[0][0]
    packed = corpus_pipeline.packing(spark, docs, SF)
    assert {r["doc_id"] for r in packed.select("doc_id").collect()} == {r["doc_id"] for r in docs.select("doc_id").collect()}


def test_run(spark, docs):
    out = corpus_pipeline.run(spark, SF)
    assert 0 < out.select("doc_id").distinct().count() <= docs.count()


@pytest.mark.parametrize("k", range(len(corpus_pipeline.STAGES)))
def test_stages_on_odd_tables(spark, k):
    name, stage = corpus_pipeline.STAGES[k]
    schema = "doc_id long, text string, lang string, source string, n_chars long, lang_pred string, score double, contamination string, digest string"
    odd = spark.createDataFrame(
        [(1, "the same of the text and", "en", None, 1, "x", 0.0, "c", "d"), (1, "the same of the text and", "en", None, 1, "x", 0.0, "c", "d"), (None, None, None, None, None, None, None, None, None),
         (None, "von der und die", "de", "s", 1, "x", 0.0, "c", "d"), (2, "", "de", "s", 1, "x", 0.0, "c", "d"), (3, "und das " * 40_000, "de", "s", 1, "x", 0.0, "c", "d")],
        schema,
    )
    for table in (odd, odd.where("false")):
        out = stage(spark, table, SF)
        rows = out.collect()
        assert len(rows) <= max(1, 10_000)
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == odd.columns
    if name == "exact_dedup":
        assert stage(spark, odd, SF).count() == 4
