"""Empty tables, through every operator and every stage of the pipeline."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from vulnlake.llm import bm25, decontaminate, jaccard_join, langid, line_dedup, lm_score, packing, quality, toxicity, url_filter
from vulnlake.llm.common import sample_per_class

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long, held_out boolean")


def test_operators_on_empty_tables(spark, none):
    no_labels = spark.createDataFrame([], "doc_id long, label int")
    items = spark.createDataFrame([], "item_id long, text string")
    assert line_dedup.line_dedup(none).count() == 0
    urls = spark.createDataFrame([], "page_id long, url string")
    assert url_filter.url_filter(urls, url_filter.labelled_urls(spark), [("net/", "block")]).count() == 0
    assert toxicity.toxicity(none, toxicity.fit(none, no_labels)).count() == 0
    assert quality.quality(none, quality.fit(none, no_labels)).count() == 0
    assert langid.identify(none, langid.fit(none)).count() == 0
    assert decontaminate.find(none, items).count() == 0 and decontaminate.remove(none, items).count() == 0
    assert jaccard_join.jaccard_join(none).count() == 0
    assert packing.pack(none).count() == 0
    assert lm_score.score(none, lm_score.fit(none)).count() == 0
    assert bm25.search(bm25.build(none), items.withColumnRenamed("item_id", "query_id")).count() == 0


@pytest.mark.parametrize("stage", [name for name, _ in corpus_pipeline.STAGES])
def test_stages_on_empty_tables(spark, none, stage):
    docs = none.drop("held_out")
    out = dict(corpus_pipeline.STAGES)[stage](spark, docs, SF)
    assert out.count() == 0
    assert stage == "packing" or out.columns == docs.columns


def test_sample_per_class_is_that_of_one_ranking(spark):
    rows = spark.range(5000).select(F.col("id").alias("doc_id"), (F.col("id") % 10 > 0).cast("int").alias("label"))
    rows = rows.unionByName(rows.where("doc_id < 50").withColumn("label", F.lit(1))).unionByName(spark.createDataFrame([(None, 1), (7000, None)], "doc_id long, label int"))
    got = {(r.doc_id, r.label) for r in sample_per_class(rows, 30).collect()}
    best = rows.where("doc_id is not null and label is not null").groupBy("doc_id").agg(F.max("label").alias("label")).withColumn("h", F.xxhash64("doc_id")).collect()
    for label in (0, 1):
        mine = sorted((r.h, r.doc_id) for r in best if r.label == label)[:30]
        assert {d for d, k in got if k == label} == {d for _, d in mine}
