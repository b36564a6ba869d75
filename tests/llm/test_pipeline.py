"""The corpus pipeline, stage by stage."""

import corpus_pipeline
from pyspark.sql import functions as F

from lodestar.llm import decontaminate, ngram_join
from lodestar.llm.common import read

SF = "/root/testdata/sf0.01"


def test_stages(spark):
    docs = read(spark, SF, "documents")
    columns = docs.columns
    seen = [docs.count()]
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF).cache()
        seen.append(docs.count())
        if name != "sharding":
            assert docs.columns == columns
        if name == "near_duplicates":
            assert ngram_join.jaccard_components(docs).where("component_id <> doc_id").count() == 0
        if name == "decontamination":
            assert decontaminate.find_overlaps(docs, read(spark, SF, "benchmark")).where("contaminated").count() == 0
    assert seen[1] >= 0.99 * seen[0] and seen[2] < seen[1] and seen[3] < seen[2]
    by = docs.groupBy("shard").agg(F.sum("size").alias("b"), F.max("size").alias("most")).collect()
    total, most = sum(r.b for r in by), max(r.most for r in by)
    # The mix takes a document twice at most; its rows are equal and stay together.
    assert len(by) == 16 and max(abs(r.b - total / 16) for r in by) <= 2 * most


def test_empty(spark):
    docs = read(spark, SF, "documents").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
    assert docs.count() == 0


def test_odd_rows_and_clashing_columns(spark):
    rows = [(1, None, "en", "a", 0), (2, "", None, None, 0), (3, "the thing with that and there is the other of them", "en", "a", 3), (3, "the thing with that and there is the other of them", "en", "a", 3), (None, "the end of that and the other", None, "b", None), (5, "que la de los y el en una", "es", "b", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs = docs.withColumns({c: F.lit("own") for c in ("score", "lang_pred", "contaminated", "bench_items", "node", "n", "copies", "target", "slot2")})
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
        if name != "sharding":
            assert docs.columns == columns and docs.where("score <> 'own' or contaminated <> 'own'").count() == 0
    assert docs.count() > 0
