"""Whole texts reach Python a few hundred rows at a time in the pipeline's stages."""

import corpus_pipeline
import pyarrow as pa
import pytest

SF = "/root/testdata/sf0.001"
ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def _largest_batch(spark):
    sizes = spark.range(0, 3000, 1, 1).mapInArrow(lambda bs: (pa.RecordBatch.from_pydict({"n": [b.num_rows]}) for b in bs), "n long")
    return max(r.n for r in sizes.collect())


@pytest.mark.parametrize("stage", ["language_id", "near_duplicates", "decontamination"])
@pytest.mark.parametrize("before, most", [("10000", 500), ("0", 500), ("100", 100)])
def test_stages_take_short_batches(spark, stage, before, most):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(20)
    was = spark.conf.get(ROWS)
    try:
        spark.conf.set(ROWS, before)
        dict(corpus_pipeline.STAGES)[stage](spark, docs, SF)
        assert _largest_batch(spark) == most
    finally:
        spark.conf.set(ROWS, was)
