"""What the n-gram join keeps on disk: tables leave once read, bitmaps are no columns of rows, buckets meet in passes."""

import os

from lodestar.llm import common, ngram_join

SF = "/root/testdata/sf0.001"


def _result(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    # Near copies of half of them, so that several roots share buckets.
    near = docs.where("doc_id % 2 = 0").selectExpr("doc_id + 100000 doc_id", "concat(text, ' and some more words ', doc_id) text")
    return sorted(tuple(r) for r in ngram_join.jaccard_components(docs.select("doc_id", "text").union(near), threshold="0.8", words=5).collect())


def test_passes_give_what_one_does(spark, monkeypatch):
    one = _result(spark)
    monkeypatch.setattr(ngram_join, "PASS_ROWS", 300)
    many = []
    save = common.Scratch.save
    monkeypatch.setattr(common.Scratch, "save", lambda self, df, what="t", by=None: many.append(what) or save(self, df, what, by))
    assert _result(spark) == one
    assert many.count("cross") > 1


def test_tables_leave_once_read(spark, monkeypatch):
    alive = {}
    save = common.Scratch.save

    def seen(self, df, what="t", **by):
        out = save(self, df, what, **by)
        alive[what] = {n.split("-")[1] for n in os.listdir(self.root.removeprefix("file://"))}, set(df.columns)
        return out

    monkeypatch.setattr(common.Scratch, "save", seen)
    _result(spark)
    assert not alive["bounded"][0] & {"sets", "nodes", "grams", "met", "ranked"}
    assert not alive["open"][1] & {"bits", "odd"} and not alive["bounded"][1] & {"bits", "odd"}
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "true"
