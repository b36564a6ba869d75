"""The ingest as Structured Streaming: deduplicated rollups, forward-only state, enrichment, promotion."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.workspace import folder


def read_stream(spark: SparkSession, path: str, files_a_batch: int = 1) -> DataFrame:
    """Parquet files as a stream, with the schema they have."""
    schema = spark.read.parquet(path).schema
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_batch)
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(at).isDirectory():
        # A stream watches folders: a single file is that name in its folder.
        reader, path = reader.option("pathGlobFilter", at.getName()), at.getParent().toString()
    s = reader.parquet(path)
    return s.withColumns({f.name: F.col(f.name).cast("timestamp") for f in schema if f.dataType.simpleString() == "timestamp_ntz"})


def run_to_table(stream: DataFrame, name: str, mode: str = "append", at: str | None = None) -> DataFrame:
    """Process all there is, with a checkpoint, into a Parquet table; returns the table. With the folder ``at`` of an earlier run it goes on from there."""
    spark = stream.sparkSession
    at = at or folder(spark, name)
    q = stream.writeStream.outputMode(mode).format("parquet").option("path", f"{at}/table").option("checkpointLocation", f"{at}/checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{at}/table")


def run_each_batch(stream: DataFrame, name: str, act: Callable[[DataFrame, int, str], None], mode: str = "update") -> str:
    """Process all there is with a function of (batch, number, folder); returns the folder."""
    at = folder(stream.sparkSession, name)
    q = stream.writeStream.outputMode(mode).foreachBatch(lambda df, i: act(df, i, at)).option("checkpointLocation", f"{at}/checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    return at


def unique_mentions(stream: DataFrame, late: str = "7 days") -> DataFrame:
    """Each (source, id) once, however often polls overlap, as long as it isn't later than the watermark."""
    return stream.withWatermark("posted_at", late).dropDuplicatesWithinWatermark(["source", "mention_id"])


def daily_rollup(stream: DataFrame) -> DataFrame:
    """Counts, engagement and distinct authors per issuer, source and UTC day, when the day is closed.

    Two aggregates in a row: an author's day first, then the day of those, so that authors are counted exactly and a busy
    day is first summed by author.
    """
    author = stream.groupBy(F.window("posted_at", "1 day").alias("w"), "issuer_id", "source", "author").agg(F.count("*").alias("n"), F.sum("engagement").alias("e"))
    w = author.groupBy(F.window(F.window_time("w"), "1 day").alias("w"), "issuer_id", "source").agg(F.sum("n").alias("mention_count"), F.sum("e").alias("engagement"), F.count("author").alias("unique_authors"))
    return w.select("issuer_id", "source", F.to_date("w.start").alias("day"), "mention_count", "engagement", "unique_authors")


def furthest(key: str, rank: str) -> Callable[[DataFrame, DataFrame], DataFrame]:
    """A merge of a snapshot with a batch: the furthest step of each key, whatever the order of events. A replay changes nothing."""
    return lambda old, new: old.select(key, rank).union(new.select(key, rank)).groupBy(key).agg(F.max(rank).alias(rank))
