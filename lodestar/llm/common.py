"""Helpers shared by the corpus operators."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A word is a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"

#: Bytes up to which a table is broadcast: a million rows of one long, fewer of wider ones.
BROADCAST_BYTES = 8_000_000

#: Rows of an Arrow batch at most. Whole texts travel in batches, which the JVM and the Python worker hold beside each other.
BATCH_ROWS = 500


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def short_batches(spark: SparkSession) -> None:
    """From now on the session's Arrow batches have BATCH_ROWS rows at most; a smaller number stays."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, BATCH_ROWS)


def short_shuffles(spark: SparkSession) -> None:
    """From now on the session removes a query's shuffle files when the query ends, not when the driver's JVM happens to collect its plan."""
    spark.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")


def ascii_lower(c: Column) -> Column:
    """A-Z in lower case, all else as it is."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def unused(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have, in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def row_hashes(df: DataFrame) -> tuple[Column, Column]:
    """128 bits of a row's whole content, as two longs: rows with the same are the same in every column."""
    cols = [F.to_json(f.name) if "map<" in f.dataType.simpleString() else F.col(f"`{f.name}`") for f in df.schema]
    # A mark of nulls, as a null leaves a hash as it was.
    nulls = F.concat(*[F.when(c.isNull(), "0").otherwise("1") for c in cols])
    return F.xxhash64(nulls, *cols), F.xxhash64(F.lit(1), *cols, nulls)


class Scratch:
    """Intermediate tables in the folder that driver and executors share.

    The folder is the session's ``spark.checkpoint.dir``; where that is unset (local tests) a folder
    of this machine is used. A saved table cuts the lineage and survives the loss of executors.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        base = spark.conf.get("spark.checkpoint.dir", None)
        if not base:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            import tempfile

            base = "file://" + tempfile.gettempdir()
        self.root = f"{base.rstrip('/')}/lodestar-{name}-{uuid.uuid4().hex}"
        self._n = 0

    def save(self, df: DataFrame, what: str = "t", by: str | None = None) -> DataFrame:
        """df as a table, in a folder a value of ``by`` if given."""
        self._n += 1
        path = f"{self.root}/{self._n:03d}-{what}"
        (df.write.partitionBy(by) if by else df.write).parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def drop(self, df: DataFrame) -> None:
        """Remove a table made by save() that no later step reads."""
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(df._scratch_path)
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def _width(t: T.DataType) -> int:
    """Bytes of a value, roughly."""
    if isinstance(t, T.StructType):
        return sum(_width(f.dataType) for f in t)
    return 64 if isinstance(t, (T.ArrayType, T.MapType)) else 32 if isinstance(t, (T.StringType, T.BinaryType)) else 8


def small(df: DataFrame) -> DataFrame:
    """The same rows, marked for broadcast if they are counted to be few for their width; else Spark joins by shuffle."""
    limit = BROADCAST_BYTES // _width(df.schema)
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def in_slices(batches: Iterator[pa.RecordBatch], rows: int = 500) -> Iterator[pa.RecordBatch]:
    """Arrow batches a few rows at a time, so that what is made of them stays small."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


def components(scratch: Scratch, edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components of an undirected graph: rows (node, root), root the smallest node reached.

    Alternates large-star and small-star steps (Kiveris et al., "Connected Components in MapReduce
    and Beyond") as joins and partial aggregates, a saved table a round. Nodes without edges get no row.
    """

    def both(e):
        return e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))

    def finger(e):
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    e = scratch.save(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct(), "edges")
    before = finger(e)
    while before[0]:
        # Large star: every larger neighbour of u is tied to the smallest of u and its neighbours.
        n = both(e)
        low = n.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = n.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # Small star: u and its smaller neighbours are tied to the smallest of them.
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        tied = large.join(low, "u")
        nxt = tied.select(F.col("v").alias("u"), F.col("m").alias("v")).union(tied.select("u", F.col("m").alias("v")))
        nxt = scratch.save(nxt.where("u <> v").distinct(), "edges")
        after = finger(nxt)
        scratch.drop(e)
        e = nxt
        if after == before:
            break
        before = after
    roots = e.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.union(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
