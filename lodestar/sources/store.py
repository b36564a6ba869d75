"""Tables that change by batches: a bucketed, versioned snapshot, and a table by day. Both keep what a batch doesn't touch.

All paths are reached through Spark, so they can be in any store that driver and executors share.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


class SnapshotStore:
    """A snapshot keyed by columns, in buckets of their hash. A batch rewrites only the buckets it touches.

    data/version=V/bucket=B holds a bucket as batch V left it; manifest-V.json says which version of each bucket is current, the
    last batch and the schema. The manifest comes last, by a rename, so a reader sees a batch whole or not at all, and a
    batch that failed is written anew. A batch number that the manifest has seen changes nothing.
    """

    def __init__(self, spark: SparkSession, path: str, key: Sequence[str], buckets: int = 64, versions: int = 2):
        self.spark, self.path, self.key, self.buckets, self.versions = spark, path.rstrip("/"), list(key), buckets, versions
        self._jvm = spark.sparkContext._jvm
        self._fs = self._path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, p: str):
        return self._jvm.org.apache.hadoop.fs.Path(p)

    def _manifests(self) -> list[int]:
        found = self._fs.globStatus(self._path(f"{self.path}/manifest-*.json")) or []
        return sorted(int(s.getPath().getName()[9:-5]) for s in found)

    def _manifest(self, version: int) -> dict:
        return json.loads("\n".join(r.value for r in self.spark.read.text(f"{self.path}/manifest-{version:012d}.json").collect()))

    def current(self) -> dict | None:
        seen = self._manifests()
        return self._manifest(seen[-1]) if seen else None

    def _bucket(self):
        return F.pmod(F.xxhash64(*self.key), F.lit(self.buckets)).cast("int")

    def _read(self, manifest: dict, buckets: Sequence[str]) -> DataFrame:
        schema = T.StructType.fromJson(manifest["schema"])
        paths = [f"{self.path}/data/version={manifest['buckets'][b]}/bucket={b}" for b in buckets]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def read(self) -> DataFrame:
        """The snapshot as the last manifest has it."""
        m = self.current()
        if m is None:
            raise FileNotFoundError(f"{self.path} has no snapshot")
        return self._read(m, sorted(m["buckets"]))

    def apply(self, updates: DataFrame, batch: int, merge: Callable[[DataFrame, DataFrame], DataFrame]) -> list[int]:
        """merge(old rows of the touched buckets, updates) becomes their content; returns the touched buckets."""
        m = self.current()
        if m is not None and batch <= m["batch"]:
            return []
        touched = sorted(r[0] for r in updates.select(self._bucket().alias("b")).distinct().collect())  # at most ``buckets``
        if m is None and not touched:
            return []
        old = self._read(m, [str(b) for b in touched if str(b) in m["buckets"]]) if m else updates.limit(0)
        version = m["version"] + 1 if m else 0
        new = merge(old, updates)
        if touched:
            # The schema stays what it was; a bucket is written by as many tasks as its rows ask for.
            new.withColumn("bucket", self._bucket()).write.partitionBy("bucket").mode("overwrite").parquet(f"{self.path}/data/version={version}")
        there = {s.getPath().getName()[7:] for s in self._fs.globStatus(self._path(f"{self.path}/data/version={version}/bucket=*")) or []}
        kept = {b: v for b, v in (m["buckets"] if m else {}).items() if int(b) not in set(touched)}
        manifest = {"version": version, "batch": batch, "buckets": kept | {b: version for b in there}, "schema": json.loads((m and json.dumps(m["schema"])) or new.schema.json())}
        self._write(version, json.dumps(manifest))
        self._clean()
        return touched

    def _write(self, version: int, text: str) -> None:
        name = f"manifest-{version:012d}.json"
        draft = self._path(f"{self.path}/.{name}")
        out = self._fs.create(draft, True)
        out.write(bytearray(text.encode()))
        out.close()
        if not self._fs.rename(draft, self._path(f"{self.path}/{name}")):
            raise OSError(f"{name} is there already: two writers on {self.path}")

    def _clean(self) -> None:
        """Drop manifests before the last few and what only they name."""
        seen = self._manifests()
        live = {(b, v) for n in seen[-self.versions :] for b, v in self._manifest(n)["buckets"].items()}
        for n in seen[: -self.versions]:
            for b, v in self._manifest(n)["buckets"].items():
                if (b, v) not in live:
                    self._fs.delete(self._path(f"{self.path}/data/version={v}/bucket={b}"), True)
            self._fs.delete(self._path(f"{self.path}/manifest-{n:012d}.json"), False)


def write_days(df: DataFrame, path: str, day: str, entity: str) -> None:
    """A table by day, rows of a file sorted by entity; days of df replace those of the table, others stay.

    Ranges of (day, entity) deal the rows, so a busy day is several files with ranges of entities that don't overlap.
    """
    dealt = df.repartitionByRange(F.col(day), F.col(entity)).sortWithinPartitions(day, entity)
    dealt.write.partitionBy(day).option("partitionOverwriteMode", "dynamic").mode("overwrite").parquet(path)
