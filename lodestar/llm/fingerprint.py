"""Fingerprints of documents: threshold-scaled sketches of their word shingles.

Of a document's distinct five-word shingles (fewer words: the whole sequence) the fingerprint keeps every 64-bit hash
below a fixed fraction of the range. The same fraction holds for every document, so a union of sketches is the
sketch of the union, and the part of one that another holds estimates containment, however unequal they are.

As text: the number of shingles, a hash of the words, and the kept hashes in ascending order as base64 of big-endian
longs, joined by colons. Equal texts have equal fingerprints. Words are runs without ASCII white space, A-Z in lower case.

Rows: null texts are empty ones. Two sketches without any hash are alike (1) if their words are, else not at all (0).
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, in_slices
from .ngram_join import shingles

#: Words of a shingle, and one of how many hashes is kept.
WORDS, ONE_IN = 5, 4

#: Bytes of text in a part of the sorted documents, about, and most parts.
PART_BYTES, PARTS = 16_000_000, 65_536
#: A repeated row counts as frequent from this many copies on, and from this part of all rows.
COPIES, COPIES_PART = 1024, 16_384


class Sketch:
    """The kept hashes of a text, ascending, with the number of its shingles and a name for its words."""

    __slots__ = ("n", "name", "kept")

    def __init__(self, text: str | None, words: int = WORDS, one_in: int = ONE_IN):
        every = shingles(text, words)
        self.n, self.kept = len(every), every[: np.searchsorted(every, np.uint64(-(-(1 << 64) // one_in)))] if one_in > 1 else every
        self.name = xxhash.xxh3_64_hexdigest(b" ".join((text or "").encode("utf-8", "surrogatepass").lower().split()))

    def __str__(self) -> str:
        return f"{self.n}:{self.name}:{base64.b64encode(self.kept.astype('>u8').tobytes()).decode()}"


def _parsed(fingerprint: str) -> tuple[str, np.ndarray]:
    _, name, kept = fingerprint.split(":")
    return name, np.frombuffer(base64.b64decode(kept), ">u8").astype(np.uint64)


def _shared(a: np.ndarray, b: np.ndarray) -> int:
    return len(np.intersect1d(a, b, assume_unique=True))


def _likeness(name_a: str, a: np.ndarray, name_b: str, b: np.ndarray) -> float:
    if name_a == name_b:
        return 1.0
    common = _shared(a, b)
    return common / max(1, len(a) + len(b) - common)


def _contained(name_a: str, a: np.ndarray, name_b: str, b: np.ndarray) -> float:
    return 1.0 if name_a == name_b else _shared(a, b) / max(1, len(a))


def with_fingerprints(docs: DataFrame, words: int = WORDS, one_in: int = ONE_IN, name: str = "fingerprint") -> DataFrame:
    """docs (text and any columns) with the fingerprint of each text; nothing is shuffled. `name` must be unused."""

    @F.pandas_udf("string")
    def made(texts: pd.Series) -> pd.Series:
        return pd.Series([str(Sketch(x, words, one_in)) for x in texts], dtype=object)

    return docs.withColumn(name, made(F.col("text").cast("string")))


def _pairwise(measure):
    @F.pandas_udf("double")
    def of(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([None if x is None or y is None else measure(*_parsed(x), *_parsed(y)) for x, y in zip(a, b)], dtype="float64")

    return of


def likeness(a: Column, b: Column) -> Column:
    """Estimated Jaccard similarity of two fingerprints, 0 to 1; null if one is null."""
    return _pairwise(_likeness)(a, b)


def containment(a: Column, b: Column) -> Column:
    """Estimated part of a's shingles that b has, 0 to 1; null if one is null."""
    return _pairwise(_contained)(a, b)


def hashes(df: DataFrame, *by: str, fingerprint: str = "fingerprint") -> DataFrame:
    """by, hash: the merged sketch of each group, a row a kept hash, so that no group has to fit a task.

    Merged sketches are what sketching all of the group's shingles at once would give.
    """
    kept = F.unbase64(F.split_part(F.col(fingerprint), F.lit(":"), F.lit(3)))
    each = F.expr("explode(transform(sequence(0, cast(length(_k) / 8 as int) - 1), i -> hex(substring(_k, i * 8 + 1, 8)))) as hash")
    return df.select(*by, kept.alias("_k")).where(F.length("_k") > 0).select(*by, each).distinct()


def contained_in(df: DataFrame, id_: str, merged: DataFrame, by: str, fingerprint: str = "fingerprint") -> DataFrame:
    """id_, by, part: the part of each row's kept hashes that each merged sketch (by, hash) holds; only pairs that share some."""
    own = hashes(df, id_, fingerprint=fingerprint)
    size = own.groupBy(id_).agg(F.count("*").alias("_n"))
    met = own.join(merged, "hash").groupBy(id_, by).agg(F.count("*").alias("_shared"))
    return met.join(size, id_).select(id_, by, (F.col("_shared") / F.col("_n")).alias("part"))


def _key(doc_id: Column, text: Column) -> Column:
    """Sorts as doc_id does, null first, then by the text's hash: 49 characters."""
    high = F.lpad(F.hex(doc_id.bitwiseXOR(F.lit(-(1 << 63)))), 16, "0")
    return F.concat(F.when(doc_id.isNull(), "0").otherwise("1"), F.coalesce(high, F.lit("0" * 16)), *[F.lpad(F.hex(h), 16, "0") for h in (F.xxhash64(text), F.xxhash64(F.lit(1), text))])


def _compared(rows: DataFrame, words: int, one_in: int) -> DataFrame:
    """Rows (guest, copies, doc_id, text), in order: each but a part's guest against the next row of its partition.

    A guest is the first row of the next part; it only ends its part.
    """
    names = ["copies", "doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "contained_edited", "contained_next"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), *[pa.float64()] * 4]

    def compare(copies, doc_id, text, own, after, after_sketch):
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        e = Sketch(edited, words, one_in)
        mine, yours, its = (own.name, own.kept), (e.name, e.kept), (after_sketch.name, after_sketch.kept)
        digest = hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest()
        return copies, doc_id, len(text), digest, str(own), str(e), _likeness(*mine, *yours), _likeness(*mine, *its), _contained(*mine, *yours), _contained(*mine, *its)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for b in in_slices(batches):
            out = []
            for guest, copies, doc_id, text in zip(*(c.to_pylist() for c in b.columns)):
                own = Sketch(text, words, one_in)
                if held is not None:
                    out.append(compare(*held, text, own))
                held = None if guest else (copies, doc_id, text, own)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names)

    return rows.select("guest", "copies", "doc_id", "text").mapInArrow(run, "copies long, doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, contained_edited double, contained_next double")


def _copies(rows: DataFrame, parts: int) -> DataFrame:
    """Each row as often as its `copies` says, which goes; COPIES at a time, so that no task makes all of one row."""
    lots = rows.select("*", F.explode(F.sequence(F.lit(0), F.expr(f"(copies - 1) div {COPIES}"))).alias("_lot")).repartition(parts)
    return lots.withColumn("_", F.explode(F.sequence(F.lit(1), F.least(F.lit(COPIES), F.col("copies") - F.col("_lot") * COPIES)))).drop("_", "_lot", "copies")


def compare_with_next(docs: DataFrame, words: int = WORDS, one_in: int = ONE_IN, part_bytes: int = PART_BYTES) -> DataFrame:
    """Each row (doc_id, text) with its fingerprint, that of its text with the last half replaced by the next row's start,
    and their likeness. Rows go in a ring by doc_id (null first), equal ids by a hash of the text.

    The texts are shuffled once, into ranges of keys; the first row of each range is also sent to the one before.
    Of rows that are equal and frequent one goes that way; the next of all others is the same text, so they are copies of one result.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "fingerprint")
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    src = src.select("doc_id", "text", _key(F.col("doc_id"), F.col("text")).alias("k"))
    keys = scratch.save(src.groupBy("k").agg(F.count("*").alias("n"), F.sum(F.octet_length("text") + 100).alias("bytes")), "keys")
    rows, size = keys.agg(F.sum("n"), F.sum("bytes")).first()
    if not rows:
        return _compared(src.withColumns({"copies": F.lit(1), "guest": F.lit(False)}), words, one_in).drop("copies")
    parts = int(min(PARTS, 1 + size // part_bytes))
    # The least key of each range: at most PARTS of 49 characters.
    cuts = sorted(r.k for r in keys.select("k").repartitionByRange(parts, "k").groupBy(F.spark_partition_id()).agg(F.min("k").alias("k")).collect())
    at = spark.sparkContext.broadcast(np.array(cuts, dtype="S49"))

    @F.pandas_udf("int")
    def part_of(k: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(at.value, k.to_numpy().astype("S49"), side="right") - 1, dtype="int32")

    first = F.broadcast(spark.createDataFrame([(c, (i - 1) % len(cuts)) for i, c in enumerate(cuts)], "k string, part int"))
    guests = src.join(first, "k").groupBy("k", "part").agg(F.first("doc_id").alias("doc_id"), F.first("text").alias("text"))
    often = keys.where(F.col("n") >= max(COPIES, rows // COPIES_PART)).select("k", "n")  # at most COPIES_PART keys
    body, extra = src.withColumn("copies", F.lit(1)), None
    if often.limit(1).count():
        one = src.join(F.broadcast(often), "k").groupBy("k").agg(F.first("doc_id").alias("doc_id"), F.first("text").alias("text"), F.first("n").alias("n"))
        one = scratch.save(one, "frequent")
        body = body.join(F.broadcast(often.select("k")), "k", "left_anti").unionByName(one.select("k", "doc_id", "text", F.lit(1).alias("copies")))
        alone = one.select("doc_id", "text", "k", (F.col("n") - 1).alias("copies"), F.explode(F.array(F.lit(False), F.lit(True))).alias("guest"))
        extra = _copies(_compared(alone.repartition("k").sortWithinPartitions("k", "guest"), words, one_in), parts)
    body = body.select("doc_id", "text", "k", "copies", part_of("k").alias("part"), F.lit(False).alias("guest"))
    every = body.unionByName(guests.withColumns({"guest": F.lit(True), "copies": F.lit(1)})).repartitionById(len(cuts), "part").sortWithinPartitions("guest", "k")
    out = _compared(every, words, one_in).drop("copies")
    return out if extra is None else out.union(extra)
