"""Token counts by a map-side, two-tier lookup of pre-token lengths.

A byte-level BPE tokenizer splits text into pre-tokens and encodes each for itself, so a text's count
is a sum of pre-token lengths. The lengths of frequent pre-tokens, found on a sample, travel to the
workers in a compact broadcast table; any other is encoded once and kept in a bounded cache of the
worker, which outlives its tasks. No pre-token is ever shuffled.
"""

from __future__ import annotations

import re
import uuid
from collections import Counter
from collections.abc import Iterable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_slices

#: Documents of a partition, and partitions of each power of two, that the frequent pre-tokens are taken
#: from; how many pre-tokens the table holds.
SAMPLE_DOCS, SAMPLE_PARTS, TABLE_SIZE = 128, 64, 65536
#: Entries and longest pre-token of a worker's cache.
CACHE_SIZE, CACHE_CHARS = 500_000, 64


class Splitter:
    """Pre-tokens of texts in any script, by a pattern over the characters met so far.

    What is a letter, a digit or a space is asked of the library itself, once a character.
    """

    def __init__(self, tokenizer):
        self.split = tokenizer.pre_tokenizer.pre_tokenize_str
        self.kinds: dict[str, str] = {}
        self.learn([chr(c) for c in range(0x250)])

    def _kind(self, c: str) -> str:
        ends = [end for _, (_, end) in self.split(f"a{c}{c}!1")]
        return {(3, 4, 5): "L", (1, 3, 4, 5): "N", (1, 2, 3, 4, 5): "S", (1, 2, 4, 5): "S"}.get(tuple(ends), "")

    def learn(self, texts: Iterable[str]) -> None:
        new = set().union(*texts) - self.kinds.keys()
        if new or not self.kinds:
            self.kinds |= {c: self._kind(c) for c in new}
            letters, digits, spaces = ("".join(re.escape(c) for c, kind in self.kinds.items() if kind == k) for k in "LNS")
            # The byte-level pre-tokenizer's pattern.
            self.find = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d| ?[{letters}]+| ?[{digits}]+| ?[^{spaces}{letters}{digits}]+|[{spaces}]+(?![^{spaces}])|[{spaces}]+").findall


class Lengths(dict):
    """Pre-token -> number of tokens; what the table lacks is encoded and, if short, kept."""

    def __init__(self, table: dict, tokenizer):
        super().__init__(table)
        self.tokenizer, self.room = tokenizer, CACHE_SIZE

    def __missing__(self, token: str) -> int:
        n = len(self.tokenizer.encode(token, add_special_tokens=False).ids)
        if self.room and len(token) <= CACHE_CHARS:
            self[token] = n
            self.room -= 1
        return n


def _load(vocabulary: str):
    """The tokenizer without truncation or padding, and the special strings it takes out of texts."""
    import json

    from tokenizers import Tokenizer

    t = Tokenizer.from_file(vocabulary)
    t.no_truncation()
    t.no_padding()
    spec = json.loads(t.to_str())
    pre = spec.get("pre_tokenizer") or {}
    plain = spec.get("normalizer") is None and pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and spec["model"]["type"] == "BPE"
    return t, [a["content"] for a in spec.get("added_tokens", [])], plain


class Worker:
    """A worker's tokenizer, pattern and cache for one vocabulary."""

    def __init__(self, vocabulary: str, table: dict):
        self.tokenizer, self.specials, self.plain = _load(vocabulary)
        self.lengths = Lengths(table, self.tokenizer)
        self.splitter = Splitter(self.tokenizer) if self.plain else None

    def counts(self, texts: list[str]) -> list[int]:
        if self.splitter:
            self.splitter.learn(texts)
        return [self._count(t) if t else 0 for t in texts]

    def _count(self, text: str) -> int:
        # Strings of added tokens are cut out before the text is split: the library's work.
        if not self.splitter or any(s in text for s in self.specials):
            return len(self.tokenizer.encode(text, add_special_tokens=False).ids)
        return sum(map(self.lengths.__getitem__, self.splitter.find(text)))


#: The worker's counter; it outlives tasks, as Spark uses workers again.
_kept: dict[tuple[str, str], Worker] = {}


def _worker(vocabulary: str, run: str, table) -> Worker:
    if (vocabulary, run) not in _kept:
        _kept.clear()
        _kept[vocabulary, run] = Worker(vocabulary, table.value)
    return _kept[vocabulary, run]


def frequent_lengths(df: DataFrame, vocabulary: str, text: str = "text", size: int = TABLE_SIZE) -> dict[str, int]:
    """Lengths of the most frequent pre-tokens of a sample, ``size`` at most.

    The sample is the first SAMPLE_DOCS documents of some partitions: all of the first 64, and 64 of every
    later power of two, so it grows with the logarithm of the table. Others aren't read. It only decides
    which lengths are ready beforehand; counts never depend on it.
    """
    if not _load(vocabulary)[2]:
        return {}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        if part >= SAMPLE_PARTS and part % (1 << (part.bit_length() - SAMPLE_PARTS.bit_length())):
            return
        splitter, seen = Splitter(_load(vocabulary)[0]), Counter()
        for b in in_slices(batches, SAMPLE_DOCS):
            texts = [t for t in b.column(0).to_pylist() if t]
            splitter.learn(texts)
            for t in texts:
                seen.update(x for x in splitter.find(t) if len(x) <= CACHE_CHARS)
            break
        top = seen.most_common(size)
        yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in top], pa.string()), pa.array([c for _, c in top], pa.int64())], ["token", "n"])

    top = df.select(F.col(text).cast("string")).mapInArrow(run, "token string, n long").groupBy("token").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "token").limit(size)
    tokens = [r[0] for r in top.collect()]
    return dict(zip(tokens, (len(e.ids) for e in _load(vocabulary)[0].encode_batch(tokens, add_special_tokens=False))))


def count_tokens(df: DataFrame, vocabulary: str, text: str = "text", limit: int = 1024) -> DataFrame:
    """Adds n_bytes, n_tokens and over_limit (more than ``limit`` tokens) to every row.

    Counts are those of the library for the vocabulary file, without added special tokens; special
    strings inside a text count as the library has it by default. Null texts count as empty: 0 and 0.
    All rows stay, repeated ones too; columns named as ours are replaced. Texts of any script take the
    lookup; only those with special strings are encoded whole by the library, and all texts if the
    vocabulary isn't byte-level BPE.
    """
    df = df.drop("n_bytes", "n_tokens", "over_limit")
    table = df.sparkSession.sparkContext.broadcast(frequent_lengths(df, vocabulary, text))
    run = uuid.uuid4().hex

    @F.pandas_udf("long")
    def tokens(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        counter = _worker(vocabulary, run, table)
        for texts in batches:
            yield pd.Series(counter.counts([t or "" for t in texts]), dtype="int64")

    return df.withColumns({"n_bytes": F.coalesce(F.octet_length(text), F.lit(0)).cast("long"), "n_tokens": tokens(F.col(text))}).withColumn("over_limit", F.col("n_tokens") > limit)
