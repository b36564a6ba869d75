"""Ranked lexical search of every document for a table of items, by bag deduplication.

A document is cut down to its bag: how often it holds each term of the items' vocabulary. Documents with the same
bag and the same length norm m score alike, so they are one class: grouped by a hash, told apart by the bag itself.
Each class is scored once against all items that share a term with it. Of the classes, those that may reach an item's
first k are known by score and smallest doc_id: k classes hold at least k documents. Only these are expanded
to their members, in the order of doc_id.

Items are taken in blocks of about BLOCK_BYTES of text, each a pass over the documents; a block's vocabulary is what
is broadcast. Terms, weights and scores are those of score_of() below; all but the weight's logarithm is in whole numbers.

Rows: a null text has no term; documents without terms count nowhere. Every row of documents and of items counts
by itself, also if rows or ids are repeated; a null doc_id comes last among equal scores. An item with null text has no rows.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, in_slices, small

#: Terms are runs of ASCII letters and digits and of all that isn't ASCII; only A-Z lose their case.
_TERMS = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))

#: Bytes of items' text in a block.
BLOCK_BYTES = 8_000_000
#: Scores, and pairs of a term and an item, that a task holds at once.
SCORES, PAIRS = 2_000_000, 2_000_000


def terms(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_TERMS).split()


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def score_of(tf: int, w: int, m: int) -> int:
    """What a term adds to a score."""
    return w * (1_000_000_000 * tf // (1000 * tf + 20 * m))


def _bags(docs: DataFrame, vocabulary: Broadcast) -> DataFrame:
    """doc_id, n (terms with repeats), term (numbers in the vocabulary, ascending), tf."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = vocabulary.value
        for b in in_slices(batches):
            sizes, ends, term, tf = [], [0], [], []
            for x in b.column(1).to_pylist():
                words = terms(x)
                sizes.append(len(words))
                bag = sorted((numbers[t], c) for t, c in Counter(words).items() if t in numbers)
                term += [t for t, _ in bag]
                tf += [c for _, c in bag]
                ends.append(len(term))
            lists = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(v, pa.int32())) for v in (term, tf)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sizes, pa.int64()), *lists], ["doc_id", "n", "term", "tf"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, n long, term array<int>, tf array<int>")


class _Best:
    """The first k of each item so far, by descending score, then ascending id."""

    def __init__(self, items: int, k: int):
        self.k, self.least, self.n, self.parts = k, np.ones(items, dtype=np.int64), 0, []

    def add(self, columns: tuple) -> None:
        self.parts.append(columns)
        self.n += len(columns[0])
        if self.n > 4 * self.k * len(self.least) + 100_000:
            self.cut()

    def cut(self) -> tuple:
        item, score, low, *rest = (np.concatenate(c) for c in zip(*self.parts))
        order = np.lexsort((low, -score, item))
        item = item[order]
        place = np.arange(len(item)) - np.searchsorted(item, item)
        last = order[place == self.k - 1]
        self.least[np.concatenate([c for c, *_ in self.parts])[last]] = score[last]
        order = order[place < self.k]
        kept = (item[place < self.k], score[order], low[order], *(r[order] for r in rest))
        self.parts, self.n = [kept], len(kept[0])
        return kept


def _scored(classes: DataFrame, model: Broadcast, k: int) -> DataFrame:
    """at (number of the item), score, low, h, m: of each item the k classes that come first in each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, first, count, items, n_items = model.value
        best, none = _Best(n_items, k), np.iinfo(np.int64).max
        step = max(1, SCORES // max(1, n_items))
        for b in in_slices(batches, step):
            low = b.column(2).fill_null(none).to_numpy(zero_copy_only=False)
            h, m = b.column(0).to_numpy(), b.column(1).to_numpy()
            lists = b.column(3)
            t, tf = lists.flatten().to_numpy(), b.column(4).flatten().to_numpy().astype(np.int64)
            row = np.repeat(np.arange(b.num_rows), lists.value_lengths().to_numpy())
            adds = w[t] * (1_000_000_000 * tf // (1000 * tf + 20 * m[row]))
            scores = np.zeros(b.num_rows * n_items, dtype=np.int64)
            pairs = np.cumsum(count[t])
            cuts = np.searchsorted(pairs, np.arange(PAIRS, int(pairs[-1]) if len(pairs) else 0, PAIRS))
            for part in np.split(np.arange(len(t)), cuts):
                c = count[t[part]]
                ends = np.cumsum(c)
                flat = np.arange(int(ends[-1]) if len(ends) else 0) - np.repeat(ends - c, c) + np.repeat(first[t[part]], c)
                np.add.at(scores, np.repeat(row[part], c) * n_items + items[flat], np.repeat(adds[part], c))
            good = np.flatnonzero(scores.reshape(b.num_rows, n_items) >= best.least)
            r = good // n_items
            best.add((good % n_items, scores[good], low[r], h[r], m[r]))
        if best.n:
            at, score, low, h, m = best.cut()
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(score), pa.array(low, mask=low == none), pa.array(h), pa.array(m)], ["at", "score", "low", "h", "m"])

    return classes.select("h", "m", "low", "term", "tf").mapInArrow(run, "at long, score long, low long, h long, m long")


def _search_block(scratch: Scratch, docs: DataFrame, items: list[tuple[int, str]], k: int) -> DataFrame:
    """at, doc_id, score: each item's first k documents and more; items are (at, text)."""
    context = docs.sparkSession.sparkContext
    sets = [set(terms(x)) for _, x in items]
    numbers = {t: i for i, t in enumerate(sorted(set().union(*sets)))}
    postings = sorted((numbers[t], i) for i, s in enumerate(sets) for t in s)
    vocabulary = context.broadcast(numbers)
    bags = scratch.save(_bags(docs, vocabulary), "bags")
    vocabulary.destroy()
    n_docs, n_terms = bags.where("n > 0").agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    norm = F.expr(f"50 + (50 * n * {n_docs}L) div {max(1, n_terms)}L")
    bags = bags.where(F.size("term") > 0).withColumn("m", norm).withColumn("h", F.xxhash64("m", "term", "tf"))
    same = ["h", "m", "term", "tf"]
    classes = scratch.save(bags.groupBy(*same).agg(F.min("doc_id").alias("low"), F.count("*").alias("n")), "classes")
    df = classes.select(F.explode("term").alias("t"), "n").groupBy("t").agg(F.sum("n").alias("df")).collect()  # at most the block's vocabulary
    w = np.zeros(len(numbers), dtype=np.int64)
    for r in df:
        w[r.t] = weight(n_docs, r.df)
    term, item = np.array(postings, dtype=np.int64).reshape(-1, 2).T
    first = np.searchsorted(term, np.arange(len(numbers) + 1))
    model = context.broadcast((w, first[:-1], np.diff(first), item, len(items)))
    order = [F.desc("score"), F.asc_nulls_last("low"), "h", "m"]
    found = _scored(classes, model, k).withColumn("place", F.row_number().over(Window.partitionBy("at").orderBy(*order))).where(F.col("place") <= k).drop("place")
    found = scratch.save(found, "found")
    model.destroy()
    # The bag tells apart what a hash may not: a class is its bag from here on.
    key = (F.col("f.h") == F.col("c.h")) & (F.col("f.m") == F.col("c.m")) & F.col("f.low").eqNullSafe(F.col("c.low"))
    named = scratch.save(classes.alias("c").join(small(found.alias("f")), key).select("at", "score", *[f"c.{c}" for c in same]), "named")
    wanted = named.select(*same).distinct()
    # Hashes find the classes' rows, bags are compared where they meet: bags are never broadcast by size of their own.
    near = bags.join(small(wanted.select("h", "m").distinct()), ["h", "m"], "left_semi")
    members = near.join(wanted, same).select("doc_id", *same)
    members = members.withColumn("place", F.row_number().over(Window.partitionBy(*same).orderBy(F.asc_nulls_last("doc_id")))).where(F.col("place") <= k)
    back = docs.sparkSession.createDataFrame(list(enumerate(a for a, _ in items)), "at long, item long")
    return named.join(members, same).join(small(back), "at").select("item", "doc_id", "score")


def search(docs: DataFrame, items: DataFrame, k: int = 50, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """item_id, rank, doc_id, score: the k highest-scoring documents (doc_id, text) of each item (item_id, text)."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "lexical")
    rows = scratch.save(items.select("item_id", F.col("text").cast("string").alias("text")).withColumn("item", F.monotonically_increasing_id()), "items")
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = 1 + total // block_bytes
    out = None
    for b in range(blocks):
        block = [(r.item, r.text) for r in rows.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == b).where("text is not null").collect()]
        if block:
            got = _search_block(scratch, docs, block, k)
            out = got if out is None else out.union(got)
    if out is None:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    place = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    ranked = out.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= k)
    return ranked.join(rows.select("item", "item_id"), "item").select("item_id", "rank", "doc_id", "score")
