"""Benchmark decontamination by spaced seeds.

Three masks of six tokens each - contiguous, with a gap of three and with a gap of six - are laid over
benchmark items and documents; positions in the gaps are ignored. Twelve aligned tokens with at most
two substitutions always have two intact blocks of three, so one of the masks hits. Items of three to
eight tokens have a mask of three, shorter ones a mask of one. Seed hashes of the benchmark travel to
the workers in blocks of a stated size and are joined there with the hashes of every document; around
a hit the windows of the two texts that hold it are compared. A seed that many places share leads to longer
masks instead of to each of them. What a block finds is a table of hits alone.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, row_hashes, small, unused

# Token positions that the masks look at.
MASKS = ((0, 1, 2, 3, 4, 5), (0, 1, 2, 6, 7, 8), (0, 1, 2, 9, 10, 11))
MASKS_SHORT, MASKS_TINY = ((0, 1, 2),), ((0,),)
#: Items from so many tokens on have the masks of six, and from so many the mask of three.
LONG, SHORT = 9, 3
#: Aligned tokens that make an overlap, and substitutions allowed among them.
WINDOW, SUBSTITUTIONS = 12, 2
#: Benchmark tokens that are joined in one pass over the documents (about 50 MB on a worker).
PASS_TOKENS = 1_000_000
#: Hits that are looked at together.
HITS = 1 << 15
#: Places of a seed beyond which its windows are found by longer masks, and hashes of those masks a block has at most (48 MB).
SHARED, SHARED_MASKS = 64, 4_000_000

TOKEN = re.compile(r"\w+")
_MULT = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53], dtype=np.uint64)


def tokens(text: str | None) -> list[str]:
    """Runs of letters, digits and underscores, in lower case."""
    return TOKEN.findall((text or "").lower())


def seeds(ids: np.ndarray, mask: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Positions whose masked tokens are all known (ids >= 0), and their hashes."""
    n = len(ids) - mask[-1]
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    known = ids >= 0
    ok = known[:n].copy()
    for o in mask[1:]:
        ok &= known[o : o + n]
    at = np.flatnonzero(ok)
    h = np.zeros(len(at), np.uint64)
    for o, m in zip(mask, _MULT):
        h = (h ^ (ids[at + o].astype(np.uint64) + np.uint64(1)) * m) * _MULT[0]
        h ^= h >> np.uint64(29)
    return at, h


class Index:
    """Seeds of a block of benchmark items, by mask.

    A table has the distinct hashes of one mask, sorted, and for each the places (tokens of all items on end)
    that have it. Seeds of more than ``shared`` places, such as those of a prompt that many items begin with,
    aren't compared place by place. The windows around them are kept once each, with the items that hold
    them, and are found by longer masks: one for every choice of the tokens that may differ, so whatever such
    a mask finds is an overlap. Where these masks would take more than SHARED_MASKS hashes, ``shared`` is
    doubled until they don't; what is found is the same for any ``shared``.
    """

    def __init__(self, block: list[tuple[int | None, list[str]]], shared: int = SHARED):
        self.item_ids = [i for i, _ in block]
        self.vocabulary: dict[str, int] = {}
        items = [np.array([self.vocabulary.setdefault(t, len(self.vocabulary)) for t in toks], dtype=np.int64) for _, toks in block]
        sizes = np.array([len(x) for x in items])
        self.first = np.concatenate(([0], np.cumsum(sizes)))
        self.flat = np.concatenate(items)
        self.width = np.minimum(sizes, WINDOW)
        self.tables = []
        for masks, lo, hi in ((MASKS, LONG, np.inf), (MASKS_SHORT, SHORT, LONG), (MASKS_TINY, 1, SHORT)):
            some = np.flatnonzero((sizes >= lo) & (sizes < hi))
            for mask in masks if len(some) else ():
                got = [seeds(items[i], mask) for i in some]
                h, place = np.concatenate([g[1] for g in got]), np.concatenate([g[0] + self.first[i] for i, g in zip(some, got)])
                if not len(h):
                    continue
                order = np.lexsort((place, h))
                hashes, first = np.unique(h[order], return_index=True)
                self.tables.append((mask, hashes, np.append(first, len(h)), place[order]))
        while True:
            windows = self._shared_windows(shared)
            if sum(len(rows) * len(_kept(w)) for w, (rows, _, _) in windows.items()) <= SHARED_MASKS:
                break
            shared *= 2
        self.shared = shared
        self.windows = {}
        for w, (rows, first, item) in windows.items():
            h = np.concatenate([_row_hashes(rows[:, kept], n) for n, kept in enumerate(_kept(w))])
            order = np.argsort(h, kind="stable")
            self.windows[w] = (rows, first, item, h[order], (order % len(rows)).astype(np.int32))

    def _shared_windows(self, shared: int) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """By width, the distinct windows around seeds of more than ``shared`` places, and the items of each."""
        starts: dict[int, list[np.ndarray]] = {}
        for mask, _, first, place in self.tables:
            n = np.diff(first)
            at = place[np.repeat(n > shared, n)]
            item = np.searchsorted(self.first, at, "right") - 1
            for w in np.unique(self.width[item]).tolist():
                a, i = at[self.width[item] == w], item[self.width[item] == w]
                for back in range(w - mask[-1]):
                    ok = (a - back >= self.first[i]) & (a - back + w <= self.first[i + 1])
                    starts.setdefault(w, []).append(a[ok] - back)
        out = {}
        for w, some in starts.items():
            start = np.unique(np.concatenate(some))
            if not len(start):
                continue
            rows, which = np.unique(self.flat[start[:, None] + np.arange(w)], axis=0, return_inverse=True)
            pairs = np.unique(np.stack([which.ravel(), np.searchsorted(self.first, start, "right") - 1], 1), axis=0)
            out[w] = (rows, np.searchsorted(pairs[:, 0], np.arange(len(rows) + 1)), pairs[:, 1])
        return out

    def overlaps(self, text: str | None) -> list[tuple[int | None, int]]:
        """(item_id, equal tokens of its best window) of the items that the whole text overlaps with."""
        toks = tokens(text)
        ids = np.fromiter((self.vocabulary.get(t, -1) for t in toks), dtype=np.int64, count=len(toks))
        best = None
        probed: dict[int, np.ndarray] = {}
        for mask, hashes, first, place in self.tables:
            at, h = seeds(ids, mask)
            k = np.searchsorted(hashes, h)
            hit = (k < len(hashes)) & (hashes[np.minimum(k, len(hashes) - 1)] == h)
            at, k = at[hit], k[hit]
            if not len(at):
                continue
            if best is None:
                best = np.zeros(len(self.item_ids), np.int8)
            often = first[k + 1] - first[k] > self.shared
            for w in self.windows if often.any() else ():
                for back in range(w - mask[-1]):
                    start = at[often] - back
                    probed.setdefault(w, np.zeros(len(ids), bool))[start[(start >= 0) & (start + w <= len(ids))]] = True
            at, k = at[~often], k[~often]
            for lo, hi in _runs(first[k + 1] - first[k]):
                who, j = _expand(first[k[lo:hi]], first[k[lo:hi] + 1])
                self._compare(ids, at[lo:hi][who], place[j], mask[-1] + 1, best)
        for w, mark in probed.items():
            self._probe(ids, w, np.flatnonzero(mark), best)
        return [] if best is None else [(self.item_ids[i], int(best[i])) for i in np.flatnonzero(best).tolist()]

    def _compare(self, ids: np.ndarray, at: np.ndarray, place: np.ndarray, span: int, best: np.ndarray) -> None:
        """Raises best by the windows around seeds of ``span`` tokens, at ``at`` of the text and ``place`` of the items."""
        item = np.searchsorted(self.first, place, "right") - 1
        for w in np.unique(self.width[item]).tolist():
            some = self.width[item] == w
            a, p, i = at[some], place[some], item[some]
            o = np.arange(span - w, w)
            equal = ids[np.clip(a[:, None] + o, 0, len(ids) - 1)] == self.flat[np.clip(p[:, None] + o, 0, len(self.flat) - 1)]
            total = np.concatenate((np.zeros((len(a), 1), np.int8), np.cumsum(equal, axis=1, dtype=np.int8)), axis=1)
            for back in range(w - span + 1):
                n = total[:, 2 * w - span - back] - total[:, w - span - back]
                ok = (n >= _enough(w)) & (a >= back) & (a - back + w <= len(ids)) & (p - back >= self.first[i]) & (p - back + w <= self.first[i + 1])
                np.maximum.at(best, i[ok], n[ok])

    def _probe(self, ids: np.ndarray, w: int, starts: np.ndarray, best: np.ndarray) -> None:
        """Raises best by the kept windows of width w that the text's windows at ``starts`` are near enough to."""
        rows, first, item, hashes, which = self.windows[w]
        mine = np.unique(ids[starts[:, None] + np.arange(w)], axis=0)
        near = np.zeros(len(rows), np.int8)
        for n, kept in enumerate(_kept(w)):
            known = mine[(mine[:, kept] >= 0).all(axis=1)]
            h = _row_hashes(known[:, kept], n)
            lo, hi = np.searchsorted(hashes, h, "left"), np.searchsorted(hashes, h, "right")
            for x, y in _runs(hi - lo):
                who, j = _expand(lo[x:y], hi[x:y])
                equal = (known[x:y][who] == rows[which[j]]).sum(axis=1).astype(np.int8)
                ok = equal >= _enough(w)
                np.maximum.at(near, which[j][ok], equal[ok])
        found = np.flatnonzero(near)
        for x, y in _runs(first[found + 1] - first[found]):
            who, j = _expand(first[found[x:y]], first[found[x:y] + 1])
            np.maximum.at(best, item[j], near[found[x:y]][who])


def _enough(w: int) -> int:
    """Equal tokens that make a window of w tokens an overlap."""
    return w - SUBSTITUTIONS * w // WINDOW


def _kept(w: int) -> list[list[int]]:
    """The positions that are looked at, for every choice of those that may differ."""
    return [list(x) for x in itertools.combinations(range(w), _enough(w))]


def _row_hashes(rows: np.ndarray, salt: int) -> np.ndarray:
    h = np.full(len(rows), salt + 1, np.uint64)
    for c in range(rows.shape[1]):
        h = (h ^ (rows[:, c].astype(np.uint64) + np.uint64(1)) * _MULT[c % len(_MULT)]) * _MULT[0]
        h ^= h >> np.uint64(29)
    return h


def _runs(counts: np.ndarray) -> Iterator[tuple[int, int]]:
    """Slices of the counts that sum to about HITS, one count at least."""
    total = np.cumsum(counts)
    lo = 0
    while lo < len(counts):
        hi = max(lo + 1, int(np.searchsorted(total, (total[lo - 1] if lo else 0) + HITS, "right")))
        yield lo, hi
        lo = hi


def _expand(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For ranges lo[i] up to hi[i]: i and the members, one range after another."""
    n = hi - lo
    who = np.repeat(np.arange(len(n)), n)
    return who, np.arange(len(who)) - np.repeat(np.cumsum(n) - n, n) + lo[who]


def _blocks(benchmark: DataFrame, text: str, id_: str) -> Iterator[list[tuple[int | None, list[str]]]]:
    """Items in blocks of about PASS_TOKENS tokens; the driver holds one block at a time."""
    block, n = [], 0
    for r in benchmark.where(F.col(text).isNotNull()).select(F.col(id_).cast("long"), text).toLocalIterator():
        toks = tokens(r[1])
        if toks:
            block.append((r[0], toks))
            n += len(toks)
        if n >= PASS_TOKENS:
            yield block
            block, n = [], 0
    if block:
        yield block


def _hits(docs: DataFrame, index) -> DataFrame:
    """(ra, rb, text) -> ra, rb, item, equal: a row a document and item that overlap."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            got = [(ra, rb, i, n) for ra, rb, t in zip(b["ra"], b["rb"], b["text"]) for i, n in index.value.overlaps(t)]
            out = pd.DataFrame(got, columns=["ra", "rb", "item", "equal"])
            yield out.astype({"ra": "int64", "rb": "int64", "item": "Int64", "equal": "int64"})

    return docs.mapInPandas(run, "ra long, rb long, item long, equal long")


def find_overlaps(df: DataFrame, benchmark: DataFrame, text: str = "text", item_text: str = "text", item_id: str = "item_id") -> DataFrame:
    """Adds bench_items (ids of overlapping items, ascending), bench_equal and contaminated to every row.

    A document overlaps with an item if twelve aligned tokens differ in at most two, or a whole item of 6
    to 11 in at most one, or a whole shorter item in none; bench_equal is the number of equal tokens in
    such a window, the most of all items. Case and punctuation don't count. An item without an id
    contaminates too but isn't named; items without tokens match nothing. Null texts overlap with nothing,
    nor does anything with an empty benchmark; all rows stay, repeated ones too; columns named as ours are
    replaced. Texts are compared whole. Each block of a large benchmark takes a pass over the texts.
    """
    spark = df.sparkSession
    df = df.drop("bench_items", "bench_equal", "contaminated")
    scratch = Scratch(spark, "bench")
    ra, rb = row_hashes(df)
    docs = df.select(ra.alias("ra"), rb.alias("rb"), F.col(text).cast("string").alias("text"))
    hits = spark.createDataFrame([], "ra long, rb long, item long, equal long")
    for block in _blocks(benchmark, item_text, item_id):
        hits = hits.union(scratch.save(_hits(docs, spark.sparkContext.broadcast(Index(block))), "hits"))
    a, b, items, equal = (unused(df, x) for x in ("ra", "rb", "items", "equal"))
    each = hits.groupBy(F.col("ra").alias(a), F.col("rb").alias(b)).agg(F.sort_array(F.collect_set("item")).alias(items), F.max("equal").alias(equal))
    each = scratch.save(each, "overlaps")
    out = df.withColumns({a: ra, b: rb}).join(small(each), [a, b], "left")
    return out.select(*df.columns, F.coalesce(items, F.array().cast("array<bigint>")).alias("bench_items"), F.coalesce(equal, F.lit(0)).cast("int").alias("bench_equal"), F.col(equal).isNotNull().alias("contaminated"))
