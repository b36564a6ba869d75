"""Self-join of documents on the Jaccard similarity of their word n-gram sets, by vertical partitioning.

N-grams have one global order: those that a sample of documents shows to be frequent come last, the
others go by their 64-bit hashes. The order cuts every set into a first fragment and the rest.

Candidates: two sets of similarity t or more share an n-gram of their first fragments, which hold
n - ceil(t n) + 1 n-grams. Documents meet in a shuffle on those n-grams, and the overlap of two first
fragments, counted there, bounds what two sets can share. A document is first paired with one leader of
its buckets only; pairs across components are made after those links are known.
Verification: the range of hashes is cut into 16 fragments, partial overlaps are counted in each
separately and summed per pair.

Equal sets are one node throughout, whatever the number of copies.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, components, in_slices, row_hashes, short_shuffles, small, unused

#: Fragments that partial overlaps are counted in, as bits of the hash.
FRAGMENT_BITS = 4
#: Longs of a set's bitmaps, a power of two.
WORDS = 8
#: Rows of a bucket from which on overlaps are bounded by document frequencies too before its pairs are made.
BUCKET = 512
#: Rows of open buckets that meet in one pass, with bitmaps of 128 bytes each; more rows take more passes, so the disk holds those of one.
PASS_ROWS = 8_000_000
#: Least document frequencies of the bands that bound overlaps; an n-gram of one document is in none.
BANDS = (2, 4, 8, 16, 64, 256)
#: Words that a worker's table of hashes keeps.
WORDS_KEPT = 100_000
#: Documents whose n-grams are counted for the global order, and most n-grams that it puts last.
#: They decide how large buckets become, never what is linked.
ORDER_DOCS, LATE = 10_000, 131_072


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(word)
        if len(self) < WORDS_KEPT and len(word) <= 32:
            self[word] = h
        return h


_words = _Words()
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingles(text: str | None, n: int = 3) -> np.ndarray:
    """Sorted distinct hashes of the n-word shingles; of fewer words, of the whole sequence.

    Words are runs without ASCII white space, A-Z in lower case.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    w = np.fromiter(map(_words.__getitem__, words), dtype=np.uint64, count=len(words))
    k = min(n, len(w))
    h = w[: len(w) - k + 1] + np.uint64(k)
    for i in range(1, k):
        h = _mixed(h) * _A + w[i : len(w) - k + 1 + i] * _B
    return np.unique(_mixed(h))


def _set_name(s: np.ndarray) -> tuple[int, int]:
    """128 bits that name a set, as two longs."""
    h = np.frombuffer(xxhash.xxh3_128_digest(s.tobytes()), ">i8")
    return int(h[0]), int(h[1])


def _parities(s: np.ndarray) -> np.ndarray:
    """WORDS longs: by a hash's lowest bits, whether the set has an odd number of such hashes.

    Where two sets differ in such a bit, one has a hash that the other lacks.
    """
    odd = np.bincount((s & np.uint64(64 * WORDS - 1)).astype(np.int64), minlength=64 * WORDS) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view("<i8")


def prefix_length(n: int, t: Fraction) -> int:
    """N-grams of a set's first fragment; 0 where only an equal set reaches the threshold."""
    return 0 if n < t / (1 - t) else n + 1 - -(-n * t.numerator // t.denominator)


def _index_length(n: Column, num: int, den: int) -> Column:
    """As prefix_length for the smaller set of a pair, which must share 2t / (1 + t) of itself."""
    return n + 1 - F.ceil(n * F.lit(2 * num) / F.lit(num + den) - 1e-9)


def _late(src: DataFrame, words: int, docs: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """N-grams in three documents or more of a sample: sorted hashes and how late they come (log2 of the count)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in in_slices(batches):
            for x in b.column(0).to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array(shingles(x, words).astype(np.int64))], ["g"])

    n = src.count()
    sample = src.select("text").sample(min(1.0, docs / n), seed=7) if n else src.select("text")
    counts = sample.mapInArrow(run, "g long").groupBy("g").agg(F.count("*").alias("c")).where("c >= 3")
    # Columns, as a Python object a row would take tens of MB of the driver.
    top = counts.orderBy(F.desc("c"), "g").limit(size).toArrow()
    g, c = (top.column(x).to_numpy() for x in ("g", "c"))
    by_hash = np.argsort(g.astype(np.uint64))
    return g[by_hash].astype(np.uint64), np.log2(c[by_hash]).astype(np.int64)


def _in_order(s: np.ndarray, k: int, late: np.ndarray, when: np.ndarray) -> tuple[np.ndarray, int]:
    """The first k hashes of a set in the global order, as longs that sort as the hashes do, and the last one's tier."""
    tier = 0
    if len(late) and k:
        at = np.minimum(np.searchsorted(late, s), len(late) - 1)
        tiers = np.where(late[at] == s, when[at], 0)
        order = np.argsort(tiers, kind="stable")[:k]
        s, tier = s[order], int(tiers[order[-1]])
    return (s[:k] ^ np.uint64(1 << 63)).astype(np.int64), tier


def _bits(prefix: str) -> Column:
    """A bitmap of WORDS longs, a struct b0, b1, ..: n-grams by their lowest bits."""
    word = "aggregate({p}, 0L, (acc, g) -> if((g & {mask}) = {at}, acc | shiftleft(1L, cast(g & 63 as int)), acc)) as b{i}"
    return F.struct(*[F.expr(word.format(p=prefix, mask=64 * (WORDS - 1), at=64 * i, i=i)) for i in range(WORDS)])


def _sets(src: DataFrame, words: int, t: Fraction, late: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """doc_id, ra and rb (hashes of the row), n (size of the set), ha and hb (name of the set), prefix: its first fragment, tier: that of the prefix' last, odd: parities of the whole set."""
    shared = src.sparkSession.sparkContext.broadcast(late)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order = shared.value
        for b in in_slices(batches):
            sizes, names, prefixes, tiers, odd = [], [], [], [], []
            for x in b.column(3).to_pylist():
                s = shingles(x, words)
                sizes.append(len(s))
                names.append(_set_name(s))
                first, tier = _in_order(s, prefix_length(len(s), t), *order)
                prefixes.append(first)
                tiers.append(tier)
                odd.append(_parities(s))
            columns = [b.column(0), b.column(1), b.column(2), pa.array(sizes, pa.int64()), *(pa.array([h[i] for h in names], pa.int64()) for i in (0, 1)), pa.array(prefixes, pa.list_(pa.int64())), pa.array(tiers, pa.int64()), pa.array(odd, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "ra", "rb", "n", "ha", "hb", "prefix", "tier", "odd"])

    return src.select("doc_id", "ra", "rb", "text").mapInArrow(run, "doc_id long, ra long, rb long, n long, ha long, hb long, prefix array<long>, tier long, odd array<long>")


def _segments(df: DataFrame, words: int) -> DataFrame:
    """(a, b, text) -> a, b, frag, seg: the hashes of the text's set that lie in a fragment."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, parts = None, []
        for batch in in_slices(batches):
            out = ([], [], [], [])
            for a, b, x in zip(*(c.to_pylist() for c in batch.columns)):
                if x != last:  # pairs of one text follow one another
                    s = shingles(x, words)
                    cuts = np.searchsorted(s, np.arange(1, 1 << FRAGMENT_BITS, dtype=np.uint64) << np.uint64(64 - FRAGMENT_BITS))
                    last, parts = x, [(f, part.astype(np.int64)) for f, part in enumerate(np.split(s, cuts)) if len(part)]
                for f, part in parts:
                    for column, v in zip(out, (a, b, f, part)):
                        column.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int16()), pa.array(out[3], pa.list_(pa.int64()))], ["a", "b", "frag", "seg"])

    return df.mapInArrow(run, "a long, b long, frag short, seg array<long>")


def _enough(overlap: Column, na: Column, nb: Column, num: int, den: int) -> Column:
    """overlap / union >= num / den, in whole numbers."""
    return den * overlap >= num * (na + nb - overlap)


def _verify(pairs: DataFrame, info: DataFrame, src: DataFrame, words: int, num: int, den: int) -> DataFrame:
    """The pairs (a, na, b, nb), a saved table, that reach the threshold; partial overlaps by fragment, summed per pair.

    The sets are made anew from the texts: that of b travels to a's, once a pair.
    """
    rows = info.select("node", "ra", "rb")

    def sets(need: DataFrame) -> DataFrame:
        return _segments(src.join(small(need), ["ra", "rb"]).select("a", "b", "text"), words)

    right = sets(pairs.select("a", "b").join(rows, F.col("b") == F.col("node")).select("a", "b", "ra", "rb"))
    left = sets(pairs.select("a").distinct().join(rows, F.col("a") == F.col("node")).select("a", F.col("a").alias("b"), "ra", "rb")).select("a", "frag", F.col("seg").alias("x"))
    part = right.join(left, ["a", "frag"]).select("a", "b", "frag", F.size(F.array_intersect("x", "seg")).cast("long").alias("o"))
    # Rows that come repeatedly give the same overlap again.
    total = part.groupBy("a", "b", "frag").agg(F.max("o").alias("o")).groupBy("a", "b").agg(F.sum("o").alias("o"))
    return total.join(pairs, ["a", "b"]).where(_enough(F.col("o"), F.col("na"), F.col("nb"), num, den)).select("a", "b")


def _banded(big: DataFrame, info: DataFrame, src: DataFrame, words: int, num: int, den: int) -> DataFrame:
    """Rows of large buckets with bands, how many n-grams of each document frequency a set has; sets of too many n-grams of their own go.

    Frequencies are counted among the sets of these rows. In no band can two sets share more than the smaller count.
    """
    need = big.select("node").distinct().join(info, "node").select(F.col("node").alias("a"), F.col("node").alias("b"), "ra", "rb")
    grams = _segments(src.join(small(need), ["ra", "rb"]).select("a", "b", "text"), words).select(F.col("a").alias("node"), F.explode("seg").alias("g")).distinct()
    shared = grams.join(grams.groupBy("g").agg(F.count("*").alias("df")).where("df > 1"), "g")
    edges = [*BANDS, None]
    bands = F.array(*[F.count_if((F.col("df") >= lo) & (F.col("df") < hi) if hi else F.col("df") >= lo) for lo, hi in zip(edges, edges[1:])])
    out = big.join(shared.groupBy("node").agg(bands.alias("bands")), "node")
    most = F.aggregate("bands", F.lit(0).cast("long"), lambda x, y: x + y)
    return out.where(_enough(most, most, F.col("n"), num, den))


def _linked(scratch: Scratch, df: DataFrame, threshold: str, words: int, text: str, id_: str) -> tuple[DataFrame, DataFrame]:
    """docs (a row a document: doc_id, ra, rb, n, ha, hb) and nodes (a row a distinct set: ha, hb, root)."""
    t = Fraction(threshold)
    num, den = t.numerator, t.denominator
    ra, rb = row_hashes(df)
    src = df.select(F.col(id_).cast("long").alias("doc_id"), ra.alias("ra"), rb.alias("rb"), F.col(text).cast("string").alias("text"))
    short_shuffles(df.sparkSession)
    sets = scratch.save(_sets(src, words, t, _late(src, words, ORDER_DOCS, LATE)), "sets")
    # Copies meet in partial aggregates; the number of a row in the saved table names its set.
    nodes = sets.where("n > 0").groupBy("ha", "hb").agg(F.count("*").alias("copies"), F.first("n").alias("n"), F.first("prefix").alias("prefix"), F.first("tier").alias("tier"), F.first("odd").alias("odd"), F.min(F.struct("ra", "rb")).alias("row"))
    nodes = scratch.save(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")
    docs = scratch.save(sets.drop("prefix", "tier", "odd"), "docs")
    scratch.drop(sets)

    # Buckets of two nodes or more.
    rows = nodes.select("node", F.posexplode("prefix").alias("pos", "g"))
    buckets = scratch.save(rows.groupBy("g").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).where("lo < hi").select("g"), "grams")
    in_buckets = scratch.save(rows.join(buckets, "g"), "met")
    scratch.drop(buckets)
    # Of each node in a bucket: k n-grams of its first fragment, own of which no other first fragment has, and where it ends.
    info = nodes.join(in_buckets.groupBy("node").agg(F.count("*").alias("m")), "node")
    info = info.select("node", "n", "copies", _bits("prefix").alias("bits"), F.struct(*[F.col("odd")[i].alias(f"b{i}") for i in range(WORDS)]).alias("odd"), F.size("prefix").alias("k"), (F.size("prefix") - F.col("m")).alias("own"), F.struct("tier", F.element_at("prefix", -1)).alias("end"), F.col("row.ra").alias("ra"), F.col("row.rb").alias("rb"))
    info = scratch.save(info, "info")
    names = scratch.save(nodes.select("node", "ha", "hb"), "names")
    scratch.drop(nodes)
    rank = F.struct((-F.col("copies")).alias("r"), F.floor(1000 * F.col("own") / F.col("n")).alias("s"), "node")
    met = scratch.save(in_buckets.join(info.select("node", "n", "own", "end", rank.alias("rank")), "node"), "ranked")
    scratch.drop(in_buckets)

    def bounded(a: str, b: str, common: Column | None) -> Column:
        """Whether two structs of a set can be a pair, with ``common`` n-grams of k in both first fragments, or by own and bits.

        Of the first fragment that ends first, n-grams that the other first fragment lacks are lacking in the other set.
        """
        x, y = (lambda c: F.col(f"{a}.{c}")), (lambda c: F.col(f"{b}.{c}"))
        if common is None:
            lacks = [F.greatest(p("own"), sum((F.bit_count(p(f"bits.b{i}").bitwiseAND(F.bitwise_not(q(f"bits.b{i}")))) for i in range(WORDS)), F.lit(0))) for p, q in ((x, y), (y, x))]
        else:
            lacks = [z("k") - common for z in (x, y)]
        most = F.when(x("end") <= y("end"), x("n") - lacks[0]).otherwise(y("n") - lacks[1])
        return _enough(F.least(most, x("n"), y("n")), x("n"), y("n"), num, den)

    def in_index(a: str, b: str) -> Column:
        """Whether the n-gram of a bucket is among those of which the smaller set of a pair must share one."""
        x, y = (lambda c: F.col(f"{a}.{c}")), (lambda c: F.col(f"{b}.{c}"))
        inside = [z("pos") < _index_length(z("n"), num, den) for z in (x, y)]
        return F.when(x("n") < y("n"), inside[0]).when(x("n") > y("n"), inside[1]).otherwise(inside[0] | inside[1])

    of_set = F.struct("node", "n", "k", "end")

    def counted(pairs: DataFrame) -> DataFrame:
        """(a, b, c: n-grams of both first fragments, index) -> the pairs that can reach the threshold, with sizes."""
        both = pairs.where("index").join(info.select(F.col("node").alias("a"), of_set.alias("x")), "a").join(info.select(F.col("node").alias("b"), of_set.alias("y")), "b")
        return both.where(bounded("x", "y", F.col("c"))).select("a", F.col("x.n").alias("na"), "b", F.col("y.n").alias("nb"))

    # First round: a set and the best leader of its buckets, by the number of copies and the share of n-grams of its own.
    # No other set leads a bucket that holds the two, so what they have in common is counted in full.
    leaders = met.groupBy("g").agg(F.min_by(F.struct("node", "n", "pos", "rank"), "rank").alias("x"))
    led = met.select("g", F.struct("node", "n", "pos").alias("y")).join(leaders, "g")
    led = led.groupBy(F.col("y.node").alias("b"), F.col("x.rank").alias("rank")).agg(F.count("*").alias("c"), F.max(in_index("x", "y")).alias("index"))
    led = led.groupBy("b").agg(F.min(F.struct("rank", "c", "index")).alias("x")).select(F.col("x.rank.node").alias("a"), "b", F.col("x.c").alias("c"), F.col("x.index").alias("index"))
    tried = scratch.save(counted(led.where("a <> b")), "pairs")
    first = scratch.save(_verify(tried, info, src, words, num, den), "links")
    roots = scratch.save(components(scratch, first), "roots")

    # Second round: pairs of a bucket that no path joins yet. Sets of a bucket's most frequent component need no pairs
    # among themselves, so they are on one side only. A bit that only one first fragment has is an n-gram that the other lacks.
    at = met.drop("rank").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    of_root = at.groupBy("g", "root").agg(F.count("*").alias("c"), F.min("node").alias("node")).groupBy("g")
    most = of_root.agg(F.max(F.struct("c", "root")).alias("m"), F.sum("c").alias("rows"), F.count("*").alias("roots")).where("roots > 1").select("g", "rows", F.col("m.root").alias("major"))
    # A set's n-grams in these buckets, in their order: the one before, the one after and the number of each. All others of
    # its first fragment are its own, as sets of other roots lack them.
    in_set = Window.partitionBy("node").orderBy("pos")
    at = at.drop("own").join(most, "g").withColumns({"before": F.lag("g").over(in_set), "after": F.lead("g").over(in_set), "nth": F.row_number().over(in_set), "open": F.count("*").over(Window.partitionBy("node"))})
    opened = scratch.save(at.join(info.select("node", "k"), "node").withColumn("own", F.col("k") - F.col("open")).drop("k", "open"), "open")
    scratch.drop(met)
    passes = max(1, -(-opened.count() // PASS_ROWS))
    no_bands = F.lit(None).cast("array<bigint>").alias("bands")
    at = opened.where(F.col("rows") <= BUCKET).withColumn("bands", no_bands).unionByName(_banded(opened.where(F.col("rows") > BUCKET), info, src, words, num, den))
    at = scratch.save(at.withColumn("pass", F.pmod(F.xxhash64("g"), F.lit(passes)).cast("int")), "bounded", by="pass")
    scratch.drop(opened)
    fields = F.struct("node", "n", "pos", "own", "end", "root", "bits", "odd", "bands", "before", "after", "nth")
    by_position = F.least("x.pos", "y.pos") + F.least(F.col("x.n") - F.col("x.pos"), F.col("y.n") - F.col("y.pos"))
    by_band = F.aggregate(F.zip_with("x.bands", "y.bands", lambda p, q: F.least(p, q)), F.lit(0).cast("long"), lambda p, q: p + q)
    # Bits of parity that differ are n-grams of one set only, of the whole sets.
    differ = sum((F.bit_count(F.col(f"x.odd.b{i}").bitwiseXOR(F.col(f"y.odd.b{i}"))) for i in range(WORDS)), F.lit(0))
    by_parity = F.floor((F.col("x.n") + F.col("y.n") - differ) / 2)
    can = _enough(F.least(by_parity, by_position, F.coalesce(by_band, by_position)), F.col("x.n"), F.col("y.n"), num, den) & bounded("x", "y", None)
    # N-grams that follow one another in both sets are a run; a pair is made at a run's first and last n-gram only. The
    # numbers of these give the run's length. All that two sets of different roots share is in these buckets, so none is left out.
    starts, ends = F.coalesce(F.col("x.before") != F.col("y.before"), F.lit(True)), F.coalesce(F.col("x.after") != F.col("y.after"), F.lit(True))
    nth = F.when(F.col("x.node") < F.col("y.node"), F.col("x.nth")).otherwise(F.col("y.nth"))
    length = F.when(ends, nth + 1).otherwise(0) - F.when(starts, nth).otherwise(0)

    def crossed(part: DataFrame) -> DataFrame:
        """(a, b, c, index) of the pairs of some buckets; bitmaps come to the rows here, as most tables of rows needn't hold them."""
        part = part.join(info.select("node", "bits", "odd"), "node")
        x = part.where("root <> major").select("g", fields.alias("x"))
        y = part.select("g", (F.col("root") == F.col("major")).alias("big"), fields.alias("y"))
        cross = x.join(y, "g").where((F.col("x.root") != F.col("y.root")) & (F.col("big") | (F.col("x.node") < F.col("y.node"))) & (starts | ends) & can)
        return cross.groupBy(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b")).agg(F.sum(length).alias("c"), F.max(in_index("x", "y")).alias("index"))

    cross = crossed(at)
    if passes > 1:
        each = [scratch.save(crossed(at.where(F.col("pass") == i)), "cross") for i in range(passes)]
        cross = reduce(DataFrame.union, each).groupBy("a", "b").agg(F.sum("c").alias("c"), F.max("index").alias("index"))
    known = tried.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    second = scratch.save(counted(cross).join(known, ["a", "b"], "left_anti"), "pairs")
    second = scratch.save(_verify(second, info, src, words, num, den), "links")
    if second.limit(1).count():
        roots = scratch.save(components(scratch, first.union(second)), "roots")
    for done in (info, at, tried):
        scratch.drop(done)
    return docs, names.join(roots, "node", "left").select("ha", "hb", F.coalesce("root", "node").alias("root"))


def jaccard_components(df: DataFrame, threshold: str = "0.9", words: int = 3, text: str = "text", id_: str = "doc_id") -> DataFrame:
    """Documents whose shingle sets are linked by Jaccard similarity >= threshold (below 1); one row a document.

    Returns doc_id, n_shingles and component_id, the smallest doc_id reachable by links, itself
    included. No link is missed. Null texts and texts without words have an empty set and link with
    nothing; equal sets always link; rows of the same id, or without one, are documents of their own;
    a null id is never the smallest of others. An empty table gives no rows. Sets are told apart by
    128-bit hashes, their n-grams by 64-bit ones.
    """
    docs, nodes = _linked(Scratch(df.sparkSession, "ngram"), df.select(id_, text), threshold, words, text, id_)
    # By set first, so that copies don't meet in one group; then each document looks up its set.
    per = docs.where("n > 0").groupBy("ha", "hb").agg(F.min("doc_id").alias("first")).join(nodes, ["ha", "hb"])
    known = per.join(per.groupBy("root").agg(F.min("first").alias("least")), "root").select("ha", "hb", "least")
    out = docs.withColumns({c: F.when(F.col("n") > 0, F.col(c)) for c in ("ha", "hb")}).join(known, ["ha", "hb"], "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("least", "doc_id").alias("component_id"))


def keep_one(df: DataFrame, threshold: str = "0.8", words: int = 5, text: str = "text", id_: str = "doc_id") -> DataFrame:
    """One row of each group of linked documents, that of the smallest id; columns as they are.

    Rows go by themselves and not by their id: of rows that share an id only those whose text is linked
    with that of a kept row go, and so do rows without an id. Of wholly equal rows with words one stays;
    of other rows with the same id and text the one with the smaller hash. Documents without words all stay.
    """
    scratch = Scratch(df.sparkSession, "keep")
    docs, nodes = _linked(scratch, df, threshold, words, text, id_)
    rank = F.struct(F.col("doc_id").isNull().alias("z"), "doc_id", "ra", "rb")
    per = docs.where("n > 0").groupBy("ha", "hb").agg(F.min(rank).alias("first")).join(nodes, ["ha", "hb"])
    known = per.join(per.groupBy("root").agg(F.min("first").alias("least")), "root").select("ha", "hb", F.col("least.ra").alias("la"), F.col("least.rb").alias("lb"))
    # Each different row with how often it comes, and whether it is the one to keep.
    each = docs.where("n > 0").groupBy("ha", "hb", "ra", "rb").agg(F.count("*").alias("c")).join(known, ["ha", "hb"])
    stays = (F.col("ra") == F.col("la")) & (F.col("rb") == F.col("lb"))
    each = scratch.save(each.select("ra", "rb", "c", stays.alias("stays")).where("not stays or c > 1"), "rows")
    a, b = unused(df, "ra"), unused(df, "rb")
    hashed = df.withColumns(dict(zip((a, b), row_hashes(df))))

    def these(condition: str) -> DataFrame:
        return small(each.where(condition).select(F.col("ra").alias(a), F.col("rb").alias(b)))

    single = hashed.join(these("true"), [a, b], "left_anti")
    repeated = hashed.join(these("stays"), [a, b], "left_semi").dropDuplicates([a, b])
    return single.union(repeated).select(*df.columns)
