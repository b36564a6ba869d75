"""The trie of conversations' prefixes, by a sparse-table range minimum over sorted longest common prefixes.

A conversation is a sequence of turns; each turn is the first 16 bytes of a SHA-256 of its role and text,
followed by its text's bytes as a long, so that byte order puts equal prefixes side by side. Equal sequences
are one class. Classes are sorted once, by a range exchange, and each partition of the result keeps what every
class has in common with the one before it (its LCP).

A node is the interval of classes that share d turns. Each border between two classes, with its LCP as d, is a
candidate: it binary-searches its left and right extent independently, in a sparse table of range minima, without
any stack. Borders with the same extents are one branching node; the chain of depths above it has the same
members. All columns are prefix sums or range minima over the interval. Intervals that leave a partition are
summed from one partial row for each partition, depth and border: their left end is found by the same search
over the partitions' minima, which are a few longs each.

Rows: null roles and texts count as empty, turns go by number (null first, equal ones by the hash of role and text),
rows without a conv_id belong to no conversation. A conversation's hashes (24 bytes a turn) have to fit a row.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, small

#: Bytes of a turn in a sequence: its hash and its text's length.
TURN = 24
#: Bytes of sequences in a sorted partition, about, and most partitions.
PART_BYTES, PARTS = 16_000_000, 8192
#: Ids of one class that are joined to one text before they are hashed.
CHUNK = 256

EMPTY = hashlib.sha256(b"").hexdigest()


def sequences(turns: DataFrame) -> DataFrame:
    """conv_id, seq: the turns (role, text) of every conversation in order, TURN bytes each."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    name = F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256)
    one = F.unhex(F.concat(F.substring(name, 1, 32), F.lpad(F.hex(F.octet_length(text).cast("long")), 16, "0")))
    listed = turns.where("conv_id is not null").select("conv_id", F.struct("turn", one.alias("e")).alias("t")).groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("t"))
    return listed.select("conv_id", F.concat(F.lit(b""), F.aggregate("t", F.lit(b""), lambda acc, x: F.concat(acc, x["e"]))).alias("seq"))


def graft(convs: DataFrame, every: int = 5, most: int = 9) -> DataFrame:
    """conv_id, seq: the first h turns of conversation c - c % every, then c's own after its first h; h = crc32(c) % most."""
    base = F.col("conv_id") - F.col("conv_id") % every
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % most * TURN).cast("int")
    group = Window.partitionBy("_base")
    named = convs.withColumn("_base", base).withColumn("_head", F.max(F.when(F.col("conv_id") == F.col("_base"), F.col("seq"))).over(group))
    head = F.coalesce(F.substring("_head", F.lit(1), h), F.lit(b""))
    return named.select("conv_id", F.concat(head, F.substring("seq", h + 1, F.length("seq"))).alias("seq"))


def _id_hashes(members: DataFrame) -> DataFrame:
    """k, ends: SHA-256 of the ascending conv_ids of each class, comma-joined.

    Ids of one class meet in texts of at most CHUNK ids; these are hashed one after another, as the
    function is sequential: of a class only one such text is in memory.
    """
    bucket = F.floor(F.col("conv_id") / CHUNK)
    chunks = members.groupBy("k", bucket.alias("at")).agg(F.array_join(F.sort_array(F.collect_list("conv_id")), ",").alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, state = None, None
        for b in batches:
            keys, ends = [], []
            for k, ids in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if k != last:
                    if state is not None:
                        keys.append(last)
                        ends.append(state.hexdigest())
                    last, state = k, hashlib.sha256(ids.encode())
                else:
                    state.update(b"," + ids.encode())
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(ends, pa.string())], ["k", "ends"])
        if state is not None:
            yield pa.RecordBatch.from_arrays([pa.array([last], pa.binary()), pa.array([state.hexdigest()])], ["k", "ends"])

    return chunks.repartition("k").sortWithinPartitions("k", "at").select("k", "ids").mapInArrow(run, "k binary, ends string")


def _common(a: bytes, b: bytes) -> int:
    """Turns that two sequences have in common at their start."""
    low, high = 0, min(len(a), len(b)) // TURN
    while low < high:
        mid = (low + high + 1) // 2
        if a[low * TURN : mid * TURN] == b[low * TURN : mid * TURN]:
            low = mid
        else:
            high = mid - 1
    return low


def _with_lcp(classes: DataFrame, parts: int) -> DataFrame:
    """Classes in order: part, idx (from 0 in a part), lcp with the one before (null for the first), lens, n, low, ends, edge (seq of a part's first and last)."""
    names = ["part", "idx", "lcp", "lens", "n", "low", "ends", "edge"]
    kinds = [pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.string(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

        held, idx = None, 0  # the last row waits, as it may be the part's last
        for b in batches:
            rows = []
            for part, seq, n, low, ends in zip(*(c.to_pylist() for c in b.columns)):
                lens = np.frombuffer(seq, ">i8").reshape(-1, 3)[:, 2].astype("<i8").tobytes()
                if held is None:
                    lcp = None
                else:
                    lcp = _common(held[1], seq)
                    rows.append((*held[0], held[1] if idx == 1 else None))
                held = ((part, idx, lcp, lens, n, low, ends), seq)
                idx += 1
            if rows:
                yield made(rows)
        if held:
            yield made([(*held[0], held[1])])

    spread = classes.repartitionByRange(parts, "seq").sortWithinPartitions("seq").select(F.spark_partition_id().alias("part"), "seq", "n", "low", "ends")
    return spread.mapInArrow(run, "part int, idx long, lcp long, lens binary, n long, low long, ends string, edge binary")


def _borders(rows: DataFrame) -> np.ndarray:
    """Of each part in order: its number, the LCP of its first class with the part before (-1: none before), the least LCP inside."""
    edges = rows.where("edge is not null").groupBy("part").agg(F.min_by("edge", "idx").alias("first"), F.max_by("edge", "idx").alias("last"))
    pairs = edges.withColumn("before", F.lag("last").over(Window.orderBy("part"))).select("part", "first", "before")  # a row a part

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lcp = [-1 if x is None else _common(x, y) for x, y in zip(b.column(2).to_pylist(), b.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(lcp, pa.int64())], ["part", "border"])

    least = rows.groupBy("part").agg(F.min("lcp").alias("least"))
    got = pairs.mapInArrow(run, "part int, border long").join(least, "part").collect()  # three numbers for each of at most PARTS parts
    far = np.iinfo(np.int64).max
    return np.array(sorted((r.part, r.border, far if r.least is None else r.least) for r in got), dtype=np.int64).reshape(-1, 3)


class RangeMin:
    """Sparse table: level k holds the minima of 2^k neighbours."""

    def __init__(self, values: np.ndarray):
        self.levels = [values]
        while (half := 1 << len(self.levels) - 1) * 2 <= len(values):
            before = self.levels[-1]
            self.levels.append(np.minimum(before[:-half], before[half:]))

    def right(self, at: np.ndarray, d: np.ndarray) -> np.ndarray:
        """The first index from `at` on whose value is below d; the length if none."""
        at, size = at.copy(), len(self.levels[0])
        for k in range(len(self.levels) - 1, -1, -1):
            ok = at + (1 << k) <= size
            ok[ok] = self.levels[k][at[ok]] >= d[ok]
            at[ok] += 1 << k
        return at

    def left(self, at: np.ndarray, d: np.ndarray) -> np.ndarray:
        """The last index up to `at` whose value is below d; -1 if none."""
        at = at + 1
        for k in range(len(self.levels) - 1, -1, -1):
            ok = at >= 1 << k
            ok[ok] = self.levels[k][at[ok] - (1 << k)] >= d[ok]
            at[ok] -= 1 << k
        return at - 1

    def least(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Minima over start <= i < end."""
        k = np.frexp((end - start).astype(np.float64))[1] - 1
        out = np.empty(len(start), dtype=np.int64)
        for level in np.unique(k):
            at = k == level
            row = self.levels[level]
            out[at] = np.minimum(row[start[at]], row[end[at] - (1 << int(level))])
        return out


_NODE = {"whole": pa.bool_(), "lpart": pa.int64(), "depth": pa.int64(), "conv_id": pa.int64(), "parent_conv_id": pa.int64(), "plpart": pa.int64(), "n_convs": pa.int64(), "n_children": pa.int64(), "n_leaves": pa.int64(), "w": pa.int64(), "u": pa.int64(), "prev": pa.int64(), "ends": pa.string()}
_NODE_SQL = ", ".join(f"{k} {'boolean' if v == pa.bool_() else 'string' if v == pa.string() else 'long'}" for k, v in _NODE.items())


def _part_nodes(t: pa.Table, at: int, lcps: tuple[int, int], over_parts: RangeMin) -> list[dict]:
    """Nodes inside a part, and its pieces of nodes that other parts share. lcps: with the part before and after (-1: none)."""
    t = t.sort_by("idx")
    m = t.num_rows
    lens = t.column("lens").to_pylist()
    turns = np.array([len(x) // 8 for x in lens], dtype=np.int64)
    # Bytes up to each turn of each class, from 0.
    start = np.concatenate([[0], np.cumsum(turns + 1)])[:-1]
    flat = np.zeros(int((turns + 1).sum()), dtype=np.int64)
    inside = np.ones(len(flat), dtype=bool)
    inside[start] = False
    flat[inside] = np.frombuffer(b"".join(lens), "<i8")
    total = np.cumsum(flat)
    upto = total - np.repeat(total[start], turns + 1)
    lcp = np.empty(m + 1, dtype=np.int64)
    lcp[1:m] = t.column("lcp").to_numpy()[1:]
    lcp[0], lcp[m] = lcps
    n, low, ends = t.column("n").to_numpy(), t.column("low").to_numpy(), np.array(t.column("ends").to_pylist(), dtype=object)
    whole = upto[start + turns]

    def sums(x: np.ndarray) -> np.ndarray:
        return np.concatenate([[0], np.cumsum(x)])

    s_n, s_leaf = sums(n), sums(lcp[1:] < turns)
    s_w, s_u = sums(n * whole), sums(whole - upto[start + np.maximum(lcp[:m], 0)])
    mins, lows = RangeMin(lcp), RangeMin(low)

    def holder(d: np.ndarray, left: np.ndarray) -> np.ndarray:
        """The part where the interval of depth d starts whose extent is `left` here."""
        return np.where(left >= 0, at, over_parts.left(np.full(len(d), at - 1, dtype=np.int64), d))

    # Branching nodes: every border is a candidate and searches both ends.
    j = np.arange(1, m)
    d = lcp[1:m]
    s, e = mins.left(j, d), mins.right(j, d)
    own = (s >= 0) & (e <= m)
    (s, d, e), c = np.unique(np.stack([s[own], d[own], e[own]]), axis=1, return_counts=True)
    # Classes by themselves, below all that they share.
    i = np.arange(m)
    s, e, d = np.concatenate([s, i]), np.concatenate([e, i + 1]), np.concatenate([d, turns])
    c = np.concatenate([c, np.zeros(m, dtype=np.int64)]) + (turns[s] > d)
    up = np.maximum(lcp[s], lcp[e])
    keep = d > up
    s, e, d, c, up = (x[keep] for x in (s, e, d, c, up))
    least = lows.least(s, e)
    # The parent of the chain's top.
    l2, r2 = mins.left(s, up), mins.right(s + 1, up)
    here = (l2 >= 0) & (r2 <= m)
    parent = np.zeros(len(s), dtype=np.int64)
    parent[here] = lows.least(l2[here], r2[here])
    top_part = holder(up, l2)
    # Every depth of the chain.
    of = np.repeat(np.arange(len(s)), d - up)
    depth = np.arange(len(of)) - np.repeat(np.cumsum(d - up) - (d - up), d - up) + up[of] + 1
    top, a, b = depth == up[of] + 1, s[of], e[of]
    prev = upto[start[a] + np.maximum(depth - 1, 0)]
    members = s_n[b] - s_n[a]
    away, root = top & ~here[of], top & (up[of] < 0)
    saved = s_w[b] - s_w[a] - members * prev - (s_u[b] - s_u[a + 1] + whole[a] - prev)
    nothing = np.zeros(len(of), dtype=np.int64)
    local = {
        "whole": np.ones(len(of), dtype=bool), "lpart": nothing, "depth": depth, "conv_id": least[of], "parent_conv_id": pa.array(np.where(top, parent[of], least[of]), mask=away | root),
        "plpart": pa.array(top_part[of], mask=~away | root), "n_convs": members, "n_children": np.where(depth == d[of], c[of], 1), "n_leaves": s_leaf[b] - s_leaf[a], "w": saved, "u": nothing, "prev": nothing,
        "ends": pa.array(np.where(turns[a] == depth, ends[a], EMPTY), pa.string()),
    }

    # Pieces of nodes over several parts: those that reach the left border, and those that start here and leave on the right.
    by_value = np.sort(lcp[:m] * (m + 1) + np.arange(m))

    def borders(d: np.ndarray, first: np.ndarray, end: np.ndarray) -> np.ndarray:
        return np.maximum(np.searchsorted(by_value, d * (m + 1) + end) - np.searchsorted(by_value, d * (m + 1) + first), 0)

    out = [local]
    if lcps[0] >= 0:
        d = np.arange(lcps[0] + 1)
        zero = np.zeros(len(d), dtype=np.int64)
        e = np.minimum(mins.right(zero, d), m)
        out.append({"whole": zero > 0, "lpart": holder(d, zero - 1), "depth": d, "conv_id": lows.least(zero, e), "parent_conv_id": zero, "plpart": pa.nulls(len(d), pa.int64()), "n_convs": s_n[e], "n_children": borders(d, zero, e), "n_leaves": s_leaf[e], "w": s_w[e], "u": s_u[e], "prev": zero, "ends": pa.nulls(len(d), pa.string())})
    if lcps[1] >= 0:
        d = np.arange(lcps[1] + 1)
        s = mins.left(np.full(len(d), m), d)
        d, s = d[s >= 0], s[s >= 0]
        end, zero = np.full(len(d), m), np.zeros(len(d), dtype=np.int64)
        out.append({
            "whole": zero > 0, "lpart": zero + at, "depth": d, "conv_id": lows.least(s, end), "parent_conv_id": zero, "plpart": pa.array(holder(d - 1, mins.left(end, d - 1)), mask=d == 0), "n_convs": s_n[m] - s_n[s], "n_children": borders(d, s + 1, end) + (turns[s] > d),
            "n_leaves": s_leaf[m] - s_leaf[s], "w": s_w[m] - s_w[s], "u": s_u[m] - s_u[s + 1] + whole[s], "prev": upto[start[s] + np.maximum(d - 1, 0)], "ends": pa.array(np.where(turns[s] == d, ends[s], EMPTY), pa.string()),
        })
    return out


def trie(convs: DataFrame, part_bytes: int = PART_BYTES) -> DataFrame:
    """One row per distinct prefix of the sequences (conv_id, seq): the node's depth, members, children, leaves, savings, ends.

    conv_id (smallest member), depth, parent_conv_id (null for the root), n_convs, n_children, n_leaves, saved_tokens,
    ends_sha256. Without conversations there is no node.
    """
    spark = convs.sparkSession
    scratch = Scratch(spark, "trie")
    members = scratch.save(convs.select("conv_id", "seq", F.unhex(F.substring(F.sha2("seq", 256), 1, 32)).alias("k")), "members")
    classes = members.groupBy("k").agg(F.first("seq").alias("seq"), F.count("*").alias("n"), F.min("conv_id").alias("low"))
    classes = scratch.save(classes.join(_id_hashes(members.select("k", "conv_id")), "k").drop("k"), "classes")
    size = classes.agg(F.sum(F.length("seq") + 100)).first()[0] or 0
    rows = scratch.save(_with_lcp(classes, int(min(PARTS, 1 + size // part_bytes))), "sorted")
    borders = _borders(rows)
    numbers = {int(p): i for i, p in enumerate(borders[:, 0])}
    before = borders[:, 1]
    after = np.append(before[1:], -1)
    over = RangeMin(np.minimum(before, borders[:, 2]))

    def run(key: tuple, t: pa.Table) -> pa.Table:
        at = numbers[key[0].as_py()]
        tables = [pa.table({k: x if isinstance(x := r[k], pa.Array) else pa.array(x, kind) for k, kind in _NODE.items()}) for r in _part_nodes(t, at, (int(before[at]), int(after[at])), over)]
        return pa.concat_tables(tables)

    nodes = scratch.save(rows.select("part", "idx", "lcp", "lens", "n", "low", "ends").groupBy("part").applyInArrow(run, _NODE_SQL), "nodes")
    wide = nodes.where("not whole").groupBy("lpart", "depth").agg(
        F.min("conv_id").alias("conv_id"), F.max("plpart").alias("plpart"), *[F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "w", "u")], F.max("prev").alias("prev"), F.max("ends").alias("ends")
    )
    wide = scratch.save(wide.withColumn("parent_conv_id", F.lit(None).cast("long")), "wide")
    up = small(wide.select(F.col("lpart").alias("plpart"), (F.col("depth") + 1).alias("depth"), F.col("conv_id").alias("_parent")))
    saved = F.col("w") - F.col("n_convs") * F.col("prev") - (F.col("u") - F.col("prev"))
    columns = ["conv_id", "depth", "parent_conv_id", "plpart", "n_convs", "n_children", "n_leaves"]
    every = nodes.where("whole").select(*columns, F.col("w").alias("saved_tokens"), "ends").unionByName(wide.select(*columns, saved.alias("saved_tokens"), "ends"))
    # Few nodes have a parent in another part's interval; the others don't meet the join.
    far = every.where("plpart is not null").join(up, ["plpart", "depth"], "left").withColumn("parent_conv_id", F.col("_parent"))
    final = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.col("ends").alias("ends_sha256")]
    return every.where("plpart is null").select(*final).union(far.select(*final))
