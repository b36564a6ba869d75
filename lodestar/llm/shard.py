"""Sharding by histogram sort.

Rows are ordered by a 63-bit key: the CRC-32 of the text above 31 bits of a hash of the id (and of a
number, for many rows of one text and id), so that equal texts are neighbours yet a group of copies of any
size can be cut. Boundaries between shards are
found by counting exact bytes below candidate keys: each round splits the brackets around unsettled
boundaries into probes, in one aggregate over keys and sizes, until a boundary is within tolerance of
its target or its bracket holds a single key. Then rows are exchanged once, by shard and key prefix:
prefixes are long enough that none holds more than a task can sort, and no task holds a whole shard.
"""

from __future__ import annotations

from bisect import bisect_right

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.search import cuts_below
from .common import Scratch, small, unused

#: Probes of a round, over all open brackets (twice as many at most), and bits that a round resolves at most.
PROBES, STEP = 65_536, 12
#: Bits of the whole key.
BITS = 63
#: Prefixes of the key that may be too heavy at one length; a part is made larger rather than have more.
HEAVY = 500_000


def text_size(text: Column) -> Column:
    """UTF-8 bytes of the text (null: none) plus 1."""
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long")


def sort_key(text: Column, id_: Column, *more: Column) -> Column:
    return F.shiftleft(F.coalesce(F.crc32(F.encode(text, "UTF-8")), F.lit(0)).cast("long"), 31) + F.pmod(F.xxhash64(id_, *more), F.lit(1 << 31))


def _numbered(rows: DataFrame, key: str, name: str) -> DataFrame:
    """Adds a number from 0 to the rows of each key: a saved table's rows in the order that it is read.

    Rows are numbered within the pieces that the table is read in; only counts by piece meet by key.
    """
    piece, at, before = (unused(rows, x) for x in ("piece", "at", "before"))
    rows = rows.withColumns({piece: F.spark_partition_id(), at: F.monotonically_increasing_id()})
    along = Window.partitionBy(key).orderBy(piece).rowsBetween(Window.unboundedPreceding, -1)
    counts = rows.groupBy(key, piece).count().select(key, piece, F.coalesce(F.sum("count").over(along), F.lit(0)).alias(before))
    inside = F.row_number().over(Window.partitionBy(key, piece).orderBy(at))
    return rows.withColumn(name, inside.cast("long")).join(counts, [key, piece]).withColumn(name, F.col(name) - 1 + F.col(before)).drop(piece, at, before)


def splitters(keys: DataFrame, parts: int, tolerance: float) -> list[int]:
    """``parts - 1`` ascending keys: part i holds the keys from splitter i-1 up to, not including, splitter i.

    ``keys`` has key and size. What the driver gets a round is one sum per probe that holds rows, in
    the brackets of unsettled boundaries: about PROBES numbers, whatever the number of rows.
    """
    total = keys.agg(F.sum("size")).first()[0] or 0
    goals = [total * i / parts for i in range(1, parts)]
    slack = tolerance * total / parts
    found: dict[int, int] = {}
    #: By prefix: the bytes below it and the boundaries that lie inside.
    open_ = {0: (0, list(range(parts - 1)))}
    shift = BITS
    while open_ and total:
        width = min(STEP, shift, max(1, (PROBES // len(open_)).bit_length() - 1))
        shift -= width
        inside = keys if shift + width >= BITS else keys.where(F.shiftright("key", shift + width).isin(*open_))
        sums: dict[int, list[tuple[int, int]]] = {}
        for probe, n in sorted(inside.groupBy(F.shiftright("key", shift).alias("p")).agg(F.sum("size")).collect()):
            sums.setdefault(probe >> width, []).append((probe, n))
        nxt: dict[int, tuple[int, list[int]]] = {}
        for prefix, (below, todo) in open_.items():
            at, edges = below, []
            for probe, n in sums.get(prefix, []):
                edges.append((at, probe, n))
                at += n
            starts = [x[0] for x in edges]
            for i in todo:
                start, probe, n = edges[max(0, bisect_right(starts, goals[i]) - 1)]
                low, high = goals[i] - start, start + n - goals[i]
                if min(low, high) <= slack or not shift:
                    found[i] = (probe if low <= high else probe + 1) << shift
                else:
                    nxt.setdefault(probe, (start, []))[1].append(i)
        open_ = nxt
    return sorted(min(found[i], (1 << BITS) - 1) for i in range(parts - 1)) if total else []


def _limit(total: int, part_bytes: int) -> int:
    """Bytes of a part: more than asked for only where there would be more than HEAVY parts."""
    return max(part_bytes, total // HEAVY)


def _leaves(scratch: Scratch, keys: DataFrame, total: int, part_bytes: int):
    """A function that adds to rows the first key of the prefix that they are sorted in.

    Prefixes are as long as evenly spread keys need; those of more than ``part_bytes`` are cut further,
    round by round. Heavy prefixes are at most HEAVY a round, by their weight, so they are broadcast.
    """
    limit = _limit(total, part_bytes)
    shift = BITS - min(BITS, (4 * total // limit).bit_length())
    levels = []

    def add(rows: DataFrame, key: str, name: str) -> DataFrame:
        first = lambda by: F.shiftleft(F.shiftright(key, by), by)
        rows = rows.withColumn(name, first(start))
        for by, heavy in levels:
            h = unused(rows, "heavy")
            rows = rows.join(F.broadcast(heavy.withColumnRenamed("leaf", h)), F.col(name) == F.col(h), "left").withColumn(name, F.when(F.col(h).isNotNull(), first(by)).otherwise(F.col(name))).drop(h)
        return rows

    start = shift
    while shift:
        shift = max(0, shift - STEP)
        heavy = scratch.save(add(keys, "key", "leaf").groupBy("leaf").agg(F.sum("size").alias("b"), F.min("key").alias("lo"), F.max("key").alias("hi")).where((F.col("b") > limit) & (F.col("lo") < F.col("hi"))).select("leaf"), "heavy")
        if not heavy.limit(1).count():
            break
        levels.append((shift, heavy))
    return add


def shard(df: DataFrame, shards: int = 16, text: str = "text", id_: str = "doc_id", part_bytes: int = 128 << 20, tolerance: float = 0.001) -> DataFrame:
    """Deal rows into shards of near equal bytes; adds size, text_crc32, law, shard, slot and grown_shard.

    Law ``bytes``: each shard's sizes sum to within ``tolerance`` of a shard on either side of equal,
    or as near as the cut between two rows allows. A shard is sorted by key in parts of at most about
    ``part_bytes``, so no task holds a whole shard; slots are gapless from 0 in key order. Equal texts
    share a shard unless a boundary falls inside their group. Null texts have size 1 and CRC 0; null
    ids hash as nulls. Rows with the same text and id have the same key; where they weigh more than a
    boundary's tolerance they are numbered and the number is hashed too, so that any number of copies
    without an id is cut like others. Which of such rows goes where depends on the table's order; if
    they are equal in all columns, the result doesn't. An empty table gives an empty result. Columns
    named as ours are replaced.
    """
    df = df.drop("size", "text_crc32", "law", "shard", "slot", "grown_shard")
    scratch = Scratch(df.sparkSession, "shard")
    # The checksum comes before the exchange, so that a query without the text doesn't carry it along.
    crc = F.coalesce(F.crc32(F.encode(text, "UTF-8")), F.lit(0)).cast("long")
    key, leaf, before = unused(df, "key"), unused(df, "leaf"), unused(df, "before")
    keyed = df.withColumns({"size": text_size(F.col(text)), "text_crc32": crc, key: sort_key(F.col(text), F.col(id_))})
    # Keys and sizes only, kept as a table, so that probing reads no text.
    keys = scratch.save(keyed.select(F.col(key).alias("key"), "size"), "keys")
    total = keys.agg(F.sum("size")).first()[0] or 0
    # Keys of several rows that weigh more than a boundary's tolerance or a part: at most shards / tolerance or HEAVY.
    most = min(tolerance * total / shards, _limit(total, part_bytes))
    tied = scratch.save(keys.groupBy("key").agg(F.sum("size").alias("b"), F.count("*").alias("n")).where((F.col("n") > 1) & (F.col("b") > most)).select(F.col("key").alias(key)), "tied")
    if tied.limit(1).count():
        same = scratch.save(keyed.join(small(tied), key, "left_semi"), "same")
        number = unused(keyed, "number")
        again = _numbered(same, key, number)
        again = again.withColumn(key, sort_key(F.col(text), F.col(id_), F.col(number))).select(*keyed.columns)
        keyed = keyed.join(small(tied), key, "left_anti").select(*keyed.columns).union(again)
        keys = scratch.save(keyed.select(F.col(key).alias("key"), "size"), "keys")
    cuts = splitters(keys, shards, tolerance)
    add = _leaves(scratch, keys, total, part_bytes)
    parts = add(keys, "key", "leaf").groupBy(cuts_below(F.col("key"), cuts).alias("shard"), "leaf").count()
    rows_before = F.sum("count").over(Window.partitionBy("shard").orderBy("leaf").rowsBetween(Window.unboundedPreceding, -1))
    parts = scratch.save(parts.select("shard", F.col("leaf").alias(leaf), F.coalesce(rows_before, F.lit(0)).alias(before)), "parts")
    rows = add(keyed, key, leaf).withColumn("shard", cuts_below(F.col(key), cuts))
    w = Window.partitionBy("shard", leaf).orderBy(key, id_)
    out = rows.join(small(parts), ["shard", leaf]).withColumn("slot", F.row_number().over(w).cast("long") - 1 + F.col(before))
    return out.select(*df.columns, "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
