"""Streaming operators with state of their own and event-time timers: retention, and promotion to the first bar.

The session needs a state store that keeps columns apart (RocksDB), see with_state_store().
"""

from __future__ import annotations

import datetime
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: Parts that one (issuer, day, source) is held in, so that a busy one is no single task's; each costs a row of state a rollup.
SALTS = 4
#: Parts of a day's issuers and sources. All of a day expires at once, so a key is a part of a day and few keys come to Python.
PARTS = 16
_STORE = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_DAY_MS = 86_400_000


def with_state_store(spark: SparkSession) -> None:
    """State with timers is kept in RocksDB; a store that the session already names stays if it is that."""
    if spark.conf.get(_STORE, "") != _ROCKS:
        spark.conf.set(_STORE, _ROCKS)


def _millis(day: datetime.date) -> int:
    return (day - datetime.date(1970, 1, 1)).days * _DAY_MS


class _Retention(StatefulProcessor):
    """Holds a part of a day's mentions and rollups; its timer fires when they are too old, and those go whose issuer and source are also rolled up."""

    def __init__(self, days: int):
        self.days = days

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getListState("held", "issuer string, source string, mention_id long")
        self.rolled = handle.getListState("rolled", "issuer string, source string")
        self.expired = handle.getValueState("expired", "expired boolean")

    def _leave(self) -> Iterator[pd.DataFrame]:
        held, rolled = [tuple(x) for x in self.held.get()], {tuple(x) for x in self.rolled.get()}
        left = [x for x in held if x[0] and x[:2] not in rolled]
        if len(left) < len(held):
            self.held.put(left) if left else self.held.clear()
            yield pd.DataFrame({"mention_id": [x[2] for x in held if not x[0] or x[:2] in rolled]})

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        new, marks, first = [], set(), not self.held.exists()
        for x in rows:
            m, r = x[~x["mark"]], x[x["mark"]]
            new += zip(m["issuer"].tolist(), m["source"].tolist(), m["mention_id"].tolist())
            marks.update(zip(r["issuer"].tolist(), r["source"].tolist()))
        if new:
            self.held.appendList(new)
        if marks:
            marks -= {tuple(x) for x in self.rolled.get()}
        if marks:
            self.rolled.appendList(sorted(marks))
        if self.expired.exists():
            yield from self._leave()
        elif new and first:
            self.handle.registerTimer(_millis(key[0]) + (self.days + 1) * _DAY_MS)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.expired.update((True,))
        yield from self._leave()

    def close(self) -> None:
        pass


def expired_mentions(mentions: DataFrame, rollups: DataFrame, days: int, late: str = "0 seconds", salts: int = SALTS) -> DataFrame:
    """mention_id of what retention deletes: more than ``days`` days old by the watermark, and its (issuer, day, source)
    rolled up or without an issuer; others are withheld until their day's rollup comes.

    ``mentions``: mention_id, issuer_id, source, posted_at. ``rollups``: issuer_id, source, day, rolled_at. Both are streams.
    """
    with_state_store(mentions.sparkSession)
    # Texts and numbers without nulls, as a null would make a whole batch's numbers floats.
    issuer, source = F.coalesce(F.col("issuer_id").cast("string"), F.lit("")), F.coalesce("source", F.lit(""))
    own = [issuer.alias("issuer"), source.alias("source"), F.pmod(F.xxhash64(issuer, source), F.lit(PARTS)).cast("int").alias("part")]
    m = mentions.where("mention_id is not null").select(*own, F.to_date("posted_at").alias("day"), F.col("mention_id").cast("long").alias("mention_id"), F.lit(False).alias("mark"), F.col("posted_at").alias("at"), F.pmod(F.xxhash64("mention_id"), F.lit(salts)).cast("int").alias("salt"))
    # A mark reaches all salts of its day.
    r = rollups.where("issuer_id is not null").select(*own, "day", F.lit(0).cast("long").alias("mention_id"), F.lit(True).alias("mark"), F.col("rolled_at").alias("at"), F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"))
    both = m.unionByName(r).withWatermark("at", late)
    return both.groupBy("day", "part", "salt").transformWithStateInPandas(_Retention(days), outputStructType="mention_id long", outputMode="append", timeMode="eventTime")


class _FirstBar(StatefulProcessor):
    """Holds an issuer's open listings and its bars; a listing leaves with its first bar once no earlier one can come."""

    def __init__(self, days: int):
        self.span = days * _DAY_MS

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getListState("open", "listing_id long, at long")
        self.bars = handle.getListState("bars", "bar_id long, at long, price double")

    def _settle(self, key, now: int) -> Iterator[pd.DataFrame]:
        listings, bars = [tuple(x) for x in self.open.get()], [tuple(x) for x in self.bars.get()]
        left, out = [], []
        for listing, at in listings:
            first = min(((t, i, p) for i, t, p in bars if at <= t <= at + self.span), default=None)
            if first and first[0] < now:
                out.append((key[0], listing, at, first[1], first[0], first[2], "listed"))
            elif not first and at + self.span < now:
                out.append((key[0], listing, at, None, None, None, "awaiting_bar"))
            else:
                left.append((listing, at))
        # What is older than the watermark serves only listings that are still open.
        oldest = min([at for _, at in left] + [now])
        kept = [b for b in bars if b[1] >= oldest]
        if len(left) < len(listings):
            self.open.put(left) if left else self.open.clear()
        if len(kept) < len(bars):
            self.bars.put(kept) if kept else self.bars.clear()
        if out:
            yield pd.DataFrame(out, columns=["issuer_id", "listing_id", "listed_ms", "bar_id", "bar_ms", "price", "status"]).astype({"bar_id": "Int64", "bar_ms": "Int64"})

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        listings, bars = [], []
        for x in rows:
            for i, at, bar, price in zip(x["id"], x["ms"], x["is_bar"], x["price"]):
                (bars.append((int(i), int(at), float(price))) if bar else listings.append((int(i), int(at))))
        if listings:
            self.open.appendList(listings)
        if bars:
            self.bars.appendList(bars)
        for at in {t + 1 for _, t, *_ in bars} | {t + self.span + 1 for _, t in listings}:
            self.handle.registerTimer(at)
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._settle(key, timerValues.getCurrentWatermarkInMs())

    def close(self) -> None:
        pass


def promotions(listings: DataFrame, bars: DataFrame, days: int = 15, late: str = "7 days") -> DataFrame:
    """One row a listing: its first bar within ``days`` days and status listed, or null and awaiting_bar once the watermark has passed them.

    ``listings``: listing_id, issuer_id, listed_at. ``bars``: bar_id, issuer_id, bar_at, price. Both are streams, in any order;
    rows without an issuer are left out.
    """
    with_state_store(listings.sparkSession)
    one = lambda df, id_, at, price, bar: df.select("issuer_id", F.col(id_).cast("long").alias("id"), F.col(at).alias("at"), F.unix_millis(at).alias("ms"), price.cast("double").alias("price"), F.lit(bar).alias("is_bar"))
    both = one(listings.where("issuer_id is not null"), "listing_id", "listed_at", F.lit(None), False).unionByName(one(bars.where("issuer_id is not null"), "bar_id", "bar_at", F.coalesce("price", F.lit(float("nan"))), True)).withWatermark("at", late)
    out = both.groupBy("issuer_id").transformWithStateInPandas(_FirstBar(days), outputStructType="issuer_id long, listing_id long, listed_ms long, bar_id long, bar_ms long, price double, status string", outputMode="append", timeMode="eventTime")
    return out.select("issuer_id", "listing_id", F.timestamp_millis("listed_ms").alias("listed_at"), "bar_id", F.timestamp_millis("bar_ms").alias("bar_at"), "price", "status")
