"""Keyed state of streams: the files of collections with their versions and tombstones, and answers that expire.

Both need the RocksDB state store; ``stateful()`` sets it on a session. State lies with the checkpoint in the shared folder,
so a lost executor loses none of it.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tessera.session import workers_import

#: Collections are cut into so many keys by the hash of the path: a collection may hold most of all files.
BUCKETS = 64
#: A bucket is read whole where it has no more than so many paths for each that a delivery names.
LOOK_UP = 16
EVENTS = "collection string, path string, hash string, at bigint"
CHANGES = "collection string, path string, hash string, at bigint, active boolean, status string"
ANSWERS = "key string, at bigint, status string"


def stateful(spark: SparkSession) -> None:
    """What a session needs before a query with keyed state starts."""
    workers_import(spark)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class Files(StatefulProcessor):
    """The last version of every path of a bucket, and the last mark of a whole listing of its collection.

    A listing tells of each file it sees (path, hash, time); its mark (no path, the time it began) says that what no listing
    has seen since is gone. So a path's state is its newest sighting, by time then hash, and it is active unless a mark is
    newer: the same after rows that come late, twice or in any order.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.mark = handle.getValueState("mark", "at bigint")
        self.files = handle.getMapState("files", "path string", "at bigint, hash string, active boolean")
        self.count = handle.getValueState("count", "n bigint")  # paths of the bucket

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        each = pd.concat(rows)
        out = []
        mark = self.mark.get()[0] if self.mark.exists() else None
        marks = each["at"][each["path"].isna()]
        newer = len(marks) and (mark is None or int(marks.max()) > mark)
        if newer:
            mark = int(marks.max())
            self.mark.update((mark,))
        seen = each[each["path"].notna()].sort_values(["path", "at", "hash"]).drop_duplicates("path", keep="last")
        count = now = self.count.get()[0] if self.count.exists() else 0
        # each look-up is a call to the state; a delivery of a fair part of the bucket reads the bucket in one go
        whole = newer or len(seen) * LOOK_UP >= count
        held = {path: old for (path,), old in self.files.iterator()} if whole and count else {}
        for path, hash_, at in zip(seen["path"], seen["hash"], seen["at"], strict=True):
            old, at = held.get(path) if whole else self.files.getValue((path,)) if self.files.containsKey((path,)) else None, int(at)
            if old is not None and (at, hash_) <= (old[0], old[1]):
                continue
            active = mark is None or mark <= at
            if old is None:
                status = "inserted" if active else "gone"
            elif active:
                status = "reactivated" if not old[2] else "updated" if hash_ != old[1] else "unchanged"
            else:
                status = "deactivated" if old[2] else "gone"
            self.files.updateValue((path,), (at, hash_, active))
            now += old is None
            if whole:
                held[path] = (at, hash_, active)
            if status != "unchanged":
                out.append((key[0], path, hash_, at, active, status))
        if newer:
            for path, (at, hash_, active) in held.items():  # a bucket
                if active and at < mark:
                    self.files.updateValue((path,), (at, hash_, False))
                    out.append((key[0], path, hash_, mark, False, "deactivated"))
        if now != count:
            self.count.update((now,))
        if out:
            yield pd.DataFrame(out, columns=["collection", "path", "hash", "at", "active", "status"])

    def close(self) -> None:
        pass


def file_changes(events: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """A stream of changes (CHANGES) from a stream of sightings and marks (EVENTS; a mark has no path)."""
    own = F.when(F.col("path").isNull(), F.sequence(F.lit(0), F.lit(buckets - 1))).otherwise(F.array(F.pmod(F.xxhash64("path"), F.lit(buckets)).cast("int")))
    keyed = events.where("collection IS NOT NULL").select("collection", F.explode(own).alias("bucket"), "path", F.coalesce("hash", F.lit("")).alias("hash"), "at")
    return keyed.groupBy("collection", "bucket").transformWithStateInPandas(statefulProcessor=Files(), outputStructType=CHANGES, outputMode="Update", timeMode="None")


def files_now(spark: SparkSession, checkpoint: str) -> DataFrame:
    """(collection, path, hash, at, active) as the state of a query of file_changes() has it, read from its checkpoint."""
    held = spark.read.format("statestore").option("path", checkpoint).option("stateVarName", "files").load()
    return held.select("key.collection", "user_map_key.path", "user_map_value.hash", "user_map_value.at", "user_map_value.active")


class Answers(StatefulProcessor):
    """One answer a key: asked for once, joined while it is on its way, kept until it expires."""

    def __init__(self, ttl: int, latency: int) -> None:
        self.ttl, self.latency = ttl, latency

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.asked = handle.getValueState("asked", "at bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        out, asked = [], self.asked.get()[0] if self.asked.exists() else None
        was = asked
        for at in sorted(int(x) for part in rows for x in part["at"]):
            if asked is None or at >= asked + self.ttl:
                if asked is not None:  # before the watermark has come to it
                    out.append((key[0], asked + self.ttl, "evicted"))
                out.append((key[0], at, "miss"))
                asked = at
            else:
                out.append((key[0], at, "joined" if at < asked + self.latency else "hit"))
        if asked != was:
            if was is not None:
                self.handle.deleteTimer(1000 * (was + self.ttl))
            self.asked.update((asked,))
            self.handle.registerTimer(1000 * (asked + self.ttl))
        yield pd.DataFrame(out, columns=["key", "at", "status"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        asked = self.asked.get()[0] if self.asked.exists() else None
        if asked is not None:
            self.asked.clear()
            yield pd.DataFrame([(key[0], asked + self.ttl, "evicted")], columns=["key", "at", "status"])

    def close(self) -> None:
        pass


def answered(requests: DataFrame, ttl: int, latency: int, late: str = "0 seconds") -> DataFrame:
    """A stream (key, at, status) of requests (key, at in seconds): miss, joined or hit; evicted, at its end, once an answer.

    A miss asks, for the first time or anew; requests while that is on its way join it. An answer that has expired leaves the state when the watermark passes, so the state holds the keys of one life span. Times are after 1970.
    """
    timed = requests.where("key IS NOT NULL AND at IS NOT NULL").withColumn("ts", F.timestamp_seconds("at")).withWatermark("ts", late)
    return timed.groupBy("key").transformWithStateInPandas(statefulProcessor=Answers(ttl, latency), outputStructType=ANSWERS, outputMode="Update", timeMode="EventTime")
