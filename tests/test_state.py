"""Keyed state of streams against a fold over the log."""

import json
import os
import random

import pytest

from tessera.streaming import state as ss


class Feed:
    """Deliveries as files, one a batch."""

    def __init__(self, spark, folder, schema, made):
        self.spark, self.folder, self.schema, self.made, self.n = spark, folder, schema, made, 0
        (folder / "in").mkdir()
        ss.stateful(spark)

    def put(self, rows):
        names = [c.split()[0] for c in self.schema.split(", ")]
        self.n += 1
        at = self.folder / "in" / f"{self.n:04d}.json"
        at.write_text("".join(json.dumps(dict(zip(names, r, strict=True))) + "\n" for r in rows))
        os.utime(at, (self.n, self.n))

    def run(self):
        stream = self.spark.readStream.schema(self.schema).option("maxFilesPerTrigger", 1).json(f"{self.folder}/in")
        keep = lambda b, k: b.write.mode("overwrite").parquet(f"{self.folder}/out/batch={k:04d}")
        self.made(stream).writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{self.folder}/c").trigger(availableNow=True).start().awaitTermination()
        return self.spark.read.parquet(f"{self.folder}/out").drop("batch")


def now(events):
    marks, last = {}, {}
    for c, p, h, at in events:
        if c is not None and p is None:
            marks[c] = max(marks.get(c, at), at)
        elif c is not None:
            last[c, p] = max(last.get((c, p), (at, h or "")), (at, h or ""))
    return sorted((c, p, h, at, at >= marks.get(c, at)) for (c, p), (at, h) in last.items())


@pytest.mark.parametrize("seed", [1, 2])
def test_files_end_alike_in_any_order(spark, tmp_path, seed):
    rng = random.Random(seed)
    events = [("a", f"p{i % 9}", f"h{rng.randrange(3)}", rng.randrange(40)) for i in range(60)] + [("b", "é/x", "h", 5), ("b", "é/x", None, 5)] + [(c, None, None, t) for c, t in (("a", 12), ("a", 25), ("b", 3), ("c", 9))] + [(None, "x", "h", 1)]
    events += events[:20]
    rng.shuffle(events)
    feed = Feed(spark, tmp_path, ss.EVENTS, lambda s: ss.file_changes(s, 3))
    feed.put(events[:30])
    feed.run()
    feed.put(events[30:60])
    feed.put(events[60:])
    changes = feed.run()
    assert sorted(map(tuple, ss.files_now(spark, f"{tmp_path}/c").select("collection", "path", "hash", "at", "active").collect())) == now(events)
    assert {r["status"] for r in changes.collect()} <= {"inserted", "updated", "reactivated", "deactivated", "gone"}


def test_tombstones_and_return(spark, tmp_path):
    feed = Feed(spark, tmp_path, ss.EVENTS, ss.file_changes)
    for rows in ([("n", "a", "1", 1), ("n", "b", "2", 1)], [("n", "a", "1", 5), ("n", None, None, 5)], [("n", "b", "2", 3)], [("n", "b", "2", 7), ("n", "a", "9", 7)]):
        feed.put(rows)
    got = [(r["path"], r["at"], r["status"]) for r in feed.run().orderBy("at", "path", "status").collect()]
    assert got == [("a", 1, "inserted"), ("b", 1, "inserted"), ("b", 3, "gone"), ("b", 5, "deactivated"), ("a", 7, "updated"), ("b", 7, "reactivated")]


def test_answers_expire(spark, tmp_path):
    feed = Feed(spark, tmp_path, "key string, at bigint", lambda s: ss.answered(s, 100, 10))
    feed.put([("x", 1), ("x", 5), ("x", 50), ("y", 20), (None, 3), ("x", None)])
    feed.put([("x", 120), ("x", 125), ("z", 400)])
    feed.put([("y", 401)])
    got = sorted((r["key"], r["at"], r["status"]) for r in feed.run().collect())
    assert [g for g in got if g[2] != "evicted"] == [("x", 1, "miss"), ("x", 5, "joined"), ("x", 50, "hit"), ("x", 120, "miss"), ("x", 125, "joined"), ("y", 20, "miss"), ("y", 401, "miss"), ("z", 400, "miss")]
    assert [g for g in got if g[2] == "evicted"] == [("x", 101, "evicted"), ("x", 220, "evicted"), ("y", 120, "evicted")]
