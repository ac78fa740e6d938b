"""Queries over streams: ingest batch by batch, arrivals by window, telemetry."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.plans.search import table
from tessera.session import scratch
from tessera.streaming import ingest as ig
from tessera.streaming import state as ss

QUERIES, ORACLE = {}, {}


def query(name, sql=None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return add


@query("stream_ingest", "SELECT source AS collection, lang || '/' || doc_id::VARCHAR || '.md' AS path, CASE WHEN doc_id % 4 = 0 THEN sha256(text || ' v2') ELSE sha256(text) END AS hash FROM documents")
def stream_ingest(spark, d):
    """Two deliveries: every document, then a later version of a quarter of them."""
    base = scratch(spark, "stream")
    docs = table(spark, d, "documents").select(F.col("source").alias("collection"), F.concat("lang", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".md")).alias("path"), F.col("text").alias("body"), F.timestamp_seconds(F.col("doc_id")).alias("ts"), "doc_id")
    docs.drop("doc_id").write.json(f"{base}/in/a")
    again = docs.where("doc_id % 4 = 0").select("collection", "path", F.concat("body", F.lit(" v2")).alias("body"), (F.col("ts") + F.expr("INTERVAL 400 DAYS")).alias("ts"))
    for name, checkpoint in (("in/a", "c"), ("in/b", "c2")):
        if name == "in/b":
            again.write.json(f"{base}/{name}")
        q = ig.arrivals(spark, f"{base}/{name}", 1000).writeStream.foreachBatch(_shifted(ig.merge_batch(spark, f"{base}/store"), 0 if name == "in/a" else 1000)).option("checkpointLocation", f"{base}/{checkpoint}").trigger(availableNow=True).start()
        q.awaitTermination()
    return ig.current(spark, f"{base}/store").select("collection", "path", "hash")


def _glob(df) -> str:
    """A pattern for the files of a table, be it one file or a folder: streams read folders or patterns."""
    file = min(df.inputFiles())
    return f"{file.rsplit('/', 1)[0]}/{{{','.join(sorted(f.rsplit('/', 1)[1] for f in df.inputFiles()))}}}"


def _shifted(merge, by: int):
    return lambda batch, i: merge(batch, i + by)


@query("stream_windows", "SELECT date_trunc('day', ts) AS day, event_type, count(*)::BIGINT AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def stream_windows(spark, d):
    """Events by day and type through a watermarked stream, complete when the input ends."""
    base, batches = scratch(spark, "windows"), []
    own = table(spark, d, "events")
    events = spark.readStream.schema(own.schema).parquet(_glob(own))
    by = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", "1 hour").groupBy(F.window("ts", "1 day"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))

    def keep(batch, i: int) -> None:
        batch.write.mode("overwrite").parquet(f"{base}/batch={i}")
        batches.append(i)

    by.writeStream.outputMode("complete").foreachBatch(keep).option("checkpointLocation", f"{base}-state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{base}/batch={max(batches)}").select(F.col("window.start").alias("day"), "event_type", "n", F.round("total", 4).alias("total"))


#: Sightings of the documents as files: a first listing, a second one after its mark without some and with changes, a late
#: third one that saw less than the second, the first once more, and some that come back.
SEEN = """ev AS (SELECT coalesce(source, 'none') AS collection, coalesce(lang, '-') || '/' || doc_id::VARCHAR || '.md' AS path, sha256(coalesce(text, '')) AS hash, doc_id FROM documents),
  seen AS (SELECT collection, path, hash, 100 AS moment FROM ev UNION ALL SELECT collection, path, CASE WHEN doc_id % 4 = 0 THEN sha256(hash) ELSE hash END, 200 FROM ev WHERE doc_id % 5 <> 0
    UNION ALL SELECT collection, path, 'late', 150 FROM ev WHERE doc_id % 3 = 0 UNION ALL SELECT collection, path, 'again', 300 FROM ev WHERE doc_id % 10 = 0),
  last AS (SELECT collection, path, max(moment) AS moment, arg_max(hash, moment) AS hash FROM seen GROUP BY collection, path)"""


@query("stream_state", f'WITH {SEEN} SELECT collection, path, hash, moment::BIGINT AS "at", moment >= 200 AS active FROM last')
def stream_state(spark, d):
    """The files' state after deliveries that come late, twice and out of order, read from the state store."""
    base = scratch(spark, "state")
    ev = table(spark, d, "documents").select(F.coalesce("source", F.lit("none")).alias("collection"), F.concat(F.coalesce("lang", F.lit("-")), F.lit("/"), F.col("doc_id").cast("string"), F.lit(".md")).alias("path"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("hash"), "doc_id")
    at = lambda rows, when, hash_="hash": rows.select("collection", "path", F.expr(hash_).alias("hash"), F.lit(when).cast("long").alias("at"))
    first, second = at(ev, 100), at(ev.where("doc_id % 5 <> 0"), 200, "CASE WHEN doc_id % 4 = 0 THEN sha2(hash, 256) ELSE hash END")
    marks = ev.select("collection", F.lit(None).cast("string").alias("path"), F.lit(None).cast("string").alias("hash"), F.lit(200).cast("long").alias("at")).distinct()
    late, back = at(ev.where("doc_id % 3 = 0"), 150, "'late'"), at(ev.where("doc_id % 10 = 0"), 300, "'again'")
    ss.stateful(spark)
    for i, rows in enumerate((first, second.unionByName(marks).unionByName(back), late.unionByName(first))):
        rows.write.json(f"{base}/in/{i}")
        events = spark.readStream.schema(ss.EVENTS).json(f"{base}/in/*")
        q = ss.file_changes(events).writeStream.outputMode("update").foreachBatch(lambda b, k: b.write.mode("overwrite").parquet(f"{base}/changes/batch={k}")).option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start()
        q.awaitTermination()
    return ss.files_now(spark, f"{base}/checkpoint")


TTL, LATENCY = 600, 60


@query(
    "stream_answers",
    f"""WITH RECURSIVE req AS (SELECT 'k' || (doc_id % 40)::VARCHAR AS key, doc_id * 3 + 1 AS moment, row_number() OVER (PARTITION BY doc_id % 40 ORDER BY doc_id) AS n FROM documents WHERE doc_id IS NOT NULL),
  told(key, n, moment, asked, status) AS (
    SELECT key, n, moment, moment, 'miss' FROM req WHERE n = 1
    UNION ALL
    SELECT r.key, r.n, r.moment, CASE WHEN r.moment >= t.asked + {TTL} THEN r.moment ELSE t.asked END, CASE WHEN r.moment >= t.asked + {TTL} THEN 'miss' WHEN r.moment < t.asked + {LATENCY} THEN 'joined' ELSE 'hit' END FROM told t JOIN req r ON r.key = t.key AND r.n = t.n + 1
  ) SELECT key, moment::BIGINT AS "at", status FROM told""",
)
def stream_answers(spark, d):
    """Requests for forty answers: misses, joins and hits as the state of the stream decides them."""
    base = scratch(spark, "answers")
    asked = table(spark, d, "documents").where("doc_id IS NOT NULL").select(F.concat(F.lit("k"), (F.col("doc_id") % 40).cast("string")).alias("key"), (F.col("doc_id") * 3 + 1).alias("at"))
    asked.write.json(f"{base}/in")
    ss.stateful(spark)
    requests = spark.readStream.schema("key string, at bigint").json(f"{base}/in")
    ss.answered(requests, TTL, LATENCY).writeStream.outputMode("update").foreachBatch(lambda b, k: b.write.mode("overwrite").parquet(f"{base}/out/batch={k}")).option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{base}/out").where("status <> 'evicted'").select("key", "at", "status")
