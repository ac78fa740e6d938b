"""Candidate runs: grids, figures by candidate, composite scores, recommendation, gates, cache and usage reports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.model import normalized

WEIGHTS = {"quality": 0.4, "latency": 0.2, "throughput": 0.15, "memory": 0.1, "stability": 0.15}
MIN_QUALITY = 0.6


def grid(spark, axes: dict[str, list]) -> DataFrame:
    """Every combination of the given values, one column for each axis; the lists are a configuration's."""
    rows = spark.range(1)
    for name, values in axes.items():  # one row grows by each list, so nothing is joined
        rows = rows.withColumn(name, F.explode(F.array(*map(F.lit, values))))
    return rows.select(*axes)


def nearest_rank(values: Column, q: float) -> Column:
    """The value at the rounded place in order, 0 where there is none; values that are not finite do not count."""
    finite = F.array_sort(F.filter(values, lambda v: ~F.isnan(v) & (F.abs(v) < float("inf"))))
    return F.coalesce(F.get(finite, F.round((F.size(finite) - 1) * q).cast("int")), F.lit(0.0))


def candidate_stats(runs: DataFrame, q: float = 0.95) -> DataFrame:
    """(candidate, success_rate, avg_seconds, p95_seconds, avg_quality): means over successes, the rank over all runs.

    The exact rank comes from counts by value, which are summed before the shuffle, and running sums over them.
    """
    good = lambda c: F.coalesce(F.avg(F.when(F.col("ok"), F.col(c))), F.lit(0.0))
    means = runs.groupBy("candidate").agg(F.avg(F.col("ok").cast("double")).alias("success_rate"), good("seconds").alias("avg_seconds"), good("quality").alias("avg_quality"), F.count("seconds").alias("n"))
    counts = runs.where("seconds IS NOT NULL").groupBy("candidate", "seconds").count()
    upto = F.sum("count").over(Window.partitionBy("candidate").orderBy("seconds"))
    ranked = counts.withColumn("upto", upto).join(means.select("candidate", "n"), "candidate").where(F.col("upto") > F.round((F.col("n") - 1) * q))
    rank = ranked.groupBy("candidate").agg(F.min("seconds").alias("p95_seconds"))
    return means.join(rank, "candidate", "left").select("candidate", *[F.round(c, 6).alias(c) for c in ("success_rate", "avg_seconds")], F.coalesce("p95_seconds", F.lit(0.0)).alias("p95_seconds"), F.round("avg_quality", 6).alias("avg_quality"))


def composite(rows: DataFrame, weights: dict[str, float] | None = None, min_quality: float = MIN_QUALITY) -> DataFrame:
    """(candidate, passed, score) over (candidate, quality, seconds, throughput, memory, success_rate)."""
    w = weights or WEIGHTS
    ends = rows.agg(*[f(c).alias(f"{n}_{c}") for c in ("seconds", "throughput", "memory") for n, f in (("lo", F.min), ("hi", F.max))])
    joined = rows.join(F.broadcast(ends))  # one row
    high = lambda c: normalized(F.col(c), F.col(f"lo_{c}"), F.col(f"hi_{c}"))
    passed = (F.col("quality") >= min_quality) & (F.col("success_rate") > 0)
    score = w["quality"] * F.col("quality") + w["latency"] * (1 - high("seconds")) + w["throughput"] * high("throughput") + w["memory"] * (1 - high("memory")) + w["stability"] * F.col("success_rate")
    score = F.when(F.col("success_rate") <= 0, 0.0).otherwise(score * F.when(passed, 1.0).otherwise(0.5))
    return joined.select("candidate", passed.alias("passed"), F.round(score, 6).alias("score"))


def recommendation(scored: DataFrame) -> DataFrame:
    """The best candidate that passed, else the best that ever succeeded."""
    return scored.where("score > 0").orderBy(F.desc("passed"), F.desc("score"), "candidate").limit(1)


def gates(stats: DataFrame, min_success: float, min_quality: float, max_p95: float) -> DataFrame:
    """(candidate, failures) with the names of the gates a candidate misses."""
    checks = {"success_rate": F.col("success_rate") < min_success, "quality": F.col("avg_quality") < min_quality, "p95": F.col("p95_seconds") > max_p95}
    return stats.select("candidate", F.array_compact(F.array(*[F.when(c, F.lit(k)) for k, c in checks.items()])).alias("failures"))


def memory_index(size_bytes: Column, in_flight: Column, context: Column, predict: Column) -> Column:
    gib = F.greatest(F.coalesce(size_bytes / float(1 << 30), F.lit(1.0)), F.lit(0.5))
    return gib * F.greatest(in_flight, F.lit(1)) * (1 + 0.35 * context / 32768.0 + 0.15 * F.greatest(predict, F.lit(1)) / 2048.0)


def cache_report(entries: DataFrame) -> DataFrame:
    """(category, hits, misses, hit_rate, tokens_saved) over (category, hit, tokens)."""
    by = entries.groupBy("category").agg(F.count_if(F.col("hit")).alias("hits"), F.count_if(~F.col("hit")).alias("misses"), F.sum(F.when(F.col("hit"), F.col("tokens")).otherwise(0)).alias("tokens_saved"))
    return by.select("category", "hits", "misses", F.round(F.col("hits") / (F.col("hits") + F.col("misses")), 6).alias("hit_rate"), "tokens_saved")


def fresh(entries: DataFrame, now: Column, hours: float) -> DataFrame:
    """Entries (category, hash, ts, payload) whose age is within the limit, the latest for each key."""
    alive = entries.where((F.unix_timestamp(now) - F.unix_timestamp("ts")) <= hours * 3600)
    return alive.groupBy("category", "hash").agg(F.max_by("payload", "ts").alias("payload"))


def report(scored: DataFrame, rows: DataFrame) -> DataFrame:
    """(line_no, text): a benchmark's report in Markdown: the best candidate, then a table by score, one line a row.

    scored: what composite() gives; rows: its input. Candidates are a configuration's, so their order is one small sort.
    """
    joined = scored.join(rows.drop("score", "passed"), "candidate")
    rank = F.row_number().over(Window.orderBy(F.desc("passed"), F.desc("score"), "candidate"))
    percent = lambda c, n: F.format_string(f"%.{n}f%%", F.col(c) * 100)
    each = joined.withColumn("rank", rank).select(
        (F.col("rank") + 7).cast("long").alias("line_no"),
        F.format_string("| %d | `%s` | %s | %.1f | %.1f | %.2f | %s | %.3f |", "rank", "candidate", percent("quality", 1), "seconds", "throughput", "memory", percent("success_rate", 0), "score").alias("text"),
    )
    best = recommendation(scored).agg(F.coalesce(F.first(F.format_string("- `%s` score `%.3f`", "candidate", "score")), F.lit("- No recommendation available.")).alias("text"))
    head = [(1, "# Benchmark report"), (2, ""), (3, "## Recommendation"), (5, "## Candidates"), (6, "| Rank | Candidate | Quality | Avg(s) | Throughput(B/s) | MemoryIdx | Success | Score |"), (7, "| --- | --- | ---: | ---: | ---: | ---: | ---: | ---: |")]
    top = rows.sparkSession.createDataFrame(head, "line_no bigint, text string")
    return top.unionByName(best.select(F.lit(4).cast("long").alias("line_no"), "text")).unionByName(each)
