"""Connected components of an edge table by alternating large-star and small-star steps.

Each half step is a minimum per node (aggregated before the shuffle) and one join; the edges of a round are written to
the shared folder, so lineage stays short and nothing is collected. Rounds grow with the logarithm of a chain's length.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.session import discard, materialize


def _large(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("n"), F.least("a", "m").alias("m"))
    return (
        both.where("b > a").join(least, F.col("a") == F.col("n"))
        .select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
    )


def _small(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("n"), "m")
    pairs = down.join(least, F.col("a") == F.col("n"))
    moved = pairs.select(F.explode(F.array(F.struct(F.col("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e"))
    return moved.select("e.a", "e.b").where("a <> b").distinct()


def _sum(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
    return row["n"], row["h"]


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """Nodes of an edge table (a, b bigint, no nulls) with the smallest node each reaches: (node, root).

    Loops and repeated edges count for nothing; an empty table gives an empty result. Nodes without an edge to another
    node are not returned.
    """
    now = materialize(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    was = _sum(now)
    for _ in range(rounds):
        if not was[0]:
            break
        new = materialize(_small(_large(now)), "edges")
        got = _sum(new)
        discard(now)
        now = new
        if got == was:
            break
        was = got
    else:
        raise RuntimeError(f"components: no fixed point after {rounds} rounds")
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("root"))
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots).distinct()
