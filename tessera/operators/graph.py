"""Dependency graphs: edges between files, nodes with what they hold, chunks for retrieval."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.substrings import pairs


def adjacency(dependencies: DataFrame) -> DataFrame:
    """(path, targets): each file's targets in order, repeats kept."""
    return dependencies.groupBy("path").agg(F.array_sort(F.collect_list("name")).alias("targets"))


def resolve_labels(labels: DataFrame, nodes: DataFrame) -> DataFrame:
    """(label, path): the first node (by path) that ends with the label, holds it, or has it as its stem."""
    # an ending and a stem are parts of the path too
    hit = pairs(labels.select(F.col("label").alias("needle")), nodes.select(F.col("path").alias("hay")))
    return hit.groupBy(F.col("needle").alias("label")).agg(F.min("hay").alias("path"))


def edges(dependencies: DataFrame, nodes: DataFrame) -> DataFrame:
    """(source, target, is_external): dependencies by label, external where no node answers."""
    found = resolve_labels(dependencies.select(F.col("name").alias("label")).distinct(), nodes)
    joined = dependencies.select("path", F.col("name").alias("label")).distinct().join(found.withColumnRenamed("path", "to"), "label", "left")
    return joined.select(F.col("path").alias("source"), F.coalesce("to", "label").alias("target"), F.col("to").isNull().alias("is_external"))


def insight_for(insights: DataFrame, files: DataFrame) -> DataFrame:
    """(path, summary): insights by path, else by file name."""
    named = files.withColumn("name", F.substring_index("path", "/", -1))
    by_path = named.join(insights.select(F.col("key").alias("path"), F.col("summary").alias("a")), "path", "left")
    by_name = insights.groupBy(F.col("key").alias("name")).agg(F.min("summary").alias("b"))
    return by_path.join(by_name, "name", "left").select("path", F.coalesce("a", "b").alias("summary"))


def chunks(nodes: DataFrame, limit: int = 256) -> DataFrame:
    """(chunk_id, path, text) of the first nodes by path: summary, up to eight symbols, up to six dependencies, else size.

    nodes: path, summary, symbols, deps, size.
    """
    part = lambda name, label, n: F.when(F.size(name) > 0, F.concat(F.lit(label), F.array_join(F.slice(name, 1, n), ", ")))
    text = F.concat_ws(" | ", F.nullif(F.col("summary"), F.lit("")), part("symbols", "symbols: ", 8), part("deps", "deps: ", 6))
    text = F.when(text == "", F.concat(F.lit("size: "), F.col("size").cast("string"))).otherwise(text)
    n = F.row_number().over(Window.orderBy("path"))  # over the bounded first rows alone
    return nodes.orderBy("path").limit(limit).select(F.concat(F.lit("dag-"), n.cast("string")).alias("chunk_id"), "path", text.alias("text"))


def greedy_batches(rows: DataFrame, budget: int, key: str = "batch_key") -> DataFrame:
    """(key, path, batch): files in path order fill a batch until the next would exceed the budget in bytes.

    The fold restarts with each batch, so it runs over the ordered array of a key; a key is one module's files.
    """
    ordered = rows.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("path", "size"))).alias("files"))
    zero = F.struct(F.lit(0).cast("long").alias("held"), F.lit(0).cast("long").alias("batch"), F.array().cast("array<struct<path:string,batch:bigint>>").alias("out"))

    def step(acc, x):
        over = (acc["held"] > 0) & (acc["held"] + x["size"] > budget)
        batch = acc["batch"] + F.when(over, 1).otherwise(0).cast("long")
        return F.struct(F.when(over, x["size"]).otherwise(acc["held"] + x["size"]).alias("held"), batch.alias("batch"), F.concat(acc["out"], F.array(F.struct(x["path"].alias("path"), batch.alias("batch")))).alias("out"))

    placed = ordered.select(key, F.explode(F.aggregate("files", zero, step, lambda acc: acc["out"])).alias("x"))
    return placed.select(key, "x.path", "x.batch")
