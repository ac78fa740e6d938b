"""Sources and sinks: collections of files, whole texts, tables by JDBC, telemetry, manifests, generated documents."""

from __future__ import annotations

import json
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions import paths as pa
from tessera.functions import text as tx
from tessera.operators.store import glob_pattern

CONTENT = T.StructType([T.StructField("hash", T.StringType(), False), T.StructField("body", T.StringType()), T.StructField("created_at", T.TimestampType())])
DOCUMENTS = T.StructType([T.StructField(n, t) for n, t in (("id", T.LongType()), ("collection", T.StringType()), ("path", T.StringType()), ("title", T.StringType()), ("hash", T.StringType()), ("created_at", T.TimestampType()), ("modified_at", T.TimestampType()), ("active", T.BooleanType()))])
SNAPSHOT = T.StructType([T.StructField("path", T.StringType()), T.StructField("hash", T.StringType()), T.StructField("size", T.LongType()), T.StructField("modified", T.TimestampType())])
TELEMETRY = T.StructType([T.StructField("ts", T.TimestampType()), T.StructField("mode", T.StringType()), T.StructField("query", T.StringType()), T.StructField("limit", T.IntegerType()), T.StructField("result_count", T.LongType()), T.StructField("duration_ms", T.LongType())])
FINDINGS = "severity string, category string, message string, section string"


def _relative(root: str):
    clean = root.split("://", 1)[-1].removeprefix("file:").rstrip("/")
    return F.regexp_replace(F.col("file"), "^.*?" + "".join(c if c.isalnum() or c in "/_" else "\\" + c for c in clean) + "/", "")


def scan(spark: SparkSession, root: str, pattern: str = "**/*") -> DataFrame:
    """(path, size, modified) of the files below a folder that match a pattern; contents are not read."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select(F.col("path").alias("file"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"))
    return rows.select(_relative(root).alias("path"), "size", "modified").where(F.rlike("path", F.lit(glob_pattern(pattern))))


def read_texts(spark: SparkSession, root: str, pattern: str = "**/*.md") -> DataFrame:
    """(path, body) of whole files as text; bytes that are no UTF-8 are replaced."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select(F.col("path").alias("file"), "content")
    return rows.select(_relative(root).alias("path"), F.decode("content", "UTF-8").alias("body")).where(F.rlike("path", F.lit(glob_pattern(pattern))))


def collection(spark: SparkSession, name: str, root: str, pattern: str = "**/*.md") -> DataFrame:
    """Ingest candidates of a collection: (collection, path, title, hash, body)."""
    rows = read_texts(spark, root, pattern)
    return rows.select(F.lit(name).alias("collection"), "path", tx.title(F.col("path"), F.col("body")).alias("title"), F.sha2("body", 256).alias("hash"), "body")


def snapshot(spark: SparkSession, root: str, pattern: str = "**/*") -> DataFrame:
    """(path, hash, size, modified) of the files that are not ignored."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    rows = rows.select(F.col("path").alias("file"), F.sha2("content", 256).alias("hash"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"))
    rows = rows.select(_relative(root).alias("path"), "hash", "size", "modified")
    return rows.where(F.rlike("path", F.lit(glob_pattern(pattern))) & ~pa.is_binary(F.col("path")))


def supported_documents(spark: SparkSession, root: str) -> DataFrame:
    """(path, kind, size) of the document types that can be read."""
    rows = scan(spark, root)
    return rows.select("path", pa.document_type(F.col("path")).alias("kind"), "size").where("kind IS NOT NULL")


def jdbc(spark: SparkSession, url: str, table: str, properties: dict[str, str], partition: tuple[str, int, int, int] | None = None) -> DataFrame:
    """A table of an existing index database; partition is (column, lowest, highest, number) for parallel reads."""
    reader = spark.read.format("jdbc").options(url=url, dbtable=table, **properties)
    if partition:
        column, low, high, n = partition
        reader = reader.options(partitionColumn=column, lowerBound=str(low), upperBound=str(high), numPartitions=str(n))
    return reader.load()


def matches(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines of a structural search; a malformed line is an error."""
    schema = "file string, text string, range struct<start:struct<line:bigint>>, metaVariables struct<single:map<string,struct<text:string>>>"
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def collections_config(spark: SparkSession, config: dict) -> tuple[DataFrame, DataFrame]:
    """(collections, contexts) from a configuration: {"global_context", "collections": {name: {path, pattern, context}}}."""
    rows, contexts = [], [(None, "/", config["global_context"])] if config.get("global_context") else []
    for name, own in sorted(config.get("collections", {}).items()):
        rows.append((name, own["path"], own.get("pattern", "**/*.md")))
        contexts += [(name, prefix, text) for prefix, text in sorted(own.get("context", {}).items())]
    return spark.createDataFrame(rows, "collection string, root string, pattern string"), spark.createDataFrame(contexts, "collection string, prefix string, text string")


def add_collection(config: dict, name: str, path: str, pattern: str = "**/*.md") -> dict:
    return config | {"collections": config.get("collections", {}) | {name: {"path": path, "pattern": pattern}}}


def remove_collection(config: dict, name: str) -> dict:
    if name not in config.get("collections", {}):
        raise KeyError(name)
    return config | {"collections": {k: v for k, v in config["collections"].items() if k != name}}


def rename_collection(config: dict, old: str, new: str) -> dict:
    """The configuration with a new name; documents keep the old one until the next ingest."""
    if new in config.get("collections", {}):
        raise ValueError(f"{new} exists")
    own = config.get("collections", {})[old]
    return config | {"collections": {k: v for k, v in config["collections"].items() if k != old} | {new: own}}


def add_context(config: dict, text: str, collection_name: str | None = None, prefix: str = "/") -> dict:
    if collection_name is None:
        return config | {"global_context": text}
    own = config["collections"][collection_name]
    return config | {"collections": config["collections"] | {collection_name: own | {"context": own.get("context", {}) | {prefix: text}}}}


def remove_context(config: dict, collection_name: str | None = None, prefix: str = "/") -> dict:
    if collection_name is None:
        return {k: v for k, v in config.items() if k != "global_context"}
    own = config["collections"][collection_name]
    return config | {"collections": config["collections"] | {collection_name: own | {"context": {k: v for k, v in own.get("context", {}).items() if k != prefix}}}}


# ---- sinks


def append_telemetry(spark: SparkSession, path: str, mode: str, query: str, limit: int, results: int, began: float) -> None:
    """One line about a search."""
    row = [(mode, query, limit, results, int((time.time() - began) * 1000))]
    frame = spark.createDataFrame(row, "mode string, query string, limit int, result_count bigint, duration_ms bigint")
    frame.select(F.current_timestamp().alias("ts"), "*").coalesce(1).write.mode("append").json(path)


def read_telemetry(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(TELEMETRY).json(path)


def write_graph(nodes: DataFrame, edges: DataFrame, chunks: DataFrame, path: str) -> None:
    for name, df in (("nodes", nodes), ("edges", edges), ("chunks", chunks)):
        df.write.mode("overwrite").parquet(f"{path}/{name}")


def write_sections(sections: DataFrame, path: str) -> None:
    """A folder for each section with its text."""
    sections.select("section", "content").write.mode("overwrite").partitionBy("section").text(path)


def write_report(findings: DataFrame, scores: dict[str, float], path: str) -> None:
    """Findings as JSON lines and the scores beside them."""
    findings.write.mode("overwrite").json(f"{path}/findings")
    spark = findings.sparkSession
    spark.createDataFrame([(json.dumps(scores, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/scores")


def read_report(spark: SparkSession, path: str) -> tuple[DataFrame, dict[str, float]]:
    return spark.read.schema(FINDINGS).json(f"{path}/findings"), json.loads(spark.read.text(f"{path}/scores").first()[0])


def quality_gate(overall: float, least: float) -> None:
    """An error where a documentation's score is too low."""
    if overall < least:
        raise ValueError(f"quality {overall:.3f} is below {least:.3f}")
