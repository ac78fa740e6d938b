"""Token-ID files: Parquet with one row per document in ascending doc_id order and the ids in a list column.

The ids are dictionary-encoded (a row group has few distinct ids), ids of documents and counts delta-encoded; row groups
and pages have a set size and carry page indexes, so a reader takes only the columns, row groups and pages it asks for:
counts and starts come without touching a token, and a range of doc_ids reads only its pages. Spark writes the files,
through its committer, so lost executors leave no half files, and any file system that Spark knows will do.
"""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.common import only, prepare, released
from tessera.llm.tokens import default_path, encoder
from tessera.session import materialize, scratch

#: How the files are laid out: row groups and pages in bytes, delta encoding for the narrow columns, dictionary for ids.
LAYOUT = {
    "parquet.block.size": str(16 << 20), "parquet.page.size": str(256 << 10), "parquet.page.row.count.limit": "2000", "parquet.writer.version": "PARQUET_2_0",
    "parquet.enable.dictionary": "true", "parquet.enable.dictionary#doc_id": "false", "parquet.enable.dictionary#n_tokens": "false", "parquet.enable.dictionary#part": "false", "parquet.enable.dictionary#part_start": "false",
    "compression": "zstd",
}


def in_order(docs: DataFrame) -> DataFrame:
    """(doc_id, text) dealt by range and sorted by doc_id (nulls first), texts with the same id by hash.

    The hash takes part in the range, and a number that spreads equal rows (whose order decides nothing), so many rows of
    one id, and many equal rows, spread over tasks too. That number is a row's place in its partition of docs, so docs
    should be a table that is read, whose rows come in the same order when a task runs again.
    """
    slim = only(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    slim = slim.withColumn("tie", F.xxhash64("text")).withColumn("spread", F.xxhash64(F.monotonically_increasing_id()))
    return slim.repartitionByRange("doc_id", "tie", "spread").sortWithinPartitions("doc_id", "tie").select("doc_id", "text")


def _encode(path: str, end_id: int):
    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        context = TaskContext.get()
        tokens, start, part = encoder(path), 0, context.partitionId() if context else 0
        for b in batches:
            ids, counts = tokens.encode_batch(b.column("text"), end_id)
            ends = np.cumsum(counts)
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(ids.view("<i4")))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(counts), pa.array(np.full(len(counts), part, dtype=np.int64)), pa.array(start + ends - counts), lists], names=["doc_id", "n_tokens", "part", "part_start", "ids"])
            start += int(counts.sum())

    return run


def write_tokens(docs: DataFrame, path: str, tokenizer: str | None = None, end_id: int = 2, layout: dict[str, str] | None = None) -> None:
    """Encode every whole text, append the end id and write (doc_id, n_tokens, part, part_start, ids) below path.

    Null text counts as empty (the end id alone); null and repeated doc_ids keep a row each, nulls first; an empty table
    writes an empty file set. Further columns are not read. A part is what one task wrote, in one file or several, and parts
    follow each other in doc_id order; part_start counts the ids before the document in its part.
    """
    prepare(docs.sparkSession)
    rows = in_order(docs).mapInArrow(released(_encode(tokenizer or default_path(), end_id)), "doc_id bigint, n_tokens bigint, part bigint, part_start bigint, ids array<int>")
    rows.write.options(**(LAYOUT | (layout or {}))).parquet(path)


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """(part, before): the ids before each part; reads the narrow columns alone."""
    narrow = spark.read.parquet(path).select("part", (F.col("part_start") + F.col("n_tokens")).alias("end"))
    sizes = narrow.groupBy("part").agg(F.max("end").alias("size"))
    before = F.sum("size").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))  # a row per part
    return sizes.select("part", F.coalesce(before, F.lit(0)).alias("before"))


def read_tokens(spark: SparkSession, path: str, *columns: str, first: int | None = None, last: int | None = None) -> DataFrame:
    """Documents from the files with their start; only the columns asked for are read, only row groups in [first, last]."""
    index = materialize(read_index(spark, path), "token-index").withColumnRenamed("part", "index_part")
    rows = spark.read.parquet(path).select("doc_id", "n_tokens", "part", "part_start", *columns)
    if first is not None:
        rows = rows.where(F.col("doc_id") >= first)
    if last is not None:
        rows = rows.where(F.col("doc_id") <= last)
    joined = rows.join(index, F.col("part") == F.col("index_part"))
    return joined.select("doc_id", (F.col("before") + F.col("part_start")).alias("start"), "n_tokens", *columns)


def _checksums(batches):
    import pyarrow as pa

    for b in batches:
        ids = b.column("ids")
        flat, at = ids.flatten().to_numpy(zero_copy_only=False).astype("<u4", copy=False), np.cumsum([0, *ids.value_lengths().to_pylist()])
        crc = [zlib.crc32(flat[x:y].tobytes()) for x, y in zip(at, at[1:], strict=False)]
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("start"), b.column("n_tokens"), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])


def token_files(docs: DataFrame, tokenizer: str | None = None, end_id: int = 2) -> DataFrame:
    """Write the files below the shared folder, read them back and return doc_id, start, n_tokens, ids_crc32."""
    spark = docs.sparkSession
    path = scratch(spark, "token-files")
    write_tokens(docs, path, tokenizer, end_id)
    return read_tokens(spark, path, "ids").mapInArrow(released(_checksums), "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")
