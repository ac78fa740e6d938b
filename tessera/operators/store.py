"""The content-addressed document store: ingest by full outer merge, status, look-ups, contexts, clean-up."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import text as tx
from tessera.session import materialize


#: How contents are written: in row groups short enough that tasks share a file.
CONTENT_FILES = {"compression": "zstd", "parquet.block.size": str(16 << 20)}


def from_documents(documents: DataFrame, *more: str) -> DataFrame:
    """The test tables' documents as store rows: id, collection, path, title, hash, body, active, and more of their columns."""
    path = F.concat(F.col("lang"), F.lit("/"), F.col("doc_id").cast("string"), F.lit(".md"))
    rows = documents.select(F.col("doc_id").alias("id"), F.col("source").alias("collection"), path.alias("path"), F.coalesce("text", F.lit("")).alias("body"), *more)
    return rows.select("id", "collection", "path", tx.title(F.col("path"), F.col("body")).alias("title"), F.sha2("body", 256).alias("hash"), "body", F.lit(True).alias("active"), *more)


def content(rows: DataFrame) -> DataFrame:
    """(hash, body), one row per hash."""
    return rows.groupBy("hash").agg(F.first("body").alias("body"))


def placed(table: DataFrame) -> DataFrame:
    """A table of files with the place of each row: its file, as a number, and its number there."""
    return table.select("*", F.xxhash64("_metadata.file_path").alias("in_file"), F.col("_metadata.row_index").alias("at_row"))


def content_in_place(rows: DataFrame) -> DataFrame:
    """content() of rows with the place of placed(): only hashes and places of rows are shuffled.

    Places of copies of an earlier row are written as a narrow table, whose size tells Spark whether to broadcast it; then
    bodies stay where they are read. With too many copies for that both sides are sorted.
    """
    order = Window.partitionBy("hash").orderBy("in_file", "at_row")
    again = rows.select("hash", "in_file", "at_row").withColumn("n", F.row_number().over(order)).where("n > 1").select("in_file", "at_row")
    return rows.join(materialize(again, "again"), ["in_file", "at_row"], "left_anti").select("hash", "body")


def file(collection: Column, path: Column) -> Column:
    return F.concat_ws("/", collection, path)


def merge(candidates: DataFrame, existing: DataFrame) -> DataFrame:
    """(collection, path, hash, status): inserted, updated, unchanged, reactivated, deactivated or gone.

    Both sides are keyed by collection and path; existing rows carry ``active``. One full outer join decides everything.
    """
    new = candidates.select("collection", "path", F.col("hash").alias("new_hash"))
    old = existing.select("collection", "path", F.col("hash").alias("old_hash"), "active")
    joined = new.join(old, ["collection", "path"], "full_outer")
    status = (
        F.when(F.col("old_hash").isNull(), "inserted")
        .when(F.col("new_hash").isNull(), F.when(F.col("active"), "deactivated").otherwise("gone"))
        .when(F.col("new_hash") != F.col("old_hash"), "updated")
        .when(~F.col("active"), "reactivated")
        .otherwise("unchanged")
    )
    return joined.select("collection", "path", F.coalesce("new_hash", "old_hash").alias("hash"), status.alias("status"))


def apply_merge(candidates: DataFrame, existing: DataFrame) -> DataFrame:
    """The store after an ingest: (collection, path, hash, active)."""
    return merge(candidates, existing).select("collection", "path", "hash", (~F.col("status").isin("deactivated", "gone")).alias("active"))


def report(merged: DataFrame) -> DataFrame:
    """One row of counters over a merge."""
    count = lambda *s: F.count_if(F.col("status").isin(*s))
    return merged.agg(count("inserted").alias("indexed"), count("updated").alias("updated"), count("unchanged", "reactivated").alias("unchanged"), count("deactivated").alias("deactivated"))


def status(rows: DataFrame, collections: DataFrame) -> DataFrame:
    """(collection, files, newest) of every configured collection, 0 where it holds nothing."""
    held = rows.where("active").groupBy("collection").agg(F.count("*").alias("files"), F.max("id").alias("newest"))
    return collections.join(held, "collection", "left").select("collection", F.coalesce("files", F.lit(0)).alias("files"), "newest")


def pending(rows: DataFrame, vectors: DataFrame) -> DataFrame:
    """(hash, body) of active contents without a vector."""
    return content(rows.where("active")).join(vectors.select("hash"), "hash", "left_anti")


def cleanup(rows: DataFrame, contents: DataFrame, vectors: DataFrame, bands: DataFrame) -> dict[str, DataFrame]:
    """What is left after inactive documents go, then contents, vectors and bands that nothing refers to."""
    rows = rows.where("active")
    contents = contents.join(rows.select("hash"), "hash", "left_semi")
    vectors = vectors.join(contents.select("hash"), "hash", "left_semi")
    return {"documents": rows, "content": contents, "vectors": vectors, "bands": bands.join(vectors.select("hash"), "hash", "left_semi")}


def resolve(rows: DataFrame, lookups: DataFrame) -> DataFrame:
    """(lookup, id, file, line): by #id, else by exact file, else by the shortest path with that ending.

    Each way is an equi-join. For the last one a path stands with one ending for each length that the look-ups left over
    have, and meets them on that ending; lengths are one row.
    """
    asked = lookups.select("lookup", tx.trailing_line(F.col("lookup")).alias("line"), F.regexp_replace("lookup", r":\d+$", "").alias("name")).distinct()
    own = rows.where("active").select("id", file(F.col("collection"), F.col("path")).alias("file"), "path")
    by_id = asked.where(F.startswith("name", F.lit("#"))).withColumn("id", F.expr("try_cast(substring(name, 2) AS BIGINT)")).join(own, "id").select("lookup", "line", "id", "file", F.lit(0).alias("way"), F.lit(0).alias("size"))
    by_file = asked.join(own, F.col("name") == F.col("file")).select("lookup", "line", "id", "file", F.lit(1).alias("way"), F.lit(0).alias("size"))
    left = asked.join(by_id.unionByName(by_file).select("lookup"), "lookup", "left_anti")
    left = left.withColumn("ending", F.lower("name"))
    sizes = left.agg(F.collect_set(F.length("ending")).alias("sizes"))  # no more than a path has characters
    ends = own.withColumn("low", F.lower("path")).join(F.broadcast(sizes)).withColumn("n", F.explode("sizes")).where(F.col("n") <= F.length("low"))
    ends = ends.select("id", "file", F.expr("right(low, n)").alias("ending"), F.length("path").alias("size"))
    by_end = left.join(ends, "ending").select("lookup", "line", "id", "file", F.lit(2).alias("way"), "size")
    found = by_id.unionByName(by_file).unionByName(by_end)
    best = found.groupBy("lookup").agg(F.min(F.struct("way", "size", "file", "id", "line")).alias("b"))
    return best.select("lookup", "b.id", "b.file", "b.line")


def glob_pattern(pattern: str) -> str:
    """A regular expression for a file pattern with *, ** and ?."""
    out, i = [], 0
    while i < len(pattern):
        if pattern.startswith("**/", i):
            out.append("(?:.*/)?")
            i += 3
        elif pattern.startswith("**", i):
            out.append(".*")
            i += 2
        else:
            c = pattern[i]
            out.append("[^/]*" if c == "*" else "[^/]" if c == "?" else c if c.isalnum() or c in "_/" else "\\" + c)
            i += 1
    return "^" + "".join(out) + "$"


def multi_get(rows: DataFrame, pattern: str, max_bytes: int) -> DataFrame:
    """(file, body, error): files that match a pattern or are in a comma list; too large ones give an error instead."""
    own = rows.where("active").select(file(F.col("collection"), F.col("path")).alias("file"), "body")
    if "," in pattern:
        wanted = F.col("file").isin(*[p.strip() for p in pattern.split(",") if p.strip()])
    else:
        wanted = F.rlike("file", F.lit(glob_pattern(pattern)))
    large = F.octet_length("body") > max_bytes
    return own.where(wanted).select("file", F.when(~large, F.col("body")).alias("body"), F.when(large, F.concat(F.lit("skipped: "), F.octet_length("body").cast("string"), F.lit(" bytes"))).alias("error"))


def list_files(rows: DataFrame, prefix: str) -> DataFrame:
    """Active files whose path starts with the prefix, whatever its case."""
    return rows.where("active").select(file(F.col("collection"), F.col("path")).alias("file"), "id").where(F.startswith(F.lower("file"), F.lit(prefix.lower())))


def contexts_for(files: DataFrame, contexts: DataFrame) -> DataFrame:
    """(file, context): the text of the longest prefix in the file's collection, else the global one.

    Contexts (collection, prefix, text; null collection: global) are a configuration's few rows. Prefixes of a file are
    exploded, so the join is on equal keys and grows with path depth only.
    """
    parts = F.split("path", "/")
    prefixes = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda n: F.concat(F.lit("/"), F.array_join(F.slice(parts, 1, n), "/")))
    each = files.select("file", "collection", F.explode(prefixes).alias("prefix"))
    own = contexts.where("collection is not null").select("collection", tx.context_path(F.col("prefix")).alias("prefix"), "text")
    best = each.join(own, ["collection", "prefix"]).groupBy("file").agg(F.max_by("text", F.length("prefix")).alias("own"))
    everywhere = contexts.where("collection is null").agg(F.first("text").alias("everywhere"))
    return files.join(best, "file", "left").join(F.broadcast(everywhere)).select("file", F.coalesce("own", "everywhere").alias("context"))  # one row


def context_gaps(rows: DataFrame, contexts: DataFrame) -> DataFrame:
    """(collection, top): first path parts that no context of the collection covers."""
    tops = rows.where("active").select("collection", F.substring_index("path", "/", 1).alias("top")).distinct()
    own = contexts.where("collection is not null").select("collection", tx.context_path(F.col("prefix")).alias("prefix"))
    covers = (F.col("c.prefix") == "/") | (F.col("c.prefix") == F.concat(F.lit("/"), F.col("t.top"))) | F.startswith("c.prefix", F.concat(F.lit("/"), F.col("t.top"), F.lit("/")))
    return tops.alias("t").join(own.alias("c"), (F.col("t.collection") == F.col("c.collection")) & covers, "left_anti")


def longest_prefix(paths: DataFrame, roots: DataFrame) -> DataFrame:
    """(path, collection): the collection with the longest root that is the path or holds it, by whole parts."""
    parts = F.split("path", "/")
    each = paths.select("path", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))).alias("root"))
    best = each.join(roots, "root").groupBy("path").agg(F.max_by("collection", F.length("root")).alias("collection"))
    return paths.join(best, "path", "left")


def snapshot_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """(path, change): unchanged, changed, new or removed between two tables of (path, hash)."""
    joined = old.select("path", F.col("hash").alias("old")).join(new.select("path", F.col("hash").alias("new")), "path", "full_outer")
    change = F.when(F.col("old").isNull(), "new").when(F.col("new").isNull(), "removed").when(F.col("old") == F.col("new"), "unchanged").otherwise("changed")
    return joined.select("path", change.alias("change"))


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)


def first_of(rows: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """Of rows with equal keys the first in the given order."""
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("__n = 1").drop("__n")
