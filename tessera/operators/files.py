"""Figures over tables of files (path, size): directories, trees, selections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import paths as pa
from tessera.operators.substrings import pairs


def language_counts(files: DataFrame) -> DataFrame:
    return files.groupBy(pa.language(F.col("path")).alias("language")).agg(F.count("*").alias("files"), F.sum("size").alias("bytes"))


def core_files(files: DataFrame, limit: int | None = None) -> DataFrame:
    """(path, score) of the files that matter most, all of them unless a limit is given."""
    scored = files.select("path", pa.importance(F.col("path"), F.col("size")).alias("score")).where("score >= 0.5")
    return scored if limit is None else scored.orderBy(F.desc("score"), "path").limit(limit)


def _above(files: DataFrame) -> DataFrame:
    """(dir): every directory above a file, the top as an empty name."""
    parts = F.split(pa.parent(F.col("path")), "/")
    ups = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    return files.select(F.explode(F.array_union(ups, F.array(F.lit("")))).alias("dir")).distinct()


def directories(files: DataFrame) -> DataFrame:
    """(dir, files, subdirs, bytes) counting direct children only."""
    own = files.groupBy(pa.parent(F.col("path")).alias("dir")).agg(F.count("*").alias("n"), F.sum("size").alias("b"))
    above = _above(files)
    subs = above.where("dir <> ''").groupBy(pa.parent(F.col("dir")).alias("dir")).agg(F.count("*").alias("s"))
    joined = above.join(own, "dir", "left").join(subs, "dir", "left")
    return joined.select("dir", F.coalesce("n", F.lit(0)).alias("files"), F.coalesce("s", F.lit(0)).alias("subdirs"), F.coalesce("b", F.lit(0)).alias("bytes"))


def tree(files: DataFrame) -> DataFrame:
    """(path, parent, name, depth, is_file) of files and directories."""
    nodes = files.select("path", F.lit(True).alias("is_file")).unionByName(_above(files).where("dir <> ''").select(F.col("dir").alias("path"), F.lit(False).alias("is_file")))
    return nodes.select("path", pa.parent(F.col("path")).alias("parent"), pa.name(F.col("path")).alias("name"), F.size(F.split("path", "/")).cast("long").alias("depth"), "is_file")


def drawn_directories(files: DataFrame) -> DataFrame:
    """(path, text): a line for each directory, drawn as a branch of its tree; in order of the parts of path they are the tree.

    A line begins with a mark for each directory above: whether that one is the last of its siblings. Directories meet
    those above them by their paths, so the tree is nowhere as a whole.
    """
    nodes = _above(files).where("dir <> ''").select(F.col("dir").alias("path"), pa.parent(F.col("dir")).alias("parent"), pa.name(F.col("dir")).alias("name"))
    last = nodes.groupBy("parent").agg(F.max("name").alias("most"))
    marked = nodes.join(last, "parent").select("path", "name", (F.col("name") == F.col("most")).alias("last"))
    parts = F.split("path", "/")
    ups = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.struct(n.alias("n"), F.array_join(F.slice(parts, 1, n), "/").alias("up")))
    each = marked.select("path", "name", F.explode(ups).alias("x")).select("path", "name", "x.n", "x.up")
    own = F.col("up") == F.col("path")
    piece = F.when(own & F.col("last"), "└── ").when(own, "├── ").when(F.col("last"), "    ").otherwise("│   ")
    drawn = each.join(marked.select(F.col("path").alias("up"), "last"), "up").select("path", "name", "n", piece.alias("piece"))
    whole = drawn.groupBy("path", "name").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "piece"))), lambda x: x["piece"]), "").alias("head"))
    return whole.select("path", F.concat("head", "name", F.lit("/")).alias("text"))


def tree_order() -> list[Column]:
    """Directories first, then names whatever their case."""
    return [F.col("is_file").asc(), F.lower("name").asc(), F.col("path").asc()]


def tree_stats(files: DataFrame) -> DataFrame:
    above = _above(files).where("dir <> ''").agg(F.count("*").alias("directories"))
    return files.agg(F.count("*").alias("files"), F.sum("size").alias("bytes")).join(F.broadcast(above))


def listed(files: DataFrame, root: str, depth: int, limit: int) -> DataFrame:
    below = files.where(F.startswith("path", F.lit(root + "/")) & (F.size(F.split("path", "/")) <= depth + root.count("/") + 1))
    return below.select("path", "size").orderBy("path").limit(limit)


def insights(files: DataFrame) -> DataFrame:
    """(ext, files, bytes, share): the share of all bytes by extension."""
    by = files.groupBy(F.coalesce(pa.extension(F.col("path")), F.lit("")).alias("ext")).agg(F.count("*").alias("files"), F.sum("size").alias("bytes"))
    total = files.agg(F.sum("size").alias("total"))
    return by.join(F.broadcast(total)).select("ext", "files", "bytes", F.round(F.col("bytes") / F.col("total"), 6).alias("share"))


def batches(files: DataFrame, size: int = 64) -> DataFrame:
    """(path, top, language, batch): runs of at most ``size`` files with the same first directory and language."""
    rows = files.select("path", F.substring_index("path", "/", 1).alias("top"), pa.language(F.col("path")).alias("language"))
    n = F.row_number().over(Window.partitionBy("top", "language").orderBy("path")) - 1
    return rows.withColumn("batch", F.floor(n / size).cast("long"))


def top_insights(rows: DataFrame, limit: int) -> DataFrame:
    return rows.select("path", "importance").orderBy(F.desc("importance"), "path").limit(limit)


def by_domain(rows: DataFrame, domains: DataFrame, limit: int) -> DataFrame:
    """(domain, path): files whose path holds one of the domain's places or is held by one, the first few of each."""
    paths, places = rows.select(F.col("path").alias("hay")), domains.select(F.col("place").alias("hay"))
    turned = lambda own: own.select(F.col("hay").alias("needle"))
    holds = pairs(turned(places), paths).select(F.col("hay").alias("path"), F.col("needle").alias("place"))
    held = pairs(turned(paths), places).select(F.col("needle").alias("path"), F.col("hay").alias("place"))
    hit = holds.unionByName(held).join(domains, "place").select("domain", "path").distinct()
    n = F.row_number().over(Window.partitionBy("domain").orderBy("path"))
    return hit.withColumn("n", n).where(F.col("n") <= limit).select("domain", "path")


def priority(kind: Column) -> Column:
    out = F
    for k, v in pa.DEPENDENCY_PRIORITY.items():
        out = out.when(kind == k, v)
    return out.otherwise(3)
