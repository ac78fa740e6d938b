"""A data source of collections of files: whole texts in partitions, and listings as a stream.

``spark.read.format("collection")`` reads what Spark's file readers pass over too, such as hidden files; with
``readStream`` every trigger lists the folder and tells of each file and, by a mark at the end, of the listing itself, which
is what streaming.state needs to see changed, removed and returning files. The folder has to be mounted on all machines.
"""

from __future__ import annotations

import hashlib
import os
import re
import time
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from tessera.operators.store import glob_pattern
from tessera.session import workers_import

TEXTS = "collection string, path string, body string, size bigint, modified bigint"
SIGHTINGS = "collection string, path string, hash string, at bigint"
#: Files (an option) and bytes of a partition.
FILES, BYTES = 1000, 64 << 20


@dataclass
class Part(InputPartition):
    files: list[tuple[str, int, int]]
    at: int = 0
    mark: bool = False


def listed(root: str, pattern: str, hidden: bool) -> Iterator[tuple[str, int, int]]:
    """(path, size, modified in ns) below a folder, in order; hidden ones on demand."""
    fits = re.compile(glob_pattern(pattern))
    for folder, below, names in os.walk(root):
        below[:] = sorted(x for x in below if hidden and x != ".git" or not x.startswith("."))
        for name in sorted(names):
            path = os.path.relpath(os.path.join(folder, name), root).replace(os.sep, "/")
            if (hidden or not name.startswith(".")) and fits.match(path):
                try:
                    seen = os.stat(os.path.join(folder, name))
                except FileNotFoundError:
                    continue
                yield path, seen.st_size, seen.st_mtime_ns


def _parts(own: _Options, at: int = 0) -> list[Part]:
    out, held, size = [], [], 0
    for found in listed(own.root, own.pattern, own.hidden):
        if held and (len(held) >= own.files or size + found[1] > BYTES):
            out.append(Part(held, at))
            held, size = [], 0
        held.append(found)
        size += found[1]
    return [*out, Part(held, at)] if held else out


class _Options:
    def __init__(self, options: dict[str, str]) -> None:
        self.root, self.name, self.pattern = options["path"].removeprefix("file:").rstrip("/"), options.get("name", ""), options.get("pattern", "**/*.md")
        self.files = int(options.get("files", FILES))
        self.hidden = options.get("hidden", "false").lower() == "true"


class Texts(_Options, DataSourceReader):
    def partitions(self) -> list[Part]:
        return _parts(self) or [Part([])]

    def read(self, partition: Part) -> Iterator[tuple]:
        for path, size, modified in partition.files:
            try:
                with open(f"{self.root}/{path}", "rb") as f:
                    body = f.read().decode("utf-8", "replace")
            except FileNotFoundError:  # gone since it was listed
                continue
            yield self.name, path, body, size, modified // 1_000_000


class Listings(_Options, DataSourceStreamReader):
    """A sighting's hash is the file's size and time of change, so no file is opened; times count in milliseconds.

    The offset is the time of a listing that differs from the one before, so a folder where nothing happens costs no batch.
    """

    def __init__(self, options: dict[str, str]) -> None:
        super().__init__(options)
        self.seen, self.offset = None, {"at": 0}

    def initialOffset(self) -> dict:
        return {"at": 0}

    def latestOffset(self) -> dict:
        digest = hashlib.sha256()
        for found in listed(self.root, self.pattern, self.hidden):
            digest.update(repr(found).encode())
        if digest.digest() != self.seen:
            self.seen, self.offset = digest.digest(), {"at": max(time.time_ns() // 1_000_000, self.offset["at"] + 1)}
        return self.offset

    def partitions(self, start: dict, end: dict) -> list[Part]:
        return [*_parts(self, end["at"]), Part([], end["at"], True)]

    def read(self, partition: Part) -> Iterator[tuple]:
        for path, size, modified in partition.files:
            yield self.name, path, f"{size}:{modified}", partition.at
        if partition.mark:
            yield self.name, None, None, partition.at


class CollectionSource(DataSource):
    """Options: path, name of the collection, pattern (**/*.md), hidden (false), files of a partition; listings (a stream of them)."""

    @classmethod
    def name(cls) -> str:
        return "collection"

    def schema(self) -> str:
        return SIGHTINGS if self.options.get("listings") == "true" else TEXTS

    def reader(self, schema) -> Texts:
        return Texts(self.options)

    def streamReader(self, schema) -> Listings:
        return Listings(self.options)


def register(spark: SparkSession) -> None:
    workers_import(spark)
    spark.dataSource.register(CollectionSource)


def texts(spark: SparkSession, name: str, root: str, pattern: str = "**/*.md", hidden: bool = False) -> DataFrame:
    """(collection, path, body, size, modified) of whole files."""
    register(spark)
    return spark.read.format("collection").options(name=name, pattern=pattern, hidden=str(hidden).lower()).load(root)


def listings(spark: SparkSession, name: str, root: str, pattern: str = "**/*.md") -> DataFrame:
    """A stream of sightings and marks, as streaming.state.file_changes() takes it."""
    register(spark)
    return spark.readStream.format("collection").options(name=name, pattern=pattern, listings="true").load(root)


# ---- ignore files

RULES = "folder string, place int, line string"


def ignore_rules(spark: SparkSession, root: str, name: str = ".gitignore") -> DataFrame:
    """(folder, place, line) of all ignore files below a folder."""
    rows = texts(spark, "", root, f"**/{name}", hidden=True)
    each = rows.select(F.regexp_replace("path", "/?[^/]*$", "").alias("folder"), F.posexplode(F.split("body", "\r?\n")).alias("place", "line"))
    return each.select("folder", "place", "line")


def _regex(pattern: Column) -> Column:
    """A glob of an ignore file as a regular expression over the path from the rule's folder."""
    marks = {"\u0001": "(?:.*/)?", "\u0002": "/(?:.*/)?", "\u0003": "/.+", "\u0004": "[^/]*", "\u0005": "[^/]"}
    p = F.regexp_replace(pattern, r"(?<!\\)\[!", "[^")
    for found, put in ((r"^\*\*/", "\u0001"), (r"/\*\*/(?:\*\*/)*", "\u0002"), (r"/\*\*$", "\u0003"), (r"(?<!\\)\*+", "\u0004"), (r"(?<!\\)\?", "\u0005")):
        p = F.regexp_replace(p, found, put)
    p = F.regexp_replace(F.regexp_replace(p, r"\\([A-Za-z0-9])", "$1"), r"([.+$(){}|]|(?<!\[)\^)", r"\\$1")
    for mark, put in marks.items():
        p = F.replace(p, F.lit(mark), F.lit(put))
    return p


def parsed_rules(rules: DataFrame) -> DataFrame:
    """(folder, depth, place, negated, folders_only, regex) of the lines that are rules."""
    line = F.regexp_replace("line", r"(?<!\\)[ \t]+$", "")
    own = rules.select("folder", "place", line.alias("line")).where((F.col("line") != "") & ~F.startswith("line", F.lit("#")))
    own = own.withColumn("negated", F.startswith("line", F.lit("!"))).withColumn("line", F.regexp_replace(F.when(F.col("negated"), F.substring("line", 2, 1 << 30)).otherwise(F.col("line")), r"\\ ", " "))
    own = own.withColumn("folders_only", F.endswith("line", F.lit("/"))).withColumn("line", F.regexp_replace("line", "/$", ""))
    anchored = F.contains("line", F.lit("/"))
    body = _regex(F.regexp_replace("line", "^/", ""))
    regex = F.concat(F.lit("^"), F.when(anchored, "").otherwise("(?:.*/)?"), body, F.lit("$"))
    depth = F.when(F.col("folder") == "", 0).otherwise(F.size(F.split("folder", "/")))
    return own.where("line <> ''").select("folder", depth.alias("depth"), "place", "negated", "folders_only", regex.alias("regex"))


def ignored(paths: DataFrame, rules: DataFrame) -> DataFrame:
    """(path) of the files that the rules of ignore files leave out.

    Rules meet files and folders by the folders above them; of those that match the one in the deepest folder counts, in it
    the last. A folder that is left out takes all below along, whatever other rules say.
    """
    parts = F.split("path", "/")
    up = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    own = paths.select("path").where("path <> ''").distinct()
    each = own.select("path", F.posexplode(up).alias("n", "entry"), F.size(parts).alias("size")).select("path", "entry", (F.col("n") + 1 < F.col("size")).alias("is_folder"))
    entries = each.select("entry", "is_folder").distinct()
    steps = F.split("entry", "/")
    above = F.transform(F.sequence(F.lit(0), F.size(steps) - 1), lambda n: F.array_join(F.slice(steps, 1, n), "/"))
    met = entries.select("entry", "is_folder", F.explode(above).alias("folder")).join(parsed_rules(rules), "folder")
    below = F.when(F.col("folder") == "", F.col("entry")).otherwise(F.expr("substring(entry, length(folder) + 2)"))
    hit = met.where((~F.col("folders_only") | F.col("is_folder")) & F.rlike(below, F.col("regex")))
    last = hit.groupBy("entry", "is_folder").agg(F.max_by("negated", F.struct("depth", "place")).alias("negated")).where(~F.col("negated"))
    return each.join(last.select("entry", "is_folder"), ["entry", "is_folder"]).select("path").distinct()
