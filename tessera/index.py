"""A document index in a folder: configuration, ingest, embedding, search, look-ups, status and clean-up as one class.

Tables are Parquet in folders of their own names, and a manifest names the folders that make up the index. Manifests are
numbered files, written last and never changed: a piece of work writes its folders, then one manifest for all tables, so a
failure at any point leaves the index as it was, and the next run does the work again. A reader takes one manifest and reads
what that one names; clean-up swaps it like any other work, and deletes folders that neither the last manifest nor the one
before names. Two writers cannot both follow the same manifest: the second one's file exists already, and it fails.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import text as tx
from tessera.functions import vector as vec
from tessera.operators import fulltext as ft
from tessera.operators import search as se
from tessera.operators import store as st
from tessera.session import discard, materialize, swept
from tessera.sources import files as fs

DOCUMENTS = "id bigint, collection string, path string, title string, hash string, modified_at timestamp, active boolean"
CONTENT = "hash string, body string"
VECTORS = "hash string, qvec array<smallint>, model string"
BANDS = "hash string, band int, bucket bigint"
POSTINGS = "token string, hash string, n int, at array<int>"
TERMS = "token string, level int, docs bigint"
HEADS = "token string, id bigint, n int, at array<int>"
SCHEMAS = {"documents": DOCUMENTS, "heads": HEADS, "content": CONTENT, "postings": POSTINGS, "terms": TERMS, "vectors": VECTORS, "bands": BANDS}
#: Folders that no manifest names may be a writer's that still runs; after so many hours they are deleted.
ORPHAN_HOURS = 24
MODEL = "hashed-256"


class Engine(Protocol):
    """What a language model may replace: forms of a query, and the scores of hits."""

    def expand(self, query: str) -> list[str]: ...

    def rerank(self, query: str, hits: DataFrame) -> DataFrame: ...


class HeuristicEngine:
    """Forms by synonyms and tokens; 0.78 of the score and 0.22 of the overlap with title and snippet."""

    def expand(self, query: str) -> list[str]:
        return se.expand_query(query)

    def rerank(self, query: str, hits: DataFrame) -> DataFrame:
        over = tx.overlap(tx.query_tokens(query), F.lower(F.concat_ws(" ", "title", "snippet")))
        return hits.withColumn("score", F.round(se.RERANK_OLD * F.col("score") + se.RERANK_OVERLAP * over, 6))


class Manifest:
    """Which folders make up the tables of an index, and its configuration."""

    def __init__(self, number: int = 0, config: dict | None = None, tables: dict[str, list[str]] | None = None) -> None:
        self.number, self.config, self.tables = number, config or {}, tables or {}

    def folders(self) -> set[str]:
        return {f for own in self.tables.values() for f in own}


class Change:
    """A piece of work on an index: folders are written one by one and count from commit() on, all at once."""

    def __init__(self, index: Index) -> None:
        self.index, self.base = index, index.manifest()
        self.config, self.tables = dict(self.base.config), {k: list(v) for k, v in self.base.tables.items()}

    def add(self, name: str, df: DataFrame) -> DataFrame:
        """Write rows as a further folder of a table; the rows read back."""
        folder = f"{name}/{uuid.uuid4().hex}"
        self.index._write(folder, df)
        self.tables.setdefault(name, []).append(folder)
        return self.index._read(SCHEMAS[name], [folder])

    def replace(self, name: str, df: DataFrame) -> DataFrame:
        """Write rows as all that a table holds."""
        before = self.tables.pop(name, [])
        try:
            return self.add(name, df)
        except BaseException:
            self.tables[name] = before
            raise

    def drop(self, *names: str) -> None:
        for name in names:
            self.tables.pop(name, None)

    def commit(self) -> Manifest:
        now = Manifest(self.base.number + 1, self.config, self.tables)
        self.index._commit(now, self.base)
        return now


class Index:
    def __init__(self, spark: SparkSession, path: str, engine: Engine | None = None) -> None:
        self.spark, self.path, self.engine = spark, path.rstrip("/"), engine or HeuristicEngine()

    # ---- manifests and folders

    def _at(self, below: str):
        """A file system and a path below the index."""
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{below}")
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()), at

    def _numbers(self) -> list[int]:
        hadoop, at = self._at("manifest/*.json")
        return sorted((int(f.getPath().getName()[:-5]) for f in hadoop.globStatus(at) or []), reverse=True)

    def _manifest(self, number: int) -> Manifest | None:
        """None where a broken write left a part of a file."""
        hadoop, at = self._at(f"manifest/{number:012d}.json")
        stream = hadoop.open(at)
        try:
            told = json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        except ValueError:
            return None
        finally:
            stream.close()
        return Manifest(number, told["config"], told["tables"])

    def manifest(self) -> Manifest:
        """The last whole one."""
        return next((m for n in self._numbers() if (m := self._manifest(n))), Manifest())

    def _commit(self, now: Manifest, base: Manifest) -> None:
        numbers = self._numbers()
        if self.manifest().number != base.number:
            raise RuntimeError("the index has changed meanwhile")
        now.number = max([base.number, *numbers]) + 1  # numbers of broken files are not used again
        hadoop, at = self._at(f"manifest/{now.number:012d}.json")
        stream = hadoop.create(at, False)  # fails where it exists: one writer wins
        try:
            stream.write(bytearray(json.dumps({"config": now.config, "tables": now.tables}, sort_keys=True).encode()))
        finally:
            stream.close()

    def _write(self, folder: str, df: DataFrame) -> None:
        df.write.parquet(f"{self.path}/{folder}")

    def _read(self, schema: str, folders: list[str]) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*(f"{self.path}/{f}" for f in folders))

    def _table(self, name: str, manifest: Manifest | None = None) -> DataFrame:
        return self._read(SCHEMAS[name], (manifest or self.manifest()).tables.get(name, []))

    def vacuum(self, orphan_hours: float = ORPHAN_HOURS) -> int:
        """Delete folders that neither the last manifest nor the one before names, and manifests before; how many folders went."""
        kept = [m for n in self._numbers() if (m := self._manifest(n))]
        live, known = {f for m in kept[:2] for f in m.folders()}, {f for m in kept for f in m.folders()}
        limit, gone = (time.time() - 3600 * orphan_hours) * 1000, 0
        for name in SCHEMAS:
            hadoop, at = self._at(f"{name}/*")
            for status in hadoop.globStatus(at) or []:
                folder = f"{name}/{status.getPath().getName()}"
                if folder not in live and (folder in known or status.getModificationTime() < limit):
                    hadoop.delete(status.getPath(), True)
                    gone += 1
        for m in kept[2:]:
            hadoop, at = self._at(f"manifest/{m.number:012d}.json")
            hadoop.delete(at, False)
        return gone

    # ---- configuration

    def config(self) -> dict:
        return self.manifest().config

    def configure(self, config: dict) -> None:
        """Store a configuration as the sources' functions (add_collection, add_context ...) return it."""
        change = Change(self)
        change.config = json.loads(json.dumps(config))
        change.commit()

    # ---- tables

    def documents(self) -> DataFrame:
        return self._table("documents")

    def rows(self) -> DataFrame:
        """Active documents with their bodies."""
        now = self.manifest()
        return self._table("documents", now).where("active").join(self._table("content", now), "hash")

    def content(self) -> DataFrame:
        return self._table("content")

    def vectors(self) -> DataFrame:
        return self._table("vectors")

    def _add_content(self, change: Change, content: DataFrame) -> None:
        """New contents by hash, their postings by token and the blocks of those: in order, so that listed filters skip most of them."""
        new = change.add("content", content.select("hash", "body").repartitionByRange("hash").sortWithinPartitions("hash"))
        change.add("terms", ft.blocks(change.add("postings", ft.postings(new))))

    def _put_documents(self, change: Change, documents: DataFrame) -> DataFrame:
        rows = change.replace("documents", documents)
        change.replace("heads", ft.heads(rows))
        return rows

    def ingest(self, force: bool = False) -> dict[str, int]:
        """Read all collections, write new contents and the next version of the documents; counters of what changed.

        With ``force`` every file that is there counts as updated.
        """
        collections = self.config().get("collections", {})
        if not collections:
            return {"indexed": 0, "updated": 0, "unchanged": 0, "deactivated": 0}
        return self.put(st.union_all([fs.collection(self.spark, name, own["path"], own.get("pattern", "**/*.md")) for name, own in sorted(collections.items())]), list(collections), force)

    def put(self, found: DataFrame, collections: list[str], force: bool = False) -> dict[str, int]:
        """Take rows (collection, path, title, hash, body) as all that the named collections hold now; counters as in ingest()."""
        change = Change(self)
        found = materialize(found, "ingest")  # the files are read once
        try:
            old = self._table("documents", change.base)
            ours = old.where(F.col("collection").isin(*collections))
            fresh = found.groupBy("hash").agg(F.first("body").alias("body")).join(self._table("content", change.base).select("hash"), "hash", "left_anti")
            if not fresh.isEmpty():
                self._add_content(change, fresh)
            merged = st.merge(found, ours.withColumn("hash", F.lit("")) if force else ours)
            keyed = ["collection", "path"]
            now = merged.join(found.select(*keyed, "title"), keyed, "left").join(ours.select(*keyed, F.col("title").alias("old_title"), F.col("hash").alias("old_hash"), "modified_at"), keyed, "left")
            identity = F.shiftrightunsigned(F.xxhash64(*keyed), 11)
            gone = F.col("status").isin("deactivated", "gone")
            rows = now.select(identity.alias("id"), *keyed, F.coalesce("title", "old_title").alias("title"), F.when(gone, F.col("old_hash")).otherwise(F.col("hash")).alias("hash"), F.when(gone, F.col("modified_at")).otherwise(F.current_timestamp()).alias("modified_at"), (~gone).alias("active"))
            counts = st.report(merged).first().asDict()
            self._put_documents(change, rows.unionByName(old.where(~F.col("collection").isin(*collections))))
            change.commit()
        finally:
            discard(found)
        return counts

    def embed(self, force: bool = False) -> int:
        """Vectors and their bands for active contents without one (all with ``force``); how many were made."""
        change = Change(self)
        known = self._table("vectors", change.base)
        rows = self._table("documents", change.base).where("active").join(self._table("content", change.base), "hash")
        todo = st.content(rows) if force else st.pending(rows, known)
        made = vec.hashed_vectors(todo).select("hash", vec.quantized(F.col("vec")).alias("qvec"), F.lit(MODEL).alias("model"))
        new = change.add("vectors", made)
        n = new.count()
        if force:  # one vector a content
            new = change.replace("vectors", new.unionByName(known.join(new.select("hash"), "hash", "left_anti")))
            change.drop("bands")
        if n:
            change.add("bands", vec.bands(new.select("hash", "qvec")).select("hash", F.col("band").cast("int").alias("band"), "bucket").distinct())
            change.commit()
        return n

    # ---- search

    def _answer(self, made: Callable[[], DataFrame]) -> DataFrame:
        """A result that a limit bounds, as local rows; what was written meanwhile below the shared folder is deleted."""
        with swept(self.spark):
            out = made()
            return self.spark.createDataFrame(out.collect(), out.schema)

    def _shown(self, hits: DataFrame, query: str, now: Manifest) -> DataFrame:
        hits = materialize(hits.select("id", "file", "score"), "hits")  # no more than a few limits
        documents = se.among(self._table("documents", now).where("active"), "id", hits)
        rows = documents.join(se.among(self._table("content", now), "hash", documents), "hash")
        shown = se.with_snippets(hits, rows, query)
        _, contexts = fs.collections_config(self.spark, now.config) if now.config else (None, self.spark.createDataFrame([], "collection string, prefix string, text string"))
        located = rows.select("id", "collection", "path").join(F.broadcast(shown), "id")  # hits are bounded by their limit
        by_file = st.contexts_for(located.select("file", "collection", "path"), contexts)
        return located.join(by_file, "file", "left").select(F.concat(F.lit("#"), F.col("id").cast("string")).alias("docid"), "file", "title", "score", "context", "snippet")

    def _logged(self, mode: str, query: str, limit: int, hits: DataFrame, telemetry: bool) -> DataFrame:
        if telemetry:
            began = time.time()
            fs.append_telemetry(self.spark, f"{self.path}/telemetry", mode, query, limit, hits.count(), began)
        return hits.orderBy(F.desc("score"), "file")

    def _fallback(self, queries: list[str], limit: int, collection: str | None, now: Manifest) -> DataFrame:
        return se.fallback_many(self._table("documents", now).withColumn("body", F.lit("")), queries, limit, collection)

    def _lexical(self, queries: list[str], limit: int, now: Manifest, collection: str | None = None) -> DataFrame:
        """Lexical hits from postings, or for queries without any those whose path or title holds them."""
        stored = (self._table(n, now) for n in ("documents", "content", "postings", "terms"))
        hits = materialize(se.lexical_stored_many(*stored, queries, limit, 0.0, collection), "hits")
        none = [i for i in range(len(queries)) if i not in {r["query"] for r in hits.select("query").distinct().collect()}]
        if not none:
            return hits
        other = self._fallback([queries[i] for i in none], limit, collection, now)
        return hits.unionByName(other.withColumn("query", F.array(*map(F.lit, none))[F.col("query")]).select(*hits.columns))

    def _vector(self, queries: list[str], limit: int, now: Manifest, exact: bool = False) -> DataFrame:
        return se.vector_stored_many(*(self._table(n, now) for n in ("documents", "vectors", "bands", "postings", "terms")), queries, limit, exact=exact)

    def search(self, query: str, limit: int = 10, min_score: float = 0.0, collection: str | None = None, telemetry: bool = False) -> DataFrame:
        now = self.manifest()
        hits = lambda: self._lexical([query], limit, now, collection).drop("query").where(F.col("score") >= min_score)
        return self._logged("lexical", query, limit, self._answer(lambda: self._shown(hits(), query, now)), telemetry)

    def ranked(self, query: str, limit: int = 10, min_score: float = 0.0, collection: str | None = None, telemetry: bool = False) -> DataFrame:
        """By cover density and overlap: quoted phrases, ``or`` and minus; a query without a hit meets paths and titles."""
        now = self.manifest()

        def hits():
            found = ft.ranked(*(self._table(n, now) for n in ("documents", "heads", "postings", "terms")), query, limit, 0.0, collection)
            return (self._fallback([query], limit, collection, now) if found.isEmpty() and query.strip() else found).where(F.col("score") >= min_score)

        return self._logged("ranked", query, limit, self._answer(lambda: self._shown(hits(), query, now)), telemetry)

    def vsearch(self, query: str, limit: int = 10, min_score: float = 0.0, telemetry: bool = False, exact: bool = False) -> DataFrame:
        """By vectors; bands narrow the search to few of the nearest contents, with ``exact`` all vectors are compared."""
        now = self.manifest()
        hits = lambda: self._vector([query], limit, now, exact).drop("query").where(F.col("score") >= min_score)
        return self._logged("vector", query, limit, self._answer(lambda: self._shown(hits(), query, now)), telemetry)

    def query(self, query: str, limit: int = 10, min_score: float = 0.0, telemetry: bool = False) -> DataFrame:
        """Both searches for every form of the query, best hit per document, reranked by the engine."""
        forms, now = self.engine.expand(query), self.manifest()
        if not forms:
            raise ValueError("the query is empty")

        def ranked():
            legs = [leg(forms, limit, now).select("id", "file", "score") for leg in (self._lexical, self._vector)]
            return self.engine.rerank(query, self._shown(se.dedup_hits(legs[0].unionByName(legs[1])), query, now)).where(F.col("score") >= min_score).orderBy(F.desc("score"), "file").limit(limit)

        return self._logged("hybrid", query, limit, self._answer(ranked), telemetry)

    # ---- look-ups

    def get(self, lookup: str, first: int | None = None, count: int | None = None, numbered: bool = False) -> str | None:
        """The text of a document by #id, file or the end of its path; a line behind the name counts unless one is given."""
        found = st.resolve(self.documents(), self.spark.createDataFrame([(lookup,)], "lookup string")).first()
        if found is None:
            return None
        at = first or found["line"] or 1
        return self.rows().where(F.col("id") == found["id"]).select(tx.slice_lines(F.col("body"), at, count, numbered)).first()[0]

    def multi_get(self, pattern: str, max_bytes: int = 10_240) -> DataFrame:
        return st.multi_get(self.rows(), pattern, max_bytes)

    def ls(self, prefix: str = "") -> DataFrame:
        return st.list_files(self.documents(), prefix).orderBy("file")

    def status(self) -> DataFrame:
        names = [(n,) for n in sorted(self.config().get("collections", {}))]
        held = self.documents()
        by = held.where("active").groupBy("collection").agg(F.count("*").alias("files"), F.max("modified_at").alias("updated"))
        return self.spark.createDataFrame(names, "collection string").join(by, "collection", "left").select("collection", F.coalesce("files", F.lit(0)).alias("files"), "updated").orderBy("collection")

    def context_gaps(self) -> DataFrame:
        _, contexts = fs.collections_config(self.spark, self.config())
        return st.context_gaps(self.documents(), contexts)

    def cleanup(self, orphan_hours: float = ORPHAN_HOURS) -> dict[str, int]:
        """Drop inactive documents and what nothing refers to any more; rows that went, by table."""
        change = Change(self)
        docs, content, vectors, bands = (self._table(n, change.base) for n in ("documents", "content", "vectors", "bands"))
        left = st.cleanup(docs, content, vectors, bands)
        before = {"documents": docs, "content": content, "vectors": vectors}
        change.drop("content", "postings", "terms")
        self._put_documents(change, left["documents"])
        self._add_content(change, left["content"])
        change.replace("bands", left["bands"])
        change.replace("vectors", left["vectors"])
        now = change.commit()
        went = {n: own.count() - self._table(n, now).count() for n, own in before.items()}
        self.vacuum(orphan_hours)
        return went
