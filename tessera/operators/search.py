"""Lexical, vector and hybrid top-k search as single plans.

Scores are rounded to six digits before they are compared, and ties go to the smaller file, then id. Bodies are read once
per search; the snippet is cut only for the rows that win.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import text as tx
from tessera.functions import vector as vec
from tessera.operators.store import file
from tessera.session import materialize

#: How scores are put together.
FALLBACK, RERANK_OLD, RERANK_OVERLAP, VECTOR_COSINE, VECTOR_OVERLAP = 0.15, 0.78, 0.22, 0.74, 0.26
SYNONYMS = (("config", "configuration"), ("build", "compile"), ("bug", "issue"), ("perf", "performance"))


def _own(rows: DataFrame, collection: str | None) -> DataFrame:
    rows = rows.where("active")
    rows = rows.where(F.col("collection") == collection) if collection else rows
    return rows.withColumn("file", file(F.col("collection"), F.col("path"))).withColumn("hay", F.lower(F.concat_ws(" ", "title", "body"))).withColumn("path_hay", F.lower(F.concat_ws(" ", "path", "title", "body")))


def _forms(queries: list[str]) -> list[tuple[int, int, float, str]]:
    """(query, variant, weight, text) of every form that is searched for."""
    return [(i, k, w, q) for i, query in enumerate(queries) for k, (w, q) in enumerate(tx.query_variants(query))]


def _top(best: DataFrame, limit: int) -> DataFrame:
    """The first rows of each query; ranks are cut off before the shuffle."""
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "file", "id"))
    return best.withColumn("rank", rank).where(F.col("rank") <= limit).drop("rank")


def _best_of(scored: DataFrame) -> DataFrame:
    """Per query and content hash the best row: score, then file, then id."""
    best = scored.groupBy("query", "hash").agg(F.min(F.struct((-F.col("score")).alias("minus"), "file", "id", "variant")).alias("b"))
    return best.select("query", "hash", (-F.col("b.minus")).alias("score"), "b.file", "b.id", "b.variant")


_HIT = ["query", "id", "file", "hash", "score", "variant"]


def lexical_many(rows: DataFrame, queries: list[str], limit: int = 10, min_score: float = 0.0, collection: str | None = None) -> DataFrame:
    """(query, id, file, hash, score, variant): the best contents of each query; bodies are read and lowered once for all."""
    own = _own(rows, collection)
    quality = tx.path_quality(F.col("file"))
    forms: dict[int, list[Column]] = {}
    for i, k, w, q in _forms(queries):
        score = F.round(tx.lexical_score(tx.query_tokens(q), q, F.col("hay"), F.col("path_hay")) * w * quality, 6)
        forms.setdefault(i, []).append(F.struct((-score).alias("minus"), F.lit(k).alias("variant")))
    if not forms:
        return own.select(F.lit(0).alias("query"), "id", "file", "hash", F.lit(0.0).alias("score"), F.lit(0).alias("variant")).limit(0)
    best = [F.struct(F.lit(i).alias("query"), F.array_min(F.array(*made)).alias("b")) for i, made in forms.items()]  # a row's best form of each query
    each = own.select("id", "file", "hash", F.explode(F.array(*best)).alias("f"))
    scored = each.select("f.query", "id", "file", "hash", (-F.col("f.b.minus")).alias("score"), F.col("f.b.variant").alias("variant")).where("score > 0")
    return _top(_best_of(scored).where(F.col("score") >= min_score), limit).select(*_HIT)


def fallback_many(rows: DataFrame, queries: list[str], limit: int = 10, collection: str | None = None) -> DataFrame:
    """Contents whose path or title holds a query: a low score by the file's place."""
    own = _own(rows, collection)
    hits = F.filter(F.array(*[F.when(F.contains(F.lower("path"), F.lit(q.lower())) | F.contains(F.lower("title"), F.lit(q.lower())), F.lit(i)) for i, q in enumerate(queries)]), lambda x: x.isNotNull())
    scored = own.select(F.explode(hits).alias("query"), "id", "file", "hash", F.round(FALLBACK * tx.path_quality(F.col("file")), 6).alias("score"), F.lit(0).alias("variant"))
    return _top(_best_of(scored), limit).select(*_HIT)


def lexical(rows: DataFrame, query: str, limit: int = 10, min_score: float = 0.0, collection: str | None = None) -> DataFrame:
    """(id, file, hash, score, variant) of the best contents; variant tells which form of the query won."""
    return lexical_many(rows, [query], limit, min_score, collection).drop("query").orderBy(F.desc("score"), "file", "id").limit(limit)


def lexical_fallback(rows: DataFrame, query: str, limit: int = 10, collection: str | None = None) -> DataFrame:
    """The fallback's hits for one query, for searches without a hit."""
    return fallback_many(rows, [query], limit, collection).drop("query").orderBy(F.desc("score"), "file", "id").limit(limit)


def lexical_or_fallback_many(rows: DataFrame, queries: list[str], limit: int = 10, collection: str | None = None) -> DataFrame:
    """Lexical hits, or for queries without any the fallback's; one plan without a look at the result in between."""
    hits = lexical_many(rows, queries, limit, 0.0, collection)
    other = fallback_many(rows, queries, limit, collection).join(F.broadcast(hits.select("query").distinct()), "query", "left_anti")  # a row per query at most
    return hits.unionByName(other.select(*hits.columns))


def lexical_or_fallback(rows: DataFrame, query: str, limit: int = 10, collection: str | None = None) -> DataFrame:
    return lexical_or_fallback_many(rows, [query], limit, collection).drop("query")


def with_snippets(hits: DataFrame, rows: DataFrame, query: str, chars: int = tx.SNIPPET_CHARS) -> DataFrame:
    """Title and snippet for the rows of a result alone."""
    terms = [t for _, q in tx.query_variants(query)[:1] for t in tx.query_tokens(q)]
    bodies = rows.select("id", "title", "body").join(F.broadcast(hits), "id")  # hits are bounded by their limit
    return bodies.select("id", "file", "title", "score", tx.snippet(F.col("body"), terms, chars).alias("snippet"))


def vector_given(vectors: DataFrame, query: list[float], limit: int = 10, key: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(key, score): the best cosines above zero with a given vector."""
    scored = vectors.select(key, F.round(vec.cosine(F.col(embedding), F.array(*[F.lit(float(x)) for x in query])), 6).alias("score"))
    return scored.where("score > 0").orderBy(F.desc("score"), key).limit(limit)


def vector_hashed_many(rows: DataFrame, queries: list[str], limit: int = 10) -> DataFrame:
    """(query, id, file, hash, score, variant) by cosine of hashed features and overlap, for several queries at once.

    A row gets its cosines and overlaps where its body is read, so the shuffle has a short row for each hit and no body. A text
    whose features cancel out has a cosine of NaN, which is above all numbers, as in its SQL.
    """
    own = _own(rows, None)
    overlaps = F.array(*[tx.overlap(tx.query_tokens(q), F.col("hay")) for q in queries])
    met = vec.hashed_cosines(own.select("id", "file", "hash", overlaps.cast("array<double>").alias("overlaps"), "body"), queries)
    each = met.select("id", "file", "hash", F.posexplode(F.arrays_zip("cos", "overlaps")).alias("query", "m")).where("m.cos > 0")
    score = (VECTOR_COSINE * F.col("m.cos") + VECTOR_OVERLAP * F.col("m.overlaps")) * tx.path_quality(F.col("file"))
    scored = each.select("query", "id", "file", "hash", F.round(score, 6).alias("score"), F.lit(0).alias("variant"))
    return _top(_best_of(scored), limit).select(*_HIT)


def vector_hashed(rows: DataFrame, query: str, limit: int = 10) -> DataFrame:
    """(id, file, hash, score, variant) for one query."""
    return vector_hashed_many(rows, [query], limit).drop("query").orderBy(F.desc("score"), "file", "id").limit(limit)


def band_candidates(bands: DataFrame, query_bands: DataFrame) -> DataFrame:
    """Hashes that share an exact band with the query; all hashes where none does."""
    near = bands.join(F.broadcast(query_bands.select("band", "bucket").distinct()), ["band", "bucket"], "left_semi").select("hash").distinct()  # a query has eight bands
    none = near.agg(F.count("*").alias("n"))
    rest = bands.select("hash").distinct().join(F.broadcast(none), F.col("n") == 0).select("hash")
    return near.unionByName(rest)


# ---- over stored tables: postings, vectors and bands in place of bodies

#: Values that a filter lists, so that the scan skips what it cannot need; more of them are joined.
LISTED = 1000


def among(rows: DataFrame, key: str, wanted: DataFrame) -> DataFrame:
    """The rows whose key is wanted: a listed filter, which reaches the scan, for up to LISTED keys, else a join."""
    keys = [r[0] for r in wanted.select(key).distinct().limit(LISTED + 1).collect()]
    return rows.where(F.col(key).isin(keys)) if len(keys) <= LISTED else rows.join(wanted.select(key).distinct(), key, "left_semi")


class Terms:
    """Which of some terms contents hold, from postings: a term lies in a text if it lies in one of its tokens."""

    WIDTH = 62  # bits of a number

    def __init__(self, queries: list[str]) -> None:
        self.all = list(dict.fromkeys(t for q in queries for t in tx.query_tokens(q)))

    def near(self, stored: DataFrame, vocabulary: DataFrame) -> DataFrame:
        """The postings of tokens that hold a term: by a listed filter where few tokens do, else by a look at each token."""
        if not self.all:
            return stored.limit(0)
        held = lambda c: reduce(lambda a, b: a | b, [F.contains(c, F.lit(t)) for t in self.all])
        found = [r[0] for r in vocabulary.where(held(F.col("token"))).select("token").distinct().limit(LISTED + 1).collect()]
        return stored.where(F.col("token").isin(found) if len(found) <= LISTED else held(F.col("token")))

    def bits(self, near: DataFrame) -> DataFrame:
        """(hash, m0, m1 ...): a bit for each term that a content holds."""
        parts = [self.all[i : i + self.WIDTH] for i in range(0, len(self.all), self.WIDTH)]
        bits = lambda part: reduce(lambda a, b: a + b, [F.contains("token", F.lit(t)).cast("long") * (1 << k) for k, t in enumerate(part)])
        return near.groupBy("hash").agg(*[F.bit_or(bits(part)).alias(f"m{i}") for i, part in enumerate(parts)]) if parts else near.select("hash").distinct()

    def masks(self, stored: DataFrame, vocabulary: DataFrame) -> DataFrame:
        """bits() of the postings; only tokens with a term are read."""
        return self.bits(self.near(stored, vocabulary))

    def in_body(self, term: str) -> Column:
        k = self.all.index(term)
        return F.coalesce(F.col(f"m{k // self.WIDTH}").bitwiseAND(F.lit(1 << k % self.WIDTH)) != 0, F.lit(False))

    def overlap(self, terms: list[str], title: Column) -> Column:
        if not terms:
            return F.lit(0.0)
        return reduce(lambda a, b: a + b, [(F.contains(title, F.lit(t)) | self.in_body(t)).cast("int") for t in terms]) / F.lit(float(len(terms)))


def _with_masks(documents: DataFrame, terms: Terms, stored: DataFrame, vocabulary: DataFrame, collection: str | None) -> DataFrame:
    own = documents.where("active")
    own = own.where(F.col("collection") == collection) if collection else own
    own = own.select("id", "hash", file(F.col("collection"), F.col("path")).alias("file"), F.lower("title").alias("low"), F.lower(F.concat_ws(" ", "path", "title")).alias("meta"))
    return own.join(terms.masks(stored, vocabulary), "hash", "left")


def lexical_stored_many(documents: DataFrame, content: DataFrame, stored: DataFrame, vocabulary: DataFrame, queries: list[str], limit: int = 10, min_score: float = 0.0, collection: str | None = None) -> DataFrame:
    """What lexical_many() gives, from postings: bodies are read only of contents that hold all words of a phrase and whose
    place among the best depends on whether they hold the phrase itself."""
    terms = Terms([q for _, _, _, q in _forms(queries)])
    own = _with_masks(documents, terms, stored, vocabulary, collection)
    quality = tx.path_quality(F.col("file"))
    if not queries or not _forms(queries):
        return lexical_many(documents.withColumn("body", F.lit("")), [])
    made = []
    for i, k, w, q in _forms(queries):
        words = tx.query_tokens(q)
        base = 0.78 * terms.overlap(words, F.col("low"))
        sure = F.contains("meta", F.lit(q.lower()))
        may = reduce(lambda a, b: a & b, [F.contains("meta", F.lit(t)) | terms.in_body(t) for t in words], F.lit(True))
        scored = lambda x, w=w, base=base: F.round((base + 0.22 * x.cast("double")) * w * quality, 6)
        made.append(F.struct(F.lit(i).alias("query"), F.lit(k).alias("variant"), F.lit(q.lower()).alias("phrase"), scored(sure).alias("low"), scored(sure | may).alias("high")))
    each = own.select("id", "file", "hash", F.explode(F.array(*made)).alias("f")).select("f.query", "id", "file", "hash", "f.variant", "f.phrase", F.col("f.low").alias("score"), "f.high").where("high > 0")
    each = materialize(each, "lexical")
    best = _top(_best_of(each.where("score > 0")), limit)  # the least that the best can have
    least = {r["query"]: r["s"] for r in best.groupBy("query").agg(F.min("score").alias("s"), F.count("*").alias("n")).where(F.col("n") >= limit).collect()}
    bar = F.coalesce(F.create_map(*[F.lit(x) for kv in least.items() for x in kv])[F.col("query")], F.lit(0.0)) if least else F.lit(0.0)
    open_ = each.where((F.col("high") > F.col("score")) & (F.col("high") >= bar))
    bodies = among(content, "hash", open_).select("hash", F.lower("body").alias("low_body"))
    metas = documents.select("id", F.lower(F.concat_ws(" ", "path", "title")).alias("meta"))
    told = open_.join(bodies, "hash").join(metas, "id").where(F.contains(F.concat_ws(" ", "meta", "low_body"), F.col("phrase")))
    told = told.select("query", "id", "file", "hash", "variant", F.col("high").alias("score"))
    found = each.select("query", "id", "file", "hash", "variant", "score").unionByName(told).where("score > 0")
    return _top(_best_of(found).where(F.col("score") >= min_score), limit).select(*_HIT)


def vector_stored_many(documents: DataFrame, vectors: DataFrame, bands: DataFrame, stored: DataFrame, vocabulary: DataFrame, queries: list[str], limit: int = 10, collection: str | None = None, exact: bool = False) -> DataFrame:
    """(query, id, file, hash, score, variant) by cosine with the stored vectors, and overlap from postings; no body is read.

    Contents that share a band with a query are its candidates; a query that shares none, and with ``exact`` every query,
    meets all vectors.
    """
    spark = documents.sparkSession
    asked = [vec.query_vector(q) for q in queries]
    known = spark.createDataFrame([(i, b, u) for i, v in enumerate(asked) for b, u in vec.query_bands(v) if not exact], "query int, band int, bucket bigint")
    listed = among(bands, "bucket", known.select("bucket"))
    near = materialize(listed.join(F.broadcast(known), ["band", "bucket"]).select("query", "hash").distinct(), "near")  # eight bands a query
    some = [r["query"] for r in near.select("query").distinct().collect()]
    q = F.array(*[F.array(*[F.lit(x) for x in v]) for v in asked])
    each = among(vectors, "hash", near).select("hash", "qvec").join(near, "hash").select("query", "hash", "qvec")
    rest = [i for i in range(len(queries)) if i not in some]
    if rest:
        each = each.unionByName(vectors.select(F.explode(F.array(*map(F.lit, rest))).alias("query"), "hash", "qvec"))
    cosines = each.select("query", "hash", vec.cosine(F.col("qvec"), q[F.col("query")]).alias("cos")).where("cos > 0")
    terms = Terms(queries)
    own = _with_masks(documents, terms, stored, vocabulary, collection)
    files = own.select("id", "file", "hash", F.array(*[terms.overlap(tx.query_tokens(x), F.col("low")) for x in queries]).alias("overlaps"))
    score = (VECTOR_COSINE * F.col("cos") + VECTOR_OVERLAP * F.col("overlaps")[F.col("query")]) * tx.path_quality(F.col("file"))
    scored = files.join(cosines, "hash").select("query", "id", "file", "hash", F.round(score, 6).alias("score"), F.lit(0).alias("variant"))
    return _top(_best_of(scored), limit).select(*_HIT)


def expand_query(query: str) -> list[str]:
    """The query, its lower case, with synonyms put in by substring, and its tokens joined where there are more than two."""
    query = query.strip()
    if not query:
        return []
    changed = query.lower()
    for word, other in SYNONYMS:
        changed = changed.replace(word, other)
    terms = tx.query_tokens(query)
    found = [query, query.lower(), " ".join(changed.split()), *([" ".join(terms)] if len(terms) > 2 else [])]
    return list(dict.fromkeys(x for x in found if x))


def dedup_hits(hits: DataFrame) -> DataFrame:
    """Per document the best hit; NaN is above all numbers."""
    best = hits.groupBy("id").agg(F.min(F.struct((~F.isnan("score")).alias("number"), (-F.col("score")).alias("minus"), "file")).alias("b"))
    return best.select("id", "b.file", (-F.col("b.minus")).alias("score"))


def hybrid(rows: DataFrame, query: str, limit: int = 10, min_score: float = 0.0) -> DataFrame:
    """(id, file, title, score): both searches for every form of the query, best hit per document, reranked by overlap.

    Each search contributes at most ``limit`` rows, so what is merged is bounded by forms times two times limit.
    """
    forms = expand_query(query)
    if not forms:
        raise ValueError("the query is empty")
    legs = [leg(rows, forms, limit).select("id", "file", "score") for leg in (lexical_or_fallback_many, vector_hashed_many)]
    merged = dedup_hits(legs[0].unionByName(legs[1]))
    shown = with_snippets(merged, rows, query)
    again = RERANK_OLD * F.col("score") + RERANK_OVERLAP * tx.overlap(tx.query_tokens(query), F.lower(F.concat_ws(" ", "title", "snippet")))
    ranked = shown.select("id", "file", "title", F.round(again, 6).alias("score"))
    return ranked.where(F.col("score") >= min_score).orderBy(F.desc("score"), "file", "id").limit(limit)


#: How a model's scores are blended in, and for how many hits.
MODEL_OLD, MODEL_SCORE, MODEL_HITS = 0.62, 0.38, 20


def blended(hits: DataFrame, scores: DataFrame) -> DataFrame:
    """(query, id, file, score) with a model's scores (query, idx, score) blended into the first hits of each query.

    idx counts hits from 0 by score, then file, then id; scores are cut to [0, 1], of several the highest counts; a hit without
    one keeps its own.
    """
    first = _top(hits, MODEL_HITS).select("query", "id", "file")
    idx = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "file", "id")) - 1
    placed = hits.join(first, ["query", "id", "file"], "left_semi").withColumn("idx", idx)  # MODEL_HITS rows a query
    given = scores.groupBy("query", "idx").agg(F.max("score").alias("given"))
    told = placed.join(given, ["query", "idx"]).select("query", "id", "file", F.greatest(F.lit(0.0), F.least(F.lit(1.0), "given")).alias("given"))
    again = F.when(F.col("given").isNotNull(), MODEL_OLD * F.col("score") + MODEL_SCORE * F.col("given")).otherwise(F.col("score"))
    return hits.join(told, ["query", "id", "file"], "left").select("query", "id", "file", F.round(again, 6).alias("score"))


def model_variants(answer: Column, query: Column, limit: int = 4) -> Column:
    """A model's forms of a query from its JSON answer: trimmed, without empty ones, the first few; else the query itself."""
    forms = F.coalesce(F.from_json(answer, "array<string>"), F.array(query))
    return F.slice(F.filter(F.transform(forms, lambda x: F.trim(x)), lambda x: x != ""), 1, limit)


def hybrid_stored(documents: DataFrame, content: DataFrame, stored: DataFrame, vocabulary: DataFrame, vectors: DataFrame, bands: DataFrame, query: str, limit: int = 10, min_score: float = 0.0) -> DataFrame:
    """What hybrid() gives, over stored tables: bodies are read of the hits that are merged and where a phrase is in doubt."""
    forms = expand_query(query)
    if not forms:
        raise ValueError("the query is empty")
    words = lexical_stored_many(documents, content, stored, vocabulary, forms, limit)
    near = vector_stored_many(documents, vectors, bands, stored, vocabulary, forms, limit)
    merged = materialize(dedup_hits(words.select("id", "file", "score").unionByName(near.select("id", "file", "score"))), "merged")
    own = documents.join(F.broadcast(merged.select("id")), "id", "left_semi")  # forms times two times limit rows
    rows = own.join(among(content, "hash", own), "hash")
    shown = with_snippets(merged, rows, query)
    again = RERANK_OLD * F.col("score") + RERANK_OVERLAP * tx.overlap(tx.query_tokens(query), F.lower(F.concat_ws(" ", "title", "snippet")))
    ranked = shown.select("id", "file", "title", F.round(again, 6).alias("score"))
    return ranked.where(F.col("score") >= min_score).orderBy(F.desc("score"), "file", "id").limit(limit)


#: Documents whose scores a task of a batch holds at a time.
BATCH_DOCUMENTS = 8192


def batch_lexical(rows: DataFrame, queries: DataFrame, limit: int = 3) -> DataFrame:
    """(query_id, id, score) for a table of queries (query_id, query): share of the query's tokens among the body's tokens.

    An inverted join: distinct tokens of queries meet distinct tokens of bodies on equal keys, counts are summed before the
    shuffle, so the plan holds for many queries and never pairs a query with a body that shares nothing.
    """
    asked = queries.select("query_id", F.explode(F.array_distinct(tx.tokens(F.col("query")))).alias("token"))
    sizes = asked.groupBy("query_id").agg(F.count("*").alias("terms"))
    held = rows.where("active").select("id", F.explode(F.array_distinct(tx.tokens(F.col("body")))).alias("token"))
    parts = max(rows.where("active").count() // BATCH_DOCUMENTS + 1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    wanted = held.join(asked.select("token").distinct(), "token", "left_semi").repartition(parts, "id")  # a task's share stays as it is
    hits = wanted.join(asked, "token").groupBy("query_id", "id").agg(F.count("*").alias("hits"))
    # a query's scores have one divisor, so hits rank them; only the best rows meet the sizes
    ranked = hits.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("hits"), "id"))).where(F.col("rank") <= limit)
    return ranked.join(sizes, "query_id").select("query_id", "id", F.round(F.col("hits") / F.col("terms"), 6).alias("score"), F.col("rank").cast("long").alias("rank"))
