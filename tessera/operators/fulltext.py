"""Ranked full-text search over positional postings: phrases, alternatives, exclusions, cover density, pruned top-k.

A content's postings hold each token once, with how often and where it stands (places count tokens, from 0). A document's
head, its path and title, has postings of its own whose places end at -1, so head and body are one text. Nothing reads a
body. Blocks tell, by token and power of two, how many contents hold the token so often. Postings lie in order of the token
and, falling, of that number, so the rows of a block are together in the files.

A query's rank is its cover density: a cover is a shortest span with a hit of every part of the query, and adds a tenth, less
the more words in it are no part of a hit. A token that stands n times bounds the rank, so the search reads the blocks of the
rarest token from the largest numbers down and stops where no block that is left can reach the last of the best rows.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import grouping
from tessera.functions import text as tx
from tessera.operators import search as se
from tessera.operators.store import file
from tessera.session import materialize, workers_import

#: How rank and overlap make a score, and what a cover without other words adds.
RANK, OVERLAP, COVER = 0.72, 0.28, 0.1
#: How many times the limit a first step reads, and how many times as much each next one.
FIRST, NEXT = 4, 16
HITS = "id bigint, file string, hash string, score double, variant int"


# ---- postings


#: Bytes of texts whose postings a task sorts.
SORTED_BYTES = 16 << 20
#: How segments are written.
SEGMENT_FILES = {"compression": "zstd", "parquet.block.size": str(32 << 20), "parquet.dictionary.page.size": str(8 << 20)}


def _grouped(rows: DataFrame, key: str, text: Column) -> DataFrame:
    """(token, key, n, size, at) of each row's text; keys are unique."""
    workers_import(rows.sparkSession)
    kind = rows.schema[key].dataType.simpleString()
    return rows.select(key, grouping.pieces(text)).mapInArrow(grouping.runs(key), f"token string, {key} {kind}, n int, size int, at array<int>")


def postings(content: DataFrame) -> DataFrame:
    """(token, hash, n, at) of each content (hash, body), in order of the token, then of how often it stands there.

    The texts' bytes tell the number of partitions, so that a task's share of the sort stays as it is when there are more.
    """
    parts = max((content.agg(F.sum(F.octet_length("body"))).first()[0] or 0) // SORTED_BYTES + 1, int(content.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    each = _grouped(content, "hash", F.col("body")).drop("size")
    return each.repartitionByRange(parts, "token", F.desc("n"), "hash").sortWithinPartitions("token", F.desc("n"), "hash")


def stored_segments(content: DataFrame) -> DataFrame:
    """The rows of postings() as a written table of segments: a run of contents' postings is sorted where it is read.

    Nothing is shuffled or sorted by Spark, a worker holds one segment, and within a segment's pages few hashes and tokens
    repeat, so dictionaries hold them: row groups are kept short enough for that.
    """
    workers_import(content.sparkSession)
    kind = content.schema["hash"].dataType.simpleString()
    each = content.select("hash", grouping.pieces(F.col("body"))).mapInArrow(grouping.segments("hash"), f"token string, hash {kind}, n int, at array<int>")
    return materialize(each, "postings", **SEGMENT_FILES)


def token_blocks(content: DataFrame) -> DataFrame:
    """blocks() of contents that need no postings: counted within short batches, then summed."""
    workers_import(content.sparkSession)
    each = content.select("hash", grouping.pieces(F.col("body"))).mapInArrow(grouping.levels, "token string, level int, docs bigint")
    return each.groupBy("token", "level").agg(F.sum("docs").alias("docs"))


def heads(documents: DataFrame) -> DataFrame:
    """(token, id, n, at) of path and title of the active documents, at places that end at -1."""
    each = _grouped(documents.where("active"), "id", F.concat_ws(" ", "path", "title"))
    each = each.select("token", "id", "n", F.transform("at", lambda x: x - F.col("size")).alias("at"))
    return each.repartitionByRange("token", "id").sortWithinPartitions("token", "id")


def blocks(stored: DataFrame) -> DataFrame:
    """(token, level, docs): how many contents hold a token 2**level times or more, and less than twice that."""
    return stored.groupBy("token", F.floor(F.log2("n")).cast("int").alias("level")).agg(F.count("*").alias("docs"))


# ---- queries


@dataclass
class Branch:
    """Parts that have to be there, each a run of tokens, and parts that must not."""

    parts: list[tuple[str, ...]] = field(default_factory=list)
    never: list[tuple[str, ...]] = field(default_factory=list)


def parse(query: str) -> list[Branch]:
    """Quoted phrases, ``or`` between alternatives, minus before what must not occur; a word of several tokens is a phrase."""
    out = [Branch()]
    for minus, quoted, word in re.findall(r'(-?)(?:"([^"]*)"|(\S+))', query):
        if word.lower() == "or" and not minus:
            out.append(Branch())
            continue
        tokens = tuple(tx.query_tokens(quoted or word))
        own = out[-1].never if minus else out[-1].parts
        if tokens and tokens not in own:
            own.append(tokens)
    return [b for b in out if b.parts]


def _hits(part: tuple[str, ...], at) -> Column:
    """Places where the tokens of a part stand one behind another."""
    return reduce(lambda a, iw: F.array_intersect(a, F.transform(at(iw[1]), lambda x: x - iw[0])), enumerate(part[1:], 1), at(part[0]))


def cover_density(parts: list[tuple[str, ...]], at) -> Column:
    """The rank of a text whose places of a token are ``at(token)``; 0 without a cover."""
    marked = lambda g, p: F.transform(_hits(p, at), lambda x: F.struct(x.alias("s"), (x + len(p) - 1).alias("e"), F.lit(g).alias("g"), F.lit(len(p)).alias("n")))
    each = [marked(g, p) for g, p in enumerate(parts)]
    null = F.lit(None).cast("int")
    last = F.array(*[F.struct(null.alias("s"), null.alias("e"), null.alias("w")) for _ in parts])
    start = F.struct(last.alias("last"), F.lit(0).alias("words"), null.alias("from"), F.lit(0.0).alias("rank"))

    def step(acc, hit):
        now = F.transform(acc["last"], lambda x, g: F.when(g == hit["g"], F.struct(hit["s"].alias("s"), hit["e"].alias("e"), acc["words"].alias("w"))).otherwise(x))
        words = acc["words"] + hit["n"]
        first = F.when(F.forall(now, lambda x: x["s"].isNotNull()), F.array_min(F.transform(now, lambda x: x["s"])))
        other = F.array_max(F.transform(now, lambda x: x["e"])) - first + 1 - (words - F.array_min(F.transform(now, lambda x: x["w"])))
        gain = F.when(first.isNotNull() & (acc["from"].isNull() | (first > acc["from"])), COVER / (1.0 + F.greatest(F.lit(0), other))).otherwise(0.0)
        return F.struct(now.alias("last"), words.alias("words"), F.coalesce(first, acc["from"]).alias("from"), (acc["rank"] + gain).alias("rank"))

    return F.aggregate(F.sort_array(F.flatten(F.array(*each))), start, step, lambda acc: acc["rank"])


def rank(branches: list[Branch], at) -> Column:
    """The greatest rank of a query's alternatives; 0 where none holds."""
    no = lambda b: reduce(lambda x, y: x & y, [F.size(_hits(p, at)) == 0 for p in b.never], F.lit(True))
    each = [F.when(no(b), cover_density(b.parts, at)).otherwise(0.0) for b in branches]
    return F.greatest(*each) if len(each) > 1 else each[0]


def _forms(query: str) -> list[tuple[int, float, list[Branch]]]:
    return [(k, w, b) for k, (w, q) in enumerate(tx.query_variants(query)) if (b := parse(q))]


def _tokens(forms) -> list[str]:
    return list(dict.fromkeys(t for _, _, branches in forms for b in branches for p in (*b.parts, *b.never) for t in p))


def _scores(forms, at, overlap: Column, quality: Column) -> Column:
    """An array of (variant, score) of the forms that match."""
    each = [F.struct(F.lit(k).alias("variant"), rank(b, at).alias("rank"), F.lit(w).alias("weight")) for k, w, b in forms]
    return F.transform(F.filter(F.array(*each), lambda x: x["rank"] > 0), lambda x: F.struct(x["variant"].alias("variant"), F.round((RANK * F.least(x["rank"], F.lit(1.0)) + OVERLAP * overlap) * x["weight"] * quality, 6).alias("score")))


# ---- search


def _steps(counts: dict[int, int], useful: list[int], limit: int) -> list[int]:
    """From which power of two on blocks are read, step by step; a step that would read most of all is left to the last."""
    steps, wanted = [], FIRST * limit
    for level in sorted(useful, reverse=True):
        held = sum(n for k, n in counts.items() if k >= level)
        if held >= wanted and held * FIRST <= sum(counts.values()):
            steps.append(level)
            wanted = NEXT * held
    return [*steps, 0]


@dataclass
class Read:
    """What a search has read: postings of the rarest tokens, by step."""

    postings: list[int] = field(default_factory=list)


def ranked(documents: DataFrame, head: DataFrame, stored: DataFrame, block: DataFrame, query: str, limit: int = 10, min_score: float = 0.0, collection: str | None = None, read: Read | None = None) -> DataFrame:
    """(id, file, hash, score, variant): the best contents by rank and overlap, from postings alone; empty queries find none."""
    forms = _forms(query)
    own = documents.where("active")
    own = own.where(F.col("collection") == collection) if collection else own
    own = own.select("id", "hash", file(F.col("collection"), F.col("path")).alias("file"), F.lower("title").alias("low"))
    if not forms:
        return own.select("id", "file", "hash", F.lit(0.0).alias("score"), F.lit(0).alias("variant")).limit(0)
    tokens = _tokens(forms)
    found = {(r["token"], r["level"]): r["docs"] for r in block.where(F.col("token").isin(tokens)).groupBy("token", "level").agg(F.sum("docs").alias("docs")).collect()}
    docs = {t: sum(n for (u, _), n in found.items() if u == t) for t in tokens}
    driving = {min((t for p in b.parts for t in p), key=lambda t: (docs[t], t)) for _, _, branches in forms for b in branches}
    ours, tops, rare = stored.where(F.col("token").isin(tokens)), head.where(F.col("token").isin(tokens)), F.col("token").isin(list(driving))
    words = se.Terms([query])
    near = words.near(stored, block)
    counts = {level: sum(n for (t, k), n in found.items() if k == level and t in driving) for level in {k for t, k in found if t in driving}}
    most, weight, steps = max(len(b.parts) for _, _, branches in forms for b in branches), max(w for _, w, _ in forms), [0]
    if sum(counts.values()) > FIRST * FIRST * limit:  # few postings are read at once
        in_head = tops.where(rare).agg(F.max("n")).first()[0] or 0
        quality = own.agg(F.max(tx.path_quality(F.col("file")))).first()[0] or 0.0
        reach = lambda level: COVER * most * (2**level - 1 + in_head)  # noqa: E731  the rank of what is not read
        steps = _steps(counts, [level for level in range(1, max(counts) + 1) if reach(level) < 1], limit)
    for level in steps:
        held = ours.where(rare & (F.col("n") >= 2**level)).select("hash")
        if read is not None:
            read.postings.append(held.count())
        candidates = own.join(held.distinct(), "hash", "left_semi")
        if level == 0:  # and those that hold it in the head alone
            candidates = candidates.unionByName(own.join(tops.where(rare).select("id").distinct(), "id", "left_semi")).dropDuplicates(["id"])
        best = _scored(candidates, ours, tops, words, near, forms, query, limit, min_score).collect()  # no more than the limit
        if level == 0 or (len(best) >= limit and min(r["score"] for r in best) > (RANK * reach(level) + OVERLAP) * weight * quality):
            break
    return documents.sparkSession.createDataFrame(best, HITS)


def _scored(candidates: DataFrame, ours: DataFrame, tops: DataFrame, words: se.Terms, near: DataFrame, forms, query: str, limit: int, min_score: float) -> DataFrame:
    places = F.map_from_entries(F.collect_list(F.struct("token", "at")))  # a query's tokens
    hashes, ids = candidates.select("hash").distinct(), candidates.select("id").distinct()
    body = ours.join(hashes, "hash", "left_semi").groupBy("hash").agg(places.alias("body"))
    top = tops.join(ids, "id", "left_semi").groupBy("id").agg(places.alias("top"))
    each = candidates.join(body, "hash", "left").join(top, "id", "left").join(words.bits(near.join(hashes, "hash", "left_semi")), "hash", "left")
    none = F.array().cast("array<int>")
    at = lambda t: F.concat(F.coalesce(F.col("top")[t], none), F.coalesce(F.col("body")[t], none))
    scores = _scores(forms, at, words.overlap(tx.query_tokens(query), F.col("low")), tx.path_quality(F.col("file")))
    scored = each.select("id", "file", "hash", F.explode(scores).alias("f")).select(F.lit(0).alias("query"), "id", "file", "hash", "f.variant", "f.score")
    return se._top(se._best_of(scored).where(F.col("score") >= min_score), limit).select("id", "file", "hash", "score", "variant")


def ranked_scan(rows: DataFrame, query: str, limit: int = 10, min_score: float = 0.0, collection: str | None = None) -> DataFrame:
    """What ranked() gives, over bodies."""
    forms = _forms(query)
    own = se._own(rows, collection)
    whole = F.filter(F.split(F.lower(F.concat_ws(" ", "path", "title", "body")), tx.TOKEN_SEPARATORS), lambda t: F.octet_length(t) >= 2)
    if not forms:
        return own.select("id", "file", "hash", F.lit(0.0).alias("score"), F.lit(0).alias("variant")).limit(0)
    own = own.select("*", F.explode(F.array(whole)).alias("tokens"))  # split once
    at = lambda t: F.filter(F.transform(F.col("tokens"), lambda x, i: F.when(x == t, i)), lambda i: i.isNotNull())
    scores = _scores(forms, at, tx.overlap(tx.query_tokens(query), F.col("hay")), tx.path_quality(F.col("file")))
    scored = own.select("id", "file", "hash", F.explode(scores).alias("f")).select(F.lit(0).alias("query"), "id", "file", "hash", "f.variant", "f.score")
    return se._top(se._best_of(scored).where(F.col("score") >= min_score), limit).select("id", "file", "hash", "score", "variant")
