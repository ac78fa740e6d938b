"""Benchmark decontamination by a distributed positional inverted index.

Words of the corpus are written as postings, in segments of some 260,000 positions: a segment lists its distinct words (as
64-bit hashes, sorted) and, for each, the ascending positions at which it stands. A segment is one row of a Parquet table,
so segments are searched wherever they lie and nothing is shuffled to build or to read them. Documents of a segment are
apart by more positions than a phrase has, so no match crosses from one to the next; a document that is longer than a
segment is cut into pieces, each with as much of its neighbours as a phrase can reach, and every word is owned by one piece.

A test phrase is found by intersection: its words are ordered by how often they stand in the segment, the rarest word's
postings, moved back by the word's offset, are the candidate starts, and every next word's postings, moved likewise, thin
them out. A word that the segment lacks ends a phrase at once. With ``slop`` a word may stand that many places from its own,
which gives proximity matches. The phrases of a test set are few beside the corpus; they go to the segments in blocks of a
fixed number, so neither the driver nor a task holds more than a block.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import only, prepare, released, texts
from tessera.session import discard, materialize

LONGEST, SEGMENT, BLOCK = 10, 1 << 18, 200_000
#: A phrase reaches no farther than this, its slop included; pieces and documents lie farther apart.
REACH, GAP = 24, 64
_TEXT, _WORDS, _WORK = 1 << 22, 1 << 20, 1 << 20

_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


class _Hashes(dict):
    """XXH64 of words as signed numbers; a bounded memo."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) > _WORDS:
            self.clear()
        h = xxhash.xxh64_intdigest(word)
        self[word] = h = h - (1 << 64) if h >> 63 else h
        return h


def word_ids(text: bytes, hashes: dict) -> np.ndarray:
    """The words of a UTF-8 text as hashes: A-Z lowered, runs of digits, a-z and characters beyond ASCII; cut in parts."""
    found, at = [], 0
    while at < len(text):
        part = text[at : at + _TEXT].translate(_TABLE)
        at += len(part)
        more = []
        while at < len(text) and not part.endswith(b" "):  # up to the end of the word
            end = text[at : at + 4096].translate(_TABLE)
            cut = end.find(b" ")
            end = end if cut < 0 else end[: cut + 1]
            at += len(end)
            more.append(end)
            if cut >= 0:
                break
        words = b"".join([part, *more]).split()
        found.append(np.fromiter(map(hashes.__getitem__, words), np.int64, len(words)))
    return np.concatenate(found) if found else np.empty(0, np.int64)


# ---- the index

INDEX = "segment bigint, uid array<bigint>, doc_id array<bigint>, lo array<int>, hi array<int>, words binary, ends binary, positions binary"


class _Segment:
    def __init__(self, number: int) -> None:
        self.number, self.size, self.pieces, self.ids, self.at = number, 0, [], [], []

    def add(self, uid: int, doc_id, ids: np.ndarray, lo: int, hi: int) -> None:
        self.pieces.append((uid, doc_id, self.size + lo, self.size + hi))
        self.ids.append(ids)
        self.at.append(np.arange(self.size, self.size + len(ids), dtype=np.int32))
        self.size += len(ids) + GAP

    def row(self) -> dict:
        ids, at = np.concatenate(self.ids), np.concatenate(self.at)
        order = np.argsort(ids, kind="stable")
        ids = ids[order]
        ends = np.flatnonzero(np.diff(ids, append=ids[-1:] + 1 if len(ids) else [])) + 1 if len(ids) else np.empty(0, np.int64)
        uid, doc_id, lo, hi = zip(*self.pieces, strict=True)
        return {"segment": self.number, "uid": uid, "doc_id": doc_id, "lo": lo, "hi": hi, "words": ids[ends - 1].tobytes(), "ends": ends.astype(np.int32).tobytes(), "positions": at[order].tobytes()}


def _indexed(size: int):
    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        i32, i64 = pa.int32(), pa.int64()
        schema = pa.schema([("segment", i64), ("uid", pa.list_(i64)), ("doc_id", pa.list_(i64)), ("lo", pa.list_(i32)), ("hi", pa.list_(i32)), ("words", pa.binary()), ("ends", pa.binary()), ("positions", pa.binary())])
        hashes, base = _Hashes(), TaskContext.get().partitionId() << 33
        uid, number = base, base
        now = _Segment(number)
        for b in batches:
            for doc_id, text in zip(b.column("doc_id").to_pylist(), texts(b.column("text")), strict=True):
                ids = word_ids(text, hashes)
                for first in range(0, max(len(ids), 1), size):
                    last = min(first + size, len(ids))
                    left, right = max(0, first - REACH), min(len(ids), last + REACH)
                    now.add(uid, doc_id, ids[left:right], first - left, last - left)
                    if now.size >= size:
                        yield pa.RecordBatch.from_pylist([now.row()], schema)
                        number += 1
                        now = _Segment(number)
                uid += 1
        if now.pieces:
            yield pa.RecordBatch.from_pylist([now.row()], schema)

    return run


def index(docs: DataFrame, size: int = SEGMENT) -> DataFrame:
    """The written index of whole texts, a row per segment; rows of equal doc_id, and of none, stay apart by a number of their own."""
    prepare(docs.sparkSession)
    slim = only(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return materialize(slim.mapInArrow(released(_indexed(size)), INDEX), "postings")


# ---- test phrases

PHRASES = "item string, words binary"


def _windows(longest: int):
    def run(batches):
        import pyarrow as pa

        hashes = _Hashes()
        for b in batches:
            for item, text in zip(b.column("item").to_pylist(), texts(b.column("text")), strict=True):
                ids = word_ids(text, hashes)
                n = min(len(ids), longest)
                if n:
                    each = np.lib.stride_tricks.sliding_window_view(ids, n)
                    for at in range(0, len(each), 4096):
                        rows = [w.tobytes() for w in each[at : at + 4096]]
                        yield pa.RecordBatch.from_arrays([pa.array([item] * len(rows), pa.string()), pa.array(rows, pa.binary())], names=["item", "words"])

    return run


def windows(items: DataFrame, longest: int = LONGEST) -> DataFrame:
    """(item, words): every distinct window of ``longest`` words of an item (item_id, text), or all words of a shorter one."""
    prepare(items.sparkSession)
    slim = only(items, "item_id", "text").select(F.col("item_id").cast("string").alias("item"), "text")
    return materialize(slim.mapInArrow(released(_windows(longest)), PHRASES).distinct(), "phrases")


class Phrases:
    """A block of phrases, ready to be looked up in a segment."""

    def __init__(self, rows: list[tuple[str | None, bytes]]) -> None:
        distinct = {w: i for i, w in enumerate(sorted({w for _, w in rows}))}
        words = [np.frombuffer(w, np.int64) for w in distinct]
        self.length = np.array([len(w) for w in words], dtype=np.int64)
        width = int(self.length.max(initial=1))
        self.words = np.unique(np.concatenate([np.empty(0, np.int64), *words]))
        self.term = np.zeros((len(words), width), dtype=np.int64)
        for i, w in enumerate(words):
            self.term[i, : len(w)] = np.searchsorted(self.words, w)
        self.inside = np.arange(width)[None, :] < self.length[:, None]
        self.names = sorted({x for x, _ in rows if x is not None})
        place = {x: i for i, x in enumerate(self.names)}
        own = sorted((distinct[w], place[x]) for x, w in rows if x is not None)
        self.item = np.array([i for _, i in own], dtype=np.int64)
        self.first = np.searchsorted(np.array([p for p, _ in own], dtype=np.int64), np.arange(len(words) + 1))

    def items_of(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place in ``phrases``, item) of every item that has one of them."""
        n = self.first[phrases + 1] - self.first[phrases]
        at = np.repeat(np.arange(len(phrases)), n)
        return at, self.item[_ranges(self.first[phrases], n)]

    def find(self, words: np.ndarray, ends: np.ndarray, positions: np.ndarray, slop: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """(phrase, start) of every match in a segment, by intersection from the rarest word outwards."""
        if not len(words) or not len(self.words):
            return np.empty(0, np.int64), np.empty(0, np.int64)
        at = np.minimum(np.searchsorted(words, self.words), len(words) - 1)
        starts = np.concatenate([[0], ends[:-1]])[at]
        held = np.where(words[at] == self.words, ends[at] - starts, 0)
        counts = np.where(self.inside, held[self.term], len(positions) + 1)
        open_ = np.flatnonzero(counts.min(1) > 0)
        order = np.argsort(counts[open_], axis=1, kind="stable")
        keys = (np.repeat(np.arange(len(words)), np.diff(ends, prepend=0)) << 32) + positions
        size = counts[open_, order[:, 0]]
        chunk = (np.cumsum(size) - size) // _WORK
        bounds = [0, *(np.flatnonzero(np.diff(chunk)) + 1).tolist(), len(open_)] if len(open_) else []
        found = [(np.empty(0, np.int64), np.empty(0, np.int64))]
        for x, y in zip(bounds[:-1], bounds[1:], strict=True):
            rank = np.repeat(np.arange(x, y), size[x:y])
            phrase, offset = open_[rank], order[rank, 0]
            start = positions[_ranges(starts[self.term[open_[x:y], order[x:y, 0]]], size[x:y])] - offset
            if slop:  # the first word's own places
                first = at[self.term[phrase, 0]] << 32
                off = np.where(offset > 0, slop, 0)
                low, high = np.searchsorted(keys, first + start - off), np.searchsorted(keys, first + start + off, side="right")
                start = positions[_ranges(low, high - low)]
                rank, start = np.unique(np.stack([np.repeat(rank, high - low), start]), axis=1)
                phrase = open_[rank]
            for k in range(1, self.term.shape[1]):
                more = np.flatnonzero(self.length[phrase] > k)
                place = order[rank[more], k]
                want = (at[self.term[phrase[more], place]] << 32) + start[more] + place
                i = np.minimum(np.searchsorted(keys, want - slop), len(keys) - 1)
                good = np.ones(len(phrase), dtype=bool)
                good[more] = (keys[i] >= want - slop) & (keys[i] <= want + slop)
                rank, phrase, start = rank[good], phrase[good], start[good]
            found.append((phrase, start))
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _ranges(first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """first[0], first[0] + 1, ... (n[0] of them), then those of first[1] and so on."""
    return np.repeat(first - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())


def _segments(batch):
    numbers = lambda data, kind: np.frombuffer(data, kind).astype(np.int64) if data else np.empty(0, np.int64)
    for uid, doc_id, lo, hi, words, ends, positions in zip(*(batch.column(c) for c in ("uid", "doc_id", "lo", "hi", "words", "ends", "positions")), strict=True):
        yield uid.values, doc_id.values, lo.values.to_numpy(), hi.values.to_numpy(), numbers(words.as_py(), np.int64), numbers(ends.as_py(), np.int32), numbers(positions.as_py(), np.int32)


def _piece(lo: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The piece in whose copy of the document each position lies."""
    return np.clip(np.searchsorted(lo - REACH, at, side="right") - 1, 0, len(lo) - 1)


def _matched(phrases: Phrases, slop: int):
    """Every match: a row for each item that has its phrase, by the piece that owns the first word."""

    def run(batches):
        import pyarrow as pa

        names = pa.array(phrases.names, pa.string())
        for b in batches:
            for uid, doc_id, lo, hi, words, ends, positions in _segments(b):
                phrase, start = phrases.find(words, ends, positions, slop)
                piece = _piece(lo, start)
                own = (start >= lo[piece]) & (start < hi[piece])
                phrase, start, piece = phrase[own], start[own], piece[own]
                at, item = phrases.items_of(phrase)
                at_piece = pa.array(piece[at])
                yield pa.RecordBatch.from_arrays([uid.take(at_piece), doc_id.take(at_piece), names.take(pa.array(item)), pa.array((start[at] - lo[piece[at]]).astype(np.int64)), pa.array(phrases.length[phrase[at]])], names=["uid", "doc_id", "item", "start", "length"])

    return run


def _hit(phrases: Phrases):
    """A row per piece: its words, the runs of them that lie in a match, and the items whose phrases they are."""

    def run(batches):
        import pyarrow as pa

        run_type = pa.struct([("lo", pa.int32()), ("hi", pa.int32())])
        for b in batches:
            for segment, (uid, doc_id, lo, hi, words, ends, positions) in zip(b.column("segment").to_pylist(), _segments(b), strict=True):
                phrase, start = phrases.find(words, ends, positions)
                steps = np.zeros(int(hi.max()) + GAP + 1, dtype=np.int32)
                np.add.at(steps, start, 1)
                np.add.at(steps, start + phrases.length[phrase], -1)
                inside = np.zeros(len(steps) + 1, dtype=np.int8)
                inside[:-1] = np.cumsum(steps) > 0
                edge = np.flatnonzero(np.diff(inside, prepend=0))
                runs = edge.reshape(-1, 2)
                # a run can lie in two pieces' copies, never in two documents: each piece keeps what it owns
                piece = _piece(lo, runs[:, 0])
                kept = [[] for _ in range(len(lo))]
                for (x, y), p in zip(runs.tolist(), piece.tolist(), strict=True):
                    x, y = max(x, int(lo[p])), min(y, int(hi[p]))
                    if x < y:
                        kept[p].append({"lo": x, "hi": y})
                touched = _piece(lo, start)
                at, item = phrases.items_of(phrase)
                pairs = np.unique(touched[at] * max(1, len(phrases.names)) + item)
                items = [[] for _ in range(len(lo))]
                for x in pairs.tolist():
                    items[x // len(phrases.names)].append(phrases.names[x % len(phrases.names)])
                yield pa.RecordBatch.from_arrays([pa.array([segment] * len(lo), pa.int64()), uid, doc_id, pa.array(lo, pa.int32()), pa.array(hi - lo, pa.int64()), pa.array(kept, pa.list_(run_type)), pa.array(items, pa.list_(pa.string()))], names=["segment", "uid", "doc_id", "lo", "n_words", "runs", "items"])

    return run


def _blocks(found: DataFrame, block: int):
    """The phrases in blocks of about ``block`` rows, read to the driver one by one; an empty one where there are none."""
    n = -(-found.count() // block) or 1
    numbered = found.withColumn("block", F.pmod(F.xxhash64("item", "words"), F.lit(n)))
    for i in range(n):
        yield Phrases([(r["item"], bytes(r["words"])) for r in (numbered.where(F.col("block") == i) if n > 1 else found).collect()])


def matches(stored: DataFrame, items: DataFrame, slop: int = 0, longest: int = LONGEST, block: int = BLOCK) -> DataFrame:
    """(uid, doc_id, item, start, length): every place of a window's first word from which the window stands in a document.

    With ``slop`` every other word may stand up to so many places from its own. ``start`` counts from the first word that
    the document's piece owns (of the document, unless that is longer than a segment).
    """
    if longest + slop > REACH:
        raise ValueError(f"a phrase and its slop reach beyond {REACH} words")
    out = None
    for phrases in _blocks(windows(items, longest), block):
        own = stored.mapInArrow(released(_matched(phrases, slop)), "uid bigint, doc_id bigint, item string, start bigint, length bigint")
        out = own if out is None else out.unionByName(own)
    return out


def contaminated(docs: DataFrame, items: DataFrame, longest: int = LONGEST, size: int = SEGMENT, block: int = BLOCK) -> DataFrame:
    """A row per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated.

    Null and empty texts have no words and are in no way hit; items without words have no window; items of fewer words
    than a window are one. A null item_id's windows hit words but are no item's; rows of one item_id are one item. Repeated
    documents, and those with null or equal ids, each keep a row. An empty table of documents gives none, an empty one of
    items no hits. Texts of any length are searched whole. Further columns are not read.
    """
    if longest > REACH:
        raise ValueError(f"a phrase reaches beyond {REACH} words")
    stored, found = index(docs, size), windows(items, longest)
    schema = "segment bigint, uid bigint, doc_id bigint, lo int, n_words bigint, runs array<struct<lo:int,hi:int>>, items array<string>"
    parts = [materialize(stored.mapInArrow(released(_hit(p)), schema), "phrase-hits") for p in _blocks(found, block)]
    discard(stored)
    discard(found)
    pieces = parts[0]
    if len(parts) > 1:  # what several blocks hit in a piece is counted once
        every = pieces
        for more in parts[1:]:
            every = every.unionByName(more)
        pieces = every.groupBy("segment", "uid", "doc_id", "lo").agg(F.max("n_words").alias("n_words"), F.sort_array(F.flatten(F.collect_list("runs"))).alias("runs"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"))
    covered = F.expr("aggregate(runs, struct(0L AS n, 0 AS at), (s, r) -> struct(s.n + greatest(r.hi - greatest(r.lo, s.at), 0) AS n, greatest(s.at, r.hi) AS at), s -> s.n)")
    each = pieces.select("uid", "doc_id", "n_words", covered.alias("n_hit"), "items")
    whole = each.groupBy("uid", "doc_id").agg(F.sum("n_words").alias("n_words"), F.sum("n_hit").alias("n_hit"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    return whole.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))
