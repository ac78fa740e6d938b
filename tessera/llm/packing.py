"""Packing documents into sequences by an order-preserving dynamic program.

Documents are dealt by doc_id range and stay in order. Within a task the stream of tokens is cut into windows of at most
``size`` tokens; cuts lie at document ends (free), sentence ends (a small penalty) or, where neither comes for long, at
set places inside (a larger one). The program minimises padding plus penalties over all cuts: a window pays what it is
short of ``size`` unless its length is a power of two, and a constant. The best predecessor of a cut minimises cost plus
position over the last ``size`` tokens, a sliding minimum that a monotone queue keeps; the few predecessors at a power of
two are tried beside it. Tokens are handled in blocks, and the last windows of a block are cut again with the next.
"""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import DataFrame

from tessera.llm.common import prepare, released
from tessera.llm.tokenfiles import in_order
from tessera.llm.tokens import default_path, encoder, sentence_tables

SIZE = 1024
#: Tokens of a block, penalties for a cut at a sentence end and elsewhere, cost of a sequence, and the distance between
#: places where a passage without sentence ends may be cut.
BLOCK, SENTENCE, INSIDE, SEQUENCE, STEP = 1 << 18, 8, 48, 16, 64


def cut_places(ids: np.ndarray, doc_ends: np.ndarray, ends: np.ndarray, starts: np.ndarray, step: int = STEP) -> tuple[np.ndarray, np.ndarray]:
    """Positions where the stream may be cut, with their penalties; 0 and the stream's end are the first and the last."""
    penalty = np.full(len(ids) + 1, -1, dtype=np.int64)
    if len(ids) > 1:
        penalty[1:-1][ends[ids[:-1]] & starts[ids[1:]]] = SENTENCE
    penalty[doc_ends] = 0
    penalty[0] = penalty[-1] = 0
    at = np.flatnonzero(penalty >= 0)
    gaps = np.diff(at)
    wide = np.flatnonzero(gaps > step)
    if len(wide):
        inner = np.concatenate([np.arange(at[i] + step, at[i + 1], step) for i in wide])
        penalty[inner] = INSIDE
        at = np.flatnonzero(penalty >= 0)
    return at, penalty[at]


def windows(at: np.ndarray, penalty: np.ndarray, size: int = SIZE) -> list[int]:
    """Indices into ``at`` of the cuts of least cost, without the first; neighbours in ``at`` are at most ``size`` apart."""
    n = len(at)
    where = np.full(int(at[-1]) + 1, -1, dtype=np.int32)
    where[at] = np.arange(n)
    others: dict[int, list[int]] = {}
    length = 1
    while length < size:
        later = np.flatnonzero(at >= length)
        found = where[at[later] - length]
        for k, i in zip(later[found >= 0].tolist(), found[found >= 0].tolist(), strict=True):
            others.setdefault(k, []).append(i)
        length *= 2
    place, extra = at.tolist(), penalty.tolist()
    cost, back = [0] * n, [0] * n
    queue, head = [0], 0  # indices with rising cost + position
    level = [0] * n
    for k in range(1, n):
        here = place[k]
        oldest = here - size
        while place[queue[head]] < oldest:
            head += 1
        i = queue[head]
        best = level[i] + size - here
        for j in others.get(k, ()):
            if cost[j] < best:
                best, i = cost[j], j
        best += extra[k] + SEQUENCE
        cost[k], back[k] = best, i
        key = level[k] = best + here
        while len(queue) > head and level[queue[-1]] >= key:
            queue.pop()
        queue.append(k)
    cuts, k = [], n - 1
    while k:
        cuts.append(k)
        k = back[k]
    return cuts[::-1]


class _Stream:
    """The documents (or what is left of them) that are not in a finished window yet."""

    def __init__(self, tables, sequence: int, size: int = SIZE) -> None:
        self.tables, self.sequence, self.size = tables, sequence, size
        self.docs: list[tuple[int | None, int, int, np.ndarray]] = []  # id, tokens of the document, start in it, ids
        self.held = 0

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.docs.append((doc_id, len(ids), 0, ids))
        self.held += len(ids)

    def cut(self, last: bool) -> list[tuple]:
        """Pieces of finished windows: (doc_id, start, length, crc, doc_tokens, sequence, offset)."""
        if not self.docs:
            return []
        ids = np.concatenate([d[3] for d in self.docs])
        doc_ends = np.cumsum([len(d[3]) for d in self.docs])
        at, penalty = cut_places(ids, doc_ends, *self.tables)
        cuts = at[windows(at, penalty, self.size)].tolist()
        if not last:
            cuts = cuts[:-2]  # the block's end is no place to stop at
        out, d, done, was = [], 0, 0, 0  # done: position in the stream where document d begins
        for end in cuts:
            begin = was
            while was < end:
                doc_id, total, start, own = self.docs[d]
                a, b = was - done, min(end - done, len(own))
                out.append((doc_id, start + a, b - a, zlib.crc32(own[a:b].tobytes()), total, self.sequence, was - begin))
                was = done + b
                if b == len(own):
                    d, done = d + 1, done + len(own)
            self.sequence += 1
        rest = self.docs[d:]
        if rest and was > done:
            doc_id, total, start, own = rest[0]
            rest[0] = (doc_id, total, start + was - done, own[was - done :])
        self.docs, self.held = rest, self.held - was
        return out


COLUMNS = ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def _batch(pieces: list[tuple]):
    import pyarrow as pa

    columns = list(zip(*pieces, strict=True)) if pieces else [()] * len(COLUMNS)
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=list(COLUMNS))


def _pack(path: str, end_id: int, size: int, block: int):
    def run(batches):
        from pyspark import TaskContext

        context = TaskContext.get()
        stream = _Stream(sentence_tables(path), (context.partitionId() if context else 0) << 40, size)
        tokens = encoder(path)
        for b in batches:
            ids, counts = tokens.encode_batch(b.column("text"), end_id)
            for doc_id, own in zip(b.column("doc_id").to_pylist(), np.split(ids, np.cumsum(counts)[:-1]), strict=True):
                stream.add(doc_id, own)
                if stream.held >= block:
                    yield _batch(stream.cut(last=False))
        yield _batch(stream.cut(last=True))

    return run


def pack(docs: DataFrame, tokenizer: str | None = None, end_id: int = 0, size: int = SIZE, block: int = BLOCK) -> DataFrame:
    """A row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Each document's ids end with end_id; every id lies in one piece, pieces of a sequence follow each other from 0. Null
    text counts as empty and packs its end id; null and repeated doc_ids keep their rows, nulls first; an empty table
    gives none. Further columns are not read. A task holds a block of tokens and the documents it cuts, at most.
    """
    prepare(docs.sparkSession)
    return in_order(docs).mapInArrow(released(_pack(tokenizer or default_path(), end_id, size, block)), ", ".join(f"{c} bigint" for c in COLUMNS))
