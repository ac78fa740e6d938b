"""An interpolated modified Kneser-Ney bigram model: counted in Spark, kept as sorted hash arrays, memory-mapped to score.

Tokens are 64-bit hashes. Counting tasks sum the bigrams of bounded chunks and send them, packed by context, to shards
(the context's leading bits), as many as the corpus asks for. A shard's task folds what arrives into sorted distinct bigrams
piece by piece, so its memory follows distinct bigrams and not tokens, and writes sorted arrays: bigram hashes with counts,
contexts with how many words follow them once, twice and more often. Contexts that a sample shows to be frequent, and a
text's start, are spread over all shards by the bigram's hash, and what the shards find about them is summed afterwards;
where bigrams lie decides nothing else. What a shard found about each word (how many contexts it follows, how often) and
about frequent contexts goes on to shards by leading bits, which write their arrays too. Only a few numbers per shard reach
the driver. Tasks that score map the files they need, a bounded number at once, and search sorted queries in them, so the
model may exceed memory.

A shard's arrays are one file of each kind in the shared folder, which has to be mounted as a path on all machines. Files
appear under their name only when whole, so a task that runs again does no harm. The driver knows from the tasks' results
which files there are: one that is missing or cut off is an error, never a count of zero.
"""

from __future__ import annotations

import json
import os
import uuid
from collections import OrderedDict

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import only, prepare, released, texts
from tessera.session import scratch

#: Bigrams of a counting chunk, bigrams that a shard is laid out for, and its greatest number of shards (beyond it shards
#: grow with the number of distinct bigrams).
CHUNK, SHARD_BIGRAMS, SHARDS = 3_000_000, 1_500_000, 1 << 16
#: Rows that may gather beyond twice what is folded before they are folded too, and files that a process maps at once.
FOLD, MAPS = 2_000_000, 4096
#: Documents at most that show which contexts are frequent: those with over a quarter of a shard's share of the tokens.
SAMPLE = 2000
FOLDS, HELD = 7, 2
_K1, _K2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_CONTEXT = np.dtype([("once", "<u4"), ("twice", "<u4"), ("more", "<u4"), ("total", "<u8")])
_WORD = np.dtype([("contexts", "<u4"), ("count", "<u8")])
_FREQUENT = np.dtype([("context", "<u8"), *((n, _CONTEXT[n]) for n in _CONTEXT.names)])


def _marks() -> tuple[np.uint64, np.uint64]:
    """The hashes of a text's start and end; no word has white space, so no word has these."""
    import xxhash

    return np.uint64(xxhash.xxh64_intdigest(b"\n", 42)), np.uint64(xxhash.xxh64_intdigest(b"\n\n", 42))


def tokens(text: bytes) -> np.ndarray:
    """Hashes of a text's words, A-Z lowered, and of its end."""
    import xxhash

    words = text.lower().split()
    out = np.empty(len(words) + 1, dtype=np.uint64)
    digest = xxhash.xxh64_intdigest
    out[:-1] = np.fromiter((digest(w, 42) for w in words), dtype=np.uint64, count=len(words))
    out[-1] = _marks()[1]
    return out


def bigrams(lists: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(contexts, words) of all texts; a text's first word follows the start mark."""
    words = np.concatenate(lists)
    contexts = np.empty_like(words)
    contexts[1:] = words[:-1]
    contexts[np.cumsum([0, *map(len, lists)])[:-1]] = _marks()[0]
    return contexts, words


def gram(contexts: np.ndarray, words: np.ndarray) -> np.ndarray:
    h = (contexts * _K1 + words) * _K2
    return h ^ (h >> np.uint64(29))


def _among(keys: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which keys are in a sorted array."""
    return known[np.minimum(np.searchsorted(known, keys), len(known) - 1)] == keys if len(known) else np.zeros(len(keys), dtype=bool)


def placed(contexts: np.ndarray, words: np.ndarray, frequent: np.ndarray, bits: int) -> np.ndarray:
    """The shard of each bigram."""
    key = contexts.copy()
    spread = _among(contexts, frequent)
    key[spread] = gram(contexts[spread], words[spread])
    return key >> np.uint64(64 - bits) if bits else np.zeros(len(key), dtype=np.uint64)


def merge(contexts: np.ndarray, words: np.ndarray, counts: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct bigrams in order of context, then word, with summed counts."""
    order = np.lexsort((words, contexts))
    contexts, words = contexts[order], words[order]
    first = np.flatnonzero(np.concatenate([[True], (contexts[1:] != contexts[:-1]) | (words[1:] != words[:-1])]))
    if counts is None:
        summed = np.diff(np.concatenate([first, [len(order)]]))
    else:
        summed = np.add.reduceat(counts[order].astype(np.uint64), first)
    return contexts[first], words[first], summed.astype(np.uint64)


def _runs(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first position, length) of each run of equal keys."""
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.empty(0, np.int64)
    return first, np.diff(np.concatenate([first, [len(keys)]])).astype(np.int64)


def _cuts(keys: np.ndarray, bits: int) -> np.ndarray:
    """Where the keys of each shard begin in sorted keys, and the end."""
    if not bits:
        return np.array([0, len(keys)])
    starts = np.arange(1, 1 << bits, dtype=np.uint64) << np.uint64(64 - bits)
    return np.concatenate([[0], np.searchsorted(keys, starts), [len(keys)]])


_COUNTED = ["shard", "contexts", "sizes", "words", "counts"]
_SEEN = ["shard", "words", "contexts", "counts", "frequent", "sizes"]
_BLOB = {n: "binary" for n in _COUNTED + _SEEN} | {"shard": "int"}
_BATCH_BYTES = 2 << 20


def _schema(names: list[str]) -> str:
    return ", ".join(f"{n} {_BLOB[n]}" for n in names)


def _blobs(names: list[str], shards: np.ndarray, *columns: tuple[np.ndarray, np.ndarray]):
    """Batches of a row per shard; a column is (array, cuts): its bytes from a cut to the next are a row's."""
    import pyarrow as pa

    arrays, total = [pa.array(shards.astype(np.int32))], 1
    for array, cuts in columns:
        offsets = np.asarray(cuts, dtype=np.int64) * array.dtype.itemsize
        arrays.append(pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(shards), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(array))]))
        total += array.nbytes
    whole = pa.RecordBatch.from_arrays(arrays, names=names)
    kinds = pa.schema([pa.field(n, pa.int32() if n == "shard" else pa.binary()) for n in names])
    rows = max(1, int(len(shards) * _BATCH_BYTES / total))
    for at in range(0, len(shards), rows):
        yield pa.RecordBatch.from_arrays([c.cast(k.type) for c, k in zip(whole.slice(at, rows).columns, kinds, strict=True)], schema=kinds)


def _count(bits: int, frequent: np.ndarray):
    def packed(lists):
        contexts, words, counts = merge(*bigrams(lists), None)
        shards = placed(contexts, words, frequent, bits)
        order = np.argsort(shards, kind="stable")
        contexts, words, counts, shards = contexts[order], words[order], counts[order], shards[order]
        first = np.flatnonzero(np.concatenate([[True], (contexts[1:] != contexts[:-1]) | (shards[1:] != shards[:-1])]))
        sizes = np.diff(np.concatenate([first, [len(words)]]))
        begins, _ = _runs(shards)
        cuts = np.concatenate([begins, [len(words)]])
        runs = np.searchsorted(first, cuts)
        yield from _blobs(_COUNTED, shards[begins], (contexts[first], runs), (sizes.astype("<u4"), runs), (words, cuts), (counts.astype("<u4"), cuts))

    def run(batches):
        held, n = [], 0
        for b in batches:
            for raw in texts(b.column("text")):
                held.append(tokens(raw))
                n += len(held[-1])
                if n >= CHUNK:
                    yield from packed(held)
                    held, n = [], 0
        if held:
            yield from packed(held)

    return run


def _save(folder: str, name: str, arrays: dict[str, np.ndarray]) -> None:
    """One file: the header's length, a header in JSON, and the arrays, each from a multiple of 64 bytes on."""
    at, parts = 0, []
    for key, array in arrays.items():
        parts.append({"key": key, "kind": np.lib.format.dtype_to_descr(array.dtype), "shape": array.shape, "at": at})
        at += -(-array.nbytes // 64) * 64
    header = json.dumps({"parts": parts, "size": at}).encode()
    header += b" " * (-(len(header) + 8) % 64)
    part = os.path.join(folder, f"{name}.{uuid.uuid4().hex}")
    with open(part, "wb") as f:
        f.write(len(header).to_bytes(8, "little") + header)
        for array in arrays.values():
            f.write(np.ascontiguousarray(array).tobytes() + bytes(-array.nbytes % 64))
    os.replace(part, os.path.join(folder, name))


def _load(folder: str, name: str) -> dict[str, np.ndarray]:
    """The arrays of a file that _save() wrote, memory-mapped."""
    whole = np.memmap(os.path.join(folder, name), dtype=np.uint8, mode="r")
    begin = 8 + int.from_bytes(whole[:8].tobytes(), "little")
    header = json.loads(whole[8:begin].tobytes())
    if len(whole) != begin + header["size"]:
        raise OSError(f"{name} in {folder} is not whole")
    out = {}
    for part in header["parts"]:
        kind = np.lib.format.descr_to_dtype(part["kind"] if isinstance(part["kind"], str) else [tuple(x) for x in part["kind"]])
        at, size = begin + part["at"], kind.itemsize * int(np.prod(part["shape"], dtype=np.int64))
        out[part["key"]] = whole[at : at + size].view(kind).reshape(part["shape"])
    return out


class _Folded:
    """Columns that arrive in pieces, folded together whenever the new ones outgrow the folded ones."""

    def __init__(self, fold) -> None:
        self.fold, self.held, self.n, self.base = fold, [], 0, 0

    def add(self, *columns: np.ndarray) -> None:
        self.held.append(columns)
        self.n += len(columns[0])
        if self.n > 2 * self.base + FOLD:
            self.done()

    def done(self) -> tuple[np.ndarray, ...]:
        if len(self.held) != 1 or self.n != self.base:
            folded = self.fold(*(np.concatenate(c) for c in zip(*self.held, strict=True)))
            self.held, self.n, self.base = [folded], len(folded[0]), len(folded[0])
        return self.held[0]


def word_sums(words: np.ndarray, contexts: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct words in order with summed contexts and counts."""
    order = np.argsort(words, kind="stable")
    words = words[order]
    first, _ = _runs(words)
    if not len(first):
        return words, contexts.astype(np.uint64), counts.astype(np.uint64)
    return words[first], np.add.reduceat(contexts[order].astype(np.uint64), first), np.add.reduceat(counts[order].astype(np.uint64), first)


def _rows(batches, names: list[str]):
    for b in batches:
        columns = [b.column(n).to_pylist() for n in names]
        yield from zip(*columns, strict=True)


def _write_bigrams(folder: str, bits: int, frequent: np.ndarray):
    def write(shard: int, contexts: np.ndarray, words: np.ndarray, counts: np.ndarray):
        keys = gram(contexts, words)
        order = np.argsort(keys, kind="stable")
        large = np.flatnonzero(counts[order] > 254)  # one byte each; the few large ones stand apart
        first, sizes = _runs(contexts)
        stats = np.zeros(len(first), dtype=_CONTEXT)
        for field, hit in (("once", counts == 1), ("twice", counts == 2), ("more", counts > 2)):
            stats[field] = np.add.reduceat(hit.astype(np.int64), first)
        stats["total"] = np.add.reduceat(counts, first)
        spread = _among(contexts[first], frequent)
        _save(folder, f"bigrams-{shard}", {
            "bigram": keys[order], "bigram-count": np.minimum(counts[order], 255).astype(np.uint8), "bigram-large": np.stack([large.astype(np.uint64), counts[order][large]]),
            "context": contexts[first][~spread], "context-stats": stats[~spread],
        })
        part = np.zeros(int(spread.sum()), dtype=_FREQUENT)
        part["context"] = contexts[first][spread]
        for field in _CONTEXT.names:
            part[field] = stats[field][spread]
        found = np.array([np.count_nonzero(counts == k) for k in (1, 2, 3, 4)], dtype="<i8")
        words, contexts, counts = word_sums(words, np.ones(len(words), dtype=np.uint32), counts)
        # every shard hears of the words and frequent contexts that are its own, this one of its sizes too
        cuts, parts = _cuts(words, bits), _cuts(part["context"], bits)
        sizes = np.zeros(len(cuts), dtype=np.int64)
        sizes[shard + 1 :] = len(found)
        to = np.flatnonzero((np.diff(cuts) > 0) | (np.diff(parts) > 0) | (np.diff(sizes) > 0))
        ends = np.concatenate([to, [len(cuts) - 1]])  # what lies between is empty
        yield from _blobs(_SEEN, to, (words, cuts[ends]), (contexts.astype("<u4"), cuts[ends]), (counts.astype("<u8"), cuts[ends]), (part, parts[ends]), (found, sizes[ends]))

    def run(batches):
        shards: dict[int, _Folded] = {}
        for shard, contexts, sizes, words, counts in _rows(batches, _COUNTED):
            context = np.repeat(np.frombuffer(contexts, "<u8"), np.frombuffer(sizes, "<u4"))
            shards.setdefault(shard, _Folded(merge)).add(context, np.frombuffer(words, "<u8"), np.frombuffer(counts, "<u4").astype(np.uint64))
        while shards:
            shard, folded = shards.popitem()
            yield from write(shard, *folded.done())

    return run


def _write_words(folder: str):
    def run(batches):
        import pyarrow as pa

        shards: dict[int, tuple[_Folded, list[bytes], list[bytes]]] = {}
        for shard, words, contexts, counts, frequent, sizes in _rows(batches, _SEEN):
            folded, parts, found = shards.setdefault(shard, (_Folded(word_sums), [], []))
            folded.add(np.frombuffer(words, "<u8"), np.frombuffer(contexts, "<u4").astype(np.uint64), np.frombuffer(counts, "<u8"))
            parts.append(frequent)
            found.append(sizes)
        for shard, (folded, parts, found) in shards.items():
            words, seen, counts = folded.done()
            stats = np.zeros(len(words), dtype=_WORD)
            stats["contexts"], stats["count"] = seen, counts
            part = np.sort(np.frombuffer(b"".join(parts), _FREQUENT), order="context")
            first, _ = _runs(part["context"])
            whole = np.zeros(len(first), dtype=_CONTEXT)
            for field in _CONTEXT.names:
                if len(first):
                    whole[field] = np.add.reduceat(part[field].astype(np.uint64), first)
            _save(folder, f"words-{shard}", {"word": words, "word-stats": stats, "frequent": part["context"][first], "frequent-stats": whole})
            own = np.frombuffer(b"".join(found), "<i8").reshape(-1, 4)  # a row if the shard has bigrams
            facts = [shard, len(words), int(counts.sum()), int(seen.sum()), *(int(np.count_nonzero(seen == k)) for k in (1, 2, 3, 4)), int(np.count_nonzero(seen > 2)), len(own), *own.sum(0).tolist()]
            yield pa.RecordBatch.from_arrays([pa.array([x], pa.int64()) for x in facts], names=_FACTS)

    return run


_FACTS = ["shard", "words", "tokens", "types", "n1", "n2", "n3", "n4", "more", "bigrams", "h1", "h2", "h3", "h4"]


def discounts(n1: int, n2: int, n3: int, n4: int) -> np.ndarray:
    """Discounts for counts 0, 1, 2 and more, from how many have the counts 1 to 4; without enough of them, half and one."""
    if not (n1 and n2 and n3):
        return np.array([0.0, 0.5, 0.75, 1.0])
    y = n1 / (n1 + 2 * n2)
    d = [0.0, 1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3]
    return np.array([0.0, *(min(max(x, 0.05), k - 0.05) for k, x in enumerate(d[1:], 1))])


class Model:
    """Where the arrays lie and the model's few numbers; tasks open the arrays they need."""

    def __init__(self, folder: str, bits: int, facts: list[dict], frequent: np.ndarray) -> None:
        self.folder, self.bits, self.frequent = folder, bits, frequent
        total = {k: sum(f[k] for f in facts) for k in _FACTS}
        self.words, self.tokens, self.types = total["words"], total["tokens"], total["types"]
        self.high, self.low = (discounts(*(total[f"{k}{i}"] for i in (1, 2, 3, 4))) for k in "hn")
        self.rest = float(self.low[1] * total["n1"] + self.low[2] * total["n2"] + self.low[3] * total["more"]) / max(self.types, 1)
        self.written = {"words": np.zeros(1 << bits, dtype=bool), "bigrams": np.zeros(1 << bits, dtype=bool)}
        for f in facts:
            self.written["words"][f["shard"]], self.written["bigrams"][f["shard"]] = True, f["bigrams"] > 0
        self.files: OrderedDict[tuple[str, int], dict[str, np.ndarray]] = OrderedDict()

    def __getstate__(self) -> dict:
        return self.__dict__ | {"files": OrderedDict()}

    def arrays(self, kind: str, shard: int) -> dict[str, np.ndarray] | None:
        """The arrays of a shard, None where no task wrote any; a file that should be there and is not is an error."""
        if not self.written[kind][shard]:
            return None
        if (kind, shard) not in self.files:
            while len(self.files) >= MAPS:
                self.files.popitem(last=False)
            self.files[kind, shard] = _load(self.folder, f"{kind}-{shard}")
        self.files.move_to_end((kind, shard))
        return self.files[kind, shard]

    def _look(self, keys: np.ndarray, shard_of: np.ndarray, kind: str, stats: str, dtype) -> np.ndarray:
        """The stats of keys (sorted by shard_of's leading bits); zeros where a key is not known."""
        out = np.zeros(len(keys), dtype=dtype)
        cuts = _cuts(shard_of, self.bits)
        for shard in np.flatnonzero(np.diff(cuts)).tolist():
            a, b = cuts[shard], cuts[shard + 1]
            arrays = self.arrays("bigrams" if kind in ("bigram", "context") else "words", shard)
            if arrays is not None and len(known := arrays[kind]):
                at = np.minimum(np.searchsorted(known, keys[a:b]), len(known) - 1)
                hit = np.flatnonzero(known[at] == keys[a:b])
                got = arrays[stats][at[hit]]
                if kind == "bigram":
                    got = got.astype(dtype)
                    large = np.flatnonzero(got == 255)
                    if len(large):
                        where, counts = arrays["bigram-large"]
                        got[large] = counts[np.searchsorted(where, at[hit][large])]
                out[a + hit] = got
        return out

    def word_stats(self, words: np.ndarray) -> np.ndarray:
        keys, back = np.unique(words, return_inverse=True)
        return self._look(keys, keys, "word", "word-stats", _WORD)[back]

    def context_stats(self, contexts: np.ndarray) -> np.ndarray:
        keys, back = np.unique(contexts, return_inverse=True)
        found, spread = self._look(keys, keys, "context", "context-stats", _CONTEXT), _among(keys, self.frequent)
        found[spread] = self._look(keys[spread], keys[spread], "frequent", "frequent-stats", _CONTEXT)
        return found[back]

    def counts(self, contexts: np.ndarray, words: np.ndarray) -> np.ndarray:
        keys = gram(contexts, words)
        shard = placed(contexts, words, self.frequent, self.bits)
        order = np.lexsort((keys, shard))
        found = self._look(keys[order], shard[order] << np.uint64(64 - self.bits) if self.bits else shard[order], "bigram", "bigram-count", np.uint64)
        out = np.empty_like(found)
        out[order] = found
        return out

    def log10(self, contexts: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(log10 probability, training count) of each word after its context."""
        w = self.word_stats(words)
        low = (w["contexts"] - self.low[np.minimum(w["contexts"], 3)]) / max(self.types, 1) + (self.rest if self.types else 1.0) / (self.words + 1)
        c = self.context_stats(contexts)
        n = self.counts(contexts, words)
        total = np.maximum(c["total"], 1).astype(np.float64)
        back = (self.high[1] * c["once"] + self.high[2] * c["twice"] + self.high[3] * c["more"]) / total
        high = (n.astype(np.float64) - self.high[np.minimum(n, 3).astype(np.int64)]) / total
        return np.log10(np.where(c["total"] > 0, high + back * low, low)), w["count"].astype(np.float64)


def _local(path: str) -> str:
    scheme, colon, rest = path.partition(":")
    if colon and scheme != "file":
        raise ValueError(f"the model's arrays are memory-mapped: the shared folder has to be mounted as a path, not {scheme}:")
    return "/" + rest.lstrip("/") if colon else path


def _by_shard(df: DataFrame, shards: int) -> DataFrame:
    return df.repartitionById(shards, F.col("shard")) if hasattr(df, "repartitionById") else df.repartition(shards, "shard")


def _sampled(batches):
    import pyarrow as pa

    for b in batches:
        lists = [tokens(raw)[:-1] for raw in texts(b.column("text"))]
        words, n = np.unique(np.concatenate(lists or [np.empty(0, np.uint64)]), return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(words.view(np.int64)), pa.array(n.astype(np.int64))], names=["word", "n"])


def frequent_contexts(docs: DataFrame, rows: int, bits: int) -> np.ndarray:
    """A text's start and the words with over a quarter of a shard's share of a sample's tokens; at most four a shard."""
    start = np.array([_marks()[0]])
    if not bits:
        return start
    part = docs.sample(fraction=min(1.0, SAMPLE / max(rows, 1)), seed=3) if rows > SAMPLE else docs
    counts = part.mapInArrow(released(_sampled), "word bigint, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
    total = counts.agg(F.sum("n")).first()[0] or 0
    found = counts.where(F.col("n") > total / (4 << bits)).select("word").collect()
    return np.unique(np.concatenate([start, np.array([r["word"] for r in found], dtype=np.int64).view(np.uint64)]))


def build(docs: DataFrame) -> Model:
    """The model of all given documents; null text counts as empty, an empty table makes a model that knows no word."""
    spark = docs.sparkSession
    prepare(spark)
    slim = only(docs, "text")
    chars, rows = slim.agg(F.coalesce(F.sum(F.length("text")), F.lit(0)), F.count("*")).first()
    bits = min(SHARDS.bit_length() - 1, max(0, int(np.ceil(np.log2(max(1, chars / 6 / SHARD_BIGRAMS))))))  # over 100 billion tokens reach the limit
    folder = _local(scratch(spark, "kneser"))
    os.makedirs(folder)
    frequent = frequent_contexts(slim, rows, bits)
    counted = slim.mapInArrow(released(_count(bits, frequent)), _schema(_COUNTED))
    seen = _by_shard(counted, 1 << bits).mapInArrow(released(_write_bigrams(folder, bits, frequent)), _schema(_SEEN))
    facts = _by_shard(seen, 1 << bits).mapInArrow(released(_write_words(folder)), ", ".join(f"{f} bigint" for f in _FACTS)).collect()
    return Model(folder, bits, [r.asDict() for r in facts], frequent)


def _scored(model: Model):
    def run(batches):
        import pyarrow as pa

        for b in batches:
            lists = [tokens(raw) for raw in texts(b.column("text"))]
            if not lists:
                continue
            logs, counts = model.log10(*bigrams(lists))
            first = np.cumsum([0, *map(len, lists)])[:-1]
            base = np.log10((counts + 1) / (model.tokens + model.words + 1))
            columns = [pa.array([len(x) for x in lists], pa.int64()), pa.array(np.add.reduceat((counts > 0).astype(np.int64), first)), pa.array(np.add.reduceat(base, first)), pa.array(np.add.reduceat(logs, first))]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *columns], names=["doc_id", "n_tokens", "n_known", "base_score", "score"])

    return run


def held_out(doc_id) -> F.Column:
    """crc32 of the id as text leaves 2 on division by 7; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % FOLDS == HELD


def score(docs: DataFrame) -> DataFrame:
    """A row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    The model learns from the rows that are not held out. Null text counts as empty (its end alone); null and repeated
    doc_ids keep a row each; an empty table gives none. Further columns are not read.
    """
    slim = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"])
    model = build(slim.where(~held_out(F.col("doc_id"))))
    out = slim.mapInArrow(released(_scored(model)), "doc_id bigint, n_tokens bigint, n_known bigint, base_score double, score double")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score")
