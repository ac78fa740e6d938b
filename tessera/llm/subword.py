"""A quality classifier on subword embeddings.

A text's units are its words, its word pairs, the 3-, 4- and 5-grams of characters (code points) of each word with its
edges, and for every window of ``SHAPE`` words the pattern of which of them are equal. Units are hashed into ``BUCKETS``
rows of a table of learned vectors; a text is the mean of its units' vectors and a softmax layer reads it. Vectors and layer
are trained together by numpy stochastic gradient descent, in small batches, on a bounded sample of labelled texts. The mean
and the layer are linear, so a task needs one number per bucket and scores texts by array operations.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import only, prepare, released, texts
from tessera.session import discard, materialize

BUCKETS, DIM, GRAMS, SHAPE = 1 << 17, 12, (3, 4, 5), 4
#: Labelled texts at most that training takes, those of the least hash of their id, as long as their distinct units stay
#: within SAMPLE_UNITS (64 MB); and how it steps.
SAMPLE, SAMPLE_UNITS, EPOCHS, BATCH, RATE, SEED = 3000, 1 << 23, 5, 16, 4.0, 7
THRESHOLD = 0.7
#: The unit that every text has; the hashed ones come after it.
END, OWN = 0, 1

_SPREAD = np.uint32(2654435761)
_MULTIPLIERS = np.random.default_rng(29).integers(1, 1 << 32, size=(8, 64), dtype=np.uint64).astype(np.uint32) | np.uint32(1)


def _bucket(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint32(15))) * _SPREAD
    return (h >> np.uint32(15)).astype(np.int64) % (BUCKETS - OWN) + OWN


def units(text: bytes) -> np.ndarray:
    """The buckets of all units of a whole text (UTF-8), repeats included; sums run modulo 2**32."""
    words = text.split()
    n = len(words)
    out = [np.array([END])]
    if not n:
        return out[0]
    joined = b" ".join([b"", *words, b""])
    raw = np.frombuffer(joined.decode("utf-8", "replace").encode("utf-32-le"), dtype="<u4")
    space = raw == 32
    inside = np.cumsum(space)
    for k in GRAMS:
        if len(raw) >= k:
            h = np.full(len(raw) - k + 1, k, dtype=np.uint32)
            for i in range(k):
                h += raw[i : len(raw) - k + 1 + i] * _MULTIPLIERS[k - 3, i]
            whole = inside[k - 2 : len(raw) - 1] == inside[: len(raw) - k + 1]  # no space but at the ends
            out.append(_bucket(h[whole]))
    starts = np.flatnonzero(space)[:-1] + 1
    place = np.arange(len(raw)) - np.repeat(np.concatenate([[0], starts]), np.diff(np.concatenate([[0], starts, [len(raw)]])))
    h = np.add.reduceat(np.where(space, 0, raw * _MULTIPLIERS[3, place % 64] + (place // 64).astype(np.uint32)).astype(np.uint32), starts, dtype=np.uint32)
    out.append(_bucket(h))
    if n > 1:
        out.append(_bucket(h[:-1] * _MULTIPLIERS[4, 0] + h[1:]))
    if n >= SHAPE:
        pattern, bit = np.zeros(n - SHAPE + 1, dtype=np.uint32), 0
        for i in range(SHAPE):
            for j in range(i + 1, SHAPE):
                pattern |= (h[i : i + len(pattern)] == h[j : j + len(pattern)]).astype(np.uint32) << np.uint32(bit)
                bit += 1
        out.append(_bucket(pattern * _MULTIPLIERS[5, 0] + _MULTIPLIERS[5, 1]))
    return np.concatenate(out)


def step(vectors: np.ndarray, layer: np.ndarray, bias: np.ndarray, batch: list[tuple[np.ndarray, np.ndarray, int]], rate: float) -> None:
    """One step of gradient descent on the cross-entropy summed over a batch of (distinct buckets, shares, label)."""
    hidden = np.stack([share @ vectors.take(buckets, axis=0) for buckets, share, _ in batch])
    logits = hidden @ layer + bias
    p = np.exp(logits - logits.max(1, keepdims=True))
    p /= p.sum(1, keepdims=True)
    p[np.arange(len(batch)), [label for _, _, label in batch]] -= 1
    back = p @ layer.T
    layer -= 0.1 * rate * (hidden.T @ p)
    bias -= 0.01 * rate * p.sum(0)
    for (buckets, share, _), own in zip(batch, back, strict=True):
        vectors[buckets] -= (rate * share)[:, None] * own


def train(samples: list[tuple[np.ndarray, np.ndarray, int]], epochs: int = EPOCHS, rate: float = RATE, seed: int = SEED, size: int = BATCH) -> np.ndarray:
    """One number per bucket (the layer's difference of classes applied to its vector) from (buckets, shares, label) rows.

    Without samples, or with one label only, the numbers are constant and every text gets the same score.
    """
    if not samples:
        return np.zeros(BUCKETS, dtype=np.float32)
    rng = np.random.default_rng(seed)
    vectors = rng.normal(scale=0.1, size=(BUCKETS, DIM)).astype(np.float32)
    layer = np.zeros((DIM, 2), dtype=np.float32)
    bias = np.zeros(2, dtype=np.float32)
    done, steps = 0, epochs * -(-len(samples) // size)
    for _ in range(epochs):
        order = rng.permutation(len(samples)).tolist()
        for at in range(0, len(order), size):
            step(vectors, layer, bias, [samples[i] for i in order[at : at + size]], rate * (1 - done / steps))
            done += 1
    return vectors @ (layer[:, 1] - layer[:, 0]) + (bias[1] - bias[0])


def score(text: bytes, table: np.ndarray) -> float:
    """The probability of label 1."""
    return float(1 / (1 + np.exp(-np.float64(table[units(text)].mean(dtype=np.float64)))))


def _counted(batches):
    import pyarrow as pa

    for b in batches:
        rows, shares, sizes = [], [], []
        for raw in texts(b.column("text")):
            own, n = np.unique(units(raw), return_counts=True)
            rows.append(own.astype("<i4").tobytes())
            shares.append((n / n.sum()).astype("<f4").tobytes())
            sizes.append(len(own))
        yield pa.RecordBatch.from_arrays([b.column("place"), pa.array(sizes, pa.int64()), pa.array(rows, pa.binary()), pa.array(shares, pa.binary()), b.column("quality")], names=["place", "n", "buckets", "shares", "quality"])


def sampled(docs: DataFrame, labels: DataFrame, sample: int) -> DataFrame:
    """(place, quality, text): a row for each of the ``sample`` labelled ids of least hash that documents have.

    Labels are narrowed first, so the ids that meet the documents are bounded by ``sample`` and broadcast; a repeated id
    brings its text of least hash, and a repeated label its least quality.
    """
    marked = only(labels, "doc_id", "quality").where("doc_id is not null and quality in (0, 1)").groupBy("doc_id").agg(F.min("quality").cast("int").alias("quality"))
    chosen = marked.select(F.col("doc_id").cast("long").alias("doc_id"), "quality", F.xxhash64("doc_id").alias("h")).orderBy("h", "doc_id").limit(sample)
    chosen = chosen.select("doc_id", "quality", F.row_number().over(Window.orderBy("h", "doc_id")).alias("place"))  # at most sample rows
    slim = only(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = slim.join(F.broadcast(chosen), "doc_id").groupBy("place", "quality").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("t"))
    return found.select("place", "quality", "t.text")


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, most: int = SAMPLE_UNITS) -> np.ndarray:
    """Train on at most ``sample`` labelled documents (quality 0 or 1) with at most ``most`` distinct units in all."""
    prepare(docs.sparkSession)
    counted = materialize(sampled(docs, labels, sample).mapInArrow(_counted, "place int, n bigint, buckets binary, shares binary, quality int"), "subword-sample")
    sizes = sorted((r["place"], r["n"]) for r in counted.select("place", "n").collect())
    last, total = 0, 0
    for place, n in sizes:
        total += n
        if total > most:
            break
        last = place
    found = sorted(counted.where(F.col("place") <= last).collect(), key=lambda r: r["place"])
    discard(counted)
    return train([(np.frombuffer(r["buckets"], "<i4").astype(np.int64), np.frombuffer(r["shares"], "<f4"), r["quality"]) for r in found])


def _scored(table: np.ndarray):
    def run(batches):
        import pyarrow as pa

        for b in batches:
            known: dict[bytes, float] = {}
            out = []
            for raw in texts(b.column("text")):
                if raw not in known:
                    known[raw] = score(raw, table)
                out.append(known[raw])
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(out, pa.float64())], names=["doc_id", "score"])

    return run


def scored(docs: DataFrame, table: np.ndarray) -> DataFrame:
    """(doc_id, score) of every whole text; null text counts as empty. Null and repeated doc_ids keep a row each."""
    prepare(docs.sparkSession)
    slim = only(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return slim.mapInArrow(released(_scored(table)), "doc_id bigint, score double")


def held_out(doc_id) -> F.Column:
    """Whether a row may not teach: crc32 of the id as text leaves 2 on division by 4; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 4 == 2


def classify(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """A row per document: doc_id, held_out, score, predicted; labels are learned from rows that are not held out.

    Texts alone make a score, over their whole length; null text counts as empty; null and repeated doc_ids keep a row
    each. An empty documents table gives no rows; without usable labels every score is 0.5. Further columns are not read.
    """
    table = fit(docs, labels.where(~held_out(labels["doc_id"])), sample)
    out = scored(docs, table)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"))
