"""SimHash near-duplicates by Golay-code fuzzy hashing.

A 64-bit fingerprint is cut into three segments of 22, 21 and 21 bits. Two fingerprints that differ in at most two bits
agree wholly in one segment (pigeonhole) and differ in at most two bits in the next. Zero-padded to 23 bits that next
segment lies near codewords of the perfect [23,12,7] Golay code: words at distance two have a midpoint at most 3 from a
codeword, so listing all codewords within distance 4 (one, or six when the nearest is 3 away) always gives them a common
index. Keys are (segment, its bits, an index of the next one): 34 bits, at most 18 for a fingerprint, and no link is lost.

Distinct fingerprints alone are keyed, so copies cost nothing. Keys that one fingerprint has alone go before any
grouping; keys with up to ``cap`` fingerprints are verified in one task each; the fingerprints of larger keys are
linked exactly by the 65 words at distance 0 or 1 from each (two that share one differ in at most two bits, and two that
differ in at most two bits share one), groups of at most 65 members. No pairs are emitted, only a spanning set of links.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import only, prepare, released, texts
from tessera.llm.components import components
from tessera.session import materialize

SEED, WIDTH, BITS = 42, 3, 64
SEGMENTS = ((0, 22), (22, 21), (43, 21))
#: Fixed value: the generator polynomial x^11+x^10+x^6+x^5+x^4+x^2+1 of the binary Golay code.
GENERATOR = 0b110001110101
CAP = 256


def _syndrome(word: int) -> int:
    for i in range(22, 10, -1):
        if word >> i & 1:
            word ^= GENERATOR << (i - 11)
    return word


def _patterns() -> np.ndarray:
    """For each of the 2048 syndromes its error patterns of weight up to 4; six columns, short rows repeat the first."""
    one = [_syndrome(1 << i) for i in range(23)]
    found: list[list[int]] = [[] for _ in range(2048)]
    for weight in range(5):
        for bits in combinations(range(23), weight):
            s = 0
            for b in bits:
                s ^= one[b]
            if weight < 4 or not found[s] or bin(found[s][0]).count("1") == 3:
                found[s].append(sum(1 << b for b in bits))
    return np.array([x + x[:1] * (6 - len(x)) for x in found], dtype=np.uint64)


_TABLES: dict[str, np.ndarray] = {}


def _tables() -> tuple[np.ndarray, np.ndarray]:
    if not _TABLES:
        _TABLES["patterns"] = _patterns()
        low = np.array([_syndrome(w) for w in range(4096)], dtype=np.uint64)
        high = np.array([_syndrome(w << 12) for w in range(2048)], dtype=np.uint64)
        _TABLES["syndromes"] = (low[None, :] ^ high[:, None]).ravel()
    return _TABLES["patterns"], _TABLES["syndromes"]


def golay_indices(words: np.ndarray) -> np.ndarray:
    """The indices (12 bits) of all codewords within distance 4 of each 23-bit word: n by 6, repeated where fewer."""
    patterns, syndromes = _tables()
    return (words[:, None] ^ patterns[syndromes[words.astype(np.int64)].astype(np.int64)]) >> np.uint64(11)


def fuzzy_keys(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(position in fps, key) of every distinct key of every fingerprint."""
    parts = [(fps >> np.uint64(at)) & np.uint64((1 << n) - 1) for at, n in SEGMENTS]
    rows, keys = [], []
    for i in range(3):
        near = golay_indices(parts[(i + 1) % 3])
        single = near[:, 0] == near[:, 1]
        key = (np.uint64(i) << np.uint64(40)) | (parts[i] << np.uint64(12))[:, None] | near
        at = np.arange(len(fps))
        rows += [at, np.repeat(at[~single], 5)]
        keys += [key[:, 0], key[~single, 1:].ravel()]
    return np.concatenate(rows), np.concatenate(keys).astype(np.int64)


def fingerprint(text: bytes) -> int:
    """The fingerprint of a whole text (UTF-8), unsigned; no words: 0."""
    import xxhash

    words = text.lower().split()  # of bytes: lowers A-Z only, splits at \x20 and \x09-\x0D only
    if not words:
        return 0
    digest = xxhash.xxh64_intdigest
    grams = [b" ".join(words)] if len(words) < WIDTH else map(b" ".join, zip(words, words[1:], words[2:], strict=False))
    counts, n = np.zeros(BITS, dtype=np.int64), 0
    h = np.fromiter((digest(g, SEED) for g in grams), dtype="<u8")
    for i in range(0, len(h), 1 << 15):
        part = h[i : i + (1 << 15)]
        counts += np.unpackbits(part.view(np.uint8), bitorder="little").reshape(-1, BITS).sum(0, dtype=np.int64)
        n += len(part)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0])


def _fingerprints(batches):
    import pyarrow as pa

    for b in batches:
        known: dict[bytes, int] = {}
        out = []
        for t in texts(b.column("text")):
            if t not in known:
                known[t] = fingerprint(t)
            out.append(known[t])
        fp = np.array(out, dtype=np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("text_hash"), pa.array(fp)], names=["doc_id", "text_hash", "fp"])


def _keyed(batches):
    import pyarrow as pa

    for b in batches:
        fps = b.column("fp").to_numpy(zero_copy_only=False)
        rows, keys = fuzzy_keys(fps.view(np.uint64))
        yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(fps[rows])], names=["key", "fp"])


def spanning(fps: np.ndarray, bits: int = 2) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect what is connected among these fingerprints at up to ``bits`` differing bits."""
    n = len(fps)
    near = np.bitwise_count(fps.view(np.uint64)[:, None] ^ fps.view(np.uint64)[None, :]) <= bits
    left = np.ones(n, dtype=bool)
    a, b = [], []
    for i in range(n):
        if left[i]:
            reach = np.zeros(n, dtype=bool)
            reach[i] = True
            front = reach.copy()
            while front.any():
                front = near[front].any(0) & ~reach
                reach |= front
            left &= ~reach
            reach[i] = False
            b.append(fps[reach])
            a.append(np.full(len(b[-1]), fps[i]))
    return np.concatenate(a), np.concatenate(b)


def _links(batches):
    import pyarrow as pa

    for batch in batches:
        a, b = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for fps in batch.column("fps"):
            x, y = spanning(fps.values.to_numpy(zero_copy_only=False))
            a.append(x)
            b.append(y)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], names=["a", "b"])


def near_links(distinct: DataFrame, cap: int = CAP) -> DataFrame:
    """Links (a, b) that span the components of distinct fingerprints (column fp) at up to two differing bits."""
    keyed = distinct.select("fp").mapInArrow(released(_keyed), "key bigint, fp bigint")
    shared = keyed.groupBy("key").agg(F.count("*").alias("members")).where("members > 1")
    several = materialize(keyed.join(shared, "key"), "golay-keys")
    small = several.where(F.col("members") <= cap).groupBy("key").agg(F.collect_list("fp").alias("fps"))
    links = small.select("fps").mapInArrow(released(_links), "a bigint, b bigint")
    around = [F.col("fp")] + [F.col("fp").bitwiseXOR(F.lit(-(1 << 63) if i == 63 else 1 << i)) for i in range(BITS)]
    hot = several.where(F.col("members") > cap).select("fp").distinct().select("fp", F.explode(F.array(*around)).alias("mid"))
    stars = hot.groupBy("mid").agg(F.collect_list("fp").alias("fps")).where(F.size("fps") > 1)
    stars = stars.select(F.array_min("fps").alias("a"), F.explode("fps").alias("b"))
    return links.unionByName(stars).where("a <> b").distinct()


def simhash(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, fp) of every document, written once; text_hash tells repeated ids with other texts apart."""
    prepare(docs.sparkSession)
    slim = only(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash"), "text")
    return materialize(slim.mapInArrow(released(_fingerprints), "doc_id bigint, text_hash bigint, fp bigint"), "simhash")


def _rooted(docs: DataFrame, cap: int) -> DataFrame:
    """simhash() with ``root``, the fingerprint that stands for the component, and component_id."""
    fps = simhash(docs)
    ids = fps.groupBy("fp").agg(F.min("doc_id").alias("least"))
    roots = components(near_links(ids.select("fp"), cap))
    rooted = ids.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    rooted = materialize(rooted, "simhash-roots")
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    return fps.join(rooted.select("fp", "root").join(least, "root"), "fp").select("doc_id", "text_hash", "fp", "root", "component_id")


def near_duplicates(docs: DataFrame, cap: int = CAP) -> DataFrame:
    """One row per document: doc_id, text_hash, fp (signed), component_id (smallest doc_id reachable by links).

    Null text counts as empty (fingerprint zero); null doc_ids keep their rows and never name a component unless it has
    no other id; repeated rows each keep a row; an empty table gives none. Further columns are ignored.
    """
    return _rooted(docs, cap).drop("root")


def keep_one(docs: DataFrame, cap: int = CAP) -> DataFrame:
    """The documents that stay: of each component the one with the smallest doc_id (nulls last), then text hash.

    A component whose ids are all null keeps one of its documents too; of equal rows one stays.
    """
    found = _rooted(docs, cap).withColumn("rank", F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash"))
    stay = found.groupBy("root").agg(F.min("rank").alias("r")).select(F.col("r.doc_id").alias("stay_id"), F.col("r.text_hash").alias("stay_hash")).distinct()
    stay = materialize(stay, "simhash-kept")
    text_hash = F.xxhash64(F.coalesce(docs["text"], F.lit("")))
    own = docs.select(F.struct(*docs.columns).alias("row"), docs["doc_id"].cast("long").alias("own_id"), text_hash.alias("own_hash"))
    kept = own.join(stay, F.col("own_id").eqNullSafe(F.col("stay_id")) & (F.col("own_hash") == F.col("stay_hash")), "left_semi").select("row.*")
    ids = docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.xxhash64(F.coalesce(docs["text"], F.lit(""))).alias("h"))
    again = ids.join(stay, ids["doc_id"].eqNullSafe(stay["stay_id"]) & (ids["h"] == stay["stay_hash"]), "left_semi")
    again = again.groupBy("doc_id", "h").count().where("count > 1").limit(1).count()
    return kept.dropDuplicates(["doc_id", "text"]) if again else kept
