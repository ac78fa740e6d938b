"""Near-duplicate embeddings by spherical-cap filters from structured random product codes.

Filter directions are the codewords of a product code: a seeded rotation, ``BLOCKS`` blocks of the coordinates, and a
random codebook for each block; a direction takes one codeword from every block. A vector belongs to every filter whose
direction it exceeds its cap height with; these are listed by extending partial codewords block by block and dropping
those that the best rest cannot lift to the height, so the work follows the output and not the number of filters. The
codebook's size follows from the number of vectors, so that a filter holds ``BUCKET`` of a class if they lie evenly. A
code is denser in some regions than in others, so the height follows the vector: it is where ``FILTERS`` directions exceed
it. Scores are sums of integers that doubles hold exactly, so a vector's filters are the same wherever they are listed.

Vectors travel as their float32 bytes (float64 where that loses something) and are verified in double precision where they
meet in a filter. Equal vectors are one member with a count, known by a digest of those bytes, so nothing is joined on
vectors. A pair counts in the smallest filter its two members share, so links need no table of pairs: a task returns sums
per vector and links that span what is connected. Filters with more than ``SPLIT`` members are cut into blocks by hash, and
each pair of blocks is verified by itself.
"""

from __future__ import annotations

import hashlib
from statistics import NormalDist

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import only, prepare, released
from tessera.llm.components import components
from tessera.session import discard, materialize

THRESHOLD = 0.98
BLOCKS, BUCKET, FILTERS, SPLIT, SEED = 4, 48, 16, 1024, 17
#: Coordinates are rounded to this unit: sums of products of two stay below 2**53 and are exact.
UNIT = float(1 << 20)


class Code:
    """The filters for vectors of one dimension, the same in every process for the same arguments."""

    def __init__(self, dim: int, members: int, seed: int = SEED) -> None:
        rng = np.random.default_rng([seed, dim])
        share = min(0.02, BUCKET / max(members, 1))
        self.size = max(2, int(np.ceil((1.5 * FILTERS / share) ** (1 / BLOCKS))))
        self.height = np.rint(NormalDist().inv_cdf(1 - share) / np.sqrt(max(dim, 1)) * UNIT * UNIT)
        self.width = -(-dim // BLOCKS)
        self.rotation = np.rint(np.linalg.qr(rng.normal(size=(dim, dim)))[0] * UNIT)
        books = rng.normal(size=(BLOCKS, self.size, self.width))
        self.books = np.rint(books / np.linalg.norm(books, axis=2, keepdims=True) / np.sqrt(BLOCKS) * UNIT)

    def decode(self, vectors: np.ndarray) -> np.ndarray:
        """A row per unit vector with its filters in rising order: those that FILTERS directions exceed its height in."""
        each = min(FILTERS, self.size**BLOCKS)
        out = np.empty((len(vectors), each), dtype=np.int64)
        for at in range(0, len(vectors), 512):
            part = np.rint(np.rint(vectors[at : at + 512] * UNIT) @ self.rotation / UNIT)
            part = np.pad(part, ((0, 0), (0, self.width * BLOCKS - part.shape[1])))
            scores = [part[:, b * self.width : (b + 1) * self.width] @ self.books[b].T for b in range(BLOCKS)]
            rest = np.zeros((BLOCKS + 1, len(part)))
            for b in range(BLOCKS - 1, -1, -1):
                rest[b] = rest[b + 1] + scores[b].max(1)
            height, open_ = np.minimum(self.height, rest[0]), np.arange(len(part))
            while len(open_):  # a lower height for those that too few exceed
                r, f, s = self._list(scores, rest, height, open_)
                enough = np.bincount(r, minlength=len(part)) >= each
                r, f, s = r[enough[r]], f[enough[r]], s[enough[r]]
                order = np.lexsort((f, -s, r))
                first = np.flatnonzero(np.diff(r[order], prepend=-1))
                best = (first[:, None] + np.arange(each)).ravel()
                out[at + r[order][first]] = np.sort(f[order][best].reshape(-1, each), axis=1)
                open_ = open_[~enough[open_]]
                height[open_] -= np.rint(0.05 * UNIT * UNIT)
        return out

    def _list(self, scores: list[np.ndarray], rest: np.ndarray, height: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        row, code, sums = which, np.zeros(len(which), dtype=np.int64), np.zeros(len(which))
        for b in range(BLOCKS):
            reach = sums[:, None] + scores[b][row]
            i, c = np.nonzero(reach + rest[b + 1][row][:, None] >= height[row][:, None])
            row, code, sums = row[i], code[i] * self.size + c, reach[i, c]
        return row, code, sums


_CODES: dict[tuple[int, int], Code] = {}


def code_for(dim: int, members: int) -> Code:
    if (dim, members) not in _CODES:
        _CODES[dim, members] = Code(dim, members)
    return _CODES[dim, members]


def _unit(flat: np.ndarray, dim: int) -> np.ndarray:
    v = flat.astype(np.float64).reshape(-1, dim)
    v = v / np.abs(v).max(1, keepdims=True)  # so that no square overflows or vanishes
    return v / np.sqrt((v * v).sum(1, keepdims=True))


def packed(column) -> list[bytes | None]:
    """Each vector of an Arrow list column as bytes, a mark of the kind first; None where it cannot be compared.

    Float32 where that loses nothing; equal vectors (zeros of either sign are equal) have equal bytes.
    """
    import pyarrow as pa

    sizes = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    flat = column.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False) + 0.0  # null is NaN; -0.0 + 0.0 is 0.0
    ends = np.cumsum(sizes)
    whole = np.concatenate([[0], np.cumsum(~np.isfinite(flat))])
    some = np.concatenate([[0], np.cumsum(flat != 0)])
    with np.errstate(over="ignore"):
        short = flat.astype("<f4")
        wide = np.concatenate([[0], np.cumsum(short != flat)])
    starts = ends - sizes
    good = (whole[ends] == whole[starts]) & (some[ends] > some[starts])
    out: list[bytes | None] = [None] * len(sizes)
    for i in np.flatnonzero(good).tolist():
        a, b = int(starts[i]), int(ends[i])
        out[i] = b"f" + short[a:b].tobytes() if wide[b] == wide[a] else b"d" + flat[a:b].astype("<f8").tobytes()
    return out


def _packed(batches):
    import pyarrow as pa

    for b in batches:
        vectors = packed(b.column("embedding"))
        digests = [None if v is None else hashlib.blake2b(v, digest_size=16).digest() for v in vectors]
        yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("label"), pa.array(digests, pa.binary()), pa.array(vectors, pa.binary())], names=["vec_id", "label", "digest", "vector"])


def _by_dim(column) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """By dimension: positions in a column of packed vectors and their unit vectors."""
    found: dict[int, dict[bytes, list[int]]] = {}
    vectors = column.to_pylist()
    for i, v in enumerate(vectors):
        found.setdefault((len(v) - 1) // (4 if v[:1] == b"f" else 8), {}).setdefault(v[:1], []).append(i)
    out = {}
    for dim, kinds in found.items():
        at = np.concatenate([np.array(x) for x in kinds.values()])
        flat = np.concatenate([np.frombuffer(b"".join(vectors[i][1:] for i in x), "<f4" if k == b"f" else "<f8").astype(np.float64) for k, x in kinds.items()])
        order = np.argsort(at)
        out[dim] = at[order], _unit(flat, dim)[order]
    return out


def _filtered(members: int):
    def run(batches):
        import pyarrow as pa

        for b in batches:
            lists = [np.empty(0, np.int64)] * b.num_rows
            for dim, (at, unit) in _by_dim(b.column("vector")).items():
                for i, own in zip(at.tolist(), code_for(dim, members).decode(unit), strict=True):
                    lists[i] = own
            filters = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, lists)]), pa.int32()), pa.array(np.concatenate([np.empty(0, np.int64), *lists])))
            yield pa.RecordBatch.from_arrays([*b.columns, filters], names=[*b.schema.names, "filters"])

    return run


class _Members:
    """Filters of vectors that pass a comparison; a bounded memo by vector."""

    def __init__(self, members: int) -> None:
        self.members, self.known = members, {}

    def of(self, nids: np.ndarray, unit: np.ndarray) -> list[np.ndarray]:
        new = np.array([i for i, n in enumerate(nids.tolist()) if n not in self.known], dtype=np.int64)
        if len(self.known) > 50_000:
            self.known.clear()
            new = np.arange(len(nids))
        if len(new):
            for i, own in zip(new.tolist(), code_for(unit.shape[1], self.members).decode(unit[new]), strict=True):
                self.known[int(nids[i])] = own
        return [self.known[n] for n in nids.tolist()]


def compare(unit: np.ndarray, nids: np.ndarray, copies: np.ndarray, block: np.ndarray | None, own: int, memo: _Members, threshold: float):
    """(nid, links) and (a, b) of the pairs of a group that count in filter ``own``; block: pairs lie across blocks only."""
    near = unit @ unit.T >= threshold
    np.fill_diagonal(near, False)
    if block is not None:
        near &= block[:, None] != block[None, :]
    hit = np.flatnonzero(near.any(1))
    if not len(hit):
        return None
    near = near[np.ix_(hit, hit)]
    lists = memo.of(nids[hit], unit[hit])
    before = np.unique(np.concatenate([x[x < own] for x in lists]))
    if len(before):
        shared = np.zeros((len(hit), len(before)), dtype=np.float32)
        for i, x in enumerate(lists):
            shared[i, np.searchsorted(before, x[x < own])] = 1
        near &= (shared @ shared.T) == 0
    links = near @ copies[hit]
    a, b = [], []
    left = np.ones(len(hit), dtype=bool)
    for i in range(len(hit)):
        if left[i]:
            reach = np.zeros(len(hit), dtype=bool)
            reach[i] = True
            front = reach.copy()
            while front.any():
                front = near[front].any(0) & ~reach
                reach |= front
            left &= ~reach
            reach[i] = False
            b.append(nids[hit][reach])
            a.append(np.full(len(b[-1]), nids[hit][i]))
    return nids[hit], links, np.concatenate(a), np.concatenate(b)


_KEYS = ("class", "filter", "low", "high")


def _verified(members: int, threshold: float):
    def run(batches):
        import pyarrow as pa

        memo = _Members(members)

        def done(t):
            """Results of whole groups in a table sorted by key."""
            keys = [t.column(k).to_numpy() for k in _KEYS]
            change = np.flatnonzero(np.any([k[1:] != k[:-1] for k in keys], axis=0)) + 1
            bounds = np.concatenate([[0], change, [len(t)]])
            nids, copies, block = (t.column(c).to_numpy() for c in ("nid", "copies", "block"))
            kinds, left, right = [np.empty(0, np.int32)], [np.empty(0, np.int64)], [np.empty(0, np.int64)]
            dims = _by_dim(t.column("vector"))
            where = np.empty(len(t), dtype=np.int64)
            sizes = np.empty(len(t), dtype=np.int64)
            for dim, (at, _) in dims.items():
                where[at], sizes[at] = np.arange(len(at)), dim
            for x, y in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                if y - x < 2:
                    continue
                for dim in np.unique(sizes[x:y]).tolist():
                    at = x + np.flatnonzero(sizes[x:y] == dim)
                    got = compare(dims[dim][1][where[at]], nids[at], copies[at], block[at] if keys[2][x] != keys[3][x] else None, int(keys[1][x]), memo, threshold) if len(at) > 1 else None
                    if got:
                        some = got[1] > 0
                        for kind, p, q in ((0, got[0][some], got[1][some]), (1, got[2], got[3])):
                            kinds.append(np.full(len(p), kind, dtype=np.int32))
                            left.append(p)
                            right.append(q)
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(kinds)), pa.array(np.concatenate(left)), pa.array(np.concatenate(right).astype(np.int64))], names=["kind", "a", "b"])

        held = None
        for b in batches:
            if not b.num_rows:
                continue
            t = pa.Table.from_batches([b])
            t = t if held is None else pa.concat_tables([held, t])
            last = np.all([t.column(k).to_numpy() == t.column(k)[len(t) - 1].as_py() for k in _KEYS], axis=0)
            at = int(np.flatnonzero(last)[0])  # the last group may go on in the next batch
            if at:
                yield done(t.slice(0, at))
            held = t.slice(at)
        if held is not None and len(held):
            yield done(held)

    return run


def near_duplicates(rows: DataFrame, threshold: float = THRESHOLD, split: int = SPLIT) -> DataFrame:
    """A row per vector: vec_id, n_links, component_id, kept.

    Vectors are compared only within a label that is not null, and only with vectors of their dimension. Null vectors,
    zero vectors and vectors with null or non-finite components link with nothing and name themselves. Repeated rows and
    equal vectors are vectors of their own (each other's links); null vec_ids keep their rows and never name a component
    unless it has no other id, and are not kept. An empty table gives none. Further columns are not read.
    """
    spark = rows.sparkSession
    prepare(spark)
    slim = only(rows, "vec_id", "embedding", "label").select(F.col("vec_id").cast("long").alias("vec_id"), F.when(F.col("label").isNotNull(), F.col("embedding")).alias("embedding"), "label")
    label = slim.schema["label"].dataType.simpleString()
    keyed = slim.mapInArrow(released(_packed), f"vec_id bigint, label {label}, digest binary, vector binary")
    classes = slim.where("label is not null").groupBy("label").count().select("label", "count", F.monotonically_increasing_id().alias("class"))
    classes = materialize(classes, "cap-classes")
    members = classes.agg(F.max("count")).first()[0] or 0
    distinct = keyed.where("digest is not null").groupBy("label", "digest").agg(F.count("*").alias("copies"), F.min("vec_id").alias("least"), F.first("vector").alias("vector"))
    distinct = distinct.join(classes.drop("count"), "label").select(F.monotonically_increasing_id().alias("nid"), "class", "label", "digest", "copies", "least", "vector")
    distinct = materialize(distinct.mapInArrow(released(_filtered(members)), f"nid bigint, class bigint, label {label}, digest binary, copies bigint, least bigint, vector binary, filters array<bigint>"), "cap-vectors")
    large = distinct.select("class", F.explode("filters").alias("filter")).groupBy("class", "filter").agg(F.count("*").alias("held")).where(F.col("held") > split)
    large = materialize(large, "cap-large")
    wide = distinct.select("class", "nid", "copies", "vector", F.explode("filters").alias("filter"))
    parts = F.coalesce(F.ceil(F.col("held") / F.lit(split / 2)), F.lit(1)).cast("long")
    wide = wide.join(large, ["class", "filter"], "left").withColumn("parts", parts).withColumn("block", F.pmod(F.xxhash64("nid"), F.col("parts")))
    wide = wide.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    wide = wide.select("class", "filter", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "nid", "copies", "block", "vector")
    sorted_ = wide.repartition(*_KEYS).sortWithinPartitions(*_KEYS)
    found = materialize(sorted_.mapInArrow(released(_verified(members, threshold)), "kind int, a bigint, b bigint"), "cap-links")
    links = found.where("kind = 0").groupBy("a").agg(F.sum("b").alias("links"))
    roots = components(found.where("kind = 1").select("a", "b"))
    placed = distinct.select("nid", "label", "digest", "copies", "least").join(links, F.col("nid") == F.col("a"), "left").join(roots, F.col("nid") == F.col("node"), "left")
    placed = placed.select("label", "digest", "least", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("root", "nid").alias("root"))
    placed = materialize(placed, "cap-placed")
    for done in (classes, distinct, large, found):
        discard(done)
    least = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    placed = placed.join(least, "root").select("label", "digest", "n_links", "component_id")
    named = keyed.select("vec_id", "label", "digest").join(placed, ["label", "digest"], "left")
    alone = F.col("digest").isNull()
    named = named.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.when(alone, F.col("vec_id")).otherwise(F.col("component_id")).alias("component_id"))
    return named.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
