"""Hard negatives by a Voronoi-partition distributed kNN join.

Ranking by inner product becomes ranking by angle: with one more coordinate, sqrt(M^2 - |x|^2) for the longest vector's
length M, all vectors lie on one sphere, an anchor with 0 there and stretched to length M lies on it too, and its inner
product with a vector is M |q| times the cosine of their angle. Angles obey the triangle inequality. Vectors are assigned to
the nearest of some pivots, which are rows of the table; a cell's least and greatest angle to its pivot bound the inner
product of all its members with an anchor from both sides.

Anchors are packed in groups by cell, cells in blocks. What an anchor finds among a bounded sample of rows bounds what it has
to look for: the sample's fifth best positive from below, its tenth best negative within the limits likewise. A cell's blocks
are replicated only to groups with an anchor whose range meets the cell's bounds; a group and a block meet in one task, which
joins them exactly by integer inner products and returns the best rows of each anchor, and those of all blocks are ranked.
A cell or a group of any size is cut into blocks, so no task holds more than one of each. The sample and the number of pivots
affect what is compared, never what is found.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import only, prepare, released
from tessera.session import discard, materialize

SCALE, POSITIVES, NEGATIVES, LOW, HIGH = 256, 5, 10, 30, 90
#: Documented bounds: rows of the sample, pivots among them, anchors of a group, candidates of a block.
SAMPLE, PIVOTS, GROUP, BLOCK = 4096, 1024, 1024, 1024
_KINDS = {b"h": "<i2", b"i": "<i4", b"d": "<f8"}


def packed(column) -> list[bytes | None]:
    """floor(SCALE * x) of each vector of an Arrow list column as bytes, a mark of the width first; None with null or non-finite components."""
    import pyarrow as pa

    sizes = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    null = column.is_null().to_numpy(zero_copy_only=False)
    flat = column.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
    with np.errstate(over="ignore", invalid="ignore"):
        flat = np.floor(SCALE * flat) + 0.0
    ends = np.cumsum(sizes)
    bad = np.concatenate([[0], np.cumsum(~np.isfinite(flat))])
    out: list[bytes | None] = [None] * len(sizes)
    for i, (a, b) in enumerate(zip((ends - sizes).tolist(), ends.tolist(), strict=True)):
        if not null[i] and bad[b] == bad[a]:
            most = np.abs(flat[a:b]).max(initial=0)
            kind = b"h" if most < 1 << 15 else b"i" if most < 1 << 31 else b"d"
            out[i] = kind + flat[a:b].astype(_KINDS[kind]).tobytes()
    return out


def matrix(vectors: list[bytes], dim: int) -> np.ndarray:
    """Packed vectors as rows of doubles; shorter ones are followed by zeros."""
    out = np.zeros((len(vectors), dim))
    alike: dict[tuple[bytes, int], list[int]] = {}
    for i, v in enumerate(vectors):
        alike.setdefault((v[:1], len(v)), []).append(i)
    for (kind, n), at in alike.items():
        if n > 1:
            own = np.frombuffer(b"".join(vectors[i][1:] for i in at), _KINDS[kind]).reshape(len(at), -1)
            out[at, : own.shape[1]] = own
    return out


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products as whole numbers, exact at any size; those beyond a long's range are set to its ends."""
    if a.shape[1] * np.abs(a).max(initial=0) * np.abs(b).max(initial=0) < 1 << 53:
        return (a @ b.T).astype(np.int64)
    whole = np.frompyfunc(int, 1, 1)
    return np.clip(whole(a) @ whole(b).T, -(1 << 63), (1 << 63) - 1).astype(np.int64)


class Cells:
    """Pivots, the bounds of their cells, and the sample: all of bounded size."""

    def __init__(self, sample: list, rows: int, longest: float, dim: int) -> None:
        self.dim, self.longest = dim, longest or 1.0
        self.ids = np.array([r["vec_id"] for r in sample], dtype=np.int64)
        self.labels = np.array([r["label"] for r in sample], dtype=np.int64)
        self.sample = matrix([bytes(r["vector"]) for r in sample], dim)
        pivots = np.unique(self.sample[: min(PIVOTS, max(1, int(np.ceil(np.sqrt(rows)))))], axis=0)
        self.pivots = self._lifted(pivots)
        self.count = np.zeros(len(pivots), dtype=np.int64)
        self.least, self.most = np.zeros(len(pivots)), np.zeros(len(pivots))

    def _lifted(self, v: np.ndarray) -> np.ndarray:
        v = v / self.longest
        return np.hstack([v, np.sqrt(np.maximum(0, 1 - (v * v).sum(1, keepdims=True)))])

    def assign(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The cell of each vector and its angle to the pivot."""
        cos = self._lifted(v) @ self.pivots.T
        cell = cos.argmax(1)
        return cell, np.arccos(np.clip(cos[np.arange(len(v)), cell], -1, 1))

    def bounds(self, anchors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least and greatest inner product of each anchor with any member of each cell, somewhat widened."""
        norm = np.sqrt((anchors * anchors).sum(1, keepdims=True))
        angle = np.arccos(np.clip(anchors @ self.pivots[:, :-1].T / np.where(norm > 0, norm, 1), -1, 1))
        near = np.maximum(0, np.maximum(angle - self.most, self.least - angle))
        far = np.minimum(np.pi, np.minimum(angle + self.most, 2 * np.pi - angle - self.least))
        reach = norm * self.longest
        return reach * np.cos(far) - 1e-6 * reach - 1e-6, reach * np.cos(near) + 1e-6 * reach + 1e-6


def _kth(values: np.ndarray, k: int) -> float:
    return float(np.partition(values, len(values) - k)[len(values) - k]) if len(values) >= k else -np.inf


def _lower(x: float) -> float:
    return x - 1e-9 * abs(x)


def _prepared(batches):
    import pyarrow as pa

    for b in batches:
        vectors = packed(b.column("embedding"))
        sizes = [None if v is None else (len(v) - 1) // np.dtype(_KINDS[v[:1]]).itemsize for v in vectors]
        squares = [None if v is None else float(np.square(np.frombuffer(v[1:], _KINDS[v[:1]]).astype(np.float64)).sum()) if len(v) > 1 else 0.0 for v in vectors]
        yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("label"), b.column("anchor"), pa.array(vectors, pa.binary()), pa.array(sizes, pa.int32()), pa.array(squares, pa.float64())], names=["vec_id", "label", "anchor", "vector", "size", "square"])


def _assigned(cells: Cells):
    def run(batches):
        import pyarrow as pa

        for b in batches:
            if b.num_rows:
                cell, angle = cells.assign(matrix(b.column("vector").to_pylist(), cells.dim))
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell, pa.int32()), pa.array(angle)], names=[*b.schema.names, "cell", "angle"])

    return run


# ---- rows packed by group or block, and what a group needs

_LISTS = {"uid": "bigint", "vec_id": "bigint", "label": "bigint", "vector": "binary", "goals": "array<struct<k:int,id:bigint,score:bigint>>"}


def _pack(names: tuple[str, ...], cells: Cells, needs):
    """Rows of equal (part, piece) as one row of lists; needs(lists) gives the cells of a group and bounds of its anchors."""

    def run(batches):
        import pyarrow as pa

        goal = pa.list_(pa.struct([("k", pa.int32()), ("id", pa.int64()), ("score", pa.int64())]))
        types = {"bigint": pa.int64(), "binary": pa.binary()}
        more = [("need", pa.list_(pa.int32())), ("floor", pa.list_(pa.list_(pa.float64())))] if needs else []
        schema = pa.schema([("part", pa.int32()), ("piece", pa.int32()), *((n, pa.list_(types.get(_LISTS[n], goal))) for n in names), *more])

        def row(key, held):
            lists = dict(zip(names, held, strict=True))
            return {"part": key[0], "piece": key[1], **lists, **(needs(cells, lists) if needs else {})}

        key, held = None, None
        for b in batches:
            out = []
            for part, piece, *values in zip(*(b.column(c).to_pylist() for c in ("part", "piece", *names)), strict=True):
                if (part, piece) != key:
                    if key is not None:
                        out.append(row(key, held))
                    key, held = (part, piece), [[] for _ in values]
                for x, v in zip(held, values, strict=True):
                    x.append(v)
            yield pa.RecordBatch.from_pylist(out, schema)
        if key is not None:
            yield pa.RecordBatch.from_pylist([row(key, held)], schema)

    return run


def _packing(rows: DataFrame, names: tuple[str, ...], cells: Cells, needs=None) -> DataFrame:
    schema = ", ".join(["part int, piece int", *(f"{n} array<{_LISTS[n]}>" for n in names), *(["need array<int>, floor array<array<double>>"] if needs else [])])
    dealt = rows.select("part", "piece", *names).repartition("part", "piece").sortWithinPartitions("part", "piece")
    return materialize(dealt.mapInArrow(released(_pack(names, cells, needs)), schema), "knn-packs")


def _for_positives(k: int):
    """Cells that may hold one of the first k rows of an anchor's label, and the score the k-th has at least."""

    def needs(cells: Cells, own: dict) -> dict:
        anchors = matrix(own["vector"], cells.dim)
        scores = products(anchors, cells.sample)
        floor = [_lower(_kth(s[(cells.labels == label) & (cells.ids != i)], k)) for s, label, i in zip(scores, own["label"], own["vec_id"], strict=True)]
        need = ~(cells.bounds(anchors)[1] < np.array(floor)[:, None])
        return {"need": np.flatnonzero(need.any(0)).tolist(), "floor": [[x] for x in floor]}

    return needs


def _limits(score: int, low: int, high: int) -> tuple[int, int]:
    return -(-low * score // 100), high * score // 100


def _for_negatives(k: int, low: int, high: int):
    """Cells that may hold one of the first k rows of other labels between the limits of any of an anchor's positives."""

    def needs(cells: Cells, own: dict) -> dict:
        anchors = matrix(own["vector"], cells.dim)
        scores, (least, most) = products(anchors, cells.sample), cells.bounds(anchors)
        need, floors = np.zeros(len(cells.count), dtype=bool), []
        for s, label, goals, x, y in zip(scores, own["label"], own["goals"], least, most, strict=True):
            floor = []
            for goal in goals:
                a, b = _limits(goal["score"], low, high)
                known = _kth(s[(cells.labels != label) & (s >= a) & (s <= b)], k)
                floor.append(_lower(max(float(a), known)))
                if a <= b:
                    need |= ~(y < floor[-1]) & ~(x > b + 1e-9 * abs(b))
            floors.append(floor)
        return {"need": np.flatnonzero(need).tolist(), "floor": floors}

    return needs


# ---- the local joins

FOUND = "uid bigint, k int, id bigint, score bigint"


def _best(row: np.ndarray, score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Of each row the first k by score, then id."""
    order = np.lexsort((ids, -score, row))
    row = row[order]
    place = np.arange(len(row)) - np.searchsorted(row, row)
    return order[place < k]


def _near(group: dict, block: dict, dim: int, k: int, limits: tuple[int, int] | None):
    """The best k of a block for each anchor of a group (k number 0), or for each of its positives (by their number)."""
    scores = products(matrix(group["vector"], dim), matrix(block["vector"], dim))
    ids, labels = np.array(block["vec_id"], dtype=np.int64), np.array(block["label"], dtype=np.int64)
    own, names = np.array(group["label"], dtype=np.int64), np.array(group["vec_id"], dtype=np.int64)
    same = own[:, None] == labels[None, :]
    found = []
    if limits is None:
        floor = np.array([f[0] for f in group["floor"]])
        at, c = np.nonzero(same & (names[:, None] != ids[None, :]) & (scores >= floor[:, None]))
        some = _best(at, scores[at, c], ids[c], k)
        found.append((at[some], np.zeros(len(some), dtype=np.int32), ids[c[some]], scores[at[some], c[some]]))
    else:
        for j in range(max(map(len, group["goals"]), default=0)):
            rows = np.array([i for i, g in enumerate(group["goals"]) if len(g) > j], dtype=np.int64)
            ends = [_limits(group["goals"][i][j]["score"], *limits) for i in rows.tolist()]
            low, high = (np.array(x, dtype=np.int64)[:, None] for x in zip(*ends, strict=True))
            floor = np.array([group["floor"][i][j] for i in rows.tolist()])
            at, c = np.nonzero(~same[rows] & (scores[rows] >= low) & (scores[rows] <= high) & (scores[rows] >= floor[:, None]))
            some = _best(at, scores[rows[at], c], ids[c], k)
            number = np.array([group["goals"][i][j]["k"] for i in rows.tolist()], dtype=np.int32)
            found.append((rows[at[some]], number[at[some]], ids[c[some]], scores[rows[at[some]], c[some]]))
    row, number, other, score = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.empty(0, np.int64),) * 4
    return np.array(group["uid"], dtype=np.int64)[row], number.astype(np.int32), other, score


def _joined(dim: int, k: int, limits: tuple[int, int] | None):
    """A unit's group comes before its block."""

    def run(batches):
        import pyarrow as pa

        group = None
        for b in batches:
            for i in range(b.num_rows):
                row = b.slice(i, 1).to_pylist()[0]
                if row["kind"] == 0:
                    group = row
                    continue
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in _near(group, row, dim, k, limits)], names=["uid", "k", "id", "score"])

    return run


def _join(groups: DataFrame, blocks: DataFrame, cells: Cells, k: int, limits: tuple[int, int] | None = None) -> DataFrame:
    """Each group with each block of the cells that it needs, a unit in one task; (uid, k, id, score) of the best."""
    wanted = groups.select("part", "piece", F.explode("need").alias("cell"))
    units = wanted.join(blocks.select(F.col("part").alias("cell"), F.col("piece").alias("block")), "cell")
    lists = [n for n in groups.columns if n not in ("part", "piece", "need")]
    left = units.join(groups.select("part", "piece", *lists), ["part", "piece"]).select("part", "piece", "cell", "block", F.lit(0).alias("kind"), *lists)
    right = blocks.select(F.col("part").alias("cell"), F.col("piece").alias("block"), "vec_id", "label", "vector").join(wanted, "cell")
    right = right.select("part", "piece", "cell", "block", F.lit(1).alias("kind"), *(F.col(n) if n in ("vec_id", "label", "vector") else F.lit(None).cast(groups.schema[n].dataType).alias(n) for n in lists))
    unit = ["part", "piece", "cell", "block"]
    dealt = left.unionByName(right).repartition(*unit).sortWithinPartitions(*unit, "kind").select("kind", *lists)
    return dealt.mapInArrow(released(_joined(cells.dim, k, limits)), FOUND)


def _first(found: DataFrame, k: int) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("uid", "k").orderBy(F.desc("score"), "id"))
    return found.withColumn("place", place).where(F.col("place") <= k)


def _groups(cells: Cells, anchors: list) -> tuple[list[int], list[int]]:
    """By cell: the group of its anchors and how many pieces they are cut into; cells near each other share a group."""
    count = np.zeros(len(cells.count), dtype=np.int64)
    for r in anchors:
        count[r["cell"]] = r["n"]
    group, pieces = [0] * len(count), [1] * len(count)
    left, now, at, held = set(range(len(count))), 0, 0, 0
    while left:
        left.discard(at)
        if held and held + count[at] > GROUP:
            now, held = now + 1, 0
        group[at], pieces[at] = now, max(1, int(-(-count[at] // GROUP)))
        held += int(count[at])
        if left:
            rest = np.array(sorted(left))
            at = int(rest[(cells.pivots[rest] @ cells.pivots[at]).argmax()])
    return group, pieces


def hard_negatives(rows: DataFrame, anchor: Column, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of rows vec_id, embedding, label.

    ``anchor`` tells by vec_id which rows are anchors. Components count as floor(256 x); a row's score for an anchor is
    their inner product. An anchor's positives are its first rows of the same label and another vec_id; its negatives for
    a positive are the first rows of other labels with ``low`` to ``high`` per cent of the positive's score; equal scores
    come by smaller vec_id.

    Rows without vec_id, label or vector, or with a null or non-finite component, take no part. Zero vectors do; vectors of
    unequal length are followed by zeros. Repeated rows, and rows of one vec_id with other contents, are rows of their own.
    Scores beyond a long's range are set to its ends. A positive with a negative score has no negatives. An empty table
    gives none. Further columns are not read.
    """
    spark = rows.sparkSession
    prepare(spark)
    slim = only(rows, "vec_id", "embedding", "label").select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), "embedding")
    slim = slim.where("vec_id is not null and label is not null and embedding is not null").withColumn("anchor", anchor)
    made = slim.mapInArrow(released(_prepared), "vec_id bigint, label bigint, anchor boolean, vector binary, size int, square double")
    vectors = materialize(made.where("vector is not null").withColumn("uid", F.monotonically_increasing_id()), "knn-vectors")
    n, longest, dim = vectors.agg(F.count("*"), F.max("square"), F.max("size")).first()
    drawn = F.pmod(F.xxhash64("uid"), F.lit(1 << 30)) < int(min(1.0, 0.9 * SAMPLE / max(n, 1)) * (1 << 30))
    cells = Cells(vectors.where(drawn if n > SAMPLE else F.lit(True)).select("vec_id", "label", "vector").limit(SAMPLE).collect(), n, float(np.sqrt(longest or 0)), dim or 0)
    if not n:
        return spark.createDataFrame([], "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint")
    placed = materialize(vectors.select("uid", "vec_id", "label", "anchor", "vector").mapInArrow(released(_assigned(cells)), "uid bigint, vec_id bigint, label bigint, anchor boolean, vector binary, cell int, angle double"), "knn-cells")
    seen = placed.groupBy("cell").agg(F.count("*").alias("n"), F.min("angle").alias("least"), F.max("angle").alias("most"), F.count_if("anchor").alias("anchors")).collect()
    for r in seen:
        cells.count[r["cell"]], cells.least[r["cell"]], cells.most[r["cell"]] = r["n"], r["least"], r["most"]
    by_cell = lambda numbers: F.array(*[F.lit(int(x)) for x in numbers])[F.col("cell")]  # noqa: E731  no more than PIVOTS
    piece = lambda pieces: F.pmod(F.xxhash64("uid"), by_cell(pieces).cast("long")).cast("int")
    blocks = _packing(placed.select(F.col("cell").alias("part"), piece(np.maximum(1, -(-cells.count // BLOCK))).alias("piece"), "vec_id", "label", "vector"), ("vec_id", "label", "vector"), cells)
    group, pieces = _groups(cells, [{"cell": r["cell"], "n": r["anchors"]} for r in seen])
    anchors = placed.where("anchor").select(by_cell(group).alias("part"), piece(pieces).alias("piece"), "uid", "vec_id", "label", "vector")
    groups = _packing(anchors, ("uid", "vec_id", "label", "vector"), cells, _for_positives(positives))
    good = materialize(_first(_join(groups, blocks, cells, positives), positives).select("uid", F.col("place").alias("k"), "id", "score"), "knn-positives")
    goals = good.where("score >= 0").groupBy("uid").agg(F.sort_array(F.collect_list(F.struct("k", "id", "score"))).alias("goals"))  # no more than ``positives``
    again = _packing(anchors.join(goals, "uid"), ("uid", "vec_id", "label", "vector", "goals"), cells, _for_negatives(negatives, low, high))
    hard = materialize(_first(_join(again, blocks, cells, negatives, (low, high)), negatives), "knn-negatives")
    for done in (vectors, blocks, groups, again):
        discard(done)
    named = good.select("uid", "k", F.col("id").alias("positive_id"), F.col("score").alias("positive_score")).join(placed.where("anchor").select("uid", F.col("vec_id").alias("anchor_id")), "uid")
    out = hard.select("uid", "k", F.col("place").alias("rank"), F.col("id").alias("negative_id"), F.col("score").alias("negative_score")).join(named, ["uid", "k"])
    return out.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
