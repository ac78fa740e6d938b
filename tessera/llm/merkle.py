"""Merkle manifest of a table of documents, as a radix-ranked trie.

A row's leaf is the SHA-256 of its fields. Its place among the leaves of its language comes from histograms and not from a
global sort: rows are counted by the leading digits of doc_id (base 4096), counts are summed up digit by digit, and the
smaller siblings of a digit give it its offset, so no task sees more than 4096 children of a node. A bucket that holds more
than ``limit`` rows is counted again by its next digits: of doc_id, then of the leaf, then of the row's own number, so a
doc_id that millions of rows share, or millions of equal rows, are ranked like any others. Within a bucket rows are sorted.

The rank's digits, in base ``fanout``, are a node's key in the trie. Nodes that share the longest prefix, all but the last
few digits, are reduced in one task to the node of that prefix; then the prefixes are reduced likewise, until a language has
one node, its subroot; subroots, by language, are the nodes of one more trie. Each step keeps its nodes, packed by prefix;
on the way down a node's path is its own siblings before those of its prefix, and leaves are verified against them.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import only, prepare, released
from tessera.session import discard, materialize

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
DIGIT, LIMIT, SPREAD, RUN, LISTED = 12, 4096, 1024, 1024, 100_000
#: Tampering: rows whose crc32 of the decimal doc_id this number divides.
TAMPERED = 7
LEAST = -(1 << 63)


def _field(value: Column) -> Column:
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaves(docs: DataFrame) -> DataFrame:
    """(uid, lang_key, doc_id, leaf, changed): digests of every row, and of the row after tampering where that changes it.

    ``lang_key`` is empty for null and sorts as the language does; ``uid`` numbers rows.
    """
    own = only(docs, *FIELDS)
    fields = {c: _field(F.col(c)) for c in FIELDS}
    more = fields | {"n_chars": _field(F.col("n_chars").cast("decimal(38,0)") + 1)}
    digest = lambda parts: F.unhex(F.sha2(F.concat(*(parts[c] for c in FIELDS)), 256))
    hit = (F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(TAMPERED)) == 0) & F.col("n_chars").isNotNull()
    lang_key = F.coalesce(F.concat(F.lit("="), F.col("lang").cast("string")), F.lit(""))
    return own.select(F.monotonically_increasing_id().alias("uid"), lang_key.alias("lang_key"), F.col("doc_id").cast("long").alias("doc_id"), digest(fields).alias("leaf"), F.when(hit, digest(more)).alias("changed"))


# ---- ranks

_KEY = ("lang_key", "a", "b", "c")


class Level:
    """A digit of a row's order: its number's column and how many bits are left out below it."""

    def __init__(self, column: str, shift: int) -> None:
        self.column, self.shift = column, shift

    def key(self) -> list[Column]:
        """Columns a, b, c of a row with numbers doc, mark and uid: whole numbers before this one, its leading bits, zeros."""
        own = F.shiftright(F.col(self.column), self.shift)
        before = {"doc": (), "mark": ("doc",), "uid": ("doc", "mark")}[self.column]
        return [c.alias(n) for c, n in zip([*map(F.col, before), own, *[F.lit(0).cast("long")] * 2], "abc", strict=False)]

    def low(self) -> list[Column]:
        """The least doc, mark and uid of a bucket with this key."""
        at = {"doc": "a", "mark": "b", "uid": "c"}[self.column]
        return [(F.shiftleft(F.col(c), self.shift) if c == at else F.col(c)).alias(n) for c, n in zip("abc", ("doc", "mark", "uid"), strict=True)]


def _levels(least: int, most: int, rows: int) -> tuple[list[Level], list[Level]]:
    """The digits above the first histogram's, and those that buckets are counted by in turn."""
    first = max(0, math.ceil(math.log2((most - least + 1) / max(1, rows // SPREAD)))) if most > least else 0
    first = min(first, 62)
    above = [Level("doc", s) for s in range(first + DIGIT, 63, DIGIT) if (most >> s - DIGIT) - (least >> s - DIGIT) >= 1 << DIGIT][::-1]
    below = [Level("doc", first), *(Level("doc", s) for s in [*range(first - DIGIT, 0, -DIGIT), *[0] * (first > 0)])]
    return above, [*below, *(Level("mark", s) for s in range(48, -1, -DIGIT)), *(Level("uid", s) for s in range(48, 0, -DIGIT))]


def _few(table: DataFrame) -> DataFrame:
    """A hint to broadcast a table whose size has been checked; a larger one is left to a shuffle."""
    return F.broadcast(table) if table.limit(LISTED + 1).count() <= LISTED else table


def ranked(rows: DataFrame, limit: int = LIMIT) -> DataFrame:
    """The rows of leaves() with ``rank``, from 0 in each language: by doc_id (null as the least number), then leaf."""
    order = F.coalesce("doc_id", F.lit(LEAST).cast("long"))
    mark = F.conv(F.substring(F.hex("leaf"), 1, 15), 16, 10).cast("long")
    numbered = rows.withColumn("doc", order).withColumn("mark", mark)
    seen = numbered.agg(F.min("doc"), F.max("doc"), F.count("*")).first()
    above, levels = _levels(seen[0] or 0, seen[1] or 0, seen[2])
    open_, placed, buckets, used = numbered, [], [], 0
    for depth, level in enumerate(levels):
        used = depth + 1
        keyed = open_.select("*", *level.key())
        counts = materialize(keyed.groupBy(*_KEY).agg(F.count("*").alias("held")), "merkle-digits")
        large = counts.where(F.col("held") > limit).select(*_KEY)
        if depth + 1 == len(levels) or large.isEmpty():
            placed.append(keyed)
            buckets.append(counts.withColumn("depth", F.lit(depth)))
            break
        large = _few(large)
        placed.append(keyed.join(large, [*_KEY], "left_anti"))
        buckets.append(counts.join(large, [*_KEY], "left_anti").withColumn("depth", F.lit(depth)))
        open_ = keyed.join(large, [*_KEY], "left_semi").drop("a", "b", "c")
    offsets = _offsets(buckets, above, levels[:used])
    place = F.row_number().over(Window.partitionBy("depth", *_KEY).orderBy("doc", "leaf", "uid"))
    out = None
    for depth, keyed in enumerate(placed):
        own = keyed.withColumn("depth", F.lit(depth)).join(offsets, ["depth", *_KEY])
        own = own.select("lang_key", (F.col("offset") + place - 1).alias("rank"), "doc_id", "leaf", "changed")
        out = own if out is None else out.unionByName(own)
    return out


def _offsets(buckets: list[DataFrame], above: list[Level], levels: list[Level]) -> DataFrame:
    """(depth, lang_key, a, b, c, offset): how many rows of the language come before each bucket, digit by digit."""
    every = None
    for depth, own in enumerate(buckets):
        own = own.select("depth", "lang_key", "held", *levels[depth].low())
        every = own if every is None else every.unionByName(own)
    before = every.select("lang_key").distinct().select("lang_key", *(F.lit(0).cast("long").alias(n) for n in ("pa", "pb", "pc")), F.lit(0).cast("long").alias("base"))
    parent, out = [F.lit(0).cast("long").alias(n) for n in ("pa", "pb", "pc")], None
    up = ["lang_key", "pa", "pb", "pc"]
    for i, level in enumerate([*above, *levels]):
        depth = max(0, i - len(above))
        nodes = every.where(F.col("depth") >= depth).select("lang_key", "held", *parent, *level.key()).groupBy(*up, "a", "b", "c").agg(F.sum("held").alias("held"))
        smaller = F.sum("held").over(Window.partitionBy(*up).orderBy("a", "b", "c").rowsBetween(Window.unboundedPreceding, -1))
        nodes = nodes.join(before, up).select("lang_key", "a", "b", "c", (F.col("base") + F.coalesce(smaller, F.lit(0))).alias("base"))
        nodes = materialize(nodes, "merkle-offsets")
        if i >= len(above):
            own = nodes.select(F.lit(depth).alias("depth"), *_KEY, F.col("base").alias("offset"))
            out = own if out is None else out.unionByName(own)
        before = nodes.withColumnsRenamed({"a": "pa", "b": "pb", "c": "pc"})
        parent = [c.alias(n) for c, n in zip(level.key(), ("pa", "pb", "pc"), strict=True)]
    return out


# ---- the trie


def _digest(hexes: list[str]) -> str:
    return hashlib.sha256("".join(hexes).encode()).hexdigest()


def _width(fanout: int) -> int:
    """How many digits a step reduces."""
    return max(1, int(math.log(RUN, fanout) + 1e-9))


def grown(nodes: list[str], prefix: int, fanout: int) -> list[list[str]]:
    """The nodes below a prefix, level by level, up to the one that is left.

    The first prefix of a group that is not full is the group's only one, so it ends with its own last node.
    """
    width = _width(fanout)
    out = [nodes]
    while len(out) <= width and (prefix > 0 or len(nodes) == fanout**width or len(out[-1]) > 1):
        last = out[-1]
        out.append([_digest(last[i : i + fanout]) for i in range(0, len(last), fanout)])
    return out


def own_path(levels: list[list[str]], at: int, fanout: int) -> list[tuple[int, list[str]]]:
    """Place in its run and siblings, level by level, of the node ``at``."""
    path = []
    for nodes in levels[:-1]:
        start = at // fanout * fanout
        path.append((at - start, nodes[start:at] + nodes[at + 1 : start + fanout]))
        at //= fanout
    return path


def folded(node: str, path: list[tuple[int, list[str]]]) -> str:
    for place, others in path:
        node = _digest([*others[:place], node, *others[place:]])
    return node


def _put(path: list[tuple[int, list[str]]]) -> bytes:
    return b"".join(place.to_bytes(2) + len(others).to_bytes(2) + bytes.fromhex("".join(others)) for place, others in path)


def _get(data: bytes) -> list[tuple[int, list[str]]]:
    path, at = [], 0
    while at < len(data):
        place, n = int.from_bytes(data[at : at + 2]), int.from_bytes(data[at + 2 : at + 4])
        path.append((place, [data[i : i + 32].hex() for i in range(at + 4, at + 4 + 32 * n, 32)]))
        at += 4 + 32 * n
    return path


def _hexes(data: bytes) -> list[str]:
    return [data[i : i + 32].hex() for i in range(0, len(data), 32)]


def _packed(extra: tuple[str, ...], types: list):
    """Rows of equal (lang_key, prefix), in order, as one row: their nodes end to end, the other columns as lists."""

    def run(batches):
        import pyarrow as pa

        schema = pa.schema([("lang_key", pa.string()), ("prefix", pa.int64()), ("nodes", pa.binary()), *((c, pa.list_(t)) for c, t in zip(extra, types, strict=True))])

        def row(key, held):
            return {"lang_key": key[0], "prefix": key[1], "nodes": b"".join(held[0]), **dict(zip(extra, held[1:], strict=True))}

        key, held = None, None
        for b in batches:
            out = []
            for lang, prefix, *values in zip(*(b.column(c).to_pylist() for c in ("lang_key", "prefix", "leaf", *extra)), strict=True):
                if (lang, prefix) != key:
                    if key is not None:
                        out.append(row(key, held))
                    key, held = (lang, prefix), [[] for _ in values]
                for x, v in zip(held, values, strict=True):
                    x.append(v)
            yield pa.RecordBatch.from_pylist(out, schema)
        if key is not None:
            yield pa.RecordBatch.from_pylist([row(key, held)], schema)

    return run


def _pack(nodes: DataFrame, fanout: int, extra: dict[str, str]) -> DataFrame:
    """Nodes (lang_key, rank, leaf and others) by their longest prefix, written."""
    import pyarrow as pa

    each = nodes.withColumn("prefix", F.floor(F.col("rank") / F.lit(fanout ** _width(fanout))).cast("long"))
    each = each.repartition("lang_key", "prefix").sortWithinPartitions("lang_key", "prefix", "rank").select("lang_key", "prefix", "leaf", *extra)
    types = [{"bigint": pa.int64(), "binary": pa.binary()}[t] for t in extra.values()]
    lists = "".join(f", {c} array<{t}>" for c, t in extra.items())
    return materialize(each.mapInArrow(released(_packed(tuple(extra), types)), f"lang_key string, prefix bigint, nodes binary{lists}"), "merkle-nodes")


def _reduced(fanout: int):
    def run(batches):
        import pyarrow as pa

        for b in batches:
            prefixes = b.column("prefix").to_pylist()
            tops = [bytes.fromhex(grown(_hexes(n), p, fanout)[-1][0]) for n, p in zip(b.column("nodes").to_pylist(), prefixes, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("lang_key"), b.column("prefix"), pa.array(tops, pa.binary())], names=["lang_key", "rank", "leaf"])

    return run


def _reduce(packed: DataFrame, fanout: int) -> DataFrame:
    return packed.select("lang_key", "prefix", "nodes").mapInArrow(released(_reduced(fanout)), "lang_key string, rank bigint, leaf binary")


def _steps(packed: DataFrame, fanout: int) -> tuple[list[DataFrame], DataFrame]:
    """The packed nodes of every step, and the node that is left of each group."""
    steps = [packed]
    while True:
        tops = materialize(_reduce(steps[-1], fanout), "merkle-tops")
        if (tops.agg(F.max("rank")).first()[0] or 0) == 0:
            return steps, tops
        steps.append(_pack(tops, fanout, {}))
        discard(tops)


def _children(fanout: int):
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            out = []
            for lang, prefix, nodes, path in zip(*(b.column(c).to_pylist() for c in ("lang_key", "prefix", "nodes", "path")), strict=True):
                levels = grown(_hexes(nodes), prefix, fanout)
                first = prefix * fanout ** _width(fanout)
                out += [{"lang_key": lang, "prefix": first + i, "path": _put(own_path(levels, i, fanout)) + path} for i in range(len(levels[0]))]
            yield pa.RecordBatch.from_pylist(out, pa.schema([("lang_key", pa.string()), ("prefix", pa.int64()), ("path", pa.binary())]))

    return run


def _paths(steps: list[DataFrame], top: DataFrame, fanout: int) -> DataFrame:
    """(lang_key, prefix, path) for the nodes that the first step's rows reduce to, from the path of each group's last node."""
    now = top
    for packed in steps[:0:-1]:
        now = packed.join(now, ["lang_key", "prefix"]).select("lang_key", "prefix", "nodes", "path").mapInArrow(released(_children(fanout)), "lang_key string, prefix bigint, path binary")
        now = materialize(now, "merkle-paths")
    return now


def _verified(root: str, fanout: int):
    def run(batches):
        import pyarrow as pa

        names = ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")
        schema = pa.schema([("doc_id", pa.int64()), *((n, pa.string()) for n in names[1:6]), ("verified", pa.bool_())])
        for b in batches:
            for prefix, nodes, ids, changed, path, subroot in zip(*(b.column(c).to_pylist() for c in ("prefix", "nodes", "doc_id", "changed", "path", "subroot")), strict=True):
                upper = _get(path)
                rest = "".join(x for _, others in upper for x in others)
                levels = grown(_hexes(nodes), prefix, fanout)
                out = []
                for i, (doc_id, other) in enumerate(zip(ids, changed, strict=True)):
                    own = own_path(levels, i, fanout)
                    proof = _digest([*(x for _, others in own for x in others), rest])
                    got = folded(levels[0][i] if other is None else other.hex(), own + upper)
                    out.append((doc_id, levels[0][i], subroot, root, proof, got, got == root))
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), schema.types, strict=True)], schema=schema)

    return run


def manifest(docs: DataFrame, fanout: int = 2, limit: int = LIMIT) -> DataFrame:
    """A row per document: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified.

    Null fields count as ``-``, empty ones as ``0:``; a null language is one of its own and comes first; a null doc_id
    orders as the least number and is never tampered with. Rows of equal doc_id are in order of their leaves, equal rows
    each are a leaf with a proof of its own. Texts of any length are hashed whole. An empty table has no rows and no root.
    Further columns are not read.
    """
    prepare(docs.sparkSession)
    rows = materialize(leaves(docs), "merkle-leaves")
    packed = _pack(ranked(rows, limit), fanout, {"doc_id": "bigint", "changed": "binary"})
    discard(rows)
    steps, subroots = _steps(packed, fanout)
    place = F.row_number().over(Window.orderBy("lang_key")) - 1  # a row per language
    named = materialize(subroots.select("lang_key", place.cast("long").alias("rank"), "leaf"), "merkle-languages")
    tops, root = _steps(_pack(named.select(F.lit("").alias("lang_key"), "rank", "leaf"), fanout, {}), fanout)
    last = root.first()
    start = root.select("lang_key", F.col("rank").alias("prefix"), F.lit(b"").alias("path"))
    over = _paths([named, *tops], start, fanout).select(F.col("prefix").alias("rank"), "path")
    over = named.join(over, "rank").select("lang_key", F.lit(0).cast("long").alias("prefix"), "path")
    paths = _paths(steps, over, fanout)
    whole = packed.join(paths, ["lang_key", "prefix"]).join(named.select("lang_key", F.lower(F.hex("leaf")).alias("subroot")), "lang_key")
    schema = "doc_id bigint, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    return whole.select("prefix", "nodes", "doc_id", "changed", "path", "subroot").mapInArrow(released(_verified(last["leaf"].hex() if last else "", fanout)), schema)
