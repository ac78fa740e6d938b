"""The Merkle manifest against a tree built by hand."""

import hashlib
import random
import zlib
from collections import Counter

import pytest

from tessera.llm import merkle, queries

SCHEMA = "doc_id bigint, source string, lang string, n_chars bigint, text string"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def tree(nodes, fanout):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([h(*levels[-1][i : i + fanout]) for i in range(0, len(levels[-1]), fanout)])
    return levels


def path(levels, at, fanout):
    out = []
    for nodes in levels[:-1]:
        start = at // fanout * fanout
        out.append((at - start, [x for i, x in enumerate(nodes[start : start + fanout], start) if i != at]))
        at //= fanout
    return out


def brute(rows, fanout=2):
    by = {}
    for r in rows:
        leaf = h(*map(field, r))
        hit = r[0] is not None and r[3] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0
        by.setdefault(r[2], []).append((-(1 << 63) if r[0] is None else r[0], leaf, h(*map(field, (*r[:3], r[3] + 1, r[4]))) if hit else leaf, r[0]))
    langs = sorted(by, key=lambda x: (x is not None, (x or "").encode()))
    trees = {k: tree([x[1] for x in sorted(by[k])], fanout) for k in langs}
    top = tree([trees[k][-1][0] for k in langs], fanout)
    out = []
    for place, k in enumerate(langs):
        for i, (_, leaf, changed, doc_id) in enumerate(sorted(by[k])):
            steps = path(trees[k], i, fanout) + path(top, place, fanout)
            node = changed
            for at, others in steps:
                node = h(*others[:at], node, *others[at:])
            out.append((doc_id, leaf, trees[k][-1][0], top[-1][0], h(*(x for _, o in steps for x in o)), node, node == top[-1][0]))
    return Counter(out)


def odd(n):
    rng = random.Random(n)
    rows = [(rng.choice([i, i << 40, -i * 7, 5, None]), rng.choice(["a", None, "", "é"]), rng.choice(["en", "en", "en", None, "", "fr", "日"]), rng.choice([None, i, 0]), rng.choice(["x" * (i % 50), None, "", "日本\n" * 400])) for i in range(n)]
    return rows + rows[: n // 5] * 3 + [(5, "same", "en", 1, "t")] * (n // 2)


@pytest.mark.parametrize("rows, fanout, limit", [([], 2, 4096), (odd(1)[:1], 2, 4096), (odd(30), 2, 4096), (odd(200), 2, 16), (odd(400), 3, 16), ([(i, "s", "en", 3, "t") for i in range(2049)], 2, 4096)])
def test_manifest(spark, rows, fanout, limit):
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = Counter(map(tuple, merkle.manifest(docs, fanout, limit).collect()))
    assert got == brute(rows, fanout)


def test_equal_rows_are_ranked_by_their_number(spark):
    rows = [(5, "same", "en", 1, "t")] * 9000
    got = Counter(map(tuple, merkle.manifest(spark.createDataFrame(rows, SCHEMA).repartition(2), limit=4096).collect()))
    assert got == brute(rows)


def test_many_languages_and_clashing_names(spark):
    rows = [(i, "s", f"l{i % 1500}", 1, "t") for i in range(1600)]
    docs = spark.createDataFrame([(*r, 1, 2, "x", 4, 5) for r in rows], SCHEMA + ", rank int, prefix int, lang_key string, a int, uid int")
    assert Counter(map(tuple, merkle.manifest(docs).collect())) == brute(rows)


def test_query_holds_every_document(spark):
    got = queries.op13_merkle_manifest(spark, "/root/testdata/sf0.001")
    assert got.count() == 200
