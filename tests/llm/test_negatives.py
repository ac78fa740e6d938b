"""The kNN join against brute force: cells, groups and blocks of all sizes, exact scores, bounds that hold."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import negatives

SCHEMA = "vec_id bigint, embedding array<double>, label bigint"


def brute(rows):
    kept = [(i, [int(np.floor(256 * x)) for x in v], n) for i, v, n in rows if i is not None and n is not None and v is not None]
    dot = lambda a, b: sum(x * y for x, y in zip(a, b, strict=False))
    out = []
    for i, v, n in kept:
        if i % 100 == 0:
            for ps, p in sorted(((-dot(v, w), j) for j, w, m in kept if m == n and j != i))[:5]:
                hard = sorted((-dot(v, w), j) for j, w, m in kept if m != n and -30 * ps <= 100 * dot(v, w) <= -90 * ps)[:10]
                out += [(i, p, k, j, -ps, -ns) for k, (ns, j) in enumerate(hard, 1)]
    return sorted(out)


def clustered(n, dim, seed):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, dim))
    return [(i, (centres[i % 6] * (1 + i % 3) + rng.normal(scale=0.2, size=dim)).tolist(), int(rng.integers(3))) for i in range(n)]


@pytest.mark.parametrize("small", [False, True])
def test_join(spark, monkeypatch, small):
    if small:  # many cells, groups and blocks; a small sample bounds less
        for name, value in {"SAMPLE": 40, "GROUP": 2, "BLOCK": 16}.items():
            monkeypatch.setattr(negatives, name, value)
    rows = clustered(900, 8, 3) + [(j, [0.5] * 8, 1) for j in range(900, 1200)]  # equal vectors tie
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = negatives.hard_negatives(df, F.col("vec_id") % 100 == 0)
    assert sorted(map(tuple, got.collect())) == brute(rows)


def test_large_components_are_exact(spark):
    rows = [(0, [1e6 + 1 / 256, 3.0], 1), (1, [1e6, 2.0], 1), (2, [9e5 + 1 / 256, 1.0], 2), (3, [9e5, 1.0], 2), (100, [4e6, 7e6], 2), (4, [4e6 + 1 / 256, 6.9e6], 2), (5, [3e6, 6e6], 1)]
    got = negatives.hard_negatives(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") % 100 == 0)
    assert sorted(map(tuple, got.collect())) == brute(rows)


@pytest.mark.parametrize("rows", [[], [(100, [1.0], 1)], [(100, [1.0], None), (None, [1.0], 1), (200, None, 1)], [(100, [0.0], 1), (1, [0.0], 1), (2, [0.0], 2)]])
def test_few_rows(spark, rows):
    got = negatives.hard_negatives(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") % 100 == 0)
    assert sorted(map(tuple, got.collect())) == brute(rows)


def test_bounds_hold():
    rng = np.random.default_rng(5)
    v = np.floor(rng.normal(size=(500, 6)) * 256)
    sample = [{"vec_id": i, "label": 0, "vector": b"d" + x.astype("<f8").tobytes()} for i, x in enumerate(v[:100])]
    cells = negatives.Cells(sample, 500, float(np.sqrt((v * v).sum(1).max())), 6)
    cell, angle = cells.assign(v)
    for c in range(len(cells.count)):
        if (cell == c).any():
            cells.least[c], cells.most[c] = angle[cell == c].min(), angle[cell == c].max()
    low, high = cells.bounds(v[:50])
    scores = v[:50] @ v.T
    assert (scores >= low[:, cell]).all() and (scores <= high[:, cell]).all()
    assert (scores > 0.3 * high[:, cell]).any()
