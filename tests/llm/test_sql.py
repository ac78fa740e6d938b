"""The queries of the training-data operators against their SQL on small tables."""

import math
import random

import duckdb
import pytest

from tessera.llm import queries

SF = "/root/testdata/sf0.001"
QUERIES, ORACLE = queries.queries(), queries.oracle_sql()


def plain(v):
    return "nan" if isinstance(v, float) and math.isnan(v) else float(f"{v:.9g}") if isinstance(v, float) else v


def held(spark, sf_dir, name, tables):
    con = duckdb.connect()
    for t in tables:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet{'' if sf_dir == SF else '/*.parquet'}')")
    df = QUERIES[name](spark, sf_dir)
    columns = sorted(df.columns)
    cursor = con.execute(ORACLE[name])
    names = [x[0] for x in cursor.description]
    assert sorted(names) == columns
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    assert got == sorted((tuple(plain(r[names.index(c)]) for c in columns) for r in cursor.fetchall()), key=repr)
    assert got


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query(spark, name):
    held(spark, SF, name, ["documents", "embeddings", "conversations", "labels", "benchmark"])


def test_every_sql_has_a_query():
    assert set(ORACLE) <= set(QUERIES) and {int(q[2:].split("_")[0]) for q in QUERIES} >= {*range(1, 14)}


def test_odd_vectors(spark, tmp_path):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0], 1), (2, [2.0, 0.0], 1), (3, [nan, 1.0], 1), (4, [inf, 1.0], 1), (5, [-inf, 0.0], 1), (6, [0.0, 0.0], 1), (7, None, 1), (8, [None, 1.0], 1), (9, [1.0, 0.0], None), (10, [1.0, 0.01], 1), (11, [1.0, 0.0], 2)]
    spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int").write.parquet(str(tmp_path / "embeddings.parquet"))
    held(spark, str(tmp_path), "op2_cap_filters", ["embeddings"])


@pytest.mark.parametrize("seed", [1, 2])
def test_odd_negatives(spark, tmp_path, seed):
    rng = random.Random(seed)
    vectors = [[rng.choice([0.0, 0.5, -0.25, 1.0]) for _ in range(rng.choice([3, 4, 4, 4]))] for _ in range(12)] + [[0.0] * 4, [], None, [None, 1.0], [math.nan], [math.inf, 1.0]]
    rows = [(rng.choice([100 * (i % 5), i, i, -i, None]), rng.choice(vectors), rng.choice([0, 1, 2, 8, 9, 9, None]), i) for i in range(400)]
    rows += rows[:40] + [(100, [1.0, 0.5, 0.0, 0.0], 9, 1), (200, [0.0] * 4, 9, 1), (7, [9e4, -9e4, 0.0, 1.0], 9, 1), (300, [9e4, -8e4, 0.0, 1.0], 1, 1), (8, [9e4, -7e4], 1, 2)]
    spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int, score int").write.parquet(str(tmp_path / "embeddings.parquet"))
    held(spark, str(tmp_path), "op12_voronoi_negatives", ["embeddings"])


def test_odd_documents(spark, tmp_path):
    rows = [(None, "a b c", "a"), (None, "a b c", "a"), (1, None, None), (1, "", "a"), (2, "x " * 3000, "b"), (3, "é\x1c ü\x85 " * 60, "c"), (3, "é\x1c ü\x85 " * 60, "c"), (4, "l one\nl one\n\n\nl two " * 30, None)]
    spark.createDataFrame(rows, "doc_id bigint, text string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    for name in ("op3_mix_sources", "op5_quality_cascade"):
        held(spark, str(tmp_path), name, ["documents"])
