"""Every registered query of the library proper against its SQL on the smallest tables, with odd rows added.

Ids are unique, as files and documents have one path each; texts are null, empty, long, end in line ends of both kinds.
"""

import math
import os

import duckdb
import pytest
from pyspark.sql import functions as F

from tessera.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
QUERIES, ORACLE = registry.queries(), registry.oracle_sql()


TEXTS = [None, "", "line one\nthe and eau\n", "\n\n", "crlf one\r\nthe and two\r\neau", "x " * 9000, "é日本   ñ eau \t tab", "# Title é\nbody `a.rs` and `x/y.rs` {\"a\": 1}\n## Two\n- item\n"]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """A folder with the tables of the smallest scale, four of them with odd rows."""
    folder = tmp_path_factory.mktemp("tables")
    read = lambda t: spark.read.parquet(f"{SF}/{t}.parquet")
    rows = [(5000 + i, t, ["en", "fr", "de", "ja"][i % 4], None if i == 3 else f"src{i % 3}", None if t is None else len(t)) for i, t in enumerate(TEXTS)]
    events = read("events")
    odd = {
        "documents": spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint"),
        "events": events.limit(3).withColumn("value", F.lit(None).cast("double")).withColumn("event_id", F.col("event_id") + 100_000),
        "pages": read("pages").limit(1).withColumn("html", F.lit("")).withColumn("page_id", F.col("page_id") + 100_000),
        "conversations": read("conversations").limit(2).withColumn("conv_id", F.lit(99_999).cast("bigint")).withColumn("text", F.lit(None).cast("string")),
    }
    for t in TABLES:
        if t in odd:
            read(t).unionByName(odd[t]).coalesce(1).write.parquet(f"{folder}/{t}.parquet")
        else:
            os.symlink(f"{SF}/{t}.parquet", f"{folder}/{t}.parquet")
    return str(folder)


@pytest.fixture(scope="module")
def con(tables):
    c = duckdb.connect()
    for t in TABLES:
        path = f"{tables}/{t}.parquet"
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}{'/*.parquet' if os.path.isdir(path) else ''}')")
    return c


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}")
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    if type(v).__name__ == "Decimal":
        return plain(float(v))
    return v


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, tables, name):
    df = QUERIES[name](spark, tables)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    assert got
    if name in ORACLE:
        cursor = con.execute(ORACLE[name])
        names = [x[0] for x in cursor.description]
        assert sorted(names) == columns
        want = sorted((tuple(plain(r[names.index(c)]) for c in columns) for r in cursor.fetchall()), key=repr)
        assert got == want


def test_every_sql_has_a_query():
    assert set(ORACLE) <= set(QUERIES)


@pytest.mark.parametrize("name", ["vector_search_hashed", "hybrid_search"])
def test_texts_whose_features_cancel_out(spark, tmp_path, name):
    """"acc" and "acg" share a place and have opposite signs, so a text of both has a norm of zero: its SQL puts it first."""
    texts = ["acc acg", "acc acg acc acg", "acc", "acc acg that config", "acc acg\n\nacg acc config eau les", "acc acg", "tion of that config eau les"]
    rows = [(7000 + i, t, "en", f"src{i % 2}", len(t)) for i, t in enumerate(texts)]
    spark.read.parquet(f"{SF}/documents.parquet").unionByName(spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")).coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    df = QUERIES[name](spark, str(tmp_path))
    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    cursor = c.execute(ORACLE[name])
    names = [x[0] for x in cursor.description]
    want = [tuple(map(plain, r)) for r in cursor.fetchall()]
    assert [tuple(plain(r[n]) for n in names) for r in df.collect()] == want
    assert {7000, 7001} <= {r[names.index("id")] for r in want if r[names.index("score")] == "nan"}
