"""Steps that have to grow no faster than their rows: tokens grouped within a row, sections cut once, short batches."""

import math
import time

from pyspark.sql import functions as F

from tessera.functions import text as tx
from tessera.functions import vector as vec
from tessera.operators import details as de
from tessera.operators import fulltext as ft
from tessera.operators import search as se
from tessera.operators import textual as te

TEXTS = [("a", "The cat, the dog; the é cat"), ("b", None), ("c", ""), ("d", "x y"), ("e", "word " * 40 + "tail")]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def contents(spark):
    return spark.createDataFrame(TEXTS, "hash string, body string")


def test_features_and_vectors_are_made_without_a_shuffle(spark):
    made, whole = vec.hashed_features(contents(spark)), vec.hashed_vectors(contents(spark))
    assert "Exchange" not in plan(made) and "Exchange" not in plan(whole)
    got, dense = {(r["hash"], r["idx"]): r["value"] for r in made.collect()}, {r["hash"]: r["vec"] for r in whole.collect()}
    assert {h for h, _ in got} == set(dense) == {"a", "e"}
    for h, text in TEXTS:
        if h in dense:
            assert [int(max(-1.0, min(1.0, x)) * 32767) for x in dense[h]] == vec.query_vector(text)


def searched(spark):
    rows = [(i, "c", f"{'src/' * (i % 2)}{i}.md", f"t{i}", h, b, True) for i, (h, b) in enumerate([*TEXTS, TEXTS[0], TEXTS[0], ("f", "dog cat bird"), TEXTS[3]])]
    return spark.createDataFrame(rows, "id long, collection string, path string, title string, hash string, body string, active boolean")


def test_searches_score_a_row_where_its_body_is_read(spark):
    queries = ["cat dog", "x", "zzz", "é the word"]
    rows = searched(spark)
    lines = plan(se.vector_hashed_many(rows, queries)).splitlines()
    assert max(i for i, x in enumerate(lines) if "Exchange" in x) < min(i for i, x in enumerate(lines) if "MapInArrow" in x)
    assert se.vector_hashed_many(rows, []).collect() == []
    want = set()
    for i, q in enumerate(queries):
        best = {}
        for r in rows.collect():
            terms, a, b = tx.query_tokens(q), vec.query_vector(q), vec.query_vector(r["body"] or "")
            n = math.sqrt(sum(x * x for x in a) * sum(x * x for x in b))
            if n and (cos := sum(x * y for x, y in zip(a, b, strict=True)) / n) > 0:
                file = f"c/{r['path']}"
                score = (0.74 * cos + 0.26 * (sum(t in f"{r['title']} {r['body']}".lower() for t in terms) / len(terms))) * (1.05 if "/src/" in file else 1)
                best[r["hash"]] = min(best.get(r["hash"], (0, "", 0)), (-round(score, 4), file, r["id"]))
        want |= {(i, h, -s, file, k) for h, (s, file, k) in best.items()}
    assert {(i, h) for i, h, *_ in want} == {(0, "a"), (0, "f"), (3, "a"), (3, "e")}
    assert {(r["query"], r["hash"], round(r["score"], 4), r["file"], r["id"]) for r in se.vector_hashed_many(rows, queries).collect()} == want


def test_a_row_meets_the_shuffle_once_for_a_query(spark):
    made = se.lexical_many(searched(spark), ["the cat dog"], 10)
    assert {(r["hash"], r["variant"]) for r in made.collect()} == {("a", 2), ("f", 1)}
    assert "array_min(" in plan(made)  # three forms of the query, one row


def test_postings_of_a_row_are_grouped_in_batches(spark):
    made = ft.postings(contents(spark))
    assert "lambda" not in plan(made)
    got = [tuple(r) for r in made.collect()]
    want = {}
    for h, text in TEXTS:
        for i, t in enumerate(tx.query_tokens(text or "")):
            want.setdefault((t, h), []).append(i)
    assert sorted((t, h, n, tuple(at)) for t, h, n, at in got) == sorted((t, h, len(at), tuple(at)) for (t, h), at in want.items())
    assert [(t, -n) for t, _, n, _ in got] == sorted((t, -n) for t, _, n, _ in got)


def test_a_task_sorts_a_bounded_share_of_postings(spark):
    texts = spark.range(40).select(F.col("id").cast("string").alias("hash"), F.repeat(F.concat(F.lit("w"), F.col("id").cast("string"), F.lit(" ")), 250_000).alias("body"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        assert ft.postings(texts).rdd.getNumPartitions() > 1
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", str(parts))


def test_token_blocks_are_those_of_the_postings_without_a_sort(spark):
    made = ft.token_blocks(contents(spark))
    assert "Sort [" not in plan(made)
    assert sorted(map(tuple, made.collect())) == sorted(map(tuple, ft.blocks(ft.postings(contents(spark))).collect()))


def test_a_text_is_cut_into_lines_once_for_all_its_sections(spark):
    body = "\n".join(f"create table t{i} (\n id int\n)" for i in range(1000))
    began = time.time()
    got = de.sql_columns(spark.createDataFrame([("p", body)], "path string, body string")).collect()
    assert len(got) == 1000 and got[0]["column_name"] == "id" and time.time() - began < 20


def test_python_workers_get_short_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
    te.chunked(contents(spark).withColumnRenamed("hash", "id"), "paragraph", 10, 2).collect()
    assert int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= 2048


def test_unit_vectors_are_those_of_the_sql_to_the_bit(spark, tmp_path):
    import struct

    import duckdb

    import __spark_entry__ as entry

    nan, inf = float("nan"), float("inf")
    odd = [[1.0, -1e-8, 0.0, -0.0], [0.0, -0.0], [1e-9, -1e-9], [3.0, None, 4.0], [None, None], [], None, [nan, 1.0], [inf, 1.0, -inf], [-1.0, 2.0000005, 1e-20], [-3e-7, 1.0]]
    rows = [(i, v, 0) for i, v in enumerate(odd)]
    spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int").coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{tmp_path}/embeddings.parquet/*.parquet')")
    bits = lambda v: None if v is None else ["null" if x is None else "nan" if x != x else struct.pack("d", x) for x in v]
    want = {k: bits(v) for k, v in con.execute(entry.oracle_sql()["l2_normalize"]).fetchall()}
    assert {r[0]: bits(r[1]) for r in entry.queries()["l2_normalize"](spark, str(tmp_path)).collect()} == want


def test_placed_parts_make_the_whole_text_of_a_collection(spark):
    rows = [(f"c{i % 2}" if i % 5 else None, i // 2 if i % 7 else None, "x" * (i % 4) + str(i)) for i in range(200)]
    got = te.placed(spark.createDataFrame(rows, "collection string, id bigint, part string")).collect()
    for c in ("c0", "c1", None):
        own = sorted((r for r in got if r["collection"] == c), key=lambda r: r["place"])
        parts = sorted((r for r in rows if r[0] == c), key=lambda r: (r[1] is None, r[1] or 0, r[2]))
        whole = "\n".join(p for _, _, p in parts)
        assert [(r["id"], r["part"]) for r in own] == [(i, p) for _, i, p in parts] and [r["place"] for r in own] == [*range(1, len(parts) + 1)]
        assert all(whole[r["start"] : r["start"] + len(r["part"])] == r["part"] for r in own)


def test_a_batch_of_searches_has_more_tasks_over_more_documents(spark, monkeypatch):
    from tessera.operators import search as se

    monkeypatch.setattr(se, "BATCH_DOCUMENTS", 10, raising=False)
    rows = spark.range(300).select("id", F.lit(True).alias("active"), F.concat(F.lit("one two n"), F.col("id").cast("string")).alias("body"))
    made = se.batch_lexical(rows, spark.createDataFrame([(1, "one n7"), (2, "two"), (3, "none")], "query_id int, query string"))
    assert "hashpartitioning(id" in plan(made) and ", 31)" in plan(made)
    assert [tuple(r)[:3] for r in made.orderBy("query_id", "rank").collect()] == [(1, 7, 1.0), (1, 0, 0.5), (1, 1, 0.5), (2, 0, 1.0), (2, 1, 1.0), (2, 2, 1.0)]


def test_segments_are_the_postings_without_a_shuffle(spark, monkeypatch):
    import pyarrow as pa

    from tessera.functions import grouping

    made = ft.stored_segments(contents(spark))
    want = sorted((t, h, n, tuple(at)) for t, h, n, at in ft.postings(contents(spark)).collect())
    assert sorted((t, h, n, tuple(at)) for t, h, n, at in made.collect()) == want
    rows = [(h, tx.query_tokens(x) if x is not None else None) for h, x in TEXTS] + [("f", ["dog", "a", "", "dog"])]
    batches = [pa.RecordBatch.from_pydict({"hash": [h for h, _ in part], "pieces": pa.array([p for _, p in part], pa.list_(pa.string()))}) for part in (rows[:2], rows[2:3], rows[3:5], rows[5:])]
    monkeypatch.setattr(grouping, "SLICE", 2)
    for most, segments in ((100, 1), (3, 2), (1, 4)):
        monkeypatch.setattr(grouping, "SEGMENT_ROWS", most)
        out = [tuple(r.values()) for b in grouping.segments("hash")(iter(batches)) for r in b.to_pylist()]
        assert sorted((t, h, n, tuple(at)) for t, h, n, at in out) == sorted([*want, ("dog", "f", 2, (0, 1))])
        falls = sum((a[0], -a[2]) > (b[0], -b[2]) for a, b in zip(out, out[1:], strict=False))
        assert falls < segments


def test_stored_tables_take_less_than_the_texts(spark, monkeypatch):
    """No body is shuffled, and postings and contents on disk are smaller than what they come from."""
    import os

    from tessera.plans import search as ps

    sf = "/root/testdata/sf0.01"
    size = lambda df: sum(os.path.getsize(f.removeprefix("file://")) for f in df.inputFiles())
    texts = ps.store(spark, sf).agg(F.sum(F.octet_length("body"))).first()[0]
    _, content, held, _ = ps.stored(spark, sf, False)
    assert size(held) < 0.8 * texts and size(content) < 0.8 * texts
    assert "Exchange hashpartitioning" not in plan(ps.content(spark, sf))


def test_one_content_of_copies_in_any_file(spark, tmp_path):
    from tessera.operators import store as st

    texts = ["a b", None, "a b", "", "c d", "a b", "c d", "e"]
    for k, rows in enumerate((texts, texts[::-1], ["f", "a b"])):
        spark.createDataFrame([(1, t, "en", "s", 0) for t in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet/part={k}")
    documents = spark.read.parquet(f"{tmp_path}/documents.parquet")
    got = st.content_in_place(st.from_documents(st.placed(documents), "in_file", "at_row"))
    want = st.content(st.from_documents(documents))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and want.count() == 5


def test_many_tokens_with_a_term_need_no_join(spark):
    stored = spark.createDataFrame([(f"the{i}", "h") for i in range(1200)] + [("x", "h"), ("lathe", "g")], "token string, hash string")
    near = se.Terms(["the"]).near(stored, stored.select("token"))
    assert near.count() == 1201 and "Join" not in plan(near)
