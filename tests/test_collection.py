"""The data source of collections, ignore files against git, and reading by JDBC."""

import os
import random
import subprocess

import pytest
from pyspark.sql import functions as F

from tessera.sources import collection as co
from tessera.sources import files as fs
from tessera.streaming import state as ss


@pytest.fixture
def root(tmp_path):
    at = tmp_path / "notes"
    (at / "sub" / "deep").mkdir(parents=True)
    for name, body in (("a.md", "# A\n"), ("sub/b.md", "é b"), ("sub/deep/c.md", ""), ("sub/d.txt", "d"), (".hidden.md", "h")):
        (at / name).write_text(body)
    return at


def test_texts_equal_those_of_the_file_reader(spark, root):
    got = co.texts(spark, "n", str(root))
    assert spark.read.format("collection").option("files", 1).load(str(root)).rdd.getNumPartitions() == 3
    want = fs.collection(spark, "n", str(root)).select("collection", "path", "body")
    assert sorted(map(tuple, got.select("collection", "path", "body").collect())) == sorted([*map(tuple, want.collect()), ("n", "sub/deep/c.md", "")])  # files without a byte too
    assert {r["path"] for r in co.texts(spark, "n", str(root), "**/*", hidden=True).collect()} == {"a.md", "sub/b.md", "sub/deep/c.md", "sub/d.txt", ".hidden.md"}


def test_stream_sees_changes_and_removals(spark, root, tmp_path):
    ss.stateful(spark)

    def run():
        q = ss.file_changes(co.listings(spark, "n", str(root)), 2).writeStream.outputMode("update").foreachBatch(lambda b, k: b.write.mode("overwrite").parquet(f"{tmp_path}/out/{k}")).option("checkpointLocation", f"{tmp_path}/c").start()
        q.processAllAvailable()
        q.stop()
        return {r["path"]: r["active"] for r in ss.files_now(spark, f"{tmp_path}/c").collect()}

    assert run() == {"a.md": True, "sub/b.md": True, "sub/deep/c.md": True}
    (root / "sub" / "b.md").unlink()
    (root / "e.md").write_text("new")
    assert run() == {"a.md": True, "sub/b.md": False, "sub/deep/c.md": True, "e.md": True}
    (root / "sub" / "b.md").write_text("back")
    assert run()["sub/b.md"]


RULES = {
    "": ["# a comment", "*.log", "!keep.log", "/top.txt", "build/", "docs/**/x.md", "**/gen", "te?t.[ch]", "data/**", "", "trail.md  ", "[!a-c].cfg", "a/b/*.tmp", "\\#odd", "\\!odd"],
    "src": ["!*.log", "secret*", "/lib", "*.c"],
    "src/lib": ["!util.c", "*.md"],
    "a/b": ["!x.tmp", "deep/"],
}


def test_ignored_equals_git(spark, tmp_path):
    rng = random.Random(3)
    names = ["x.log", "keep.log", "top.txt", "x.md", "test.c", "tent.h", "a.cfg", "d.cfg", "x.tmp", "y.tmp", "secret1", "util.c", "main.c", "gen", "trail.md", "#odd", "!odd", "plain"]
    folders = ["", "src", "src/lib", "src/libs", "build", "src/build", "docs", "docs/one", "docs/one/two", "data", "data/in", "a/b", "a/b/deep", "a/b/c/deep", "gen", "x/gen/y", "build/src"]
    paths = sorted({f"{f}/{n}".lstrip("/") for f in folders for n in rng.sample(names, 12)})
    paths = [p for p in paths if not any(q.startswith(p + "/") for q in paths)]
    repo = tmp_path / "repo"
    for p in paths:
        (repo / p).parent.mkdir(parents=True, exist_ok=True)
        (repo / p).write_text("x")
    for folder, lines in RULES.items():
        (repo / folder / ".gitignore").write_text("\n".join(lines) + "\n")
    subprocess.run(["git", "init", "-q", str(repo)], check=True)
    told = subprocess.run(["git", "-C", str(repo), "-c", "core.quotePath=false", "check-ignore", "--no-index", "--stdin"], input="\n".join(paths), capture_output=True, text=True).stdout.split("\n")
    rules = co.ignore_rules(spark, str(repo))
    got = co.ignored(spark.createDataFrame([(p,) for p in paths], "path string"), rules)
    want = {x for x in told if x}
    assert {r["path"] for r in got.collect()} == want and 20 < len(want) < len(paths) - 20


def test_jdbc_reads_parts_with_a_pushed_filter(spark, tmp_path):
    url = f"jdbc:derby:{tmp_path}/db;create=true"
    driver = {"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}
    rows = spark.range(100).select(F.col("id").cast("int").alias("ID"), F.concat(F.lit("p"), F.col("id").cast("string")).alias("PATH"))
    rows.coalesce(1).write.format("jdbc").options(url=url, dbtable="DOCS", **driver).save()
    got = fs.jdbc(spark, url, "DOCS", driver, ("ID", 0, 100, 4))
    assert got.rdd.getNumPartitions() == 4 and got.count() == 100
    some = got.where("ID >= 90").select("PATH")
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(ID,90)" in plan and "ReadSchema: struct<PATH:string>" in plan
    assert {r["PATH"] for r in some.collect()} == {f"p{i}" for i in range(90, 100)}
    assert not os.path.exists("DOCS")
