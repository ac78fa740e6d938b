"""Substring joins against all pairs, with plans that pair nothing."""

import random

import pytest

from tessera.operators import substrings
from tessera.plans import registry

WORDS = ["", "a", "ab", "é", "日本", "src/a.rs", "a.rs", "src", "d1/src/a.rs", "d12/src/a.rs", "zzzzzzzzzz", "aaaaaaaaaaaa", "aaaaaa", "x_y", None]


def made(seed, n):
    rng = random.Random(seed)
    return WORDS + ["".join(rng.choice("ab/é.") for _ in range(rng.randrange(1, 14))) for _ in range(n)]


@pytest.mark.parametrize("n", [0, 150])
def test_pairs(spark, n):
    needles, hays = made(1, n), made(2, n)
    got = substrings.pairs(spark.createDataFrame([(x,) for x in needles], "needle string"), spark.createDataFrame([(x,) for x in hays], "hay string"))
    assert sorted(map(tuple, got.collect())) == sorted({(x, y) for x in needles for y in hays if x is not None and y is not None and x in y})


def test_pairs_of_nothing(spark):
    none, one = spark.createDataFrame([], "needle string"), spark.createDataFrame([("ab",)], "hay string")
    assert substrings.pairs(none, one).count() == 0
    assert substrings.pairs(one.withColumnRenamed("hay", "needle"), none.withColumnRenamed("needle", "hay")).count() == 0
    assert [tuple(r) for r in substrings.pairs(spark.createDataFrame([("",)], "needle string"), one).collect()] == [("", "ab")]


@pytest.mark.parametrize("block", [2_000_000, 50])
def test_found(spark, block):
    needles, texts = made(3, 120), [" ".join(x for x in made(k, 12) if x) + " _id id9 to" for k in range(4, 9)] + [None, ""]
    rows = [(x, i % 2 == 0) for i, x in enumerate(dict.fromkeys(needles))] + [("id", True), ("to", True), ("id9", False)]
    word = lambda c: c.isalnum() or c == "_"

    def holds(t, x, whole):
        return any(t.startswith(x, i) and not (whole and (i and word(t[i - 1]) or i + len(x) < len(t) and word(t[i + len(x)]))) for i in range(len(t)))

    got = substrings.found(spark.createDataFrame(rows, "needle string, whole boolean"), spark.createDataFrame([(t,) for t in texts], "text string").repartition(3), block)
    assert sorted(r["needle"] for r in got.collect()) == sorted(x for x, w in rows if x and any(t and holds(t, x, w) for t in texts))


@pytest.mark.parametrize("name", ["changed_agents", "resolve_labels", "dag_edges", "domain_insights", "file_coverage", "symbol_coverage", "representation"])
def test_nothing_is_paired(spark, name):
    plan = registry.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and ("BroadcastNestedLoopJoin" not in plan or name == "representation")  # two one-row sides


def test_a_run_that_no_hay_holds_rules_its_needle_out(spark):
    from tessera.operators import substrings as sb

    own = spark.createDataFrame([("src/core7", "src/co"), ("src/core7", "/core7"), ("core/a", "core/a")], "needle string, run string")
    held = spark.createDataFrame([(f"src/core/a.rs{i}", r) for i in range(9) for r in ("src/co", "core/a")], "hay string, run string")
    assert [tuple(r) for r in sb._keyed(own, held).collect()] == [("core/a", "core/a")]
