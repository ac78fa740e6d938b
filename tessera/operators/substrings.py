"""Which strings lie in which others, without pairing them all.

pairs() is for short strings on both sides, paths and labels: a string that holds another holds all its runs of a few
characters, so each needle is keyed by the run of its own that the fewest others hold, and meets those on equal keys.
found() is for needles in whole texts: an automaton of a block of needles goes over every text once, whatever their number;
needles beyond a block are another block's, so no task holds more than one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.session import workers_import

RUN = 6
#: Characters of the needles of a block.
BLOCK = 2_000_000


def _runs(rows: DataFrame, name: str, sizes: Column) -> DataFrame:
    """(name, run): the distinct runs of each string, of each of the given sizes."""
    once = rows.select(name, F.explode(F.array(F.filter(F.split(name, ""), lambda c: c != ""))).alias("chars"), sizes.alias("sizes"))  # split once
    own = F.flatten(F.transform("sizes", lambda n: F.when(F.size("chars") >= n, F.transform(F.sequence(F.lit(1), F.size("chars") - n + 1), lambda i: F.array_join(F.slice("chars", i, n), ""))).otherwise(F.array().cast("array<string>"))))
    return once.select(name, F.explode(F.array_distinct(own)).alias("run"))


def _keyed(own: DataFrame, held: DataFrame) -> DataFrame:
    """(needle, run): of each needle's runs the one that the fewest hays hold; a run that none holds rules the needle out."""
    often = held.join(own.select("run").distinct(), "run", "left_semi").groupBy("run").agg(F.count("*").alias("n"))
    keyed = own.join(often, "run", "left").groupBy("needle").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "run")).alias("k"))
    return keyed.where("k.n > 0").select("needle", "k.run")


def pairs(needles: DataFrame, hays: DataFrame) -> DataFrame:
    """(needle, hay) of distinct strings where the hay holds the needle; null holds nothing, and all hold the empty one.

    needles has the column ``needle``, hays the column ``hay``.
    """
    needles, hays = needles.select("needle").where("needle IS NOT NULL").distinct(), hays.select("hay").where("hay IS NOT NULL").distinct()
    told = needles.agg(F.collect_set(F.least(F.length("needle"), F.lit(RUN))).alias("sizes")).first()["sizes"]  # RUN + 1 values at most
    empty = hays.select(F.lit("").alias("needle"), "hay") if 0 in told else None
    sizes = sorted(n for n in told if n)
    if not sizes:
        return empty if empty is not None else hays.select(F.lit("").alias("needle"), "hay").limit(0)
    held = _runs(hays, "hay", F.array(*map(F.lit, sizes)))
    own = _runs(needles.where("needle <> ''"), "needle", F.array(F.least(F.length("needle"), F.lit(RUN))))
    keyed = _keyed(own, held)
    out = keyed.join(held, "run").where(F.contains("hay", F.col("needle"))).select("needle", "hay")
    return out if empty is None else out.unionByName(empty)


def _automaton(needles: list[tuple[str, bool]]):
    import ahocorasick

    built = ahocorasick.Automaton()
    for needle, whole in needles:
        built.add_word(needle, (needle, whole))
    built.make_automaton()
    return built


def _seen(needles: list[tuple[str, bool]]):
    word = lambda c: c.isalnum() or c == "_"

    def run(batches):
        import pyarrow as pa

        built, left = _automaton(needles), dict(needles)
        for b in batches:
            for text in b.column("text").to_pylist():
                if not left:
                    break
                hits = set()
                for end, (needle, whole) in built.iter(text or ""):
                    if needle in left and needle not in hits:
                        start = end - len(needle) + 1
                        if not whole or not (start and word(text[start - 1])) and not (end + 1 < len(text) and word(text[end + 1])):
                            hits.add(needle)
                for needle in hits:
                    del left[needle]
                if hits:
                    yield pa.RecordBatch.from_arrays([pa.array(sorted(hits), pa.string())], names=["needle"])
                    if left and len(left) < len(built) // 2:  # what is found already need not be found again
                        built = _automaton([*left.items()])

    return run


def found(needles: DataFrame, texts: DataFrame, block: int = BLOCK) -> DataFrame:
    """(needle) that lie in some text; with ``whole`` only where no letter, digit or underscore is next to them.

    needles: needle, whole; texts: text. Null and empty needles are found nowhere, null texts hold nothing.
    """
    spark = needles.sparkSession
    workers_import(spark)
    own = needles.where("needle <> ''").select("needle", "whole").distinct()
    n = -(-(own.agg(F.sum(F.length("needle"))).first()[0] or 0) // block) or 1
    out = None
    for i in range(n):
        part = [(r["needle"], r["whole"]) for r in own.where(F.pmod(F.xxhash64("needle"), F.lit(n)) == i).collect()]  # a block
        each = texts.select("text").mapInArrow(_seen(part), "needle string").distinct() if part else needles.select("needle").limit(0)
        out = each if out is None else out.unionByName(each)
    return out
