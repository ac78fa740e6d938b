"""Mixing sources to target weights, in DataFrame operations only.

Words are counted per document and written once as a narrow table. Sizes per source are summed (map-side first), target
sizes come from a water-filling rule over one row per source, and each document is emitted floor(rate) times plus one
hash-seeded Bernoulli copy whose probability is the fraction. A draw is a function of a row's id, source and text and of its
number among equal rows, so no row's text is shuffled for it and reruns agree. A source's words stray from its target by
what independent draws leave: sqrt(f (1 - f) * sum of squared sizes) at a fraction f.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import only
from tessera.session import materialize

WEIGHTS, LIMIT = (1, 2, 3), 3
WORD = r"[^\x20\x09-\x0D]+"
#: Equal rows that one task expands, so that a row repeated without end spreads over tasks.
BLOCK = 1 << 16


def words(text: Column) -> Column:
    """The number of words of a text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame) -> DataFrame:
    """From (source, source_size) a row per source: rank, weight and target.

    Shares run by weight over all sizes; a target stops at LIMIT times its source's size and the excess goes to the others
    by weight. In order of size per weight the stopped sources come first, so one pass of running sums finds the level.
    One row per source is all that meets in a task here.
    """
    ranked = sizes.withColumn("rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    weight = F.element_at(F.array(*[F.lit(w) for w in WEIGHTS]), (F.col("rank") % len(WEIGHTS) + 1).cast("int")).cast("long")
    all_rows = Window.partitionBy()
    by_need = Window.orderBy((F.col("source_size").cast("double") / F.col("weight")).asc(), F.col("rank").asc()).rowsBetween(Window.unboundedPreceding, -1)
    level = ranked.withColumn("weight", weight).withColumns({
        "total": F.sum("source_size").over(all_rows), "weights": F.sum("weight").over(all_rows),
        "before_size": F.coalesce(F.sum("source_size").over(by_need), F.lit(0)), "before_weight": F.coalesce(F.sum("weight").over(by_need), F.lit(0)),
    })
    # the level if exactly the sources before this one are stopped; the first that this level does not stop sets it
    own = (F.col("total") - LIMIT * F.col("before_size")).cast("double") / (F.col("weights") - F.col("before_weight"))
    level = level.withColumn("own", own)
    open_ = F.when(F.col("own") * F.col("weight") <= LIMIT * F.col("source_size"), F.col("own"))
    level = level.withColumn("level", F.min_by(open_, F.struct(open_.isNull(), F.col("source_size").cast("double") / F.col("weight"), F.col("rank"))).over(all_rows))
    target = F.least((LIMIT * F.col("source_size")).cast("double"), F.coalesce(F.col("level") * F.col("weight"), F.lit(float("inf"))))
    return level.select("source", "source_size", "rank", "weight", target.alias("target"))


def draw(doc_id: Column, source: Column, mark: Column, number: Column) -> Column:
    """A number in [0, 1): 52 bits of md5 over id, source, the text's md5 and the row's number among equal rows."""
    parts = [F.coalesce(c.cast("string"), F.lit("null")) for c in (doc_id, source, mark)]
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts, number.cast("string"))), 1, 13), 16, 10).cast("double") / float(1 << 52)


def copies(doc_id: Column, source: Column, mark: Column, number: Column) -> Column:
    """How often a row is emitted, given its source's rate."""
    return (F.floor("rate") + F.when(draw(doc_id, source, mark, number) < F.col("rate") - F.floor("rate"), 1).otherwise(0)).cast("long")


def plan(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """The narrow tables behind a mix, all written: (doc_id, source, mark, size, key) of every document, (s, source_size,
    target, rate) of every source, and the keys that several rows share (None if there are none)."""
    mark = F.md5(F.col("text"))
    base = only(docs, "doc_id", "source", "text").select("doc_id", "source", mark.alias("mark"), words(F.col("text")).alias("size"))
    base = materialize(base.withColumn("key", F.xxhash64("doc_id", "source", "mark")), "mix-sizes")
    per = targets(base.groupBy("source").agg(F.sum("size").alias("source_size")))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    per = materialize(per.select(F.col("source").alias("s"), "source_size", "target", rate.alias("rate")), "mix-targets")
    often = materialize(base.groupBy("key").count().where("count > 1").select("key"), "mix-repeated")
    return base, per, None if often.isEmpty() else often


def numbered(rows: DataFrame, often: DataFrame | None, key: str, number: str) -> DataFrame:
    """The rows with their number among equal rows: equal ones are counted (map-side first) and expanded in blocks."""
    if often is None:
        return rows.withColumn(number, F.lit(0).cast("long"))
    often = often.withColumnRenamed("key", "__often")
    lone = rows.join(often, F.col(key) == F.col("__often"), "left_anti").withColumn(number, F.lit(0).cast("long"))
    several = rows.join(often, F.col(key) == F.col("__often"), "left_semi").groupBy(*rows.columns).agg(F.count("*").alias("__n"))
    blocks = several.withColumn("__block", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("__n") - 1) / BLOCK))))
    blocks = blocks.repartition(key, "__block")
    last = F.least((F.col("__block") + 1) * BLOCK, F.col("__n")) - 1
    return lone.unionByName(blocks.withColumn(number, F.explode(F.sequence(F.col("__block") * BLOCK, last))).drop("__n", "__block"))


def mix(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, copies, taken.

    Null text has size 0; a null source is a source of its own, last in order; null and repeated doc_ids keep their rows,
    and rows that agree in id, source and text are numbered, so each has its own draw; an empty table gives none. A source
    of size 0 has target 0 and takes nothing. Very long texts are counted whole. Further columns are ignored.
    """
    base, per, often = plan(docs)
    joined = numbered(base, often, "key", "number").join(per, F.col("source").eqNullSafe(F.col("s")))
    joined = joined.withColumn("copies", copies(F.col("doc_id"), F.col("source"), F.col("mark"), F.col("number")))
    return joined.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def emit(docs: DataFrame) -> DataFrame:
    """The mixed documents themselves: each row as often as mix() takes it, with the columns it came with.

    Nulls, empty texts, repeated rows and an empty table count as in mix(). Further columns stay, whatever their names;
    rows that differ in them alone are not equal rows, and share their draws. Rows are shuffled only where they are repeated.
    """
    _, per, often = plan(docs)
    mark = F.md5(docs["text"])
    own = docs.select(F.struct(*docs.columns).alias("__row"), mark.alias("__mark"), F.xxhash64(docs["doc_id"], docs["source"], mark).alias("__key"))
    own = numbered(own, often, "__key", "__number")
    joined = own.join(per, F.col("__row.source").eqNullSafe(F.col("s")))
    joined = joined.withColumn("__copies", copies(F.col("__row.doc_id"), F.col("__row.source"), F.col("__mark"), F.col("__number"))).where("__copies > 0")
    return joined.select("__row", F.explode(F.sequence(F.lit(1), F.col("__copies").cast("int"))).alias("__copy")).select("__row.*")
