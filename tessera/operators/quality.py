"""Scores of generated documentation: completeness, references, freshness, grounding, coverage, coherence."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import lines
from tessera.operators.substrings import found

#: Sections, weights, patterns and penalties.
REQUIRED = ("Project Overview", "Architecture Description", "Core Workflows", "Boundary Interfaces")
OPTIONAL, LEAST_BYTES = "Database Overview", 100
REFERENCE = r"`([^`]+\.[a-zA-Z]{1,10})`"
PATH_REFERENCE = r"`([a-zA-Z0-9_/\\.-]+\.[a-zA-Z]{1,10})`"
CONVERSION = "^(to|as|into|from|try_from|try_into)_"
TERM = r"`([A-Za-z_][A-Za-z0-9_]{2,})`"
CLAIM = r"(?i)\b(built with|uses|powered by|written in|framework|stack)\b"
ERROR_PENALTY, WARNING_PENALTY = 0.15, 0.05
WEIGHTS = {"completeness": 0.20, "accuracy": 0.20, "freshness": 0.10, "grounding": 0.20, "coherence": 0.15, "helpfulness": 0.15}
COMPLETENESS_BLEND = {"sections": 0.5, "symbols": 0.3, "representation": 0.2}
FILE_SHARE, SYMBOL_SHARE = 0.6, 0.4


def completeness(sections: DataFrame) -> DataFrame:
    """One row: the share of required sections that are long enough; the optional one counts where it is there."""
    longest = sections.groupBy("section").agg(F.max(F.octet_length("content")).alias("bytes"))
    good = F.count_if(F.col("section").isin(*REQUIRED, OPTIONAL) & (F.col("bytes") >= LEAST_BYTES))
    return longest.agg(good.alias("present"), (F.lit(len(REQUIRED)) + F.count_if(F.col("section") == OPTIONAL)).alias("expected")).select("present", "expected", (F.col("present") / F.col("expected")).alias("score"))


def _skipped(ref: Column, equals: bool) -> Column:
    tests = [F.contains(ref, F.lit("://")), F.startswith(ref, F.lit("v")), *(F.endswith(ref, F.lit(e)) for e in (".com", ".org", ".io"))]
    return reduce(lambda a, b: a | b, tests + ([F.contains(ref, F.lit("="))] if equals else []))


def references(sections: DataFrame, files: DataFrame) -> DataFrame:
    """(section, ref, valid): references in backticks that are a known path or a known file name."""
    refs = sections.select("section", F.explode(F.regexp_extract_all("content", F.lit(REFERENCE), F.lit(1))).alias("ref")).where(~_skipped(F.col("ref"), True))
    names = files.select(F.substring_index("path", "/", -1).alias("name")).distinct()
    marked = refs.withColumn("name", F.substring_index("ref", "/", -1))
    hit = marked.join(files.select(F.col("path").alias("ref"), F.lit(True).alias("p")).distinct(), "ref", "left").join(names.withColumn("n", F.lit(True)), "name", "left")
    return hit.select("section", "ref", (F.col("p").isNotNull() | F.col("n").isNotNull()).alias("valid"))


def share(rows: DataFrame, flag: str) -> DataFrame:
    """One row: the share of rows with the flag, 1 where there are none."""
    return rows.agg(F.count_if(F.col(flag)).alias("good"), F.count("*").alias("checked")).select("good", "checked", F.coalesce(F.try_divide("good", "checked"), F.lit(1.0)).alias("score"))


def freshness(sections: DataFrame, files: DataFrame) -> DataFrame:
    """(section, ref, fresh): path references; one that is no file counts only if it holds a directory."""
    refs = sections.select("section", F.explode(F.regexp_extract_all("content", F.lit(PATH_REFERENCE), F.lit(1))).alias("ref")).where(~_skipped(F.col("ref"), False))
    hit = refs.join(files.select(F.col("path").alias("ref"), F.lit(True).alias("p")).distinct(), "ref", "left")
    return hit.select("section", "ref", F.col("p").isNotNull().alias("fresh")).where(F.col("fresh") | F.rlike("ref", F.lit(r"[/\\]")))


def grounding(sections: DataFrame, known: list[str]) -> DataFrame:
    """(section, line, grounded): lines that claim a technology, and whether they name a known one."""
    each = sections.select("section", F.explode(lines(F.col("content"))).alias("line")).where(F.rlike("line", F.lit(CLAIM)))
    named = reduce(lambda a, b: a | b, [F.contains(F.lower("line"), F.lit(k.lower())) for k in known])
    return each.select("section", "line", named.alias("grounded"))


def coherence(sections: DataFrame) -> DataFrame:
    """(norm, variants): spellings of the same name, without pairs of a conversion method and a type."""
    terms = sections.select(F.explode(F.regexp_extract_all("content", F.lit(TERM), F.lit(1))).alias("term")).distinct()
    groups = terms.groupBy(F.regexp_replace(F.lower("term"), "[_-]", "").alias("norm")).agg(F.array_sort(F.collect_set("term")).alias("variants"))
    conversion = F.exists("variants", lambda v: F.rlike(v, F.lit(CONVERSION)))
    type_name = F.exists("variants", lambda v: F.rlike(v, F.lit("^[A-Z]")) & ~F.rlike(v, F.lit(CONVERSION)))
    return groups.where(~((F.size("variants") == 2) & conversion & type_name))


def symbol_coverage(symbols: DataFrame, sections: DataFrame) -> DataFrame:
    """(symbol, found): names in some section; short ones only as whole words."""
    distinct = symbols.where("symbol <> ''").select("symbol").distinct()
    needles = distinct.select(F.col("symbol").alias("needle"), (F.octet_length("symbol") <= 4).alias("whole"))
    seen = found(needles, sections.select(F.col("content").alias("text"))).select(F.col("needle").alias("symbol"), F.lit(True).alias("found"))
    return distinct.join(seen, "symbol", "left").select("symbol", F.coalesce("found", F.lit(False)).alias("found"))


def file_coverage(files: DataFrame, sections: DataFrame) -> DataFrame:
    """(path, found): files whose path or name some section holds, whatever its case."""
    files = files.select("path").distinct()
    names = files.select("path", F.explode(F.array(F.lower("path"), F.lower(F.substring_index("path", "/", -1)))).alias("needle"))
    seen = found(names.select("needle", F.lit(False).alias("whole")), sections.select(F.lower("content").alias("text")))
    hit = names.join(seen, "needle", "left_semi").select("path").distinct().withColumn("f", F.lit(True))
    return files.join(hit, "path", "left").select("path", F.coalesce("f", F.lit(False)).alias("found"))


def section_scores(findings: DataFrame) -> DataFrame:
    """(section, errors, warnings, score): 1 less a penalty for each error and warning, not below 0."""
    counts = findings.where("section IS NOT NULL").groupBy("section").agg(F.count_if(F.col("severity") == "error").alias("errors"), F.count_if(F.col("severity") == "warning").alias("warnings"))
    score = F.greatest(F.lit(0.0), 1.0 - ERROR_PENALTY * F.col("errors") - WARNING_PENALTY * F.col("warnings"))
    return counts.where("errors + warnings > 0").select("section", "errors", "warnings", F.round(score, 6).alias("score"))


def overall(scores: DataFrame) -> DataFrame:
    """(run, overall): the weighted sum of a run's scores; completeness blends sections, symbols and representation."""
    complete = reduce(lambda a, b: a + b, [F.col(k) * w for k, w in COMPLETENESS_BLEND.items()])
    parts = [WEIGHTS["completeness"] * complete, *(F.col(k) * w for k, w in WEIGHTS.items() if k != "completeness")]
    return scores.select("run", F.round(reduce(lambda a, b: a + b, parts), 6).alias("overall"))


def broken_references(docs: DataFrame, files: DataFrame) -> DataFrame:
    """(path, line, ref): references in backticks that hold a directory and are no file."""
    each = docs.select("path", F.posexplode(lines(F.col("body"))).alias("i", "text"))
    refs = each.select("path", (F.col("i") + 1).cast("long").alias("line"), F.explode(F.regexp_extract_all("text", F.lit("`([^`]+)`"), F.lit(1))).alias("ref")).where(F.contains("ref", F.lit("/")))
    return refs.join(files.select(F.col("path").alias("ref")).distinct(), "ref", "left_anti").select("path", "line", "ref")
