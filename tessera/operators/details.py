"""Smaller operators over source text, manifests and model lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import sections


def sql_columns(files: DataFrame) -> DataFrame:
    """(path, table_name, column_name, type): lines between a table's head and its end, without constraints."""
    head, end = r"(?i)create\s+table", (r"^\s*\)", r"(?i)^\s*go\s*$")
    named, column = r"(?i)create\s+table\s+([A-Za-z0-9_.]+)", r"^\s*([A-Za-z_][A-Za-z0-9_]*)\s+([A-Za-z]+)"
    marks = lambda x: F.rlike(x, F.lit(head)) | F.rlike(x, F.lit(end[0])) | F.rlike(x, F.lit(end[1]))
    parts = files.select("path", sections(F.col("body"), marks).alias("all"))
    # a head without a name goes by the last name before it
    names = F.filter(F.transform("all", lambda s: F.struct(s["at"].alias("at"), F.regexp_extract(s["head"], named, 1).alias("name"))), lambda n: n["name"] != "")
    own = lambda s: F.get(F.filter("names", lambda n: n["at"] <= s["at"]), F.size(F.filter("names", lambda n: n["at"] <= s["at"])) - 1)["name"]
    tables = parts.withColumn("names", names).select("path", F.explode(F.transform(F.filter("all", lambda s: F.rlike(s["head"], F.lit(head))), lambda s: F.struct(own(s).alias("table_name"), s["below"].alias("below")))).alias("t"))
    rows = tables.select("path", "t.table_name", F.explode("t.below").alias("text"))
    rows = rows.where(~F.rlike("text", F.lit(r"(?i)^\s*(constraint|primary|foreign|unique|check|index)\b")) & F.rlike("text", F.lit(column)))
    return rows.select("path", "table_name", F.regexp_extract("text", column, 1).alias("column_name"), F.upper(F.regexp_extract("text", column, 2)).alias("type"))


def project_name(path: Column, body: Column) -> Column:
    """The name a manifest gives its project."""
    toml = F.nullif(F.regexp_extract(body, r'(?m)^name\s*=\s*"([^"]+)"', 1), F.lit(""))
    module = F.nullif(F.regexp_extract(body, r"(?m)^module\s+(\S+)", 1), F.lit(""))
    return F.when(F.endswith(path, F.lit(".toml")), toml).when(F.endswith(path, F.lit(".json")), F.get_json_object(body, "$.name")).otherwise(module)


def matching_models(wanted: DataFrame, installed: DataFrame) -> DataFrame:
    """(want, model): the installed model of that name, else one with the same name before the colon."""
    exact = installed.select(F.col("model").alias("want"), F.col("model").alias("a"))
    by_base = installed.groupBy(F.substring_index("model", ":", 1).alias("base")).agg(F.min("model").alias("b"))
    joined = wanted.join(exact, "want", "left").withColumn("base", F.substring_index("want", ":", 1)).join(by_base, "base", "left")
    return joined.select("want", F.coalesce("a", "b").alias("model"))
