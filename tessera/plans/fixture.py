"""Rows that a query and its SQL share: literal ones, and as many of the same forms as the documents table has rows.

A fixture lists the forms that matter to a query. Where over() says so, each document adds a row of one of these forms (by
its id), with what the document brings put in: its id in paths and names, its text behind a body, its length in a size.
So queries over files, findings or answers run over as many rows as there are documents, and over their texts, null and
odd ones included, and their SQL does the same.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_SQL = {"string": "VARCHAR", "long": "BIGINT", "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "boolean": "BOOLEAN", "array<string>": "VARCHAR[]", "array<int>": "INTEGER[]", "array<double>": "DOUBLE[]", "timestamp": "TIMESTAMP"}


def _literal(value) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return str(value).lower()
    if isinstance(value, (list, tuple)):
        return "[" + ", ".join(map(_literal, value)) + "]"
    if isinstance(value, (int, float)):
        return repr(value)
    return "'" + str(value).replace("'", "''") + "'"


def _line(text):
    return F.substring_index(text, "\n", 1)


#: How a document goes into a column: a function of column, block (a string), text and id for Spark, and SQL of the same.
_WAYS = {
    "prefix": (lambda c, b, t, i: F.concat(F.lit("d"), b, F.lit("/"), c), "'d' || block || '/' || {c}"),
    "tag": (lambda c, b, t, i: F.concat(c, F.lit("-"), b), "{c} || '-' || block"),
    "number": (lambda c, b, t, i: F.concat(c, b), "{c} || block"),
    "after": (lambda c, b, t, i: F.concat(c, F.lit("\n"), t), "{c} || chr(10) || text"),
    "tail": (lambda c, b, t, i: F.concat(c, F.lit(" "), _line(t)), "{c} || ' ' || split_part(text, chr(10), 1)"),
    "word": (lambda c, b, t, i: F.regexp_extract(t, "[A-Za-z]+", 0), "regexp_extract(text, '[A-Za-z]+')"),
    "shift": (lambda c, b, t, i: c + (b.cast("int") + 1) * 1000, "({c} + (block::INT + 1) * 1000)"),
    "chars": (lambda c, b, t, i: c + F.length(t), "({c} + length(text))"),
    "odd": (lambda c, b, t, i: (c + F.length(t)) * 2 + 1, "(({c} + length(text)) * 2 + 1)"),
    "unit": (lambda c, b, t, i: (c + (i % 61) / 61.0) / 2, "(({c} + (id % 61) / 61.0::DOUBLE) / 2)"),
    "file": (lambda c, b, t, i: F.replace(c, F.lit('"file": "'), F.concat(F.lit('"file": "d'), b, F.lit("/"))), "replace({c}, '\"file\": \"', '\"file\": \"d' || block || '/')"),
}


class Fixture:
    """Rows with a Spark schema such as "path string, size long"."""

    def __init__(self, name: str, schema: str, rows: list[tuple]) -> None:
        self.name, self.schema, self.rows = name, schema, rows
        self.columns = [x.strip().split(" ", 1) for x in schema.split(", ")]
        self.ways: dict[str, str] = {}

    def over(self, **ways: str) -> Fixture:
        """Each document adds a row too; ``ways`` tells by column what it brings."""
        self.ways = ways
        return self

    def only(self, rows: list[tuple]) -> Fixture:
        """The same with some of the forms alone."""
        return Fixture(self.name, self.schema, rows).over(**self.ways)

    def df(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        own = spark.createDataFrame(self.rows, self.schema)
        if not self.ways:
            return own
        forms = spark.createDataFrame([(i, *r) for i, r in enumerate(self.rows)], f"form bigint, {self.schema}")
        docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet").select(F.abs(F.coalesce("doc_id", F.lit(0))).alias("__id"), F.coalesce("text", F.lit("")).alias("__text"))
        n = len(self.rows)
        docs = docs.select("__id", "__text", (F.col("__id") % n).alias("form"), F.floor(F.col("__id") / n).cast("string").alias("__block"))
        joined = docs.join(F.broadcast(forms), "form")  # a few literal rows
        put = {c: _WAYS[w][0](F.col(c), F.col("__block"), F.col("__text"), F.col("__id")) for c, w in self.ways.items()}
        types = dict(own.dtypes)
        return own.unionByName(joined.select(*(put.get(c, F.col(c)).cast(types[c]).alias(c) for c, _ in self.columns)))

    @property
    def sql(self) -> str:
        """A common table expression of the same rows."""
        rows = ", ".join("(" + ", ".join(map(_literal, (i, *r))) + ")" for i, r in enumerate(self.rows))
        names = [n for n, _ in self.columns]
        forms = f"(SELECT form, {', '.join(f'c{i}::{_SQL[t]} AS {n}' for i, (n, t) in enumerate(self.columns))} FROM (VALUES {rows}) AS v(form, {', '.join(f'c{i}' for i in range(len(names)))}))"
        if not self.ways:
            return f"{self.name} AS (SELECT {', '.join(names)} FROM {forms})"
        n = len(self.rows)
        docs = f"(SELECT abs(coalesce(doc_id, 0)) AS id, coalesce(text, '') AS text, abs(coalesce(doc_id, 0)) % {n} AS form, (abs(coalesce(doc_id, 0)) // {n})::VARCHAR AS block FROM documents)"
        put = ", ".join(f"({_WAYS[self.ways[c]][1].format(c='v.' + c) if c in self.ways else 'v.' + c})::{_SQL[t]} AS {c}" for c, t in self.columns)
        put = put.replace("(text", "(x.text").replace("|| text", "|| x.text").replace("block", "x.block").replace("(id ", "(x.id ")
        return f"{self.name} AS (SELECT {', '.join(names)} FROM {forms} UNION ALL SELECT {put} FROM {docs} x JOIN {forms} v ON x.form = v.form)"


def with_(*parts) -> str:
    """WITH of fixtures and common table expressions given as text."""
    return "WITH " + ", ".join(p.sql if isinstance(p, Fixture) else p for p in parts) + " "
