"""Queries over lines and chunks: search in lines, highlighting, chunking, Markdown repairs, token estimates, memory."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import model as mo
from tessera.functions import text as tx
from tessera.operators import textual as te
from tessera.plans.fixture import Fixture, with_
from tessera.plans.search import STORE, lines_sql, store, table

QUERIES, ORACLE = {}, {}


def query(name, sql=None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return add


DOCLINES = f"d AS (SELECT lang || '/' || doc_id::VARCHAR || '.md' AS path, {lines_sql('text')} AS l FROM documents), each AS (SELECT path, l, unnest(range(1, len(l) + 1)) AS i FROM d), ln AS (SELECT path, l, i, l[i] AS content FROM each)"
HIT = "hit AS (SELECT path, i::BIGINT AS line_no, content, CASE WHEN i > 1 THEN l[i - 1] END AS before, l[i + 1] AS after, (CASE WHEN starts_with(trim(content), '#') THEN 3.0 ELSE 1.0 END * CASE WHEN list_contains(string_split_regex(lower(content), '\\s+'), 'eau') THEN 2.0 ELSE 1.0 END * CASE WHEN starts_with(ltrim(lower(content)), 'eau') THEN 1.5 ELSE 1.0 END)::DOUBLE AS line_score FROM ln WHERE contains(lower(content), 'eau'))"


def doc_files(spark, d):
    t = table(spark, d, "documents")
    return t.select(F.concat("lang", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".md")).alias("path"), F.col("text").alias("body"))


@query("line_search", with_(DOCLINES, HIT) + "SELECT path, line_no, content, before, after, line_score FROM hit")
def line_search(spark, d):
    return te.line_search(doc_files(spark, d), "eau").drop("highlighted")


@query("file_search", with_(DOCLINES, HIT) + "SELECT path, count(*)::BIGINT AS matches, sum(line_score) + CASE WHEN contains(lower(split_part(path, '/', -1)), 'eau') THEN 2.0 ELSE 0.0 END AS relevance FROM hit GROUP BY path ORDER BY relevance DESC, path LIMIT 50")
def file_search(spark, d):
    return te.file_search(doc_files(spark, d), "eau")


MARKS = Fixture("marks", "k int, content string", [(1, "a <b> Eau & eau"), (2, "nothing"), (3, "EAUeau"), (4, "x&y <eau>")]).over(k="shift", content="tail")


@query("highlight", with_(MARKS) + "SELECT k, regexp_replace(replace(replace(replace(content, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '(eau)', '<mark>\\1</mark>', 'gi') AS marked FROM marks")
def highlight(spark, d):
    return MARKS.df(spark, d).select("k", tx.highlight(F.col("content"), "eau").alias("marked"))


@query("escape_html", "SELECT page_id, md5(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')) AS escaped FROM pages")
def escape_html(spark, d):
    return table(spark, d, "pages").select("page_id", F.md5(tx.escape_html(F.col("html"))).alias("escaped"))


@query("chunk_fixed", "SELECT doc_id AS id, s // 800 AS chunk_index, n AS total_chunks, substr(text, s::BIGINT + 1, 1000) AS content FROM (SELECT doc_id, text, len(r)::BIGINT AS n, unnest(r) AS s FROM (SELECT doc_id, text, CASE WHEN text <> '' THEN range(0, greatest(1, length(text) - 200), 800) ELSE [] END AS r FROM documents))")
def chunk_fixed(spark, d):
    t = table(spark, d, "documents")
    return te.chunk_fixed(t.select(F.col("doc_id").alias("id"), F.col("text").alias("body")), 1000, 200)


@query("needs_chunking", "SELECT doc_id, strlen(text) >= 10000 AS chunked FROM documents")
def needs_chunking(spark, d):
    return table(spark, d, "documents").select("doc_id", (F.octet_length("text") >= 10000).alias("chunked"))


MD = Fixture("md", "id int, body string", [(1, "# A\ntext one\n## B\nmore text here\n### C\ndeep\n# D\nlast\n"), (2, ""), (3, "no heading\n" * 12), (4, "# É\n" + "é" * 60 + "\n## Z\nz\n")]).over(id="shift", body="after")
SQLTEXT = Fixture("sqltext", "id int, body string", [(1, "CREATE TABLE a (\n x INT\n);\nINSERT INTO a VALUES (1);\ncreate view v as select 1;\nDROP TABLE b;\n")]).over(id="shift", body="after")


@query("chunk_markdown")
def chunk_markdown(spark, d):
    return te.chunked(MD.df(spark, d), "markdown", 24, 8)


@query("chunk_sql")
def chunk_sql(spark, d):
    return te.chunked(SQLTEXT.df(spark, d), "sql", 20, 0)


@query("chunk_paragraph")
def chunk_paragraph(spark, d):
    rows = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.replace("text", F.lit("\n"), F.lit("\n\n")).alias("body"))
    return te.chunked(rows, "paragraph", 1000, 100)


FIX = Fixture("fx", "path string, body string", [("a.md", "# One\n[x]()\n# Two\n##\n## ok\n# Three\n```mermaid\n| a |\n"), ("b.md", "text\n# First\n[a](b) [c]( )\n")]).over(path="prefix", body="after")
FIXLINES = f"each AS (SELECT path, i, l[i] AS text FROM (SELECT path, l, unnest(range(1, len(l) + 1)) AS i FROM (SELECT path, {lines_sql('body')} AS l FROM fx)))"


@query("fix_markdown", with_(FIX, FIXLINES, "h AS (SELECT path, i, text, sum(starts_with(text, '# ')::INT) OVER (PARTITION BY path ORDER BY i) AS n FROM each)") + "SELECT path, i::BIGINT AS line, regexp_replace(CASE WHEN starts_with(text, '# ') AND n > 1 THEN '#' || text ELSE text END, '\\]\\(\\s*\\)', '](#)', 'g') AS text FROM h WHERE NOT regexp_matches(text, '^#{1,6}\\s*$')")
def fix_markdown(spark, d):
    return te.fixed_markdown(FIX.df(spark, d))


@query("audit_markdown", with_(FIX) + "SELECT path, len(regexp_extract_all(body, '```mermaid'))::BIGINT AS diagrams, len(regexp_extract_all(chr(10) || body, '\\n\\|'))::BIGINT AS table_lines FROM fx")
def audit_markdown(spark, d):
    return FIX.df(spark, d).select("path", F.regexp_count("body", F.lit("```mermaid")).cast("long").alias("diagrams"), F.regexp_count(F.concat(F.lit("\n"), F.col("body")), F.lit("\n\\|")).cast("long").alias("table_lines"))


FENCED = Fixture("fx", "path string, body string", [("r.md", "a\n```rust\ncode\n```\n\nb\n```\nx\n"), ("s.md", "one\n\ntwo\n")]).over(path="prefix", body="after")


@query("trim_markdown", with_(FENCED, FIXLINES, "h AS (SELECT path, i, text, starts_with(trim(text), '```') AS fence, sum(starts_with(trim(text), '```')::INT) OVER (PARTITION BY path ORDER BY i) AS n FROM each WHERE i <= 500)") + "SELECT path, i::BIGINT AS line, text FROM h WHERE NOT fence AND n % 2 = 0 AND trim(text) <> ''")
def trim_markdown(spark, d):
    return te.trimmed_markdown(FENCED.df(spark, d))


LONG = Fixture("fx", "path string, body string", [("a.rs", "\n".join(("pub fn f%d() {" % i) if i % 4 == 0 else "    let x%d = %d;" % (i, i * i) for i in range(30))), ("b.rs", "x\npub fn g()\ny")]).over(path="prefix", body="after")


@query("truncate_source", with_(LONG, FIXLINES, "h AS (SELECT *, starts_with(text, 'pub fn') AS imp, sum(length(text) + 1) OVER (PARTITION BY path, starts_with(text, 'pub fn') ORDER BY i) AS s FROM each)", "k AS (SELECT path, max(s) AS used FROM h WHERE imp AND s <= 220 GROUP BY path)") + "SELECT h.path, i::BIGINT AS line, text FROM h LEFT JOIN k ON h.path = k.path WHERE (imp AND s <= 220) OR (NOT imp AND s + coalesce(used, 0) <= 220)")
def truncate_source(spark, d):
    return te.truncated(LONG.df(spark, d), 220, lambda x: F.startswith(x, F.lit("pub fn")))


CJKS = "[\\x{3400}-\\x{4DBF}\\x{4E00}-\\x{9FFF}\\x{20000}-\\x{2A6DF}\\x{2A700}-\\x{2EBEF}\\x{30000}-\\x{3134F}]"


def estimate_sql(x: str) -> str:
    cjk = f"(length({x}) - length(regexp_replace({x}, '{CJKS}', '', 'g')))"
    plain = f"(length({x}) - length(regexp_replace({x}, '[\\x00-\\x7F]', '', 'g')))"
    return f"(ceil({cjk} / 1.5) + ceil({plain} / 4.0) + ceil((length({x}) - {cjk} - {plain}) / 4.0) + 50)::BIGINT"


@query("estimate_tokens", f"SELECT conv_id, turn, {estimate_sql('text')} AS tokens FROM conversations")
def estimate_tokens(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", tx.estimated_tokens(F.col("text")).alias("tokens"))


@query("token_cost", f"WITH t AS (SELECT conv_id, role, {estimate_sql('text')} AS n FROM conversations), g AS (SELECT conv_id, sum(CASE WHEN role = 'user' THEN n ELSE 0 END) AS i, sum(CASE WHEN role = 'assistant' THEN n ELSE 0 END) AS o FROM t GROUP BY conv_id) SELECT conv_id, i::BIGINT AS tokens_in, o::BIGINT AS tokens_out, round(i / 1000.0 * 0.00025::DOUBLE + o / 1000.0 * 0.002::DOUBLE, 9) AS cost FROM g")
def token_cost(spark, d):
    t = table(spark, d, "conversations").select("conv_id", "role", tx.estimated_tokens(F.col("text")).alias("n"))
    by = t.groupBy("conv_id").agg(*[F.sum(F.when(F.col("role") == r, F.col("n")).otherwise(0)).alias(k) for k, r in (("tokens_in", "user"), ("tokens_out", "assistant"))])
    return by.withColumn("cost", F.round(mo.cost(F.col("tokens_in"), F.col("tokens_out")), 9))


MIXED = Fixture("mixed", "k int, t string", [(1, ""), (2, "hello"), (3, "你好，世界"), (4, "naïve café")]).over(k="shift", t="after")


@query("estimate_tokens_mixed", with_(MIXED) + f"SELECT k, {estimate_sql('t')} AS tokens FROM mixed")
def estimate_tokens_mixed(spark, d):
    return MIXED.df(spark, d).select("k", tx.estimated_tokens(F.col("t")).alias("tokens"))


@query("inference_time", "SELECT doc_id, round(2.0::DOUBLE + least(strlen(text) / 1000.0::DOUBLE, 10.0::DOUBLE), 6) AS seconds FROM documents")
def inference_time(spark, d):
    return table(spark, d, "documents").select("doc_id", F.round(mo.seconds(F.octet_length("text")), 6).alias("seconds"))


@query("emergency_cut", "WITH c AS (SELECT doc_id, text, floor(strlen(text) * 0.4::DOUBLE)::BIGINT AS keep FROM documents), h AS (SELECT *, substr(text, 1, keep) AS head FROM c), e AS (SELECT *, CASE WHEN contains(head, chr(10)) THEN length(head) - length(string_split(head, chr(10))[-1]) - 1 ELSE -1 END AS place FROM h) SELECT doc_id, CASE WHEN strlen(text) <= keep + 100 THEN text ELSE CASE WHEN place > 100 THEN substr(head, 1, place) ELSE head END || chr(10) || chr(10) || '[Content truncated due to size limitations]' END AS cut FROM e")
def emergency_cut(spark, d):
    return table(spark, d, "documents").select("doc_id", tx.emergency_cut(F.col("text"), F.lit(0.4)).alias("cut"))


@query("memory_usage", "SELECT conv_id::VARCHAR AS scope, count(*)::BIGINT AS entries, sum(strlen(text))::BIGINT AS bytes FROM conversations GROUP BY conv_id")
def memory_usage(spark, d):
    return table(spark, d, "conversations").groupBy(F.col("conv_id").cast("string").alias("scope")).agg(F.count("*").alias("entries"), F.sum(F.octet_length("text")).alias("bytes"))


@query("memory_digest", "SELECT conv_id, coalesce(string_agg(turn::VARCHAR || ': ' || substr(text, 1, 200), chr(10) ORDER BY turn), '') AS digest FROM conversations GROUP BY conv_id")
def memory_digest(spark, d):
    t = table(spark, d, "conversations").select("conv_id", "turn", F.concat(F.col("turn").cast("string"), F.lit(": "), F.substring("text", 1, 200)).alias("line"))
    return t.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "line"))), lambda x: x["line"]), "\n").alias("digest"))


@query("memory_keys", "SELECT conv_id, count(*)::BIGINT AS keys FROM conversations WHERE starts_with(role, 'user') GROUP BY conv_id")
def memory_keys(spark, d):
    return table(spark, d, "conversations").where(F.startswith("role", F.lit("user"))).groupBy("conv_id").agg(F.count("*").alias("keys"))


VISIBLE = Fixture("docs_", "name string, targets array<string>", [("a", []), ("b", ["Overview"]), ("c", ["Workflow", "Overview"]), ("d", ["Boundary"])]).over(name="tag")


@query("visible_documents", with_(VISIBLE) + "SELECT name FROM docs_ WHERE len(targets) = 0 OR list_contains(targets, 'Overview')")
def visible_documents(spark, d):
    return VISIBLE.df(spark, d).where((F.size("targets") == 0) | F.array_contains("targets", "Overview")).select("name")


@query("format_for_prompt", with_(STORE, "parts AS (SELECT collection, id, '## ' || title || chr(10) || body AS part FROM st)") + "SELECT collection, id, row_number() OVER w AS place, coalesce(sum(length(part) + 1) OVER (PARTITION BY collection ORDER BY id, part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start, part FROM parts WINDOW w AS (PARTITION BY collection ORDER BY id, part)")
def format_for_prompt(spark, d):
    """A collection's prompt, its parts by id with a line end between, as whole parts with their places and where they start."""
    return te.placed(store(spark, d).select("collection", "id", F.concat(F.lit("## "), F.col("title"), F.lit("\n"), F.col("body")).alias("part")))


@query("markdown_pages")
def markdown_pages(spark, d):
    """Pages of all documents; a Markdown grammar is beyond SQL, tests hold it against pages written by hand."""
    from tessera.operators import html

    return html.rendered(store(spark, d).select("path", "title", "body"))


@query("prompt_parts")
def prompt_parts(spark, d):
    return te.prompt_parts(store(spark, d).select("id", "collection", "path", "body"))


@query("prompt_snippets", with_(STORE) + "SELECT id, substr(trim(regexp_replace(body, '\\s+', ' ', 'g')), 1, 220) AS snippet FROM st ORDER BY id LIMIT 8")
def prompt_snippets(spark, d):
    return store(spark, d).orderBy("id").limit(8).select("id", F.substring(F.trim(F.regexp_replace("body", r"\s+", " ")), 1, 220).alias("snippet"))


@query("supplementary_docs", with_(STORE) + f"SELECT id, array_to_string({lines_sql('body')}, chr(10)) AS body, strlen(body)::BIGINT AS bytes FROM st")
def supplementary_docs(spark, d):
    return store(spark, d).select("id", tx.slice_lines(F.col("body")).alias("body"), F.octet_length("body").cast("long").alias("bytes"))


PROJECT_DOCS = Fixture("fx", "project string, path string, body string", [("a", "docs/README.md", "# Guide\n\n" + "line é\n" * 700), ("a", "CLAUDE.md", "rules\n```\ncode\n```\n\nmore\n"), ("a", "README.md", "not a candidate"), ("b", "CONTRIBUTING.md", "x" * 4001), ("c", "CLAUDE.md", "\n \n")]).over(project="tag", body="after")


@query("supplementary_context")
def supplementary_context(spark, d):
    return te.supplementary(PROJECT_DOCS.df(spark, d))
