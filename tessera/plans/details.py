"""Queries of details: SQL objects, doc strings, manifests, prompts, model choice, loose JSON, round trips of sources."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import code as co
from tessera.functions import model as mo
from tessera.functions import paths as pa
from tessera.functions import text as tx
from tessera.operators import details as de
from tessera.plans.coding import ALL, EACH, NODES
from tessera.plans.fixture import Fixture, with_
from tessera.plans.search import OWN, Q2, lexical_parts, store, table
from tessera.session import scratch

QUERIES, ORACLE = {}, {}


def query(name, sql=None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return add


DDL = Fixture("files", "path string, body string", [("a.sql", "CREATE TABLE users (\n  id INT NOT NULL,\n  name VARCHAR(20),\n  CONSTRAINT pk PRIMARY KEY (id)\n);\nCREATE TABLE dbo.orders (\n  no BIGINT,\n  PRIMARY KEY (no)\n)\nGO\nCREATE PROCEDURE p @a INT, @b VARCHAR(10) = 'x'\nAS SELECT 1\nGO\nCREATE FUNCTION f(@x INT) RETURNS INT AS BEGIN RETURN 1 END\n")]).over(path="prefix", body="after")
COLS = r"""own AS (SELECT path, i, text, last_value(nullif(regexp_extract(text, '(?i)create\s+table\s+([A-Za-z0-9_.]+)', 1), '') IGNORE NULLS) OVER w AS tbl, sum((regexp_matches(text, '(?i)create\s+table') OR regexp_matches(text, '^\s*\)') OR regexp_matches(text, '(?i)^\s*go\s*$'))::INT) OVER w AS n, regexp_matches(text, '(?i)create\s+table') AS is_head FROM each WINDOW w AS (PARTITION BY path ORDER BY i)),
  heads AS (SELECT path, n FROM own WHERE is_head)"""


@query("sql_columns", with_(DDL, EACH, COLS) + r"SELECT o.path, tbl AS table_name, regexp_extract(text, '^\s*([A-Za-z_][A-Za-z0-9_]*)\s+([A-Za-z]+)', 1) AS column_name, upper(regexp_extract(text, '^\s*([A-Za-z_][A-Za-z0-9_]*)\s+([A-Za-z]+)', 2)) AS type FROM own o SEMI JOIN heads h ON o.path = h.path AND o.n = h.n WHERE NOT is_head AND NOT regexp_matches(text, '(?i)^\s*(constraint|primary|foreign|unique|check|index)\b') AND regexp_matches(text, '^\s*([A-Za-z_][A-Za-z0-9_]*)\s+([A-Za-z]+)')")
def sql_columns(spark, d):
    return de.sql_columns(DDL.df(spark, d))


@query("sql_parameters", with_(DDL) + r"SELECT path, unnest(regexp_extract_all(body, '@([A-Za-z_][A-Za-z0-9_]*)\s+[A-Za-z]+', 1)) AS name FROM files")
def sql_parameters(spark, d):
    return DDL.df(spark, d).select("path", F.explode(F.regexp_extract_all("body", F.lit(r"@([A-Za-z_][A-Za-z0-9_]*)\s+[A-Za-z]+"), F.lit(1))).alias("name"))


@query("sql_return_types", with_(DDL) + r"SELECT path, regexp_extract(body, '(?i)create\s+function\s+([A-Za-z0-9_.]+)', 1) AS name, upper(regexp_extract(body, '(?i)returns\s+([A-Za-z]+)', 1)) AS type FROM files")
def sql_return_types(spark, d):
    return DDL.df(spark, d).select("path", F.regexp_extract("body", r"(?i)create\s+function\s+([A-Za-z0-9_.]+)", 1).alias("name"), F.upper(F.regexp_extract("body", r"(?i)returns\s+([A-Za-z]+)", 1)).alias("type"))


@query("sql_object_counts", with_(DDL, EACH) + "SELECT kind, count(*)::BIGINT AS n FROM (" + " UNION ALL ".join(f"SELECT '{k}' AS kind FROM each WHERE regexp_matches(text, '{p}')" for k, p in co.SYMBOLS["sql"]) + ") GROUP BY kind")
def sql_object_counts(spark, d):
    return co.found(DDL.df(spark, d), co.SYMBOLS["sql"]).groupBy("kind").agg(F.count("*").alias("n"))


DATABASE = Fixture("dbfiles", "path string", [(p,) for p in ("db/tables/users.sql", "db/views/v.sql", "db/procs/p.sql", "db/App.sqlproj", "src/dao/UserDao.java", "src/models/user.py", "x/migrations/001.sql", "misc/readme.md")]).over(path="prefix")
_CATEGORIES = (("project", ".sqlproj"), ("migration", "migration"), ("table", "/tables/"), ("view", "/views/"), ("procedure", "/procs/"), ("access", "dao"), ("model", "/models/"))


@query("database_categories", with_(DATABASE) + "SELECT CASE " + " ".join(f"WHEN contains(lower(path), '{p}') THEN '{k}'" for k, p in _CATEGORIES) + " ELSE 'other' END AS category, count(*)::BIGINT AS files FROM dbfiles GROUP BY 1")
def database_categories(spark, d):
    return DATABASE.df(spark, d).groupBy(pa.first([(k, F.contains(F.lower("path"), F.lit(p))) for k, p in _CATEGORIES], "other").alias("category")).agg(F.count("*").alias("files"))


@query("docstrings", with_(ALL) + "SELECT path, trim(unnest(regexp_extract_all(body, '(?s)\"\"\"(.*?)\"\"\"', 1))) AS doc FROM files WHERE language = 'python'")
def docstrings(spark, d):
    return ALL.df(spark, d).where("language = 'python'").select("path", F.explode(F.regexp_extract_all("body", F.lit('(?s)"""(.*?)"""'), F.lit(1))).alias("doc")).select("path", F.trim("doc").alias("doc"))


JAVADOC = Fixture("jd", "path string, body string", [("A.java", "/**\n * Adds two numbers.\n * @return sum\n */\npublic int add(int a, int b) {}\n/** One line. */\nclass X {}\n")]).over(path="prefix", body="after")


@query("block_comments", with_(JAVADOC) + r"SELECT path, trim(regexp_replace(regexp_replace(unnest(regexp_extract_all(body, '(?s)/\*\*(.*?)\*/', 1)), '\n\s*\*', chr(10), 'g'), '\s+', ' ', 'g')) AS doc FROM jd")
def block_comments(spark, d):
    found = JAVADOC.df(spark, d).select("path", F.explode(F.regexp_extract_all("body", F.lit(r"(?s)/\*\*(.*?)\*/"), F.lit(1))).alias("doc"))
    return found.select("path", F.trim(F.regexp_replace(F.regexp_replace("doc", r"\n\s*\*", "\n"), r"\s+", " ")).alias("doc"))


MANIFESTS = Fixture("manifests", "path string, body string, pos long", [("Cargo.toml", '[package]\nname = "engine"\n', 0), ("package.json", '{"name": "web", "dependencies": {"react": "1"}}', 1), ("pyproject.toml", '[project]\nname = "tools"\n', 2), ("go.mod", "module example.org/x\n", 3)]).over(path="prefix", pos="shift")
NAME = "CASE WHEN ends_with(path, '.toml') THEN nullif(regexp_extract(body, '(?m)^name\\s*=\\s*\"([^\"]+)\"', 1), '') WHEN ends_with(path, '.json') THEN json_extract_string(body, '$.name') ELSE nullif(regexp_extract(body, '(?m)^module\\s+(\\S+)', 1), '') END"


@query("project_names", with_(MANIFESTS.only([r for r in MANIFESTS.rows if not r[0].endswith(".json")])) + "SELECT path, CASE WHEN ends_with(path, '.toml') THEN nullif(regexp_extract(body, '(?m)^name\\s*=\\s*\"([^\"]+)\"', 1), '') ELSE nullif(regexp_extract(body, '(?m)^module\\s+(\\S+)', 1), '') END AS name FROM manifests")
def project_names(spark, d):
    rows = MANIFESTS.only([r for r in MANIFESTS.rows if not r[0].endswith(".json")]).df(spark, d)
    return rows.select("path", de.project_name(F.col("path"), F.col("body")).alias("name"))


@query("project_name", with_(MANIFESTS) + "SELECT 'engine' AS name, count(*)::BIGINT AS manifests FROM manifests")
def project_name(spark, d):
    rows = MANIFESTS.df(spark, d).withColumn("name", de.project_name(F.col("path"), F.col("body")))
    return rows.agg(F.min_by("name", "pos").alias("name"), F.count("*").alias("manifests"))


@query("tech_stack", with_(MANIFESTS) + "SELECT CASE split_part(path, '/', -1) WHEN 'Cargo.toml' THEN 'rust' WHEN 'package.json' THEN 'node' WHEN 'pyproject.toml' THEN 'python' ELSE 'go' END AS ecosystem, path FROM manifests")
def tech_stack(spark, d):
    return MANIFESTS.df(spark, d).select(F.when(pa.name(F.col("path")) == "Cargo.toml", "rust").when(pa.name(F.col("path")) == "package.json", "node").when(pa.name(F.col("path")) == "pyproject.toml", "python").otherwise("go").alias("ecosystem"), "path")


@query("prompt_interfaces", with_(NODES) + "SELECT path, unnest(symbols) AS symbol FROM nodes ORDER BY path, symbol LIMIT 100")
def prompt_interfaces(spark, d):
    return NODES.df(spark, d).select("path", F.explode("symbols").alias("symbol")).orderBy("path", "symbol").limit(100)


@query("extracted_files", with_(ALL, EACH) + f"""SELECT f.path, {' + '.join(f"coalesce(len(list_filter(string_split(body, chr(10)), lambda x: regexp_matches(x, {chr(39)}{p}{chr(39)}))), 0)" for k, p in co.SYMBOLS['rust'] if k == 'function')} AS functions, len(string_split(regexp_replace(body, '\\n$', ''), chr(10)))::BIGINT AS total_lines, strlen(body)::BIGINT AS size_bytes FROM files f""")
def extracted_files(spark, d):
    pattern = next(p for k, p in co.SYMBOLS["rust"] if k == "function")
    b = F.col("body")
    return ALL.df(spark, d).select("path", F.size(F.filter(tx.lines(b), lambda x: F.rlike(x, F.lit(pattern)))).cast("long").alias("functions"), F.size(tx.lines(b)).cast("long").alias("total_lines"), F.octet_length(b).cast("long").alias("size_bytes"))


INSTALLED = Fixture("installed", "model string", [("llama3:8b",), ("qwen2.5:7b",), ("phi3:mini",)])
WANTED = Fixture("wanted", "want string", [("llama3:8b",), ("qwen2.5:14b",), ("phi3",), ("gone",)]).over(want="tag")


@query("matching_models", with_(INSTALLED, WANTED) + "SELECT want, coalesce(a.model, b.model) AS model FROM wanted LEFT JOIN installed a ON a.model = want LEFT JOIN installed b ON split_part(b.model, ':', 1) = split_part(want, ':', 1)")
def matching_models(spark, d):
    return de.matching_models(WANTED.df(spark, d), INSTALLED.df(spark, d))


AGENTS = Fixture("agents", "agent string, prefers string", [("a", "quality"), ("b", "fast"), ("c", None)]).over(agent="tag")


@query("model_for_agent", with_(AGENTS) + "SELECT agent, CASE WHEN prefers = 'quality' THEN 'powerful' ELSE 'efficient' END AS main_model, CASE WHEN prefers = 'quality' THEN 'efficient' ELSE 'powerful' END AS fallback_model FROM agents")
def model_for_agent(spark, d):
    good = F.coalesce(F.col("prefers") == "quality", F.lit(False))
    return AGENTS.df(spark, d).select("agent", F.when(good, "powerful").otherwise("efficient").alias("main_model"), F.when(good, "efficient").otherwise("powerful").alias("fallback_model"))


SIZES = Fixture("model_sizes", "model string, bytes long", [("a", 4 * 2**30), ("b", 1), ("c", None)]).over(model="tag", bytes="chars")


@query("model_sizes", with_(SIZES, INSTALLED) + "SELECT model, round(bytes / 1073741824.0::DOUBLE, 9) AS gib, (ceil(coalesce(bytes, 0) / 4096.0::DOUBLE) * 4096)::BIGINT AS rounded FROM model_sizes")
def model_sizes(spark, d):
    return SIZES.df(spark, d).select("model", F.round(F.col("bytes") / float(1 << 30), 9).alias("gib"), mo.rounded_up(F.coalesce("bytes", F.lit(0)), 4096).alias("rounded"))


LOOSE = Fixture("loose", "k int, j string", [(1, '["a", "b"]'), (2, '"one"'), (3, '{"x": 1}'), (4, "null"), (5, "7")]).over(k="shift")


@query("loose_json", with_(LOOSE) + "SELECT k, CASE WHEN starts_with(j, '[') THEN 'list' WHEN starts_with(j, '\"') THEN 'text' WHEN starts_with(j, '{') THEN 'object' WHEN j = 'null' THEN 'nothing' ELSE 'number' END AS kind, CASE WHEN starts_with(j, '\"') THEN trim(j, '\"') ELSE j END AS as_text FROM loose")
def loose_json(spark, d):
    v = F.try_parse_json("j")
    kind = F.schema_of_variant(v)
    label = F.when(F.startswith(kind, F.lit("ARRAY")), "list").when(kind == "STRING", "text").when(F.startswith(kind, F.lit("OBJECT")), "object").when(kind == "VOID", "nothing").otherwise("number")
    return LOOSE.df(spark, d).select("k", label.alias("kind"), F.when(kind == "STRING", F.variant_get(v, "$", "string")).otherwise(F.col("j")).alias("as_text"))


TEMPLATES = Fixture("templates", "t string", [("on {date}",), ("at {date} {time}",), ("plain",)]).over(t="tail")


@query("fill_templates", with_(TEMPLATES) + "SELECT t, replace(replace(t, '{date}', '2024-05-17'), '{time}', '10:00:00') AS filled FROM templates")
def fill_templates(spark, d):
    return TEMPLATES.df(spark, d).select("t", F.replace(F.replace("t", F.lit("{date}"), F.lit("2024-05-17")), F.lit("{time}"), F.lit("10:00:00")).alias("filled"))


@query("overlap_tails", "SELECT doc_id, right(text, 200) AS tail FROM documents")
def overlap_tails(spark, d):
    return table(spark, d, "documents").select("doc_id", F.right("text", F.lit(200)).alias("tail"))


@query("source_json_roundtrip", "SELECT doc_id, md5(text) AS digest, source FROM documents")
def source_json_roundtrip(spark, d):
    """Documents written as JSON by source and read back with a schema."""
    path = scratch(spark, "json")
    table(spark, d, "documents").select("doc_id", "text", "source").write.partitionBy("source").json(path)
    back = spark.read.schema("doc_id bigint, text string, source string").json(path)
    return back.select("doc_id", F.md5("text").alias("digest"), "source")


@query("source_orc_roundtrip", "SELECT conv_id, count(*)::BIGINT AS turns FROM conversations GROUP BY conv_id")
def source_orc_roundtrip(spark, d):
    path = scratch(spark, "orc")
    table(spark, d, "conversations").write.orc(path)
    return spark.read.orc(path).groupBy("conv_id").agg(F.count("*").alias("turns"))


@query("source_text_lines", "SELECT count(*)::BIGINT AS n_lines, sum(strlen(l))::BIGINT AS bytes FROM (SELECT unnest(string_split(replace(text, chr(13), ''), chr(10))) AS l FROM documents)")
def source_text_lines(spark, d):
    """Bodies written as text and read back line by line."""
    path = scratch(spark, "text")
    table(spark, d, "documents").where("text IS NOT NULL").select("text").write.text(path)
    read = spark.read.text(path, lineSep="\n").select(F.replace("value", F.lit("\r"), F.lit("")).alias("value"))
    return read.agg(F.count("*").alias("n_lines"), F.sum(F.octet_length("value")).alias("bytes"))


@query("scan_tables")
def scan_tables(spark, d):
    """Files of the given tables with their sizes."""
    from tessera.sources import files as fs

    return fs.scan(spark, d, "**/*.parquet").select("path", "size")


@query("viewer_rows", with_(OWN, lexical_parts(Q2)) + "SELECT split_part(b.file, '/', -1) AS name, b.file, round(b.score * 100, 2) AS percent FROM best b WHERE r = 1 ORDER BY score DESC, file, id LIMIT 10")
def viewer_rows(spark, d):
    from tessera.operators import search as se

    return se.lexical(store(spark, d), Q2).select(F.substring_index("file", "/", -1).alias("name"), "file", F.round(F.col("score") * 100, 2).alias("percent"))


CUTS = Fixture("prefixes", "p string, r string", [("/a/b", "/a"), ("/ab", "/a"), ("/a", "/a"), ("/a", "/a/b")]).over(p="prefix", r="prefix")


@query("path_prefixes", with_(CUTS) + "SELECT p, r, p = r OR starts_with(p, r || '/') AS holds, p = r OR starts_with(p, r || '/') OR starts_with(r, p || '/') AS covers FROM prefixes")
def path_prefixes(spark, d):
    holds = (F.col("p") == F.col("r")) | F.startswith("p", F.concat(F.col("r"), F.lit("/")))
    return CUTS.df(spark, d).select("p", "r", holds.alias("holds"), (holds | F.startswith("r", F.concat(F.col("p"), F.lit("/")))).alias("covers"))
