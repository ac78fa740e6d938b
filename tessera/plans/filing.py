"""Queries over paths: languages, classes, purposes, importance, filters, directory figures."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import paths as pa
from tessera.functions import text as tx
from tessera.operators import files as fi
from tessera.plans.fixture import Fixture, with_
from tessera.plans.search import table

QUERIES, ORACLE = {}, {}


def query(name, sql=None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return add


_PATHS = """src/main.rs src/lib.rs src/core/engine.rs src/utils/text.py tests/test_app.py app/pages/home.tsx app/components/button.jsx config/settings.yaml docs/guide.md README.md
build.rs Makefile Cargo.toml src/api/users.go src/db/schema.sql db/Proj.sqlproj src/models/user.java lib/index.js web/style.css web/logo.png pkg/foo_test.go spec/a.rb src/App.cs tools/run.py
.hidden/x.rs target/debug/a.o node_modules/x/index.js src/context/ctx.ts src/middleware/auth.ts src/router/routes.ts plugin/p.py x/plugin/p.py a/repository/user.kt cmd/cli.go notes
src/FooTest.java src/foo-test.js e2e/login.spec.ts src/persistence/save.py src/view.vue src/data.json.gz src/screen.swift a/b/c/d/e.c a/b/mod.rs a/commands.php fixtures/big.dat"""
FILES = Fixture("files", "path string, size long", [(p, (i * 7919) % 200_000) for i, p in enumerate(_PATHS.split())]).over(path="prefix", size="chars")


def files(spark, d):
    return FILES.df(spark, d)


BASE = "f AS (SELECT path, size, lower(path) AS low, split_part(path, '/', -1) AS name, lower(split_part(path, '/', -1)) AS own, coalesce(nullif(regexp_extract(split_part(path, '/', -1), '^.+\\.([^.]*)$', 1), ''), '') AS ext, regexp_replace(split_part(path, '/', -1), '^(.+)\\.[^.]*$', '\\1') AS stem FROM files)"


def q(x) -> str:
    return "'" + x.replace("'", "''") + "'"


def any_sql(tests) -> str:
    return "(" + " OR ".join(tests) + ")"


def contains_sql(text, parts) -> str:
    return any_sql(f"contains({text}, {q(p)})" for p in parts)


def isin(text, values) -> str:
    return f"{text} IN ({', '.join(map(q, values))})"


def case(cases, other="NULL") -> str:
    return "CASE " + " ".join(f"WHEN {t} THEN {q(k)}" for k, t in cases) + f" ELSE {other} END"


LANGUAGE = case([(k, isin("ext", e)) for k, e in pa.LANGUAGES.items()], "'unknown'")


@query("detect_language", with_(FILES, BASE) + f"SELECT path, {LANGUAGE} AS language FROM f")
def detect_language(spark, d):
    return files(spark, d).select("path", pa.language(F.col("path")).alias("language"))


@query("language_counts", with_(FILES, BASE) + f"SELECT {LANGUAGE} AS language, count(*)::BIGINT AS files, sum(size)::BIGINT AS bytes FROM f GROUP BY 1")
def language_counts(spark, d):
    return fi.language_counts(files(spark, d))


@query("document_counts", "SELECT lang, source, count(*)::BIGINT AS docs, sum(n_chars)::BIGINT AS chars FROM documents GROUP BY lang, source")
def document_counts(spark, d):
    return table(spark, d, "documents").groupBy("lang", "source").agg(F.count("*").alias("docs"), F.sum("n_chars").alias("chars"))


_OPS = {"is": "{0} = {1}", "ends": "ends_with({0}, {1})", "starts": "starts_with({0}, {1})", "contains": "contains({0}, {1})"}
_PARTS = {"stem": "lower(stem)", "ext": "lower(ext)", "path": "low"}
CLASS = case([(k, any_sql(_OPS[op].format(_PARTS[part], q(v)) for part, op, v in tests)) for k, tests in pa.CLASSES], "'unknown'")


@query("classify_files", with_(FILES, BASE) + f"SELECT path, {CLASS} AS class FROM f")
def classify_files(spark, d):
    return files(spark, d).select("path", pa.file_class(F.col("path")).alias("class"))


PURPOSE = case([("database", "(ends_with(own, '.sql') OR ends_with(own, '.sqlproj'))"), *((k, contains_sql("low", p)) for k, p in pa.PURPOSE_BY_PATH), *((k, contains_sql("own", p)) for k, p in pa.PURPOSE_BY_NAME)], "'other'")


@query("code_purpose", with_(FILES, BASE) + f"SELECT path, {PURPOSE} AS purpose FROM f")
def code_purpose(spark, d):
    return files(spark, d).select("path", pa.purpose(F.col("path")).alias("purpose"))


LABELS = Fixture("labels_", "label string", [(x,) for x in "Project_Execution-Entry|intelligent agent|UI Page|frontend component|Data Model|tool|Utility|Config file|HTTP API|service|third party|unit test|DAO|CLI handler|whatever|  |Router|Logical functionality|data–access–layer|Types".split("|")]).over(label="tail")
LABEL = case([("entry", "contains(regexp_replace(x, '\\s', '', 'g'), 'entry')"), *((k, any_sql("(" + " AND ".join(f"contains(x, {q(w)})" for w in words) + ")" for words in alts)) for k, alts in pa.PURPOSE_BY_LABEL)], "'other'")


@query("purpose_from_label", with_(LABELS, "x AS (SELECT label, regexp_replace(lower(trim(label)), '[–—_-]', ' ', 'g') AS x FROM labels_)") + f"SELECT label, {LABEL} AS purpose FROM x")
def purpose_from_label(spark, d):
    return LABELS.df(spark, d).select("label", pa.purpose_from_label(F.col("label")).alias("purpose"))


def when_sum(parts) -> str:
    return " + ".join(f"CASE WHEN {t} THEN {v}::DOUBLE ELSE 0 END" for t, v in parts)


IMPORTANCE = "round(" + when_sum([*((contains_sql("low", p), v) for p, v in (*pa.IMPORTANT_PLACES, *pa.IMPORTANT_EXTRA)), ("size > 1024 AND size < 51200", 0.2), *((isin("ext", e), v) for e, v in pa.IMPORTANT_TYPES)]) + ", 6)"


@query("importance", with_(FILES, BASE) + f"SELECT path, least({IMPORTANCE}, 1.0::DOUBLE) AS importance, {IMPORTANCE} >= 0.5 AS is_core FROM f")
def importance(spark, d):
    score = pa.importance(F.col("path"), F.col("size"))
    return files(spark, d).select("path", F.least(score, F.lit(1.0)).alias("importance"), (score >= 0.5).alias("is_core"))


@query("core_files", with_(FILES, BASE) + f"SELECT path, {IMPORTANCE} AS score FROM f WHERE {IMPORTANCE} >= 0.5")
def core_files(spark, d):
    return fi.core_files(files(spark, d))


TEST = "(" + " OR ".join([*(f"contains(low, '/{t}/') OR starts_with(low, '{t}/')" for t in pa.TEST_DIRS), "starts_with(own, 'test_')", *(f"ends_with(own, '{e}')" for e in pa.TEST_ENDINGS)]) + f" OR (contains(own, 'test') AND (starts_with(own, 'test') OR ends_with(own, 'test') OR {contains_sql('own', pa.TEST_INSIDE)})))"


@query("test_file_filter", with_(FILES, BASE) + f"SELECT path, {TEST} AS is_test, {isin('lower(ext)', pa.BINARY)} AS is_binary FROM f")
def test_file_filter(spark, d):
    return files(spark, d).select("path", pa.is_test_file(F.col("path")).alias("is_test"), pa.is_binary(F.col("path")).alias("is_binary"))


DIRS = Fixture("dirs", "dir string", [(x,) for x in "tests Testing my_test fixtures src unit attest a-tests .git e2e core".split()]).over(dir="tag")
TESTDIR = "(" + isin("lower({0})", pa.TEST_DIRECTORY_NAMES) + " OR " + " OR ".join(f"ends_with(lower({{0}}), '{e}')" for e in pa.TEST_DIRECTORY_ENDINGS) + ")"


@query("test_directories", with_(DIRS) + f"SELECT dir, {TESTDIR.format('dir')} AS is_test FROM dirs")
def test_directories(spark, d):
    return DIRS.df(spark, d).select("dir", pa.is_test_directory(F.col("dir")).alias("is_test"))


EXCLUDED = ["target", "node_modules", "src/core"]
IGNORED = f"(len(list_filter(string_split(dir, '/'), lambda p: {isin('p', ['target', 'node_modules'])} OR {TESTDIR.format('p')} OR starts_with(p, '.'))) > 0 OR dir = 'src/core' OR starts_with(dir, 'src/core/'))"


@query("ignore_filter", with_(FILES, BASE, "g AS (SELECT *, lower(regexp_replace(path, '/?[^/]*$', '')) AS dir FROM f)") + f"SELECT path, {IGNORED} AS dir_ignored, (contains(own, '.d') OR own = 'makefile' OR lower(ext) IN ('css', 'lock') OR {TEST} OR starts_with(own, '.') OR size > 150000 OR {isin('lower(ext)', pa.BINARY)}) AS file_ignored FROM g")
def ignore_filter(spark, d):
    return files(spark, d).select("path", pa.ignored_directory(pa.parent(F.col("path")), EXCLUDED).alias("dir_ignored"), pa.ignored_file(F.col("path"), F.col("size"), ["*.d*", "Makefile"], ["css", "lock"], 150_000).alias("file_ignored"))


@query("discover_files", with_(FILES, BASE) + f"SELECT path, size FROM f WHERE size > 0 AND size <= 150000 AND NOT ({TEST} OR starts_with(own, '.') OR {isin('lower(ext)', pa.BINARY)})")
def discover_files(spark, d):
    return files(spark, d).where((F.col("size") > 0) & ~pa.ignored_file(F.col("path"), F.col("size"), [], [], 150_000))


SIZE = case([(k, f"size <= {m}") for k, m in pa.SIZES], "'huge'")


@query("size_histogram", with_(FILES, BASE) + f"SELECT {SIZE} AS size_class, ext, count(*)::BIGINT AS files FROM f GROUP BY 1, 2")
def size_histogram(spark, d):
    return files(spark, d).groupBy(pa.size_class(F.col("size")).alias("size_class"), F.coalesce(pa.extension(F.col("path")), F.lit("")).alias("ext")).agg(F.count("*").alias("files"))


DIRSTATS = """g AS (SELECT path, size, regexp_replace(path, '/?[^/]*$', '') AS dir FROM files), up AS (SELECT DISTINCT array_to_string(list_slice(string_split(dir, '/'), 1, n), '/') AS dir FROM (SELECT dir, unnest(range(1, len(string_split(dir, '/')) + 1)) AS n FROM g WHERE dir <> '') UNION SELECT ''),
  own AS (SELECT dir, count(*) AS files, sum(size) AS bytes FROM g GROUP BY dir), sub AS (SELECT regexp_replace(dir, '/?[^/]*$', '') AS dir, count(*) AS subs FROM up WHERE dir <> '' GROUP BY 1)"""


@query("directory_stats", with_(FILES, DIRSTATS) + "SELECT up.dir, coalesce(files, 0)::BIGINT AS files, coalesce(subs, 0)::BIGINT AS subdirs, coalesce(bytes, 0)::BIGINT AS bytes FROM up LEFT JOIN own USING (dir) LEFT JOIN sub USING (dir)")
def directory_stats(spark, d):
    return fi.directories(files(spark, d))


DIRSCORE = "least(1.0::DOUBLE, " + when_sum([("lower(split_part(up.dir, '/', -1)) IN ('src', 'lib')", 0.4), (contains_sql("lower(split_part(up.dir, '/', -1))", ("core", "main")), 0.3), ("coalesce(files, 0) > 5", 0.2), ("coalesce(subs, 0) > 2", 0.1)]) + ")"


@query("directory_importance", with_(FILES, DIRSTATS) + f"SELECT up.dir, round({DIRSCORE}, 6) AS importance FROM up LEFT JOIN own USING (dir) LEFT JOIN sub USING (dir)")
def directory_importance(spark, d):
    return fi.directories(files(spark, d)).select("dir", pa.directory_importance(F.col("dir"), F.col("files"), F.col("subdirs")).alias("importance"))


@query("file_tree", with_(FILES, DIRSTATS) + "SELECT path, dir AS parent, split_part(path, '/', -1) AS name, len(string_split(path, '/'))::BIGINT AS depth, true AS is_file FROM g UNION ALL SELECT dir, regexp_replace(dir, '/?[^/]*$', ''), split_part(dir, '/', -1), len(string_split(dir, '/')), false FROM up WHERE dir <> ''")
def file_tree(spark, d):
    return fi.tree(files(spark, d))


@query("tree_stats", with_(FILES, DIRSTATS) + "SELECT (SELECT count(*) FROM files)::BIGINT AS files, (SELECT count(*) FROM up WHERE dir <> '')::BIGINT AS directories, (SELECT sum(size) FROM files)::BIGINT AS bytes")
def tree_stats(spark, d):
    return fi.tree_stats(files(spark, d))


@query(
    "directory_tree_text",
    with_(FILES, DIRSTATS, "nd AS (SELECT dir AS path, regexp_replace(dir, '/?[^/]*$', '') AS parent, split_part(dir, '/', -1) AS name FROM up WHERE dir <> '')", "mk AS (SELECT path, name, name = max(name) OVER (PARTITION BY parent) AS last FROM nd)", "an AS (SELECT path, name, n, array_to_string(list_slice(string_split(path, '/'), 1, n), '/') AS above FROM (SELECT path, name, unnest(range(1, len(string_split(path, '/')) + 1)) AS n FROM nd))")
    + "SELECT an.path, string_agg(CASE WHEN above = an.path THEN CASE WHEN last THEN '└── ' ELSE '├── ' END WHEN last THEN '    ' ELSE '│   ' END, '' ORDER BY n) || any_value(an.name) || '/' AS text FROM an JOIN mk ON mk.path = an.above GROUP BY an.path",
)
def directory_tree_text(spark, d):
    return fi.drawn_directories(files(spark, d))


@query("list_directory", with_(FILES) + "SELECT path, size FROM files WHERE starts_with(path, 'src/') AND len(string_split(path, '/')) <= 4 ORDER BY path LIMIT 8")
def list_directory(spark, d):
    return fi.listed(files(spark, d), "src", 3, 8)


@query("find_files", with_(FILES, BASE) + "SELECT path FROM f WHERE starts_with(name, 'i') AND ends_with(name, '.js') ORDER BY path LIMIT 20")
def find_files(spark, d):
    return files(spark, d).where(pa.matches(pa.name(F.col("path")), "i*.js")).select("path").orderBy("path").limit(20)


@query("file_info", with_(FILES, BASE) + f"SELECT path, name, ext, size, {SIZE} AS size_class, {LANGUAGE} AS language FROM f WHERE path = 'src/utils/text.py'")
def file_info(spark, d):
    p = F.col("path")
    return files(spark, d).where(p == "src/utils/text.py").select("path", pa.name(p).alias("name"), pa.extension(p).alias("ext"), "size", pa.size_class(F.col("size")).alias("size_class"), pa.language(p).alias("language"))


@query("file_insights", with_(FILES, BASE) + "SELECT ext, count(*)::BIGINT AS files, sum(size)::BIGINT AS bytes, round(sum(size) * 1.0 / sum(sum(size)) OVER (), 6)::DOUBLE AS share FROM f GROUP BY ext")
def file_insights(spark, d):
    return fi.insights(files(spark, d))


DOCTYPE = case([(k, isin("lower(ext)", e)) for k, e in pa.SUPPORTED_DOCS.items()])


@query("document_types", with_(FILES, BASE) + f"SELECT path, {DOCTYPE} AS kind FROM f WHERE {DOCTYPE} IS NOT NULL")
def document_types(spark, d):
    return files(spark, d).select("path", pa.document_type(F.col("path")).alias("kind")).where("kind IS NOT NULL")


@query("source_extensions", with_(FILES, BASE) + f"SELECT path, {isin('lower(ext)', pa.SOURCE)} AS is_source FROM f")
def source_extensions(spark, d):
    return files(spark, d).select("path", F.coalesce(F.lower(pa.extension(F.col("path"))).isin(*pa.SOURCE), F.lit(False)).alias("is_source"))


@query("doc_bytes", with_(FILES, BASE) + "SELECT ext, count(*)::BIGINT AS docs, sum(size)::BIGINT AS bytes FROM f WHERE ext IN ('md', 'html') GROUP BY ext")
def doc_bytes(spark, d):
    return files(spark, d).withColumn("ext", pa.extension(F.col("path"))).where("ext IN ('md', 'html')").groupBy("ext").agg(F.count("*").alias("docs"), F.sum("size").alias("bytes"))


@query("ast_batches", with_(FILES, BASE, f"g AS (SELECT path, split_part(path, '/', 1) AS top, {LANGUAGE} AS language FROM f)") + "SELECT path, top, language, (row_number() OVER (PARTITION BY top, language ORDER BY path) - 1) // 3 AS batch FROM g")
def ast_batches(spark, d):
    return fi.batches(files(spark, d), 3)


SIZES_ = Fixture("sizes", "n long", [(0,), (1023,), (1024,), (1536,), (1048576,), (5 * 1024**3,)]).over(n="odd")


@query("format_bytes", with_(SIZES_) + "SELECT n, CASE WHEN n < 1024 THEN n::VARCHAR || ' B' WHEN n < 1048576 THEN printf('%.1f KB', n / 1024.0) WHEN n < 1073741824 THEN printf('%.1f MB', n / 1048576.0) ELSE printf('%.1f GB', n / 1073741824.0) END AS label FROM sizes")
def format_bytes(spark, d):
    return SIZES_.df(spark, d).select("n", tx.bytes_text(F.col("n")).alias("label"))


@query("page_paths", "SELECT page_id, regexp_extract(url, '^[a-z]+://([^/]+)', 1) AS host, regexp_replace(url, '^[a-z]+://[^/]+', '') AS path, length(html)::BIGINT AS size FROM pages")
def page_paths(spark, d):
    return table(spark, d, "pages").select("page_id", F.regexp_extract("url", "^[a-z]+://([^/]+)", 1).alias("host"), F.regexp_replace("url", "^[a-z]+://[^/]+", "").alias("path"), F.length("html").cast("long").alias("size"))


DOSSIERS = Fixture("dossiers", "path string, purpose string, importance double, bytes long", [(f"m{i}/f{i}.{'sql' if i % 5 == 0 else 'rs'}", ["database", "dao", "api", "config", "entry", "router", "util"][i % 7], round((i * 37 % 100) / 100, 2), i * 1500) for i in range(60)]).over(path="prefix", importance="unit", bytes="chars")


@query("database_insights", with_(DOSSIERS) + "SELECT path, importance FROM dossiers WHERE (purpose IN ('database', 'dao') OR ends_with(path, '.sql')) AND bytes <= 50000 ORDER BY importance DESC, path LIMIT 50")
def database_insights(spark, d):
    return fi.top_insights(DOSSIERS.df(spark, d).where("(purpose IN ('database', 'dao') OR endswith(path, '.sql')) AND bytes <= 50000"), 50)


@query("boundary_insights", with_(DOSSIERS) + "SELECT path, importance FROM dossiers WHERE purpose IN ('entry', 'api', 'config', 'router', 'controller') ORDER BY importance DESC, path LIMIT 50")
def boundary_insights(spark, d):
    return fi.top_insights(DOSSIERS.df(spark, d).where("purpose IN ('entry', 'api', 'config', 'router', 'controller')"), 50)


@query("purpose_distribution", with_(DOSSIERS) + "SELECT purpose, count(*)::BIGINT AS n, count(*) FILTER (importance >= 0.5)::BIGINT AS important FROM dossiers GROUP BY purpose")
def purpose_distribution(spark, d):
    return DOSSIERS.df(spark, d).groupBy("purpose").agg(F.count("*").alias("n"), F.count_if(F.col("importance") >= 0.5).alias("important"))


@query("has_database_files", with_(DOSSIERS) + "SELECT count(*) FILTER (purpose IN ('database', 'dao') OR ends_with(path, '.sql')) > 0 AS has FROM dossiers")
def has_database_files(spark, d):
    return DOSSIERS.df(spark, d).agg(F.bool_or(F.col("purpose").isin("database", "dao") | F.endswith("path", F.lit(".sql"))).alias("has"))


@query("relationship_input", with_(DOSSIERS) + "SELECT path, importance FROM dossiers WHERE importance >= 0.6 ORDER BY importance DESC, path LIMIT 150")
def relationship_input(spark, d):
    return fi.top_insights(DOSSIERS.df(spark, d).where("importance >= 0.6"), 150)


DOMAINS = Fixture("domains", "domain string, place string", [("one", "m1"), ("one", "m12/f12.rs"), ("two", "f3"), ("none", "zzz")])


@query("domain_insights", with_(DOSSIERS, DOMAINS, "h AS (SELECT DISTINCT domain, path, importance FROM domains JOIN dossiers ON contains(path, place) OR contains(place, path))", "r AS (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY path) AS n FROM h)") + "SELECT domain, path FROM r WHERE n <= 6")
def domain_insights(spark, d):
    return fi.by_domain(DOSSIERS.df(spark, d), DOMAINS.df(spark, d), 6)


DEPTYPES = Fixture("deps", "src string, dst string, kind string", [("a", "b", k) for k in ("import", "module", "other", "inheritance", "function_call", "data_flow", "composition")]).over(src="tag")
PRIORITY = "CASE " + " ".join(f"WHEN kind = '{k}' THEN {v}" for k, v in pa.DEPENDENCY_PRIORITY.items()) + " ELSE 3 END"


@query("dependency_priority", with_(DEPTYPES) + f"SELECT kind, {PRIORITY} AS priority FROM deps ORDER BY priority DESC, kind LIMIT 5")
def dependency_priority(spark, d):
    return DEPTYPES.df(spark, d).select("kind", fi.priority(F.col("kind")).alias("priority")).orderBy(F.desc("priority"), "kind").limit(5)


@query("fence_languages", with_(FILES, BASE) + "SELECT path, " + case([(v, f"lower(ext) = '{k}'") for k, v in pa.DOC_LANGUAGE.items()], "'text'") + " AS fence FROM f")
def fence_languages(spark, d):
    return files(spark, d).select("path", pa.first([(v, F.lower(pa.extension(F.col("path"))) == k) for k, v in pa.DOC_LANGUAGE.items()], "text").alias("fence"))


IGNORES = [("", 0, "# built files"), ("", 1, "*.log"), ("", 2, "!keep.log"), ("", 3, "build/"), ("", 4, "/d3/docs"), ("d1/src", 0, "!*.log"), ("d1/src", 1, "*.c"), ("d1/src", 2, "!7.c")]
TREE = "tree AS (SELECT 'd' || (doc_id % 7)::VARCHAR || '/' || CASE doc_id % 3 WHEN 0 THEN 'src' WHEN 1 THEN 'build' ELSE 'docs' END AS dir, CASE WHEN doc_id % 11 = 0 THEN 'keep.log' ELSE doc_id::VARCHAR || CASE doc_id % 5 WHEN 0 THEN '.log' WHEN 1 THEN '.c' ELSE '.md' END END AS name FROM documents WHERE doc_id >= 0)"


@query("gitignore_files", f"WITH {TREE} SELECT DISTINCT dir || '/' || name AS path FROM tree WHERE ends_with(dir, '/build') OR dir = 'd3/docs' OR (ends_with(name, '.log') AND name <> 'keep.log' AND dir <> 'd1/src') OR (ends_with(name, '.c') AND dir = 'd1/src' AND name <> '7.c')")
def gitignore_files(spark, d):
    from tessera.sources import collection as co

    n = F.col("doc_id")
    folder = F.concat(F.lit("d"), (n % 7).cast("string"), F.lit("/"), F.when(n % 3 == 0, "src").when(n % 3 == 1, "build").otherwise("docs"), F.lit("/"))
    name = F.when(n % 11 == 0, "keep.log").otherwise(F.concat(n.cast("string"), F.when(n % 5 == 0, ".log").when(n % 5 == 1, ".c").otherwise(".md")))
    paths = spark.read.parquet(f"{d.rstrip('/')}/documents.parquet").where(n >= 0).select(F.concat(folder, name).alias("path"))
    return co.ignored(paths, spark.createDataFrame(IGNORES, co.RULES))
