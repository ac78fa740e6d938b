"""Queries over source text: symbols, dependencies, complexity, comments, manifests, graphs, batches."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import code as co
from tessera.functions import text as tx
from tessera.operators import graph as gr
from tessera.plans.fixture import Fixture, with_
from tessera.plans.search import lines_sql, s, table

QUERIES, ORACLE = {}, {}


def query(name, sql=None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return add


SAMPLES = {
    "rust": ("src/lib.rs", "use std::fmt;\npub use crate::core::Engine as E;\npub mod parser;\n\n/// Adds.\n/// Twice.\npub async fn add(a: i32, b: Option<i32>) -> i32 {\n    if a > 0 && b.is_some() { // note\n        match a { _ => 1 }\n    } else {\n        2\n    }\n}\nstruct Point { x: i32 }\npub(crate) enum Kind { A }\npub trait Shape {}\nimpl Shape for Point {}\n"),
    "python": ("app/main.py", "import os.path\nfrom typing import Any\n\nclass Main(Base):\n    \"\"\"Doc # kept\"\"\"\n    def run(self, n: int = 3, *rest) -> None:\n        for x in range(n):  # loop\n            if x : print('# no')\n\nasync def go(a, b=2):\n    with a as c: pass\ndef _hidden(): pass\n"),
    "javascript": ("web/a.js", "import x from './x';\nconst y = require('y');\nconst z = await import('z');\nexport async function load(a, b) {\n  if (a) { return b ? 1 : 2; } // why\n}\nexport default class App {}\nconst run = async (q) => q && 1 || 2;\n"),
    "typescript": ("web/b.ts", "import type { T } from './types';\nimport { a } from '@x/y';\nexport interface I { n: number }\nexport type U = string;\nabstract class C {}\nexport enum E { A }\nexport function f(a: number) { switch (a) { case 1: return; } }\n"),
    "react": ("web/C.tsx", "import React, { useState } from 'react';\nexport default function Card(p) {\n  const [n, set] = useState(0);\n  useEffect(() => {}, []);\n}\nexport const Row = () => null;\n"),
    "vue": ("web/D.vue", "<template></template>\n<script>\nimport T from './T.vue'\nexport default {\n  name: 'Big-Box',\n}\nfunction grow() {}\n</script>\n"),
    "svelte": ("web/E.svelte", "<script>\n  import { on } from 'svelte';\n  export let size;\n  function tap() {}\n</script>\n<p>x</p>\n"),
    "java": ("src/A.java", "package a.b.c;\nimport java.util.List;\nimport static a.B.*;\npublic final class A {\n  private static int count(List<String> xs, int n) { for (;;) { if (n > 0) break; } }\n}\ninterface B {}\nenum C {}\n"),
    "kotlin": ("src/K.kt", "package a.k\nimport a.b.C\ndata class P(val x: Int)\nobject One\nsuspend fun go() {}\n"),
    "csharp": ("src/S.cs", "using System;\nusing static System.Math;\npublic sealed class S {\n  public async Task<int> Run(int a, string b = \"// no\") { foreach (var x in y) { } }\n}\npublic record R(int A);\ninternal interface IThing {}\n"),
    "php": ("web/p.php", "<?php\nuse App\\Models\\User;\nrequire_once 'lib.php';\nabstract class Page {\n  public static function show($a) {}\n}\ninterface X {}\ntrait Y {}\n"),
    "swift": ("ios/s.swift", "import UIKit\npublic final class V {}\nstruct W {}\nprotocol Q {}\nprivate func go(_ a: Int) {}\n"),
    "sql": ("db/s.sql", "CREATE TABLE users (\n  id INT,\n  name TEXT REFERENCES people\n);\ncreate view v AS SELECT * FROM users u JOIN orders o ON 1=1;\nCREATE PROCEDURE refresh AS INSERT INTO log SELECT 1 FROM v;\nCREATE UNIQUE INDEX ix ON users(id);\nUPDATE users SET id = 1;\nEXEC refresh;\n"),
    "project": ("p/a.csproj", "<ItemGroup>\n<PackageReference Include=\"Json\" Version=\"1.2\" />\n<ProjectReference Include=\"..\\b.csproj\" />\n<FrameworkReference Include=\"Web\" />\n<ArtifactReference Include=\"x.dacpac\" />\n<Build Include=\"t.sql\" />\n</ItemGroup>\nProject(\"{1}\") = \"Core\", \"Core\\Core.csproj\"\n"),
}


def sample(language: str) -> Fixture:
    return Fixture("files", "path string, body string", [SAMPLES[language]]).over(path="prefix", body="after")


ALL = Fixture("files", "path string, body string, language string", [(*v, k) for k, v in SAMPLES.items()]).over(path="prefix", body="after")
EACH = f"each AS (SELECT path, i, l[i] AS text FROM (SELECT path, l, unnest(range(1, len(l) + 1)) AS i FROM (SELECT path, {lines_sql('body')} AS l FROM files)))"


def found_sql(rules) -> str:
    return " UNION ALL ".join(f"SELECT path, i::BIGINT AS line, '{k}' AS kind, regexp_extract(text, {s(p)}, 1) AS name FROM each WHERE regexp_extract(text, {s(p)}, 1) <> ''" for k, p in rules)


def register(prefix: str, rules: dict) -> None:
    for language, own in rules.items():
        fixture = sample(language)
        query(f"{prefix}_{language}", with_(fixture, EACH) + found_sql(own))(lambda spark, d, f=fixture, r=own: co.found(f.df(spark, d), r))


register("dependencies", co.DEPENDENCIES)
register("symbols", co.SYMBOLS)
query("project_references", with_(sample("project"), EACH) + found_sql(co.PROJECT_REFERENCES))(lambda spark, d: co.found(sample("project").df(spark, d), co.PROJECT_REFERENCES))


def all_sql(rules) -> str:
    return " UNION ALL ".join(f"SELECT path, '{k}' AS kind, unnest(regexp_extract_all(body, {s(p)}, 1)) AS name FROM files" for k, p in rules)


@query("sql_references", with_(sample("sql")) + all_sql(co.SQL_REFERENCES))
def sql_references(spark, d):
    return co.found_all(sample("sql").df(spark, d), co.SQL_REFERENCES)


@query("interfaces")
def interfaces(spark, d):
    """Definitions of whole files of all languages; a lexer is beyond SQL, tests hold it against sources written by hand."""
    from tessera.operators import symbols

    return symbols.interfaces(ALL.df(spark, d))


def count_sql(part: str) -> str:
    return f"((length(body) - length(replace(body, {s(part)}, ''))) / {len(part)})::BIGINT"


def total_sql(parts) -> str:
    return "(" + " + ".join(map(count_sql, parts)) + ")"


CYCLO = "CASE language " + " ".join(f"WHEN '{k}' THEN {total_sql(co.BRANCHES['typescript' if k == 'javascript' else k])}" for k in ("rust", "python", "typescript", "javascript", "csharp", "java", "go")) + f" ELSE {total_sql(co.BRANCHES['other'])} END + 1"
LOC = "len(list_filter(string_split(body, chr(10)), lambda x: trim(x) <> ''))::BIGINT"


@query("complexity", with_(ALL) + f"SELECT path, {CYCLO} AS cyclomatic, {LOC} AS loc FROM files")
def complexity(spark, d):
    return ALL.df(spark, d).select("path", co.cyclomatic(F.col("body"), F.col("language")).alias("cyclomatic"), co.lines_of_code(F.col("body")).alias("loc"))


@query("complexity_alt", with_(ALL) + f"SELECT path, {total_sql(co.BRANCH_MARKS)} + 1 AS cyclomatic, {total_sql(co.FUNCTION_MARKS)} AS functions, {total_sql(co.CLASS_MARKS)} AS classes FROM files")
def complexity_alt(spark, d):
    b = F.col("body")
    return ALL.df(spark, d).select("path", (co.total(b, co.BRANCH_MARKS) + 1).alias("cyclomatic"), co.total(b, co.FUNCTION_MARKS).alias("functions"), co.total(b, co.CLASS_MARKS).alias("classes"))


@query("top_complex_files", with_(ALL) + f"SELECT path, {CYCLO} AS cyclomatic FROM files ORDER BY cyclomatic DESC, path LIMIT 5")
def top_complex_files(spark, d):
    return ALL.df(spark, d).select("path", co.cyclomatic(F.col("body"), F.col("language")).alias("cyclomatic")).orderBy(F.desc("cyclomatic"), "path").limit(5)


@query("project_statistics", with_(ALL) + f"SELECT language, count(*)::BIGINT AS files, sum({LOC})::BIGINT AS loc FROM files GROUP BY language")
def project_statistics(spark, d):
    return ALL.df(spark, d).groupBy("language").agg(F.count("*").alias("files"), F.sum(co.lines_of_code(F.col("body"))).alias("loc"))


@query("document_complexity", "SELECT doc_id, ((length(text) - length(replace(text, 'the ', ''))) / 4)::BIGINT AS marks, len(list_filter(string_split(text, chr(10)), lambda x: trim(x) <> ''))::BIGINT AS loc FROM documents")
def document_complexity(spark, d):
    t = F.col("text")
    return table(spark, d, "documents").select("doc_id", co.occurrences(t, "the ").alias("marks"), co.lines_of_code(t).alias("loc"))


def strip_sql(pattern: str) -> str:
    return f"regexp_replace(regexp_replace(regexp_replace(regexp_replace(body, {s(pattern)}, '\\1', 'g'), '[ \\t]+(\\n|$)', '\\1', 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g'), '^\\n+', '')"


@query("compress_source", with_(ALL) + f"SELECT path, CASE WHEN language = 'python' THEN {strip_sql(co.PYTHON_COMMENTS)} ELSE {strip_sql(co.C_COMMENTS)} END AS body FROM files WHERE language IN ('python', 'rust', 'javascript', 'csharp', 'java')")
def compress_source(spark, d):
    b = F.col("body")
    return ALL.df(spark, d).where("language IN ('python', 'rust', 'javascript', 'csharp', 'java')").select("path", F.when(F.col("language") == "python", co.without_comments(b, co.PYTHON_COMMENTS)).otherwise(co.without_comments(b, co.C_COMMENTS)).alias("body"))


@query("collapse_whitespace", with_(ALL) + "SELECT path, regexp_replace(regexp_replace(regexp_replace(body || chr(10) || chr(10) || '  ', '[ \\t]+(\\n|$)', '\\1', 'g'), '\\n{3,}', chr(10) || chr(10), 'g'), '^\\n+', '') AS body FROM files")
def collapse_whitespace(spark, d):
    return ALL.df(spark, d).select("path", tx.collapse_blank(F.concat("body", F.lit("\n\n  "))).alias("body"))


SIGNATURES = Fixture("signatures", "line string", [("pub fn add(&self, a: i32, mut b: &str) -> X",), ("public async Task Run(int a)",), ("def f(self, x, y=3):",), ("private void g()",), ("pub(crate) fn h(q: A<B>)",), ("let x = 1",)]).over(line="tail")
PARAMS = "list_filter(list_transform(string_split(regexp_extract(line, '\\(([^)]*)\\)', 1), ','), lambda p: trim(split_part(split_part(p, ':', 1), '=', 1))), lambda n: n <> '' AND n NOT IN ('self', '&self', '&mut self', 'mut self'))"


@query("parameters_and_visibility", with_(SIGNATURES, "g AS (SELECT replace(line, 'pub(crate) ', 'pub_crate ') AS line FROM signatures)") + f"SELECT line, {PARAMS} AS params, coalesce(nullif(regexp_extract(line, '^\\s*(public|protected|internal|private|pub)\\b', 1), ''), 'private') AS visibility FROM g")
def parameters_and_visibility(spark, d):
    g = SIGNATURES.df(spark, d).select(F.replace("line", F.lit("pub(crate) "), F.lit("pub_crate ")).alias("line"))
    return g.select("line", co.parameters(F.col("line")).alias("params"), co.visibility(F.col("line")).alias("visibility"))


TARGETS = Fixture("targets", "target string", [("std::collections::HashMap",), ("crate::a::{B, C}",), ("serde_json as json",), ("'quoted'",)]).over(target="tail")


@query("dependency_names", with_(TARGETS) + "SELECT target, trim(coalesce(nullif(regexp_extract(target, '\\{\\s*([A-Za-z0-9_]+)', 1), ''), string_split(regexp_replace(target, '\\s+as\\s+.*$', ''), '::')[-1])) AS name, regexp_replace(target, '^[''\"]+|[''\"]+$', '', 'g') AS plain FROM targets")
def dependency_names(spark, d):
    return TARGETS.df(spark, d).select("target", co.dependency_name(F.col("target")).alias("name"), F.regexp_replace("target", "^['\"]+|['\"]+$", "").alias("plain"))


@query("doc_comments", with_(sample("rust"), EACH, "c AS (SELECT path, i, regexp_extract(text, '^\\s*///\\s?(.*)$', 1) AS t, regexp_matches(text, '^\\s*///') AS is_doc FROM each)", "g AS (SELECT *, i - row_number() OVER (PARTITION BY path, is_doc ORDER BY i) AS run FROM c)") + "SELECT path, max(i)::BIGINT + 1 AS line, string_agg(t, ' ' ORDER BY i) AS doc FROM g WHERE is_doc GROUP BY path, run")
def doc_comments(spark, d):
    from tessera.operators import textual as te

    return te.doc_comments(sample("rust").df(spark, d))


@query("script_content", with_(ALL) + "SELECT path, regexp_extract(body, '(?s)<script[^>]*>(.*?)</script>', 1) AS script FROM files WHERE language IN ('vue', 'svelte')")
def script_content(spark, d):
    return ALL.df(spark, d).where("language IN ('vue', 'svelte')").select("path", F.regexp_extract("body", "(?s)<script[^>]*>(.*?)</script>", 1).alias("script"))


LITERALS = Fixture("literals", "v string", [(x,) for x in ('"text"', "12", "-3.5", "true", "[1, 2]", '["a": 1]', "Foo()", "nil", "x")]).over(v="number")


@query("infer_type", with_(LITERALS) + r"""SELECT v, CASE WHEN starts_with(v, '"') THEN 'String' WHEN regexp_matches(v, '^-?[0-9]+$') THEN 'Int' WHEN regexp_matches(v, '^-?[0-9]+\.[0-9]+$') THEN 'Double' WHEN v IN ('true', 'false') THEN 'Bool' WHEN regexp_matches(v, '^\[[^\]]*:') THEN 'Dictionary' WHEN starts_with(v, '[') THEN 'Array' ELSE coalesce(nullif(regexp_extract(v, '^([A-Z][A-Za-z0-9]*)\(', 1), ''), 'Any') END AS type FROM literals""")
def infer_type(spark, d):
    v = F.col("v")
    kind = F.when(F.startswith(v, F.lit('"')), "String").when(F.rlike(v, F.lit("^-?[0-9]+$")), "Int").when(F.rlike(v, F.lit(r"^-?[0-9]+\.[0-9]+$")), "Double").when(v.isin("true", "false"), "Bool")
    kind = kind.when(F.rlike(v, F.lit(r"^\[[^\]]*:")), "Dictionary").when(F.startswith(v, F.lit("[")), "Array").otherwise(F.coalesce(F.nullif(F.regexp_extract(v, r"^([A-Z][A-Za-z0-9]*)\(", 1), F.lit("")), F.lit("Any")))
    return LITERALS.df(spark, d).select("v", kind.alias("type"))


CARGO = Fixture("files", "path string, body string", [("Cargo.toml", '[package]\nname = "x"\n\n[dependencies]\nserde = "1"\nTokio = { version = "1" }\n[dev-dependencies]\ncriterion = "0.5"\n[profile.release]\nlto = true\n'), ("b/Cargo.toml", "[dependencies]\nanyhow = \"1\"\n")]).over(path="prefix", body="after")


@query("manifest_deps_cargo", with_(CARGO, EACH, "u AS (SELECT path, text, last_value(nullif(regexp_extract(text, '^\\s*\\[([^\\]]+)\\]', 1), '') IGNORE NULLS) OVER (PARTITION BY path ORDER BY i ROWS UNBOUNDED PRECEDING) AS under FROM each)") + "SELECT path, lower(regexp_extract(text, '^\\s*([A-Za-z0-9_-]+)\\s*=', 1)) AS name FROM u WHERE regexp_extract(text, '^\\s*([A-Za-z0-9_-]+)\\s*=', 1) <> '' AND ends_with(under, 'dependencies')")
def manifest_deps_cargo(spark, d):
    return co.cargo_dependencies(CARGO.df(spark, d))


NPM = Fixture("files", "path string, body string", [("package.json", '{"name": "x", "dependencies": {"@a/b": "1", "React": "2"}, "devDependencies": {"jest": "3"}}'), ("q/package.json", '{"name": "y"}')]).over(path="prefix")


@query("manifest_deps_npm", with_(NPM) + "SELECT path, lower(regexp_replace(k, '^@[^/]+/', '')) AS name FROM (SELECT path, unnest(list_concat(coalesce(json_keys(body, '$.dependencies'), []), coalesce(json_keys(body, '$.devDependencies'), []))) AS k FROM files)")
def manifest_deps_npm(spark, d):
    return co.npm_dependencies(NPM.df(spark, d))


PIP = Fixture("files", "path string, body string", [("requirements.txt", "Django==4.2\n# note\nrequests>=2 # why\n-r other.txt\n\nnumpy\n")]).over(path="prefix", body="after")


@query("manifest_deps_pip", with_(PIP, EACH) + "SELECT path, lower(regexp_extract(trim(regexp_replace(text, '#.*$', '')), '^([A-Za-z0-9_.-]+)', 1)) AS name FROM each WHERE regexp_extract(trim(regexp_replace(text, '#.*$', '')), '^([A-Za-z0-9_.-]+)', 1) <> '' AND NOT starts_with(text, '-')")
def manifest_deps_pip(spark, d):
    return co.pip_dependencies(PIP.df(spark, d))


PROJECT = Fixture("deps_", "name string", [("requests[security]>=2.0",), ("numpy",), ("  flask ; python_version > '3'",), ("uvicorn~=0.3",)]).over(name="number")


@query("pyproject_names", with_(PROJECT) + "SELECT name, regexp_extract(trim(name), '^([A-Za-z0-9_.-]+)', 1) AS package FROM deps_")
def pyproject_names(spark, d):
    return PROJECT.df(spark, d).select("name", F.regexp_extract(F.trim("name"), "^([A-Za-z0-9_.-]+)", 1).alias("package"))


NODES = Fixture("nodes", "path string, summary string, symbols array<string>, deps array<string>, size long", [("src/a.rs", "entry", ["x", "y"], ["b", "serde"], 10), ("src/b.rs", "", [f"s{i}" for i in range(10)], [], 20), ("src/c/mod.rs", "", [], [], 30), ("web/a.ts", "ui", [], ["c/mod", "react"], 40)]).over(path="prefix", size="chars")
DEPS = "dep AS (SELECT DISTINCT path, unnest(deps) AS label FROM nodes), res AS (SELECT label, min(n.path) AS target FROM (SELECT DISTINCT label FROM dep) JOIN nodes n ON contains(n.path, label) OR regexp_replace(split_part(n.path, '/', -1), '\\.[^.]*$', '') = label GROUP BY label)"


def node_dependencies(spark, d):
    return NODES.df(spark, d).select("path", F.explode("deps").alias("name"))


@query("dependency_graph", with_(NODES) + "SELECT path, list_sort(deps) AS targets FROM nodes WHERE len(deps) > 0")
def dependency_graph(spark, d):
    return gr.adjacency(node_dependencies(spark, d))


@query("dag_edges", with_(NODES, DEPS) + "SELECT dep.path AS source, coalesce(target, label) AS target, target IS NULL AS is_external FROM dep LEFT JOIN res USING (label)")
def dag_edges(spark, d):
    return gr.edges(node_dependencies(spark, d), NODES.df(spark, d).select("path"))


@query("resolve_labels", with_(NODES, DEPS) + "SELECT label, target AS path FROM res")
def resolve_labels(spark, d):
    return gr.resolve_labels(node_dependencies(spark, d).select(F.col("name").alias("label")).distinct(), NODES.df(spark, d).select("path"))


@query("rag_chunks", with_(NODES, "t AS (SELECT path, size, concat_ws(' | ', nullif(summary, ''), CASE WHEN len(symbols) > 0 THEN 'symbols: ' || array_to_string(list_slice(symbols, 1, 8), ', ') END, CASE WHEN len(deps) > 0 THEN 'deps: ' || array_to_string(list_slice(deps, 1, 6), ', ') END) AS text FROM nodes)") + "SELECT 'dag-' || row_number() OVER (ORDER BY path)::VARCHAR AS chunk_id, path, CASE WHEN text = '' THEN 'size: ' || size::VARCHAR ELSE text END AS text FROM t ORDER BY path LIMIT 256")
def rag_chunks(spark, d):
    return gr.chunks(NODES.df(spark, d))


INSIGHTS = Fixture("insights", "key string, summary string", [("src/a.rs", "by path"), ("b.rs", "by name"), ("mod.rs", "module"), ("zzz", "none")]).over(key="prefix")


@query("insight_for_file", with_(NODES, INSIGHTS) + "SELECT n.path, coalesce(a.summary, b.summary) AS summary FROM nodes n LEFT JOIN insights a ON a.key = n.path LEFT JOIN insights b ON b.key = split_part(n.path, '/', -1)")
def insight_for_file(spark, d):
    return gr.insight_for(INSIGHTS.df(spark, d), NODES.df(spark, d).select("path"))


@query("ast_index", with_(NODES) + "SELECT path, len(symbols)::BIGINT AS n_symbols, len(deps)::BIGINT AS n_deps, list_sort(list_distinct(list_concat(symbols, deps))) AS all_names FROM nodes")
def ast_index(spark, d):
    return NODES.df(spark, d).select("path", F.size("symbols").cast("long").alias("n_symbols"), F.size("deps").cast("long").alias("n_deps"), F.array_sort(F.array_union("symbols", "deps")).alias("all_names"))


HINTS = Fixture("hints", "name string, kind string, line long", [("run", "function", 3), ("run", "function", 3), ("Main", "class", 1), ("stop", "function", 9)]).over(name="tag")
KNOWN = Fixture("known", "name string, kind string, line long", [("run", "function", 3), ("go", "function", 5)]).over(name="tag")


@query("apply_hints", with_(HINTS, KNOWN) + "SELECT * FROM known UNION ALL SELECT DISTINCT h.* FROM hints h WHERE NOT EXISTS (SELECT 1 FROM known k WHERE k.name = h.name AND k.kind = h.kind AND k.line = h.line)")
def apply_hints(spark, d):
    known, hints = KNOWN.df(spark, d), HINTS.df(spark, d).dropDuplicates(["name", "kind", "line"])
    return known.unionByName(hints.join(known, ["name", "kind", "line"], "left_anti"))


MATCHES = Fixture("matches", "line string", [('{"file": "a.rs", "text": "fn x() {}", "range": {"start": {"line": 4}}, "metaVariables": {"single": {"NAME": {"text": "x"}}}}',), ('{"file": "b.rs", "text": "use y;", "range": {"start": {"line": 0}}, "metaVariables": {"single": {}}}',)]).over(line="file")


@query("structural_matches", with_(MATCHES) + "SELECT json_extract_string(line, '$.file') AS file, json_extract(line, '$.range.start.line')::BIGINT + 1 AS line_no, json_extract_string(line, '$.metaVariables.single.NAME.text') AS name FROM matches")
def structural_matches(spark, d):
    g = lambda p: F.get_json_object("line", p)
    return MATCHES.df(spark, d).select(g("$.file").alias("file"), (g("$.range.start.line").cast("long") + 1).alias("line_no"), g("$.metaVariables.single.NAME.text").alias("name"))


BATCH = Fixture("sized", "batch_key string, path string, size long", [("a", f"f{i:02}", (i * 37 % 11) * 900 + 100) for i in range(20)] + [("b", "g1", 9000), ("b", "g2", 100)]).over(batch_key="tag")


@query(
    "greedy_batches",
    "WITH RECURSIVE " + BATCH.sql + ", o AS (SELECT *, row_number() OVER (PARTITION BY batch_key ORDER BY path) AS i FROM sized), r(batch_key, i, path, held, batch) AS (SELECT batch_key, i, path, size, 0::BIGINT FROM o WHERE i = 1 UNION ALL SELECT o.batch_key, o.i, o.path, CASE WHEN r.held > 0 AND r.held + o.size > 8000 THEN o.size ELSE r.held + o.size END, r.batch + CASE WHEN r.held > 0 AND r.held + o.size > 8000 THEN 1 ELSE 0 END FROM r JOIN o ON o.batch_key = r.batch_key AND o.i = r.i + 1) SELECT batch_key, path, batch FROM r",
)
def greedy_batches(spark, d):
    return gr.greedy_batches(BATCH.df(spark, d), 8000)


CANDIDATES = Fixture("candidates", "name string, candidate string, way long", [("engine", "src/engine.rs", 0), ("engine", "src/engine/mod.rs", 1), ("util", "src/util.rs", 0), ("util", "lib/util.rs", 1), ("none", "src/none.rs", 0)]).over(name="tag", candidate="prefix")
PRESENT = Fixture("present", "path string", [("src/engine/mod.rs",), ("lib/util.rs",), ("src/util.rs",), ("deep/none.rs",)]).over(path="prefix")


@query("dependency_lookup", with_(CANDIDATES, PRESENT, "h AS (SELECT name, candidate AS path, way FROM candidates JOIN present ON path = candidate)", "st AS (SELECT DISTINCT c.name, min(p.path) AS path FROM candidates c JOIN present p ON regexp_replace(split_part(p.path, '/', -1), '\\.[^.]*$', '') = c.name GROUP BY c.name)") + "SELECT name, arg_min(path, way) AS path FROM (SELECT * FROM h UNION ALL SELECT name, path, 99 FROM st) GROUP BY name")
def dependency_lookup(spark, d):
    from tessera.operators import textual as te

    return te.dependency_files(CANDIDATES.df(spark, d), PRESENT.df(spark, d))


WORDS = Fixture("asked", "word string", [("serch",), ("stauts",), ("get",), ("zzzzzz",), ("quer",)]).over(word="word")
TOOLS = Fixture("tools", "tool string", [(x,) for x in ("search", "vsearch", "query", "get", "multi_get", "status", "ingest", "embed")])


@query("name_suggestion", with_(WORDS, TOOLS, "d AS (SELECT word, tool, levenshtein(word, tool) AS dist FROM asked, tools)") + "SELECT word, arg_min(tool, (dist, tool)) AS suggestion, min(dist)::BIGINT AS distance FROM d WHERE dist <= CASE WHEN length(word) <= 4 THEN 1 ELSE 2 END GROUP BY word")
def name_suggestion(spark, d):
    from tessera.operators import textual as te

    return te.suggestions(WORDS.df(spark, d), TOOLS.df(spark, d))


PSR = Fixture("files", "path string, body string", [("composer.json", '{"autoload": {"psr-4": {"App\\\\": "src/", "Db\\\\": "db/"}}}')]).over(path="prefix")


@query("psr_namespaces", with_(PSR) + "SELECT path, unnest(json_keys(body, '$.autoload.psr-4')) AS namespace FROM files")
def psr_namespaces(spark, d):
    return PSR.df(spark, d).select("path", F.explode(F.map_keys(F.from_json(F.get_json_object("body", "$.autoload['psr-4']"), "map<string,string>"))).alias("namespace"))


@query("component_type", with_(ALL) + "SELECT path, CASE WHEN contains(path, 'main') THEN 'entry' WHEN ends_with(path, 'lib.rs') OR ends_with(path, 'mod.rs') THEN 'library' WHEN contains(body, 'trait ') OR contains(body, 'interface ') THEN 'contract' WHEN contains(body, 'class ') OR contains(body, 'struct ') THEN 'model' ELSE 'module' END AS component FROM files")
def component_type(spark, d):
    p, b = F.col("path"), F.col("body")
    has = lambda x: F.contains(b, F.lit(x))
    kind = F.when(F.contains(p, F.lit("main")), "entry").when(F.endswith(p, F.lit("lib.rs")) | F.endswith(p, F.lit("mod.rs")), "library").when(has("trait ") | has("interface "), "contract").when(has("class ") | has("struct "), "model").otherwise("module")
    return ALL.df(spark, d).select("path", kind.alias("component"))
