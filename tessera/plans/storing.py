"""Queries of the document store: ingest, look-ups, contexts, status, clean-up, snapshots and change sets."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import text as tx
from tessera.operators import changes as ch
from tessera.operators import store as st
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


@query("get_by_id", with_(STORE) + "SELECT id, file, title, hash FROM st WHERE id = 42")
def get_by_id(spark, d):
    return shown(store(spark, d).where("id = 42"))


def shown(rows):
    return rows.select("id", st.file(F.col("collection"), F.col("path")).alias("file"), "title", "hash")


@query("get_by_path", with_(STORE) + "SELECT id, file, title, hash FROM st WHERE collection = 'src7' AND path = 'en/7.md'")
def get_by_path(spark, d):
    return shown(store(spark, d).where("collection = 'src7' AND path = 'en/7.md'"))


@query("get_by_suffix", with_(STORE) + "SELECT id, file, title, hash FROM st WHERE ends_with(lower(path), '/7.md') ORDER BY length(path), path, id LIMIT 1")
def get_by_suffix(spark, d):
    return shown(store(spark, d).where(F.endswith(F.lower("path"), F.lit("/7.md"))).orderBy(F.length("path"), "path", "id").limit(1))


LOOKUPS = Fixture("lookups", "lookup string", [("#42",), ("src7/en/7.md:12",), ("/7.md",), ("2.md",), ("nothing.md",), ("src1/en/1.md",), ("#zz",), ("#3:9",)])
RESOLVED = r"""asked AS (SELECT DISTINCT lookup, try_cast(nullif(regexp_extract(lookup, ':(\d+)$', 1), '') AS BIGINT) AS line, regexp_replace(lookup, ':\d+$', '') AS name FROM lookups),
  a AS (SELECT lookup, line, id, file, 0 AS way, 0 AS size FROM asked JOIN st ON starts_with(name, '#') AND try_cast(substr(name, 2) AS BIGINT) = id),
  b AS (SELECT lookup, line, id, file, 1 AS way, 0 AS size FROM asked JOIN st ON name = file),
  c AS (SELECT lookup, line, id, file, 2 AS way, length(path) AS size FROM asked JOIN st ON ends_with(lower(path), lower(name)) WHERE lookup NOT IN (SELECT lookup FROM a UNION SELECT lookup FROM b)),
  r AS (SELECT *, row_number() OVER (PARTITION BY lookup ORDER BY way, size, file, id) AS n FROM (SELECT * FROM a UNION ALL SELECT * FROM b UNION ALL SELECT * FROM c))"""


@query("resolve_document", with_(STORE, LOOKUPS, RESOLVED) + "SELECT lookup, id, file, line FROM r WHERE n = 1")
def resolve_document(spark, d):
    return st.resolve(store(spark, d), LOOKUPS.df(spark, d))


@query("get_document", with_(STORE, LOOKUPS, RESOLVED) + f"SELECT lookup, file, array_to_string(list_slice({lines_sql('body')}, coalesce(line, 1), coalesce(line, 1) + 1), chr(10)) AS part FROM r JOIN st USING (id, file) WHERE n = 1")
def get_document(spark, d):
    rows = store(spark, d)
    found = st.resolve(rows, LOOKUPS.df(spark, d)).join(rows.select("id", "body"), "id")
    part = F.array_join(F.slice(tx.lines(F.col("body")), F.coalesce("line", F.lit(1)).cast("int"), F.lit(2)), "\n")
    return found.select("lookup", "file", part.alias("part"))


@query("multi_get_glob", with_(STORE) + "SELECT file, CASE WHEN strlen(body) <= 3000 THEN body END AS body, CASE WHEN strlen(body) > 3000 THEN 'skipped: ' || strlen(body)::VARCHAR || ' bytes' END AS error FROM st WHERE regexp_matches(file, '^src1/[^/]*/[^/]*1\\.md$')")
def multi_get_glob(spark, d):
    return st.multi_get(store(spark, d), "src1/*/*1.md", 3000)


@query("multi_get_list", with_(STORE) + "SELECT file, CASE WHEN strlen(body) <= 3000 THEN body END AS body, CASE WHEN strlen(body) > 3000 THEN 'skipped: ' || strlen(body)::VARCHAR || ' bytes' END AS error FROM st WHERE file IN ('src1/en/1.md', 'src7/en/7.md', 'none.md')")
def multi_get_list(spark, d):
    return st.multi_get(store(spark, d), "src1/en/1.md, src7/en/7.md, none.md", 3000)


@query("list_files", with_(STORE) + "SELECT file, id FROM st WHERE starts_with(lower(file), 'src1/e')")
def list_files(spark, d):
    return st.list_files(store(spark, d), "SRC1/e")


COLLECTIONS = Fixture("collections", "collection string", [("src1",), ("src2",), ("unused",)])


@query("index_status", with_(STORE, COLLECTIONS) + "SELECT c.collection, count(st.id)::BIGINT AS files, max(st.id) AS newest FROM collections c LEFT JOIN st ON st.collection = c.collection GROUP BY c.collection")
def index_status(spark, d):
    return st.status(store(spark, d), COLLECTIONS.df(spark, d))


@query("index_totals", with_(STORE) + "SELECT count(*)::BIGINT AS documents, count(DISTINCT hash)::BIGINT AS contents, (SELECT count(DISTINCT hash) FROM st WHERE id % 3 <> 0 AND hash NOT IN (SELECT hash FROM st WHERE id % 3 = 0))::BIGINT AS needs_embedding FROM st")
def index_totals(spark, d):
    rows = store(spark, d)
    missing = st.pending(rows, rows.where("id % 3 = 0")).agg(F.count("*").alias("needs_embedding"))
    return rows.agg(F.count("*").alias("documents"), F.countDistinct("hash").alias("contents")).join(F.broadcast(missing))


@query("needs_embedding", with_(STORE) + "SELECT DISTINCT hash FROM st WHERE hash NOT IN (SELECT hash FROM st WHERE id % 3 = 0)")
def needs_embedding(spark, d):
    rows = store(spark, d)
    return st.pending(rows, rows.where("id % 3 = 0")).select("hash")


@query("embed_pending", with_(STORE) + "SELECT hash, sum(strlen(body))::BIGINT AS bytes FROM (SELECT DISTINCT hash, body FROM st WHERE hash NOT IN (SELECT hash FROM st WHERE id % 5 = 0)) GROUP BY hash")
def embed_pending(spark, d):
    rows = store(spark, d)
    return st.pending(rows, rows.where("id % 5 = 0")).select("hash", F.octet_length("body").cast("long").alias("bytes"))


OLD = "old AS (SELECT collection, path, CASE WHEN id % 10 = 1 THEN sha256(body || 'old') ELSE hash END AS hash, id % 17 <> 0 AS active FROM st WHERE id % 10 <> 0), cand AS (SELECT collection, path, hash FROM st WHERE id % 7 <> 3)"
MERGED = """merged AS (SELECT coalesce(c.collection, o.collection) AS collection, coalesce(c.path, o.path) AS path, coalesce(c.hash, o.hash) AS hash,
  CASE WHEN o.hash IS NULL THEN 'inserted' WHEN c.hash IS NULL THEN CASE WHEN o.active THEN 'deactivated' ELSE 'gone' END WHEN c.hash <> o.hash THEN 'updated' WHEN NOT o.active THEN 'reactivated' ELSE 'unchanged' END AS status
  FROM cand c FULL JOIN old o ON c.collection = o.collection AND c.path = o.path)"""


def snapshots(spark, d):
    rows = store(spark, d)
    old = rows.where("id % 10 <> 0").select("collection", "path", F.when(F.col("id") % 10 == 1, F.sha2(F.concat("body", F.lit("old")), 256)).otherwise(F.col("hash")).alias("hash"), (F.col("id") % 17 != 0).alias("active"))
    return rows.where("id % 7 <> 3"), old


@query("ingest_merge", with_(STORE, OLD, MERGED) + "SELECT collection, path, hash, status FROM merged")
def ingest_merge(spark, d):
    return st.merge(*snapshots(spark, d))


@query("ingest_tombstones", with_(STORE, OLD, MERGED) + "SELECT collection, path, hash, status NOT IN ('deactivated', 'gone') AS active FROM merged")
def ingest_tombstones(spark, d):
    return st.apply_merge(*snapshots(spark, d))


@query("ingest_report", with_(STORE, OLD, MERGED) + "SELECT count(*) FILTER (status = 'inserted')::BIGINT AS indexed, count(*) FILTER (status = 'updated')::BIGINT AS updated, count(*) FILTER (status IN ('unchanged', 'reactivated'))::BIGINT AS unchanged, count(*) FILTER (status = 'deactivated')::BIGINT AS deactivated FROM merged")
def ingest_report(spark, d):
    return st.report(st.merge(*snapshots(spark, d)))


CLEAN = "a AS (SELECT * FROM st WHERE id % 4 <> 0), c AS (SELECT DISTINCT hash FROM st WHERE hash IN (SELECT hash FROM a)), v AS (SELECT DISTINCT hash FROM st WHERE id % 2 = 0 AND hash IN (SELECT hash FROM c))"


@query("cleanup_orphans", with_(STORE, CLEAN) + "SELECT 'documents' AS relation, count(*)::BIGINT AS n FROM a UNION ALL SELECT 'content', count(*) FROM c UNION ALL SELECT 'vectors', count(*) FROM v UNION ALL SELECT 'bands', 8 * count(*) FROM v")
def cleanup_orphans(spark, d):
    rows = store(spark, d).withColumn("active", F.col("id") % 4 != 0)
    vectors = rows.where("id % 2 = 0").select("hash").distinct()
    bands = vectors.select("hash", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("band"))
    left = st.cleanup(rows, st.content(rows), vectors, bands)
    return st.union_all([df.agg(F.count("*").alias("n")).select(F.lit(k).alias("relation"), "n") for k, df in left.items()])


CONTEXTS = Fixture("contexts", "collection string, prefix string, text string", [(None, "/", "everything"), ("src1", "en/", "English of one"), ("src1", "/", "all of one"), ("src2", "fr", "French of two"), ("src3", "en/3.md", "a single file"), ("src4", "/e", "no whole part")])
SCOPES = Fixture("contexts", CONTEXTS.schema, CONTEXTS.rows).over(prefix="number", text="number")
COVER = "(CASE WHEN trim(prefix) IN ('', '/') THEN '/' ELSE regexp_replace(CASE WHEN starts_with(trim(prefix), '/') THEN trim(prefix) ELSE '/' || trim(prefix) END, '/+$', '') END)"


@query(
    "context_for_path",
    with_(STORE, CONTEXTS, f"own AS (SELECT collection, {COVER} AS prefix, text FROM contexts WHERE collection IS NOT NULL)", "hit AS (SELECT st.file, own.text, row_number() OVER (PARTITION BY st.file ORDER BY length(own.prefix) DESC) AS r FROM st JOIN own ON st.collection = own.collection AND (own.prefix = '/' OR '/' || st.path = own.prefix OR starts_with('/' || st.path, own.prefix || '/')))")
    + "SELECT st.file, coalesce(hit.text, (SELECT text FROM contexts WHERE collection IS NULL)) AS context FROM st LEFT JOIN hit ON st.file = hit.file AND r = 1",
)
def context_for_path(spark, d):
    files = store(spark, d).select(st.file(F.col("collection"), F.col("path")).alias("file"), "collection", "path")
    return st.contexts_for(files, CONTEXTS.df(spark, d))


@query(
    "context_gap",
    with_(STORE, CONTEXTS, f"own AS (SELECT collection, {COVER} AS prefix FROM contexts WHERE collection IS NOT NULL)", "tops AS (SELECT DISTINCT collection, split_part(path, '/', 1) AS top FROM st)")
    + "SELECT collection, top FROM tops t WHERE NOT EXISTS (SELECT 1 FROM own c WHERE c.collection = t.collection AND (c.prefix = '/' OR c.prefix = '/' || t.top OR starts_with(c.prefix, '/' || t.top || '/')))",
)
def context_gap(spark, d):
    return st.context_gaps(store(spark, d), CONTEXTS.df(spark, d))


@query("list_contexts", with_(SCOPES) + f"SELECT coalesce(collection, 'global') AS scope, {COVER} AS path, text FROM contexts")
def list_contexts(spark, d):
    return SCOPES.df(spark, d).select(F.coalesce("collection", F.lit("global")).alias("scope"), tx.context_path(F.col("prefix")).alias("path"), "text").orderBy("scope", "path")


@query("contexts_by_scope", with_(SCOPES) + "SELECT coalesce(collection, 'global') AS scope, count(*)::BIGINT AS n, list(text ORDER BY text) AS texts FROM contexts GROUP BY ALL")
def contexts_by_scope(spark, d):
    return SCOPES.df(spark, d).groupBy(F.coalesce("collection", F.lit("global")).alias("scope")).agg(F.count("*").alias("n"), F.array_sort(F.collect_list("text")).alias("texts"))


ROOTS = Fixture("roots", "root string, collection string", [("/work", "all"), ("/work/docs", "docs"), ("/work/docs/api", "api"), ("/other", "other")])
FS = Fixture("fs", "path string", [("/work/docs/api/x.md",), ("/work/docsx/y.md",), ("/work/docs",), ("/none/z.md",), ("/other/a/b/c",)]).over(path="number")


@query("collection_from_path", with_(ROOTS, FS) + "SELECT path, (SELECT collection FROM roots WHERE path = root OR starts_with(path, root || '/') ORDER BY length(root) DESC LIMIT 1) AS collection FROM fs")
def collection_from_path(spark, d):
    return st.longest_prefix(FS.df(spark, d), ROOTS.df(spark, d))


TARGETS = Fixture("targets", "target string", [("/",), ("index://notes/a/b",), ("index://notes",), ("docs/x",), ("",)]).over(target="number")


@query("parse_context_target", with_(TARGETS) + r"SELECT target, CASE WHEN target = '/' THEN 'global' WHEN regexp_matches(target, '^[a-z]+://[^/]+') THEN 'collection' ELSE 'path' END AS kind, nullif(regexp_extract(target, '^[a-z]+://([^/]+)', 1), '') AS collection, CASE WHEN regexp_matches(target, '^[a-z]+://[^/]+') THEN '/' || regexp_replace(target, '^[a-z]+://[^/]+/?', '') END AS path FROM targets")
def parse_context_target(spark, d):
    virtual = F.rlike("target", F.lit("^[a-z]+://[^/]+"))
    return TARGETS.df(spark, d).select(
        "target", F.when(F.col("target") == "/", "global").when(virtual, "collection").otherwise("path").alias("kind"), F.nullif(F.regexp_extract("target", "^[a-z]+://([^/]+)", 1), F.lit("")).alias("collection"),
        F.when(virtual, F.concat(F.lit("/"), F.regexp_replace("target", "^[a-z]+://[^/]+/?", ""))).alias("path"),
    )


PREVIEWS = Fixture("previews", "text string", [("short  text \n here",), ("x " * 90,), ("",)]).over(text="after")


@query("context_preview", with_(PREVIEWS, "p AS (SELECT text, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS q FROM previews)") + "SELECT text, CASE WHEN length(q) > 80 THEN substr(q, 1, 80) || '...' ELSE q END AS preview FROM p")
def context_preview(spark, d):
    return PREVIEWS.df(spark, d).select("text", tx.preview(F.col("text")).alias("preview"))


NAMES = Fixture("names", "name string", [("My Index/1",), ("plain",), ("Ü-x",), ("--a--",)]).over(name="tail")


@query("sanitize_names", with_(NAMES) + "SELECT name, lower(regexp_replace(name, '[^A-Za-z0-9]', '_', 'g')) AS index_name, regexp_replace(lower(regexp_replace(name, '[^A-Za-z0-9]', '-', 'g')), '^-+|-+$', '', 'g') AS id FROM names")
def sanitize_names(spark, d):
    return NAMES.df(spark, d).select("name", tx.sanitize(F.col("name"), "_").alias("index_name"), F.regexp_replace(tx.sanitize(F.col("name"), "-"), "^-+|-+$", "").alias("id"))


PATHS = Fixture("paths", "p string", [("notes/a.md:12",), ("notes/a.md",), ("/x",), ("notes/",), ("a/b/c.md:007",)]).over(p="prefix")


@query("parse_lookup", with_(PATHS) + r"SELECT p, try_cast(nullif(regexp_extract(p, ':(\d+)$', 1), '') AS BIGINT) AS line, nullif(split_part(p, '/', 1), '') AS collection, nullif(substr(p, strpos(p, '/') + 1), '') AS rest FROM paths")
def parse_lookup(spark, d):
    return PATHS.df(spark, d).select("p", tx.trailing_line(F.col("p")).alias("line"), F.nullif(F.substring_index("p", "/", 1), F.lit("")).alias("collection"), F.nullif(F.substring("p", F.instr("p", "/") + 1, F.lit(1 << 30)), F.lit("")).alias("rest"))


# ---- snapshots, manifests and change sets

SNAPS = "o AS (SELECT c_custkey::VARCHAR AS path, md5(c_name || c_acctbal::BIGINT::VARCHAR) AS hash FROM customer WHERE c_custkey % 10 <> 0), n AS (SELECT c_custkey::VARCHAR AS path, md5(c_name || c_acctbal::BIGINT::VARCHAR || CASE WHEN c_custkey % 9 = 1 THEN 'x' ELSE '' END) AS hash FROM customer WHERE c_custkey % 7 <> 0)"
DIFF = "diff AS (SELECT coalesce(o.path, n.path) AS path, CASE WHEN o.hash IS NULL THEN 'new' WHEN n.hash IS NULL THEN 'removed' WHEN o.hash = n.hash THEN 'unchanged' ELSE 'changed' END AS change FROM o FULL JOIN n ON o.path = n.path)"


def customer_snapshots(spark, d):
    base = table(spark, d, "customer").select("c_custkey", F.col("c_custkey").cast("string").alias("path"), F.concat("c_name", F.expr("cast(round(c_acctbal, 0) AS bigint)").cast("string")).alias("x"))
    old = base.where("c_custkey % 10 <> 0").select("path", F.md5("x").alias("hash"))
    new = base.where("c_custkey % 7 <> 0").select("path", F.md5(F.concat("x", F.when(F.col("c_custkey") % 9 == 1, "x").otherwise(""))).alias("hash"))
    return old, new


SNAPS = SNAPS.replace("c_acctbal::BIGINT", "round(c_acctbal, 0)::BIGINT")


@query("snapshot_diff", with_(SNAPS, DIFF) + "SELECT path, change FROM diff")
def snapshot_diff(spark, d):
    return st.snapshot_diff(*customer_snapshots(spark, d))


@query("snapshot_apply", with_(SNAPS) + "SELECT path, hash FROM n")
def snapshot_apply(spark, d):
    return ch.apply_snapshot(*customer_snapshots(spark, d))


@query("symmetric_difference", with_(SNAPS) + "SELECT path, 'cached' AS side FROM o WHERE path NOT IN (SELECT path FROM n) UNION ALL SELECT path, 'current' FROM n WHERE path NOT IN (SELECT path FROM o)")
def symmetric_difference(spark, d):
    old, new = customer_snapshots(spark, d)
    return ch.symmetric_difference(old.select("path"), new.select("path"))


@query("paths_in_both", with_(SNAPS) + "SELECT path FROM o INTERSECT SELECT path FROM n")
def paths_in_both(spark, d):
    old, new = customer_snapshots(spark, d)
    return old.select("path").intersect(new.select("path"))


@query("paths_gone", with_(SNAPS) + "SELECT path FROM o EXCEPT SELECT path FROM n")
def paths_gone(spark, d):
    old, new = customer_snapshots(spark, d)
    return old.select("path").subtract(new.select("path"))


@query("should_sync", with_(SNAPS) + "SELECT (SELECT count(*) FROM (SELECT path FROM o EXCEPT SELECT path FROM n)) + (SELECT count(*) FROM (SELECT path FROM n EXCEPT SELECT path FROM o)) > 0 AS set_changed, count(*)::BIGINT AS files FROM n")
def should_sync(spark, d):
    old, new = customer_snapshots(spark, d)
    changed = ch.symmetric_difference(old.select("path"), new.select("path")).agg((F.count("*") > 0).alias("set_changed"))
    return changed.join(F.broadcast(new.agg(F.count("*").alias("files"))))


MODULES = Fixture("modules", "agent string, input string", [("OverviewEditor", "src/main.rs"), ("OverviewEditor", "src/lib.rs"), ("KeyModulesInsight_core", "src/core"), ("Core Workflows", "docs/flow.md"), ("Custom", "tools/x.py"), ("DatabaseEditor", "db/schema.sql")]).over(input="number")
DIFFLINES = Fixture("lines", "line string", [("M\tsrc/core/a.rs",), ("A\tdb/schema.sql",), ("D\ttools/x.py",), ("R100\tdocs/flow.md\tdocs/new.md",), ("C\tother.txt",), ("bad line",)]).over(line="number")
ALIAS = "CASE WHEN contains(agent, 'KeyModulesInsight') THEN 'KeyModulesInsight' " + " ".join(f"WHEN agent IN ({', '.join(repr(x) for x in names)}) THEN '{to}'" for to, names in ch.AGENT_NAMES.items()) + " ELSE agent END"
CHANGED = r"""ch AS (SELECT trim(split_part(line, chr(9), 1)) AS st, line FROM lines WHERE contains(line, chr(9))),
  files AS (SELECT trim(split_part(line, chr(9), 2)) AS file, CASE WHEN st = 'A' THEN 'added' WHEN st = 'D' THEN 'removed' ELSE 'changed' END AS change FROM ch WHERE NOT starts_with(st, 'R')
    UNION ALL SELECT trim(split_part(line, chr(9), 2)), 'removed' FROM ch WHERE starts_with(st, 'R') UNION ALL SELECT trim(split_part(line, chr(9), 3)), 'added' FROM ch WHERE starts_with(st, 'R'))"""


@query("detect_changes", with_(DIFFLINES, CHANGED) + "SELECT file, change FROM files")
def detect_changes(spark, d):
    return ch.name_status(DIFFLINES.df(spark, d))


@query(
    "changed_agents",
    with_(MODULES, DIFFLINES, CHANGED, f"hit AS (SELECT f.file, {ALIAS} AS agent FROM files f JOIN modules m ON contains(f.file, m.input) OR contains(m.input, f.file))")
    + ", direct AS (SELECT agent FROM hit UNION SELECT unnest(['SystemContextResearcher', 'DomainModulesDetector']) FROM files WHERE file NOT IN (SELECT file FROM hit)) SELECT agent FROM direct UNION SELECT unnest(['Overview', 'Architecture', 'Workflow', 'Boundary', 'Database', 'KeyModulesInsight']) FROM direct WHERE regexp_matches(agent, 'Researcher|Detector|Analyzer|Insight')",
)
def changed_agents(spark, d):
    return ch.affected_agents(ch.name_status(DIFFLINES.df(spark, d)), MODULES.df(spark, d))


@query("rebuild_ratio", with_(MODULES, DIFFLINES, CHANGED) + "SELECT (SELECT count(*) FROM files)::BIGINT AS changes, count(DISTINCT input)::BIGINT AS tracked, (SELECT count(*) FROM files) / count(DISTINCT input)::DOUBLE > 0.3 AS full_rebuild FROM modules")
def rebuild_ratio(spark, d):
    return ch.rebuild(ch.name_status(DIFFLINES.df(spark, d)), MODULES.df(spark, d))


@query("manifest_modules", with_(MODULES) + "SELECT agent, count(*)::BIGINT AS n, sha256(string_agg(input, chr(10) ORDER BY input)) AS digest FROM modules GROUP BY agent")
def manifest_modules(spark, d):
    return ch.module_digests(MODULES.df(spark, d))


@query("normalize_agents", with_(MODULES) + f"SELECT DISTINCT agent, {ALIAS} AS name FROM modules")
def normalize_agents(spark, d):
    return MODULES.df(spark, d).select("agent", ch.agent_name(F.col("agent")).alias("name")).distinct()
