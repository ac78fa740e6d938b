"""Queries of scoring: documentation quality, candidate benchmarks, caches, model settings, answers of models."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import model as mo
from tessera.operators import bench as be
from tessera.operators import quality as qu
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


SECTIONS = Fixture("sections", "section string, content string", [
    ("Project Overview", "Built with Rust. See `src/main.rs`, `lib.rs` and `missing.py`. " + "More. " * 20 + "\nUses COBOL only.\n`CodeInsight` or `code_insight`, `to_string` and `ToString`."),
    ("Architecture Description", "short"),
    ("Core Workflows", "A framework of python steps in `src/core/engine.rs` and `docs/none.md`, `v1.rs`, `a=b.rs`, `site.com`. " + "Words go on. " * 10 + "id `Engine` `engine`"),
    ("Database Overview", "tables " * 30),
]).over(content="after")
PROJECT = Fixture("project", "path string", [("src/main.rs",), ("src/lib.rs",), ("src/core/engine.rs",), ("README.md",)]).over(path="prefix")


@query("completeness", with_(SECTIONS, "b AS (SELECT section, max(strlen(content)) AS n FROM sections GROUP BY section)") + "SELECT count(*) FILTER (section IN ('Project Overview', 'Architecture Description', 'Core Workflows', 'Boundary Interfaces', 'Database Overview') AND n >= 100)::BIGINT AS present, (4 + count(*) FILTER (section = 'Database Overview'))::BIGINT AS expected, count(*) FILTER (section IN ('Project Overview', 'Architecture Description', 'Core Workflows', 'Boundary Interfaces', 'Database Overview') AND n >= 100) / (4 + count(*) FILTER (section = 'Database Overview'))::DOUBLE AS score FROM b")
def completeness(spark, d):
    return qu.completeness(SECTIONS.df(spark, d))


SKIP = "contains(ref, '://') OR starts_with(ref, 'v') OR ends_with(ref, '.com') OR ends_with(ref, '.org') OR ends_with(ref, '.io')"
REFS = f"r AS (SELECT section, unnest(regexp_extract_all(content, '`([^`]+\\.[a-zA-Z]{{1,10}})`', 1)) AS ref FROM sections), ok AS (SELECT section, ref, ref IN (SELECT path FROM project) OR split_part(ref, '/', -1) IN (SELECT split_part(path, '/', -1) FROM project) AS valid FROM r WHERE NOT ({SKIP} OR contains(ref, '=')))"


@query("file_references", with_(SECTIONS, PROJECT, REFS) + "SELECT section, ref, valid FROM ok")
def file_references(spark, d):
    return qu.references(SECTIONS.df(spark, d), PROJECT.df(spark, d))


@query("reference_accuracy", with_(SECTIONS, PROJECT, REFS) + "SELECT count(*) FILTER (valid)::BIGINT AS good, count(*)::BIGINT AS checked, count(*) FILTER (valid) / count(*)::DOUBLE AS score FROM ok")
def reference_accuracy(spark, d):
    return qu.share(qu.references(SECTIONS.df(spark, d), PROJECT.df(spark, d)), "valid")


@query("freshness", with_(SECTIONS, PROJECT, f"r AS (SELECT section, unnest(regexp_extract_all(content, '`([a-zA-Z0-9_/\\\\.-]+\\.[a-zA-Z]{{1,10}})`', 1)) AS ref FROM sections), ok AS (SELECT section, ref, ref IN (SELECT path FROM project) AS fresh FROM r WHERE NOT ({SKIP}))") + "SELECT * FROM ok WHERE fresh OR contains(ref, '/') OR contains(ref, chr(92))")
def freshness(spark, d):
    return qu.freshness(SECTIONS.df(spark, d), PROJECT.df(spark, d))


@query("tech_grounding", with_(SECTIONS, "l AS (SELECT section, unnest(string_split(content, chr(10))) AS line FROM sections)") + "SELECT section, line, contains(lower(line), 'rust') OR contains(lower(line), 'python') AS grounded FROM l WHERE regexp_matches(line, '(?i)\\b(built with|uses|powered by|written in|framework|stack)\\b')")
def tech_grounding(spark, d):
    return qu.grounding(SECTIONS.df(spark, d), ["rust", "python"])


COHERE = "t AS (SELECT DISTINCT unnest(regexp_extract_all(content, '`([A-Za-z_][A-Za-z0-9_]{2,})`', 1)) AS term FROM sections), g AS (SELECT regexp_replace(lower(term), '[_-]', '', 'g') AS norm, list_sort(list(term)) AS variants FROM t GROUP BY 1), k AS (SELECT * FROM g WHERE NOT (len(variants) = 2 AND len(list_filter(variants, lambda v: regexp_matches(v, '^(to|as|into|from|try_from|try_into)_'))) > 0 AND len(list_filter(variants, lambda v: regexp_matches(v, '^[A-Z]'))) > 0))"


@query("coherence", with_(SECTIONS, COHERE) + "SELECT norm, variants FROM k")
def coherence(spark, d):
    return qu.coherence(SECTIONS.df(spark, d))


@query("coherence_score", with_(SECTIONS, COHERE) + "SELECT count(*) FILTER (len(variants) = 1)::BIGINT AS good, count(*)::BIGINT AS checked, count(*) FILTER (len(variants) = 1) / count(*)::DOUBLE AS score FROM k")
def coherence_score(spark, d):
    return qu.share(qu.coherence(SECTIONS.df(spark, d)).withColumn("one", F.size("variants") == 1), "one")


SYMBOLS = Fixture("symbols", "symbol string", [("CodeInsight",), ("id",), ("to",), ("Engine",), ("never_there",), ("",), ("steps",), ("Engine",)])
FOUND = "f AS (SELECT symbol, bool_or(CASE WHEN strlen(symbol) <= 4 THEN regexp_matches(content, '(?:^|[^\\p{L}\\p{N}_])' || symbol || '(?:$|[^\\p{L}\\p{N}_])') ELSE contains(content, symbol) END) AS found FROM (SELECT DISTINCT symbol FROM symbols WHERE symbol <> ''), sections GROUP BY symbol)"


@query("symbol_coverage", with_(SECTIONS, SYMBOLS, FOUND) + "SELECT symbol, found FROM f")
def symbol_coverage(spark, d):
    return qu.symbol_coverage(SYMBOLS.df(spark, d), SECTIONS.df(spark, d))


FILECOVER = "c AS (SELECT path, bool_or(contains(lower(content), lower(path)) OR contains(lower(content), lower(split_part(path, '/', -1)))) AS found FROM project, sections GROUP BY path)"


@query("representation", with_(SECTIONS, PROJECT, SYMBOLS, FOUND, FILECOVER) + "SELECT round(0.6::DOUBLE * (SELECT avg(found::INT) FROM c) + 0.4::DOUBLE * (SELECT avg(found::INT) FROM f), 6) AS score")
def representation(spark, d):
    files = qu.share(qu.file_coverage(PROJECT.df(spark, d), SECTIONS.df(spark, d)), "found").select(F.col("score").alias("a"))
    symbols = qu.share(qu.symbol_coverage(SYMBOLS.df(spark, d), SECTIONS.df(spark, d)), "found").select(F.col("score").alias("b"))
    return files.join(F.broadcast(symbols)).select(F.round(qu.FILE_SHARE * F.col("a") + qu.SYMBOL_SHARE * F.col("b"), 6).alias("score"))


@query("file_coverage", with_(SECTIONS, PROJECT, FILECOVER) + "SELECT path, found FROM c")
def file_coverage(spark, d):
    return qu.file_coverage(PROJECT.df(spark, d), SECTIONS.df(spark, d))


FINDINGS = Fixture("findings", "severity string, category string, section string", [("error", "a", "S1")] * 8 + [("warning", "b", "S1"), ("warning", "b", "S2"), ("info", "c", "S3"), ("error", "a", None), ("error", "d", "S2")]).over(section="tag")


@query("section_scores", with_(FINDINGS, "g AS (SELECT section, count(*) FILTER (severity = 'error')::BIGINT AS errors, count(*) FILTER (severity = 'warning')::BIGINT AS warnings FROM findings WHERE section IS NOT NULL GROUP BY section)") + "SELECT section, errors, warnings, round(greatest(0.0::DOUBLE, 1.0 - 0.15::DOUBLE * errors - 0.05::DOUBLE * warnings), 6) AS score FROM g WHERE errors + warnings > 0")
def section_scores(spark, d):
    return qu.section_scores(FINDINGS.df(spark, d))


@query("finding_counts", with_(FINDINGS) + "SELECT count(*) FILTER (severity = 'error')::BIGINT AS errors, count(*) FILTER (severity = 'warning')::BIGINT AS warnings FROM findings")
def finding_counts(spark, d):
    return FINDINGS.df(spark, d).agg(F.count_if(F.col("severity") == "error").alias("errors"), F.count_if(F.col("severity") == "warning").alias("warnings"))


SCORES = Fixture("scores", "run string, sections double, symbols double, representation double, accuracy double, freshness double, grounding double, coherence double, helpfulness double", [(f"r{i}", *[round((i * k * 7 % 10) / 10, 2) for k in range(1, 9)]) for i in range(1, 6)]).over(run="tag", accuracy="unit", freshness="unit")
OVERALL = "round(0.2::DOUBLE * (sections * 0.5::DOUBLE + symbols * 0.3::DOUBLE + representation * 0.2::DOUBLE) + accuracy * 0.2::DOUBLE + freshness * 0.1::DOUBLE + grounding * 0.2::DOUBLE + coherence * 0.15::DOUBLE + helpfulness * 0.15::DOUBLE, 6)"


@query("quality_overall", with_(SCORES) + f"SELECT run, {OVERALL} AS overall FROM scores")
def quality_overall(spark, d):
    return qu.overall(SCORES.df(spark, d))


@query("regression_gate", with_(SCORES, f"o AS (SELECT run, {OVERALL} AS overall FROM scores)", "w AS (SELECT *, lag(overall) OVER (ORDER BY run) AS baseline FROM o)") + "SELECT run, overall, baseline, coalesce(baseline - overall > 0.05, false) AS regressed FROM w")
def regression_gate(spark, d):
    from pyspark.sql import Window

    base = F.lag("overall").over(Window.orderBy("run"))  # a row per run
    return qu.overall(SCORES.df(spark, d)).withColumn("baseline", base).withColumn("regressed", F.coalesce(F.col("baseline") - F.col("overall") > 0.05, F.lit(False)))


BROKEN = Fixture("pages_", "path string, body string", [("d/a.md", "see `src/main.rs`\nand `src/gone.rs` or `plain`\n`x/y`"), ("d/b.md", "nothing")]).over(path="prefix", body="after")


@query("broken_references", with_(BROKEN, PROJECT, "l AS (SELECT path, i, string_split(body, chr(10))[i] AS text FROM (SELECT path, body, unnest(range(1, len(string_split(body, chr(10))) + 1)) AS i FROM pages_))", "r AS (SELECT path, i::BIGINT AS line, unnest(regexp_extract_all(text, '`([^`]+)`', 1)) AS ref FROM l)") + "SELECT * FROM r WHERE contains(ref, '/') AND ref NOT IN (SELECT path FROM project)")
def broken_references(spark, d):
    return qu.broken_references(BROKEN.df(spark, d), PROJECT.df(spark, d))


ANSWERS = Fixture("answers", "k int, a string", [(1, '[4, 5, 3]'), (2, 'scores: [1,2]'), (3, 'none'), (4, '[9, 2, 4]'), (5, '[5]')]).over(k="shift", a="tail")


@query("helpfulness_parse", with_(ANSWERS, "n AS (SELECT k, list_filter(list_transform(string_split(regexp_extract(a, '\\[([^\\]]*)\\]', 1), ','), lambda x: try_cast(trim(x) AS DOUBLE)), lambda x: x BETWEEN 1 AND 5) AS v FROM answers)") + "SELECT k, CASE WHEN len(v) >= 2 THEN round((list_avg(v) - 1) / 4, 6) END AS score FROM n")
def helpfulness_parse(spark, d):
    values = F.filter(F.transform(F.split(F.regexp_extract("a", r"\[([^\]]*)\]", 1), ","), lambda x: F.trim(x).try_cast("double")), lambda x: x.between(1, 5))
    mean = F.aggregate("v", F.lit(0.0), lambda s, x: s + x) / F.size("v")
    return ANSWERS.df(spark, d).select("k", values.alias("v")).select("k", F.when(F.size("v") >= 2, F.round((mean - 1) / 4, 6)).alias("score"))


REVIEWS = Fixture("reviews", "k int, j string", [(1, '{"accuracy": 4, "clarity": 5, "depth": 3}'), (2, '{"accuracy": 1}'), (3, "{}")]).over(k="shift")


@query("review_scores", with_(REVIEWS, "m AS (SELECT k, (coalesce(json_extract(j, '$.accuracy')::DOUBLE, 3) + coalesce(json_extract(j, '$.clarity')::DOUBLE, 3) + coalesce(json_extract(j, '$.depth')::DOUBLE, 3)) / 3 AS m FROM reviews)") + "SELECT k, round(greatest(0, least(1, (m - 1) / 4)), 6) AS score, (m - 1) / 4 >= 0.6 AS accepted FROM m")
def review_scores(spark, d):
    g = lambda key: F.coalesce(F.get_json_object("j", f"$.{key}").cast("double"), F.lit(3.0))
    score = ((g("accuracy") + g("clarity") + g("depth")) / 3 - 1) / 4
    return REVIEWS.df(spark, d).select("k", F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)), 6).alias("score"), (score >= 0.6).alias("accepted"))


OUTPUTS = Fixture("outputs", "k int, t string", [(1, '{"a": 1}'), (2, 'Sure!\n```json\n{"result": {"b": 2}}\n```\nbye'), (3, 'text {"data": [1, 2]} end'), (4, "no json"), (5, '  ["x"] ')]).over(k="shift", t="after")


@query("json_recovery", with_(OUTPUTS, "f AS (SELECT k, trim(t) AS a, regexp_extract(t, '(?s)```(?:json)?\\s*(.*?)\\s*```', 1) AS b, regexp_extract(t, '(?s)(\\{.*\\})', 1) AS c FROM outputs)") + "SELECT k, CASE WHEN json_valid(a) THEN a WHEN b <> '' AND json_valid(b) THEN b WHEN c <> '' AND json_valid(c) THEN c END AS json FROM f")
def json_recovery(spark, d):
    return OUTPUTS.df(spark, d).select("k", mo.recovered_json(F.col("t")).alias("json"))


ENVELOPES = Fixture("envelopes", "k int, j string", [(1, '{"result": "x"}'), (2, '{"data": 5}'), (3, '{"a": 1}'), (4, '{"output": "y", "z": 1}')]).over(k="shift")


@query("unwrap_envelope", with_(ENVELOPES) + "SELECT k, coalesce(json_extract_string(j, '$.result'), json_extract_string(j, '$.data'), json_extract_string(j, '$.output'), j) AS inner_json FROM envelopes")
def unwrap_envelope(spark, d):
    return ENVELOPES.df(spark, d).select("k", mo.unwrapped(F.col("j")).alias("inner_json"))


BYTES = Fixture("bytes_", "v string", [("3",), ("7.6",), ("300",), ("-2",), ("x",), (None,), ("",)]).over(v="number")


@query("byte_numbers", with_(BYTES) + "SELECT v, coalesce(greatest(0, least(255, round(try_cast(v AS DOUBLE)))), 0)::INT AS n, try_cast(nullif(v, '') AS DOUBLE) AS number FROM bytes_")
def byte_numbers(spark, d):
    return BYTES.df(spark, d).select("v", mo.byte_number(F.col("v")).alias("n"), F.nullif(F.col("v"), F.lit("")).try_cast("double").alias("number"))


JSONLISTS = Fixture("jl", "k int, j string", [(1, '["a", "b"]'), (2, "[]"), (3, '["x", "y", "z"]')]).over(k="shift")


@query("json_string_list", with_(JSONLISTS) + "SELECT k, json_extract_string(j, ['$[0]', '$[1]', '$[2]']) AS items FROM jl")
def json_string_list(spark, d):
    items = F.from_json("j", "array<string>")
    return JSONLISTS.df(spark, d).select("k", F.array(*[F.get(items, F.lit(i)) for i in range(3)]).alias("items"))


RANKS = Fixture("ranks", "k int, j string", [(1, '[{"idx": 0, "score": 0.5}, {"idx": 2, "score": 0.9}]'), (2, '[{"idx": 1, "score": 1.5}]')]).over(k="shift")


@query("json_rerank", with_(RANKS, "e AS (SELECT k, unnest(from_json(j, '[{\"idx\": \"INTEGER\", \"score\": \"DOUBLE\"}]')) AS x FROM ranks)") + "SELECT k, x.idx AS idx, round(0.62::DOUBLE * 0.5 + 0.38::DOUBLE * x.score, 6) AS score FROM e")
def json_rerank(spark, d):
    each = RANKS.df(spark, d).select("k", F.explode(F.from_json("j", "array<struct<idx:int,score:double>>")).alias("x"))
    return each.select("k", "x.idx", F.round(0.62 * F.lit(0.5) + 0.38 * F.col("x.score"), 6).alias("score"))


# ---- candidates

RUNS = "runs AS (SELECT event_type AS candidate, event_id % 7 <> 0 AS ok, abs(value) AS seconds, (event_id % 10) / 10.0::DOUBLE AS quality FROM events)"
STATS = """stats AS (SELECT candidate, round(avg(ok::INT), 6) AS success_rate, round(coalesce(avg(CASE WHEN ok THEN seconds END), 0), 6) AS avg_seconds,
  list_sort(list(seconds) FILTER (seconds IS NOT NULL))[round((count(seconds) - 1) * 0.95::DOUBLE)::INT + 1] AS p95_seconds, round(coalesce(avg(CASE WHEN ok THEN quality END), 0), 6) AS avg_quality FROM runs GROUP BY candidate)"""


def runs(spark, d):
    return table(spark, d, "events").select(F.col("event_type").alias("candidate"), (F.col("event_id") % 7 != 0).alias("ok"), F.abs("value").alias("seconds"), ((F.col("event_id") % 10) / 10.0).alias("quality"))


@query("candidate_stats", with_(RUNS, STATS) + "SELECT * FROM stats")
def candidate_stats(spark, d):
    return be.candidate_stats(runs(spark, d))


@query("promotion_gates", with_(RUNS, STATS) + "SELECT candidate, list_filter([CASE WHEN success_rate < 0.857 THEN 'success_rate' END, CASE WHEN avg_quality < 0.4498 THEN 'quality' END, CASE WHEN p95_seconds > 60 THEN 'p95' END], lambda x: x IS NOT NULL) AS failures FROM stats")
def promotion_gates(spark, d):
    return be.gates(be.candidate_stats(runs(spark, d)), 0.857, 0.4498, 60)


CANDS = Fixture("cands", "candidate string, quality double, seconds double, throughput double, memory double, success_rate double", [(f"c{i}", round((i * 13 % 10) / 10, 2), 1.0 + i * 7 % 5, 100.0 * (i * 3 % 7), 1.0 + i % 3, [1.0, 0.5, 0.0, 0.9][i % 4]) for i in range(9)]).over(candidate="tag", quality="unit")


def norm_sql(c: str) -> str:
    return f"(CASE WHEN abs(hi_{c} - lo_{c}) <= 2.220446049250313e-16 THEN 1.0 ELSE greatest(0.0, least(1.0, ({c} - lo_{c}) / (hi_{c} - lo_{c}))) END)::DOUBLE"


COMPOSITE = "e AS (SELECT *, " + ", ".join(f"{f}({c}) OVER () AS {n}_{c}" for c in ("seconds", "throughput", "memory") for n, f in (("lo", "min"), ("hi", "max"))) + f""" FROM cands),
  sc AS (SELECT candidate, quality >= 0.6 AND success_rate > 0 AS passed, round(CASE WHEN success_rate <= 0 THEN 0.0 ELSE (0.4::DOUBLE * quality + 0.2::DOUBLE * (1 - {norm_sql('seconds')}) + 0.15::DOUBLE * {norm_sql('throughput')} + 0.1::DOUBLE * (1 - {norm_sql('memory')}) + 0.15::DOUBLE * success_rate) * CASE WHEN quality >= 0.6 AND success_rate > 0 THEN 1.0 ELSE 0.5 END END::DOUBLE, 6) AS score FROM e)"""


@query("composite_scores", with_(CANDS, COMPOSITE) + "SELECT * FROM sc")
def composite_scores(spark, d):
    return be.composite(CANDS.df(spark, d))


@query("recommendation", with_(CANDS, COMPOSITE) + "SELECT * FROM sc WHERE score > 0 ORDER BY passed DESC, score DESC, candidate LIMIT 1")
def recommendation(spark, d):
    return be.recommendation(be.composite(CANDS.df(spark, d)))


@query(
    "benchmark_report",
    with_(CANDS, COMPOSITE, "rk AS (SELECT sc.*, c.quality, c.seconds, c.throughput, c.memory, c.success_rate, row_number() OVER (ORDER BY passed DESC, score DESC, candidate) AS r FROM sc JOIN cands c USING (candidate))")
    + """SELECT line_no, text FROM (VALUES (1::BIGINT, '# Benchmark report'), (2, ''), (3, '## Recommendation'), (5, '## Candidates'), (6, '| Rank | Candidate | Quality | Avg(s) | Throughput(B/s) | MemoryIdx | Success | Score |'), (7, '| --- | --- | ---: | ---: | ---: | ---: | ---: | ---: |')) v(line_no, text)
  UNION ALL SELECT 4, coalesce((SELECT printf('- `%s` score `%.3f`', candidate, round(score::DECIMAL(18, 6), 3)::DOUBLE) FROM sc WHERE score > 0 ORDER BY passed DESC, score DESC, candidate LIMIT 1), '- No recommendation available.')
  UNION ALL SELECT r + 7, printf('| %d | `%s` | %.1f%% | %.1f | %.1f | %.2f | %.0f%% | %.3f |', r, candidate, quality * 100, seconds, throughput, memory, success_rate * 100, round(score::DECIMAL(18, 6), 3)::DOUBLE) FROM rk""",
)
def benchmark_report(spark, d):
    rows = CANDS.df(spark, d)
    return be.report(be.composite(rows), rows)


@query("candidate_grid", "SELECT model, context, predict, top_p, lower(model) || '-ctx' || context::VARCHAR || '-np' || predict::VARCHAR || '-tp' || round(top_p * 100)::INT::VARCHAR AS id FROM (SELECT unnest(['A', 'B']) AS model), (SELECT unnest([4096, 8192])::BIGINT AS context), (SELECT unnest([512, 1024, 2048])::BIGINT AS predict), (SELECT unnest([0.85, 0.9])::DOUBLE AS top_p)")
def candidate_grid(spark, d):
    g = be.grid(spark, {"model": ["A", "B"], "context": [4096, 8192], "predict": [512, 1024, 2048], "top_p": [0.85, 0.9]})
    return g.withColumn("id", F.concat(F.lower("model"), F.lit("-ctx"), F.col("context").cast("string"), F.lit("-np"), F.col("predict").cast("string"), F.lit("-tp"), F.round(F.col("top_p") * 100).cast("int").cast("string")))


PROFILES = Fixture("profiles", "model string, size_bytes long, in_flight int, context int, predict int", [("a", 4 * 2**30, 2, 8192, 1024), ("b", None, 0, 32768, 2048), ("c", 100, 1, 4096, -1)]).over(model="tag", size_bytes="chars")


@query("memory_index", with_(PROFILES) + "SELECT model, round(greatest(coalesce(size_bytes / 1073741824.0::DOUBLE, 1.0), 0.5) * greatest(in_flight, 1) * (1 + 0.35::DOUBLE * context / 32768.0::DOUBLE + 0.15::DOUBLE * greatest(predict, 1) / 2048.0::DOUBLE), 6)::DOUBLE AS index FROM profiles")
def memory_index(spark, d):
    return PROFILES.df(spark, d).select("model", F.round(be.memory_index(*[F.col(c) for c in ("size_bytes", "in_flight", "context", "predict")]), 6).alias("index"))


WEIGHTS = Fixture("weights", "k int, w array<double>", [(1, [2.0, 1.0, 1.0]), (2, [0.0, 0.0, 0.0])]).over(k="shift")


@query("normalize_weights", with_(WEIGHTS) + "SELECT k, CASE WHEN list_sum(w) <= 2.220446049250313e-16 THEN [0.5, 0.3, 0.2]::DOUBLE[] ELSE list_transform(w, lambda x: x / list_sum(w)) END AS w FROM weights")
def normalize_weights(spark, d):
    total = F.aggregate("w", F.lit(0.0), lambda s, x: s + x)
    return WEIGHTS.df(spark, d).select("k", F.when(total <= 2.220446049250313e-16, F.array(F.lit(0.5), F.lit(0.3), F.lit(0.2))).otherwise(F.transform("w", lambda x: x / total)).alias("w"))


CSVS = Fixture("csvs", "v string", [("1, 2,3",), (" a ,,b",), ("",), ("7",)]).over(v="number")


@query("parse_lists", with_(CSVS) + "SELECT v, list_filter(list_transform(string_split(v, ','), lambda x: trim(x)), lambda x: x <> '') AS items, list_transform(list_filter(list_transform(string_split(v, ','), lambda x: trim(x)), lambda x: x <> ''), lambda x: try_cast(x AS INT)) AS numbers FROM csvs")
def parse_lists(spark, d):
    items = F.filter(F.transform(F.split("v", ","), lambda x: F.trim(x)), lambda x: x != "")
    return CSVS.df(spark, d).select("v", items.alias("items"), F.transform(items, lambda x: x.try_cast("int")).alias("numbers"))


# ---- caches, usage, models


@query("cache_report", "SELECT event_type AS category, count(*) FILTER (value > 50)::BIGINT AS hits, count(*) FILTER (value > 50 IS NOT TRUE)::BIGINT AS misses, round(count(*) FILTER (value > 50) / count(*)::DOUBLE, 6) AS hit_rate, sum(CASE WHEN value > 50 THEN event_id % 100 ELSE 0 END)::BIGINT AS tokens_saved FROM events GROUP BY event_type")
def cache_report(spark, d):
    e = table(spark, d, "events")  # a call without a figure is a miss
    return be.cache_report(e.select(F.col("event_type").alias("category"), F.coalesce(F.col("value") > 50, F.lit(False)).alias("hit"), (F.col("event_id") % 100).alias("tokens")))


@query("cache_ttl", "WITH m AS (SELECT max(ts) AS now FROM events), e AS (SELECT event_type AS category, user_id::VARCHAR AS hash, ts, event_id AS payload FROM events, m WHERE epoch(date_trunc('second', now)) - epoch(date_trunc('second', ts)) <= 240 * 3600) SELECT category, hash, max(ts) AS ts FROM e GROUP BY category, hash")
def cache_ttl(spark, d):
    e = table(spark, d, "events").select(F.col("event_type").alias("category"), F.col("user_id").cast("string").alias("hash"), "ts", F.col("ts").alias("payload"))
    now = e.agg(F.max("ts").alias("now"))
    return be.fresh(e.join(F.broadcast(now)), F.col("now"), 240).withColumnRenamed("payload", "ts")


@query("cache_lookup", "SELECT doc_id, md5(text) AS key, doc_id % 3 = 0 AS cached FROM documents")
def cache_lookup(spark, d):
    t = table(spark, d, "documents").select("doc_id", F.md5("text").alias("key"))
    cached = t.where("doc_id % 3 = 0").select("doc_id", F.lit(True).alias("hit"))
    return t.join(cached, "doc_id", "left").select("doc_id", "key", F.coalesce("hit", F.lit(False)).alias("cached"))


@query("coalesced_requests", "SELECT md5(text) AS key, count(*)::BIGINT AS waiting, min(doc_id) AS leader FROM documents GROUP BY text")
def coalesced_requests(spark, d):
    return table(spark, d, "documents").groupBy(F.md5("text").alias("key")).agg(F.count("*").alias("waiting"), F.min("doc_id").alias("leader"))


@query("cost_counters", "SELECT event_type AS category, coalesce(sum(floor(abs(value) * 0.01::DOUBLE * 1000)), 0)::BIGINT AS milli FROM events GROUP BY event_type")
def cost_counters(spark, d):
    milli = F.coalesce(F.sum(F.floor(F.abs("value") * 0.01 * 1000)).cast("long"), F.lit(0).cast("long"))
    return table(spark, d, "events").groupBy(F.col("event_type").alias("category")).agg(milli.alias("milli"))


@query("timing_pivot", "SELECT user_id % 5 AS bucket, coalesce(count(*) FILTER (event_type = 'click'), 0)::BIGINT AS click, coalesce(count(*) FILTER (event_type = 'view'), 0)::BIGINT AS view FROM events GROUP BY 1")
def timing_pivot(spark, d):
    e = table(spark, d, "events").select((F.col("user_id") % 5).alias("bucket"), "event_type")
    return e.groupBy("bucket").pivot("event_type", ["click", "view"]).count().na.fill(0)


@query("phase_shares", "WITH t AS (SELECT event_type, sum(abs(value)) AS s FROM events GROUP BY event_type) SELECT event_type, round(s / (SELECT sum(s) FROM t), 6) AS share FROM t")
def phase_shares(spark, d):
    t = table(spark, d, "events").groupBy("event_type").agg(F.sum(F.abs("value")).alias("s"))
    return t.join(F.broadcast(t.agg(F.sum("s").alias("all")))).select("event_type", F.round(F.col("s") / F.col("all"), 6).alias("share"))


MODELS = Fixture("models", "model string, attempt int", [("gemma3:12b", 1), ("qwen2.5-coder:7b", 2), ("qwen3:14b", 3), ("qwen3:72b", 4), ("llama3.1", 5), ("codellama:13b", 9), ("mistral", 0), ("unknown", 1), ("phi4", 7), ("DeepSeek-r1:8b", 2)]).over(model="tag")
WINDOW = "CASE WHEN regexp_matches(lower(model), '^(gemma3|gemma-3|gemma2)') THEN 131072 WHEN regexp_matches(lower(model), '^(qwen2.5|qwen-2.5|qwen3)') THEN CASE WHEN n <= 8 THEN 32768 WHEN n <= 14 THEN 65536 ELSE 131072 END WHEN regexp_matches(lower(model), '^(llama3|llama-3|deepseek|phi)') THEN 131072 WHEN starts_with(lower(model), 'codellama') THEN 16384 WHEN regexp_matches(lower(model), '^(mistral|mixtral)') THEN 32768 ELSE 32768 END"
SIZED = "m AS (SELECT *, try_cast(nullif(regexp_extract(lower(model), '(?:^|[^a-z0-9])([0-9]+)b(?:[^a-z0-9]|$)', 1), '') AS INT) AS n FROM models)"


@query("context_windows", with_(MODELS, SIZED) + f"SELECT model, {WINDOW}::INT AS context_window FROM m")
def context_windows(spark, d):
    return MODELS.df(spark, d).select("model", mo.context_window(F.col("model")).alias("context_window"))


@query("retry_delays", with_(MODELS) + "SELECT model, least(500 * pow(2, least(greatest(attempt - 1, 0), 6)), 15000)::BIGINT AS delay_ms FROM models")
def retry_delays(spark, d):
    return MODELS.df(spark, d).select("model", mo.retry_delay(F.lit(500), F.col("attempt")).alias("delay_ms"))


@query("request_windows", "SELECT conv_id, turn, greatest(least(4096, 32768), least((ceil((ceil(est * 1.0) + 2048 + 512) / 1024.0) * 1024)::BIGINT, 32768))::BIGINT AS num_ctx FROM (SELECT conv_id, turn, (ceil((length(text) - length(regexp_replace(text, '[\\x00-\\x7F]', '', 'g'))) / 4.0) + ceil(length(regexp_replace(text, '[\\x00-\\x7F]', '', 'g')) / 4.0) + 50) AS est FROM conversations)")
def request_windows(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", mo.request_window(F.col("text"), F.lit(32768)).alias("num_ctx"))


@query("model_choice", "SELECT doc_id, CASE WHEN strlen(text) <= 8000 THEN 'efficient' ELSE 'powerful' END AS model FROM documents")
def model_choice(spark, d):
    return table(spark, d, "documents").select("doc_id", F.when(F.octet_length("text") <= 8000, "efficient").otherwise("powerful").alias("model"))


LOCAL = Fixture("local_", "model string, pos long", [("phi3:mini", 0), ("llama3:8b", 1), ("qwen2.5:7b", 2), ("Llama3:8b", 3)]).over(model="tag", pos="shift")


@query("local_models", with_(LOCAL) + "SELECT lower(model) AS key, arg_min(model, pos) AS model FROM local_ GROUP BY lower(model)")
def local_models(spark, d):
    return LOCAL.df(spark, d).groupBy(F.lower("model").alias("key")).agg(F.min_by("model", "pos").alias("model"))


@query("best_local_model", with_(LOCAL) + "SELECT arg_min(model, (CASE WHEN contains(lower(model), 'qwen') THEN 0 WHEN contains(lower(model), 'llama') THEN 1 ELSE 2 END, pos)) AS model FROM local_")
def best_local_model(spark, d):
    rank = F.when(F.contains(F.lower("model"), F.lit("qwen")), 0).when(F.contains(F.lower("model"), F.lit("llama")), 1).otherwise(2)
    return LOCAL.df(spark, d).agg(F.min_by("model", F.struct(rank.alias("r"), "pos")).alias("model"))


@query("cache_signature", "SELECT event_id, md5(concat_ws('|', event_type, user_id::VARCHAR, event_id::VARCHAR)) AS signature FROM events")
def cache_signature(spark, d):
    return table(spark, d, "events").select("event_id", F.md5(F.concat_ws("|", "event_type", F.col("user_id").cast("string"), F.col("event_id").cast("string"))).alias("signature"))


@query("format_times", "SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS label FROM events")
def format_times(spark, d):
    return table(spark, d, "events").select("event_id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("label"))


@query("telemetry_report", "SELECT event_type AS mode, count(*)::BIGINT AS searches, round(avg(value), 6) AS mean_ms, max(value) AS most_ms FROM events GROUP BY event_type")
def telemetry_report(spark, d):
    return table(spark, d, "events").groupBy(F.col("event_type").alias("mode")).agg(F.count("*").alias("searches"), F.round(F.avg("value"), 6).alias("mean_ms"), F.max("value").alias("most_ms"))
