"""Chunkers, store steps, sources, sinks and streams."""

import math
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st_
from pyspark.sql import functions as F

from tessera.functions import code as co
from tessera.functions import text as tx
from tessera.functions import vector as vec
from tessera.operators import bench as be
from tessera.operators import fulltext as ft
from tessera.operators import search as se
from tessera.operators import store as st
from tessera.operators import textual as te
from tessera.sources import files as fs
from tessera.streaming import ingest as ig

SF = "/root/testdata/sf0.001"
ALPHA = "# Rust Ownership\n\nThe borrow checker enforces aliasing rules."
BETA = "# Search Tuning\n\nFalse positives and false negatives can be balanced."


@pytest.fixture(scope="module")
def two(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("notes")
    (root / "alpha.md").write_text(ALPHA)
    (root / "sub").mkdir()
    (root / "sub" / "beta.md").write_text(BETA)
    (root / "skip.txt").write_text("not taken")
    return root


def stored(rows):
    return rows.withColumn("id", F.monotonically_increasing_id()).withColumn("active", F.lit(True))


def test_collection_is_searched_by_words_vectors_and_both(spark, two):
    rows = fs.collection(spark, "notes", str(two))
    got = {r["path"]: r["title"] for r in rows.collect()}
    assert got == {"alpha.md": "Rust Ownership", "sub/beta.md": "Search Tuning"}
    own = stored(rows)
    assert se.lexical(own, "borrow checker").first()["file"] == "notes/alpha.md"
    assert se.vector_hashed(own, "ownership aliasing rules").first()["file"] == "notes/alpha.md"
    assert se.hybrid(own, "how does rust ownership work").first()["file"] == "notes/alpha.md"
    assert se.lexical(own, "").count() == 0
    assert se.lexical_or_fallback(own, "sub/be").first()["file"] == "notes/sub/beta.md"


def test_update_and_delete(spark):
    keyed = lambda rows: spark.createDataFrame(rows, "collection string, path string, hash string")
    old = keyed([("n", "a.md", "1"), ("n", "b.md", "2"), ("n", "c.md", "3")]).withColumn("active", F.col("path") != "c.md")
    merged = st.merge(keyed([("n", "a.md", "9"), ("n", "c.md", "3"), ("n", "d.md", "4")]), old)
    assert {r["path"]: r["status"] for r in merged.collect()} == {"a.md": "updated", "b.md": "deactivated", "c.md": "reactivated", "d.md": "inserted"}
    assert tuple(st.report(merged).first()) == (1, 1, 1, 1)
    again = st.apply_merge(keyed([("n", "a.md", "9")]), old)
    assert {r["path"] for r in again.where("active").collect()} == {"a.md"}


@pytest.mark.parametrize("pattern, yes, no", [("**/*.md", ["a.md", "x/y/a.md"], ["a.txt"]), ("src/*.rs", ["src/a.rs"], ["src/b/a.rs"]), ("a?.md", ["ab.md"], ["a/.md", "abc.md"]), ("**", ["any/thing"], [])])
def test_glob(spark, pattern, yes, no):
    rows = spark.createDataFrame([(p,) for p in yes + no], "p string")
    assert {r["p"] for r in rows.where(F.rlike("p", F.lit(st.glob_pattern(pattern)))).collect()} == set(yes)


def test_sources_and_sinks(spark, two, tmp_path):
    assert {r["path"]: r["size"] for r in fs.scan(spark, str(two)).collect()}["skip.txt"] == 9
    assert {r["path"] for r in fs.snapshot(spark, str(two)).collect()} == {"alpha.md", "sub/beta.md", "skip.txt"}
    assert {r["kind"] for r in fs.supported_documents(spark, str(two)).collect()} == {"markdown", "text"}
    fs.append_telemetry(spark, str(tmp_path / "t"), "lexical", "q", 10, 3, 0.0)
    fs.append_telemetry(spark, str(tmp_path / "t"), "vector", "q", 10, 0, 0.0)
    assert fs.read_telemetry(spark, str(tmp_path / "t")).count() == 2
    findings = spark.createDataFrame([("error", "a", "m", None)], fs.FINDINGS)
    fs.write_report(findings, {"overall": 0.5}, str(tmp_path / "r"))
    back, scores = fs.read_report(spark, str(tmp_path / "r"))
    assert back.count() == 1 and scores == {"overall": 0.5}
    fs.quality_gate(0.5, 0.5)
    with pytest.raises(ValueError):
        fs.quality_gate(0.4, 0.5)
    (tmp_path / "bad.json").write_text('{"file": "a"}\nnot json\n')
    with pytest.raises(Exception):
        fs.matches(spark, str(tmp_path / "bad.json")).collect()


def test_configuration():
    config = fs.add_context(fs.add_collection({}, "a", "/x"), "about", "a", "docs")
    assert config["collections"]["a"]["context"] == {"docs": "about"}
    assert set(fs.rename_collection(config, "a", "b")["collections"]) == {"b"}
    assert fs.remove_context(fs.add_context(config, "all")) == config
    with pytest.raises(ValueError):
        fs.rename_collection(fs.add_collection(config, "b", "/y"), "a", "b")
    with pytest.raises(KeyError):
        fs.remove_collection(config, "z")


def test_stream_keeps_the_last_version(spark, tmp_path):
    (tmp_path / "in").mkdir()
    line = lambda p, b, t: f'{{"collection": "n", "path": "{p}", "body": "{b}", "ts": "{t}"}}\n'
    (tmp_path / "in" / "1.json").write_text(line("a.md", "one", "2024-01-01T00:00:00Z") + line("a.md", "two", "2024-01-02T00:00:00Z") + line("b.md", "b", "2024-01-01T00:00:00Z"))
    for body in ("three", "three"):
        ig.start(spark, str(tmp_path / "in"), str(tmp_path / "store"), str(tmp_path / "c")).awaitTermination()
        (tmp_path / "in" / "2.json").write_text(line("a.md", body, "2024-01-03T00:00:00Z"))
    ig.start(spark, str(tmp_path / "in"), str(tmp_path / "store"), str(tmp_path / "c")).awaitTermination()
    assert {r["path"]: r["body"] for r in ig.current(spark, str(tmp_path / "store")).collect()} == {"a.md": "three", "b.md": "b"}


@settings(max_examples=100, deadline=None)
@given(st_.lists(st_.sampled_from(["# A", "## B", "### C", "text é", "", "more words here"]), max_size=25), st_.integers(8, 60))
def test_markdown_chunks_lose_nothing(found, size):
    body = "\n".join(found)
    chunks = list(te.markdown_chunks(body, size, 0))
    whole = "".join(c for c, _ in chunks)
    assert whole.strip() == "".join(x + "\n" for x in body.splitlines()).strip()
    for content, _ in chunks[1:]:
        assert "\n# " not in content


def test_chunk_sections_and_objects():
    assert [s for _, s in te.markdown_chunks("# A\nx\n## B\ny\n### C\nz\n# D\n", 1, 99)] == ["A", "A > B", "A > B > C", "D"]
    found = list(te.sql_chunks("CREATE TABLE a (x INT);\nINSERT INTO a VALUES (1);\ncreate view \"v\" as select 1;\n", 5, 0))
    assert [s for _, s in found] == ["a", "a", "v"]
    assert [c for c, _ in te.paragraph_chunks("aa\n\nbb\n\ncc", 5, 1)] == ["aa\n\nbb", "b\n\ncc"]
    assert list(te.paragraph_chunks("", 5, 1)) == []


def test_fixed_chunks_cover_the_text(spark):
    rows = spark.createDataFrame([(1, "abcdefghij" * 3), (2, ""), (3, "abc")], "id int, body string")
    got = [tuple(r) for r in te.chunk_fixed(rows, 12, 2).orderBy("id", "chunk_index").collect()]
    assert [r[3] for r in got if r[0] == 1] == [("abcdefghij" * 3)[i : i + 12] for i in (0, 10, 20)]
    assert [r for r in got if r[0] != 1] == [(3, 0, 1, "abc")]


def test_percentile_is_the_nearest_rank(spark):
    rng = random.Random(1)
    rows = [(c, rng.random() > 0.2, float(rng.randint(0, 50)), rng.random()) for c in "abc" for _ in range(rng.randint(1, 80))]
    got = {r["candidate"]: r for r in be.candidate_stats(spark.createDataFrame(rows, "candidate string, ok boolean, seconds double, quality double")).collect()}
    for c in "abc":
        own = sorted(s for k, _, s, _ in rows if k == c)
        assert got[c]["p95_seconds"] == own[math.floor((len(own) - 1) * 0.95 + 0.5)]


def test_comments_go_and_literals_stay(spark):
    rows = spark.createDataFrame([('let a = "// kept"; // gone\nlet b = 1; /* gone\n too */ c', "x = '# kept'  # gone\n\"\"\"doc # kept\"\"\"\n")], "c string, p string")
    got = rows.select(co.without_comments(F.col("c"), co.C_COMMENTS), co.without_comments(F.col("p"), co.PYTHON_COMMENTS)).first()
    assert got[0] == 'let a = "// kept";\nlet b = 1;  c' and got[1].startswith("x = '# kept'\n\"\"\"doc # kept\"\"\"")


def test_lines_and_titles(spark):
    rows = spark.createDataFrame([("a/b.md", "x\n\n# T \ny\r\n"), ("a/b.md", ""), ("a/b.md", "ab\n")], "path string, body string")
    got = rows.select(tx.lines(F.col("body")), tx.title(F.col("path"), F.col("body"))).collect()
    assert [r[0] for r in got] == [["x", "", "# T ", "y"], [], ["ab"]]
    assert [r[1] for r in got] == ["T", "b.md", "b.md"]


def test_hybrid_keeps_the_best_hit_of_a_document(spark):
    hits = spark.createDataFrame([("a", "a", 0.5), ("b", "b", 0.7), ("a", "a", 0.9), ("x", "x", 0.4)], "id string, file string, score double")
    assert {r["id"]: r["score"] for r in se.dedup_hits(hits).collect()} == {"a": 0.9, "b": 0.7, "x": 0.4}


def test_bands_fall_back_to_everything(spark):
    bands = spark.createDataFrame([("h1", 0, 5), ("h1", 1, 6), ("h2", 0, 7)], "hash string, band int, bucket bigint")
    near = lambda rows: {r["hash"] for r in se.band_candidates(bands, spark.createDataFrame(rows, "band int, bucket bigint")).collect()}
    assert near([(0, 7)]) == {"h2"} and near([(0, 99)]) == {"h1", "h2"}


def test_prompt_parts_are_whole(spark):
    from tessera.operators import textual

    long = "".join(f"# H{i}\n" + f"word{i} " * 500 + "\n" for i in range(6))
    rows = [(1, "c", "en/1.md", "x" * 5000), (2, "c", "en/2.md", long), (3, "e", "en/3.md", "")]
    got = sorted(((r["collection"], r["id"] or 0, r["part_no"], r["part"]) for r in textual.prompt_parts(spark.createDataFrame(rows, "id long, collection string, path string, body string")).collect()))
    assert [g[:3] for g in got if g[1] != 2] == [("c", 0, 0), ("c", 1, 1), ("e", 0, 0), ("e", 3, 1)]
    assert got[1][3] == "\n---\n\n## 1.md\n\n**Source:** en/1.md\n**Type:** Markdown\n\n" + "x" * 5000 + "\n\n"
    parts = [g for g in got if g[1] == 2]
    n = len(parts)
    assert n > 1 and all(f"(Part {i + 1}/{n})" in p[3] and f"**Chunk:** {i + 1}/{n}\n" in p[3] for i, p in enumerate(parts))
    assert all(sum(p[3].count(f"word{i} ") for p in parts) >= 500 for i in range(6))


def test_supplementary_texts_in_order_with_their_limit(spark):
    from tessera.operators import textual

    def trimmed(body):
        out, fenced = "", False
        for x in body.splitlines()[:500]:
            if x.startswith("```"):
                fenced = not fenced
            elif not fenced and x.strip():
                out += x + "\n"
        return out

    bodies = {"docs/README.md": "# Guide\n\n" + "line éa\n" * 700, "CLAUDE.md": "rules\n```sh\ncode\n```\n\n  ```\nmore", "CONTRIBUTING.md": "a" + "é" * 2500, "other.md": "no"}
    rows = [("p", k, v) for k, v in bodies.items()] + [("q", "CLAUDE.md", " \n"), ("r", "CLAUDE.md", None), ("s", "CLAUDE.md", "日" * 1334)]
    got = {r["project"]: r["context"] for r in textual.supplementary(spark.createDataFrame(rows, "project string, path string, body string")).collect()}

    def part(path, body):
        text = trimmed(body)
        cut = text.encode()[:4000].decode("utf-8", "ignore") + "...(truncated)" if len(text.encode()) > 4000 else text
        return f"#### From {path}\n{cut}\n\n"

    assert got == {"p": "".join(part(k, bodies[k]) for k in ("CLAUDE.md", "CONTRIBUTING.md", "docs/README.md")), "s": part("CLAUDE.md", "日" * 1334)}
    assert got["p"].count("...(truncated)") == 1 + (len(trimmed(bodies["docs/README.md"]).encode()) > 4000)


def test_queries_keep_texts_with_a_last_line_end(spark, tmp_path):
    from tessera.plans import registry

    rows = [(1, "one\neau two\nthree\n", "en", "s"), (2, "x\r\neau\r\n", "en", "s"), (3, "", "en", "s"), (4, None, "en", "s")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    run = lambda name: registry.queries()[name](spark, str(tmp_path)).collect()
    assert sorted((r["path"], r["line_no"], r["content"], r["after"]) for r in run("line_search")) == [("en/1.md", 2, "eau two", "three"), ("en/2.md", 2, "eau", None)]
    assert {r["path"] for r in run("file_search")} == {"en/1.md", "en/2.md"}
    assert {r["doc_id"]: r["part"] for r in run("slice_lines")} == {1: "eau two\nthree", 2: "eau", 3: "", 4: None}
    assert {r["id"]: r["body"] for r in run("supplementary_docs")} == {1: "one\neau two\nthree", 2: "x\neau", 3: "", 4: ""}
    assert [(r["n_lines"], r["bytes"]) for r in run("source_text_lines")] == [(4 + 3 + 1, 15 + 4)]


QUESTIONS = ["the and", "Tion of that", "config eau les", "en/1", "zzzqqq", "a", "++", "der die", "Th", "of THE house, and more of the same"]


def test_stored_searches_agree_with_those_over_bodies(spark):
    from tessera.plans import search as ps

    rows, content, held, terms, vectors, bands = ps.stored(spark, SF)
    whole = ps.store(spark, SF)
    for limit, collection in ((10, None), (3, "src1")):
        want = sorted(map(tuple, se.lexical_many(whole, QUESTIONS, limit, 0.0, collection).collect()))
        assert sorted(map(tuple, se.lexical_stored_many(rows, content, held, terms, QUESTIONS, limit, 0.0, collection).collect())) == want
    stored_vectors = {r["hash"]: list(r["qvec"]) for r in vectors.collect()}
    stored_bands = {(r["hash"], r["band"], r["bucket"]) for r in bands.collect()}
    for h, v in list(stored_vectors.items())[:5]:
        assert {(h, b, u) for b, u in vec.query_bands(v)} == {x for x in stored_bands if x[0] == h}
    asked = spark.createDataFrame(list(enumerate(QUESTIONS)), "hash int, body string")
    made = {r["hash"]: list(r["qvec"]) for r in vec.hashed_vectors(asked).select("hash", vec.quantized(F.col("vec")).alias("qvec")).collect()}
    for i, q in enumerate(QUESTIONS):
        assert vec.query_vector(q) == made.get(i, [0] * vec.DIM)
    got = se.vector_stored_many(rows, vectors, bands, held, terms, QUESTIONS, 5).collect()
    for i, q in enumerate(QUESTIONS):
        v = vec.query_vector(q)
        shared = {h for h, b, u in stored_bands if (b, u) in set(vec.query_bands(v))}
        scores = []
        for h in shared or stored_vectors:
            dot, n = sum(a * b for a, b in zip(v, stored_vectors[h], strict=True)), math.sqrt(sum(a * a for a in stored_vectors[h]) * sum(a * a for a in v))
            if n and dot > 0:
                scores.append((h, dot / n))
        assert len([r for r in got if r["query"] == i]) == min(5, len(scores))


def test_scans_of_stored_tables_are_filtered(spark, tmp_path):
    ft.postings(spark.createDataFrame([("h", "one two"), ("g", "two three")], "hash string, body string")).write.parquet(str(tmp_path / "p"))
    stored = spark.read.parquet(str(tmp_path / "p"))
    near = se.among(stored, "token", spark.createDataFrame([("two",)], "token string"))
    assert "In(token" in near._jdf.queryExecution().executedPlan().toString() or "EqualTo(token" in near._jdf.queryExecution().executedPlan().toString()
    assert {r["hash"] for r in near.collect()} == {"g", "h"}


def test_suggestions_agree_with_all_pairs(spark):
    from tessera.operators import textual as te

    words, tools = ["serch", "stauts", "get", "zzzzzz", "", "qu", "a", "ingset", "embedd", "quey"], ["search", "status", "query", "get", "ingest", "embed", "ab"]
    got = {r["word"]: (r["suggestion"], r["distance"]) for r in te.suggestions(spark.createDataFrame([(w,) for w in words], "word string"), spark.createDataFrame([(t,) for t in tools], "tool string")).collect()}

    def edits(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, was = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(was[j] + 1, row[-1] + 1, was[j - 1] + (x != y)))
        return row[-1]

    want = {}
    for w in words:
        best = min((edits(w, t), t) for t in tools)
        if best[0] <= (1 if len(w) <= 4 else 2):
            want[w] = (best[1], best[0])
    assert got == want


SOURCES = {
    "rust": (
        "/// Adds.\n/// Twice.\n#[inline]\npub async fn add<T: Into<i32>>(\n    a: i32,\n    mut b: Option<(i32, T)>, // fn no(x: i32)\n) -> i32 {\n    let s = \"fn hidden(a: i32) {\";\n    a\n}\n"
        "pub(crate) struct Point { x: i32 }\nimpl Shape for Point {\n    fn area(&self, scale: f64) -> f64 { 0.0 }\n}\n/* fn gone() {} */\nmod inner { pub fn deep() {} }\n",
        [("function", "add", "pub", ["a", "b"], None, 4, "Adds. Twice."), ("struct", "Point", "pub(crate)", [], None, 11, ""), ("impl", "Point", "private", [], None, 12, ""), ("function", "area", "private", ["scale"], "Point", 13, ""), ("module", "inner", "private", [], None, 16, ""), ("function", "deep", "pub", [], "inner", 16, "")],
    ),
    "python": (
        "class Main(Base):\n    \"\"\"Doc # kept\n    def no(): pass\"\"\"\n    def run(\n        self,\n        n: int = 3,\n        *rest,\n    ) -> None:\n        \"\"\"Runs.\"\"\"\n        x = 'def nope(a):'\n\n    class Inner:\n        def deep(self): pass\nasync def _go(a, b=(1, 2)):\n    pass\n",
        [("class", "Main", "public", [], None, 1, "Doc # kept def no(): pass"), ("function", "run", "public", ["n", "rest"], "Main", 4, "Runs."), ("class", "Inner", "public", [], "Main", 12, ""), ("function", "deep", "public", [], "Inner", 13, ""), ("function", "_go", "private", ["a", "b"], None, 14, "")],
    ),
    "typescript": (
        "export interface I { n: number }\nexport default class App {\n}\n/** Loads. */\nexport async function load(\n  a: string,\n  b?: { c: number },\n) { const t = `function no() {}`; }\nconst run = async (q: string, r = 1) => q;\nexport type U = string;\n",
        [("interface", "I", "export", [], None, 1, ""), ("class", "App", "export", [], None, 2, ""), ("function", "load", "export", ["a", "b"], None, 5, "Loads."), ("function", "run", "private", ["q", "r"], None, 9, ""), ("type", "U", "export", [], None, 10, "")],
    ),
    "java": (
        "package a;\npublic final class A {\n  /** Counts. */\n  @Override\n  private static int count(\n      List<String> xs, final int n) {\n    for (int i = 0; i < n; i++) { if (n > 0) { return 1; } }\n  }\n}\ninterface B {}\n",
        [("class", "A", "public", [], None, 2, ""), ("function", "count", "private", ["xs", "n"], "A", 5, "Counts."), ("interface", "B", "private", [], None, 10, "")],
    ),
    "go": ("// x\nfunc (s *S) Run(a int, b string) error {\n}\ntype S struct {}\n", [("function", "Run", "public", ["int", "string"], None, 2, ""), ("struct", "S", "public", [], None, 4, "")]),
    "kotlin": ("data class P(val x: Int)\nsuspend fun go(a: Int, b: String = \"fun no()\") {}\n", [("class", "P", "private", [], None, 1, ""), ("function", "go", "private", ["a", "b"], None, 2, "")]),
}


@pytest.mark.parametrize("language", sorted(SOURCES))
def test_definitions_of_whole_files(language):
    from tessera.operators import symbols

    text, want = SOURCES[language]
    got = [(d["kind"], d["name"], d["visibility"], d["parameters"], d["owner"], d["line"], d["doc"]) for d in symbols.definitions(text, language)]
    assert got == want
    code = symbols.blanked(text, language)
    assert len(code) == len(text) and code.count("\n") == text.count("\n")
    for odd in ("", "\"", "/*", "fn f(", "def f(", "'''", "}" * 50 + text, text * 40):
        symbols.definitions(odd, language)


def test_definitions_over_files(spark):
    from tessera.operators import symbols

    rows = [(f"{k}.x", v[0], k) for k, v in SOURCES.items()] + [("n", None, "rust"), ("e", "", "rust"), ("u", "x", "none"), ("l", "fn a() {}\n" * 30_000, "rust")]
    out = symbols.interfaces(spark.createDataFrame(rows, "path string, body string, language string")).groupBy("path").count().collect()
    got = {r["path"]: r["count"] for r in out}
    assert got.pop("l") == 30_000 and got == {f"{k}.x": len(v[1]) for k, v in SOURCES.items()}


MARKDOWN = [
    ("# One *two* `a<b`\n\ntext **bold** and ~~gone~~ & more  \nnext", "<h1>One <em>two</em> <code>a&lt;b</code></h1>\n<p>text <strong>bold</strong> and <del>gone</del> &amp; more<br />\nnext</p>"),
    ("```rust\nlet x = 1 < 2;\n# no\n```\n---\n", "<pre><code class=\"language-rust\">let x = 1 &lt; 2;\n# no\n</code></pre>\n<hr />"),
    ("- a\n- b\n  - c\n- [x] d\n- [ ] e", "<ul>\n<li>a</li>\n<li>b\n<ul>\n<li>c</li>\n</ul>\n</li>\n<li><input disabled=\"\" type=\"checkbox\" checked=\"\"/>\nd</li>\n<li><input disabled=\"\" type=\"checkbox\"/>\ne</li>\n</ul>"),
    ("3. x\n4. y", "<ol start=\"3\">\n<li>x</li>\n<li>y</li>\n</ol>"),
    ("> q\n> r\n\nz", "<blockquote>\n<p>q\nr</p>\n</blockquote>\n<p>z</p>"),
    ("| a | b |\n|---|:-:|\n| 1 | x \\| y |\n\nend", "<table><thead><tr><th>a</th><th>b</th></tr></thead><tbody>\n<tr><td>1</td><td>x | y</td></tr>\n</tbody></table>\n<p>end</p>"),
    ("[l](http://x.y/?a=1&b=2 \"t\") ![i](p.png) <https://z.org> \\*n\\*", "<p><a href=\"http://x.y/?a=1&amp;b=2\">l</a> <img src=\"p.png\" alt=\"i\" /> <a href=\"https://z.org\">https://z.org</a> *n*</p>"),
    ("<script>x</script>", "<p>&lt;script&gt;x&lt;/script&gt;</p>"), ("", ""), ("snake_case_name and 2 * 3 * 4", "<p>snake_case_name and 2 * 3 * 4</p>"), ("```\nopen", "<pre><code>open\n</code></pre>"),
]


@pytest.mark.parametrize("text, want", MARKDOWN)
def test_markdown_as_html(text, want):
    from tessera.operators import html

    assert html.body(text) == want


def test_pages_of_documents(spark):
    from tessera.operators import html

    rows = [("a.md", "T <1>", "# x"), ("n.md", None, None), ("l.md", "l", "- a\n" * 20_000 + "*" * 20_000 + "`" * 9000 + "[" * 20_000), ("q.md", "q", "> " * 5000 + "x\n" + "\n".join("  " * i + "- y" for i in range(300)))]
    got = {r["path"]: r["html"] for r in html.rendered(spark.createDataFrame(rows, "path string, title string, body string")).collect()}
    assert "<title>T &lt;1&gt;</title>" in got["a.md"] and "<h1>x</h1>" in got["a.md"] and "<body>\n\n</body>" in got["n.md"] and got["l.md"].count("<li>") >= 19_999
