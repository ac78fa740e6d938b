"""Rules over paths and labels as Column expressions. The tables state fixed values; first match wins."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Languages by extension.
LANGUAGES = {
    "rust": ("rs",), "typescript": ("ts", "tsx"), "javascript": ("js", "jsx", "mjs"), "python": ("py",), "csharp": ("cs",), "powershell": ("ps1", "psm1", "psd1"),
    "java": ("java",), "go": ("go",), "ruby": ("rb",), "cpp": ("cpp", "cc", "cxx", "hpp"), "c": ("c", "h"),
}

#: A file's class by tests on name (stem), extension and path.
CLASSES = (
    ("test", (("stem", "ends", "_test"), ("stem", "ends", ".test"), ("stem", "starts", "test_"), ("path", "contains", "/tests/"), ("path", "contains", "/test/"), ("stem", "is", "tests"), ("stem", "is", "test"))),
    ("entry_point", (("stem", "is", "main"), ("stem", "is", "program"), ("stem", "is", "app"))),
    ("config", (*(("ext", "is", e) for e in ("toml", "json", "yaml", "yml", "ini", "env")), ("stem", "contains", "config"), ("stem", "contains", "settings"))),
    ("build_script", (("stem", "is", "build"), ("stem", "is", "makefile"), ("stem", "is", "cargo"), ("ext", "is", "cmake"), ("stem", "is", "justfile"))),
    ("documentation", tuple(("ext", "is", e) for e in ("md", "rst", "txt", "adoc"))),
    ("module", tuple(("stem", "is", e) for e in ("mod", "index", "lib", "__init__"))),
    ("library", tuple(("ext", "is", e) for e in ("rs", "ts", "js", "py", "cs", "java", "go", "rb"))),
)

#: A file's purpose, first by path parts, then by its name.
PURPOSE_BY_PATH = (
    ("page", ("/pages/", "/views/", "/screens/")), ("widget", ("/components/", "/widgets/", "/ui/")), ("model", ("/models/", "/entities/", "/data/")),
    ("util", ("/utils/", "/utilities/", "/helpers/")), ("config", ("/config/", "/configs/", "/settings/")), ("middleware", ("/middleware/", "/middlewares/")),
    ("plugin", ("/plugin/",)), ("router", ("/routes/", "/router/", "/routing/")), ("database", ("/database/", "/db/", "/storage/")),
    ("dao", ("/dao/", "/repository/", "/persistence/")), ("context", ("/context", "/ctx/")), ("api", ("/api", "/endpoint", "/controller", "/native_module", "/bridge")),
    ("test", ("/test/", "/tests/", "/__tests__/")), ("doc", ("/docs/", "/doc/", "/documentation/")),
)
PURPOSE_BY_NAME = (
    ("entry", ("main", "index", "app")), ("page", ("page", "view", "screen")), ("widget", ("component", "widget")), ("model", ("model", "entity")), ("util", ("util",)),
    ("config", ("config", "setting")), ("middleware", ("middleware",)), ("plugin", ("plugin",)), ("router", ("route",)), ("database", ("database",)),
    ("dao", ("repository", "persistence")), ("context", ("context", "ctx")), ("api", ("api", "endpoint")), ("test", ("test", "spec")), ("doc", ("readme", "doc")), ("command", ("cli", "commands")),
)

#: A purpose from a loose label; each entry holds alternatives, an alternative words that must all occur.
PURPOSE_BY_LABEL = (
    ("agent", (("agent",),)), ("page", (("page",),)), ("widget", (("ui component",), ("component", "ui"), ("component", "frontend"), ("widget",))),
    ("specific_feature", (("specificfeature",), ("logical functionality",), ("feature",))), ("model", (("data type",), ("model",), ("schema",), ("entity",))),
    ("types", (("interface definition",), ("types",), ("type definition",))), ("tool", (("tool",),)), ("util", (("utility",), ("helper",))),
    ("config", (("config",), ("settings",))), ("middleware", (("middleware",),)), ("plugin", (("plugin",),)), ("router", (("router",), ("routing",))),
    ("database", (("database",), ("sql",), ("storage",), ("repository",))), ("api", (("api",), ("http",), ("rpc",), ("endpoint",))), ("controller", (("controller",),)),
    ("service", (("service",),)), ("module", (("module",),)), ("lib", (("library",), ("third party",), ("package",))), ("test", (("test",), ("spec",))), ("doc", (("doc",), ("readme",))),
    ("dao", (("data access layer",), ("dao",), ("persistence",))), ("context", (("context",),)), ("command", (("command",), ("cli",), ("handler",))),
)

#: Names and endings that mark tests, and extensions of files that are not text.
TEST_DIRS = ("test", "tests", "__tests__", "spec", "specs")
TEST_ENDINGS = (
    "_test.py", ".test.js", ".spec.js", ".test.ts", ".spec.ts", ".test.jsx", ".spec.jsx", ".test.tsx", ".spec.tsx", "test.java", "tests.java", "test.cs", "tests.cs",
    "_test.rs", "_tests.rs", "_test.go", "test.c", "test.cpp", "test.cc",
)
TEST_INSIDE = ("_test_", ".test.", "-test-", "-test.", ".spec.", "_spec_", "-spec-", "-spec.")
TEST_DIRECTORY_NAMES = (*TEST_DIRS, "testing", "test_data", "testdata", "fixtures", "e2e", "integration", "unit", "acceptance")
TEST_DIRECTORY_ENDINGS = ("_test", "_tests", "-test", "-tests")
BINARY = (
    "jpg", "jpeg", "png", "gif", "bmp", "ico", "svg", "webp", "mp3", "wav", "flac", "aac", "ogg", "m4a", "mp4", "avi", "mkv", "mov", "wmv", "flv", "webm", "zip", "rar", "7z", "tar", "gz", "bz2",
    "xz", "exe", "dll", "so", "dylib", "bin", "pdf", "doc", "docx", "xls", "xlsx", "ppt", "pptx", "ttf", "otf", "woff", "woff2", "db", "sqlite", "sqlite3", "dat", "cache", "archive",
)
SOURCE = ("rs", "py", "js", "jsx", "ts", "tsx", "c", "h", "cpp", "hpp", "go", "java", "cs", "kt", "swift", "php", "rb", "scala", "sql")
SUPPORTED_DOCS = {"pdf": ("pdf",), "markdown": ("md", "markdown"), "text": ("txt", "text"), "sql": ("sql",), "yaml": ("yaml", "yml"), "json": ("json",)}

#: What adds to a file's importance.
IMPORTANT_PLACES = (((("src", "lib")), 0.3), (("main", "index"), 0.2), (("config", "setup"), 0.1))
IMPORTANT_TYPES = (
    (("rs", "py", "java", "kt", "cpp", "c", "go", "rb", "php", "m", "swift", "dart", "cs", "jsx", "tsx", "js", "ts", "mjs", "cjs", "vue", "svelte", "wxml", "ttml", "ksml"), 0.3),
    (("sql", "sqlproj"), 0.25), (("csproj", "sln"), 0.2), (("gradle", "pom", "package"), 0.15), (("lock",), 0.05),
    (("toml", "yaml", "yml", "json", "xml", "ini", "env", "css", "scss", "sass", "less", "styl", "wxss", "html", "htm", "hbs", "mustache", "ejs"), 0.1),
)
IMPORTANT_EXTRA = ((("database", "schema", "migrations"), 0.15), (("/tools/",), 0.15))
SIZES = (("tiny", 1024), ("small", 10240), ("medium", 102400), ("large", 1048576))
DEPENDENCY_PRIORITY = {"import": 10, "inheritance": 9, "function_call": 8, "composition": 7, "data_flow": 6, "module": 5}
DOC_LANGUAGE = {"sql": "sql", "rs": "rust", "py": "python", "js": "javascript", "ts": "typescript", "cs": "csharp", "java": "java", "go": "go", "kt": "kotlin", "php": "php"}


def any_of(tests: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, tests)


def contains_any(text: Column, parts) -> Column:
    return any_of([F.contains(text, F.lit(p)) for p in parts])


def name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def parent(path: Column) -> Column:
    """The directory; nothing for a file at the top."""
    return F.regexp_replace(path, r"/?[^/]*$", "")


def extension(path: Column) -> Column:
    """Behind the last dot of the name, null without one; a name's first character is no such dot."""
    return F.nullif(F.regexp_extract(name(path), r"^.+\.([^.]*)$", 1), F.lit(""))


def stem(path: Column) -> Column:
    return F.regexp_replace(name(path), r"^(.+)\.[^.]*$", "$1")


def first(cases: list[tuple[str, Column]], other: str | None) -> Column:
    label, test = cases[0]
    out = F.when(test, label)
    for label, test in cases[1:]:
        out = out.when(test, label)
    return out.otherwise(other)


def language(path: Column) -> Column:
    return first([(k, extension(path).isin(*e)) for k, e in LANGUAGES.items()], "unknown")


def file_class(path: Column) -> Column:
    parts = {"stem": F.lower(stem(path)), "ext": F.coalesce(F.lower(extension(path)), F.lit("")), "path": F.lower(path)}
    how = {"is": lambda c, v: c == v, "ends": lambda c, v: F.endswith(c, F.lit(v)), "starts": lambda c, v: F.startswith(c, F.lit(v)), "contains": lambda c, v: F.contains(c, F.lit(v))}
    return first([(label, any_of([how[op](parts[part], v) for part, op, v in tests])) for label, tests in CLASSES], "unknown")


def purpose(path: Column) -> Column:
    low, own = F.lower(path), F.lower(name(path))
    cases = [("database", F.endswith(own, F.lit(".sql")) | F.endswith(own, F.lit(".sqlproj")))]
    cases += [(k, contains_any(low, p)) for k, p in PURPOSE_BY_PATH] + [(k, contains_any(own, p)) for k, p in PURPOSE_BY_NAME]
    return first(cases, "other")


def purpose_from_label(label: Column) -> Column:
    plain = F.regexp_replace(F.lower(F.trim(label)), "[–—_-]", " ")
    entry = F.contains(F.regexp_replace(plain, r"\s", ""), F.lit("entry"))
    cases = [("entry", entry)]
    cases += [(k, any_of([reduce(lambda a, b: a & b, [F.contains(plain, F.lit(w)) for w in words]) for words in alternatives])) for k, alternatives in PURPOSE_BY_LABEL]
    return first(cases, "other")


def is_test_file(path: Column) -> Column:
    low, own = F.lower(path), F.lower(name(path))
    tests = [F.contains(low, F.lit(f"/{d}/")) | F.startswith(low, F.lit(f"{d}/")) for d in TEST_DIRS]
    tests += [F.startswith(own, F.lit("test_")), *(F.endswith(own, F.lit(e)) for e in TEST_ENDINGS)]
    generic = F.startswith(own, F.lit("test")) | F.endswith(own, F.lit("test")) | contains_any(own, TEST_INSIDE)
    return any_of([*tests, F.contains(own, F.lit("test")) & generic])


def is_test_directory(directory: Column) -> Column:
    low = F.lower(directory)
    return any_of([low.isin(*TEST_DIRECTORY_NAMES), *(F.endswith(low, F.lit(e)) for e in TEST_DIRECTORY_ENDINGS)])


def is_binary(path: Column) -> Column:
    return F.coalesce(F.lower(extension(path)).isin(*BINARY), F.lit(False))


def importance(path: Column, size: Column) -> Column:
    """The sum of what a file's place, size and type add, not capped; core files have 0.5 or more."""
    low, ext = F.lower(path), F.coalesce(extension(path), F.lit(""))
    parts = [F.when(contains_any(low, p), v).otherwise(0.0) for p, v in (*IMPORTANT_PLACES, *IMPORTANT_EXTRA)]
    parts += [F.when((size > 1024) & (size < 50 * 1024), 0.2).otherwise(0.0)]
    parts += [F.when(ext.isin(*e), v).otherwise(0.0) for e, v in IMPORTANT_TYPES]
    return F.round(reduce(lambda a, b: a + b, parts), 6)


def directory_importance(directory: Column, files: Column, subdirectories: Column) -> Column:
    low = F.lower(name(directory))
    total = F.when(low.isin("src", "lib"), 0.4).otherwise(0.0) + F.when(contains_any(low, ("core", "main")), 0.3).otherwise(0.0)
    return F.round(F.least(F.lit(1.0), total + F.when(files > 5, 0.2).otherwise(0.0) + F.when(subdirectories > 2, 0.1).otherwise(0.0)), 6)


def size_class(size: Column) -> Column:
    return first([(k, size <= most) for k, most in SIZES], "huge")


def document_type(path: Column) -> Column:
    return first([(k, F.lower(extension(path)).isin(*e)) for k, e in SUPPORTED_DOCS.items()], None)


def ignored_directory(directory: Column, excluded: list[str], tests: bool = False, hidden: bool = False) -> Column:
    """Excluded by one of its parts' names, by a path from the top, as a directory of tests or as a hidden one."""
    low = F.lower(directory)
    parts = F.split(low, "/")
    checks = [F.array_contains(parts, e.lower()) if "/" not in e else (low == e.lower()) | F.startswith(low, F.lit(e.lower() + "/")) for e in excluded]
    if not tests:
        checks.append(F.exists(parts, is_test_directory))
    if not hidden:
        checks.append(F.exists(parts, lambda p: F.startswith(p, F.lit("."))))
    return any_of(checks)


def ignored_file(path: Column, size: Column, excluded: list[str], excluded_extensions: list[str], most: int, included_extensions: list[str] | None = None) -> Column:
    """Excluded by name (a star stands for anything around the rest), extension, as a test, hidden, large or binary file."""
    own, ext = F.lower(name(path)), F.coalesce(F.lower(extension(path)), F.lit(""))
    checks = [F.contains(own, F.lit(e.replace("*", "").lower())) if "*" in e else own == e.lower() for e in excluded]
    checks += [ext.isin(*excluded_extensions), is_test_file(path), F.startswith(own, F.lit(".")), size > most, is_binary(path)]
    if included_extensions:
        checks.append(~ext.isin(*included_extensions))
    return any_of(checks)


def matches(text: Column, pattern: str) -> Column:
    """A pattern with one star is a beginning and an ending; others are searched for."""
    if pattern.count("*") == 1:
        a, b = pattern.split("*")
        return F.startswith(text, F.lit(a)) & F.endswith(text, F.lit(b))
    return F.contains(text, F.lit(pattern.replace("*", "")))
