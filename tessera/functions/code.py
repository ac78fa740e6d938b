"""Source text as Column expressions: symbols and dependencies line by line, complexity, comments, manifests."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import lines, sections

#: What marks a branch, by language.
BRANCHES = {
    "rust": (" if ", " for ", " while ", " match ", " else if ", "else {", "?"),
    "python": (" if ", " for ", " while ", " elif ", " except ", " with "),
    "typescript": (" if ", " for ", " while ", " switch ", " catch ", " else if ", " case ", " ? ", "&&", "||"),
    "csharp": (" if ", " for ", " foreach ", " while ", " switch ", " catch ", " case ", " else if "),
    "java": (" if ", " for ", " while ", " switch ", " catch ", " case ", " else if "),
    "go": (" if ", " for ", " switch ", " select ", " case ", " else if "),
    "other": (" if ", " for ", " while ", " switch ", " case "),
}
#: What counts as a function, a class and a branch in the simple measure.
FUNCTION_MARKS, CLASS_MARKS = ("fn ", "def ", "function ", "async "), ("class ", "struct ", "interface ")
BRANCH_MARKS = ("if ", "while ", "for ", "foreach ", "match ", "switch ", "case ")

#: Dependencies by language: kind and a pattern whose first group is the target.
DEPENDENCIES = {
    "rust": (("use", r"^\s*(?:pub(?:\([a-z]+\))?\s+)?use\s+([A-Za-z0-9_:]+)"), ("mod", r"^\s*(?:pub(?:\([a-z]+\))?\s+)?mod\s+([A-Za-z0-9_]+)\s*;")),
    "python": (("import", r"^\s*import\s+([A-Za-z0-9_.]+)"), ("from_import", r"^\s*from\s+([A-Za-z0-9_.]+)\s+import\s")),
    "javascript": (("import", r"^\s*import\s+(?:[^'\"]*\sfrom\s+)?['\"]([^'\"]+)['\"]"), ("require", r"require\(\s*['\"]([^'\"]+)['\"]\s*\)"), ("dynamic_import", r"[^A-Za-z]import\(\s*['\"]([^'\"]+)['\"]\s*\)")),
    "typescript": (("type_import", r"^\s*import\s+type\s+[^'\"]*\sfrom\s+['\"]([^'\"]+)['\"]"), ("import", r"^\s*import\s+(?:[^'\"t][^'\"]*\sfrom\s+)?['\"]([^'\"]+)['\"]")),
    "react": (("import", r"^\s*import\s+(?:[^'\"]*\sfrom\s+)?['\"]([^'\"]+)['\"]"), ("hook", r"[^A-Za-z](use[A-Z][A-Za-z]+)\(")),
    "vue": (("import", r"^\s*import\s+(?:[^'\"]*\sfrom\s+)?['\"]([^'\"]+)['\"]"),),
    "svelte": (("import", r"^\s*import\s+(?:[^'\"]*\sfrom\s+)?['\"]([^'\"]+)['\"]"),),
    "java": (("import", r"^\s*import\s+(?:static\s+)?([A-Za-z0-9_.*]+)\s*;"), ("package", r"^\s*package\s+([A-Za-z0-9_.]+)\s*;")),
    "kotlin": (("import", r"^\s*import\s+([A-Za-z0-9_.*]+)"), ("package", r"^\s*package\s+([A-Za-z0-9_.]+)")),
    "csharp": (("using", r"^\s*using\s+(?:static\s+)?([A-Za-z0-9_.]+)\s*;"),),
    "php": (("use", r"^\s*use\s+([A-Za-z0-9_\\]+)"), ("require", r"^\s*(?:require|include)(?:_once)?\s*\(?\s*['\"]([^'\"]+)['\"]")),
    "swift": (("import", r"^\s*import\s+([A-Za-z0-9_.]+)"),),
}

#: Symbols by language: kind and a pattern whose first group is the name.
SYMBOLS = {
    "rust": (("function", r"^\s*(?:pub(?:\([a-z]+\))?\s+)?(?:async\s+)?fn\s+([A-Za-z0-9_]+)"), ("struct", r"^\s*(?:pub(?:\([a-z]+\))?\s+)?struct\s+([A-Za-z0-9_]+)"), ("trait", r"^\s*(?:pub(?:\([a-z]+\))?\s+)?trait\s+([A-Za-z0-9_]+)"), ("enum", r"^\s*(?:pub(?:\([a-z]+\))?\s+)?enum\s+([A-Za-z0-9_]+)"), ("impl", r"^\s*impl(?:<[^>]*>)?\s+([A-Za-z0-9_]+)")),
    "python": (("class", r"^class\s+([A-Za-z0-9_]+)"), ("async_function", r"^async\s+def\s+([A-Za-z0-9_]+)"), ("function", r"^def\s+([A-Za-z0-9_]+)"), ("method", r"^\s+(?:async\s+)?def\s+([A-Za-z0-9_]+)")),
    "javascript": (("function", r"^\s*(?:export\s+)?(?:default\s+)?(?:async\s+)?function\s+([A-Za-z0-9_$]+)"), ("class", r"^\s*(?:export\s+)?(?:default\s+)?class\s+([A-Za-z0-9_$]+)"), ("arrow", r"^\s*(?:export\s+)?const\s+([A-Za-z0-9_$]+)\s*=\s*(?:async\s*)?\(")),
    "typescript": (("function", r"^\s*(?:export\s+)?(?:async\s+)?function\s+([A-Za-z0-9_$]+)"), ("class", r"^\s*(?:export\s+)?(?:abstract\s+)?class\s+([A-Za-z0-9_$]+)"), ("interface", r"^\s*(?:export\s+)?interface\s+([A-Za-z0-9_$]+)"), ("enum", r"^\s*(?:export\s+)?enum\s+([A-Za-z0-9_$]+)"), ("type", r"^\s*(?:export\s+)?type\s+([A-Za-z0-9_$]+)\s*=")),
    "react": (("component", r"^\s*(?:export\s+)?(?:default\s+)?function\s+([A-Z][A-Za-z0-9_]*)"), ("component", r"^\s*(?:export\s+)?const\s+([A-Z][A-Za-z0-9_]*)\s*=")),
    "vue": (("component", r"^\s*name:\s*['\"]([A-Za-z0-9_-]+)['\"]"), ("function", r"^\s*(?:async\s+)?function\s+([A-Za-z0-9_$]+)")),
    "svelte": (("prop", r"^\s*export\s+let\s+([A-Za-z0-9_$]+)"), ("function", r"^\s*(?:async\s+)?function\s+([A-Za-z0-9_$]+)")),
    "java": (("class", r"^\s*(?:public\s+|abstract\s+|final\s+)*class\s+([A-Za-z0-9_]+)"), ("interface", r"^\s*(?:public\s+)?interface\s+([A-Za-z0-9_]+)"), ("enum", r"^\s*(?:public\s+)?enum\s+([A-Za-z0-9_]+)"), ("method", r"^\s*(?:public|protected|private)\s+(?:static\s+)?[A-Za-z0-9_<>\[\]]+\s+([A-Za-z0-9_]+)\s*\(")),
    "kotlin": (("class", r"^\s*(?:data\s+|open\s+|abstract\s+|sealed\s+)*class\s+([A-Za-z0-9_]+)"), ("object", r"^\s*object\s+([A-Za-z0-9_]+)"), ("function", r"^\s*(?:suspend\s+)?fun\s+([A-Za-z0-9_]+)")),
    "csharp": (("class", r"^\s*(?:public\s+|internal\s+|abstract\s+|sealed\s+|static\s+|partial\s+)*class\s+([A-Za-z0-9_]+)"), ("record", r"^\s*(?:public\s+)?record\s+([A-Za-z0-9_]+)"), ("interface", r"^\s*(?:public\s+|internal\s+)?interface\s+([A-Za-z0-9_]+)"), ("method", r"^\s*(?:public|protected|private|internal)\s+(?:static\s+|async\s+|virtual\s+|override\s+)*[A-Za-z0-9_<>\[\]?]+\s+([A-Za-z0-9_]+)\s*\(")),
    "php": (("class", r"^\s*(?:abstract\s+|final\s+)?class\s+([A-Za-z0-9_]+)"), ("interface", r"^\s*interface\s+([A-Za-z0-9_]+)"), ("trait", r"^\s*trait\s+([A-Za-z0-9_]+)"), ("function", r"^\s*(?:public\s+|protected\s+|private\s+|static\s+)*function\s+([A-Za-z0-9_]+)")),
    "swift": (("class", r"^\s*(?:public\s+|final\s+)*class\s+([A-Za-z0-9_]+)"), ("struct", r"^\s*(?:public\s+)?struct\s+([A-Za-z0-9_]+)"), ("protocol", r"^\s*(?:public\s+)?protocol\s+([A-Za-z0-9_]+)"), ("function", r"^\s*(?:public\s+|private\s+|static\s+)*func\s+([A-Za-z0-9_]+)")),
    "sql": (("table", r"(?i)create\s+table\s+(?:if\s+not\s+exists\s+)?\[?([A-Za-z0-9_.]+)"), ("view", r"(?i)create\s+view\s+\[?([A-Za-z0-9_.]+)"), ("procedure", r"(?i)create\s+proc(?:edure)?\s+\[?([A-Za-z0-9_.]+)"), ("function", r"(?i)create\s+function\s+\[?([A-Za-z0-9_.]+)"), ("trigger", r"(?i)create\s+trigger\s+\[?([A-Za-z0-9_.]+)"), ("index", r"(?i)create\s+(?:unique\s+)?index\s+\[?([A-Za-z0-9_.]+)"), ("type", r"(?i)create\s+type\s+\[?([A-Za-z0-9_.]+)")),
}
SQL_REFERENCES = (("from", r"(?i)\bfrom\s+([A-Za-z_][A-Za-z0-9_.]*)"), ("join", r"(?i)\bjoin\s+([A-Za-z_][A-Za-z0-9_.]*)"), ("insert", r"(?i)\binsert\s+into\s+([A-Za-z_][A-Za-z0-9_.]*)"), ("update", r"(?i)\bupdate\s+([A-Za-z_][A-Za-z0-9_.]*)\s+set\b"), ("references", r"(?i)\breferences\s+([A-Za-z_][A-Za-z0-9_.]*)"), ("exec", r"(?i)\bexec(?:ute)?\s+([A-Za-z_][A-Za-z0-9_.]*)"))
PROJECT_REFERENCES = (("package", r"<PackageReference\s+Include=\"([^\"]+)\""), ("project", r"<ProjectReference\s+Include=\"([^\"]+)\""), ("framework", r"<FrameworkReference\s+Include=\"([^\"]+)\""), ("solution", r"^Project\(\"[^\"]*\"\)\s*=\s*\"([^\"]+)\""), ("artifact", r"<ArtifactReference\s+Include=\"([^\"]+)\""), ("build", r"<Build\s+Include=\"([^\"]+)\""))


def found(files: DataFrame, rules) -> DataFrame:
    """(path, line, kind, name): every rule's first match in every line of (path, body)."""
    each = files.select("path", F.posexplode(lines(F.col("body"))).alias("i", "text"))
    hits = F.filter(F.array(*[F.struct(F.lit(k).alias("kind"), F.regexp_extract("text", p, 1).alias("name")) for k, p in rules]), lambda x: x["name"] != "")
    return each.select("path", (F.col("i") + 1).cast("long").alias("line"), F.explode(hits).alias("h")).select("path", "line", "h.kind", "h.name")


def _kind(kind: str):
    return lambda name: F.struct(F.lit(kind).alias("kind"), name.alias("name"))


def found_all(files: DataFrame, rules) -> DataFrame:
    """(path, kind, name): every match of every rule in the whole body."""
    hits = [F.transform(F.regexp_extract_all("body", F.lit(p), F.lit(1)), _kind(k)) for k, p in rules]
    return files.select("path", F.explode(F.concat(*hits)).alias("h")).select("path", "h.kind", "h.name")


def occurrences(text: Column, part: str) -> Column:
    """How often a part occurs, without overlap."""
    return ((F.length(text) - F.length(F.replace(text, F.lit(part), F.lit("")))) / len(part)).cast("long")


def total(text: Column, parts) -> Column:
    return reduce(lambda a, b: a + b, [occurrences(text, p) for p in parts])


def cyclomatic(text: Column, language: Column) -> Column:
    shared = {"javascript": "typescript"}
    out = F
    for name in ("rust", "python", "typescript", "javascript", "csharp", "java", "go"):
        out = out.when(language == name, total(text, BRANCHES[shared.get(name, name)]))
    return out.otherwise(total(text, BRANCHES["other"])) + 1


def lines_of_code(text: Column) -> Column:
    return F.size(F.filter(lines(text), lambda x: F.trim(x) != "")).cast("long")


#: A string literal (kept as the first group) or a comment of C-like languages, and of Python.
C_COMMENTS = r"(\"(?:\\.|[^\"\\])*\"|'(?:\\.|[^'\\])*'|`(?:\\.|[^`\\])*`)|//[^\n]*|/\*(?:[^*]|\*+[^*/])*\*+/"
PYTHON_COMMENTS = r"(\"\"\"(?:[^\"]|\"[^\"]|\"\"[^\"])*\"\"\"|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*')|#[^\n]*"


def without_comments(text: Column, pattern: str) -> Column:
    """Comments removed, string literals kept; blanks at line ends and runs of empty lines go too."""
    from tessera.functions.text import collapse_blank

    return collapse_blank(F.regexp_replace(text, pattern, "$1"))


def visibility(line: Column) -> Column:
    """The first word that says who may use a symbol, else private."""
    return F.coalesce(F.nullif(F.regexp_extract(line, r"^\s*(public|protected|internal|private|pub(?:\([a-z]+\))?)\b", 1), F.lit("")), F.lit("private"))


def dependency_name(target: Column) -> Column:
    """The first name in braces, before an alias, last part of a path."""
    inner = F.coalesce(F.nullif(F.regexp_extract(target, r"\{\s*([A-Za-z0-9_]+)", 1), F.lit("")), F.element_at(F.split(F.regexp_replace(target, r"\s+as\s+.*$", ""), "::"), -1))
    return F.trim(inner)


def parameters(signature: Column) -> Column:
    """Names before a colon of what stands in the first parentheses, without self."""
    inside = F.regexp_extract(signature, r"\(([^)]*)\)", 1)
    names = F.transform(F.split(inside, ","), lambda p: F.trim(F.substring_index(F.substring_index(p, ":", 1), "=", 1)))
    return F.filter(names, lambda n: (n != "") & ~n.isin("self", "&self", "&mut self", "mut self"))


def cargo_dependencies(manifests: DataFrame) -> DataFrame:
    """(path, name) of keys under a dependencies heading; what stands under a heading comes from the array of lines."""
    heading = r"^\s*\[([^\]]+)\]"
    parts = manifests.select("path", F.explode(sections(F.col("body"), lambda x: F.rlike(x, F.lit(heading)))).alias("s"))
    under = parts.where(F.endswith(F.regexp_extract("s.head", heading, 1), F.lit("dependencies")))
    rows = under.select("path", F.explode(F.concat(F.array("s.head"), "s.below")).alias("text")).withColumn("name", F.regexp_extract("text", r"^\s*([A-Za-z0-9_-]+)\s*=", 1))
    return rows.where("name <> ''").select("path", F.lower("name").alias("name"))


def npm_dependencies(manifests: DataFrame) -> DataFrame:
    """(path, name) of a package file's dependencies, scopes stripped."""
    keys = lambda part: F.coalesce(F.map_keys(F.from_json(F.get_json_object("body", f"$.{part}"), "map<string,string>")), F.array().cast("array<string>"))
    names = F.concat(keys("dependencies"), keys("devDependencies"))
    return manifests.select("path", F.explode(names).alias("n")).select("path", F.lower(F.regexp_replace("n", "^@[^/]+/", "")).alias("name"))


def pip_dependencies(manifests: DataFrame) -> DataFrame:
    """(path, name) of a requirements file's packages."""
    each = manifests.select("path", F.explode(lines(F.col("body"))).alias("text"))
    name = F.regexp_extract(F.trim(F.regexp_replace("text", "#.*$", "")), r"^([A-Za-z0-9_.-]+)", 1)
    return each.select("path", F.lower(name).alias("name")).where("name <> '' AND NOT startswith(name, '-')")
