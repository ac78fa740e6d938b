"""Definitions in whole source files: names, kinds, visibility, parameters over several lines, docs and what encloses them.

A file is read once: comments and the insides of strings are blanked (so nothing in them looks like code), definitions are
found on what is left, parameters run to the matching parenthesis, and enclosing definitions follow from braces or, in
Python, from indentation. Files are independent, so the plan is one Arrow pass without a shuffle.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

_AT = r"(?:^|(?<=[{};]))[ \t]*"
_C = r"//[^\n]*|/\*[\s\S]*?(?:\*/|\Z)"
_TEXT = r"\"(?:\\.|[^\"\\\n])*\"?"
_CHARS = r"'(?:\\.|[^'\\\n])*'?"
_MODIFIERS = r"(?:(?:public|protected|private|internal|open|fileprivate|static|final|abstract|sealed|async|override|virtual|partial|readonly|default|synchronized|native|data|inline|suspend|operator|mutating|export|declare|extern|unsafe|const|new|required|convenience|companion|inner|enum|annotation)\s+)*"


@dataclass(frozen=True)
class Language:
    """How a language marks comments, strings and definitions (``kw`` or ``kind``, ``name``); doc: what a doc line begins with."""

    blank: str
    definitions: tuple[tuple[str | None, str], ...]
    public: tuple[str, ...] = ("public", "export", "open")
    indented: bool = False
    kinds: dict[str, str] = field(default_factory=dict)


_CLASSES = (None, rf"{_AT}(?P<mods>{_MODIFIERS})(?P<kw>class|interface|enum|record|struct|trait|object|protocol|extension|actor|namespace)\s+(?P<name>[\w$]+)")
_METHODS = ("function", rf"{_AT}(?P<mods>{_MODIFIERS})(?:<[^<>\n]*>\s*)?(?P<type>[\w$.]+(?:<[^;{{}}()\n]*>)?(?:\[\])*\??)\s+(?P<name>(?!if\b|for\b|while\b|switch\b|catch\b|return\b|new\b)[\w$]+)\s*(?=\((?:[^()]|\([^()]{{0,500}}\)){{0,2000}}\)\s*(?:throws[\w\s,.]+)?(?:where[^{{;]+)?(?:\{{|=>))")
_SCRIPT = Language(
    rf"{_C}|{_TEXT}|{_CHARS}|`(?:\\.|[^`\\])*`?",
    (
        (None, rf"{_AT}(?P<mods>(?:export\s+|default\s+|declare\s+|abstract\s+|async\s+)*)(?P<kw>function|class|interface|enum|type|namespace)\b\s*\*?\s*(?P<name>[\w$]+)"),
        ("function", rf"{_AT}(?P<mods>(?:export\s+)?)(?:const|let|var)\s+(?P<name>[\w$]+)\s*(?::[^=\n]+)?=\s*(?:async\s*)?(?:function\b\s*)?(?=\((?:[^()]|\([^()]{{0,500}}\)){{0,2000}}\)\s*(?::[^={{\n]+)?(?:=>|\{{)|[\w$]+\s*=>)"),
    ),
)
LANGUAGES = {
    "rust": Language(
        rf"{_C}|r#+\"[\s\S]*?\"#+|{_TEXT}|'(?:\\.[^'\n]*|[^'\\\n])'",
        ((None, rf"{_AT}(?P<mods>(?:pub(?:\s*\([^)]*\))?\s+)?)(?:(?:default|const|async|unsafe|extern(?:\s*\"\s*\")?)\s+)*(?P<kw>fn|struct|enum|trait|type|union|mod)\s+(?P<name>\w+)"), ("impl", rf"{_AT}(?P<mods>)(?:unsafe\s+)?impl\b\s*(?:<[^{{;\n]*?>\s+)?(?:[\w:<>, ]+?\s+for\s+)?(?P<name>\w+)")),
        ("pub",), kinds={"fn": "function", "mod": "module"},
    ),
    "python": Language(rf"#[^\n]*|\"\"\"[\s\S]*?(?:\"\"\"|\Z)|'''[\s\S]*?(?:'''|\Z)|{_TEXT}|{_CHARS}", ((None, rf"{_AT}(?P<mods>(?:async\s+)?)(?P<kw>def|class)\s+(?P<name>\w+)"),), (), True, {"def": "function"}),
    "javascript": _SCRIPT, "typescript": _SCRIPT, "react": _SCRIPT, "vue": _SCRIPT, "svelte": _SCRIPT,
    "java": Language(rf"{_C}|\"\"\"[\s\S]*?(?:\"\"\"|\Z)|{_TEXT}|{_CHARS}", (_CLASSES, _METHODS)),
    "csharp": Language(rf"{_C}|@\"(?:[^\"]|\"\")*\"|{_TEXT}|{_CHARS}", (_CLASSES, _METHODS)),
    "kotlin": Language(rf"{_C}|\"\"\"[\s\S]*?(?:\"\"\"|\Z)|{_TEXT}|{_CHARS}", (_CLASSES, ("function", rf"{_AT}(?P<mods>{_MODIFIERS})fun\s+(?:<[^>\n]*>\s*)?(?:[\w<>?]+\.)?(?P<name>\w+)"))),
    "swift": Language(rf"{_C}|\"\"\"[\s\S]*?(?:\"\"\"|\Z)|{_TEXT}", (_CLASSES, ("function", rf"{_AT}(?P<mods>{_MODIFIERS})func\s+(?P<name>\w+)"))),
    "php": Language(rf"#(?!\[)[^\n]*|{_C}|{_TEXT}|{_CHARS}", (_CLASSES, ("function", rf"{_AT}(?P<mods>{_MODIFIERS})function\s+&?(?P<name>\w+)"))),
    "go": Language(rf"{_C}|{_TEXT}|{_CHARS}|`[^`]*`?", (("function", r"^(?P<mods>)func\s+(?:\([^)]*\)\s*)?(?P<name>\w+)"), (None, r"^(?P<mods>)type\s+(?P<name>\w+)\s+(?P<kw>struct|interface|\w+)"))),
}
_COMPILED = {k: (re.compile(v.blank), [(kind, re.compile(p, re.M)) for kind, p in v.definitions]) for k, v in LANGUAGES.items()}
_SELF = frozenset("self this cls".split())


def blanked(text: str, language: str) -> str:
    """The text with comments and the insides of strings as spaces; lengths and line ends stay."""
    return _COMPILED[language][0].sub(lambda m: re.sub(r"[^\n]", " ", m.group()) if m.group()[0] not in "\"'`@r" or len(m.group()) < 2 else m.group()[0] + re.sub(r"[^\n]", " ", m.group()[1:-1]) + m.group()[-1], text)


def _parameters(code: str, at: int) -> tuple[list[str], int]:
    """Names between the parentheses that open at or soon after a place, and where they end; none if there are none."""
    while at < len(code) and code[at] in " \t\n":
        at += 1
    if code.startswith("<", at):  # type parameters
        depth = 0
        while at < len(code):
            depth += {"<": 1, ">": -1}.get(code[at], 0)
            at += 1
            if not depth:
                break
        while at < len(code) and code[at] in " \t\n":
            at += 1
    if not code.startswith("(", at):
        return [], at
    parts, depth, begin = [], 0, at + 1
    for i in range(at, len(code)):
        c = code[i]
        if c in "([{<" and not (c == "<" and code[i + 1 : i + 2] in "= "):
            depth += 1
        elif c in ")]}" or c == ">" and code[i - 1] not in "-=":
            depth -= 1
        if depth == 0 or depth == 1 and c == ",":
            parts.append(code[begin:i])
            begin = i + 1
            if depth == 0:
                return [n for p in parts if (n := _name(p))], i + 1
    return [], len(code)


def _name(part: str) -> str:
    """The name in a parameter: before a colon, else the last word before a default value."""
    part = re.sub(r"@\w+(?:\([^)]*\))?", " ", part).split("=", 1)[0]
    before = part.split(":", 1)[0] if ":" in part.replace("::", "") else part
    words = re.findall(r"[\w$]+", before)
    words = [w for w in words if w not in ("mut", "ref", "final", "val", "var", "params", "out", "in", "const", "inout")]
    if not words or words[0 if ":" in part else -1] in _SELF or words[-1] in _SELF:
        return ""
    return words[-1]


def _doc(lines: list[str], row: int) -> str:
    """The doc comment that ends on the line above (0-based row): /// lines, a /** block or lines of #."""
    out, i = [], row - 1
    while i >= 0 and re.match(r"\s*(?:#\[|@\w)", lines[i]):  # attributes and annotations stand between
        i -= 1
    if i >= 0 and lines[i].rstrip().endswith("*/"):
        while i >= 0:
            out.append(re.sub(r"^\s*(?:/\*\*?|\*(?!/))?\s?|\s*\*/\s*$", "", lines[i]).strip())
            if "/*" in lines[i]:
                return " ".join(x for x in reversed(out) if x) if "/**" in lines[i] else ""
            i -= 1
        return ""
    while i >= 0 and (m := re.match(r"\s*///\s?(.*)$", lines[i])):
        out.append(m[1].strip())
        i -= 1
    return " ".join(x for x in reversed(out) if x)


def definitions(text: str, language: str) -> list[dict]:
    """All definitions of a text in order: line (from 1), kind, name, visibility, parameters, owner, signature, doc."""
    if language not in LANGUAGES or not text:
        return []
    spec, code, lines = LANGUAGES[language], blanked(text, language), text.split("\n")
    found: dict[int, tuple] = {}
    for kind, pattern in _COMPILED[language][1]:
        for m in pattern.finditer(code):
            at = m.start("mods")
            word = m.groupdict().get("kw")
            found.setdefault(at, (m, kind or spec.kinds.get(word, word if language != "go" or word in ("struct", "interface") else "type")))
    out, stack, place, row, depth = [], [], 0, 0, 0  # stack: (name, depth or column) of what is open
    for at in sorted(found):
        m, kind = found[at]
        between = code[place:at]
        row += between.count("\n")
        column = at - (code.rfind("\n", 0, at) + 1)
        if spec.indented:
            while stack and stack[-1][1] >= column:
                stack.pop()
        else:
            for c in re.findall(r"[{}]", between):
                depth += 1 if c == "{" else -1
                while c == "}" and stack and stack[-1][1] >= depth:
                    stack.pop()
            while stack and stack[-1][1] >= depth:  # a definition without a body of its own holds nothing
                stack.pop()
        place = at
        names, after = _parameters(code, m.end())
        mods = (m.groupdict().get("mods") or "").split()
        said = " ".join(w for w in mods if w.split("(")[0] in (*spec.public, "protected", "private", "internal", "fileprivate"))
        if language == "python":
            said = "private" if m["name"].startswith("_") else "public"
        elif language == "go":
            said = "public" if m["name"][:1].isupper() else "private"
        head = next((x.strip() for x in lines[row : row + 1]), "")
        doc = _doc(lines, row)
        if language == "python" and (d := re.compile(r"[^:]*?:\s*\n\s*(?:\"\"\"|''')\s*([\s\S]*?)(?:\"\"\"|''')").match(text, after)):
            doc = " ".join(d[1].split())
        out.append({"line": row + 1, "kind": kind, "name": m["name"], "visibility": said or "private", "parameters": names if kind == "function" else [], "owner": stack[-1][0] if stack else None, "signature": head, "doc": doc})
        stack.append((m["name"], column if spec.indented else depth))
    return out


def _run(batches):
    import pyarrow as pa

    columns = ("line", "kind", "name", "visibility", "parameters", "owner", "signature", "doc")
    kinds = (pa.int64(), pa.string(), pa.string(), pa.string(), pa.list_(pa.string()), pa.string(), pa.string(), pa.string())
    for b in batches:
        paths, rows = [], []
        for path, body, language in zip(*(b.column(n).to_pylist() for n in ("path", "body", "language")), strict=True):
            own = definitions(body or "", language or "")
            paths += [path] * len(own)
            rows += own
        yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), *(pa.array([r[c] for r in rows], k) for c, k in zip(columns, kinds, strict=True))], names=["path", *columns])


def interfaces(files: DataFrame) -> DataFrame:
    """(path, line, kind, name, visibility, parameters, owner, signature, doc) of files (path, body, language).

    Null and empty bodies and languages that are not known define nothing.
    """
    from tessera.session import workers_import

    workers_import(files.sparkSession)
    return files.select("path", "body", "language").mapInArrow(_run, "path string, line bigint, kind string, name string, visibility string, parameters array<string>, owner string, signature string, doc string")
