"""Text functions of retrieval as Column expressions: tokens, overlap, scores, snippets, titles, slices."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Path parts that raise or lower a result's score.
RAISED = (("/crates/", 1.08), ("/src/", 1.05))
LOWERED, LOWERED_BY = ("/target/", "/dist/", "/build/", "/node_modules/", "/deepwiki-rs/", "/generated/", "/.git/"), 0.72
TOKEN_SEPARATORS = r"[^\p{IsAlphabetic}\p{N}_]+"
SNIPPET_CHARS = 360


def let(value: Column, use) -> Column:
    """use(value), with the value computed once a row, also where a lambda of ``use`` takes it for every element."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def tokens(text: Column) -> Column:
    """Lower-case runs of letters, digits and underscores of two bytes or more, repeats kept."""
    return F.filter(F.split(F.lower(text), TOKEN_SEPARATORS), lambda t: F.octet_length(t) >= 2)


def query_tokens(query: str) -> list[str]:
    return [t for t in re.split(r"[^\w]+", query.lower()) if len(t.encode()) >= 2]


def query_variants(query: str) -> list[tuple[float, str]]:
    """(weight, text): the query, its tokens joined, its first and last token."""
    query = query.strip()
    terms = query_tokens(query)
    found = [(1.0, query)] if query else []
    found += [(1.08, " ".join(terms))] if terms else []
    return found + ([(0.92, f"{terms[0]} {terms[-1]}")] if len(terms) > 1 else [])


def overlap(terms: list[str], hay: Column) -> Column:
    """Share of terms that occur in the (lower-case) text; repeated terms count again, no terms give 0."""
    if not terms:
        return F.lit(0.0)
    hits = reduce(lambda a, b: a + b, [F.contains(hay, F.lit(t)).cast("int") for t in terms])
    return hits / F.lit(float(len(terms)))


def path_quality(file: Column) -> Column:
    """The factor that a file's place gives its score, between 0.5 and 1.2."""
    low = F.lower(file)
    factors = [F.when(F.contains(low, F.lit(p)), f).otherwise(1.0) for p, f in (*RAISED, *((p, LOWERED_BY) for p in LOWERED))]
    return F.greatest(F.lit(0.5), F.least(F.lit(1.2), reduce(lambda a, b: a * b, factors)))


def lexical_score(terms: list[str], phrase: str, hay: Column, path_hay: Column) -> Column:
    """0.78 of the overlap with title and body, 0.22 if the phrase occurs in path, title and body."""
    return 0.78 * overlap(terms, hay) + 0.22 * F.contains(path_hay, F.lit(phrase.lower())).cast("double")


def lines(text: Column) -> Column:
    """The lines of a text without their ends; a last line end makes no line, empty text has none."""
    body = F.regexp_replace(text, r"\r?\n\z", "")
    return F.when(F.length(text) == 0, F.array().cast("array<string>")).otherwise(F.transform(F.split(body, "\n"), lambda x: F.regexp_replace(x, r"\r\z", "")))


def sections(text: Column, mark) -> Column:
    """An array of (at, head, below): each line that the function marks, its 0-based place, and the lines up to the next one.

    The pieces come from the array of lines within its row, in linear time, so no line is shuffled or sorted.
    """
    def cut(own):
        marks = F.filter(F.transform(own, lambda x, i: F.when(mark(x), i)), lambda i: i.isNotNull())
        return let(marks, lambda m: F.transform(m, lambda at, k: F.struct(at.alias("at"), F.get(own, at).alias("head"), F.slice(own, at + 2, F.coalesce(F.get(m, k + 1), F.size(own)) - at - 1).alias("below"))))

    return let(lines(text), cut)


def window_around(body: Column, at: Column, chars: int = SNIPPET_CHARS) -> Column:
    """A quarter of the characters before the 1-based place, three quarters from it on."""
    start = F.greatest(at - 1 - chars // 4, F.lit(0))
    return F.trim(F.substring(body, start + 1, at - 1 + chars * 3 // 4 - start))


def snippet(body: Column, terms: list[str], chars: int = SNIPPET_CHARS) -> Column:
    """Text around the first term (in term order) that occurs, else the beginning."""
    low = F.lower(body)
    return F.coalesce(*[F.when(F.instr(low, t) > 0, window_around(body, F.instr(low, t), chars)) for t in terms if t], F.substring(body, 1, chars))


def title(path: Column, body: Column) -> Column:
    """Among the first 20 lines the first heading or line of five bytes, whichever comes first; else the file's name."""
    head = F.slice(F.split(body, "\r?\n", 21), 1, 20)  # the rest of a long text is not cut
    fit = F.filter(F.transform(head, lambda x: F.trim(x)), lambda x: F.startswith(x, F.lit("# ")) | (F.octet_length(x) >= 5))
    first = F.get(fit, F.lit(0))
    return F.when(first.isNull(), F.substring_index(path, "/", -1)).when(F.startswith(first, F.lit("# ")), F.trim(F.substring(first, 3, 1 << 30))).otherwise(F.substring(first, 1, 120))


def slice_lines(text: Column, first: int = 1, count: int | None = None, numbered: bool = False) -> Column:
    """Lines from a 1-based number on, each with its number in front if asked for."""
    part = F.slice(lines(text), first, 1 << 30 if count is None else count)
    if numbered:
        part = F.transform(part, lambda x, i: F.concat((i + first).cast("string"), F.lit(": "), x))
    return F.array_join(part, "\n")


def trailing_line(lookup: Column) -> Column:
    """The line number behind a file's name, as in a.md:12."""
    return F.nullif(F.regexp_extract(lookup, r":(\d+)$", 1), F.lit("")).cast("long")


def context_path(path: Column) -> Column:
    """One slash in front, none behind; nothing is the root."""
    trimmed = F.trim(path)
    return F.when(trimmed.isin("", "/"), "/").otherwise(F.regexp_replace(F.when(F.startswith(trimmed, F.lit("/")), trimmed).otherwise(F.concat(F.lit("/"), trimmed)), "/+$", ""))


def preview(text: Column, chars: int = 80) -> Column:
    """White space squeezed, cut to a number of characters with three dots."""
    squeezed = F.trim(F.regexp_replace(text, r"\s+", " "))
    return F.when(F.length(squeezed) > chars, F.concat(F.substring(squeezed, 1, chars), F.lit("..."))).otherwise(squeezed)


def sanitize(name: Column, mark: str) -> Column:
    """Lower case with a mark for every character that is no ASCII letter or digit."""
    return F.lower(F.regexp_replace(name, "[^A-Za-z0-9]", mark))


def escape_html(text: Column) -> Column:
    """The three characters with a meaning in HTML."""
    for char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        text = F.replace(text, F.lit(char), F.lit(entity))
    return text


def highlight(text: Column, query: str) -> Column:
    """Escaped text with every occurrence of the query marked, whatever its case."""
    mark = re.escape(query.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;"))
    return F.regexp_replace(escape_html(text), f"(?i)({mark})", "<mark>$1</mark>")


def collapse_blank(text: Column) -> Column:
    """Lines without trailing blanks, at most one empty line in a row, none in front."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(text, r"[ \t]+(?=\n|\z)", ""), r"\n{3,}", "\n\n"), r"\A\n+", "")


#: What a token holds of Chinese and other characters, and tokens every text costs.
CJK = r"[\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{20000}-\x{2A6DF}\x{2A700}-\x{2EBEF}\x{30000}-\x{3134F}]"
CJK_PER_TOKEN, OTHER_PER_TOKEN, BASE_TOKENS = 1.5, 4.0, 50


def estimated_tokens(text: Column) -> Column:
    total = F.length(text)
    cjk = total - F.length(F.regexp_replace(text, CJK, ""))
    plain = total - F.length(F.regexp_replace(text, r"[\x00-\x7F]", ""))
    return (F.ceil(cjk / CJK_PER_TOKEN) + F.ceil(plain / OTHER_PER_TOKEN) + F.ceil((total - cjk - plain) / OTHER_PER_TOKEN) + BASE_TOKENS).cast("long")


def emergency_cut(text: Column, ratio: Column) -> Column:
    """A share of the text, cut at a line end where one lies behind the first hundred characters."""
    keep = F.floor(F.octet_length(text) * ratio).cast("int")
    head = F.substring(text, F.lit(1), keep)
    end = F.length(head) - F.length(F.substring_index(head, "\n", -1)) - 1
    cut = F.when(end > 100, F.substring(head, F.lit(1), end)).otherwise(head)
    return F.when(F.octet_length(text) <= keep + 100, text).otherwise(F.concat(cut, F.lit("\n\n[Content truncated due to size limitations]")))


def bytes_text(size: Column) -> Column:
    """A size in bytes for people: B, KB, MB, GB with one decimal."""
    value = lambda power: F.format_string("%.1f", size / F.lit(1024.0**power))
    return (
        F.when(size < 1024, F.concat(size.cast("string"), F.lit(" B")))
        .when(size < 1024**2, F.concat(value(1), F.lit(" KB")))
        .when(size < 1024**3, F.concat(value(2), F.lit(" MB")))
        .otherwise(F.concat(value(3), F.lit(" GB")))
    )
