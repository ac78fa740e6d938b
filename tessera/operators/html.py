"""Markdown as HTML: headings, paragraphs, lists, quotes, fenced code, tables, task items and the usual inline marks.

A block parser over lines and an inline parser over a block's text; each document is rendered by itself in an Arrow pass.
Left out of the grammar: setext headings, indented code, link definitions, raw HTML (it is shown as text).
"""

from __future__ import annotations

import html
import re

from pyspark.sql import DataFrame

_PAGE = """<!DOCTYPE html>
<html lang="en">
<head>
<meta charset="utf-8">
<title>{title}</title>
</head>
<body>
{body}
</body>
</html>"""
_MARK = re.compile(r"(?P<ticks>`+)(?P<code>.+?)(?P=ticks)(?!`)|\\(?P<escape>[!-/:-@\[-`{-~])|(?P<image>!?)\[(?P<label>[^\[\]]*)\]\((?P<to>[^()\s]*)(?:\s+\"[^\"]*\")?\)|<(?P<auto>(?:https?|mailto):[^<>\s]+)>|(?P<strong>\*\*|__)(?=\S)(?P<bold>.+?)(?<=\S)(?P=strong)|(?P<em>[*_])(?=\S)(?P<slant>[^*_]+?)(?<=\S)(?P=em)(?!\w)|~~(?P<gone>[^~]+)~~|(?P<break> {2,}\n)", re.S)
_ITEM = re.compile(r"^(\s*)([-*+]|\d{1,9}[.)])\s+(.*)$")
_FENCE = re.compile(r"^\s{0,3}(```+|~~~+)\s*([\w+#.-]*)[^`]*$")


def inline(text: str) -> str:
    """A block's text with its inline marks as tags and everything else escaped."""
    out, at = [], 0
    for m in _MARK.finditer(text):
        out.append(html.escape(text[at : m.start()], quote=False))
        at = m.end()
        if m["code"] is not None:
            code = m["code"].replace("\n", " ")
            out.append(f"<code>{html.escape(code[1:-1] if len(code) > 2 and code[0] == code[-1] == ' ' else code, quote=False)}</code>")
        elif m["escape"]:
            out.append(html.escape(m["escape"], quote=False))
        elif m["label"] is not None:
            to = html.escape(m["to"])
            out.append(f'<img src="{to}" alt="{html.escape(m["label"])}" />' if m["image"] else f'<a href="{to}">{inline(m["label"])}</a>')
        elif m["auto"]:
            out.append(f'<a href="{html.escape(m["auto"])}">{html.escape(m["auto"], quote=False)}</a>')
        elif m["bold"]:
            out.append(f"<strong>{inline(m['bold'])}</strong>")
        elif m["slant"]:
            out.append(f"<em>{inline(m['slant'])}</em>")
        elif m["gone"]:
            out.append(f"<del>{inline(m['gone'])}</del>")
        else:
            out.append("<br />\n")
    return "".join(out) + html.escape(text[at:], quote=False)


def _cells(line: str) -> list[str]:
    return [c.strip().replace("\\|", "|") for c in re.split(r"(?<!\\)\|", line.strip().removeprefix("|").removesuffix("|"))]


def _table(lines: list[str]) -> str:
    head, rows = _cells(lines[0]), [_cells(x) for x in lines[2:]]
    top = "".join(f"<th>{inline(c)}</th>" for c in head)
    body = "".join("<tr>" + "".join(f"<td>{inline(c)}</td>" for c in (r + [""] * len(head))[: len(head)]) + "</tr>\n" for r in rows)
    return f"<table><thead><tr>{top}</tr></thead><tbody>\n{body}</tbody></table>"


def _list(lines: list[str], at: int, depth_left: int) -> tuple[str, int]:
    """The list that begins at a line, and the line after it; deeper items and lines indented under an item are its own."""
    first = _ITEM.match(lines[at])
    depth, ordered, items = len(first[1]), first[2][0].isdigit(), []
    while at < len(lines) and (m := _ITEM.match(lines[at])) and len(m[1]) >= depth and m[2][0].isdigit() == ordered:
        if len(m[1]) > depth + 1:
            break
        own, under, width = m[3], [], len(m[1]) + len(m[2]) + 1
        at += 1
        while at < len(lines) and (not lines[at].strip() and at + 1 < len(lines) and len(lines[at + 1]) - len(lines[at + 1].lstrip()) >= 2 + depth and lines[at + 1].strip() or lines[at].strip() and len(lines[at]) - len(lines[at].lstrip()) >= min(width, depth + 2)):
            under.append(lines[at])
            at += 1
        cut = min((len(x) - len(x.lstrip()) for x in under if x.strip()), default=0)
        task = re.match(r"\[([ xX])\]\s+(.*)$", own)
        text = f'<input disabled="" type="checkbox"{" checked=" + chr(34) * 2 if task[1] in "xX" else ""}/>\n{inline(task[2])}' if task else inline(own)
        items.append(f"<li>{text}{chr(10) + body(chr(10).join(x[cut:] for x in under), depth_left - 1) + chr(10) if under else ''}</li>\n")
    tag = "ol" if ordered else "ul"
    start = f' start="{int(re.match(r"[0-9]+", first[2])[0])}"' if ordered and not first[2].startswith("1") else ""
    return f"<{tag}{start}>\n{''.join(items)}</{tag}>", at


def body(text: str, depth_left: int = 40) -> str:
    """The blocks of a text, one after the other; what is nested deeper than ``depth_left`` is shown as text."""
    lines, out, at, paragraph = text.replace("\r\n", "\n").split("\n"), [], 0, []

    def flush() -> None:
        if paragraph:
            out.append(f"<p>{inline(chr(10).join(x.lstrip() for x in paragraph).rstrip())}</p>")
            paragraph.clear()

    while at < len(lines):
        line = lines[at]
        if m := _FENCE.match(line):
            flush()
            end = at + 1
            while end < len(lines) and not re.match(rf"\s{{0,3}}{re.escape(m[1])}\s*$", lines[end]):
                end += 1
            named = f' class="language-{html.escape(m[2])}"' if m[2] else ""
            out.append(f"<pre><code{named}>{html.escape(''.join(x + chr(10) for x in lines[at + 1 : end]), quote=False)}</code></pre>")
            at = end + 1
        elif m := re.match(r"^\s{0,3}(#{1,6})(?:\s+(.*?))?(?:\s+#+)?\s*$", line):
            flush()
            out.append(f"<h{len(m[1])}>{inline(m[2] or '')}</h{len(m[1])}>")
            at += 1
        elif re.match(r"^\s{0,3}([-*_])(?:\s*\1){2,}\s*$", line):
            flush()
            out.append("<hr />")
            at += 1
        elif depth_left and line.lstrip().startswith(">"):
            flush()
            end = at
            while end < len(lines) and lines[end].lstrip().startswith(">"):
                end += 1
            out.append(f"<blockquote>\n{body(chr(10).join(re.sub(r'^ *> ?', '', x) for x in lines[at:end]), depth_left - 1)}\n</blockquote>")
            at = end
        elif depth_left and _ITEM.match(line) and (not paragraph or not line.lstrip()[0].isdigit()):
            flush()
            made, at = _list(lines, at, depth_left)
            out.append(made)
        elif "|" in line and at + 1 < len(lines) and re.match(r"^\s*\|?\s*:?-+:?\s*(?:\|\s*:?-+:?\s*)*\|?\s*$", lines[at + 1]) and len(_cells(line)) == len(_cells(lines[at + 1])):
            flush()
            end = at + 2
            while end < len(lines) and lines[end].strip() and "|" in lines[end]:
                end += 1
            out.append(_table(lines[at:end]))
            at = end
        elif not line.strip():
            flush()
            at += 1
        else:
            paragraph.append(line)
            at += 1
    flush()
    return "\n".join(out)


def page(text: str, title: str) -> str:
    return _PAGE.format(title=html.escape(title), body=body(text))


def _run(batches):
    import pyarrow as pa

    for b in batches:
        pages = [page(text or "", title or "") for title, text in zip(b.column("title").to_pylist(), b.column("body").to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([b.column("path"), pa.array(pages, pa.string())], names=["path", "html"])


def rendered(docs: DataFrame) -> DataFrame:
    """(path, html): a page for each document (path, title, body); null bodies make empty pages, titles are escaped."""
    from tessera.session import workers_import

    workers_import(docs.sparkSession)
    return docs.select("path", "title", "body").mapInArrow(_run, "path string, html string")
