"""Commands over a document index: python -m tessera --index FOLDER COMMAND ..."""

from __future__ import annotations

import argparse
import json

from pyspark.sql import DataFrame

from tessera.index import Index
from tessera.session import local_session
from tessera.sources import files as fs


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="tessera")
    p.add_argument("--index", required=True)
    sub = p.add_subparsers(dest="command", required=True)
    for name in ("search", "ranked", "vsearch", "query"):
        c = sub.add_parser(name)
        c.add_argument("text")
        c.add_argument("-n", "--limit", type=int, default=10)
        c.add_argument("--min-score", type=float, default=0.0)
    for name in ("ingest", "embed"):
        sub.add_parser(name).add_argument("--force", action="store_true")
    for name in ("status", "cleanup"):
        sub.add_parser(name)
    c = sub.add_parser("get")
    c.add_argument("lookup")
    c.add_argument("--from-line", type=int)
    c.add_argument("-l", "--lines", type=int)
    c.add_argument("--line-numbers", action="store_true")
    c = sub.add_parser("multi-get")
    c.add_argument("pattern")
    c.add_argument("--max-bytes", type=int, default=10_240)
    sub.add_parser("ls").add_argument("prefix", nargs="?", default="")
    c = sub.add_parser("collection")
    c.add_argument("action", choices=("add", "remove", "rename", "list"))
    c.add_argument("names", nargs="*")
    c.add_argument("--pattern", default="**/*.md")
    c = sub.add_parser("context")
    c.add_argument("action", choices=("add", "remove", "list", "check"))
    c.add_argument("text", nargs="?")
    c.add_argument("--collection")
    c.add_argument("--path", default="/")
    return p


def run(index: Index, a: argparse.Namespace):
    """What a command returns: rows, a text or counters."""
    if a.command in ("search", "ranked", "vsearch", "query"):
        return getattr(index, a.command)(a.text, a.limit, a.min_score)
    if a.command in ("ingest", "embed"):
        return getattr(index, a.command)(a.force)
    if a.command in ("status", "cleanup"):
        return getattr(index, a.command)()
    if a.command == "get":
        return index.get(a.lookup, a.from_line, a.lines, a.line_numbers)
    if a.command == "multi-get":
        return index.multi_get(a.pattern, a.max_bytes)
    if a.command == "ls":
        return index.ls(a.prefix)
    config = index.config()
    if a.command == "collection":
        if a.action == "list":
            return config.get("collections", {})
        change = {"add": lambda: fs.add_collection(config, a.names[0], a.names[1], a.pattern), "remove": lambda: fs.remove_collection(config, a.names[0]), "rename": lambda: fs.rename_collection(config, *a.names)}
    else:
        if a.action == "list":
            return fs.collections_config(index.spark, config)[1]
        if a.action == "check":
            return index.context_gaps()
        change = {"add": lambda: fs.add_context(config, a.text, a.collection, a.path), "remove": lambda: fs.remove_context(config, a.collection, a.path)}
    index.configure(change[a.action]())
    return index.config()


def main(arguments: list[str] | None = None) -> None:
    a = parser().parse_args(arguments)
    spark = local_session()
    spark.sparkContext.setLogLevel("ERROR")
    out = run(Index(spark, a.index), a)
    if isinstance(out, DataFrame):
        for row in out.toLocalIterator():
            print(json.dumps(row.asDict(recursive=True), default=str, ensure_ascii=False))
    else:
        print(out if isinstance(out, str) else json.dumps(out, ensure_ascii=False))


if __name__ == "__main__":
    main()
