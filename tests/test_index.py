"""The index from configuration to clean-up, through its class and its commands."""

import pytest
from pyspark.sql import functions as F

from tessera.__main__ import parser, run
from tessera.index import HeuristicEngine, Index

ALPHA = "# Rust Ownership\n\nThe borrow checker enforces aliasing rules."
BETA = "# Search Tuning\n\nFalse positives and false negatives can be balanced."


@pytest.fixture
def index(spark, tmp_path):
    root = tmp_path / "notes"
    (root / "sub").mkdir(parents=True)
    (root / "alpha.md").write_text(ALPHA)
    (root / "sub" / "beta.md").write_text(BETA)
    own = Index(spark, str(tmp_path / "index"))
    command(own, "collection", "add", "notes", str(root))
    return own


def command(index, *arguments):
    return run(index, parser().parse_args(["--index", index.path, *arguments]))


def test_pipeline_of_commands(index, tmp_path):
    assert command(index, "ingest") == {"indexed": 2, "updated": 0, "unchanged": 0, "deactivated": 0}
    assert command(index, "embed") == 2 and command(index, "embed") == 0
    command(index, "context", "add", "about search", "--collection", "notes", "--path", "sub")
    command(index, "context", "add", "everything")
    hits = command(index, "search", "borrow checker").collect()
    assert hits[0]["file"] == "notes/alpha.md" and hits[0]["context"] == "everything" and "borrow" in hits[0]["snippet"]
    assert command(index, "vsearch", "ownership aliasing rules").first()["file"] == "notes/alpha.md"
    both = command(index, "query", "false positives balanced").collect()
    assert both[0]["file"] == "notes/sub/beta.md" and both[0]["context"] == "about search"
    assert command(index, "get", "alpha.md", "--from-line", "3", "--line-numbers") == "3: The borrow checker enforces aliasing rules."
    assert command(index, "get", "notes/alpha.md:3", "-l", "1") == "The borrow checker enforces aliasing rules."
    assert command(index, "get", "nothing.md") is None
    assert [r["file"] for r in command(index, "ls", "notes/s").collect()] == ["notes/sub/beta.md"]
    assert {r["error"] is None for r in command(index, "multi-get", "notes/**/*.md", "--max-bytes", "65").collect()} == {True, False}
    assert [(r["collection"], r["files"]) for r in command(index, "status").collect()] == [("notes", 2)]
    assert [r["top"] for r in command(index, "context", "check").collect()] == ["alpha.md"]


def test_update_delete_and_cleanup(index, tmp_path):
    command(index, "ingest")
    command(index, "embed")
    (tmp_path / "notes" / "alpha.md").write_text("# Changed\n")
    (tmp_path / "notes" / "sub" / "beta.md").unlink()
    assert command(index, "ingest") == {"indexed": 0, "updated": 1, "unchanged": 0, "deactivated": 1}
    assert command(index, "ingest") == {"indexed": 0, "updated": 0, "unchanged": 1, "deactivated": 0}
    assert index.documents().where("active").count() == 1
    assert command(index, "cleanup") == {"documents": 1, "content": 2, "vectors": 2}
    assert command(index, "search", "Changed").count() == 1
    (tmp_path / "notes" / "sub" / "beta.md").write_text(BETA)
    assert command(index, "ingest")["indexed"] == 1


def test_engine_can_be_replaced(spark, index):
    class Loud(HeuristicEngine):
        def rerank(self, query, hits):
            return super().rerank(query, hits).withColumn("score", F.lit(9.0))

    command(index, "ingest")
    loud = Index(spark, index.path, Loud())
    assert {r["score"] for r in loud.query("rust", telemetry=True).collect()} == {9.0}
    with pytest.raises(ValueError):
        loud.query("  ")
