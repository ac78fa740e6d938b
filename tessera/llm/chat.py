r"""Chat formatting whose grammar survives a round trip.

A turn is written as ``### role:``, a line end, its text, a line end, ``</turn>`` and a line end. Control strings are
``### `` and ``</turn>``; one that stands in a text gets a backslash in front, and so does one that has backslashes in
front already, so a reader takes one backslash off and reads none that has any as control. Every turn is rendered plain
first, parsed, compared with its source, and rendered again with what the parser read otherwise escaped, until the parse
is identical. Turns end themselves, so parses of turns are parses of whole conversations.

Turns are rendered where they lie, then dealt by conversation and sorted; a task reads turns one after the other and
keeps a digest per conversation, never its text, so a very long conversation costs time in one task but no memory.
"""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import only, prepare

OPEN, MIDDLE, CLOSE = "### ", ":\n", "\n</turn>\n"
LEARNED_ROLE = "assistant"
_CONTROL = re.compile(r"(?<!\\)(\\*+)(### |</turn>)")  # a run of backslashes counts whole
_ROLE_OUT = {"\\": "\\\\", ":": "\\:", "\n": "\\n"}
_ROLE_IN = {"\\": "\\", ":": ":", "n": "\n"}


class GrammarError(ValueError):
    """The text is no sequence of turns."""


def _role_out(role: str) -> str:
    return "".join(_ROLE_OUT.get(c, c) for c in role)


def parse(rendered: str) -> list[tuple[str, str, int, int]]:
    """(role, text, start, end) of each turn; start and end bound the text as written, in code points."""
    turns, at = [], 0
    while at < len(rendered):
        if not rendered.startswith(OPEN, at):
            raise GrammarError(f"no turn begins at {at}")
        at += len(OPEN)
        role = []
        while not rendered.startswith(MIDDLE, at):
            c = rendered[at : at + 1]
            if c == "\\":
                at += 1
                c = _ROLE_IN.get(rendered[at : at + 1], "")
            if not c:
                raise GrammarError(f"no role ends at {at}")
            role.append(c)
            at += 1
        at += len(MIDDLE)
        start, pieces = at, []
        while True:
            m = _CONTROL.search(rendered, at)
            if m is None:
                raise GrammarError(f"the turn at {start} has no end")
            if m[1]:
                pieces += [rendered[at : m.start()], m[1][1:], m[2]]
                at = m.end()
                continue
            end = m.start() - 1
            if m[2] == OPEN or not rendered.startswith(CLOSE, end) or end < start:
                raise GrammarError(f"control string at {m.start()} out of place")
            pieces.append(rendered[at:end])
            turns.append(("".join(role), "".join(pieces), start, end))
            at = end + len(CLOSE)
            break
    return turns


def _write(role: str, text: str, escaped: frozenset[int]) -> str:
    body, at = [], 0
    for i in sorted(escaped):
        body += [text[at:i], "\\"]
        at = i
    return f"{OPEN}{_role_out(role)}{MIDDLE}{''.join(body)}{text[at:]}{CLOSE}"


def _read(rendered: str) -> list[tuple[str, str]] | None:
    try:
        return [t[:2] for t in parse(rendered)]
    except GrammarError:
        return None


def render(role: str, text: str) -> str:
    """The turn, with as much escaped as it takes for the parse to give the turn back."""
    escaped: frozenset[int] = frozenset()
    while True:
        rendered = _write(role, text, escaped)
        if _read(rendered) == [(role, text)]:
            return rendered
        conflicts = frozenset(m.start() for m in _CONTROL.finditer(text)) - escaped
        if not conflicts:
            raise GrammarError("nothing is left to escape")
        escaped |= conflicts


def format_turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, rendered) of every turn.

    Null text and null roles count as empty; null conv_ids are one conversation, null turns come first. Further columns
    are not read.
    """
    prepare(conversations.sparkSession)
    slim = only(conversations, "conv_id", "turn", "role", "text").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    )

    def run(batches):
        import pyarrow as pa

        for b in batches:
            out = [render(r, t) for r, t in zip(b.column("role").to_pylist(), b.column("text").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("conv_id"), b.column("turn"), b.column("role"), pa.array(out, pa.string())], names=["conv_id", "turn", "role", "rendered"])

    return slim.mapInArrow(run, "conv_id bigint, turn bigint, role string, rendered string")


class _Digest:
    def __init__(self) -> None:
        self.turns, self.loss, self.n, self.loss_chars, self.chars = hashlib.sha256(), hashlib.sha256(), 0, 0, 0

    def add(self, rendered: str) -> None:
        for role, text, _, _ in parse(rendered):
            raw = text.encode("utf-8", "surrogatepass")
            self.turns.update(role.encode() + b"\n" + raw + b"\n")
            if role == LEARNED_ROLE:
                self.loss.update(raw)
                self.loss_chars += len(text)
            self.n += 1
        self.chars += len(rendered)


_DIGEST = "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint"


def _digests(batches):
    import pyarrow as pa

    names = [x.split()[0] for x in _DIGEST.split(", ")]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    now, digest = None, None

    def row():
        return (now[0], digest.n, digest.turns.hexdigest(), digest.loss_chars, digest.loss.hexdigest(), digest.chars)

    for b in batches:
        done = []
        for conv, rendered in zip(b.column("conv_id").to_pylist(), b.column("rendered").to_pylist(), strict=True):
            if now is None or now[0] != conv:
                if now is not None:
                    done.append(row())
                now, digest = (conv,), _Digest()
            digest.add(rendered)
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*done, strict=True), kinds, strict=True)], names=names)
    if now is not None:
        yield pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row(), kinds, strict=True)], names=names)


def digests(formatted: DataFrame) -> DataFrame:
    """A row per conversation, read back from its rendered turns: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars.

    Turns with the same number follow by role, then rendered text; repeated rows count as often as they occur; an empty
    table gives none.
    """
    prepare(formatted.sparkSession)
    dealt = formatted.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "rendered")
    return dealt.select("conv_id", "rendered").mapInArrow(_digests, _DIGEST)
