"""Quality rules as a short-circuit cascade.

Each rule rejects a text on its own figures. Cost and rejections of every rule are measured on a bounded sample, and the
rules run in the order of rejections per second among what the earlier ones leave; a text stops at the first rule that
rejects it. A verdict is the same in any order, so timing decides only how fast it comes.

The method's own rules and their thresholds are those of published filters of web text (word length, symbols, words with a
letter, stop words, bullets, ellipses, repeated lines and n-grams), and the share of capitals; none is fitted to labels.
"""

from __future__ import annotations

import time
from collections import Counter
from collections.abc import Callable
from functools import cached_property

import numpy as np
from pyspark.sql import DataFrame

from tessera.llm.common import only, prepare, released, texts

#: Documents at most on which costs and rejections are measured.
SAMPLE = 1000
SYMBOLS, UPPER, LETTERS = b"#*$%&|<>", bytes(range(65, 91)), bytes([*range(65, 91), *range(97, 123)])
SPACE = b" \t\n\v\f\r"
#: ASCII characters that are neither letters nor white space.
NO_LETTERS = bytes(c for c in range(128) if c not in LETTERS and c not in SPACE)
#: Frequent words of English, German, French, Spanish, Italian, Portuguese and Dutch; two of them make running text.
STOP_WORDS = frozenset(
    w.encode() for w in (
        "the be to of and that have with der die das und ist nicht ein von le la les et des est une dans el los que y en por una il che di per un o os e do da em het van een niet"
    ).split()
)
#: Fixed values of published filters: the share of a text's word bytes that its heaviest repeated n-gram may hold.
TOP_GRAM = {2: 0.20, 3: 0.18, 4: 0.16}


class Text:
    """A text (UTF-8) whose figures are computed when a rule first asks for them."""

    def __init__(self, text: bytes) -> None:
        self.text = text

    def _count(self, chars: bytes) -> int:
        return len(self.text) - len(self.text.translate(None, chars))

    @cached_property
    def words(self) -> list[bytes]:
        return self.text.split()

    @cached_property
    def n_words(self) -> int:
        return len(self.words)

    @cached_property
    def word_chars(self) -> int:
        return len(b"".join(self.words).decode("utf-8", "replace"))

    @cached_property
    def n_symbols(self) -> int:
        return self._count(SYMBOLS)

    @cached_property
    def n_upper(self) -> int:
        return self._count(UPPER)

    @cached_property
    def n_letters(self) -> int:
        return self._count(LETTERS)

    @cached_property
    def lines(self) -> list[bytes]:
        return [x for x in self.text.split(b"\n") if x.strip()]

    @cached_property
    def n_dup_lines(self) -> int:
        return len(self.lines) - len(set(self.lines))

    @cached_property
    def n_alphabetic(self) -> int:
        """Words with a letter; all code points beyond ASCII count as letters."""
        return len(self.text.translate(None, NO_LETTERS).split())

    @cached_property
    def n_stop_words(self) -> int:
        return len(STOP_WORDS.intersection(self.text.lower().split()))

    @cached_property
    def n_bullets(self) -> int:
        return sum(x.lstrip(SPACE).startswith((b"-", b"*", "•".encode())) for x in self.lines)

    @cached_property
    def n_ellipses(self) -> int:
        return sum(x.rstrip(SPACE).endswith((b"...", "…".encode())) for x in self.lines)

    @cached_property
    def line_bytes(self) -> int:
        return sum(map(len, self.lines))

    @cached_property
    def dup_line_bytes(self) -> int:
        return self.line_bytes - sum(map(len, set(self.lines)))

    @cached_property
    def word_bytes(self) -> int:
        return sum(map(len, self.words))

    def repeated(self, n: int) -> dict[tuple, int]:
        """The windows of n words that occur more than once, with their counts."""
        windows = list(zip(*(self.words[i:] for i in range(n)), strict=False))
        return {} if len(set(windows)) == len(windows) else {w: k for w, k in Counter(windows).items() if k > 1}

    def top_gram_bytes(self, n: int) -> int:
        """The most bytes that one repeated window of n words holds, all its places together."""
        return max((k * sum(map(len, w)) for w, k in self.repeated(n).items()), default=0)

    @cached_property
    def n_repeat_words(self) -> int:
        often = self.repeated(3)
        if not often:
            return 0
        at = np.flatnonzero([w in often for w in zip(self.words, self.words[1:], self.words[2:], strict=False)])
        seen = np.zeros(self.n_words, dtype=bool)
        for k in range(3):
            seen[at + k] = True
        return int(seen.sum())


#: Rules by name; each says whether it rejects. The first two are the base, the rest the method's own, which ask for stop
#: words only where half of the characters or more are letters A to Z.
RULES: dict[str, Callable[[Text], bool]] = {
    "short": lambda t: t.n_words < 50,
    "repeats": lambda t: 100 * t.n_repeat_words > 50 * t.n_words,
    "symbols": lambda t: 10 * t.n_symbols > t.n_words,
    "word_length": lambda t: t.word_chars < 3 * t.n_words or t.word_chars > 10 * t.n_words,
    "alphabetic": lambda t: 10 * t.n_alphabetic < 8 * t.n_words,
    "stop_words": lambda t: t.n_stop_words < 2 and 2 * t.n_letters >= t.word_chars,
    "capitals": lambda t: 10 * t.n_upper > 4 * t.n_letters,
    "bullets": lambda t: 10 * t.n_bullets > 9 * len(t.lines),
    "ellipses": lambda t: 10 * t.n_ellipses > 3 * len(t.lines),
    "dup_lines": lambda t: 10 * t.n_dup_lines > 3 * len(t.lines),
    "dup_line_bytes": lambda t: 10 * t.dup_line_bytes > 2 * t.line_bytes,
    **{f"top_{n}_gram": lambda t, n=n, most=most: 100 * t.top_gram_bytes(n) > round(100 * most) * t.word_bytes for n, most in TOP_GRAM.items()},
}
BASE = ("short", "repeats")


def kept(text: Text, order: list[str]) -> bool:
    """Whether no rule rejects; later rules are not asked after one does."""
    return not any(RULES[name](text) for name in order)


def _measure(batches):
    import pyarrow as pa

    for b in batches:
        rejected, cost = {k: [] for k in RULES}, {k: [] for k in RULES}
        for raw in texts(b.column("text")):
            for name, rule in RULES.items():
                t, began = Text(raw), time.perf_counter()
                rejected[name].append(rule(t))
                cost[name].append(time.perf_counter() - began)
        yield pa.RecordBatch.from_arrays([*(pa.array(x, pa.bool_()) for x in rejected.values()), *(pa.array(x, pa.float64()) for x in cost.values())], names=[*RULES, *(f"{k}_s" for k in RULES)])


def rank(rejected: np.ndarray, cost: np.ndarray, names: list[str]) -> list[str]:
    """Rules in the order of rejections per cost among the sample rows (first axis) that those before them leave."""
    order, left = [], np.ones(len(rejected), dtype=bool)
    todo = list(range(len(names)))
    while todo:
        rates = [(rejected[left, i].sum() / max(cost[left, i].sum(), 1e-9), -cost[:, i].sum()) for i in todo]
        i = todo.pop(max(range(len(todo)), key=lambda k: rates[k]))
        order.append(names[i])
        left &= ~rejected[:, i].astype(bool)
    return order


def learn_order(docs: DataFrame, sample: int = SAMPLE) -> list[str]:
    """The order of the rules from a sample of at most ``sample`` documents; an empty table leaves the order as listed."""
    names = list(RULES)
    n = docs.count()
    part = only(docs, "text")
    if n > sample:
        part = part.sample(fraction=min(1.0, 1.5 * sample / n), seed=11).limit(sample)
    schema = ", ".join([*(f"{k} boolean" for k in RULES), *(f"{k}_s double" for k in RULES)])
    rows = part.mapInArrow(_measure, schema).collect()
    if not rows:
        return names
    table = np.array([list(r) for r in rows], dtype=float)
    return rank(table[:, : len(names)], table[:, len(names) :], names)


def _figures(order: list[str]):
    def run(batches):
        import pyarrow as pa

        for b in batches:
            rows = []
            for raw in texts(b.column("text")):
                t = Text(raw)
                stays = kept(t, order)
                failed = RULES["short"](t) or RULES["repeats"](t)
                rows.append((t.n_words, t.word_chars, t.n_symbols, t.n_dup_lines, t.n_repeat_words, failed, stays))
            columns = list(zip(*rows, strict=True)) if rows else [()] * 7
            kinds = [pa.int64()] * 5 + [pa.bool_()] * 2
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"])

    return run


def figures(docs: DataFrame, order: list[str] | None = None) -> DataFrame:
    """A row per document: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept.

    Null text counts as empty (no words, base_failed); null and repeated doc_ids keep a row each; an empty table gives
    none. Further columns are not read. Memory holds one Arrow batch and the words of one text.
    """
    prepare(docs.sparkSession)
    order = order or learn_order(docs)
    schema = "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, kept boolean"
    slim = only(docs, "doc_id", "text")
    return slim.select(slim["doc_id"].cast("long").alias("doc_id"), "text").mapInArrow(released(_figures(order)), schema)


def _stay(order: list[str]):
    def run(batches):
        import pyarrow as pa

        for b in batches:
            yield b.filter(pa.array([kept(Text(raw), order) for raw in texts(b.column("text"))], pa.bool_()))

    return run


def keep(docs: DataFrame, order: list[str] | None = None) -> DataFrame:
    """The documents that no rule rejects, with all their columns; each text stops at its first rejection.

    Null and empty texts have no words and go; null and repeated doc_ids are judged by their texts alone; an empty table
    gives none. Texts are read whole; columns of any name stay as they are.
    """
    prepare(docs.sparkSession)
    return docs.mapInArrow(released(_stay(order or learn_order(docs))), docs.schema)
