"""The positional index and its matches against a plain scan."""

import hashlib
import random
import re
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import phrases

DOCS, ITEMS = "doc_id bigint, text string", "item_id bigint, text string"


def words(text):
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def windows(text):
    w = words(text)
    return {tuple(w[i : i + 10]) for i in range(max(len(w) - 9, 1))} if w else set()


def brute(docs, items):
    out = Counter()
    for doc_id, text in docs:
        w, hit, own = words(text), set(), set()
        for item, more in items:
            for g in windows(more):
                for i in range(len(w) - len(g) + 1):
                    if tuple(w[i : i + len(g)]) == g:
                        hit |= {*range(i, i + len(g))}
                        own |= {str(item)} if item is not None else set()
        out[doc_id, len(w), len(hit), len(own), hashlib.sha256(",".join(sorted(own)).encode()).hexdigest(), bool(hit)] += 1
    return out


def made(seed, n_docs, alphabet, length):
    rng = random.Random(seed)
    text = lambda n: " ".join(rng.choice(alphabet) for _ in range(n))
    items = [(i % 7, text(rng.choice([1, 2, 9, 10, 11, 14]))) for i in range(10)] + [(None, "Lone Words"), (8, None), (9, "--"), (10, "")]
    docs = [(rng.choice([i, 5, None]), text(rng.randrange(length)) + ", " + (rng.choice(items)[1] or "é").upper() + ".\n" + text(rng.randrange(6))) for i in range(n_docs)]
    return docs + [(1, None), (2, ""), (3, "!!"), (3, "!!"), (4, "a_Lone words-lone WORDS")], items


@pytest.mark.parametrize("seed, alphabet, size, block", [(1, "a b c", 1 << 18, 200_000), (2, "a b", 40, 200_000), (3, "aa É1 c d e", 64, 5)])
def test_contaminated(spark, seed, alphabet, size, block):
    docs, items = made(seed, 60, alphabet.split(), 120)
    rows = spark.createDataFrame([(*d, 1, "x", 2) for d in docs], DOCS + ", uid int, lo string, item_id int").repartition(3)
    got = phrases.contaminated(rows, spark.createDataFrame([(*i, "x") for i in items], ITEMS + ", words string"), size=size, block=block)
    assert Counter(map(tuple, got.collect())) == brute(docs, items)


def test_empty_tables(spark):
    docs, items = spark.createDataFrame([], DOCS), spark.createDataFrame([], ITEMS)
    assert phrases.contaminated(docs, spark.createDataFrame([(1, "a")], ITEMS)).count() == 0
    got = phrases.contaminated(spark.createDataFrame([(1, "a b")], DOCS), items).collect()
    assert [(r["n_words"], r["n_hit"], r["n_items"], r["contaminated"]) for r in got] == [(2, 0, 0, False)]


def near(docs, items, slop):
    out = Counter()
    for doc_id, text in docs:
        w = words(text)
        for item in {i for i, _ in items}:
            for g in {g for i, t in items if i == item for g in windows(t)}:
                for s in range(len(w)):
                    if item is not None and w[s] == g[0] and all(any(0 <= p < len(w) and w[p] == x for p in range(s + k - slop, s + k + slop + 1)) for k, x in enumerate(g) if k):
                        out[doc_id, str(item), s, len(g)] += 1
    return out


@pytest.mark.parametrize("slop, size", [(0, 1 << 18), (2, 1 << 18), (0, 30)])
def test_matches(spark, slop, size):
    docs, items = made(7, 30, "a b c d e f g h".split(), 60)
    docs = [(i, t) for i, (_, t) in enumerate(docs)]
    docs = docs if size > 30 else [(i, " ".join(words(t)[:30])) for i, t in docs]
    stored = phrases.index(spark.createDataFrame(docs, DOCS).repartition(2), size)
    got = phrases.matches(stored, spark.createDataFrame(items, ITEMS), slop).collect()
    assert Counter((r["doc_id"], r["item"], r["start"], r["length"]) for r in got) == near(docs, items, slop)
    with pytest.raises(ValueError):
        phrases.matches(stored, spark.createDataFrame(items, ITEMS), 20)


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet="aZé_1 .\x00\x85　`{", max_size=60))
def test_words(text):
    hashes = phrases._Hashes()
    assert phrases.word_ids(text.encode(), hashes).tolist() == [hashes[w.encode()] for w in words(text)]


def test_words_are_not_cut(monkeypatch):
    monkeypatch.setattr(phrases, "_TEXT", 5)
    hashes = phrases._Hashes()
    text = "one twothreefour " * 3 + "x" * 9000 + " end five5 "
    assert phrases.word_ids(text.encode(), hashes).tolist() == [hashes[w.encode()] for w in words(text)]
