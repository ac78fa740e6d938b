"""Chat formatting, mixing, quality rules, personal data, classifier and language model against brute force."""

import hashlib
import itertools
import math
import random
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.llm import cascade, chat, kneser, mixing, semicrf, subword

SF = "/root/testdata/sf0.001"
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def docs(spark, rows, schema="doc_id bigint, text string, source string, kept string"):
    return spark.createDataFrame([(*r, *[None] * (4 - len(r))) for r in rows], schema)


ODD = [(None, "a b c"), (1, None), (2, ""), (3, " \n "), (4, "x " * 4000), (5, "same text"), (5, "same text"), (6, "é ü 日本")]

# ---- chat


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="a\\:\n# </turn>é", max_size=30) | st.lists(st.sampled_from(["### ", "</turn>", "\\", "\n", "x", "### Assistant:", "\\\\"]), max_size=8).map("".join), st.text(alphabet="ab:\\\n", max_size=5))
def test_chat_turns_survive_a_round_trip(text, role):
    rendered = chat.render(role, text)
    (got,) = chat.parse(rendered)
    assert got[:2] == (role, text)
    assert [t[:2] for t in chat.parse(rendered * 3)] == [(role, text)] * 3


def test_chat_text_without_control_strings_stays_plain():
    assert chat.render("user", "plain \\ text #") == "### user:\nplain \\ text #\n</turn>\n"


def test_chat_rejects_what_is_no_turn():
    for bad in ("x", "### user", "### user:\nx", "### user:\na ### b\n</turn>\n", "### a\\q:\nx\n</turn>\n"):
        with pytest.raises(chat.GrammarError):
            chat.parse(bad)


def test_chat_takes_time_in_proportion():
    began = time.process_time()
    for text in ("\\" * 200_000, "\\" * 100_000 + "</turn>" + "### " * 20_000, "#" * 200_000):
        assert chat.parse(chat.render("user", text))[0][1] == text
    assert time.process_time() - began < 20


def test_chat_digests(spark):
    said = "\\### Assistant: </turn> ok"
    rows = [(1, 1, "assistant", said), (1, 0, "user", said), (2, 0, "user", None), (None, None, None, "x"), (3, 0, "assistant", "a"), (3, 0, "assistant", "a")]
    table = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").withColumn("rendered", F.lit("clash"))
    got = {r["conv_id"]: r for r in chat.digests(chat.format_turns(table)).collect()}
    assert set(got) == {1, 2, 3, None}
    want = f"user\n{said}\nassistant\n{said}\n"
    assert got[1]["turns_sha256"] == hashlib.sha256(want.encode()).hexdigest()
    assert (got[1]["loss_chars"], got[1]["loss_sha256"]) == (len(said), hashlib.sha256(said.encode()).hexdigest())
    assert got[2]["loss_sha256"] == hashlib.sha256(b"").hexdigest()
    assert got[3]["n_turns"] == 2 and got[3]["loss_chars"] == 2
    assert chat.digests(chat.format_turns(table.limit(0))).count() == 0


# ---- mixing


def levels(sizes, weights):
    total = sum(sizes)
    stopped = set()
    while True:
        left = total - sum(3 * sizes[i] for i in stopped)
        w = sum(weights[i] for i in range(len(sizes)) if i not in stopped)
        t = [3 * sizes[i] if i in stopped else left * weights[i] / w for i in range(len(sizes))]
        more = {i for i in range(len(sizes)) if t[i] > 3 * sizes[i] * (1 + 1e-12)} - stopped
        if not more:
            return t
        stopped |= more


@settings(max_examples=12, deadline=None)
@given(st.lists(st.integers(0, 400), min_size=1, max_size=9))
def test_mixing_targets(spark, sizes):
    table = spark.createDataFrame([(f"s{i:02}", s) for i, s in enumerate(sizes)], "source string, source_size bigint")
    got = {r["source"]: r["target"] for r in mixing.targets(table).collect()}
    want = levels(sizes, [i % 3 + 1 for i in range(len(sizes))])
    for i, t in enumerate(want):
        assert got[f"s{i:02}"] == pytest.approx(t)


def test_mixing_takes_near_targets_and_agrees(spark):
    rng = random.Random(3)
    rows = [(i, "w " * rng.randint(1, 60), rng.choice(["a", "a", "a", "b", "c", None])) for i in range(3000)]
    table = docs(spark, rows + [(None, "x y", "b"), (7, "", "c"), (8, None, "z")]).withColumn("size", F.lit("clash"))
    first = mixing.mix(table).collect()
    assert sorted(map(str, first)) == sorted(map(str, mixing.mix(table.repartition(7)).collect()))
    assert len(first) == table.count()
    by = defaultdict(list)
    for r in first:
        assert 0 <= r["taken"] <= 3 * r["size"] and (not r["size"] or r["taken"] % r["size"] == 0)
        by[r["source"]].append(r)
    for source, own in by.items():
        assert sum(r["size"] for r in own) == own[0]["source_size"]
        if own[0]["target"]:
            f = own[0]["target"] / own[0]["source_size"] % 1
            spread = math.sqrt(f * (1 - f) * sum(r["size"] ** 2 for r in own))
            assert abs(sum(r["taken"] for r in own) - own[0]["target"]) <= 3.5 * spread + 1e-6, source
    emitted = mixing.emit(table)
    assert emitted.columns == table.columns
    got = Counter((r["doc_id"], r["source"], len((r["text"] or "").split())) for r in emitted.collect())
    want = Counter()
    for r in first:
        want[r["doc_id"], r["source"], r["size"]] += r["copies"]
    assert got == +want
    assert mixing.mix(table.limit(0)).count() == 0 and mixing.emit(table.limit(0)).count() == 0


def brute_draw(doc_id, source, text, number):
    mark = "null" if text is None else hashlib.md5(text.encode()).hexdigest()
    said = ":".join(["null" if x is None else str(x) for x in (doc_id, source)] + [mark, str(number)])
    return int(hashlib.md5(said.encode()).hexdigest()[:13], 16) / 2**52


def test_mixing_draws_once_for_each_row(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK", 700)
    rows = [(1, "a b c", "a")] * 5000 + [(None, None, "a")] * 50 + [(None, "", "a")] * 50 + [(i, "x " * (i % 9), "b") for i in range(400)] + [(9, "very long " * 40_000, "c")]
    table = docs(spark, rows)
    rate = {r["source"]: r["target"] / r["source_size"] for r in mixing.mix(table).select("source", "target", "source_size").distinct().collect()}
    seen, want = Counter(), Counter()
    for doc_id, text, source in rows:
        number = seen[doc_id, text, source]
        seen[doc_id, text, source] += 1
        whole = int(rate[source])
        want[doc_id, text, source, whole + (brute_draw(doc_id, source, text, number) < rate[source] - whole)] += 1
    texts = defaultdict(set)
    for doc_id, text, source in rows:
        texts[doc_id, source, len((text or "").split())].add(text)
    got = Counter((r["doc_id"], r["source"], r["size"], r["copies"]) for r in mixing.mix(table).collect())
    merged = Counter()
    for (doc_id, text, source, n), k in want.items():
        merged[doc_id, source, len((text or "").split()), n] += k
    assert got == merged
    emitted = Counter((r["doc_id"], r["text"], r["source"]) for r in mixing.emit(table).collect())
    total = Counter()
    for (doc_id, text, source, n), k in want.items():
        total[doc_id, text, source] += n * k
    assert emitted == +total
    equal = 5000 * rate["a"]
    assert abs(total[1, "a b c", "a"] - equal) < 4 * math.sqrt(5000)  # neither all nor none


# ---- quality rules


def brute_figures(text):
    w = re.findall("[^\x20\x09-\x0d]+", text)
    tri = Counter(zip(w, w[1:], w[2:]))
    at = {i + k for i in range(len(w) - 2) if tri[tuple(w[i : i + 3])] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if re.search("[^\x20\x09-\x0d]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(at)


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab \n\té#|\x0b\x85", max_size=60))
def test_cascade_figures(text):
    t = cascade.Text(text.encode())
    assert (t.n_words, t.word_chars, t.n_symbols, t.n_dup_lines, t.n_repeat_words) == brute_figures(text)


def test_cascade_verdict_does_not_depend_on_order(spark):
    texts = [r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    names = list(cascade.RULES)
    for order in ([*reversed(names)], names[3:] + names[:3]):
        assert [cascade.kept(cascade.Text(t.encode()), order) for t in texts] == [cascade.kept(cascade.Text(t.encode()), names) for t in texts]
    assert cascade.rank(np.array([[1, 0], [1, 0], [0, 1]]), np.array([[9.0, 1], [9, 1], [9, 1]]), ["slow", "fast"]) == ["fast", "slow"]


GOOD = "The river ran past the old mill and to the sea. " + " ".join(f"Then w{i}ord ca{i}me near plac{i}e." for i in range(12))
SPLIT = GOOD.split(" ")


@pytest.mark.parametrize(
    "rule, text",
    [
        ("symbols", " ".join(w + "#" * (i % 4 == 0) for i, w in enumerate(SPLIT))),
        ("word_length", " ".join(w * 4 for w in SPLIT)),
        ("word_length", " ".join(w[:1] for w in SPLIT)),
        ("alphabetic", " ".join(w if i % 3 else str(i) for i, w in enumerate(SPLIT))),
        ("stop_words", " ".join(f"w{chr(97 + i % 26)}{i}ord" for i in range(60))),
        ("capitals", GOOD.upper()),
        ("bullets", "\n".join(f"- {w} {i} so on it goes" for i, w in enumerate(SPLIT))),
        ("ellipses", "\n".join(f"{w} {i} so on it goes..." for i, w in enumerate(SPLIT))),
        ("dup_lines", "\n".join([*GOOD.split(". "), *["the same"] * 9])),
        ("dup_line_bytes", "\n".join([GOOD, GOOD, *(f"x{i}" for i in range(9))])),
        ("top_2_gram", GOOD + " extraordinary circumstances" * 9),
        ("top_3_gram", GOOD + " extraordinary circumstances prevail" * 6),
        ("top_4_gram", GOOD + " extraordinary circumstances prevail nowadays" * 5),
    ],
)
def test_cascade_rules(rule, text):
    assert cascade.kept(cascade.Text(GOOD.encode()), list(cascade.RULES))
    assert cascade.RULES[rule](cascade.Text(text.encode()))


def test_cascade_asks_for_stop_words_in_latin_letters_only():
    assert not cascade.RULES["stop_words"](cascade.Text(("слово " * 60).encode()))
    assert not cascade.RULES["alphabetic"](cascade.Text(("слово " * 60).encode()))


def test_cascade_keeps_good_and_rejects_bad(spark):
    table = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    quality = {r["doc_id"]: r["quality"] for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    judged = [(quality[r["doc_id"]], r["kept"]) for r in cascade.figures(table).collect() if r["doc_id"] in quality and not r["base_failed"]]
    for label, least in ((1, 0.97), (0, 0.0)):
        own = [kept for q, kept in judged if q == label]
        assert sum(own) / len(own) >= least
    assert sum(kept for q, kept in judged if q == 0) < 0.1 * sum(q == 0 for q, _ in judged)
    kept = cascade.keep(table)
    assert kept.columns == table.columns and 0 < kept.count() < table.count()
    odd = cascade.figures(docs(spark, ODD)).collect()
    assert len(odd) == len(ODD) and all(r["base_failed"] for r in odd)
    assert cascade.figures(table.limit(0)).count() == 0


# ---- personal data

PATTERNS = [re.compile(p) for p in (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]")]


def brute_spans(text):
    out = []
    for k, p in enumerate(PATTERNS):
        for m in p.finditer(text):
            digits = re.sub("[^0-9]", "", m.group())
            good = [True, k == 1 and all(int(x) <= 255 for x in m.group().split(".")), 12 <= len(digits) <= 19 and semicrf.luhn(digits), 9 <= len(digits) <= 15][k]
            if good:
                out.append((m.start(), k, m.end()))
    return sorted(out)


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="a@.-+ 019()é", max_size=40) | st.lists(st.sampled_from(["a@b.c", "1.2.3.4", ".", "256.", "4111 1111 1111 1111", "+1 (555) 123-4567", "@", "x", " ", "0"]), max_size=6).map("".join))
def test_pii_base_spans(text):
    assert semicrf.base_spans(text) == brute_spans(text)


@pytest.fixture(scope="module")
def model():
    return semicrf.train()


def measured(model, passages):
    hit, wrong, missed = 0, 0, 0
    for text, gold in passages:
        base, spans = semicrf.find(text.encode(), model)
        assert set(base) <= set(spans)
        got = {(a, semicrf.KINDS[k], b) for a, k, b in spans if (a, k, b) not in base}
        want = {g for g in gold if (g[0], semicrf.KINDS.index(g[1]), g[2]) not in base}
        hit, wrong, missed = hit + len(got & want), wrong + len(got - want), missed + len(want - got)
    return hit / (hit + wrong), hit / (hit + missed)


def test_pii_model_on_made_passages(model):
    for make in (semicrf._made, semicrf._made_long, semicrf._made_keyed, semicrf._made_forms):
        rng = random.Random(123)
        precision, recall = measured(model, [make(rng) for _ in range(300)])
        assert precision > 0.95 and recall > 0.93, make


def test_pii_model_on_passages_written_by_hand(model):
    from passages import LATER, PASSAGES

    for passages in (PASSAGES, LATER):
        found = [(t, [(t.index(own), kind, t.index(own) + len(own)) for kind, own in want]) for t, want in passages]
        assert {kind for _, want in passages for kind, _ in want} == set(semicrf.KINDS)
        precision, recall = measured(model, found)
        assert precision >= 0.9 and recall >= 0.9


def test_pii_secrets_of_any_length(model):
    rng = random.Random(31)
    for n in (150, 170, 520, 5000):
        own = "x" + "".join(rng.choice("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789") for _ in range(n - 2)) + "7"
        assert semicrf.written(semicrf.find(("password=" + own).encode(), model)[1]) == f"secret:9:{9 + n}"
        marked = own[:50] + "!" + own[51:120] + "%" + own[121:]
        assert semicrf.written(semicrf.find(("password: " + marked + " x").encode(), model)[1]) == f"secret:10:{10 + n}"


def test_pii_training_counts_all_paths():
    rng = random.Random(2)
    for _ in range(30):
        n = rng.randint(1, 6)
        found = sorted({(i, rng.randint(i + 1, n)) for i in [rng.randrange(n) for _ in range(rng.randint(1, 6))]})
        total = [rng.uniform(-2, 2) for _ in found]

        def paths(at, n=n, found=found):
            if at == n:
                return [()]
            return [p for p in paths(at + 1)] + [(k, *p) for k, (i, j) in enumerate(found) if i == at for p in paths(j)]

        weight = {p: math.exp(sum(total[k] for k in p)) for p in paths(0)}
        z = Counter()
        for p, w in weight.items():
            z.update({k: w for k in p})
        masses = semicrf._Lattice(n, found, []).masses(total)
        for k in range(len(found)):
            assert math.exp(masses[k] + total[k]) == pytest.approx(z[k] / sum(weight.values()))


def test_pii_best_segmentation_is_the_best(model):
    text = "word password=b7db7aa4a5fcc78305 on"
    spans = semicrf.atoms(text, 0, len(text))
    found = semicrf.candidates(text, spans, semicrf.Cover([]))
    scores = model.scores(text, spans, found).max(1)
    best = max(sum(scores[list(c)]) if c else 0.0 for n in range(3) for c in itertools.combinations(range(len(found)), n) if all(found[a][1] <= found[b][0] or found[b][1] <= found[a][0] for a, b in itertools.combinations(c, 2)))
    got = model.decode(text, semicrf.Cover([]))
    assert text[got[0][0] : got[0][2]] == "b7db7aa4a5fcc78305" and semicrf.KINDS[got[0][1]] == "secret"
    assert scores[[k for k, (i, j) in enumerate(found) if (spans[i][0], spans[j - 1][1]) == (got[0][0], got[0][2])][0]] == pytest.approx(best)


@pytest.mark.parametrize("text", ["a" * 300_000 + " 1", "12345678," * 30_000, "+1 (555) 123-4567 " * 8000, "a@b.cd " * 20_000, "x@" * 50_000 + "1", "1." * 100_000, "+1" + "(" * 200_000, "ab1/" * 60_000, "0" * 300_000, "abc:" * 60_000, "x at y dot " * 20_000, "a.dot " * 40_000, "Mr X" * 50_000, "Dear " * 50_000, "12 Aa " * 40_000, "DE12 " * 40_000, "A" * 300_000, "rue 1 rue " * 30_000, "1[.]" * 60_000])
def test_pii_takes_time_in_proportion(model, text):
    began = time.process_time()
    base, spans = semicrf.find(text.encode(), model)
    assert set(base) <= set(spans) and time.process_time() - began < 20


def test_pii_in_long_runs(model):
    rng = random.Random(77)
    some = lambda n, more="": "".join(rng.choice("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789" + more) for _ in range(n))
    key = "AKIA" + "QWERTYUIOPASDFGH"
    cases = [("SessionToken=", some(600), ""), ("SessionToken=", some(600, "+/") + "x", ""), ("see password=", some(161) + "9", " there"), ("token: ", some(9000), " x"), ("a" * 500 + "/", key, "/" + "b" * 20), ("q" * 600 + "/", "555-123-4567", "/z")]
    for before, secret, after in cases:
        text = before + secret + after
        assert [text[a:b] for a, _, b in semicrf.find(text.encode(), model)[1]] == [secret]
    assert semicrf.find(("data:image/png;base64," + some(3000, "+/")).encode(), model)[1] == []  # data and no one's


def test_pii_forms_of_any_length(model):
    from passages import LONG

    for text, want in LONG:
        assert [(semicrf.KINDS[k], text[a:b]) for a, k, b in semicrf.find(text.encode(), model)[1]] == want, text


def test_pii_scans_stay_linear(model):
    import time

    took = []
    for n in (20_000, 80_000):
        text = ("12 A " * n + "Street " + "Calle Del " * n + "Mr " + "Ab " * n + "x [at] " + "y." * n).encode()
        began = time.process_time()
        semicrf.triggers(text.decode(), semicrf.Cover([]), semicrf.Hints(text))
        took.append(time.process_time() - began)
    assert took[1] < 10 * took[0] + 1


def test_pii_on_passages_the_generator_does_not_make(model):
    cases = [
        ("call 555 123 4567", ["555 123 4567"]), ("Please call (555) 123 4567 today", ["(555) 123 4567"]), ("tel 06 12 34 56 78.", ["06 12 34 56 78"]), ("password: hunter2", ["hunter2"]), ("pwd=ab12cd3", ["ab12cd3"]),
        ("password: CorrectHorse", ["CorrectHorse"]), ("my password is swordfish42, ok", ["swordfish42"]), ("Password: p@ss!word9", ["p@ss!word9"]), ("le password: motdepasse", ["motdepasse"]),
        ("the key idea is simple", []), ("password reset is required", []), ("token = get_token()", []), ("password: None", []), ("author: Melville", []), ("max_tokens: 4096", []), ("population 12 345 678 in 2019", []), ("2019 2020 2021", []),
    ]
    for text, want in cases:
        assert [text[a:b] for a, _, b in semicrf.find(text.encode(), model)[1]] == want, text


def test_pii_labels_what_base_spans_leave_of_a_run(model):
    key = "3fa9c0d1b2ee" + "4111111111111111" + "ab09cd8ef7a1"
    base, spans = semicrf.find(f'api_key = "{key}"'.encode(), model)
    assert base == [(23, 2, 39)] and spans == [(11, 4, 23), (23, 2, 39), (39, 4, 51)]
    assert semicrf.mask(f'api_key = "{key}"'.encode(), model) == b'api_key = "<SECRET><CARD><SECRET>"'


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 30), st.integers(1, 9)), max_size=5), st.integers(0, 30), st.integers(1, 12))
def test_pii_cover(stretches, a, n):
    spans = sorted((x, 0, x + k) for x, k in stretches)
    cover, inside, b = semicrf.Cover(spans), {i for x, _, y in spans for i in range(x, y)}, a + n
    assert cover.covers(a, b) == (set(range(a, b)) <= inside) or any(y in {x for x, _, _ in spans} for _, _, y in spans)
    assert [i for x, y in cover.left(a, b) for i in range(x, y)] == [i for i in range(a, b) if i not in inside]


def test_pii_over_documents(spark, model):
    rows = [(11, "mail a@b.c and é +1 (555) 123-4567", "s", "k"), (12, "clean text"), *ODD[:4]]
    got = {r["doc_id"]: r for r in semicrf.detect(docs(spark, rows), model).collect()}
    assert got[11]["spans"] == "email:5:10,phone:17:34" and got[11]["n_email"] == got[11]["n_phone"] == 1
    assert got[11]["base_sha256"] == hashlib.sha256(b"email:5:10,phone:17:34").hexdigest()
    assert got[12]["spans"] == ""
    out = {r["doc_id"]: r for r in semicrf.redact(docs(spark, rows).withColumn("n_chars", F.length("text")), model).collect()}
    assert out[11]["text"] == "mail <EMAIL> and é <PHONE>" and out[11]["n_chars"] == len(out[11]["text"]) and out[11]["kept"] == "k"
    assert semicrf.detect(docs(spark, rows).limit(0), model).count() == 0 and semicrf.redact(docs(spark, rows).limit(0), model).count() == 0
    clash = docs(spark, [*rows, (13, "mail a@b.c " + "very long " * 50_000)]).withColumn("spans", F.lit("x")).withColumn("n_email", F.lit("clash")).withColumn("base_sha256", F.lit(1))
    assert Counter(r["n_email"] for r in semicrf.detect(clash, model).collect())[1] == 2
    assert semicrf.redact(clash, model).columns == clash.columns


# ---- classifier


def brute_units(text):
    """The same units one at a time, with plain integers."""
    m = [[int(x) for x in row] for row in subword._MULTIPLIERS]
    mask = (1 << 32) - 1

    def bucket(h):
        h = (h ^ (h >> 15)) * 2654435761 & mask
        return (h >> 15) % (subword.BUCKETS - subword.OWN) + subword.OWN

    words = re.findall("[^\x20\x09-\x0d]+", text)
    out, hashes = [subword.END], []
    for w in words:
        edged = f" {w} "
        for k in subword.GRAMS:
            out += [bucket((k + sum(ord(c) * m[k - 3][i] for i, c in enumerate(edged[a : a + k]))) & mask) for a in range(len(edged) - k + 1)]
        hashes.append(sum(ord(c) * m[3][i % 64] + i // 64 for i, c in enumerate(w)) & mask)
    out += map(bucket, hashes)
    out += [bucket((a * m[4][0] + b) & mask) for a, b in itertools.pairwise(hashes)]
    for a in range(len(words) - subword.SHAPE + 1):
        equal = [words[a + i] == words[a + j] for i, j in itertools.combinations(range(subword.SHAPE), 2)]
        out.append(bucket((sum(1 << k for k, e in enumerate(equal) if e) * m[5][0] + m[5][1]) & mask))
    return Counter(out)


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="abAé日\U0001f600 \n\t\x85\x1c", max_size=60) | st.lists(st.sampled_from(["aa", "bb", "c", "x" * 70]), max_size=12).map(" ".join))
def test_classifier_units(text):
    assert Counter(subword.units(text.encode()).tolist()) == brute_units(text)


def test_classifier_step_follows_the_gradient():
    rng = np.random.default_rng(5)
    vectors, layer, bias = rng.normal(size=(subword.BUCKETS, 3)), rng.normal(size=(3, 2)), rng.normal(size=2)
    batch = [(np.array([1, 4, 7]), np.array([0.5, 0.25, 0.25]), 1), (np.array([4, 9]), np.array([0.75, 0.25]), 0)]

    def loss():
        total = 0.0
        for buckets, share, label in batch:
            z = share @ vectors[buckets] @ layer + bias
            total += math.log(sum(math.exp(x) for x in z)) - z[label]
        return total

    before = {"vectors": vectors.copy(), "layer": layer.copy(), "bias": bias.copy()}
    slopes = {}
    for name, array, at in (("vectors", vectors, (4, 1)), ("vectors", vectors, (9, 2)), ("layer", layer, (0, 1)), ("bias", bias, (1,))):
        array[at] += 1e-6
        high = loss()
        array[at] -= 2e-6
        slopes[name, at] = (high - loss()) / 2e-6
        array[at] += 1e-6
    subword.step(vectors, layer, bias, batch, 0.01)
    now = {"vectors": vectors, "layer": layer, "bias": bias}
    for (name, at), slope in slopes.items():
        moved = (before[name][at] - now[name][at]) / 0.01 / {"vectors": 1, "layer": 0.1, "bias": 0.01}[name]
        assert moved == pytest.approx(slope, rel=1e-3)
    assert (vectors[[0, 2, 3, 5]] == before["vectors"][[0, 2, 3, 5]]).all()


def test_classifier_sample_is_bounded(spark):
    rows = [(1, f"copy {i % 3}") for i in range(2000)] + [(i, f"text {i}") for i in range(2, 30)] + [(500, "very long " * 60_000)]
    labels = spark.createDataFrame([(i, (i or 0) % 2) for i in [*range(40), 500, 1, None]], "doc_id bigint, quality int")
    found = subword.sampled(docs(spark, rows).withColumn("place", F.lit("clash")), labels, 10_000).collect()
    assert len(found) == 30 and len({r["place"] for r in found}) == 30  # one row for each id
    assert len(subword.sampled(docs(spark, rows), labels, 7).collect()) <= 7
    assert subword.fit(docs(spark, rows), labels, most=0).any() == False  # noqa: E712  no units, no training


def test_classifier_held_out_accuracy(spark):
    base = "/root/testdata/sf0.01"
    table, labels = spark.read.parquet(f"{base}/documents.parquet"), spark.read.parquet(f"{base}/labels.parquet")
    got = {r["doc_id"]: r for r in subword.classify(table, labels).collect()}
    assert len(got) == table.count()
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) for i, r in got.items())
    tests = [(got[r["doc_id"]]["predicted"], r["quality"]) for r in labels.collect() if got[r["doc_id"]]["held_out"]]
    assert sum(a == b for a, b in tests) / len(tests) > 0.95
    by = {q: [a for a, b in tests if b == q] for q in (0, 1)}
    assert sum(by[0]) < 0.2 * len(by[0])


def test_classifier_learns_from_texts_alone_and_takes_odd_rows(spark):
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(40)], "doc_id bigint, quality int, toxic int")
    rows = [(i, ("good fine words here " if i % 2 else "b@d $$$ !!! ") * 9) for i in range(40)]
    odd = [(None, "x"), (100, None), (101, ""), (3, "again"), (102, "very long words " * 60_000)]
    out = subword.classify(docs(spark, rows + odd).withColumn("score", F.lit("clash")).withColumn("quality", F.lit(7)), labels).collect()
    assert len(out) == 45 and all(0 <= r["score"] <= 1 for r in out)
    assert all(r["predicted"] == (r["score"] >= 0.7) for r in out)
    got = {r["doc_id"]: r["score"] for r in out if r["doc_id"] not in (None, 3)}
    assert min(got[i] for i in range(1, 40, 2) if i != 3) > max(got[i] for i in range(0, 40, 2))
    assert subword.classify(docs(spark, rows), labels.limit(0)).agg(F.max("score"), F.min("score")).first() == (0.5, 0.5)
    assert subword.classify(docs(spark, rows).limit(0), labels).count() == 0


# ---- language model


def brute_kneser(train, tests):
    """log10 probabilities by plain dictionaries, and a function for single probabilities."""
    seqs = [["<s>", *t.lower().split(), "</s>"] for t in train]
    big = Counter(p for s in seqs for p in zip(s, s[1:]))
    uni = Counter(w for s in seqs for w in s[1:])
    cont = Counter(w for _, w in big)
    d2 = kneser.discounts(*(sum(c == k for c in big.values()) for k in (1, 2, 3, 4)))
    d1 = kneser.discounts(*(sum(c == k for c in cont.values()) for k in (1, 2, 3, 4)))
    rest = sum(d1[min(c, 3)] for c in cont.values()) / len(big)
    follow = defaultdict(list)
    for (u, _), c in big.items():
        follow[u].append(c)

    def p(u, v):
        low = max(cont[v] - d1[min(cont[v], 3)], 0) / len(big) + rest / (len(uni) + 1)
        if u not in follow:
            return low
        total = sum(follow[u])
        return max(big[u, v] - d2[min(big[u, v], 3)], 0) / total + sum(d2[min(c, 3)] for c in follow[u]) / total * low

    scores = []
    for t in tests:
        s = ["<s>", *t.lower().split(), "</s>"]
        scores.append(sum(math.log10(p(u, v)) for u, v in zip(s, s[1:])))
    return scores, uni, p


def test_language_model(spark, monkeypatch):
    monkeypatch.setattr(kneser, "SHARD_BIGRAMS", 50)
    rng = random.Random(4)
    rows = [(i, " ".join(rng.choice("a b c d e f g h A the of xy".split()) for _ in range(rng.randint(0, 30))) + ("\n" if i % 3 else " new%d" % i)) for i in range(120)]
    rows += [(None, "a b"), (500, None), (501, ""), (501, "")]
    train = [t or "" for i, t in rows if zlib.crc32(("" if i is None else str(i)).encode()) % 7 != 2]
    want, uni, p = brute_kneser(train, [t or "" for _, t in rows])
    got = kneser.score(docs(spark, rows)).collect()
    assert len(got) == len(rows)
    n, v = sum(uni.values()), len(uni)
    keyed = Counter((r["doc_id"], round(r["score"], 6), r["n_tokens"], r["n_known"], round(r["base_score"], 6), r["held_out"], r["train_tokens"]) for r in got)
    for (i, t), s in zip(rows, want):
        tokens = [*(t or "").lower().split(), "</s>"]
        base = sum(math.log10((uni[w] + 1) / (n + v + 1)) for w in tokens)
        key = (i, round(s, 6), len(tokens), sum(w in uni for w in tokens), round(base, 6), zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2, n)
        assert keyed[key] > 0, key
    for u in ("<s>", "a", "the", "never"):
        assert sum(p(u, w) for w in uni) + p(u, "unseen") == pytest.approx(1)
    assert kneser.score(docs(spark, rows).limit(0)).count() == 0


def test_frequent_contexts_lie_in_all_shards(spark, monkeypatch):
    monkeypatch.setattr(kneser, "SHARD_BIGRAMS", 40)
    rows = [(i, " ".join(f"the w{i * j % 211}" for j in range(1, 40))) for i in range(60)]
    want, _, _ = brute_kneser([t for i, t in rows if zlib.crc32(str(i).encode()) % 7 != 2], [t for _, t in rows])
    got = [r["score"] for r in kneser.score(docs(spark, rows)).orderBy("doc_id").collect()]
    assert got == pytest.approx(want)
    model = kneser.build(docs(spark, rows).select("text"))
    the = np.unique(kneser.tokens(b"the")[:1])
    assert len(model.frequent) >= 2 and kneser._among(the, model.frequent).all()
    sizes = [len(arrays["bigram"]) for k in range(1 << model.bits) if (arrays := model.arrays("bigrams", k)) is not None]
    assert max(sizes) < 0.25 * sum(sizes)


def test_language_model_counts_over_255(spark):
    rows = [(i, "x y " * 200) for i in range(4)]
    want, _, _ = brute_kneser([t for i, t in rows if zlib.crc32(str(i).encode()) % 7 != 2], [t for _, t in rows])
    got = [r["score"] for r in kneser.score(docs(spark, rows)).orderBy("doc_id").collect()]
    assert got == pytest.approx(want)


def test_language_model_folds_and_maps_within_bounds(spark, monkeypatch):
    for name, value in (("SHARD_BIGRAMS", 30), ("FOLD", 10), ("CHUNK", 40), ("MAPS", 3)):
        monkeypatch.setattr(kneser, name, value)
    rng = random.Random(9)
    rows = [(i, " ".join(f"w{rng.randint(0, 40)}" for _ in range(60))) for i in range(40)]
    want, _, _ = brute_kneser([t for _, t in rows], [t for _, t in rows])
    model = kneser.build(docs(spark, rows).repartition(3))
    lists = [kneser.tokens(t.encode()) for _, t in rows]
    logs, _ = model.log10(*kneser.bigrams(lists))
    assert np.add.reduceat(logs, np.cumsum([0, *map(len, lists)])[:-1]).tolist() == pytest.approx(want)
    assert len(model.files) <= 3


def test_language_model_misses_no_file(spark, monkeypatch):
    import os

    monkeypatch.setattr(kneser, "SHARD_BIGRAMS", 200)
    rows = [(i, " ".join(f"w{i * j % 97}" for j in range(60))) for i in range(40)]
    model = kneser.build(docs(spark, rows))
    queries = kneser.bigrams([kneser.tokens(t.encode()) for _, t in rows])
    for kind in ("bigrams", "words"):
        shard = int(np.flatnonzero(model.written[kind])[0])
        path = os.path.join(model.folder, f"{kind}-{shard}")
        whole = open(path, "rb").read()
        os.remove(path)
        model.files.clear()
        with pytest.raises(OSError):
            model.log10(*queries)
        open(path, "wb").write(whole[:-64])
        with pytest.raises(OSError):
            model.log10(*queries)
        open(path, "wb").write(whole)
        model.log10(*queries)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.tuples(st.integers(0, 5), st.integers(0, 5), st.integers(1, 3)), min_size=1, max_size=12), min_size=1, max_size=8), st.integers(0, 9))
def test_folding_sums(pieces, most):
    was, kneser.FOLD = kneser.FOLD, most
    try:
        folded, want = kneser._Folded(kneser.merge), Counter()
        for piece in pieces:
            folded.add(*(np.array(c, dtype=np.uint64) for c in zip(*piece)))
            for a, b, n in piece:
                want[a, b] += n
        got = list(zip(*(c.tolist() for c in folded.done())))
    finally:
        kneser.FOLD = was
    assert got == sorted((a, b, n) for (a, b), n in want.items())


def test_language_model_takes_odd_tables(spark):
    rows = [(1, "very long " * 60_000), (2, "unbroken" * 30_000), (None, None), (3, "a b"), (3, "a b")]
    table = docs(spark, rows).withColumn("shard", F.lit("clash")).withColumn("words", F.lit(1)).withColumn("score", F.lit(0.5))
    got = kneser.score(table).collect()
    assert len(got) == 5 and all(math.isfinite(r["score"]) for r in got)
    assert kneser.score(docs(spark, [])).count() == 0
