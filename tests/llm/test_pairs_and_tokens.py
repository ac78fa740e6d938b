"""Near duplicates, token files, packing and the pipeline against brute force."""

import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.llm import capfilters, components, golay, packing, tokenfiles, tokens

SF = "/root/testdata/sf0.001"


def least_reachable(nodes, links):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


@pytest.mark.parametrize("edges", [[], [(1, 1)], [(i, i + 1) for i in range(40)], [(7, i) for i in range(30)], [(3, 9), (9, -4), (5, 6), (6, 5), (5, 6)]])
def test_components(spark, edges):
    got = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    nodes = {n for e in edges if e[0] != e[1] for n in e}
    assert got == least_reachable(nodes, [e for e in edges if e[0] != e[1]])


# ---- SimHash


def brute_fingerprint(text):
    words = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) > 2 else [" ".join(words)] if words else []
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="aAbÉé \n\t\x85　", max_size=40))
def test_fingerprint(text):
    assert golay.fingerprint(text.encode()) == brute_fingerprint(text)


@settings(max_examples=200, deadline=None)
@given(st.integers(0, 2**64 - 1), st.lists(st.integers(0, 63), max_size=2, unique=True))
def test_golay_keys_meet_within_two_bits(fp, bits):
    other = fp
    for b in bits:
        other ^= 1 << b
    rows, keys = golay.fuzzy_keys(np.array([fp, other], dtype=np.uint64))
    assert set(keys[rows == 0]) & set(keys[rows == 1])
    assert max(Counter(rows.tolist()).values()) <= 18


def brute_duplicates(rows):
    fps = [brute_fingerprint(t or "") for _, t in rows]
    links = [(i, j) for i in range(len(rows)) for j in range(i) if bin(fps[i] ^ fps[j]).count("1") <= 2]
    group = least_reachable(range(len(rows)), links)
    least = {}
    for i, g in group.items():
        if rows[i][0] is not None:
            least[g] = min(least.get(g, rows[i][0]), rows[i][0])
    return Counter((rows[i][0], fps[i], least.get(group[i])) for i in range(len(rows)))


def test_one_of_a_component_without_ids_stays(spark):
    text = " ".join(f"w{i}" for i in range(400))
    near = next(t for k in range(400) for t in [text.replace(f"w{k} ", "other ", 1)] if 0 < bin(golay.fingerprint(t.encode()) ^ golay.fingerprint(text.encode())).count("1") <= 2)
    rows = [(None, text), (None, near), (None, near), (None, "quite another text"), (7, "one two three four"), (None, "one two three four")]
    kept = golay.keep_one(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert len(kept) == 3 and len({r["text"] for r in kept} & {text, near}) == 1
    assert [r["doc_id"] for r in kept if r["text"] == "one two three four"] == [7]


@pytest.mark.parametrize("cap", [2, 256])
def test_near_duplicates_of_documents(spark, cap):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    rng = np.random.default_rng(2)
    long = max((t for _, t in rows), key=len).split(" ")
    for i in range(60):  # a group of near copies
        own = list(long)
        own[int(rng.integers(len(own)))] = f"w{i}"
        rows.append((1000 + i, " ".join(own)))
    rows += [(None, ""), (2000, None), (2001, " \n"), (None, "lonely words here once"), (5, rows[5][1]), (5, "other text under the same id")]
    table = spark.createDataFrame([(*r, "clash", 1) for r in rows], "doc_id bigint, text string, fp string, root int")
    got = Counter((r["doc_id"], r["fp"] % (1 << 64), r["component_id"]) for r in golay.near_duplicates(table, cap).collect())
    assert got == brute_duplicates(rows)


def test_near_duplicates_of_nothing(spark):
    empty = spark.createDataFrame([], "doc_id bigint, text string")
    assert golay.near_duplicates(empty).count() == 0
    assert golay.keep_one(empty).count() == 0


def test_one_document_of_each_group_stays(spark):
    table = spark.createDataFrame([(3, "a b c d", "x"), (1, "a b c d", "x"), (2, "e f g h i", "y"), (2, "e f g h i", "y"), (None, "a b c d", "z"), (None, "only here", "z"), (9, None, "n"), (8, "", "n")], "doc_id bigint, text string, source string")
    kept = golay.keep_one(table)
    assert kept.columns == table.columns
    assert Counter((r["doc_id"], r["text"]) for r in kept.collect()) == Counter([(1, "a b c d"), (2, "e f g h i"), (None, "only here"), (8, "")])


# ---- embeddings


def brute_links(rows):
    ok = []
    for i, (_, e, label) in enumerate(rows):
        good = label is not None and e is not None and None not in e and np.isfinite(e).all() and any(e)
        ok.append(np.array(e, dtype=float) if good else None)
    links = []
    for i in range(len(rows)):
        for j in range(i):
            if ok[i] is not None and ok[j] is not None and rows[i][2] == rows[j][2] and len(ok[i]) == len(ok[j]):
                if ok[i] @ ok[j] / np.linalg.norm(ok[i]) / np.linalg.norm(ok[j]) >= 0.98:
                    links.append((i, j))
    return links


@pytest.mark.parametrize("split", [16, 1024])
def test_near_duplicates_of_embeddings(spark, split):
    rng = np.random.default_rng(3)
    f = lambda v: [float(x) for x in np.float32(v)]
    rows, centre = [], rng.normal(size=32)
    for i in range(120):
        rows.append((i, f(rng.normal(size=32)), i % 3))
    for i in range(70):  # a large cluster, links near the threshold
        rows.append((1000 + i, f(centre + rng.normal(size=32) * np.linalg.norm(centre) / np.sqrt(32) * rng.uniform(0.02, 0.18)), 1))
    rows += [(2000, rows[5][1], rows[5][2]), (2001, rows[5][1], 9), (2002, rows[5][1], None), (2003, None, 1), (2004, [0.0] * 32, 1), (2005, [float("nan")] + [1.0] * 31, 1)]
    rows += [(2006, [float("inf")] + [1.0] * 31, 1), (2007, [None] + [1.0] * 31, 1), (2008, [1.0, 2.0], 1), (2009, [2.0, 4.0], 1), (2010, [], 1), (None, rows[7][1], rows[7][2]), (2011, f(np.array(rows[9][1]) * 3), rows[9][2]), (2012, [-0.0, 1.0], 2), (2013, [0.0, 1.0], 2), (5, rows[5][1], rows[5][2])]
    table = spark.createDataFrame([(*r, "clash") for r in rows], "vec_id bigint, embedding array<float>, label int, nid string")
    links = brute_links(rows)
    group, degree = least_reachable(range(len(rows)), links), Counter(x for l in links for x in l)
    least = {}
    for i, g in group.items():
        if rows[i][0] is not None:
            least[g] = min(least.get(g, rows[i][0]), rows[i][0])
    want = Counter((rows[i][0], degree[i], least.get(group[i]), rows[i][0] is not None and rows[i][0] == least.get(group[i])) for i in range(len(rows)))
    assert Counter(tuple(r) for r in capfilters.near_duplicates(table, split=split).collect()) == want
    assert capfilters.near_duplicates(table.limit(0)).count() == 0


def test_cap_filter_recall_at_scale():
    rng = np.random.default_rng(8)
    code = capfilters.Code(64, 100_000)
    x = rng.normal(size=(1500, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    g = rng.normal(size=x.shape)
    g -= (g * x).sum(1, keepdims=True) * x
    y = 0.98 * x + np.sqrt(1 - 0.98**2) * g / np.linalg.norm(g, axis=1, keepdims=True)  # just at the threshold
    a, b = code.decode(x), code.decode(y)
    assert a.shape == (1500, capfilters.FILTERS)
    met = sum(bool(set(p) & set(q)) for p, q in zip(a.tolist(), b.tolist(), strict=True))
    assert met / len(x) > 0.995
    # the best directions, and the same ones in any batch
    for i in range(0, 1500, 97):
        assert (code.decode(x[i : i + 1])[0] == a[i]).all()


def test_cap_filters_are_the_best_directions():
    rng = np.random.default_rng(4)
    for dim in (1, 2, 7, 32):
        code = capfilters.Code(dim, 200)
        x = rng.normal(size=(20, dim))
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        got = code.decode(x)
        part = np.rint(np.rint(x * capfilters.UNIT) @ code.rotation / capfilters.UNIT)
        part = np.pad(part, ((0, 0), (0, code.width * 4 - dim)))
        for i in range(20):
            s = [code.books[b] @ part[i, b * code.width : (b + 1) * code.width] for b in range(4)]
            every = (s[0][:, None, None, None] + s[1][:, None, None] + s[2][:, None] + s[3]).ravel()
            assert sorted(every[got[i]], reverse=True) == sorted(every, reverse=True)[: len(got[i])]


def test_vectors_keep_what_float32_loses(spark):
    rows = [(1, [1.0, 0.1, 0.3], 1), (2, [1.0, 0.1, 0.3], 1), (3, [1.0, 0.5, 0.25], 1), (4, [2.0, 1.0, 0.5], 1), (5, [1e300, 1e299, 3e299], 1), (6, [1e-300, 1e-301, 3e-301], 1)]
    table = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int")
    got = sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in capfilters.near_duplicates(table).collect())
    assert got == [(1, 3, 1), (2, 3, 1), (3, 1, 3), (4, 1, 3), (5, 3, 1), (6, 3, 1)]


# ---- tokens

ODD = ["", " ", "a  b", "\n\na b\n c \t d", "it's don't 'S", "a\u0085b \x1c c", "  <|endoftext|> a<|endoftext|>", "日本 語 x", "a 　 b", "x\ty", "\nLead", "trail\n", "a\n\nb", "word", "word word\nword", "long" * 20 + " end", "\x00 a\x00 \x00"]


ADDED = ["x <|endoftext|> y", "<|endoftext|>", "a<|endoftext|>b\nc  d", "<|endoftext |>", "<|endoftext|><|endoftext|>\n"]


@pytest.fixture(scope="module")
def encoder():
    return tokens.Encoder(tokens.default_path())


@pytest.fixture(scope="module")
def plain():
    """A tokenizer of its own, as the library loads it."""
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokens.default_path())
    return lambda text: tokenizer.encode(text, add_special_tokens=False).ids


def lists(ids, counts):
    return [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet="ab \n\t.,'é日　<|>", max_size=25) | st.lists(st.sampled_from(["<|endoftext|>", " ", "a", "\n", "b<|"]), max_size=6).map("".join), min_size=1, max_size=6))
def test_ids_equal_those_of_whole_texts(encoder, plain, found):
    import pyarrow as pa

    for _ in range(2):
        assert lists(*encoder.encode_batch(pa.array(found))) == [plain(t) for t in found]


def test_strings_of_added_tokens(encoder, plain):
    import pyarrow as pa

    assert plain(ADDED[0]) == [87, 220, 50256, 331]
    assert lists(*encoder.encode_batch(pa.array([*ADDED, "x", *ADDED]))) == [plain(t) for t in [*ADDED, "x", *ADDED]]


def test_ids_with_a_full_memo(monkeypatch, plain):
    import pyarrow as pa

    monkeypatch.setattr(tokens, "MEMO_UNITS", 12)
    own = tokens.Encoder(tokens.default_path())
    for part in (ODD[:6], ODD[4:], ODD):
        assert lists(*own.encode_batch(pa.array(part), 7)) == [[*plain(t), 7] for t in part]
    assert lists(*own.encode_batch(pa.array([None, "a"]), 7))[0] == [7]


def token_rows(spark):
    rows = [(i * 3 % 101, t) for i, t in enumerate((ODD + ADDED) * 4)] + [(300, "very long " * 50_000 + "end"), (301, "unbroken" * 20_000)] + [(None, "no id"), (500, None), (500, "same id"), (-5, "first")]
    return rows, spark.createDataFrame([(*r, "x") for r in rows], "doc_id bigint, text string, n_tokens string").repartition(5)


@pytest.mark.parametrize("most", ["0", "3"])
def test_token_files(spark, plain, most):
    rows, table = token_rows(spark)
    spark.conf.set("spark.sql.files.maxRecordsPerFile", most)  # a task may write several files
    try:
        got = tokenfiles.token_files(table).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxRecordsPerFile")
    ids = {t: [*plain(t or ""), 2] for _, t in rows}
    want = Counter((d, len(ids[t]), zlib.crc32(np.array(ids[t], "<u4").tobytes())) for d, t in rows)
    assert Counter((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in got) == want
    at = 0
    for r in sorted(got, key=lambda r: r["start"]):
        assert r["start"] == at
        at += r["n_tokens"]
    order = [r["doc_id"] for r in sorted(got, key=lambda r: r["start"])]
    assert order == sorted(order, key=lambda x: (x is not None, x))
    assert tokenfiles.token_files(table.limit(0)).count() == 0


def test_token_files_with_many_parts(spark, tmp_path):
    path = str(tmp_path / "t")  # names of files sort otherwise than numbers of parts
    rows = [(i, 1, part, 0, [2]) for i, part in enumerate([9, 10, 11, 99_999, 100_000, 100_001, 1_000_000])]
    spark.createDataFrame(rows, "doc_id bigint, n_tokens bigint, part bigint, part_start bigint, ids array<int>").repartition(7).write.parquet(path)
    assert sorted((r["doc_id"], r["start"]) for r in tokenfiles.read_tokens(spark, path).collect()) == [(i, i) for i in range(7)]


def test_equal_rows_spread_over_tasks(spark):
    table = spark.range(8000).select(F.when(F.col("id") % 2 == 0, F.col("id")).alias("doc_id"), F.lit("same").alias("text"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        sizes = [r["n"] for r in tokenfiles.in_order(table).groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(sizes) >= 4 and max(sizes) < 8000 / 3


def test_token_files_layout_and_selective_reads(spark, tmp_path):
    import glob

    import pyarrow.parquet as pq

    path = str(tmp_path / "t")
    tokenfiles.write_tokens(spark.read.parquet(f"{SF}/documents.parquet"), path)
    column = {}
    for f in glob.glob(f"{path}/*.parquet"):
        group = pq.ParquetFile(f).metadata.row_group(0)
        column |= {group.column(i).path_in_schema: group.column(i) for i in range(group.num_columns)}
    assert "DELTA_BINARY_PACKED" in column["doc_id"].encodings and column["ids.list.element"].has_dictionary_page
    assert column["doc_id"].has_column_index and column["doc_id"].has_offset_index
    some = tokenfiles.read_tokens(spark, path, first=10, last=20)
    assert sorted(r["doc_id"] for r in some.collect()) == list(range(10, 21))
    assert "ids" not in some._jdf.queryExecution().executedPlan().toString().split("ReadSchema")[1]


# ---- packing


def brute_cost(at, penalty, size):
    best = [0] + [10**9] * (len(at) - 1)
    for k in range(1, len(at)):
        for i in range(k):
            n = at[k] - at[i]
            if n <= size:
                best[k] = min(best[k], best[i] + (0 if n & (n - 1) == 0 else size - n) + penalty[k] + packing.SEQUENCE)
    return best[-1]


@settings(max_examples=120, deadline=None)
@given(st.lists(st.integers(1, 30), min_size=1, max_size=40), st.randoms())
def test_packing_finds_the_least_cost(gaps, rng):
    size = 32
    at = np.concatenate([[0], np.cumsum(gaps)])
    penalty = np.array([0, *[rng.choice([0, 8, 48]) for _ in gaps[1:]], 0])
    cuts = packing.windows(at, penalty, size)
    cost, last = 0, 0
    for k in cuts:
        n = int(at[k] - at[last])
        assert 0 < n <= size
        cost += (0 if n & (n - 1) == 0 else size - n) + int(penalty[k]) + packing.SEQUENCE
        last = k
    assert last == len(at) - 1 and cost == brute_cost(at.tolist(), penalty.tolist(), size)


@pytest.mark.parametrize("block", [300, packing.BLOCK])
def test_packing_places_every_id_once(spark, plain, block):
    rows, _ = token_rows(spark)
    rows = list({d: (d, t) for d, t in rows}.values()) + [(1000 + i, "word " * 700 + "x") for i in range(6)] + [(2000, "unbroken" * 800)]
    table = spark.createDataFrame(rows, "doc_id bigint, text string")
    ids = {d: [*plain(t or ""), 0] for d, t in rows}
    got = packing.pack(table, block=block).collect()
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in got:
        by_doc[r["doc_id"]].append(r)
        by_sequence[r["sequence_id"]].append(r)
        piece = ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert r["length"] > 0 and r["ids_crc32"] == zlib.crc32(np.array(piece, "<u4").tobytes()) and r["doc_tokens"] == len(ids[r["doc_id"]])
    for d, own in by_doc.items():
        spans = sorted((r["start"], r["length"]) for r in own)
        assert [s for s, _ in spans] == [0, *np.cumsum([n for _, n in spans])[:-1].tolist()] and sum(n for _, n in spans) == len(ids[d])
    assert set(by_doc) == set(ids)
    for own in by_sequence.values():
        spans = sorted((r["offset"], r["length"]) for r in own)
        assert [s for s, _ in spans] == [0, *np.cumsum([n for _, n in spans])[:-1].tolist()] and sum(n for _, n in spans) <= 1024
    assert packing.pack(table.limit(0)).count() == 0


def test_packing_takes_repeated_rows_and_odd_tables(spark, plain):
    rows = [(1, "same text here")] * 500 + [(1, "other")] * 3 + [(None, "no id")] * 40 + [(None, None)] * 2 + [(2, "very long " * 60_000), (3, "")]
    table = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id bigint, text string, sequence_id string, length int").repartition(3)
    ids = {t: [*plain(t or ""), 0] for _, t in rows}
    got = packing.pack(table, block=3000).collect()
    covered, want = Counter(), Counter()
    for r in got:
        for at in range(r["start"], r["start"] + r["length"]):
            covered[r["doc_id"], r["doc_tokens"], at] += 1
    for d, t in rows:
        for at in range(len(ids[t])):
            want[d, len(ids[t]), at] += 1
    assert covered == want
    by = defaultdict(list)
    for r in got:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for own in by.values():
        assert [s for s, _ in sorted(own)] == [0, *np.cumsum([n for _, n in sorted(own)])[:-1].tolist()] and sum(n for _, n in own) <= 1024


def test_packing_pads_little(spark):
    got = packing.pack(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").coalesce(1)).groupBy("sequence_id").agg(F.sum("length").alias("n")).collect()
    padded = sum(0 if r["n"] & (r["n"] - 1) == 0 else 1024 - r["n"] for r in got)
    assert padded / sum(r["n"] for r in got) < 0.03


# ---- the pipeline


def test_pipeline_stages(spark):
    import corpus_pipeline as cp
    from tessera.llm import cascade, semicrf
    from tessera.session import materialize

    assert [n for n, _ in cp.STAGES] == ["quality", "near_duplicates", "personal_data", "mixture", "sequences"]
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumn("extra", F.lit(1))
    after = {}
    for name, stage in cp.STAGES:
        after[name] = docs = materialize(stage(spark, docs, SF), f"test-{name}")
        if name != "sequences":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars", "extra"]
    source = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    kept = {r["doc_id"] for r in after["quality"].collect()}
    assert kept == {d for d, t in source.items() if cascade.kept(cascade.Text(t.encode()), list(cascade.RULES))}
    rows = [(r["doc_id"], r["text"]) for r in after["quality"].collect()]
    assert {r["doc_id"] for r in after["near_duplicates"].collect()} == {c for _, _, c in brute_duplicates(rows)}
    model = semicrf.train()
    assert {r["doc_id"]: r["text"] for r in after["personal_data"].collect()} == {d: semicrf.mask(source[d].encode(), model).decode() for d in {r["doc_id"] for r in after["near_duplicates"].collect()}}
    counts = Counter(r["doc_id"] for r in after["mixture"].collect())
    assert max(counts.values()) <= 3
    whole = Counter()
    for r in after["sequences"].collect():
        whole[r["doc_id"]] += r["length"]
    assert set(whole) == set(counts)


def test_pipeline_leaves_its_result_alone(spark):
    import os

    import corpus_pipeline as cp
    from tessera.session import shared_dir

    folder = f"{shared_dir(spark)}/tessera".removeprefix("file:")
    before = set(os.listdir(folder)) if os.path.isdir(folder) else set()
    assert cp.run(spark, SF).count() > 0
    assert [x.rsplit("-", 1)[0] for x in set(os.listdir(folder)) - before] == ["pipeline-sequences"]


def test_pipeline_stages_take_odd_rows(spark):
    import corpus_pipeline as cp

    good = " ".join(f"word{i % 83}{' and' * (i % 9 == 0)}{' the' * (i % 9 == 4)}" for i in range(70))
    rows = [(None, good, "en", None, None, "c"), (1, None, "en", "a", 0, "c"), (2, "", None, "a", 0, "c"), (3, good + " more", "en", "b", 1, "c"), (3, good + " more", "en", "b", 1, "c"), (4, "a@b.org " + " ".join(f"é{i}" for i in range(60)), None, None, 9, None)]
    rows += [(5, " ".join(f"x{i * i % 9973}y" for i in range(60_000)), "en", "a", 1, "c"), (6, "unbroken" * 20_000, "en", "a", 1, "c")]
    table = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, fp string").withColumn("copies", F.lit("clash")).withColumn("row", F.lit(1)).withColumn("s", F.lit(2))
    for name, stage in cp.STAGES:
        out = stage(spark, table, SF)
        if name != "sequences":
            assert out.columns == table.columns, name
        assert out.count() > 0, name
        assert stage(spark, table.limit(0), SF).count() == 0, name
    stayed = Counter(r["doc_id"] for r in golay.keep_one(table).collect())
    assert max(stayed.values()) == 1 and stayed[1] == 1 and stayed[2] == 0 and {4, 5, 6} <= set(stayed)
