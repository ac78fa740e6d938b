"""The registered queries of this subpackage, and the SQL that gives the same rows where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.cascade import STOP_WORDS
from tessera.llm.common import table


def op1_chat_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.chat import digests, format_turns

    said = "\\### Assistant: </turn> ok"
    own = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    more = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    return digests(format_turns(own.unionByName(more)))


def op2_cap_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.capfilters import near_duplicates

    return near_duplicates(table(spark, sf_dir, "embeddings"))


def op3_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.mixing import mix

    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "copies")


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.tokenfiles import token_files

    return token_files(table(spark, sf_dir, "documents"))


def op5_quality_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.cascade import figures

    return figures(table(spark, sf_dir, "documents"))


def op6_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.kneser import score

    return score(table(spark, sf_dir, "documents"))


def op7_subword_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.subword import classify

    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_pack_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.packing import pack

    return pack(table(spark, sf_dir, "documents"))


def op10_pii_semicrf(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.semicrf import detect

    return detect(table(spark, sf_dir, "documents"))


def op9_simhash_golay(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.golay import near_duplicates

    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op11_phrase_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.phrases import contaminated

    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_voronoi_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.negatives import hard_negatives

    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label").cast("long") + 1) % 10).otherwise(F.col("label").cast("long"))
    return hard_negatives(table(spark, sf_dir, "embeddings").withColumn("label", moved), F.col("vec_id") % 100 == 0)


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.merkle import manifest

    return manifest(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in sorted(globals().items()) if k.startswith("op") and callable(f)}


_OP3 = r"""
WITH base AS (
  SELECT doc_id, source, md5(text) AS mark, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents
), numbered AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id, source, mark) - 1 AS number FROM base
), per AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source ASC NULLS LAST) - 1 AS rnk
  FROM base GROUP BY source
), w AS (
  SELECT *, (rnk % 3 + 1)::BIGINT AS weight FROM per
), lev AS (
  SELECT *, sum(source_size) OVER () AS total, sum(weight) OVER () AS weights,
    coalesce(sum(source_size) OVER o, 0) AS before_size, coalesce(sum(weight) OVER o, 0) AS before_weight
  FROM w WINDOW o AS (ORDER BY source_size::DOUBLE / weight, rnk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), own AS (
  SELECT *, (total - 3 * before_size)::DOUBLE / (weights - before_weight)::DOUBLE AS own FROM lev
), lvl AS (
  SELECT own AS level FROM own WHERE own * weight <= 3 * source_size ORDER BY source_size::DOUBLE / weight, rnk LIMIT 1
), tgt AS (
  SELECT source, source_size, least((3 * source_size)::DOUBLE, level * weight) AS target,
    CASE WHEN source_size > 0 THEN least((3 * source_size)::DOUBLE, level * weight) / source_size ELSE 0.0 END AS rate
  FROM own, lvl
), drawn AS (
  SELECT b.doc_id, b.size, t.source_size, t.target, t.rate,
    ('0x' || substr(md5(coalesce(b.doc_id::VARCHAR, 'null') || ':' || coalesce(b.source, 'null') || ':' || coalesce(b.mark, 'null') || ':' || b.number::VARCHAR), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0 AS draw
  FROM numbered b JOIN tgt t ON b.source IS NOT DISTINCT FROM t.source
), counted AS (
  SELECT *, (floor(rate) + CASE WHEN draw < rate - floor(rate) THEN 1 ELSE 0 END)::BIGINT AS copies FROM drawn
)
SELECT doc_id, size, source_size, target, (copies * size)::BIGINT AS taken, copies FROM counted
"""


_STOP_WORDS = "[" + ", ".join(f"'{w.decode()}'" for w in sorted(STOP_WORDS)) + "]"

_OP5 = r"""
WITH base AS (
  SELECT doc_id, row_number() OVER () AS rid, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), pos AS (
  SELECT rid, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT rid, w, unnest(range(1, len(w) - 1)) AS i FROM base WHERE len(w) > 2)
), often AS (
  SELECT rid, g FROM pos GROUP BY rid, g HAVING count(*) > 1
), rep AS (
  SELECT rid, count(DISTINCT p) AS n FROM (SELECT pos.rid, unnest([i, i + 1, i + 2]) AS p FROM pos JOIN often ON pos.rid = often.rid AND pos.g = often.g) GROUP BY rid
), grams AS (
  SELECT rid, k, w[i:i + k - 1] AS g FROM (SELECT rid, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM base, (VALUES (2), (3), (4)) v(k) WHERE len(w) >= k)
), top AS (
  SELECT rid, max(b) FILTER (k = 2) AS top2, max(b) FILTER (k = 3) AS top3, max(b) FILTER (k = 4) AS top4
  FROM (SELECT rid, k, count(*) * strlen(array_to_string(g, '')) AS b FROM grams GROUP BY rid, k, g HAVING count(*) > 1) GROUP BY rid
), ln AS (
  SELECT rid, l FROM (SELECT rid, unnest(string_split(t, chr(10))) AS l FROM base) WHERE regexp_matches(l, '[^\x20\x09-\x0D]')
), dup AS (
  SELECT rid, sum(n) AS n_lines, sum(n - 1) AS n, sum(n * strlen(l)) AS line_bytes, sum((n - 1) * strlen(l)) AS dup_bytes,
    sum(n) FILTER (regexp_matches(l, '^[\x20\x09-\x0D]*[-*•]')) AS bullets, sum(n) FILTER (regexp_matches(l, '(\.\.\.|…)[\x20\x09-\x0D]*$')) AS ellipses
  FROM (SELECT rid, l, count(*) AS n FROM ln GROUP BY rid, l) GROUP BY rid
), fig AS (
  SELECT b.doc_id, len(w)::BIGINT AS n_words, len(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars, strlen(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS word_bytes,
    len(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, coalesce(dup.n, 0)::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words,
    coalesce(dup.n_lines, 0) AS n_lines, coalesce(dup.line_bytes, 0) AS line_bytes, coalesce(dup.dup_bytes, 0) AS dup_bytes, coalesce(dup.bullets, 0) AS bullets, coalesce(dup.ellipses, 0) AS ellipses,
    coalesce(top2, 0) AS top2, coalesce(top3, 0) AS top3, coalesce(top4, 0) AS top4,
    len(list_filter(w, lambda x: regexp_matches(x, '[A-Za-z]|[^\x00-\x7F]'))) AS alphabetic,
    len(list_intersect(list_distinct(list_transform(w, lambda x: translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'))), STOP_WORDS)) AS stops,
    len(regexp_replace(t, '[^A-Z]', '', 'g')) AS uppers, len(regexp_replace(t, '[^A-Za-z]', '', 'g')) AS letters
  FROM base b LEFT JOIN rep ON b.rid = rep.rid LEFT JOIN dup ON b.rid = dup.rid LEFT JOIN top ON b.rid = top.rid
), judged AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
    10 * n_symbols > n_words OR word_chars < 3 * n_words OR word_chars > 10 * n_words OR 10 * alphabetic < 8 * n_words
    OR (stops < 2 AND 2 * letters >= word_chars) OR 10 * uppers > 4 * letters OR 10 * bullets > 9 * n_lines OR 10 * ellipses > 3 * n_lines
    OR 10 * n_dup_lines > 3 * n_lines OR 10 * dup_bytes > 2 * line_bytes
    OR 100 * top2 > 20 * word_bytes OR 100 * top3 > 18 * word_bytes OR 100 * top4 > 16 * word_bytes AS rejected FROM fig
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT (base_failed OR rejected) AS kept FROM judged
""".replace("STOP_WORDS", _STOP_WORDS)


_OP1 = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
)
SELECT conv_id, count(*)::BIGINT AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(CASE WHEN role = 'assistant' THEN len(text) END), 0)::BIGINT AS loss_chars,
  sha256(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn, role, text)) AS loss_sha256,
  sum(15 + len(role) + len(regexp_extract_all(role, '[\\:\n]')) + len(text) + len(regexp_extract_all(text, '### |</turn>')))::BIGINT AS formatted_chars
FROM c GROUP BY conv_id
"""

#: All pairs of a label, for small scales; components by reaching the least id step by step.
_OP2 = """
WITH RECURSIVE v AS MATERIALIZED (
  SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), link AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE CASE WHEN len(a.e) = len(b.e) THEN list_cosine_similarity(a.e, b.e) >= 0.98 ELSE false END
), reach(a, b) AS (
  SELECT vec_id, vec_id FROM embeddings UNION SELECT r.a, l.b FROM reach r JOIN link l ON r.b = l.a
), comp AS (
  SELECT a, min(b) AS component_id FROM reach GROUP BY a
), deg AS (
  SELECT a, count(*) AS n FROM link GROUP BY a
)
SELECT m.vec_id, coalesce(deg.n, 0)::BIGINT AS n_links, comp.component_id, m.vec_id = comp.component_id AS kept
FROM embeddings m JOIN comp ON m.vec_id = comp.a LEFT JOIN deg ON m.vec_id = deg.a
"""


_OP11 = r"""
WITH docs AS (
  SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), WORD) AS w FROM documents
), items AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), WORD) AS w FROM benchmark
), windows AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i:i + 9], ' ') AS g FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM items WHERE len(w) > 0)
), grams AS (
  SELECT rid, n, i, array_to_string(w[i:i + n - 1], ' ') AS g FROM (SELECT rid, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM docs, (SELECT DISTINCT n FROM windows) WHERE len(w) >= n)
), found AS (
  SELECT g.rid, g.n, g.i, w.item_id FROM grams g JOIN windows w ON g.n = w.n AND g.g = w.g
), hit AS (
  SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(i, i + n)) AS p FROM found) GROUP BY rid
), own AS (
  SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT rid, item_id::VARCHAR AS item FROM found WHERE item_id IS NOT NULL) GROUP BY rid
)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(h.n_hit, 0)::BIGINT AS n_hit, coalesce(o.n_items, 0)::BIGINT AS n_items, sha256(coalesce(o.items, '')) AS items_sha256, coalesce(h.n_hit, 0) > 0 AS contaminated
FROM docs d LEFT JOIN hit h ON d.rid = h.rid LEFT JOIN own o ON d.rid = o.rid
""".replace("WORD", r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'")

_OP12 = """
WITH v AS (
  SELECT row_number() OVER () AS rid, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label::BIGINT + 1) % 10 ELSE label END AS label,
    list_resize(list_transform(embedding, lambda x: floor(256 * x::DOUBLE)), (SELECT max(len(embedding)) FROM embeddings), 0.0::DOUBLE) AS e
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), pos AS (
  SELECT a.rid, a.vec_id AS anchor_id, a.label, a.e, b.vec_id AS positive_id, list_inner_product(a.e, b.e)::BIGINT AS ps,
    row_number() OVER (PARTITION BY a.rid ORDER BY list_inner_product(a.e, b.e) DESC, b.vec_id) AS k
  FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0 QUALIFY k <= 5
), scored AS (
  SELECT a.rid, n.label, n.vec_id AS negative_id, list_inner_product(a.e, n.e)::BIGINT AS ns FROM v a JOIN v n ON a.label <> n.label WHERE a.vec_id % 100 = 0
)
SELECT p.anchor_id, p.positive_id, (row_number() OVER (PARTITION BY p.rid, p.k ORDER BY s.ns DESC, s.negative_id))::INTEGER AS rank, s.negative_id, p.ps AS positive_score, s.ns AS negative_score
FROM pos p JOIN scored s ON p.rid = s.rid AND 30 * p.ps <= 100 * s.ns AND 100 * s.ns <= 90 * p.ps QUALIFY rank <= 10
"""

_OP13 = r"""
WITH RECURSIVE base AS (
  SELECT *, row_number() OVER (PARTITION BY g ORDER BY coalesce(doc_id, -9223372036854775808), leaf) - 1 AS r, count(*) OVER (PARTITION BY g) AS n, row_number() OVER () AS rid FROM (
    SELECT doc_id, coalesce('=' || lang, '') AS g, sha256(a || n0 || z) AS leaf,
      CASE WHEN n_chars IS NOT NULL AND xor(list_reduce(bits, lambda c, x: xor(xor(c, x) >> 1, 3988292384 * (xor(c, x) & 1)), 4294967295::BIGINT), 4294967295) % 7 = 0 THEN sha256(a || n1 || z) END AS changed
    FROM (
      SELECT doc_id, lang, n_chars, flatten(list_transform(string_split(doc_id::VARCHAR, ''), lambda ch: [unicode(ch)::BIGINT, 0, 0, 0, 0, 0, 0, 0])) AS bits,
        coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') AS a,
        coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') AS n0, strlen((n_chars::HUGEINT + 1)::VARCHAR) || ':' || (n_chars::HUGEINT + 1) AS n1,
        coalesce(strlen(text) || ':' || text, '-') AS z
      FROM documents
    )
  )
), tree(g, lvl, idx, n, h) AS (
  SELECT g, 0, r, n, leaf FROM base
  UNION ALL
  SELECT g, any_value(lvl) + 1, idx // 2, (any_value(n) + 1) // 2, sha256(string_agg(h, '' ORDER BY idx)) FROM tree WHERE n > 1 GROUP BY g, idx // 2
), subs AS (
  SELECT g, h AS subroot, lvl AS height, row_number() OVER (ORDER BY g) - 1 AS place, count(*) OVER () AS n FROM tree WHERE n = 1
), top(lvl, idx, n, h) AS (
  SELECT 0, place, n, subroot FROM subs
  UNION ALL
  SELECT any_value(lvl) + 1, idx // 2, (any_value(n) + 1) // 2, sha256(string_agg(h, '' ORDER BY idx)) FROM top WHERE n > 1 GROUP BY idx // 2
), step AS (
  SELECT b.rid, t.lvl, CASE WHEN s.h IS NULL THEN 'N' WHEN t.idx % 2 = 0 THEN 'R' || s.h ELSE 'L' || s.h END AS e
  FROM base b JOIN tree t ON t.g = b.g AND t.n > 1 AND t.idx = b.r // (1::BIGINT << t.lvl) LEFT JOIN tree s ON s.g = t.g AND s.lvl = t.lvl AND s.idx = xor(t.idx, 1)
  UNION ALL
  SELECT b.rid, 100 + t.lvl, CASE WHEN s.h IS NULL THEN 'N' WHEN t.idx % 2 = 0 THEN 'R' || s.h ELSE 'L' || s.h END
  FROM base b JOIN subs u ON u.g = b.g JOIN top t ON t.n > 1 AND t.idx = u.place // (1::BIGINT << t.lvl) LEFT JOIN top s ON s.lvl = t.lvl AND s.idx = xor(t.idx, 1)
), path AS (
  SELECT rid, list(e ORDER BY lvl) AS es, string_agg(e[2:], '' ORDER BY lvl) AS others FROM step GROUP BY rid
), done AS (
  SELECT b.doc_id, b.leaf, u.subroot, (SELECT h FROM top WHERE n = 1) AS root, sha256(coalesce(p.others, '')) AS proof_sha256,
    list_reduce(coalesce(p.es, []::VARCHAR[]), lambda h, e: sha256(CASE e[1] WHEN 'N' THEN h WHEN 'R' THEN h || e[2:] ELSE e[2:] || h END), coalesce(b.changed, b.leaf)) AS folded_root
  FROM base b JOIN subs u ON u.g = b.g LEFT JOIN path p ON p.rid = b.rid
)
SELECT *, folded_root = root AS verified FROM done
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_chat_roundtrip": _OP1, "op2_cap_filters": _OP2, "op3_mix_sources": _OP3, "op5_quality_cascade": _OP5, "op11_phrase_index": _OP11, "op12_voronoi_negatives": _OP12, "op13_merkle_manifest": _OP13}
