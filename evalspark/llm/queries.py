"""Registered queries of the corpus operators, with SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evalspark.llm import (ann, chat, exact_topk, filter_audit, language_id, line_dedup, mixing, near_dedup, packing, repeats, simhash, spelling,
                           url_rules)
from evalspark.llm.common import table

Build = Callable[[SparkSession, str], DataFrame]


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = language_id.learn_and_predict(table(spark, sf_dir, "documents"))
    return out.select("row.doc_id", "held_out", "lang_pred", "score")


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup_lines(table(spark, sf_dir, "documents"), min_chars=1, min_docs=10, keep_first=False, with_text=False)
    return out.select("row.doc_id", "out.n_lines", "out.n_dropped", "out.kept_sha256")


def op3_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.remove_repeats(table(spark, sf_dir, "documents"), length=200, with_text=False).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), capacity=2048)


def op5_robust_graph_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


def op6_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_topk.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20, scale=64.0)


def op7_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_rules.judge(table(spark, sf_dir, "pages"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken_words(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.format_chats(table(spark, sf_dir, "conversations"))


def op10_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"), size=4, percent=80)


def op11_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_prints(table(spark, sf_dir, "documents"), size=3, distance=2).select("doc_id", "fingerprint", "component_id")


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_variants(table(spark, sf_dir, "documents"), every=31, min_length=7, min_count=2, ratio=10)


OP2_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
l AS (SELECT doc_id, text, generate_subscripts(string_split(text, chr(10)), 1) AS pos, unnest(string_split(text, chr(10))) AS line FROM d),
k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                          'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
often AS (SELECT key FROM k WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT doc_id) >= 10)
SELECT doc_id, count(*) AS n_lines, count(o.key) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE o.key IS NULL), '')) AS kept_sha256
FROM k LEFT JOIN often o ON k.key = o.key GROUP BY doc_id
"""

OP6_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS q FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS query_id, b.vec_id, CAST(list_dot_product(a.q, b.q) AS BIGINT) AS score
      FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""

OP8_SQL = r"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
                  md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS shuffle FROM documents),
s0 AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
s1 AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS place FROM s0),
s2 AS (SELECT *, CASE place % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight, source_size * 3 AS cap FROM s1),
s3 AS (SELECT *, coalesce(CAST(sum(cap) OVER (ORDER BY cap / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS BIGINT), 0) AS spent,
              sum(weight) OVER (ORDER BY cap / weight, place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest_weight,
              CAST(sum(source_size) OVER () AS BIGINT) AS all_words FROM s2),
s4 AS (SELECT *, min(CASE WHEN (all_words - spent) / rest_weight * weight <= cap THEN struct_pack(r := cap / weight, p := place, l := (all_words - spent) / rest_weight) END) OVER () AS first_level FROM s3),
t AS (SELECT source, source_size, place, all_words, CASE WHEN all_words = 0 THEN 0.0::DOUBLE ELSE least(cap::DOUBLE, first_level.l * weight) END AS target FROM s4),
q AS (SELECT d.*, t.source_size, t.target, t.place, t.all_words,
             sum(size) OVER (PARTITION BY d.source ORDER BY shuffle, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS sent
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
c AS (SELECT q.*, e.turn, CAST(sent + e.turn * source_size AS DOUBLE) / target AS finish FROM q CROSS JOIN (VALUES (0), (1), (2)) e(turn) WHERE size > 0),
o AS (SELECT *, sum(size) OVER (ORDER BY finish, place, shuffle, doc_id, size, turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto FROM c),
k AS (SELECT doc_id, source, size, count(*) AS copies FROM o WHERE upto <= all_words GROUP BY doc_id, source, size)
SELECT q.doc_id, q.size, q.source_size, q.target, CAST(q.size * coalesce(k.copies, 0) AS BIGINT) AS taken
FROM q LEFT JOIN k ON q.doc_id IS NOT DISTINCT FROM k.doc_id AND q.source IS NOT DISTINCT FROM k.source AND q.size = k.size
"""

OP9_SQL = """
WITH c AS (SELECT conv_id, list(struct_pack(role := role, text := text) ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS turns
           FROM conversations GROUP BY conv_id),
g AS (SELECT turns, len(turns) AS n_turns, min(conv_id) AS conv_id, count(*) AS n_copies FROM c GROUP BY turns),
p AS (SELECT DISTINCT a.conv_id FROM g a JOIN g b ON a.turns[1] = b.turns[1] AND a.n_turns < b.n_turns AND b.turns[1:a.n_turns] = a.turns)
SELECT conv_id, n_turns, n_copies,
       list_aggregate(list_transform(turns, lambda t: concat('<|', coalesce(t.role, ''), '|>', chr(10), coalesce(t.text, ''), chr(10), '<|end|>', chr(10))), 'string_agg', '') AS rendered
FROM g WHERE conv_id NOT IN (SELECT conv_id FROM p)
"""

OP12_SQL = r"""
WITH t AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words, min(doc_id) OVER (PARTITION BY text) AS first_id FROM t),
l AS (SELECT doc_id, max(CAST(coalesce(quality = 1, false) AS INTEGER)) AS good, max(CAST(coalesce(toxic = 1, false) AS INTEGER)) AS bad FROM labels GROUP BY doc_id),
m AS (SELECT w.part, coalesce(l.good, 0) AS good, coalesce(l.bad, 0) AS bad,
             CASE WHEN len(words) < 50 THEN 1 ELSE 0 END + CASE WHEN 100 * len(list_distinct(words)) < 65 * len(words) THEN 2 ELSE 0 END
             + CASE WHEN 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 5 * length(text) THEN 4 ELSE 0 END
             + CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 8 ELSE 0 END + CASE WHEN w.doc_id > first_id THEN 16 ELSE 0 END AS mask
      FROM w LEFT JOIN l ON w.doc_id = l.doc_id),
cell AS (SELECT part, mask, count(*) AS n, sum(good) AS good, sum(bad) AS bad FROM m GROUP BY part, mask),
f AS (SELECT chr(CAST(65 + i AS INTEGER)) AS letter, 1 << i AS bit FROM range(5) r(i)),
o AS (SELECT concat(a.letter, b.letter, c.letter, d.letter, e.letter) AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits
      FROM f a, f b, f c, f d, f e WHERE a.bit + b.bit + c.bit + d.bit + e.bit = 31 AND len(list_distinct([a.bit, b.bit, c.bit, d.bit, e.bit])) = 5),
s AS (SELECT filter_order, CAST(step AS INTEGER) AS step, bits[step] AS bit, CAST(list_sum(bits[1:step]) AS BIGINT) - bits[step] AS past FROM o, range(1, 6) r(step)),
x AS (SELECT part, filter_order, step, bit, n, good, bad, mask, mask & past = 0 AND mask & bit <> 0 AS hit, mask & past <> 0 AND mask & bit <> 0 AS late, mask & (past + bit) = 0 AS clean FROM cell, s),
g AS (SELECT part, filter_order, step, bit, CAST(sum(CASE WHEN clean THEN n ELSE 0 END) AS BIGINT) AS kept, CAST(sum(CASE WHEN hit THEN n ELSE 0 END) AS BIGINT) AS removed,
             CAST(sum(CASE WHEN late THEN n ELSE 0 END) AS BIGINT) AS redundant, CAST(sum(CASE WHEN mask = bit THEN n ELSE 0 END) AS BIGINT) AS unique_fails,
             CAST(sum(CASE WHEN hit THEN good ELSE 0 END) AS BIGINT) AS good_lost, CAST(sum(CASE WHEN hit THEN bad ELSE 0 END) AS BIGINT) AS toxic_lost
      FROM x GROUP BY part, filter_order, step, bit)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
       CAST(sum(removed) OVER (PARTITION BY part, bit) AS BIGINT) AS shapley FROM g
"""

QUERIES: dict[str, tuple[Build, str | None]] = {
    "op1_language_id": (op1_language_id, None),
    "op2_line_dedup": (op2_line_dedup, OP2_SQL),
    "op3_suffix_array_dedup": (op3_suffix_array_dedup, None),
    "op4_best_fit_packing": (op4_best_fit_packing, None),
    "op5_robust_graph_search": (op5_robust_graph_search, None),
    "op6_exact_top_k": (op6_exact_top_k, OP6_SQL),
    "op7_url_rules": (op7_url_rules, None),
    "op8_mixing": (op8_mixing, OP8_SQL),
    "op9_chat_format": (op9_chat_format, OP9_SQL),
    "op10_near_dedup": (op10_near_dedup, None),
    "op11_simhash_dedup": (op11_simhash_dedup, None),
    "op12_filter_audit": (op12_filter_audit, OP12_SQL),
    "op13_spelling_variants": (op13_spelling_variants, None),
}
