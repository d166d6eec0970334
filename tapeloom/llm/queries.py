"""The registered queries of this subpackage and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeloom.llm import bpe, language, ngram_join, packing, prefix_trie, quality, structure_repair, substring_dedup, suffix_dedup, token_counts, topk, toxicity, urls

#: Vocabulary files are a parameter of the operators; these are the ones the queries use.
WORD_BPE = "word_bpe_49k.json"
BYTE_BPE = "byte_bpe_50k.json"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{directory}/{name}.parquet")


def query(run: Callable[[SparkSession, str], DataFrame]):
    QUERIES[run.__name__] = run
    return run


@query
def op1_language_id(spark: SparkSession, directory: str) -> DataFrame:
    return language.language_id(table(spark, directory, "documents"))


@query
def op2_ngram_jaccard_join(spark: SparkSession, directory: str) -> DataFrame:
    return ngram_join.ngram_jaccard_join(table(spark, directory, "documents"), width=4, similar=85)


@query
def op3_url_filters(spark: SparkSession, directory: str) -> DataFrame:
    return urls.url_filters(table(spark, directory, "pages"), urls.labelled_urls(spark))


@query
def op4_best_fit_packing(spark: SparkSession, directory: str) -> DataFrame:
    return packing.best_fit_packing(table(spark, directory, "documents"), public_tokenizers.path(WORD_BPE))


@query
def op5_suffix_dedup(spark: SparkSession, directory: str) -> DataFrame:
    return suffix_dedup.suffix_dedup(table(spark, directory, "documents"))


@query
def op6_bpe_round_trip(spark: SparkSession, directory: str) -> DataFrame:
    return bpe.bpe_round_trip(table(spark, directory, "documents"), public_tokenizers.path(BYTE_BPE))


@query
def op7_toxicity(spark: SparkSession, directory: str) -> DataFrame:
    return toxicity.toxicity(table(spark, directory, "documents"), table(spark, directory, "labels"))


@query
def op8_quality_rules(spark: SparkSession, directory: str) -> DataFrame:
    return quality.quality_rules(table(spark, directory, "documents"))


SQL["op8_quality_rules"] = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT rid, doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words FROM d),
win AS (SELECT rid, i, array_to_string(words[i:i + 4], ' ') AS five FROM (SELECT rid, words, unnest(range(1, len(words) - 3)) AS i FROM w WHERE len(words) >= 5)),
often AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, five) AS c FROM win) WHERE c > 1),
rep AS (SELECT rid, count(DISTINCT i + k) AS n FROM often CROSS JOIN (SELECT unnest(range(0, 5)) AS k) GROUP BY rid),
lines AS (SELECT rid, line, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS n FROM (SELECT rid, unnest(string_split(text, chr(10))) AS line FROM d)),
judged AS (
  SELECT rid, line, n, length(regexp_replace(line, '[\x20\x09-\x0D]', '', 'g')) AS chars,
    (n >= 3 AND 3 * (length(line) - length(replace(replace(line, '|', ''), '>', ''))) >= n)
    OR regexp_matches(lower(line), 'all rights reserved|licensed under|released under the|cookie policy|privacy policy|terms of use|terms of service|click here|subscribe to our|sign up for|enable javascript|skip to content')
    OR length(line) - length(regexp_replace(line, '[!-/:-@\[-`{-~]', '', 'g')) > n
    OR NOT regexp_matches(line, '(?:[.!?]|…)(?:["'')\]]|»|”)*(?:[ \t\x0b\x0c\r]|$)') AS failed
  FROM lines WHERE n > 0),
per AS (SELECT rid, count(*) - count(DISTINCT line) AS dup, count(*) FILTER (failed) AS n_failed, coalesce(sum(chars) FILTER (failed), 0) AS lost FROM judged GROUP BY rid),
base AS (
  SELECT w.doc_id, CAST(len(w.words) AS BIGINT) AS n_words, CAST(length(regexp_replace(w.text, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
    CAST(length(w.text) - length(regexp_replace(w.text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(coalesce(per.dup, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words,
    coalesce(per.n_failed, 0) AS n_failed_lines, coalesce(per.lost, 0) AS lost
  FROM w LEFT JOIN per USING (rid) LEFT JOIN rep USING (rid)),
flagged AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM base)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND 100 * lost <= 50 * word_chars AS kept,
  CAST(n_failed_lines AS BIGINT) AS n_failed_lines
FROM flagged
"""


@query
def op9_exact_top_k(spark: SparkSession, directory: str) -> DataFrame:
    return topk.top_k(table(spark, directory, "embeddings"))


SQL["op9_exact_top_k"] = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 1024) AS BIGINT)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(range(1, len(q.e) + 1), lambda i: q.e[i] * c.e[i])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id AND len(q.e) = len(c.e)),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 10
"""


@query
def op10_token_counts(spark: SparkSession, directory: str) -> DataFrame:
    return token_counts.token_counts(table(spark, directory, "documents"), public_tokenizers.path(WORD_BPE))


@query
def op11_conversation_prefix_trie(spark: SparkSession, directory: str) -> DataFrame:
    return prefix_trie.prefix_trie(prefix_trie.grafted(prefix_trie.turn_sequences(table(spark, directory, "conversations"))))


#: The unsigned CRC-32 of the decimal digits in ``s``.
_CRC32 = """xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(s, ''), lambda x: CAST(ascii(x) AS BIGINT))),
  lambda c, b: list_reduce(list_prepend(xor(c, b), CAST(range(8) AS BIGINT[])), lambda a, i: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END)), 4294967295)"""

SQL["op11_conversation_prefix_trie"] = f"""
WITH own AS (
  SELECT conv_id, CAST(conv_id AS VARCHAR) AS s, list(struct_pack(r := coalesce(role, ''), t := coalesce(text, '')) ORDER BY turn NULLS FIRST) AS turns
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
h AS (SELECT conv_id, turns, CAST({_CRC32} % 9 AS BIGINT) AS h FROM own),
seq AS (SELECT h.conv_id, list_concat(coalesce(b.turns[1:h.h], []), h.turns[h.h + 1:]) AS turns FROM h LEFT JOIN own b ON b.conv_id = h.conv_id - h.conv_id % 5),
path AS (SELECT conv_id, d, turns[1:d] AS key, len(turns) = d AS ends FROM (SELECT conv_id, turns, unnest(range(0, len(turns) + 1)) AS d FROM seq)),
node AS (
  SELECT key, d, min(conv_id) AS conv_id, count(*) AS n, string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (ends) AS ids, coalesce(strlen(last(key)[d].t), 0) AS bytes
  FROM path GROUP BY key, d),
kids AS (SELECT key[1:d - 1] AS key, count(*) AS n_children FROM node WHERE d > 0 GROUP BY ALL),
below AS (
  SELECT key[1:up] AS key, sum(leaf) AS n_leaves, sum(saved) AS saved
  FROM (SELECT node.key, unnest(range(0, d + 1)) AS up, CASE WHEN n_children IS NULL THEN 1 ELSE 0 END AS leaf, (n - 1) * bytes AS saved FROM node LEFT JOIN kids USING (key)) GROUP BY ALL)
SELECT CAST(node.conv_id AS BIGINT) AS conv_id, CAST(node.d AS BIGINT) AS depth, CAST(p.conv_id AS BIGINT) AS parent_conv_id, CAST(node.n AS BIGINT) AS n_convs,
  CAST(coalesce(n_children, 0) AS BIGINT) AS n_children, CAST(n_leaves AS BIGINT) AS n_leaves, CAST(saved AS BIGINT) AS saved_tokens, sha256(coalesce(node.ids, '')) AS ends_sha256
FROM node JOIN below USING (key) LEFT JOIN kids USING (key) LEFT JOIN node p ON node.d > 0 AND p.d = node.d - 1 AND p.key = node.key[1:node.d - 1]
"""


@query
def op12_conversation_repair(spark: SparkSession, directory: str) -> DataFrame:
    return structure_repair.structure_repair(structure_repair.damaged(table(spark, directory, "conversations")))


SQL["op12_conversation_repair"] = rf"""
WITH RECURSIVE
named AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS s FROM conversations),
coded AS (SELECT *, {_CRC32} % 20 AS code FROM named),
hurt AS (
  SELECT conv_id, turn, CASE code WHEN 4 THEN 'user' ELSE role END AS role, CASE code WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
    unnest(CASE code WHEN 0 THEN [] WHEN 3 THEN [1, 2] ELSE [1] END) AS copy FROM coded),
judged AS (
  SELECT conv_id, turn, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i, substr(role, 1, 1) AS c, NOT regexp_matches(text, '[^\x20\x09-\x0D]') AS blank,
    NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') AS cut FROM hurt),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS again FROM judged),
r AS (SELECT *, blank OR again AS must, CAST(cut AS BIGINT) AS t, lag(c) OVER (PARTITION BY conv_id ORDER BY i) AS before FROM placed),
n AS (
  SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (again AND NOT blank) AS duplicate,
    count(*) FILTER (cut AND NOT must) AS truncated, count(*) FILTER (before IS NOT NULL AND before || c NOT IN ('su', 'ua', 'au')) AS illegal FROM r GROUP BY conv_id),
v(conv_id, i, v0, v1, v2, v3) AS (
  SELECT conv_id, n + 1, CAST(0 AS BIGINT), CAST(4 AS BIGINT), CAST(2 AS BIGINT), CAST(0 AS BIGINT) FROM n
  UNION ALL
  SELECT conv_id, i, least(h0, 2 + h2, 4 + h3), least(h1, 2 + h2, 4 + h3), least(h2, 2 + h3), least(h3, 2 + h2)
  FROM (
    SELECT r.conv_id, r.i,
      least(3 + v0, CASE WHEN NOT must THEN 2 + t + v2 END, CASE WHEN NOT must AND c = 's' THEN t + v1 WHEN NOT must AND c = 'u' THEN t + v2 END) AS h0,
      least(3 + v1, CASE WHEN NOT must THEN 2 + t + v2 END, CASE WHEN NOT must AND c = 'u' THEN t + v2 END) AS h1,
      least(3 + v2, CASE WHEN NOT must THEN 2 + t + v3 END, CASE WHEN NOT must AND c = 'a' THEN t + v3 END) AS h2,
      least(3 + v3, CASE WHEN NOT must THEN 2 + t + v2 END, CASE WHEN NOT must AND c = 'u' THEN t + v2 END) AS h3
    FROM v JOIN r ON r.conv_id IS NOT DISTINCT FROM v.conv_id AND r.i = v.i - 1)),
whole AS (
  SELECT n.conv_id, n.n, rows, costs FROM n
  JOIN (SELECT conv_id, list(struct_pack(role := role, text := text, c := c, must := must, t := t) ORDER BY i) AS rows FROM r GROUP BY conv_id) a ON a.conv_id IS NOT DISTINCT FROM n.conv_id
  JOIN (SELECT conv_id, list([v0, v1, v2, v3] ORDER BY i) AS costs FROM v GROUP BY conv_id) b ON b.conv_id IS NOT DISTINCT FROM n.conv_id),
trace(conv_id, i, q, audit, cost, lines) AS (
  SELECT conv_id, CAST(1 AS BIGINT), 0, '', CAST(0 AS BIGINT), CAST([] AS VARCHAR[]) FROM whole
  UNION ALL
  SELECT conv_id, CASE WHEN edit = 'I' THEN i ELSE i + 1 END, CASE edit WHEN 'D' THEN q WHEN 'K' THEN kept ELSE made END, audit || edit,
    cost + CASE edit WHEN 'D' THEN 3 WHEN 'I' THEN 2 WHEN 'K' THEN row.t ELSE 2 + row.t END,
    CASE edit WHEN 'D' THEN lines WHEN 'I' THEN list_append(lines, name || ':') WHEN 'K' THEN list_append(lines, row.role || ':' || row.text) ELSE list_append(lines, name || ':' || row.text) END
  FROM (
    SELECT *, CASE WHEN i <= n AND 3 + costs[i + 1][q + 1] = costs[i][q + 1] THEN 'D' WHEN 2 + costs[i][made + 1] = costs[i][q + 1] THEN 'I'
      WHEN kept IS NOT NULL AND row.t + costs[i + 1][kept + 1] = costs[i][q + 1] THEN 'K' ELSE 'R' END AS edit
    FROM (
      SELECT trace.*, n, costs, CASE q WHEN 2 THEN 3 ELSE 2 END AS made, CASE q WHEN 2 THEN 'assistant' ELSE 'user' END AS name, rows[i] AS row,
        CASE WHEN i > n OR rows[i].must THEN NULL WHEN q = 0 AND rows[i].c = 's' THEN 1 WHEN q <> 2 AND rows[i].c = 'u' THEN 2 WHEN q = 2 AND rows[i].c = 'a' THEN 3 END AS kept
      FROM trace JOIN whole ON whole.conv_id IS NOT DISTINCT FROM trace.conv_id
      WHERE i <= n OR costs[i][q + 1] > 0))),
ended AS (SELECT trace.* FROM trace JOIN whole ON whole.conv_id IS NOT DISTINCT FROM trace.conv_id WHERE i > n AND costs[i][q + 1] = 0)
SELECT c.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, CAST(coalesce(blank, 0) AS BIGINT) AS blank, CAST(coalesce(duplicate, 0) AS BIGINT) AS duplicate, CAST(coalesce(truncated, 0) AS BIGINT) AS truncated,
  CAST(coalesce(illegal, 0) AS BIGINT) AS illegal, CAST(coalesce(cost, 0) AS BIGINT) AS cost, coalesce(audit, '') AS audit, sha256(coalesce(array_to_string(lines, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN n ON n.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN ended ON ended.conv_id IS NOT DISTINCT FROM c.conv_id
"""


@query
def op13_substring_dedup(spark: SparkSession, directory: str) -> DataFrame:
    kept = substring_dedup.kept_words(table(spark, directory, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


SQL["op13_substring_dedup"] = r"""
WITH w AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(doc_id, 9223372036854775807) AS did, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
win AS (SELECT rid, did, i, array_to_string(words[i:i + 12], ' ') AS run FROM (SELECT rid, did, words, unnest(range(1, len(words) - 11)) AS i FROM w WHERE len(words) >= 13)),
late AS (SELECT rid, i FROM (SELECT rid, did, i, min(did) OVER (PARTITION BY run) AS least FROM win) WHERE least < did),
gone AS (SELECT DISTINCT rid, i + k AS i FROM late CROSS JOIN (SELECT unnest(range(0, 13)) AS k)),
each AS (SELECT rid, i, words[i] AS word FROM (SELECT rid, words, unnest(range(1, len(words) + 1)) AS i FROM w)),
kept AS (SELECT rid, string_agg(word, ' ' ORDER BY i) AS kept, count(*) AS n FROM each ANTI JOIN gone USING (rid, i) GROUP BY rid)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(len(words) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (rid)
"""
