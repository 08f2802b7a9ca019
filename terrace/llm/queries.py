"""The registered queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import context_mixing, license_scan, line_rules, media, mixing, ngram_join, packing, periodic_runs, quality_pu, spelling, token_counts, toxicity, url_filter
from .common import documents

Query = Callable[[SparkSession, str], DataFrame]


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_rules.op10(documents(spark, sf_dir))


OP10_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents
), win AS (
  SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d WHERE len(w) >= 3)
), dup AS (
  SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM win
), rep AS (
  SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM dup WHERE n >= 2) GROUP BY doc_id
), line AS (
  SELECT doc_id, l, list_filter(regexp_split_to_array(l, '[\x20\x09-\x0D]+'), lambda w: w <> '') AS lw FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS l FROM d)
), judged AS (
  SELECT doc_id, l, len(lw) AS nw,
    len(lw) >= 1 AND (
      (length(l) - length(translate(l, '#*$%&|<>', ''))) * 10 >= len(lw) * 3
      OR (len(lw) >= 4 AND length(regexp_replace(l, '\P{Lu}+', '', 'g')) * 10 >= length(regexp_replace(l, '\P{L}+', '', 'g')) * 6)
      OR (len(lw) >= 10 AND len(list_distinct(lw)) * 3 < len(lw))
      OR (len(lw) <= 25 AND regexp_matches(l, '(?i)(cookie|javascript|privacy policy|terms of use|all rights reserved|sign in|log in|subscribe now|click here|lorem ipsum|politique de confidentialité|tous droits réservés|se connecter|cliquez ici|abonnez-vous|política de privacidad|todos los derechos reservados|iniciar sesión|haga clic|suscríbete|datenschutzerklärung|alle rechte vorbehalten|anmelden|hier klicken|newsletter abonnieren)'))) AS bad,
    length(regexp_replace(l, '[\x20\x09-\x0D]+', '', 'g')) AS solid
  FROM line
), per AS (
  SELECT doc_id, sum(CASE WHEN bad THEN 0 ELSE solid END) AS left_over, count(*) FILTER (nw > 0) - count(DISTINCT l) FILTER (nw > 0) AS n_dup_lines FROM judged GROUP BY doc_id
), f AS (
  SELECT d.doc_id, len(w)::BIGINT AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
    (length(t) - length(translate(t, '#*$%&|<>', '')))::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words, left_over
  FROM d JOIN per USING (doc_id) LEFT JOIN rep USING (doc_id)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND (word_chars = 0 OR 1 - left_over::DOUBLE / word_chars <= 0.5) AS kept
FROM f
"""

QUERIES: dict[str, Query] = {"op10_quality_rules": op10_quality_rules}
ORACLE_SQL: dict[str, str] = {"op10_quality_rules": OP10_SQL}


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.op4(spark.read.parquet(f"{sf_dir}/pages.parquet"))


OP4_SQL = r"""
WITH p AS (
  SELECT page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM pages
), r(rule, h, p, v) AS (VALUES ('org/', 'org', '/', 'allow'), ('example.org/es/', 'example.org', '/es/', 'block'), ('example.org/en/1', 'example.org', '/en/1', 'block'), ('com/fr/', 'com', '/fr/', 'allow'), ('com/de/', 'com', '/de/', 'block')),
b(h) AS (VALUES ('ads-track.example.com'), ('spam-farm.example.org'), ('casino-win.example.net'), ('adult-x.example.com'), ('cheap-pills.example.net'), ('free-bets.example.net')),
m AS (
  SELECT page_id, host, path, (SELECT arg_max(rule || '|' || v, length(rule)) FROM r WHERE (host = r.h OR host LIKE '%.' || r.h) AND starts_with(path, r.p)) AS hit,
    EXISTS (SELECT 1 FROM b WHERE host = b.h OR host LIKE '%.' || b.h) AS blocked FROM p
)
SELECT page_id, host, path, nullif(split_part(coalesce(hit, ''), '|', 1), '') AS rule, CASE WHEN hit IS NOT NULL THEN split_part(hit, '|', 2) WHEN blocked THEN 'block' ELSE 'allow' END AS verdict FROM m
"""

QUERIES["op4_url_filter"] = op4_url_filter
ORACLE_SQL["op4_url_filter"] = OP4_SQL


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.op5(documents(spark, sf_dir))


QUERIES["op5_mixing"] = op5_mixing


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.op7(documents(spark, sf_dir))


QUERIES["op7_packing"] = op7_packing


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.op1(documents(spark, sf_dir))


QUERIES["op1_ngram_join"] = op1_ngram_join


def op2_quality_pu(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_pu.op2(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.op8(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


QUERIES |= {"op2_quality_pu": op2_quality_pu, "op8_toxicity": op8_toxicity}


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.op6(documents(spark, sf_dir))


def op9_context_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return context_mixing.op9(documents(spark, sf_dir))


QUERIES |= {"op6_license_scan": op6_license_scan, "op9_context_mixing": op9_context_mixing}


def op3_media_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.op3(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


QUERIES["op3_media_copies"] = op3_media_copies


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.op11(documents(spark, sf_dir))


#: CRC-32 is written out: a table of 256 entries by its rule (polynomial 0xEDB88320), then a fold over the bytes. Near words share what is left when the
#: letter at one place is taken out, or one of them is that rest.
OP11_SQL = r"""
WITH RECURSIVE crc_table AS (
  SELECT list_transform(range(256), lambda x: list_reduce(list_prepend(x, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t
), runs AS (
  SELECT coalesce(doc_id::VARCHAR, '') AS d, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{00C0}-\x{00FF}]+')) AS run FROM documents
), each AS (SELECT d, run, count(*) AS c FROM runs WHERE length(run) >= 5 GROUP BY ALL),
hashed AS (
  SELECT run, c, xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(range(1, octet_length(encode(d || ':' || run)) + 1), lambda i: ('0x' || substr(hex(encode(d || ':' || run)), 2 * i - 1, 2))::BIGINT)), lambda s, b: xor(s >> 8, t[(xor(s, b) & 255) + 1]))) AS h
  FROM each, crc_table
), v AS (
  SELECT word, sum(c)::BIGINT AS n FROM (SELECT CASE WHEN h % 97 = 0 THEN substr(run, 1, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word, c FROM hashed)
  WHERE length(word) >= 5 GROUP BY word HAVING sum(c) >= 3
), gap AS (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM v)),
near AS (
  SELECT a.word, b.word AS other, b.n FROM gap a JOIN gap b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT g.word, v.word, v.n FROM gap g JOIN v ON g.rest = v.word
  UNION SELECT v.word, g.word, g.n FROM gap g JOIN v ON g.rest = v.word
), best AS (
  SELECT word, count(*) AS n_near, max(n) AS m, min(other) FILTER (n = top) AS other FROM (SELECT *, max(n) OVER (PARTITION BY word) AS top FROM near) GROUP BY word
), f AS (
  SELECT v.word, v.n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN m >= 2 * v.n THEN other END AS form, CASE WHEN m >= 2 * v.n THEN m END AS form_n FROM v LEFT JOIN best USING (word)
), walk AS (
  SELECT word, word AS root FROM f UNION ALL SELECT walk.word, f.form FROM walk JOIN f ON f.word = walk.root WHERE f.form IS NOT NULL
)
SELECT f.word, f.form, walk.root, f.n, f.n_near, f.form_n FROM f JOIN walk USING (word) WHERE walk.root IN (SELECT word FROM f WHERE form IS NULL)
"""


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs.op12(documents(spark, sf_dir))


def op13_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.op13(documents(spark, sf_dir))


QUERIES |= {"op11_spelling_variants": op11_spelling_variants, "op12_periodic_runs": op12_periodic_runs, "op13_token_counts": op13_token_counts}
ORACLE_SQL["op11_spelling_variants"] = OP11_SQL
