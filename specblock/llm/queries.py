"""One query for each operator over its whole table, with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from specblock.llm import chat_formatting, decontamination, language_id, line_dedup, mixing, nearest, ngram_lm, simhash, substring_dedup, token_counts
from specblock.llm.common import id_bucket, read_table

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def query(function):
    QUERIES[function.__name__] = function
    return function


@query
def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    bucket = id_bucket("doc_id", 3)
    profiles = language_id.fit_profiles(docs.where(bucket != 1))
    return language_id.detect(docs, profiles, ["doc_id", (bucket == 1).alias("held_out")])


@query
def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return token_counts.token_counts(docs, public_tokenizers.path("piece_bpe_32k.model"), limit=4096)


@query
def op6_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(read_table(spark, sf_dir, "documents"), shingle=3, radius=3)


@query
def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = substring_dedup.dedup_substrings(read_table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


@query
def op2_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read_table(spark, sf_dir, "documents")).drop("source")


@query
def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup.dedup_lines(read_table(spark, sf_dir, "documents"), min_sites=line_dedup.MIN_SITES)
    return kept.select("doc_id", "n_lines", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


ORACLE_SQL["op9_line_dedup"] = f"""
WITH lines AS (
  SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos
  FROM documents),
spread AS (
  SELECT trim(line) AS t FROM lines WHERE trim(line) <> ''
  GROUP BY 1 HAVING count(DISTINCT source) >= {line_dedup.MIN_SITES}),
kept AS (
  SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE t IS NOT NULL) AS n_removed,
         coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE t IS NULL), '') AS body
  FROM lines LEFT JOIN spread ON trim(line) = t GROUP BY doc_id)
SELECT doc_id, n_lines, n_removed, sha256(body) AS kept_sha256 FROM kept
"""


@query
def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, items = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark")
    found = decontamination.contamination(docs, items)
    ids = F.sha2(F.array_join("item_ids", ","), 256)
    return found.select("doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"), ids.alias("items_sha256"), "contaminated")


@query
def op7_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest.nearest(read_table(spark, sf_dir, "embeddings"), F.col("id") % 100 == 0)


@query
def op8_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_formatting.format_chats(read_table(spark, sf_dir, "conversations"))


ORACLE_SQL["op8_chat_formatting"] = f"""
WITH turns AS (
  SELECT conv_id, role, text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS place,
         count(*) OVER (PARTITION BY conv_id) AS n
  FROM conversations),
prefixes AS (
  SELECT conv_id, place, n,
         string_agg(coalesce(length(role) || ':' || role, '-') || coalesce(length(text) || ':' || text, '-'), '')
           OVER (PARTITION BY conv_id ORDER BY place) AS prefix
  FROM turns),
maximal AS (
  SELECT min(conv_id) AS conv_id FROM prefixes e
  WHERE place = n AND NOT EXISTS (SELECT 1 FROM prefixes p WHERE p.place = e.place AND p.prefix = e.prefix AND p.n > e.n)
  GROUP BY prefix)
SELECT t.conv_id, (t.place - 1) // {chat_formatting.CHUNK_TURNS} AS chunk, max(t.n) AS n_turns,
       string_agg('{chat_formatting.START}' || replace(coalesce(role, ''), '<|', '< |') || chr(10)
                  || replace(coalesce(text, ''), '<|', '< |') || '{chat_formatting.END}' || chr(10), '' ORDER BY place) AS rendered
FROM turns t JOIN maximal m ON t.conv_id = m.conv_id GROUP BY 1, 2
"""


@query
def op5_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    bucket = id_bucket("doc_id", 5)
    model = ngram_lm.train_model(docs.where(bucket != 1))
    return ngram_lm.score(docs, model, ["doc_id", (bucket == 1).alias("held_out")])


ORACLE_SQL["op1_decontamination"] = r"""
WITH words AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') AS w
  FROM documents),
items AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') AS w
  FROM benchmark WHERE text IS NOT NULL),
windows AS (
  SELECT DISTINCT item_id, list_slice(w, s, s + 9) AS g FROM items, unnest(range(1, greatest(1, len(w) - 9) + 1)) u(s) WHERE len(w) > 0),
lengths AS (SELECT DISTINCT len(g) AS n FROM windows),
runs AS (SELECT r, s, n, list_slice(w, s, s + n - 1) AS g FROM words, lengths, unnest(range(1, len(w) - n + 2)) u(s)),
hits AS (SELECT r, s, n, item_id FROM runs JOIN windows USING (g)),
covered AS (SELECT r, count(DISTINCT p) AS n_hit FROM hits, unnest(range(s, s + n)) u(p) GROUP BY r),
found AS (SELECT r, list_sort(list(DISTINCT item_id::VARCHAR)) AS ids FROM hits GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(len(ids), 0)::BIGINT AS n_items,
       sha256(coalesce(array_to_string(ids, ','), '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM words LEFT JOIN covered USING (r) LEFT JOIN found USING (r)
"""
ORACLE_SQL["op4_substring_dedup"] = r"""
WITH words AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
windows AS (SELECT r, s, list_slice(w, s, s + 34) AS g FROM words, unnest(range(1, len(w) - 33)) u(s)),
repeated AS (SELECT g FROM windows GROUP BY g HAVING count(*) > 1),
gone AS (SELECT DISTINCT r, p FROM windows SEMI JOIN repeated USING (g), unnest(range(s, s + 35)) u(p)),
kept AS (
  SELECT r, count(*) AS n, string_agg(word, ' ' ORDER BY p) AS body
  FROM (SELECT r, unnest(w) AS word, generate_subscripts(w, 1) AS p FROM words) ANTI JOIN gone USING (r, p) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(body, '')) AS kept_sha256
FROM words LEFT JOIN kept USING (r)
"""
