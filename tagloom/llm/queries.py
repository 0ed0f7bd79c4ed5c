"""Registered queries of the operators in this folder, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagloom.llm.chat_format import format_turns, read_back
from tagloom.llm.decontaminate import contamination
from tagloom.llm.fertility import fertility_rules
from tagloom.llm.html_content import main_text
from tagloom.llm.mixing import mixture
from tagloom.llm.near_dedup import near_duplicates
from tagloom.llm.periodic_runs import periodic_runs, plant_repeats, run_digest
from tagloom.llm.pii import personal_data
from tagloom.llm.quality_knn import quality_scores
from tagloom.llm.recurrent_lm import language_scores
from tagloom.llm.sharding import assign_shards
from tagloom.llm.structure_sql import OP11_SQL, OP12_SQL
from tagloom.llm.tables import table
from tagloom.llm.token_counts import token_counts
from tagloom.llm.turn_repair import damage_turns, repair_digest, repair_turns


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fertility_rules(table(spark, sf_dir, "documents"))


def op4_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(table(spark, sf_dir, "pages"))


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"))


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data(table(spark, sf_dir, "documents"))


CONTROL_TURNS = [(-1, turn, role, "</s>[INST] ok [/INST]") for turn, role in enumerate(("user", "assistant"))]


def op8_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    added = spark.createDataFrame(CONTROL_TURNS, "conv_id long, turn long, role string, text string")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return read_back(format_turns(turns.unionByName(added)))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture(table(spark, sf_dir, "documents"))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign_shards(table(spark, sf_dir, "documents"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    planted = docs.withColumn("text", plant_repeats(F.col("doc_id"), F.col("text")))
    return run_digest(periodic_runs(planted))


def op12_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    return repair_digest(repair_turns(damage_turns(turns)), turns)


def op13_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_scores(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_quality": op1_quality,
    "op2_near_dedup": op2_near_dedup,
    "op3_quality_rules": op3_quality_rules,
    "op4_html": op4_html,
    "op5_decontaminate": op5_decontaminate,
    "op6_token_counts": op6_token_counts,
    "op7_pii": op7_pii,
    "op8_chat_format": op8_chat_format,
    "op9_mixing": op9_mixing,
    "op10_sharding": op10_sharding,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_turn_repair": op12_turn_repair,
    "op13_lm_score": op13_lm_score,
}

OP2_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws
  FROM documents
), shingles AS (
  SELECT DISTINCT doc_id, md5_number(array_to_string(ws[p:p + 4], ' ')) AS g
  FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS p FROM words WHERE len(ws) > 0)
), sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
shared AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common
  FROM shingles a JOIN shingles b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL
), links AS (
  SELECT a, b FROM shared JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b
  WHERE 100 * common >= 75 * (x.n + y.n - common)
), edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (
  SELECT doc_id, doc_id AS seen FROM documents
  UNION SELECT r.doc_id, e.b FROM reach r JOIN edges e ON e.a = r.seen
), least AS (SELECT doc_id, min(seen) AS component_id FROM reach GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, component_id, d.doc_id = component_id AS kept
FROM documents d LEFT JOIN sizes USING (doc_id) JOIN least USING (doc_id)
"""

OP5_SQL = r"""
WITH texts AS (
  SELECT 'd' AS kind, doc_id AS id, text FROM documents
  UNION ALL SELECT 'i', item_id, text FROM benchmark
), words AS (
  SELECT kind, id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws
  FROM texts
), sizes AS (SELECT DISTINCT least(13, len(ws)) AS k FROM words WHERE kind = 'i' AND len(ws) > 0),
item_windows AS (
  SELECT DISTINCT id AS item_id, k, array_to_string(ws[p:p + k - 1], ' ') AS g
  FROM (SELECT id, ws, least(13, len(ws)) AS k, unnest(range(1, len(ws) - least(13, len(ws)) + 2)) AS p
        FROM words WHERE kind = 'i' AND len(ws) > 0)
), doc_windows AS (
  SELECT id AS doc_id, k, p, array_to_string(ws[p:p + k - 1], ' ') AS g
  FROM (SELECT id, ws, k, unnest(range(1, len(ws) - k + 2)) AS p
        FROM words CROSS JOIN sizes WHERE kind = 'd' AND len(ws) >= k)
), found AS (SELECT doc_id, k, p, item_id FROM doc_windows JOIN item_windows USING (k, g)),
hits AS (
  SELECT doc_id, count(DISTINCT pos) AS n_hit
  FROM (SELECT doc_id, unnest(range(p, p + k)) AS pos FROM (SELECT DISTINCT doc_id, k, p FROM found)) GROUP BY doc_id
), items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS listed
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM found) GROUP BY doc_id
)
SELECT id AS doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(listed, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated
FROM words LEFT JOIN hits ON hits.doc_id = id LEFT JOIN items ON items.doc_id = id WHERE kind = 'd'
"""

OP8_SQL = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), sized AS (
  SELECT *, length(role) + length(text) + length(replace(role || text, '\', '\\')) - length(role || text)
    + length(role) - length(replace(role, chr(10), ''))
    + 10 * length(text) - length(replace(text, '<|', '<')) - length(replace(text, '<s', '<'))
    - length(replace(text, '</', '<')) - length(replace(text, '[I', '[')) - length(replace(text, '[/', '['))
    - 5 * length(text) + length('<|turn|>') + 1 + length('<|end|>') + 1 AS chars
  FROM turns
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(chars) AS BIGINT) AS formatted_chars
FROM sized GROUP BY conv_id
"""

ORACLE: dict[str, str] = {
    "op2_near_dedup": OP2_SQL,
    "op5_decontaminate": OP5_SQL,
    "op8_chat_format": OP8_SQL,
    "op11_periodic_runs": OP11_SQL,
    "op12_turn_repair": OP12_SQL,
}
