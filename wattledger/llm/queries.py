"""Queries of the subpackage over the driver's tables, and their SQL."""

from __future__ import annotations

import os
from pathlib import Path

from wattledger.llm import (
    bit_codes, chat_format, decontamination, embeddings_dedup, html_extract, jaccard_join, licences, mixing, sharding, spelling, substring_dedup, token_alignment, toxicity)

#: Rows of an Arrow batch: texts may be long, and a batch is what a Python worker holds at once.
ARROW_ROWS = "512"


def table(spark, sf_dir: str, name: str):
    """A table of the driver's. Python workers find this package even if the session was started in another folder."""
    root, env = str(Path(__file__).resolve().parents[2]), spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (root, env.get("PYTHONPATH", "")) if x)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_ROWS)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_embedding_near_dedup(spark, d):
    return embeddings_dedup.link_embeddings(table(spark, d, "embeddings"))


def op2_decontamination(spark, d):
    return decontamination.find_contamination(table(spark, d, "documents"), table(spark, d, "benchmark")).where("contaminated").drop("text_hash")


def op3_chat_format(spark, d):
    turns = table(spark, d, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    extra = spark.sql(f"SELECT CAST(-1 AS BIGINT) AS conv_id, CAST(turn AS BIGINT) AS turn, role, '{said}' AS text FROM VALUES (0, 'user'), (1, 'assistant') AS t(turn, role)")
    return chat_format.digest_chats(turns.union(extra))


def op4_mixing(spark, d):
    return mixing.mix_report(table(spark, d, "documents"))


def op5_html_extraction(spark, d):
    return html_extract.extract_pages(table(spark, d, "pages")).select("page_id", "url", "text", "n_chars")


def op6_sharding(spark, d):
    return sharding.shard_report(table(spark, d, "documents"))


def op7_toxicity(spark, d):
    return toxicity.score_toxicity(table(spark, d, "documents"), table(spark, d, "labels"))


def op8_ngram_jaccard_join(spark, d):
    return jaccard_join.jaccard_join(table(spark, d, "documents")).drop("text_hash")


def op9_substring_dedup(spark, d):
    return substring_dedup.find_repeats(table(spark, d, "documents"))


def op10_licence_scan(spark, d):
    return licences.scan_licences(table(spark, d, "documents"))


def op11_token_alignment(spark, d):
    return token_alignment.alignment_report(table(spark, d, "documents"))


def op12_spelling_variants(spark, d):
    return spelling.spelling_forms(table(spark, d, "documents"))


def op13_nearest_neighbours(spark, d):
    return bit_codes.nearest_neighbours(table(spark, d, "embeddings"))


QUERIES = {f.__name__: f for f in (
    op1_embedding_near_dedup, op2_decontamination, op3_chat_format, op4_mixing, op5_html_extraction, op6_sharding,
    op7_toxicity, op8_ngram_jaccard_join, op9_substring_dedup, op10_licence_scan,
    op11_token_alignment, op12_spelling_variants, op13_nearest_neighbours)}

#: Brute force over the five-word shingles of whole texts.
JACCARD_SQL = """
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
grams AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, least(len(w), 1)) + 1)) AS i FROM words)),
sizes AS (SELECT doc_id, count(*) AS n FROM grams GROUP BY 1),
links AS (
  SELECT a.doc_id AS u, b.doc_id AS v FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id <> b.doc_id
  JOIN sizes s ON s.doc_id = a.doc_id JOIN sizes t ON t.doc_id = b.doc_id
  GROUP BY 1, 2, s.n, t.n HAVING count(*) >= 0.8 * (s.n + t.n - count(*))),
reach AS (SELECT u, v FROM links UNION SELECT r.u, l.v FROM reach r JOIN links l ON r.v = l.u)
SELECT doc_id, coalesce(n, 0) AS shingles, (SELECT count(*) FROM links WHERE u = doc_id) AS n_links,
  least(doc_id, coalesce((SELECT min(v) FROM reach WHERE u = doc_id), doc_id)) AS component_id,
  doc_id <= coalesce((SELECT min(v) FROM reach WHERE u = doc_id), doc_id) AS kept
FROM documents LEFT JOIN sizes USING (doc_id)
"""

#: Contamination as whole items in whole texts, which is what the tables hold.
SQL = {"op3_chat_format": chat_format.ORACLE, "op8_ngram_jaccard_join": JACCARD_SQL, "op10_licence_scan": licences.ORACLE,
       "op12_spelling_variants": spelling.ORACLE, "op13_nearest_neighbours": bit_codes.ORACLE}
