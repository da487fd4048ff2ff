"""Queries of the training-data operators over the given tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leadflow.llm import ann, bpe, chat, language, licences, lm, neardup, packing, quality, repair, tiers, warc, whitening
from leadflow.llm.support import QUERIES, SQL, query, table


def all_queries():
    return dict(QUERIES)


def all_sql():
    return dict(SQL)


@query("op10_language_id")
def language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of every document, learned from the rows that are not held out."""
    return language.identify(table(spark, sf_dir, "documents"))


@query("op2_quality_rules")
def quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, robust distance and verdict of every document."""
    return quality.judge(table(spark, sf_dir, "documents")).drop("row_key")


@query("op9_near_duplicates")
def near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class of near duplicates of every document."""
    return neardup.near_duplicates(table(spark, sf_dir, "documents"))


@query("op5_best_fit_packing")
def best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's pieces and their places in sequences of 2048 ids."""
    return packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@query("op1_permutation_index")
def permutation_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest found for every vector whose id is divisible by 20, among all vectors."""
    vectors = ann.usable(table(spark, sf_dir, "embeddings"))
    return ann.search(vectors, vectors.filter("vec_id % 20 = 0"))


CHAT_SQL = """
WITH turns AS (
  SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
marked AS (
  SELECT conv_id, turn, role, text, '<s>' || role || '[INST]' || text || '[/INST]</s>' AS plain,
    len(regexp_extract_all(role || chr(10) || text, '\\\\|<s>|</s>|\\[INST\\]|\\[/INST\\]|<<SYS>>|<</SYS>>|<\\|')) AS escapes FROM turns)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(length(plain) + escapes)::BIGINT AS formatted_chars
FROM marked GROUP BY conv_id
"""


@query("op3_chat_formatting", CHAT_SQL)
def chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation, and one that holds control strings, formatted by turns and read back."""
    said = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    return chat.read_back(chat.format_conversations(turns))


@query("op4_tree_bpe")
def tree_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every whole document, and their bytes, as digests."""
    found = bpe.digests(F.col("text"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return table(spark, sf_dir, "documents").select("doc_id", found.alias("d")).select("doc_id", "d.*")


@query("op6_kneser_ney")
def kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score of every whole document under the model of the documents that are not held out."""
    return lm.score_documents(table(spark, sf_dir, "documents"))


WARC_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, octet_length(encode(html)) AS payload_bytes, sha1(html) AS payload_digest,
  max(page_id) OVER (PARTITION BY html) AS last, count(*) OVER (PARTITION BY html) AS copies FROM p)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 1000 AND page_id <> last THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 1000 AND page_id <> last THEN last END AS refers_to
FROM d
"""


@query("op8_warc_zstd", WARC_SQL)
def warc_zstd(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written as a record and read back from the archives."""
    return warc.round_trip(table(spark, sf_dir, "pages"))


# The documents laid out as a tree of files: a third of them below the source, a third below its language, the others one deeper.
FILES_SQL = """SELECT CASE doc_id % 3 WHEN 0 THEN source || '/' WHEN 1 THEN source || '/' || lang || '/' ELSE source || '/' || lang || '/' || (doc_id % 50) || '/' END
  || doc_id || '.txt' AS path, text FROM documents"""


@query("op7_licence_scan", f"SELECT replace(regexp_extract(path, '[0-9]+[.]txt$'), '.txt', '')::BIGINT AS doc_id, * FROM ({licences.sql_twin(FILES_SQL)})")
def licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence of every document, its own or that of the nearest directory above it."""
    branch = F.expr("CASE doc_id % 3 WHEN 0 THEN concat(source, '/') WHEN 1 THEN concat(source, '/', lang, '/') ELSE concat(source, '/', lang, '/', doc_id % 50, '/') END")
    files = table(spark, sf_dir, "documents").select(F.concat(branch, F.col("doc_id"), F.lit(".txt")).alias("path"), "text")
    return licences.licences(files).select(F.regexp_extract("path", "([0-9]+)[.]txt$", 1).cast("long").alias("doc_id"), "*")


@query("op11_hierarchical_packing")
def hierarchical_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's pieces and their places in sequences of several lengths without padding."""
    return tiers.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


@query("op12_structure_repair")
def structure_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation, damaged by a rule on its ids and repaired by the cheapest edits."""
    turns = table(spark, sf_dir, "conversations")
    return repair.summaries(repair.repaired(repair.damage(turns), turns))


@query("op13_embedding_whitening")
def embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whitened coordinates of every usable vector on the eight strongest components."""
    return whitening.whiten(table(spark, sf_dir, "embeddings"))
