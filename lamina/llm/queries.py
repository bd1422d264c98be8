"""The registered queries of this subpackage, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lamina.llm import decontaminate, editcount, linededup, lm, neardup, packing, passages, repair, topk, toxicity
from lamina.llm.bpe import vocabulary_path


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2
    return lm.lm_scores(table(spark, sf_dir, "documents"), held_out, order=3, strength=30.0)


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = linededup.line_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"), min_docs=10, min_chars=1)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.train(docs, table(spark, sf_dir, "labels").select("doc_id", "toxic"), ~held_out)
    scored = toxicity.score(docs, model)
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.best_fit_packing(table(spark, sf_dir, "documents"), vocabulary_path("byte_bpe_50k.json"), capacity=1024, end_id=2)


def op4_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return topk.top_k(vectors, vectors.where(F.col("vec_id") % 50 == 0), k=5, scale=256.0)


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts before and after masking mail addresses and runs of five or more digits."""
    secrets = r"[A-Za-z0-9._-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+|[0-9]{5,}"
    return editcount.edited_counts(table(spark, sf_dir, "documents"), vocabulary_path("byte_bpe_50k.json"), redact=(secrets, "[masked]"))


def op8_repair_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    shards = repair.write_shards(table(spark, sf_dir, "documents"), vocabulary_path("word_bpe_49k.json"), vocabulary=49_408, end_id=1)
    return repair.read_documents(shards)


def op10_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"), shingle=2, percent=80)


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.repeated_passages(table(spark, sf_dir, "documents"), min_words=50, percent=80)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_lm_scoring": op1_lm_scoring,
    "op2_decontamination": op2_decontamination,
    "op3_line_dedup": op3_line_dedup,
    "op4_exact_top_k": op4_exact_top_k,
    "op5_toxicity": op5_toxicity,
    "op6_best_fit_packing": op6_best_fit_packing,
    "op7_token_counts": op7_token_counts,
    "op8_repair_binary": op8_repair_binary,
    "op9_substring_dedup": op9_substring_dedup,
    "op10_minhash_near_dedup": op10_minhash_near_dedup,
}

LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

SQL: dict[str, str] = {
    # Ten equal words of twelve have four equal ones in a row, so aligning on runs of four finds every pair of windows; all
    # windows of an alignment are then compared in full.
    "op2_decontamination": r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[^\pL\pN]+'), lambda x: x <> '') AS w FROM documents),
b AS (
  SELECT row_number() OVER () AS s, item_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[^\pL\pN]+'), lambda x: x <> '') AS w
  FROM benchmark WHERE item_id IS NOT NULL),
dg AS (SELECT r, p, array_to_string(w[p : p + 3], ' ') AS g FROM (SELECT r, w, unnest(range(1, len(w) - 2)) AS p FROM d)),
bg AS (SELECT s, q, array_to_string(w[q : q + 3], ' ') AS g FROM (SELECT s, w, unnest(range(1, len(w) - 2)) AS q FROM b)),
aligned AS (SELECT DISTINCT r, s, p - q AS shift FROM dg JOIN bg USING (g)),
sized AS (
  SELECT r, s, shift, doc_id, item_id, d.w AS dw, b.w AS bw, CASE WHEN len(b.w) >= 12 THEN 12 ELSE len(b.w) END AS size
  FROM aligned JOIN d USING (r) JOIN b USING (s) WHERE len(b.w) >= 8),
windows AS (SELECT *, unnest(range(greatest(1, 1 + shift), least(len(dw), len(bw) + shift) - size + 2)) AS p FROM sized),
same AS (SELECT doc_id, item_id, shift, p, size, len(list_filter(range(0, size), lambda i: dw[p + i] = bw[p - shift + i])) AS equal_words FROM windows),
stretches AS (
  SELECT doc_id, item_id, max(p + size) - min(p) AS stretch, max(equal_words) AS equal_words
  FROM same WHERE equal_words >= CASE WHEN size = 12 THEN 10 ELSE size END GROUP BY doc_id, item_id, shift)
SELECT doc_id, count(DISTINCT item_id) AS n_items, min(item_id) AS first_item, max(equal_words)::INT AS best_words, max(stretch)::INT AS overlap_words
FROM stretches GROUP BY doc_id""",
    "op3_line_dedup": r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents),
keyed AS (
  SELECT *, trim(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS k
  FROM lines),
frequent AS (SELECT k FROM keyed WHERE length(k) >= 1 GROUP BY k HAVING count(DISTINCT doc_id) >= 10)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (k IN (FROM frequent)) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (k NOT IN (FROM frequent)), '')) AS kept_sha256
FROM keyed GROUP BY doc_id""",
    "op4_exact_top_k": """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id AND len(q.e) = len(c.e)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5""",
}
