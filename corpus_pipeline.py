"""The corpus pipeline: toxicity filter, line deduplication, near-deduplication, decontamination, packing.

Each stage takes (spark, docs, sf_dir) and works on all that the one before kept; its result is written as Parquet in the
shared folder and read back as the next one's documents. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lamina.llm import decontaminate, linededup, neardup, packing, toxicity
from lamina.llm.bpe import vocabulary_path
from lamina.llm.common import checked, empty, row_key, save

TOXIC_FROM = 0.7


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go; it learns from the labelled rows that op5 learns from."""
    learn = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 != 1
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic"), learn)
    return toxicity.score(docs, model).where(F.col("score") < TOXIC_FROM).select(*docs.columns)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines found in ten or more documents go; n_chars follows the text."""
    kept = linededup.line_dedup(docs, min_docs=10, min_chars=1)
    return kept.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.char_length("text").cast("long")).otherwise(F.col("n_chars"))).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates (five-word shingles, similarity 0.8) stays: the smallest id, and of rows
    that share it the first by text. Rows are told apart by id and text, so rows that share an id but no group all stay.
    Rows without words or without an id are no duplicates of each other."""
    keyed = docs.withColumn("__k", F.when(F.col("doc_id").isNotNull(), row_key(F.col("doc_id"), F.col("text"))[0]))
    found = save(neardup.near_duplicates(keyed, shingle=5, percent=80, id_col="__k").where("n_shingles > 0 and doc_id is not null").select(F.col("doc_id").alias("__k"), "component_id", "kept"), "found")
    groups = save(found.where(~F.col("kept")).select("component_id").distinct(), "groups")
    members = save(found.join(checked(groups), "component_id").select("__k", "component_id").distinct(), "members")
    chosen = keyed.join(checked(members), "__k").groupBy("component_id").agg(F.min(F.struct("doc_id", "text", "__k"))["__k"].alias("__k"))
    gone = save(members.join(chosen.select("__k"), "__k", "left_anti").select("__k"), "gone")
    left = keyed.join(checked(gone), "__k", "left_anti")
    again = save(found.groupBy("__k").agg(F.count("*").alias("n")).where("n > 1").select("__k"), "again")
    if empty(again):
        return left.select(*docs.columns)
    first = left.join(checked(again), "__k").groupBy("__k").agg(F.min(F.struct("text", "doc_id", *[c for c in docs.columns if c not in ("doc_id", "text")])).alias("r"))
    return left.join(checked(again), "__k", "left_anti").select(*docs.columns).unionByName(first.select("r.*"))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that overlap with a benchmark item go."""
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left, packed into sequences of at most 1024 tokens."""
    return packing.best_fit_packing(docs, vocabulary_path("byte_bpe_50k.json"), capacity=1024, end_id=2)


STAGES = [("toxicity", drop_toxic), ("line_dedup", drop_lines), ("near_dedup", drop_near_duplicates), ("decontamination", drop_contaminated), ("packing", pack)]

#: The classifier and the packing can't be said in SQL; tests hold every stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = save(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
