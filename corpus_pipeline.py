"""The corpus pipeline: stages over ``documents``, each written as Parquet and read by the next.

A stage takes (spark, docs, sf_dir) and returns a DataFrame: all but the last the columns
of documents, the last the token ids as well. Each works on all that its predecessor kept; of an
empty table it keeps nothing, and further columns of documents are left out. A stage begins with
executors that hold no garbage of the one before: their heaps and the Python workers share one limit.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm.common import drop, executors_tidy, settings_kept, small_batches, split_by, store

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects (score under 0.3) go."""
    from tessella.llm.quality_rff import keep, train

    executors_tidy(spark)
    small_batches(spark)
    return keep(docs.select(*COLUMNS), train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def _once(docs: DataFrame) -> DataFrame:
    """``docs`` with one of the rows that share doc_id and text; only rows of repeated doc_ids are moved."""
    again = docs.where("doc_id IS NOT NULL").groupBy("doc_id", F.xxhash64("text").alias("th")).count().where("count > 1")
    again = store(again.select("doc_id", "th"), "again")
    some, others = split_by(docs.withColumn("_th", F.xxhash64("text")), again, "doc_id", "_th")
    # a null doc_id is never among the keys, but its row may pass their filter
    return some.where("doc_id IS NOT NULL").dropDuplicates(["doc_id", "text"]).unionByName(others).unionByName(some.where("doc_id IS NULL")).select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates, the document of the least doc_id stays: groups by links of fingerprints, and of 5-word shingles that are 0.8 alike. Of rows that share doc_id and text one stays; rows of one doc_id and different texts are one document. Rows without a doc_id stay."""
    from tessella.llm.common import components
    from tessella.llm.simhash_anchors import near_duplicates, similar_links

    executors_tidy(spark)
    small_batches(spark)
    docs = _once(docs.select(*COLUMNS))
    links = near_duplicates(docs).where("doc_id <> component_id").select(F.col("doc_id").alias("a"), F.col("component_id").alias("b"))
    executors_tidy(spark)
    links = links.unionByName(similar_links(docs))
    executors_tidy(spark)
    found = components(links)
    gone = store(found.where("node <> root").select(F.col("node").alias("doc_id"), F.lit(0).alias("th")).distinct(), "gone")
    own = docs.select(*COLUMNS).withColumn("_z", F.lit(0))
    some, others = split_by(own, gone, "doc_id", "_z")
    return some.join(gone.select("doc_id"), "doc_id", "left_anti").select(*COLUMNS).unionByName(others.select(*COLUMNS))


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words in windows of 50 that a document of a smaller doc_id holds as well are cut; a text that loses nothing stays as it is, one that loses all its words goes."""
    from tessella.llm.substring_dedup import dedup_substrings

    executors_tidy(spark)
    small_batches(spark)
    out = dedup_substrings(docs.select(*COLUMNS)).where("n_removed = 0 OR n_removed < n_words")
    text = F.when(F.col("n_removed") == 0, F.col("text")).otherwise(F.col("kept_text"))
    return out.withColumn("text", text).withColumn("n_chars", F.when(F.col("n_removed") == 0, F.col("n_chars")).otherwise(F.length("text").cast("long"))).select(*COLUMNS)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a twentieth of their words or more inside passages of the benchmark go."""
    from tessella.llm.positional_index import contamination

    executors_tidy(spark)
    small_batches(spark)
    found = contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    gone = store(found.where("contaminated").select("doc_id", F.col("text_hash").alias("th")).distinct(), "contaminated")
    th = F.xxhash64("text")
    return docs.select(*COLUMNS).join(gone, docs["doc_id"].eqNullSafe(gone["doc_id"]) & (th == gone["th"]), "left_anti").select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their token ids, as little-endian unsigned 32-bit integers, and the number of them."""
    import public_tokenizers

    from tessella.llm.bpe import encode as bpe

    executors_tidy(spark)
    small_batches(spark)
    out = bpe(docs.select(*COLUMNS), public_tokenizers.path("word_bpe_49k.json"), decode=False)
    return out.withColumn("n_tokens", F.expr("CAST(octet_length(token_ids) / 4 AS BIGINT)"))


STAGES = [("quality", quality), ("near_dedup", near_dedup), ("substring_dedup", substring_dedup), ("decontaminate", decontaminate), ("encode", encode)]

#: Fingerprints, random features and tokens have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each result written to the shared folder and read again; it goes when the next one stands. The session keeps its settings."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    with settings_kept(spark):
        for name, stage in STAGES:
            before, docs = docs, store(stage(spark, docs, sf_dir), name)
            drop(before)
    return docs
