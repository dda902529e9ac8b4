"""The corpus pipeline: toxicity, line dedup, near duplicates, decontamination, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet and read
again as the next one's docs. All but the last return the columns of `documents`, of all the
rows that they keep.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm import bpe, decontam, line_dedup, ngram_join, toxicity
from siltstone.scratch import written
from siltstone.tables import table

#: Documents that score this much or more are rejected.
TOXIC_FROM = 0.3


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model rejects go; it is fitted on the labels of the input's folder."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.scored(docs, model).where(F.col("score") < TOXIC_FROM).select(docs.columns)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Duplicate lines go, and with them the documents of which no line is left."""
    out = line_dedup.line_deduplicated(docs)
    return out.where("n_removed = 0 OR length(trim(text)) > 0").select(docs.columns)


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates one document stays: that of the smallest id (null first), then text
    hash. Rows equal in id and text are one document. Without a set of n-grams, rows with null ids all stay."""
    groups = ngram_join.components(docs).withColumn("id", F.coalesce("doc_id", F.lit(ngram_join.NO_ID)))
    # Components of unlike texts may share their smallest id, so they go by group_id.
    kept = groups.where("n_shingles > 0").groupBy("group_id").agg(F.min(F.struct("id", "body")).alias("k")).select("k.*")
    kept = kept.unionByName(groups.where("n_shingles = 0").select("id", "body")).distinct().select(F.col("id").alias("kept_id"), F.col("body").alias("kept_body"))
    key, body = F.coalesce(F.col("doc_id").cast("long"), F.lit(ngram_join.NO_ID)), F.xxhash64("text")
    left = docs.withColumn("row_id", key).withColumn("row_body", body)
    left = left.join(kept, (F.col("row_id") == F.col("kept_id")) & (F.col("row_body") == F.col("kept_body")), "left_semi")
    blank = F.col("doc_id").isNull() & (F.coalesce(F.length(F.trim("text")), F.lit(0)) == 0)
    first = left.where(~blank).dropDuplicates(["row_id", "row_body"])
    return first.unionByName(left.where(blank)).select(docs.columns)


def drop_leaked(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of a benchmark item go."""
    return decontam.decontaminated(docs, table(spark, sf_dir, "benchmark")).select(docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids and the decoded text of every document."""
    path = public_tokenizers.path("byte_bpe_50k.json")
    return bpe.decode(bpe.encode(docs, path), path)


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_repeated_lines),
    ("n-gram jaccard join", keep_one_of_near_copies),
    ("benchmark decontamination", drop_leaked),
    ("bpe", tokens),
]

#: SQL expresses neither the model nor the tokenizer; tests/llm/test_pipeline.py has brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each one's result written and read again."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, f"pipeline-{k}")
    return docs
