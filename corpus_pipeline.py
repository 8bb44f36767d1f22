"""A corpus pipeline over ``documents``: quality rules, near-duplicates, benchmark leaks, personal data, token ids.

Every stage takes (spark, docs, sf_dir), works on all that its predecessor kept, and returns a DataFrame that is written as Parquet
and read again for the next one. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tequant.llm import decontam, pieces, pii, quality, simhash
from tequant.llm.common import bounded, cut, table
from tequant.llm.queries import POLICY

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Five-word shingles, 512 bits. Texts whose shingles agree to 0.8 differ in about 78 bits (the angle of a cosine of 8/9), give or take
#: 8; the links within the radius are then held to the exact shingles.
NEAR = {"size": 5, "longs": 8, "radius": 94, "sets": simhash.similar_sets, "lead": 1, "similarity": 0.8}


def keyed(docs: DataFrame) -> DataFrame:
    """With a key that is the same for rows of the same id and text only, and never null."""
    return docs.withColumn("_key", F.xxhash64("doc_id", "text"))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents that fail no rule of the policy; null texts count as empty and go. Repeated rows are judged each for itself."""
    return quality.apply_policy(quality.ledger(docs, carry=COLUMNS), POLICY).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps of each group of near-duplicates the document with the smallest id, null being the largest, and of its rows with equal texts
    one. Texts without words are near-duplicates of each other; different texts under one id are judged each for itself."""
    rows = keyed(docs)
    found = simhash.near_duplicates(rows, key="_key", **NEAR).select(F.col("id").alias("_key"), "component_id").distinct()
    ids = rows.select("_key", "doc_id").groupBy("_key").agg(F.first("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("n"))
    found = cut(found.join(ids, "_key"))
    first = found.groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "_key")).alias("m")).select(F.col("m._key").alias("_key"))
    repeated = bounded(found.where("n > 1").join(first, "_key", "left_semi").select("_key"))
    gone = bounded(found.join(first, "_key", "left_anti").select("_key"))
    once = rows.join(repeated, "_key", "left_semi").dropDuplicates(["_key"])  # only these need a shuffle of texts
    return rows.join(gone, "_key", "left_anti").join(repeated, "_key", "left_anti").unionByName(once).select(*COLUMNS)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that hold a benchmark item, whole or edited, with an id or without; null and empty texts stay."""
    rows = keyed(docs)
    found = bounded(decontam.leaks(rows, table(spark, sf_dir, "benchmark"), key="_key").select(F.col("doc_id").alias("_key")).distinct())
    return rows.join(found, "_key", "left_anti").select(*COLUMNS)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data by the name of its kind; n_chars follows the new text. Null texts stay null; every row is kept."""
    rows = pii.detect(docs, carry=COLUMNS)
    text = F.when(F.col("text").isNotNull(), pii.redacted(F.col("text"), F.col("spans")))
    return rows.select("doc_id", text.alias("text"), "lang", "source", F.when(F.size("spans") > 0, F.length(text).cast("long")).otherwise(F.col("n_chars")).alias("n_chars"))


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, ids): the ids of each text; null and empty texts have none. Every row is kept."""
    return pieces.encode(docs, public_tokenizers.path("piece_bpe_32k.model"))


STAGES = [
    ("quality rules", quality_rules),
    ("SimHash near-dedup", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("PII", personal_data),
    ("SentencePiece encoding", token_ids),
]
ORACLE_SQL = None  # SQL has no SimHash, alignment or merges; tests hold the stages against brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = cut(docs)
    return docs
