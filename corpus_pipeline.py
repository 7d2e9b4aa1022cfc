"""A training corpus from raw documents: quality, exact copies, near copies, repeated passages, packing.

STAGES are (name, function) pairs; a function takes (spark, docs, sf_dir) and returns a DataFrame that
is written and read again as the next one's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankweave.llm import exact_dedup, jaccard_join, packing, quality, suffix_dedup
from rankweave.llm.common import saved
from rankweave.llm.queries import table, vocabulary

#: Shortest repeated passage that goes, in bytes: below that of fifty words.
PASSAGE_BYTES = 200


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts; it learns from the labels that op5 learns from, on all documents given."""
    labels = table(spark, sf_dir, "labels").where(F.crc32(F.col("doc_id").cast("string")) % 5 != 0)
    return quality.score(docs, quality.fit(docs, labels)).where("predicted = 1").select(docs.columns)


def drop_exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of largest id, of equal texts."""
    return exact_dedup.drop_copies(docs)


def drop_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of smallest id, of each group linked by similarity 0.8 or more of five-word shingles."""
    return jaccard_join.drop_near_duplicates(docs)


def cut_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, without the passages that occur elsewhere too; n_chars follows the text."""
    out = suffix_dedup.without_repeats(docs, PASSAGE_BYTES)
    return out.withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast(dict(docs.dtypes)["n_chars"])) if "n_chars" in docs.columns else out


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of at most 1024 tokens."""
    return packing.pack_documents(docs, vocabulary("byte_bpe_50k.json"))


STAGES = [("quality", keep_quality), ("exact dedup", drop_exact), ("near dedup", drop_near), ("passages", cut_passages), ("packing", pack)]

#: The classifier and the tokenizer are beyond SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = saved(docs, name.replace(" ", "-"))
    return docs
