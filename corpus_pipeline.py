"""A corpus pipeline: quality rules, exact dedup, SimHash near-dedup, source mix, packed sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; its result is written as Parquet and read again as the next
one's docs. All but the last keep the columns of documents. A stage's rules for null, empty, long and repeated
rows are those of its operator; empty tables give empty results in each stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from faultline.llm.exact_dedup import dedup_filter
from faultline.llm.mixing import mix_documents
from faultline.llm.near_copies import near_copy_filter
from faultline.llm.packing import pack_documents
from faultline.llm.quality_rules import quality_filter
from faultline.sources.shared import new_path, scratch


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the base rules and the adaptive thresholds keep."""
    return quality_filter(docs)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with equal text (A-Z lower-cased), the one with the largest doc_id."""
    return dedup_filter(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by a Jaccard similarity of 0.8 or more over five-word shingles, the one with the smallest doc_id."""
    return near_copy_filter(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The words of each source that the mix takes: a row for each document and pass."""
    return mix_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token pieces of the mix with their sequence and offset."""
    return pack_documents(docs)


STAGES = [("quality rules", quality), ("exact dedup", exact_dedup), ("simhash near-dedup", near_dedup), ("mixing sources", mix), ("best-fit packing", pack)]

#: The later stages (keyed permutations, fingerprint components, packing) have no SQL form; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents. What a stage stages for itself goes once its result is written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES[:-1]):
        path = new_path(spark, f"stage-{k}")
        with scratch(spark):
            out = stage(spark, docs, sf_dir)
            out.write.parquet(path)
        docs = spark.read.schema(out.schema).parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
