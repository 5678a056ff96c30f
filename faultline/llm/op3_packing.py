"""Query op3: all documents packed into sequences of at most 1024 tokens."""

from pyspark.sql import DataFrame, SparkSession

from .common import table
from .packing import pack_documents

NAME = "op3_best_fit_packing"


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))
