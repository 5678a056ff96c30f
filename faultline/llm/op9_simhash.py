"""Query op9: SimHash near-dedup of all documents."""

from pyspark.sql import DataFrame, SparkSession

from .common import table
from .simhash import near_dup_report

NAME = "op9_simhash"


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup_report(table(spark, sf_dir, "documents"))
