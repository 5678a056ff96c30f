"""Query op4: the mix of all documents."""

from pyspark.sql import DataFrame, SparkSession

from .common import table
from .mixing import mix_report

NAME = "op4_source_mix"


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_report(table(spark, sf_dir, "documents"))
