"""Query op7: all pages written as WARC bundles and read back."""

from pyspark.sql import DataFrame, SparkSession

from .common import table
from .warc import archive_report

NAME = "op7_warc_bundles"


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive_report(table(spark, sf_dir, "pages"))
