"""Query op2: the verdict of every page's url."""

from pyspark.sql import DataFrame, SparkSession

from .common import table
from .url_filter import url_report

NAME = "op2_url_filter"


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_report(table(spark, sf_dir, "pages"))
