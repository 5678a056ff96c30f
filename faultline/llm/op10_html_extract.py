"""Query op10: the main text of every page."""

from pyspark.sql import DataFrame, SparkSession

from .common import table
from .html_extract import extract

NAME = "op10_html_extract"


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
