"""Query op8: all documents in 16 shards of near-equal bytes."""

from pyspark.sql import DataFrame, SparkSession

from .common import table
from .sharding import shard_report

NAME = "op8_minimax_shards"


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_report(table(spark, sf_dir, "documents"))
