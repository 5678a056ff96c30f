"""Query op1: the language of every document."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh, table
from .lang_id import identify, train

NAME = "op1_language_id"


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    docs = docs.select("doc_id", "text", "lang", F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False)).alias("held_out"))
    model = train(docs.where(~F.col("held_out") & F.col("doc_id").isNotNull()))
    return identify(docs, model, ["doc_id", "held_out"])
