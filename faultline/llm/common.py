"""Small helpers that the operators of this subpackage share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from faultline.sources.shared import new_path, small_or_not, staged  # noqa: F401

#: The white space of the word contract, [\x20\x09-\x0D].
WS = " \t\n\x0b\f\r"
WS_RE = r"[\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


#: A key with more rows than that is joined by broadcast: of n rows at most n / HOT_ROWS keys are.
HOT_ROWS = 100_000


def join_hot(rows: DataFrame, small: DataFrame, key: str, max_rows: int) -> DataFrame:
    """Inner join of staged rows with small, which has each key once, where one key may hold a third of the rows.

    small is broadcast if a count proves that it has at most max_rows rows; else its keys of over HOT_ROWS rows are, and the rest joins by a shuffle.
    """
    if small.limit(max_rows + 1).count() <= max_rows:
        return rows.join(F.broadcast(small), key)
    hot = staged(rows.groupBy(key).agg(F.count("*").alias("n")).where(F.col("n") > HOT_ROWS).select(key), "hot-keys")
    near = rows.join(F.broadcast(hot), key, "left_semi").join(F.broadcast(small.join(F.broadcast(hot), key, "left_semi")), key)
    return rows.join(F.broadcast(hot), key, "left_anti").join(small, key).unionByName(near)


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def let(value: Column, body) -> Column:
    """body(value), with value computed once for each row, even if body uses it inside other lambdas."""
    return F.transform(F.array(value), body)[0]


def words(text: Column) -> Column:
    """The runs of [^\\x20\\x09-\\x0D] in text; none for null."""
    return let(
        F.btrim(F.coalesce(text, F.lit("")), F.lit(WS)),
        lambda t: F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, WS_RE, -1)),
    )


def ascii_lower(text: Column) -> Column:
    """Only A-Z become lower case."""
    return F.translate(text, UPPER, UPPER.lower())


def unsigned_hex(value: Column) -> Column:
    return F.lower(F.lpad(F.hex(value), 16, "0"))


def apart(small: DataFrame, from_: DataFrame) -> DataFrame:
    """small with column names that from_ doesn't have, in the same order."""
    return small.toDF(*[fresh(from_, f"_{c}") for c in small.columns])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bucket_count(rows: int, per_bucket: int) -> int:
    """Buckets that hold about per_bucket rows each, growing with the input."""
    return max(1, -(-rows // per_bucket))
