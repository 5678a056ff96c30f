"""End-to-end jobs that compose the operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from faultline.functions.text import best_label
from faultline.operators import stats
from faultline.operators.features import build_features, modified_array
from faultline.sources import versions
from faultline.sources.files import overwrite, read_part_lists, read_parts
from faultline.sources.shared import new_path, staged
from faultline.streaming.incremental import put_late

KEYS = ["project", "bug"]


def merge_parts(spark: SparkSession, pattern: str, dates: DataFrame) -> DataFrame:
    """Features over all parts of the intermediate table; of a change that several parts hold, the last part's rows count.

    Features come after the union: a test's history spans parts. The rows never carry the changes' lists.
    """
    parts = read_parts(spark, pattern)
    last = staged(parts.groupBy(*KEYS).agg(F.max("part").alias("part")), "last-parts")
    one = modified_array(read_part_lists(spark, pattern).join(last, [*KEYS, "part"], "left_semi"))
    return build_features(parts.join(last, [*KEYS, "part"], "left_semi").drop("part"), one.select(*KEYS, "modified_classes"), dates)


def add_missing(path: str, new: DataFrame) -> versions.Version:
    """A dated table with new changes put in (rows of the same changes are replaced), history computed again where it can differ, as the table's next version.

    Readers see the table before or after, never between; the version before stays. A project that the result would lack is an error before the switch.
    """
    return put_late(path, new, on=KEYS)


def consolidate(long: DataFrame, strategies: list[str], folder: str | None = None) -> dict[str, DataFrame]:
    """The tables long, wide (with best and worst), descriptive, best and pairwise of strategies' results, written under folder and read again.

    The results and their pairs are staged once and read by all tables.
    """
    spark = long.sparkSession
    folder = folder or new_path(spark, "consolidated")
    long = staged(long, "long-results")
    paired = staged(stats.pairs(long, strategies), "pairs")
    wide = stats.wide(long, strategies)
    tables = {
        "long": long,
        "wide": stats.best_and_worst(wide, strategies),
        "descriptive": stats.describe_by_scope(long),
        "best": wide.groupBy(best_label(strategies).alias("best")).agg(F.count("*").alias("n")),
        "pairwise": stats.tested(paired),
    }
    for name, table in tables.items():
        overwrite(table, f"{folder}/{name}")
    return {name: spark.read.schema(table.schema).parquet(f"{folder}/{name}") for name, table in tables.items()}
