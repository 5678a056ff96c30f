"""Chronological train/test split of changes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

KEYS = ["project", "bug"]


def tail_split(features: DataFrame, dates: DataFrame, fraction: float = 0.3) -> DataFrame:
    """project, bug, fixed_commit_date, has_trigger, side.

    Of a project's k changes with a trigger the newest round_half_even(fraction * k) are test; all the others, and those without a trigger, are train.
    """
    labels = features.groupBy(*KEYS).agg((F.max("label") == 1).alias("has_trigger"))
    dated = labels.join(dates.select(*KEYS, "fixed_commit_date"), KEYS)
    own = Window.partitionBy("project", "has_trigger")
    newest = F.row_number().over(own.orderBy(F.desc("fixed_commit_date"), F.desc("bug")))
    size = F.bround(F.count("*").over(own) * F.lit(fraction), 0)
    return dated.withColumn("side", F.when(F.col("has_trigger") & (newest <= size), F.lit("test")).otherwise(F.lit("train")))


def on_side(df: DataFrame, split: DataFrame, side: str) -> DataFrame:
    """The rows of df whose change is on a side."""
    return df.join(split.where(F.col("side") == side).select(*KEYS), KEYS, "left_semi")


def split_summary(split: DataFrame) -> DataFrame:
    """project (null: all), total, no_trigger, train, test."""
    return split.rollup("project").agg(
        F.count("*").alias("total"), F.count_if(~F.col("has_trigger")).alias("no_trigger"), F.count_if(F.col("side") == "train").alias("train"), F.count_if(F.col("side") == "test").alias("test")
    )


def chronology(dates: DataFrame) -> DataFrame:
    """project, oldest, newest, direction: whether ids rise or fall with time."""
    at = F.struct("fixed_commit_date", "bug")
    ends = dates.groupBy("project").agg(F.min_by("bug", at).alias("oldest"), F.max_by("bug", at).alias("newest"))
    return ends.withColumn("direction", F.when(F.col("newest") > F.col("oldest"), "rising").when(F.col("newest") < F.col("oldest"), "falling").otherwise("single"))
