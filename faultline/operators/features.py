"""Features of each (change, test): chronological history, package affinity and change size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from faultline.functions.text import package_of, semicolon_list


def with_dates(df: DataFrame, dates: DataFrame, also: tuple[str, ...] = ()) -> DataFrame:
    """df with fixed_commit_date (and other columns of dates); a change without a date is an error when its row is reached."""
    joined = df.join(dates.select("project", "bug", "fixed_commit_date", *also), ["project", "bug"], "left")
    missing = F.raise_error(F.concat(F.lit("no commit date for "), F.col("project"), F.lit("-"), F.col("bug").cast("string"))).cast("long")
    return joined.withColumn("fixed_commit_date", F.coalesce("fixed_commit_date", missing))


def undated(df: DataFrame, dates: DataFrame) -> DataFrame:
    """The changes of df that have no date: the report that goes with the error."""
    return df.select("project", "bug").distinct().join(dates, ["project", "bug"], "left_anti")


def chronological_rank(dates: DataFrame) -> DataFrame:
    """project, bug, position: from 0 in each project by date, then id."""
    order = Window.partitionBy("project").orderBy("fixed_commit_date", "bug")
    return dates.select("project", "bug", "fixed_commit_date").distinct().withColumn("position", F.row_number().over(order) - 1)


def history(tests: DataFrame, label: str = "is_trigger") -> DataFrame:
    """tests with history: the test's detections in strictly earlier rows by date, then id. The window's key is a test, never a project."""
    earlier = Window.partitionBy("project", "test_class", "test_method").orderBy("fixed_commit_date", "bug").rowsBetween(Window.unboundedPreceding, -1)
    return tests.withColumn("history", F.coalesce(F.sum(F.col(label).cast("long")).over(earlier), F.lit(0)).cast("long"))


def same_package(tests: DataFrame, changes: DataFrame, n: list[int] | None = None) -> DataFrame:
    """tests with same_package: a join with the distinct packages of each change's modified classes; both sides dealt to n partitions, if given."""
    packages = changes.select("project", "bug", F.explode("modified_classes").alias("c")).select("project", "bug", package_of(F.col("c")).alias("package")).distinct()
    keys = ["project", "bug", "package"]
    tests = tests.withColumn("package", package_of(F.col("test_class")))
    if n:
        tests, packages = tests.repartition(*n, *keys), packages.repartition(*n, *keys)
    joined = tests.join(packages.withColumn("same", F.lit(1)), keys, "left")
    return joined.withColumn("same_package", F.coalesce("same", F.lit(0))).drop("same", "package")


def modified_array(df: DataFrame) -> DataFrame:
    """A ;-joined modified_classes column as an array, for text sources."""
    return df.withColumn("modified_classes", semicolon_list(F.col("modified_classes")))


def build_features(tests: DataFrame, changes: DataFrame, dates: DataFrame) -> DataFrame:
    """The feature table of tests (is_trigger), changes (modified_classes) and dates.

    Dates and sizes are joined to each other first, a row for each change, so that the tests meet the changes in one join.
    """
    sizes = changes.select("project", "bug", F.coalesce(F.size("modified_classes"), F.lit(0)).alias("modified_classes_count"))
    by_change = dates.select("project", "bug", "fixed_commit_date").join(sizes, ["project", "bug"], "left").na.fill(0, ["modified_classes_count"])
    return final_projection(same_package(history(with_dates(tests, by_change, ("modified_classes_count",))), changes))


def final_projection(df: DataFrame) -> DataFrame:
    return df.select("project", "bug", "test_class", "test_method", "history", "same_package", "modified_classes_count", F.col("is_trigger").alias("label"))
