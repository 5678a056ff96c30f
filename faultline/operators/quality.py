"""Data-quality jobs over the feature table. Each gives rows of (check, scope, observed, expected, ok)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from faultline.schema import FEATURES, TEST_KEYS

from .features import history

KEYS = ["project", "bug"]


def _row(check: str, scope: Column | str, observed: Column, expected: Column, ok: Column) -> list[Column]:
    scope = F.lit(scope) if isinstance(scope, str) else scope
    return [F.lit(check).alias("check"), scope.alias("scope"), observed.cast("long").alias("observed"), expected.cast("long").alias("expected"), ok.alias("ok")]


def columns(df: DataFrame, required: list[str] | None = None) -> DataFrame:
    """Missing and extra columns; metadata only, no job."""
    required = required or FEATURES.names
    missing, extra = [c for c in required if c not in df.columns], [c for c in df.columns if c not in required]
    rows = [("missing_columns", ",".join(missing), len(missing), 0, not missing), ("extra_columns", ",".join(extra), len(extra), 0, not extra)]
    return df.sparkSession.createDataFrame(rows, "check string, scope string, observed long, expected long, ok boolean")


def nulls(df: DataFrame) -> DataFrame:
    counts = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns])
    tall = counts.select(F.inline(F.array(*[F.struct(F.lit(c).alias("c"), F.col(c).alias("n")) for c in df.columns])))
    return tall.select(*_row("nulls", F.col("c"), F.col("n"), F.lit(0), F.col("n") == 0))


def duplicate_keys(df: DataFrame, keys: list[str] = TEST_KEYS) -> DataFrame:
    extra = df.groupBy(*keys).agg(F.count("*").alias("n")).agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("extra"))
    return extra.select(*_row("duplicate_keys", ",".join(keys), F.col("extra"), F.lit(0), F.col("extra") == 0))


def duplicate_members(df: DataFrame, keys: list[str] = TEST_KEYS, examples: int = 10) -> DataFrame:
    """The first keys that occur more than once, and how often."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1").orderBy(*keys).limit(examples)


def domains(df: DataFrame) -> DataFrame:
    rules = {"same_package": ~F.col("same_package").isin(0, 1), "label": ~F.col("label").isin(0, 1), "history": F.col("history") < 0, "modified_classes_count": F.col("modified_classes_count") < 0}
    counts = df.agg(*[F.count_if(v).alias(k) for k, v in rules.items()])
    tall = counts.select(F.inline(F.array(*[F.struct(F.lit(k).alias("c"), F.col(k).alias("n")) for k in rules])))
    return tall.select(*_row("domain", F.col("c"), F.col("n"), F.lit(0), F.col("n") == 0))


def classes_present(df: DataFrame) -> DataFrame:
    n = F.count_distinct("label")
    return df.agg(n.alias("n")).select(*_row("classes_present", "label", F.col("n"), F.lit(2), F.col("n") == 2))


def without_trigger(df: DataFrame) -> DataFrame:
    """For each project the changes that have no positive."""
    each = df.groupBy(*KEYS).agg(F.max("label").alias("y"))
    return each.groupBy("project").agg(F.count_if(F.col("y") == 0).alias("n")).select(*_row("without_trigger", F.col("project"), F.col("n"), F.lit(0), F.col("n") == 0))


def projects(df: DataFrame, expected: DataFrame) -> DataFrame:
    """Expected projects and found ones, side by side."""
    found = df.select("project").distinct().withColumn("found", F.lit(1))
    both = expected.select("project").withColumn("want", F.lit(1)).join(found, "project", "full")
    a, b = F.coalesce("found", F.lit(0)), F.coalesce("want", F.lit(0))
    return both.select(*_row("projects", F.col("project"), a, b, a == b))


def expected_changes(df: DataFrame, expected: DataFrame, report: DataFrame) -> DataFrame:
    """project, expected, found, absent, justified, ok: changes that are absent must be failed attempts of the report."""
    found = df.select(*KEYS).distinct().groupBy("project").agg(F.count("*").alias("found"))
    failed = report.where("status <> 'ok'").select(*KEYS).distinct().groupBy("project").agg(F.count("*").alias("justified"))
    full = expected.join(found, "project", "left").join(failed, "project", "left").na.fill(0, ["found", "justified"])
    absent = F.col("n") - F.col("found")
    return full.select("project", F.col("n").alias("expected"), "found", absent.alias("absent"), "justified", (absent == F.col("justified")).alias("ok"))


def history_consistency(df: DataFrame, dates: DataFrame) -> DataFrame:
    """How many stored history values differ from those computed again."""
    again = history(df.withColumnRenamed("history", "stored").join(dates, KEYS), "label")
    n = again.agg(F.count_if(F.col("stored") != F.col("history")).alias("n"))
    return n.select(*_row("history_consistency", "all", F.col("n"), F.lit(0), F.col("n") == 0))


def history_plausibility(df: DataFrame) -> DataFrame:
    """project, positives, first_detections, percent_first, negatives_with_history, max_history, plausible (some positive had a history; the largest is below the positives)."""
    p, h = F.col("label") == 1, F.col("history")
    out = df.groupBy("project").agg(F.count_if(p).alias("positives"), F.count_if(p & (h == 0)).alias("first_detections"), F.count_if(~p & (h > 0)).alias("negatives_with_history"), F.max("history").alias("max_history"))
    share = F.bround(100 * F.try_divide("first_detections", "positives"), 4)
    return out.select("project", "positives", "first_detections", share.alias("percent_first"), "negatives_with_history", "max_history", ((F.col("first_detections") < F.col("positives")) & (F.col("max_history") <= F.col("positives"))).alias("plausible"))


def detection_sequence(df: DataFrame, dates: DataFrame) -> DataFrame:
    """How many positives break the rule that a test's k-th detection, in date order, has history k - 1."""
    order = Window.partitionBy("project", "test_class", "test_method").orderBy("fixed_commit_date", "bug")
    k = df.where("label = 1").join(dates, KEYS).withColumn("k", F.row_number().over(order) - 1).agg(F.count_if(F.col("k") != F.col("history")).alias("n"))
    return k.select(*_row("detection_sequence", "all", F.col("n"), F.lit(0), F.col("n") == 0))


def all_checks(df: DataFrame, dates: DataFrame) -> DataFrame:
    parts = [columns(df), nulls(df), duplicate_keys(df), domains(df), classes_present(df), without_trigger(df), history_consistency(df, dates), detection_sequence(df, dates)]
    return reduce(DataFrame.unionByName, parts)


def change_counts(df: DataFrame, expected: DataFrame | None = None) -> DataFrame:
    """project (null: all), changes, instances, triggers, no_trigger (and expected), from one aggregation by change."""
    each = df.groupBy(*KEYS).agg(F.count("*").alias("rows"), F.sum("label").alias("positives"))
    out = each.rollup("project").agg(F.count("*").alias("changes"), F.sum("rows").alias("instances"), F.sum("positives").cast("long").alias("triggers"), F.count_if(F.col("positives") == 0).alias("no_trigger"))
    if expected is not None:
        total = expected.rollup("project").agg(F.sum("n").alias("expected"))
        out = out.alias("o").join(total.alias("e"), F.col("o.project").eqNullSafe(F.col("e.project")), "left").select("o.*", "e.expected")
    return out


def distinct_counts(df: DataFrame) -> DataFrame:
    """projects, changes (pairs: ids repeat across projects), test_classes, tests."""
    return df.agg(F.count_distinct("project").alias("projects"), F.count_distinct(F.struct("project", "bug")).alias("changes"), F.count_distinct("test_class").alias("test_classes"), F.count_distinct(F.struct("test_class", "test_method")).alias("tests"))


