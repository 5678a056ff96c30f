"""Labels from change metadata: which enumerated tests are the triggers of a change."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from faultline.functions.text import newline_list, signature_class, signature_method

KEYS = ["project", "bug"]
#: Property names and the metadata column each gives. Fixed values.
PROPERTIES = {"tests.trigger": "trigger_tests", "tests.relevant": "relevant_test_classes", "classes.modified": "modified_classes"}


def metadata(properties: DataFrame) -> DataFrame:
    """(project, bug, property, content) as project, bug and one list for each property; the two test lists without repeats."""
    lists = properties.select(*KEYS, "property", newline_list(F.col("content")).alias("items"))
    out = lists.groupBy(*KEYS).agg(*[F.coalesce(F.max(F.when(F.col("property") == p, F.col("items"))), F.array().cast("array<string>")).alias(c) for p, c in PROPERTIES.items()])
    return out.select(*KEYS, F.array_distinct("trigger_tests").alias("trigger_tests"), F.array_distinct("relevant_test_classes").alias("relevant_test_classes"), "modified_classes")


def signatures(meta: DataFrame) -> DataFrame:
    """project, bug, signature, test_class, test_method of each trigger; class and method are null where the signature is invalid."""
    each = meta.select(*KEYS, F.explode("trigger_tests").alias("signature"))
    return each.withColumn("test_class", signature_class(F.col("signature"))).withColumn("test_method", signature_method(F.col("signature")))


def rejected(signed: DataFrame) -> DataFrame:
    return signed.where("test_class is null or test_method is null").select(*KEYS, "signature")


def triggers(meta: DataFrame) -> DataFrame:
    return signatures(meta).where("test_class is not null and test_method is not null").select(*KEYS, "test_class", "test_method").distinct()


def label(meta: DataFrame, enumerated: DataFrame) -> DataFrame:
    """The intermediate table: each enumerated test of a change that has metadata, with is_trigger and the change's modified classes."""
    found = enumerated.select(*KEYS, "test_class", "test_method").distinct()
    marked = found.join(triggers(meta).withColumn("hit", F.lit(1)), [*KEYS, "test_class", "test_method"], "left")
    sizes = meta.select(*KEYS, "modified_classes", F.size("modified_classes").alias("modified_classes_count"))
    return marked.join(sizes, KEYS).select(*KEYS, "test_class", "test_method", F.coalesce("hit", F.lit(0)).alias("is_trigger"), "modified_classes", "modified_classes_count")


def missed(meta: DataFrame, enumerated: DataFrame) -> DataFrame:
    """project, bug, n_missed and the first five missed triggers of each change: expected but not enumerated."""
    gone = triggers(meta).join(enumerated.select(*KEYS, "test_class", "test_method").distinct(), [*KEYS, "test_class", "test_method"], "left_anti")
    named = gone.select(*KEYS, F.concat_ws("::", "test_class", "test_method").alias("test"))
    first = F.row_number().over(Window.partitionBy(*KEYS).orderBy("test"))
    return named.withColumn("k", first).groupBy(*KEYS).agg(F.count("*").alias("n_missed"), F.sort_array(F.collect_list(F.when(F.col("k") <= 5, F.col("test")))).alias("first_missed"))


def build_report(meta: DataFrame, intermediate: DataFrame, failures: DataFrame) -> DataFrame:
    """project, bug, status, reason, n_tests, n_triggers_expected, n_triggers_labeled, missing of each attempt.

    failures: project, bug, reason of attempts that ended early.
    """
    counts = intermediate.groupBy(*KEYS).agg(F.count("*").alias("n_tests"), F.sum("is_trigger").cast("long").alias("n_labeled"))
    expected = triggers(meta).groupBy(*KEYS).agg(F.count("*").alias("n_expected"))
    every = meta.select(*KEYS).union(failures.select(*KEYS)).distinct()
    full = every.join(expected, KEYS, "left").join(counts, KEYS, "left").join(failures.select(*KEYS, "reason"), KEYS, "left")
    zero = [F.coalesce(c, F.lit(0)).cast("long") for c in ("n_tests", "n_expected", "n_labeled")]
    failed = F.col("reason").isNotNull() | (zero[0] == 0)
    reason = F.when(failed, F.coalesce("reason", F.lit("no tests"))).when(zero[1] > zero[2], F.concat((zero[1] - zero[2]).cast("string"), F.lit(" triggers not labelled"))).otherwise(F.lit(""))
    return full.select(
        *KEYS, F.when(failed, "falhou").otherwise("ok").alias("status"), reason.alias("reason"), zero[0].alias("n_tests"), zero[1].alias("n_triggers_expected"), zero[2].alias("n_triggers_labeled"), (zero[1] - zero[2]).alias("missing")
    )


def last_attempt(report: DataFrame, order: list[str]) -> DataFrame:
    """Of each change's rows the last in the given order."""
    last = F.row_number().over(Window.partitionBy(*KEYS).orderBy(*[F.desc(c) for c in order]))
    return report.withColumn("_last", last).where("_last = 1").drop("_last")
