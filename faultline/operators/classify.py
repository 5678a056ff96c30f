"""Classification measures of scored tests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from faultline.functions.text import exact

from .rank import global_rank
from .stats import _scoped


def ratio(a: Column, b: Column) -> Column:
    """a / b, 0 where b is 0."""
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


def confusion(df: DataFrame, predicted: str = "predicted", label: str = "label") -> DataFrame:
    """scope, tn, fp, fn, tp, positives, rows, changes: overall and by project in one pass."""
    p, y = F.col(predicted) == 1, F.col(label) == 1
    counts = {"tn": ~p & ~y, "fp": p & ~y, "fn": ~p & y, "tp": p & y, "positives": y}
    out = _scoped(df, [], *[F.count_if(v).alias(k) for k, v in counts.items()], F.count("*").alias("rows"), F.count_distinct(F.struct("project", "bug")).alias("changes"))
    return out.select("scope", *counts, "rows", "changes")


def scores_of(counts: DataFrame, digits: int = 4) -> DataFrame:
    """counts with precision, recall and f1 of the positive class."""
    p, r = ratio(F.col("tp"), F.col("tp") + F.col("fp")), ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    f1 = ratio(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn"))
    return counts.select("*", exact(p, digits).alias("precision"), exact(r, digits).alias("recall"), exact(f1, digits).alias("f1"))


def sums_to_overall(counts: DataFrame, columns: list[str]) -> DataFrame:
    """measure, overall, by_project, ok: the projects' counts sum to the overall ones."""
    tall = counts.select("scope", F.inline(F.array(*[F.struct(F.lit(c).alias("measure"), F.col(c).cast("long").alias("n")) for c in columns])))
    total, parts = F.sum(F.when(F.col("scope") == "Overall", F.col("n"))), F.sum(F.when(F.col("scope") != "Overall", F.col("n")))
    return tall.groupBy("measure").agg(total.alias("overall"), parts.alias("by_project"), (total == parts).alias("ok"))


def auc(df: DataFrame, score: str = "score", label: str = "label", by: list[str] | None = None, count: str | None = None) -> DataFrame:
    """auc, positives and negatives (by columns): the rank statistic, ties counted half; null with one class. A row stands for count instances, if given.

    Rows meet as one row for each different score, so the ranking never sorts the input.
    """
    by, n = by or [], F.col(count) if count else F.lit(1)
    each = df.groupBy(*by, score).agg(*[F.sum(F.when(F.col(label) == y, n).otherwise(0)).alias(c) for y, c in ((1, "p"), (0, "n"))])
    below = F.coalesce(F.sum("n").over(Window.partitionBy(*by).orderBy(score).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranked = each.withColumn("won", F.col("p") * (below + F.col("n") / 2))
    pairs = F.col("positives").cast("double") * F.col("negatives")
    out = ranked.groupBy(*by).agg(F.sum("won").alias("won"), F.sum("p").alias("positives"), F.sum("n").alias("negatives"))
    return out.select(*by, F.try_divide(F.col("won"), pairs).alias("auc"), "positives", "negatives")


def group_folds(df: DataFrame, folds: int = 5) -> DataFrame:
    """project, bug, size, fold: changes by size down, dealt to the folds back and forth, so that folds have about as many rows and each change one fold."""
    sizes = df.groupBy("project", "bug").agg(F.count("*").alias("size"))
    rank = F.col("_rank")
    back = (F.floor(rank / folds) % 2) == 1
    ranked = global_rank(sizes, [F.desc("size"), "project", "bug"], "_rank")
    return ranked.withColumn("fold", F.when(back, folds - 1 - rank % folds).otherwise(rank % folds).cast("int")).drop("_rank")


def fold_summary(by_fold: DataFrame, column: str = "auc") -> DataFrame:
    """mean and population deviation over folds."""
    return by_fold.agg(exact(F.avg(column), 4).alias("mean"), exact(F.stddev_pop(column), 4).alias("std"))


def constant_within_change(df: DataFrame, features: list[str]) -> DataFrame:
    """feature, constant_changes, changes, always: in how many changes a feature has one value."""
    each = df.groupBy("project", "bug").agg(*[F.count_distinct(f).alias(f) for f in features])
    tall = each.select(F.inline(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).alias("n")) for f in features])))
    return tall.groupBy("feature").agg(F.count_if(F.col("n") == 1).alias("constant_changes"), F.count("*").alias("changes"), (F.count_if(F.col("n") != 1) == 0).alias("always"))


def balanced_weights(df: DataFrame, label: str = "label") -> DataFrame:
    """df with weight n / (2 n_c), from counts of the two classes."""
    counts = df.groupBy(label).agg(F.count("*").alias("n"))
    total = F.sum("n").over(Window.partitionBy())  # two rows
    weights = counts.select(F.col(label), (total / (2 * F.col("n"))).alias("weight"))
    return df.join(F.broadcast(weights), label)
