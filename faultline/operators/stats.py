"""Statistics of strategies: by scope, pairwise, and over the distribution."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from faultline.functions.text import best_label, exact
from faultline.sources.shared import staged

OVERALL = "Overall"
SIGNIFICANT = 0.05


def _scoped(df: DataFrame, keys: list[str], *aggs: Column) -> DataFrame:
    """One pass of grouping sets: scope Overall and each project."""
    g = df.groupingSets([[F.col(k) for k in keys], [F.col("project"), *[F.col(k) for k in keys]]], *[F.col(k) for k in ["project", *keys]])
    out = g.agg(F.grouping("project").alias("_all"), *aggs)
    return out.withColumn("scope", F.when(F.col("_all") == 1, F.lit(OVERALL)).otherwise(F.col("project"))).drop("_all", "project")


def spread(counts: DataFrame, by: list[str], value: str, quantiles: dict[str, float] | None = None) -> DataFrame:
    """by, count, mean, std (sample), min, max and exact quantiles (interpolated) of a value, from a row of n for each different value; nulls aren't counted.

    The quantiles come from sums of n along the values, so that what is sorted, and spilled where it is much, are different values and not rows.
    """
    x, whole = F.col(value), Window.partitionBy(*by)
    n = F.when(x.isNotNull(), F.col("n")).otherwise(0)
    upto = F.sum(n).over(whole.orderBy(x).rowsBetween(Window.unboundedPreceding, 0))
    placed = counts.select(*by, x.alias("_x"), n.alias("_n"), upto.alias("_upto"), F.sum(n).over(whole).alias("_total"), F.sum(n * x).over(whole).alias("_sum"))
    x, n, total = F.col("_x"), F.col("_n"), F.col("_total")
    mean = F.try_divide(F.col("_sum").cast("double"), total)

    def at(place: Column) -> Column:
        return F.min(F.when(F.col("_upto") > place, x))

    aggs = {"count": F.coalesce(F.max(total), F.lit(0)).cast("long"), "mean": F.max(mean), "std": F.sqrt(F.try_divide(F.sum(n * F.pow(x - mean, F.lit(2))), F.nullif(F.max(total) - 1, F.lit(0)))), "min": F.min(x), "max": F.max(x)}
    for name, q in (quantiles or {}).items():
        place = F.lit(q) * (total - 1)
        low = at(F.floor(place))
        aggs[name] = low + (at(F.ceil(place)) - low) * F.max(place - F.floor(place))
    return placed.groupBy(*by).agg(*[v.alias(k) for k, v in aggs.items()])


def strategy_summary(results: DataFrame, by: list[str] | None = None, digits: int = 4) -> DataFrame:
    """mean, median, std (sample), min, max and count of apfd, for all or by columns; undefined ones are left out."""
    by = by or []
    out = spread(results.groupBy(*by, "apfd").agg(F.count("*").alias("n")), by, "apfd", {"median": 0.5})
    return out.select(*by, *[exact(F.col(k), digits).alias(k) for k in ("mean", "median", "std", "min", "max")], "count")


def describe_by_scope(long: DataFrame, digits: int = 4) -> DataFrame:
    """scope, strategy, mean, median, std, min, q25, q75, max, count."""
    counts = _scoped(long, ["strategy", "apfd"], F.count("*").alias("n"))
    out = spread(counts, ["scope", "strategy"], "apfd", {"median": 0.5, "q25": 0.25, "q75": 0.75})
    return out.select("scope", "strategy", *[exact(F.col(k), digits).alias(k) for k in ("mean", "median", "std", "min", "q25", "q75", "max")], "count")


def _fences(counts: DataFrame) -> DataFrame:
    """scope, strategy, n, mean, q1, median, q3, low, high of counted results: values beyond low and high, 1.5 IQR off the quartiles, are outliers."""
    out = spread(counts, ["scope", "strategy"], "apfd", {"q1": 0.25, "median": 0.5, "q3": 0.75})
    reach = 1.5 * (F.col("q3") - F.col("q1"))
    return out.select("scope", "strategy", F.col("count").alias("n"), "mean", "q1", "median", "q3", (F.col("q1") - reach).alias("low"), (F.col("q3") + reach).alias("high"))


def boxplot(long: DataFrame) -> DataFrame:
    """scope, strategy, n, mean, quartiles, whiskers (the last values within 1.5 IQR) and n_outliers; outliers() has the outliers themselves."""
    x, inside = F.col("apfd"), F.col("apfd").between(F.col("low"), F.col("high"))
    counts = staged(_scoped(long.where(x.isNotNull()), ["strategy", "apfd"], F.count("*").alias("k")).withColumnRenamed("k", "n"), "counts")
    fences = _fences(counts)
    met = fences.join(counts.withColumnRenamed("n", "_n"), ["scope", "strategy"]).groupBy("scope", "strategy", "n", "mean", "q1", "median", "q3")
    return met.agg(F.min(F.when(inside, x)).alias("whisker_low"), F.max(F.when(inside, x)).alias("whisker_high"), F.sum(F.when(inside, 0).otherwise(F.col("_n"))).alias("n_outliers"))


def outliers(long: DataFrame) -> DataFrame:
    """scope and the results that lie beyond the fences of their scope and strategy, a row each."""
    defined = long.where("apfd is not null")
    fences = _fences(_scoped(defined, ["strategy", "apfd"], F.count("*").alias("n"))).select("scope", "strategy", "low", "high")  # one row for each strategy of a scope
    scopes = defined.withColumn("scope", F.explode(F.array(F.lit(OVERALL), F.col("project"))))
    return scopes.join(fences, ["scope", "strategy"]).where("apfd < low or apfd > high").select("scope", *long.columns)


def duplicates(long: DataFrame) -> DataFrame:
    """(strategy, project, bug) that occur more than once: a pivot would be wrong."""
    return long.groupBy("strategy", "project", "bug").agg(F.count("*").alias("n")).where("n > 1")


def wide(long: DataFrame, strategies: list[str]) -> DataFrame:
    """project, bug and one apfd column for each strategy; a repeated (strategy, change) is an error when it is reached."""
    one = F.when(F.count("apfd") > 1, F.raise_error(F.lit("a strategy has a change twice")).cast("double")).otherwise(F.first("apfd", ignorenulls=True))
    return long.groupBy("project", "bug").pivot("strategy", strategies).agg(one)


def pairs(long: DataFrame, strategies: list[str]) -> DataFrame:
    """strategy_a, strategy_b, project, bug, a, b for each two strategies in the order given; both results defined."""
    index = F.array_position(F.array(*map(F.lit, strategies)), F.col("strategy")).alias("i")
    x = long.where("apfd is not null").select("project", "bug", index, F.col("strategy"), exact(F.col("apfd")).alias("apfd"))
    a = x.select("project", "bug", F.col("i").alias("i_a"), F.col("strategy").alias("strategy_a"), F.col("apfd").alias("a"))
    b = x.select("project", "bug", F.col("i").alias("i_b"), F.col("strategy").alias("strategy_b"), F.col("apfd").alias("b"))
    return a.join(b, ["project", "bug"]).where("i_a > 0 and i_b > 0 and i_a < i_b").drop("i_a", "i_b")


def wins(paired: DataFrame) -> DataFrame:
    """wins of a, wins of b, ties, n_pairs, mean_a, mean_b, and whether the series are identical."""
    return paired.groupBy("strategy_a", "strategy_b").agg(
        F.count_if(F.col("a") > F.col("b")).alias("wins_a"),
        F.count_if(F.col("a") < F.col("b")).alias("wins_b"),
        F.count_if(F.col("a") == F.col("b")).alias("ties"),
        F.count("*").alias("n_pairs"),
        exact(F.avg("a"), 4).alias("mean_a"),
        exact(F.avg("b"), 4).alias("mean_b"),
        (F.count_if(~F.col("a").eqNullSafe(F.col("b"))) == 0).alias("identical"),
    )


def difference_ranks(paired: DataFrame) -> DataFrame:
    """strategy_a, strategy_b, size, n, n_plus, rank: the average rank of each different |a - b| that isn't zero, without a global sort."""
    d = exact(F.col("a") - F.col("b"))
    sizes = paired.withColumn("d", d).where("d <> 0").groupBy("strategy_a", "strategy_b", F.abs("d").alias("size")).agg(F.count("*").alias("n"), F.count_if(F.col("d") > 0).alias("n_plus"))
    below = Window.partitionBy("strategy_a", "strategy_b").orderBy("size").rowsBetween(Window.unboundedPreceding, -1)
    return sizes.withColumn("rank", F.coalesce(F.sum("n").over(below), F.lit(0)) + (F.col("n") + 1) / 2)


def signed_ranks(paired: DataFrame) -> DataFrame:
    """strategy_a, strategy_b, n, w_plus, w_minus, w, z by the tie-corrected normal approximation; z is null without a difference."""
    out = difference_ranks(paired).groupBy("strategy_a", "strategy_b").agg(
        F.sum("n").alias("n"),
        F.sum(F.col("rank") * F.col("n_plus")).alias("w_plus"),
        F.sum(F.col("rank") * (F.col("n") - F.col("n_plus"))).alias("w_minus"),
        F.sum(F.pow(F.col("n").cast("double"), F.lit(3)) - F.col("n")).alias("tie_sum"),
    )
    n = F.col("n").cast("double")
    sd = F.sqrt((n * (n + 1) * (2 * n + 1) - F.col("tie_sum") / 2) / 24)
    return out.select("strategy_a", "strategy_b", "n", "w_plus", "w_minus", F.least("w_plus", "w_minus").alias("w"), F.when(sd > 0, (F.least("w_plus", "w_minus") - n * (n + 1) / 4) / sd).alias("z"))


@F.pandas_udf(T.DoubleType())
def two_sided_p(z: pd.Series) -> pd.Series:
    """The two-sided normal tail; Spark has no error function. It runs on one row for each pair of strategies."""
    return z.map(lambda v: math.erfc(abs(v) / math.sqrt(2)), na_action="ignore")


def wilcoxon(long: DataFrame, strategies: list[str]) -> DataFrame:
    """tested() of each two strategies of long results, whose pairs are staged once."""
    return tested(staged(pairs(long, strategies), "pairs"))


def tested(paired: DataFrame) -> DataFrame:
    """One row for each pair of strategies of staged pairs: wins, ties, means, w, z, p_value, significant, identical. Identical series aren't tested."""
    tested = wins(paired).join(signed_ranks(paired), ["strategy_a", "strategy_b"], "left").withColumn("p_value", two_sided_p("z"))
    return tested.withColumn("significant", F.coalesce(F.col("p_value") < SIGNIFICANT, F.lit(False)))


def best_and_worst(table: DataFrame, strategies: list[str]) -> DataFrame:
    """The wide table with best and worst: the strategies that reach the row's largest and smallest value."""
    rounded = table.select("project", "bug", *[exact(F.col(s)).alias(s) for s in strategies])
    return rounded.withColumn("best", best_label(strategies)).withColumn("worst", best_label(strategies, largest=False))


def coverage(long: DataFrame) -> DataFrame:
    """strategies, changes, covered_by_all, complete: whether every strategy has every change."""
    k = long.agg(F.count_distinct("strategy")).first()[0]  # one number
    each = long.groupBy("project", "bug").agg(F.count_distinct("strategy").alias("n"))
    counts = each.agg(F.lit(k).cast("long").alias("strategies"), F.count("*").alias("changes"), F.count_if(F.col("n") == k).alias("covered_by_all"))
    return counts.withColumn("complete", F.col("changes") == F.col("covered_by_all"))


def value_shares(df: DataFrame, column: str) -> DataFrame:
    """value, n, percent of a column's values."""
    counts = df.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))
    return counts.withColumn("percent", exact(100 * F.col("n") / F.sum("n").over(Window.partitionBy()), 4))  # one row for each different value


def numeric_profile(df: DataFrame, columns: list[str]) -> DataFrame:
    """feature, count, mean, std, min, q25, median, q75, max: one pass over all the columns, then over their different values."""
    tall = df.select(F.inline(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("x")) for c in columns])))
    out = spread(tall.groupBy("feature", "x").agg(F.count("*").alias("n")), ["feature"], "x", {"q25": 0.25, "median": 0.5, "q75": 0.75})
    return out.select("feature", "count", exact(F.col("mean"), 8).alias("mean"), exact(F.col("std"), 8).alias("std"), "min", "q25", "median", "q75", "max")
