"""Orderings of a change's tests, and how early they find the fault."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

KEYS = ["project", "bug"]


def priority_rank(df: DataFrame, score: Column) -> DataFrame:
    """df with priority from 1: score down, then test_method, then test_class."""
    order = Window.partitionBy(*KEYS).orderBy(score.desc(), "test_method", "test_class")
    return df.withColumn("priority", F.row_number().over(order))


def apfd_of(first: Column, n: Column) -> Column:
    """1 - TF1 / n + 1 / 2n; null without a detection."""
    return 1 - first / n + 1 / (2 * n)


def apfd(ranked: DataFrame, keys: list[str] = KEYS, label: str = "label") -> DataFrame:
    """keys, apfd, n_tests, n_trigger_tests from ranked tests."""
    first = F.min(F.when(F.col(label) == 1, F.col("priority")))
    counts = ranked.groupBy(*keys).agg(first.alias("first"), F.count("*").alias("n_tests"), F.sum(label).cast("long").alias("n_trigger_tests"))
    return counts.select(*keys, apfd_of(F.col("first"), F.col("n_tests")).alias("apfd"), "n_tests", "n_trigger_tests")


def apfd_unsorted(df: DataFrame, before: Column, keys: list[str] = KEYS, label: str = "label") -> DataFrame:
    """The same without a sort: the first detection's rank is one more than the tests that come before the best positive.

    before: a sortable column, unique within keys. Two hash aggregations; the positives' side is small.
    """
    rows = df.withColumn("_before", before)
    best = rows.where(F.col(label) == 1).groupBy(*keys).agg(F.min("_before").alias("_best"), F.count("*").alias("_positives"))
    joined = rows.select(*keys, "_before").join(best, keys, "left")
    counts = joined.groupBy(*keys).agg(F.count_if(F.col("_before") < F.col("_best")).alias("_ahead"), F.count("*").alias("n_tests"), F.max("_positives").alias("_positives"))
    first = F.when(F.col("_positives").isNotNull(), F.col("_ahead") + 1)
    return counts.select(*keys, apfd_of(first, F.col("n_tests")).alias("apfd"), "n_tests", F.coalesce("_positives", F.lit(0)).cast("long").alias("n_trigger_tests"))


def apfd_by_scores(df: DataFrame, scores: dict[str, Column]) -> DataFrame:
    """strategy, project, bug, apfd, n_tests, n_trigger_tests of the orders by several scores (down, then test_method, test_class): two hash aggregations for all of them, no sort."""
    keys = {f"_k{i}": score_key(s) for i, s in enumerate(scores.values())}
    best = df.where("label = 1").groupBy(*KEYS).agg(*[F.min(k).alias(f"_b{i}") for i, k in enumerate(keys.values())])
    joined = df.join(best, KEYS, "left")
    ahead = [F.count_if(k < F.col(f"_b{i}")).alias(f"_a{i}") for i, k in enumerate(keys.values())]
    counts = joined.groupBy(*KEYS).agg(*ahead, F.count("*").alias("n_tests"), F.sum("label").cast("long").alias("n_trigger_tests"))
    first = [F.when(F.col("n_trigger_tests") > 0, F.col(f"_a{i}") + 1) for i in range(len(keys))]
    each = F.array(*[F.struct(F.lit(name).alias("strategy"), apfd_of(f, F.col("n_tests")).alias("apfd")) for name, f in zip(scores, first, strict=True)])
    return counts.select(F.inline(each), *KEYS, "n_tests", "n_trigger_tests").select("strategy", *KEYS, "apfd", "n_tests", "n_trigger_tests")


def score_key(score: Column) -> Column:
    """The key of priority_rank's order, for apfd_unsorted."""
    return F.struct((-score).alias("s"), F.col("test_method"), F.col("test_class"))


def random_key(seed: Column | str = "seed") -> Column:
    """A keyed hash order of a change's tests: one random permutation for each seed, whatever the partitioning."""
    return F.md5(F.concat_ws(":", F.col(seed) if isinstance(seed, str) else seed, "project", "bug", "test_class", "test_method"))


def random_apfd(df: DataFrame, seeds: int = 30) -> DataFrame:
    """project, bug, seed, apfd, n_tests, n_trigger_tests under seeds random orders, without sorts.

    Only the positives are copied for each seed before the join: a change without one costs nothing, and the
    rows that are compared are (tests x seeds) of the changes with positives, streamed through a hash join and aggregation.
    """
    seed = F.explode(F.sequence(F.lit(0), F.lit(seeds - 1))).alias("seed")
    positives = df.where("label = 1").select(*df.columns, seed)
    best = positives.groupBy(*KEYS, "seed").agg(F.min(random_key()).alias("best"))
    bests = best.groupBy(*KEYS).agg(F.collect_list(F.struct("seed", "best")).alias("bests"))
    # One row for each test and change with all seeds' bests beside it: an array of 30, not 30 rows.
    # A row costs 30 hashes: the tests are dealt evenly before, whatever files or large changes they come in.
    spread = df.select(*KEYS, "test_class", "test_method").repartition(*KEYS, "test_class", "test_method")
    joined = spread.join(bests, KEYS)
    ahead = joined.select(*KEYS, "test_class", "test_method", F.explode("bests").alias("b")).select(
        *KEYS, F.col("b.seed").alias("seed"), (random_key(F.col("b.seed")) < F.col("b.best")).alias("ahead")
    )
    counts = ahead.groupBy(*KEYS, "seed").agg(F.count_if("ahead").alias("n_ahead"))
    sizes = df.groupBy(*KEYS).agg(F.count("*").alias("n_tests"), F.sum("label").cast("long").alias("n_trigger_tests"))
    full = sizes.select("*", seed).join(counts, [*KEYS, "seed"], "left")
    return full.select(*KEYS, "seed", apfd_of(F.col("n_ahead") + 1, F.col("n_tests")).alias("apfd"), "n_tests", "n_trigger_tests")


def seed_summary(by_seed: DataFrame) -> DataFrame:
    """project, bug, apfd_mean, apfd_std (sample), n_tests, n_trigger_tests."""
    return by_seed.groupBy(*KEYS, "n_tests", "n_trigger_tests").agg(F.avg("apfd").alias("apfd_mean"), F.stddev_samp("apfd").alias("apfd_std")).select(*KEYS, "apfd_mean", "apfd_std", "n_tests", "n_trigger_tests")


def numpy_random_apfd(df: DataFrame, seeds: int = 30) -> DataFrame:
    """project, bug, apfd_mean, apfd_std (sample), n_tests, n_trigger_tests under numpy's permutations by default_rng(0), default_rng(1), ...

    The parity mode of random_apfd(): the permutations act on a change's tests in the order of test_class, test_method, so a change with a positive is
    one task's, of which a test is 8 bytes. Changes without a positive have no order and stay in Spark.
    """

    def scored(change: pa.Table) -> pa.Table:
        labels = change.column("label").to_numpy()
        n = len(labels)
        first = np.array([np.argmax(np.random.default_rng(seed).permutation(labels) == 1) + 1 for seed in range(seeds)])
        apfds = 1 - first / n + 1 / (2 * n)
        std = float(apfds.std(ddof=1)) if seeds > 1 else None
        return pa.table({"project": change.column("project")[:1], "bug": change.column("bug")[:1], "apfd_mean": [float(apfds.mean())], "apfd_std": pa.array([std], pa.float64())})

    sizes = df.groupBy(*KEYS).agg(F.count("*").alias("n_tests"), F.sum("label").cast("long").alias("n_trigger_tests"))
    # ordered here: what the task gets is a label for each test, in its place
    place = F.row_number().over(Window.partitionBy(*KEYS).orderBy("test_class", "test_method"))
    rows = df.join(sizes.where("n_trigger_tests > 0"), KEYS, "left_semi").select(*KEYS, F.col("label").cast("int").alias("label"), place.alias("place"))
    key = df.schema["project"].dataType.simpleString(), df.schema["bug"].dataType.simpleString()
    found = rows.groupBy(*KEYS).applyInArrow(lambda change: scored(change.sort_by("place")), f"project {key[0]}, bug {key[1]}, apfd_mean double, apfd_std double")
    return sizes.join(found, KEYS, "left").select(*KEYS, "apfd_mean", "apfd_std", "n_tests", "n_trigger_tests")
