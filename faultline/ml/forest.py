"""Random-forest ordering: weights, group folds, grid search, scores, ablation, saved models."""

from __future__ import annotations

import itertools
import json
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.evaluation import BinaryClassificationEvaluator, Evaluator, MulticlassClassificationEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from faultline.ml.cuts import cut_scores
from faultline.operators.classify import auc, balanced_weights, group_folds, ratio
from faultline.operators.order import apfd_by_scores, apfd_unsorted, score_key
from faultline.schema import FEATURE_COLUMNS, KEYS
from faultline.sources.files import exists
from faultline.sources.shared import new_path, staged

SEED = 42
#: No depth limit becomes 30, the deepest that Spark grows; Spark has no smallest split, its counterpart in the grid is left out.
GRID = {"numTrees": [100, 200, 500], "maxDepth": [30, 5, 10, 20], "minInstancesPerNode": [1, 2, 5]}
#: Copies of a distinct row that a search's trees draw from, at least the largest minInstancesPerNode.
COPIES = 8
#: The same for a single forest.
FIT_COPIES = 64
VARIANTS = {"3 features": FEATURE_COLUMNS, "only same_package": ["same_package"], "only history": ["history"], "without same_package": ["history", "modified_classes_count"]}


def pipeline(features: list[str] = FEATURE_COLUMNS, **params) -> Pipeline:
    forest = RandomForestClassifier(featuresCol="features", labelCol="label", weightCol="weight", seed=SEED)
    for name, value in params.items():  # also a seed
        forest.set(forest.getParam(name), value)
    return Pipeline(stages=[VectorAssembler(inputCols=features, outputCol="features"), forest])


def fit(train: DataFrame, features: list[str] = FEATURE_COLUMNS, **params) -> PipelineModel:
    """A forest of all of train's instances with balanced weights, fitted on weighted distinct rows: train is read once, whatever the trees are."""
    return fit_distinct(staged(distinct_rows(train, features), "distinct"), features, **params)


def fit_distinct(distinct: DataFrame, features: list[str] = FEATURE_COLUMNS, **params) -> PipelineModel:
    """fit() of staged distinct_rows() by the features or more columns."""
    rows = distinct.groupBy(*features, "label").agg(F.sum("n").alias("n"))
    dealt = weighted_copies(rows, FIT_COPIES).repartition(8, *features, "label").sortWithinPartitions(*features, "label")  # a fixed order: reruns draw alike
    return pipeline(features, **params).fit(dealt)


def evaluator(scoring: str) -> Evaluator:
    if scoring == "roc_auc":
        return BinaryClassificationEvaluator(labelCol="label", rawPredictionCol="probability", numBins=0)
    return MulticlassClassificationEvaluator(labelCol="label", metricName="fMeasureByLabel", metricLabel=1.0)


def folds_with_positives(train: DataFrame, folds: int) -> DataFrame:
    """train with fold; a fold without a positive is an error, as it can't be scored."""
    rows = train.join(group_folds(train, folds).select(*KEYS, "fold"), KEYS)
    poor = rows.groupBy("fold").agg(F.max("label").alias("y")).where("y = 0").count()
    if poor:
        raise ValueError(f"{poor} of {folds} folds have no positive")
    return rows


def distinct_rows(rows: DataFrame, features: list[str] = FEATURE_COLUMNS, by: list[str] | None = None) -> DataFrame:
    """features, label, by columns, n: the instances that a forest can't tell apart, counted. As many rows as there are different values, whatever the instances are."""
    return rows.groupBy(*features, "label", *(by or [])).agg(F.count("*").alias("n"))


def weighted_copies(distinct: DataFrame, copies: int = COPIES) -> DataFrame:
    """distinct rows as min(n, copies) copies each, with weights that sum to n balanced between the classes.

    Trees draw copies, not instances, so a row's share of a tree varies more than if all instances were drawn; counts of under copies instances, which
    the smallest leaf asks for, stay exact.
    """
    n_copies = F.least("n", F.lit(copies))
    sizes = distinct.groupBy("label").agg(F.sum("n").alias("_size"))
    total = F.sum("_size").over(Window.partitionBy())  # two rows
    share = F.broadcast(sizes.select("label", (total / (2 * F.col("_size"))).alias("_share")))
    out = distinct.join(share, "label").withColumn("weight", F.col("_share") * F.col("n") / n_copies)
    return out.withColumn("_copy", F.explode(F.sequence(F.lit(1), n_copies.cast("int")))).drop("_share", "_copy", "n")


def grown(n_trees: list[int]) -> list[tuple[int, int]]:
    """(trees, seed) of the forests that make up each size in turn: a larger forest is the smaller one and more trees."""
    sizes = sorted(n_trees)
    return [(k - before, SEED + i) for i, (before, k) in enumerate(zip([0, *sizes], sizes, strict=False)) if k > before]


def search_scores(train: DataFrame, folds: int = 5, grid: dict | None = None, parallelism: int = 8, features: list[str] = FEATURE_COLUMNS) -> DataFrame:
    """numTrees, maxDepth, minInstancesPerNode, fold, label, n, score: the scores of each fold's distinct rows by forests of the other folds, for every setting.

    Forests are fitted on weighted distinct rows, parallelism at a time, one for each smallest leaf and fold: of the most and deepest trees in the grid, whose first
    trees, cut at each depth, are the forests of the other settings. All objectives can be read from the scores.
    """
    grid = grid or GRID
    spark, depths, sizes = train.sparkSession, sorted(set(grid["maxDepth"])), sorted(set(grid["numTrees"]))
    rows = staged(distinct_rows(folds_with_positives(train, folds), features, ["fold"]), "distinct")
    path = new_path(spark, "search-scores")
    sides = [(staged(weighted_copies(rows.where(F.col("fold") != k).drop("fold")), "fold-train"), rows.where(F.col("fold") == k)) for k in range(folds)]

    def one(task: tuple[str, int, int]) -> None:
        own, leaf, k = task
        fitting, scored = sides[k]
        model = pipeline(features, numTrees=sizes[-1], maxDepth=depths[-1], minInstancesPerNode=leaf).fit(fitting).stages[-1]
        out = cut_scores(model, scored.select(*features, "fold", "label", "n"), features, sizes, depths)
        out.select("fold", "label", "n", "numTrees", "score", F.lit(leaf).alias("minInstancesPerNode"), "maxDepth").write.parquet(own)

    tasks = [(f"{path}/{i}", leaf, k) for i, (leaf, k) in enumerate(itertools.product(sorted(set(grid["minInstancesPerNode"])), range(folds)))]
    with ThreadPoolExecutor(parallelism) as pool:
        list(pool.map(inheritable_thread_target(spark)(one), tasks))  # a task for each leaf size and fold
    return spark.read.parquet(f"{path}/*")


def objective(scores: DataFrame, by: list[str], scoring: str = "f1", count: str | None = None, hit: Column | None = None) -> DataFrame:
    """by columns, value: f1 of the positive class at 0.5 (or where hit holds), or roc_auc, of all groups in one pass. A row stands for count instances, if given."""
    if scoring == "roc_auc":
        return auc(scores, by=by, count=count).select(*by, F.col("auc").alias("value"))
    n, hit, y = F.col(count) if count else F.lit(1), F.col("score") > 0.5 if hit is None else hit, F.col("label") == 1
    sums = scores.groupBy(*by).agg(*[F.sum(F.when(c, n).otherwise(0)).alias(k) for k, c in {"tp": hit & y, "fp": hit & ~y, "fn": ~hit & y}.items()])
    return sums.select(*by, ratio(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")).alias("value"))


def setting_scores(scores: DataFrame, scoring: str = "f1") -> DataFrame:
    """The grid's params, score and std (population) over folds, of f1 of the positive class at 0.5, or roc_auc."""
    params = list(GRID)
    each = objective(scores, [*params, "fold"], scoring, "n")
    return each.groupBy(*params).agg(F.bround(F.avg("value"), 10).alias("score"), F.bround(F.stddev_pop("value"), 10).alias("std"))


def best_of(settings: DataFrame, grid: dict) -> tuple[dict, float]:
    """(params, score) of the best of a staged table of settings; of equal scores the one that comes first in the grid."""
    held = {tuple(r[p] for p in grid): r["score"] for r in settings.collect()}  # a row for each setting
    best = max(itertools.product(*grid.values()), key=lambda s: -1.0 if held[s] is None else held[s])
    return dict(zip(grid, best, strict=True)), held[best]


def grid_search(train: DataFrame, scoring: str = "f1", folds: int = 5, grid: dict | None = None, parallelism: int = 8) -> tuple[PipelineModel, dict, DataFrame]:
    """(the best model, fitted on all of train; its params and cross-validated score; the scores of all settings). All rows of a change are in one fold."""
    grid = grid or GRID
    settings = staged(setting_scores(search_scores(train, folds, grid, parallelism), scoring), "settings")
    params, score = best_of(settings, grid)
    model = pipeline(**params).fit(weighted_copies(staged(distinct_rows(train), "distinct")))
    return model, {"params": params, "score": score, "scoring": scoring, "folds": folds, "fixed": {"seed": SEED, "weights": "balanced"}}, settings


def cross_validated(train: DataFrame, scoring: str, folds: int, grid: dict, parallelism: int = 4) -> list[tuple[dict, float]]:
    """(params, score) of each setting with forests fitted on all instances: what grid_search() is held against, at its full price."""
    base = pipeline()
    forest = base.getStages()[1]
    builder = ParamGridBuilder()
    for name, values in grid.items():
        builder = builder.addGrid(forest.getParam(name), values)
    rows = balanced_weights(folds_with_positives(train, folds))
    cv = CrossValidator(estimator=base, estimatorParamMaps=builder.build(), evaluator=evaluator(scoring), numFolds=folds, foldCol="fold", parallelism=parallelism, seed=SEED).fit(rows)
    return [({p.name: v for p, v in m.items()}, x) for m, x in zip(cv.getEstimatorParamMaps(), cv.avgMetrics, strict=True)]


def score(model: PipelineModel, df: DataFrame, threshold: float = 0.5) -> DataFrame:
    """df with score, the probability of a positive, and predicted."""
    scored = model.transform(df).withColumn("score", vector_to_array("probability")[1])
    return scored.select(*df.columns, "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def forest_apfd(scored: DataFrame) -> DataFrame:
    """project, bug, apfd, n_tests, n_trigger_tests of the tests by score (12 places), without a sort."""
    return apfd_unsorted(scored, score_key(F.bround("score", 12)))


def fold_auc(train: DataFrame, folds: int = 5, **params) -> DataFrame:
    """fold, auc: each fold scored by a model of the others. A model for each fold, fitted one after the other; a distinct row counts as its instances."""
    rows = staged(distinct_rows(folds_with_positives(train, folds), by=["fold"]), "distinct")
    parts = [score(fit_distinct(rows.where(F.col("fold") != k), **params), rows.where(F.col("fold") == k)).select("fold", "label", "score", "n") for k in range(folds)]
    return auc(reduce(DataFrame.unionByName, parts), by=["fold"], count="n").select("fold", "auc", "positives", "negatives")


def ablation(train: DataFrame, test: DataFrame, variants: dict[str, list[str]] | None = None, **params) -> DataFrame:
    """strategy, project, bug, apfd, n_tests, n_trigger_tests: the test changes ordered by a model of each feature subset."""
    variants = variants or VARIANTS
    columns = sorted({f for features in variants.values() for f in features})
    rows = staged(distinct_rows(train, columns), "distinct")
    cells = test.select(*columns).distinct()
    for i, features in enumerate(variants.values()):
        cells = score(fit_distinct(rows, features, **params), cells).withColumn(f"_s{i}", F.bround("score", 12)).drop("score", "predicted")
    cells = staged(cells, "variant-scores")  # a row for each different value of the features, with all variants' scores
    return apfd_by_scores(test.join(cells, columns), {name: F.col(f"_s{i}") for i, name in enumerate(variants)})


def importances(model: PipelineModel, features: list[str] = FEATURE_COLUMNS) -> list[tuple[str, float]]:
    return list(zip(features, (float(x) for x in model.stages[-1].featureImportances.toArray()), strict=True))


def _own_params(model: PipelineModel) -> dict:
    forest = model.stages[-1]
    return {name: forest.getOrDefault(name) for name in GRID}


def save(model: PipelineModel, report: dict, path: str) -> None:
    """The model, and beside it one row of JSON with its params and score."""
    spark = SparkSession.active()
    model.write().overwrite().save(f"{path}/model")
    spark.createDataFrame([(json.dumps(report, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/params")


def load(spark, path: str) -> tuple[PipelineModel, dict]:
    """A saved model; params that differ from those beside it are an error."""
    if not exists(spark, f"{path}/model"):
        raise FileNotFoundError(path)
    model, report = PipelineModel.load(f"{path}/model"), json.loads(spark.read.text(f"{path}/params").first()[0])
    own = _own_params(model)
    if wrong := {k: (own.get(k), v) for k, v in report["params"].items() if own.get(k) != v}:
        raise ValueError(f"the saved model has other params than its report: {wrong}")
    return model, report
