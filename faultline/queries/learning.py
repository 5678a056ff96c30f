"""Queries of the random forest. Spark's forest has no SQL form; tests hold them against invariants and against SQL over the nodes of a saved model."""

from __future__ import annotations

from pyspark.sql import functions as F

from faultline.ml import forest
from faultline.operators import classify, order, split, stats
from faultline.operators.rank import global_rank
from faultline.plans import derived
from faultline.plans.derived import sql
from faultline.sources.files import exists
from faultline.sources.shared import new_path, staged

from . import evaluation, query

TREES = {"numTrees": 20, "maxDepth": 5}


def sides(spark, d):
    """(train, test): views of one staged feature table."""
    f, s = derived.features_and_split(spark, d)
    f = staged(f, "features")
    return split.on_side(f, s, "train"), split.on_side(f, s, "test")


@query("Q9_forest_apfd")
def q9(spark, d):
    train, test = sides(spark, d)
    return forest.forest_apfd(forest.score(forest.fit(train, **TREES), test))


#: The stored scores of a search by application and folder: both objectives read the same forests.
_searched: dict[tuple[str, str], str] = {}


def searched(spark, d):
    """The scores of the full grid over five folds."""
    key = spark.sparkContext.applicationId, d
    if key not in _searched or not exists(spark, _searched[key]):
        path = new_path(spark, "search")
        forest.search_scores(sides(spark, d)[0]).write.parquet(path)
        _searched[key] = path
    return spark.read.parquet(_searched[key])


def ranked(settings):
    """The settings from the best score down, ties in the grid's order."""
    return global_rank(settings, [F.desc_nulls_last("score"), *forest.GRID], "place")


@query("M2_grid_search")
def m2(spark, d):
    return ranked(forest.setting_scores(searched(spark, d), "f1"))


@query("M5_grid_search_auc")
def m5(spark, d):
    return ranked(forest.setting_scores(searched(spark, d), "roc_auc"))


@query("M4_scored_confusion")
def m4(spark, d):
    train, test = sides(spark, d)
    return classify.scores_of(classify.confusion(forest.score(forest.fit(train, **TREES), test)))


@query("Q11_classification")
def q11(spark, d):
    train, test = sides(spark, d)
    scored = staged(forest.score(forest.fit(train, **TREES), test), "scored")
    mean, std = classify.fold_summary(forest.fold_auc(train, 3, **TREES)).first()  # one row
    return classify.auc(scored).select(F.bround("auc", 4).alias("test_auc"), F.lit(mean).alias("cv_auc_mean"), F.lit(std).alias("cv_auc_std"))


@query("M6_ablation")
def m6(spark, d):
    train, test = sides(spark, d)
    return forest.ablation(train, test, **TREES)


@query("Q12_ablation_summary")
def q12(spark, d):
    train, test = sides(spark, d)
    variants = forest.ablation(train, test, **TREES)
    baseline = order.apfd_unsorted(test, order.score_key(F.col("same_package"))).withColumn("strategy", F.lit("Same-Package"))
    both = staged(variants.unionByName(baseline), "variants")
    return stats.wilcoxon(both, [*forest.VARIANTS, "Same-Package"])


@query("M7_importances")
def m7(spark, d):
    train, _ = sides(spark, d)
    return spark.createDataFrame(forest.importances(forest.fit(train, **TREES)), "feature string, importance double")


@query("S14_saved_model")
def s14(spark, d):
    train, test = sides(spark, d)
    path = new_path(spark, "model")
    forest.save(forest.fit(train, **TREES, minInstancesPerNode=1), {"params": TREES | {"minInstancesPerNode": 1}}, path)
    model, report = forest.load(spark, path)
    return forest.score(model, test).groupBy("project", "bug").agg(F.sum("predicted").alias("predicted"), F.count("*").alias("n"))


@query("M1_training_weights", sql(", sp0 AS (SELECT project, bug, q, max(is_trigger) = 1 AS h FROM t GROUP BY ALL), sp AS (SELECT project, bug, h AND row_number() OVER (PARTITION BY project, h ORDER BY q DESC, bug DESC) <= round_even(count(*) OVER (PARTITION BY project, h) * 0.3::DOUBLE, 0) AS test FROM sp0) SELECT label, count(*) AS n, (sum(count(*)) OVER () / (2 * count(*)))::DOUBLE AS weight FROM f JOIN sp ON f.project = sp.project AND f.bug = sp.bug WHERE NOT test GROUP BY label"))
def m1(spark, d):
    train, _ = sides(spark, d)
    return classify.balanced_weights(train).groupBy("label", "weight").agg(F.count("*").alias("n"))


@query("M3_fold_scores", evaluation.sql(evaluation.SCORED + ", x AS (SELECT project, score, predicted, label FROM sf), s AS (SELECT project, 2.0::DOUBLE * sum(predicted * label) / nullif(sum(predicted) + sum(label), 0) AS f1 FROM x GROUP BY ALL), sc AS (SELECT project, score, count(*) FILTER (WHERE label = 1) AS p, count(*) FILTER (WHERE label = 0) AS n FROM x GROUP BY ALL), cm AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY project ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE AS below FROM sc), au AS (SELECT project, " + evaluation.AUC + " AS auc FROM cm GROUP BY project) SELECT project, round_even(f1, 8) AS f1, round_even(auc, 8) AS roc_auc FROM s JOIN au USING (project)"))
def m3(spark, d):
    """The search's objectives of stored scores, for each project as a fold: one pass each, whatever the number of folds."""
    rows = staged(evaluation.scored(spark, d).select("project", "score", "predicted", "label"), "scored")
    f1 = forest.objective(rows, ["project"], "f1", hit=F.col("predicted") == 1)
    return f1.join(forest.objective(rows, ["project"], "roc_auc").withColumnRenamed("value", "roc_auc"), "project").select("project", F.bround("value", 8).alias("f1"), F.bround("roc_auc", 8).alias("roc_auc"))
