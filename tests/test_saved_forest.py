"""A saved forest held against SQL: its nodes walked by a recursive query in another engine, and all that is said of its scores computed again from those."""

import random

import duckdb
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from faultline.ml import forest
from faultline.operators import classify
from faultline.schema import FEATURE_COLUMNS

ROWS = "project string, bug long, test_class string, test_method string, history long, same_package int, modified_classes_count int, label int"


@pytest.fixture(scope="module")
def rows(spark):
    rnd = random.Random(11)
    out = []
    for i in range(900):
        history, same, n = rnd.choice([0, 0, 0, 1, 2, 5]), int(rnd.random() < 0.2), i % 12 % 5
        out.append((f"P{i % 2}", i % 12, f"a.b{i % 7}.C", f"t{i}", history, same, n, int(rnd.random() < 0.03 + 0.1 * history + 0.3 * same)))
    return spark.createDataFrame(out, ROWS)


#: Every row walks down every tree; a forest's score is the mean of its leaves' shares of positives.
WALK = """
WITH RECURSIVE nodes AS (SELECT treeID, nodeData.* FROM read_parquet('{path}/model/stages/1_*/data/*.parquet')),
r AS (SELECT *, [{features}]::DOUBLE[] AS x FROM read_parquet('{path}/rows/*.parquet')),
w AS (
    SELECT project, bug, test_method, x, treeID, 0 AS node FROM r, (SELECT DISTINCT treeID FROM nodes)
    UNION ALL
    SELECT project, bug, test_method, x, w.treeID, CASE WHEN x[n.split.featureIndex + 1] <= n.split.leftCategoriesOrThreshold[1] THEN n.leftChild ELSE n.rightChild END
    FROM w JOIN nodes n ON w.treeID = n.treeID AND w.node = n.id WHERE n.leftChild >= 0),
leaf AS (SELECT project, bug, test_method, n.impurityStats[2] / (n.impurityStats[1] + n.impurityStats[2]) AS share FROM w JOIN nodes n ON w.treeID = n.treeID AND w.node = n.id WHERE n.leftChild < 0),
s AS (SELECT r.*, v.score, (v.score >= 0.5)::INT AS predicted FROM r JOIN (SELECT project, bug, test_method, avg(share) AS score FROM leaf GROUP BY ALL) v USING (project, bug, test_method))
"""


@pytest.fixture(scope="module")
def saved(spark, rows, tmp_path_factory):
    """(scores of the loaded model, a function that asks SQL of the saved nodes)."""
    path = str(tmp_path_factory.mktemp("forest"))
    forest.save(forest.fit(rows, numTrees=7, maxDepth=4), {"params": {"numTrees": 7, "maxDepth": 4}}, path)
    rows.write.parquet(f"{path}/rows")
    scored = forest.score(forest.load(spark, path)[0], spark.read.parquet(f"{path}/rows"))
    walk = WALK.format(path=path, features=", ".join(FEATURE_COLUMNS))
    return scored, lambda tail: duckdb.sql(walk + tail).fetchall()


def test_scores_are_those_of_the_saved_nodes(saved):
    scored, ask = saved
    want = {tuple(r[:3]): r[3:] for r in ask("SELECT project, bug, test_method, score, predicted FROM s")}
    got = {(r["project"], r["bug"], r["test_method"]): (r["score"], r["predicted"]) for r in scored.collect()}
    assert got.keys() == want.keys() and len({round(s, 6) for s, _ in got.values()}) > 10
    assert all(got[k][0] == pytest.approx(want[k][0], abs=1e-9) and got[k][1] == want[k][1] for k in want)


def test_confusion_and_scores_by_sql(saved):
    scored, ask = saved
    want = ask("""SELECT coalesce(project, 'Overall'), count(*) FILTER (WHERE predicted = 0 AND label = 0), count(*) FILTER (WHERE predicted = 1 AND label = 0),
        count(*) FILTER (WHERE predicted = 0 AND label = 1), count(*) FILTER (WHERE predicted = 1 AND label = 1) FROM s GROUP BY ROLLUP (project)""")
    got = classify.scores_of(classify.confusion(scored)).collect()
    assert sorted(tuple(r)[:5] for r in got) == sorted(want)
    for r in got:
        assert r["f1"] == pytest.approx(2 * r["tp"] / max(2 * r["tp"] + r["fp"] + r["fn"], 1), abs=5e-5)


def test_auc_and_objectives_by_sql_and_evaluators(saved):
    scored, ask = saved
    scored = scored.withColumn("score", F.bround("score", 10))
    pairs = "(a.score > b.score)::INT + 0.5 * (a.score = b.score)::INT"
    want = dict(ask(f", q AS (SELECT project, label, round(score, 10) AS score FROM s) SELECT a.project, avg({pairs}) FROM q a JOIN q b ON a.project = b.project AND a.label = 1 AND b.label = 0 GROUP BY ALL"))
    for r in forest.objective(scored, ["project"], "roc_auc").collect():
        assert r["value"] == pytest.approx(want[r["project"]], abs=1e-9)
    values = {s: dict(map(tuple, forest.objective(scored, ["project"], s, hit=F.col("predicted") == 1).collect())) for s in ("f1", "roc_auc")}
    table = scored.withColumn("prediction", F.col("predicted").cast("double")).withColumn("probability", array_to_vector(F.array(1 - F.col("score"), "score"))).withColumn("label", F.col("label").cast("double"))
    for project, scoring in (("P0", "f1"), ("P1", "f1"), ("P0", "roc_auc"), ("P1", "roc_auc")):
        assert values[scoring][project] == pytest.approx(forest.evaluator(scoring).evaluate(table.where(F.col("project") == project)), abs=1e-9)


def test_forest_order_by_sql_without_a_sort(saved):
    scored, ask = saved
    want = ask(""", o AS (SELECT *, row_number() OVER (PARTITION BY project, bug ORDER BY round(score, 12) DESC, test_method, test_class) AS place FROM s)
        SELECT project, bug, 1 - min(place) FILTER (WHERE label = 1) / count(*) + 1 / (2 * count(*)), count(*), sum(label) FROM o GROUP BY ALL""")
    out = forest.forest_apfd(scored)
    got = {tuple(r)[:2]: tuple(r)[2:] for r in out.collect()}
    assert len(got) == len(want) == 12
    for project, bug, value, n, positives in want:
        assert got[project, bug] == (pytest.approx(value), n, positives)
    assert "Window" not in out._jdf.queryExecution().optimizedPlan().toString()
