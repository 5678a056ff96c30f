"""One fitted forest as the forests of all sizes and depths of a search."""

import random

import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from faultline.ml import cuts, forest

SCHEMA = "project string, bug long, test_class string, test_method string, history long, same_package int, modified_classes_count int, label int"


@pytest.fixture(scope="module")
def rows(spark):
    rnd = random.Random(5)
    out = []
    for i in range(600):
        h, s, m = rnd.choice((0, 0, 1, 2, 5)), int(rnd.random() < 0.3), rnd.randrange(9)
        out.append(("P", i % 20, "c", f"m{i}", h, s, m, int(rnd.random() < 0.1 + 0.3 * s + 0.1 * h)))
    return spark.createDataFrame(out, SCHEMA)


def test_cut_trees_are_those_grown_no_further(spark, rows):
    dealt = forest.weighted_copies(forest.distinct_rows(rows)).coalesce(1).sortWithinPartitions(*forest.FEATURE_COLUMNS, "label")
    own = {"numTrees": 7, "featureSubsetStrategy": "all"}  # without drawn features a tree's splits don't depend on what is split beside it
    deepest = forest.pipeline(**own, maxDepth=12).fit(dealt)
    cells = rows.select(*forest.FEATURE_COLUMNS).distinct()
    found = cuts.cut_scores(deepest.stages[-1], cells, forest.FEATURE_COLUMNS, [7], [0, 1, 2, 4, 12, 30])
    assert max(t.depth for t in deepest.stages[-1].trees) > 4
    for depth in (0, 1, 2, 4, 12, 30):
        model = deepest if depth > 4 else forest.pipeline(**own, maxDepth=depth).fit(dealt)
        scored = model.transform(cells).select(*forest.FEATURE_COLUMNS, F.bround(vector_to_array("rawPrediction")[1] / 7, 8))
        want = {tuple(r)[:3]: r[3] for r in scored.collect()}
        got = {tuple(r)[:3]: r[-1] for r in found.where(F.col("maxDepth") == depth).collect()}
        assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=1e-7) for k in want)


def test_a_search_fits_a_forest_for_each_leaf_and_fold(spark, rows, monkeypatch):
    fitted = []
    pipeline = forest.pipeline
    monkeypatch.setattr(forest, "pipeline", lambda *a, **k: fitted.append(k) or pipeline(*a, **k))
    grid = {"numTrees": [3, 5], "maxDepth": [9, 2, 4], "minInstancesPerNode": [1, 5]}
    scores = forest.search_scores(rows, 3, grid)
    assert len(fitted) == 2 * 3
    n = {tuple(r)[:3]: r[3] for r in scores.groupBy(*grid).agg(F.sum("n").alias("n")).collect()}
    assert len(n) == 12 and set(n.values()) == {600}
