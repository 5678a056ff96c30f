"""Forms that spread work over tasks: global ranks, doubling closures, quantiles from counts, searches over weighted distinct rows, numpy's orders."""

import random
import statistics

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from faultline.ml import forest
from faultline.operators import enumerate_tests, order, rank, stats
from faultline.schema import FEATURES
from faultline.sources import files

LONG = "strategy string, project string, bug long, apfd double, n_tests long, n_trigger_tests long"


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("n", [0, 1, 500])
def test_global_rank(spark, n):
    keys = list(range(n))
    random.Random(n).shuffle(keys)
    df = spark.createDataFrame([(k % 7, k, "x") for k in keys], "a long, b long, rank string").repartition(5)
    out = rank.global_rank(df, [F.desc("a"), "b"], "place", 6)
    assert [(r["a"], r["b"], r["place"]) for r in out.orderBy("place").collect()] == [(a, b, i) for i, (a, b) in enumerate(sorted(((k % 7, k) for k in keys), key=lambda x: (-x[0], x[1])))]
    assert "Window" not in plan(out)


def test_export_is_in_order_over_its_files(spark, tmp_path):
    df = spark.createDataFrame([(f"P{k % 4}", k) for k in range(200)], "project string, bug long").repartition(7)
    files.export_sorted(df, f"{tmp_path}/x", ["project", "bug"], ["project", "bug"], 4)
    parts = sorted((tmp_path / "x").glob("part-*.csv"))
    lines = [line for p in parts for line in p.read_text().splitlines()[1:]]
    assert len(parts) == 4 and lines == [f"{p},{b}" for p, b in sorted((f"P{k % 4}", k) for k in range(200))]


def chains(edges, depth=20):
    up = dict(edges)
    out = set()
    for c in up:
        a, d = c, 0
        while d < depth:
            out.add((c, a, d))
            a, d = up.get(a), d + 1
            if a not in up:
                break
    return out


@settings(max_examples=10, deadline=None)
@given(st.lists(st.integers(-1, 30), min_size=1, max_size=30))
def test_closure_by_doubling(spark, over):
    edges = [(f"c{i}", f"c{o}" if o >= 0 else None) for i, o in enumerate(over)]  # chains, trees, cycles, missing classes
    closure = enumerate_tests.superclass_closure(spark.createDataFrame(edges, "class_name string, superclass string"))
    rows = closure.collect()
    assert {tuple(r) for r in rows} == chains(edges) and len(rows) == len(chains(edges))
    cyclic = {c: min(d for x, a, d in chains(edges) if x == c == a and d) for c, a, d in chains(edges) if c == a and d}
    assert dict(map(tuple, enumerate_tests.cyclic_classes(closure).collect())) == cyclic


def test_long_chain_takes_five_joins(spark, monkeypatch):
    written = []
    staged = enumerate_tests.staged
    monkeypatch.setattr(enumerate_tests, "staged", lambda df, name: written.append(name) or staged(df, name))
    edges = [(f"c{i}", f"c{i + 1}") for i in range(60)]
    closure = enumerate_tests.superclass_closure(spark.createDataFrame(edges, "class_name string, superclass string"))
    assert closure.agg(F.max("depth")).first()[0] == 19 and len(written) <= 6  # the direct superclasses, and five rounds


@settings(max_examples=10, deadline=None)
@given(st.lists(st.tuples(st.sampled_from("PQ"), st.one_of(st.none(), st.integers(0, 12))), min_size=0, max_size=40))
def test_statistics_from_counts(spark, values):
    rows = [("s", p, i, None if v is None else v / 12, 1, 1) for i, (p, v) in enumerate(values)]
    long = spark.createDataFrame(rows, LONG)
    found = {r["scope"]: r for r in stats.describe_by_scope(long, 9).collect()}
    boxes = {r["scope"]: r for r in stats.boxplot(long).collect()}
    far = [tuple(r) for r in stats.outliers(long).select("scope", "bug").collect()]
    for scope in found:
        x = [r[3] for r in rows if r[3] is not None and scope in (stats.OVERALL, r[1])]
        r = found[scope]
        assert r["count"] == len(x)
        if not x:
            assert r["mean"] is None and r["median"] is None and scope not in boxes
            continue
        close = {"mean": np.mean(x), "median": np.median(x), "q25": np.quantile(x, 0.25), "q75": np.quantile(x, 0.75), "min": min(x), "max": max(x)}
        assert all(r[k] == pytest.approx(v, abs=1e-8) for k, v in close.items())
        assert r["std"] == (pytest.approx(statistics.stdev(x), abs=1e-7) if len(x) > 1 else None)
        q1, q3 = np.quantile(x, 0.25), np.quantile(x, 0.75)
        inside = [v for v in x if q1 - 1.5 * (q3 - q1) - 1e-9 <= v <= q3 + 1.5 * (q3 - q1) + 1e-9]
        assert (boxes[scope]["whisker_low"], boxes[scope]["whisker_high"], boxes[scope]["n_outliers"]) == (min(inside), max(inside), len(x) - len(inside))
        assert sum(s == scope for s, _ in far) == len(x) - len(inside)
    for df in (stats.describe_by_scope(long), stats.boxplot(long), stats.strategy_summary(long), stats.numeric_profile(long, ["apfd"])):
        assert "percentile" not in plan(df) and "collect_list" not in plan(df)
    assert stats.strategy_summary(long).first()["count"] == sum(v is not None for _, v in values)


def instances(seed=1, n=1200):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        h, s, m = rng.choice((0, 0, 0, 1, 2)), int(rng.random() < 0.2), rng.choice((1, 2, 3))
        rows.append(("P", i % 40, "c", f"m{i}", h, s, m, int(rng.random() < 0.02 + 0.3 * s + 0.1 * h)))
    return rows


def test_copies_keep_weights_and_small_leaves(spark):
    df = spark.createDataFrame(instances(), FEATURES)
    distinct = forest.distinct_rows(df)
    copies = forest.weighted_copies(distinct)
    assert distinct.agg(F.sum("n")).first()[0] == 1200
    by_label = {r["label"]: r["w"] for r in copies.groupBy("label").agg(F.sum("weight").alias("w")).collect()}
    assert by_label[0] == pytest.approx(600) and by_label[1] == pytest.approx(600)
    n = {tuple(r[:-1]): r[-1] for r in distinct.collect()}
    held = {tuple(r[:-1]): r[-1] for r in copies.groupBy(*forest.FEATURE_COLUMNS, "label").count().collect()}
    assert held == {k: min(v, forest.COPIES) for k, v in n.items()} and max(forest.GRID["minInstancesPerNode"]) <= forest.COPIES
    assert forest.grown([500, 100, 200]) == [(100, 42), (100, 43), (300, 44)]


@pytest.mark.parametrize("scoring", ["f1", "roc_auc"])
def test_search_over_distinct_rows_scores_like_all_instances(spark, scoring):
    df = spark.createDataFrame(instances(), FEATURES)
    grid = {"numTrees": [10, 20], "maxDepth": [2, 5], "minInstancesPerNode": [1, 5]}
    model, report, table = forest.grid_search(df, scoring, 3, grid)
    mine = {(r["numTrees"], r["maxDepth"], r["minInstancesPerNode"]): r["score"] for r in table.collect()}
    theirs = {tuple(p[k] for k in grid): s for p, s in forest.cross_validated(df, scoring, 3, grid)}
    assert mine.keys() == theirs.keys() and all(abs(mine[k] - theirs[k]) < 0.05 for k in mine)
    assert report["score"] == max(mine.values()) and model.stages[-1].getNumTrees == report["params"]["numTrees"]


def test_setting_scores_are_those_of_the_counted_rows(spark):
    rows = [(10, 2, 1, f, y, n, s) for f in range(2) for y, n, s in ((1, 3, 0.9), (0, 2, 0.9), (1, 1, 0.5), (0, 5, 0.1))]
    scores = spark.createDataFrame(rows, "numTrees int, maxDepth int, minInstancesPerNode int, fold int, label int, n long, score double")
    assert forest.setting_scores(scores, "f1").first()["score"] == pytest.approx(2 * 3 / (2 * 3 + 2 + 1))
    wins = 3 * (5 + 2 / 2) + 1 * 5
    assert forest.setting_scores(scores, "roc_auc").first()["score"] == pytest.approx(wins / (4 * 7))


def test_numpy_orders(spark):
    rows = [("P", 1, f"c{i % 3}", f"m{i}", 0, 0, 0, int(i in (2, 5))) for i in range(9)] + [("P", 2, "c", "m", 0, 0, 0, 1), ("Q", 1, "c", "m", 0, 0, 0, 0)]
    rows += [("R", 1, "c", f"m{i}", 0, 0, 0, int(i in (2, 5))) for i in range(9)]
    found = {(r["project"], r["bug"]): r for r in order.numpy_random_apfd(spark.createDataFrame(rows, FEATURES).repartition(5), 3).collect()}
    labels = np.array([r[7] for r in sorted(rows[:9], key=lambda r: (r[2], r[3]))])
    each = []
    for seed in range(3):
        at = next(i + 1 for i, y in enumerate(np.random.default_rng(seed).permutation(labels)) if y)
        each.append(1 - at / 9 + 1 / 18)
    assert found["P", 1]["apfd_mean"] == pytest.approx(statistics.mean(each)) and found["P", 1]["apfd_std"] == pytest.approx(statistics.stdev(each))
    # by hand: numpy's orders of nine are 4 5 2 ..., 7 0 1 4 2 ... and 2 7 ...; tests 2 and 5 first come second, fifth and first
    assert found["R", 1]["apfd_mean"] == pytest.approx(((1 - 2 / 9) + (1 - 5 / 9) + (1 - 1 / 9)) / 3 + 1 / 18)
    assert (found["P", 2]["apfd_mean"], found["P", 2]["apfd_std"]) == (0.5, 0.0)
    assert tuple(found["Q", 1])[2:] == (None, None, 1, 0)
