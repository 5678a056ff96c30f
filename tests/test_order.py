"""Orderings and their score on hand-made changes, and properties."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from faultline.operators import order

SCHEMA = "project string, bug long, test_class string, test_method string, history long, same_package int, modified_classes_count int, label int"


def change(labels, bug=1):
    return [("P", bug, "a.b.T", f"t{i:03d}", 0, 0, 1, y) for i, y in enumerate(labels)]


@pytest.mark.parametrize(("labels", "expected"), [([1, 0, 0, 0], 0.875), ([0, 0, 0, 1], 0.125), ([0, 1, 1, 0], 0.625), ([0, 0, 0], None)])
def test_apfd_cases(spark, labels, expected):
    df = spark.createDataFrame(change(labels), SCHEMA)
    a = order.apfd(order.priority_rank(df, F.col("history"))).first()
    b = order.apfd_unsorted(df, order.score_key(F.col("history"))).first()
    assert a["apfd"] == expected and b["apfd"] == expected
    assert (a["n_tests"], a["n_trigger_tests"]) == (len(labels), sum(labels)) == (b["n_tests"], b["n_trigger_tests"])


def test_ties_go_by_method_then_class(spark):
    df = spark.createDataFrame([("P", 1, "b", "x", 0, 0, 0, 0), ("P", 1, "a", "x", 0, 0, 0, 0), ("P", 1, "z", "a", 0, 0, 0, 0), ("P", 1, "q", "z", 2, 0, 0, 1)], SCHEMA)
    rows = order.priority_rank(df, F.col("history")).orderBy("priority").collect()
    assert [r["test_class"] for r in rows] == ["q", "z", "a", "b"]


@settings(max_examples=8, deadline=None)
@given(st.lists(st.lists(st.tuples(st.integers(0, 3), st.integers(0, 1)), min_size=1, max_size=12), min_size=1, max_size=5))
def test_forms_agree_and_stay_in_bounds(spark, changes):
    rows = [("P", b, "c", f"m{i:02d}", s, 0, 0, y) for b, tests in enumerate(changes) for i, (s, y) in enumerate(tests)]
    df = spark.createDataFrame(rows, SCHEMA)
    a = {r["bug"]: r["apfd"] for r in order.apfd(order.priority_rank(df, F.col("history"))).collect()}
    b = {r["bug"]: r["apfd"] for r in order.apfd_unsorted(df, order.score_key(F.col("history"))).collect()}
    assert a == b
    both = order.apfd_by_scores(df, {"up": F.col("history"), "down": -F.col("history")})
    assert {r["bug"]: r["apfd"] for r in both.where("strategy = 'up'").collect()} == a
    assert {r["bug"]: r["apfd"] for r in both.where("strategy = 'down'").collect()} == {r["bug"]: r["apfd"] for r in order.apfd(order.priority_rank(df, -F.col("history"))).collect()}
    for bug, tests in enumerate(changes):
        n = len(tests)
        ranked = sorted(range(n), key=lambda i: (-tests[i][0], i))
        first = next((k for k, i in enumerate(ranked, 1) if tests[i][1]), None)
        assert a[bug] == (None if first is None else pytest.approx(1 - first / n + 1 / (2 * n)))
        assert first is None or 1 / (2 * n) - 1e-12 <= a[bug] <= 1 - 1 / (2 * n) + 1e-12


def test_random_order_is_near_its_expectation(spark):
    n, m = 40, 3
    rows = [x for b in range(20) for x in change([1] * m + [0] * (n - m), b)] + change([0, 0], 99)
    by_seed = order.random_apfd(spark.createDataFrame(rows, SCHEMA), 30)
    mean = by_seed.agg(F.avg("apfd")).first()[0]
    assert mean == pytest.approx(1 - (n + 1) / (n * (m + 1)) + 1 / (2 * n), abs=0.02)
    assert by_seed.where("bug = 99 and apfd is null").count() == 30
    assert order.seed_summary(by_seed).where("bug = 99").first()["apfd_mean"] is None


def test_empty_table(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert order.apfd(order.priority_rank(df, F.col("history"))).count() == order.apfd_unsorted(df, order.score_key(F.col("history"))).count() == order.random_apfd(df).count() == 0
