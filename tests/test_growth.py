"""Forms whose work grows no faster than their input: tables derived by part, lists beside parts, coarse state, fits on distinct rows."""

import gzip
import re

import pytest
from pyspark.sql import functions as F

from faultline.ml import forest
from faultline.operators import classify, features
from faultline.plans import derived, jobs
from faultline.queries import evaluation
from faultline.queries import features as feature_queries
from faultline.queries import incremental as incremental_queries
from faultline.queries import sources
from faultline.sources import files
from faultline.streaming import incremental

SALES = {
    "lineitem": ("l_orderkey long, l_partkey long, l_returnflag string, l_quantity double, l_discount double", [(1, 1, "R", 50.0, 0.1), (1, 1, "N", 1.0, 0.0), (1, 2, "N", 48.0, 0.1), (2, 1, "N", 1.0, 0.0), (2, 3, "R", 45.0, 0.09), (3, 9, "R", 50.0, 0.1), (9, 1, "R", 50.0, 0.1), (4, 2, "N", 1.0, 0.0), (None, 1, "N", 1.0, 0.0)]),
    "orders": ("o_orderkey long, o_custkey long, o_orderdate date", [(1, 1, "1995-02-01"), (2, 1, "1995-08-01"), (3, 1, "1997-01-01"), (4, 2, "1995-02-01"), (5, 7, "1995-02-01")]),
    "customer": ("c_custkey long, c_mktsegment string", [(1, "BUILDING"), (2, "MACHINERY")]),
    # part 2 twice as it is, part 3 under two names
    "part": ("p_partkey long, p_type string, p_brand string, p_name string", [(1, "A B", "Brand#1", "x y"), (2, "A B", "Brand#1", "z"), (2, "A B", "Brand#1", "z"), (3, "C", "Brand#2", "x"), (3, "C", "Brand#2", "y")]),
}


@pytest.fixture(scope="module")
def sales(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("sales"))
    for name, (schema, rows) in SALES.items():
        df = spark.createDataFrame(rows, schema.replace("date date", "date string").replace("o_orderdate date", "o_orderdate string"))
        if name == "orders":
            df = df.withColumn("o_orderdate", F.to_date("o_orderdate"))
        df.write.parquet(f"{d}/{name}.parquet")
    return d


def by_sql(sales, tail):
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    for name in SALES:
        c.execute(f"create view {name} as select * from read_parquet('{sales}/{name}.parquet/*.parquet')")
    return sorted(c.execute(derived.sql(tail)).fetchall(), key=repr)


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_derived_tables_on_odd_keys(spark, sales):
    keys = "project, bug, test_class, test_method"
    assert rows_of(derived.tests(spark, sales)) == by_sql(sales, f" SELECT {keys}, is_trigger FROM t")
    assert rows_of(derived.features(spark, sales)) == by_sql(sales, f" SELECT {keys}, history, same_package, modified_classes_count, label FROM f")
    changes = by_sql(sales, " SELECT project, bug, fixed_commit_date, modified_classes_count FROM ch")
    assert rows_of(derived.dates(spark, sales)) == [r[:3] for r in changes]
    for df in (derived.changes(spark, sales), derived.tests_and_changes(spark, sales)[1]):
        assert rows_of(df.select("project", "bug", "fixed_commit_date", F.size("modified_classes"))) == changes


def test_features_join_the_tables_once(spark, sales):
    plan = derived.features(spark, sales)._jdf.queryExecution().optimizedPlan().toString()
    assert "l_orderkey" not in plan and "o_orderkey" not in plan


def test_part_files_hold_a_list_once(spark, tmp_path):
    many = ";".join(f"p{i}.C{i}" for i in range(300))
    tests = spark.createDataFrame([("P", b, f"p{i}.T", f"m{i}", int(i == b)) for b in (1, 2) for i in range(100)], "project string, bug long, test_class string, test_method string, is_trigger int")
    lists = spark.createDataFrame([("P", 1, many, 300), ("P", 2, None, 0)], "project string, bug long, modified_classes string, modified_classes_count int")
    files.write_part(tests.where("bug = 1"), lists.where("bug = 1").withColumn("modified_classes", F.lit("q.Old")), f"{tmp_path}/intermediate_a.csv")
    files.write_part(tests, lists, f"{tmp_path}/intermediate_b.csv")
    written = b"".join(gzip.decompress(p.read_bytes()) for p in tmp_path.glob("*/part-*.gz"))
    assert written.count(many.encode()) == 1
    assert {tuple(r) for r in files.part_counts(files.read_parts(spark, f"{tmp_path}/intermediate_*.csv")).collect()} == {("intermediate_a.csv", 100), ("intermediate_b.csv", 200)}
    assert {(r["part"], r["bug"], len(r["modified_classes"] or "")) for r in files.read_part_lists(spark, f"{tmp_path}/intermediate_*.csv").collect()} == {("intermediate_a.csv", 1, 5), ("intermediate_b.csv", 1, len(many)), ("intermediate_b.csv", 2, 0)}
    dates = spark.createDataFrame([("P", 1, 10), ("P", 2, 20)], "project string, bug long, fixed_commit_date long")
    merged = jobs.merge_parts(spark, f"{tmp_path}/intermediate_*.csv", dates)
    found = merged.groupBy("bug").agg(F.count("*").alias("n"), F.sum("same_package").alias("same"), F.max("modified_classes_count").alias("most"), F.sum("history").alias("h"), F.sum("label").alias("y"))
    assert rows_of(found) == [(1, 100, 100, 300, 0, 1), (2, 100, 0, 0, 1, 1)]


def test_part_queries_on_odd_keys(spark, sales):
    counts = by_sql(sales, " SELECT t.project, t.bug, modified_classes_count, count(*) FROM t JOIN ch ON t.project = ch.project AND t.bug = ch.bug GROUP BY ALL")
    assert rows_of(sources.s3_lists(spark, sales)) == counts
    assert rows_of(sources.q5(spark, sales)) == by_sql(sales, f" SELECT {sources.F_COLUMNS} FROM f")


def test_same_package_opens_a_list_once(spark, sales):
    out = feature_queries.f5(spark, sales)
    assert rows_of(out) == by_sql(sales, " SELECT project, bug, sum(same_package)::BIGINT FROM f GROUP BY ALL")
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("exists(") < plan.index("explode(")  # the lists are opened below, and met package by package


def test_fits_read_the_instances_once(spark, monkeypatch):
    rows = [("P", i % 12, "c", f"m{i}", int(i % 7 == 0), int(i % 5 == 0), i % 3, int(i % 5 == 0 and i % 12 < 9 or i % 31 == 0)) for i in range(3000)]
    df = spark.createDataFrame(rows, "project string, bug long, test_class string, test_method string, history long, same_package int, modified_classes_count int, label int")
    fitted = []
    copies = forest.weighted_copies
    monkeypatch.setattr(forest, "weighted_copies", lambda d, *n: fitted.append(copies(d, *n)) or fitted[-1])
    params = {"numTrees": 10, "maxDepth": 4}
    model = forest.fit(df, **params)
    n_distinct = df.select(*forest.FEATURE_COLUMNS, "label").distinct().count()
    assert fitted[0].count() <= forest.FIT_COPIES * n_distinct < 3000
    by_label = {r["label"]: r["w"] for r in fitted[0].groupBy("label").agg(F.sum("weight").alias("w")).collect()}
    assert by_label == {0: pytest.approx(1500), 1: pytest.approx(1500)}
    # against a fit on all instances, and each variant against a fit and an ordering of its own
    whole = forest.pipeline(**params).fit(classify.balanced_weights(df))
    cells = df.select(*forest.FEATURE_COLUMNS).distinct()
    both = forest.score(model, cells).join(forest.score(whole, cells).withColumnRenamed("score", "other"), forest.FEATURE_COLUMNS)
    assert both.agg(F.max(F.abs(F.col("score") - F.col("other")))).first()[0] < 0.1
    found = {tuple(r) for r in forest.ablation(df, df, **params).collect()}
    each = [forest.forest_apfd(forest.score(forest.fit(df, features, **params), df)).select(F.lit(name), "*") for name, features in forest.VARIANTS.items()]
    assert found == {tuple(r) for part in each for r in part.collect()}
    folds = forest.fold_auc(df, 3, **params).collect()
    assert sorted(r["fold"] for r in folds) == [0, 1, 2] and sum(r["positives"] + r["negatives"] for r in folds) == 3000 and all(r["auc"] > 0.8 for r in folds)


def test_running_history_calls_by_bucket(spark, tmp_path, monkeypatch):
    schema = "project string, bug long, test_class string, test_method string, fixed_commit_date long, is_trigger long"
    rows = [("P" if i % 2 else None, b, f"c{i % 5}", f"m{i}", b, int((i + b) % 3 == 0)) for b in range(6) for i in range(40)]
    whole = {tuple(r) for r in features.history(spark.createDataFrame(rows, schema)).select("project", "bug", "test_method", "history").collect()}
    with incremental_queries.state_conf(spark):
        for k in range(2):  # the second batch's rows go on from the state of the first
            spark.createDataFrame([r for r in rows if r[1] // 3 == k], schema).write.mode("append").parquet(f"{tmp_path}/in")
            out = incremental.running_history(incremental.replay(spark, f"{tmp_path}/in", schema, 100), buckets=3)
            query = out.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/check").trigger(availableNow=True).start()
            query.awaitTermination()
            assert sum(s["numRowsTotal"] for s in query.lastProgress["stateOperators"]) <= 3  # not one for each of the 40 tests
    assert {tuple(r) for r in spark.read.parquet(f"{tmp_path}/out").select("project", "bug", "test_method", "history").collect()} == whole


def test_history_comes_from_the_dealing_by_part(spark, monkeypatch):
    """Rows by test are dealt by part into tasks of a bounded number of lines; their history needs no shuffle by test, and equals the window over tests."""
    d = "/root/testdata/sf0.001"
    plain = sorted(map(tuple, derived.features(spark, d).collect()))
    monkeypatch.setattr(derived, "TASK_LINES", 500)
    each = derived.each_test(spark, d)
    plan = each._jdf.queryExecution().executedPlan().toString()
    assert derived.deals(spark, d) == [-(-spark.read.parquet(f"{d}/lineitem.parquet").count() // 500)] and "Window" in plan
    assert not re.search(r"hashpartitioning\((project|test_class)", plan) and "hashpartitioning(part#" in plan
    assert sorted(map(tuple, derived.features(spark, d).collect())) == plain
    again = features.history(each.drop("history"))
    assert each.exceptAll(again.select(*each.columns)).isEmpty()
    names = derived.test_names(spark, d)
    assert sorted(map(tuple, names.collect())) == sorted(map(tuple, each.select(*names.columns).distinct().collect()))


def test_streams_deal_more_files_not_larger_ones(spark, monkeypatch):
    d = "/root/testdata/sf0.001"
    assert incremental_queries.shares(spark, d, 4) == 1
    monkeypatch.setattr(derived, "TASK_LINES", 500)
    n = derived.deals(spark, d)[0]
    assert n > 8 and incremental_queries.shares(spark, d, 4) == -(-n // 4) and incremental_queries.shares(spark, d, 40) == -(-n // 40)


def test_random_orders_read_no_features(spark, sales):
    """The random strategy's rows are those of the feature table, nulls among the keys left out, with neither history nor packages derived for them."""
    keys = "project, bug, test_class, test_method"
    assert rows_of(derived.labelled(spark, sales)) == by_sql(sales, f" SELECT {keys}, label FROM f")
    plan = derived.labelled(spark, sales)._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and "regexp" not in plan
    assert evaluation.a3.__code__.co_names.count("labelled") == evaluation.x1.__code__.co_names.count("labelled") == 1


def test_distinct_tests_are_not_grouped_by_name(spark, sales):
    keys = "project, test_class, test_method"
    assert rows_of(derived.test_names(spark, sales)) == by_sql(sales, f" SELECT DISTINCT {keys} FROM t")
    plan = derived.test_names(spark, sales)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.lstrip().startswith("Project") and plan.splitlines()[1].lstrip("+- ").startswith("Join")


def test_packages_are_met_in_even_deals(spark, sales, monkeypatch):
    """Where rows are many, the join by package is dealt like the other steps, not to the session's number of partitions."""
    few = rows_of(derived.features(spark, sales))
    monkeypatch.setattr(derived, "TASK_LINES", 1)
    assert derived.deals(spark, sales) == [9]
    f = derived.features(spark, sales)
    assert rows_of(f) == few and f._jdf.queryExecution().optimizedPlan().toString().count("RepartitionByExpression [project") == 2
