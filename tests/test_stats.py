"""Statistics, classification, quality, incremental builds and the forest on hand-made inputs."""

import pytest
from pyspark.sql import functions as F

from faultline.ml import forest
from faultline.operators import classify, features, quality, stats
from faultline.plans import jobs
from faultline.schema import FEATURES
from faultline.sources import files
from faultline.queries.incremental import state_conf
from faultline.streaming import incremental

LONG = "strategy string, project string, bug long, apfd double"


def two(spark, a, b):
    return spark.createDataFrame([(s, "P", i, x) for s, xs in (("A", a), ("B", b)) for i, x in enumerate(xs)], LONG)


def test_signed_rank_of_equal_signs(spark):
    r = stats.wilcoxon(two(spark, [0.1 * i for i in range(1, 9)], [0.0] * 8), ["A", "B"]).first()
    assert (r["w"], r["wins_a"], r["ties"]) == (0, 8, 0)
    assert r["z"] == pytest.approx(-2.5205041512504174) and r["p_value"] == pytest.approx(0.0117186856) and r["significant"]


def test_known_p_value(spark):
    df = spark.createDataFrame([((1830 - 89 * 90 / 4) / (89 * 90 * 179 / 24) ** 0.5,)], "z double")
    assert df.select(stats.two_sided_p("z")).first()[0] == pytest.approx(0.480342549658587)


def test_identical_series_are_not_tested(spark):
    r = stats.wilcoxon(two(spark, [0.5, 0.6], [0.5, 0.6]), ["A", "B"]).first()
    assert r["identical"] and r["p_value"] is None and not r["significant"] and r["ties"] == 2


def test_ties_at_ten_places(spark):
    r = stats.wins(stats.pairs(two(spark, [0.1 + 0.2, 0.4, None], [0.3, 0.5, 0.1]), ["A", "B"])).first()
    assert (r["wins_a"], r["wins_b"], r["ties"], r["n_pairs"]) == (0, 1, 1, 2)


def test_best_and_worst(spark):
    names = ["History", "Random", "RF", "same_package"]
    df = spark.createDataFrame([("P", 1, 0.84, 0.51, 0.84, 0.96), ("P", 2, 0.9, 0.1, 0.9, 0.1)], "project string, bug long, " + ", ".join(f"{n} double" for n in names))
    rows = {r["bug"]: (r["best"], r["worst"]) for r in stats.best_and_worst(df, names).collect()}
    assert rows == {1: ("same_package", "Random"), 2: ("History / RF", "Random / same_package")}


def test_repeated_result_breaks_the_pivot(spark):
    df = spark.createDataFrame([("A", "P", 1, 0.5), ("A", "P", 1, 0.6)], LONG)
    assert stats.duplicates(df).count() == 1
    with pytest.raises(Exception, match="twice"):
        stats.wide(df, ["A"]).collect()


def test_wide_keeps_missing_as_null(spark):
    df = spark.createDataFrame([("A", "P", 1, 0.5), ("B", "P", 2, None)], LONG)
    assert {tuple(r) for r in stats.wide(df, ["A", "B"]).collect()} == {("P", 1, 0.5, None), ("P", 2, None, None)}


def test_auc_counts_ties_half(spark):
    df = spark.createDataFrame([(0.9, 1), (0.5, 1), (0.5, 0), (0.1, 0)], "score double, label int")
    assert classify.auc(df).first()["auc"] == pytest.approx(0.875)
    assert classify.auc(df.where("label = 1")).first()["auc"] is None


def test_no_predicted_positive(spark):
    df = spark.createDataFrame([("P", 1, 0, 1), ("P", 1, 0, 0)], "project string, bug long, predicted int, label int")
    r = classify.scores_of(classify.confusion(df)).where("scope = 'Overall'").first()
    assert (r["precision"], r["recall"], r["f1"], r["fn"], r["tn"]) == (0, 0, 0, 1, 1)


def test_folds_keep_changes_whole_and_even(spark):
    df = spark.range(1000).select(F.lit("P").alias("project"), (F.col("id") % 23).alias("bug"), F.lit(0).alias("label"))
    f = classify.group_folds(df, 5)
    assert f.count() == 23
    sizes = [r[1] for r in f.groupBy("fold").agg(F.sum("size")).collect()]
    assert len(sizes) == 5 and max(sizes) - min(sizes) < 100


def test_specs(spark):
    df = spark.createDataFrame([("Lang:3,28-30",), ("Lang: 3",)], "spec string")
    assert sorted(r["bug"] for r in incremental.parse_specs(df).collect()) == [3, 28, 29, 30]
    with pytest.raises(Exception, match="malformed"):
        incremental.parse_specs(spark.createDataFrame([("Lang 3",)], "spec string")).collect()
    with pytest.raises(Exception, match="backwards"):
        incremental.parse_specs(spark.createDataFrame([("Lang:5-3",)], "spec string")).collect()
    changes = spark.createDataFrame([("P", i) for i in range(9)] + [("Q", 7)], "project string, bug long")
    assert sorted(map(tuple, incremental.id_range(changes, "6-7").collect())) == [("P", 6), ("P", 7), ("Q", 7)] and incremental.id_range(changes, "7").count() == 2
    with pytest.raises(ValueError, match="backwards"):
        incremental.id_range(changes, "5-3")
    assert sorted(map(tuple, incremental.first_changes(changes, 2).collect())) == [("P", 0), ("P", 1), ("Q", 7)]


TESTS = "project string, bug long, test_class string, test_method string, fixed_commit_date long, is_trigger long"


def test_running_history_equals_batch(spark, tmp_path):
    rows = [("P", b, "c", f"m{b % 2}", b // 2, int(b % 3 == 0)) for b in range(12)]
    df = spark.createDataFrame(rows, TESTS)
    for k in range(3):
        df.where(f"bug div 4 = {k}").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = incremental.replay(spark, f"{tmp_path}/in", TESTS, 1)
    incremental.running_history(stream).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/check").trigger(availableNow=True).start().awaitTermination()
    key = ["bug", "test_method", "history"]
    assert sorted(map(tuple, spark.read.parquet(f"{tmp_path}/out").select(*key).collect())) == sorted(map(tuple, features.history(df).select(*key).collect()))


@pytest.mark.parametrize("restored", [True, False])
def test_expired_state_comes_back_from_the_sink(spark, tmp_path, restored):
    rows = [("P", b, "c", f"m{b % 2}", b, int(b % 3 == 0)) for b in range(12)]
    df = spark.createDataFrame(rows, TESTS)
    for k in range(2):
        df.where(f"bug div 6 = {k}").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        sink = spark.read.parquet(f"{tmp_path}/out") if k and restored else None
        stream = incremental.running_history(incremental.replay(spark, f"{tmp_path}/in", TESTS, 1), 1, sink)
        with state_conf(spark):
            stream.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/check").trigger(availableNow=True).start().awaitTermination()
    key = ["bug", "test_method", "history"]
    found = sorted(map(tuple, spark.read.parquet(f"{tmp_path}/out").select(*key).collect()))
    batch = features.history(df) if restored else features.history(df.where("bug < 6")).unionByName(features.history(df.where("bug >= 6")))
    assert found == sorted(map(tuple, batch.select(*key).collect()))  # without the sink the second half starts from nothing: the state was gone


def test_late_change_rewrites_later_history(spark):
    df = spark.createDataFrame([("P", 1, "c", "m", 1, 1), ("P", 2, "c", "m", 2, 1), ("P", 3, "c", "m", 3, 0), ("Q", 1, "c", "m", 1, 1)], TESTS)
    first = features.history(df.where("bug <> 2"))
    again = incremental.recompute_late(first, df.where("bug = 2").withColumn("history", F.lit(0)))
    assert sorted(map(tuple, again.select("project", "bug", "history").collect())) == [("P", 1, 0), ("P", 2, 1), ("P", 3, 2), ("Q", 1, 0)]


def test_upsert_and_lost_projects(spark):
    old = spark.createDataFrame([("P", 1, 0), ("P", 2, 0), ("Q", 1, 0)], "project string, bug long, x int")
    new = spark.createDataFrame([("P", 2, 9)], "project string, bug long, x int")
    assert sorted(map(tuple, incremental.upsert(old, new).collect())) == [("P", 1, 0), ("P", 2, 9), ("Q", 1, 0)]
    assert [r[0] for r in incremental.lost_projects(old, new).collect()] == ["Q"]
    assert incremental.no_project_lost(new, old) is old
    with pytest.raises(ValueError, match="lost: Q"):
        incremental.no_project_lost(old, new)


def test_consolidation_writes_all_tables(spark, tmp_path):
    rows = [(s, p, b, x) for s, d in (("A", 0.0), ("B", 0.1)) for p in "PQ" for b in range(4) for x in [0.1 * b + d * (b > 1)]]
    long = spark.createDataFrame(rows, LONG)
    found = jobs.consolidate(long, ["A", "B"], f"{tmp_path}/out")
    assert {k: spark.read.parquet(f"{tmp_path}/out/{k}").count() for k in found} == {"long": 16, "wide": 8, "descriptive": 6, "best": 2, "pairwise": 1}
    assert {r["best"]: r["n"] for r in found["best"].collect()} == {"A / B": 4, "B": 4}
    one = found["pairwise"].first()
    assert (one["wins_a"], one["wins_b"], one["ties"]) == (0, 4, 4) and one["p_value"] == stats.wilcoxon(long, ["A", "B"]).first()["p_value"]


def test_sources(spark, tmp_path):
    rows = [("P", 1, "a.T", "m", 0, 1, 2, 1), ("Q", 2, "a.T", "n,x", 1, 0, 0, 0)]
    df = spark.createDataFrame(rows, FEATURES)
    files.overwrite(df, f"{tmp_path}/f.csv", "csv")
    assert sorted(map(tuple, files.read_features(spark, f"{tmp_path}/f.csv").collect())) == rows
    assert files.done_keys(spark, f"{tmp_path}/none").count() == 0
    assert files.active_changes(spark, f"{tmp_path}/*/active-bugs.csv").count() == 0
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        files.read_dates(spark, f"{tmp_path}/none.csv")
    (tmp_path / "props" / "P" / "7").mkdir(parents=True)
    (tmp_path / "props" / "P" / "7" / "tests.trigger").write_text("a.T::m")
    assert tuple(files.read_properties(spark, f"{tmp_path}/props/*/*/*").first()) == ("P", 7, "tests.trigger", "a.T::m")


def test_quality_checks_find_what_is_wrong(spark):
    df = spark.createDataFrame([("P", 1, "a", "m", 0, 2, 1, 0), ("P", 1, "a", "m", -1, 0, None, 0)], FEATURES)
    dates = spark.createDataFrame([("P", 1, 1)], "project string, bug long, fixed_commit_date long")
    bad = {(r["check"], r["scope"]) for r in quality.all_checks(df, dates).where("not ok").collect()}
    assert bad == {("nulls", "modified_classes_count"), ("duplicate_keys", "project,bug,test_class,test_method"), ("domain", "same_package"), ("domain", "history"), ("classes_present", "label"), ("without_trigger", "P"), ("history_consistency", "all")}


def test_one_feature_forest_orders_like_its_feature(spark, tmp_path):
    rows = [("P", b, "c", f"m{i:02d}", 0, int(i % 4 == b % 4), 1, int(i % 4 == b % 4 and i < 8)) for b in range(8) for i in range(16)]
    df = spark.createDataFrame(rows, FEATURES)
    model = forest.fit(df, ["same_package"], numTrees=5, maxDepth=3, minInstancesPerNode=1)
    scored = forest.score(model, df)
    from faultline.operators.order import apfd, priority_rank

    baseline = {r["bug"]: r["apfd"] for r in apfd(priority_rank(df, F.col("same_package"))).collect()}
    assert {r["bug"]: r["apfd"] for r in forest.forest_apfd(scored).collect()} == baseline
    forest.save(model, {"params": {"numTrees": 5, "maxDepth": 3}}, f"{tmp_path}/m")
    assert forest.load(spark, f"{tmp_path}/m")[1]["params"]["numTrees"] == 5
    forest.save(model, {"params": {"numTrees": 6}}, f"{tmp_path}/m")
    with pytest.raises(ValueError, match="other params"):
        forest.load(spark, f"{tmp_path}/m")
