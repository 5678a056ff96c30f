"""Queries of data-quality jobs, distributions and small reports."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from faultline.functions.text import exact
from faultline.operators import quality, stats
from faultline.plans import derived
from faultline.plans.derived import sql
from faultline.sources.shared import small_or_not, staged
from faultline.streaming.incremental import lost_projects

from . import query


def _check(name: str, scope: str, observed: str, expected: str, tail: str) -> str:
    return f" SELECT '{name}' AS \"check\", {scope} AS scope, ({observed})::BIGINT AS observed, ({expected})::BIGINT AS expected, ({observed}) = ({expected}) AS ok {tail}"


@query("K1_columns", "SELECT 'missing_columns' AS \"check\", 'history' AS scope, 1::BIGINT AS observed, 0::BIGINT AS expected, false AS ok UNION ALL SELECT 'extra_columns', 'score', 1, 0, false")
def k1(spark, d):
    """Of a stored feature table that lacks a column and has another."""
    return quality.columns(staged(derived.features(spark, d).withColumnRenamed("history", "score"), "features"))


COLUMNS = ("project", "bug", "test_class", "test_method", "history", "same_package", "modified_classes_count", "label")


@query("K2_nulls", sql(" UNION ALL ".join(_check("nulls", f"'{c}'", f"count(*) - count({c})", "0", "FROM f") for c in COLUMNS)))
def k2(spark, d):
    return quality.nulls(derived.features(spark, d))


@query("K3_duplicate_keys", sql(", x AS (SELECT project, bug, test_method, count(*) AS n FROM l GROUP BY ALL)" + _check("duplicate_keys", "'project,bug,test_method'", "sum(n - 1)", "0", "FROM x")))
def k3(spark, d):
    return quality.duplicate_keys(derived.lines(spark, d), ["project", "bug", "test_method"])


@query("K3_duplicate_members", sql(" SELECT project, bug, test_class, test_method, count(*) AS n FROM l GROUP BY ALL HAVING count(*) > 1 ORDER BY project, bug, test_class, test_method LIMIT 10"))
def k3_members(spark, d):
    return quality.duplicate_members(derived.lines(spark, d))


def expected(spark, d):
    """Expected changes of each project: those found, and two more of one project."""
    n = derived.dates(spark, d).groupBy("project").agg(F.count("*").alias("n"))
    return n.withColumn("n", F.col("n") + F.when(F.col("project") == "MACHINERY", 2).otherwise(0))


@query("K4_projects", sql(", p AS (SELECT DISTINCT project FROM t)" + " SELECT 'projects' AS \"check\", coalesce(p.project, e.project) AS scope, (p.project IS NOT NULL)::BIGINT AS observed, (e.project IS NOT NULL)::BIGINT AS expected, (p.project IS NOT NULL) = (e.project IS NOT NULL) AS ok FROM p FULL JOIN (SELECT project FROM p WHERE project <> 'BUILDING' UNION ALL SELECT 'NONE') e ON p.project = e.project"))
def k4(spark, d):
    want = derived.dates(spark, d).select("project").distinct().where("project <> 'BUILDING'").union(spark.createDataFrame([("NONE",)], "project string"))
    return quality.projects(derived.features(spark, d), want)


def report(spark, d):
    """A build report: every change of the derived data is ok; two more of MACHINERY failed."""
    ok = derived.dates(spark, d).select("project", "bug", F.lit("ok").alias("status"))
    return ok.union(spark.createDataFrame([("MACHINERY", -1, "falhou"), ("MACHINERY", -2, "falhou")], "project string, bug long, status string"))


@query("J12_expected_changes", sql(", n AS (SELECT project, count(*) AS found FROM ch GROUP BY ALL) SELECT project, (found + CASE WHEN project = 'MACHINERY' THEN 2 ELSE 0 END)::BIGINT AS expected, found, CASE WHEN project = 'MACHINERY' THEN 2 ELSE 0 END::BIGINT AS absent, CASE WHEN project = 'MACHINERY' THEN 2 ELSE 0 END::BIGINT AS justified, true AS ok FROM n"))
def j12(spark, d):
    return quality.expected_changes(derived.features(spark, d), expected(spark, d), report(spark, d))


@query("K6_classes_present", sql(_check("classes_present", "'label'", "count(DISTINCT label)", "2", "FROM f")))
def k6(spark, d):
    return quality.classes_present(derived.features(spark, d))


@query("K7_domains", sql(_check("domain", "'same_package'", "count(*) FILTER (WHERE same_package NOT IN (0, 1))", "0", "FROM f") + " UNION ALL " + _check("domain", "'label'", "count(*) FILTER (WHERE label NOT IN (0, 1))", "0", "FROM f") + " UNION ALL " + _check("domain", "'history'", "count(*) FILTER (WHERE history < 0)", "0", "FROM f") + " UNION ALL " + _check("domain", "'modified_classes_count'", "count(*) FILTER (WHERE modified_classes_count < 0)", "0", "FROM f")))
def k7(spark, d):
    return quality.domains(derived.features(spark, d))


@query("K8_without_trigger", sql(", y AS (SELECT project, bug, max(label) AS y FROM f GROUP BY ALL)" + _check("without_trigger", "project", "count(*) FILTER (WHERE y = 0)", "0", "FROM y GROUP BY project")))
def k8(spark, d):
    return quality.without_trigger(derived.features(spark, d))


@query("K9_history_consistency", sql(_check("history_consistency", "'all'", "count(*) FILTER (WHERE label = 1 AND bug % 10 = 0)", "0", "FROM f")))
def k9(spark, d):
    spoiled = derived.features(spark, d).withColumn("history", F.col("history") + F.when((F.col("label") == 1) & (F.col("bug") % 10 == 0), 1).otherwise(0))
    return quality.history_consistency(spoiled, derived.dates(spark, d))


@query("K10_history_plausibility", sql(", h AS (SELECT project, count(*) FILTER (WHERE label = 1) AS positives, count(*) FILTER (WHERE label = 1 AND history = 0) AS first_detections, count(*) FILTER (WHERE label = 0 AND history > 0) AS negatives_with_history, max(history) AS max_history FROM f GROUP BY ALL) SELECT project, positives, first_detections, round_even(100.0::DOUBLE * first_detections / positives, 4) AS percent_first, negatives_with_history, max_history, first_detections < positives AND max_history <= positives AS plausible FROM h"))
def k10(spark, d):
    return quality.history_plausibility(derived.features(spark, d))


@query("K12_detection_sequence", sql(_check("detection_sequence", "'all'", "count(*) FILTER (WHERE k <> history)", "0", "FROM (SELECT f.history, row_number() OVER (PARTITION BY f.project, f.test_class, f.test_method ORDER BY q, f.bug) - 1 AS k FROM f JOIN t ON f.project = t.project AND f.bug = t.bug AND f.test_class = t.test_class AND f.test_method = t.test_method WHERE label = 1)")))
def k12(spark, d):
    return quality.detection_sequence(derived.features(spark, d), derived.dates(spark, d))


@query("K14_strategy_coverage", sql(", x AS (SELECT 'a' AS strategy, project, bug FROM ch UNION ALL SELECT 'b', project, bug FROM ch WHERE bug % 7 <> 0), e AS (SELECT project, bug, count(*) AS n FROM x GROUP BY ALL) SELECT 2::BIGINT AS strategies, count(*) AS changes, count(*) FILTER (WHERE n = 2) AS covered_by_all, count(*) = count(*) FILTER (WHERE n = 2) AS complete FROM e"))
def k14(spark, d):
    ch = derived.dates(spark, d).select("project", "bug")
    return stats.coverage(ch.select(F.lit("a").alias("strategy"), "*").union(ch.where("bug % 7 <> 0").select(F.lit("b").alias("strategy"), "*")))


KEYS_SQL = "SELECT project, bug, test_class, test_method, count(*) AS n FROM f GROUP BY ALL"
SEQUENCE = "SELECT f.history, row_number() OVER (PARTITION BY f.project, f.test_class, f.test_method ORDER BY q, f.bug) - 1 AS k FROM f JOIN t USING (project, bug, test_class, test_method) WHERE label = 1"
ALL_CHECKS = [_check(x, "''", "0", "0", "") for x in ("missing_columns", "extra_columns")] + [_check("nulls", f"'{c}'", f"count(*) - count({c})", "0", "FROM f") for c in COLUMNS]
ALL_CHECKS += [_check("duplicate_keys", "'project,bug,test_class,test_method'", "sum(n - 1)", "0", f"FROM ({KEYS_SQL})")]
ALL_CHECKS += [_check("domain", f"'{c}'", f"count(*) FILTER (WHERE {bad})", "0", "FROM f") for c, bad in (("same_package", "same_package NOT IN (0, 1)"), ("label", "label NOT IN (0, 1)"), ("history", "history < 0"), ("modified_classes_count", "modified_classes_count < 0"))]
ALL_CHECKS += [_check("classes_present", "'label'", "count(DISTINCT label)", "2", "FROM f"), _check("without_trigger", "project", "count(*) FILTER (WHERE y = 0)", "0", "FROM (SELECT project, bug, max(label) AS y FROM f GROUP BY ALL) GROUP BY project")]
ALL_CHECKS += [_check("history_consistency", "'all'", "0", "0", ""), _check("detection_sequence", "'all'", "count(*) FILTER (WHERE k <> history)", "0", f"FROM ({SEQUENCE})")]


@query("Q13_all_checks", sql(" UNION ALL ".join(ALL_CHECKS)))
def q13(spark, d):
    t, base = derived.ordered_and_changes(spark, d)
    return quality.all_checks(staged(derived.with_features(t, base, derived.deals(spark, d)), "features"), small_or_not(staged(base.select("project", "bug", "fixed_commit_date"), "dates")))


@query("A17_distinct_counts", sql(" SELECT count(DISTINCT project) AS projects, count(DISTINCT (project, bug)) AS changes, count(DISTINCT test_class) AS test_classes, count(DISTINCT (test_class, test_method)) AS tests FROM f"))
def a17(spark, d):
    return quality.distinct_counts(derived.features(spark, d))


@query("A18_history_shares", sql(" SELECT history AS value, count(*) AS n, round_even(100.0::DOUBLE * count(*) / sum(count(*)) OVER (), 4) AS percent FROM f GROUP BY history"))
def a18(spark, d):
    return stats.value_shares(derived.features(spark, d), "history")


@query("A18_same_package_of_positives", sql(" SELECT same_package AS value, count(*) AS n, round_even(100.0::DOUBLE * count(*) / sum(count(*)) OVER (), 4) AS percent FROM f WHERE label = 1 GROUP BY same_package"))
def a18_positives(spark, d):
    return stats.value_shares(derived.features(spark, d).where("label = 1"), "same_package")


def _profile(c: str) -> str:
    return f" SELECT '{c}' AS feature, count({c}) AS count, round_even(avg({c}), 8) AS mean, round_even(stddev_samp({c}), 8) AS std, min({c})::DOUBLE AS min, quantile_cont({c}, 0.25)::DOUBLE AS q25, quantile_cont({c}, 0.5)::DOUBLE AS median, quantile_cont({c}, 0.75)::DOUBLE AS q75, max({c})::DOUBLE AS max FROM f"


@query("A19_numeric_profile", sql(_profile("history") + " UNION ALL " + _profile("modified_classes_count")))
def a19(spark, d):
    return stats.numeric_profile(derived.features(spark, d), ["history", "modified_classes_count"])


@query("A21_project_summary", sql(", e AS (SELECT project, bug, count(*) AS n, sum(label)::BIGINT AS p FROM f GROUP BY ALL) SELECT project, count(*) AS changes, sum(n)::BIGINT AS instances, sum(p)::BIGINT AS triggers, count(*) FILTER (WHERE p = 0) AS no_trigger, (count(*) + CASE WHEN project = 'MACHINERY' OR project IS NULL THEN 2 ELSE 0 END)::BIGINT AS expected FROM e GROUP BY ROLLUP (project)"))
def a21(spark, d):
    return quality.change_counts(derived.features(spark, d), expected(spark, d))


@query("O3_most_frequent", sql(" SELECT modified_classes_count AS value, count(*) AS n FROM f GROUP BY ALL ORDER BY n DESC, value LIMIT 10"))
def o3(spark, d):
    counts = derived.features(spark, d).groupBy(F.col("modified_classes_count").alias("value")).agg(F.count("*").alias("n"))
    return counts.orderBy(F.desc("n"), "value").limit(10)


@query("O4_first_rows", sql(" SELECT project, bug, test_class, test_method, history FROM f WHERE history > 0 ORDER BY project, bug, test_class, test_method LIMIT 10"))
def o4(spark, d):
    keys = ["project", "bug", "test_class", "test_method"]
    return derived.features(spark, d).where("history > 0").select(*keys, "history").orderBy(*keys).limit(10)


@query("O5_declared_order", sql(", s AS (SELECT coalesce(project, 'Overall') AS scope, count(*) AS n FROM f GROUP BY GROUPING SETS ((), (project))) SELECT scope, n, row_number() OVER (ORDER BY scope <> 'Overall', scope) AS place FROM s"))
def o5(spark, d):
    n = derived.features(spark, d).rollup("project").agg(F.count("*").alias("n")).select(F.coalesce("project", F.lit("Overall")).alias("scope"), "n")
    return n.withColumn("place", F.row_number().over(Window.orderBy(F.col("scope") != "Overall", "scope")).cast("long"))  # one row for each scope


@query("U3_lost_projects", sql(" SELECT DISTINCT project FROM t WHERE project = 'FURNITURE'"))
def u3(spark, d):
    t = derived.tests(spark, d)
    return lost_projects(t, t.where("project <> 'FURNITURE'"))


@query("P3_scope_column", sql(" SELECT 'derived' AS source, project, count(*) AS n, count(DISTINCT bug) AS n_bugs FROM f GROUP BY project"))
def p3(spark, d):
    return derived.features(spark, d).groupBy("project").agg(F.count("*").alias("n"), F.count_distinct("bug").alias("n_bugs")).select(F.lit("derived").alias("source"), "*")


@query("P8_status_predicates", "SELECT conv_id, turn, length(trim(text)) > 0 AS filled FROM conversations WHERE role <> 'user' AND length(trim(coalesce(text, ''))) > 0")
def p8(spark, d):
    c = spark.read.parquet(f"{d}/conversations.parquet")
    return c.where("role <> 'user' and trim(text) <> ''").select("conv_id", "turn", (F.trim("text") != "").alias("filled"))


@query("A18_quality_labels", "SELECT quality AS value, count(*) AS n, round_even(100.0::DOUBLE * count(*) / sum(count(*)) OVER (), 4) AS percent FROM labels GROUP BY quality")
def a18_labels(spark, d):
    return stats.value_shares(spark.read.parquet(f"{d}/labels.parquet"), "quality").withColumn("percent", exact(F.col("percent"), 4))


@query("K5_found_changes", sql(", n AS (SELECT project, count(*) AS all_of, count(*) FILTER (WHERE fixed_commit_date % 7 <> 0) AS found FROM ch GROUP BY ALL), x AS (SELECT project, (all_of + CASE WHEN project = 'MACHINERY' THEN 2 ELSE 0 END)::BIGINT AS expected, found, CASE WHEN project = 'MACHINERY' THEN 2 ELSE 0 END::BIGINT AS justified FROM n) SELECT project, expected, found, expected - found AS absent, justified, expected - found = justified AS ok FROM x"))
def k5(spark, d):
    ch = derived.dates(spark, d)
    return quality.expected_changes(ch.where("fixed_commit_date % 7 <> 0"), expected(spark, d), report(spark, d))
