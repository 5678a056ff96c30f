"""Queries that write a derived table in a source's form, read it back by the source, and return what it gives."""

from __future__ import annotations

from pyspark.sql import functions as F

from faultline.functions.text import semicolon_list
from faultline.operators import labels
from faultline.operators.rank import global_rank
from faultline.plans import derived
from faultline.plans.derived import sql
from faultline.plans.jobs import merge_parts
from faultline.schema import FEATURES
from faultline.sources import files, versions
from faultline.sources.shared import new_path, staged

from . import query
from .evaluation import SPLIT
from .features import meta_of

F_COLUMNS = "project, bug, test_class, test_method, history, same_package, modified_classes_count, label"


@query("S1_feature_csv", sql(f" SELECT {F_COLUMNS} FROM f"))
def s1(spark, d):
    path = new_path(spark, "features") + ".csv"
    files.overwrite(derived.features(spark, d), path, "csv")
    return files.read_features(spark, path)


@query("S9_feature_parquet", sql(f" SELECT {F_COLUMNS} FROM f WHERE same_package = 1"))
def s9(spark, d):
    path = new_path(spark, "features")
    files.overwrite(derived.features(spark, d), path)
    return files.read_features(spark, path).where("same_package = 1")


@query("S2_done_keys", sql(" SELECT DISTINCT project, bug FROM t"))
def s2(spark, d):
    """The keys that each commit writes beside its rows: a row for each change, not the sink's rows."""
    path = new_path(spark, "done")
    versions.append(derived.tests(spark, d), path)
    return versions.done_keys(spark, path).select("project", "bug")


def intermediate(spark, d):
    """(tests, staged; the ;-joined list of each change; their dates)."""
    t, ch = derived.tests_and_changes(spark, d)
    lists = ch.select("project", "bug", F.array_join("modified_classes", ";").alias("modified_classes"), F.size("modified_classes").alias("modified_classes_count"))
    return t, lists, ch.select("project", "bug", "fixed_commit_date")


@query("S3_part_files", sql(" SELECT 'intermediate_' || project || '.csv' AS part, count(*) AS rows FROM t GROUP BY ALL"))
def s3(spark, d):
    base = new_path(spark, "parts")
    t, lists, _ = intermediate(spark, d)
    lists = staged(lists, "lists")
    for (project,) in lists.select("project").distinct().collect():  # one part for each project
        files.write_part(*[df.where(F.col("project") == project) for df in (t, lists)], f"{base}/intermediate_{project}.csv")
    return files.part_counts(files.read_parts(spark, f"{base}/intermediate_*.csv"))


@query("S3_parts_modified_lists", sql(" SELECT t.project, t.bug, modified_classes_count AS listed, count(*) AS n FROM t JOIN ch ON t.project = ch.project AND t.bug = ch.bug GROUP BY ALL"))
def s3_lists(spark, d):
    path = new_path(spark, "parts") + "/intermediate_all.csv"
    t, lists, _ = intermediate(spark, d)
    files.write_part(t, lists, path)
    listed = files.read_part_lists(spark, path).select("project", "bug", F.size(semicolon_list(F.col("modified_classes"))).alias("listed"))
    return files.read_parts(spark, path).groupBy("project", "bug").agg(F.count("*").alias("n")).join(listed, ["project", "bug"]).select("project", "bug", "listed", "n")


@query("W5_last_attempt", sql(" SELECT project, bug, 'part2' AS part, CASE WHEN fixed_commit_date % 3 = 0 THEN 'ok' ELSE 'again' END AS status FROM ch WHERE fixed_commit_date % 2 = 0 UNION ALL SELECT project, bug, 'part1', 'first' FROM ch WHERE fixed_commit_date % 2 = 1"))
def w5(spark, d):
    ch = derived.dates(spark, d)
    one = ch.select("project", "bug", F.lit("part1").alias("part"), F.lit(0).alias("seq"), F.lit("first").alias("status"))
    two = ch.where("fixed_commit_date % 2 = 0").select("project", "bug", F.lit("part2").alias("part"), F.explode(F.sequence(F.lit(0), F.lit(1))).alias("seq"), "fixed_commit_date")
    two = two.withColumn("status", F.when(F.col("seq") == 0, "early").when(F.col("fixed_commit_date") % 3 == 0, "ok").otherwise("again")).drop("fixed_commit_date")
    return labels.last_attempt(one.unionByName(two), ["part", "seq"]).drop("seq")


@query("S4_split_file", sql(SPLIT + " SELECT side, project, bug FROM sp"))
def s4(spark, d):
    path = new_path(spark, "split")
    files.write_split(derived.features_and_split(spark, d)[1], path)
    return files.read_split(spark, path)


@query("S13_split_json", sql(SPLIT + " SELECT side, project, count(*) AS n, min(bug) AS first_id, max(bug) AS last_id FROM sp GROUP BY ALL"))
def s13(spark, d):
    value = files.split_json(derived.features_and_split(spark, d)[1])
    parsed = value.select(F.from_json("value", "train map<string,array<long>>, test map<string,array<long>>").alias("s"))
    sides = parsed.select(F.explode(F.create_map(F.lit("train"), F.col("s.train"), F.lit("test"), F.col("s.test"))).alias("side", "m")).select("side", F.explode("m").alias("project", "ids"))
    return sides.select("side", "project", F.size("ids").cast("long").alias("n"), F.get("ids", F.lit(0)).alias("first_id"), F.element_at("ids", -1).alias("last_id"))


@query("S5_commit_dates", sql(" SELECT project, bug, fixed_commit_date, 'r' || bug AS fixed_revision FROM ch"))
def s5(spark, d):
    path = new_path(spark, "dates")
    dates = derived.dates(spark, d).withColumn("fixed_revision", F.concat(F.lit("r"), F.col("bug")))
    files.export_sorted(dates, path, ["project", "bug", "fixed_commit_date", "fixed_revision"], ["project", "bug"])
    return files.read_dates(spark, path)


@query("S6_active_changes", sql(" SELECT project, bug, 'r' || bug AS revision FROM ch"))
def s6(spark, d):
    base = new_path(spark, "active")
    rows = derived.dates(spark, d).select("project", F.col("bug").alias("bug.id"), F.concat(F.lit("r"), F.col("bug")).alias("revision_id_fixed"))
    rows = staged(rows.withColumnRenamed("bug.id", "id"), "active")
    for (project,) in rows.select("project").distinct().collect():  # one list for each project
        rows.where(F.col("project") == project).select(F.col("id").alias("bug.id"), F.col("revision_id_fixed").alias("revision.id.fixed")).coalesce(1).write.option("header", True).csv(f"{base}/{project}/active-bugs.csv")
    return files.active_changes(spark, f"{base}/*/active-bugs.csv")


@query("S7_property_files", sql(", n AS (SELECT project, bug, sum(is_trigger * CASE WHEN bug % 4 = 0 THEN 2 ELSE 1 END)::INT AS n FROM t GROUP BY ALL) SELECT n.project, n.bug, n.n AS triggers, ch.modified_classes_count AS modified FROM n JOIN ch ON n.project = ch.project AND n.bug = ch.bug"))
def s7(spark, d):
    """Each change's properties as files at project/bug/property, read back."""
    base, meta = new_path(spark, "properties"), meta_of(spark, d)
    each = F.inline(F.array(*[F.struct(F.lit(p).alias("property"), F.concat(F.array_join(c, "\n"), F.lit("\n")).alias("content")) for p, c in labels.PROPERTIES.items()]))
    files.write_texts(meta.select("project", "bug", each).select(F.concat_ws("/", "project", "bug", "property").alias("path"), "content"), base)
    found = files.read_properties(spark, f"{base}/*/*/*")
    return labels.metadata(found).select("project", "bug", F.size("trigger_tests").alias("triggers"), F.size("modified_classes").alias("modified"))


@query("S10_append", sql(" SELECT project, count(*) AS n FROM t GROUP BY ALL"))
def s10(spark, d):
    path = new_path(spark, "sink")
    t = derived.tests(spark, d)
    files.append(t.where("bug % 2 = 0"), path)
    files.append(t.where("bug % 2 = 1"), path)
    return spark.read.parquet(path).groupBy("project").agg(F.count("*").alias("n"))


@query("S11_append_report", sql(" SELECT project, bug, 'ok' AS status, 1::BIGINT AS attempt FROM ch WHERE fixed_commit_date % 2 = 0 UNION ALL SELECT project, bug, 'falhou', 0 FROM ch WHERE fixed_commit_date % 2 = 1"))
def s11(spark, d):
    path = new_path(spark, "report")
    ch = derived.dates(spark, d)
    row = [F.lit("").alias("reason"), *[F.lit(0).cast("long").alias(c) for c in ("n_tests", "n_triggers_expected", "n_triggers_labeled")]]
    files.append_report(ch.select("project", "bug", F.lit("falhou").alias("status"), *row), path)
    files.append_report(ch.where("fixed_commit_date % 2 = 0").select("project", "bug", F.lit("ok").alias("status"), *row), path)
    return labels.last_attempt(spark.read.parquet(path), ["attempt"]).select("project", "bug", "status", "attempt")


@query("S12_sorted_export", sql(" SELECT row_number() OVER (ORDER BY project, bug) - 1 AS line, project, bug FROM ch"))
def s12(spark, d):
    """The export's lines in the order of its files."""
    path = new_path(spark, "export")
    files.export_sorted(derived.dates(spark, d), path, ["project", "bug"], ["project", "bug"], 3)
    texts = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("file"), F.posexplode(F.split(F.btrim("value", F.lit("\n")), "\n")).alias("pos", "v")).where("pos > 0")
    lines = global_rank(texts, ["file", "pos"], "line")
    return lines.select("line", F.get(F.split("v", ","), F.lit(0)).alias("project"), F.get(F.split("v", ","), F.lit(1)).cast("long").alias("bug"))


@query("Q5_merge_parts", sql(f" SELECT {F_COLUMNS} FROM f"))
def q5(spark, d):
    base = new_path(spark, "merge")
    t, lists, dates = intermediate(spark, d)
    lists = staged(lists, "lists")
    files.write_part(t.where("bug % 2 = 0"), lists.where("bug % 2 = 0"), f"{base}/intermediate_a.csv")
    files.write_part(t, lists, f"{base}/intermediate_b.csv")
    return merge_parts(spark, f"{base}/intermediate_*.csv", dates).select(*FEATURES.names)
