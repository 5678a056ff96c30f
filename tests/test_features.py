"""Features, splits, text functions, labels and enumeration on hand-made inputs."""

import pytest
from pyspark.sql import functions as F

from faultline.functions import text as X
from faultline.operators import enumerate_tests, features, labels, split
from faultline.plans import derived
from faultline.sources import files
from faultline.sources.shared import new_path, scratch, staged


def test_history_goes_by_date_not_id(spark):
    tests = spark.createDataFrame([("P", b, "a.T", "m", 1, 100 - b) for b in (7, 16, 27, 36)], "project string, bug long, test_class string, test_method string, is_trigger int, fixed_commit_date long")
    assert [r["history"] for r in features.history(tests).orderBy("bug").collect()] == [3, 2, 1, 0]


def test_missing_date_is_an_error(spark):
    tests = spark.createDataFrame([("P", 1), ("P", 2)], "project string, bug long")
    dates = spark.createDataFrame([("P", 1, 5)], "project string, bug long, fixed_commit_date long")
    with pytest.raises(Exception, match="no commit date for P-2"):
        features.with_dates(tests, dates).collect()
    assert [tuple(r) for r in features.undated(tests, dates).collect()] == [("P", 2)]


@pytest.mark.parametrize(("test", "modified", "expected"), [("a.b.T", ["a.b.X", "c.Y"], 1), ("a.b.T", ["c.Y"], 0), ("a.b.T", [], 0), ("T", ["X"], 1), ("a.b.T", None, 0)])
def test_same_package(spark, test, modified, expected):
    df = spark.createDataFrame([("P", 1, test, "m", modified)], "project string, bug long, test_class string, test_method string, modified_classes array<string>")
    assert df.select(X.same_package(F.col("test_class"), F.col("modified_classes"))).first()[0] == expected
    assert features.same_package(df.drop("modified_classes"), df.select("project", "bug", "modified_classes")).first()["same_package"] == expected


@pytest.mark.parametrize(("signature", "expected"), [("a.B::m", ("a.B", "m")), ("a.B.m", ("a.B", "m")), ("x", (None, None)), ("a::b::c", (None, None)), (" a.B :: m ", ("a.B", "m"))])
def test_signatures(spark, signature, expected):
    df = spark.createDataFrame([(signature,)], "s string")
    assert tuple(df.select(X.signature_class(F.col("s")), X.signature_method(F.col("s"))).first()) == expected


def test_lists_and_names(spark):
    df = spark.createDataFrame([(" a \n\n b\n", "x;; y;", "a.B$c", "1a")], "n string, s string, good string, bad string")
    row = df.select(X.newline_list(F.col("n")), X.semicolon_list(F.col("s")), X.is_class_name(F.col("good")), X.is_class_name(F.col("bad"))).first()
    assert tuple(row) == (["a", "b"], ["x", " y"], True, False)


@pytest.mark.parametrize(
    ("log", "expected"),
    [("error: x\nat /y failed\n\n", "error: x"), (None, "sem stderr"), ("", "sem stderr"), ("one\n\ntwo\nthree", "one; two"), ("error: a,b\nerror: c\nerror: d\nerror: e", "error: a;b; error: c; error: d"), ("error: " + "z" * 400, ("error: " + "z" * 400)[:300])],
)
def test_error_summary(spark, log, expected):
    assert spark.createDataFrame([(log,)], "l string").select(X.error_summary(F.col("l"))).first()[0] == expected


@pytest.mark.parametrize(("k", "n_test"), [(5, 2), (15, 4), (25, 8), (61, 18), (106, 32)])
def test_split_rounds_half_to_even(spark, k, n_test):
    rows = spark.range(k + 1).select(F.lit("P").alias("project"), F.col("id").alias("bug"), (F.col("id") > 0).cast("int").alias("label"), (1000 - F.col("id")).alias("fixed_commit_date"))
    out = split.tail_split(rows, rows)
    test = sorted(r["bug"] for r in out.where("side = 'test'").collect())
    assert test == list(range(1, n_test + 1))  # the newest have the smallest ids here; change 0 has no trigger
    assert split.split_summary(out).where("project is null").first()[1:] == (k + 1, 1, k + 1 - n_test, n_test)


def listing(spark, *blocks):
    lines = enumerate_tests.block_lines(enumerate_tests.class_blocks(spark.createDataFrame([("\n".join(blocks),)], "value string")))
    return enumerate_tests.class_info(lines), enumerate_tests.method_info(lines)


def block(name, over, members, abstract=False):
    head = [f"Classfile /shop/{name}.class", "public class y", f"  flags: (0x0021) ACC_PUBLIC{', ACC_ABSTRACT' * abstract}", f"  this_class: #7   // shop/tests/{name}", f"  super_class: #8   // {over}"]
    return "\n".join([*head, "Constant pool:", "{", *members, "}"])


def member(decl, lines=2, *notes):
    body = [f"  {decl};", "    descriptor: ()V", "    Code:", *[f"         {i}: nop" for i in range(lines)]]
    return "\n".join(body + (["    RuntimeVisibleAnnotations:", "      0: #21()", *[f"        {n}" for n in notes]] if notes else []))


def test_inherited_tests(spark):
    till = block("TillTest", "shop/tests/CounterTest", [member("public shop.tests.TillTest()"), member("public void testOpens()", 3, "org.junit.Test"), member("public void fill(int)"), member("public static void clean()", 1, "org.junit.AfterClass"), member("void testHidden()")])
    counter = block("CounterTest", "java/lang/Object", [member("public void testCounts()", 90, "org.junit.Test"), member("public void sums()", 120, "org.junit.jupiter.api.Test"), member("public void testBroken()", 5, "org.junit.Ignore")], True)
    sale = block("SaleTest", "shop/gone/Nothing", [member("public void refuses() throws shop.Closed", 1, "org.junit.Test(", "  timeout=5", ")"), member("public void TESTRefund()"), member("public void lists(java.util.Map<K, V>)", 1, "org.testng.annotations.Test"), member("public void nested()", 1, "shop.Outer$Note")])
    classes, methods = listing(spark, till, counter, sale, "Classfile /shop/unnamed.class\n{\n}")
    assert {(r["class_name"], r["superclass"], r["is_abstract"]) for r in classes.collect()} == {("shop.tests.TillTest", "shop.tests.CounterTest", False), ("shop.tests.CounterTest", None, True), ("shop.tests.SaleTest", "shop.gone.Nothing", False)}
    seen = {(r["class_name"], r["name"]): r for r in methods.collect()}
    assert seen["shop.tests.SaleTest", "lists"]["has_params"] and seen["shop.tests.SaleTest", "nested"]["annotations"] == ["shop.Outer.Note"] and ("shop.tests.TillTest", "TillTest") not in seen
    assert seen["shop.tests.SaleTest", "refuses"]["annotations"] == ["org.junit.Test"] and not seen["shop.tests.TillTest", "testHidden"]["is_public"]
    found = enumerate_tests.inherited_tests(classes, methods, enumerate_tests.superclass_closure(classes))
    assert {(r[0], r[1]) for r in found.collect()} == {("shop.tests.TillTest", m) for m in ("testOpens", "testCounts", "sums")} | {("shop.tests.SaleTest", m) for m in ("refuses", "TESTRefund")}


def test_override_without_annotation_hides(spark):
    classes = spark.createDataFrame([("S", "B", False), ("B", None, True)], "class_name string, superclass string, is_abstract boolean")
    rows = [("B", "check", True, False, False, ["org.junit.Test"]), ("S", "check", True, False, False, []), ("B", "testA", True, False, False, []), ("S", "testA", True, False, False, [])]
    methods = spark.createDataFrame(rows, "class_name string, name string, is_public boolean, is_static boolean, has_params boolean, annotations array<string>")
    assert [tuple(r) for r in enumerate_tests.inherited_tests(classes, methods, enumerate_tests.superclass_closure(classes)).collect()] == [("S", "testA")]


def test_text_files_and_properties(spark):
    rows = [("P/1/tests.trigger", "a.T::x\na.T::gone\n"), ("P/1/classes.modified", "a.A\n"), ("Q/2/tests.trigger", "\n")]
    base = new_path(spark, "texts")
    files.write_texts(spark.createDataFrame(rows, "path string, content string"), base)
    meta = {(r["project"], r["bug"]): r for r in labels.metadata(files.read_properties(spark, f"{base}/*/*/*")).collect()}
    assert meta["P", 1]["trigger_tests"] == ["a.T::x", "a.T::gone"] and meta["P", 1]["modified_classes"] == ["a.A"] and meta["Q", 2]["trigger_tests"] == []
    assert [r["value"] for r in files.read_listings(spark, f"{base}/P/1/tests.trigger").collect()] == [rows[0][1]]


def test_scratch_tables_go(spark):
    df = spark.range(3)
    with scratch(spark):
        inner = staged(df, "inner")
        kept = staged(inner, "inner-2")
        assert kept.count() == 3
    with pytest.raises(Exception, match="PATH_NOT_FOUND|FILE_NOT_EXIST|does not exist"):
        inner.count()
    assert staged(df, "outer").count() == 3


def test_labels_and_report(spark):
    props = spark.createDataFrame([("P", 1, "tests.trigger", "a.T::x\n\na.T::gone\nbad\n"), ("P", 1, "classes.modified", "a.A\nb.B")], "project string, bug long, property string, content string")
    meta = labels.metadata(props)
    tests = spark.createDataFrame([("P", 1, "a.T", "x"), ("P", 1, "a.T", "y"), ("P", 2, "a.T", "x")], "project string, bug long, test_class string, test_method string")
    table = labels.label(meta, tests)
    assert {(r["test_method"], r["is_trigger"], r["modified_classes_count"]) for r in table.collect()} == {("x", 1, 2), ("y", 0, 2)}
    assert [tuple(r) for r in labels.rejected(labels.signatures(meta)).collect()] == [("P", 1, "bad")]
    assert labels.missed(meta, tests).first()["first_missed"] == ["a.T::gone"]
    failures = spark.createDataFrame([("P", 3, "checkout")], "project string, bug long, reason string")
    report = {r["bug"]: r for r in labels.build_report(meta, table, failures).collect()}
    assert (report[1]["status"], report[1]["n_triggers_expected"], report[1]["n_triggers_labeled"], report[1]["missing"]) == ("ok", 2, 1, 1)
    assert (report[3]["status"], report[3]["reason"]) == ("falhou", "checkout")
    attempts = spark.createDataFrame([("L", 1, "falhou", 0), ("L", 1, "ok", 1)], "project string, bug long, status string, part int")
    assert labels.last_attempt(attempts, ["part"]).first()["status"] == "ok"


def test_golden_counts(spark):
    f = derived.features(spark, "/root/testdata/sf0.001").persist()
    assert tuple(f.agg(F.count("*"), F.sum("history"), F.max("history"), F.sum("same_package"), F.sum("label"), F.min("modified_classes_count"), F.max("modified_classes_count")).first()) == (5321, 113, 1, 21, 36, 0, 2)
