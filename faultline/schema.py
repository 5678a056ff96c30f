"""Explicit schemas of the library's tables."""

from pyspark.sql import types as T

S, L, I, D, B = T.StringType(), T.LongType(), T.IntegerType(), T.DoubleType(), T.BooleanType()


def struct(**fields) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


KEYS = ["project", "bug"]
TEST_KEYS = ["project", "bug", "test_class", "test_method"]
FEATURE_COLUMNS = ["history", "same_package", "modified_classes_count"]

#: One row for each (change, test); modified_classes is a ;-joined list in text sources.
INTERMEDIATE = struct(project=S, bug=L, test_class=S, test_method=S, is_trigger=I, modified_classes=S, modified_classes_count=I)
#: A part of it as files: the rows without the list, and beside them the list of each change, once.
PART_ROWS = struct(project=S, bug=L, test_class=S, test_method=S, is_trigger=I)
PART_LISTS = struct(project=S, bug=L, modified_classes=S, modified_classes_count=I)
FEATURES = struct(project=S, bug=L, test_class=S, test_method=S, history=L, same_package=I, modified_classes_count=I, label=I)
COMMIT_DATES = struct(project=S, bug=L, fixed_commit_date=L, fixed_revision=S)
BUILD_REPORT = struct(project=S, bug=L, status=S, reason=S, n_tests=L, n_triggers_expected=L, n_triggers_labeled=L)
METADATA = struct(project=S, bug=L, trigger_tests=T.ArrayType(S), relevant_test_classes=T.ArrayType(S), modified_classes=T.ArrayType(S))
CLASS_INFO = struct(class_name=S, superclass=S, is_abstract=B)
METHOD_INFO = struct(class_name=S, name=S, is_public=B, is_static=B, has_params=B, annotations=T.ArrayType(S))
RESULT = struct(project=S, bug=L, apfd=D, n_tests=L, n_trigger_tests=L)
LONG_RESULT = struct(strategy=S, project=S, bug=L, apfd=D, n_tests=L, n_trigger_tests=L)
SPLIT = struct(method=S, train=T.MapType(S, T.ArrayType(L)), test=T.MapType(S, T.ArrayType(L)))
EXPECTED = struct(project=S, n=L)
