"""Column functions over names, signatures, lists and logs."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

PACKAGE = r"^(.*)[.][^.]*$"
CLASS_NAME = r"^[A-Za-z_$][A-Za-z0-9_$]*([.][A-Za-z_$][A-Za-z0-9_$]*)*$"
BLANK = " \t\r\n\f\x0b"
#: Words that mark an error line, and starts of lines that only frame it. Fixed values.
ERROR_WORDS = ("error:", "No such file", "does not exist", "BUILD FAILED", "Cannot ", "cannot ", "failed", "FAIL")
FRAMES = ("at /", "---")
NO_LOG = "sem stderr"


def trimmed(x: Column) -> Column:
    return F.btrim(x, F.lit(BLANK))


def newline_list(x: Column) -> Column:
    """The trimmed lines of a text that aren't blank; none for null."""
    return F.filter(F.transform(F.split(F.coalesce(x, F.lit("")), "\n"), trimmed), lambda v: v != "")


def semicolon_list(x: Column) -> Column:
    """The items between semicolons that aren't blank, as they are; none for null."""
    return F.filter(F.split(F.coalesce(x, F.lit("")), ";"), lambda v: trimmed(v) != "")


def package_of(name: Column) -> Column:
    """The text before the last point, '' without one."""
    return F.regexp_extract(name, PACKAGE, 1)


def signature_class(x: Column) -> Column:
    """The class of A::m or A.m, trimmed; null if x has another form."""
    return _signature(x, 0)


def signature_method(x: Column) -> Column:
    """The method of A::m or A.m, trimmed; null if x has another form."""
    return _signature(x, 1)


def _signature(x: Column, part: int) -> Column:
    two = F.split(x, "::", -1)
    dotted = F.regexp_extract(x, r"^(.*)[.]([^.]*)$", part + 1)
    return F.when(F.contains(x, F.lit("::")), F.when(F.size(two) == 2, trimmed(F.get(two, F.lit(part))))).when(F.contains(x, F.lit(".")), trimmed(dotted))


def test_id(test_class: Column, test_method: Column) -> Column:
    return F.concat_ws("::", test_class, test_method)


def same_package(test_class: Column, modified: Column) -> Column:
    """1 if the test's package is that of a modified class; a missing or empty list gives 0."""
    return F.coalesce(F.exists(modified, lambda c: package_of(c) == package_of(test_class)), F.lit(False)).cast("int")


def is_class_name(x: Column) -> Column:
    return F.coalesce(x.rlike(CLASS_NAME), F.lit(False))


def exact(x: Column, digits: int = 10) -> Column:
    """Rounded half to even, as results are before they are compared (10 places) or shown (4)."""
    return F.bround(x, digits)


def error_summary(log: Column) -> Column:
    """The first three error lines of a log (else its first two lines; a note if it has none), at most 300 characters, commas as semicolons."""
    lines = newline_list(log)

    def wrong(v: Column) -> Column:
        return reduce(or_, [F.contains(v, F.lit(w)) for w in ERROR_WORDS]) & ~reduce(or_, [F.startswith(v, F.lit(w)) for w in FRAMES])

    errors = F.slice(F.filter(lines, wrong), 1, 3)
    chosen = F.when(F.coalesce(log, F.lit("")) == "", F.array(F.lit(NO_LOG))).when(F.size(errors) > 0, errors).otherwise(F.slice(lines, 1, 2))
    return F.replace(F.substring(F.array_join(chosen, "; "), 1, 300), F.lit(","), F.lit(";"))


def best_label(names: list[str], largest: bool = True) -> Column:
    """The names of the columns that equal the row's largest (or smallest) value, joined by ' / ' in the order given."""
    top = (F.greatest if largest else F.least)(*names)
    return F.array_join(F.filter(F.array(*[F.when(F.col(n) == top, F.lit(n)) for n in names]), lambda x: x.isNotNull()), " / ")


def renamed(x: Column, names: dict[str, str]) -> Column:
    """Display names; an unknown one is an error."""
    out = F.raise_error(F.concat(F.lit("no display name for "), x)).cast("string")
    for k, v in names.items():
        out = F.when(x == k, F.lit(v)).otherwise(out)
    return out
