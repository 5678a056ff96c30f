"""Quality rules: adaptive thresholds from mergeable quantile sketches, then a joined filter.

Base measures come from each whole text. A sketch is a histogram of an integer measure, keyed by (lang, source), whose buckets keep the
SIGNIFICANT leading bits of a value: values under 2 ** SIGNIFICANT are exact, larger ones are known to 2 ** (1 - SIGNIFICANT) of themselves, there is
no largest bucket, and a sketch has at most 2 ** (SIGNIFICANT - 1) buckets for each further bit. Ranks are exact. Sums of counts merge sketches, in any order, along any tree, and over
sources into languages and into the whole corpus. Quartiles of the sketches give the fences

    high = q75 + SPREADS * max(q75 - q25, floor)      low = q25 - SPREADS * max(q75 - q25, floor)

A group of n rows weighs its own fences by n and its language's by PRIOR_ROWS, and a language its own and the corpus's likewise, so that
small groups lean on larger ones without a limit where that changes.
Only texts that pass the base rules enter the sketches.

Defined results: null or empty text: zero counts, base_failed; long texts are measured whole; a value at a fence is kept; null lang or source is a group of its
own; repeated rows each get their row; an empty table gives an empty result; other columns of the
input don't matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import WS, apart, fresh, let, small_or_not, staged, words

#: name: (numerator, denominator, units in 1, smallest spread in units, two-sided). Fixed values.
MEASURES = {
    "symbols": ("n_symbols", "n_words", 1000, 25, False),
    "dup_lines": ("n_dup_lines", "n_lines", 1000, 100, False),
    "repeats": ("n_repeat_words", "n_words", 1000, 120, False),
    "word_length": ("word_chars", "n_words", 100, 50, True),
}
SPREADS = 4
SIGNIFICANT = 10
PRIOR_ROWS = 50


def repeat_words(w: Column) -> Column:
    """How many words lie in 3-word windows that occur twice or more in w; windows are told apart by 64-bit hashes."""
    hashes = F.transform(w, lambda x: F.xxhash64(x))
    windows = let(
        hashes,
        lambda h: F.transform(F.slice(h, 1, F.greatest(F.size(h) - 2, F.lit(0))), lambda x, i: F.xxhash64(x, F.get(h, i + 1), F.get(h, i + 2))),
    )

    def covered(at: Column) -> Column:
        spans = F.transform(at, lambda p, i: F.least(F.lit(3), F.coalesce(F.get(at, i + 1) - p, F.lit(3))))
        return F.aggregate(spans, F.lit(0).cast("long"), lambda a, x: a + x)

    def found(g: Column) -> Column:
        return let(
            F.sort_array(F.transform(g, lambda x, i: F.struct(x.alias("h"), i.alias("p")))),
            lambda s: let(
                F.sort_array(
                    F.transform(
                        F.filter(s, lambda e, i: (F.get(s, i + 1)["h"] == e["h"]) | ((i > 0) & (F.get(s, F.greatest(i - 1, F.lit(0)))["h"] == e["h"]))),
                        lambda e: e["p"],
                    )
                ),
                covered,
            ),
        )

    return let(windows, lambda g: F.when(F.size(F.array_distinct(g)) < F.size(g), found(g)).otherwise(F.lit(0).cast("long")))


def measured(text: Column) -> Column:
    """struct(n_words, word_chars, n_symbols, n_dup_lines, n_lines, n_repeat_words) of a text."""
    text = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(text, "\n", -1), lambda x: F.btrim(x, F.lit(WS)) != "")
    return let(
        words(text),
        lambda w: let(
            lines,
            lambda l: F.struct(
                F.size(w).cast("long").alias("n_words"),
                F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
                F.length(F.regexp_replace(text, "[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
                (F.size(l) - F.size(F.array_distinct(l))).cast("long").alias("n_dup_lines"),
                F.size(l).cast("long").alias("n_lines"),
                repeat_words(w).alias("n_repeat_words"),
            ),
        ),
    )


def base_failed(m: Column) -> Column:
    return (m["n_words"] < 50) | (100 * m["n_repeat_words"] > 50 * m["n_words"])


def _units(m: Column, name: str) -> Column:
    over, under, units, _, _ = MEASURES[name]
    return F.floor(m[over] * units / F.greatest(m[under], F.lit(1))).cast("long")


def bucket(value: Column) -> Column:
    """The value with its SIGNIFICANT leading bits only."""
    dropped = F.greatest(F.length(F.bin(value)) - SIGNIFICANT, F.lit(0))
    return value - value % F.pow(F.lit(2), dropped).cast("long")


def sketches(rows: DataFrame, m: str, group: list[str]) -> DataFrame:
    """(group columns, measure, bucket, n): the mergeable sketches of the rows that pass the base rules."""
    each = F.array(*[F.struct(F.lit(k).alias("measure"), bucket(_units(F.col(m), k)).alias("bucket")) for k in MEASURES])
    return rows.where(~base_failed(F.col(m))).select(*group, F.inline(each)).groupBy(*group, "measure", "bucket").agg(F.count("*").alias("n"))


def _fences(sketch: DataFrame, keys: list[str]) -> DataFrame:
    """One row per key and measure: n, low and high."""
    by = Window.partitionBy(*keys, "measure")
    merged = sketch.groupBy(*keys, "measure", "bucket").agg(F.sum("n").alias("n"))
    placed = merged.select("*", F.sum("n").over(by.orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)).alias("upto"), F.sum("n").over(by).alias("rows"))
    quartiles = placed.groupBy(*keys, "measure").agg(
        F.max("rows").alias("rows"),
        F.min(F.when(F.col("upto") * 4 >= F.col("rows"), F.col("bucket"))).alias("q25"),
        F.min(F.when(F.col("upto") * 4 >= 3 * F.col("rows"), F.col("bucket"))).alias("q75"),
    )
    floor = F.coalesce(*[F.when(F.col("measure") == k, F.lit(v[3])) for k, v in MEASURES.items()])
    reach = SPREADS * F.greatest(F.col("q75") - F.col("q25"), floor)
    return quartiles.select(*keys, "measure", "rows", (F.col("q25") - reach).alias("low"), (F.col("q75") + reach).alias("high"))


def thresholds(sketch: DataFrame, lang: str, source: str, prior_rows: int = PRIOR_ROWS) -> DataFrame:
    """One row per (lang, source) of the sketch: an array of (measure, low, high)."""
    fine = _fences(sketch, [lang, source]).select(F.col(lang).alias("g1"), F.col(source).alias("g2"), "measure", "rows", "low", "high")
    mid = _fences(sketch, [lang]).select(F.col(lang).alias("m1"), F.col("measure").alias("m2"), F.col("rows").alias("mid_rows"), F.col("low").alias("mid_low"), F.col("high").alias("mid_high"))
    top = _fences(sketch, []).select(F.col("measure").alias("t1"), F.col("low").alias("top_low"), F.col("high").alias("top_high"))
    joined = fine.join(mid, F.col("g1").eqNullSafe(F.col("m1")) & (F.col("measure") == F.col("m2")), "left").join(F.broadcast(top), F.col("measure") == F.col("t1"), "left")

    def pick(x: str) -> Column:
        mid = (F.col("mid_rows") * F.col(f"mid_{x}") + prior_rows * F.col(f"top_{x}")) / (F.col("mid_rows") + prior_rows)
        return ((F.col("rows") * F.col(x) + prior_rows * mid) / (F.col("rows") + prior_rows)).alias(x)

    return joined.select("g1", "g2", F.struct("measure", pick("low"), pick("high")).alias("f")).groupBy("g1", "g2").agg(F.collect_list("f").alias("fences"))


def judge(docs: DataFrame, carry: list[str], text: str = "text", lang: str = "lang", source: str = "source", prior_rows: int = PRIOR_ROWS) -> tuple[DataFrame, str, str]:
    """(rows with carry's columns, a struct of measures and a verdict; the names of those two columns)."""
    m, kept = fresh(docs, "measures"), fresh(docs, "verdict")
    g = [fresh(docs, "group_lang"), fresh(docs, "group_source")]
    rows = staged(docs.select(*carry, F.col(lang).alias(g[0]), F.col(source).alias(g[1]), measured(F.col(text)).alias(m)), "quality")
    limits = apart(staged(thresholds(staged(sketches(rows, m, g), "sketches"), *g, prior_rows), "fences"), rows)
    g1, g2, fences = limits.columns
    joined = rows.join(small_or_not(limits, 20_000), F.col(g[0]).eqNullSafe(F.col(g1)) & F.col(g[1]).eqNullSafe(F.col(g2)), "left")

    def outside(k: str):
        v = _units(F.col(m), k)
        return F.exists(fences, lambda f: (f["measure"] == k) & ((v > f["high"]) | (F.lit(MEASURES[k][4]) & (v < f["low"]))))

    inside = ~F.greatest(*[F.coalesce(outside(k), F.lit(False)) for k in MEASURES])
    return joined.select(*carry, m, (~base_failed(F.col(m)) & inside).alias(kept)), m, kept


def quality_report(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept of each document."""
    rows, m, kept = judge(docs, ["doc_id"])
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return rows.select("doc_id", *[F.col(m)[x].alias(x) for x in names], base_failed(F.col(m)).alias("base_failed"), F.col(kept).alias("kept"))


def quality_filter(docs: DataFrame) -> DataFrame:
    """The documents that the rules keep, with all their columns."""
    rows, _, kept = judge(docs, docs.columns)
    return rows.where(F.col(kept)).select(*docs.columns)
