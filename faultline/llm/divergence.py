"""How the sources of a language differ in their use of terms: term counts, and smoothed relative frequencies compared between sources.

Terms are counted in the tasks that read the texts (terms.py): packed by length, radix-sorted and run-counted, merged over the task's texts up to MERGE_BYTES.
One shuffle by (lang, term) then sums them and drops rare ones, so that a frequent term reaches it as one row for each task and source. Sources
are compared in blocks of terms, so that no task holds a language's vocabulary.

Null text, lang and source are ''. A row is a document, repeated ones too; doc_id and extra columns are ignored. Groups without a kept term are compared as
well: their p is 1 + 10^9 * 2 / (0 + 2V). An empty table gives an empty result. Counts are 64-bit: p is exact up to 9 * 10^15 terms a language.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import terms
from .common import small_or_not, staged

MIN_DOCS = 10
TOP = 10
SCALE = 1_000_000_000
#: Counts that a task holds before it merges them, and sends them on if merging doesn't halve them.
MERGE_BYTES = 48 << 20
#: Counts (terms times sources) that a block of a comparison holds.
BLOCK_CELLS = 1 << 20
#: Groups that may be broadcast; beyond, tables meet by a shuffle.
SMALL_GROUPS = 100_000

COUNTS = "lang string, source string, term string, n long, docs long"


class Counts:
    """Sorted runs of one number of words: rows of (group, words ...), occurrences and documents of each."""

    def __init__(self) -> None:
        self.parts: dict[int, list[tuple[np.ndarray, np.ndarray, np.ndarray]]] = {}
        self.bytes = 0

    def add(self, rows: np.ndarray, n: np.ndarray, docs: np.ndarray) -> None:
        self.parts.setdefault(rows.shape[1], []).append((rows, n, docs))
        self.bytes += rows.nbytes + n.nbytes + docs.nbytes

    def count(self, bucket: terms.Bucket, group_of: np.ndarray) -> None:
        """Adds the terms of texts whose groups are group_of. Texts come in order, so in a sorted run a document's terms stand together."""
        groups = group_of[bucket.docs].astype(np.uint64)[:, None]
        order = _order(groups, bucket.keys)
        rows, docs = np.hstack([groups[order], bucket.keys[order]]), bucket.docs[order]
        at = terms.runs(rows)
        new_doc = np.ones(len(docs), np.int64)
        new_doc[1:] = docs[1:] != docs[:-1]
        new_doc[at] = 1
        self.add(rows[at], np.diff(np.append(at, len(rows))), np.add.reduceat(new_doc, at))

    def merge(self) -> None:
        old, self.parts, self.bytes = self.parts, {}, 0
        for parts in old.values():
            rows, n, docs = (np.concatenate(x) for x in zip(*parts, strict=True))
            order = _order(rows[:, :1], rows[:, 1:])
            rows = rows[order]
            at = terms.runs(rows)
            self.add(rows[at], np.add.reduceat(n[order], at), np.add.reduceat(docs[order], at))

    def batches(self, names: list[tuple[str, str]]) -> Iterator[pa.RecordBatch]:
        columns = [pa.array(x, pa.string()) for x in zip(*names, strict=True)]
        for parts in self.parts.values():
            for rows, n, docs in parts:
                for k in range(0, len(rows), 1 << 16):
                    part = slice(k, k + (1 << 16))
                    group = pa.array(rows[part, 0].astype(np.int64))
                    arrays = [*[c.take(group) for c in columns], terms.unpack(rows[part, 1:]).cast(pa.string()), pa.array(n[part]), pa.array(docs[part])]
                    yield pa.RecordBatch.from_arrays(arrays, names=["lang", "source", "term", "n", "docs"])
        self.parts, self.bytes = {}, 0


def _order(groups: np.ndarray, keys: np.ndarray) -> np.ndarray:
    order = terms.sort_order(keys)
    return order[terms.radix_order(groups[order])]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts, number = Counts(), {}
    for batch in batches:
        pairs = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
        group_of = np.array([number.setdefault(p, len(number)) for p in pairs], np.int64)
        for first, data, ends in terms.pieces(batch.column(2)):
            for bucket in terms.buckets(data, ends, terms.LETTERS):
                counts.count(bucket, group_of[first : first + len(ends)])
            if counts.bytes > MERGE_BYTES:
                counts.merge()
                if counts.bytes > MERGE_BYTES // 2:
                    yield from counts.batches(list(number))
    counts.merge()
    if number:
        yield from counts.batches(list(number))


def named(docs: DataFrame) -> DataFrame:
    """lang, source, text without nulls."""
    return docs.select(*[F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("lang", "source", "text")])


def vocabulary(docs: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """lang, term, n, cells (source, n of each source that has it) of the terms in at least min_docs documents of the language."""
    counted = named(docs).mapInArrow(_count, COUNTS).repartition("lang", "term")  # a task's texts are summed already
    each = counted.groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    by_term = each.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("n"), F.collect_list(F.struct("source", "n")).alias("cells"))  # a row for each source
    return by_term.where(F.col("docs") >= min_docs).drop("docs")


def _p(n: Column, total: Column, kept: Column) -> Column:
    """1 + floor(10^9 (n + 2) / (total + 2 kept))."""
    return F.lit(1).cast("long") + F.call_function("div", F.lit(SCALE).cast("decimal(10,0)") * (n + 2).cast("decimal(20,0)"), (total + 2 * kept).cast("decimal(20,0)"))


def _shares(n: np.ndarray, total: np.ndarray) -> np.ndarray:
    """As _p, of n and total = the whole divisor: long division by three digits of base 1000, as 10^9 n doesn't fit."""
    whole, rest = np.divmod(n + 2, total)
    for _ in range(3):
        digit, rest = np.divmod(rest * 1000, total)
        whole = whole * 1000 + digit
    return 1 + whole


def _compare(block: pa.Table, groups: pa.Table) -> pa.Table:
    """lang, a, b, value of each two sources of a language: the sum over the block's terms."""
    sources, none = groups.column("source").combine_chunks(), pa.table({"lang": pa.array([], pa.string()), "a": pa.array([], pa.string()), "b": pa.array([], pa.string()), "value": pa.array([], pa.int64())})
    if len(sources) < 2:
        return none
    values = np.zeros((len(sources), len(sources)), np.int64)
    if block.num_rows:
        cells = block.column("cells").combine_chunks()
        flat = pc.list_flatten(cells)
        counts = np.zeros((len(cells), len(sources)), np.int64)
        counts[pc.list_parent_indices(cells).to_numpy(), pc.index_in(flat.field("source"), sources).to_numpy(zero_copy_only=False)] = flat.field("n").to_numpy(zero_copy_only=False)
        p = _shares(counts, groups.column("total").to_numpy() + 2 * groups.column("kept").to_numpy())
        for i in range(len(sources) - 1):
            a, b = p[:, i : i + 1], p[:, i + 1 :]
            values[i, i + 1 :] = ((a - b) ** 2 // (a + b)).sum(axis=0)
    i, j = np.triu_indices(len(sources), 1)
    langs = pa.array([groups.column("lang")[0].as_py()] * len(i), pa.string())
    return pa.table({"lang": langs, "a": sources.take(pa.array(i)).cast(pa.string()), "b": sources.take(pa.array(j)).cast(pa.string()), "value": values[i, j]})


def source_divergence(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP) -> DataFrame:
    """lang, source, part, item, value, rank.

    part pair: every other source of the language with the divergence of both, largest first. part term: the top terms that the source uses more
    than its language does, by their part of the divergence.
    """
    kept = staged(vocabulary(docs, min_docs), "vocabulary")
    by_lang = kept.groupBy("lang").agg(F.count("*").alias("kept"), F.sum("n").alias("lang_total"))
    cells = kept.select("lang", "term", F.col("n").alias("lang_n"), F.inline("cells"))
    totals = cells.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = named(docs).select("lang", "source").distinct().join(by_lang, "lang", "left").join(totals, ["lang", "source"], "left")
    groups = staged(groups.na.fill(0, ["kept", "lang_total", "total"]), "groups")

    p, q = F.col("p"), F.col("q")
    rated = cells.join(small_or_not(groups, SMALL_GROUPS), ["lang", "source"])
    rated = rated.withColumns({"p": _p(F.col("n"), F.col("total"), F.col("kept")), "q": _p(F.col("lang_n"), F.col("lang_total"), F.col("kept"))}).where(p > q)
    words = rated.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), F.call_function("div", (p - q) * (p - q), p + q).alias("value"))

    n_blocks = F.ceil(F.col("kept") * F.col("sources") / F.lit(BLOCK_CELLS)).cast("int")
    blocks = groups.groupBy("lang").agg(F.count("*").alias("sources"), F.max("kept").alias("kept")).select("lang", F.greatest(n_blocks, F.lit(1)).alias("blocks"))
    dealt = kept.join(small_or_not(blocks, SMALL_GROUPS), "lang").select("lang", F.pmod(F.hash("term"), "blocks").alias("block"), "cells")
    copies = groups.join(small_or_not(blocks, SMALL_GROUPS), "lang").select("lang", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "source", "total", "kept")
    compared = dealt.groupBy("lang", "block").cogroup(copies.groupBy("lang", "block")).applyInArrow(_compare, "lang string, a string, b string, value long")
    halves = compared.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    sides = F.inline(F.array(*[F.struct(F.col(x).alias("source"), F.lit("pair").alias("part"), F.col(y).alias("item"), F.col("value")) for x, y in (("a", "b"), ("b", "a"))]))
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    # the filter on the rank lets each task send its own first rows only
    return halves.select("lang", sides).withColumn("rank", rank).unionByName(words.withColumn("rank", rank).where(F.col("rank") <= top))
