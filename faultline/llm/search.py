"""Ranked lexical search of all documents for each item, over classes of documents that no item can tell apart.

Documents are cut down to the items' vocabulary. Those with the same term frequencies there and the same length measure m have the same score for
every item: they are one class, found by a hash and told apart by the whole vector and m. Each class is scored once; of a class the k smallest doc_ids are
kept, which is exact, as no more of them can be among an item's k best. For the same reason each task sends on the k best
classes of an item, by score and smallest doc_id.

Items are dealt to blocks of about BLOCK_TERMS (item, term) pairs, whose vocabulary goes to the tasks; more items make more blocks, each a pass over the documents.

Null texts have no term. Rows of documents are documents of their own, also with repeated or null doc_ids; null ones rank last among equal scores. Rows of one
item_id, null too, are one item, with the terms of all. Items without a document above 0 give no row. Extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from . import terms
from .common import ascii_lower, bucket_count, staged

TOP = 10
#: Weights are in thousandths, saturations in 10^-9, and m is 10 + 90 for a text of mean length.
WEIGHT, SATURATION, LENGTH_PERCENT = 1000, 1_000_000_000, 90
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
BLOCK_TERMS = 200_000
#: Sums of contributions that are computed at once.
STEP = 1 << 21
EXACT = 1 << 53
_ODD = 0x9E3779B97F4A7C15


class Vocabulary:
    """Numbers of terms, found by a hash of their packed words and verified by the words themselves."""

    def __init__(self, names: list[str]) -> None:
        self.size = len(names)
        data = "".join(names).encode()
        ends = np.cumsum([len(n.encode()) for n in names], dtype=np.int64)
        self.classes = {}
        numbered: dict[int, list[terms.Bucket]] = {}
        for b in terms.buckets(np.frombuffer(data, np.uint8), ends, terms.LETTERS_DIGITS):
            numbered.setdefault(b.keys.shape[1], []).append(b)
        for width, parts in numbered.items():
            keys, ids = np.concatenate([b.keys for b in parts]), np.concatenate([b.docs for b in parts])
            odd = _ODD
            while len(np.unique(_hash(keys, odd))) < len(keys):  # another factor tells them apart
                odd = (odd * 3 + 2) % (1 << 64) | 1
            h = _hash(keys, odd)
            order = np.argsort(h)
            self.classes[width] = (odd, h[order], keys[order], ids[order])

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The number of each packed term, -1 for others."""
        if keys.shape[1] not in self.classes:
            return np.full(len(keys), -1)
        odd, h, known, ids = self.classes[keys.shape[1]]
        at = np.minimum(np.searchsorted(h, _hash(keys, odd)), len(h) - 1)
        return np.where((known[at] == keys).all(axis=1), ids[at], -1)


def _hash(keys: np.ndarray, odd: int) -> np.ndarray:
    h = np.zeros(len(keys), np.uint64)
    for k in range(keys.shape[1]):
        h = (h ^ keys[:, k]) * np.uint64(odd)
        h ^= h >> np.uint64(29)
    return h


def _bags(vocabulary) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def cut_down(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = vocabulary.value
        for batch in batches:
            for first, data, ends in terms.pieces(batch.column(1)):
                n, codes = np.zeros(len(ends), np.int64), [np.zeros(0, np.int64)]
                for b in terms.buckets(data, ends, terms.LETTERS_DIGITS):
                    n += np.bincount(b.docs, minlength=len(ends))
                    number = known.find(b.keys)
                    codes.append(b.docs[number >= 0] * known.size + number[number >= 0])
                code, tf = np.unique(np.concatenate(codes), return_counts=True)
                some = np.flatnonzero(n)
                offsets = np.searchsorted(code, np.append(some, len(ends)) * known.size).astype(np.int32)  # texts without a term hold no code
                lists = [pa.ListArray.from_arrays(pa.array(offsets), pa.array(x.astype(np.int32))) for x in (code % max(known.size, 1), tf)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(ends)).take(pa.array(some)), pa.array(n[some]), *lists], names=["doc_id", "n", "ids", "tfs"])

    return cut_down


class Best:
    """The k best classes of each item so far: score down, smallest doc_id up."""

    def __init__(self, items: int, k: int, members_type: pa.DataType) -> None:
        self.k, self.least = k, np.ones(items, np.int64)
        self.item, self.score, self.first = (np.zeros(0, np.int64) for _ in range(3))
        self.members = pa.array([], members_type)

    def add(self, scores: np.ndarray, first: np.ndarray, members: pa.Array) -> None:
        """scores: a row for each class, a column for each item. Only classes that reach an item's k-th score are looked at."""
        c, item = np.nonzero(scores >= self.least)
        item, score, small = np.append(self.item, item), np.append(self.score, scores[c, item]), np.append(self.first, first[c])
        order = np.lexsort((small, -score, item))
        item = item[order]
        rank = np.arange(len(item)) - np.searchsorted(item, item)
        kept = order[rank < self.k]
        self.members = pa.concat_arrays([self.members, members.take(pa.array(c))]).take(pa.array(kept))
        self.score, self.first, self.item = score[kept], small[kept], item[rank < self.k]
        last = rank[rank < self.k] == self.k - 1
        self.least[self.item[last]] = self.score[last]


def _scores(block, k: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        item_ids, starts, items, weights, longest = block.value
        best = None
        for batch in batches:
            m, ids, tfs, members = batch.columns
            best = best or Best(len(item_ids), k, members.type)
            small = _first(members)
            offsets = ids.offsets.to_numpy().astype(np.int64)
            ids, tfs, m = ids.values.to_numpy(), tfs.values.to_numpy().astype(np.int64), m.to_numpy()
            met = starts[ids + 1] - starts[ids]
            work = np.append(0, np.cumsum(met))[offsets] + np.arange(len(offsets)) * len(item_ids)
            at = 0
            while at < len(m):
                upto = max(at + 1, int(np.searchsorted(work, work[at] + STEP, "right")) - 1)
                part = slice(offsets[at], offsets[upto])
                cls = np.repeat(np.arange(upto - at), np.diff(offsets[at : upto + 1]))
                tf = tfs[part]
                gain = weights[ids[part]] * ((SATURATION * tf) // (WEIGHT * tf + 8 * m[at + cls]))
                # one contribution for each item that has the term
                each = np.repeat(np.arange(len(tf)), met[part])
                before = np.cumsum(met[part]) - met[part]
                item = items[np.arange(len(each)) - before[each] + starts[ids[part]][each]]
                where, shape = cls[each] * len(item_ids) + item, (upto - at, len(item_ids))
                if longest * int(gain.max(initial=0)) < EXACT:  # sums of whole numbers below 2^53 are exact in doubles
                    sums = np.bincount(where, weights=gain[each], minlength=shape[0] * shape[1]).astype(np.int64)
                else:
                    sums = np.zeros(shape[0] * shape[1], np.int64)
                    np.add.at(sums, where, gain[each])
                best.add(sums.reshape(shape), small[at:upto], members.slice(at, upto - at))
                at = upto
        if best:
            yield pa.RecordBatch.from_arrays([item_ids.take(pa.array(best.item)), pa.array(best.score), best.members], names=["item_id", "score", "members"])

    return score


def _first(members: pa.Array) -> np.ndarray:
    """The smallest doc_id of each class, the first of its list; null counts as the largest."""
    flat = members.values.take(pa.array(members.offsets.to_numpy()[:-1]))
    return flat.cast(pa.int64()).fill_null(np.iinfo(np.int64).max).to_numpy(zero_copy_only=False)


def item_terms(items: DataFrame) -> DataFrame:
    """item_id, term of each different term of an item."""
    return items.select("item_id", F.explode(F.regexp_extract_all(ascii_lower(F.col("text")), F.lit(TERM), F.lit(0))).alias("term")).distinct()


def _of_block(docs: DataFrame, pairs: pa.Table, k: int, result: T.StructType) -> DataFrame | None:
    """The ranked documents of the items of one block, from its (item_id, term) pairs; None if no document has a term."""
    spark = docs.sparkSession
    names = pairs.column("term").combine_chunks().dictionary_encode()
    ids = pairs.column("item_id").combine_chunks().dictionary_encode("encode")
    vocabulary = spark.sparkContext.broadcast(Vocabulary(names.dictionary.to_pylist()))
    doc_type = result["doc_id"].dataType
    schema = T.StructType([T.StructField("doc_id", doc_type), T.StructField("n", T.LongType()), *[T.StructField(c, T.ArrayType(T.IntegerType())) for c in ("ids", "tfs")]])
    bags = staged(docs.select("doc_id", "text").mapInArrow(_bags(vocabulary), schema), "bags")
    total, length = bags.agg(F.count("*"), F.sum("n")).first()  # two numbers
    if not total:
        return None
    df = dict(bags.select(F.explode("ids").alias("id")).groupBy("id").count().collect())  # at most a row for each term of the block
    weights = np.array([math.floor(WEIGHT * math.log((2 * total + 2) / (2 * df.get(i, 0) + 1))) for i in range(len(names.dictionary))], np.int64)

    m = F.lit(100 - LENGTH_PERCENT).cast("long") + F.call_function("div", F.lit(LENGTH_PERCENT).cast("long") * F.col("n") * F.lit(total).cast("long"), F.lit(length).cast("long"))
    key = ["h", "m", "ids", "tfs"]
    place = F.row_number().over(Window.partitionBy(*key).orderBy(F.asc_nulls_last("doc_id")))  # with the filter, k rows of a class from each task
    first = bags.where(F.size("ids") > 0).select("doc_id", F.xxhash64("ids", "tfs").alias("h"), m.alias("m"), "ids", "tfs").withColumn("place", place).where(F.col("place") <= k)
    classes = first.groupBy(*key).agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "doc_id"))), lambda x: x["doc_id"]).alias("members"))

    term_of, item_of = names.indices.to_numpy(), ids.indices.to_numpy()
    order = np.argsort(term_of, kind="stable")
    starts = np.searchsorted(term_of[order], np.arange(len(names.dictionary) + 1))
    block = spark.sparkContext.broadcast((ids.dictionary, starts, item_of[order].astype(np.int64), weights, int(np.bincount(item_of).max())))
    scored = T.StructType([result["item_id"], T.StructField("score", T.LongType()), T.StructField("members", T.ArrayType(doc_type))])
    rank = F.row_number().over(Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
    rows = classes.select("m", "ids", "tfs", "members").mapInArrow(_scores(block, k), scored).select("item_id", "score", F.explode("members").alias("doc_id"))
    return rows.withColumn("rank", rank).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


def ranked_search(docs: DataFrame, items: DataFrame, k: int = TOP) -> DataFrame:
    """item_id, rank, doc_id, score: the k best documents of each item with a score above 0, equal scores by ascending doc_id."""
    fields = {"item_id": items.schema["item_id"].dataType, "rank": T.IntegerType(), "doc_id": docs.schema["doc_id"].dataType, "score": T.LongType()}
    result = T.StructType([T.StructField(name, kind) for name, kind in fields.items()])
    pairs = staged(item_terms(items), "item-terms")
    blocks = bucket_count(pairs.count(), BLOCK_TERMS)
    dealt = pairs.withColumn("block", F.pmod(F.xxhash64("item_id"), F.lit(blocks)))
    found = []
    for b in range(blocks):
        mine = dealt.where(F.col("block") == b).select("item_id", "term").toArrow()  # about BLOCK_TERMS rows, whatever the documents are
        if mine.num_rows:
            found.append(_of_block(docs, mine, k, result))
    return reduce(DataFrame.unionByName, [x for x in found if x] or [docs.sparkSession.createDataFrame([], result)])
