"""Exact dedup over an extendible-hash index that lies on shared files.

The index holds one entry per distinct text. Its directory over the leading bits of the texts' 64-bit hashes starts as one bucket; while
a bucket has over CAPACITY hashes it splits by its next bit, and the directory doubles when that bit is beyond its global depth, up
to all 64 bits. Only overfull buckets split, so bucket depths differ. The directory is a table: its counts stay in Spark, STEP bits
at a time. Every text goes by the directory to its bucket, and with it to the owner task of the bucket's range of hashes. The owner chains the texts that share a hash, compares their whole
normalised bytes and writes keep_id and group_size of each to its buckets. Before any shuffle of texts a bit map of the hashes that occur again sifts them, and equal texts are combined in
their task: a third of all rows with one text reach their owner as a few rows for each task, and of unique texts only those travel whose bit another hash has set.
Every row then finds its entry by directory and bucket, the rows of hot texts by broadcast.

Defined results: null text counts as empty, and all empty texts are equal; long texts are hashed and compared whole; of rows with equal text and
the same largest doc_id exactly one stays; null doc_ids are the smallest; an empty table gives an empty
result; other columns of the input don't matter.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import HOT_ROWS, apart, ascii_lower, bucket_count, fresh, small_or_not, staged

#: Hashes in a bucket before it splits.
CAPACITY = 512
#: Bits by which the counts of overfull buckets become finer.
STEP = 8
#: Entries of an owner task, about.
OWNER_ENTRIES = 20_000
#: Bytes of texts that a task combines at once.
COMBINE_BYTES = 1 << 25
#: Rows of (hash) or of the directory that may be broadcast: 16 to 24 bytes each.
BROADCAST_ROWS = 500_000
#: Leading bits of a hash that choose a word of the bit map; the next 6 choose the bit. At most 2 ** WORD_BITS rows of 16 bytes are broadcast.
WORD_BITS = 20


def prefix(h: str, depth: int | str) -> Column:
    """The depth leading bits of a hash as a number, in the order of unsigned hashes; depth is a number or a column's name."""
    return F.expr(f"CASE WHEN {depth} = 0 THEN 0L ELSE shiftrightunsigned({h}, 64 - {depth}) END")


def split(first: int, depth: int, counts: dict[int, int], bits: int, capacity: int) -> list[tuple[int, int, int]]:
    """(prefix, local depth, hashes) of each bucket that the bucket of a prefix and depth splits into, for hashes counted by bits further leading bits.

    An overfull bucket splits by its next bit until no bits are left; then it is returned as it is.
    """
    done, todo = [], [(first, depth, counts)]
    while todo:
        own, at, held = todo.pop()
        n = sum(held.values())
        if n <= capacity or at == depth + bits:
            done.append((own, at, n))
            continue
        half = 1 << (depth + bits - at - 1)
        todo += [(2 * own + side, at + 1, {k - side * half: v for k, v in held.items() if (k >= half) == bool(side)}) for side in (1, 0)]
    return done


def directory(hashes: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """prefix, depth, n of the buckets of staged distinct hashes (h)."""
    parts: list[DataFrame] = []
    over, depth = None, 0
    while depth < 64:
        rows = hashes if over is None else hashes.withColumn("parent", prefix("h", depth)).join(small_or_not(over, BROADCAST_ROWS), "parent", "left_semi")
        counts = rows.groupBy(prefix("h", depth + STEP).alias("p")).agg(F.count("*").alias("n"))
        family = counts.groupBy(F.shiftrightunsigned("p", STEP).alias("parent") if depth else F.lit(0).cast("long").alias("parent")).agg(F.collect_list(F.struct("p", "n")).alias("counts"))  # at most 2 ** STEP of a parent

        def grown(batches: Iterator[pa.RecordBatch], depth: int = depth) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                found = [x for parent, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for x in split(parent, depth, {c["p"] & ((1 << STEP) - 1): c["n"] for c in counts}, STEP, capacity)]
                columns = [[p - (1 << 64) if p >> 63 else p for p, _, _ in found], [d for _, d, _ in found], [n for *_, n in found]]
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, (pa.int64(), pa.int32(), pa.int64()), strict=True)], names=["prefix", "depth", "n"])

        depth += STEP
        level = staged(family.mapInArrow(grown, "prefix long, depth int, n long"), "directory-level")
        done = (F.col("n") <= capacity) | (F.lit(depth) == 64)
        parts.append(level.where(done))
        over = level.where(~done).select(F.col("prefix").alias("parent"))
        if over.isEmpty():
            break
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return staged(out, "directory")


def least_depth(found: DataFrame) -> int:
    return found.agg(F.min("depth")).first()[0] or 0


def looked_up(rows: DataFrame, found: DataFrame, least: int) -> DataFrame:
    """The rows, which have a hash h, with the prefix and depth of their bucket; buckets of one prefix of the least depth are told apart by their own."""
    found = found.select("prefix", "depth", F.expr(f"shiftrightunsigned(prefix, depth - {least})").alias("slot"))
    same = (prefix("h", least) == F.col("slot")) & (prefix("h", "depth") == F.col("prefix"))
    return rows.join(small_or_not(found, BROADCAST_ROWS), same).drop("slot")


def normalised(text: str) -> Column:
    return ascii_lower(F.coalesce(F.col(text), F.lit("")))


def prints(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, h, sha of every row: the 64-bit hash and the SHA-256 of the normalised text."""
    return docs.select(F.col(doc_id).alias("doc_id"), normalised(text).alias("norm")).select("doc_id", F.xxhash64("norm").alias("h"), F.sha2("norm", 256).alias("sha"))


def sieved(rows: DataFrame, keys: DataFrame) -> DataFrame:
    """The rows whose hash h may be one of keys (h): none of those is lost, and of n other hashes about n * len(keys) / 2 ** (WORD_BITS + 6) stay. Nothing is shuffled but the bit map."""
    word, bit = F.shiftrightunsigned("h", 64 - WORD_BITS), F.expr(f"shiftleft(1L, CAST(shiftrightunsigned(h, {58 - WORD_BITS}) & 63L AS INT))")
    words = keys.groupBy(word.alias("_word")).agg(F.bit_or(bit).alias("_bits"))
    return rows.join(F.broadcast(words), word == F.col("_word")).where(F.col("_bits").bitwiseAND(bit) != 0).drop("_word", "_bits")


def larger(a, b):
    """The larger of two ids; null is the smallest."""
    return a if b is None or (a is not None and a >= b) else b


def combined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(h, norm, keep_id, n) of rows (h, norm, doc_id): equal texts of a task become one row, as many texts at once as COMBINE_BYTES hold."""
    held: dict[tuple[int, str], list] = {}
    size, kind = 0, None

    def flush() -> pa.RecordBatch:
        columns = ([k[0] for k in held], [k[1] for k in held], [v[0] for v in held.values()], [v[1] for v in held.values()])
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, (pa.int64(), pa.string(), kind, pa.int64()), strict=True)], names=["h", "norm", "keep_id", "n"])

    for batch in batches:
        kind = batch.schema.field(2).type
        for h, norm, doc_id in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if found := held.get((h, norm)):
                found[0], found[1] = larger(found[0], doc_id), found[1] + 1
                continue
            held[h, norm] = [doc_id, 1]
            size += len(norm)
            if size >= COMBINE_BYTES:
                yield flush()
                held.clear()
                size = 0
    if held:
        yield flush()


def owned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """An owner's entries of rows (prefix, depth, h, norm, sha, keep_id, n) sorted by h: the texts of one hash are chained and told apart by their bytes."""
    names, kind = ["prefix", "depth", "h", "chain", "sha", "keep_id", "group_size"], None

    def rows() -> Iterator[tuple]:
        nonlocal kind
        for batch in batches:
            kind = batch.schema.field(5).type
            yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)

    def flush(out: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.string(), kind, pa.int64())
        return pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], t) for k, t in enumerate(kinds)], names=names)

    out: list[tuple] = []
    for (bucket, depth, h), group in groupby(rows(), key=lambda r: r[:3]):
        chain: list[list] = []
        for *_, norm, sha, keep_id, n in group:
            own = None if norm is None else norm.encode("utf-8", "surrogatepass")
            for link in chain:
                if link[0] == own:
                    link[2], link[3] = larger(link[2], keep_id), link[3] + n
                    break
            else:
                chain.append([own, sha or hashlib.sha256(own).hexdigest(), keep_id, n])
        chain.sort(key=lambda x: x[1])
        out += [(bucket, depth, h, k, sha, keep_id, n) for k, (_, sha, keep_id, n) in enumerate(chain)]
        if len(out) >= 10_000:
            yield flush(out)
            out = []
    if out:
        yield flush(out)


def build_index(docs: DataFrame, rows: DataFrame, text: str = "text", capacity: int = CAPACITY, doc_id: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """(the index of docs on shared files, an entry per distinct text: prefix, depth, h, chain, sha, keep_id, group_size; its directory).

    rows: the staged prints of docs. chain numbers the different texts of one hash.
    """
    kind = rows.schema["doc_id"].dataType.simpleString()
    by_hash = staged(rows.groupBy("h").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("n"), F.min("sha").alias("sha")), "hashes")
    found = directory(by_hash.select("h"), capacity)
    least = least_depth(found)
    alone = by_hash.where("n = 1").select("h", F.lit(None).cast("string").alias("norm"), "sha", "keep_id", "n")
    again = docs.select(F.col(doc_id).alias("doc_id"), normalised(text).alias("norm")).withColumn("h", F.xxhash64("norm"))
    repeated = by_hash.where("n > 1").select("h")
    again = sieved(again.select("h", "norm", "doc_id"), repeated).mapInArrow(combined, f"h long, norm string, keep_id {kind}, n long")
    again = again.join(small_or_not(repeated, BROADCAST_ROWS), "h", "left_semi").select("h", "norm", F.lit(None).cast("string").alias("sha"), "keep_id", "n")
    owners = bucket_count(by_hash.count(), OWNER_ENTRIES)
    placed = looked_up(alone.unionByName(again), found, least).withColumn("owner", prefix("h", least))  # an owner takes many small ranges
    ordered = placed.repartition(owners, "owner").sortWithinPartitions("h").select("prefix", "depth", "h", "norm", "sha", "keep_id", "n")
    return staged(ordered.mapInArrow(owned, f"prefix long, depth int, h long, chain int, sha string, keep_id {kind}, group_size long"), "extendible"), found


def with_entries(placed: DataFrame, index: DataFrame) -> DataFrame:
    """The placed rows with their entry of the index, if it has one. A text of over HOT_ROWS rows is joined by broadcast: of n rows at most n / HOT_ROWS texts are."""
    key = ["prefix", "depth", "h", "sha"]
    hot, rest = index.where(F.col("group_size") > HOT_ROWS), index.where(F.col("group_size") <= HOT_ROWS)
    return placed.join(F.broadcast(hot.select(key)), key, "left_anti").join(rest, key).unionByName(placed.join(F.broadcast(hot), key))


def repeated_rows(rows: DataFrame) -> DataFrame:
    """The rows whose text and doc_id both occur again: rh, rsha, rid."""
    return staged(rows.groupBy("h", "sha", "doc_id").agg(F.count("*").alias("c")).where("c > 1").select(F.col("h").alias("rh"), F.col("sha").alias("rsha"), F.col("doc_id").alias("rid")), "repeats")


def dedup_report(docs: DataFrame) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 of each row."""
    rows = staged(prints(docs), "prints")
    index, found = build_index(docs, rows)
    repeats = repeated_rows(rows)
    out = ["doc_id", "keep_id", "group_size", "kept", F.col("sha").alias("text_sha256")]
    joined = with_entries(looked_up(rows, found, least_depth(found)), index.drop("chain")).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("keep_id")))
    if repeats.isEmpty():
        return joined.select(*out)
    same = (F.col("h") == F.col("rh")) & (F.col("sha") == F.col("rsha")) & F.col("doc_id").eqNullSafe(F.col("rid"))
    again = (
        joined.join(repeats, same, "left_semi")
        .groupBy("doc_id", "keep_id", "group_size", "sha", F.col("kept").alias("last"))
        .agg(F.count("*").alias("n"))
        .select("*", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))).alias("i"))
        .withColumn("kept", F.col("last") & (F.col("i") == 1))
    )
    return joined.join(repeats, same, "left_anti").select(*out).unionByName(again.select(*out))


def dedup_filter(docs: DataFrame) -> DataFrame:
    """One row of each group of equal texts, with all columns: the one with the largest doc_id."""
    rows = staged(prints(docs), "prints")
    index, found = build_index(docs, rows)
    index = index.where("group_size > 1").drop("chain")
    h, sha = fresh(docs, "dedup_h"), fresh(docs, "dedup_sha")
    norm = ascii_lower(F.coalesce(F.col("text"), F.lit("")))
    marked = docs.withColumn(h, F.xxhash64(norm))
    lost = with_entries(looked_up(rows, found, least_depth(found)), index).where("not (doc_id <=> keep_id)").select(F.col("h").alias("rh"), F.col("doc_id").alias("rid"))
    repeats = repeated_rows(rows)

    def among(keys: DataFrame, how: str) -> DataFrame:
        keys = apart(keys, marked)
        at, own = (F.col(c) for c in keys.columns)
        return marked.join(small_or_not(keys, BROADCAST_ROWS), (F.col(h) == at) & F.col("doc_id").eqNullSafe(own), how)

    kept = among(staged(lost.unionByName(repeats.select("rh", "rid")).distinct(), "lost"), "left_anti").select(*docs.columns)
    if repeats.isEmpty():
        return kept
    stay = repeats.join(index, (F.col("h") == F.col("rh")) & (F.col("sha") == F.col("rsha"))).where("rid <=> keep_id").select("rh", "rid")
    again = among(staged(stay, "stay"), "left_semi").withColumn(sha, F.sha2(norm, 256))
    return kept.unionByName(again.dropDuplicates([h, sha]).select(*docs.columns))
