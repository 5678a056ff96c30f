"""Near copies of texts for the pipeline: SimHash at a radius for similarity 0.8, vantage-point trees, each link verified by exact Jaccard.

Two texts link if the Jaccard similarity of their sets of five-word shingles is SIMILAR or more. SimHash fingerprints have WORDS words here:
at 0.8 they differ by 39 +- 6 of 256 bits, unrelated ones by 128 +- 8, so RADIUS, five deviations more, tells them apart.
No set of disjoint bit blocks shards such a radius. Shards are therefore drawn bits: texts whose fingerprints agree in one of the tables' drawn
bits meet. A shard is to hold about SHARD unrelated texts, which sets the bits; a pair at 0.8 misses all tables with probability MISSED, which sets their number.
The bits are drawn in two steps: by the first ones texts are shuffled to shards of about 2 * CELL, so that there are few such tables, and by the others a task
deals a shard again in memory, with other tables for each shard. A shard of over CELL texts, dense by the bits drawn, is dealt once more by other bits as long as that makes fewer pairs
(over 8 * CELL in the first step: by a shuffle). In each shard a vantage-point tree
finds the links at the radius: their components there are groups. A shard of over CELL that stays dense is a group as it is. Groups of all tables that share texts
are one, up to CELL texts, so that a text's set is shuffled once and not for each table.

In a group every pair of different components is tested by the sets. Groups with the same members are searched once.
A group of over CELL texts is dealt to cells, each with the group's smallest node too; after the components of these links, what
isn't in the group's largest component meets every cell. So no pair of a group is lost.
A large group that the first links join costs no square; one that falls into many components does.

Defined results: texts without words are copies of each other, null too; fewer words than a shingle: the whole sequence is one; long texts are read whole;
a similarity of just SIMILAR links; of equal smallest doc_ids the text with the smallest hash stays, and of repeated rows one; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cache, reduce
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_or_not, staged
from .simhash import BROADCAST_ROWS, components, forest, keep_first, shingle_hashes

SHINGLE = 5
SIMILAR = 0.8
WORDS = 4
#: The share of bits in which fingerprints at SIMILAR differ, acos(2s / (1 + s)) / pi; and five deviations more.
DIFFER = math.acos(2 * SIMILAR / (1 + SIMILAR)) / math.pi
RADIUS = round(64 * WORDS * DIFFER + 5 * math.sqrt(64 * WORDS * DIFFER * (1 - DIFFER)))
#: Unrelated texts of a shard, about, and the probability that a pair at SIMILAR is in none of the tables.
SHARD, MISSED = 128, 0.001
CELL = 2000
LEAF = 64
FP = [f"w{i}" for i in range(WORDS)]

_DRAWN = np.random.default_rng(42).integers(0, 1 << 63, (2, WORDS), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(text: str | None) -> np.ndarray:
    """The sorted set of a text's shingle hashes."""
    return np.unique(np.concatenate(list(shingle_hashes(text, SHINGLE)) or [np.zeros(1, np.uint64)]))


def wide_fingerprint(hashes: np.ndarray) -> np.ndarray:
    """The bits that more than half of a set's hashes have, in WORDS words: each word mixes the hash anew."""
    ones = np.zeros(64 * WORDS, np.int64)
    for at in range(0, len(hashes), 255 * 32):
        mixed = (hashes[at : at + 255 * 32, None] ^ (hashes[at : at + 255 * 32, None] >> np.uint64(32))) * _DRAWN[0]
        mixed = (mixed ^ (mixed >> np.uint64(29))) * _DRAWN[1]
        mixed ^= mixed >> np.uint64(32)
        bits = np.unpackbits(mixed.view(np.uint8), axis=1, bitorder="little")
        for k in range(0, len(bits), 255):  # sums of bytes
            ones += bits[k : k + 255].sum(axis=0, dtype=np.uint8)
    return np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)


@cache
def tables(bits: int) -> int:
    """How many tables of so many drawn bits a pair at SIMILAR misses with probability MISSED at most."""
    width = 64 * WORDS
    odds = [(math.comb(width, d) * DIFFER**d * (1 - DIFFER) ** (width - d), math.comb(width - d, bits) / math.comb(width, bits)) for d in range(width + 1)]
    return next(t for t in count(1) if sum(p * (1 - same) ** t for p, same in odds) <= MISSED)


@cache
def nested(first: int, bits: int) -> tuple[int, int]:
    """(tables of so many first bits, tables of the other bits in each shard of these) that a pair at SIMILAR misses with probability MISSED at most: about as many in all as tables(bits)."""
    width, inner = 64 * WORDS, -(-tables(bits) // tables(first))

    def meets(d: int) -> float:
        shuffled, both = (math.comb(width - d, b) / math.comb(width, b) for b in (first, bits))
        return shuffled and shuffled * (1 - (1 - both / shuffled) ** inner)

    odds = [(math.comb(width, d) * DIFFER**d * (1 - DIFFER) ** (width - d), meets(d)) for d in range(width + 1)]
    return next(t for t in count(1) if sum(p * (1 - met) ** t for p, met in odds) <= MISSED), inner


def first_bits(n: int) -> int:
    """Bits that deal n unrelated texts to shards of about 2 * CELL, the first of bits_for(n)."""
    return min(bits_for(n), max(0, round(math.log2(max(1, n) / (2 * CELL)))))


def masks(seed: list[int], bits: int, n: int) -> np.ndarray:
    """The drawn bits of each of n tables, as rows of words."""
    rnd = np.random.default_rng(seed)
    drawn = np.zeros((n, 64 * WORDS), np.uint8)
    for row in drawn:
        row[rnd.choice(64 * WORDS, bits, replace=False)] = 1
    return np.packbits(drawn, axis=1, bitorder="little").view(np.uint64)


def bits_for(n: int) -> int:
    """Bits that deal n unrelated texts to shards of about SHARD."""
    return min(32, max(0, round(math.log2(max(1, n) / SHARD))))


def dealt(rows: DataFrame, level: int, n: int) -> DataFrame:
    """key, node, the words, child, bits and draws of rows with a key, of which n have the same: a child for each table of the level, and how many bits and tables are left to deal it in memory."""
    every = max(bits_for(n), min(level, 1))
    first = max(first_bits(n), min(level, 1))
    number, draws = nested(first, every)
    drawn = masks([42, level, first], first, number)
    salts = np.random.default_rng([43, level]).integers(0, 1 << 63, (2, len(drawn)), dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                words = np.stack([part.column(c).to_numpy().view(np.uint64) for c in FP], axis=1)
                h = (part.column("key").to_numpy().view(np.uint64)[:, None] ^ salts[0]) * salts[1]
                for w in range(WORDS):
                    h = (h ^ (words[:, w, None] & drawn[:, w])) * salts[1]
                    h ^= h >> np.uint64(31)
                who = pa.array(np.repeat(np.arange(part.num_rows), len(drawn)))
                yield pa.RecordBatch.from_arrays([*part.take(who).columns, pa.array(h.ravel().view(np.int64))], names=["key", "node", *FP, "child"])

    out = rows.select("key", "node", *FP).mapInArrow(each, f"key long, node long, {', '.join(f'{c} long' for c in FP)}, child long")
    return out.withColumn("bits", F.lit(every - first)).withColumn("draws", F.lit(draws))


def shards(fps: DataFrame) -> DataFrame:
    """key, node, words, bits, draws: each of staged fingerprints in a shard of every table of first bits; a shard over 8 * CELL is dealt again by other bits as long as that makes fewer pairs."""
    n, done = fps.count(), []
    held = [F.col("child").alias("key"), "node", *FP, "bits", "draws"]
    rows = dealt(fps.withColumn("key", F.lit(0).cast("long")), 0, n).select(*held)
    for level in count(1):
        large = staged(rows.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > 8 * CELL), "large-shards")
        most = large.agg(F.max("n")).first()[0]
        if most is None:
            break
        chosen = rows.join(small_or_not(large.select("key"), BROADCAST_ROWS), "key", "left_semi")
        finer = staged(dealt(chosen, level, most), "dealt")
        pairs = finer.groupBy("key", "child").agg(F.count("*").cast("double").alias("c")).groupBy("key").agg(F.sum(F.col("c") * F.col("c")).alias("after"))
        pays = staged(pairs.join(large, "key").where(2 * F.col("after") < F.col("n").cast("double") * F.col("n")).select("key"), "dealt-shards")
        if pays.isEmpty():
            break
        pays = small_or_not(pays, BROADCAST_ROWS)
        done.append(rows.join(pays, "key", "left_anti"))
        rows = finer.join(pays, "key", "left_semi").select(*held)
    return reduce(DataFrame.unionByName, done, rows)


def parts(fps: np.ndarray, seed: list[int], bits: int, draws: int) -> Iterator[list[np.ndarray]]:
    """For each of so many tables of drawn bits the rows of fps that agree in them, where there are two or more."""
    for mask in masks(seed, bits, draws):
        h = np.zeros(len(fps), np.uint64)
        for w in range(WORDS):
            h = (h ^ (fps[:, w] & mask[w])) * _DRAWN[1, w]
            h ^= h >> np.uint64(31)
        order = np.argsort(h, kind="stable")
        yield [x for x in np.split(order, np.nonzero(np.diff(h[order]))[0] + 1) if len(x) > 1]


def grouped(fps: np.ndarray, at: np.ndarray, seed: list[int]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(root, member) rows of the components of the links among the rows at of fps; over CELL they are dealt again as long as that makes fewer pairs, else they are one group."""
    n = len(at)
    if n <= CELL:
        own, root = forest(fps[at], RADIUS, LEAF)
        tops = np.unique(root)
        yield at[np.concatenate([root, tops])], at[np.concatenate([own, tops])]
        return
    bits = max(1, bits_for(n))
    if 2 * sum(len(x) ** 2 for table in parts(fps[at], seed, bits, tables(bits)) for x in table) >= n * n:
        yield np.full(n, at[0]), at
        return
    for t, table in enumerate(parts(fps[at], seed, bits, tables(bits))):
        for x in table:
            yield from grouped(fps, at[x], [*seed, t])


def groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """key, root, node of rows (key, node, words, bits, draws) sorted by key: the members of each component of a shard's links at RADIUS, found by vantage-point trees in the shards that the other bits deal it to."""
    held: list[pa.RecordBatch] = []

    def found(t: pa.Table) -> Iterator[pa.RecordBatch]:
        key, node = t.column("key").to_numpy(), t.column("node").to_numpy()
        fps = np.stack([t.column(c).to_numpy().view(np.uint64) for c in FP], axis=1)
        bits, draws = t.column("bits").to_numpy(), t.column("draws").to_numpy()
        cuts = [0, *(np.nonzero(key[1:] != key[:-1])[0] + 1).tolist(), len(key)]
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for lo, hi in zip(cuts, cuts[1:], strict=False):
            if hi - lo > 1:
                seed = [42, int(key[lo]) % (1 << 64)]  # other bits for each shard, so that its tables miss other pairs than another's
                for k, table in enumerate(parts(fps[lo:hi], seed, int(bits[lo]), int(draws[lo]))):
                    for x in table:
                        for root, at in grouped(fps, lo + x, [*seed, k]):
                            out.append((np.full(len(at), k), root, at))
        if out:
            table, root, at = (np.concatenate(x) for x in zip(*out, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(key[at]), pa.array(table.astype(np.int32)), pa.array(node[root]), pa.array(node[at])], names=["key", "part", "root", "node"])

    for batch in batches:
        if batch.num_rows:
            t = pa.Table.from_batches([*held, batch])
            key = t.column("key").to_numpy()
            done = int(np.searchsorted(key, key[-1]))
            if done:
                yield from found(t.slice(0, done))
            held = t.slice(done).to_batches()
    if held:
        yield from found(pa.Table.from_batches(held))


def candidates(fps: DataFrame) -> DataFrame:
    """Distinct (node, key): groups in which alike texts meet, from staged fingerprints (node and words).

    The groups of all tables that share texts are one, which a text is in once, however many tables it meets others in. Where that makes more than CELL texts the tables' own groups stay.
    """
    found = shards(fps).repartition("key").sortWithinPartitions("key", "node").mapInArrow(groups, "key long, part int, root long, node long")  # a root is its group's smallest node in each table
    found = staged(found.select("node", "root", F.xxhash64("key", "part", "root").alias("key")), "shard-groups")
    stars = components(found.select(F.col("root").alias("u"), F.col("node").alias("v")).where("u <> v").distinct())
    stars = staged(stars.unionByName(stars.select(F.col("root").alias("node"), "root").distinct()), "met")
    large = staged(stars.groupBy("root").agg(F.count("*").alias("n")).where(F.col("n") > CELL).select("root"), "large-groups")
    if large.isEmpty():
        return stars.select("node", F.col("root").alias("key"))
    large = small_or_not(large, BROADCAST_ROWS)
    own = found.select("node", "key").distinct().join(stars.join(large, "root", "left_semi").select("node"), "node", "left_semi")
    return own.unionByName(stars.join(large, "root", "left_anti").select("node", F.col("root").alias("key")))


def linked(sets: list[np.ndarray], root: np.ndarray) -> Iterator[tuple[int, int]]:
    """Pairs that link the components (root) of a cell's members: every pair of different ones is tested."""
    label, sizes = np.unique(root, return_inverse=True)[1], np.array([len(s) for s in sets])
    named = np.unique(np.concatenate(sets), return_inverse=True)[1]
    ids = np.split(named, np.cumsum(sizes)[:-1])
    mark = np.zeros(int(named.max()) + 1, bool)
    for i in range(len(sets) - 1):
        least, most = np.minimum(sizes[i], sizes[i + 1 :]), np.maximum(sizes[i], sizes[i + 1 :])
        near = (label[i + 1 :] != label[i]) & (least >= SIMILAR * most)
        others = np.nonzero(near)[0] + i + 1
        if not len(others):
            continue
        mark[ids[i]] = True
        cuts = np.concatenate(([0], np.cumsum(sizes[others])[:-1]))
        both = np.add.reduceat(mark[np.concatenate([ids[j] for j in others])], cuts, dtype=np.int64)
        mark[ids[i]] = False
        for j in others[10 * both >= round(10 * SIMILAR) * (sizes[i] + sizes[others] - both)].tolist():
            if label[i] != label[j]:
                label[label == label[j]] = label[i]
                yield i, j


def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges (u, v) of rows (cell, node, root, hashes) sorted by cell."""

    def found(t: pa.Table) -> Iterator[pa.RecordBatch]:
        cell, node, root = (t.column(c).to_numpy() for c in ("cell", "node", "root"))
        hashes = t.column("hashes").combine_chunks()
        hashes = pa.concat_arrays(hashes.chunks) if isinstance(hashes, pa.ChunkedArray) else hashes
        sets = np.split(hashes.flatten().to_numpy(), np.cumsum(hashes.value_lengths().to_numpy())[:-1])
        cuts = [0, *(np.nonzero(cell[1:] != cell[:-1])[0] + 1).tolist(), len(cell)]
        us, vs = [], []
        for lo, hi in zip(cuts, cuts[1:], strict=False):
            at = lo + np.unique(node[lo:hi], return_index=True)[1]
            if len(at) > 1:
                for i, j in linked([sets[x] for x in at], root[at]):
                    us.append(node[at[i]])
                    vs.append(node[at[j]])
        yield pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], names=["u", "v"])

    held: list[pa.RecordBatch] = []
    for batch in batches:
        if batch.num_rows:
            t = pa.Table.from_batches([*held, batch])
            cell = t.column("cell").to_numpy()
            done = int(np.searchsorted(cell, cell[-1]))
            if done:
                yield from found(t.slice(0, done))
            held = t.slice(done).to_batches()
    if held:
        yield from found(pa.Table.from_batches(held))


def _searched(rows: DataFrame) -> DataFrame:
    """Edges (u, v) of rows (cell, node, root, hashes), whose sets are shuffled by cell."""
    return rows.repartition("cell").sortWithinPartitions("cell").mapInArrow(search, "u long, v long").distinct()


def links(keys: DataFrame, texts: DataFrame) -> DataFrame:
    """Spanning edges (u, v) of the texts (node, text) that are alike, by staged distinct (node, key).

    A text brings its cells along until its set is built, so that sets are shuffled once, by cell, and don't meet the cells by a join.
    """
    shards = keys.groupBy("key").agg(F.count("*").alias("n"), F.min("node").alias("least"), F.max("node").alias("most"), F.bit_xor(F.xxhash64("node")).alias("x")).where("n > 1")
    shards = staged(shards.groupBy("n", "least", "most", "x").agg(F.min("key").alias("key")).select("key", "n", "least"), "shards")
    chunks = F.ceil(F.col("n") / CELL).cast("int")
    cell = F.xxhash64("key", "chunk").alias("cell")
    members = keys.join(small_or_not(shards, BROADCAST_ROWS), "key").withColumn("chunk", F.pmod(F.xxhash64(F.col("node"), F.lit(1)), chunks).cast("int"))
    members = staged(members.select("key", "node", "n", "chunk"), "shard-members")

    def sets_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                sets = [shingles(t) for t in part.column(1).to_pylist()]
                ends = np.cumsum([0, *[len(s) for s in sets]])
                hashes = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(sets).view(np.int64)))
                yield pa.RecordBatch.from_arrays([part.column(0), hashes, part.column(2)], names=["node", "hashes", "cells"])

    hot = shards.where(F.col("n") > CELL)
    leaders = hot.select("key", F.col("least").alias("node"), F.explode(F.sequence(F.lit(0), chunks - 1)).alias("chunk")).select(cell, "node")
    asked = members.select(cell, "node").unionByName(leaders).groupBy("node").agg(F.collect_set("cell").alias("cells"))
    sets = texts.join(small_or_not(staged(asked, "alike"), BROADCAST_ROWS), "node").dropDuplicates(["node"])
    sets = staged(sets.select("node", "text", "cells").mapInArrow(sets_of, "node long, hashes array<long>, cells array<long>"), "shingles")
    edges = staged(_searched(sets.select(F.explode("cells").alias("cell"), "node", F.col("node").alias("root"), "hashes")), "alike-edges")
    if hot.isEmpty():
        return edges
    placed = members.where(F.col("n") > CELL).join(components(edges).withColumnRenamed("node", "of"), F.col("node") == F.col("of"), "left")
    placed = staged(placed.select("key", "node", "n", "chunk", F.coalesce("root", "node").alias("root")), "placed")
    torn = placed.groupBy("key", "root").agg(F.count("*").alias("c")).groupBy("key").agg(F.max_by("root", F.struct("c", "root")).alias("largest"), F.count("*").alias("roots"))
    torn = staged(torn.where("roots > 1").select("key", "largest"), "torn")
    placed = placed.join(small_or_not(torn, BROADCAST_ROWS), "key")
    everywhere = placed.where("root <> largest").select("key", "node", "root", F.explode(F.sequence(F.lit(0), chunks - 1)).alias("chunk"))
    more = placed.where("root = largest").select(cell, "node", "root").unionByName(everywhere.select(cell, "node", "root"))
    return edges.unionByName(_searched(more.join(sets, "node").select("cell", "node", "root", "hashes"))).distinct()


def near_copy_filter(docs: DataFrame) -> DataFrame:
    """One row of each component of texts alike, with all columns: the one with the smallest doc_id."""
    node = F.xxhash64(F.coalesce(F.col("text"), F.lit("")))

    def printed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                fps = np.stack([wide_fingerprint(shingles(t)) for t in part.column(2).to_pylist()]).view(np.int64)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *[pa.array(fps[:, w].copy()) for w in range(WORDS)]], names=["doc_id", "node", *FP])

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = staged(docs.select("doc_id", node.alias("node"), "text").mapInArrow(printed, f"doc_id {kind}, node long, {', '.join(f'{c} long' for c in FP)}"), "fingerprints")
    keys = staged(candidates(staged(rows.select("node", *FP).distinct(), "distinct")), "groups")
    stars = staged(components(links(keys, docs.select(node.alias("node"), "text"))), "components")
    stars = small_or_not(stars.withColumnRenamed("node", "of"), BROADCAST_ROWS)
    placed = rows.join(stars, F.col("node") == F.col("of"), "left").select(F.coalesce("root", "node").alias("root"), F.struct("doc_id", F.col("node").alias("key")).alias("row"))
    return keep_first(docs, staged(placed, "members"))
