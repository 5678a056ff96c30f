"""SimHash near-dedup: vantage-point trees over fingerprints, exact links at a Hamming radius, components.

Fingerprints: the majority of each bit over the XXH64 hashes of a text's shingles, repeats included.

Sharding by Hamming distance. Random 64-bit fingerprints lie at 32 +- 4 bits from any vantage point, so a
radius of 4 overlaps the boundary of a shell for about 70% of them at each level, and a tree over whole
fingerprints would copy nearly all to all shards. Vantage distances are therefore taken inside bit blocks: of
radius + 1 disjoint blocks, two fingerprints within the radius agree on one at least, at distance 0. There the shells of
distance 0 don't overlap, so each fingerprint is in one shard of every block, and no pair is lost. All fingerprints are one shard to begin with;
one of over 4 * SHARD is dealt again by blocks of other bits, as many as bring it to about SHARD, as long as that makes
fewer pairs to look at, at any depth. In each shard a
vantage-point tree over the whole fingerprints finds the exact pairs: a branch is left out when the triangle
bounds |d(q, v) - mu| > radius rule it out, and both sides of a boundary are searched for what overlaps it. A shard emits a spanning forest of its links, never all pairs.

Copies of a fingerprint are one node before anything is searched. Components come from alternating large-star
and small-star steps on shuffled edges, with the edges written to the shared folder after each round.

Defined results: a text without words has fingerprint zero, null too, and such texts link like any others; fewer words
than a shingle: the whole sequence is one; repeated rows have one fingerprint; null doc_ids get the component
of their fingerprint; long texts are read whole; a bit set in just half of the hashes is 0, and pairs at just the radius link; an empty table gives an empty result; other columns of the input don't matter.
"""

from __future__ import annotations

import math
import random
from collections.abc import Iterable, Iterator
from functools import reduce
from itertools import count

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import UPPER, apart, join_hot, small_or_not, staged, unsigned_hex

SHINGLE = 4
RADIUS = 4
SEED = 42
LEAF = 32
#: Fingerprints of a shard, about; one of four times as many is dealt again.
SHARD = 1024
BROADCAST_ROWS = 100_000

_LOWER = bytes.maketrans(UPPER.encode(), UPPER.lower().encode())


def shingle_hashes(text: str | None, shingle: int = SHINGLE) -> Iterator[np.ndarray]:
    """The hashes of the whole text's shingles, repeats included, in slices of bounded number; none without words."""
    found = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not found:
        return
    joined = b" ".join(found)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    k = max(1, len(found) - shingle + 1)
    lo, hi = starts[:k].tolist(), ends[min(shingle, len(found)) - 1 :].tolist()
    view = memoryview(joined)
    hash_of = xxhash.xxh64_intdigest
    for at in range(0, k, 65536):
        yield np.fromiter((hash_of(view[a:b], SEED) for a, b in zip(lo[at : at + 65536], hi[at : at + 65536], strict=True)), np.uint64, min(65536, k - at))


def majority(slices: Iterable[np.ndarray]) -> int:
    """The bits that more than half of the hashes have, as an unsigned number."""
    ones, k = np.zeros(64, np.int64), 0
    for h in slices:
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        k += len(h)
    return int(np.packbits(2 * ones > k, bitorder="little").view(np.uint64)[0])


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """Of the whole text, as an unsigned number."""
    return majority(shingle_hashes(text, shingle))


def fingerprints(docs: DataFrame, carry: list[str], text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """carry's columns and fp, a signed long, of each row."""

    @F.pandas_udf("long")
    def of(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            yield pd.Series(np.array([fingerprint(t, shingle) for t in batch], np.uint64).view(np.int64))

    return docs.select(*carry, of(F.col(text)).alias("fp"))


def distance(a: np.ndarray, b: np.ndarray, wide: bool) -> np.ndarray:
    """Differing bits of fingerprints of one word, or of rows of words (wide)."""
    d = np.bitwise_count(a ^ b)
    return d.sum(axis=-1, dtype=np.int16) if wide else d


class VPTree:
    """A vantage-point tree over fingerprints, unsigned 64-bit words or rows of them, which are sorted in place by branches."""

    def __init__(self, fps: np.ndarray, leaf: int = LEAF):
        self.fps, self.leaf, self.at, self.wide = fps.copy(), leaf, np.arange(len(fps)), fps.ndim > 1
        self.nodes: list[tuple] = []
        self.visited = self.pruned = 0  # branches that queries went into, and that the bounds ruled out
        todo = [(0, len(fps), -1, 0)]
        while todo:
            lo, hi, parent, side = todo.pop()
            me = len(self.nodes)
            if parent >= 0:
                self.nodes[parent][4 + side] = me
            if hi - lo <= leaf:
                self.nodes.append([lo, hi, 0, -1, -1, -1])
                continue
            part = self.fps[lo:hi]
            vantage = part[(hi - lo) // 2].copy()
            d = distance(part, vantage, self.wide)
            mu = int(np.median(d))
            inner = d <= mu
            if inner.all():
                mu -= 1
                inner = d <= mu
            if not inner.any() or inner.all():  # one distance only: the branch can't split by it
                self.nodes.append([lo, hi, 0, -1, -1, -1])
                continue
            order = np.argsort(~inner, kind="stable")
            self.fps[lo:hi], self.at[lo:hi] = part[order], self.at[lo:hi][order]
            cut = lo + int(inner.sum())
            self.nodes.append([lo, hi, vantage, mu, -1, -1])
            todo += [(lo, cut, me, 0), (cut, hi, me, 1)]

    def links(self, queries: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(query index, index in the tree's input) of the pairs within radius, a batch at a time."""
        todo = [(0, np.arange(len(queries)))] if len(self.fps) and len(queries) else []
        while todo:
            node, who = todo.pop()
            lo, hi, vantage, mu, inner, outer = self.nodes[node]
            if mu < 0:
                for q in range(0, len(who), 1024):
                    for k in range(lo, hi, 1024):
                        i, j = np.nonzero(distance(queries[who[q : q + 1024], None], self.fps[None, k : min(k + 1024, hi)], self.wide) <= radius)
                        yield who[q + i], self.at[k + j]
                continue
            d = distance(queries[who], vantage, self.wide).astype(np.int16)
            for to, near in ((inner, d <= mu + radius), (outer, d > mu - radius)):
                some = who[near]
                self.visited, self.pruned = self.visited + len(some), self.pruned + len(who) - len(some)
                if some.size:
                    todo.append((to, some))


def _hook(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Merges the sets of i and j in label, whose entries are roots."""
    while True:
        a, b = label[i], label[j]
        if not (differ := a != b).any():
            return
        i, j = i[differ], j[differ]
        np.minimum.at(label, np.maximum(a, b)[differ], np.minimum(a, b)[differ])
        while ((jumped := label[label]) != label).any():
            label[:] = jumped


def forest(fps: np.ndarray, radius: int, leaf: int = LEAF) -> tuple[np.ndarray, np.ndarray]:
    """(node, root) edges of a spanning forest of the links among fps: fewer than there are fps."""
    label, tree = np.arange(len(fps)), VPTree(fps, leaf)
    held: list[tuple[np.ndarray, np.ndarray]] = []
    n = 0
    for i, j in tree.links(fps, radius):
        held.append((i[i < j], j[i < j]))
        n += len(held[-1][0])
        if n > 500_000:
            _hook(label, *map(np.concatenate, zip(*held, strict=True)))
            held, n = [], 0
    if n:
        _hook(label, *map(np.concatenate, zip(*held, strict=True)))
    own = np.nonzero(label != np.arange(len(fps)))[0]
    return own, label[own]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def masks(level: int, radius: int, bits: int) -> list[int]:
    """radius + 1 disjoint masks of at most bits bits each, other ones at each level."""
    order = list(range(64))
    if level:
        random.Random(level).shuffle(order)
    cuts = [64 * i // (radius + 1) for i in range(radius + 2)]
    return [_signed(sum(1 << x for x in order[a:b][:bits])) for a, b in zip(cuts, cuts[1:], strict=False)]


def shards(fps: DataFrame, radius: int, shard: int | None = None) -> DataFrame:
    """key and fp: each fingerprint of staged distinct ones (fp) in every shard that may hold one within the radius. Equal keys of different blocks only merge shards."""
    shard = shard or SHARD
    rows, done = fps.select(F.lit(0).cast("long").alias("key"), "fp"), []
    for level in count():
        large = staged(rows.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > 4 * shard), "large-shards")
        most = large.agg(F.max("n")).first()[0]
        if most is None:
            break
        bits = max(1, math.ceil(math.log2(most / shard)))
        finer = F.array(*[F.xxhash64("key", F.lit(level), F.lit(j), F.col("fp").bitwiseAND(F.lit(m).cast("long"))) for j, m in enumerate(masks(level, radius, bits))])
        dealt = rows.join(small_or_not(large.select("key"), BROADCAST_ROWS), "key", "left_semi").select("key", "fp", F.explode(finer).alias("child"))
        pairs = dealt.groupBy("key", "child").agg(F.count("*").cast("double").alias("c")).groupBy("key").agg(F.sum(F.col("c") * F.col("c")).alias("after"))
        pays = staged(pairs.join(large, "key").where(2 * F.col("after") < F.col("n").cast("double") * F.col("n")).select("key"), "dealt-shards")
        if pays.isEmpty():
            break
        chosen = small_or_not(pays, BROADCAST_ROWS)
        done.append(rows.join(chosen, "key", "left_anti"))
        rows = dealt.join(chosen, "key", "left_semi").select(F.col("child").alias("key"), "fp")
    return reduce(DataFrame.unionByName, done, rows)


def links(fps: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Spanning edges (u, v) of the links among staged distinct fingerprints (fp)."""
    rows = shards(fps, radius)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, held = np.empty(0, np.int64), np.empty(0, np.int64)

        def found(k: np.ndarray, f: np.ndarray) -> Iterator[pa.RecordBatch]:
            cuts = [0, *(np.nonzero(k[1:] != k[:-1])[0] + 1).tolist(), len(k)]
            us, vs = [], []
            for lo, hi in zip(cuts, cuts[1:], strict=False):
                if hi - lo > 1:
                    part = f[lo:hi]
                    i, j = forest(part.view(np.uint64), radius)
                    us.append(part[i])
                    vs.append(part[j])
            if us:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(us)), pa.array(np.concatenate(vs))], names=["u", "v"])

        for batch in batches:
            k, f = (batch.column(x).to_numpy(zero_copy_only=False) for x in ("key", "fp"))
            keys, held = np.concatenate([keys, k]), np.concatenate([held, f])
            if len(keys) and (done := int(np.searchsorted(keys, keys[-1]))):
                yield from found(keys[:done], held[:done])
                keys, held = keys[done:], held[done:]
        yield from found(keys, held)

    return rows.repartition("key").sortWithinPartitions("key").mapInArrow(search, "u long, v long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of the edges (u, v) but the roots themselves; root is the smallest node of the component."""

    def both(e: DataFrame) -> DataFrame:
        return e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))

    def large(e: DataFrame) -> DataFrame:
        sym = both(e)
        least = sym.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), F.least("u", "m").alias("m"))
        return sym.where("v > u").join(least, F.col("u") == F.col("w")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()

    def small(e: DataFrame) -> DataFrame:
        down = e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v")
        least = down.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), "m")
        moved = down.join(least, F.col("u") == F.col("w")).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        return moved.union(least.select(F.col("w").alias("u"), F.col("m").alias("v"))).distinct()

    def state(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    edges = staged(edges.where("u <> v"), "edges")
    before = None
    while (now := state(edges)) != before:
        edges, before = staged(small(large(edges)), "stars"), now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))


def clustered(docs: DataFrame, carry: list[str], shingle: int = SHINGLE, radius: int = RADIUS) -> tuple[DataFrame, DataFrame]:
    """(carry's columns and fp of each row; fp, root of each distinct fingerprint)."""
    rows = staged(fingerprints(docs, carry, shingle=shingle), "fingerprints")
    fps = staged(rows.select("fp").distinct(), "distinct")
    stars = staged(components(links(fps, radius)), "components")
    return rows, fps.join(small_or_not(stars, BROADCAST_ROWS), F.col("fp") == F.col("node"), "left").select("fp", F.coalesce("root", "fp").alias("root"))


def near_dup_report(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint, component_id of each row."""
    rows, roots = clustered(docs, ["doc_id"])
    first = rows.groupBy("fp").agg(F.min("doc_id").alias("first"))
    placed = staged(roots.join(first, "fp"), "roots")
    ids = staged(placed.groupBy("root").agg(F.min("first").alias("component_id")), "component-ids")
    by_fp = staged(join_hot(placed, ids, "root", BROADCAST_ROWS).select("fp", "component_id"), "fingerprint-ids")
    return join_hot(rows, by_fp, "fp", BROADCAST_ROWS).select("doc_id", unsigned_hex(F.col("fp")).alias("fingerprint"), "component_id")


def near_dup_filter(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """One row of each component, with all columns: the one with the smallest doc_id."""
    key = F.xxhash64(F.coalesce(F.col("text"), F.lit(""))).alias("key")
    rows, roots = clustered(docs.select("doc_id", "text", key), ["doc_id", "key"], shingle, radius)
    rows = staged(join_hot(rows, staged(roots, "roots"), "fp", BROADCAST_ROWS).select("root", F.struct("doc_id", "key").alias("row")), "members")
    return keep_first(docs, rows)


def keep_first(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """Of each root of staged rows (root, row: doc_id and key of the text) the docs' row with the smallest doc_id."""
    stay = staged(rows.groupBy("root").agg(F.min("row").alias("stay"), F.count("*").alias("n")).where("n > 1").select("root", "stay"), "stay")
    same_row = F.col("row").eqNullSafe(F.col("stay"))
    lost = join_hot(rows, stay, "root", BROADCAST_ROWS).where(~same_row).select(F.col("row.doc_id").alias("lost_id"), F.col("row.key").alias("lost_key")).distinct()
    lost = apart(staged(lost, "lost"), docs)
    lost_id, lost_key = (F.col(c) for c in lost.columns)
    kept = docs.join(small_or_not(lost, BROADCAST_ROWS), F.col("doc_id").eqNullSafe(lost_id) & (F.xxhash64(F.coalesce(F.col("text"), F.lit(""))) == lost_key), "left_anti")
    if rows.groupBy("row").agg(F.count("*").alias("n")).where("n > 1").isEmpty():
        return kept
    return kept.dropDuplicates(["doc_id", "text"])
