"""The pipeline's near-dedup stage against brute force."""

import random

import numpy as np
import pytest

import corpus_pipeline
from faultline.llm import near_copies, simhash

from .cases import DOCS, odd_documents, with_clashes


def shingle_set(text):
    w = (text or "").lower().split()
    return {" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def brute_kept(rows):
    sets, root = [shingle_set(r[1]) for r in rows], list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if root[i] != root[j] and 10 * len(sets[i] & sets[j]) >= 8 * len(sets[i] | sets[j]):
                a, b = root[i], root[j]
                root = [b if x == a else x for x in root]
    groups = {}
    for r, top in zip(rows, root, strict=True):
        groups.setdefault(top, []).append(r[0])
    return sorted(min(g) for g in groups.values())


def edited(rnd, base, n):
    words = list(base)
    for at in rnd.sample(range(len(words)), n):
        words[at] = f"new{rnd.randrange(10**6)}"
    return " ".join(words)


@pytest.mark.parametrize("cell", [2000, 5])
def test_stage_links_at_similarity_08(spark, monkeypatch, cell):
    monkeypatch.setattr(near_copies, "CELL", cell)
    rnd, rows = random.Random(9), [r for r in odd_documents() if r[0] and r[0] != 8]
    for k in range(25):
        base = [f"v{rnd.randrange(900)}" for _ in range(300)]
        for c, n in enumerate((0, 5, 5, 12)):  # similarity to the first: about 0.85, the last under 0.8
            rows.append((1000 + 10 * k + c, edited(rnd, base, n), "en", "a", 0))
    base = [f"g{rnd.randrange(900)}" for _ in range(300)]
    rows += [(2000 + c, edited(rnd, base, c // 4), "en", "a", 0) for c in range(40)]  # a group of chains
    got = corpus_pipeline.near_dedup(spark, with_clashes(spark.createDataFrame(rows, DOCS)), "")
    assert sorted(r["doc_id"] for r in got.select("doc_id").collect()) == brute_kept(rows)
    assert got.limit(0).count() == corpus_pipeline.near_dedup(spark, spark.createDataFrame([], DOCS), "").count() == 0


def test_vantage_point_trees_find_the_candidates(spark, monkeypatch):
    """Groups of the fingerprints' shards, drawn bits and all, hold every pair at 0.8, and trees with bounds prune on clusters."""
    rnd, texts = random.Random(3), []
    for _ in range(150):
        base = [f"v{rnd.randrange(5000)}" for _ in range(200)]
        texts += [" ".join(base), edited(rnd, base, 2), " ".join(f"u{rnd.randrange(5000)}" for _ in range(200))]
    fps = np.stack([near_copies.wide_fingerprint(near_copies.shingles(t)) for t in texts])
    sizes = []
    tree = simhash.VPTree
    monkeypatch.setattr(simhash, "VPTree", lambda *a: (sizes.append(len(a[0])), tree(*a))[1])
    own, root = simhash.forest(fps, near_copies.RADIUS, 8)
    assert sizes == [450] and sorted(zip(own.tolist(), root.tolist())) == [(3 * k + 1, 3 * k) for k in range(150)]
    near = tree(np.concatenate([fps[2:100:3], np.repeat(fps[:1], 30, 0), fps[101:200:3]]), 8)  # a cluster among others
    list(near.links(fps[:1], near_copies.RADIUS))
    assert near.pruned
    monkeypatch.setattr(near_copies, "SHARD", 16)
    monkeypatch.setattr(near_copies, "CELL", 30)
    df = near_copies.staged(spark.createDataFrame([(k, *f.view(np.int64).tolist()) for k, f in enumerate(fps)], "node long, w0 long, w1 long, w2 long, w3 long"), "fps")
    assert near_copies.bits_for(450) == 5 and near_copies.shards(df).groupBy("key").count().agg({"count": "max"}).first()[0] < 120
    keys = {}
    for r in near_copies.candidates(df).collect():
        keys.setdefault(r["node"], set()).add(r["key"])
    assert all(keys.get(3 * k, set()) & keys.get(3 * k + 1, set()) for k in range(150)) and not any(3 * k + 2 in keys for k in range(150))


@pytest.mark.parametrize(("cell", "once"), [(2000, True), (20, False)])
def test_a_text_meets_others_once_for_all_tables(spark, monkeypatch, cell, once):
    """Groups that different tables find of the same texts are one; over CELL texts the tables' own groups stay, and hold the same pairs."""
    rnd = random.Random(4)
    monkeypatch.setattr(near_copies, "SHARD", 16)
    monkeypatch.setattr(near_copies, "CELL", cell)
    base = [f"v{rnd.randrange(5000)}" for _ in range(200)]
    texts = [edited(rnd, base, c // 3) for c in range(30)] + [" ".join(f"u{rnd.randrange(5000)}" for _ in range(200)) for _ in range(120)]
    fps = np.stack([near_copies.wide_fingerprint(near_copies.shingles(t)) for t in texts])
    near = np.bitwise_count(fps[:, None] ^ fps[None]).sum(axis=-1) <= near_copies.RADIUS
    df = near_copies.staged(spark.createDataFrame([(k, *f.view(np.int64).tolist()) for k, f in enumerate(fps)], "node long, w0 long, w1 long, w2 long, w3 long"), "fps")
    rows = [tuple(r) for r in near_copies.candidates(df).collect()]
    keys = {}
    for node, key in rows:
        keys.setdefault(node, set()).add(key)
    assert len(rows) == len(set(rows)) and (len(rows) == len(keys)) is once
    assert all(keys[0] & keys[k] for k in range(1, 30) if near[0, k]) and near[0, 1:30].any()


def test_texts_are_shuffled_for_few_tables_that_miss_no_more():
    """The first bits' tables are few and grow slowly; with the tables that a task deals them to, a pair at 0.8 is missed as seldom as by tables of all bits."""
    copies = {}
    for n in (38_453, 191_605, 11_000_000):
        bits, first = near_copies.bits_for(n), near_copies.first_bits(n)
        copies[n], inner = near_copies.nested(first, bits)
        assert 2 * copies[n] <= near_copies.tables(bits) and copies[n] * inner <= 1.7 * near_copies.tables(bits)
    assert copies[191_605] <= 2.5 * copies[38_453]
    rnd = np.random.default_rng(1)  # by trial, with the very draws
    differ = np.packbits(rnd.random((4000, 256)) < near_copies.DIFFER, axis=1, bitorder="little").view(np.uint64)
    outer, inner = near_copies.nested(3, 8)
    met = np.zeros(4000, bool)
    for k, mask in enumerate(near_copies.masks([42, 0, 3], 3, outer)):
        for part in near_copies.masks([42, k], 5, inner):
            met |= ~(differ & (mask | part)).any(axis=1)
    assert (~met).mean() <= 0.004


def test_a_set_is_shuffled_once(spark):
    """The cells come with the texts: the sets meet nothing by a join before they are dealt to cells."""
    import inspect

    rows = spark.createDataFrame([(c, k, k, [k, k + 1]) for c in (7, 9) for k in range(3)], "cell long, node long, root long, hashes array<long>")
    assert list(inspect.signature(near_copies._searched).parameters) == ["rows"]
    assert "Join" not in near_copies._searched(rows)._jdf.queryExecution().toString()
