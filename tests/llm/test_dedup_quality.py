"""Quality rules (5), exact dedup (6) and SimHash near-dedup (9) against brute force."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from faultline.llm import exact_dedup, quality_rules, simhash

from .cases import DOCS, odd_documents, odd_frame, rows_of, with_clashes

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def base_measures(text):
    text = text or ""
    w = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    counts = Counter(windows)
    covered = {p for i, g in enumerate(windows) if counts[g] > 1 for p in range(i, i + 3)}
    failed = len(w) < 50 or 100 * len(covered) > 50 * len(w)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered), failed


def test_quality_measures(spark):
    extra = [(200, "a b c a b c a b", "en", "a", 1), (201, "x\nx\n\nx y\nx", "en", "a", 1), (202, "q w e r t " * 30, "en", "a", 1), (203, "#*$ %& |<> a\x0bb\x0cc\rd", "en", "a", 1)]
    docs = spark.createDataFrame(odd_documents() + extra, DOCS)
    got = rows_of(quality_rules.quality_report(with_clashes(docs)).drop("kept"))
    assert got == sorted([(r[0], *base_measures(r[1])) for r in odd_documents() + extra], key=repr)


@settings(max_examples=10, deadline=None)
@given(st.lists(st.text(alphabet="ab \n#", max_size=60), min_size=1, max_size=15))
def test_quality_measures_of_any_text(spark, texts):
    docs = spark.createDataFrame([(i, t, "en", "a", 0) for i, t in enumerate(texts)], DOCS)
    assert rows_of(quality_rules.quality_report(docs).drop("kept")) == sorted([(i, *base_measures(t)) for i, t in enumerate(texts)], key=repr)


def test_adaptive_thresholds_drop_outliers_only(spark):
    def text(i, symbol=""):
        return " ".join(f"w{(i * 31 + j * j * 7) % 997}{symbol}" for j in range(80))

    rows = [(i, text(i), "en", f"s{i % 3}", 0) for i in range(300)] + [(1000 + i, text(i, "$$$"), "en", f"s{i % 3}", 0) for i in range(6)]
    rows += [(2000, text(1), None, None, 0), (2001, text(2, "$$$"), None, None, 0)]
    kept = {r["doc_id"]: r["kept"] for r in quality_rules.quality_report(spark.createDataFrame(rows, DOCS)).collect()}
    assert all(kept[i] == (i < 1000 or i == 2000) for i in kept)


def test_sketches_merge_in_any_order(spark):
    docs = odd_frame(spark)
    one = docs.select("lang", "source", quality_rules.measured(F.col("text")).alias("m"))
    whole = rows_of(quality_rules.sketches(one, "m", ["lang", "source"]))
    parts = [quality_rules.sketches(one.where(f"m.n_words % 2 = {k}"), "m", ["lang", "source"]) for k in (0, 1)]
    merged = parts[0].union(parts[1]).groupBy("lang", "source", "measure", "bucket").agg(F.sum("n").alias("n"))
    assert rows_of(merged) == whole


def test_buckets_keep_leading_bits(spark):
    values = [0, 1, 999, 1023, 1024, 1025, 1026, 5000, 123_457, 10**9, 10**15 + 7]
    got = [r[0] for r in spark.createDataFrame([(v,) for v in values], "v long").select(quality_rules.bucket(F.col("v"))).collect()]
    assert got == [v if v < 1024 else v >> (v.bit_length() - 10) << (v.bit_length() - 10) for v in values]


def test_report_equals_its_sql(spark, tmp_path):
    import duckdb

    from faultline.llm import op5_quality

    rnd = random.Random(6)
    words = [f"w{i}" for i in range(900)]
    rows = odd_documents()[:6] + [(500 + i, "\n".join(" ".join(rnd.choices(words, k=30)) for _ in range(4)) + " #" * int(rnd.expovariate(0.2)), rnd.choice(["en", "de", None]), rnd.choice("abcdefg"), 0) for i in range(150)]
    rows += [(800, " ".join(f"u{i}" for i in range(60)) + "$" * 300_000, "en", "a", 0)]
    spark.createDataFrame(rows, DOCS).coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    got = op5_quality.query(spark, str(tmp_path))
    want = con.sql(f"SELECT {', '.join(got.columns)} FROM ({op5_quality.SQL})").fetchall()
    assert rows_of(got) == sorted(want, key=repr) and {r["kept"] for r in got.collect()} == {True, False}


def test_filters_keep_columns_and_stand_empty_tables(spark):
    docs = with_clashes(odd_frame(spark))
    for f in (quality_rules.quality_filter, exact_dedup.dedup_filter, simhash.near_dup_filter):
        assert f(docs).columns == docs.columns and f(docs).count() > 0
        assert f(docs.limit(0)).count() == 0
    empty = odd_frame(spark).limit(0)
    assert quality_rules.quality_report(empty).count() == exact_dedup.dedup_report(empty).count() == simhash.near_dup_report(empty).count() == 0


def test_exact_dedup(spark):
    got = exact_dedup.dedup_report(with_clashes(odd_frame(spark))).collect()
    groups = defaultdict(list)
    for r in odd_documents():
        groups[(r[1] or "").translate(LOWER)].append(r[0])
    assert len(got) == len(odd_documents())
    by_text = defaultdict(list)
    for r in got:
        by_text[r["text_sha256"]].append(r)
    for text, ids in groups.items():
        rows = by_text[hashlib.sha256(text.encode()).hexdigest()]
        assert sorted((r["doc_id"] for r in rows), key=repr) == sorted(ids, key=repr)
        largest = max((i for i in ids if i is not None), default=None)
        assert {r["keep_id"] for r in rows} == {largest} and {r["group_size"] for r in rows} == {len(ids)}
        assert [r["doc_id"] for r in rows if r["kept"]] == [largest]


def test_exact_dedup_filter_is_the_report(spark):
    docs = odd_frame(spark)
    kept = exact_dedup.dedup_filter(docs)
    assert rows_of(kept.select("doc_id")) == rows_of(exact_dedup.dedup_report(docs).where("kept").select("doc_id"))


def test_chained_hashes_compare_bytes(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup.F, "xxhash64", lambda *c: F.lit(7).cast("long"))
    got = {r["doc_id"]: (r["keep_id"], r["group_size"]) for r in exact_dedup.dedup_report(odd_frame(spark).where("doc_id < 10")).collect()}
    assert got[1] == (2, 2) and got[6] == (7, 2) and got[9] == (9, 1)


def test_sieve_loses_no_key_and_lets_few_others_pass(spark):
    rnd = random.Random(4)
    keys, others = ([(simhash._signed(rnd.getrandbits(64)),) for _ in range(n)] for n in (3000, 20_000))
    keys += [(0,), (-1,), (1 << 37,), (-(1 << 63),)]
    rows = spark.createDataFrame(keys + others, "h long")
    got = {r[0] for r in exact_dedup.sieved(rows, spark.createDataFrame(keys, "h long")).collect()}
    assert got >= {k for (k,) in keys} and len(got) < len(keys) + 20
    assert exact_dedup.sieved(rows, spark.createDataFrame([], "h long")).count() == 0


def test_hot_texts_beyond_any_broadcast(spark, monkeypatch):
    """A text of a third of all rows, and nothing small enough for a broadcast but the hot entries: the same report and the same rows that stay."""
    docs = spark.createDataFrame([(i, ("Hot TEXT " * 50 if i % 3 == 0 else f"text {i % 90}" if i % 3 == 1 else f"unique {i}"), "en", "a", 0) for i in range(600)], DOCS)
    want, stay = rows_of(exact_dedup.dedup_report(docs)), rows_of(exact_dedup.dedup_filter(docs))
    assert {r[2] for r in want if r[0] % 3 == 0} == {200} and {r[2] for r in want if r[0] % 3 == 2} == {1} and len(stay) == len({r[1] for r in want})
    monkeypatch.setattr(exact_dedup, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(exact_dedup, "HOT_ROWS", 50)
    assert rows_of(exact_dedup.dedup_report(docs)) == want and rows_of(exact_dedup.dedup_filter(docs)) == stay


def test_split_of_overfull_buckets_only():
    found = sorted(exact_dedup.split(0, 0, {0: 5, 1: 5, 2: 1, 12: 40}, 4, 8))
    assert sum(x[2] for x in found) == 51 and sum(16 >> depth for _, depth, _ in found) == 16
    assert all(n <= 8 or depth == 4 for _, depth, n in found) and (12, 4, 40) in found and len({d for _, d, _ in found}) > 1
    assert exact_dedup.split(5, 8, {}, 8, 8) == [(5, 8, 0)]


def brute_directory(hashes, capacity):
    done, todo = set(), [(0, 0, hashes)]
    while todo:
        own, depth, held = todo.pop()
        if len(held) <= capacity or depth == 64:
            done.add((simhash._signed(own), depth, len(held)))
        else:
            todo += [(2 * own + s, depth + 1, [h for h in held if (h >> (63 - depth)) & 1 == s]) for s in (0, 1)]
    return done


@pytest.mark.parametrize("capacity", [1, 7, 1000])
def test_directory_is_the_brute_force_one(spark, capacity):
    rnd = random.Random(capacity)
    hashes = list({*[rnd.getrandbits(64) for _ in range(300)], *[(1 << 63) + (1 << 40) + rnd.getrandbits(13) for _ in range(60)], 0, 1, 2**64 - 1})
    df = spark.createDataFrame([(simhash._signed(h),) for h in hashes], "h long")
    found = exact_dedup.directory(df, capacity)
    assert {tuple(r) for r in found.collect()} == brute_directory(hashes, capacity)
    rows = exact_dedup.looked_up(df, found, exact_dedup.least_depth(found)).collect()
    assert len(rows) == len(hashes) and all((r["h"] % 2**64) >> (64 - r["depth"]) == r["prefix"] % 2**64 for r in rows)


def test_dedup_through_many_buckets_and_chains(spark, monkeypatch):
    docs = odd_frame(spark).unionByName(spark.createDataFrame([(1000 + i, f"Text {i % 70} Of many", "en", "a", 0) for i in range(300)], DOCS))
    want = rows_of(exact_dedup.dedup_report(docs))
    real = exact_dedup.F.xxhash64
    monkeypatch.setattr(exact_dedup, "CAPACITY", 3)
    monkeypatch.setattr(exact_dedup, "OWNER_ENTRIES", 20)
    monkeypatch.setattr(exact_dedup.build_index, "__defaults__", ("text", 3, "doc_id"))
    monkeypatch.setattr(exact_dedup.F, "xxhash64", lambda *c: real(*c) % 40)  # about three texts of each hash
    rows = exact_dedup.staged(exact_dedup.prints(docs), "prints")
    index, found = exact_dedup.build_index(docs, rows)
    assert found.count() > 10 and found.agg(F.max("n")).first()[0] <= 3 and index.agg(F.max("chain")).first()[0] > 1
    assert rows_of(exact_dedup.dedup_report(docs)) == want
    monkeypatch.setattr(exact_dedup, "COMBINE_BYTES", 10)
    assert rows_of(exact_dedup.dedup_report(docs)) == want
    assert rows_of(exact_dedup.dedup_filter(docs).select("doc_id")) == rows_of(exact_dedup.dedup_report(docs).where("kept").select("doc_id"))


def brute_fingerprint(text):
    w = WORD.findall((text or "").translate(LOWER))
    shingles = [" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))] if w else []
    bits = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s.encode(), 42)
        for b in range(64):
            bits[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * bits[b] > len(shingles))


def brute_components(ids, fps, radius=4):
    root = list(range(len(fps)))

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius:
                root[max(top(i), top(j))] = min(top(i), top(j))
    out = {}
    for i in range(len(fps)):
        out.setdefault(top(i), []).append(ids[i])
    least = {t: min((x for x in v if x is not None), default=None) for t, v in out.items()}
    return [least[top(i)] for i in range(len(fps))]


def test_simhash_report(spark):
    rnd = random.Random(3)
    rows = list(odd_documents())
    for k in range(12):
        base = [f"v{rnd.randrange(900)}" for _ in range(300)]
        for c in range(6):
            words = list(base)
            for _ in range(c):
                words[rnd.randrange(300)] = "changed"
            rows.append((500 + 10 * k + c, " ".join(words), "en", "a", 0))
    docs = spark.createDataFrame(rows, DOCS)
    fps = [brute_fingerprint(r[1]) for r in rows]
    want = sorted(zip([r[0] for r in rows], [f"{f:016x}" for f in fps], brute_components([r[0] for r in rows], fps), strict=True), key=repr)
    assert rows_of(simhash.near_dup_report(with_clashes(docs))) == want
    kept = simhash.near_dup_filter(docs)
    assert kept.count() == len({w[2] for w in want})


@pytest.mark.parametrize("n", [0, 1, 2, 64, 65, 700])
def test_tree_finds_all_links(n):
    rng = np.random.default_rng(n)
    centres = rng.integers(0, 1 << 63, max(1, n // 7), dtype=np.uint64)
    fps = np.unique(np.array([int(centres[i % len(centres)]) ^ sum(1 << int(b) for b in rng.choice(64, i % 4, replace=False)) for i in range(n)], np.uint64))
    tree = simhash.VPTree(fps, leaf=8)
    got = {(int(i), int(j)) for a, b in tree.links(fps, 4) for i, j in zip(a, b, strict=True)}
    assert got == {(i, j) for i in range(len(fps)) for j in range(len(fps)) if int(fps[i] ^ fps[j]).bit_count() <= 4}
    own, root = simhash.forest(fps, 4)
    label = np.arange(len(fps))
    label[own] = root
    assert [int(fps[x]) for x in label] == [int(fps[x]) for x in brute_components(list(range(len(fps))), [int(f) for f in fps])]


@pytest.mark.parametrize(("shard", "radius"), [(1024, 4), (5, 4), (1, 4), (3, 0), (2, 9)])
def test_shards_lose_no_pair(spark, monkeypatch, shard, radius):
    rnd = random.Random(5)
    base = rnd.getrandbits(64)
    near = [base ^ sum(1 << b for b in rnd.sample(range(64), max(1, radius))) for _ in range(40)]
    fps = list({base, *near, *[rnd.getrandbits(64) for _ in range(400)], *range(0, 9)})
    df = spark.createDataFrame([(simhash._signed(f),) for f in fps], "fp long")
    keys = simhash.shards(df, radius, shard).groupBy("key").agg(F.collect_list("fp").alias("x")).collect()
    together = {frozenset(p) for r in keys for p in ((a % 2**64, b % 2**64) for a in r["x"] for b in r["x"] if a < b)}
    assert all(frozenset((a, b)) in together for a in fps for b in fps if a != b and (a ^ b).bit_count() <= radius)
    assert len(keys) == 1 if shard == 1024 else len(keys) > 1
    monkeypatch.setattr(simhash, "SHARD", shard)
    signed = [simhash._signed(f) for f in fps]
    root = {r["node"]: r["root"] for r in simhash.components(simhash.links(df, radius)).collect()}
    assert [root.get(f, f) for f in signed] == brute_components(signed, fps, radius)


def test_trees_prune_branches():
    rng = np.random.default_rng(8)
    fps = np.unique(rng.integers(0, 1 << 63, 4000, dtype=np.uint64))
    tree = simhash.VPTree(fps)
    assert sum(len(a) for a, _ in tree.links(fps, 4)) >= len(fps)
    assert sum(mu >= 0 for *_, mu, _, _ in tree.nodes) > 50 and tree.pruned > len(fps) and tree.visited > 0


@pytest.mark.parametrize("most", [0, 1000])
def test_hot_keys_are_joined_apart(spark, monkeypatch, most):
    from faultline.llm import common

    monkeypatch.setattr(common, "HOT_ROWS", 10)
    rows = spark.createDataFrame([(i % 7 if i % 3 else 0, i) for i in range(100)], "k long, x long")
    small = spark.createDataFrame([(k, f"v{k}") for k in range(6)], "k long, v string")
    assert rows_of(common.join_hot(rows, small, "k", most)) == rows_of(rows.join(small, "k"))


def test_components_of_chains(spark):
    edges = [(i + 1, i) for i in range(60)] + [(100, 200), (200, 300), (5, 5)]
    got = {r["node"]: r["root"] for r in simhash.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{i: 0 for i in range(1, 61)}, 200: 100, 300: 100}
