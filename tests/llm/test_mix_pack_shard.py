"""Mixing (4), packing (3), sharding (8) and the pipeline against brute force."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from faultline.llm import mixing, packing, sharding

from .cases import DOCS, odd_documents, odd_frame, rows_of, with_clashes
from .test_dedup_quality import LOWER, WORD
from .test_near_copies import brute_kept


def brute_targets(sizes, weights=(3, 1, 2)):
    w = [weights[i % 3] for i in range(len(sizes))]
    out, stopped, total = [0.0] * len(sizes), set(), 1.5 * sum(sizes)
    while True:
        left = total - sum(2 * sizes[i] for i in stopped)
        rest = [i for i in range(len(sizes)) if i not in stopped]
        for i in range(len(sizes)):
            out[i] = 2.0 * sizes[i] if i in stopped else left * w[i] / sum(w[j] for j in rest)
        over = {i for i in rest if out[i] > 2 * sizes[i]}
        if not over:
            return out
        stopped |= over


@pytest.mark.parametrize(("seed", "rows"), [(0, 10_000), (1, 3), (2, 2)])
def test_targets(spark, monkeypatch, seed, rows):
    monkeypatch.setattr(mixing, "BUCKET_ROWS", rows)
    rnd = random.Random(seed)
    for sizes in ([5], [0, 0], [rnd.randrange(10_000) for _ in range(9)], [rnd.choice([1, 2, 3000]) for _ in range(40)]):
        names = [f"é{i:02}" if i % 2 else f"a{i:02}" for i in range(len(sizes) - 1)] + [None]
        order = sorted(range(len(sizes)), key=lambda i: (names[i] is None, (names[i] or "").encode()))
        want = dict(zip([names[i] for i in order], brute_targets([sizes[i] for i in order]), strict=True))
        frame = spark.createDataFrame(list(zip(names, sizes, strict=True)), "name string, source_size long").repartition(3)
        assert {r["name"]: r["target"] for r in mixing.targets(frame).collect()} == {k: pytest.approx(v) for k, v in want.items()}


def test_shards_are_multinomial_draws(spark):
    rows = [(f"s{i}" if i else None, q, q + 2) for i, q in enumerate((40_000, 100, 9_000, 0, 30_900))]
    sources = spark.createDataFrame(rows, "name string, quota long, slots long")
    got = mixing.drawn(sources, 1000).collect()
    by_source, by_shard = defaultdict(list), defaultdict(int)
    for r in got:
        by_source[r["name"]].append((r["first"], r["n"], r["shard"]))
        by_shard[r["shard"]] += r["n"]
    for name, quota, slots in rows:
        at = 0
        for first, n, _ in sorted(by_source[name]):
            assert first == at
            at += n
        assert at >= slots * (quota > 0) and [x[2] for x in sorted(by_source[name])] == sorted(x[2] for x in by_source[name])
    open_shards = [j for j in by_shard if j < 81]
    assert len(open_shards) == 81 and all(by_shard[j] == 1000 for j in open_shards)
    p = 40_000 / 80_000
    counts = [next((n for _, n, s in by_source[None] if s == j), 0) for j in open_shards]
    chi = sum((n - 1000 * p) ** 2 / (1000 * p * (1 - p)) for n in counts)
    assert 40 < chi < 140 and len(set(counts)) > 10  # 81 +- 13


@pytest.mark.parametrize("block", [1, 7, 256])
def test_mix_report(spark, block):
    rows = odd_documents()
    docs = spark.createDataFrame(rows, DOCS).where("doc_id is null or doc_id not in (6, 7)")
    rows = [r for r in rows if r[0] not in (6, 7)]
    got = mixing.mix_report(with_clashes(docs), block).collect()
    size = defaultdict(int)
    for r in rows:
        size[r[3]] += len(WORD.findall(r[1] or ""))
    names = sorted(size, key=lambda x: (x is None, (x or "").encode()))
    want = dict(zip(names, brute_targets([size[n] for n in names]), strict=True))
    assert sorted(((r["doc_id"], r["size"]) for r in got), key=repr) == sorted(((r[0], len(WORD.findall(r[1] or ""))) for r in rows), key=repr)
    taken, source_of = defaultdict(int), {r[0]: r[3] for r in rows}
    for r in got:
        assert 0 <= r["taken"] <= 2 * r["size"]
        s = source_of[r["doc_id"]]
        assert r["source_size"] == size[s] and r["target"] == pytest.approx(want[s])
        taken[s] += r["taken"]
    for s in names:
        assert abs(taken[s] - want[s]) <= 1
    assert rows_of(mixing.mix_report(docs.repartition(3), block)) == rows_of(mixing.mix_report(docs, block))


def test_another_draw_takes_other_documents(spark, monkeypatch):
    rows = [(i, " ".join(f"w{i}x{j}" for j in range(30 + i % 50)), "en", f"s{i % 3}", 0) for i in range(400)]
    docs = spark.createDataFrame(rows, DOCS)
    monkeypatch.setattr(mixing, "SHARD_SLOTS", 256)
    found = []
    for seed in ("draw", "another", "third"):
        monkeypatch.setattr(mixing, "DRAW_SEED", seed)
        placed, slots, c = mixing.plan(docs, ["doc_id"], block_words=7)
        got = slots.collect()
        assert len({r["shard"] for r in got}) > 5
        # no block twice in a pass, and full passes have each block
        each = Counter((r["name"], r["pass"], r["block"]) for r in got)
        assert max(each.values()) == 1
        report = mixing.mix_report(docs, 7).collect()
        found.append({r["doc_id"]: r["taken"] for r in report})
        size, taken = {r["doc_id"]: r["size"] for r in report}, Counter()
        for r in report:
            taken[r["doc_id"] % 3] += r["taken"]
        assert all(0 <= found[-1][i] <= 2 * size[i] for i in size) and all(abs(taken[r["doc_id"] % 3] - r["target"]) <= 1 for r in report)
    assert sum(found[0][i] != found[1][i] for i in found[0]) > 20 and sum(found[1][i] != found[2][i] for i in found[0]) > 20


def test_mix_documents_have_the_words_of_the_report(spark):
    docs = with_clashes(odd_frame(spark))
    mixed = mixing.mix_documents(docs, 7)
    assert mixed.columns == docs.columns
    got, want = defaultdict(int), defaultdict(int)
    texts = {r[0]: WORD.findall(r[1] or "") for r in odd_documents()}
    for r in mixed.select("doc_id", "text", "source", "n_chars").collect():
        words = iter(texts[r["doc_id"]])
        own = WORD.findall(r["text"])
        assert all(w in words for w in own)  # in their order
        got[r["doc_id"]] += len(own)
    for r in mixing.mix_report(docs, 7).collect():
        want[r["doc_id"]] += r["taken"]
    assert got == {k: v for k, v in want.items() if v}
    assert mixing.mix_documents(docs.limit(0)).count() == mixing.mix_report(docs.limit(0)).count() == 0


def test_permutation_is_one(spark):
    df = spark.createDataFrame([(n, f"s{n}") for n in (1, 2, 3, 10, 97, 1000)], "n_blocks long, name string")
    df = df.withColumn("perm_a", mixing._coprime(F.col("n_blocks"), F.col("name"))).withColumn("perm_b", F.lit(5))
    rows = df.select("n_blocks", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_blocks") - 1)).alias("k"), "perm_a", "perm_b").withColumn("to", mixing._permuted(F.col("k")))
    for r in rows.groupBy("n_blocks").agg(F.sort_array(F.collect_list("to")).alias("x")).collect():
        assert r["x"] == list(range(r["n_blocks"]))


def test_packing(spark):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    docs = with_clashes(odd_frame(spark))
    packed = packing.pack_documents(docs, keep_ids=True).persist()
    rows = packed.collect()
    want = sorted([(r[0], tuple([*tokenizer.encode(r[1] or "", add_special_tokens=False).ids, 2])) for r in odd_documents()], key=repr)
    by_doc, fill = defaultdict(list), defaultdict(list)
    for r in rows:
        assert r["length"] == len(r["ids"]) // 4 <= 1024 and r["ids_crc32"] == zlib.crc32(bytes(r["ids"]))
        by_doc[r["doc_id"]].append((r["piece"], r["start"], r["length"], bytes(r["ids"])))
        fill[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in fill.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024
    for doc_id, ids in {k: v for k, v in want}.items():
        copies = sum(1 for w in want if w[0] == doc_id)
        parts = sorted(by_doc[doc_id])[::copies]
        assert np.frombuffer(b"".join(p[3] for p in parts), "<u4").tolist() == list(ids)
        assert [p[1] for p in parts] == packing.cut(len(ids), 1024) and all(p[2] == 1024 for p in parts[1:])
    total = sum(r["length"] for r in rows)
    assert len(fill) <= -(-total // 1024) + 1
    joined = packing.sequences(packed)
    assert joined.agg(F.sum("length")).first()[0] == total and joined.where("length(ids) <> 4 * length").count() == 0
    assert packing.pack_documents(docs.limit(0)).count() == 0


@pytest.mark.parametrize(("n", "starts"), [(1, [0]), (1024, [0]), (1025, [0, 1]), (2048, [0, 1024]), (2050, [0, 2, 1026])])
def test_cut(n, starts):
    assert packing.cut(n, 1024) == starts


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 99), min_size=1, max_size=60))
def test_local_search_never_loses_or_overfills(lengths):
    bins = packing.best_fit(lengths, 100)
    before, squares = len(bins), sum(sum(lengths[i] for i in b) ** 2 for b in bins)
    after = packing.improve([list(b) for b in bins], lengths, 100)
    assert sorted(i for b in after for i in b) == list(range(len(lengths)))
    assert all(sum(lengths[i] for i in b) <= 100 for b in after) and -(-sum(lengths) // 100) <= len(after) <= before
    assert sum(sum(lengths[i] for i in b) ** 2 for b in after) >= squares


def test_local_search_empties_a_bin():
    lengths = [60, 50, 40, 30, 20]
    assert len(packing.improve([[0, 4], [1, 3], [2]], lengths, 100)) == 2


def fewest(lengths, capacity):
    """The exact optimum: bins as a sorted tuple of fills, piece by piece."""
    states = {()}
    for n in sorted(lengths, reverse=True):
        states = {tuple(sorted([*s[:k], s[k] + n, *s[k + 1 :]])) for s in states for k in range(len(s)) if s[k] + n <= capacity} | {tuple(sorted([*s, n])) for s in states}
    return min(map(len, states))


def test_local_search_against_the_optimum():
    rnd, over = random.Random(11), []
    for _ in range(150):
        lengths = [rnd.randint(1, 20) for _ in range(rnd.randint(1, 8))]
        worst = [[i] for i in range(len(lengths))]
        found = [len(packing.improve(b, lengths, 20)) for b in (packing.best_fit(lengths, 20), worst)]
        over.append([n - fewest(lengths, 20) for n in found])
    assert all(0 <= x <= 1 for both in over for x in both) and sum(x for x, _ in over) <= 3


def test_local_search_beats_best_fit_on_many_pieces():
    rnd = random.Random(2)
    lengths = [rnd.randint(250, 700) for _ in range(2000)]
    bins = packing.best_fit(lengths, 1024)
    before = len(bins)
    after = packing.improve(bins, lengths, 1024)
    assert len(after) < before and sorted(i for b in after for i in b) == list(range(2000)) and all(sum(lengths[i] for i in b) <= 1024 for b in after)


def brute_capacity(sizes, shards):
    c = max(max(sizes, default=0), -(-sum(sizes) // shards))
    while True:
        used, held = 1, 0
        for s in sizes:
            used, held = (used + 1, s) if held + s > c else (used, held + s)
        if used <= shards:
            return c
        c += 1


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 50), max_size=40), st.integers(1, 9))
def test_minimax(sizes, shards):
    c = sharding.minimax(sizes, shards)
    assert c == brute_capacity(sizes, shards) and sharding.greedy(sizes, c, shards) is not None
    cuts = [0, *sharding.level(sizes, c, shards), len(sizes)]
    assert cuts == sorted(cuts) and all(sum(sizes[a:b]) <= c for a, b in zip(cuts, cuts[1:], strict=False))
    assert not sizes or c == max(max(sizes), -(-sum(sizes) // shards)) or sharding.greedy(sizes, c - 1, shards) is None


@pytest.mark.parametrize(("n", "hot"), [(5, 0), (400, 0), (400, 4000), (3000, 200)])
def test_cuts_through_ranges_are_exact(spark, monkeypatch, n, hot):
    monkeypatch.setattr(sharding, "FIRST_BITS", 2)
    monkeypatch.setattr(sharding, "STEP_BITS", 3)
    rnd = random.Random(n + hot)
    groups = sorted({rnd.randrange(-(2**63), 2**63): rnd.randrange(1, 60) for _ in range(n)}.items())
    groups[n // 2] = (groups[n // 2][0], groups[n // 2][1] + hot)
    cuts, capacity = sharding.find_cuts(spark.createDataFrame(groups, "key long, size long"), 16)
    sizes = [s for _, s in groups]
    assert capacity == brute_capacity(sizes, 16)
    held = [0] * 16
    for k, s in groups:
        held[sum(k >= c for c in cuts)] += s
    assert max(held) == capacity and sum(held) == sum(sizes)


def test_shard_report(spark):
    got = sharding.shard_report(with_clashes(odd_frame(spark))).collect()
    text = lambda r: (r[1] or "").encode()
    assert sorted(((r["doc_id"], r["size"], r["text_crc32"]) for r in got), key=repr) == sorted(((r[0], len(text(r)) + 1, zlib.crc32(text(r))) for r in odd_documents()), key=repr)
    slots, shards_of = defaultdict(list), defaultdict(set)
    for r in got:
        slots[r["shard"]].append(r["slot"])
        shards_of[(r["size"], r["text_crc32"])].add(r["shard"])
        assert r["law"] == "bytes" and r["grown_shard"] is None and 0 <= r["shard"] < 16
    assert all(sorted(x) == list(range(len(x))) for x in slots.values()) and all(len(x) == 1 for x in shards_of.values())
    assert sharding.shard_report(odd_frame(spark).limit(0)).count() == 0


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    rows = odd_documents() + [(300 + i, " ".join(f"q{(i * 13 + j * 3) % 1009}" for j in range(90)), "en", "abc"[i % 3], 9) for i in range(40)]
    rows += [(400, rows[42][1], "en", "a", 1), (401, rows[42][1].upper(), "en", "a", 1)]
    spark.createDataFrame(rows, DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        assert k == len(corpus_pipeline.STAGES) - 1 or out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
    stages = [spark.read.parquet(f"{tmp_path}/{k}") for k in range(5)]
    ids = [{r[0] for r in s.select("doc_id").collect()} for s in stages]
    assert ids[1] < ids[0] and 400 not in ids[1] and 401 in ids[1] and ids[2] <= ids[1] and ids[3] <= ids[2] and ids[4] == ids[3]
    frames = [sorted(map(tuple, s.select("doc_id", "text", "lang", "source").collect()), key=repr) for s in stages[:4]]
    groups = defaultdict(list)
    for doc_id, text, *_ in frames[0]:
        groups[(text or "").translate(LOWER)].append(doc_id)
    assert sorted(r[0] for r in frames[1]) == sorted(max(g) for g in groups.values())
    assert sorted(r[0] for r in frames[2]) == brute_kept(frames[1])
    sizes, mixed = defaultdict(int), defaultdict(int)
    for rows, out in ((frames[2], sizes), (frames[3], mixed)):
        for _, text, _, source in rows:
            out[source] += len(WORD.findall(text))
    names = sorted(sizes, key=lambda x: (x is None, (x or "").encode()))
    assert all(abs(mixed[n] - want) <= 1 for n, want in zip(names, brute_targets([sizes[n] for n in names]), strict=True))
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tokens = defaultdict(int)
    for doc_id, text, *_ in frames[3]:
        tokens[doc_id] += len(tokenizer.encode(text, add_special_tokens=False).ids) + 1
    assert {r[0]: r[1] for r in stages[4].groupBy("doc_id").agg(F.sum("length")).collect()} == tokens
    words = stages[3].select(F.sum(F.size(F.regexp_extract_all("text", F.lit(r"([^\x20\x09-\x0D]+)"))))).first()[0]
    kept = stages[2].select(F.sum(F.size(F.regexp_extract_all("text", F.lit(r"([^\x20\x09-\x0D]+)"))))).first()[0]
    assert words == pytest.approx(1.5 * kept, rel=0.01)
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == stages[4].count()
    empty = tmp_path / "empty"
    spark.createDataFrame([], DOCS).write.parquet(f"{empty}/documents.parquet")
    assert corpus_pipeline.run(spark, str(empty)).count() == 0
