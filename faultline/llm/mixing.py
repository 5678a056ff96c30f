"""Mixing sources to target weights, in fixed-length blocks.

1. Targets: the sources, ordered by code point with null last, share 150% of all words by their weights; a
   target stops at twice its source's words, and the excess is shared again by weight. In order of limit / weight
   the first source that doesn't reach its limit gives the level at which all from there on share; running sums find it.
2. Blocks: each source's documents, in a fixed pseudorandom order, are one stream of words cut into blocks of
   block_words words; the last may be shorter.
3. Draws: each of an output shard's SHARD_SLOTS slots draws its source by a keyed hash, in proportion to the targets, so that the
   sources' counts in a shard are a multinomial draw. A source's slots are numbered through the shards in their order, and cut into passes of as many slots as it
   has blocks. Draws beyond a source's target are left out, what draws leave short of it fills closing shards, so that totals meet the targets.
4. Slots map to blocks through a pseudorandom permutation of the source's block indices for each pass, x -> (a x + b) mod n
   with gcd(a, n) = 1, and join the blocks by index. A full pass takes every index. Of the last pass, which takes r of n indices, each shard has a range of
   indices of its own, as long as its share of the r slots stretched to n; of it the shard takes as many as it drew. So the drawn counts decide
   which blocks the mix takes again, or at all. The last slot is cut to the words that are left.

Positions in a stream and numbers of slots are two-level prefix sums (within buckets, then over bucket totals), so
that a source with a third of all rows is never in one task. Sources are rows of a table, however many there are. Reruns agree: all draws are keyed hashes.

Defined results: null or empty text has size 0 and takes nothing; long texts span many blocks; null source is a source of its own, the last;
equal rows are counted before anything else and stand one after the other in the stream, each a document of its own; one source
alone stops at twice its words; sources with equal limit for their weight stop together; rows without a doc_id are documents like others; extra columns
are ignored by the report and kept by the mix, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import apart, bucket_count, fresh, let, small_or_not, staged, words

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2
BLOCK_WORDS = 256
SHARD_SLOTS = 256
BUCKET_DOCS = 2_000
#: Rows of one bucket of a two-level prefix sum over sources or shards.
BUCKET_ROWS = 10_000
SEED = "mix"
#: Of the draws of sources.
DRAW_SEED = "draw"
#: Rows of sources, or of cells of the draw, that may be broadcast, if names are short: about 100 bytes each.
BROADCAST_ROWS = 50_000


def running(rows: DataFrame, order: list[Column], sums: dict[str, Column], tag: str) -> DataFrame:
    """The rows with the running sums of the given values before each in the order of all rows: within key ranges, then over their totals."""
    parts = rows.repartitionByRange(bucket_count(rows.count(), BUCKET_ROWS), *order).withColumn("part", F.spark_partition_id())
    parts = staged(parts, tag)
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row for BUCKET_ROWS rows
    totals = parts.groupBy("part").agg(*[F.sum(v).alias(f"{k}_part") for k, v in sums.items()])
    totals = totals.select("part", *[F.coalesce(F.sum(f"{k}_part").over(before), F.lit(0)).alias(f"{k}_part") for k in sums])
    within = Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    out = parts.select("*", *[F.coalesce(F.sum(v).over(within), F.lit(0)).alias(k) for k, v in sums.items()]).join(F.broadcast(totals), "part")
    return out.select(*rows.columns, *[(F.col(k) + F.col(f"{k}_part")).alias(k) for k in sums])


def targets(sources: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """name, source_size, target of each source of staged rows (name, source_size)."""
    placed = running(sources, [F.col("name").isNull().alias("last"), F.col("name")], {"at": F.lit(1)}, "sources")
    w = F.get(F.array(*[F.lit(float(x)) for x in weights]), (F.col("at") % len(weights)).cast("int"))
    placed = placed.select("name", "source_size", w.alias("w"), (F.lit(float(most)) * F.col("source_size")).alias("most"))
    placed = staged(placed, "limits")
    total, weight = placed.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("w"), F.lit(0.0))).first()
    order = [F.col("most") / F.col("w"), F.col("name").isNull(), F.col("name")]
    steps = running(placed, order, {"stopped": F.col("most"), "gone": F.col("w")}, "levels")
    left, rest = F.lit(share * total) - F.col("stopped"), F.lit(weight) - F.col("gone")
    first = steps.where(F.col("most") * rest > left * F.col("w")).agg(F.min_by(left / rest, F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)]))).first()[0]
    level = F.col("most") if first is None else F.least("most", F.col("w") * first)
    return placed.select("name", "source_size", level.alias("target"))


def _coprime(n: Column, key: Column) -> Column:
    """A pseudorandom number below n without a common factor with n (1 if none of 48 draws has it)."""

    def gcd(a: Column, b: Column) -> Column:
        step = F.aggregate(
            F.sequence(F.lit(1), F.lit(92)),
            F.struct(a.cast("long").alias("a"), b.cast("long").alias("b")),
            lambda s, _: F.when(s["b"] == 0, s).otherwise(F.struct(s["b"].alias("a"), (s["a"] % F.greatest(s["b"], F.lit(1))).alias("b"))),
        )
        return step["a"]

    draws = F.transform(F.sequence(F.lit(1), F.lit(48)), lambda j: F.lit(1) + F.pmod(F.xxhash64(key, F.lit(SEED), j), F.greatest(n - 1, F.lit(1))))
    return F.coalesce(F.get(F.filter(draws, lambda a: gcd(a, n) == 1), F.lit(0)), F.lit(1)).cast("long")


def _permuted(k: Column) -> Column:
    """The block index of slot index k of the row's source: exact in decimals of 38 digits."""
    wide = k.cast("decimal(18,0)") * F.col("perm_a").cast("decimal(18,0)") + F.col("perm_b")
    return F.pmod(wide, F.col("n_blocks").cast("decimal(18,0)")).cast("long")


def document_key(docs: DataFrame) -> Column:
    return F.xxhash64(docs["doc_id"], docs["text"], F.lit(SEED))


def drawn(sources: DataFrame, shard_slots: int = SHARD_SLOTS) -> DataFrame:
    """name, shard, n, first: how many slots of each shard go to a staged source (name, quota, slots), and the number of the first among the source's slots.

    Shards are drawn for as many slots as all sources have; then closing shards give each source what it is short of. A source's slots may run beyond what it needs.
    """
    spark = sources.sparkSession
    aims = running(sources.where("quota > 0").select("name", "quota", "slots"), [F.col("name").isNull(), F.col("name")], {"low": F.col("quota")}, "draw-shares")
    aims = staged(aims.withColumn("high", F.col("low") + F.col("quota")), "draw-shares")
    total, slots, n = aims.agg(F.sum("quota"), F.sum("slots"), F.count("*")).first()
    if not n:
        return spark.createDataFrame([], f"name {sources.schema['name'].dataType.simpleString()}, shard long, n long, first long")
    shards = bucket_count(slots, shard_slots)
    width = bucket_count(total, 4 * n)  # of a cell: a draw meets the few sources whose share touches its cell
    cells = aims.select("name", "low", "high", F.explode(F.sequence(F.expr(f"low div {width}"), F.expr(f"(high - 1) div {width}"))).alias("cell"))
    at = F.pmod(F.xxhash64(F.lit(DRAW_SEED), F.col("id")), F.lit(total))
    draws = spark.range(shards * shard_slots).select(F.expr(f"id div {shard_slots}").alias("shard"), at.alias("at")).withColumn("cell", F.expr(f"at div {width}"))
    hits = draws.join(small_or_not(staged(cells, "draw-cells"), BROADCAST_ROWS), "cell").where("at >= low and at < high")
    counts = staged(hits.groupBy("name", "shard").agg(F.count("*").alias("n")), "draws")
    group = F.expr(f"shard div {BUCKET_ROWS}")
    sums = counts.groupBy("name", group.alias("group")).agg(F.sum("n").alias("n"))
    before = Window.partitionBy("name").orderBy("group").rowsBetween(Window.unboundedPreceding, -1)
    offsets = staged(sums.select(F.col("name").alias("o_name"), "group", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset")), "draw-offsets")
    within = Window.partitionBy("name", "group").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    placed = counts.withColumn("group", group).withColumn("first", F.coalesce(F.sum("n").over(within), F.lit(0)))
    placed = placed.join(small_or_not(offsets, BROADCAST_ROWS), F.col("name").eqNullSafe(F.col("o_name")) & (placed["group"] == offsets["group"]))
    placed = placed.select("name", "shard", "n", (F.col("first") + F.col("offset")).alias("first"))
    got = counts.groupBy(F.col("name").alias("g_name")).agg(F.sum("n").alias("got"))
    short = aims.join(got, F.col("name").eqNullSafe(F.col("g_name")), "left").withColumn("got", F.coalesce("got", F.lit(0))).where("slots > got")
    part = F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(slots - got - 1) div {shard_slots}")))
    closing = short.select("name", "slots", "got", part.alias("part")).withColumn("first", F.col("got") + F.col("part") * shard_slots)
    closing = closing.select("name", (F.lit(shards) + F.col("part")).alias("shard"), F.least(F.lit(shard_slots), F.col("slots") - F.col("first")).cast("long").alias("n"), "first")
    return placed.unionByName(closing)


def plan(docs: DataFrame, carry: list[str], weights=WEIGHTS, block_words: int = BLOCK_WORDS, text: str = "text", source: str = "source", shard_slots: int = SHARD_SLOTS) -> tuple[DataFrame, DataFrame, dict]:
    """(documents with their place in their source's stream, slots with shard and block, column names)."""
    c = {k: fresh(docs, f"mix_{k}") for k in ("src", "size", "bucket", "start", "key", "copies")}
    rows = docs.select(*carry, F.col(source).alias(c["src"]), F.size(words(F.col(text))).cast("long").alias(c["size"]), document_key(docs).alias(c["key"]))
    rows = staged(rows.groupBy(*rows.columns).agg(F.count("*").alias(c["copies"])), "sizes")
    buckets = bucket_count(rows.count(), BUCKET_DOCS)
    rows = rows.withColumn(c["bucket"], F.pmod(F.col(c["key"]), F.lit(buckets)).cast("int"))
    held = F.col(c["size"]) * F.col(c["copies"])
    sums = staged(rows.groupBy(c["src"], c["bucket"]).agg(F.sum(held).alias("words")), "bucket-sums")
    totals = staged(sums.groupBy(F.col(c["src"]).alias("name")).agg(F.sum("words").alias("source_size")), "source-sizes")
    n_blocks = F.ceil(F.col("source_size") / F.lit(block_words)).cast("long")
    sources = targets(totals, weights).withColumn("quota", F.bround("target").cast("long")).withColumn("n_blocks", n_blocks)
    sources = sources.withColumn("perm_a", _coprime(F.col("n_blocks"), F.col("name")))
    span = F.when(F.col("quota") > 0, F.ceil(F.col("quota") / F.lit(block_words)) + 2).otherwise(F.lit(0)).cast("long")
    sources = staged(sources.withColumn("slots", span), "sources")
    before = Window.partitionBy(c["src"]).orderBy(c["bucket"]).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(F.col(c["src"]).alias("o_src"), F.col(c["bucket"]).alias("o_bucket"), F.coalesce(F.sum("words").over(before), F.lit(0)).alias("offset"))
    within = Window.partitionBy(c["src"], c["bucket"]).orderBy(c["key"], c["size"], *carry).rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn(c["start"], F.coalesce(F.sum(held).over(within), F.lit(0)))
    offsets = staged(offsets, "offsets")
    placed = placed.join(small_or_not(offsets, 2 * BROADCAST_ROWS), F.col(c["src"]).eqNullSafe(F.col("o_src")) & (F.col(c["bucket"]) == F.col("o_bucket")), "left")
    placed = _each_copy(placed.withColumn(c["start"], (F.col(c["start"]) + F.col("offset")).cast("long")).drop("o_src", "o_bucket", "offset"), rows, c)
    # All blocks but the last have block_words words; where the last one falls is known.
    known = small_or_not(sources, BROADCAST_ROWS)
    counts = drawn(sources, shard_slots).withColumnRenamed("name", "d_name")
    slots = counts.join(known, F.col("d_name").eqNullSafe(F.col("name"))).drop("d_name")
    slots = slots.withColumn("slot", F.explode(F.sequence("first", F.col("first") + F.col("n") - 1))).where("slot < slots")  # n is shard_slots at most
    slots = slots.withColumn("pass", F.expr("slot div n_blocks")).withColumn("k", F.col("slot") % F.col("n_blocks"))
    # In the last pass a shard's slots stand together at the start of its stretched range: both stay in order and below n_blocks.
    rest, begun = F.col("slots") % F.col("n_blocks"), F.greatest(F.col("first") - F.col("pass") * F.col("n_blocks"), F.lit(0))
    stretched = F.call_function("div", begun.cast("decimal(18,0)") * F.col("n_blocks").cast("decimal(18,0)"), rest.cast("decimal(18,0)")) + F.col("k") - begun
    index = F.when(F.col("pass") == F.expr("slots div n_blocks"), stretched).otherwise(F.col("k"))
    slots = slots.withColumn("index", index).withColumn("perm_b", F.pmod(F.xxhash64("name", F.lit(SEED), "pass"), "n_blocks"))
    slots = staged(slots.withColumn("block", _permuted(F.col("index"))), "slots")
    short = F.col("n_blocks") * block_words - F.col("source_size")
    # The slot of the last block in each pass, found by the slots themselves; of the last pass it may be missing.
    last = staged(slots.where("block = n_blocks - 1").select(F.col("name").alias("l_name"), F.col("pass").alias("l_pass"), F.col("k").alias("last_k")), "last-blocks")
    slots = slots.join(small_or_not(last, BROADCAST_ROWS), F.col("name").eqNullSafe(F.col("l_name")) & (F.col("pass") == F.col("l_pass")), "left").drop("l_name", "l_pass")
    used = F.col("pass") * F.col("source_size") + F.col("k") * block_words - F.when(F.coalesce(F.col("last_k"), F.col("n_blocks")) < F.col("k"), short).otherwise(0)
    length = F.when(F.col("block") == F.col("n_blocks") - 1, block_words - short).otherwise(F.lit(block_words))
    slots = slots.withColumn("words", F.least(length, F.col("quota") - used).cast("long")).where("words > 0")
    return placed, slots.select("name", "source_size", "target", "shard", "slot", "pass", "block", "words"), c | {"sources": sources}


def _each_copy(placed: DataFrame, rows: DataFrame, c: dict) -> DataFrame:
    """A row for each of the copies that placed counts, one after the other in the stream."""
    most = rows.agg(F.max(c["copies"])).first()[0] or 1
    if most == 1:
        return placed.drop(c["copies"])
    i, part = fresh(placed, "mix_copy"), fresh(placed, "mix_part")
    out = placed.withColumn(part, F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"({c['copies']} - 1) div {BUCKET_ROWS}"))))
    out = out.repartition(c["key"], part) if most > BUCKET_ROWS else out
    out = out.withColumn(i, F.explode(F.sequence(F.col(part) * BUCKET_ROWS, F.least((F.col(part) + 1) * BUCKET_ROWS, F.col(c["copies"])) - 1)))
    return out.withColumn(c["start"], F.col(c["start"]) + F.col(i) * F.col(c["size"])).drop(c["copies"], i, part)


def _pieces(placed: DataFrame, slots: DataFrame, c: dict, block_words: int, by: list[str], keep_size: bool = False) -> DataFrame:
    """A row for each document, block and slot that takes a part of it: source, start and by's columns, shard, pass, first word in the document, words."""
    start, end = F.col(c["start"]), F.col(c["start"]) + F.col(c["size"])
    first, last = F.floor(start / block_words).cast("long"), F.floor((end - 1) / block_words).cast("long")
    parts = placed.where(F.col(c["size"]) > 0).select(*by, c["src"], c["start"], c["size"], F.explode(F.sequence(first, last)).alias("d_block"))
    # The joined key is (source, block): a source's rows are spread over its blocks.
    both = parts.join(slots.select("name", "shard", "pass", "block", "words"), F.col(c["src"]).eqNullSafe(F.col("name")) & (F.col("d_block") == F.col("block")))
    lo = F.greatest(start, F.col("block") * block_words)
    hi = F.least(end, F.col("block") * block_words + F.col("words"))
    return both.select(*by, c["src"], c["start"], *[c["size"]] * keep_size, "shard", "pass", (lo - start).alias("at"), (hi - lo).alias("taken")).where("taken > 0")


def mix_report(docs: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """doc_id, size, source_size, target, taken of each row, and the first output shard that takes a part of it."""
    placed, slots, c = plan(docs, ["doc_id"], block_words=block_words)
    placed = staged(placed, "placed")
    taken = _pieces(placed, slots, c, block_words, [c["key"]]).groupBy(c["src"], c["key"], c["start"]).agg(F.sum("taken").alias("taken"), F.min("shard").alias("first_shard"))
    taken = taken.select(F.col(c["src"]).alias("t_src"), F.col(c["key"]).alias("t_key"), F.col(c["start"]).alias("t_start"), "taken", "first_shard")
    same = F.col(c["src"]).eqNullSafe(F.col("t_src")) & (F.col(c["key"]) == F.col("t_key")) & (F.col(c["start"]) == F.col("t_start")) & (F.col(c["size"]) > 0)
    out = placed.join(taken, same, "left").join(small_or_not(c["sources"].select("name", "source_size", "target"), BROADCAST_ROWS), F.col(c["src"]).eqNullSafe(F.col("name")), "left")
    return out.select("doc_id", F.col(c["size"]).alias("size"), "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), "first_shard")


def mix_documents(docs: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The mix as documents, with all columns: a row for each document and pass that takes words of it.

    A document that a pass takes whole keeps its text; of another the words taken stay, in their order, joined by spaces.
    n_chars, where there is such a column, is that of the text that stays.
    """
    placed, slots, c = plan(docs, ["doc_id"], block_words=block_words)
    placed = staged(placed.where(F.col(c["size"]) > 0), "placed")
    own = [c["src"], "doc_id", c["key"], c["size"], c["start"]]
    span, t = fresh(docs, "mix_spans"), fresh(docs, "mix_taken")
    parts = _pieces(placed, slots, c, block_words, ["doc_id", c["key"]], keep_size=True)
    runs = parts.groupBy(*own, "pass").agg(F.sum("taken").alias(t), F.sort_array(F.collect_list(F.struct("at", "taken"))).alias(span))
    texts = docs.withColumn(c["key"], document_key(docs))
    if not placed.groupBy(*own[:4]).agg(F.count("*").alias("n")).where("n > 1").isEmpty():  # rows that are the same twice: their runs meet one of them
        texts = texts.dropDuplicates(["doc_id", "source", c["key"]])
    runs = apart(runs.select(*own[:4], t, span), texts)
    r_src, r_id, r_key, r_size, t, span = runs.columns
    same = F.col("source").eqNullSafe(F.col(r_src)) & F.col("doc_id").eqNullSafe(F.col(r_id)) & (F.col(c["key"]) == F.col(r_key))
    cut = let(words(F.col("text")), lambda w: F.array_join(F.flatten(F.transform(F.col(span), lambda s: F.slice(w, s["at"].cast("int") + 1, s["taken"].cast("int")))), " "))
    whole = F.col(t) == F.col(r_size)
    out = texts.join(runs, same).withColumn(c["start"], F.when(whole, F.col("text")).otherwise(cut))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(whole, F.col("n_chars")).otherwise(F.length(c["start"])).cast(docs.schema["n_chars"].dataType))
    return out.withColumn("text", F.col(c["start"])).select(*docs.columns)
