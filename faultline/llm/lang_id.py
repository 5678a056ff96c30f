"""Language identification by interpolated Kneser-Ney character models.

Training. Every label that occurs is learned. Rows with a label are drawn into a sample by a keyed hash of their
id, whole texts of at most TRAIN_ROWS rows a language and, over all languages, about TRAIN_CHARS characters, but one text of each language at least (both bounds are
parameters; a language with fewer rows gives all). Spark counts the character n-grams of
orders 1 to ORDER. The highest order keeps its counts; lower orders count the
different characters seen before the n-gram (continuation counts), by which interpolated Kneser-Ney smooths:

    p(c | h) = max(count(hc) - D, 0) / count(h) + D * types(h) / count(h) * p(c | h without its first)

with D = n1 / (n1 + 2 n2) for each language and order, and the uniform distribution below order 1. Spark computes these by joins and sums, order by order.

Model. For each order an array of sorted 64-bit n-gram hashes with the languages that have the n-gram and their log-probabilities, each already
interpolated; and one of sorted context hashes with the languages that have the context and their log back-off weights. No n-gram of the sample is left out, so that a
language's probabilities after any context sum to 1. Each different n-gram of a batch of texts is looked up once, by binary search in
each order until every language has it. Spark sorts the arrays; they are bounded by the sample, collected and broadcast.

Decision. The language of the lowest cross-entropy per character, the first by name of equal ones. Rejection is calibrated: on one in five of the sampled rows, which the
models have not seen, the cross-entropies of each language's own texts give a mean, a variance between texts and one that falls with a text's length;
a text is accepted unless it lies more than the calibrated REJECT quantile above its language's mean.

Text is lower-cased; each run of characters that are no letters is one boundary. Whole texts are scored, however long, in slices of
bounded size. Defined results: null text or text without a letter: und, score 0, not accepted; repeated rows
get the same row; null labels are not learned from; without any labelled row every text is und; an empty table gives an empty result; other columns of the input don't matter.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import small_or_not, staged

ORDER = 4
TRAIN_ROWS = 1500
#: Characters of the sample over all languages, about.
TRAIN_CHARS = 24_000_000
#: Numbers (characters by languages) scored at once.
SLICE = 1 << 22
#: Rows of (language, count) that may be broadcast.
BROADCAST_ROWS = 100_000
REJECT = 0.999
#: Between texts of a language the cross-entropy varies by this share of its mean at least.
LEAST_SPREAD = 0.03

_MUL = np.uint64(0x9E3779B97F4A7C15)


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """For each code point: itself in lower case if it is a letter or a mark, else 0; and whether it is a letter."""
    low, letter = np.zeros(0x110000, np.uint32), np.zeros(0x110000, bool)
    for x in range(0x40000):
        c = chr(x)
        if (kind := unicodedata.category(c)[0]) in "LM":
            letter[x] = kind == "L"
            small = c.lower()
            low[x] = ord(small) if len(small) == 1 else x
    return low, letter


_cached: list[tuple[np.ndarray, np.ndarray]] = []


def symbols(text: str, order: int = ORDER) -> np.ndarray:
    """Letters in lower case, as code points, and each run of anything else as one 0; order - 1 zeros in front, one at the end. Empty without a letter."""
    if not _cached:
        _cached.append(_tables())
    low, letter = _cached[0]
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    if not letter[points].any():
        return np.empty(0, np.uint32)
    x = low[points]
    x = x[(x != 0) | np.concatenate(([True], x[:-1] != 0))]
    x = x[int(x[0] == 0) : len(x) - int(x[-1] == 0)]
    return np.concatenate([np.zeros(order - 1, np.uint32), x, np.zeros(1, np.uint32)])


def hashes(x: np.ndarray, order: int) -> np.ndarray:
    """Hash of the order symbols that end at each position from order - 1 on."""
    x = x.astype(np.uint64) + np.uint64(1)
    h = np.zeros(max(0, len(x) - order + 1), np.uint64)
    for i in range(order):
        h = (h ^ x[i : i + len(h)]) * _MUL
        h ^= h >> np.uint64(29)
    return h


def ngrams(x: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the n-grams of an order that end at each predicted symbol, of their contexts and of their suffixes."""
    own = hashes(x, order)
    if order == 1:
        zero = np.zeros(len(own), np.uint64)
        return own, zero, zero
    less = hashes(x, order - 1)
    return own, less[:-1], less[1:]


def counted(sample: DataFrame, order: int = ORDER) -> DataFrame:
    """lang, k, h, ctx, suf, n: the n-grams of orders 1 to order of the rows (text, lang), counted over whole texts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text, lang in zip(batch.column(0), batch.column(1), strict=True):
                x = symbols(text.as_py() or "", order)
                for k in range(1, order + 1) if len(x) else ():
                    own, ctx, suf = ngrams(x[order - k :], k)
                    h, at, n = np.unique(own, return_index=True, return_counts=True)
                    ints = (np.full(len(h), k, np.int32), h.view(np.int64), ctx[at].view(np.int64), suf[at].view(np.int64), n.astype(np.int64))
                    yield pa.RecordBatch.from_arrays([pa.array([lang.as_py()] * len(h)), *map(pa.array, ints)], names=["lang", "k", "h", "ctx", "suf", "n"])

    rows = sample.select("text", "lang").mapInArrow(count, "lang string, k int, h long, ctx long, suf long, n long")
    return rows.groupBy("lang", "k", "h").agg(F.first("ctx").alias("ctx"), F.first("suf").alias("suf"), F.sum("n").alias("n"))


def probabilities(counts: DataFrame, order: int = ORDER) -> tuple[DataFrame, DataFrame, int]:
    """((k, h, lang, logp) of the n-grams, (k, h, lang, back) of the contexts, the number of symbols that the uniform distribution has), for staged counted()."""
    size = max(256, 2 * counts.where("k = 1").select("h").distinct().count())
    lower, grams, contexts = None, [], []
    for k in range(1, order + 1):
        own = counts.where(F.col("k") == k).select("lang", "h", "ctx", "suf", "n")
        if k < order:  # different symbols seen in front: one for each n-gram of the next order
            before = counts.where(F.col("k") == k + 1).groupBy("lang", F.col("suf").alias("h")).agg(F.count("*").alias("n"))
            own = own.drop("n").join(before, ["lang", "h"])
        own = staged(own, "ngrams")
        ones, twos = F.count_if(F.col("n") == 1), F.count_if(F.col("n") == 2)
        d = own.groupBy("lang").agg(F.least(F.greatest(F.when(ones > 0, ones / (ones + 2 * twos)).otherwise(F.lit(0.5)), F.lit(0.05)), F.lit(0.95)).alias("d"))
        of = own.groupBy("lang", "ctx").agg(F.sum("n").alias("total"), F.count("*").alias("types"))
        of = staged(of.join(small_or_not(staged(d, "discounts"), BROADCAST_ROWS), "lang").withColumn("gamma", F.col("d") * F.col("types") / F.col("total")), "contexts")
        own = own.join(of, ["lang", "ctx"])
        if lower is None:
            own = own.withColumn("below", F.lit(1.0 / size))
        else:
            own = own.join(lower.select("lang", F.col("h").alias("suf"), F.col("p").alias("below")), ["lang", "suf"])
        lower = staged(own.select("lang", "h", (F.greatest(F.col("n") - F.col("d"), F.lit(0.0)) / F.col("total") + F.col("gamma") * F.col("below")).alias("p")), "probabilities")
        grams.append(lower.select(F.lit(k).alias("k"), "h", "lang", F.log("p").cast("float").alias("value")))
        contexts.append(of.select(F.lit(k).alias("k"), F.col("ctx").alias("h"), "lang", F.log("gamma").cast("float").alias("value")))
    return reduce(DataFrame.unionByName, grams), reduce(DataFrame.unionByName, contexts), size


class Rows:
    """Sorted hashes, each with the languages that have it and their values."""

    def __init__(self, h: np.ndarray, lang: np.ndarray, value: np.ndarray):
        self.keys, first = np.unique(h, return_index=True)
        self.first, self.lang, self.value = np.append(first, len(h)), lang, value

    def of(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(index into h, language, value) of each entry of the given hashes."""
        at = np.minimum(np.searchsorted(self.keys, h), len(self.keys) - 1)
        hit = np.nonzero(self.keys[at] == h)[0]
        lo, n = self.first[at[hit]], self.first[at[hit] + 1] - self.first[at[hit]]
        entry = np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum())
        return np.repeat(hit, n), self.lang[entry], self.value[entry]


class Model:
    """The languages' models: for each order the rows of n-grams with log-probabilities and of contexts with log back-off weights."""

    def __init__(self, langs: list[str], grams: list[Rows], contexts: list[Rows], size: int):
        self.langs, self.order, self.grams, self.contexts = langs, len(grams), grams, contexts
        self.calibration: tuple[np.ndarray, np.ndarray, np.ndarray, float] | None = None
        self.unseen = np.zeros(len(langs), np.float32)
        _, lang, back = contexts[0].of(contexts[0].keys)
        self.unseen[lang] = back - np.float32(np.log(size))

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Log-probability of each symbol of x after the first order - 1, in each language."""
        _, first, inverse = np.unique(hashes(x, self.order), return_index=True, return_inverse=True)
        out = np.zeros((len(first), len(self.langs)), np.float32)
        todo = np.ones(out.shape, bool)
        for k in range(self.order, 0, -1):
            own, ctx, _ = ngrams(x[self.order - k :], k)
            at, lang, value = self.grams[k - 1].of(own[first])
            some = todo[at, lang]
            at, lang = at[some], lang[some]
            out[at, lang] += value[some]
            todo[at, lang] = False
            if k > 1:
                at, lang, value = self.contexts[k - 1].of(ctx[first])
                some = todo[at, lang]
                out[at[some], lang[some]] += value[some]
        out += np.where(todo, self.unseen, np.float32(0))
        return out[inverse]

    def entropies(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(nats per symbol of each text in each language, number of symbols, 0 without a letter); whole texts, slice by slice."""
        sums, sizes = np.zeros((len(texts), len(self.langs))), np.zeros(len(texts), np.int64)
        held: list[tuple[int, np.ndarray]] = []

        def flush() -> None:
            if held:
                joined = np.concatenate([x for _, x in held])
                logp, at, head = self.scores(joined), 0, self.order - 1
                for i, x in held:
                    sums[i] += logp[at : at + len(x) - head].sum(axis=0, dtype=np.float64)
                    at += len(x)
                held.clear()

        size, most = 0, max(1000, SLICE // max(4, len(self.langs)))
        for i, text in enumerate(texts):
            x = symbols(text, self.order) if text else np.empty(0, np.uint32)
            sizes[i] = max(0, len(x) - self.order + 1)
            for at in range(0, int(sizes[i]), most):
                held.append((i, x[at : at + most + self.order - 1]))
                size += len(held[-1][1])
                if size >= most // 2:
                    flush()
                    size = 0
        flush()
        return -sums / np.maximum(sizes, 1)[:, None], sizes

    def calibrate(self, entropy: np.ndarray, sizes: np.ndarray, own: np.ndarray) -> None:
        """From unseen texts of known language, with their cross-entropy in it: each language's mean, its variance between texts and within them (by length), and the limit."""
        mean, between, within = np.full(len(self.langs), np.inf), np.zeros(len(self.langs)), np.zeros(len(self.langs))
        z = [np.zeros(0)]
        for lang in range(len(self.langs)):
            who = (own == lang) & (sizes > 0)
            if who.sum() >= 5:
                e, n = entropy[who], sizes[who]
                mean[lang] = (e * n).sum() / n.sum()
                long = n >= np.median(n)
                between[lang] = max(((e - mean[lang])[long] ** 2).mean(), (LEAST_SPREAD * mean[lang]) ** 2)
                within[lang] = ((e - mean[lang]) ** 2 * n)[~long | (n == n.min())].mean()
                z.append((e - mean[lang]) / np.sqrt(between[lang] + within[lang] / n))
        pooled = np.concatenate(z)
        self.calibration = mean, between, within, float(np.quantile(pooled, REJECT)) if len(pooled) else np.inf

    def decide(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
        """(language, score, accepted, cross-entropy) of each text."""
        entropy, sizes = self.entropies(texts)
        best = entropy.argmin(axis=1)
        row = np.arange(len(texts))
        lead = np.exp(-(entropy - entropy[row, best][:, None]) * np.minimum(sizes, 50)[:, None])
        score = np.where(sizes > 0, 1 / lead.sum(axis=1), 0.0)
        none = np.zeros(len(self.langs))
        mean, between, within, limit = self.calibration or (none + np.inf, none, none, np.inf)
        with np.errstate(divide="ignore", invalid="ignore"):
            off = (entropy[row, best] - mean[best]) / np.sqrt(between[best] + within[best] / np.maximum(sizes, 1))
        accepted = (sizes > 0) & ~(off > limit)
        return [self.langs[b] if n else "und" for b, n in zip(best, sizes, strict=True)], score, accepted, np.where(sizes > 0, entropy[row, best], np.nan)


def training_sample(docs: DataFrame, rows: int = TRAIN_ROWS, chars: int = TRAIN_CHARS) -> DataFrame:
    """text, lang and part (1 in 5 calibrates) of labelled rows, drawn by a keyed hash of doc_id: at most rows a language, and its share of chars, but one at least."""
    draw = F.pmod(F.xxhash64("doc_id", F.lit("lang-sample")), F.lit(1 << 30))
    labelled = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "text", "lang", draw.alias("draw"))
    counts = staged(labelled.groupBy("lang").agg(F.count("*").alias("n")), "language-counts")
    langs = counts.count()
    each = chars // max(1, langs)
    share = F.least(F.lit(1.0), F.lit(1.2 * rows + 50) / F.col("n")) * (1 << 30)
    near = labelled.join(small_or_not(counts, BROADCAST_ROWS), "lang").where(F.col("draw") < share).withColumn("chars", F.length("text").cast("long"))
    order = Window.partitionBy("lang").orderBy(F.col("chars") > each, "draw", "doc_id")  # texts over the share of a language come last
    placed = near.withColumn("rank", F.row_number().over(order)).withColumn("held", F.sum("chars").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return placed.where((F.col("rank") <= rows) & ((F.col("held") <= each) | (F.col("rank") == 1))).select("text", "lang", (F.col("rank") % 5 == 4).alias("calibrates"))


def fitted(counts: DataFrame, order: int = ORDER) -> Model | None:
    """The model of staged counted(), or None if it has no row. What is collected is bounded by the sample."""
    langs = sorted(r["lang"] for r in counts.select("lang").distinct().collect())
    if not langs:
        return None
    grams, contexts, size = probabilities(counts, order)

    def rows(of: DataFrame) -> list[Rows]:
        found = of.select("k", "h", "lang", "value").orderBy("k", "h", "lang").toArrow()
        k, h, value = (found.column(c).to_numpy() for c in ("k", "h", "value"))
        coded = found.column("lang").combine_chunks().dictionary_encode()
        coded = coded.combine_chunks() if isinstance(coded, pa.ChunkedArray) else coded
        at = np.array([langs.index(x) for x in coded.dictionary.to_pylist()], np.int32)[coded.indices.to_numpy()]
        cuts = np.searchsorted(k, np.arange(1, order + 2))
        return [_by_unsigned(h[a:b].view(np.uint64), at[a:b], value[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]

    return Model(langs, rows(grams), rows(contexts), size)


def _by_unsigned(h: np.ndarray, lang: np.ndarray, value: np.ndarray) -> Rows:
    """Rows from entries sorted by signed hash: the negative ones are the larger unsigned ones."""
    cut = int(np.searchsorted(h.view(np.int64), 0))
    return Rows(*(np.concatenate([x[cut:], x[:cut]]) for x in (h, lang, value)))


def train(docs: DataFrame, rows: int = TRAIN_ROWS, order: int = ORDER, chars: int = TRAIN_CHARS) -> Model | None:
    """A calibrated model of the labelled rows of docs, or None if there are none."""
    sample = staged(training_sample(docs, rows, chars), "language-sample")
    model = fitted(staged(counted(sample.where("not calibrates"), order), "ngram-counts"), order)
    if model is None:
        return None
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def unseen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = batch.column(1).to_pylist()
            entropy, sizes = shared.value.entropies(batch.column(0).to_pylist())
            known = {x: i for i, x in enumerate(shared.value.langs)}
            own = np.array([known.get(x, -1) for x in langs], np.int64)
            value = np.where(own >= 0, entropy[np.arange(len(own)), own], np.nan)
            yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(value), pa.array(sizes)], names=["own", "entropy", "n"])

    found = sample.where("calibrates").select("text", "lang").mapInArrow(unseen, "own long, entropy double, n long").where("own >= 0").toPandas()
    model.calibrate(found["entropy"].to_numpy(), found["n"].to_numpy(), found["own"].to_numpy())
    return model


def identify(docs: DataFrame, model: Model | None, carry: list[str], text: str = "text") -> DataFrame:
    """carry's columns, lang_pred, score, accepted and cross_entropy of each row."""
    if model is None:
        return docs.select(*carry, F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(False).alias("accepted"), F.lit(None).cast("double").alias("cross_entropy"))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in carry)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                lang, value, accepted, entropy = shared.value.decide(part.column(len(carry)).to_pylist())
                new = [pa.array(lang, pa.string()), pa.array(value), pa.array(accepted), pa.array(entropy, from_pandas=True)]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], *new], names=[*carry, "lang_pred", "score", "accepted", "cross_entropy"])

    return docs.select(*carry, text).mapInArrow(score, f"{kinds}, lang_pred string, score double, accepted boolean, cross_entropy double")
