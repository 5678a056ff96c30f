"""Secrets in texts: base patterns, and spans of high Shannon entropy in a sliding window over candidate strings.

Candidates are the runs of a character class, at least WINDOW long, that the allow list doesn't name. A window slides over each; the counts
of its characters change by the one that enters and the one that leaves, and with them the sum of c * log2(c), from which
the entropy follows. Windows of enough entropy, and with enough kinds of characters, join to a span where they touch. All of it is column
functions: one pass over the rows, no shuffle.

A null text is empty and has no spans. Repeated rows, null and repeated doc_ids each give a row; extra columns are ignored; an empty table gives an
empty one. Work grows with a text's length, whatever it holds.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, fresh, let


def _either_case(word: str) -> str:
    return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word)


#: The base patterns by kind, in the order in which equal starts are listed, and the shortest match or value.
NAMES = "|".join(map(_either_case, ("password", "passwd", "secret", "token", "api_?key")))
ASSIGN = rf"""({NAMES})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
SHORTEST_VALUE = 6
#: The look-ahead changes no match; with it five times fewer characters reach the alternatives.
BASE = {"assign": f"(?=[pPsStTaA]){ASSIGN}", "access": r"AKIA[A-Z0-9]{16,}", "hex": r"[0-9a-f]{24,}"}

WINDOW = 20
#: log2 sums are whole numbers of 2^-20 bits, so that they don't depend on the order of additions.
UNIT = 1 << 20
C_LOG_C = [0, *(round(UNIT * c * math.log2(c)) for c in range(1, WINDOW + 1))]
KINDS = {"lower": "abcdefghijklmnopqrstuvwxyz", "upper": "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "digit": "0123456789", "other": "+/_-"}
#: By class: the characters of its runs, whether A-Z count as a-z, bits a character, the kinds that a window must hold.
CLASSES = {
    "entropy_hex": ("0-9A-Fa-f", "0123456789abcdef", True, 3.0, ("lower", "digit")),
    "entropy_base64": ("A-Za-z0-9+/_-", "".join(KINDS.values()), False, 3.7, ("lower", "upper", "digit")),
}
#: A candidate is no secret if this fits the NEAR characters before it and itself, A-Z lower-cased. Fixed values.
ALLOW = r"example|sample|dummy|placeholder|changeme|redacted|xxxxx|abcdefghij|0123456789|sha1[-:=]|sha256[-:=]|sha384[-:=]|sha512[-:=]|integrity"
NEAR = 16
BLOCK = 256


def most_sum(bits: float) -> int:
    """The largest sum of c * log2(c) of a window with that entropy: log2(W) - sum / W bits."""
    return math.floor(WINDOW * (math.log2(WINDOW) - bits) * UNIT)


def running(xs: Column, op: Callable[[Column, Column], Column]) -> Column:
    """For each element of longs, op over all before it, from 0. By blocks of BLOCK, as arrays are copied when they grow: no square of a long array."""
    zero = F.lit(0).cast("long")

    def prefixes(block: Column) -> Column:
        return F.aggregate(block, F.array(zero), lambda acc, x: F.concat(acc, F.array(op(F.get(acc, F.size(acc) - 1), x))))

    def joined(blocks: Column) -> Column:
        carried = prefixes(F.transform(blocks, lambda b: F.get(b, F.size(b) - 1)))
        return F.flatten(F.transform(blocks, lambda b, i: F.transform(F.slice(b, 1, F.size(b) - 1), lambda x: op(F.get(carried, i), x))))

    starts = F.sequence(F.lit(1), F.size(xs), F.lit(BLOCK))
    whole = let(F.transform(starts, lambda at: prefixes(F.slice(xs, at, F.lit(BLOCK)))), joined)
    return F.when(F.size(xs) == 0, F.array().cast("array<bigint>")).otherwise(whole)


def found(text: Column, pattern: str) -> Column:
    """start, end, run and the NEAR characters before it, of each match from the left, none overlapping; code points, end exclusive."""

    def placed(x: Column) -> Column:
        pieces, runs = x["pieces"], x["runs"]
        steps = F.transform(runs, lambda run, i: (F.length(F.get(pieces, i)) + F.length(run)).cast("long"))

        def one(before: Column, run: Column, i: Column) -> Column:
            start = F.get(before, i) + F.length(F.get(pieces, i))
            return F.struct(start.alias("start"), (start + F.length(run)).alias("end"), run.alias("run"), F.right(F.get(pieces, i), F.lit(NEAR)).alias("near"))

        return let(running(steps, lambda a, b: a + b), lambda before: F.transform(runs, lambda run, i: one(before, run, i)))

    both = F.struct(F.split(text, pattern, -1).alias("pieces"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("runs"))
    return F.when(F.rlike(text, F.lit(pattern)), let(both, placed)).otherwise(F.array().cast("array<struct<start:bigint,end:bigint,run:string,near:string>>"))


def base_spans(text: Column) -> list[Column]:
    """Arrays of start, rank, end, kind, one for each base kind."""
    out = []
    for rank, (kind, pattern) in enumerate(BASE.items()):
        hits = found(text, pattern)
        if kind == "assign":
            hits = F.filter(hits, lambda x: F.length(F.regexp_extract(x["run"], ASSIGN, 2)) >= SHORTEST_VALUE)
        out.append(_spans(hits, rank, kind))
    return out


def _spans(hits: Column, rank: int, kind: str) -> Column:
    return F.transform(hits, lambda x: F.struct(x["start"].alias("start"), F.lit(rank).alias("rank"), x["end"].alias("end"), F.lit(kind).alias("kind")))


STATE = "struct<counts:array<int>,kinds:array<int>,total:bigint,from:int,upto:int,out:array<struct<start:int,end:int>>>"


def high_entropy(run: Column, alphabet: str, fold: bool, bits: float, needs: tuple[str, ...]) -> Column:
    """start, end in run of the joined windows that reach bits of entropy and hold all the kinds of characters needed.

    One step a character: the entering one's count goes up, the leaving one's down, and the sum of c * log2(c) moves by the differences in C_LOG_C.
    """
    table = F.array(*[F.lit(x).cast("long") for x in C_LOG_C])
    kind_of = F.array(*[F.lit(next(k for k, v in enumerate(KINDS.values()) if c in v)) for c in alphabet])
    # 1 to len(alphabet); split by nothing gives the characters
    codes = F.transform(F.split(ascii_lower(run) if fold else run, ""), lambda c: F.instr(F.lit(alphabet), c))

    def log_of(count: Column) -> Column:
        return F.get(table, count)

    def moved(counts: Column, up: Column, down: Column) -> Column:
        return F.transform(counts, lambda c, k: c + (k == up).cast("int") - (k == down).cast("int"))

    def step(acc: Column, i: Column, codes: Column) -> Column:
        up = F.get(codes, i) - 1
        down = F.when(i >= WINDOW, F.get(codes, i - WINDOW) - 1).otherwise(-1)

        def slid(x: Column) -> Column:
            ups, downs = F.get(acc["counts"], x["up"]), F.get(acc["counts"], x["down"])
            lost = F.when(x["down"] >= 0, log_of(downs) - log_of(downs - 1)).otherwise(0)
            kinds = moved(acc["kinds"], F.get(kind_of, x["up"]), F.when(x["down"] >= 0, F.get(kind_of, x["down"])).otherwise(-1))
            same = x["up"] == x["down"]
            return F.struct(
                F.when(same, acc["counts"]).otherwise(moved(acc["counts"], x["up"], x["down"])).alias("counts"),
                F.when(same, acc["kinds"]).otherwise(kinds).alias("kinds"),
                F.when(same, acc["total"]).otherwise(acc["total"] + log_of(ups + 1) - log_of(ups) - lost).alias("total"),
            )

        def joined(x: Column) -> Column:
            high = (i >= WINDOW - 1) & (x["total"] <= most_sum(bits))
            for kind in needs:
                high = high & (F.get(x["kinds"], F.lit(list(KINDS).index(kind))) > 0)
            start = i - (WINDOW - 1)
            touches = acc["upto"] >= start
            parts = {
                "from": F.when(touches, acc["from"]).otherwise(start),
                "upto": i + 1,
                "out": F.when(touches | (acc["upto"] < 0), acc["out"]).otherwise(F.concat(acc["out"], F.array(F.struct(acc["from"].alias("start"), acc["upto"].alias("end"))))),
            }
            return F.struct(x["counts"].alias("counts"), x["kinds"].alias("kinds"), x["total"].alias("total"), *[F.when(h, v).otherwise(acc[k]).alias(k) for h in [high] for k, v in parts.items()])

        return let(let(F.struct(up.alias("up"), down.alias("down")), slid), joined)

    def scan(codes: Column) -> Column:
        zero = F.struct(
            F.array_repeat(F.lit(0), F.lit(len(alphabet))).alias("counts"), F.array_repeat(F.lit(0), F.lit(len(KINDS))).alias("kinds"), F.lit(0).cast("long").alias("total"),
            F.lit(-1).alias("from"), F.lit(-1).alias("upto"), F.array().cast("array<struct<start:int,end:int>>").alias("out"),
        ).cast(STATE)
        last = F.aggregate(F.sequence(F.lit(0), F.size(codes) - 1), zero, lambda acc, i: step(acc, i, codes).cast(STATE))
        return let(last, lambda x: F.when(x["upto"] < 0, x["out"]).otherwise(F.concat(x["out"], F.array(F.struct(x["from"].alias("start"), x["upto"].alias("end"))))))

    return let(codes, scan)


def _having(candidates: Column, pattern: str) -> Column:
    return F.filter(candidates, lambda x: F.rlike(x["run"], F.lit(pattern)))


def _of_kind(spans: Column, kind: str) -> Column:
    return F.filter(spans, lambda x: x["kind"] == kind)


def entropy_spans(text: Column) -> list[Column]:
    """Arrays of start, rank, end, kind, one for each class of candidates."""
    out = []
    for k, (kind, (chars, alphabet, fold, bits, needs)) in enumerate(CLASSES.items()):
        candidates = F.filter(found(text, f"[{chars}]{{{WINDOW},}}"), lambda x: ~F.rlike(ascii_lower(F.concat(x["near"], x["run"])), F.lit(ALLOW)))
        for need in needs:  # a run without one of the kinds has no window with it
            marks = f"[{KINDS[need]}]" if not (fold and need == "lower") else "[A-Fa-f]"
            candidates = _having(candidates, marks)
        hits = F.flatten(F.transform(candidates, lambda x: F.transform(high_entropy(x["run"], alphabet, fold, bits, needs), lambda y: F.struct((x["start"] + y["start"]).alias("start"), (x["start"] + y["end"]).alias("end")))))
        out.append(_spans(hits, len(BASE) + k, kind))
    return out


def uncovered(spans: Column) -> Column:
    """Sorted spans without those of the method that lie within one base span."""
    ends = F.transform(spans, lambda x: F.when(x["rank"] < len(BASE), x["end"]).otherwise(F.lit(0).cast("long")))
    return let(running(ends, lambda a, b: F.greatest(a, b)), lambda reach: F.filter(F.transform(spans, lambda x, i: F.when((x["rank"] < len(BASE)) | (F.get(reach, i) < x["end"]), x)), lambda x: x.isNotNull()))


def find_secrets(docs: DataFrame, text: str = "text", into: str = "secrets") -> DataFrame:
    """docs with an array of start, rank, end and kind: the base spans, and the entropy spans that no base span covers, by start, then rank."""
    raw = F.coalesce(F.col(text), F.lit(""))
    # most rows have no span: the second step, outside generated code, leaves them alone
    return docs.withColumn(into, F.concat(*base_spans(raw), *entropy_spans(raw))).withColumn(into, F.when(F.size(into) == 0, F.col(into)).otherwise(let(F.array_sort(into), uncovered)))


def listed(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def masked(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with the characters of all spans replaced by an asterisk each."""
    at = fresh(docs, "secrets")

    def cover(spans: Column) -> Column:
        # the text between the spans as they follow one another, and asterisks for what each adds to those before it
        ends = let(F.transform(spans, lambda x: x["end"]), lambda e: running(e, lambda a, b: F.greatest(a, b)))

        def part(reach: Column, x: Column, i: Column) -> Column:
            upto = F.get(reach, i)
            gap = F.substr(F.col(text), (upto + 1).cast("int"), F.greatest(x["start"] - upto, F.lit(0)).cast("int"))
            return F.concat(gap, F.repeat(F.lit("*"), F.greatest(x["end"] - F.greatest(x["start"], upto), F.lit(0)).cast("int")))

        def built(reach: Column) -> Column:
            last = F.array_max(F.transform(spans, lambda x: x["end"]))
            return F.concat(F.array_join(F.transform(spans, lambda x, i: part(reach, x, i)), ""), F.substr(F.col(text), (last + 1).cast("int"), F.length(text)))

        return let(ends, built)

    return find_secrets(docs, text, at).withColumn(text, F.when(F.size(at) == 0, F.col(text)).otherwise(let(F.col(at), cover))).drop(at)


def secret_report(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256 and spans of each row."""
    s = find_secrets(docs.select("doc_id", "text"))
    counts = [F.size(_of_kind(F.col("secrets"), kind)).cast("long").alias(f"n_{kind}") for kind in BASE]
    base = listed(F.filter("secrets", lambda x: x["rank"] < len(BASE)))
    return s.select("doc_id", *counts, F.sha2(base, 256).alias("base_sha256"), listed(F.col("secrets")).alias("spans"))
