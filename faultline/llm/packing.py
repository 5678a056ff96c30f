"""Best-fit packing of token pieces into sequences, finished by a swap-based local search.

Each text becomes its token ids and an end id; only longer ones are cut, so that all pieces but the first
are whole sequences. Pieces are dealt by their row numbers into groups of about GROUP_PIECES (the number of groups
grows with the input), and each group is packed in one task: best fit, longest first, then local search.
The search takes the emptiest bin and gives its pieces away: it moves a piece into another underfull bin,
or exchanges it for one or two shorter ones of that bin. Each step raises the sum of squared fills, so the
search ends; bins that lost all their pieces are gone. It goes over all underfull bins, emptiest first, again and again until it can
empty none of them, or the bound sum / capacity is met. Tables of each bin's piece lengths and pair sums make a step a look along one row.

Defined results: null text is empty and one piece of one token, the end id; a text with the string of a
special token gets that token, as the tokenizer itself does; long texts are cut into as many pieces as they need; pieces of equal length go in any order; repeated rows are packed each; null doc_ids are carried;
an empty table gives an empty result; other columns of the input don't matter.
"""

from __future__ import annotations

import base64
import os
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bucket_count, staged

CAPACITY = 1024
END_ID = 2
GROUP_PIECES = 40_000
#: Token ids of that many words are kept by each Python worker, about 100 MB.
CACHE_WORDS = 300_000
SPECIAL = "<|endoftext|>"


def vocabulary() -> dict[str, str]:
    """Where the public vocabulary lies: the tokenizer's file and the same vocabulary as ranks."""
    import public_tokenizers as public

    return {"json": public.path("byte_bpe_50k.json"), "ranks": public.path("byte_bpe_50k.tiktoken"), "pattern": public.PATTERN}


class Encoder(dict):
    """The tokenizer's ids of texts, as little-endian unsigned 32-bit bytes; keeps those of frequent words.

    Splitting before each space doesn't change the ids as long as no two spaces meet and no special token
    occurs: a pre-token has a space only in front. Texts for which that doesn't hold go to the tokenizer whole.
    """

    def __init__(self, files: dict[str, str]):
        super().__init__()
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import tiktoken
        from tokenizers import Tokenizer

        with open(files["ranks"], "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        self.words = tiktoken.Encoding("words", pat_str=files["pattern"], mergeable_ranks=ranks, special_tokens={})
        self.whole = Tokenizer.from_file(files["json"])

    def __missing__(self, word: str) -> bytes:
        ids = np.array(self.words.encode_ordinary(word), "<u4").tobytes()
        if len(self) < CACHE_WORDS:
            self[word] = ids
        return ids

    def encode(self, text: str) -> bytes:
        if not text:
            return b""
        if "  " in text or SPECIAL in text:
            return np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        first, *rest = text.split(" ")
        return b"".join([self[first] if first else b"", *map(self.__getitem__, [" " + w for w in rest])])


_encoders: dict[str, Encoder] = {}


def _encoder(files: dict[str, str]) -> Encoder:
    """One for each Python worker, whatever the number of its tasks."""
    if files["json"] not in _encoders:
        _encoders[files["json"]] = Encoder(files)
    return _encoders[files["json"]]


def cut(n: int, capacity: int) -> list[int]:
    """First ids of the pieces of n ids: the first piece takes what is over whole pieces."""
    if n <= capacity:
        return [0]
    over = n % capacity
    return [0] * (over > 0) + list(range(over, n, capacity))


def token_pieces(docs: DataFrame, capacity: int = CAPACITY, end_id: int = END_ID, files: dict[str, str] | None = None, keep_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and ids, as bytes) of each piece of each row."""
    files = files or vocabulary()
    end = np.array([end_id], "<u4").tobytes()

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(files)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                row, piece, start, length, crc, kept = [], [], [], [], [], []
                for i, text in enumerate(part.column(1).to_pylist()):
                    ids = encoder.encode(text or "") + end
                    starts = cut(len(ids) // 4, capacity)
                    for k, (a, b) in enumerate(zip(starts, [*starts[1:], len(ids) // 4], strict=True)):
                        own = ids[4 * a : 4 * b]
                        row.append(i), piece.append(k), start.append(a), length.append(b - a), crc.append(zlib.crc32(own))
                        if keep_ids:
                            kept.append(own)
                columns = [part.column(0).take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))]
                names = ["doc_id", "piece", "start", "length", "ids_crc32"]
                if keep_ids:
                    columns, names = [*columns, pa.array(kept, pa.binary())], [*names, "ids"]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids binary" * keep_ids
    return docs.select("doc_id", "text").mapInArrow(split, schema)


def best_fit(lengths: list[int], capacity: int) -> list[list[int]]:
    """Bins of indices: longest first, each into the fullest bin that has room."""
    bins: list[list[int]] = []
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms: list[int] = []  # those with a bin, in order
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        at = bisect_left(rooms, lengths[i])
        if at == len(rooms):
            b, room = len(bins), capacity
            bins.append([])
        else:
            room = rooms[at]
            b = by_room[room].pop()
            if not by_room[room]:
                rooms.pop(at)
        bins[b].append(i)
        room -= lengths[i]
        if room:
            if not by_room[room]:
                insort(rooms, room)
            by_room[room].append(b)
    return bins


class Bins:
    """Underfull bins for the local search: their rooms, and for each length a the smallest piece, and sum of two pieces, of a or more of each bin (beyond the capacity if there is none)."""

    def __init__(self, bins: list[list[int]], lengths: list[int], capacity: int):
        self.bins, self.lengths, self.capacity = bins, lengths, capacity
        self.none = 2 * capacity
        self.at = np.arange(len(bins))
        self.room = np.array([capacity - sum(lengths[i] for i in b) for b in bins], np.int32)
        self.one, self.two = np.zeros((capacity + 1, len(bins)), np.int32), np.zeros((capacity + 1, len(bins)), np.int32)
        for b in range(len(bins)):
            self.noted(b)

    def noted(self, b: int) -> None:
        """Brings the tables of a bin up to date."""
        single, pairs, seen = 0, 0, set()
        for i in self.bins[b]:
            n = self.lengths[i]
            if n not in seen:
                pairs |= single << n
                single |= 1 << n
                seen.add(n)
            else:
                pairs |= 1 << 2 * n
        for table, bits in ((self.one, single), (self.two, pairs)):
            held = np.frombuffer((bits & ((1 << self.capacity) - 1)).to_bytes(self.capacity // 8 + 1, "little"), np.uint8)
            at = np.nonzero(np.unpackbits(held, bitorder="little"))[0]
            table[:, b] = np.append(at, self.none)[np.searchsorted(at, np.arange(self.capacity + 1))]

    def exchanged(self, a: int, out: int, b: int, back: list[int]) -> None:
        """Piece out goes from bin a to bin b, pieces back from b to a."""
        self.bins[a].remove(out)
        self.bins[b].append(out)
        for j in back:
            self.bins[b].remove(j)
            self.bins[a].append(j)
        gain = self.lengths[out] - sum(self.lengths[j] for j in back)
        self.room[a] += gain
        self.room[b] -= gain
        self.noted(a)
        self.noted(b)

    def step(self, e: int) -> bool:
        """One move or exchange that makes bin e emptier and raises the sum of squares, if there is one; the bin that it fills most is taken."""
        full = self.capacity + 1
        for i in sorted(self.bins[e], key=lambda i: -self.lengths[i]):
            a = self.lengths[i]
            need = np.maximum(a - self.room, 1)  # what a bin must give back
            for parts in (0, 1, 2):
                gain = a - (self.one, self.two)[parts - 1][need, self.at].astype(np.int32) if parts else np.full(len(self.room), a, np.int32)
                left = self.room - gain
                left[(left < 0) | (gain <= 0) | (self.room == self.capacity)] = full
                left[gain <= self.room - self.room[e]] = full  # the other bin would be the emptier one
                left[e] = full
                b = int(left.argmin())
                if left[b] < full:
                    self.exchanged(e, i, b, self.found(b, a - int(gain[b]), parts))
                    return True
        return False

    def found(self, b: int, total: int, parts: int) -> list[int]:
        """parts pieces of a bin whose lengths sum to total."""
        by_length: dict[int, int] = {}
        for j in self.bins[b] if parts else ():
            n = self.lengths[j]
            if parts == 1 and n == total:
                return [j]
            if parts == 2 and total - n in by_length:
                return [by_length[total - n], j]
            by_length[n] = j
        return []


def improve(bins: list[list[int]], lengths: list[int], capacity: int) -> list[list[int]]:
    """The local search over underfull bins; full bins stay as they are."""
    least = -(-sum(lengths) // capacity)
    fill = [sum(lengths[i] for i in b) for b in bins]
    full = [b for b, n in zip(bins, fill, strict=True) if n == capacity]
    if len(bins) <= least:
        return bins
    held = Bins([b for b, n in zip(bins, fill, strict=True) if n < capacity], lengths, capacity)
    count, before = len(bins), None
    while count != before and count > least:  # a pass that empties no bin is the last
        before = count
        for e in np.argsort(-held.room, kind="stable").tolist():
            if not held.bins[e] or held.room[e] == 0:
                continue
            while held.bins[e] and held.step(e):
                pass
            count -= not held.bins[e]
            if count <= least:
                break
    return full + [b for b in held.bins if b]


def pack(pieces: DataFrame, capacity: int = CAPACITY, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """The staged pieces with sequence_id and offset."""
    short, every = pieces.agg(F.count_if(F.col("length") < capacity), F.count("*")).first()
    groups = max(bucket_count(short, group_pieces), bucket_count(every, 10 * group_pieces))  # whole pieces only need numbers
    dealt = pieces.withColumn("group", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(groups)).cast("int"))  # copies of a row are dealt like any others

    def packed(key: tuple, table: pa.Table) -> pa.Table:
        length = table.column("length").to_numpy()
        sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
        full, short = np.nonzero(length >= capacity)[0], np.nonzero(length < capacity)[0]
        sequence[full] = np.arange(len(full))
        own = length[short].tolist()
        for b, bin_ in enumerate(improve(best_fit(own, capacity), own, capacity), len(full)):
            at = 0
            for i in bin_:
                sequence[short[i]], offset[short[i]] = b, at
                at += own[i]
        base = key[0].as_py() << 36
        return table.drop_columns(["group"]).append_column("sequence_id", pa.array(sequence + base)).append_column("offset", pa.array(offset))

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema)
    return dealt.groupBy("group").applyInArrow(packed, f"{fields}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, files: dict[str, str] | None = None, keep_ids: bool = False) -> DataFrame:
    """Each piece of each row with its place: doc_id, piece, start, length, ids_crc32, (ids,) sequence_id, offset."""
    return pack(staged(token_pieces(docs, capacity, files=files, keep_ids=keep_ids), "pieces"), capacity)


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id, length and ids (bytes) of each sequence of pieces packed with their ids; at most capacity ids each."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    joined = F.aggregate(parts, F.lit(b"").cast("binary"), lambda a, x: F.concat(a, x["ids"]))
    return packed.groupBy("sequence_id").agg(F.sum("length").alias("length"), joined.alias("ids"))
