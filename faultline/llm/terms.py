"""Terms of texts in numpy: cut by byte classes, packed by length into uint64 words, radix-sorted and run-counted.

Arrow's UTF-8 buffers are read as they are: a term's bytes are those of a table, and each byte of a non-ASCII character is a term's. Terms of up to 8
bytes become one uint64 word, those of up to 16 two; longer ones go to buckets by their number of words, sorted as bytes. A padded word
is unique for its length class, as terms hold no zero byte.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Bytes of text that are packed at once: the arrays of one piece take some 60 times that.
PIECE = 1 << 20
SHORT = 2  # words


def byte_table(ascii_runs: list[tuple[int, int]]) -> np.ndarray:
    """table[b]: whether byte b belongs to a term; the runs are of ASCII codes, both ends included."""
    table = np.zeros(256, bool)
    table[128:] = True
    for low, high in ascii_runs:
        table[low : high + 1] = True
    return table


LETTERS = byte_table([(65, 90), (97, 122)])
LETTERS_DIGITS = byte_table([(48, 57), (65, 90), (97, 122)])
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


@dataclass
class Bucket:
    """Terms of one length class: keys (n x words, big-endian so that they sort as bytes do) and the document of each, in text order."""

    keys: np.ndarray
    docs: np.ndarray


def pieces(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(number of the first text, bytes, ends) of runs of texts of about PIECE bytes; a longer text is a piece of its own, whole. Nulls are empty."""
    texts = texts.cast(pa.large_string())
    if not len(texts):
        return
    if texts.null_count:
        texts = texts.fill_null("")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    first = 0
    while first < len(texts):
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + PIECE, "right")) - 1)
        yield first, data[offsets[first] : offsets[last]], offsets[first + 1 : last + 1] - offsets[first]
        first = last


def cut(data: np.ndarray, ends: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, document) of each term in the bytes of texts that end at ends."""
    inside = table[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[ends] = True  # a term never goes on into the next text
    before = np.empty(len(data), bool)
    before[:1], before[1:] = False, inside[:-1]
    starts = np.flatnonzero(inside & (~before | edge[:-1]))
    after = np.empty(len(data), bool)
    after[-1:], after[:-1] = False, inside[1:]
    stops = np.flatnonzero(inside & (~after | edge[1:])) + 1
    return starts, stops - starts, np.searchsorted(ends, starts, "right")


def pack(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, words: int) -> np.ndarray:
    """Terms of at most 8 * words bytes as rows of big-endian words, A-Z lower-cased, padded by zeros."""
    at = np.arange(8 * words)
    where = starts[:, None] + at
    out = np.where(at < lengths[:, None], _LOWER[data[np.minimum(where, len(data) - 1)]], 0).astype(np.uint8)
    return out.view(">u8").astype(np.uint64).reshape(len(starts), words)


def buckets(data: np.ndarray, ends: np.ndarray, table: np.ndarray) -> Iterator[Bucket]:
    """The terms by length class: one word, two words, then classes of doubling width."""
    starts, lengths, docs = cut(data, ends, table)
    low, words = 0, 1
    while len(starts):
        mine = (lengths > low) & (lengths <= 8 * words)
        if mine.any():
            # a class of wide terms is packed in runs that hold PIECE bytes at most, or one term
            # packed in runs, as packing takes 8 times the bytes; one bucket, so that a document's terms stay together
            step, where = max(1, PIECE // (8 * words)), np.flatnonzero(mine)
            keys = [pack(data, starts[part], lengths[part], words) for part in (where[k : k + step] for k in range(0, len(where), step))]
            yield Bucket(np.concatenate(keys), docs[where])
        rest = lengths > 8 * words
        starts, lengths, docs = starts[rest], lengths[rest], docs[rest]
        low, words = 8 * words, 2 * words


def radix_order(keys: np.ndarray) -> np.ndarray:
    """The stable order of rows of uint64 words: least digit first, 16 bits a digit, digits that are all equal left out."""
    order = np.arange(len(keys))
    for word in range(keys.shape[1] - 1, -1, -1):
        column = keys[:, word]
        differ = int(np.bitwise_or.reduce(column ^ column[0])) if len(column) else 0
        for shift in range(0, 64, 16):
            if (differ >> shift) & 0xFFFF:
                digit = ((column >> np.uint64(shift)) & np.uint64(0xFFFF)).astype(np.uint16)
                order = order[np.argsort(digit[order], kind="stable")]
    return order


def sort_order(keys: np.ndarray) -> np.ndarray:
    """Radix for short terms; the wide ones of a bucket as byte strings. Both are stable."""
    if keys.shape[1] <= SHORT:
        return radix_order(keys)
    return np.argsort(keys.astype(">u8").view(f"S{8 * keys.shape[1]}").ravel(), kind="stable")


def runs(keys: np.ndarray) -> np.ndarray:
    """Where a row differs from the one before: the first rows of the runs of sorted rows."""
    new = np.ones(len(keys), bool)
    new[1:] = (keys[1:] != keys[:-1]).any(axis=1)
    return np.flatnonzero(new)


def unpack(keys: np.ndarray) -> pa.Array:
    """The terms of packed rows as strings."""
    data = np.ascontiguousarray(keys.astype(">u8")).view(np.uint8).reshape(len(keys), -1)
    used = data != 0
    offsets = np.zeros(len(keys) + 1, np.int64)
    np.cumsum(used.sum(axis=1), out=offsets[1:])
    return pa.Array.from_buffers(pa.large_string(), len(keys), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data[used]))])
