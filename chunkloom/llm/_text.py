"""Vectorised word handling over Arrow string buffers.

A word is a maximal run of bytes that are not ASCII white space.  Word
identities are 64-bit hashes of the word's bytes; all arithmetic is numpy
over slices of a few megabytes, so memory stays flat whatever a partition
holds, and a single text longer than a slice is a slice of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_BYTE[[9, 10, 11, 12, 13, 32]] = 0
_BASE = np.uint64(0x9E3779B97F4A7C15)
SLICE_BYTES = 1 << 21


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64: a bijection of 64-bit integers."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def raw(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts and the n + 1 offsets; a null counts as empty."""
    if texts.null_count:
        texts = pc.fill_null(texts, "")
    if len(texts) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    _, at, data = texts.buffers()
    offs = np.frombuffer(at, kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    buf = np.zeros(0, np.uint8) if data is None else np.frombuffer(data, np.uint8)[offs[0] : offs[-1]]
    return buf, offs - offs[0]


def slices(texts: pa.Array, size: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets) of slices of about `size` bytes."""
    buf, offs = raw(texts)
    row, n = 0, len(offs) - 1
    while row < n:
        end = max(row + 1, int(np.searchsorted(offs, offs[row] + size, "right")) - 1)
        end = min(end, n)
        yield row, end, buf[offs[row] : offs[end]], offs[row : end + 1] - offs[row]
        row = end


def spans(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and for each text the index of its first word (n + 1 values)."""
    n = len(buf)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offs), np.int64)
    word = ~_SPACE[buf]
    begin, last = word.copy(), word.copy()
    begin[1:] &= ~word[:-1]
    last[:-1] &= ~word[1:]
    edge = offs[:-1][offs[:-1] < n]
    begin[edge] = word[edge]
    edge = offs[1:][offs[1:] > 0] - 1
    last[edge] = word[edge]
    starts = np.flatnonzero(begin)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, offs)


def word_hashes(buf: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """64-bit identity of every word."""
    if len(starts) == 0:
        return np.zeros(0, np.uint64)
    buf = buf[starts[0] :]
    at = starts - starts[0]
    run = np.diff(at, append=len(buf))
    inside = np.arange(len(buf), dtype=np.int64) - np.repeat(at, run)
    powers = np.full(int(run.max()), _BASE, np.uint64)
    powers[0] = 1
    np.cumprod(powers, out=powers)
    return mix(np.add.reduceat(_BYTE[buf] * powers[inside], at))


def chain(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of every run of n consecutive values (len(h) - n + 1 of them), order matters."""
    if n == 1:
        return h.copy()
    if len(h) < n:
        return np.zeros(0, np.uint64)
    out, have = h, 1
    for bit in bin(n)[3:]:
        step = np.uint64(pow(int(_BASE), have, 1 << 64))
        out, have = out[:-have] * step + out[have:], have * 2
        if bit == "1":
            out, have = out[:-1] * _BASE + h[have:], have + 1
    return mix(out)


def gram_sets(h: np.ndarray, first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct n-gram hashes of each text, one after the other, and n + 1 offsets.

    A text of fewer than n words, but at least one, has one gram: all its words.
    """
    counts = np.diff(first)
    grams = chain(h, n)
    total = int(first[-1])
    doc = np.repeat(np.arange(len(counts)), np.maximum(counts - n + 1, 0))
    keep = np.ones(len(grams), bool)
    for k in range(1, n):  # starts from which the text's end is nearer than n words
        bad = first[1:][counts >= k] - k
        keep[bad[bad < len(grams)]] = False
    grams = grams[keep]
    short = np.flatnonzero((counts > 0) & (counts < n))
    if len(short):
        extra = np.array([int(mix(np.array([int(h[first[d] : first[d + 1]].sum(dtype=np.uint64)) ^ int(_fold(h[first[d] : first[d + 1]]))], np.uint64))[0]) for d in short], np.uint64)
        grams, doc = np.concatenate([grams, extra]), np.concatenate([doc, short])
    del total
    order = np.lexsort((grams, doc))
    grams, doc = grams[order], doc[order]
    new = np.ones(len(grams), bool)
    new[1:] = (grams[1:] != grams[:-1]) | (doc[1:] != doc[:-1])
    grams, doc = grams[new], doc[new]
    return grams, np.searchsorted(doc, np.arange(len(counts) + 1))


def _fold(h: np.ndarray) -> int:
    out = len(h)
    for x in h.tolist():
        out = (out * int(_BASE) + x) & (2**64 - 1)
    return out
