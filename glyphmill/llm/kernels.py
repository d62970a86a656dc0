"""Vectorised text kernels shared by the shingle operators.

A batch of texts is handled as one UTF-8 byte buffer: words, word hashes and
shingle hashes come from numpy passes over that buffer, so no Python object is
made per word.  Hashes are 64 bits wide.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
_MULTIPLIER = U64(0x9E3779B97F4A7C15)
_MIX_A = U64(0xBF58476D1CE4E5B9)
_MIX_B = U64(0x94D049BB133111EB)

#: Bytes of the separators of `[^\x20\x09-\x0D]+` words.
SPACE_BYTES = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)

#: Texts are worked on in runs of about this many bytes (one long text alone may exceed it).
RUN_BYTES = 1 << 19


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser (splitmix64)."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= _MIX_A
    x ^= x >> U64(27)
    x *= _MIX_B
    x ^= x >> U64(31)
    return x


_BYTE_VALUES = mix(np.arange(1, 257, dtype=U64) * _MULTIPLIER)


def _word_bytes(bare: bool) -> np.ndarray:
    """Bytes of words: all but separators, or (`bare`) ASCII letters and digits and all of other characters."""
    table = np.ones(256, dtype=bool)
    if bare:
        table[:0x80] = False
        for first, last in ((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A)):
            table[first : last + 1] = True
    else:
        table[list(SPACE_BYTES)] = False
    return table


_IS_WORD = {bare: _word_bytes(bare) for bare in (False, True)}


def _byte_table(lower: bool, bare: bool) -> np.ndarray:
    table = _BYTE_VALUES.copy()
    if lower:
        table[0x41:0x5B] = table[0x61:0x7B]
    table[~_IS_WORD[bare]] = 0
    return table


_TABLES = {(lower, bare): _byte_table(lower, bare) for lower in (False, True) for bare in (False, True)}


def runs(texts: pa.Array, size: int = RUN_BYTES) -> Iterator[tuple[int, int]]:
    """Index ranges of `texts` holding about `size` bytes each."""
    offsets = _offsets(texts)
    start, n = 0, len(texts)
    while start < n:
        stop = int(np.searchsorted(offsets, offsets[start] + size, side="right")) - 1
        stop = min(n, max(stop, start + 1))
        yield start, stop
        start = stop


def _offsets(texts: pa.Array) -> np.ndarray:
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    return np.frombuffer(texts.buffers()[1], dtype=kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)


def plain(texts: pa.Array | pa.ChunkedArray) -> pa.Array:
    """One string array without nulls (null counts as empty)."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
        if isinstance(texts, pa.ChunkedArray):
            texts = pa.concat_arrays(texts.chunks) if texts.num_chunks else pa.array([], pa.string())
    return texts.fill_null("") if texts.null_count else texts


def buffer(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts and the n + 1 offsets of the texts in them."""
    offsets = _offsets(texts)
    base = int(offsets[0])
    bounds = offsets - base
    size = int(bounds[-1])
    if size == 0:
        return np.empty(0, np.uint8), bounds
    return np.frombuffer(texts.buffers()[2], dtype=np.uint8)[base : base + size], bounds


def word_hashes(texts: pa.Array, lower: bool = True, places: bool = False, bare: bool = False) -> tuple[np.ndarray, ...]:
    """Hashes of all words of the texts in order, and per text the offset of its first word (n + 1 offsets).

    With `places`, also the byte at which each word starts.  With `bare`, ASCII punctuation separates words too.
    """
    data, bounds = buffer(texts)
    size = len(data)
    none = (np.empty(0, U64), np.zeros(len(texts) + 1, np.int64), np.empty(0, np.int64))
    if size == 0:
        return none if places else none[:2]
    inside = _IS_WORD[bare][data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    edges = bounds[:-1][bounds[:-1] < size]
    begins[edges] = inside[edges]  # a word never runs over the end of its text
    starts = np.flatnonzero(begins)
    if len(starts) == 0:
        return none if places else none[:2]
    place = np.arange(size, dtype=np.int64)
    lengths = np.diff(np.append(starts, size))
    place[starts[0] :] -= np.repeat(starts, lengths)
    place[: starts[0]] = 0
    powers = np.empty(int(lengths.max()) + 1, dtype=U64)
    powers[0] = 1
    powers[1:] = _MULTIPLIER
    np.multiply.accumulate(powers, out=powers)
    values = _TABLES[lower, bare][data]
    values *= powers[place]
    hashes = mix(np.add.reduceat(values, starts))
    firsts = np.searchsorted(starts, bounds, side="left")
    return (hashes, firsts, starts) if places else (hashes, firsts)


def shingle_hashes(words: np.ndarray, firsts: np.ndarray, size: int, short_whole: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all `size`-word windows per text, in order, and per text the offset of its first one.

    With `short_whole`, a text with 1 to size - 1 words has its whole word sequence as its only shingle.
    """
    counts = np.diff(firsts)
    n_out = np.maximum(counts - size + 1, 0)
    if short_whole:
        n_out = np.where((counts > 0) & (counts < size), 1, n_out)
    outs = np.concatenate(([0], np.cumsum(n_out)))
    total = int(outs[-1])
    if total == 0:
        return np.empty(0, U64), outs
    at = np.arange(total, dtype=np.int64) + np.repeat(firsts[:-1] - outs[:-1], n_out)
    left = np.repeat(firsts[1:], n_out) - at
    hashes = np.zeros(total, dtype=U64)
    for k in range(size):
        have = left > k
        if have.all():
            hashes = hashes * _MULTIPLIER + words[at + k]
        else:
            hashes[have] = hashes[have] * _MULTIPLIER + words[at[have] + k]
    return mix(hashes), outs


def distinct_sorted(hashes: np.ndarray, firsts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per text the distinct hashes in rising order, with new offsets."""
    counts = np.diff(firsts)
    owner = np.repeat(np.arange(len(counts)), counts)
    order = np.lexsort((hashes, owner)) if len(counts) > 1 else np.argsort(hashes, kind="stable")
    hashes, owner = hashes[order], owner[order]
    keep = np.ones(len(hashes), dtype=bool)
    keep[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
    hashes, owner = hashes[keep], owner[keep]
    return hashes, np.searchsorted(owner, np.arange(len(counts) + 1))
