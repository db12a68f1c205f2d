"""Vectorised word handling over the bytes of a batch of texts.

Words are `[^\\x20\\x09-\\x0D]+`. These six bytes never occur inside a longer UTF-8
sequence, so the split works on bytes. All functions take the texts of one Arrow batch
at once; nothing is done word by word in Python.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

U = np.uint64
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_ODD = 0x9E3779B97F4A7C15 | 1
_INV = pow(_ODD, -1, 1 << 64)
PIECE = 1 << 21


def flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts one after another, and where each starts (nulls are empty)."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.fill_null(b"" if pa.types.is_binary(texts.type) or pa.types.is_large_binary(texts.type) else "")
    texts = texts.cast(pa.large_binary())
    n = len(texts)
    offsets = np.frombuffer(texts.buffers()[1], np.int64, n + 1 + texts.offset)[texts.offset :]
    data = texts.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None and n else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batch: pa.RecordBatch, column: str, most: int = PIECE) -> Iterator[pa.RecordBatch]:
    """The rows of an Arrow batch in runs of about `most` bytes of text (one row at least)."""
    texts = batch.column(column)
    if not len(texts):
        return
    size = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    total, lo = np.cumsum(size), 0
    while lo < len(texts):
        hi = max(lo + 1, int(np.searchsorted(total, (total[lo - 1] if lo else 0) + most, "right")))
        yield batch.slice(lo, hi - lo)
        lo = hi


def spans(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every word in `raw`, and the first word of each text (length n + 1)."""
    ink = ~_SPACE[raw]
    edge = np.empty(len(raw) + 1, bool)
    edge[0], edge[-1] = bool(len(raw)) and ink[0], bool(len(raw)) and ink[-1]
    edge[1:-1] = ink[1:] != ink[:-1]
    bounds = offsets[1:-1]
    bounds = bounds[(bounds > 0) & (bounds < len(raw))]
    both = bounds[ink[bounds - 1] & ink[bounds]] if len(bounds) else bounds
    at = np.flatnonzero(edge)
    if len(both):  # a text's end cuts a run of ink in two words
        both = np.unique(both)
        at = np.sort(np.concatenate([at, both, both]), kind="stable")
    starts, ends = at[0::2], at[1::2]
    return starts, ends, np.searchsorted(starts, offsets)


_POWERS: dict[int, np.ndarray] = {}


def powers(n: int, base: int) -> np.ndarray:
    """base^0 .. base^(n-1) modulo 2^64; the longest table asked for so far is kept."""
    known = _POWERS.get(base)
    if known is None or len(known) < n:
        known = _powers(n, base)
        if n <= 2 * PIECE:
            _POWERS[base] = known
    return known[:n]


def _powers(n: int, base: int) -> np.ndarray:
    out = np.full(n, U(base & (2**64 - 1)))
    if n:
        out[0] = U(1)
    return np.multiply.accumulate(out)


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> U(32))
    x = x * U(0xD6E8FEB86659FD93)
    x = x ^ (x >> U(32))
    x = x * U(0xD6E8FEB86659FD93)
    return x ^ (x >> U(32))


def _letters(seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(0, 2**64, 256, np.uint64)


def word_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int) -> np.ndarray:
    """64-bit hash of each word: a polynomial in its bytes, then mixed. Works in pieces
    of the buffer so that helper arrays stay small whatever the batch holds."""
    out = np.empty(len(starts), np.uint64)
    letters = _letters(seed)
    lo = 0
    while lo < len(starts):
        base = int(starts[lo])
        hi = int(np.searchsorted(starts, base + PIECE, "left"))
        hi = max(hi, lo + 1)
        stop = int(ends[hi - 1])
        up = powers(stop - base + 1, _ODD)
        total = np.zeros(stop - base + 1, np.uint64)
        np.cumsum(letters[raw[base:stop]] * up[:-1], out=total[1:])
        down = powers(stop - base + 1, _INV)
        s, e = starts[lo:hi] - base, ends[lo:hi] - base
        out[lo:hi] = mix((total[e] - total[s]) * down[s] + (e - s).astype(np.uint64) * U(0xA24BAED4963EE407))
        lo = hi
    return out


def word_names(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, which: int) -> np.ndarray:
    """64-bit name of each word, one of several kinds with independent constants. The first sixteen
    bytes of all words are taken in together, eight at a time; the few longer words are hashed by
    the library. Words of one length of up to eight bytes never share a name."""
    salt = _letters(1000 + which)[:4] | U(1)
    padded = np.concatenate([raw, np.zeros(16, np.uint8)])
    lanes = np.ndarray((len(padded) - 7,), "<u8", padded, strides=(1,))
    out = np.empty(len(starts), np.uint64)
    masks = np.array([(1 << 8 * n) - 1 for n in range(8)] + [2**64 - 1], np.uint64)
    for lo in range(0, len(starts), PIECE // 8):
        s = starts[lo : lo + PIECE // 8]
        n = ends[lo : lo + PIECE // 8] - s
        h = mix((lanes[s] & masks[np.minimum(n, 8)]) * salt[0] + n.astype(np.uint64) * salt[1])
        more = np.flatnonzero(n > 8)
        h[more] = mix(h[more] + (lanes[s[more] + 8] & masks[np.minimum(n[more] - 8, 8)]) * salt[2])
        out[lo : lo + PIECE // 8] = h
    for i in np.flatnonzero(ends - starts > 16).tolist():
        out[i] = xxhash.xxh64_intdigest(raw[starts[i] : ends[i]].tobytes(), 1000 + which)
    return out


def window_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Hash of each run of `size` word hashes; runs that cross texts are included and are
    for the caller to mask. Empty if there are fewer words."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.empty(n, np.uint64)
    for lo in range(0, n, PIECE):
        part = words[lo : min(n, lo + PIECE) + size - 1]
        total = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(part * powers(len(part), _ODD), out=total[1:])
        m = len(part) - size + 1
        out[lo : lo + m] = mix((total[size:] - total[:m]) * powers(m, _INV))
    return out


def lower_ascii(raw: np.ndarray) -> np.ndarray:
    big = (raw >= 65) & (raw <= 90)
    return np.where(big, raw | 32, raw).astype(np.uint8)


def single_spaced(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words joined by exactly one space: the buffer, and each word's start and end there."""
    size = ends - starts
    new = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(size + 1, out=new[1:])
    out = np.full(int(new[-1]), 32, np.uint8)
    ink = np.ones(int(new[-1]), bool)
    if len(starts):
        ink[new[1:] - 1] = False
        keep = np.zeros(len(raw) + 1, np.int8)
        keep[starts] += 1  # starts differ from each other, and so do ends
        keep[ends] -= 1
        out[ink] = raw[np.cumsum(keep[:-1]).astype(bool)]
    return out, new[:-1], new[1:] - 1


# The five primes of XXH64.
P1, P2, P3, P4, P5 = (
    U(11400714785074694791), U(14029467366897019727), U(1609587929392839161),
    U(9650029242287828579), U(2870177450012600261),
)


def _rot(x: np.ndarray, r: int) -> np.ndarray:
    return (x << U(r)) | (x >> U(64 - r))


def xxh64(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 42) -> np.ndarray:
    """XXH64 of each slice `raw[start:end]`. Slices under 32 bytes are hashed together, eight
    bytes of all slices at a time; the few longer ones go to the library."""
    length = ends - starts
    short = length < 32
    out = np.empty(len(starts), np.uint64)
    for i in np.flatnonzero(~short):
        out[i] = xxhash.xxh64_intdigest(raw[starts[i] : ends[i]].tobytes(), seed)
    picked = np.flatnonzero(short)
    padded = np.concatenate([raw, np.zeros(8, np.uint8)])
    lanes8 = np.ndarray((len(padded) - 7,), "<u8", padded, strides=(1,))
    lanes4 = np.ndarray((len(padded) - 7,), "<u4", padded, strides=(1,))
    with np.errstate(over="ignore"):
        for lo in range(0, len(picked), PIECE // 4):
            rows = picked[lo : lo + PIECE // 4]
            order = np.argsort(length[rows], kind="stable")[::-1]
            rows = rows[order]
            at, left = starts[rows].copy(), length[rows].copy()
            h = U(seed) + P5 + left.astype(np.uint64)
            n = len(rows)
            while n and (n := int(np.count_nonzero(left[:n] >= 8))):  # rows are by falling length
                k = _rot(lanes8[at[:n]] * P2, 31) * P1
                h[:n] = _rot(h[:n] ^ k, 27) * P1 + P4
                at[:n] += 8
                left[:n] -= 8
            four = np.flatnonzero(left >= 4)
            h[four] = _rot(h[four] ^ (lanes4[at[four]].astype(np.uint64) * P1), 23) * P2 + P3
            at[four] += 4
            left[four] -= 4
            for i in range(3):
                one = np.flatnonzero(left > i)
                h[one] = _rot(h[one] ^ (padded[at[one] + i].astype(np.uint64) * P5), 11) * P1
            h ^= h >> U(33)
            h *= P2
            h ^= h >> U(29)
            h *= P3
            h ^= h >> U(32)
            out[rows] = h
    return out
