"""The encoder stage by stage, without a library: the `strict` backend of compression.

Each stage is a function over whole arrays, so that it can be looked at and tested alone: run
coding into blocks, sorting of rotations, recency ranks with zero runs, code lengths of bounded
depth, choice among several code tables, and the bits. What it writes is a regular archive, in
general not the bytes that the library would choose.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from functools import lru_cache

import numpy as np

from blockloom.functions import kernels as K

# Fixed values of the format and its public encoder.
RUN = 259  # bytes that one coded run stands for, at most: four and 255 repeats
GROUP = 50  # symbols that share a code table
DEEPEST = 17  # bits of a code, at most; readers take 20
PASSES = 4
TABLES = ((2400, 6), (1200, 5), (600, 4), (200, 3), (0, 2))  # number of symbols from which so many tables are used
SPARE = 19  # bytes of a block that stay free
SHORT = 64  # bytes up to which rotations are sorted as they are


def runs(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and lengths of the runs of equal bytes, none longer than RUN."""
    edge = np.flatnonzero(np.r_[True, raw[1:] != raw[:-1]]) if len(raw) else np.zeros(0, int)
    length = np.diff(np.r_[edge, len(raw)])
    pieces = -(-length // RUN)
    last = np.cumsum(pieces) - 1
    out = np.full(int(pieces.sum()), RUN)
    out[last] = length - RUN * (pieces - 1)
    return np.repeat(raw[edge], pieces), out


def collect(raw: bytes, level: int) -> Iterator[tuple[bytes, bytes]]:
    """The input in parts that fit a block each: (part, its run coding). A run is never cut by a block's end."""
    data = np.frombuffer(raw, np.uint8)
    byte, length = runs(data)
    size = np.where(length < 4, length, 5)
    total, ends = np.cumsum(size), np.cumsum(length)
    lo, room = 0, level * 100_000 - SPARE
    while lo < len(byte):
        hi = int(np.searchsorted(total, (total[lo - 1] if lo else 0) + room, "right"))
        b, n = byte[lo:hi], length[lo:hi]
        at = np.cumsum(size[lo:hi])
        coded = np.repeat(b, size[lo:hi])
        long = n >= 4
        coded[at[long] - 1] = n[long] - 4
        yield raw[(ends[lo - 1] if lo else 0) : ends[hi - 1]], coded.tobytes()
        lo = hi


def sort_rotations(data: bytes) -> tuple[bytes, int]:
    """Last column of the sorted rotations, and the row of the text itself. Ranks of twice the length come
    from pairs of ranks; equal rotations keep the order of their starts."""
    n = len(data)
    if n <= SHORT:
        twice = data + data
        starts = sorted(range(n), key=lambda i: twice[i : i + n])
        return bytes(data[i - 1] for i in starts), starts.index(0)
    text = np.frombuffer(data, np.uint8)
    rank, step = text.astype(np.int64), 1
    order = np.argsort(rank, kind="stable")
    while True:
        key = rank * (int(rank.max()) + 1) + np.roll(rank, -step)
        order = np.argsort(key, kind="stable")
        sorted_ = key[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(np.r_[False, sorted_[1:] != sorted_[:-1]])
        step *= 2
        if step >= n or rank[order[-1]] == n - 1:
            break
    return text[order - 1].tobytes(), int(np.flatnonzero(order == 0)[0])


def symbols(last: bytes) -> tuple[list[int], list[int]]:
    """The bytes in use, and the block's symbols: zero runs in bijective base two by 0 and 1, other recency
    ranks plus one, then the end."""
    used = sorted(set(last))
    recent, out, zeros = list(used), [], 0

    def flush() -> None:
        nonlocal zeros
        while zeros:
            out.append((zeros - 1) & 1)
            zeros = (zeros - 1) >> 1

    for byte in last:
        k = recent.index(byte)
        if not k:
            zeros += 1
            continue
        flush()
        out.append(k + 1)
        recent.insert(0, recent.pop(k))
    flush()
    return used, [*out, len(used) + 1]


def code_lengths(counts: list[int], deepest: int = DEEPEST) -> list[int]:
    """Lengths of a prefix code that is optimal for the counts, symbols of count 0 counted as 1. Of equal
    weights the older node is merged first. While a code is too long the counts are halved."""
    return list(_code_lengths(tuple(max(1, c) for c in counts), deepest))


@lru_cache(1024)
def _code_lengths(weights: tuple[int, ...], deepest: int) -> tuple[int, ...]:
    while True:
        heap = [(w, i) for i, w in enumerate(weights)]
        heapq.heapify(heap)
        above: dict[int, int] = {}
        node = len(weights)
        while len(heap) > 1:
            (a, x), (b, y) = heapq.heappop(heap), heapq.heappop(heap)
            above[x] = above[y] = node
            heapq.heappush(heap, (a + b, node))
            node += 1
        depth = {node - 1: 0}
        for child in range(node - 2, -1, -1):
            depth[child] = depth[above[child]] + 1
        lengths = [max(1, depth[i]) for i in range(len(weights))]
        if max(lengths) <= deepest:
            return tuple(lengths)
        weights = tuple(w // 2 + 1 for w in weights)


def table_count(n: int) -> int:
    return next(t for least, t in TABLES if n >= least)


def choose_tables(coded: np.ndarray, alphabet: int) -> tuple[list[list[int]], list[int]]:
    """Code lengths of each table and the table of each group. Tables start as specialists for parts of the
    alphabet of equal weight; then groups choose the cheapest table, lowest number on a tie, and
    tables are fitted to the groups that chose them, PASSES times."""
    tables, groups = table_count(len(coded)), -(-len(coded) // GROUP)
    weight = np.cumsum(np.bincount(coded, minlength=alphabet))
    part = np.minimum((weight - 1) * tables // weight[-1], tables - 1).clip(0)
    lengths = np.where(part[None] == np.arange(tables)[:, None], 1, 15)
    group = np.arange(len(coded)) // GROUP
    counts = np.zeros((groups, alphabet), np.int64)
    np.add.at(counts, (group, coded), 1)
    chosen = np.full(groups, -1)
    for _ in range(PASSES):
        before, chosen = chosen, (counts @ lengths.T).argmin(1)
        if (before == chosen).all():  # the tables are fitted already
            break
        lengths = np.array([code_lengths(counts[chosen == t].sum(0).tolist()) for t in range(tables)])
    return lengths.tolist(), chosen.tolist()


def codes(lengths: list[int]) -> list[int]:
    """Canonical codes: ascending by length, then by symbol."""
    out, code, before = [0] * len(lengths), 0, 0
    for n, s in sorted((n, s) for s, n in enumerate(lengths)):
        code <<= n - before
        out[s], before = code, n
        code += 1
    return out


def _packed(values: np.ndarray, sizes: np.ndarray) -> tuple[bytes, int]:
    """Values of so many bits each, one after another."""
    total = int(sizes.sum())
    own = np.repeat(np.arange(len(values)), sizes)
    place = np.arange(total) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    return np.packbits((values[own] >> (sizes[own] - 1 - place)) & 1).tobytes(), total


def encode_block(part: bytes, coded: bytes) -> tuple[bytes, int, int]:
    """One block's bits at a byte edge, their number, and the checksum of the part."""
    crc = K.crc32(part)
    last, origin = sort_rotations(coded)
    used, listed = symbols(last)
    stream = np.array(listed, np.int64)
    lengths, chosen = choose_tables(stream, len(used) + 2)
    writer = K.BitWriter()
    for value, count in ((K.BLOCK_MARK, 48), (crc, 32), (0, 1), (origin, 24)):
        writer.put(value, count)
    there = [False] * 256
    for b in used:
        there[b] = True
    rows = [there[16 * g : 16 * g + 16] for g in range(16)]
    mask = lambda flags: int("".join("1" if f else "0" for f in flags), 2)
    writer.put(mask(any(r) for r in rows), 16)
    for row in rows:
        if any(row):
            writer.put(mask(row), 16)
    writer.put(len(lengths), 3)
    writer.put(len(chosen), 15)
    recent = list(range(len(lengths)))
    for t in chosen:
        k = recent.index(t)
        writer.put((1 << (k + 1)) - 2, k + 1)
        recent.insert(0, recent.pop(k))
    for table in lengths:
        at = table[0]
        writer.put(at, 5)
        for n in table:
            writer.put(int(("10" * (n - at) if n > at else "11" * (at - n)) + "0", 2), 2 * abs(n - at) + 1)
            at = n
    tables = np.repeat(np.array(chosen), GROUP)[: len(stream)]
    head = writer.parts, writer.tail, writer.tail_bits
    count = 8 * sum(map(len, head[0])) + head[2]
    body, n = _packed(np.array([codes(t) for t in lengths])[tables, stream], np.array(lengths)[tables, stream])
    writer.put_bytes(body, n)
    return writer.finish(), count + n, crc


def compress(raw: bytes, level: int = 9) -> bytes:
    """A member of the input."""
    return K.stitch((encode_block(part, coded) for part, coded in collect(bytes(raw), level)), level)
