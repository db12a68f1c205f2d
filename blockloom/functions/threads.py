"""Blocks coded side by side in the threads of one process: libbz2 works without the interpreter's lock.
Results come in order, and only a bounded number of blocks is in flight."""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterable, Iterator
from concurrent.futures import Future, ThreadPoolExecutor

from blockloom.functions import kernels as K
from blockloom.functions import strict
from blockloom.options import DecodeOptions


def in_order(pool: ThreadPoolExecutor, work: Callable, items: Iterable, flight: int) -> Iterator:
    """work(item) of all items, in their order; at most `flight` are begun and not yet taken."""
    waiting: deque[Future] = deque()
    try:
        for item in items:
            waiting.append(pool.submit(work, item))
            if len(waiting) >= flight:
                yield waiting.popleft().result()
        while waiting:
            yield waiting.popleft().result()
    finally:
        for f in waiting:
            f.cancel()


def encode(parts: Iterable[bytes], level: int, workers: int) -> Iterator[bytes]:
    """A member of parts that fit a block each, as it grows."""
    writer, crc = K.BitWriter(), 0
    writer.put(int.from_bytes(K.MAGIC + b"%d" % level, "big"), 32)
    with ThreadPoolExecutor(workers) as pool:
        for body, count, block_crc in in_order(pool, lambda part: K.encode_block(part, level), parts, 2 * workers):
            writer.put_bytes(body, count)
            crc = K.combine(crc, block_crc)
            yield writer.take()
    writer.put(K.END_MARK, 48)
    writer.put(crc, 32)
    yield writer.finish()


def blocks(data: bytes, options: DecodeOptions | None = None, workers: int = 4) -> Iterator[dict]:
    """Like `strict.blocks`, with the blocks between neighbouring markers decoded ahead. Only their order of
    work differs: a false marker or a defect is found and named by the reader in sequence."""
    found = K.markers(data)
    level = data[3] - 48 if len(data) > 3 and 49 <= data[3] <= 57 else 9
    pairs = [(bit, end) for (bit, kind), (end, _) in zip(found, found[1:], strict=False) if kind == "block" and (end - bit) // 8 <= K.bound(level)]
    with ThreadPoolExecutor(workers) as pool:
        results = in_order(pool, lambda p: (*p, K.decode_block(data, *p, level)), pairs, 2 * workers)
        now: list[tuple[int, int, bytes | None]] = []

        def ahead(pos: int, own: int) -> tuple[bytes, int] | None:
            while not now or now[0][0] < pos:
                nxt = next(results, None)
                if nxt is None:
                    return None
                now[:] = [nxt]
            bit, end, out = now[0]
            return (out, end) if bit == pos and own == level and out is not None else None

        yield from strict.blocks(data, options, found, ahead=ahead)
