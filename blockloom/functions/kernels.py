"""Bytes in, bytes out: checksums, markers, bit moves, and block coding by the standard library.

A block of the format is bit-aligned. To decode one alone, its bits are moved to a byte edge and
given a header, an end marker and its own checksum as the stream's: a complete archive of one
block, which libbz2 reads at full speed. Encoding goes the other way round.
"""

from __future__ import annotations

import bz2
import zlib
from collections.abc import Iterable

MAGIC = b"BZh"
BLOCK_MARK = 0x314159265359  # fixed values of the format: the digits of pi and of its square root
END_MARK = 0x177245385090
_REVERSED = bytes(int(f"{b:08b}"[::-1], 2) for b in range(256))


def crc32(data: bytes, value: int = 0) -> int:
    """The format's checksum: CRC-32 of most-significant-bit-first bytes. It is the common CRC-32 of
    the bit-reversed bytes, bit-reversed. `value` continues an earlier one."""
    return _flip32(zlib.crc32(data.translate(_REVERSED), _flip32(value)))


def _flip32(x: int) -> int:
    return int.from_bytes(x.to_bytes(4, "little").translate(_REVERSED), "big")


def combine(stream: int, block: int) -> int:
    """Checksum of a stream after one more block."""
    return ((stream << 1 | stream >> 31) & 0xFFFFFFFF) ^ block


def fold(blocks: Iterable[int]) -> int:
    out = 0
    for block in blocks:
        out = combine(out, block)
    return out


def bound(level: int) -> int:
    """Most bytes that an unfinished block may hold."""
    return level * 400_000 + 65_536


def bits(data: bytes, at: int, count: int) -> int:
    """`count` bits from bit `at`, most significant first."""
    first, last = at // 8, (at + count + 7) // 8
    return int.from_bytes(data[first:last], "big") >> (8 * last - at - count) & ((1 << count) - 1)


def cut_bits(data: bytes, start: int, end: int) -> bytes:
    """Bits start..end moved to a byte edge, padded with zeros."""
    count = end - start
    size = (count + 7) // 8
    return (bits(data, start, count) << (8 * size - count)).to_bytes(size, "big")


def _shifted(mark: int) -> list[tuple[int, bytes]]:
    """For each alignment, the five bytes of a marker that are whole there."""
    out = []
    for shift in range(8):
        wide = (mark << (8 - shift)).to_bytes(7, "big")
        out.append((shift, wide[1:6] if shift else wide[:6]))
    return out


_NEEDLES = [(kind, mark, shift, inner) for kind, mark in (("block", BLOCK_MARK), ("end", END_MARK)) for shift, inner in _shifted(mark)]


def markers(data: bytes, first_byte: int = 0) -> list[tuple[int, str]]:
    """(bit, kind) of every marker candidate, at any alignment, in order. Candidates may lie inside
    a payload by chance; decoding tells. `first_byte` is added to the positions."""
    found = []
    for kind, mark, shift, inner in _NEEDLES:
        at = data.find(inner)
        while at >= 0:
            bit = 8 * (at - 1) + shift if shift else 8 * at
            if bit >= 0 and bit + 48 <= 8 * len(data) and bits(data, bit, 48) == mark:
                found.append((bit + 8 * first_byte, kind))
            at = data.find(inner, at + 1)
    return sorted(found)


def wrap(data: bytes, start: int, end: int, level: int) -> bytes:
    """The block at bits start..end as an archive of its own."""
    head = MAGIC + b"%d" % level
    crc = bits(data, start + 48, 32)
    count = end - start
    body = (bits(data, start, count) << 80) | (END_MARK << 32) | crc
    size = (count + 80 + 7) // 8
    return head + (body << (8 * size - count - 80)).to_bytes(size, "big")


def decode_block(data: bytes, start: int, end: int, level: int) -> bytes | None:
    """Output of the block at bits start..end, None if that isn't exactly one good block."""
    if end - start < 105 or bits(data, start, 48) != BLOCK_MARK:
        return None
    decoder = bz2.BZ2Decompressor()
    try:
        out = decoder.decompress(wrap(data, start, end, level))
    except (OSError, ValueError, EOFError):
        return None
    return out if decoder.eof and not decoder.unused_data else None


def slice_size(level: int) -> int:
    """Raw bytes that fit one block whatever they are: run coding makes at most five of four, and
    the library keeps 19 bytes free. It depends on the level alone, so that bytes never depend on
    how the work was dealt out."""
    return (level * 100_000 - 19) * 4 // 5


def encode_block(raw: bytes, level: int) -> tuple[bytes, int, int]:
    """One block's bits at a byte edge, their number, and the block's checksum."""
    archive = bz2.compress(raw, level)
    found = markers(archive)
    ends = [bit for bit, kind in found if kind == "end" and bits(archive, bit + 48, 32) == bits(archive, 80, 32) and 8 * len(archive) - bit - 80 < 8]
    if len(ends) != 1:
        raise RuntimeError("the library made more than one block")
    end = ends[0]
    return cut_bits(archive, 32, end), end - 32, bits(archive, 80, 32)


def stitch(blocks: Iterable[tuple[bytes, int, int]], level: int) -> bytes:
    """A member from its blocks in order."""
    writer = BitWriter()
    writer.put(int.from_bytes(MAGIC + b"%d" % level, "big"), 32)
    crc = 0
    for body, count, block_crc in blocks:
        writer.put_bytes(body, count)
        crc = combine(crc, block_crc)
    writer.put(END_MARK, 48)
    writer.put(crc, 32)
    return writer.finish()


class BitWriter:
    """Appends bits, most significant first, at any offset; `take` gives the whole bytes so far."""

    def __init__(self, tail: int = 0, tail_bits: int = 0) -> None:
        self.parts: list[bytes] = []
        self.tail, self.tail_bits = tail, tail_bits

    def put(self, value: int, count: int) -> None:
        total = self.tail_bits + count
        value |= self.tail << count
        keep = total % 8
        if total - keep:
            self.parts.append((value >> keep).to_bytes((total - keep) // 8, "big"))
        self.tail, self.tail_bits = value & ((1 << keep) - 1), keep

    def put_bytes(self, data: bytes, count: int) -> None:
        if count:
            self.put(int.from_bytes(data[: (count + 7) // 8], "big") >> (-count % 8), count)

    def take(self) -> bytes:
        out = b"".join(self.parts)
        self.parts = []
        return out

    def finish(self) -> bytes:
        if self.tail_bits:
            self.put(0, 8 - self.tail_bits)
        return self.take()


def compress(raw: bytes, level: int = 9) -> bytes:
    """A member of the input, cut into blocks as the distributed encoder does."""
    if not isinstance(raw, (bytes, bytearray, memoryview)):
        raise TypeError("input must be bytes")
    raw, size = bytes(raw), slice_size(level)
    return stitch((encode_block(raw[i : i + size], level) for i in range(0, len(raw), size)), level)


def chunks(data: bytes, size: int) -> list[bytes]:
    return [data[i : i + size] for i in range(0, len(data), size)]
