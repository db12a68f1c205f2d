"""Strict decoding of archives: exact codes where libbz2 only says no.

Blocks are decoded by libbz2. Only one that it refuses is read bit by bit here, to name the
defect. Member headers, stream checksums, padding and trailing bytes are always checked here.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np

from blockloom.errors import BlockError
from blockloom.functions import kernels as K
from blockloom.options import DecodeOptions


class _Short(Exception):
    """The input ends inside a block."""


class _Reader:
    """Bits of a byte string from a position on, in windows of one big number."""

    def __init__(self, data: bytes, at: int) -> None:
        self.data, self.at, self.end = data, at, 8 * len(data)
        self.window, self.base, self.top = 0, 0, 0

    def read(self, count: int) -> int:
        if self.at + count > self.end:
            raise _Short
        if not (self.base <= self.at and self.at + count <= self.top):
            first = self.at // 8
            part = self.data[first : first + 64]
            self.window, self.base, self.top = int.from_bytes(part, "big"), 8 * first, 8 * (first + len(part))
        self.at += count
        return self.window >> (self.top - self.at) & ((1 << count) - 1)


def _table(lengths: list[int]) -> dict[tuple[int, int], int]:
    """(length, code) to symbol, by ascending length and symbol."""
    out, code, last = {}, 0, 0
    for length, symbol in sorted((n, s) for s, n in enumerate(lengths)):
        code <<= length - last
        last = length
        out[length, code] = symbol
        code += 1
    return out


def read_block(data: bytes, start: int, level: int) -> tuple[np.ndarray | None, int, int, bool]:
    """Parse the block at bit `start`: (output bytes, stored checksum, end bit, randomised). The output
    of a randomised block is left to the library. Raises BlockError without place, or _Short."""
    r = _Reader(data, start)
    most = level * 100_000

    def bad(code: str, message: str) -> BlockError:
        return BlockError(code, message, bit=r.at)

    if r.read(48) != K.BLOCK_MARK:
        raise bad("INVALID_BLOCK_HEADER", "no block marker")
    crc, randomised, origin = r.read(32), bool(r.read(1)), r.read(24)
    if origin >= most:
        raise bad("INVALID_BWT_POINTER", "origin beyond the block size")
    groups = r.read(16)
    used = [16 * g + i for g in range(16) if groups >> (15 - g) & 1 for m in [r.read(16)] for i in range(16) if m >> (15 - i) & 1]
    if not used:
        raise bad("INVALID_BLOCK_HEADER", "no symbols")
    tables, selectors = r.read(3), r.read(15)
    if not 2 <= tables <= 6 or not selectors:
        raise bad("INVALID_HUFFMAN_TABLE", "number of tables or selectors")
    recent, chosen = list(range(tables)), []
    for _ in range(selectors):
        k = 0
        while r.read(1):
            k += 1
            if k >= tables:
                raise bad("INVALID_HUFFMAN_TABLE", "selector beyond the tables")
        recent.insert(0, recent.pop(k))
        chosen.append(recent[0])
    codes = []
    for _ in range(tables):
        length, lengths = r.read(5), []
        for _ in range(len(used) + 2):
            while True:
                if not 1 <= length <= 20:
                    raise bad("INVALID_HUFFMAN_TABLE", "code length out of range")
                if not r.read(1):
                    break
                length += -1 if r.read(1) else 1
            lengths.append(length)
        if sum(1 << (20 - n) for n in lengths) > 1 << 20:
            raise bad("INVALID_HUFFMAN_TABLE", "more codes than bits allow")
        codes.append(_table(lengths))
    last = _symbols(r, codes, chosen, used, most, bad)
    if origin >= len(last):
        raise bad("INVALID_BWT_POINTER", "origin beyond the block")
    return (None if randomised else expand_runs(undo_bwt(last, origin))), crc, r.at, randomised


_DELTAS = re.compile("(?:1[01])*0")


def tables_fit(data: bytes, start: int) -> bool:
    """Whether no code table of a block claims more codes than bits allow. libbz2 doesn't look at
    that; all other rules for the tables it checks by itself. Reads the header as a bit string."""
    first = start // 8
    part = data[first : first + 40_000]
    text = bin(int.from_bytes(b"\1" + part, "big"))[3:]
    at = start - 8 * first + 105
    groups = text[at : at + 16].count("1")
    used = text[at + 16 : at + 16 + 16 * groups].count("1")
    at += 16 + 16 * groups
    tables, selectors = int(text[at : at + 3] or "0", 2), int(text[at + 3 : at + 18] or "0", 2)
    unary = text[at + 18 :].split("0", selectors)
    at = len(text) - len(unary[-1])
    for _ in range(tables):
        length, room = int(text[at : at + 5] or "0", 2), 1 << 20
        at += 5
        for _ in range(used + 2):
            m = _DELTAS.match(text, at)
            if m is None:
                return True
            steps = m[0][1::2]
            length += steps.count("0") - steps.count("1")
            room -= 1 << max(0, 20 - length)
            at = m.end()
        if room < 0:
            return False
    return True


def _symbols(r: _Reader, codes: list, chosen: list[int], used: list[int], most: int, bad) -> np.ndarray:
    """The block's last column: Huffman symbols, zero runs and recency ranks undone."""
    out, recent = bytearray(), list(used)
    run, weight, end = 0, 1, len(used) + 1
    group = 0
    while True:
        if group >= len(chosen):
            raise bad("INVALID_HUFFMAN_TABLE", "selectors exhausted")
        table = codes[chosen[group]]
        group += 1
        for _ in range(50):
            code = length = 0
            while True:
                code, length = code << 1 | r.read(1), length + 1
                symbol = table.get((length, code))
                if symbol is not None:
                    break
                if length >= 20:
                    raise bad("INVALID_HUFFMAN_TABLE", "unknown code")
            if symbol <= 1:
                run += weight << symbol
                weight <<= 1
                if run > most:
                    raise bad("BLOCK_OVERFLOW", "run beyond the block size")
                continue
            if run:
                if len(out) + run > most:
                    raise bad("BLOCK_OVERFLOW", "run beyond the block size")
                out += bytes([recent[0]]) * run
                run, weight = 0, 1
            if symbol == end:
                return np.frombuffer(bytes(out), np.uint8)
            if len(out) >= most:
                raise bad("BLOCK_OVERFLOW", "more symbols than the block size")
            recent.insert(0, recent.pop(symbol - 1))
            out.append(recent[0])


def undo_bwt(last: np.ndarray, origin: int) -> np.ndarray:
    """The text whose sorted rotations end with `last`; `origin` is the row of the text itself."""
    successor = np.argsort(last, kind="stable").tolist()
    at, out = origin, np.empty(len(last), np.int64)
    for i in range(len(last)):
        at = successor[at]
        out[i] = at
    return last[out]


def expand_runs(data: np.ndarray) -> np.ndarray:
    """Four equal bytes are followed by the number of further repeats."""
    out, run, before, i = bytearray(), 0, -1, 0
    for byte in data.tolist():
        if run == 4:
            out += bytes([before]) * byte
            run, before = 0, -1
            continue
        run = run + 1 if byte == before else 1
        before = byte
        out.append(byte)
        i += 1
    return np.frombuffer(bytes(out), np.uint8)


def blocks(data: bytes, options: DecodeOptions | None = None, found: list[tuple[int, str]] | None = None, backend: str = "fast", ahead: Callable[[int, int], tuple[bytes, int] | None] | None = None) -> Iterator[dict]:
    """The blocks of an archive in order: {member, block, level, start_bit, end_bit, crc, out}, and per
    member one with block None and its stream checksum. Raises BlockError at the first defect,
    after all good blocks before it. `found` are marker candidates, which may hold false ones;
    `backend` 'strict' reads every block bit by bit. `ahead` may know a block by its place and level."""
    o = options or DecodeOptions()
    found = K.markers(data) if found is None else sorted(found)
    bits_ = [bit for bit, _ in found]
    at, member, total = 0, 0, 0
    while True:
        level = _header(data, at, member, o)
        if level is None:
            return
        pos, crc, block = 8 * at + 32, 0, 0
        while True:
            place = {"member": member, "block": block}
            if pos + 48 > 8 * len(data):
                raise BlockError("UNEXPECTED_EOF", "input ends before a marker", pos, **place)
            mark = K.bits(data, pos, 48)
            if mark == K.END_MARK:
                break
            out, end = (ahead(pos, level) if ahead and backend == "fast" and mark == K.BLOCK_MARK else None) or (None, 0)
            if out is not None and not tables_fit(data, pos):
                out = None
            elif out is None and backend == "fast" and mark == K.BLOCK_MARK:
                k = int(np.searchsorted(bits_, pos, "right"))
                for end in bits_[k : k + 8]:  # a false marker ends a block too early; the next one may fit
                    if (end - pos) // 8 > K.bound(level):
                        break
                    if (out := K.decode_block(data, pos, end, level)) is not None:
                        break
                if out is not None and not tables_fit(data, pos):
                    out = None
            left = None if o.max_output_bytes is None else o.max_output_bytes - total
            if out is None:
                out, end = _diagnose(data, pos, level, left, place)
            if left is not None and len(out) > left:
                raise BlockError("OUTPUT_LIMIT_EXCEEDED", "block passes the output limit", pos, **place)
            stored = K.bits(data, pos + 48, 32)
            yield {**place, "level": level, "start_bit": pos, "end_bit": end, "crc": stored, "out": out}
            total += len(out)
            crc, pos, block = K.combine(crc, stored), end, block + 1
        if pos + 80 > 8 * len(data):
            raise BlockError("UNEXPECTED_EOF", "input ends inside a trailer", pos, member, block)
        stored = K.bits(data, pos + 48, 32)
        if stored != crc:
            raise BlockError("STREAM_CRC_MISMATCH", "stream checksum differs", pos + 48, member, block, stored, crc)
        pad = -(pos + 80) % 8
        if pad and K.bits(data, pos + 80, pad):
            raise BlockError("INVALID_PADDING", "padding is not zero", pos + 80, member, block)
        yield {"member": member, "block": None, "level": level, "start_bit": pos, "end_bit": pos + 80 + pad, "crc": stored, "out": b""}
        at, member = (pos + 80 + pad) // 8, member + 1


def _header(data: bytes, at: int, member: int, o: DecodeOptions) -> int | None:
    """Level of the member at byte `at`; None at the regular end of the archive."""
    head = data[at : at + 4]
    if member:
        if not head:
            return None
        if not o.concatenated or head[:3] != K.MAGIC or len(head) < 4:
            if o.trailing_data == "ignore":
                return None
            raise BlockError("TRAILING_DATA", "bytes after the last member", 8 * at, member)
    elif head[:3] != K.MAGIC[: len(head)]:
        raise BlockError("INVALID_MAGIC", "not an archive of this format", 0, 0)
    elif len(head) < 4:
        raise BlockError("UNEXPECTED_EOF", "input ends inside the header", 8 * len(data), 0)
    if not 49 <= head[3] <= 57:
        raise BlockError("INVALID_BLOCK_SIZE", "level is not 1 to 9", 8 * at + 24, member)
    return head[3] - 48


def _diagnose(data: bytes, pos: int, level: int, left: int | None, place: dict) -> tuple[bytes, int]:
    try:
        out, stored, end, randomised = read_block(data, pos, level)
    except _Short:
        raise BlockError("UNEXPECTED_EOF", "input ends inside a block", 8 * len(data), **place) from None
    except BlockError as e:
        raise BlockError(e.code, e.message, e.bit, **place) from None
    if randomised:
        plain = K.decode_block(data, pos, end, level)
        if plain is None:
            raise BlockError("BLOCK_CRC_MISMATCH", "block checksum differs", pos + 48, **place, expected=stored)
        return plain, end
    raw = out.tobytes()
    if left is not None and len(raw) > left:
        raise BlockError("OUTPUT_LIMIT_EXCEEDED", "block passes the output limit", pos, **place)
    actual = K.crc32(raw)
    if actual != stored:
        raise BlockError("BLOCK_CRC_MISMATCH", "block checksum differs", pos + 48, **place, expected=stored, actual=actual)
    return raw, end


def decompress(data: bytes, options: DecodeOptions | None = None, backend: str = "fast") -> bytes:
    """Output of a whole archive; raises BlockError."""
    if not isinstance(data, (bytes, bytearray, memoryview)):
        raise TypeError("input must be bytes")
    return b"".join(b["out"] for b in blocks(bytes(data), options, backend=backend))


def validate(data: bytes, options: DecodeOptions | None = None) -> BlockError | None:
    try:
        for _ in blocks(data, options):
            pass
    except BlockError as e:
        return e
    return None
