"""Chunked streams: decoding and encoding as state machines, and as Structured Streaming operators.

A stream is a key with chunks numbered from 0 and a last one that says so. Chunks may come in any
order; those that are early wait in the state. What goes out depends on the bytes alone, never
on how they were cut.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupStateTimeout

from blockloom.errors import ERROR_TYPE, BlockError
from blockloom.functions import kernels as K
from blockloom.functions import strict
from blockloom.options import DecodeOptions, EncodeOptions

MOST_EARLY = 100_000  # chunks that wait for an earlier one, at most


class StreamDecoder:
    """Decodes an archive pushed in pieces. A block is decoded when the marker behind it has come, so
    each byte is searched once; finished blocks go out though a later one fails. A failure is
    final; what is pushed after it, or after ignored trailing bytes, is dropped."""

    def __init__(self, options: DecodeOptions | None = None) -> None:
        self.o = options or DecodeOptions()
        self.buffer, self.pos, self.base = bytearray(), 0, 0
        self.state, self.level = "header", 0
        self.member = self.block = self.crc = self.total = 0
        self.error: BlockError | None = None
        self.scanned = 0

    def push(self, data: bytes) -> list[bytes]:
        if self.state in ("finished", "cancelled"):
            raise BlockError("INVALID_STATE", f"the stream was {self.state}")
        if self.state in ("failed", "ignoring"):
            return []
        self.buffer += data
        return self._run(False)

    def finish(self) -> list[bytes]:
        """Decodes the rest. Calling it again after success does nothing."""
        if self.state == "finished":
            return []
        if self.error or self.state == "cancelled":
            raise BlockError("INVALID_STATE", "the stream has failed or was cancelled")
        out = self._run(True) if self.state != "ignoring" else []
        if not self.error:
            self.state = "finished"
        return out

    def cancel(self) -> None:
        """Gives up: what is held is dropped, and pushing or finishing is an error from now on."""
        self.state, self.buffer = "cancelled", bytearray()

    def _run(self, last: bool) -> list[bytes]:
        out: list[bytes] = []
        try:
            while self._step(out, last):
                pass
        except BlockError as e:
            if e.bit is not None:
                e.bit += self.base
            self.error, self.state, self.buffer = e, "failed", bytearray()
        return [c for b in out for c in K.chunks(b, self.o.output_chunk_size)]

    def _drop(self) -> None:
        whole = self.pos // 8
        if whole:
            del self.buffer[:whole]  # the rest is not copied
            self.pos, self.base, self.scanned = self.pos % 8, self.base + 8 * whole, max(0, self.scanned - whole)

    def _step(self, out: list[bytes], last: bool) -> bool:
        if self.state == "header":
            more = self.buffer[:3] == K.MAGIC[: len(self.buffer)] and (self.o.concatenated or not self.member)
            if len(self.buffer) < 4 and not last and (more or not self.buffer):
                return False
            level = strict._header(self.buffer, 0, self.member, self.o)
            if level is None:
                self.state = "ignoring" if self.buffer else "header"
                self.buffer = bytearray()
                return False
            self.level, self.pos, self.crc, self.block, self.state = level, 32, 0, 0, "blocks"
            self._drop()
        have = 8 * len(self.buffer) - self.pos
        place = {"member": self.member, "block": self.block}
        if have < 48:
            if last:
                raise BlockError("UNEXPECTED_EOF", "input ends before a marker", 8 * len(self.buffer), **place)
            return False
        if K.bits(self.buffer, self.pos, 48) == K.END_MARK:
            return self._trailer(have, last)
        return self._block(out, last, place)

    def _trailer(self, have: int, last: bool) -> bool:
        pad = -(self.pos + 80) % 8
        if have < 80 + pad:
            if last:
                raise BlockError("UNEXPECTED_EOF", "input ends inside a trailer", 8 * len(self.buffer), self.member, self.block)
            return False
        stored = K.bits(self.buffer, self.pos + 48, 32)
        if stored != self.crc:
            raise BlockError("STREAM_CRC_MISMATCH", "stream checksum differs", self.pos + 48, self.member, self.block, stored, self.crc)
        if pad and K.bits(self.buffer, self.pos + 80, pad):
            raise BlockError("INVALID_PADDING", "padding is not zero", self.pos + 80, self.member, self.block)
        self.pos += 80 + pad
        self.member, self.state, self.scanned = self.member + 1, "header", 0
        self._drop()
        return bool(self.buffer) or last

    def _block(self, out: list[bytes], last: bool, place: dict) -> bool:
        left = None if self.o.max_output_bytes is None else self.o.max_output_bytes - self.total
        body, end = None, 0
        if K.bits(self.buffer, self.pos, 48) == K.BLOCK_MARK:
            start = max(0, self.scanned - 7)
            ends = [b for b, _ in K.markers(self.buffer[start:], start) if b > self.pos + 48]
            for end in ends:
                body = K.decode_block(self.buffer, self.pos, end, self.level)
                if body is not None:
                    break
            if body is not None and not strict.tables_fit(self.buffer, self.pos):
                body, ends = None, [0]
            if body is None and not ends and not last:
                if len(self.buffer) - self.pos // 8 > K.bound(self.level):
                    raise BlockError("COMPRESSED_BLOCK_TOO_LARGE", "an unfinished block is too large", self.pos, **place)
                self.scanned = len(self.buffer)
                return False
        if body is None:
            try:
                body, end = strict._diagnose(self.buffer, self.pos, self.level, left, place)
            except BlockError as e:
                if e.code != "UNEXPECTED_EOF" or last:
                    raise
                if len(self.buffer) - self.pos // 8 > K.bound(self.level):
                    raise BlockError("COMPRESSED_BLOCK_TOO_LARGE", "an unfinished block is too large", self.pos, **place) from None
                return False
        if left is not None and len(body) > left:
            raise BlockError("OUTPUT_LIMIT_EXCEEDED", "block passes the output limit", self.pos, **place)
        self.crc = K.combine(self.crc, K.bits(self.buffer, self.pos + 48, 32))
        self.total, self.block, self.pos, self.scanned = self.total + len(body), self.block + 1, end, end // 8
        self._drop()
        out.append(body)
        return True


class StreamEncoder:
    """Encodes raw pieces; holds less than one slice of input and less than a byte of output."""

    def __init__(self, options: EncodeOptions | None = None) -> None:
        self.o = options or EncodeOptions()
        self.raw, self.crc, self.tail, self.tail_bits = b"", 0, 0, 0
        self.begun = self.done = False

    def _encode(self, last: bool) -> bytes:
        level = self.o.block_size
        writer = K.BitWriter(self.tail, self.tail_bits)
        if not self.begun:
            writer.put(int.from_bytes(K.MAGIC + b"%d" % level, "big"), 32)
            self.begun = True
        size = K.slice_size(level)
        while len(self.raw) >= size or last and self.raw:
            body, count, crc = K.encode_block(self.raw[:size], level)
            self.raw, self.crc = self.raw[size:], K.combine(self.crc, crc)
            writer.put_bytes(body, count)
        if last:
            writer.put(K.END_MARK, 48)
            writer.put(self.crc, 32)
            out = writer.finish()
        else:
            out = writer.take()
        self.tail, self.tail_bits = writer.tail, writer.tail_bits
        return out

    def push(self, data: bytes) -> list[bytes]:
        if self.done:
            raise BlockError("INVALID_STATE", "the stream was finished")
        if not isinstance(data, (bytes, bytearray, memoryview)):
            raise TypeError("input must be bytes")
        self.raw += bytes(data)
        return K.chunks(self._encode(False), self.o.output_chunk_size)

    def cancel(self) -> None:
        """Gives up: what is held is dropped, and pushing is an error from now on."""
        self.done, self.raw = True, b""

    def finish(self) -> list[bytes]:
        if self.done:
            return []
        self.done = True
        return K.chunks(self._encode(True), self.o.output_chunk_size)


class _Ordered:
    """A machine with its chunks brought into order. Once it has ended only its place is kept."""

    def __init__(self, machine, most_early: int) -> None:
        self.machine, self.next, self.early, self.sent, self.most_early = machine, 0, {}, 0, most_early

    def _row(self, chunk: bytes | None, error: BlockError | None = None) -> tuple[int, bytes | None, dict | None]:
        self.sent += 1
        return self.sent - 1, chunk, error and error.row()

    def _end(self) -> None:
        self.machine, self.early = None, {}

    def feed(self, rows: pd.DataFrame) -> Iterator[tuple[int, bytes | None, dict | None]]:
        for seq, data, last in zip(rows["seq"], rows["bytes"], rows["is_last"], strict=True):
            if self.machine is not None and seq >= self.next:
                self.early[int(seq)] = (bytes(data) if data is not None else b"", bool(last))
        while self.machine is not None and self.next in self.early:
            data, last = self.early.pop(self.next)
            self.next += 1
            out = self.machine.push(data)
            if last and not getattr(self.machine, "error", None):
                out += self.machine.finish()
            for chunk in out:
                yield self._row(chunk)
            error = getattr(self.machine, "error", None)
            if error:
                yield self._row(None, error)
            if error or last:
                self._end()
        if len(self.early) > self.most_early:
            yield self._row(None, BlockError("INVALID_STATE", f"more than {self.most_early} chunks came before chunk {self.next}"))
            self._end()

    def expire(self) -> Iterator[tuple[int, bytes | None, dict | None]]:
        if self.machine is not None:
            yield self._row(None, BlockError("UNEXPECTED_EOF", f"chunk {self.next} did not come in time"))


def _stateful(rows: DataFrame, key: str, make, most_early: int, timeout_ms: int | None) -> DataFrame:
    out = f"{key} string, seq bigint, bytes binary, error {ERROR_TYPE}"

    def run(name, parts, state):
        ordered = pickle.loads(bytes(state.get[0])) if state.exists else _Ordered(make(), most_early)
        if state.hasTimedOut:
            found = [(name[0], *r) for r in ordered.expire()]
            state.remove()
        else:
            found = [(name[0], *r) for part in parts for r in ordered.feed(part)]
            state.update((pickle.dumps(ordered),))
            if timeout_ms:
                state.setTimeoutDuration(timeout_ms)
        yield pd.DataFrame(found, columns=[key, "seq", "bytes", "error"])

    source = rows.selectExpr(f"cast({key} as string) as {key}", "cast(seq as bigint) as seq", "bytes", "is_last")
    wait = GroupStateTimeout.ProcessingTimeTimeout if timeout_ms else GroupStateTimeout.NoTimeout
    return source.groupBy(key).applyInPandasWithState(run, out, "machine binary", "append", wait)


def decode(rows: DataFrame, key: str = "stream_id", most_early: int = MOST_EARLY, timeout_ms: int | None = None, **options) -> DataFrame:
    """Streaming rows (key, seq, bytes, is_last) of archives to rows (key, seq, bytes, error). Of a stream that
    has ended only its place is kept, so that late copies of chunks do nothing. With `timeout_ms` a
    stream that rests for so long ends with UNEXPECTED_EOF, if it had not ended, and leaves the state.
    More than `most_early` chunks ahead of a missing one end it with INVALID_STATE."""
    chosen = DecodeOptions(**options)
    return _stateful(rows, key, lambda: StreamDecoder(chosen), most_early, timeout_ms)


def encode(rows: DataFrame, key: str = "stream_id", most_early: int = MOST_EARLY, timeout_ms: int | None = None, **options) -> DataFrame:
    """Streaming rows (key, seq, bytes, is_last) of raw bytes to rows of archives; state as in `decode`."""
    chosen = EncodeOptions(**options)
    return _stateful(rows, key, lambda: StreamEncoder(chosen), most_early, timeout_ms)
