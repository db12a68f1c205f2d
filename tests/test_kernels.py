import base64
import bz2
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from blockloom.errors import CODES, BlockError
from blockloom.functions import encoder as E
from blockloom.functions import kernels as K
from blockloom.functions import strict as S
from blockloom.functions import threads
from blockloom.options import DecodeOptions, EncodeOptions, parse_concurrency
from blockloom.plans.queries import SAMPLE, bad_archives
from blockloom.streaming.chunks import StreamDecoder, StreamEncoder

GOOD = base64.b64decode(SAMPLE)


def code(data, backend="fast", **options):
    try:
        S.decompress(data, DecodeOptions(**options), backend)
    except BlockError as e:
        assert e.code in CODES
        return e.code


def noise(n, seed=1):
    return random.Random(seed).randbytes(n)


def test_checksum():
    assert K.crc32(b"123456789") == 0xFC891918
    assert K.crc32(b"") == 0
    data = noise(1000)
    assert K.crc32(data[300:], K.crc32(data[:300])) == K.crc32(data)
    assert K.fold([5, 7]) == K.combine(5, 7)


SHAPES = [bytes([7]) * n for k in (4, E.RUN, 2 * E.RUN) for n in (k - 1, k, k + 1)]  # about where a coded run begins or ends
SHAPES += [b"", b"\0", b"sleet and snow, " * 5, bytes(range(256)) * 4, b"no", noise(150_001, 9), b"\xff" * 333_333]


@pytest.mark.parametrize("raw", SHAPES)
@pytest.mark.parametrize("level", [1, 9])
def test_round_trip(raw, level):
    packed = K.compress(raw, level)
    assert bz2.decompress(packed) == raw
    assert S.decompress(packed) == raw


@settings(max_examples=40, deadline=None)
@given(st.binary(max_size=3000))
def test_round_trip_any(raw):
    assert S.decompress(bz2.compress(raw, 1), backend="strict") == raw


def test_worst_case_slices_make_one_block():
    for level in (1, 9):
        raw = b"aaaabbbb" * (K.slice_size(level) // 8 + 1)
        K.encode_block(raw[: K.slice_size(level)], level)


def test_bad_archives():
    for name, data, options, expected in bad_archives():
        assert code(data, **options) == expected, name


def test_every_truncation_and_flip_agrees_in_both_backends():
    for n in range(len(GOOD)):
        assert code(GOOD[:n]) == "UNEXPECTED_EOF"
    for bit in range(32, 8 * len(GOOD)):
        bad = bytearray(GOOD)
        bad[bit // 8] ^= 128 >> bit % 8
        assert code(bytes(bad)) == code(bytes(bad), "strict"), bit


def test_blocks_before_a_defect_stay():
    packed = bytearray(K.compress(noise(250_000), 1))
    packed[-40] ^= 1
    seen = []
    with pytest.raises(BlockError):
        for b in S.blocks(bytes(packed)):
            seen.append(b["block"])
    assert seen and seen == list(range(len(seen)))


def test_false_markers():
    packed = K.compress(noise(250_000), 1)
    fake = [*K.markers(packed), (8 * 3000 + 5, "block"), (8 * (len(packed) - 40) + 1, "end")]
    assert b"".join(b["out"] for b in S.blocks(packed, found=fake)) == noise(250_000)


def test_markers_at_every_alignment():
    for shift in range(8):
        w = K.BitWriter()
        w.put(1, 24 + shift)
        w.put(K.BLOCK_MARK, 48)
        w.put(0, 80)
        assert K.markers(w.finish()) == [(24 + shift, "block")]


def test_inverse_transform_matches_naive_rotations():
    for text in (b"banana", b"abcabcabc", bytes(range(7)) * 9, b"a", b"aab"):
        rows = sorted(range(len(text)), key=lambda i: text[i:] + text[:i])
        last = bytes(text[i - 1] for i in rows)
        out = S.undo_bwt(np.frombuffer(last, np.uint8), rows.index(0)).tobytes()
        assert out == text


@pytest.mark.parametrize("size", [1, 3, 37, 997, 65536, 10**9])
def test_chunks_make_no_difference(size):
    raw = noise(20_000) if size < 10 else noise(220_000)
    packed = K.compress(raw, 1) + K.compress(b"second", 2)
    d, out = StreamDecoder(), []
    for part in K.chunks(packed, size):
        out += d.push(part)
    assert b"".join(out + d.finish()) == raw + b"second"
    assert d.finish() == []
    e, out = StreamEncoder(EncodeOptions(block_size=1)), []
    for part in K.chunks(raw, size):
        out += e.push(part)
    assert b"".join(out + e.finish()) == K.compress(raw, 1)


def test_stream_failure_is_final():
    bad = GOOD[:10] + bytes([GOOD[10] ^ 1]) + GOOD[11:]
    d = StreamDecoder()
    assert d.push(bad) == [] and d.error.code == "BLOCK_CRC_MISMATCH"
    assert d.push(GOOD) == []
    with pytest.raises(BlockError, match="INVALID_STATE"):
        d.finish()
    d = StreamDecoder()
    d.push(GOOD)
    d.finish()
    with pytest.raises(BlockError, match="INVALID_STATE"):
        d.push(b"x")


def test_stream_codes_match_whole_decoding():
    for name, data, options, expected in bad_archives():
        for size in (1, 7, 1000):
            d = StreamDecoder(DecodeOptions(**options))
            for part in K.chunks(data, size):
                d.push(part)
            if not d.error:
                d.finish()
            assert (d.error and d.error.code) == expected, (name, size)


def test_stream_bounds_an_unfinished_block():
    d = StreamDecoder()
    d.push(GOOD[:4] + K.BLOCK_MARK.to_bytes(6, "big"))
    for _ in range(K.bound(9) // 100_000 + 2):
        d.push(noise(100_000, 3))
        if d.error:
            break
    assert d.error is not None and d.error.code in ("COMPRESSED_BLOCK_TOO_LARGE", "INVALID_BWT_POINTER", "INVALID_HUFFMAN_TABLE", "INVALID_BLOCK_HEADER")


def test_options():
    for bad in ({"block_size": 0}, {"block_size": 10}, {"output_chunk_size": 0}, {"yield_after_ms": -1}, {"yield_after_ms": float("inf")}):
        with pytest.raises(ValueError):
            EncodeOptions(**bad)
    for bad in ({"concatenated": 1}, {"trailing_data": "no"}, {"max_output_bytes": 1.5}, {"concurrency": 1.5}):
        with pytest.raises(TypeError):
            DecodeOptions(**bad)
    assert parse_concurrency("auto", 7) == 7
    with pytest.raises(TypeError):
        K.compress("text")


@pytest.mark.parametrize("raw", [*SHAPES[:13], noise(4000, 3), b"ab" * 3000, b"to and fro " * 20_000])
def test_strict_encoder(raw):
    packed = E.compress(raw, 1)
    assert bz2.decompress(packed) == raw == S.decompress(packed) == S.decompress(packed, backend="strict")
    assert len(packed) <= 1.02 * len(bz2.compress(raw, 1)) + 40


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=600) | st.text("ab", max_size=900).map(str.encode))
def test_strict_encoder_any(raw):
    assert bz2.decompress(E.compress(raw, 1)) == raw


def test_blocks_are_filled_with_whole_runs():
    raw = b"".join(bytes([b]) * n for b, n in zip(noise(9000, 5), [random.Random(6).randrange(1, 700) for _ in range(9000)], strict=True))
    parts = list(E.collect(raw, 1))
    assert b"".join(p for p, _ in parts) == raw and len(parts) == len([b for b in S.blocks(E.compress(raw, 1)) if b["block"] is not None])
    for part, coded in parts:
        assert len(coded) <= 100_000 - E.SPARE and S.expand_runs(np.frombuffer(coded, np.uint8)).tobytes() == part
    assert all(len(coded) > 100_000 - E.SPARE - 5 for _, coded in parts[:-1])


def test_rotations_sorted():
    rnd = random.Random(7)
    for raw in [bytes(rnd.choice(b"ab") for _ in range(rnd.randrange(1, 40))) for _ in range(200)] + [b"abab" * 9, b"z" * 50]:
        order = sorted(range(len(raw)), key=lambda i: (raw[i:] + raw[:i], i))
        assert E.sort_rotations(raw) == (bytes(raw[i - 1] for i in order), order.index(0))


def test_code_lengths():
    rnd = random.Random(8)
    for n in (2, 3, 7, 60, 258):
        counts = [rnd.choice([0, 1, 5, 90, 300]) for _ in range(n)]
        lengths = E.code_lengths(counts)
        assert sum(2.0**-x for x in lengths) == 1 and max(lengths) <= E.DEEPEST
        assert sum(max(1, c) * x for c, x in zip(counts, lengths, strict=True)) == _least_cost([max(1, c) for c in counts])
    fibonacci = [1, 1]
    while len(fibonacci) < 40:
        fibonacci.append(fibonacci[-1] + fibonacci[-2])
    lengths = E.code_lengths(fibonacci)
    assert max(lengths) <= E.DEEPEST and sum(2.0**-x for x in lengths) <= 1
    assert E.code_lengths([5, 5, 5, 5]) == [2, 2, 2, 2]


def _least_cost(weights):
    total = 0
    while len(weights) > 1:
        weights = sorted(weights)
        total += weights[0] + weights[1]
        weights = [weights[0] + weights[1], *weights[2:]]
    return total


def test_tables_suit_their_groups():
    stream = np.array([0, 1] * 300 + [5, 6, 7] * 200 + [9])
    lengths, chosen = E.choose_tables(stream, 10)
    assert len(lengths) == E.table_count(len(stream)) == 5 and len(chosen) == -(-len(stream) // E.GROUP)
    assert chosen[0] != chosen[-2] and lengths[chosen[0]][0] < lengths[chosen[-2]][0]
    assert [E.table_count(n) for n in (1, 199, 200, 599, 600, 1199, 1200, 2399, 2400)] == [2, 2, 3, 3, 4, 4, 5, 5, 6]


def test_threads_give_what_one_reader_gives():
    good = K.compress(noise(700_000, 11), 1)
    rnd = random.Random(12)
    places = [rnd.randrange(len(good)) for _ in range(12)]
    damaged = [good[:at] + bytes([good[at] ^ 16]) + good[at + 1 :] for at in places]
    for data in (good, good * 2 + K.compress(b"x", 9), b"", K.compress(b""), good + b"?", *damaged):
        results = []
        for read in (S.blocks, threads.blocks):
            out, error = [], None
            try:
                for b in read(data):
                    out.append((b["member"], b["block"], b["out"]))
            except BlockError as e:
                error = (e.code, e.member, e.block, e.bit)
            results.append((out, error))
        assert results[0] == results[1]
    raw = noise(300_000, 13)
    size = K.slice_size(1)
    assert b"".join(threads.encode((raw[i : i + size] for i in range(0, len(raw), size)), 1, 3)) == K.compress(raw, 1)


def test_flight_is_bounded():
    begun, taken = [], 0
    with threads.ThreadPoolExecutor(2) as pool:
        for x in threads.in_order(pool, lambda i: begun.append(i) or i, range(50), 4):
            taken += 1
            assert x == taken - 1 and len(begun) <= taken + 4


def test_cancelled_streams():
    d, e = StreamDecoder(), StreamEncoder()
    d.push(GOOD[:9])
    for machine in (d, e):
        machine.cancel()
        with pytest.raises(BlockError, match="INVALID_STATE"):
            machine.push(b"x")


def test_streams_in_state():
    import pandas as pd

    from blockloom.streaming.chunks import _Ordered

    rows = lambda *r: pd.DataFrame(r, columns=["seq", "bytes", "is_last"])
    o = _Ordered(StreamDecoder(), 2)
    assert list(o.feed(rows((1, GOOD[20:], True)))) == [] and [r[1] for r in o.feed(rows((0, GOOD[:20], False)))] == [b"This is a test\n"]
    assert o.machine is None and list(o.feed(rows((0, GOOD[:20], False)))) == [] and list(o.expire()) == []
    o = _Ordered(StreamDecoder(), 2)
    assert [r[2]["code"] for r in o.feed(rows(*[(k, b"", False) for k in (1, 2, 3)]))] == ["INVALID_STATE"]
    assert [r[2]["code"] for r in _Ordered(StreamDecoder(), 2).expire()] == ["UNEXPECTED_EOF"]
