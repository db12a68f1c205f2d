"""Cost-balanced packing of whole documents into training sequences.

A piece of n tokens costs LINEAR * n + QUADRATIC * n^2 (feed-forward and attention inside the
document). In each window of documents the pieces, longest first, go to the cheapest sequence
that still has room; what fits nowhere whole is cut to fill the rooms that are left, so every
sequence is full. The few tokens beyond the last full sequence wait for the next window, and
the end of a partition goes to sequences of power-of-two lengths, which need no padding.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blockloom.llm.bpe_arrays import Merges, byte_matrix
from blockloom.llm.piecewise import PieceCache, no_collector
from blockloom.llm.words import slices

CAPACITY = 4096
WINDOW = 1 << 21  # tokens that are packed together
LINEAR, QUADRATIC = 1.0, 1.0 / 2048
END = 2


def assign(lengths: np.ndarray, rooms: np.ndarray, linear: float = LINEAR, quadratic: float = QUADRATIC) -> tuple[list[tuple[int, int, int, int]], list[tuple[int, int, int]]]:
    """Deal pieces out to sequences with the given rooms. Returns placements (piece, from, length,
    sequence) in the order in which they are laid down, and what is left over (piece, from, length)."""
    rooms = rooms.copy()
    cost = np.zeros(len(rooms))
    placed, homeless = [], []
    for i in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[i])
        if not n:
            continue
        fits = rooms >= n
        if fits.any():
            s = int(np.argmin(np.where(fits, cost, np.inf)))
            placed.append((i, 0, n, s))
            rooms[s] -= n
            cost[s] += linear * n + quadratic * n * n
        else:
            homeless.append((i, 0, n))
    for s in np.lexsort((np.arange(len(rooms)), cost)).tolist():
        while rooms[s] and homeless:
            i, at, n = homeless.pop()
            cut = min(n, int(rooms[s]))
            placed.append((i, at, cut, s))
            rooms[s] -= cut
            if cut < n:
                homeless.append((i, at + cut, n - cut))
    return placed, homeless


class Packer:
    """Packs a stream of (doc_id, token bytes); `rows` yields the pieces of finished windows."""

    def __init__(self, capacity: int, window: int, first_sequence: int) -> None:
        self.capacity, self.window, self.sequence = capacity, max(window, capacity), first_sequence
        self.docs: list[tuple] = []  # doc_id, ids as bytes, tokens of the document, start, length
        self.held = 0

    def add(self, doc_id: int | None, ids: bytes) -> Iterator[tuple]:
        total = len(ids) // 4
        if total:
            self.docs.append((doc_id, ids, total, 0, total))
            self.held += total
        if self.held >= self.window:
            yield from self._flush(np.full(self.held // self.capacity, self.capacity))

    def end(self) -> Iterator[tuple]:
        if self.held >= self.capacity:
            yield from self._flush(np.full(self.held // self.capacity, self.capacity))
        rest = [1 << b for b in range(self.held.bit_length() - 1, -1, -1) if self.held >> b & 1]
        if rest:
            yield from self._flush(np.array(rest))

    def _flush(self, rooms: np.ndarray) -> Iterator[tuple]:
        docs, full = self.docs, self.capacity
        pieces = []  # document, start, length; whole sequences' worth of long documents go first
        for d, (_, _, _, start, length) in enumerate(docs):
            while length > full:
                pieces.append((d, start, full))
                start, length = start + full, length - full
            pieces.append((d, start, length))
        placed, left = assign(np.array([p[2] for p in pieces]), rooms)
        offsets = [0] * len(rooms)
        for i, at, n, s in placed:
            d, start, _ = pieces[i]
            doc_id, ids, total, _, _ = docs[d]
            a = start + at
            yield doc_id, a, n, zlib.crc32(memoryview(ids)[4 * a : 4 * (a + n)]), total, self.sequence + s, offsets[s]
            offsets[s] += n
        self.sequence += len(rooms)
        self.docs = [(*docs[pieces[i][0]][:3], pieces[i][1] + at, n) for i, at, n in left]
        self.held = sum(x[4] for x in self.docs)


_CACHES: dict[str, PieceCache] = {}
LONG = 64  # bytes; longer words go to the library
ROWS = 4096  # words that are encoded side by side


def _latin(text: str) -> bool:
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


class WordTokenizer:
    """Encodes pieces as the tokenizer file says. Pieces of Latin-1 characters, which the file's
    normaliser only lower-cases, are encoded side by side; all others, and pieces with the string of an
    added token, which the library makes that token, go to the library."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        added = spec.get("added_tokens") or []
        if any(a[k] for a in added for k in ("single_word", "lstrip", "rstrip", "normalized")) or any(a["content"][:-1].isalpha() or " " in a["content"] for a in added):
            raise ValueError("added tokens that reach beyond a piece are not supported")
        self.added = [a["content"] for a in added]  # a piece that holds one goes to the library
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in merges]
        self.suffix = spec["model"].get("end_of_word_suffix") or ""
        self.merges = Merges(*(np.array(x, np.int64) for x in zip(*((vocab[a], vocab[b], vocab[a + b]) for a, b in merges), strict=True)))
        # the byte alphabet: printable Latin-1 stands for itself, the rest is moved behind U+0100
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        moved = iter(range(256, 512))
        letters = [chr(b) if b in plain else chr(next(moved)) for b in range(256)]
        self.inner = np.array([vocab[c] for c in letters], np.int32)
        self.final = np.array([vocab[c + self.suffix] for c in letters], np.int32)
        steps = spec["pre_tokenizer"]["pretokenizers"]
        self.pattern = regex.compile(next(x["pattern"]["Regex"] for x in steps if x["type"] == "Split"))

    def words(self, words: list[str]) -> dict[str, bytes]:
        """Ids of distinct lower-case words."""
        out: dict[str, bytes] = {}
        coded = list(map(str.encode, words))
        order = np.argsort(np.fromiter(map(len, coded), np.int64, len(coded)), kind="stable").tolist()
        for lo in range(0, len(order), ROWS):
            some = order[lo : lo + ROWS]
            matrix, length = byte_matrix([coded[i] for i in some])
            cols = np.arange(matrix.shape[1])
            ids = np.where(cols < length[:, None] - 1, self.inner[matrix], np.where(cols == length[:, None] - 1, self.final[matrix], -1))
            ids = self.merges.encode(ids.astype(np.int32))
            count = (ids >= 0).sum(1)
            data = ids[cols < count[:, None]].astype("<u4").tobytes()
            ends = (4 * np.cumsum(count)).tolist()
            out.update(zip([words[i] for i in some], [data[a:b] for a, b in zip([0, *ends], ends, strict=False)], strict=True))
        return out

    def split(self, pieces: list[str]) -> list[Sequence[str] | None]:
        """Lower-case words of each piece, None if it is one for the library. Pieces hold no spaces, so that all can
        be looked at and lower-cased as one text."""
        whole = " ".join(pieces)
        good = [len(p) < LONG // 2 for p in pieces]
        if not _latin(whole):
            good = [g and _latin(p) for g, p in zip(good, pieces, strict=True)]
        if any(a in whole for a in self.added):
            good = [g and not any(a in p for a in self.added) for g, p in zip(good, pieces, strict=True)]
        if not any(good):
            return [None] * len(pieces)
        low = iter(" ".join([p for g, p in zip(good, pieces, strict=True) if g]).lower().split(" "))
        return [self._split(next(low)) if g else None for g in good]

    def _split(self, low: str) -> Sequence[str]:
        if low.isalpha():
            return (low,)
        if low[:-1].isalpha() and low[-1] in ".,;:!?":
            return low[:-1], low[-1]
        return self.pattern.findall(low)

    def __call__(self, pieces: list[str]) -> list[bytes]:
        split = self.split(pieces)
        words = self.words(list({w for ws in split if ws for w in ws}))
        out = [b"" if ws is None else words[ws[0]] if len(ws) == 1 else b"".join([words[w] for w in ws]) for ws in split]
        other = [i for i, ws in enumerate(split) if ws is None]
        for i, e in zip(other, self.library.encode_batch([pieces[i] for i in other], add_special_tokens=False), strict=True):
            out[i] = np.array(e.ids, "<u4").tobytes()
        return out


def token_cache(path: str) -> PieceCache:
    """Cache over a tokenizer file whose pre-tokenizer never joins text across a space or a line's end."""
    if path not in _CACHES:
        _CACHES[path] = PieceCache(WordTokenizer(path))
    return _CACHES[path]


def token_bytes(texts: pa.Array, cache: PieceCache, end: int | None = END) -> list[bytes]:
    """Ids of each text (none null) as little-endian 32-bit numbers. A line's end counts as a space, so that
    the last word of a line and the first of the next are no piece of their own. Each distinct
    piece is looked up once; its ids are laid down in all its places together."""
    cuts = pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ")
    coded = cuts.flatten().dictionary_encode()
    ids = cache.look_up(coded.dictionary.to_numpy(zero_copy_only=False).tolist())
    at = coded.indices.to_numpy()
    size = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
    start = np.cumsum(size) - size
    ends = np.concatenate([[0], np.cumsum(size[at])])  # where the ids of each piece begin and end
    places = np.repeat(start[at] - ends[:-1], size[at]) + np.arange(ends[-1])
    data = np.frombuffer(b"".join(ids), "<u4")[places].tobytes()
    tail = b"" if end is None else np.array([end], "<u4").tobytes()
    bounds = (4 * ends[cuts.offsets.to_numpy()]).tolist()
    return [data[a:b] + tail for a, b in zip(bounds, bounds[1:], strict=False)]


_SCHEMA = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"
_NAMES = [x.split()[0] for x in _SCHEMA.split(", ")]


def pack(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, window: int = WINDOW, end: int | None = END) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Each partition is packed on its own, in windows of bounded size, without a shuffle; sequence
    ids carry the partition's number and so never meet. A null text is empty and has the end
    token only; a null id is carried along; repeated rows are packed each on its own. Texts
    without tokens (only if there is no end token) have no piece. Other columns are not read.
    """
    source = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = token_cache(tokenizer)
        packer = Packer(capacity, window, TaskContext.get().partitionId() << 40)
        rows: list[tuple] = []

        def out() -> pa.RecordBatch:
            cols = list(zip(*rows, strict=True)) or [[]] * len(_NAMES)
            rows.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], _NAMES)

        for batch in batches:
            for part in slices(batch, "text"):
                with no_collector():
                    tokens = token_bytes(part.column(1), cache, end)
                for doc_id, ids in zip(part.column(0).to_pylist(), tokens, strict=True):
                    rows.extend(packer.add(doc_id, ids))
                    if len(rows) >= 20_000:
                        yield out()
        rows.extend(packer.end())
        yield out()

    return source.mapInArrow(run, _SCHEMA)


def op5_packing(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("word_bpe_49k.json"))
