"""Byte-level BPE by dynamic programming over prefixes.

For a valid vocabulary each prefix of a byte string has exactly one encoding, so its last
token is unique. `PrefixEncoder` stores that token for every prefix of a piece: the last token
of prefix i is the token t ending at i for which (last token of prefix i - len(t), t) is a pair
that BPE itself would leave apart. Appending bytes only adds entries, and an edit renews entries
only until they meet the old ones again. Pieces (the matches of the pre-tokenising pattern) are encoded once and
kept in a bounded cache.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blockloom.llm.bpe_arrays import Prefixes
from blockloom.llm.piecewise import PieceCache, no_collector
from blockloom.llm.words import slices

MOST_PAIRS = 1_000_000


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


class Vocabulary:
    """Ranks and what the prefix recursion asks of them."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.ranks = ranks
        self.tokens = {rank: token for token, rank in ranks.items()}
        self.longest = max(map(len, ranks))
        self.pairs: dict[tuple[int, int], bool] = {}
        self.alone: dict[int, bool] = {}

    def merges(self, data: bytes) -> list[int]:
        """Encoding by the definition: merge the lowest-ranked neighbours, leftmost first."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            best = min(range(len(parts) - 1), key=lambda i: self.ranks.get(parts[i] + parts[i + 1], 1 << 60))
            if parts[best] + parts[best + 1] not in self.ranks:
                break
            parts[best : best + 2] = [parts[best] + parts[best + 1]]
        return [self.ranks[p] for p in parts]

    def reachable(self, token: int) -> bool:
        known = self.alone.get(token)
        if known is None:
            known = self.alone[token] = self.merges(self.tokens[token]) == [token]
        return known

    def apart(self, left: int, right: int) -> bool:
        """Whether BPE, given these two tokens' bytes, ends with these two tokens."""
        key = (left, right)
        known = self.pairs.get(key)
        if known is None:
            if len(self.pairs) >= MOST_PAIRS:
                self.pairs.clear()
            known = self.pairs[key] = self.merges(self.tokens[left] + self.tokens[right]) == [left, right]
        return known


class PrefixEncoder:
    """Encoding of a growing byte string; last[i] is the last token of its first i + 1 bytes."""

    def __init__(self, vocabulary: Vocabulary, data: bytes = b"") -> None:
        self.v = vocabulary
        self.data = b""
        self.last: list[int] = []
        self.renewed = 0  # entries computed so far
        self.append(data)

    def _next(self) -> int:
        """The entry behind the last one; it depends on the `longest` entries and bytes before it alone."""
        v, last, data = self.v, self.last, self.data
        end = len(last) + 1
        for begin in range(max(0, end - v.longest), end):
            token = v.ranks.get(data[begin:end])
            if token is not None and v.reachable(token) and (begin == 0 or v.apart(last[begin - 1], token)):
                self.renewed += 1
                return token
        raise ValueError(f"byte {data[end - 1]} has no token")

    def append(self, more: bytes) -> None:
        self.data += more
        while len(self.last) < len(self.data):
            self.last.append(self._next())

    def edit(self, begin: int, end: int, new: bytes) -> None:
        """Replace bytes. Entries from `begin` on are computed again until, behind the new bytes, as many
        as the longest token has bytes are the old ones; from there on all are."""
        old, moved, settled, same = self.last, len(new) - (end - begin), begin + len(new), 0
        self.last = old[:begin]
        self.data = self.data[:begin] + new + self.data[end:]
        while len(self.last) < len(self.data) and same < self.v.longest:
            i, token = len(self.last), self._next()
            self.last.append(token)
            same = same + 1 if i >= settled and old[i - moved] == token else 0
        self.last += old[len(self.last) - moved :] if len(self.last) < len(self.data) else []

    def ids(self, length: int | None = None) -> list[int]:
        """Encoding of the first `length` bytes (all, if not given)."""
        at = len(self.data) if length is None else length
        out = []
        while at:
            out.append(self.last[at - 1])
            at -= len(self.v.tokens[out[-1]])
        return out[::-1]


LONG = 40  # bytes; longer pieces are encoded one at a time
LETTERS = [chr(c) for c in range(33, 0x250) if chr(c).isalpha()]  # those that pieces are mostly made of


class Encoder:
    """Texts to ids. A text is cut at single spaces, which go to the piece behind them. A piece
    that is empty or has white space at an end is not cut off from its neighbours, so that the
    pattern sees every run of white space whole."""

    def __init__(self, path: str, pattern: str) -> None:
        self.v = Vocabulary(load_ranks(path))
        self.many = Prefixes(self.v.ranks, MOST_PAIRS)
        self.pattern = regex.compile(pattern)
        most = max(self.v.tokens) + 1
        self.texts = pa.array([self.v.tokens.get(i, b"") for i in range(most)], pa.binary())
        self.numbers = pa.array([b"%d" % i for i in range(most)], pa.binary())
        # whether the pattern keeps a run of letters whole, with the space before it, and cuts a mark off its end
        self.plain = all(self.pattern.findall(f" a{x}") == [f" a{x}"] and self.pattern.findall(f" {x}a") == [f" {x}a"] for x in LETTERS)
        self.marks = frozenset(m for m in ".,;:!?" if all(self.pattern.findall(f" a{x}{m}") == [f" a{x}", m] for x in LETTERS))
        self.cache = PieceCache(lambda pieces: self._pieces(pieces, " "), most=300_000)
        self.first = PieceCache(lambda pieces: self._pieces(pieces, ""), most=50_000)

    def _joined(self, ids: np.ndarray, count: np.ndarray) -> tuple[list[bytes], list[bytes]]:
        """For runs of ids: the ids in decimal joined by commas, and the bytes that they stand for."""
        ends = pa.array(np.concatenate([[0], np.cumsum(count)]), pa.int32())
        at = pa.array(ids, pa.int64())
        join = lambda values, mark: pc.binary_join(pa.ListArray.from_arrays(ends, values.take(at)), mark).to_pylist()
        return join(self.numbers, b","), join(self.texts, b"")

    def _summaries(self, words: list[str]) -> dict[str, tuple[bytes, bytes]]:
        """`summary` of distinct matches of the pattern. A match that is a token as a whole stays whole."""
        out: dict[str, tuple[bytes, bytes]] = {}
        rest = []
        for word in sorted(words):
            data = word.encode()
            whole = self.v.ranks.get(data)
            if whole is not None:
                out[word] = self.summary([whole])
            elif len(data) > LONG:
                out[word] = self.summary(PrefixEncoder(self.v, data).ids())
            else:
                rest.append((word, data))
        for lo in range(0, len(rest), 1 << 15):
            some, data = zip(*rest[lo : lo + (1 << 15)], strict=True)
            out.update(zip(some, zip(*self._joined(*self.many.encode(data)), strict=True), strict=True))
        return out

    def _whole(self, text: str) -> tuple[bytes, bytes]:
        found = self.pattern.findall(text)
        known = self._summaries(list(set(found)))
        return b",".join([known[w][0] for w in found]), b"".join([known[w][1] for w in found])

    def _matches(self, before: str, p: str) -> tuple[str, ...] | list[str] | None:
        if not p or p[0].isspace() or p[-1].isspace():
            return None
        if self.plain and (p.isascii() or max(p) < "\u0250"):
            if p.isalpha():
                return (before + p,)
            if p[-1] in self.marks and p[:-1].isalpha():
                return before + p[:-1], p[-1]
        return self.pattern.findall(before + p)

    def _pieces(self, pieces: list[str], before: str) -> list[tuple[bytes, bytes] | bool]:
        split = [self._matches(before, p) for p in pieces]
        words = list({w for ws in split if ws for w in ws})
        text = self._summaries(words)
        return [
            False if ws is None else text[ws[0]] if len(ws) == 1
            else (b",".join([text[w][0] for w in ws]), b"".join([text[w][1] for w in ws]))
            for ws in split
        ]

    def summary(self, ids: list[int]) -> tuple[bytes, bytes]:
        """The ids in decimal joined by commas, and the bytes they stand for."""
        return b",".join([b"%d" % i for i in ids]), self.decode(ids)

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.v.tokens.__getitem__, ids))

    def parts(self, texts: list[str]) -> Iterator[list[tuple[bytes, bytes]]]:
        """For each text the summaries of its parts, in order."""
        cuts = [t.split(" ") for t in texts]
        values = self.cache.look_up([p for c in cuts for p in c[1:]])
        at = 0
        for cut, head in zip(cuts, self.first.look_up([c[0] for c in cuts]), strict=True):
            own = values[at : at + len(cut) - 1]
            at += len(cut) - 1
            yield self._irregular(cut, own) if head is False or False in own else [head, *own]

    def _irregular(self, cut: list[str], values: list) -> list[tuple[bytes, bytes]]:
        """Pieces around irregular white space are put together again before they are encoded."""
        out, rest = [], [cut[0]]
        for k, (piece, value) in enumerate(zip(cut[1:], values, strict=True)):
            closed = not rest or (rest[-1] != "" and not rest[-1][-1].isspace())
            if value is False or not closed:
                rest += [" ", piece]
                continue
            if rest:
                out.append(self._whole("".join(rest)))
                rest = []
            if k + 1 < len(values) and values[k + 1] is False:
                rest = [" ", piece]
            else:
                out.append(value)
        if rest:
            out.append(self._whole("".join(rest)))
        return out


_ENCODERS: dict[tuple[str, str], Encoder] = {}


def encoder(path: str, pattern: str) -> Encoder:
    if (path, pattern) not in _ENCODERS:
        _ENCODERS[path, pattern] = Encoder(path, pattern)
    return _ENCODERS[path, pattern]


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", digest: bool = False) -> DataFrame:
    """One row per document: doc_id, n_tokens, ids (array<int>), decoded (binary); with `digest`
    the SHA-256 of the ids in decimal, joined by commas, and of the decoded bytes instead.

    `path` has the ranks and `pattern` cuts a text in pieces that are encoded each on its own.
    A null text is empty and has no ids. Ids may be null or repeat; other columns are not
    read; an empty table gives an empty result.
    """
    source = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))

    def row(parts: list[tuple[bytes, bytes]]) -> tuple:
        ids = b",".join([p[0] for p in parts if p[0]])
        decoded = b"".join([p[1] for p in parts])
        number = ids.count(b",") + 1 if ids else 0
        if digest:
            return number, hashlib.sha256(ids).hexdigest(), hashlib.sha256(decoded).hexdigest()
        return number, np.array(ids.split(b","), np.int32) if number else np.zeros(0, np.int32), decoded

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(path, pattern)
        for batch in batches:
            rows = []
            for part in slices(batch, "text"):
                with no_collector():
                    rows += [row(parts) for parts in e.parts(part.column(1).to_pylist())]
            kinds = [pa.int64(), pa.string(), pa.string()] if digest else [pa.int64(), pa.list_(pa.int32()), pa.binary()]
            cols = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *cols], names)

    names = ["doc_id", "n_tokens", *(["ids_sha256", "decoded_sha256"] if digest else ["ids", "decoded"])]
    kinds = "ids_sha256 string, decoded_sha256 string" if digest else "ids array<int>, decoded binary"
    return source.mapInArrow(run, f"doc_id bigint, n_tokens bigint, {kinds}")


def op7_prefix_bpe(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers as P

    return encode(spark.read.parquet(f"{sf_dir}/documents.parquet"), P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN, digest=True)
