"""Repeated passages removed, with a count-min sketch in front of the exact grouping.

Documents are dealt into blocks by id and text. Each block makes a partial count-min sketch of its
windows: in every row of the sketch the cells that its windows fall in, with counts that stop at
two. A sketch is dealt out in shards by the window's hash, and partial sketches travel sparsely,
as sorted cells. A shard adds the blocks' partial sketches up and answers each with one bit a cell:
does the merged count reach two? A window is suspected if its cells in all rows do. Count-min never
counts too low, so no repeated window is lost. Only suspected windows are then grouped exactly: a
block sends each such sequence once, however often it holds it, and learns whether its first
occurrence anywhere lies in the block. So a passage that a third of all documents share costs one
entry a block, not one a document, and all that is sent grows in proportion to the input.

Word sequences are told apart by 128 bits: two hashes of independent constants for each word, which
never collide for words of one length of up to eight bytes, and a polynomial over each. Different
sequences are taken for equal with a probability of about n^2 / 2^129 among n suspected ones:
some 10^-13 for the 10^13 windows of 100 TB.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blockloom.llm import words as W
from blockloom.llm.common import width

U = np.uint64
SIZE = 20
BLOCK_BYTES = 4 << 20  # text in a block, about
TASK_BYTES = 64 << 20  # text in a task's blocks, about
SHARD_WINDOWS = 4_000_000  # windows in a shard, about
CELL_BITS = 25  # logarithm of the counters in each of a shard's rows
ROWS = 2
LARGE = (1 << 16) - 1
_LAST = np.iinfo(np.int64).max


class Block:
    """Words and windows of the documents of one block, in the order of their ids and then of a hash of
    their texts."""

    def __init__(self, rows: pa.Table, size: int) -> None:
        missing = rows.column("doc_id").is_null().to_numpy()
        ids = rows.column("doc_id").fill_null(_LAST).to_numpy()
        mark = rows.column("mark").to_numpy()
        order = np.lexsort((mark, missing, ids))
        self.missing, self.ids, self.mark = missing[order], ids[order], mark[order]
        self.raw, offsets = W.flat(rows.column("text").combine_chunks().take(pa.array(order)))
        self.starts, self.ends, self.first = W.spans(self.raw, offsets)
        self.count = np.diff(self.first)
        self.size = size
        hashes = W.word_names(self.raw, self.starts, self.ends, 0)
        n = len(hashes) - size + 1
        doc = np.repeat(np.arange(len(self.count)), self.count)
        self.doc = doc[: max(n, 0)]
        self.at = np.flatnonzero(self.doc == doc[size - 1 :]) if n > 0 else np.zeros(0, np.int64)
        self.window = W.window_hashes(hashes, size)[self.at]

    def second(self, picked: np.ndarray) -> np.ndarray:
        """64 more bits of hash for some of the windows."""
        return W.window_hashes(W.word_names(self.raw, self.starts, self.ends, 1), self.size)[self.at[picked]]

    def sketched(self, shards: int, row: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """One row of the partial sketch: sorted cells as (shard << CELL_BITS | cell), which of them are
        hit more than once, and the place of each window's cell among them."""
        cell = W.mix(self.window + U(0x9E3779B97F4A7C15 * (row + 1) & (2**64 - 1))) >> U(64 - CELL_BITS)
        key = _shard(self.window, shards) << U(CELL_BITS) | cell
        cells, place, times = np.unique(key, return_inverse=True, return_counts=True)
        return cells, times > 1, place


def _shard(window: np.ndarray, shards: int) -> np.ndarray:
    return (window >> U(32)) % U(shards)


def _parts(keys: np.ndarray, shards: int, bits: int) -> np.ndarray:
    """Where each shard begins in sorted keys."""
    return np.searchsorted(keys, np.arange(shards + 1, dtype=np.uint64) << U(bits))


def _steps(cells: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted cells as steps of 16 bits; steps that are larger come in a list of their own."""
    step = np.diff(cells, prepend=U(0))
    wide = step >= LARGE
    return np.where(wide, LARGE, step).astype("<u2"), step[wide].astype("<u4")


def _cells(steps: np.ndarray, wide: np.ndarray) -> np.ndarray:
    step = steps.astype(np.int64)
    step[steps == LARGE] = wide
    return np.cumsum(step)


_PARTIAL = "shard bigint, block bigint, row int, steps binary, wide binary, twice binary"


def _partial_sketches(shards: int, size: int):
    def run(table: pa.Table) -> pa.Table:
        block, number = Block(table, size), table.column("block")[0].as_py()
        out: list[tuple] = []
        for row in range(ROWS):
            cells, twice, _ = block.sketched(shards, row)
            at = _parts(cells, shards, CELL_BITS)
            for s in np.flatnonzero(np.diff(at)).tolist():
                own = slice(at[s], at[s + 1])
                steps, wide = _steps(cells[own] & U((1 << CELL_BITS) - 1))
                out.append((s, number, row, steps.tobytes(), wide.tobytes(), np.packbits(twice[own]).tobytes()))
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]
        names = [x.split()[0] for x in _PARTIAL.split(", ")]
        return pa.table([pa.array(c, k) for c, k in zip(zip(*out, strict=True) if out else [[]] * 6, kinds, strict=True)], names)

    return run


class Sketch:
    """One row of a count-min sketch with counters that stop at 2."""

    def __init__(self) -> None:
        self.counts = np.zeros(1 << CELL_BITS, np.uint8)

    def add(self, cells: np.ndarray, twice: np.ndarray) -> None:
        """Merge a partial sketch: distinct cells, and which of them count two."""
        self.counts[cells] = np.minimum(self.counts[cells] + 1 + twice, 2)

    def repeated(self, cells: np.ndarray) -> np.ndarray:
        return self.counts[cells] >= 2


def _bits(packed: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(packed, np.uint8), count=n).astype(bool)


def _merge_sketches(table: pa.Table) -> pa.Table:
    """All blocks' partial sketches of one row of one shard: add up, then answer each block in the order
    of its cells."""
    sketch = Sketch()
    read = lambda i: _cells(np.frombuffer(table.column("steps")[i].as_buffer(), "<u2"), np.frombuffer(table.column("wide")[i].as_buffer(), "<u4"))
    for i in range(table.num_rows):
        cells = read(i)
        sketch.add(cells, _bits(table.column("twice")[i].as_py(), len(cells)))
    said = [np.packbits(sketch.repeated(read(i))).tobytes() for i in range(table.num_rows)]
    return pa.table({"block": table.column("block"), "kind": table.column("row"), "shard": table.column("shard"), "said": pa.array(said, pa.binary())})


def _answers(said: pa.Table, kind: int, at: np.ndarray) -> np.ndarray:
    """The bits that the shards sent back, in the order of what was asked; `at` is where each shard begins."""
    out = np.zeros(at[-1], bool)
    mine = said.filter(pa.compute.equal(said.column("kind"), kind))
    for shard, packed in zip(mine.column("shard").to_pylist(), mine.column("said"), strict=True):
        out[at[shard] : at[shard + 1]] = _bits(packed.as_py(), at[shard + 1] - at[shard])
    return out


class Suspects:
    """Windows of a block that the sketch calls repeated, and their distinct sequences."""

    def __init__(self, block: Block, said: pa.Table, shards: int) -> None:
        repeated = np.ones(len(block.window), bool)
        for row in range(ROWS):
            cells, _, place = block.sketched(shards, row)
            repeated &= _answers(said, row, _parts(cells, shards, CELL_BITS))[place]
        self.picked = np.flatnonzero(repeated)
        h1, h2 = block.window[self.picked], block.second(self.picked)
        shard = _shard(h1, shards)
        order = np.lexsort((np.arange(len(h1)), h2, h1, shard))  # ties keep the order of documents and starts
        s1, s2 = h1[order], h2[order]
        fresh = np.r_[True, (s1[1:] != s1[:-1]) | (s2[1:] != s2[:-1])] if len(order) else np.zeros(0, bool)
        self.lead = order[fresh]  # first window of each sequence
        self.sequence = np.empty(len(order), np.int64)
        self.sequence[order] = np.cumsum(fresh) - 1
        self.h1, self.h2 = h1[self.lead], h2[self.lead]
        self.owner = block.doc[block.at[self.picked[self.lead]]]
        self.parts = np.searchsorted(shard[self.lead], np.arange(shards + 1, dtype=np.uint64))


_SEQUENCES = "shard bigint, block bigint, h1 binary, h2 binary, owner binary, ids binary, marks binary"


def _send_sequences(shards: int, size: int):
    names = [x.split()[0] for x in _SEQUENCES.split(", ")]
    kinds = [pa.int64(), pa.int64(), *[pa.binary()] * 5]

    def run(docs: pa.Table, said: pa.Table) -> pa.Table:
        if not docs.num_rows or not said.num_rows:
            return pa.table([pa.array([], k) for k in kinds], names)
        block = Block(docs, size)
        s = Suspects(block, said, shards)
        some = np.flatnonzero(np.diff(s.parts)).tolist()
        parts = [slice(s.parts[i], s.parts[i + 1]) for i in some]
        own = [np.unique(s.owner[p], return_inverse=True) for p in parts]
        cols = [
            some, [docs.column("block")[0].as_py()] * len(some),
            [s.h1[p].astype("<u8").tobytes() for p in parts], [s.h2[p].astype("<u8").tobytes() for p in parts],
            [place.astype("<u4").tobytes() for _, place in own],
            [block.ids[d].astype("<i8").tobytes() for d, _ in own], [block.mark[d].astype("<i8").tobytes() for d, _ in own],
        ]
        return pa.table([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names)

    return run


def _find_first(table: pa.Table) -> pa.Table:
    """All blocks' sequences of one shard: tell each block which of them begin with it."""
    read = lambda name, kind: [np.frombuffer(x.as_buffer(), kind) for x in table.column(name)]
    h1s, h2s, owners, ids, marks = read("h1", "<u8"), read("h2", "<u8"), read("owner", "<u4"), read("ids", "<i8"), read("marks", "<i8")
    h1, h2 = np.concatenate(h1s), np.concatenate(h2s)
    doc, mark = (np.concatenate([i[o] for i, o in zip(v, owners, strict=True)]) for v in (ids, marks))
    order = np.lexsort((mark, doc, h2, h1))
    a, b = h1[order], h2[order]
    first = np.zeros(len(h1), bool)
    first[order[np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])]]] = True
    ends = np.cumsum([0, *[len(x) for x in h1s]])
    said = [np.packbits(first[i:j]).tobytes() for i, j in zip(ends, ends[1:], strict=False)]
    return pa.table({"block": table.column("block"), "kind": pa.array([ROWS] * len(said), pa.int32()), "shard": table.column("shard"), "said": pa.array(said, pa.binary())})


def _cut_out(shards: int, size: int):
    def run(docs: pa.Table, said: pa.Table) -> pa.Table:
        names = ["doc_id", "n_words", "n_removed", "kept_text"]
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string()]
        if not docs.num_rows:
            return pa.table({n: pa.array([], k) for n, k in zip(names, kinds, strict=True)})
        block = Block(docs, size)
        gone = np.zeros(len(block.starts) + 1, np.int64)
        if said.num_rows:
            s = Suspects(block, said, shards)
            stays = np.zeros(len(s.picked), bool)
            stays[s.lead] = _answers(said, ROWS, s.parts)
            start = block.at[s.picked[~stays]]
            gone[start] += 1
            np.subtract.at(gone, np.minimum(start + size, len(gone) - 1), 1)
        keep = np.cumsum(gone[:-1]) == 0
        doc = np.repeat(np.arange(len(block.count)), block.count)
        left = np.bincount(doc[keep], minlength=len(block.count))
        out, begin, end = W.single_spaced(block.raw, block.starts[keep], block.ends[keep])
        ends = np.cumsum(left)
        data = out.tobytes()
        texts = [data[begin[e - n] : end[e - 1]].decode() if n else "" for n, e in zip(left.tolist(), ends.tolist(), strict=True)]
        ids = pa.array(block.ids, pa.int64(), mask=block.missing)
        return pa.table([ids, pa.array(block.count, pa.int64()), pa.array(block.count - left, pa.int64()), pa.array(texts, pa.string())], names)

    return run


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE, block_bytes: int = BLOCK_BYTES, shard_windows: int = SHARD_WINDOWS) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept_text (kept words, one space between).

    A window is `size` consecutive words (split at ASCII white space). A word goes if some window
    over it has the same words as a window that starts earlier, in a document of smaller id or
    earlier in the same one. Null texts have no words. Null ids come after all others; rows that
    share an id come in the order of a hash of their texts, equal rows one behind the other. An
    empty table gives an empty result; other columns are not read.
    """
    spark = docs.sparkSession
    text = F.col(text_col).cast("string")
    source = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), text.cast("binary").alias("text"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("mark"))
    total = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    blocks = max(width(spark), total // block_bytes + 1)
    tasks = max(width(spark), total // TASK_BYTES + 1)
    shards = int(max(1, total // 6 // shard_windows + 1))
    # rows without an id, or with one and the same, are dealt out by their texts
    dealt = source.withColumn("block", F.pmod(F.xxhash64("doc_id", "mark"), F.lit(blocks))).repartition(tasks, "block")
    partial = dealt.groupBy("block").applyInArrow(_partial_sketches(shards, size), _PARTIAL)
    said = "block bigint, kind int, shard bigint, said binary"
    spread = max(width(spark), min(ROWS * shards, tasks))
    suspected = partial.repartition(spread, "shard", "row").groupBy("shard", "row").applyInArrow(_merge_sketches, said)
    sequences = dealt.groupBy("block").cogroup(suspected.groupBy("block")).applyInArrow(_send_sequences(shards, size), _SEQUENCES)
    firsts = sequences.repartition(spread, "shard").groupBy("shard").applyInArrow(_find_first, said)
    both = suspected.unionByName(firsts)
    return dealt.groupBy("block").cogroup(both.groupBy("block")).applyInArrow(_cut_out(shards, size), "doc_id bigint, n_words bigint, n_removed bigint, kept_text string")


def op3_substring_dedup(spark, sf_dir: str) -> DataFrame:
    out = remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


ORACLE = r"""
WITH l AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
w AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS pos FROM l),
k AS (SELECT doc_id, pos, count(*) OVER f AS n, string_agg(word, ' ') OVER f AS key FROM w
  WINDOW f AS (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND 19 FOLLOWING)),
r AS (SELECT doc_id, pos FROM k WHERE n = 20 QUALIFY row_number() OVER (PARTITION BY key ORDER BY doc_id, pos) > 1),
g AS (SELECT DISTINCT doc_id, unnest(range(pos, pos + 20)) AS pos FROM r),
s AS (SELECT w.doc_id, string_agg(w.word, ' ' ORDER BY w.pos) AS kept, count(*) AS n FROM w ANTI JOIN g ON w.doc_id = g.doc_id AND w.pos = g.pos GROUP BY 1)
SELECT l.doc_id, len(ws)::BIGINT AS n_words, (len(ws) - coalesce(s.n, 0))::BIGINT AS n_removed, sha256(coalesce(s.kept, '')) AS kept_sha256
FROM l LEFT JOIN s ON l.doc_id = s.doc_id
"""
