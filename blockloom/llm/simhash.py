"""SimHash near-duplicates found by Golay-code fuzzy hashing.

A 64-bit fingerprint is cut into three segments of 22, 21 and 21 bits, each padded to a
23-bit word of the perfect binary Golay code. Two fingerprints that differ in at most two
bits agree in at least one whole segment, and their words in any other segment lie within
two bits, so some word lies within one bit of both: decoding every word in a radius of one
gives each fingerprint one to six codeword indices, and two such fingerprints share one.
The key of a bucket is the number of the equal segment, its bits, and an index of the next
segment. Candidates are verified inside their bucket, and only links that connect it leave.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blockloom.llm import words as W
from blockloom.llm.common import cut, unused, width
from blockloom.llm.graph import components

U = np.uint64
GENERATOR = 0b101011100011  # x^11 + x^9 + x^7 + x^6 + x^5 + x + 1, of the (23, 12) code
SEGMENTS = ((0, 22), (22, 21), (43, 21))  # first bit and number of bits
LINK = 2  # differing bits of a link
SMALL = 8  # buckets up to here are compared pair by pair


def _syndromes(words: np.ndarray) -> np.ndarray:
    out = words.copy()
    for bit in range(22, 10, -1):
        out = np.where((out >> bit) & 1, out ^ (GENERATOR << (bit - 11)), out)
    return out


def _errors() -> np.ndarray:
    """The error pattern of up to three bits for each of the 2048 syndromes."""
    ones = [1 << i for i in range(23)]
    all_ = [0, *ones, *(ones[i] | ones[j] for i in range(23) for j in range(i)), *(ones[i] | ones[j] | ones[k] for i in range(23) for j in range(i) for k in range(j))]
    patterns = np.array(all_, np.int64)
    out = np.zeros(2048, np.int64)
    out[_syndromes(patterns)] = patterns
    return out


_TABLE: list[np.ndarray] = []


def decode(words: np.ndarray) -> np.ndarray:
    """Index (12 bits) of the codeword nearest to each 23-bit word."""
    if not _TABLE:
        every = np.arange(1 << 12, dtype=np.int64)
        _TABLE.extend([_syndromes(every), _syndromes(every << 11 & 0x7FFFFF), _errors()])
    syndrome = _TABLE[0][words & 0x7FF] ^ _TABLE[1][words >> 11]
    return (words ^ _TABLE[2][syndrome]) >> 11


def bucket_keys(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(key, row) for each of the three equal segments and each fuzzy index of the next one."""
    keys, rows = [], []
    n = len(prints)
    for i, (at, bits) in enumerate(SEGMENTS):
        exact = (prints >> U(at)) & U((1 << bits) - 1)
        to, wide = SEGMENTS[(i + 1) % 3]
        word = ((prints >> U(to)) & U((1 << wide) - 1)).astype(np.int64)
        ball = np.concatenate([word[None], word[None] ^ (1 << np.arange(wide, dtype=np.int64))[:, None]])
        index = np.sort(decode(ball), axis=0)
        fresh = np.ones_like(index, bool)
        fresh[1:] = index[1:] != index[:-1]
        where = np.nonzero(fresh)
        keys.append((U(i) << U(34)) | (exact[where[1]] << U(12)) | index[where].astype(np.uint64))
        rows.append(np.arange(n)[where[1]])
    return np.concatenate(keys), np.concatenate(rows)


def _prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in W.slices(batch, "text"):
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(fingerprints(part.column("text")).view(np.int64))], ["doc_id", "print"])


def fingerprints(texts: pa.Array, shingle: int = 3) -> np.ndarray:
    """SimHash of each text (see `near_classes`)."""
    raw, offsets = W.flat(texts)
    raw = W.lower_ascii(raw)
    starts, ends, first = W.spans(raw, offsets)
    raw, starts, ends = W.single_spaced(raw, starts, ends)
    count = np.diff(first)
    shingles = np.where(count >= shingle, count - shingle + 1, np.minimum(count, 1))
    begin = np.zeros(len(count) + 1, np.int64)
    np.cumsum(shingles, out=begin[1:])
    doc = np.repeat(np.arange(len(count)), shingles)
    at = first[:-1][doc] + np.arange(begin[-1]) - begin[:-1][doc]
    last = np.minimum(at + shingle, first[1:][doc]) - 1
    hashes = W.xxh64(raw, starts[at], ends[last]) if len(at) else np.zeros(0, np.uint64)
    sums = np.zeros((len(count), 64), np.int64)
    for lo in range(0, len(hashes), 1 << 18):
        part = hashes[lo : lo + (1 << 18)]
        own = doc[lo : lo + (1 << 18)]
        edges = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
        bits = np.unpackbits(part.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        sums[own[edges]] += np.add.reduceat(bits, edges, axis=0, dtype=np.int32)
    ones = (2 * sums > shingles[:, None]).astype(np.uint8)
    return np.packbits(ones, axis=1, bitorder="little").view("<u8").reshape(-1).astype(np.uint64)


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        prints = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
        if len(prints):
            keys, rows = bucket_keys(prints)
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(prints[rows].view(np.int64))], ["key", "print"])


def linked(group: np.ndarray, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect, inside each bucket, all fingerprints that a chain of true links
    connects. `group` is sorted. Small buckets are compared pair by pair. In others each
    fingerprint meets its neighbours at the words one bit away from both, so the work grows
    with the bucket and not with its square, and each leaves one link to its class."""
    edge = np.flatnonzero(np.r_[True, group[1:] != group[:-1], True])
    size = np.repeat(np.diff(edge), np.diff(edge))
    left, right = [], []
    for shift in range(1, SMALL):
        i = np.flatnonzero((group[:-shift] == group[shift:]) & (size[:-shift] <= SMALL)) if len(group) > shift else np.zeros(0, int)
        close = np.bitwise_count(prints[i] ^ prints[i + shift]) <= LINK
        left.append(prints[i[close]])
        right.append(prints[i[close] + shift])
    big = np.flatnonzero(size > SMALL)
    if len(big):
        flips = np.r_[U(0), U(1) << np.arange(64, dtype=np.uint64)]
        own = np.repeat(np.arange(len(big)), 65)
        meet = (prints[big][:, None] ^ flips[None]).reshape(-1)
        order = np.lexsort((meet, group[big][own]))
        own, meet, g = own[order], meet[order], group[big][own[order]]
        run = np.flatnonzero(np.r_[True, (meet[1:] != meet[:-1]) | (g[1:] != g[:-1])])
        lone = np.diff(np.r_[run, len(meet)]) == 1
        keep = np.repeat(~lone, np.diff(np.r_[run, len(meet)]))
        own, run_of = own[keep], np.repeat(np.arange(len(run)), np.diff(np.r_[run, len(meet)]))[keep]
        run = np.flatnonzero(np.r_[True, run_of[1:] != run_of[:-1]]) if len(own) else np.zeros(0, int)
        label = np.arange(len(big))
        while len(own):
            low = np.minimum.reduceat(label[own], run)
            new = label.copy()
            np.minimum.at(new, own, np.repeat(low, np.diff(np.r_[run, len(own)])))
            new = new[new]
            if (new == label).all():
                break
            label = new
        moved = np.flatnonzero(label != np.arange(len(big)))
        left.append(prints[big[moved]])
        right.append(prints[big[label[moved]]])
    return np.concatenate(left) if left else prints[:0], np.concatenate(right) if right else prints[:0]


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by bucket; the last bucket of a batch waits for the next batch."""
    keys, prints = np.zeros(0, np.int64), np.zeros(0, np.uint64)

    def out(k: np.ndarray, p: np.ndarray) -> pa.RecordBatch:
        a, b = linked(k, p)
        return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

    waiting: list[tuple[np.ndarray, np.ndarray]] = []
    for batch in batches:
        keys = batch.column(0).to_numpy(zero_copy_only=False)
        prints = batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64)
        if not len(keys):
            continue
        end = int(np.searchsorted(keys, keys[-1], "left"))
        if waiting and (end or waiting[0][0][0] != keys[0]):
            same = int(np.searchsorted(keys, waiting[0][0][0], "right")) if waiting[0][0][0] == keys[0] else 0
            waiting.append((keys[:same], prints[:same]))
            yield out(np.concatenate([k for k, _ in waiting]), np.concatenate([p for _, p in waiting]))
            waiting = []
            keys, prints, end = keys[same:], prints[same:], end - same
        if end > 0:
            yield out(keys[:end], prints[:end])
        waiting.append((keys[max(end, 0) :], prints[max(end, 0) :]))
    if waiting:
        yield out(np.concatenate([k for k, _ in waiting]), np.concatenate([p for _, p in waiting]))


def print_classes(prints: DataFrame) -> DataFrame:
    """(print, root) for each fingerprint that links to another. `prints` has one bigint column
    of distinct fingerprints."""
    n = width(prints.sparkSession)
    keyed = prints.mapInArrow(_keyed, "key bigint, print bigint")
    links = keyed.repartition(n, "key").sortWithinPartitions("key").mapInArrow(_links, "a bigint, b bigint").distinct()
    return components(links).select(F.col("node").alias("print"), "root")


def near_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, print (bigint), component_id.

    Texts are lower-cased (A-Z) and cut into words at ASCII white space; the features are the
    runs of three words, repeats included, or all words if there are fewer. A bit is 1 if it is
    set in more than half of the features' XXH64. Documents link when their fingerprints differ
    in at most two bits; component_id is the smallest id that can be reached. Null and blank
    texts have the fingerprint zero, linked like any other. A null id takes part but never names
    a component unless all its ids are null. Repeated rows give repeated rows; other columns are
    not read; an empty table gives an empty result.
    """
    source = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    marked = cut(source.mapInArrow(_prints, "doc_id bigint, print bigint"))
    least = marked.groupBy("print").agg(F.min("doc_id").alias("least"))
    roots = print_classes(least.select("print"))
    named = least.join(roots, "print", "left").withColumn("root", F.coalesce("root", "print"))
    lowest = named.groupBy("root").agg(F.min("least").alias("component_id"))
    names = named.join(lowest, "root").select("print", "component_id")
    return marked.join(names, "print").select("doc_id", "print", "component_id")


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `docs` whose id names their component, all columns; where ids repeat, one row each. Columns
    may have any names; an empty table gives an empty result."""
    spare = unused(docs, "key")
    key = lambda i: F.coalesce(i.cast("bigint").cast("string"), F.lit(""))
    kept = near_classes(docs, id_col, text_col).where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(key(F.col("doc_id")).alias(spare))
    return docs.withColumn(spare, key(F.col(id_col))).join(kept, spare, "left_semi").dropDuplicates([spare]).drop(spare)


def op10_simhash(spark, sf_dir: str) -> DataFrame:
    out = near_classes(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", F.lpad(F.lower(F.hex("print")), 16, "0").alias("fingerprint"), "component_id")
