"""Exact deduplication by composable polynomial fingerprints.

The fingerprint of a byte string b_0 .. b_{n-1} is sum(b_i * R^(n-1-i)) mod P for two primes
P. It composes: fp(x + y) = fp(x) * R^len(y) + fp(y), so the chunks of a huge document are
hashed on their own, in any order and on any machine, and joined by `combine`. Documents
with equal length and fingerprints are then compared chunk by chunk with the document that
would stay; those that differ after all (a collision) form classes of their own.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blockloom.llm.common import cut, keep, unused, width
from blockloom.llm.words import slices

PRIMES = (2_147_483_647, 2_147_483_629)
BASES = (1_103_515_245, 1_664_525)
CHUNK = 1 << 14  # bytes hashed at once; 255 * 2^31 * 2^14 fits in 64 bits
COMPARED = 1 << 18  # bytes compared at once
LONG = 4 << 20  # bytes; longer texts are hashed in chunks of this size, in tasks of their own
LARGE = 256  # rows from which a class is dealt out in parts
SALTS = 16  # parts in which one class of copies is dealt out


def _powers(base: int, prime: int, n: int) -> np.ndarray:
    out = np.empty(n, np.int64)
    x = 1
    for i in range(n - 1, -1, -1):
        out[i] = x
        x = x * base % prime
    return out


_TABLES: dict[tuple[int, int], np.ndarray] = {}


def chunk_hash(chunk: bytes, which: int, primes: tuple[int, ...] = PRIMES) -> int:
    """Polynomial hash of at most CHUNK bytes."""
    key = (primes[which], BASES[which])
    if key not in _TABLES:
        _TABLES[key] = _powers(key[1] % key[0], key[0], CHUNK)
    data = np.frombuffer(chunk, np.uint8).astype(np.int64)
    return int(data @ _TABLES[key][CHUNK - len(data) :]) % key[0]


def combine(left: int, right: int, right_length: int, which: int, primes: tuple[int, ...] = PRIMES) -> int:
    """Fingerprint of the text whose halves have these fingerprints."""
    return (left * pow(BASES[which], right_length, primes[which]) + right) % primes[which]


def fold(parts: Iterable[tuple[int, int]], which: int, primes: tuple[int, ...] = PRIMES) -> int:
    """Join (hash, length) pairs of consecutive chunks."""
    out = 0
    for h, n in parts:
        out = combine(out, h, n, which, primes)
    return out


def fingerprint(data: bytes, which: int, primes: tuple[int, ...] = PRIMES) -> int:
    cuts = (data[i : i + CHUNK] for i in range(0, len(data), CHUNK))
    return fold(((chunk_hash(c, which, primes), len(c)) for c in cuts), which, primes)


_TO_SPACE = bytes.maketrans(b"\t\n\x0b\x0c\r", b"     ")


def normalised(data: bytes) -> bytes:
    """Each run of the six ASCII white-space characters becomes one space."""
    data = data.translate(_TO_SPACE)
    while b"  " in data:
        data = data.replace(b"  ", b" ")
    return data


_SCHEMA = "doc_id bigint, n_bytes bigint, f1 bigint, f2 bigint, sha binary"
_SCHEMA_NAMES = ["doc_id", "n_bytes", "f1", "f2", "sha"]
_KEY = ["n_bytes", "f1", "f2"]
_NORMALISED = r"regexp_replace(text, '[\\x20\\x09-\\x0D]+', ' ')"


def _fingerprints(primes: tuple[int, ...]):
    """Texts of at most LONG bytes, each hashed whole."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                rows = [normalised(t.as_buffer().to_pybytes()) for t in part.column("text").cast(pa.large_binary())]
                cols = [
                    part.column("doc_id"),
                    pa.array([len(t) for t in rows], pa.int64()),
                    pa.array([fingerprint(t, 0, primes) for t in rows], pa.int64()),
                    pa.array([fingerprint(t, 1, primes) for t in rows], pa.int64()),
                    pa.array([hashlib.sha256(t).digest() for t in rows], pa.binary()),
                ]
                yield pa.RecordBatch.from_arrays(cols, _SCHEMA_NAMES)

    return run


def _chunk_hashes(primes: tuple[int, ...]):
    """Hashes of chunks of long texts, and the factors that shift what stands before a chunk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [x.as_buffer().to_pybytes() for x in batch.column("part")]
            cols = [c for name, c in zip(batch.schema.names, batch.columns, strict=True) if name != "part"]
            names = [n for n in batch.schema.names if n != "part"]
            for w in (0, 1):
                cols += [pa.array([fingerprint(x, w, primes) for x in parts], pa.int64()), pa.array([pow(BASES[w], len(x), primes[w]) for x in parts], pa.int64())]
                names += [f"h{w}", f"p{w}"]
            yield pa.RecordBatch.from_arrays(cols, names)

    return run


def _marked(source: DataFrame, primes: tuple[int, ...], long: int) -> DataFrame:
    """Fingerprints and SHA-256 of all texts. A longer text is cut in chunks, which are dealt out over the
    tasks, hashed each on its own, and put together by length-shifted sums."""
    short = source.where(f"octet_length(text) <= {long}").mapInArrow(_fingerprints(primes), _SCHEMA)
    whole = source.where(f"octet_length(text) > {long}").select(F.monotonically_increasing_id().alias("row"), "doc_id", F.expr(f"cast({_NORMALISED} as binary)").alias("norm"))
    whole = whole.select("row", "doc_id", F.octet_length("norm").cast("bigint").alias("n_bytes"), F.unhex(F.sha2("norm", 256)).alias("sha"), "norm")
    at = F.posexplode(F.expr(f"transform(sequence(0, greatest(0, (n_bytes - 1) div {long})), i -> substring(norm, cast(i * {long} + 1 as int), {long}))")).alias("chunk", "part")
    chunks = whole.select("row", "doc_id", "n_bytes", "sha", at).repartition(width(source.sparkSession), "row", "chunk")
    hashed = chunks.mapInArrow(_chunk_hashes(primes), "row bigint, doc_id bigint, n_bytes bigint, sha binary, chunk int, h0 bigint, p0 bigint, h1 bigint, p1 bigint")
    listed = hashed.groupBy("row", "doc_id", "n_bytes", "sha").agg(F.array_sort(F.collect_list(F.struct("chunk", "h0", "p0", "h1", "p1"))).alias("c"))
    fold = lambda w: F.expr(f"aggregate(c, 0L, (s, x) -> (s * x.p{w} + x.h{w}) % {primes[w]}L)").alias(f"f{w + 1}")
    return short.union(listed.select("doc_id", "n_bytes", fold(0), fold(1), "sha"))


def exact_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", primes: tuple[int, ...] = PRIMES, long: int = LONG) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, sha (binary SHA-256 of the
    normalised text), n_bytes.

    Texts are equal when they are the same after each run of ASCII white space became one
    space; a null text counts as empty. The smallest id of a class stays. Null ids come after
    all others: such a row stays only if its whole class has none. Of rows that repeat the
    id that stays, one is kept. Other columns of `docs` are not read; an empty table gives
    an empty result. Texts over `long` bytes are hashed in chunks side by side.
    """
    source = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    marked = cut(_marked(source, primes, long).withColumn("level", F.lit(0)))
    level = 0
    while True:
        classes = marked.groupBy(*_KEY, "level").agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        repeated = classes.where("group_size > 1")
        wrong = _mismatches(source, marked, repeated.where(F.col("level") == level))
        if wrong is None:
            break
        moved = wrong.withColumns({"wrong": F.lit(True), "level": F.lit(level)})
        level += 1
        marked = cut(
            marked.join(moved, [*_KEY, "sha", "level"], "left")
            .withColumn("level", F.when(F.col("wrong"), level).otherwise(F.col("level")))
            .select(*_SCHEMA_NAMES, "level")
        )
    return _numbered(marked, repeated)


def _salted(df: DataFrame) -> DataFrame:
    return df.withColumn("salt", F.explode(F.array(*map(F.lit, range(SALTS)))))


def _numbered(marked: DataFrame, repeated: DataFrame) -> DataFrame:
    """Each document with its class. Equal rows are counted first, so that of several with
    the id that stays exactly one is kept. Only classes of several rows are joined, in parts."""
    rows = marked.groupBy("doc_id", *_KEY, "level", "sha").agg(F.count(F.lit(1)).alias("times"))
    rows = rows.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int"))
    out = rows.join(_salted(repeated), [*_KEY, "level", "salt"], "left")
    out = out.withColumn("keep_id", F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id"))).withColumn("group_size", F.coalesce("group_size", F.lit(1)).cast("bigint"))
    return out.select("*", F.posexplode(F.sequence(F.lit(1), F.col("times").cast("int"))).alias("nth", "_n")).select(
        "doc_id", "keep_id", "group_size",
        (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("nth") == 0)).alias("kept"), "sha", "n_bytes",
    )


def _mismatches(source: DataFrame, marked: DataFrame, repeated: DataFrame) -> DataFrame | None:
    """Texts (key and SHA) of these classes whose bytes differ from the one that would stay; None if none do.
    Only texts of such classes are read again, and they are cut in chunks before they are joined."""
    salt = F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int").alias("salt")
    listed = marked.select("doc_id", "sha", "level", *_KEY, salt).join(_salted(repeated), [*_KEY, "level", "salt"])
    salts = F.when(F.col("group_size") > LARGE, SALTS).otherwise(1).alias("salts")
    # one row a text, however many copies it has; the plan is that of large tables also where they are small
    stays = F.max(F.col("doc_id").eqNullSafe(F.col("keep_id"))).alias("stays")
    wanted = keep(listed.groupBy("sha", *_KEY, salts).agg(stays), "wanted")
    bodies = source.select("doc_id", F.expr(f"cast({_NORMALISED} as binary)").alias("body"))
    members = bodies.withColumn("sha", F.unhex(F.sha2("body", 256))).join(wanted.hint("merge"), "sha")
    at = F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.length("body") - 1) / COMPARED)).cast("int")))
    salt = F.pmod(F.xxhash64("doc_id"), "salts").cast("int").alias("salt")
    members = keep(members.withColumn("chunk", at).select("sha", *_KEY, "salts", salt, "stays", "chunk", F.expr(f"substring(body, chunk * {COMPARED} + 1, {COMPARED})").alias("part")), "members")
    # of a class without ids, and of texts that share the id that stays, the one of the least hash is compared with
    keeper = members.where("stays").groupBy(*_KEY, "salts", "chunk").agg(F.min(F.struct("sha", "part")).alias("k"))
    keeper = keeper.select(*_KEY, "chunk", F.col("k.part").alias("kept_part"), F.explode(F.expr("sequence(0, salts - 1)")).alias("salt"))
    differ = members.join(keeper.hint("merge"), [*_KEY, "chunk", "salt"]).where(F.col("part") != F.col("kept_part"))
    differ = cut(differ.select(*_KEY, "sha").distinct())
    return None if differ.isEmpty() else differ


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `docs` that stay, all columns. One row of each class, also where ids repeat:
    the row is found again by its id and text, and of repeated rows one is taken. Columns may have
    any names; an empty table gives an empty result."""
    spare = unused(docs, "key")
    key = lambda i, sha: F.concat_ws("|", F.coalesce(i.cast("string"), F.lit("")), sha)
    kept = exact_classes(docs, id_col, text_col).where("kept").select(key(F.col("doc_id"), F.lower(F.hex("sha"))).alias(spare))
    text = F.regexp_replace(F.coalesce(F.col(text_col).cast("string"), F.lit("")), r"[\x20\x09-\x0D]+", " ")
    marked = docs.withColumn(spare, key(F.col(id_col).cast("bigint"), F.sha2(text, 256)))
    return marked.join(kept, spare, "left_semi").dropDuplicates([spare]).drop(spare)


def op2_exact_dedup(spark, sf_dir: str) -> DataFrame:
    out = exact_classes(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("sha")).alias("text_sha256"))


ORACLE = r"""
WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS n FROM documents),
h AS (SELECT doc_id, sha256(n) AS text_sha256 FROM t)
SELECT doc_id, min(doc_id) OVER (PARTITION BY text_sha256) AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size,
  doc_id = min(doc_id) OVER (PARTITION BY text_sha256) AS kept, text_sha256
FROM h
"""
