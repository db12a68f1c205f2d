"""Archives as rows: members, markers, segments and blocks; parallel decoding and encoding.

An archive is a row of a key column and a binary column `content`. Parallel decoding spreads
the segments between marker candidates over the cluster and decodes each on its own, numbered in
their order; only an archive that is not regular or in which a segment fails goes to the
sequential reader, which mends false markers and names defects.
"""

from __future__ import annotations

import gc
import hashlib
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

from blockloom.errors import ERROR_TYPE, BlockError
from blockloom.functions import kernels as K
from blockloom.functions import strict
from blockloom.functions.columns import bz2_validate, combine_expr
from blockloom.options import DecodeOptions, EncodeOptions, parse_concurrency


def batches(rows: Iterable[tuple], schema: pa.Schema, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Rows as Arrow batches of about `most` bytes of binary values."""
    held: list[tuple] = []
    size = 0

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), schema.types, strict=True)], schema=schema)

    for row in rows:
        held.append(row)
        size += sum(len(v) for v in row if isinstance(v, bytes)) + 64
        if size >= most:
            yield out()
            held, size = [], 0
    if held:
        yield out()


def pairs(parts: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, bytes]]:
    """(key, content) of the rows, content empty where it is null."""
    for batch in parts:
        for name, content in zip(batch.column(0), batch.column(1), strict=True):
            yield name.as_py(), content.as_py() or b""


def members(archives: DataFrame, key: str = "path") -> DataFrame:
    """(key, level, is_magic) of the first header of each archive, in SQL alone."""
    head = F.substring("content", 1, 3) == F.unhex(F.lit("425A68"))
    digit = F.conv(F.hex(F.expr("substring(content, 4, 1)")), 16, 10).cast("int") - 48
    return archives.select(key, F.coalesce(head, F.lit(False)).alias("is_magic"), F.when(digit.between(1, 9), digit).alias("level"))


def markers(archives: DataFrame, key: str = "path") -> DataFrame:
    """(key, bit, kind) of every marker candidate."""
    schema = pa.schema([("key", pa.string()), ("bit", pa.int64()), ("kind", pa.string())])

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from batches(((name, bit, kind) for name, content in pairs(parts) for bit, kind in K.markers(content)), schema)

    return archives.select(F.col(key).cast("string").alias("key"), "content").mapInArrow(run, "key string, bit bigint, kind string").withColumnRenamed("key", key)


def segments(found: DataFrame, key: str = "path") -> DataFrame:
    """Each marker with the next one of its archive: (key, bit, kind, end_bit)."""
    own = Window.partitionBy(key).orderBy("bit")
    return found.withColumn("end_bit", F.lead("bit").over(own))


def per_row(rows: DataFrame, column: str, work: Callable[[bytes | None], tuple], fields: dict[str, str], most: int = 1 << 20) -> DataFrame:
    """Each row with `column` taken away and the values of work(value of the column) added as `fields` (name: type), in one
    Python worker a task that holds about `most` bytes of the column's values besides Spark's own batch."""
    kept = [c for c in rows.columns if c != column]
    added = StructType.fromDDL(", ".join(f"`{n}` {t}" for n, t in fields.items()))
    schema = StructType([*rows.select(*kept).schema.fields, *added.fields])
    types = [to_arrow_type(f.dataType) for f in added.fields]

    def cuts(values: pa.Array) -> Iterator[tuple[int, int]]:
        lo = size = 0
        for i, v in enumerate(values):
            size += 64 + (len(v.as_buffer()) if v.is_valid else 0)
            if size >= most:
                yield lo, i + 1
                lo, size = i + 1, 0
        if lo < len(values):
            yield lo, len(values)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            names = batch.schema.names
            for lo, hi in cuts(batch.column(names.index(column))):
                part = batch.slice(lo, hi - lo)
                made = list(zip(*(work(v.as_py()) for v in part.column(names.index(column))), strict=True))
                yield pa.RecordBatch.from_arrays([*(part.column(names.index(c)) for c in kept), *(pa.array(v, t) for v, t in zip(made, types, strict=True))], names=schema.names)

    return rows.select(*kept, F.col(column).cast("binary").alias(column)).mapInArrow(run, schema)


def spread(rows: DataFrame) -> DataFrame:
    """Rows dealt out to all cores: a small file is one task of Spark's, however long its rows take."""
    return rows.repartition(4 * rows.sparkSession.sparkContext.defaultParallelism)


_HELD = {"raw": "binary", "members": "bigint", "blocks": "bigint", "raw_len": "bigint", "crc": "bigint", "error_code": "string"}


def inspect(rows: DataFrame, content: str = "content", raw: bool = True) -> DataFrame:
    """Each row with what its archive holds instead of the archive: output, good members and blocks, bytes, the last
    block's checksum, the code of the defect that ended it. Null has nulls. Nothing is grouped, so keys
    may be null or come more than once."""

    def held(content: bytes | None) -> tuple:
        if content is None:
            return (None,) * len(fields)
        parts, members, blocks, crc, code = [], 0, 0, None, None
        try:
            for b in strict.blocks(content):
                if b["block"] is None:
                    members += 1
                else:
                    parts.append(b["out"])
                    blocks, crc = blocks + 1, b["crc"]
        except BlockError as e:
            code = e.code
        found = members, blocks, sum(map(len, parts)), crc, code
        return (b"".join(parts), *found) if raw else found

    fields = {n: t for n, t in _HELD.items() if raw or n != "raw"}
    return per_row(rows, content, held, fields)


def blocks(archives: DataFrame, key: str = "path") -> DataFrame:
    """Inventory of good blocks, with the defect that ended an archive in a last row: (key, member,
    block, level, start_bit, end_bit, crc, raw_len, error_code). Member ends have block null."""
    schema = pa.schema([("key", pa.string()), ("member", pa.int32()), ("block", pa.int32()), ("level", pa.int32()), ("start_bit", pa.int64()), ("end_bit", pa.int64()), ("crc", pa.int64()), ("raw_len", pa.int64()), ("error_code", pa.string())])

    def rows(name: str, content: bytes) -> Iterator[tuple]:
        try:
            for b in strict.blocks(content):
                yield name, b["member"], b["block"], b["level"], b["start_bit"], b["end_bit"], b["crc"], len(b["out"]), None
        except BlockError as e:
            yield name, e.member, e.block, None, e.bit, None, e.expected, None, e.code

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from batches((row for pair in pairs(parts) for row in rows(*pair)), schema)

    ddl = "key string, member int, block int, level int, start_bit bigint, end_bit bigint, crc bigint, raw_len bigint, error_code string"
    return archives.select(F.col(key).cast("string").alias("key"), "content").mapInArrow(run, ddl).withColumnRenamed("key", key)


def crc_fold(rows: DataFrame, keys: list[str], order: str, crc: str = "crc") -> DataFrame:
    """Ordered checksum of each group of block checksums: the sum is not commutative, so the blocks are
    put in order first."""
    listed = F.expr(f"transform(array_sort(collect_list(struct({order}, {crc}))), x -> x.{crc})")
    return rows.groupBy(*keys).agg(listed.alias("_c")).withColumn("combined", F.expr(f"aggregate(_c, 0L, (s, b) -> {combine_expr('s', 'b')})")).drop("_c")


def crc_fold_xor(rows: DataFrame, keys: list[str], order: str, crc: str = "crc") -> DataFrame:
    """The same as a commutative sum: block i of n counts turned left by n - i bits. No group is
    gathered in one row, so it also holds for groups of any size."""
    own = Window.partitionBy(*keys)
    turned = rows.withColumn("_t", F.expr("0")).withColumn("_t", (F.count(F.lit(1)).over(own) - F.row_number().over(own.orderBy(order))) % 32)
    left = F.expr(f"(shiftleft({crc}, cast(_t as int)) & 4294967295) | shiftright({crc}, cast(32 - _t as int))")
    return turned.withColumn("_x", left).groupBy(*keys).agg(F.bit_xor("_x").alias("combined"))


def validate(archives: DataFrame, mode: str = "PERMISSIVE", **options) -> DataFrame:
    """PERMISSIVE adds `error`; DROPMALFORMED keeps good archives; FAILFAST raises at the first bad one."""
    if mode not in ("PERMISSIVE", "DROPMALFORMED", "FAILFAST"):
        raise ValueError(f"unknown mode {mode}")
    checked = archives.withColumn("error", bz2_validate("content", **options))
    if mode == "DROPMALFORMED":
        return checked.where("error is null").drop("error")
    if mode == "FAILFAST":
        fail = F.raise_error(F.concat_ws(": ", "error.code", "error.message"))
        return checked.where(F.when(F.col("error").isNotNull(), fail.cast("boolean")).otherwise(True)).drop("error")
    return checked


def output_limit(rows: DataFrame, keys: list[str], order: list[str], limit: int, size: str = "raw_len") -> DataFrame:
    """Running output of each archive, and whether a block passes the limit. It is a flag and never cuts."""
    own = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    total = F.sum(size).over(own)
    return rows.withColumn("total_out", total).withColumn("over_limit", total > limit)


_DECODED = pa.schema([("key", pa.string()), ("seq", pa.int64()), ("bytes", pa.binary()), ("error", pa.struct([("code", pa.string()), ("message", pa.string()), ("byte_offset", pa.int64()), ("bit_offset", pa.int32()), ("member", pa.int32()), ("block", pa.int32()), ("expected", pa.int64()), ("actual", pa.int64())]))])


def _sequential(name: str, content: bytes, options: DecodeOptions, seq: int = 0) -> Iterator[tuple]:
    first = seq
    try:
        for b in strict.blocks(content, options):
            for part in K.chunks(b["out"], options.output_chunk_size):
                yield name, seq, part, None
                seq += 1
        if seq == first:
            yield name, seq, b"", None
    except BlockError as e:
        yield name, seq, None, e.row()


WHOLE = 256 << 10  # bytes


def decode(archives: DataFrame, key: str = "path", fake_markers: DataFrame | None = None, whole_below: int = WHOLE, **options) -> DataFrame:
    """(key, seq, bytes, error): the output of each archive in chunks, in the order of seq, one empty chunk
    if there is none. Blocks before a defect stay; the defect is the last row. Segments between markers are decoded in parallel: a
    task gets segments' bytes, not the archive, and no task gathers what an archive unfolds to.
    Archives of less than `whole_below` bytes are read by one task each, since cutting them up costs more
    than reading them; so are those with several members, false markers or defects, which the reader
    in sequence mends or names. Keys are distinct. Decoded segments are kept on the executors' disks,
    so that none is decoded twice. `fake_markers` (key, bit, kind) join the candidates, for tests
    of their repair."""
    o = DecodeOptions(**options)
    spark = archives.sparkSession
    source = archives.select(F.col(key).cast("string").alias("key"), "content")
    n = parse_concurrency(o.concurrency, spark.sparkContext.defaultParallelism)
    if n == 1 or o.max_output_bytes is not None:
        return _in_sequence(source, o).withColumnRenamed("key", key)
    return _parallel(source, o, n, fake_markers, whole_below).withColumnRenamed("key", key)


def _in_sequence(source: DataFrame, o: DecodeOptions) -> DataFrame:
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from batches((row for pair in pairs(parts) for row in _sequential(*pair, o)), _DECODED)

    return source.mapInArrow(run, f"key string, seq bigint, bytes binary, error {ERROR_TYPE}")


def _parallel(every: DataFrame, o: DecodeOptions, n: int, fake: DataFrame | None, whole_below: int) -> DataFrame:
    large = F.expr(f"content is not null and length(content) >= {whole_below}")
    source = every.where(large).withColumn("fake", F.lit(None).cast("array<struct<bit:bigint,kind:string>>"))
    if fake is not None:
        listed = fake.groupBy("key").agg(F.collect_list(F.struct(F.col("bit").cast("bigint").alias("bit"), "kind")).alias("fake"))
        source = source.drop("fake").join(listed, "key", "left")
    segments_ = source.select("key", "content", "fake").mapInArrow(_regular_segments, "key string, block int, level int, shift int, n_bits bigint, part binary")
    decoded = segments_.repartition(n, "key", "block").mapInArrow(_decode_segments(o.output_chunk_size), "key string, seq bigint, bytes binary, bad boolean")
    decoded = decoded.persist(StorageLevel.DISK_ONLY)
    fast, rest = decoded, every.where(~large | F.col("content").isNull())
    # Counted at once: the parts below would else run side by side, and executors decode the same segments.
    if decoded.where("bad").count():
        bad = decoded.where("bad").select("key").distinct()
        fast = decoded.where("not bad").join(bad, "key", "left_anti")
        rest = source.select("key", "content").join(bad, "key", "left_semi").union(rest)
    return fast.select("key", "seq", "bytes", F.lit(None).cast(ERROR_TYPE).alias("error")).union(_in_sequence(rest, o))


_SEGMENTS = pa.schema([("key", pa.string()), ("block", pa.int32()), ("level", pa.int32()), ("shift", pa.int32()), ("n_bits", pa.int64()), ("part", pa.binary())])
_CHUNKS = pa.schema([("key", pa.string()), ("seq", pa.int64()), ("bytes", pa.binary()), ("bad", pa.bool_())])


def regular(content: bytes, found: list[tuple[int, str]]) -> bool:
    """Whether markers and checksums are those of one member and nothing else, by what the archive says; no
    block is decoded for it. A false marker would have to repair the stream's checksum by chance."""
    if len(content) < 14 or content[:3] != K.MAGIC or not 49 <= content[3] <= 57:
        return False
    end, kind = found[-1] if found else (0, "")
    if kind != "end" or found[0][0] != 32 or any(k == "end" for _, k in found[:-1]) or len(content) != (end + 87) // 8:
        return False
    if K.bits(content, end + 80, 8 * len(content) - end - 80):
        return False
    return K.fold(K.bits(content, bit + 48, 32) for bit, _ in found[:-1]) == K.bits(content, end + 48, 32)


def _regular_segments(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The segments of regular archives; one row without bytes for each of the others."""

    def cut() -> Iterator[tuple]:
        for batch in parts:
            for name, value, fake in zip(*batch.columns, strict=True):
                content = value.as_py() or b""
                found = sorted({*K.markers(content), *((f["bit"], f["kind"]) for f in fake.as_py() or ())})
                if len(found) < 2 or not regular(content, found):
                    yield name.as_py(), -1, 0, 0, 0, None
                    continue
                for i, ((bit, _), (end, _)) in enumerate(zip(found, found[1:], strict=False)):
                    yield name.as_py(), i, content[3] - 48, bit % 8, end - bit, content[bit // 8 : end // 8 + 1]

    yield from batches(cut(), _SEGMENTS)


def _decode_segments(size: int):
    def decoded(r: dict) -> Iterator[tuple]:
        out, shift, part = None, r["shift"], r["part"]
        if part is not None and r["n_bits"] <= 8 * K.bound(r["level"]):
            out = K.decode_block(part, shift, shift + r["n_bits"], r["level"])
        if out is None or not strict.tables_fit(part, shift):
            yield r["key"], None, None, True
            return
        for i, chunk in enumerate(K.chunks(out, size)):
            yield r["key"], (r["block"] << 32) + i, chunk, False

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from batches((row for batch in parts for i in range(batch.num_rows) for r in batch.slice(i, 1).to_pylist() for row in decoded(r)), _CHUNKS)

    return run


def assemble(chunks: DataFrame, key: str = "path", seq: str = "seq", data: str = "bytes") -> DataFrame:
    """One value per key: its chunks joined in order. A value, like any in Spark, holds 2 GB at most; what is
    longer is best left in chunks, sorted by key and seq."""
    whole = F.expr(f"listagg({data}) within group (order by {seq})")
    return chunks.groupBy(key).agg(F.coalesce(whole, F.expr("cast('' as binary)")).alias("content"))


def encode(raw: DataFrame, key: str = "path", level: int = 9, concurrency: int | str = "auto") -> DataFrame:
    """(key, content): each value as an archive. Values of more than one slice are cut into slices of
    fixed size, which are encoded in parallel and stitched per key, so the bytes don't depend on the
    number of tasks. Keys are distinct; null values are left out."""
    EncodeOptions(block_size=level, concurrency=concurrency)
    n = parse_concurrency(concurrency, raw.sparkSession.sparkContext.defaultParallelism)
    size = K.slice_size(level)
    source = raw.select(F.col(key).cast("string").alias("key"), F.col("content").cast("binary").alias("content"))
    cut = F.expr(f"transform(sequence(0, greatest(0, (length(content) - 1) div {size})), i -> substring(content, cast(i * {size} + 1 as int), {size}))")
    single = source.where(f"length(content) <= {size}").mapInArrow(_encode_whole(level), "key string, content binary")
    slices = source.where(f"length(content) > {size}").select("key", F.posexplode(cut).alias("seq", "part")).repartition(n, "key", "seq")
    coded = slices.mapInArrow(_encode_slices(level), "key string, seq bigint, body binary, n_bits bigint, crc bigint")

    def join(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: r["seq"])
        whole = K.stitch(((r["body"], r["n_bits"], r["crc"]) for r in rows if r["n_bits"]), level)
        return pa.table({"key": [rows[0]["key"]], "content": pa.array([whole], pa.binary())})

    return single.union(coded.groupBy("key").applyInArrow(join, "key string, content binary")).withColumnRenamed("key", key)


def _encode_whole(level: int):
    schema = pa.schema([("key", pa.string()), ("content", pa.binary())])

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from batches(((name, K.compress(content, level)) for name, content in pairs(parts)), schema)

    return run


def _encode_slices(level: int):
    schema = pa.schema([("key", pa.string()), ("seq", pa.int64()), ("body", pa.binary()), ("n_bits", pa.int64()), ("crc", pa.int64())])

    def coded(r: dict) -> tuple:
        return (r["key"], r["seq"], *(K.encode_block(r["part"], level) if r["part"] else (b"", 0, 0)))

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from batches((coded(r) for batch in parts for r in batch.to_pylist()), schema)

    return run


PART = 4 << 20  # bytes


def encode_joined(rows: DataFrame, key: str, order: list[str], value: str, path: str, separator: bytes = b"\n", level: int = 9, part: int = PART) -> DataFrame:
    """(key, part, content): the values of each key joined in order, as members that hold `part` bytes each and make one
    archive one behind the other. Keys are not null; null values count as empty. No task holds a key's values or archive:
    rows are sorted over the cluster, each task joins its own, and what it has is cut where the members
    end. Bytes don't depend on the number of tasks. The joined pieces are kept at `path`."""
    spark = rows.sparkSession
    EncodeOptions(block_size=level)
    _write_joined(rows, key, order, value, separator, path)
    drop_shuffles(spark)
    pieces = spark.read.parquet(path)
    held = pieces.groupBy("key", "task").agg(F.sum("n").alias("size"))
    own = Window.partitionBy("key")
    held = held.select("key", "task", (F.sum("size").over(own.orderBy("task")) - F.col("size")).alias("base"), (F.sum("size").over(own) - len(separator)).alias("total"))
    placed = pieces.join(F.broadcast(held), ["key", "task"]).withColumn("at", F.col("base") + F.col("lo"))
    placed = placed.withColumn("n", F.least("n", F.col("total") - F.col("at"))).where("n > 0")
    first, last = f"greatest(at, p * {part}L)", f"least(at + n, (p + 1) * {part}L)"
    cut = f"inline(transform(sequence(at div {part}, (at + n - 1) div {part}), p -> struct(p as part, {first} as at, substring(bytes, cast({first} - at + 1 as int), cast({last} - {first} as int)) as bytes)))"
    dealt = placed.select("key", F.expr(cut)).repartition("key", "part").sortWithinPartitions("key", "part", "at")
    return dealt.select("key", "part", "bytes").mapInArrow(_members(level), "key string, part bigint, content binary").withColumnRenamed("key", key)


def _write_joined(rows: DataFrame, key: str, order: list[str], value: str, separator: bytes, path: str) -> None:
    ordered = rows.select(F.col(key).cast("string").alias("key"), *[F.col(c).alias(f"order{i}") for i, c in enumerate(order)], F.col(value).cast("binary").alias("value"))
    n = max(rows.sparkSession.sparkContext.defaultParallelism, 4 * rows.rdd.getNumPartitions())
    by = [F.asc("key"), *[F.asc_nulls_last(f"order{i}") for i in range(len(order))]]
    ordered = ordered.repartitionByRange(n, *by).sortWithinPartitions(*by).select("key", "value", F.spark_partition_id().alias("task"))
    pieces = ordered.mapInArrow(_joined(separator), "key string, task int, lo bigint, n bigint, bytes binary")
    pieces.write.option("compression", "zstd").parquet(path)


def drop_shuffles(spark: SparkSession) -> None:
    """Shuffle files of jobs that are done stay on the executors' disks until the driver happens to collect its
    garbage. This collects it now, after a write whose files alone are read again."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def _joined(separator: bytes, most: int = 1 << 20):
    """Values of sorted rows one behind the other, a separator after each, in pieces of about `most` bytes."""
    schema = pa.schema([("key", pa.string()), ("task", pa.int32()), ("lo", pa.int64()), ("n", pa.int64()), ("bytes", pa.binary())])

    def made(parts: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        now, held, size, lo = None, [], 0, 0
        for batch in parts:
            for key, value, task in zip(*batch.columns, strict=True):
                at = key.as_py(), task.as_py()
                if at != now or size >= most:
                    if held:
                        yield *now, lo, size, b"".join(held)
                    lo = lo + size if at == now else 0
                    now, held, size = at, [], 0
                held += [value.as_py() or b"", separator]
                size += len(held[-2]) + len(separator)
        if held:
            yield *now, lo, size, b"".join(held)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from batches(made(parts), schema)

    return run


def _members(level: int):
    """The pieces of each part, which come in order, as one member."""
    schema = pa.schema([("key", pa.string()), ("part", pa.int64()), ("content", pa.binary())])

    def made(parts: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        now, held = None, []
        for batch in parts:
            for key, part, piece in zip(*batch.columns, strict=True):
                at = key.as_py(), part.as_py()
                if at != now:
                    if held:
                        yield *now, K.compress(b"".join(held), level)
                    now, held = at, []
                held.append(piece.as_py())
        if held:
            yield *now, K.compress(b"".join(held), level)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from batches(made(parts), schema)

    return run


def digests(chunks: DataFrame, keys: list[str], order: list[str], data: str = "bytes", error: str = "error") -> DataFrame:
    """(keys, digest, n_bytes, defects): MD5 and length of each key's chunks in order, and its rows with an error, in a stream. The
    sum can't be split, so a key is one task's; its chunks travel there compressed. Keys are strings and not null."""
    schema = pa.schema([*((k, pa.string()) for k in keys), ("digest", pa.string()), ("n_bytes", pa.int64()), ("defects", pa.int64())])
    squeeze = lambda v: ((None, 0) if v is None else (pa.compress(v, "zstd", asbytes=True), len(v)))

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made() -> Iterator[tuple]:
            now, sum_, size, bad = None, None, 0, 0
            for batch in parts:
                for *at, packed, n, failed in zip(*batch.columns, strict=True):
                    at = [k.as_py() for k in at]
                    if at != now:
                        if now is not None:
                            yield *now, sum_.hexdigest(), size, bad
                        now, sum_, size, bad = at, hashlib.md5(usedforsecurity=False), 0, 0
                    if packed.is_valid:
                        sum_.update(pa.decompress(packed.as_buffer(), n.as_py(), "zstd"))
                        size += n.as_py()
                    bad += failed.as_py()
            if now is not None:
                yield *now, sum_.hexdigest(), size, bad

        yield from batches(made(), schema)

    small = per_row(chunks.select(*keys, *order, F.col(error).isNotNull().alias("_bad"), F.col(data).alias("_data")), "_data", squeeze, {"_packed": "binary", "_n": "bigint"})
    sorted_ = small.repartition(*keys).sortWithinPartitions(*keys, *order)
    ddl = ", ".join([*(f"`{k}` string" for k in keys), "digest string, n_bytes bigint, defects bigint"])
    return sorted_.select(*keys, "_packed", "_n", "_bad").mapInArrow(run, ddl)


def concatenate(parts: DataFrame, key: str, order: str) -> DataFrame:
    """Members of one key put one behind the other: an archive of several members."""
    return assemble(parts, key, order, "content")
