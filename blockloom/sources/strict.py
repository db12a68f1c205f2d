"""Archive files as a data source, `bz2strict`.

Reading gives one row per block: path, member, block, start_bit, crc, content, error. By default a file
is read by one task and all rules are checked. With `splitBytes` a file is dealt out in byte
ranges: a task decodes the blocks whose marker begins in its range, reads on as far as the last of
them goes, and checks each block; rules for whole streams are then left to `validate`.

Modes: FAILFAST raises at the first defect. PERMISSIVE gives the good blocks before it and a last row with
the defect's code in `error`. DROPMALFORMED gives nothing of a file with a defect, and of a
range no block with one.

The source opens files by itself, so it reads and writes folders that all machines mount. `read` takes
any path that Spark opens, with the same rows and modes. Writing encodes each task's `content`
rows, in their order, into one archive file, published when the job commits; in overwrite mode
the old folder goes when the new one is in place.
"""

from __future__ import annotations

import glob
import os
import shutil
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from blockloom.errors import BlockError
from blockloom.functions import kernels as K
from blockloom.functions import strict
from blockloom.operators.archive import batches, pairs
from blockloom.options import DecodeOptions, EncodeOptions

SCHEMA = "path string, member int, block int, start_bit bigint, crc bigint, content binary, error string"
MODES = ("FAILFAST", "PERMISSIVE", "DROPMALFORMED")


@dataclass
class _Range(InputPartition):
    path: str
    start: int
    end: int
    whole: bool


def _files(path: str) -> list[str]:
    path = path.removeprefix("file://")
    if os.path.isdir(path):
        return sorted(os.path.join(path, f) for f in os.listdir(path) if not f.startswith(("_", ".")))
    return sorted(glob.glob(path))


def rows(path: str, data: bytes, options: DecodeOptions, mode: str) -> Iterator[tuple]:
    """Rows of one archive under a mode."""
    held, error = [], None
    blocks = strict.blocks(data, options)
    while True:
        try:
            b = next(blocks, None)
        except BlockError as e:
            if mode == "FAILFAST":
                raise
            error = (path, e.member, e.block, e.bit, None, None, e.code)
            b = None
        if b is None:
            break
        if b["block"] is not None:
            row = (path, b["member"], b["block"], b["start_bit"], b["crc"], b["out"], None)
            if mode == "DROPMALFORMED":
                held.append(row)
            else:
                yield row
    if error is None:
        yield from held
    elif mode == "PERMISSIVE":
        yield error


def scan(archives: DataFrame, mode: str = "FAILFAST", **options) -> DataFrame:
    """The source's rows from rows (path, content) of archives, wherever they come from. Null contents are
    empty archives; options as in DecodeOptions."""
    if mode not in MODES:
        raise ValueError(f"unknown mode {mode}")
    chosen = DecodeOptions(**options)
    kinds = pa.schema([("path", pa.string()), ("member", pa.int32()), ("block", pa.int32()), ("start_bit", pa.int64()), ("crc", pa.int64()), ("content", pa.binary()), ("error", pa.string())])

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from batches((row for path, content in pairs(parts) for row in rows(path, content, chosen, mode)), kinds)

    return archives.selectExpr("cast(path as string) as path", "content").mapInArrow(run, SCHEMA)


def read(spark: SparkSession, path: str, mode: str = "FAILFAST", **options) -> DataFrame:
    """The source's rows from files at any path that Spark can open, a file by one task."""
    return scan(archives(spark, path), mode, **options)


class _Reader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.path = options["path"]
        self.split = int(options.get("splitbytes", 0))
        self.mode = options.get("mode", "FAILFAST").upper()
        if self.mode not in MODES:
            raise ValueError(f"unknown mode {self.mode}")
        limit = options.get("maxoutputbytes")
        self.options = DecodeOptions(concatenated=options.get("concatenated", "true") == "true", trailing_data=options.get("trailingdata", "error"), max_output_bytes=None if limit is None else int(limit))

    def partitions(self) -> list[_Range]:
        out = []
        for f in _files(self.path):
            size = os.path.getsize(f)
            step = self.split or max(size, 1)
            out += [_Range(f, at, min(size, at + step), not self.split) for at in range(0, max(size, 1), step)]
        return out

    def read(self, part: _Range):
        if not part.whole:
            yield from self._range(part)
            return
        with open(part.path, "rb") as f:
            yield from rows(part.path, f.read(), self.options, self.mode)

    def _range(self, part: _Range):
        with open(part.path, "rb") as f:
            level = f.read(4)[3:]
            f.seek(part.start)
            data = f.read(part.end - part.start + K.bound(9) + 6)
        level = level[0] - 48 if level and 49 <= level[0] <= 57 else 9
        found = K.markers(data)
        inside = 0  # markers before this bit lie in a block that decoded
        for i, (bit, kind) in enumerate(found):
            if kind != "block" or bit >= 8 * (part.end - part.start) or bit < inside:
                continue
            out, inside_to = None, 0
            for end, _ in found[i + 1 :]:
                if (end - bit) // 8 > K.bound(9):
                    break
                for lv in dict.fromkeys((level, 9)):
                    out = K.decode_block(data, bit, end, lv)
                    if out is not None and strict.tables_fit(data, bit):
                        inside_to = end
                        break
                    out = None
                if out is not None:
                    break
            if out is None:  # read bit by bit, which raises with the block's own error
                try:
                    out, inside_to = strict._diagnose(data, bit, 9, None, {"member": None, "block": None})
                except BlockError as e:
                    if self.mode == "FAILFAST":
                        raise BlockError(e.code, f"{e.message} in the block at bit {8 * part.start + bit}") from None
                    if self.mode == "PERMISSIVE":
                        yield part.path, None, None, 8 * part.start + bit, None, None, e.code
                    continue
            inside = inside_to
            yield part.path, None, None, 8 * part.start + bit, K.bits(data, bit + 48, 32), out, None


@dataclass
class _Written(WriterCommitMessage):
    temporary: str


class _Writer(DataSourceWriter):
    def __init__(self, options: dict, overwrite: bool) -> None:
        self.path = options["path"].removeprefix("file://")
        self.level = EncodeOptions(block_size=int(options.get("blocksize", 9))).block_size
        self.overwrite = overwrite
        if os.path.exists(self.path) and not overwrite:
            raise FileExistsError(f"{self.path} exists")

    def write(self, rows) -> _Written:
        from pyspark import TaskContext

        os.makedirs(os.path.dirname(self.path) or ".", exist_ok=True)
        temporary = f"{self.path}.{uuid.uuid4().hex}.{TaskContext.get().partitionId():05d}.tmp"
        try:
            with open(temporary, "wb") as f:
                some = False
                for row in rows:
                    f.write(K.compress(bytes(row.content or b""), self.level))
                    some = True
                if not some:
                    f.write(K.compress(b"", self.level))
        except BaseException:
            os.unlink(temporary)
            raise
        return _Written(temporary)

    def commit(self, messages: list) -> None:
        fresh = f"{self.path}.{uuid.uuid4().hex}"
        os.makedirs(f"{fresh}.new")
        for i, m in enumerate(m for m in messages if m):
            os.replace(m.temporary, os.path.join(f"{fresh}.new", f"part-{i:05d}.bz2"))
        if self.overwrite and os.path.isdir(self.path):
            os.rename(self.path, f"{fresh}.old")
        os.rename(f"{fresh}.new", self.path)
        shutil.rmtree(f"{fresh}.old", ignore_errors=True)

    def abort(self, messages: list) -> None:
        for m in messages:
            if m and os.path.exists(m.temporary):
                os.unlink(m.temporary)


class StrictSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "bz2strict"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader({k.lower(): v for k, v in self.options.items()})

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _Writer({k.lower(): v for k, v in self.options.items()}, overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(StrictSource)


def read_lenient(spark: SparkSession, path: str, kind: str = "text", **options):
    """Spark's own splittable scan of trusted files: fast, and blind to several defects."""
    return spark.read.format(kind).options(**options).load(path)


def archives(spark: SparkSession, path: str):
    """Whole files as rows (path, content), by any path Spark can open."""
    return spark.read.format("binaryFile").load(path).select("path", "content")
