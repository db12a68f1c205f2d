"""Column functions over binary columns, and their SQL names."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from blockloom.errors import ERROR_TYPE
from blockloom.functions import encoder, strict
from blockloom.functions import kernels as K
from blockloom.options import DecodeOptions, EncodeOptions

_KINDS = {"string": T.StringType(), "bigint": T.LongType(), "int": T.IntegerType()}
ERROR = T.StructType([T.StructField(n, _KINDS[k]) for n, k in (x.split(":") for x in ERROR_TYPE[7:-1].split(","))])


def _binary(column: Column | str) -> Column:
    return (F.col(column) if isinstance(column, str) else column).cast("binary")


def bz2_compress(column: Column | str, level: int | Column = 9, backend: str = "fast") -> Column:
    """Each value as an archive of one member; null stays null, empty gives an empty member. The backend
    'strict' does all stages itself, and makes other bytes. The level may be a column; a null level gives null."""
    coder = {"fast": K.compress, "strict": encoder.compress}[backend]
    if isinstance(level, Column):

        @F.pandas_udf(T.BinaryType())
        def leveled(values: pd.Series, levels: pd.Series) -> pd.Series:
            return pd.Series([None if v is None or pd.isna(n) else coder(v, EncodeOptions(block_size=int(n)).block_size) for v, n in zip(values, levels, strict=True)], dtype=object)

        return leveled(_binary(column), level)
    EncodeOptions(block_size=level)

    @F.pandas_udf(T.BinaryType())
    def run(values: pd.Series) -> pd.Series:
        return values.map(lambda v: None if v is None else coder(v, level))

    return run(_binary(column))


def bz2_decompress(column: Column | str, backend: str = "fast", **options) -> Column:
    """Output of each archive; a defect fails the query. Options as in DecodeOptions."""
    chosen = DecodeOptions(**options)

    @F.pandas_udf(T.BinaryType())
    def run(values: pd.Series) -> pd.Series:
        return values.map(lambda v: None if v is None else strict.decompress(v, chosen, backend))

    return run(_binary(column))


def bz2_validate(column: Column | str, **options) -> Column:
    """Null for a good archive, else the first defect as a struct."""
    chosen = DecodeOptions(**options)

    @F.pandas_udf(ERROR)
    def run(values: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        names = [f.name for f in ERROR]
        for part in values:
            rows = [(e.row() if v is not None and (e := strict.validate(v, chosen)) else dict.fromkeys(names)) for v in part]
            yield pd.DataFrame(rows, columns=names).astype(object).where(lambda d: d.notna(), None)

    found = run(_binary(column))
    return F.when(found["code"].isNotNull(), found)


def bzip2_crc32(column: Column | str) -> Column:
    """Checksum of the format, as a bigint, by an Arrow function."""

    @F.pandas_udf(T.LongType())
    def run(values: pd.Series) -> pd.Series:
        return values.map(lambda v: None if v is None else K.crc32(v)).astype("Int64")

    return run(_binary(column))


def crc32_expr(column: str) -> str:
    """The same checksum of a binary column in SQL alone: eight bit steps a byte. For short values."""
    byte = f"cast(conv(hex(substring({column}, i, 1)), 16, 10) as bigint)"
    step = "if(c & 2147483648 <> 0, ((c * 2) & 4294967295) ^ 79764919, (c * 2) & 4294967295)"
    return (
        f"if(length({column}) = 0, 0L, aggregate(sequence(1, length({column})), 4294967295L, "
        f"(v, i) -> aggregate(sequence(1, 8), v ^ ({byte} * 16777216), (c, k) -> {step}), v -> v ^ 4294967295L))"
    )


def combine_expr(stream: str, block: str) -> str:
    """Checksum of a stream after one more block, in SQL."""
    return f"((({stream}) * 2) & 4294967295 | shiftright({stream}, 31)) ^ ({block})"


def chunk_expr(column: str, size: int) -> str:
    """Array of the pieces of a binary or string column, none for an empty one."""
    return f"if(length({column}) = 0, array(), transform(sequence(0, (length({column}) - 1) div {size}), i -> substring({column}, cast(i * {size} + 1 as int), {size})))"


@F.udtf(returnType="member int, block int, level int, start_bit bigint, end_bit bigint, crc bigint, raw_len bigint")
class Blocks:
    """bz2_blocks(content): one row per block of an archive, and one with block null per member end."""

    def eval(self, content: bytes):
        if content is not None:
            for b in strict.blocks(bytes(content)):
                yield b["member"], b["block"], b["level"], b["start_bit"], b["end_bit"], b["crc"], len(b["out"])


def register(spark: SparkSession) -> None:
    """SQL names: bz2_compress, bz2_decompress, bzip2_crc32, bz2_validate, and the table function bz2_blocks."""

    @F.pandas_udf(T.BinaryType())
    def squeeze(values: pd.Series) -> pd.Series:
        return values.map(lambda v: None if v is None else K.compress(v))

    @F.pandas_udf(T.BinaryType())
    def unfold(values: pd.Series) -> pd.Series:
        return values.map(lambda v: None if v is None else strict.decompress(v))

    @F.pandas_udf(T.LongType())
    def crc(values: pd.Series) -> pd.Series:
        return values.map(lambda v: None if v is None else K.crc32(v)).astype("Int64")

    @F.pandas_udf(T.StringType())
    def code(values: pd.Series) -> pd.Series:
        return values.map(lambda v: None if v is None or (e := strict.validate(v)) is None else e.code)

    for name, f in (("bz2_compress", squeeze), ("bz2_decompress", unfold), ("bzip2_crc32", crc), ("bz2_validate", code)):
        spark.udf.register(name, f)
    spark.udtf.register("bz2_blocks", Blocks)
