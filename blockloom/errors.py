"""Error codes of archive validation, as an exception and as a Spark struct."""

from __future__ import annotations

# The codes that users of the format's validators switch on.
CODES = (
    "INVALID_MAGIC", "INVALID_BLOCK_SIZE", "INVALID_BLOCK_HEADER", "INVALID_HUFFMAN_TABLE", "BLOCK_OVERFLOW",
    "INVALID_BWT_POINTER", "OUTPUT_LIMIT_EXCEEDED", "BLOCK_CRC_MISMATCH", "STREAM_CRC_MISMATCH", "INVALID_PADDING",
    "TRAILING_DATA", "UNEXPECTED_EOF", "COMPRESSED_BLOCK_TOO_LARGE", "INVALID_STATE",
)

ERROR_TYPE = "struct<code:string,message:string,byte_offset:bigint,bit_offset:int,member:int,block:int,expected:bigint,actual:bigint>"


class BlockError(ValueError):
    """A defect of an archive: what, and at which bit, member and block."""

    def __init__(self, code: str, message: str, bit: int | None = None, member: int | None = None, block: int | None = None, expected: int | None = None, actual: int | None = None) -> None:
        super().__init__(f"{code}: {message}")
        self.code, self.message, self.bit, self.member, self.block, self.expected, self.actual = code, message, bit, member, block, expected, actual

    def row(self) -> dict:
        at = (None, None) if self.bit is None else divmod(self.bit, 8)
        return {"code": self.code, "message": self.message, "byte_offset": at[0], "bit_offset": at[1], "member": self.member, "block": self.block, "expected": self.expected, "actual": self.actual}

    def __reduce__(self):
        return BlockError, (self.code, self.message, self.bit, self.member, self.block, self.expected, self.actual)
