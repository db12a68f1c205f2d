"""Validated options. A wrong type raises TypeError, a value out of range ValueError."""

from __future__ import annotations

import math
from dataclasses import dataclass

SAFE = 2**53 - 1
CHUNK = 65_536


def _whole(name: str, value: object, low: int, high: int = SAFE) -> None:
    if isinstance(value, bool) or not isinstance(value, int):
        raise TypeError(f"{name} must be a whole number")
    if not low <= value <= high:
        raise ValueError(f"{name} must be from {low} to {high}")


def parse_concurrency(value: int | str, cores: int = 4) -> int:
    """'auto' is the number of cores at hand."""
    if value == "auto":
        return cores
    if isinstance(value, str):
        raise TypeError("concurrency must be a whole number or 'auto'")
    _whole("concurrency", value, 1)
    return value


@dataclass(frozen=True)
class EncodeOptions:
    """block_size: 1 to 9, in units of 100,000 bytes. yield_after_ms is checked and has no effect:
    tasks have no shared event loop to yield to."""

    block_size: int = 9
    output_chunk_size: int = CHUNK
    concurrency: int | str = 1
    yield_after_ms: float | None = None

    def __post_init__(self) -> None:
        _whole("block_size", self.block_size, 1, 9)
        _whole("output_chunk_size", self.output_chunk_size, 1)
        parse_concurrency(self.concurrency)
        _check_yield(self.yield_after_ms)


@dataclass(frozen=True)
class DecodeOptions:
    """max_output_bytes None is no limit."""

    concatenated: bool = True
    trailing_data: str = "error"
    max_output_bytes: int | None = None
    output_chunk_size: int = CHUNK
    concurrency: int | str = 1
    yield_after_ms: float | None = None

    def __post_init__(self) -> None:
        if not isinstance(self.concatenated, bool):
            raise TypeError("concatenated must be a boolean")
        if self.trailing_data not in ("error", "ignore"):
            raise TypeError("trailing_data must be 'error' or 'ignore'")
        if self.max_output_bytes is not None:
            _whole("max_output_bytes", self.max_output_bytes, 0)
        _whole("output_chunk_size", self.output_chunk_size, 1)
        parse_concurrency(self.concurrency)
        _check_yield(self.yield_after_ms)


def _check_yield(value: float | None) -> None:
    if value is None:
        return
    if isinstance(value, bool) or not isinstance(value, (int, float)):
        raise TypeError("yield_after_ms must be a number")
    if not math.isfinite(value) or value < 0:
        raise ValueError("yield_after_ms must be finite and not negative")
