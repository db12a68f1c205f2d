"""Tokenising by pieces: a text is cut at single spaces, and each distinct piece is tokenised
once. The cache is bounded: two generations of at most `most` pieces each."""

from __future__ import annotations

import gc
from collections.abc import Callable, Iterator
from contextlib import contextmanager


class PieceCache:
    def __init__(self, encode: Callable[[list[str]], list], most: int = 350_000, longest: int = 64) -> None:
        self.encode, self.most, self.longest = encode, most, longest
        self.new: dict = {}
        self.old: dict = {}

    def look_up(self, pieces: list[str]) -> list:
        """The value of each piece, in order."""
        out = list(map(self.new.get, pieces))
        absent = [i for i, v in enumerate(out) if v is None]
        if not absent:
            return out
        asked = [pieces[i] for i in absent]
        distinct = dict.fromkeys(asked)
        found = dict(zip(distinct, map(self.old.get, distinct), strict=True))
        rest = [p for p, v in found.items() if v is None]
        found.update(zip(rest, self.encode(rest), strict=True))
        for i, v in zip(absent, map(found.__getitem__, asked), strict=True):
            out[i] = v
        if len(self.new) + len(found) > self.most:
            self.old, self.new = self.new, {}
        if max(map(len, found)) > self.longest:
            found = {p: v for p, v in found.items() if len(p) <= self.longest}
        self.new.update(found)
        return out


@contextmanager
def no_collector() -> Iterator[None]:
    """The garbage collector off: it would walk millions of small values that hold no cycles."""
    on = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if on:
            gc.enable()
