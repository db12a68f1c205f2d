"""Command line: compress, decompress, test. Exit status 0, 1 for bad data or files, 2 for usage."""

from __future__ import annotations

import argparse
import contextlib
import os
import sys
import tempfile
from collections.abc import Iterator

from blockloom import __version__
from blockloom.errors import BlockError
from blockloom.functions import encoder, strict, threads
from blockloom.functions import kernels as K
from blockloom.options import DecodeOptions, EncodeOptions, parse_concurrency
from blockloom.streaming.chunks import StreamDecoder


PIECE = 1 << 20


def _parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="blockloom", allow_abbrev=False)
    top.add_argument("--version", action="version", version=f"blockloom {__version__}")
    commands = top.add_subparsers(dest="command", required=True)
    for name in ("compress", "decompress", "test"):
        c = commands.add_parser(name, allow_abbrev=False)
        c.add_argument("input", nargs="?", default="-")
        c.add_argument("--concurrency", default="1")
        c.add_argument("--backend", choices=("fast", "strict"), default="fast")
        if name != "test":
            c.add_argument("-o", "--output")
            c.add_argument("-f", "--force", action="store_true")
        if name == "compress":
            c.add_argument("-b", "--block-size", type=int, default=9)
        else:
            c.add_argument("--max-output-bytes", type=int)
    return top


def _pieces(f, size: int) -> Iterator[bytes]:
    while piece := f.read(size):
        yield piece


def _encoded(f, level: int, workers: int, backend: str) -> Iterator[bytes]:
    """The input is read as it is needed: a slice for each block in flight."""
    if backend == "strict":
        yield encoder.compress(f.read(), level)
    else:
        yield from threads.encode(_pieces(f, K.slice_size(level)), level, workers)


def _decoded(f, options: DecodeOptions, workers: int, backend: str) -> Iterator[bytes]:
    """One worker holds a block and what is read of the next one; several, and the strict backend, the whole
    input."""
    if backend == "strict":
        yield from (b["out"] for b in strict.blocks(f.read(), options, backend=backend))
    elif workers > 1:
        yield from (b["out"] for b in threads.blocks(f.read(), options, workers))
    else:
        decoder = StreamDecoder(options)
        for piece in _pieces(f, PIECE):
            yield from decoder.push(piece)
            if decoder.error:
                raise decoder.error
        yield from decoder.finish()
        if decoder.error:
            raise decoder.error


@contextlib.contextmanager
def _sink(output: str | None, force: bool):
    """A file that appears only when whole. Without force it never replaces another one."""
    if output in (None, "-"):
        yield sys.stdout.buffer
        return
    if os.path.exists(output) and not force:
        raise FileExistsError(f"{output} exists")
    handle, temporary = tempfile.mkstemp(dir=os.path.dirname(os.path.abspath(output)), prefix=".blockloom-")
    try:
        with os.fdopen(handle, "wb") as f:
            yield f
        if force:
            os.replace(temporary, output)
        else:
            os.link(temporary, output)
    finally:
        with contextlib.suppress(FileNotFoundError):
            os.unlink(temporary)


def main(argv: list[str] | None = None) -> int:
    try:
        a = _parser().parse_args(argv)
    except SystemExit as e:
        return 0 if e.code == 0 else 2
    try:
        workers = parse_concurrency(a.concurrency if a.concurrency == "auto" else int(a.concurrency), os.cpu_count() or 4)
        coding = EncodeOptions(block_size=a.block_size) if a.command == "compress" else DecodeOptions(max_output_bytes=a.max_output_bytes)
        output = getattr(a, "output", None)
        if getattr(a, "force", False) and output in (None, "-"):
            raise ValueError("--force needs an output file")
        if output not in (None, "-") and a.input != "-" and os.path.exists(output) and os.path.exists(a.input) and os.path.samefile(a.input, output):
            raise ValueError("input and output are the same file")
        if a.command != "test" and output in (None, "-") and sys.stdout.isatty():
            raise ValueError("binary output to a terminal")
    except (TypeError, ValueError) as e:
        print(f"blockloom: {e}", file=sys.stderr)
        return 2
    if workers > 1 and a.command != "compress" and (a.backend == "strict" or a.max_output_bytes is not None) or workers > 1 and a.command == "compress" and a.backend == "strict":
        print("blockloom: --concurrency has no effect with the strict backend or an output limit", file=sys.stderr)
        workers = 1
    try:
        with contextlib.nullcontext(sys.stdin.buffer) if a.input == "-" else open(a.input, "rb") as source:
            if a.command == "test":
                for _ in _decoded(source, coding, workers, a.backend):
                    pass
                return 0
            with _sink(output, a.force) as f:
                for part in _encoded(source, coding.block_size, workers, a.backend) if a.command == "compress" else _decoded(source, coding, workers, a.backend):
                    f.write(part)
    except (OSError, BlockError) as e:
        print(f"blockloom: {e}", file=sys.stderr)
        return 1
    except KeyboardInterrupt:  # what was begun is taken away by the sink
        return 130
    return 0


if __name__ == "__main__":
    sys.exit(main())
