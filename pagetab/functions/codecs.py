"""Undo content encodings of one response body under a size ceiling; a helper of the body-decode job."""

from __future__ import annotations

import gzip
import io
import zlib

try:
    import zstandard
except ImportError:  # the encoding is then left as a residual
    zstandard = None
try:
    import brotli
except ImportError:
    brotli = None

_CHUNK = 1 << 16


class TooLarge(Exception):
    """A decoded body passed the ceiling."""


def _drain(read, ceiling: int) -> tuple[bytes, bool]:
    """Read to the end: (data, whether a damaged tail was dropped after it); a bad start raises."""
    out = bytearray()
    while True:
        try:
            chunk = read(_CHUNK)
        except (OSError, EOFError):
            if out:
                return bytes(out), True
            raise
        if not chunk:
            return bytes(out), False
        out += chunk
        if len(out) > ceiling:
            raise TooLarge


def _gunzip(data: bytes, ceiling: int) -> tuple[bytes, bool]:
    return _drain(gzip.GzipFile(fileobj=io.BytesIO(data)).read1, ceiling)


def _inflate(data: bytes, ceiling: int) -> tuple[bytes, bool]:
    def attempt(window_bits: int) -> tuple[bytes, bool]:
        decoder = zlib.decompressobj(window_bits)
        out = decoder.decompress(data, ceiling + 1)
        if len(out) > ceiling:
            raise TooLarge
        return out, not decoder.eof

    try:
        return attempt(zlib.MAX_WBITS)
    except zlib.error:  # some servers send the stream without its header
        return attempt(-zlib.MAX_WBITS)


def _unzstd(data: bytes, ceiling: int) -> tuple[bytes, bool]:
    try:
        return _drain(zstandard.ZstdDecompressor().stream_reader(io.BytesIO(data), read_across_frames=True).read, ceiling)
    except zstandard.ZstdError as problem:
        raise OSError(str(problem)) from problem


def _unbrotli(data: bytes, ceiling: int) -> tuple[bytes, bool]:
    decoder = brotli.Decompressor()
    out = decoder.process(data, output_buffer_limit=ceiling + 1)
    if len(out) > ceiling:
        raise TooLarge
    return out, not decoder.is_finished()


DECODERS = {"gzip": _gunzip, "x-gzip": _gunzip, "deflate": _inflate}
if zstandard:
    DECODERS["zstd"] = _unzstd
if brotli:
    DECODERS["br"] = _unbrotli


def decode_body(
    body: bytes | None, encodings: str | None, ceiling: int
) -> tuple[bytes | None, str | None, int, str | None, bool]:
    """(body, residual encoding, largest size met while decoding, error, whether a tail was lost).

    Encodings are undone from the last to the first until one is unknown; what
    is left is the residual. On an error the body is null. ``ceiling`` bounds what is
    expanded: a body that passes it is null with a size of one more.
    """
    data = body or b""
    todo = [e.strip() for e in (encodings or "").split(",") if e.strip()]
    peak, cut = 0, False
    try:
        while todo and data and todo[-1].lower() in DECODERS:
            data, lost = DECODERS[todo[-1].lower()](data, ceiling)
            cut |= lost
            todo.pop()
            peak = max(peak, len(data))
    except TooLarge:
        return None, ", ".join(todo), ceiling + 1, None, cut
    except Exception as problem:  # any decoder failure is a property of the row, not of the job
        return None, ", ".join(todo), peak, type(problem).__name__, cut
    return (None if body is None else data), (", ".join(todo) or None), peak, None, cut
