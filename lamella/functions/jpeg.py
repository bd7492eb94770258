"""JPEG streams as bytes: segments, subsampling, shared tables, colour marker. Plain Python on one value; the *_udf forms
work on Arrow batches, and a broken stream gives null, never a failed job."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T  # type objects: a worker that imports this has no session to parse a string

# JPEG markers (ITU-T T.81).
SOI, EOI, SOS, DQT, DHT, APP14 = 0xD8, 0xD9, 0xDA, 0xDB, 0xC4, 0xEE
FRAMES = (0xC0, 0xC1, 0xC2)
STANDALONE = (0x01, *range(0xD0, 0xD9))


def segments(data: bytes):
    """(marker, start, end) of the segments from the start mark on, until the end mark, the scan (whose end is the data's),
    or something that is no marker, as (None, start, end). A segment that the data cut off has an end beyond them."""
    at = 2
    while at + 2 <= len(data):
        if data[at] != 0xFF:
            yield None, at, len(data)
            return
        marker = data[at + 1]
        if marker == EOI:
            return
        if marker == SOS:
            yield SOS, at, len(data)
            return
        if marker == SOI:
            at += 2
            continue
        size = int.from_bytes(data[at + 2 : at + 4], "big") if at + 4 <= len(data) else len(data)
        yield marker, at, at + 2 + size
        at += 2 + size


def subsampling(data: bytes | None) -> tuple[int, int] | None:
    """Horizontal and vertical sampling of the first component relative to the second, from the first frame header;
    nothing behind that is looked at."""
    data = data or b""
    if data[:2] != b"\xff\xd8":
        return None
    for marker, start, end in _plain(data):
        if marker is None or end - start < 4:
            return None
        if marker in FRAMES:
            body = data[start + 4 :]
            if len(body) < 11 or body[5] < 2 or len(body) < 6 + 3 * body[5]:
                return None
            (h0, v0), (h1, v1) = divmod(body[7], 16), divmod(body[10], 16)
            return (h0 // h1, v0 // v1) if h1 and v1 else None
    return None


def _plain(data: bytes):
    """Like segments, but markers without a length (restarts, start, temporary) are passed over, and a scan's header is one
    more segment."""
    at = 2
    while at + 2 <= len(data):
        marker = data[at + 1]
        if data[at] != 0xFF:
            yield None, at, at
            return
        if marker == EOI:
            return
        if marker in STANDALONE:
            at += 2
            continue
        end = at + 2 + (int.from_bytes(data[at + 2 : at + 4], "big") if at + 4 <= len(data) else 0)
        yield marker, at, end
        at = end


def split(data: bytes | None) -> tuple[bytes, bytes] | None:
    """(tables, tile): quantisation and Huffman tables as a stream of their own, and the rest without application data.
    Without a scan the tile has what headers there are; None if a segment is cut off or the data are no JPEG stream."""
    data = data or b""
    if len(data) < 4 or data[:2] != b"\xff\xd8":
        return None
    tables, rest = b"", b""
    for marker, start, end in segments(data):
        if end > len(data):
            return None
        if marker in (DQT, DHT):
            tables += data[start:end]
        elif marker is None or not 0xE0 <= marker <= 0xEF:
            rest += data[start:end]
    return b"\xff\xd8" + tables + b"\xff\xd9", b"\xff\xd8" + rest


def rejoin(tables: bytes | None, tile: bytes | None, rgb: bool = False) -> bytes | None:
    """A whole stream again; rgb adds the marker that says that the samples are not YCbCr."""
    if not tables or not tile or tables[:2] != b"\xff\xd8" or tile[:2] != b"\xff\xd8":
        return None
    head = tables[:-2] if tables.endswith(b"\xff\xd9") else tables
    adobe = b"\xff\xee\x00\x0eAdobe\x00\x64\x00\x00\x00\x00\x00" if rgb else b""
    return head + adobe + tile[2:]


def app14_transform(data: bytes | None) -> int | None:
    """The colour transform of the first APP14 marker, if it is Adobe's."""
    at = (data or b"").find(b"\xff\xee")
    if at < 0 or len(data) < at + 16 or data[at + 4 : at + 9] != b"Adobe":
        return None
    return data[at + 15] if data[at + 15] <= 2 else None


@F.pandas_udf(T.StructType([T.StructField("h", T.IntegerType()), T.StructField("v", T.IntegerType())]))
def subsampling_udf(data: pd.Series) -> pd.DataFrame:
    found = [subsampling(x) or (None, None) for x in data]
    return pd.DataFrame({"h": pd.array([h for h, _ in found], "Int32"), "v": pd.array([v for _, v in found], "Int32")})


@F.pandas_udf(T.StructType([T.StructField("tables", T.BinaryType()), T.StructField("tile", T.BinaryType())]))
def split_udf(data: pd.Series) -> pd.DataFrame:
    found = [split(x) or (None, None) for x in data]
    return pd.DataFrame(found, columns=["tables", "tile"], dtype=object)


@F.pandas_udf(T.BinaryType())
def rejoin_udf(tables: pd.Series, tile: pd.Series) -> pd.Series:
    return pd.Series([rejoin(a, b) for a, b in zip(tables, tile)], dtype=object)


def resize_plane(pixels: np.ndarray, out_h: int, out_w: int, kernel: str) -> np.ndarray:
    """An image (h, w, ...) resized by a named kernel: two matrix products, for tiles of hundreds of pixels."""
    from lamella.operators.kernels import kernel_weights

    def matrix(size: int, out: int) -> np.ndarray:
        m = np.zeros((out, size))
        for i, row in enumerate(kernel_weights(kernel, size, out)):
            for k, w in row:
                m[i, k] = w
        return m

    rows, cols = matrix(pixels.shape[0], out_h), matrix(pixels.shape[1], out_w)
    return np.clip(np.floor(np.einsum("yh,hw...,xw->yx...", rows, pixels.astype(float), cols) + 0.5), 0, 255).astype(np.uint8)
