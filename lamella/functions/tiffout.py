"""BigTIFF files from tiles that are already encoded (or raw): the directories of one slide as bytes."""

from __future__ import annotations

import struct
from dataclasses import dataclass, field

from lamella.functions import binfmt as B

# TIFF field types and further tags (TIFF 6.0, BigTIFF).
ASCII, SHORT, LONG, RATIONAL, UNDEFINED, LONG8, IFD8 = 2, 3, 4, 5, 7, 16, 18
SUBFILE, BITS, ORIENTATION, PLANAR, TILE_OFFSETS, TILE_COUNTS, JPEG_TABLES = 254, 258, 274, 284, 324, 325, 347
_SIZE = {ASCII: "s", SHORT: "H", LONG: "I", UNDEFINED: "s", LONG8: "Q", IFD8: "Q"}


@dataclass
class Directory:
    """One image: its tiles in row order (None: absent), and whether it hangs under the first directory."""

    width: int
    height: int
    tile: int
    tiles: list
    compression: int = 1
    photometric: int = 1
    samples: int = 1
    subfile: int = 0
    mpp: float = 0.0
    sub: bool = False
    description: str | None = None
    profile: bytes | None = None
    tables: bytes | None = None
    places: list = field(default_factory=list)

    def entries(self, subs: list[int]) -> list[tuple]:
        out = [
            (SUBFILE, LONG, [self.subfile]),
            (B.WIDTH, LONG, [self.width]),
            (B.HEIGHT, LONG, [self.height]),
            (BITS, SHORT, [8] * self.samples),
            (B.COMPRESSION, SHORT, [self.compression]),
            (B.PHOTOMETRIC, SHORT, [self.photometric]),
            (ORIENTATION, SHORT, [1]),
            (B.SAMPLES, SHORT, [self.samples]),
            (PLANAR, SHORT, [1]),
            (B.TILE_W, LONG, [self.tile]),
            (B.TILE_H, LONG, [self.tile]),
            (TILE_OFFSETS, LONG8, [a for a, _ in self.places]),
            (TILE_COUNTS, LONG8, [n for _, n in self.places]),
        ]
        if self.mpp > 0:
            per_cm = (round(1e4 / self.mpp * 1000), 1000)
            out += [(B.X_RES, RATIONAL, per_cm), (B.Y_RES, RATIONAL, per_cm), (B.UNIT, SHORT, [3])]
        if self.description is not None:
            out.append((B.DESCRIPTION, ASCII, self.description.encode() + b"\0"))
        if self.profile:
            out.append((B.PROFILE, UNDEFINED, self.profile))
        if self.tables:
            out.append((JPEG_TABLES, UNDEFINED, self.tables))
        if subs:
            out.append((B.SUB_IFDS, IFD8, subs))
        return sorted(out)


def bigtiff(directories: list[Directory]) -> bytes:
    """The file: header, tiles, then directories, sub-directories first and the main chain from its end."""
    out = bytearray(struct.pack("<2sHHHQ", b"II", 43, 8, 0, 0))
    for d in directories:
        for data in d.tiles:
            d.places.append((len(out), len(data)) if data else (0, 0))
            out += data or b""

    def write(d: Directory, subs: list[int], following: int) -> int:
        rows = []
        for tag, kind, value in d.entries(subs):
            if kind == RATIONAL:
                raw, count = struct.pack("<II", *value), 1
            elif _SIZE[kind] == "s":
                raw, count = value, len(value)
            else:
                raw, count = struct.pack(f"<{len(value)}{_SIZE[kind]}", *value), len(value)
            if len(raw) > 8:
                out.extend(b"\0" * (-len(out) % 8))
                place = len(out)
                out.extend(raw)
                raw = struct.pack("<Q", place)
            rows.append(struct.pack("<HHQ", tag, kind, count) + raw.ljust(8, b"\0"))
        out.extend(b"\0" * (-len(out) % 8))
        at = len(out)
        out.extend(struct.pack("<Q", len(rows)) + b"".join(rows) + struct.pack("<Q", following))
        return at

    subs = [write(d, [], 0) for d in directories if d.sub]
    main, following = [d for d in directories if not d.sub], 0
    for k in range(len(main) - 1, -1, -1):
        following = write(main[k], subs if k == 0 else [], following)
    struct.pack_into("<Q", out, 8, following)
    return bytes(out)
