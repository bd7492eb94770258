"""Parsers of binary slide indexes. Each takes bytes and gives rows; None where the data can't be of that format."""

from __future__ import annotations

import struct
from dataclasses import dataclass, field


def number(data: bytes, at: int, kind: str):
    """A little-endian number, or None beyond the end."""
    size = struct.calcsize("<" + kind)
    return struct.unpack("<" + kind, data[at : at + size])[0] if 0 <= at <= len(data) - size else None


# Tags of the tagged container, their types' flags, and the types of values that are read.
IMAGE_FRAME, EXTERNAL_FILES, STACK_NAME, BOUNDARY, SCALE, DOCUMENT, SLIDE = 2002, 2018, 2030, 2053, 2019, 2109, 2062
EXTRA_TAG, EXTENDED, INLINE, KIND = 1 << 27, 1 << 28, 1 << 30, 0xFFFFFF
VOLUMES, NESTED = 0, (1, 2)
LATIN_TEXT, UTF16_TEXT, RECTANGLES, PAIR = 13, 8192, (256, 257, 258, 259), 260


@dataclass
class Pyramid:
    name: str | None = None
    width: int | None = None
    height: int | None = None
    psx: float | None = None
    psy: float | None = None


@dataclass
class _Walk:
    data: bytes
    pyramids: list = field(default_factory=list)
    current: int = -1
    before: int = 0
    fields: list = field(default_factory=list)


def tag_tree(data: bytes, start: int = 8) -> tuple[list[Pyramid], list[tuple[int, int, int, int]]]:
    """Pyramids described by a tagged container, and its (depth, tag, offset, size) fields."""
    walk = _Walk(data)
    _container(walk, start, 0)
    return walk.pyramids, walk.fields


def _container(walk: _Walk, at: int, depth: int) -> int:
    """Walks the container at a place and gives the place behind it, where a sibling may begin."""
    data, total = walk.data, len(walk.data)
    if at + 24 >= total or depth > 64:
        return at
    place, count = at + number(data, at + 8, "q"), number(data, at + 16, "I") & 0xFFFFFFF
    if place < 0:
        return at
    for _ in range(count):
        if place + 16 >= total:
            break
        kind, tag, following, size = struct.unpack("<IiIi", data[place : place + 16])
        body, size = place + 16 + (4 if kind & EXTRA_TAG else 0), max(size, 0)
        if tag < 0:
            return body
        walk.fields.append((depth, tag, body, size))
        if tag == EXTERNAL_FILES and walk.before == IMAGE_FRAME:
            walk.current += 1
            if walk.current == len(walk.pyramids):
                walk.pyramids.append(Pyramid())
        elif tag in (DOCUMENT, SLIDE):
            walk.current = -1
        walk.before = tag
        nested = kind & KIND if kind & EXTENDED else None
        if nested == VOLUMES:
            inner, end = body, min(body + size, total)
            while inner < end and (after := _container(walk, inner, depth + 1)) > inner:
                inner = after
        elif nested in NESTED:
            _container(walk, body, depth + 1)
        elif walk.current >= 0 and not kind & INLINE and size:
            _capture(walk.pyramids[walk.current], tag, kind & KIND, data[body : body + size])
        if not following:  # the container's last field; its size tells where the container ends
            return at + size + 32 if at + size + 32 < total else place
        if at + following >= total:
            break
        place = at + following
    return place


def _capture(p: Pyramid, tag: int, kind: int, raw: bytes) -> None:
    """A value of the type that its tag has; the first one of a pyramid stays."""
    if tag == STACK_NAME and kind in (LATIN_TEXT, UTF16_TEXT) and p.name is None:
        text = raw[: len(raw) // 2 * 2].decode("utf-16-le", "replace") if kind == UTF16_TEXT else raw.decode("latin-1")
        text = text.split("\0")[0].strip()
        p.name = text if text not in ("", "0") else None
    elif tag == BOUNDARY and kind in RECTANGLES and p.width is None and len(raw) >= 16:
        p.width, p.height = (max(v, 0) for v in struct.unpack("<ii", raw[8:16]))
    elif tag == SCALE and kind == PAIR and p.psx is None and len(raw) >= 16:
        p.psx, p.psy = struct.unpack("<dd", raw[:16])


#: Bytes of a sample by pixel type, where not one.
SAMPLE_BYTES = {3: 2, 4: 2, 5: 4, 6: 4, 9: 4, 7: 8, 8: 8, 10: 8}


def tile_stream(data: bytes) -> dict | None:
    """Header of a tile stream and its chunks: (coord, offset, nbytes); a cut table ends early."""
    if len(data) < 48 or data[:3] != b"SIS":
        return None
    n_dim, extra, table, count = number(data, 12, "i"), number(data, 16, "q"), number(data, 32, "q"), number(data, 40, "i")
    if not 1 <= n_dim <= 16 or not 0 <= extra <= len(data) - 160 or data[extra : extra + 3] != b"ETS":
        return None
    head = {k: number(data, extra + d, "i") for k, d in (("pixel_type", 8), ("channels", 12), ("compression", 20), ("tile_w", 28), ("tile_h", 32), ("component_order", 148), ("pyramid", 152))}
    colour = max(head["channels"], 0) * SAMPLE_BYTES.get(head["pixel_type"], 1)
    background = data[extra + 108 : extra + 108 + colour]
    head["background"] = background if len(background) == colour else b""
    size, chunks = 20 + 4 * n_dim, []
    for k in range(max(count, 0)):
        row = data[table + k * size : table + k * size + size] if table >= 0 else b""
        if len(row) < size:
            break
        *coord, offset, nbytes = struct.unpack(f"<4x{n_dim}iqI4x", row)
        chunks.append((coord, offset, nbytes))
    return head | {"n_dim": n_dim, "chunks": chunks}


def first_parsed(blobs, parse):
    """What parse gives for the first of blobs for which it gives anything."""
    return next((found for found in map(parse, blobs) if found is not None), None)


def page_list(data: bytes, root: int) -> list[tuple[int, int, int, int]] | None:
    """(image_index, offset, length, file) records of the linked pages that a root points to; negative ones are dropped.
    A page that points back to an earlier one ends the walk."""
    table = number(data, root, "i")
    head = number(data, table, "i") if table is not None else None
    if head is None or number(data, head, "i") != 0:
        return None
    page, out, seen = number(data, head + 4, "i"), [], set()
    while page is not None and page > 0 and page not in seen:
        seen.add(page)
        count, following = number(data, page, "i"), number(data, page + 4, "i")
        if count is None or count < 0 or page + 8 + 16 * count > len(data):
            return None
        out += [r for r in struct.iter_unpack("<4i", data[page + 8 : page + 8 + 16 * count]) if min(r) >= 0]
        page = following
    return out


def single_record(data: bytes, root: int, record: int) -> tuple[int, int, int] | None:
    """(file, offset, size) of a numbered record."""
    table = number(data, root, "i")
    at = number(data, table + 4 * record, "i") if table is not None else None
    if at is None or number(data, at, "i") != 0:
        return None
    page = number(data, at + 4, "i")
    if page is None or (number(data, page, "i") or 0) < 1:
        return None
    offset, size, file = (number(data, page + d, "i") for d in (16, 20, 24))
    return None if None in (offset, size, file) or min(offset, size, file) < 0 else (file, offset, size)


def position_buffer(data: bytes, count: int) -> list[tuple[int, int]] | None:
    """x, y of 9-byte records; None unless there are exactly as many as positions."""
    return [(x, y) for _, x, y in struct.iter_unpack("<Bii", data)] if len(data) == 9 * count else None


# TIFF tags and the sizes of TIFF field types (TIFF 6.0, BigTIFF).
WIDTH, HEIGHT, COMPRESSION, PHOTOMETRIC, SAMPLES, X_RES, Y_RES, UNIT, TILE_W, TILE_H, SUB_IFDS, DESCRIPTION, PROFILE = 256, 257, 259, 262, 277, 282, 283, 296, 322, 323, 330, 270, 34675
_TYPES = {1: "B", 2: "c", 3: "H", 4: "I", 5: "II", 6: "b", 7: "B", 8: "h", 9: "i", 10: "ii", 11: "f", 12: "d", 13: "I", 16: "Q", 17: "q", 18: "Q"}


def tiff_directories(data: bytes) -> list[dict] | None:
    """Directories of a TIFF or BigTIFF: chain (main, or sub of the first one), number, tags."""
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    if order is None or len(data) < 8:
        return None
    version = struct.unpack(order + "H", data[2:4])[0]
    if version not in (42, 43):
        return None
    big = version == 43
    count_kind, size_kind, entry, inline = ("Q", "Q", 20, 8) if big else ("H", "I", 12, 4)

    def read(kind: str, at: int):
        return struct.unpack(order + kind, data[at : at + struct.calcsize(order + kind)])[0]

    def directory(at: int) -> tuple[dict, int]:
        n, tags = read(count_kind, at), {}
        at += struct.calcsize(count_kind)
        for k in range(n):
            place = at + k * entry
            tag, kind, many = read("H", place), read("H", place + 2), read(size_kind, place + 4)
            unit = _TYPES.get(kind)
            if unit is None:
                continue
            size = struct.calcsize("<" + unit) * many
            where = place + entry - inline
            where = where if size <= inline else read(size_kind, where)
            if where + size > len(data):
                continue
            if kind == 2:
                tags[tag] = data[where : where + size].split(b"\0")[0].decode("utf-8", "replace")
            elif tag == PROFILE:
                tags[tag] = data[where : where + size]
            else:
                values = struct.unpack(f"{order}{many * len(unit)}{unit[0]}", data[where : where + size])
                tags[tag] = [a / b if b else 0.0 for a, b in zip(values[::2], values[1::2])] if kind in (5, 10) else list(values)
        return tags, read(size_kind, at + n * entry)

    out, seen = [], set()
    try:
        at = read(size_kind, 8 if big else 4)
        while at and at not in seen:
            seen.add(at)
            tags, at = directory(at)
            out.append({"chain": "main", "dir": len(out), "tags": tags})
        for k, sub in enumerate(out[0]["tags"].get(SUB_IFDS, []) if out else []):
            if sub not in seen:
                seen.add(sub)
                out.append({"chain": "sub", "dir": k, "tags": directory(sub)[0]})
    except struct.error:
        return None
    return out
