"""DICOM files (PS3.5, PS3.10): elements, sequences and encapsulated frames, from anything that can be sliced like bytes.

Values stay bytes until they are asked for; of the pixel data only the places of its fragments are noted, so a file is
read but for its pixels. Little-endian syntaxes, explicit or implicit, are read; others raise ValueError."""

from __future__ import annotations

import struct
from collections.abc import Iterator

# Tags (group << 16 | element), value representations with a 4-byte length, and the syntax without VRs.
SYNTAX, SOP_CLASS, MODALITY, IMAGE_TYPE, SERIES = 0x00020010, 0x00080016, 0x00080060, 0x00080008, 0x0020000E
SAMPLES, FRAMES, ROWS, COLUMNS, SPACING, PROFILE = 0x00280002, 0x00280008, 0x00280010, 0x00280011, 0x00280030, 0x00282000
VOLUME_WIDTH, VOLUME_HEIGHT, MATRIX_COLUMNS, MATRIX_ROWS = 0x00480001, 0x00480002, 0x00480006, 0x00480007
POWER, OPTICAL_PATHS, PER_FRAME, PLANE, COLUMN_POS, ROW_POS = 0x00480112, 0x00480105, 0x52009230, 0x0048021A, 0x0048021E, 0x0048021F
PHOTOMETRIC, PIXELS = 0x00280004, 0x7FE00010
ITEM, ITEM_END, SEQUENCE_END = 0xFFFEE000, 0xFFFEE00D, 0xFFFEE0DD
LONG_VRS = (b"OB", b"OD", b"OF", b"OL", b"OV", b"OW", b"SQ", b"SV", b"UC", b"UN", b"UR", b"UT", b"UV")
IMPLICIT, DEFLATED, BIG_ENDIAN = "1.2.840.10008.1.2", "1.2.840.10008.1.2.1.99", "1.2.840.10008.1.2.2"
UNDEFINED = 0xFFFFFFFF
#: Sequences whose items are looked into; all others are skipped, by their length if they have one.
WANTED = {OPTICAL_PATHS, PER_FRAME, PLANE}
#: How VRs of binary numbers are read; all others are texts.
_NUMBERS = {b"US": "H", b"SS": "h", b"UL": "I", b"SL": "i", b"FL": "f", b"FD": "d"}


class Dataset(dict):
    """tag: (VR, bytes) of an element, a list of datasets of a sequence, or (offset, length) pairs of pixel fragments
    (None, if pixels are not encapsulated)."""

    def text(self, tag: int) -> str | None:
        """The value as text: of binary numbers their decimal form, several ones separated by backslashes."""
        found = self.get(tag)
        if not isinstance(found, tuple):
            return None
        vr, raw = found
        if vr in _NUMBERS:
            kind = _NUMBERS[vr]
            return "\\".join(map(str, struct.unpack(f"<{len(raw) // struct.calcsize(kind)}{kind}", raw[: len(raw) // struct.calcsize(kind) * struct.calcsize(kind)])))
        return raw.decode("latin-1").rstrip(" \0")

    def number(self, tag: int, kind=int):
        """The trimmed text as a number, None where it is none."""
        try:
            return kind((self.text(tag) or "").strip())
        except ValueError:
            return None

    def first(self, tag: int) -> Dataset | None:
        found = self.get(tag)
        return found[0] if isinstance(found, list) and found else None


class _Cursor:
    def __init__(self, data, at: int, implicit: bool):
        self.data, self.at, self.implicit, self.end = data, at, implicit, len(data)

    def take(self, n: int) -> bytes:
        raw = self.data[self.at : self.at + n]
        if len(raw) < n:
            raise ValueError("the file ends within an element")
        self.at += n
        return raw

    def header(self) -> tuple[int, bytes, int]:
        """Tag, VR, length."""
        group, element = struct.unpack("<HH", self.take(4))
        tag = group << 16 | element
        if group == 0xFFFE or self.implicit:
            return tag, b"", struct.unpack("<I", self.take(4))[0]
        vr = self.take(2)
        if vr in LONG_VRS:
            return tag, vr, struct.unpack("<2xI", self.take(6))[0]
        return tag, vr, struct.unpack("<H", self.take(2))[0]


#: VRs that an implicit file leaves out, of the tags read here.
_IMPLICIT_VR = {
    SAMPLES: b"US", ROWS: b"US", COLUMNS: b"US", MATRIX_COLUMNS: b"UL", MATRIX_ROWS: b"UL", VOLUME_WIDTH: b"FL", VOLUME_HEIGHT: b"FL",
    COLUMN_POS: b"SL", ROW_POS: b"SL", OPTICAL_PATHS: b"SQ", PER_FRAME: b"SQ", PLANE: b"SQ", PROFILE: b"OB", PIXELS: b"OW",
}


def _fragments(c: _Cursor) -> list[tuple[int, int]]:
    """Places of the items of encapsulated pixels, but for the first one, which is the offset table."""
    out = []
    while c.at < c.end:
        tag, _, length = c.header()
        if tag == SEQUENCE_END:
            break
        if tag != ITEM or length == UNDEFINED or c.at + length > c.end:
            raise ValueError("broken fragments")
        out.append((c.at, length))
        c.at += length
    return out[1:]


def _items(c: _Cursor, length: int, keep: bool) -> list[Dataset]:
    stop, out = (c.end if length == UNDEFINED else c.at + length), []
    while c.at < stop:
        tag, _, size = c.header()
        if tag == SEQUENCE_END:
            break
        if tag != ITEM:
            raise ValueError("a sequence holds something that is no item")
        own = _dataset(c, c.end if size == UNDEFINED else c.at + size, keep)
        if keep:
            out.append(own)
    return out


def _dataset(c: _Cursor, stop: int, keep: bool = True, group: int | None = None) -> Dataset:
    out = Dataset()
    while c.at < stop and c.at + 8 <= c.end:
        before = c.at
        tag, vr, length = c.header()
        if tag in (ITEM_END, SEQUENCE_END):
            break
        if group is not None and tag >> 16 != group:
            c.at = before
            break
        vr = vr or _IMPLICIT_VR.get(tag, b"SQ" if length == UNDEFINED else b"UN")
        if tag == PIXELS:
            out[tag] = _fragments(c) if length == UNDEFINED else None
            if length != UNDEFINED:
                c.at += length
        elif vr == b"SQ" or length == UNDEFINED:
            if tag not in WANTED and length != UNDEFINED:
                c.at += length
            else:
                found = _items(c, length, keep and tag in WANTED)
                if tag in WANTED:
                    out[tag] = found
        elif keep:
            out[tag] = vr, c.take(length)
        else:
            c.at += length
    return out


def dataset(data) -> tuple[str, Dataset]:
    """Transfer syntax and elements of a file; ValueError if it is no DICOM file or of a syntax that isn't read here."""
    if len(data) < 132 or data[128:132] != b"DICM":
        raise ValueError("not a DICOM file")
    c = _Cursor(data, 132, False)
    syntax = _dataset(c, c.end, group=2).text(SYNTAX) or ""
    if syntax in (DEFLATED, BIG_ENDIAN):
        raise ValueError(f"unsupported transfer syntax {syntax}")
    c.implicit = syntax == IMPLICIT
    return syntax, _dataset(c, c.end)


def profile(found: Dataset) -> bytes | None:
    """The colour profile of the first optical path, else the file's own; an empty one is none."""
    path = found.first(OPTICAL_PATHS)
    for own in (path, found):
        value = own.get(PROFILE) if own is not None else None
        if isinstance(value, tuple) and value[1]:
            return value[1]
    return None


def positions(found: Dataset) -> list[tuple[int, int]] | None:
    """1-based (column, row) of each frame in the whole image; None unless each frame has a place. A number that lacks or
    is none stands for 1."""
    frames = found.get(PER_FRAME)
    if not isinstance(frames, list):
        return None
    places = [f.first(PLANE) for f in frames]
    if any(p is None for p in places):
        return None
    one = lambda p, tag: 1 if (v := p.number(tag)) is None else v
    return [(one(p, COLUMN_POS), one(p, ROW_POS)) for p in places]


def spacing(found: Dataset) -> tuple[float | None, float | None]:
    """Micrometres a pixel, horizontally and vertically: of the imaged volume, or if that lacks a side, of the spacing."""
    width, height = found.number(VOLUME_WIDTH, float), found.number(VOLUME_HEIGHT, float)
    columns, rows = found.number(MATRIX_COLUMNS), found.number(MATRIX_ROWS)
    x = width * 1000 / columns if width is not None and columns else None
    y = height * 1000 / rows if height is not None and rows else None
    if x is None or y is None:
        parts = []
        for part in (found.text(SPACING) or "").split("\\"):
            try:
                parts.append(float(part.strip()))
            except ValueError:
                continue
        if len(parts) >= 2:
            return parts[1] * 1000, parts[0] * 1000
    return x, y


def element(tag: int, vr: bytes, value: bytes | list[bytes]) -> bytes:
    """An explicit little-endian element; a list of datasets' bytes makes a sequence, items and all of defined length."""
    if isinstance(value, list):
        value = b"".join(struct.pack("<HHI", 0xFFFE, 0xE000, len(v)) + v for v in value)
    value += (b"\0" if vr in (b"UI", b"OB") else b" ") * (len(value) % 2)
    head = struct.pack("<HH", tag >> 16, tag & 0xFFFF) + vr
    return head + (struct.pack("<2xI", len(value)) if vr in LONG_VRS else struct.pack("<H", len(value))) + value


def file(syntax: str, elements: list[bytes], fragments: list[bytes]) -> bytes:
    """A file of elements in ascending order of tags, with encapsulated frames."""
    item = lambda v: struct.pack("<HHI", 0xFFFE, 0xE000, len(v)) + v
    meta = element(SYNTAX, b"UI", syntax.encode())
    meta = element(0x00020000, b"UL", struct.pack("<I", len(meta))) + meta
    pixels = struct.pack("<HH2s2xI", PIXELS >> 16, PIXELS & 0xFFFF, b"OB", UNDEFINED)
    return b"\0" * 128 + b"DICM" + meta + b"".join(elements) + pixels + item(b"") + b"".join(map(item, fragments)) + struct.pack("<HHI", 0xFFFE, 0xE0DD, 0)


def frames(found: Dataset) -> Iterator[tuple[int, int | None, int | None, int | None]]:
    """(ordinal, tile index, offset, length) of each frame; without encapsulated pixels there is no place."""
    places, at = found.get(PIXELS) or [], positions(found)
    tile_w, tile_h = found.number(COLUMNS), found.number(ROWS)
    across = -(-(found.number(MATRIX_COLUMNS) or tile_w or 0) // tile_w) if tile_w else 0
    count = len(at) if at is not None else found.number(FRAMES) or 0
    for k in range(count):
        index = k
        if at is not None and tile_w and tile_h:
            column, row = (max(v, 1) - 1 for v in at[k])
            index = row // tile_h * across + column // tile_w
        yield k, index, *(places[k] if k < len(places) else (None, None))
