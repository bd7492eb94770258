"""Whole texts of Arrow batches as numpy arrays: bytes, words, word hashes, shingles.

Everything works on one byte array and the offsets of its documents, a few MB at a time; a document is never cut, so
the longest one bounds the memory of a task (about 60 bytes for each of its bytes).
"""

from __future__ import annotations

import ctypes
import functools
from contextlib import suppress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: The white space of all contracts: space, tab, line feed, vertical tab, form feed, carriage return.
SPACES = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)
IS_SPACE = np.zeros(256, bool)
IS_SPACE[list(SPACES)] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32

_U = np.uint64
_rng = np.random.default_rng(20240229)
_ODD = int(_rng.integers(1 << 62, (1 << 63) - 1)) * 2 + 1
_ODD_INVERSE = pow(_ODD, -1, 1 << 64)
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * _U(2) + _U(1)
_BYTE_LOWER = _BYTE[LOWER]
_SHINGLE = _rng.integers(1, 1 << 63, 64, dtype=np.uint64) * _U(2) + _U(1)
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        have = np.full(max(n, 1 << 16), base, np.uint64)
        have[0] = 1
        _powers[base] = have = np.multiply.accumulate(have)
    return have[:n]


def mix64(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> _U(33))
    x *= _U(0xFF51AFD7ED558CCD)
    x ^= x >> _U(33)
    x *= _U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> _U(33))


_kept: list = []


def kept(key, build):
    """build(), made once in each Python worker for a key. A worker holds one such model at a time: workers live on from
    stage to stage, and would hold those of all stages."""
    if not _kept or _kept[0] != key:
        _kept.clear()
        _kept.extend([key, build()])
    return _kept[1]


def tidy(run):
    """A function over batches that hands its freed memory back to the system at its end, as its worker lives on."""

    @functools.wraps(run)
    def wrapped(batches):
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        with suppress(OSError, AttributeError):  # not with every C library
            ctypes.CDLL(None).malloc_trim(0)

    return wrapped


def column_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts and the offset of each, and of the end; a null text is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    off = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    data = texts.buffers()[2] if len(texts) else None
    buf = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None and off[-1] > off[0] else np.zeros(0, np.uint8)
    return buf, off - off[0]


def pieces(off: np.ndarray, limit: int = 1 << 20):
    """(first, last) document numbers of runs of whole documents with about limit bytes."""
    n, at = len(off) - 1, 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(off, off[at] + limit, "right")) - 1)
        yield at, min(n, to)
        at = min(n, to)


class Words:
    """starts, ends: byte positions of words; first: number of the first word of each document, and of the end."""

    def __init__(self, buf: np.ndarray, off: np.ndarray, lower: bool = True):
        n = len(buf)
        word = ~IS_SPACE[buf]
        edge = np.zeros(n + 1, bool)
        edge[off] = True
        start = word & edge[:n]
        start[1:] |= word[1:] & ~word[:-1]
        end = word & edge[1:]
        end[:-1] |= word[:-1] & ~word[1:]
        self.starts, self.ends = np.flatnonzero(start), np.flatnonzero(end) + 1
        self.first = np.searchsorted(self.starts, off)
        self.buf, self.off, self.lower = buf, off, lower

    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))

    def hashes(self) -> np.ndarray:
        """64-bit hashes of the words, A-Z lower-cased if so asked."""
        return span_hashes(self.buf, self.starts, self.ends, self.lower)


def span_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = True) -> np.ndarray:
    n = len(buf)
    if not len(starts):
        return np.zeros(0, np.uint64)
    total = np.empty(n + 1, np.uint64)
    total[0] = 0
    np.cumsum((_BYTE_LOWER if lower else _BYTE)[buf] * powers(_ODD, n), out=total[1:])
    return mix64((total[ends] - total[starts]) * powers(_ODD_INVERSE, n + 1)[starts] + (ends - starts).astype(np.uint64))


def shingles(hashes: np.ndarray, first: np.ndarray, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of k words in each document (of all its words, if it has fewer), and their documents' numbers."""
    n, docs = len(hashes), np.diff(first)
    doc = np.repeat(np.arange(len(docs)), docs)
    if n >= k:
        total = hashes[: n - k + 1] * _SHINGLE[0]
        for j in range(1, k):
            total += hashes[j : n - k + 1 + j] * _SHINGLE[j]
        inside = doc[: n - k + 1] == doc[k - 1 :]
        out, owner = mix64(total[inside]), doc[: n - k + 1][inside]
    else:
        out, owner = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    short = np.flatnonzero((docs > 0) & (docs < k))
    if len(short):
        own = [mix64(np.array([int(np.sum(hashes[first[d] : first[d + 1]] * _SHINGLE[8 : 8 + docs[d]], dtype=np.uint64))], np.uint64))[0] for d in short]
        out, owner = np.concatenate([out, np.array(own, np.uint64)]), np.concatenate([owner, short])
        order = np.argsort(owner, kind="stable")
        out, owner = out[order], owner[order]
    return out, owner


def distinct_sets(values: np.ndarray, owner: np.ndarray, n_docs: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values of each document, one after the other, and the offsets of the documents."""
    at = np.searchsorted(owner, np.arange(n_docs + 1))
    sets = [np.unique(values[a:b]) for a, b in zip(at[:-1], at[1:])]
    return (np.concatenate(sets) if sets else np.zeros(0, np.uint64)), np.concatenate([[0], np.cumsum([len(s) for s in sets], dtype=np.int64)]).astype(np.int64)
