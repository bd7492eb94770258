"""Byte-level BPE ids of whole texts by the tokenizers library, with the splitting and the lookups in numpy.

The library cuts a text into pieces (a run of letters, of digits, of white space, of others; a space joins the run
after it) and encodes each alone. Here numpy finds the pieces of a batch, and the library encodes each distinct piece
that a bounded cache doesn't hold. A text with a character that this splitter doesn't class for certain (beyond Latin,
control characters, unusual white space, contractions) goes to the library whole; the ids are the same either way.
"""

from __future__ import annotations

import os
import re
import unicodedata

import numpy as np
import pyarrow as pa

from lamella.llm.textkit import column_bytes, pieces, span_hashes

LETTER, DIGIT, SPACE, OTHER = 0, 1, 2, 3
SLOTS = 1 << 20
POOL = 1 << 22


def _class(c: str) -> int:
    kind = unicodedata.category(c)[0]
    return LETTER if kind == "L" else DIGIT if kind == "N" else OTHER


_ASCII = np.array([SPACE if b in (9, 10, 11, 12, 13, 32) else _class(chr(b)) if b < 128 else OTHER for b in range(256)], np.uint8)
#: U+0080 to U+024F, in two bytes of UTF-8.
_LATIN = np.array([[_class(chr((lead & 0x1F) << 6 | low)) for low in range(64)] for lead in range(0xC2, 0xCA)], np.uint8)
_STRANGE = re.compile(rb"[\x00-\x08\x0e-\x1f\xca-\xff]|\xc2[\x85\xa0]|\xc9[\x90-\xbf]|'[stmdrvl]")
#: Bytes that such a place begins with.
_SUSPECT = np.array([b < 9 or 13 < b < 32 or b in (0x27, 0xC2, 0xC9) or b >= 0xCA for b in range(256)])


class Encoder:
    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # tasks are the parallelism
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        # a text that may hold a special token's string goes to the library whole, which knows what becomes of it
        special = sorted({t.content.encode() for t in self.library.get_added_tokens_decoder().values()})
        self.special = re.compile(b"|".join(map(re.escape, special))) if special else None
        vocabulary = self.library.get_vocab()
        self.size = max(vocabulary.values()) + 1
        self.bytes_of = np.zeros(self.size, np.int64)  # a token is written with one character for each byte
        for token, k in vocabulary.items():
            self.bytes_of[k] = len(token)
        self._clear()

    def _clear(self) -> None:
        self.key = np.zeros(SLOTS, np.uint64)
        self.start, self.count = np.zeros(SLOTS, np.int64), np.zeros(SLOTS, np.int64)
        self.pool, self.used = np.zeros(POOL, np.int32), 0

    def _library(self, texts: list[str]) -> list:
        return [e.ids for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def encode(self, texts: pa.Array, limit: int = 1 << 20):
        """Yields (first text, last text, ids, offsets of the texts in the ids)."""
        buf, off = column_bytes(texts)
        for a, b in pieces(off, limit):
            yield a, b, *self._piecewise(buf[off[a] : off[b]], off[a : b + 1] - off[a])

    def _piecewise(self, buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if _SUSPECT[buf].any():
            raw, n = buf.tobytes(), len(off) - 1
            strange = {int(np.searchsorted(off, m.start(), "right")) - 1 for m in _STRANGE.finditer(raw)}
        else:
            raw, n, strange = b"", len(off) - 1, set()
        if self.special:
            raw = raw or buf.tobytes()
            strange |= {int(np.searchsorted(off, m.start(), "right")) - 1 for m in self.special.finditer(raw)}
        if strange:
            whole = sorted(strange)
            found = dict(zip(whole, self._library([raw[off[d] : off[d + 1]].decode() for d in whole])))
            rest = [d for d in range(n) if d not in strange]
            own = np.concatenate([[0], np.cumsum([off[d + 1] - off[d] for d in rest])]).astype(np.int64)
            kept = np.concatenate([buf[off[d] : off[d + 1]] for d in rest]) if rest else np.zeros(0, np.uint8)
            ids, at = self._numpy(kept, own)
            for k, d in enumerate(rest):
                found[d] = ids[at[k] : at[k + 1]]
            parts = [np.asarray(found[d], np.int32) for d in range(n)]
            return np.concatenate(parts), np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64)
        return self._numpy(buf, off)

    def _numpy(self, buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = len(buf)
        if not n:
            return np.zeros(0, np.int32), np.zeros(len(off), np.int64)
        kind = _ASCII[buf]
        lead = np.flatnonzero(buf >= 0xC2)
        kind[lead] = kind[lead + 1] = _LATIN[buf[lead] - 0xC2, buf[lead + 1] - 0x80]
        edge = np.zeros(n + 1, bool)
        edge[off] = True
        first = edge[:n].copy()
        first[1:] |= kind[1:] != kind[:-1]
        space = kind == SPACE
        joined = np.zeros(n, bool)  # behind a blank of the same text
        joined[1:] = (buf[:-1] == 0x20) & ~edge[1:n]
        last = np.zeros(n, bool)  # white space before another character of the same text
        last[:-1] = space[:-1] & ~space[1:] & ~edge[1:n]
        starts = np.flatnonzero((first & ~(joined & ~space)) | last)
        ends = np.append(starts[1:], n)
        hashes = span_hashes(buf, starts, ends, lower=False)
        slot = (hashes >> np.uint64(44)).astype(np.int64)
        begin, count = self.start[slot], self.count[slot]
        miss = np.flatnonzero(self.key[slot] != hashes)
        if len(miss):
            new, where, back = np.unique(hashes[miss], return_index=True, return_inverse=True)
            if self.used + int((ends - starts)[miss[where]].sum()) > POOL:
                self._clear()
                return self._numpy(buf, off)
            at = miss[where]
            own_start, own_count = self._learn(buf, starts[at], ends[at], kind)
            begin[miss], count[miss] = own_start[back], own_count[back]
            put = (new >> np.uint64(44)).astype(np.int64)
            self.key[put], self.start[put], self.count[put] = new, own_start, own_count
        total = np.concatenate([[0], np.cumsum(count)])
        out = self.pool[np.repeat(begin - total[:-1], count) + np.arange(total[-1])]
        return out, total[np.searchsorted(starts, off)]

    def _learn(self, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of distinct pieces, put into the pool. Blank + letters pieces are encoded many at a time, since the
        library takes them apart again and a token's bytes tell to which piece it belongs."""
        start, count = np.zeros(len(starts), np.int64), np.zeros(len(starts), np.int64)
        word = (buf[starts] == 0x20) & (ends - starts > 1) & (kind[np.minimum(starts + 1, len(buf) - 1)] == LETTER)
        raw = buf.tobytes()
        together = np.flatnonzero(word)
        for a in range(0, len(together), 20_000):
            group = together[a : a + 20_000]
            spans = [raw[starts[k] : ends[k]] for k in group]
            texts = [b"".join(spans[i : i + 500]).decode() for i in range(0, len(spans), 500)]
            ids = np.concatenate([np.asarray(x, np.int32) for x in self._library(texts)])
            at = np.concatenate([[0], np.cumsum(self.bytes_of[ids])])
            cut = np.searchsorted(at, np.concatenate([[0], np.cumsum(ends[group] - starts[group])]))
            start[group], count[group] = self.used + cut[:-1], np.diff(cut)
            self.pool[self.used : self.used + len(ids)] = ids
            self.used += len(ids)
        alone = np.flatnonzero(~word)
        for k, ids in zip(alone, self._library([raw[starts[k] : ends[k]].decode() for k in alone]) if len(alone) else []):
            start[k], count[k] = self.used, len(ids)
            self.pool[self.used : self.used + len(ids)] = ids
            self.used += len(ids)
        return start, count
