"""A file as a sliceable value of which only the blocks asked for are read."""

from __future__ import annotations

BLOCK = 1 << 16
#: Blocks that are kept; a header's tables are read more than once.
KEPT = 64


def opened(path: str):
    """(file system, name in it) of a path or URI."""
    from pyarrow import fs

    if "://" in path and not path.startswith("file:"):
        return fs.FileSystem.from_uri(path)
    plain = path.removeprefix("file:")
    return fs.LocalFileSystem(), "/" + plain.lstrip("/") if path.startswith("file:") else plain


class Ranged:
    """data[a:b] and len(data), like bytes, on any store that Arrow opens (local, HDFS, object stores)."""

    def __init__(self, path: str):
        store, name = opened(path)
        self.file = store.open_input_file(name)
        self.size = self.file.size()
        self.blocks: dict[int, bytes] = {}

    def __len__(self) -> int:
        return self.size

    def __getitem__(self, span: slice) -> bytes:
        start, stop, _ = span.indices(self.size)
        if stop - start > KEPT * BLOCK // 4:
            return self.file.read_at(stop - start, start)
        return b"".join(self._block(k)[max(0, start - k * BLOCK) : stop - k * BLOCK] for k in range(start // BLOCK, -(-stop // BLOCK)))

    def _block(self, k: int) -> bytes:
        if k not in self.blocks:
            if len(self.blocks) >= KEPT:
                self.blocks.pop(next(iter(self.blocks)))
            self.blocks[k] = self.file.read_at(min(BLOCK, self.size - k * BLOCK), k * BLOCK)
        return self.blocks[k]

    def __enter__(self) -> Ranged:
        return self

    def __exit__(self, *_) -> None:
        self.file.close()
