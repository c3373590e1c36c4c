"""Words of whole texts as numpy columns, inside tasks: one pass over the bytes of many documents at once.

A word is a maximal run of bytes other than space and 0x09-0x0D of the UTF-8 text, i.e. ``[^\\x20\\x09-\\x0D]+``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 1 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_BASE_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_IS_SPACE = np.zeros(256, dtype=bool)
_IS_SPACE[[32, 9, 10, 11, 12, 13]] = True


def mixed(h: np.ndarray, salt: int = 0) -> np.ndarray:
    """A 64-bit finaliser, so that every bit of the result depends on every bit of ``h``."""
    h = h ^ np.uint64(salt * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class Powers:
    """Powers of the hash base and of its inverse modulo 2^64, grown on demand."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def to(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 2 * len(self.up))
            steps = np.full(size, _BASE, dtype=np.uint64)
            steps[0] = 1
            self.up = np.cumprod(steps, dtype=np.uint64)
            steps[1:] = _BASE_INVERSE
            self.down = np.cumprod(steps, dtype=np.uint64)
        return self.up, self.down


class Words:
    """Words of several texts: byte offsets into ``data``, and the index of the text of each word."""

    def __init__(self, texts: list[bytes]) -> None:
        self.data = b"\n".join(texts) + b"\n"
        self.n_texts = len(texts)
        self.bytes = np.frombuffer(self.data, dtype=np.uint8)
        space = _IS_SPACE[self.bytes]
        edge = np.flatnonzero(np.diff(space, prepend=True))
        self.start, self.end = edge[::2], edge[1::2]
        lengths = np.fromiter((len(x) + 1 for x in texts), dtype=np.int64, count=len(texts))
        self.offset = np.concatenate([[0], np.cumsum(lengths)])
        self.doc = np.searchsorted(self.offset, self.start, side="right") - 1
        #: The words of text i are first[i] .. first[i + 1].
        self.first = np.searchsorted(self.start, self.offset)

    def __len__(self) -> int:
        return len(self.start)

    def word(self, i: int) -> bytes:
        return self.data[self.start[i] : self.end[i]]

    def hashes(self, powers: Powers) -> np.ndarray:
        """A 64-bit hash of each word's bytes."""
        up, down = powers.to(len(self.bytes) + 1)
        sums = np.zeros(len(self.bytes) + 1, dtype=np.uint64)
        np.cumsum((self.bytes.astype(np.uint64) + np.uint64(1)) * up[: len(self.bytes)], out=sums[1:])
        return mixed((sums[self.end] - sums[self.start]) * down[self.start])


def gram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of ``n`` consecutive word hashes (runs may cross texts; callers mask those)."""
    if len(words) < n:
        return np.zeros(0, dtype=np.uint64)
    out = np.zeros(len(words) - n + 1, dtype=np.uint64)
    for j in range(n):
        out = out * np.uint64(0xD6E8FEB86659FD93) + words[j : j + len(out)]
    return mixed(out, n)


def chunks(texts: list[bytes], limit: int = CHUNK_BYTES) -> Iterator[tuple[int, list[bytes]]]:
    """Consecutive texts of about ``limit`` bytes together (a longer text stands alone), with the first one's index."""
    first, size = 0, 0
    for i, text in enumerate(texts):
        if size and size + len(text) > limit:
            yield first, texts[first:i]
            first, size = i, 0
        size += len(text) + 1
    if first < len(texts):
        yield first, texts[first:]


def slices(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """The batches in small pieces, so that Python objects of few texts exist at a time."""
    for batch in batches:
        for first in range(0, batch.num_rows, rows):
            yield batch.slice(first, rows)


def portions(batches: Iterator[pa.RecordBatch], column: str, limit: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """The batches in pieces of about ``limit`` bytes of ``column`` (a longer value stands alone)."""
    for batch in batches:
        size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        end, first = np.cumsum(size), 0
        while first < batch.num_rows:
            last = max(first + 1, int(np.searchsorted(end, end[first] - size[first] + limit, side="right")))
            yield batch.slice(first, last - first)
            first = last


def utf8(column: pa.Array | pa.ChunkedArray) -> list[bytes]:
    """The texts as bytes; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]
