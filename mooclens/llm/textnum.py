"""Vectorised text hashing for use inside tasks.

A chunk of documents is laid out as one byte buffer with a space after
each text. Word hashes come from one polynomial prefix sum over the bytes
(arithmetic modulo 2**64 with an odd base, so that a prefix can be divided
out), followed by a bit mixer. Cost is a few nanoseconds a byte and memory
is bounded by the chunk, not by the Arrow batch.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np

CHUNK_BYTES = 1 << 20
BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
PAD = np.uint64(0x2545F4914F6CDD1D)

_powers = np.ones(1, np.uint64)
_inverses = np.ones(1, np.uint64)

SPACES = np.zeros(256, bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32
#: Bytes outside a run of letters: ASCII other than letters.
NOT_LETTERS = np.ones(256, bool)
NOT_LETTERS[0x80:] = False
NOT_LETTERS[ord("a") : ord("z") + 1] = False
NOT_LETTERS[ord("A") : ord("Z") + 1] = False


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit mixer (multiply and xor-shift rounds)."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xA0761D6478BD642F)
    x ^= x >> np.uint64(32)
    return x


def _grown(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers, _inverses
    if len(_powers) < n:
        size = max(n, CHUNK_BYTES + (1 << 17))
        p = np.full(size, BASE, np.uint64)
        p[0] = 1
        _powers = np.cumprod(p, dtype=np.uint64)
        p = np.full(size, INVERSE, np.uint64)
        p[0] = 1
        _inverses = np.cumprod(p, dtype=np.uint64)
    return _powers, _inverses


def as_bytes(column) -> list[bytes]:
    """Arrow string column to UTF-8 bytes; null becomes empty."""
    import pyarrow as pa

    return [x or b"" for x in column.cast(pa.large_binary()).to_pylist()]


def parts(batches: Iterable, column: str, limit: int = 8 << 20) -> Iterator:
    """The batches' rows in batches of about ``limit`` bytes of ``column``:
    what a task derives from a batch stays small, however many rows Spark
    sends at once."""
    import pyarrow.compute as pc

    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        slot = np.cumsum(sizes, dtype=np.int64) // limit
        cuts = [0, *(np.flatnonzero(np.diff(slot)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if b > a:
                yield batch.slice(a, b - a)


def chunks(texts: list[bytes], limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Index ranges of consecutive texts that hold about ``limit`` bytes."""
    first, held = 0, 0
    for i, t in enumerate(texts):
        held += len(t) + 1
        if held >= limit:
            yield first, i + 1
            first, held = i + 1, 0
    if first < len(texts):
        yield first, len(texts)


class Layout:
    """Texts as one buffer. ``begin[i]`` is where text i starts; a space
    follows each text."""

    def __init__(self, texts: list[bytes], lower: bool = False):
        self.buf = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
        if lower:
            self.buf = LOWER[self.buf]
        lengths = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
        self.begin = np.concatenate([[0], np.cumsum(lengths)])

    def prefix(self) -> np.ndarray:
        p, _ = _grown(len(self.buf) + 1)
        out = np.zeros(len(self.buf) + 1, np.uint64)
        np.cumsum((self.buf.astype(np.uint64) + np.uint64(1)) * p[: len(self.buf)], out=out[1:])
        return out

    def words(self, breaks: np.ndarray = SPACES) -> tuple[np.ndarray, np.ndarray]:
        """Start and end positions of the words, in order."""
        inside = np.zeros(len(self.buf) + 2, np.int8)
        inside[1:-1] = ~breaks[self.buf]
        edge = np.diff(inside)
        return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)

    def span_hashes(self, start: np.ndarray, end: np.ndarray, prefix: np.ndarray | None = None) -> np.ndarray:
        """64-bit hash of buf[start:end] for each span."""
        c = self.prefix() if prefix is None else prefix
        _, inv = _grown(len(self.buf) + 1)
        h = (c[end] - c[start]) * inv[start]
        return mix(h + (end - start).astype(np.uint64) * PAD)

    def text_of(self, position: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.begin, position, side="right") - 1


def word_hashes(texts: list[bytes], lower: bool, breaks: np.ndarray = SPACES) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of ``texts``, and bounds: the words of text i are
    hashes[bounds[i]:bounds[i + 1]]."""
    lay = Layout(texts, lower)
    start, end = lay.words(breaks)
    bounds = np.searchsorted(start, lay.begin)
    return lay.span_hashes(start, end), bounds


def windows(hashes: np.ndarray, bounds: np.ndarray, width: int, padded: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of word windows of ``width``, and bounds by text.

    A text with fewer words gives its whole sequence as one window; one
    without words gives none. ``padded`` adds the incomplete windows at the
    text's start, so a text of n words has n windows.
    """
    n = len(hashes)
    counts = np.diff(bounds)
    place = np.arange(n) - np.repeat(bounds[:-1], counts)
    out = hashes.copy()
    for k in range(1, width):
        back = np.full(n, PAD, np.uint64)
        back[k:] = hashes[: max(0, n - k)]
        back[place < k] = PAD
        out = out * BASE + mix(back + np.uint64(k))
    out = mix(out)
    if padded:
        return out, bounds
    short_last = (np.repeat(counts, counts) < width) & (place == np.repeat(counts, counts) - 1)
    keep = (place >= width - 1) | short_last
    total = np.concatenate([[0], np.cumsum(keep)])
    return out[keep], total[bounds]
