"""Words of many texts at once, as 64-bit hashes, by array operations on their UTF-8 bytes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash

#: Ranges of more bytes are hashed one by one.
LONG = 128
_MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A one-to-one scrambling of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def hashed(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each range of bytes: eight at a time, each scrambled with all before it."""
    eights = np.ndarray((len(data) + 1,), "<u8", np.concatenate([data, np.zeros(8, np.uint8)]), strides=(1,))
    size = end - start
    out = mix(size.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
    for k in range(0, min(LONG, int(size.max(initial=0))), 8):
        at = np.flatnonzero(size > k)
        out[at] = mix((out[at] ^ (eights[start[at] + k] & _MASKS[np.minimum(size[at] - k, 8)])) * np.uint64(0xD6E8FEB86659FD93))
    for k in np.flatnonzero(size > LONG).tolist():
        out[k] = xxhash.xxh3_64_intdigest(data[start[k] : end[k]].tobytes())
    return out


class Words:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a column of texts.

    ``start`` and ``end`` are byte positions in ``data``; ``first`` has, for each text, the position
    of its first word in these arrays, and one more entry at the end; ``hash`` is a 64-bit hash of
    each word's bytes.
    """

    def __init__(self, texts: pa.ChunkedArray | pa.Array, lower: bool = False):
        texts = texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts
        if isinstance(texts, pa.ChunkedArray):  # no chunk at all, or over 2 GB
            texts = pa.concat_arrays([c.cast(pa.large_string()) for c in texts.chunks]) if texts.num_chunks else pa.array([], pa.string())
        kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
        n = len(texts)
        bounds = np.frombuffer(texts.buffers()[1], kind, n + 1, texts.offset * np.dtype(kind).itemsize).astype(np.int64) if n else np.zeros(1, np.int64)
        data = np.frombuffer(texts.buffers()[2], np.uint8)[bounds[0] : bounds[-1]] if n and texts.buffers()[2] is not None else np.zeros(0, np.uint8)
        bounds = bounds - bounds[0]
        if lower:
            data = data + np.uint8(32) * ((data >= 65) & (data <= 90))
        self.data = data
        gap = (data == 32) | ((data >= 9) & (data <= 13))
        opens, closes = ~gap, np.zeros(len(data) + 1, bool)
        closes[1:] = opens
        begin = opens.copy()
        begin[1:] &= gap[:-1]
        inner = bounds[(bounds > 0) & (bounds < len(data))]
        begin[inner] = opens[inner]
        closes[:-1] &= gap
        closes[inner] |= opens[inner - 1]
        self.start, self.end = np.flatnonzero(begin), np.flatnonzero(closes)
        self.first = np.searchsorted(self.start, bounds)
        self.first[-1] = len(self.start)
        self.hash = hashed(data, self.start, self.end)
        self.text_of = np.repeat(np.arange(n), np.diff(self.first))

    def runs(self, length: int) -> np.ndarray:
        """For every word, whether ``length`` words of its text begin there."""
        return np.arange(len(self.start)) + length <= self.first[1:][self.text_of]


def chained(values: np.ndarray, length: int, base: int) -> np.ndarray:
    """A hash of each ``length`` consecutive values, in order; shorter by length - 1."""
    out = np.zeros(max(0, len(values) - length + 1), np.uint64)
    for k in range(length):
        out = mix(out * np.uint64(base) + values[k : k + len(out)])
    return out
