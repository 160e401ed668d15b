"""Words, word hashes and shingles of many texts at once, on the bytes of Arrow columns.

Words are runs of ``[^\\x20\\x09-\\x0D]`` with A-Z lower-cased. All separators are ASCII, so working on
UTF-8 bytes gives the same words as working on characters. Hashes depend on the bytes alone: they are
the same in every process and on every machine.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

# Texts are worked on in slices of about this many bytes, which bounds the memory of a task; a longer
# text is a slice of its own.
SLICE_BYTES = 2 << 20

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
WHITE_SPACE = np.zeros(256, dtype=bool)
WHITE_SPACE[[9, 10, 11, 12, 13, 32]] = True
# Everything in ASCII but letters and digits.
NO_LETTERS = np.array([c < 128 and not chr(c).isalnum() for c in range(256)])
_MASKS = np.array([(1 << (8 * n)) - 1 for n in range(9)], dtype=np.uint64)
# Words beyond this many bytes (base64 blobs and the like) are hashed one by one.
_LONG = 128


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: every input bit changes about half of the output bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def constants(n: int, seed: int) -> np.ndarray:
    """``n`` fixed odd 64-bit numbers."""
    base = np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed)
    return mix(base) | np.uint64(1)


def slices(texts: pa.Array, size: int = SLICE_BYTES) -> Iterator[tuple[int, list[bytes]]]:
    """(first row, UTF-8 bytes of consecutive rows); nulls count as empty texts."""
    values = texts.cast(pa.large_binary())
    lengths = np.nan_to_num(np.asarray(pa.compute.binary_length(values).to_numpy(zero_copy_only=False), dtype=float))
    ends = np.cumsum(lengths)
    first = 0
    while first < len(values):
        reached = ends[first - 1] if first else 0.0
        last = max(first + 1, int(np.searchsorted(ends, reached + size, side="right")))
        yield first, [v or b"" for v in values.slice(first, last - first).to_pylist()]
        first = last


class Words:
    """Words of some texts: ``starts``, ``ends`` in ``data`` and, per text, ``bounds`` into them."""

    def __init__(self, texts: list[bytes], separator: np.ndarray = WHITE_SPACE):
        joined = b"\n".join(texts) + b"\n" + bytes(8)
        self.data = _LOWER[np.frombuffer(joined, dtype=np.uint8)]
        word = ~separator[self.data[:-8]]
        edges = np.flatnonzero(word[1:] != word[:-1]) + 1
        if word[0]:
            edges = np.concatenate(([0], edges))
        self.starts, self.ends = edges[::2], edges[1::2]
        lengths = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
        self.text_starts = np.concatenate(([0], np.cumsum(lengths + 1)))
        self.bounds = np.searchsorted(self.starts, self.text_starts)

    def prefix_hashes(self, width: int) -> np.ndarray:
        """One hash per word of its first ``width`` (at most 8) bytes; of shorter words, of all."""
        short = np.minimum(self.ends - self.starts, width)
        part = self._eights()[self.starts] & _MASKS[short]
        return mix(part ^ constants(width, 11)[-1])

    def _eights(self) -> np.ndarray:
        """The eight bytes from each place on as a number."""
        return np.ndarray(len(self.data) - 7, dtype="<u8", buffer=self.data.tobytes(), strides=(1,))

    def hashes(self) -> np.ndarray:
        """One 64-bit hash per word."""
        lengths = self.ends - self.starts
        out = lengths.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        eights = self._eights()
        for chunk in range((_LONG + 7) // 8):
            left = lengths - 8 * chunk
            which = slice(None) if chunk == 0 else np.flatnonzero(left > 0)
            if chunk and not len(which):
                break
            part = eights[self.starts[which] + 8 * chunk] & _MASKS[np.minimum(left[which], 8)]
            out[which] = mix(out[which] ^ part)
        for i in np.flatnonzero(lengths > _LONG):
            out[i] = _hash_bytes(self.data[self.starts[i] : self.ends[i]])
        return out


def _hash_bytes(data: np.ndarray) -> np.uint64:
    padded = np.zeros(-(-len(data) // 8) * 8, dtype=np.uint8)
    padded[: len(data)] = data
    parts = padded.view("<u8")
    place = constants(len(parts), 7)
    return mix(np.array([np.bitwise_xor.reduce(mix(parts + place)) + np.uint64(len(data))], dtype=np.uint64))[0]


_PLACES = constants(64, 101)


def shingles(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all runs of ``width`` words; fewer words form one run; no word, none."""
    n = len(hashes)
    if n == 0:
        return hashes
    if n < width:
        return mix((hashes * _PLACES[:n]).sum(dtype=np.uint64, keepdims=True) + np.uint64(n))
    total = hashes[: n - width + 1] * _PLACES[0]
    for i in range(1, width):
        total += hashes[i : n - width + 1 + i] * _PLACES[i]
    return mix(total + np.uint64(width))
