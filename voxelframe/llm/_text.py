"""Words and hashes of many texts at a time, on the bytes of Arrow string columns."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x.astype(U, copy=True)
    with np.errstate(over="ignore"):
        x ^= x >> U(33)
        x *= U(0xFF51AFD7ED558CCD)
        x ^= x >> U(33)
        x *= U(0xC4CEB9FE1A85EC53)
        x ^= x >> U(33)
    return x


_BASE = 0x9E3779B97F4A7C15
_CODES = mix(np.arange(1, 257, dtype=U) * U(_BASE))
_SLOTS = mix(np.arange(1000, 1064, dtype=U) * U(_BASE)) | U(1)
_POWERS = {"up": np.ones(1, U), "down": np.ones(1, U)}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS["up"]) < n:
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            steps = np.full(max(n, 1 << 20), base, U)
            steps[0] = 1
            with np.errstate(over="ignore"):
                _POWERS[name] = np.multiply.accumulate(steps)
    return _POWERS["up"][:n], _POWERS["down"][:n]


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int) -> Iterator[tuple[pa.RecordBatch, pa.Array]]:
    """Pieces of whole rows with about `limit` bytes of text each, and that column without nulls."""
    for batch in batches:
        texts = batch.column(batch.schema.get_field_index(column)).cast(pa.large_string()).fill_null("")
        ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
        at = 0
        while at < len(texts):
            to = max(at + 1, int(np.searchsorted(ends, ends[at] + limit, "right")) - 1)
            yield batch.slice(at, to - at), texts.slice(at, to - at)
            at = to


@dataclass
class Words:
    data: np.ndarray  # the texts' bytes, one after the other
    start: np.ndarray  # of each word, in data
    end: np.ndarray
    first: np.ndarray  # number of the first word of each text, and the number of words

    @property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word's bytes."""
        up, down = _powers(len(self.data) + 1)
        with np.errstate(over="ignore"):
            total = np.zeros(len(self.data) + 1, U)
            np.cumsum(_CODES[self.data] * up[:-1], out=total[1:])
            return mix((total[self.end] - total[self.start]) * down[self.start])


def words(texts: pa.Array, separator: np.ndarray, lower: bool) -> Words:
    """Words of a large_string array without nulls; separator: for each byte, whether it parts words. lower: A-Z only."""
    ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    buffer = texts.buffers()[2]
    data = np.frombuffer(buffer, np.uint8)[ends[0] : ends[-1]] if buffer is not None else np.zeros(0, np.uint8)
    ends = ends - ends[0]
    if lower:
        data = LOWER[data]
    part = separator[data]
    begin, close = ~part, ~part
    begin[1:] &= part[:-1]
    close[:-1] &= part[1:]
    inner = ends[(ends > 0) & (ends < len(data))]  # texts also end words
    begin[inner] |= ~part[inner]
    close[inner - 1] |= ~part[inner - 1]
    start = np.flatnonzero(begin)
    return Words(data, start, np.flatnonzero(close) + 1, np.searchsorted(start, ends))


LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
BLANKS = np.zeros(256, bool)
BLANKS[[32, *range(9, 14)]] = True


def runs(w: Words, hashes: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each k consecutive words of one text: number of the first word, hash."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, U)
    doc = w.doc
    at = np.flatnonzero(doc[:n] == doc[k - 1 :])
    total = np.zeros(len(at), U)
    with np.errstate(over="ignore"):
        for j in range(k):
            total += hashes[at + j] * _SLOTS[j]
    return at, mix(total)


def spread(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For groups of these lengths: each member's group, and its place there."""
    group = np.repeat(np.arange(len(lengths)), lengths)
    return group, np.arange(len(group)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
