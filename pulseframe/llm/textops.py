"""Vectorised word splitting and hashing over Arrow string columns.

A word is a run of ASCII letters, digits or bytes above 127 of the lower-cased text; every other
byte separates. Hashes are 64 bits wide and depend on the bytes alone, so they agree between
tasks, machines and runs. All functions work on whole texts.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
#: Fixed odd multipliers of the mixing functions.
MIX1, MIX2, BASE = U(0xFF51AFD7ED558CCD), U(0xC4CEB9FE1A85EC53), U(0x9E3779B97F4A7C15)
BASE_INVERSE = U(pow(int(BASE), -1, 1 << 64))
#: Texts are worked on in slices of so many bytes; smaller ones are no slower and keep a worker small.
SLICE_BYTES = 1 << 20

_word_byte = np.zeros(256, dtype=bool)
_word_byte[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values with good avalanche."""
    h = h ^ (h >> U(33))
    h = h * MIX1
    h ^= h >> U(29)
    h *= MIX2
    h ^= h >> U(32)
    return h


_byte_value = mix(np.arange(1, 257, dtype=np.uint64) * BASE)
_powers: dict[str, np.ndarray] = {}


def _power(base: np.uint64, name: str, n: int) -> np.ndarray:
    have = _powers.get(name)
    if have is None or len(have) < n:
        steps = np.full(max(n, SLICE_BYTES + 1), base, dtype=np.uint64)
        steps[0] = 1
        have = _powers[name] = np.multiply.accumulate(steps)
    return have[:n]


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and its n + 1 offsets; null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    if len(texts) == 0 or texts.buffers()[2] is None:
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    data = np.frombuffer(texts.buffers()[2], dtype=np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def give_back_memory() -> None:
    """Workers live on between tasks; what a task has freed goes back to the machine, where the C library can do that."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut record batches so that each holds about `most` bytes of `column`; a longer text comes alone."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        total, at = np.cumsum(sizes), 0
        while at < batch.num_rows:
            before = total[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(total, before + most, side="right")))
            yield batch.slice(at, to - at)
            at = to
    give_back_memory()


class Words:
    """The words of a batch of texts: hash, text number, start and end byte of each."""

    def __init__(self, texts: pa.Array, lower: bool = True):
        if lower:
            texts = pc.utf8_lower(texts)
        self.data, self.offsets = buffers(texts)
        self.n_texts = len(self.offsets) - 1
        n = len(self.data)
        inside = _word_byte[self.data]
        before = np.zeros(n + 1, dtype=bool)
        before[1:] = inside
        before[self.offsets] = False  # a text never continues its neighbour's last word
        after = np.zeros(n + 1, dtype=bool)
        after[:-1] = inside
        after[self.offsets] = False
        self.start = np.flatnonzero(inside & ~before[:n])
        self.end = np.flatnonzero(inside & ~after[1:]) + 1
        self.text_of = np.searchsorted(self.offsets, self.start, side="right") - 1
        self.hash = span_hash(self.data, self.start, self.end)
        self.first = np.searchsorted(self.start, self.offsets)  # word number at which each text begins

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def windows(self, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Hash, text number and first word number of each run of `width` words of a text; a shorter text
        with words has one window, all its words. Text numbers ascend."""
        n, h = len(self.hash), self.hash
        if n == 0:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        keys = mix(np.arange(1, width + 1, dtype=np.uint64) * MIX2) | U(1)
        whole = max(0, n - width + 1)
        total = np.zeros(whole, dtype=np.uint64)
        for j in range(width):
            total += h[j : j + whole] * keys[j]
        at = np.flatnonzero(self.text_of[:whole] == self.text_of[width - 1 :])
        total, of = mix(total[at]), self.text_of[at]
        counts = self.counts()
        short = np.flatnonzero((counts > 0) & (counts < width))
        if len(short):
            begin, size, extra = self.first[short], counts[short], np.zeros(len(short), dtype=np.uint64)
            for j in range(width - 1):
                has = size > j
                extra[has] += h[begin[has] + j] * keys[j]
            total, of, at = np.concatenate([total, mix(extra + size.astype(np.uint64))]), np.concatenate([of, short]), np.concatenate([at, begin])
            order = np.argsort(of, kind="stable")
            total, of, at = total[order], of[order], at[order]
        return total, of, at


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """Running sums from which `span_hash` of any span is one subtraction."""
    total = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(_byte_value[data] * _power(BASE, "up", len(data)), out=total[1:])
    return total


def span_hash(data: np.ndarray, start: np.ndarray, end: np.ndarray, total: np.ndarray | None = None) -> np.ndarray:
    """64-bit hash of each span of bytes; equal bytes have equal hashes wherever they stand."""
    if len(start) == 0:
        return np.zeros(0, np.uint64)
    total = prefix_hash(data) if total is None else total
    back = _power(BASE_INVERSE, "down", len(data) + 1)
    return mix((total[end] - total[start]) * back[start] + (end - start).astype(np.uint64))


def unique_in_texts(of: np.ndarray, values: np.ndarray, n_texts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct values of each text with their counts, sorted by text and value."""
    if len(values) == 0:
        return of, values, np.zeros(0, np.int64)
    out, counts, owner = [], [], []
    bounds = np.searchsorted(of, np.arange(n_texts + 1))
    for i in np.flatnonzero(np.diff(bounds)):
        part = np.sort(values[bounds[i] : bounds[i + 1]])
        edge = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
        out.append(part[edge])
        counts.append(np.diff(np.append(edge, len(part))))
        owner.append(np.full(len(edge), i))
    return np.concatenate(owner), np.concatenate(out), np.concatenate(counts)
