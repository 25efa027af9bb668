"""Words, lines and their hashes of whole Arrow text columns, by numpy over the UTF-8 bytes.

A word is a maximal run of bytes outside the six ASCII white-space bytes. UTF-8 keeps those bytes
out of every longer code point, so byte positions and code points split at the same places.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_BYTE = np.random.default_rng(20240917).integers(1, 2**64, 256, dtype=np.uint64)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_ODD = np.random.default_rng(11).integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers = np.ones(1, np.uint64)


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (in place on a fresh array)."""
    h = h ^ (h >> np.uint64(32))
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xC2B2AE3D27D4EB4F)
    h ^= h >> np.uint64(32)
    return h


def powers(n: int) -> np.ndarray:
    global _powers
    if len(_powers) < n:
        grown = np.full(max(n, 256), _BASE)
        grown[0] = 1
        _powers = np.multiply.accumulate(grown)
    return _powers


@dataclass
class Words:
    """Words of some documents: bytes, document offsets into them, and each word's place and hash."""

    data: np.ndarray
    offsets: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray  # of each document, the index of its first word; one entry more than documents
    hashes: np.ndarray

    def windows(self, width: int) -> np.ndarray:
        """Hash of the width words from each word on; only those inside one document have a meaning."""
        n = len(self.hashes)
        out = np.zeros(n, np.uint64)
        for k in range(min(width, n)):
            out[: n - k] += self.hashes[k:] * _ODD[k]
        return mix(out + np.uint64(width))


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and offsets; null counts as empty."""
    texts = pc.fill_null(texts, "")
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    offsets = np.frombuffer(texts.buffers()[1], kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]] if raw is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def words(texts: pa.Array, lower: bool = False) -> Words:
    data, offsets = buffers(texts)
    if lower:
        data = LOWER[data]
    inside = ~SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    begin = inside.copy()
    begin[1:] &= SPACE[data[:-1]] | edge[1:-1]
    stop = inside.copy()
    stop[:-1] &= SPACE[data[1:]] | edge[1:-1]
    starts, ends = np.flatnonzero(begin), np.flatnonzero(stop) + 1
    lengths = ends - starts
    if len(starts):
        run = np.concatenate(([0], np.cumsum(lengths)[:-1]))
        within = np.arange(run[-1] + lengths[-1]) - np.repeat(run, lengths)
        values = _BYTE[data[inside]] * powers(int(lengths.max()))[within]
        hashes = mix(np.add.reduceat(values, run) + lengths.astype(np.uint64))
    else:
        hashes = np.zeros(0, np.uint64)
    return Words(data, offsets, starts, ends, np.searchsorted(starts, offsets), hashes)


def slices(batch: pa.RecordBatch, column: str, limit: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with about limit bytes of text each, one row at least."""
    lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    total, at = np.cumsum(lengths), 0
    while at < batch.num_rows:
        done = total[at - 1] if at else 0
        upto = max(at + 1, int(np.searchsorted(total, done + limit, "right")))
        yield batch.slice(at, upto - at)
        at = upto
