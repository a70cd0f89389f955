"""Words of many texts at once as arrays: boundaries and 64-bit hashes of words and word runs."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute

_U = np.uint64
# Gives freed memory back to the system where the C library can: workers outlive their stage.
_release = partial(getattr(ctypes.CDLL(None), "malloc_trim", lambda _: 0), 0)
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
SLICE_BYTES = 2_000_000


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads their bits."""
    x = x.astype(_U, copy=True)
    x ^= x >> _U(30)
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


_BYTES = mix(np.arange(1, 257, dtype=_U) * _U(_BASE))
# Powers of the base and of its inverse, for one block of values; those of a block's place are made from the last.
_BLOCK = 1 << 16
_POWERS, _INVERSES = (
    np.multiply.accumulate(np.concatenate([np.ones(1, _U), np.full(_BLOCK, base, _U)])) for base in (_BASE, _INVERSE)
)


def _places(n: int, power: np.uint64) -> np.ndarray:
    """The powers of a whole block, for n blocks."""
    return np.multiply.accumulate(np.concatenate([np.ones(1, _U), np.full(max(n - 1, 0), power, _U)]))


def _runs(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, table: np.ndarray | None = None) -> np.ndarray:
    """Hash of values[start:end], for many runs, from prefix sums modulo 2^64; with `table`, of table[values]."""
    total = np.zeros(len(values) + 1, _U)
    n_blocks = len(values) // _BLOCK + 1
    for i, scale in enumerate(_places(n_blocks, _POWERS[_BLOCK])):
        part = total[i * _BLOCK + 1 : (i + 1) * _BLOCK + 1]
        block = values[i * _BLOCK : (i + 1) * _BLOCK]
        np.multiply(block if table is None else table[block], _POWERS[: len(part)], out=part)
        np.cumsum(part, out=part)
        part *= scale
        part += total[i * _BLOCK]
    out = total[ends]
    out -= total[starts]
    out *= _INVERSES[starts % _BLOCK]
    if n_blocks > 1:
        out *= _places(n_blocks, _INVERSES[_BLOCK])[starts // _BLOCK]
    out += (ends - starts).astype(_U)
    return mix(out)


@dataclass
class Words:
    """Words of some texts, joined by single spaces in `data`; text t has words offsets[t]:offsets[t+1]."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    offsets: np.ndarray
    hashes: np.ndarray

    def windows(self, k: int) -> np.ndarray:
        """Hashes of k consecutive words from every word on; runs over a text's end are included."""
        n = len(self.hashes) - k + 1
        if n <= 0:
            return np.zeros(0, _U)
        at = np.arange(n)
        return _runs(self.hashes, at, at + k)

    def inside(self, k: int) -> np.ndarray:
        """First words of the runs of k words that lie inside one text."""
        counts = np.maximum(np.diff(self.offsets) - k + 1, 0)
        total = int(counts.sum())
        first = np.repeat(self.offsets[:-1] - (np.cumsum(counts) - counts), counts)
        return first + np.arange(total)


def words_of(texts: list[str | None], lower: bool = False, table: bytes | None = None) -> Words:
    """Words are runs of bytes other than ASCII white space; `lower` folds A-Z, `table` maps all bytes."""
    split = []
    for text in texts:
        raw = text.encode("utf-8", "surrogatepass") if text else b""
        raw = raw.lower() if lower else raw.translate(table) if table else raw
        split.append(raw.split())
    offsets = np.zeros(len(split) + 1, np.int64)
    np.cumsum([len(s) for s in split], out=offsets[1:])
    data = np.frombuffer(b"".join(b" ".join(s) + b" " for s in split if s), np.uint8)
    ends = np.flatnonzero(data == 32)
    starts = np.concatenate(([0], ends[:-1] + 1)) if len(ends) else ends
    return Words(data, starts, ends, offsets, _runs(data, starts, ends, _BYTES))


def slices(batch: pa.RecordBatch, column: str = "text", size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with about `size` bytes of text each; one text is never cut."""
    lengths = np.asarray(pa.compute.fill_null(pa.compute.binary_length(batch[column]), 0), np.int64)
    part = np.cumsum(lengths) // size
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(lengths)]
    for a, b in zip(cuts, cuts[1:], strict=False):
        if b > a:
            yield batch.slice(a, b - a)
    pa.default_memory_pool().release_unused()
    _release()
