"""Words of many texts as numbers: each distinct word of a slice is held once."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.compute

# A text is split in blocks of about this many bytes, so that the words of a long one are never all Python objects.
BLOCK = 1 << 20


def byte_map(separators: bytes, **others: bytes) -> bytes:
    """A table for bytes.translate: A-Z in lower case, `separators` as spaces, and each of `others` as the byte of its value's end."""
    table = bytearray(range(256))
    table[65:91] = range(97, 123)
    for b in separators:
        table[b] = 32
    for group in others.values():
        for b in group[:-1]:
            table[b] = group[-1]
    return bytes(table)


def blocks(raw: bytes) -> Iterator[list[bytes]]:
    """The words of a text whose separators are single spaces, in blocks; empty ones are included."""
    at = 0
    while at < len(raw):
        end = raw.find(b" ", at + BLOCK)
        end = len(raw) if end < 0 else end
        yield raw[at:end].split(b" ")
        at = end + 1


class Ids:
    """Numbers of words in order of their first use; the words given at first have the first numbers."""

    def __init__(self, first: tuple[bytes, ...] = ()):
        self.of: dict[bytes, int] = defaultdict(count(len(first)).__next__, {w: i for i, w in enumerate(first)})

    def __len__(self) -> int:
        return len(self.of)

    def numbers(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.of.__getitem__, words), np.int32, len(words))

    def words(self) -> pa.Array:
        """Each number's word."""
        return pa.array(self.of, pa.binary()).cast(pa.string())


def texts(batch: pa.RecordBatch, column: str = "text") -> list[bytes]:
    """A batch's texts as UTF-8, null as empty."""
    return pa.compute.fill_null(batch[column].cast(pa.binary()), b"").to_pylist()


def summed(keys: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and the sum of each one's weights."""
    if not len(keys):
        return keys, weights
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    return keys[first], np.add.reduceat(weights[order], first)


def counted(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and how often each occurs."""
    keys = np.sort(keys)
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.diff(np.append(first, len(keys)))
