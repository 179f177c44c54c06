"""Words of many texts at once, as numpy views over Arrow buffers.

Tasks work through a batch in pieces of bounded bytes, so that the temporary arrays of a
piece stay small whatever the number of texts in a batch. A piece holds at least one text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

PIECE_BYTES = 2 << 20


def _table(codes) -> np.ndarray:
    flags = np.zeros(256, bool)
    flags[list(codes)] = True
    return flags


# ASCII white space: everything else, bytes of longer characters included, makes up words.
WHITE = _table([0x20, *range(0x09, 0x0E)])
# Everything in ASCII that is neither a letter nor a digit.
NOT_ALNUM = _table(
    [*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]
)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20


def utf8(column) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts, one after the other, and where each begins. Null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, places, data = column.buffers()
    bounds = np.frombuffer(places, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[bounds[0] : bounds[-1]], bounds - bounds[0]


def pieces(bounds: np.ndarray, limit: int = PIECE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of texts of at most `limit` bytes, or of a single text."""
    start, n = 0, len(bounds) - 1
    while start < n:
        end = int(np.searchsorted(bounds, bounds[start] + limit, side="right")) - 1
        yield start, (end := min(n, max(start + 1, end)))
        start = end


@dataclass(frozen=True)
class Words:
    """`data` is the words without what separates them; `first` gives each text's first word."""

    data: np.ndarray
    bounds: np.ndarray
    first: np.ndarray

    def __len__(self) -> int:
        return len(self.bounds) - 1

    @property
    def per_text(self) -> np.ndarray:
        return np.diff(self.first)

    def text_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.per_text)

    def encoded(self) -> tuple[np.ndarray, list[bytes]]:
        """A number for each word, and the distinct words by that number."""
        if not len(self):
            return np.zeros(0, np.int64), []
        places = pa.py_buffer(np.ascontiguousarray(self.bounds, np.int64))
        data = pa.py_buffer(np.ascontiguousarray(self.data))
        found = pa.Array.from_buffers(pa.large_binary(), len(self), [None, places, data])
        found = found.dictionary_encode()
        return found.indices.to_numpy().astype(np.int64), found.dictionary.to_pylist()


def words(
    raw: np.ndarray, bounds: np.ndarray, separators: np.ndarray, lower: bool = False
) -> Words:
    keep = ~separators[raw]
    begin = keep.copy()
    begin[1:] &= ~keep[:-1]
    starts = bounds[:-1][np.diff(bounds) > 0]
    begin[starts] = keep[starts]
    places = np.flatnonzero(begin)
    data = (LOWER[raw] if lower else raw)[keep]
    kept = np.concatenate([[0], np.cumsum(keep, dtype=np.int64)])
    return Words(
        data,
        np.concatenate([kept[places], [len(data)]]),
        np.searchsorted(places, bounds),
    )


def sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Totals of values between neighbouring bounds; empty stretches are 0."""
    total = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return total[bounds[1:]] - total[bounds[:-1]]


def unused(columns: list[str], name: str) -> str:
    """A column name like `name` that a frame does not have yet."""
    taken = {column.lower() for column in columns}
    while name.lower() in taken:
        name += "_"
    return name
