"""Hashes of words and of word shingles for whole Arrow batches, by array operations only."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes hashed at once; a batch of any length is taken in such chunks, cut at separators.
CHUNK = 1 << 20
_ODD = np.uint64(0x9E3779B97F4A7C15)


def _random(seed: int, n: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(1, 1 << 63, size=n, dtype=np.uint64) | np.uint64(1)


def byte_table(separators: bytes) -> np.ndarray:
    """A random odd number for each byte value, 0 for separators; A-Z count as a-z."""
    table = _random(71, 256)
    table[ord("A") : ord("Z") + 1] = table[ord("a") : ord("z") + 1]
    table[list(separators)] = 0
    return table


#: Words are runs of ASCII letters, digits and all that is beyond ASCII.
WORDS = byte_table(bytes(b for b in range(128) if not chr(b).isalnum()))
#: Words are runs of anything but ASCII white space.
TOKENS = byte_table(b" \t\n\v\f\r")

_powers: dict[str, np.ndarray] = {}


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers["up"]) < n:
        n = max(n, CHUNK)
        for name, base in (("up", int(_ODD)), ("down", pow(int(_ODD), -1, 1 << 64))):
            steps = np.full(n, np.uint64(base))
            steps[0] = 1
            _powers[name] = np.multiply.accumulate(steps)
    return _powers["up"], _powers["down"]


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def column_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a binary or string column; a null has no bytes."""
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    large = pa.types.is_large_binary(column.type) or pa.types.is_large_string(column.type)
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64 if large else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    data = column.buffers()[2]
    data = np.zeros(0, np.uint8) if data is None else np.frombuffer(data, dtype=np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def word_hashes(data: np.ndarray, offsets: np.ndarray, table: np.ndarray = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words in order, and for each text the index of its first word (one more entry at the end)."""
    n, at, hashes, begins = len(data), 0, [], []
    inner = offsets[1:-1]
    while at < n:
        end = min(at + CHUNK, n)
        if end < n:
            gaps = np.flatnonzero(table[data[at:end]] == 0)
            if len(gaps):
                end = at + int(gaps[-1]) + 1
            else:  # a word longer than a chunk
                while end < n and table[data[end]]:
                    end += 1
        values = table[data[at:end]]
        word = values != 0
        first = np.concatenate(([True], ~word[:-1]))
        first[inner[(inner > at) & (inner < end)] - at] = True  # a text's first byte begins a word
        start = np.flatnonzero(word & first)
        last = np.concatenate((first[1:], [True])) | np.concatenate((~word[1:], [True]))
        stop = np.flatnonzero(word & last) + 1
        up, down = _tables(end - at)
        sums = np.zeros(end - at + 1, dtype=np.uint64)
        np.cumsum(values * up[: end - at], out=sums[1:])
        hashes.append(mix((sums[stop] - sums[start]) * down[start]))
        begins.append(start + at)
        at = end
    found = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
    begin = np.concatenate(begins) if begins else np.zeros(0, np.int64)
    return found, np.searchsorted(begin, offsets)


def shingle_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """Hash of each run of ``width`` words (position i: words i .. i + width - 1)."""
    n = len(words) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = np.zeros(n, dtype=np.uint64)
    for k in range(width):
        total = total * _ODD + words[k : k + n]
    return mix(total)


def slices(batch: pa.RecordBatch, column: int, most_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The batch in parts of at most ``most_bytes`` of the binary or string column (one row at least)."""
    _, offsets = column_bytes(batch.column(column))
    at = 0
    while at < batch.num_rows:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most_bytes, side="right")) - 1)
        yield batch.slice(at, end - at)
        at = end


def spread(first: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each i, ``count[i]`` times i, beside first[i], first[i] + 1, ..."""
    owner = np.repeat(np.arange(len(first)), count)
    return owner, first[owner] + np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)


class HashSet:
    """Positions of 64-bit keys; a bit table turns most other values away first."""

    def __init__(self, keys: np.ndarray, bits: int = 20):
        self.keys = np.unique(keys)
        self._shift = np.uint64(64 - bits)
        self._may = np.zeros(1 << bits, dtype=bool)
        self._may[(self.keys >> self._shift).astype(np.int64)] = True

    def find(self, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(positions in ``values``, positions in ``keys``) of all hits."""
        if not len(self.keys):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = np.flatnonzero(self._may[(values >> self._shift).astype(np.int64)])
        where = np.minimum(np.searchsorted(self.keys, values[at]), len(self.keys) - 1)
        hit = self.keys[where] == values[at]
        return at[hit], where[hit]
