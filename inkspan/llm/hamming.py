"""Multi-index of 64-bit fingerprints: all that lie within a radius of a query, by blocks of their bits.

A code is cut into four blocks of 16 bits. If two codes differ in at most r = 4 * a + c bits (c < 4), then they differ in at
most a bits of one of the first c + 1 blocks, or in at most a - 1 bits of one of the others: otherwise the differences would add up
to more than r. So it is enough to look up near values in each block's directory, and every code within the radius is found.
"""

from __future__ import annotations

from functools import cache

import numpy as np

from inkspan.llm.textscan import spread

BLOCKS, BITS = 4, 16
#: Pairs of a query and a code that one step may hold at most.
STEP = 1 << 22


@cache
def ball(bits: int) -> np.ndarray:
    """All 16-bit masks of at most ``bits`` ones."""
    every = np.arange(1 << BITS, dtype=np.uint16)
    return every[np.bitwise_count(every) <= bits]


def shares(radius: int) -> list[int]:
    """Bits in which each block may differ; -1: the block need not be looked at."""
    return [radius // BLOCKS - (b > radius % BLOCKS) for b in range(BLOCKS)]


def block_of(codes: np.ndarray, block: int) -> np.ndarray:
    return (codes >> np.uint64(BITS * block)).astype(np.uint16)


class HammingIndex:
    """Codes by the values of their blocks."""

    def __init__(self, codes: np.ndarray):
        self.codes = codes
        self.directories = []
        for b in range(BLOCKS):
            value = block_of(codes, b)
            order = np.argsort(value, kind="stable")
            keys, first = np.unique(value[order], return_index=True)
            self.directories.append((keys, np.append(first, len(codes)), order))

    def near(self, queries: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """(query, code): positions of all pairs that differ in at most ``radius`` bits, by query."""
        step = max(1, STEP // max(1, len(self.codes), len(ball(min(max(shares(radius)), BITS)))))
        found = [self._near(queries[at : at + step], radius) + at * len(self.codes) for at in range(0, len(queries), step)] if len(self.codes) else []
        return np.divmod(np.concatenate(found), len(self.codes)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64))

    def _near(self, queries: np.ndarray, radius: int) -> np.ndarray:
        """Sorted query * codes + code of the pairs."""
        pairs = [np.zeros(0, np.int64)]
        for b, share in enumerate(shares(radius)):
            if share < 0:
                continue
            values, back, times = np.unique(block_of(queries, b), return_inverse=True, return_counts=True)
            value, key = self._keys(b, values, min(share, BITS))
            # each query that has the value, with each code that has the key
            asked, of_value = np.argsort(back, kind="stable"), np.cumsum(times) - times
            one, at = spread(of_value[value], times[value])
            query, key = asked[at], key[one]
            _, first, order = self.directories[b]
            one, at = spread(first[key], first[key + 1] - first[key])
            query, code = query[one], order[at]
            close = np.bitwise_count(queries[query] ^ self.codes[code]) <= radius
            pairs.append(query[close] * len(self.codes) + code[close])
        return np.unique(np.concatenate(pairs))

    def _keys(self, block: int, values: np.ndarray, share: int) -> tuple[np.ndarray, np.ndarray]:
        """(value, key): positions of the directory's keys within ``share`` bits of each value; the shorter of directory and ball is walked."""
        keys, masks = self.directories[block][0], ball(share)
        if len(keys) <= len(masks):
            return np.nonzero(np.bitwise_count(values[:, None] ^ keys) <= share)
        probes = values[:, None] ^ masks
        at = np.minimum(np.searchsorted(keys, probes), len(keys) - 1)
        value, mask = np.nonzero(keys[at] == probes)
        return value, at[value, mask]
