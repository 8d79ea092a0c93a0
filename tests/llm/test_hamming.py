import math

import numpy as np
import pytest

from inkspan.llm import decontamination as dc
from inkspan.llm import hamming


def draw(rng, n):
    return rng.integers(0, 1 << 64, n, dtype=np.uint64, endpoint=False)


@pytest.mark.parametrize("codes", [1, 40, 3000])
def test_every_code_within_the_radius_is_found(codes, monkeypatch):
    """Short directories are walked, long ones are asked for the masks of a ball."""
    rng = np.random.default_rng(codes)
    known = draw(rng, codes)
    known[codes // 2 :] = known[: codes - codes // 2]  # repeated codes
    queries = np.concatenate((draw(rng, 60), known[:20], known[:20]))
    for q in range(60):
        flips = rng.choice(64, q % 26, replace=False)
        queries[q] = known[q % codes] ^ np.bitwise_or.reduce(np.uint64(1) << flips.astype(np.uint64), initial=np.uint64(0))
    apart = np.bitwise_count(queries[:, None] ^ known)
    index = hamming.HammingIndex(known)
    for step in (1 << 22, 7 * codes):
        monkeypatch.setattr(hamming, "STEP", step)
        for radius in (0, 1, 3, 4, 11, 16, 20, 23):
            want = np.nonzero(apart <= radius)
            got = index.near(queries, radius)
            assert got[0].tolist() == want[0].tolist() and got[1].tolist() == want[1].tolist()


def test_an_index_of_nothing():
    none = np.zeros(0, np.uint64)
    assert [len(x) for x in hamming.HammingIndex(none).near(np.arange(3, dtype=np.uint64), 5)] == [0, 0]
    assert [len(x) for x in hamming.HammingIndex(np.arange(3, dtype=np.uint64)).near(none, 5)] == [0, 0]


@pytest.mark.parametrize(("size", "span"), [(5, 4), (9, 9), (16, 16), (26, 26), (60, 60), (60, 50), (150, 150)])
def test_radius_keeps_pairs_at_the_similarity(size, span):
    """Measured distances of random pairs at the similarity have the stated mean and lie within the radius."""
    rng = np.random.default_rng(size + span)
    shared = math.ceil(0.8 * (size + span) / 1.8 - 1e-9)
    apart = []
    for _ in range(2000):
        hashes = draw(rng, size + span - shared)
        apart.append(int(np.bitwise_count(dc.simhash(hashes[:size]) ^ dc.simhash(np.concatenate((hashes[:shared], hashes[size:]))))))
    apart = np.array(apart)
    assert abs(apart.mean() - 64 * dc.flip_chance(size, span, shared)) < 0.35
    assert (apart > dc.radius_of(size, span, 0.8)).mean() <= 0.002
    assert dc.radius_of(7, 7, 0.8) == 0 and dc.radius_of(10, 4, 0.8) == 0
