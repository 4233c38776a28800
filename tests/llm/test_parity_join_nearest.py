import tracemalloc
from collections import Counter

import numpy as np

from catalog_fusion.llm import parity_join
from catalog_fusion.llm.parity_join import _nearest, sketch_distance


def brute_force(sketches, sizes, labels, blocks, low, high):
    found, seen = [], Counter()
    pairs = [(sketch_distance(a, sketches[j]), i, j) for i, a in enumerate(sketches) for j in range(i + 1, len(sketches))]
    for d, i, j in sorted(pairs):
        small, large = sorted((sizes[i], sizes[j]))
        apart = labels[i] != labels[j] and (blocks is None or blocks[i] != blocks[j])
        wide = sorted((len(sketches[i]), len(sketches[j])))
        if apart and 100 * small >= 80 * large and 9 * d <= small + large and wide[1] <= 2 * wide[0]:
            two = tuple(sorted((labels[i], labels[j])))
            if low <= seen[two] < high:
                found.append((d, i, j))
            seen[two] += 1
    return found


def test_pairs_and_ranks_equal_brute_force(monkeypatch):
    rng = np.random.default_rng(5)
    base = rng.integers(0, 1 << 63, 32, dtype=np.uint64)
    sketches = []
    for n in range(90):
        mine = base.copy()
        mine[rng.integers(32, size=4)] ^= np.uint64(1) << rng.integers(0, 63, 4).astype(np.uint64)
        sketches.append(mine[:16] ^ mine[16:] if n % 3 == 0 else mine)
    sizes, labels, blocks = rng.integers(480, 620, 90), rng.integers(-3, 4, 90), rng.integers(0, 2, 90)
    for waiting in (1 << 20, 50):
        monkeypatch.setattr(parity_join, "_WAITING", waiting)
        for low, high in ((0, 4), (4, 1 << 62)):
            for apart in (None, blocks):
                pairs, rank = _nearest(sketches, sizes, labels, apart, high)
                got = pairs[(rank >= low) & (rank < high)].tolist()
                assert sorted(map(tuple, got)) == sorted(brute_force(sketches, sizes, labels, apart, low, high)) and got


def test_two_full_blocks_stay_within_bounds():
    """Millions of near pairs of few components wait in bounded memory."""
    rng = np.random.default_rng(6)
    sketches = list(np.repeat(rng.integers(0, 1 << 63, (1, 16), dtype=np.uint64), 4096, 0))
    labels, blocks = np.arange(4096) % 2, np.arange(4096) // 2048
    tracemalloc.start()
    pairs, rank = _nearest(sketches, np.full(4096, 250), labels, blocks, 16)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(pairs) == 16 and rank.tolist() == list(range(16)) and peak < 300 << 20
