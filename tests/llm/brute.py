"""Plain restatements of the corpus operators that the tests compare with."""

from __future__ import annotations

import xxhash


def simhash(text: str | None, width: int = 3) -> int:
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    runs = [words] if len(words) < width else [words[i : i + width] for i in range(len(words) - width + 1)]
    hashes = [xxhash.xxh64_intdigest(b" ".join(r), 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def classes(ids: list, linked) -> dict:
    """Smallest id reachable from each, by comparing all pairs."""
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            if linked(a, b) and find(a) != find(b):
                lo, hi = sorted((find(a), find(b)))
                parent[hi] = lo
    return {i: find(i) for i in ids}
