"""Hashes of the words of many texts at once, by running sums over their bytes."""

from __future__ import annotations

import numpy as np

BASE = 0x9E3779B97F4A7C15 | 1
WHITE = np.zeros(256, dtype=bool)
WHITE[[0x20, *range(0x09, 0x0E)]] = True


def mixed(z: np.ndarray) -> np.ndarray:
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


class Words:
    """The words, between ASCII white space, of some texts: hashes `h`, byte offsets `s` and `e` in `data`, and the texts' bounds.

    Words of text k are those from at[k] to at[k + 1]; its bytes begin at begin[k].
    """

    def __init__(self, texts: list[bytes], powers: Powers, lower: bool = False):
        joined = b"\n".join([*texts, b""])
        self.data = np.frombuffer(joined.lower() if lower else joined, dtype=np.uint8)
        up, down = powers.of(len(self.data))
        edge = np.diff(np.concatenate(([False], ~WHITE[self.data], [False])).astype(np.int8))
        self.s, self.e = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        sums = np.concatenate((np.zeros(1, dtype=np.uint64), np.cumsum((self.data + np.uint64(1)) * down, dtype=np.uint64)))
        self.h = mixed((sums[self.e] - sums[self.s]) * up[self.s] + (self.e - self.s).astype(np.uint64)) if len(self.s) else np.zeros(0, dtype=np.uint64)
        self.begin = np.cumsum([0, *(len(t) + 1 for t in texts)])
        self.at = np.searchsorted(self.s, self.begin)

    def line_starts(self) -> list[np.ndarray]:
        """For each text the numbers of the words at which its physical lines begin, its end included."""
        breaks = np.flatnonzero(self.data == 10)
        first = np.searchsorted(self.s, breaks)
        bounds = np.searchsorted(breaks, self.begin)
        return [np.concatenate(([0], first[a:b] - w)) for a, b, w in zip(bounds[:-1], bounds[1:], self.at[:-1], strict=True)]


class Powers:
    """Powers of the base and of its inverse, kept for the longest text so far."""

    def __init__(self):
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def of(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            for name, base in (("up", BASE), ("down", pow(BASE, -1, 1 << 64))):
                p = np.full(2 * n, base, dtype=np.uint64)
                p[0] = 1
                setattr(self, name, np.multiply.accumulate(p))
        return self.up[:n], self.down[:n]


def batches_of(texts: list[bytes | None], most: int = 500_000):
    """(first, texts): consecutive texts of about `most` bytes together, null as empty."""
    part, size, first = [], 0, 0
    for k, t in enumerate(texts):
        part.append(t or b"")
        size += len(part[-1])
        if size > most:
            yield first, part
            part, size, first = [], 0, k + 1
    if part:
        yield first, part
