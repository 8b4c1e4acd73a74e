"""A 64-bit generator whose draws are reproducible anywhere, and unbiased bounded draws."""

from __future__ import annotations

MASK = (1 << 64) - 1


class SplitMix64:
    def __init__(self, seed: int):
        self.state = seed & MASK

    def next(self) -> int:
        self.state = (self.state + 0x9E3779B97F4A7C15) & MASK
        x = self.state
        x = (x ^ (x >> 30)) * 0xBF58476D1CE4E5B9 & MASK
        x = (x ^ (x >> 27)) * 0x94D049BB133111EB & MASK
        return x ^ (x >> 31)

    def below(self, bound: int) -> int:
        """Uniform in 0 .. bound-1; draws in the short remainder are rejected."""
        least = (1 << 64) % bound
        while (x := self.next()) < least:
            pass
        return x % bound


def bounded_draws(seed: int, bound: int):
    """A function that gives the next so many of ``SplitMix64(seed).below(bound)`` as an array."""
    import numpy as np

    at, least = 0, (1 << 64) % bound

    def draws(count: int) -> np.ndarray:
        nonlocal at
        out = np.empty(0, np.uint64)
        while len(out) < count:
            n = count - len(out)
            x = np.uint64(seed & MASK) + np.arange(at + 1, at + n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
            at += n
            x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
            x ^= x >> np.uint64(31)
            out = np.concatenate((out, x[x >= np.uint64(least)]))
        return (out % np.uint64(bound)).astype(np.int64)

    return draws
