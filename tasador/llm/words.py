"""Hashed words and word shingles of whole texts, vectorised over the bytes of one text."""

from __future__ import annotations

import numpy as np

_rng = np.random.default_rng(20240229)
_LETTERS = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(int(_BASE), -1, 2**64))
_STEP = np.uint64(0xD1342543DE82EF95)

_lower = np.arange(256, dtype=np.uint8)
_lower[ord("A") : ord("Z") + 1] += 32
_VALUES = _LETTERS[_lower]
_WORD = np.ones(256, np.uint8)
_WORD[[0x20, *range(0x09, 0x0E)]] = 0
_TOKEN = np.array([1 if c >= 0x80 or chr(c).isalnum() else 2 if 0x20 < c < 0x7F else 0 for c in range(256)], np.uint8)

_powers = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, at least ``n`` of each."""
    if len(_powers["up"]) < n:
        size = 1 << int(n - 1).bit_length()
        for name, base in (("up", _BASE), ("down", _BACK)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[name] = np.cumprod(steps)
    return _powers["up"], _powers["down"]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _run_hashes(raw: np.ndarray, values: np.ndarray, kinds: np.ndarray) -> np.ndarray:
    """One hash per longest run of bytes of one kind; kind 0 separates."""
    if not len(raw):
        return np.empty(0, np.uint64)
    kind = kinds[raw]
    turns = np.flatnonzero(kind[1:] != kind[:-1]) + 1
    starts = np.concatenate(([0], turns))
    ends = np.concatenate((turns, [len(raw)]))
    used = kind[starts] != 0
    starts, ends = starts[used], ends[used]
    up, down = _power(len(raw))
    total = np.empty(len(raw) + 1, np.uint64)
    total[0] = 0
    np.cumsum(values[raw] * up[: len(raw)], out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts])


def word_hashes(text: str) -> np.ndarray:
    """One 64-bit hash per word, in order: A-Z lower-cased, words split at blanks and \\t to \\r."""
    return _run_hashes(np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8), _VALUES, _WORD)


def token_hashes(text: str) -> np.ndarray:
    """One 64-bit hash per run of letters and digits and per run of ASCII marks; case counts."""
    return _run_hashes(np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8), _LETTERS, _TOKEN)


def shingles(text: str | None, size: int) -> np.ndarray:
    """Sorted distinct hashes of runs of ``size`` words; fewer words count as one run; none without words."""
    words = word_hashes(text) if text else np.empty(0, np.uint64)
    if not len(words):
        return words
    n = max(1, len(words) - size + 1)
    runs = np.zeros(n, np.uint64)
    for j in range(min(size, len(words))):
        runs = runs * _STEP + words[j : j + n]
    return np.unique(mix(runs + np.uint64(min(size, len(words)))))
