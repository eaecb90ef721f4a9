"""Hashes of words and of word shingles for many texts at once, in numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

SIZE = 5
SPACES = np.zeros(256, bool)
SPACES[[9, 10, 11, 12, 13, 32]] = True
_RANDOM = np.random.default_rng(20240607)
BYTES = _RANDOM.integers(1, 2**64, 256, np.uint64)
FACTOR = np.uint64(0x9E3779B97F4A7C15)
PLACES = _RANDOM.integers(1, 2**64, SIZE, np.uint64) | np.uint64(1)
LENGTHS = _RANDOM.integers(1, 2**64, SIZE, np.uint64)
CHUNK = 1 << 21


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (the finisher of SplitMix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def grouped(texts: list[str | None], chunk: int = CHUNK) -> Iterator[tuple[int, list[bytes]]]:
    """The texts as bytes with A-Z in lower case, in runs of about ``chunk`` bytes, each with its first number."""
    held: list[bytes] = []
    first = size = 0
    for k, text in enumerate(texts):
        held.append((text or "").encode().lower())
        size += len(held[-1])
        if size >= chunk:
            yield first, held
            held, size, first = [], 0, k + 1
    if held:
        yield first, held


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Per word its hash, the number of its text, its first byte there and its length.

    Words end at ``[\\x20\\x09-\\x0D]``.
    """
    data = np.frombuffer(b" ".join(texts), np.uint8)
    at = np.flatnonzero(~SPACES[data])
    if not len(at):
        none = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), none, none, none
    first = np.flatnonzero(np.diff(at, prepend=-2) > 1)
    lengths = np.diff(first, append=len(at))
    inside = np.arange(len(at)) - np.repeat(first, lengths)
    powers = np.cumprod(np.full(int(lengths.max()), FACTOR, np.uint64))
    hashed = np.add.reduceat(BYTES[data[at]] * powers[inside], first)
    ends = np.cumsum([len(text) + 1 for text in texts])
    of = np.searchsorted(ends, at[first], "right")
    starts = at[first] - np.concatenate([[0], ends])[of]
    return mix(hashed + lengths.astype(np.uint64)), of, starts, lengths


def shingle_sets(texts: list[bytes], size: int = SIZE) -> list[np.ndarray]:
    """Per text the sorted distinct hashes of its ``size``-word shingles.

    A text with fewer words has one shingle, the whole sequence; a text without words has none.
    """
    words, of, *_ = word_hashes(texts)
    counts = np.bincount(of, minlength=len(texts))
    ends = np.cumsum(counts)
    sums = np.zeros(max(0, len(words) - size + 1), np.uint64)
    for k in range(size):
        sums += words[k:k + len(sums)] * PLACES[k]
    sums = mix(sums)
    sets = []
    for n, end in zip(counts.tolist(), ends.tolist()):
        if n >= size:
            sets.append(np.unique(sums[end - n:end - size + 1]))
        elif n:
            sets.append(mix(np.atleast_1d((words[end - n:end] * PLACES[:n]).sum(dtype=np.uint64) ^ LENGTHS[n])))
        else:
            sets.append(np.zeros(0, np.uint64))
    return sets
