"""Words of whole texts as hashes, for operators that compare runs of words."""

from __future__ import annotations

from itertools import chain

import numpy as np
import xxhash

#: Odd numbers, so that every word of a run changes its hash.
STEP = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))
STIR = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


class Hashes(dict):
    """A number for each distinct word, and the word's 128-bit hash in two lanes."""

    def __init__(self) -> None:
        self.digests: list[bytes] = []

    def __missing__(self, word: bytes) -> int:
        self[word] = place = len(self.digests)
        self.digests.append(xxhash.xxh3_128_digest(word))
        return place

    def lanes(self) -> tuple[np.ndarray, np.ndarray]:
        both = np.frombuffer(b"".join(self.digests), "<u8").reshape(-1, 2)
        return both[:, 0], both[:, 1]


def words_of(text: str | None) -> list[bytes]:
    """Runs of anything but ASCII white space (0x20, 0x09 to 0x0D), unchanged."""
    return text.encode().split() if text else []


def lanes_of(words: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Both hash lanes of all words of several texts, end to end, and where each text starts (and the last ends)."""
    numbers = Hashes()
    starts = np.zeros(len(words) + 1, np.int64)
    np.cumsum([len(w) for w in words], out=starts[1:])
    places = np.fromiter(map(numbers.__getitem__, chain.from_iterable(words)), np.int64, starts[-1])
    first, second = numbers.lanes()
    return first[places], second[places], starts


def runs(lane: np.ndarray, at: np.ndarray, length: int, which: int = 0) -> np.ndarray:
    """A 64-bit hash of the ``length`` words from each place in ``at``."""
    with np.errstate(over="ignore"):
        found = np.zeros(len(at), np.uint64)
        for j in range(length):
            found = found * STEP[which] + lane[at + j]
        found ^= found >> np.uint64(31)
        found *= STIR[which]
        return found ^ (found >> np.uint64(29))
