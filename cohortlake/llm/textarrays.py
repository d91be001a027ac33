"""Whole texts as flat arrays: code points, words, shingles and their hashes.

A run of texts is joined into one array, so that every step is one numpy call for
about a million characters instead of one call for each text or word.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np

# Characters handled at once; a longer text is a run of its own.
RUN_CHARS = 1 << 20

_STEP = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def mix(values: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit over all others."""
    x = values.astype(np.uint64) + np.uint64((seed * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) % (1 << 64))
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def runs(texts: Sequence[str], limit: int = RUN_CHARS) -> Iterator[tuple[int, list[str]]]:
    """Consecutive texts of about ``limit`` characters, with the place of the first."""
    start, size = 0, 0
    for i, text in enumerate(texts):
        if size and size + len(text) > limit:
            yield start, list(texts[start:i])
            start, size = i, 0
        size += len(text) + 1
    if start < len(texts):
        yield start, list(texts[start:])


def code_points(texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts, a line feed after each, and where each text starts."""
    joined = "".join([part for text in texts for part in (text, "\n")])
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    starts = np.zeros(len(texts) + 1, dtype=np.int64)
    np.cumsum([len(text) + 1 for text in texts], out=starts[1:])
    return codes, starts


def word_bounds(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of every word: a run without space, tab or line control."""
    inside = ~((codes == 32) | ((codes >= 9) & (codes <= 13)))
    edges = np.diff(inside.view(np.int8), prepend=np.int8(0), append=np.int8(0))
    return np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)


class Hasher:
    """Hashes of words in a flat array, from one running sum of weighted code points."""

    def __init__(self) -> None:
        self.powers = np.ones(1, dtype=np.uint64)
        self.inverse = np.ones(1, dtype=np.uint64)

    def _reach(self, size: int) -> None:
        if len(self.powers) < size:
            size = max(size, RUN_CHARS + (RUN_CHARS >> 2))
            for name, step in (("powers", _STEP), ("inverse", _BACK)):
                factors = np.full(size, step, dtype=np.uint64)
                factors[0] = 1
                setattr(self, name, np.cumprod(factors, dtype=np.uint64))

    def words(self, codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """A 64-bit hash per word that depends on its characters alone."""
        self._reach(len(codes))
        sums = np.zeros(len(codes) + 1, dtype=np.uint64)
        values = codes.astype(np.uint64) + np.uint64(1)
        values *= np.uint64(0xD6E8FEB86659FD93)
        values ^= values >> np.uint64(29)
        np.cumsum(values * self.powers[: len(codes)], dtype=np.uint64, out=sums[1:])
        return mix((sums[ends] - sums[starts]) * self.inverse[starts])


def owners(starts: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Which text each place of the flat array belongs to."""
    return np.searchsorted(starts, places, side="right") - 1


def windows(hashes: np.ndarray, owner: np.ndarray, width: int, texts: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``width`` words inside a text, and their texts.

    A text with fewer words, but at least one, gives one window of all its words.
    """
    count = len(hashes)
    mixed = np.zeros(max(count - width + 1, 0), dtype=np.uint64)
    for k in range(width):
        mixed = mixed * _STEP + hashes[k : k + len(mixed)]
    whole = owner[: len(mixed)] == owner[width - 1 : width - 1 + len(mixed)]
    values, places = mix(mixed[whole]), owner[: len(mixed)][whole]
    sizes = np.bincount(owner, minlength=texts)
    short = np.flatnonzero((sizes > 0) & (sizes < width))
    if len(short):
        first = np.searchsorted(owner, short)
        extra = np.zeros(len(short), dtype=np.uint64)
        for k in range(width - 1):
            has = sizes[short] > k
            extra[has] = extra[has] * _STEP + hashes[first[has] + k]
        values = np.concatenate([values, mix(extra, 1 + width)])
        places = np.concatenate([places, short])
        order = np.argsort(places, kind="stable")
        values, places = values[order], places[order]
    return values, places
