"""Word splitting, word hashing and stable folds shared by the corpus operators.

A word is a maximal run of bytes outside space and U+0009..U+000D, which is
what ``bytes.split()`` cuts, so texts are handled as UTF-8 bytes throughout.
"""

from __future__ import annotations

import ctypes

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column
from pyspark.sql import functions as F

#: The white space that separates words, as a regular expression class.
WORD_SPACE = r"[\x20\x09-\x0D]+"

#: Odd 64-bit multipliers, one for each place of a shingle.
_MULTIPLIERS = np.array(
    [xxhash.xxh64_intdigest(f"place {i}") | 1 for i in range(64)], dtype=np.uint64
)


#: What operators remember in this process from task to task, by key.
MEMORIES: dict[tuple, dict] = {}


def give_back(keep: tuple | None = None) -> None:
    """Returns freed memory to the system: a Python worker goes from task to task, and what one has used the next may not need.

    Of the ``MEMORIES`` only the one with the key ``keep`` stays.
    """
    for key in [k for k in MEMORIES if k != keep]:
        del MEMORIES[key]
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError, TypeError):  # not this C library
        pass


def slices(batches, rows: int = 500, keep: tuple | None = None):
    """Record batches of at most so many rows, so that what a function makes of one at a time stays small."""
    give_back(keep)
    for batch in batches:
        for begin in range(0, batch.num_rows, rows):
            yield batch.slice(begin, rows)


def fold(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id written as text, modulo ``modulus`` (null id: as the text '')."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))), F.lit(modulus))


class WordHashes(dict):
    """word bytes -> 64-bit hash, remembered for at most ``limit`` words."""

    def __init__(self, limit: int = 200_000):
        super().__init__()
        self.limit = limit

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.limit:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser, so that sums of products spread over all bits."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def shingle_hashes(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hashes of every run of ``width`` words; one hash of all words when there are fewer."""
    n = len(hashes)
    if n == 0:
        return hashes
    if n < width:
        width_used = n
    else:
        width_used = width
    out = np.zeros(n - width_used + 1, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for i in range(width_used):
            out += hashes[i : n - width_used + 1 + i] * _MULTIPLIERS[i]
        return mix(out + np.uint64(width_used))


class RunHashes:
    """Hashes of runs of words of one text, from rolling sums over its word hashes."""

    _BASE = 0x9E3779B97F4A7C15
    _powers = np.ones(1, dtype=np.uint64)
    _inverse = np.ones(1, dtype=np.uint64)

    @classmethod
    def _reach(cls, n: int) -> None:
        if len(cls._powers) <= n:
            size = max(2 * len(cls._powers), n + 1)
            with np.errstate(over="ignore"):
                for name, base in (("_powers", cls._BASE), ("_inverse", pow(cls._BASE, -1, 1 << 64))):
                    steps = np.full(size, base, dtype=np.uint64)
                    steps[0] = 1
                    setattr(cls, name, np.cumprod(steps))

    def __init__(self, hashes: np.ndarray):
        n = len(hashes)
        self._reach(n)
        with np.errstate(over="ignore"):
            self.sums = np.zeros(n + 1, dtype=np.uint64)
            np.cumsum(mix(hashes) * self._powers[:n], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hash of the words start <= i < end, for arrays of both."""
        with np.errstate(over="ignore"):
            return mix((self.sums[end] - self.sums[start]) * self._inverse[start] + (end - start).astype(np.uint64))
