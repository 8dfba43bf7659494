"""Hashed words, word shingles and bounded groups of pairs, for operators on similar texts."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bytes of a shingle's hash that are compared when links are confirmed.
KEPT_BYTES = 8

SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
_BASE = 0x9E3779B97F4A7C15
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)


def random_factors(n: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Odd factors and shifts of ``n`` hash functions."""
    rng = np.random.default_rng(seed)
    return tuple(rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1) for _ in range(2))


_LETTERS = random_factors(256, 20240229)[0]


def mixed(h: np.ndarray) -> np.ndarray:
    """The numbers with their bits spread."""
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return h ^ (h >> np.uint64(33))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def least_values(shingles: np.ndarray, factors: np.ndarray, shifts: np.ndarray) -> np.ndarray:
    """For each hash function the least value over a set of shingles, in steps of bounded size."""
    least = np.full(len(factors), np.iinfo(np.uint64).max, dtype=np.uint64)
    for i in range(0, len(shingles), 2048):
        np.minimum(least, (shingles[i : i + 2048, None] * factors + shifts).min(axis=0), out=least)
    return least


class Shingler:
    """Distinct shingle hashes of texts; keeps tables of powers as long as the longest text it has met."""

    def __init__(self, width: int):
        self.width = width
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def cut(self, data: np.ndarray, between: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Hash, first byte and end of each word; ``between`` marks the bytes that part words."""
        n = len(data)
        if n == 0:
            none = np.empty(0, dtype=np.int64)
            return none.astype(np.uint64), none, none
        if n > len(self.up):
            self.up, self.down = _powers(_BASE, 2 * n), _powers(_BASE_INVERSE, 2 * n)
        edges = np.flatnonzero(np.diff(np.concatenate(([True], between[data], [True])).astype(np.int8)))
        starts, ends = edges[::2], edges[1::2]
        sums = np.concatenate((np.zeros(1, dtype=np.uint64), np.cumsum(_LETTERS[data] * self.up[:n], dtype=np.uint64)))
        return mixed((sums[ends] - sums[starts]) * self.down[starts] + (ends - starts).astype(np.uint64)), starts, ends

    def in_order(self, words: np.ndarray) -> np.ndarray:
        """Hashes of the shingles of a row of words, in order; fewer words than a shingle are one."""
        if len(words) == 0:
            return words
        width = min(self.width, len(words))
        out = np.full(len(words) - width + 1, width, dtype=np.uint64)
        for i in range(width):
            out = mixed(out * np.uint64(_BASE) + words[i : len(words) - width + 1 + i])
        return out

    def range_hashes(self, words: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """A hash of the words of each range, in order."""
        n = len(words)
        if n > len(self.up):
            self.up, self.down = _powers(_BASE, 2 * n), _powers(_BASE_INVERSE, 2 * n)
        sums = np.concatenate((np.zeros(1, dtype=np.uint64), np.cumsum(words * self.up[:n], dtype=np.uint64)))
        return mixed((sums[ends] - sums[starts]) * self.down[starts] + (ends - starts).astype(np.uint64))

    def of_words(self, words: np.ndarray) -> np.ndarray:
        """Sorted distinct hashes of the shingles of a row of words."""
        return np.unique(self.in_order(words))

    def of_text(self, text: str | None) -> np.ndarray:
        """Shingles of a text; A-Z count as a-z, and blanks, tabs and line ends part words."""
        data = np.frombuffer((text or "").encode("utf-8").lower(), dtype=np.uint8)
        return self.of_words(self.cut(data, SPACE)[0])

    def packed(self, shingles: np.ndarray) -> bytes:
        """The first bytes of each hash, in order."""
        return shingles.astype(">u8").view(np.uint8).reshape(-1, 8)[:, :KEPT_BYTES].tobytes()


def unpacked(data: bytes) -> np.ndarray:
    wide = np.zeros((len(data) // KEPT_BYTES, 8), dtype=np.uint8)
    wide[:, :KEPT_BYTES] = np.frombuffer(data, dtype=np.uint8).reshape(-1, KEPT_BYTES)
    return wide.view(">u8").ravel().astype(np.uint64)


def shared_count(a: Column, b: Column) -> Column:
    """Size of the intersection of two packed sets."""

    @F.pandas_udf("int")
    def shared(left: pd.Series, right: pd.Series) -> pd.Series:
        counts = [
            len(np.intersect1d(unpacked(x), unpacked(y), assume_unique=True)) for x, y in zip(left, right, strict=True)
        ]
        return pd.Series(counts, dtype="int32")

    return shared(a, b)


def pairs_within(rows: DataFrame) -> DataFrame:
    """All pairs ``u`` < ``v`` of the ids that share a ``region``; for regions that hold a few ids at most."""
    other = rows.select("region", F.col("id").alias("v"))
    return rows.select("region", F.col("id").alias("u")).join(other, "region").filter("u < v").select("u", "v")
