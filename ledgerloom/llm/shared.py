"""Helpers that several corpus operators use."""

from __future__ import annotations

import hashlib
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.session import stage_table

#: Words are runs of anything but ASCII blanks, tabs and line breaks.
WORD = r"[^\x20\x09-\x0D]+"
BREAK = r"[\x20\x09-\x0D]+"

#: Rows a DataFrame may have, counted first, to be broadcast on purpose.
BROADCAST_ROWS = 500_000

_BASE = 0x9E3779B97F4A7C15
_SEGMENT = 1 << 20
_KNOWN_WORDS = 1 << 15
_powers: dict[str, np.ndarray] = {}


#: Settings while a stage is written: Python gets small batches, since a text or a set may be long.
_WRITING = {
    "spark.sql.execution.arrow.maxRecordsPerBatch": "500",
    "spark.sql.execution.arrow.maxBytesPerBatch": str(4 << 20),
}


def staged(df: DataFrame, purpose: str) -> DataFrame:
    """``df`` written to the shared folder and read back; its shuffle files go with the write."""
    conf = df.sparkSession.conf
    before = {key: conf.get(key) for key in _WRITING}
    try:
        for key, value in _WRITING.items():
            conf.set(key, value)
        return stage_table(df, f"llm-{purpose}", "snappy")
    finally:
        for key, value in before.items():
            conf.set(key, value)


def counted(df: DataFrame, rows: int) -> DataFrame:
    """``df`` to be broadcast if it was counted to have few rows, else left to Spark."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def total(columns: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, columns)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit words."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2**64."""
    if len(_powers.get("up", ())) < n:
        size = max(1 << 17, 1 << (n - 1).bit_length())
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[name] = np.cumprod(steps)
    return _powers["up"][:n], _powers["down"][:n]


def _segments(data: bytes):
    """Cuts at blanks, so that word lists stay small for any length of text."""
    at = 0
    while len(data) - at > _SEGMENT:
        cut = max(data.rfind(b, at, at + _SEGMENT) for b in (b" ", b"\n"))
        if cut <= at:
            found = [x for x in (data.find(b, at + 1) for b in (b" ", b"\n")) if x > 0]
            cut = min(found, default=len(data))
        yield data[at:cut]
        at = cut
    yield data[at:]


class _WordHashes(dict):
    """64 bits of BLAKE2b per word, kept for the words a task has met lately."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= _KNOWN_WORDS:
            self.clear()
        self[word] = value = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
        return value


_words = _WordHashes()


def word_hashes(data: bytes) -> np.ndarray:
    """A 64-bit hash per word of the UTF-8 text, letters A-Z folded."""
    return np.concatenate(
        [np.array([*map(_words.__getitem__, part.lower().split())], np.uint64) for part in _segments(data)]
    )


def shingle_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """Sorted distinct hashes of the word shingles; a shorter text is one shingle."""
    width = min(width, len(words))
    n = len(words) - width + 1 if width else 0
    hashes = np.full(n, width, np.uint64)
    for j in range(width):
        hashes = hashes * np.uint64(0xD6E8FEB86659FD93) + words[j : j + n]
    return np.unique(mix(hashes))
