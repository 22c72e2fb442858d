"""Words of whole texts as bytes, piece by piece, and 64-bit numbers of words."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import xxhash

#: Bytes of a text that are split at a time.
PIECE = 4_000_000
#: A worker forgets its words' numbers beyond so many.
CACHE_WORDS = 500_000


def separated(separates: Callable[[int], bool]) -> bytes:
    """A table for :func:`words` that makes the bytes below 128 for which ``separates`` holds blanks."""
    return bytes(32 if b < 128 and separates(b) else b for b in range(256))


#: Words between white space of ASCII.
BLANKS = separated(lambda b: b == 32 or 9 <= b <= 13)
#: Words of letters and digits of ASCII and of any character beyond it.
ALPHANUMERIC = separated(lambda b: not chr(b).isalnum())
#: The same without digits.
LETTERS = separated(lambda b: not chr(b).isalpha())


def words(text: str | None, table: bytes, piece: int = PIECE) -> Iterator[list[bytes]]:
    """Lists of the words of a text after lower-casing A-Z, in order; null counts as empty.  A word is never cut."""
    data, at = (text or "").encode("utf-8").lower().translate(table), 0  # bytes.lower() knows A-Z only
    while at < len(data):
        end = data.find(b" ", at + piece)
        end = len(data) if end < 0 else end
        yield data[at:end].split()
        at = end


class Numbers(dict):
    """64-bit numbers of words, remembered for the next batch."""

    def __missing__(self, word: bytes) -> int:
        self[word] = number = xxhash.xxh3_64_intdigest(word)
        return number

    def of(self, found: list[bytes]) -> np.ndarray:
        if len(self) > CACHE_WORDS:
            self.clear()
        return np.fromiter(map(self.__getitem__, found), np.uint64, len(found))


class Places(dict):
    """Words by the order in which they were first seen, from 0."""

    def __missing__(self, word: bytes) -> int:
        self[word] = place = len(self)
        return place

    def of(self, found: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, found), np.int64, len(found))


def shuffled(numbers: np.ndarray) -> np.ndarray:
    """Another 64-bit number of each number, one to one."""
    x = numbers ^ (numbers >> np.uint64(31))
    x = x * np.uint64(0x9E3779B97F4A7C15)
    x = x ^ (x >> np.uint64(29))
    return x * np.uint64(0xBF58476D1CE4E5B9)
