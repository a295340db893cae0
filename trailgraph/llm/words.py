"""The words of many texts at once, as numpy arrays.

A class of words is given by the ASCII bytes that separate them, so every byte
of a longer UTF-8 sequence belongs to a word.  A-Z become a-z.  All words of a
slice of texts are found by comparing bytes, and each distinct word is kept once.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

# A-Z become a-z.
_LOWER = np.array([c + 32 if 0x41 <= c <= 0x5A else c for c in range(256)], np.uint8)


def byte_class(characters: bytes) -> np.ndarray:
    """A table of all bytes that says which are among ``characters``."""
    table = np.zeros(256, bool)
    table[list(characters)] = True
    return table


# Multipliers and shifts of a 64-bit mixing function, and its increment.
_MIX = (0xBF58476D1CE4E5B9, 0x94D049BB133111EB)
_SHIFTS = (30, 27, 31)
INCREMENT = 0x9E3779B97F4A7C15


def mixed(values: np.ndarray) -> np.ndarray:
    """A one-to-one map of unsigned 64-bit numbers that looks random."""
    values = (values ^ (values >> np.uint64(_SHIFTS[0]))) * np.uint64(_MIX[0])
    values = (values ^ (values >> np.uint64(_SHIFTS[1]))) * np.uint64(_MIX[1])
    return values ^ (values >> np.uint64(_SHIFTS[2]))


_OF_BYTE = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(INCREMENT))


def hashes_of(words: pa.Array, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of each word: random numbers of its bytes, times one for each place, added up.

    Another ``seed`` gives another hash.
    """
    words = words.cast(pa.large_binary())
    bounds = np.frombuffer(words.buffers()[1], np.int64)[words.offset : words.offset + len(words) + 1]
    sizes = np.diff(bounds)
    found = np.zeros(len(words), np.uint64)
    held = np.flatnonzero(sizes)
    if len(held):
        data = np.frombuffer(words.buffers()[2], np.uint8)[bounds[0] : bounds[-1]]
        starts = (bounds[:-1] - bounds[0])[held]
        place = np.arange(len(data)) - np.repeat(starts, sizes[held])
        number = np.arange(1, int(sizes.max()) + 1, dtype=np.uint64) * np.uint64(INCREMENT)
        weight = mixed(number + np.uint64(seed)) | np.uint64(1)
        found[held] = np.add.reduceat(_OF_BYTE[data] * weight[place], starts)
    return mixed(found + sizes.astype(np.uint64) * np.uint64(INCREMENT))


@dataclass(frozen=True)
class Words:
    """The words of some texts, in order."""

    code: np.ndarray  # of each word, its place in ``distinct``
    row: np.ndarray  # of each word, the number of its text
    piece: np.ndarray  # of each word, how many stops stand before it
    distinct: pa.Array


def words_of(texts: pa.Array, gaps: np.ndarray, stops: np.ndarray | None = None, lower: bool = True) -> Words:
    """The words between bytes of ``gaps``; null texts have none.

    ``stops`` are gaps that also end a piece of a text.  Without ``lower``, A-Z stay.
    """
    texts = texts.cast(pa.large_binary())
    bounds = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    whole = texts.buffers()[2]
    data = np.frombuffer(whole, np.uint8)[bounds[0] : bounds[-1]] if whole else np.zeros(0, np.uint8)
    bounds = bounds - bounds[0]
    data = _LOWER[data] if lower else data
    inside = ~gaps[data]
    fresh = np.ones(len(data) + 1, bool)  # no word goes on here
    fresh[1:-1] = ~inside[:-1]
    fresh[bounds] = True
    starts = np.flatnonzero(inside & fresh[:-1])
    after = fresh[1:].copy()
    after[:-1] |= ~inside[1:]
    sizes = np.flatnonzero(inside & after) - starts + 1
    places = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(sizes, out=places[1:])
    words = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(places), pa.py_buffer(data[inside]))
    coded = words.dictionary_encode()
    if stops is None:
        piece = np.zeros(len(starts), np.int32)
    else:
        piece = np.searchsorted(np.flatnonzero(stops[data]), starts).astype(np.int32)
    return Words(
        coded.indices.to_numpy(),
        np.searchsorted(bounds[1:], starts, side="right").astype(np.int32),
        piece,
        coded.dictionary.cast(pa.string()),
    )
