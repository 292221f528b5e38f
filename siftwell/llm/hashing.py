"""Hashes of the words of many texts at once, on the UTF-8 bytes, without a Python object for each word."""

from __future__ import annotations

import numpy as np

_GOLDEN = np.uint64(0x9E3779B97F4A7C15)
#: White space that separates words: the six ASCII characters.
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser."""
    x = x + _GOLDEN
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: What is left of eight bytes when so many of them belong to a word.
_LOW = np.array([(1 << (8 * n)) - 1 for n in range(9)], dtype=np.uint64)


def word_spans(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, first byte, byte after the last) of each word of UTF-8 bytes. A word's hash depends on its bytes alone.

    Every eight bytes of a word are mixed with their place before they are summed, so that no pattern of letters cancels out, as it
    does in a polynomial modulo a power of two.
    """
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    space = np.concatenate(([True], _SPACE[data], [True]))
    edge = np.flatnonzero(space[1:] != space[:-1])
    starts, ends = edge[0::2], edge[1::2]
    if not len(starts):
        return np.zeros(0, np.uint64), starts, ends
    padded = np.concatenate((data, np.zeros(8, np.uint8)))
    eights = np.ndarray((len(data),), "<u8", padded, strides=(1,))  # the eight bytes from each place on
    size = ends - starts
    lanes = (size + 7) >> 3
    first = np.cumsum(lanes) - lanes
    number = np.arange(int(lanes.sum())) - np.repeat(first, lanes)
    at = np.repeat(starts, lanes) + 8 * number
    lane = eights[at] & _LOW[np.minimum(np.repeat(ends, lanes) - at, 8)]
    mixed = mix(lane ^ mix(number.astype(np.uint64)))
    return mix(np.add.reduceat(mixed, first) ^ (size.astype(np.uint64) * _GOLDEN)), starts, ends


def hash_words(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, first byte) of each word."""
    return word_spans(data)[:2]


def runs(sorted_values: np.ndarray) -> np.ndarray:
    """Start of each run of equal values."""
    if not len(sorted_values):
        return np.zeros(0, np.int64)
    return np.flatnonzero(np.concatenate(([True], sorted_values[1:] != sorted_values[:-1])))
