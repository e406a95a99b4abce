"""Word shingles of UTF-8 texts as 64-bit hashes, computed over whole Arrow buffers with numpy.

Words are runs of bytes other than white space (0x20, 0x09 to 0x0D) after lower-casing A-Z. A text's set holds its
distinct shingles of WORDS words; a shorter text has its whole word sequence as one; a text without words has none.
"""

from __future__ import annotations

import numpy as np

WORDS = 4
#: Characters of a character shingle.
CHARACTERS = 5
_VALUE = np.arange(1, 257, dtype=np.uint64)
_VALUE[65:91] += 32
_WHITE = np.zeros(256, bool)
_WHITE[[32, *range(9, 14)]] = True
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
#: Bytes of a word that one pass over the powers takes; longer words are put together from pieces.
PIECE = 1 << 12
_POWERS = np.power(_BASE, np.arange(PIECE + 1, dtype=np.uint64))


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def spans(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(begin, end) of the runs of bytes that are inside; a run ends with its text."""
    starts, ends = inside.copy(), inside.copy()
    starts[1:] &= ~inside[:-1]
    ends[:-1] &= ~inside[1:]
    cut = offsets[(offsets > 0) & (offsets < len(inside))]
    starts[cut] |= inside[cut]
    ends[cut - 1] |= inside[cut - 1]
    return np.flatnonzero(starts), np.flatnonzero(ends) + 1


def span_hashes(data: np.ndarray, inside: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A hash of the lower-cased bytes of each of these runs of inside bytes: a polynomial of fixed powers, whatever their place and length."""
    if not len(begin):
        return np.zeros(0, np.uint64)
    size = np.diff(np.append(begin, len(data)))
    place = np.arange(begin[0], len(data)) - np.repeat(begin, size)
    term = _VALUE[data[begin[0] :]] * inside[begin[0] :]
    pieces = -(-size // PIECE)
    if pieces.max() == 1:
        total = np.add.reduceat(term * _POWERS[place], begin - begin[0])
    else:
        first = np.cumsum(pieces) - pieces
        number = np.arange(first[-1] + pieces[-1]) - np.repeat(first, pieces)
        part = np.add.reduceat(term * _POWERS[place % PIECE], np.repeat(begin - begin[0], pieces) + number * PIECE)
        total = np.add.reduceat(part * np.power(_POWERS[PIECE], number.astype(np.uint64)), first)
    return mixed(total + (end - begin).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, offsets of each text's words)."""
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    inside = ~_WHITE[data]
    begin, end = spans(inside, offsets)
    return span_hashes(data, inside, begin, end), np.searchsorted(begin, offsets)


def shingle_hashes(data: np.ndarray, offsets: np.ndarray, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each shingle in order, repeats included; offsets of each text's shingles)."""
    value, at = word_hashes(data, offsets)
    n_words = np.diff(at)
    n = np.where(n_words >= words, n_words - words + 1, np.minimum(n_words, 1))
    bounds = np.concatenate([[0], np.cumsum(n)])
    first = np.repeat(at[:-1] - bounds[:-1], n) + np.arange(bounds[-1])
    last = np.repeat(at[1:], n)
    out = np.repeat(np.minimum(n_words, words), n).astype(np.uint64)
    padded = np.concatenate([value, np.zeros(words, np.uint64)])
    for k in range(words):
        here = np.where(first + k < last, padded[first + k], np.uint64(k + 1))
        out = mixed(out * np.uint64(0x9FB21C651E98DF25) + here)
    return out, bounds


def shingle_sets(data: np.ndarray, offsets: np.ndarray, words: int = WORDS) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    value, bounds = shingle_hashes(data, offsets, words)
    return [np.unique(value[a:b]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]


def character_hashes(data: np.ndarray, offsets: np.ndarray, characters: int = CHARACTERS) -> tuple[np.ndarray, np.ndarray]:
    """(hash of the shingle at every character in order, repeats included; offsets of each text's shingles).

    Characters are code points of UTF-8 as they stand; a shorter text is one shingle, an empty one has none.
    """
    begin = np.flatnonzero((data & 0xC0) != 0x80)
    edges = np.append(begin, len(data))
    at = np.searchsorted(begin, offsets)
    length = np.diff(at)
    n = np.where(length >= characters, length - characters + 1, np.minimum(length, 1))
    bounds = np.concatenate([[0], np.cumsum(n)])
    first = np.repeat(at[:-1] - bounds[:-1], n) + np.arange(bounds[-1])
    low, high = begin[first], edges[np.minimum(first + characters, np.repeat(at[1:], n))]
    total, wide = (high - low).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93), np.append(data, np.zeros(4 * characters, np.uint8))
    for k in range(int((high - low).max(initial=0))):
        total += np.where(low + k < high, (wide[low + k].astype(np.uint64) + np.uint64(1)) * _POWERS[k], np.uint64(0))
    return mixed(total), bounds
