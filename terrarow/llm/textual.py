"""Vectorised word and shingle hashing of one text, in numpy.

All hashes are polynomial in the UTF-8 bytes modulo 2**64, mixed afterwards; equal words give equal hashes in every
process. No list of words is made, and texts beyond BLOCK bytes are hashed in blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Bytes of a text that are hashed at a time, about.
BLOCK = 4 << 20

_R = np.uint64(0x9E3779B97F4A7C15 | 1)
_RI = np.uint64(pow(int(_R), -1, 1 << 64))
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]
#: ASCII white space: a word is a run of other characters.
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """R**i and R**-i for i < n."""
    if len(_powers[0]) < n:
        size = max(n, 1 << 16, 2 * len(_powers[0]))
        for k, r in ((0, _R), (1, _RI)):
            p = np.full(size, r, np.uint64)
            p[0] = 1
            _powers[k] = np.multiply.accumulate(p)
    return _powers[0][:n], _powers[1][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64, elementwise."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def prefix_sums(data: np.ndarray) -> np.ndarray:
    """S with S[i] = sum of (byte j + 1) * R**j over j < i; windows follow by window_hash."""
    up, _ = _power(len(data))
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up, out=out[1:])
    return out


def window_hash(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The unmixed hash of bytes [start, end)."""
    _, down = _power(len(sums))
    return (sums[ends] - sums[starts]) * down[starts]


def word_bounds(data: np.ndarray, space: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray]:
    """Byte starts and ends of the words of UTF-8 data."""
    gap = np.ones(len(data) + 2, bool)
    gap[1:-1] = space[data]
    edge = np.flatnonzero(gap[1:] != gap[:-1])
    return edge[0::2], edge[1::2]


def _parts(data: np.ndarray, space: np.ndarray) -> Iterator[tuple[int, int]]:
    """Bounds of parts of about BLOCK bytes that end at white space, so that no word is cut."""
    at = 0
    while at < len(data):
        end = min(at + BLOCK, len(data))
        while end < len(data) and not (gaps := space[data[end : end + BLOCK]]).any():
            end = min(end + BLOCK, len(data))
        if end < len(data):
            end += int(gaps.argmax())
        yield at, end
        at = end


def _long_word(word: np.ndarray) -> np.uint64:
    """window_hash of a whole word, added up by blocks."""
    out = 0
    for at in range(0, len(word), BLOCK):
        part = word[at : at + BLOCK]
        out += int(prefix_sums(part)[-1]) * pow(int(_R), at, 1 << 64)
    return np.uint64(out % (1 << 64))


def word_hashes(data: np.ndarray, space: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Mixed hashes of the words, and their byte bounds; worked out in blocks, so memory follows the words."""
    found = []
    for a, b in _parts(data, space):
        part = data[a:b]
        starts, ends = word_bounds(part, space)
        if not len(starts):
            continue
        if len(part) > 2 * BLOCK:  # some word is longer than a block
            raw = np.array([_long_word(part[i:j]) for i, j in zip(starts.tolist(), ends.tolist())], np.uint64)
        else:
            raw = window_hash(prefix_sums(part), starts, ends)
        found.append((mix(raw + (ends - starts).astype(np.uint64)), a + starts, a + ends))
    if not found:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    return found[0] if len(found) == 1 else tuple(np.concatenate(x) for x in zip(*found))


def shingle_hashes(words: np.ndarray, n: int = 5) -> np.ndarray:
    """Mixed hashes of all runs of n words; a text of fewer, but some, words has one shingle of them all."""
    if not len(words):
        return words
    n = min(n, len(words))
    out = np.zeros(len(words) - n + 1, np.uint64)
    for j in range(n):
        out = out * np.uint64(0xD6E8FEB86659FD93) + words[j : j + len(out)]
    return mix(out)


def as_bytes(text: str | None) -> np.ndarray:
    return np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)
