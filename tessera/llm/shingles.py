"""64-bit hashes of words and word shingles, made for many texts at once in numpy.

Words are the runs of bytes outside 0x20 and 0x09-0x0D with A-Z lower-cased.  A
word's hash is a polynomial of its bytes modulo 2**64, mixed; a shingle's is a
chain of its words' hashes.  Texts are read in segments of about ``SEGMENT``
bytes, cut between words, so the memory beside a text is a few times a segment
and eight bytes a word, however long the text is.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Bytes hashed at once.
SEGMENT = 1 << 19
_BASE = 0x9E3779B97F4A7C15 | 1
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def _powers_to(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = 1 << max(n - 1, 1).bit_length()
    if size not in _powers:
        made = []
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            made.append(np.multiply.accumulate(steps))
        _powers[size] = (made[0], made[1])
    return _powers[size]


def _segment_words(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of ``data`` and the places they start at."""
    raw = np.frombuffer(data, np.uint8)
    space = np.ones(len(raw) + 2, bool)
    space[1:-1] = _SPACE[raw]
    edges = np.flatnonzero(space[1:] != space[:-1])
    starts, ends = edges[::2], edges[1::2]
    power, inverse = _powers_to(len(raw) + 1)
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum((_LOWER[raw].astype(np.uint64) + np.uint64(1)) * power[: len(raw)], out=sums[1:])
    h = (sums[ends] - sums[starts]) * inverse[starts]
    return mix(h + (ends - starts).astype(np.uint64) * np.uint64(_BASE)), starts


def word_hashes(text: bytes) -> np.ndarray:
    """The word hashes of one text of any length, in order."""
    found, at = [], 0
    while at < len(text):
        end = min(at + SEGMENT, len(text))
        if end < len(text):  # back to the last space, or on to the next one
            part = _SPACE[np.frombuffer(text, np.uint8, end - at, at)]
            hits = np.flatnonzero(part)
            if len(hits):
                end = at + int(hits[-1]) + 1
            else:
                while end < len(text) and not _SPACE[text[end]]:
                    end += 1
        found.append(_segment_words(text[at:end])[0])
        at = end
    return np.concatenate(found) if found else np.empty(0, np.uint64)


def words_of_texts(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The word hashes of all texts, and how many each has."""
    hashes, counts, group, size = [], [], [], 0

    def flush() -> None:
        nonlocal group, size
        if not group:
            return
        h, starts = _segment_words(b" ".join(group))
        ends = np.cumsum(np.fromiter(map(len, group), np.int64, len(group)) + 1)
        hashes.append(h)
        counts.append(np.diff(np.searchsorted(starts, ends), prepend=0))
        group, size = [], 0

    for text in texts:
        if len(text) > SEGMENT:
            flush()
            h = word_hashes(text)
            hashes.append(h)
            counts.append(np.array([len(h)], np.int64))
            continue
        group.append(text)
        size += len(text) + 1
        if size > SEGMENT:
            flush()
    flush()
    if not hashes:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    return np.concatenate(hashes), np.concatenate(counts)


def chain(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of ``k`` words in ``words``."""
    n = len(words) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    h = words[:n].copy()
    for j in range(1, k):
        h = (h ^ (h >> np.uint64(29))) * _M1 + words[j : n + j]
    return mix(h)


def shingle_sets(texts: list[bytes], k: int) -> Iterator[np.ndarray]:
    """For each text its distinct shingles of ``k`` words, sorted; of a text with fewer words, one of all of them."""
    words, counts = words_of_texts(texts)
    runs = chain(words, k)
    at = 0
    for n in counts.tolist():
        yield np.unique(runs[at : at + n - k + 1]) if n >= k else chain(words[at : at + n], n) if n else np.empty(0, np.uint64)
        at += n
