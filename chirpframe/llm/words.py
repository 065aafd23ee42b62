"""Words of UTF-8 texts as 64-bit numbers, for many texts at a time.

A batch of texts is one byte array. Word borders are found by comparing bytes,
and the hash of every word comes from one running sum of ``byte * P**position``
(all modulo 2**64, P odd, so positions divide out again). Nothing here is bound
to Spark; tasks call it on Arrow batches and feed it a bounded number of bytes.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np

CHUNK_BYTES = 1 << 19
_P = 0x9E3779B97F4A7C15 | 1
_P_INV = pow(_P, -1, 1 << 64)
_tables: dict[str, np.ndarray] = {}


def _powers(kind: str, base: int, n: int) -> np.ndarray:
    table = _tables.get(kind)
    if table is None or len(table) < n:
        size = 1 << max(12, int(n - 1).bit_length())
        table = np.empty(size, np.uint64)
        table[0] = 1
        done = 1
        while done < size:  # doubling: the second half is the first times base**done
            step = np.uint64(pow(base, done, 1 << 64))
            table[done:2 * done] = table[:done] * step
            done *= 2
        _tables[kind] = table
    return table


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over the word."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


@dataclass
class Words:
    """Words of a batch: hash, borders in ``data`` and the text each belongs to."""

    data: np.ndarray  # the bytes, A-Z in lower case if asked
    hashes: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray  # words of text i are first[i]:first[i + 1]
    begins: np.ndarray  # text i is data[begins[i]:begins[i + 1] - 1]


def segment_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of each ``data[start:end]``."""
    n = len(data)
    up, down = _powers("up", _P, n + 1), _powers("down", _P_INV, n + 1)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:n], out=total[1:])
    raw = (total[ends] - total[starts]) * down[starts]
    return mix(raw ^ (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def is_space(data: np.ndarray) -> np.ndarray:
    """True for the six bytes of ``[\\x20\\x09-\\x0D]``."""
    return (data == 32) | ((data >= 9) & (data <= 13))


def lower_ascii(data: np.ndarray) -> np.ndarray:
    return np.where((data >= 65) & (data <= 90), data + np.uint8(32), data)


def split_words(texts: list[bytes], lower: bool = True) -> Words:
    """Words ``[^\\x20\\x09-\\x0D]+`` of every text; an empty text has none."""
    data = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    if lower:
        data = lower_ascii(data)
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    begins = np.concatenate([[0], np.cumsum(lengths + 1)])
    space = is_space(data)
    edge = np.empty(len(data), bool)
    edge[0] = not space[0]
    edge[1:] = space[1:] != space[:-1]
    places = np.flatnonzero(edge)
    starts, ends = places[::2], places[1::2]  # the last byte is a space, so every word ends
    first = np.searchsorted(starts, begins)
    return Words(data, segment_hashes(data, starts, ends), starts, ends, first, begins)


def shingle_sets(words: Words, size: int) -> Iterator[np.ndarray]:
    """Per text: sorted distinct hashes of its ``size``-word shingles.

    A text with fewer words has its whole word sequence as the only shingle; a
    text without words has an empty set.
    """
    h = words.hashes
    n = len(h)
    joined = h.copy()
    for k in range(1, size):
        if n > k:
            joined[:n - k] = mix(joined[:n - k] * np.uint64(0x9FB21C651E98DF25) + h[k:])
    for a, b in zip(words.first[:-1].tolist(), words.first[1:].tolist()):
        if b - a >= size:
            yield np.unique(joined[a:b - size + 1])
        elif b > a:
            value = h[a:a + 1].copy()
            for k in range(a + 1, b):
                value = mix(value * np.uint64(0x9FB21C651E98DF25) + h[k])
            yield value ^ np.uint64(b - a)  # apart from shingles of full size
        else:
            yield h[:0]


def byte_chunks(texts: Iterable[str | None], limit: int = CHUNK_BYTES) -> Iterator[tuple[int, list[bytes]]]:
    """(index of the first text, texts in UTF-8) in runs of about ``limit`` bytes; null is empty."""
    run: list[bytes] = []
    start = size = 0
    for i, text in enumerate(texts):
        raw = b"" if text is None else text.encode("utf-8")
        if run and size + len(raw) > limit:
            yield start, run
            run, start, size = [], i, 0
        run.append(raw)
        size += len(raw)
    if run:
        yield start, run
