"""Words of many texts at once: spans and 64-bit hashes by array operations over Arrow's own buffers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that one array operation goes over.
CHUNK = 1 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15)
_powers = np.ones(1, dtype=np.uint64)


def powers(n: int) -> np.ndarray:
    """The first n powers of an odd multiplier, modulo 2^64."""
    global _powers
    while len(_powers) < n:
        step = _powers[-1:] * _BASE
        _powers = np.concatenate([_powers, _powers * step])
    return _powers


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string array; null texts are empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = pc.fill_null(texts, "")
    texts = texts.cast(pa.large_string())
    _, ends, data = texts.buffers()
    offsets = np.frombuffer(ends, dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    if data is None:
        return np.zeros(0, np.uint8), offsets - offsets[0]
    return np.frombuffer(data, dtype=np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(offsets: np.ndarray, most: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Ranges of texts of at most so many bytes together (or one text)."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, side="right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def words(data: np.ndarray, offsets: np.ndarray, fold: np.ndarray, prefixes: tuple[int | None, ...] = (None,)) -> tuple[list[np.ndarray], np.ndarray]:
    """(hashes of the words, one array for each prefix length; index of each text's first word, and the total).

    fold: for each byte the byte that is hashed, 0 for bytes that part words. A word never crosses texts. prefixes: so
    many leading bytes of each word are hashed, None for all; of at most 7, packed in a number instead, first byte lowest.
    """
    n = len(data)
    none = [np.zeros(0, np.uint64) for _ in prefixes], np.zeros(len(offsets), np.int64)
    if not n:
        return none
    folded = fold[data]
    inside = folded != 0
    opens = inside.copy()
    opens[1:] &= ~inside[:-1]
    edge = offsets[:-1][offsets[:-1] < n]
    opens[edge] = inside[edge]
    starts = np.flatnonzero(opens)
    if not len(starts):
        return none
    at = np.flatnonzero(inside)
    first = np.searchsorted(at, starts)
    length = np.diff(np.append(first, len(at)))
    place = np.arange(len(at), dtype=np.int64) - np.repeat(first, length)
    value = (folded[at].astype(np.uint64) + np.uint64(1)) * powers(int(length.max()))[place]
    found = []
    for k in prefixes:
        if k is not None and k <= 7:
            shift = 8 * np.minimum(place, k).astype(np.uint64)
            found.append(np.add.reduceat(np.where(place < k, folded[at].astype(np.uint64) << shift, np.uint64(0)), first))
            continue
        some, size = (value, length) if k is None else (np.where(place < k, value, np.uint64(0)), np.minimum(length, k))
        found.append(mix(np.add.reduceat(some, first) + size.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)))
    return found, np.searchsorted(starts, offsets)


def ascii_fold(separators: bytes) -> np.ndarray:
    """Lower-cases A-Z only; the given bytes part words."""
    fold = np.arange(256, dtype=np.uint16)
    fold[65:91] += 32
    fold = np.where(fold == 0, 256, fold)
    fold[list(separators)] = 0
    return fold


#: Words of the near-duplicate contract: everything but space and the control characters from tab to return.
BLANK_PARTED = ascii_fold(bytes([0x20, *range(0x09, 0x0E)]))
#: Words of letters and digits; bytes of other scripts count as letters.
ALNUM = ascii_fold(bytes(b for b in range(128) if not chr(b).isalnum()))
