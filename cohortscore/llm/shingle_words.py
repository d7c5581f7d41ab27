"""Word and shingle hashes of many texts at once, as flat numpy arrays."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash

#: A worker forgets its word hashes at so many entries.
CACHE = 300_000
_known: dict[bytes, int] = {}
_ODD = np.uint64(0x9E3779B97F4A7C15)


def word_lists(texts: list[str | None], lower: bool = False) -> list[list[bytes]]:
    """UTF-8 words between runs of space, \\t, \\n, \\v, \\f, \\r; with `lower`, A-Z in lower case. Null gives none."""
    raw = ((t or "").encode("utf-8", "surrogatepass") for t in texts)
    return [b.lower().split() for b in raw] if lower else [b.split() for b in raw]  # bytes: ASCII rules only


def word_hashes(words: list[bytes]) -> np.ndarray:
    if len(_known) > CACHE:
        _known.clear()
    for w in set(words).difference(_known):
        _known[w] = xxhash.xxh3_64_intdigest(w)
    return np.fromiter(map(_known.__getitem__, words), np.uint64, len(words))


def mix(h: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of splitmix: every input bit reaches every output bit."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def window_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit hash of each run of k word hashes, in order; none if there are fewer."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for i in range(k):
        out = out * _ODD + h[i : i + n]
        if i % 4 == 3:
            out = mix(out)
    return mix(out + np.uint64(k))


#: What a byte adds to its word's hash: random odd-looking values from a fixed seed; white space adds nothing.
_SPACE = np.isin(np.arange(256), [32, 9, 10, 11, 12, 13])
_BYTE = np.where(_SPACE, 0, np.random.default_rng(2024).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)).astype(np.uint64)
_BYTE_LOWER = _BYTE.copy()
_BYTE_LOWER[65:91] = _BYTE[97:123]
_power = np.ones(1, np.uint64)


def hashed_texts(column: pa.Array, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """The word hashes of all texts of an Arrow string column, one text after the other, and where each text's words begin and end.

    Words are those of `word_lists`. A word's hash is a polynomial over its UTF-8 bytes modulo 2^64, mixed; it is
    made from the column's buffer for all texts at once, without a Python object for any word.
    """
    global _power
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, places, data = column.buffers()
    at = np.frombuffer(places, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and len(at) > 1 else np.zeros(0, np.uint8)
    at = at - at[0]
    inside = ~_SPACE[raw]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    edge = at[:-1][at[:-1] < len(raw)]
    begins[edge] = inside[edge]
    start = np.flatnonzero(begins)
    bounds = np.searchsorted(start, at)
    if not len(start):
        return np.zeros(0, np.uint64), bounds
    reach = np.diff(np.append(start, len(raw)))
    if reach.max() > len(_power):
        _power = np.cumprod(np.append(np.uint64(1), np.full(int(reach.max()), _ODD)), dtype=np.uint64)
    value = (_BYTE_LOWER if lower else _BYTE)[raw[start[0] :]]
    value *= _power[np.arange(start[0], len(raw)) - np.repeat(start, reach)]
    return mix(np.add.reduceat(value, start - start[0])), bounds


def shingles(h: np.ndarray, bounds: np.ndarray, k: int) -> list[np.ndarray]:
    """Each text's k-word window hashes, in order, from `hashed_texts`; fewer than k words make one window, no words none."""
    whole, out = window_hashes(h, k), []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        out.append(whole[a : b - k + 1] if b - a >= k else window_hashes(h[a:b], b - a) if b > a else whole[:0])
    return out


def distinct(s: np.ndarray) -> np.ndarray:
    """Sorted, each value once."""
    s = np.sort(s)
    return s[np.append(True, s[1:] != s[:-1])] if len(s) else s
