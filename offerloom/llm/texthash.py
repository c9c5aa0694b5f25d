"""Hashes of words, word runs and character n-grams with numpy; one text at a time, in bounded pieces."""

from __future__ import annotations

import numpy as np

PIECE = 1 << 20
_RANDOM = np.random.default_rng(20240601)
_BYTE = _RANDOM.integers(1, 1 << 63, 256, dtype=np.uint64)
_STEP = np.uint64(0x9E3779B97F4A7C15)
_STEP_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
_powers: dict[int, np.ndarray] = {}


def utf8(text: str) -> bytes:
    return text.encode("utf-8", "surrogatepass")


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of unsigned 64-bit numbers (a bijection)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power(base: np.uint64, count: int) -> np.ndarray:
    known = _powers.get(int(base))
    if known is None or len(known) < count:
        size = max(count, 1 << 16)
        known = np.full(size, base, dtype=np.uint64)
        known[0] = 1
        known = np.multiply.accumulate(known)
        if size <= 2 * PIECE:
            _powers[int(base)] = known
    return known[:count]


def _piece_words(raw: bytes, space: np.ndarray) -> np.ndarray:
    data = np.frombuffer(raw, np.uint8)
    gap = np.concatenate([[True], space[data], [True]])
    edge = np.flatnonzero(gap[1:] != gap[:-1])
    start, end = edge[::2], edge[1::2]
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * _power(_STEP, len(data)), out=total[1:])
    return mix((total[end] - total[start]) * _power(_STEP_INVERSE, len(data) + 1)[start] + (end - start).astype(np.uint64))


def word_hashes(text: str, lower: bool = True, space: np.ndarray = _SPACE) -> np.ndarray:
    """A 64-bit hash per word (run of bytes that are not white space), in text order."""
    raw = utf8(text)
    if lower:
        raw = raw.translate(_LOWER)
    parts, begin = [], 0
    while begin < len(raw):
        end = min(begin + PIECE, len(raw))
        while end < len(raw) and not space[raw[end]]:  # never inside a word
            end += 1
        parts.append(_piece_words(raw[begin:end], space))
        begin = end
    return np.concatenate(parts) if parts else np.zeros(0, np.uint64)


def runs_of(words: np.ndarray, length: int) -> np.ndarray:
    """Hash of each run of ``length`` words; of the whole sequence if it is shorter; none without words."""
    if not len(words):
        return words
    length = min(length, len(words))
    total = np.zeros(len(words) - length + 1, np.uint64)
    for i in range(length):
        total = total * _STEP + words[i : len(words) - length + 1 + i]
    return mix(total + np.uint64(length))


def grams(raw: bytes, size: int) -> np.ndarray:
    """The bytes of every n-gram (up to 8 bytes), packed into one number: no two n-grams share one."""
    count = len(raw) - size + 1
    if count <= 0:
        return np.zeros(0, np.uint64)
    window = np.ndarray(shape=(count,), dtype="<u8", buffer=raw + bytes(8), strides=(1,))
    return window & np.uint64((1 << (8 * size)) - 1)


def slots(keys: np.ndarray, bits: int) -> np.ndarray:
    return ((keys * _STEP) >> np.uint64(64 - bits)).astype(np.int64)
