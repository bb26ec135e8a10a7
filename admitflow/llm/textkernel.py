"""Word hashes of whole Arrow text columns, without a Python object a word.

Words are maximal runs of bytes other than space and 0x09-0x0D, with A-Z
lowered; a word's hash is 64 bits wide and depends on its bytes alone."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_RNG = np.random.Generator(np.random.PCG64(20240501))


def _odd(n: int) -> np.ndarray:
    return _RNG.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


_BYTES, _NEAR, _FAR = _odd(256), _odd(4096), _odd(4096)
_BYTES[65:91] = _BYTES[97:123]  # A-Z as a-z
_FAR[0] = 1  # words of up to 4096 bytes hash the same wherever they stand
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_BYTES[_SPACE] = 0
_WINDOW = 1 << 20


def mix(h: np.ndarray) -> np.ndarray:
    """Spread 64-bit values (a bijection)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def text_buffer(col) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null texts are empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    col = col.cast(pa.large_string()).fill_null("")
    _, offsets, data = col.buffers()
    at = np.frombuffer(offsets, np.int64)[col.offset:col.offset + len(col) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0]:at[-1]] if len(at) else raw[:0], at - at[0]


def word_hashes(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words in order, and for each text the number of the
    first of its words (one more at the end)."""
    hashes, places, a, n = [], [], 0, len(raw)
    while a < n:
        b = _cut(raw, at, a, n)
        by = raw[a:b]
        space = _SPACE[by]
        edge = np.zeros(b - a, bool)
        edge[at[np.searchsorted(at, a):np.searchsorted(at, b)] - a] = True
        edge[0] = True
        edge[1:] |= space[:-1]
        starts = np.flatnonzero(edge & ~space)
        if len(starts):
            pos = np.arange(b - a, dtype=np.int32) - starts.astype(np.int32)[np.cumsum(edge & ~space, dtype=np.int32) - 1]
            value = _BYTES[by] * _NEAR[pos & 4095]
            if pos.max() >= 4096:
                value *= _FAR[(pos >> 12) & 4095]
            hashes.append(mix(np.add.reduceat(value, starts)))
            places.append(starts + a)
        a = b
    if not hashes:
        return np.zeros(0, np.uint64), np.zeros(len(at), np.int64)
    return np.concatenate(hashes), np.searchsorted(np.concatenate(places), at)


def _cut(raw: np.ndarray, at: np.ndarray, a: int, n: int) -> int:
    """End of the window that begins at ``a``: a white space or a text's
    start, so that no word is cut."""
    b = a + _WINDOW
    while b < n:
        text = at[np.searchsorted(at, b, "right") - 1]  # start of the text that holds b
        spaces = np.flatnonzero(_SPACE[raw[max(a, text):b]])
        if len(spaces):
            return int(max(a, text) + spaces[-1]) + 1
        if text > a:
            return int(text)
        b += _WINDOW
    return n


def lowered_words(text: str) -> list[str]:
    """The same words of one text, as strings (for small helpers and tests)."""
    import re
    low = text.translate({c: c + 32 for c in range(65, 91)})
    return re.findall(r"[^\x20\x09-\x0D]+", low)
