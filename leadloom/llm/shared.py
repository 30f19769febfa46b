"""What the operators share: the shared working folder, and words as numpy arrays."""

from __future__ import annotations

import gc
import sys
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute

from ..storage import forget, stored, workspace

__all__ = ["alone", "forget", "letters", "mixed", "shingle_hashes", "slices", "stored", "text_bytes", "word_hashes", "workspace"]


_KEPT: dict[Any, Any] = {}


def alone(key: Any = None, make: Callable[[], Any] | None = None) -> Any:
    """What a Python worker keeps between tasks: one object, that of the step at hand. Another key, or none, lets go of it."""
    if key not in _KEPT:
        if _KEPT:
            _KEPT.clear()
            gc.collect()
        if make is None:
            return None
        _KEPT[key] = make()
    return _KEPT[key]


def slices(texts: pa.Array, size: int = 1 << 19) -> Iterator[tuple[int, pa.Array]]:
    """Runs of texts of about ``size`` bytes, each with the place of its first."""
    ends = np.cumsum(np.maximum(1, np.nan_to_num(np.array(pa.compute.binary_length(texts).to_numpy(zero_copy_only=False), float))))
    at = 0
    while at < len(texts):
        end = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + size, side="right")))
        yield at, texts.slice(at, end - at)
        at = end


_LETTERS: list[np.ndarray] = []


def letters() -> np.ndarray:
    """Whether each code point is a letter."""
    if not _LETTERS:
        _LETTERS.append(np.array([chr(c).isalpha() for c in range(sys.maxunicode + 1)]))
    return _LETTERS[0]


# Word hashing. White space is the space and the code points 9 to 13; odd multipliers of 64 bits.
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_WORD, _PLACE = np.uint64(0xD6E8FEB86659FD93), np.uint64(0x9E3779B97F4A7C15)
#: Bytes of one text that are hashed at once.
_PIECE = 2 << 20


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit moves every output bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTES = mixed(np.arange(1, 257, dtype=np.uint64) * _PLACE)


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string array, nulls as empty texts, and where each text starts and the last one ends."""
    if texts.null_count:
        texts = texts.fill_null("")
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    offsets = np.frombuffer(texts.buffers()[1], kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = texts.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, offsets - offsets[0]


def word_hashes(texts: pa.Array, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words (runs without white space) of all texts in order, and, text by text, the place of its first word."""
    raw, offsets = text_bytes(texts)
    if len(texts) > 1 or len(raw) <= _PIECE:
        return _hashed(raw, offsets, lower)
    parts, at = [], 0  # one long text, cut at white space
    while at < len(raw):
        end = min(at + _PIECE, len(raw))
        while end < len(raw):
            spaces = np.flatnonzero(_SPACE[raw[end : end + _PIECE]])
            if len(spaces):
                end += int(spaces[0])
                break
            end = min(end + _PIECE, len(raw))
        parts.append(_hashed(raw[at:end], np.array([0, end - at]), lower)[0])
        at = end
    words = np.concatenate(parts)
    return words, np.array([0, len(words)])


def _hashed(raw: np.ndarray, offsets: np.ndarray, lower: bool) -> tuple[np.ndarray, np.ndarray]:
    if not len(raw):
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    if lower:
        raw = _LOWER[raw]
    inside = ~_SPACE[raw]
    before = np.zeros(len(raw), bool)
    before[1:] = inside[:-1]
    firsts = offsets[:-1][offsets[:-1] < len(raw)]
    before[firsts] = False  # a word ends with its text
    starts = np.flatnonzero(inside & ~before)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    owner = np.cumsum(inside & ~before)[inside] - 1
    at = np.flatnonzero(inside)
    # A sum over a word's bytes, each mixed with its place, so that no algebra of places makes two words equal.
    values = _BYTES[raw[at]] + (at - starts[owner]).astype(np.uint64) * _PLACE
    values = (values ^ (values >> np.uint64(32))) * _WORD
    values ^= values >> np.uint64(29)
    sums = np.add.reduceat(values, np.searchsorted(at, starts))
    return mixed(sums), np.searchsorted(starts, offsets)


def shingle_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """A hash for each run of ``size`` words of one text; fewer words make one run; no words make none."""
    n = len(words)
    if not n:
        return words
    k = min(size, n)
    out = np.full(n - k + 1, np.uint64(k))
    for i in range(k):
        out = out * _WORD + words[i : n - k + 1 + i]
    return mixed(out)
