"""Vectorised words, word hashes and shingles of many texts at once, on their UTF-8 bytes."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np

U = np.uint64
#: Bytes hashed at once; bounds the working arrays however long a text is.
SPAN = 1 << 20
_BASE = 0x9E3779B97F4A7C55  # odd, so that its powers have inverses modulo 2**64


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def seeds(n: int, salt: int) -> np.ndarray:
    return mix((np.arange(1, n + 1, dtype=U) + U(salt)) * U(0x9E3779B97F4A7C15))


@cache
def lower_table() -> np.ndarray:
    low = np.arange(256, dtype=np.uint8)
    low[65:91] += 32
    return low


@cache
def white_space() -> np.ndarray:
    """True for the bytes that end a word: space and 0x09 to 0x0D."""
    gap = np.zeros(256, bool)
    gap[[0x20, *range(0x09, 0x0E)]] = True
    return gap


@cache
def not_alphanumeric() -> np.ndarray:
    """True for ASCII bytes other than letters and digits; words are then free of punctuation."""
    gap = np.ones(256, bool)
    gap[128:] = False
    for low, high in ((48, 58), (65, 91), (97, 123)):
        gap[low:high] = False
    return gap


@cache
def _byte_values() -> np.ndarray:
    return seeds(256, 77)


_powers: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the hash base and of its inverse modulo 2**64."""
    if not _powers or len(_powers[0]) < n:
        size = max(n, SPAN)
        inverse = pow(_BASE, -1, 1 << 64)
        _powers[:] = [np.multiply.accumulate(np.concatenate((np.ones(1, U), np.full(size - 1, b, U)))) for b in (_BASE, inverse)]
    return _powers[0][:n], _powers[1][:n]


def spans(raw: np.ndarray, offsets: np.ndarray, gap: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and text index of every word; a word never crosses texts."""
    if not len(raw):
        none = np.zeros(0, np.int64)
        return none, none, none
    out = gap[raw]
    before, after = np.empty(len(raw), bool), np.empty(len(raw), bool)
    before[0] = after[-1] = True
    before[1:], after[:-1] = out[:-1], out[1:]
    inner = offsets[(offsets > 0) & (offsets < len(raw))]
    before[inner] = True
    after[inner - 1] = True
    np.logical_not(out, out=out)
    starts = np.flatnonzero(out & before)
    ends = np.flatnonzero(out & after) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def _pieces(starts: np.ndarray, ends: np.ndarray, width: int) -> Iterator[tuple[slice, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Blocks of the pieces of ``width`` symbols of each span: the spans at hand, pieces of each, and the pieces' first symbol, number and span's end."""
    count = -(-(ends - starts) // width)
    last = np.cumsum(count)
    block = max(SPAN // width, 1)
    for low in range(0, int(last[-1]) if len(last) else 0, block):
        high = min(low + block, int(last[-1]))
        a, b = int(np.searchsorted(last, low, "right")), int(np.searchsorted(last, high - 1, "right")) + 1
        first = last[a:b] - count[a:b]
        here = np.minimum(last[a:b], high) - np.maximum(first, low)
        number = np.arange(low, high) - np.repeat(first, here)
        yield slice(a, b), here, np.repeat(starts[a:b], here) + number * width, number, np.repeat(ends[a:b], here)


def _summed(mixed: np.ndarray, here: np.ndarray) -> np.ndarray:
    total = np.concatenate((np.zeros(1, U), np.cumsum(mixed, dtype=U)))
    to = np.cumsum(here)
    return total[to] - total[to - here]


def hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold_case: bool = True) -> np.ndarray:
    """64-bit hash of each span of bytes, A-Z as a-z if ``fold_case``.

    Every piece of eight bytes is mixed with its number in the span, and the sum is mixed again, so
    that no pattern of the bytes cancels out as it does in a polynomial modulo a power of two.
    """
    out = np.zeros(len(starts), U)
    if len(raw) < 8:
        raw = np.concatenate((raw, np.zeros(8, np.uint8)))
    view = np.ndarray((len(raw) - 7,), "<u8", np.ascontiguousarray(raw), strides=(1,))
    for spans_, here, at, number, end in _pieces(starts, ends, 8):
        base = np.minimum(at, len(view) - 1)
        piece = view[base].astype(U) >> ((at - base).astype(U) << U(3))
        left = np.minimum(end - at, 8).astype(U)
        piece &= U(0xFFFFFFFFFFFFFFFF) >> ((U(8) - left) << U(3))
        if fold_case:
            low = piece & U(0x7F7F7F7F7F7F7F7F)
            upper = ((low + U(0x3F3F3F3F3F3F3F3F)) ^ (low + U(0x2525252525252525))) & ~piece & U(0x8080808080808080)
            piece |= upper >> U(2)
        out[spans_] += _summed(mix(piece ^ mix(number.astype(U) + U(77))), here)
    return mix(out ^ ((ends - starts).astype(U) * U(0x9E3779B97F4A7C15)))


def symbol_hashes(code: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The same of spans of symbols below 2**21, three to a piece."""
    out = np.zeros(len(starts), U)
    for spans_, here, at, number, end in _pieces(starts, ends, 3):
        piece = code[at].astype(U) + U(1)
        for k in (1, 2):
            inside = np.flatnonzero(at + k < end)
            piece[inside] |= (code[at[inside] + k].astype(U) + U(1)) << U(21 * k)
        out[spans_] += _summed(mix(piece ^ mix(number.astype(U) + U(79))), here)
    return mix(out ^ ((ends - starts).astype(U) * U(0x9E3779B97F4A7C15)))


def rolled(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each span (in order of start) by sums of powers, for short spans that overlap.

    A polynomial modulo 2**64 gives some long patterns one hash: whoever takes equal hashes for
    equal spans has to compare the bytes.
    """
    values = _byte_values()
    out = np.empty(len(starts), U)
    at = 0
    while at < len(starts):
        base = int(starts[at])
        to = max(at + 1, int(np.searchsorted(starts, base + SPAN, "left")))
        top = int(ends[at:to].max())
        power, inverse = powers(top - base)
        total = np.empty(top - base + 1, U)
        total[0] = 0
        np.cumsum(values[raw[base:top]] * power, out=total[1:])
        s, e = starts[at:to] - base, ends[at:to] - base
        out[at:to] = (total[e] - total[s]) * inverse[np.minimum(s, top - base - 1)]
        at = to
    return mix(out ^ ((ends - starts).astype(U) << U(40)))


def grams(word: np.ndarray, text: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of every k successive words of one text, and the index of each first word."""
    n = len(word) - k + 1
    if n <= 0:
        return np.zeros(0, U), np.zeros(0, np.int64)
    at = np.flatnonzero(text[:n] == text[k - 1 :])
    total = np.zeros(len(at), U)
    for i, seed in enumerate(seeds(k, 1000 + k)):
        total += mix(word[at + i] ^ seed) * (seed | U(1))
    return mix(total), at


def counts(index: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(index, minlength=n).astype(np.int64)


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices of the concatenated ranges [start, start + length)."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(lengths)
    return np.arange(total) + np.repeat(starts - (ends - lengths), lengths)
