"""Whole-array text work: code points, words, pre-tokens and 64-bit hashes of them, without a Python step per word.

Texts are taken in blocks of about a million characters, so memory doesn't follow the size of an Arrow batch.
"""

from __future__ import annotations

import functools
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BLOCK, BLOCK_TEXTS = 1 << 19, 4096
#: Texts that are taken out of an Arrow batch at once.
SLICE = 1024
OTHER, LETTER, NUMBER, SPACE = 0, 1, 2, 3
_WHITE = [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
U64 = np.uint64


@functools.cache
def classes() -> np.ndarray:
    """The class of each code point."""
    kind = np.array(list(map(unicodedata.category, map(chr, range(0x110000)))), "U2").view(np.uint32).reshape(-1, 2)[:, 0]
    table = np.zeros(0x110000, np.uint8)
    table[kind == ord("L")] = LETTER
    table[kind == ord("N")] = NUMBER
    table[_WHITE] = SPACE
    return table


_powers: list[np.ndarray] = [np.ones(1, U64), np.ones(1, U64)]


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        for k, b in enumerate((_BASE, _INVERSE)):
            x = np.full(max(n, BLOCK + 4096), b, U64)
            x[0] = 1
            _powers[k] = np.multiply.accumulate(x)
    return _powers[0], _powers[1]


def mix(h: np.ndarray) -> np.ndarray:
    """Spreads every bit of h over all 64 bits; a bijection."""
    h = h ^ (h >> U64(30))
    h = h * U64(0xBF58476D1CE4E5B9)
    h ^= h >> U64(27)
    h *= U64(0x94D049BB133111EB)
    h ^= h >> U64(31)
    return h


def blocks(texts: list[str | None], limit: int = BLOCK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """first, end, code points, offsets: texts[first:end] in one array, text i at offsets[i - first]. None counts as empty."""
    first, size = 0, 0
    for i in range(len(texts) + 1):
        n = len(texts[i] or "") if i < len(texts) else 0
        if i == len(texts) or size and size + n > limit or i - first >= BLOCK_TEXTS:
            if i > first:
                part = [t or "" for t in texts[first:i]]
                cps = np.frombuffer("".join(part).encode("utf-32-le", "surrogatepass"), np.uint32)
                offsets = np.zeros(len(part) + 1, np.int64)
                np.cumsum([len(t) for t in part], out=offsets[1:])
                yield first, i, cps, offsets
            first, size = i, 0
        size += n


def _edges(change: np.ndarray, offsets: np.ndarray) -> None:
    inner = offsets[:-1]
    change[inner[inner < len(change)]] = True


def word_spans(cps: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """start, end and document of each maximal run of letters and digits."""
    if not len(cps):
        e = np.zeros(0, np.int64)
        return e, e, e
    kind = classes()[cps]
    word = (kind == LETTER) | (kind == NUMBER)
    change = np.empty(len(cps), bool)
    change[0] = True
    np.not_equal(word[1:], word[:-1], out=change[1:])
    _edges(change, offsets)
    at = np.flatnonzero(change)
    ends = np.append(at[1:], len(cps))
    keep = word[at]
    starts, ends = at[keep], ends[keep]
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


_SHORT = np.zeros(128, bool)
_SHORT[[ord(c) for c in "stmd"]] = True


def pretoken_spans(cps: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """start, end and document of each pre-token of the byte-level BPE pattern:
    's|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+"""
    n = len(cps)
    if not n:
        e = np.zeros(0, np.int64)
        return e, e, e
    kind = classes()[cps]
    first = np.zeros(n + 1, bool)
    _edges(first, offsets)
    first[n] = True
    start = np.empty(n + 1, bool)
    start[0] = start[n] = True
    np.not_equal(kind[1:], kind[:-1], out=start[1:n])
    start |= first
    space = kind == SPACE
    # the last of a run of white space, before something else of the same text
    last = np.flatnonzero(space[:-1] & ~space[1:] & ~first[1:n]) if n > 1 else np.zeros(0, np.int64)
    start[last] = True
    start[last[cps[last] == 32] + 1] = False
    quote = np.flatnonzero(cps == 39)
    if len(quote):
        padded = np.append(cps, np.zeros(3, np.uint32))
        fresh = first[quote] | ((kind[quote - 1] != OTHER) & (cps[quote - 1] != 32))
        a, b = padded[quote + 1], padded[quote + 2]
        a = np.where(first[quote + 1], 0, a)
        b = np.where(first[np.minimum(quote + 2, n)], 0, b)
        two = fresh & _SHORT[np.minimum(a, 127)]
        three = fresh & ~two & (((a == ord("r")) | (a == ord("v"))) & (b == ord("e")) | (a == ord("l")) & (b == ord("l")))
        start[quote[two | three] + 1] = False
        start[quote[two] + 2] = True
        start[quote[three] + 2] = False
        start[quote[three] + 3] = True
    at = np.flatnonzero(start)
    starts, ends = at[:-1], at[1:]
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def span_hashes(cps: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span's characters, the same wherever it stands. It is a polynomial modulo 2**64, which some long
    words of two letters share (Thue and Morse's): what must be right whatever the text says compares the characters too."""
    up, down = _power(len(cps) + 1)
    total = np.zeros(len(cps) + 1, U64)
    np.cumsum((cps.astype(U64) + U64(1)) * up[: len(cps)], out=total[1:])
    h = (total[ends] - total[starts]) * down[starts]
    return mix(h ^ (ends - starts).astype(U64) * U64(0xD6E8FEB86659FD93))


def distinct_spans(cps: np.ndarray, starts: np.ndarray) -> pa.DictionaryArray:
    """The texts of spans that fill cps one after another. Equal ones are found by their bytes, not by hashes alone."""
    data = text_of(cps, 0, len(cps)).encode("utf-8", "surrogatepass")
    at = np.append(starts, len(cps))
    if len(data) != len(cps):
        more = np.zeros(len(cps) + 1, np.int32)
        np.cumsum((cps > 0x7F).view(np.int8) + (cps > 0x7FF).view(np.int8) + (cps > 0xFFFF).view(np.int8), out=more[1:])
        at = at + more[at]
    return pa.StringArray.from_buffers(len(starts), pa.py_buffer(at.astype(np.int32)), pa.py_buffer(data)).dictionary_encode()


def distinct_texts(cps: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For spans as in distinct_spans(): which distinct text each is, and these texts."""
    found = distinct_spans(cps, starts)
    return found.indices.to_numpy(), found.dictionary.to_numpy(zero_copy_only=False)


def word_hash(words: list[str]) -> np.ndarray:
    """The hash that span_hashes gives for each word; the words are in lower case already."""
    ends = np.cumsum([len(w) for w in words], dtype=np.int64)
    cps = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
    return span_hashes(cps, np.concatenate([[0], ends[:-1]]).astype(np.int64), ends) if words else np.zeros(0, U64)


def text_of(cps: np.ndarray, start: int, end: int) -> str:
    return cps[start:end].tobytes().decode("utf-32-le", "surrogatepass")


def slices(column, lower: bool = True) -> Iterator[tuple[int, list[str | None]]]:
    """First row and texts of a few rows at a time of an Arrow column, so that a batch is never held as Python strings."""
    for a in range(0, len(column), SLICE):
        texts = column.slice(a, SLICE).to_pylist()
        yield a, lowered(texts) if lower else texts


def lowered(texts: list[str | None]) -> list[str]:
    return [t.lower() if t else "" for t in texts]


def lookup(table: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Index of each h in the sorted table, -1 where it isn't there."""
    if not len(table):
        return np.full(len(h), -1, np.int64)
    at = np.searchsorted(table, h)
    at[at == len(table)] = 0
    return np.where(table[at] == h, at, -1)
