"""Vectorised pre-tokenisation: texts to pre-token spans and 64-bit word hashes.

Both public BPE files split a text by character class before any merge. The
splits are done here on arrays of code points, so that the cost a character
is a few array operations, and each pre-token gets a hash of its characters,
by which equal pre-tokens of a chunk are encoded once.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import regex

OTHER, LETTER, NUMBER, SPACE, SEP = 0, 1, 2, 3, 5
_TOP = 0x110000
#: Code points with the Unicode property White_Space (fixed values).
WHITE_SPACE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
#: Characters in one array step. A longer text is cut where no pre-token can span the cut.
STEP = 1 << 20
_SAFE = regex.compile(r"(?<=[A-Za-z])(?= [A-Za-z])")


@lru_cache(maxsize=1)
def tables() -> tuple[np.ndarray, np.ndarray]:
    """Class and random 64-bit value of each code point (one more for the separator)."""
    cls = np.zeros(_TOP + 1, np.uint8)
    for lo in range(0, _TOP, 0x10000):
        block = "".join(map(chr, range(lo, lo + 0x10000)))
        for k, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+")):
            for m in regex.finditer(pattern, block):
                cls[lo + m.start() : lo + m.end()] = k
    cls[WHITE_SPACE] = SPACE
    cls[_TOP] = SEP
    return cls, np.random.default_rng(20240229).integers(0, 2**64, _TOP + 1, np.uint64)


_P = np.uint64(0x9E3779B97F4A7C15)
_PI = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))


@lru_cache(maxsize=1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    both = []
    for p in (_P, _PI):
        a = np.full(n, p, np.uint64)
        a[0] = 1
        both.append(np.cumprod(a, dtype=np.uint64))
    return both[0], both[1]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = STEP * 2
    while size < n + 1:
        size *= 2
    return _powers(size)


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All texts with a separator after each; where each begins."""
    joined = "\0".join(texts) + "\0"
    cps = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32).copy()
    lens = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
    ends = np.cumsum(lens)
    cps[ends - 1] = _TOP
    return cps, ends - lens


def spans(cps: np.ndarray, byte_level: bool) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the pre-tokens.

    ``byte_level``: a space joins the run after it, other white space is kept,
    digits run together. Otherwise white space is dropped and each number
    character stands alone. In both, a run of other characters that begins
    with an apostrophe and one of s t re ve m ll d is split as a contraction.
    """
    g = tables()[0][cps]
    n = len(g)
    prev = np.empty_like(g)
    prev[0] = SEP
    prev[1:] = g[:-1]
    start = g != prev
    white = g == SPACE
    if byte_level:
        begins = np.flatnonzero(start & (prev == SPACE) & (g != SEP))
        start[begins - 1] = True
        start[begins[cps[begins - 1] == 32]] = False
    else:
        start |= g == NUMBER
    marks = np.flatnonzero(cps == 39)
    if len(marks):
        marks = marks[start[marks]] if byte_level else marks[prev[marks] != OTHER]
        at = lambda k: cps[np.minimum(marks + k, n - 1)]
        one, two = at(1), at(2)
        long = ((one == 114) & (two == 101)) | ((one == 118) & (two == 101)) | ((one == 108) & (two == 108))
        short = np.isin(one, (115, 116, 109, 100))
        for hit, k in ((short, 2), (long & ~short, 3)):
            m = marks[hit]
            start[m + 1] = False
            e = m + k
            start[e[g[e] == LETTER]] = True
    s = np.flatnonzero(start)
    e = np.append(s[1:], n)
    keep = g[s] != SEP if byte_level else (g[s] != SEP) & ~white[s]
    return s[keep], e[keep]


def hashes(cps: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the characters of each span, the same wherever it stands."""
    up, down = powers(len(cps))
    total = np.zeros(len(cps) + 1, np.uint64)
    np.cumsum(tables()[1][cps] * up[: len(cps)], out=total[1:])
    h = (total[e] - total[s]) * down[s]
    return h ^ ((e - s).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def pieces(text: str) -> list[str]:
    """The text, cut into steps between a letter and a space that a letter follows: every pre-token stays whole."""
    if len(text) <= STEP:
        return [text]
    out, lo = [], 0
    while len(text) - lo > STEP:
        m = _SAFE.search(text, lo + STEP // 2)
        if not m:
            break
        out.append(text[lo : m.start()])
        lo = m.start()
    out.append(text[lo:])
    return out
