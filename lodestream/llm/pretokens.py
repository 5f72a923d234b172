"""Vectorised pre-tokenisation over UTF-8 bytes, and exact keys for the pieces.

``piece_starts`` marks where each match of the byte-level BPE pattern

    's|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+

begins, for a whole batch of texts at once: a class per character, then boundaries from class changes, the
blank that joins the following run, the last white space before a word, and the contractions.
"""

from __future__ import annotations

import sys
import unicodedata
from functools import lru_cache

import numpy as np

LETTER, NUMBER, SPACE = 1, 2, 3
#: Unicode White_Space, which is what \s matches in the pattern.
WHITE_SPACE = (*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)
PAD = 16
#: Beyond planes 0 to 3 Unicode has no letters and no numbers.
LAST_PLANES = 0x40000


@lru_cache(maxsize=1)
def char_classes() -> np.ndarray:
    kinds = {"L": LETTER, "N": NUMBER}
    table = np.zeros(sys.maxunicode + 1, np.uint8)
    table[:LAST_PLANES] = np.fromiter((kinds.get(unicodedata.category(chr(c))[0], 0) for c in range(LAST_PLANES)), np.uint8, LAST_PLANES)
    table[list(WHITE_SPACE)] = SPACE
    return table


def padded(buf: np.ndarray) -> np.ndarray:
    out = np.zeros(len(buf) + PAD, np.uint8)
    out[: len(buf)] = buf
    return out


def code_points(pad: np.ndarray, pos: np.ndarray) -> np.ndarray:
    """Code points of the characters whose first bytes stand at ``pos``."""
    b0 = pad[pos]
    out = b0.astype(np.int32)
    for least, most, mask, extra in ((0xC0, 0xDF, 31, 1), (0xE0, 0xEF, 15, 2), (0xF0, 0xFF, 7, 3)):
        at = np.flatnonzero((b0 >= least) & (b0 <= most))
        if len(at):
            cp = (b0[at] & mask).astype(np.int32)
            for k in range(1, extra + 1):
                cp = (cp << 6) | (pad[pos[at] + k] & 63)
            out[at] = cp
    return out


def piece_starts(pad: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Byte offsets, ascending, where the pattern's matches begin in the texts between ``offs``."""
    n = int(offs[-1])
    if n == 0:
        return np.zeros(0, np.int64)
    buf = pad[:n]
    pos = np.flatnonzero((buf & 0xC0) != 0x80)
    b0 = buf[pos]
    cls = char_classes()[code_points(pad, pos)]
    m = len(pos)
    first = np.zeros(m, bool)
    begins = offs[:-1][np.diff(offs) > 0]
    first[np.searchsorted(pos, begins)] = True
    white = cls == SPACE
    change = first.copy()
    change[1:] |= cls[1:] != cls[:-1]
    after_blank = np.zeros(m, bool)
    after_blank[1:] = b0[:-1] == 0x20
    after_blank &= ~first
    before_word = np.zeros(m, bool)
    before_word[:-1] = ~white[1:] & ~first[1:]
    start = np.where(white, change | before_word, change & ~after_blank)
    quote = np.flatnonzero((b0 == 0x27) & start)
    quote = quote[quote + 1 < m]
    quote = quote[~first[quote + 1]]
    if len(quote):
        c1 = b0[quote + 1]
        has2 = (quote + 2 < m) & ~first[np.minimum(quote + 2, m - 1)]
        c2 = np.where(has2, b0[np.minimum(quote + 2, m - 1)], 0)
        one = np.isin(c1, list(b"stmd"))
        two = ((c1 == ord("r")) & (c2 == ord("e"))) | ((c1 == ord("v")) & (c2 == ord("e"))) | ((c1 == ord("l")) & (c2 == ord("l")))
        for at, size in ((quote[one], 2), (quote[two], 3)):
            start[at + 1] = False
            rest = at + size
            rest = rest[rest < m]
            start[rest[~first[rest] & (cls[rest] == LETTER)]] = True
    return pos[start].astype(np.int64)


_MASK = np.array([(1 << (8 * k)) - 1 for k in range(8)] + [2**64 - 1], np.uint64)
_C = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)]


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _C[1]
    x = (x ^ (x >> np.uint64(27))) * _C[2]
    return x ^ (x >> np.uint64(31))


def _word(pad: np.ndarray, start: np.ndarray, size: np.ndarray, k: int) -> np.ndarray:
    """The k-th eight bytes of each piece, zero beyond its end."""
    view = np.ndarray((len(pad) - 7,), "<u8", buffer=pad, strides=(1,))
    return view[start + 8 * k] & _MASK[np.minimum(size - 8 * k, 8)]


def piece_hash(pad: np.ndarray, start: np.ndarray, size: np.ndarray, seed: int = 0) -> np.ndarray:
    h = mixed(size.astype(np.uint64) * _C[0] + np.uint64(seed))
    k, at = 0, np.flatnonzero(size > 0)
    while len(at):
        whole = len(at) == len(size)
        s, z = (start, size) if whole else (start[at], size[at])
        got = mixed((h if whole else h[at]) ^ _word(pad, s, z, k) * _C[0])
        if whole:
            h = got
        else:
            h[at] = got
        k += 1
        at = np.flatnonzero(size > 8 * k)
    return h


def same_pieces(
    pad_a: np.ndarray, start_a: np.ndarray, size_a: np.ndarray, pad_b: np.ndarray, start_b: np.ndarray, size_b: np.ndarray
) -> np.ndarray:
    """Whether the pieces are equal, byte for byte."""
    same = size_a == size_b
    k, at = 0, np.flatnonzero(same & (size_a > 0))
    while len(at):
        bad = _word(pad_a, start_a[at], size_a[at], k) != _word(pad_b, start_b[at], size_b[at], k)
        same[at[bad]] = False
        k += 1
        at = at[~bad]
        at = at[size_a[at] > 8 * k]
    return same


def distinct_pieces(pad: np.ndarray, start: np.ndarray, size: np.ndarray, h: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(index of one piece of each kind, kind of every piece); hash collisions are found by bytes and rehashed."""
    seed = 0
    h = piece_hash(pad, start, size) if h is None else h
    while True:
        _, index, kind = np.unique(h, return_index=True, return_inverse=True)
        rep = index[kind]
        if same_pieces(pad, start, size, pad, start[rep], size[rep]).all():
            return index, kind
        seed += 1
        h = piece_hash(pad, start, size, seed)


def cut_points(pad: np.ndarray, a: int, b: int, limit: int) -> list[int]:
    """Offsets in (a, b) where a long text can be cut without changing its pieces: before a blank after a non-white ASCII byte."""
    out, at = [], a
    while b - at > limit:
        part = pad[at + limit // 2 : min(at + limit * 2, b)]
        ok = np.flatnonzero((part[1:] == 0x20) & (part[:-1] > 0x20) & (part[:-1] < 0x7F))
        at = at + limit // 2 + 1 + int(ok[0]) if len(ok) else min(at + limit * 2, b)
        if len(ok):
            out.append(at)
    return out
