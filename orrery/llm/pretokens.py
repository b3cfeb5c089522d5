"""Vectorised pre-tokenisation: codepoint classes, runs, and an associative scan of transition functions.

The boundaries are those of the pattern
    's|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+
but no regular expression runs over the text. A text is cut into runs of one class (letter, number,
space, other). What a run does depends on a state with three values, left by the runs before it:
FREE (a token starts at the run), GLUED (the last space of the run before belongs to it) and
SUFFIX (an apostrophe waits for its contraction). Each run is a function from state to state; such
functions compose associatively, so all states come from one parallel prefix scan.
"""

from __future__ import annotations

import functools
import sys

import numpy as np

LETTER, NUMBER, SPACE, OTHER = range(4)
FREE, GLUED, SUFFIX = range(3)
#: The code points with the Unicode property White_Space.
WHITE_SPACE = (*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)
#: What may follow an apostrophe as a contraction.
CONTRACTIONS = ("s", "t", "re", "ve", "m", "ll", "d")


@functools.cache
def classes() -> np.ndarray:
    """The class of every code point."""
    import regex

    table = np.full(sys.maxunicode + 1, OTHER, np.uint8)
    points = [x for x in range(sys.maxunicode + 1) if not 0xD800 <= x <= 0xDFFF]
    every = "".join(map(chr, points))
    for name, value in ((r"\p{L}+", LETTER), (r"\p{N}+", NUMBER)):
        for m in regex.finditer(name, every):
            table[points[m.start()] : points[m.end() - 1] + 1] = value
    table[0xD800:0xE000] = OTHER
    table[list(WHITE_SPACE)] = SPACE
    return table


def _code(f: tuple[int, int, int]) -> int:
    return f[0] | f[1] << 2 | f[2] << 4


def _compose_table() -> np.ndarray:
    """table[f, g]: the code of the function that applies f, then g."""
    decode = [(c & 3, c >> 2 & 3, c >> 4 & 3) for c in range(64)]
    out = np.zeros((64, 64), np.uint8)
    for i, f in enumerate(decode):
        for j, g in enumerate(decode):
            if max(f) < 3 and max(g) < 3:
                out[i, j] = _code((g[f[0]], g[f[1]], g[f[2]]))
    return out


TO_FREE, TO_GLUED, APOSTROPHE = _code((FREE, FREE, FREE)), _code((GLUED, GLUED, GLUED)), _code((SUFFIX, FREE, SUFFIX))
IDENTITY = _code((FREE, GLUED, SUFFIX))
COMPOSE = _compose_table()


def scan(codes: np.ndarray, width: int = 64) -> np.ndarray:
    """Inclusive prefix composition: doubling within rows of `width`, then over the rows' totals."""
    n = len(codes)
    if n <= 1:
        return codes.copy()
    rows = np.full(-(-n // width) * width, IDENTITY, np.uint8)
    rows[:n] = codes
    rows = rows.reshape(-1, width)
    step = 1
    while step < width:
        rows[:, step:] = COMPOSE[rows[:, :-step], rows[:, step:]]
        step *= 2
    if len(rows) > 1:
        before = scan(rows[:, -1].copy(), width)
        rows[1:] = COMPOSE[before[:-1, None], rows[1:]]
    return rows.reshape(-1)[:n]


def _suffix(points: np.ndarray, at: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Length of the contraction that starts at each position and ends before `ends`, else 0."""
    out = np.zeros(len(at), np.int64)
    for text in CONTRACTIONS:
        fits = at + len(text) <= ends
        for k, c in enumerate(text):
            fits &= points[np.minimum(at + k, len(points) - 1)] == ord(c)
        out[fits] = len(text)
    return out


def boundaries(points: np.ndarray, doc_starts: np.ndarray) -> np.ndarray:
    """Sorted token starts over texts laid end to end; points: code points, doc_starts: where texts start."""
    n = len(points)
    if not n:
        return np.zeros(0, np.int64)
    kind = classes()[points]
    edge = np.empty(n, bool)
    edge[0] = True
    np.not_equal(kind[1:], kind[:-1], out=edge[1:])
    edge[doc_starts[doc_starts < n]] = True
    start = np.flatnonzero(edge)
    end = np.append(start[1:], n)
    kinds, size = kind[start], end - start
    opens = np.zeros(n + 1, bool)
    opens[doc_starts] = True
    last = opens[end] | (end == n)  # the text ends here
    space = kinds == SPACE
    glue = space & ~last & (points[end - 1] == 0x20)
    after = np.append(start[1:], 0)
    letters = np.append(kinds[1:] == LETTER, False) & ~last
    mark = (kinds == OTHER) & (size == 1) & (points[start] == ord("'")) & letters
    length = np.zeros(len(start), np.int64)
    at = np.flatnonzero(mark)
    length[at] = _suffix(points, after[at], end[np.minimum(at + 1, len(end) - 1)])
    codes = np.full(len(start), TO_FREE, np.uint8)
    codes[glue] = TO_GLUED
    codes[length > 0] = APOSTROPHE
    state = np.empty(len(start), np.uint8)
    state[0] = FREE
    state[1:] = scan(codes)[:-1] & 3  # the state after the runs before, from FREE
    cut = np.zeros(n + 1, bool)
    cut[start[state == FREE]] = True
    cut[start[state == GLUED] - 1] = True
    waits = np.flatnonzero(state == SUFFIX)
    rest = start[waits] + length[waits - 1]
    cut[rest[rest < end[waits]]] = True
    alone = space & ~last & (size > 1) & ~glue  # the last of several spaces is a token of its own
    cut[end[alone] - 1] = True
    return np.flatnonzero(cut[:n])


def slices(texts: list[str | None]) -> tuple[bytes, np.ndarray, np.ndarray]:
    """The texts' UTF-8 bytes end to end, the token starts in them plus the end, and each text's first token."""
    joined = "".join(x for x in texts if x)
    data = joined.encode("utf-8", "surrogatepass")
    lengths = np.array([len(x) if x else 0 for x in texts], np.int64)
    starts = np.concatenate([[0], np.cumsum(lengths)])
    if len(data) == len(joined):
        points = np.frombuffer(data, np.uint8)
        cut = boundaries(points, starts[:-1])
        at = cut
    else:
        points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        cut = boundaries(points, starts[:-1])
        more = (points >= 0x80).view(np.uint8) + (points >= 0x800) + (points >= 0x10000)
        extra = np.zeros(len(points) + 1, np.int32)
        np.cumsum(more, out=extra[1:])
        at = cut + extra[cut]
    return data, np.append(at, len(data)), np.searchsorted(cut, starts)


def distinct(data: bytes, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the slices data[at[k]:at[k + 1]]: positions that hold every different slice, and which of them each slice equals.

    Slices of up to 15 bytes are two 64-bit words with the length in the last byte, longer ones stand for themselves.
    Equal words are found by sorting a hash of them and then compared; should two differ under one hash, all stand for themselves.
    """
    n = len(at) - 1
    size = np.diff(at)
    short = np.flatnonzero(size < 16)
    words = np.ndarray(len(data) + 8, "<u8", np.frombuffer(data + bytes(16), np.uint8), strides=(1,))  # the 8 bytes at every place
    keep = np.array([(1 << 8 * k) - 1 for k in range(8)] + [(1 << 64) - 1] * 8, np.uint64)  # of the low word
    start, own = at[short], size[short]
    low = words[start] & keep[own]
    high = (words[np.minimum(start + 8, len(data))] & keep[np.maximum(own - 8, 0)]) | own.astype(np.uint64) << np.uint64(56)
    key = (low ^ (high * np.uint64(0x9E3779B97F4A7C15))) * np.uint64(0xC2B2AE3D27D4EB4F)
    key ^= key >> np.uint64(32)
    order = np.argsort(key)
    key = key[order]
    new = np.empty(len(key), bool)
    new[:1] = True
    np.not_equal(key[1:], key[:-1], out=new[1:])
    one = order[new]
    same = np.empty(len(key), np.int64)
    same[order] = np.cumsum(new) - 1
    if (low != low[one][same]).any() or (high != high[one][same]).any():
        return np.arange(n), np.arange(n)
    inverse = np.empty(n, np.int64)
    inverse[short] = same
    long = np.flatnonzero(size >= 16)
    inverse[long] = len(one) + np.arange(len(long))
    return np.concatenate([short[one], long]), inverse
