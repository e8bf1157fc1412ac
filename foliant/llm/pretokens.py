r"""Pre-tokenisation without regular expressions.

Boundaries of the pattern

    's|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+

come from an array of code-point classes and one scan. The scan runs a machine of four states over the classes: what it
does to the state at each code point is a function, kept as four 2-bit results in one byte; functions compose by a
table, and composition is associative, so whole columns of blocks compose at once and blocks combine afterwards. A
text's first code point has a constant function, which keeps texts apart.
"""

from __future__ import annotations

import unicodedata

import numpy as np

LETTER, NUMBER, SPACE, WHITE, OTHER = range(5)
#: State before a code point: an apostrophe may begin a contraction; may not (a run of others, or a space, takes it in);
#: the contraction's last letter comes; its last two come.
FREE, TAKEN, LAST, TWO = range(4)
_WHITE = [*range(9, 14), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
_tables: dict = {}


def _function(*to: int) -> int:
    return sum(s << (2 * i) for i, s in enumerate(to))


_TO_FREE = _function(FREE, FREE, FREE, LAST)  # letters, numbers, white space
_TO_TAKEN = _function(TAKEN, TAKEN, TAKEN, TAKEN)  # others, spaces
_SHORT = _function(LAST, TAKEN, TAKEN, TAKEN)  # apostrophe before s, t, m, d
_LONG = _function(TWO, TAKEN, TAKEN, TAKEN)  # apostrophe before re, ve, ll
_IDENTITY = _function(0, 1, 2, 3)
_BLOCK = 256


def tables() -> tuple[np.ndarray, np.ndarray]:
    """Class of each code point; composition of two functions (first << 8 | second)."""
    if not _tables:
        kinds = np.full(0x110000, OTHER, np.uint8)
        for cp in range(0x110000):
            k = unicodedata.category(chr(cp))[0]
            if k in "LN":
                kinds[cp] = LETTER if k == "L" else NUMBER
        kinds[_WHITE] = WHITE
        kinds[32] = SPACE
        f = np.arange(256)
        then = np.zeros((256, 256), np.uint8)
        for s in range(4):
            mid = (f >> (2 * s)) & 3
            then |= (((f[None, :] >> (2 * mid[:, None])) & 3) << (2 * s)).astype(np.uint8)
        _tables["kinds"], _tables["then"] = kinds, then.ravel()
    return _tables["kinds"], _tables["then"]


def scan(functions: np.ndarray) -> np.ndarray:
    """For each place the composition of all functions up to it."""
    _, then = tables()
    n = len(functions)
    if n <= 1:
        return functions.copy()
    rows = -(-n // _BLOCK)
    f = np.full(rows * _BLOCK, _IDENTITY, np.uint8)
    f[:n] = functions
    f = np.ascontiguousarray(f.reshape(rows, _BLOCK).T)
    for j in range(1, _BLOCK):
        f[j] = then[(f[j - 1].astype(np.uint16) << 8) | f[j]]
    if rows > 1:
        before = np.concatenate([np.array([_IDENTITY], np.uint8), scan(f[-1])[:-1]])
        f = then[(before.astype(np.uint16) << 8)[None, :] | f]
    return np.ascontiguousarray(f.T).ravel()[:n]


def code_points(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each code point of valid UTF-8 and where its bytes begin."""
    at = np.flatnonzero((data & 0xC0) != 0x80)
    lead = data[at]
    cp = lead.astype(np.int32)
    if len(at) != len(data):
        pad = np.concatenate([data, np.zeros(3, np.uint8)])
        for low, high, keep, more in ((0xC0, 0xE0, 0x1F, 1), (0xE0, 0xF0, 0x0F, 2), (0xF0, 0x100, 0x07, 3)):
            some = np.flatnonzero((lead >= low) & (lead < high if high < 0x100 else True))
            got = (lead[some] & keep).astype(np.int32)
            for k in range(1, more + 1):
                got = (got << 6) | (pad[at[some] + k] & 0x3F)
            cp[some] = got
    return cp, at


def pieces(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of all pieces, and each text's range in them (one more than texts)."""
    kinds, _ = tables()
    cp, at = code_points(data)
    n = len(cp)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offs), np.int64)
    kind = kinds[cp]
    first = np.zeros(n + 1, bool)
    first[np.searchsorted(at, offs)] = True  # a text's first code point; also one past the last
    function = np.where((kind == SPACE) | (kind == OTHER), _TO_TAKEN, _TO_FREE).astype(np.uint8)
    mark = np.flatnonzero(cp == 39)
    if len(mark):
        one, two = (np.where(mark + k < n, cp[np.minimum(mark + k, n - 1)], 0) for k in (1, 2))
        same1 = ~first[mark + 1]
        same2 = same1 & ~first[np.minimum(mark + 2, n)]
        short = same1 & np.isin(one, [ord(x) for x in "stmd"])
        long = same2 & (((one == ord("r")) & (two == ord("e"))) | ((one == ord("v")) & (two == ord("e"))) | ((one == ord("l")) & (two == ord("l"))))
        function[mark[short]], function[mark[long]] = _SHORT, _LONG
    start_at = np.flatnonzero(first[:n])
    function[start_at] = (function[start_at] & 3) * np.uint8(0b01010101)  # from FREE, whatever came before
    state = np.empty(n, np.uint8)  # before each code point
    state[0] = FREE
    state[1:] = scan(function)[:-1] & 3
    state[start_at] = FREE
    white = (kind == SPACE) | (kind == WHITE)
    start = first[:n].copy()
    w0, w1 = white[:-1], white[1:]
    followed = np.zeros(n, bool)  # by something else than white space, in the same text
    followed[:-1] = ~white[1:] & ~first[1:n]
    begins = np.where(
        w1,
        ~w0 | followed[1:],
        np.where(w0, kind[:-1] == WHITE, ((kind[:-1] != kind[1:]) & (state[1:] != LAST) & (state[1:] != TWO)) | (state[:-1] == LAST)),
    )
    start[1:] |= begins
    starts = at[np.flatnonzero(start)]
    return starts, np.append(starts[1:], len(data)), np.searchsorted(starts, offs)
