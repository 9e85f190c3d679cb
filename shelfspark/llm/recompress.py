"""Recompression of word sequences: consistent names for repeated passages.

A sequence is renamed in rounds: maximal runs of one symbol become one symbol, then pairs whose symbols fall on opposite sides
of a partition of the alphabet do.  A name is a hash of what it stands for, so every task gives
equal runs and pairs equal names, and equal substrings have equal symbols but for
some at their ends, whose fate hangs on words outside.  How far the fate of a boundary between two
symbols reaches to its left and right is kept with it; a boundary that a window
determines by its own words is an anchor for it, and equal windows have equal anchors wherever they stand.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np

U = np.uint64
#: Base of the polynomial hashes, and its inverse modulo 2^64.
BASE = 0x9E3779B97F4A7C15 | 5
UNDO = pow(BASE, -1, 1 << 64)
#: Bytes of a text that are hashed at once; longer words are hashed alone.
PIECE_BYTES = 1 << 20
#: Words that are renamed together: many short texts or a part of a long one.
CHUNK_WORDS = 1 << 17
#: Rounds, of runs and of pairs in turn.  Three rounds of pairs leave symbols of 2.4 words on average, and some 16 words determine a boundary.
ROUNDS = 6
#: An extent that no window has room for.
FAR = 1 << 12
#: The name of the place between two texts.
EDGE = U(0)
SPACE = re.compile(rb"[\x20\x09-\x0D]")


class Powers:
    """Powers of BASE and of its inverse, grown on demand."""

    def __init__(self):
        self.up = self.down = np.ones(1, U)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > len(self.up):
            size = 1 << (n - 1).bit_length()
            grown = lambda m: np.concatenate((np.ones(1, U), np.cumprod(np.full(size - 1, m, U))))
            self.up, self.down = grown(BASE), grown(UNDO)
        return self.up, self.down


POWERS = Powers()


def mixed(h: np.ndarray) -> np.ndarray:
    """Spread a hash over all 64 bits."""
    h = h ^ (h >> U(31))
    h *= U(0xBF58476D1CE4E5B9)
    h ^= h >> U(27)
    h *= U(0x94D049BB133111EB)
    return h ^ (h >> U(31))


def spans_hash(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Polynomial hashes of ``values[start:end]``, equal for equal contents wherever they stand."""
    up, down = POWERS.get(len(values) + 1)
    sums = np.zeros(len(values) + 1, U)
    np.cumsum(values * up[: len(values)], out=sums[1:])
    return mixed((sums[ends] - sums[starts]) * down[starts])


def word_spans(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of every word: maximal stretches without ASCII white space."""
    black = np.zeros(len(raw) + 2, np.int8)
    black[1:-1] = (raw != 32) & ((raw < 9) | (raw > 13))
    turns = np.diff(black)
    return np.flatnonzero(turns == 1), np.flatnonzero(turns == -1)


def word_names(text: bytes) -> np.ndarray:
    """64-bit names of the words of one of the :func:`pieces` of a text."""
    if len(text) > 2 * PIECE_BYTES:
        return np.array([_long_name(text)], U)
    raw = np.frombuffer(text, np.uint8)
    starts, ends = word_spans(raw)
    names = spans_hash(raw.astype(U) + U(1), starts, ends) | U(1)
    for k in np.flatnonzero(ends - starts > PIECE_BYTES):
        names[k] = _long_name(text[starts[k] : ends[k]])
    return names


def _long_name(word: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little") | 1


def pieces(text: bytes):
    """Parts of a text of any length, cut at white space; those of more than twice PIECE_BYTES are single words."""
    at, size = 0, len(text)
    while at < size:
        near = min(size, at + PIECE_BYTES)
        space = SPACE.search(text, near)
        end = space.start() if space else size
        if end - near > PIECE_BYTES:
            start = max(at, max(text.rfind(bytes([c]), at, near) for c in (9, 10, 11, 12, 13, 32)) + 1)
            if start > at:
                yield text[at:start]
            yield text[start:end]
        else:
            yield text[at:end]
        at = end + bool(space)


def segments(text: bytes, window: int):
    """``(first, names)``: parts of a text that together hold each of its windows once."""
    held, first, size = [], 0, 0
    for names in map(word_names, pieces(text)):
        held.append(names)
        size += len(names)
        while size >= CHUNK_WORDS + window:
            every = np.concatenate(held)
            yield first, every[: CHUNK_WORDS + window - 1]
            held, first = [every[CHUNK_WORDS:]], first + CHUNK_WORDS
            size = len(held[0])
    if size >= window:
        yield first, np.concatenate(held)


def anchors(names: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For the window from every word on: where its anchor stands (-1: no window, it meets an edge), its round, its symbol.

    The anchor is one of the boundaries that outlive most rounds, as far as the window's words determine
    them: the one whose symbol is smallest, of equal ones the leftmost.  The symbol names the two symbols that the boundary parts and all
    words that determine it.  Windows in which no round leaves a boundary, as those of one repeated
    word, are anchored at their start in round 0 and have no symbol (0).
    """
    m = len(names)
    found = _rounds(names, window)
    place = np.full(m, -1, np.int64)
    level = np.zeros(m, np.int8)
    symbol = np.zeros(m, U)
    open_ = np.zeros(m, bool)  # windows without an anchor so far
    if m >= window:
        edges = np.concatenate(([0], np.cumsum(names == EDGE)))
        open_[: m - window + 1] = edges[window:] == edges[: m - window + 1]
    for r in range(len(found), 0, -1):
        p, near, far, key = found[r - 1]
        first, last = np.maximum(p + far - window, 0), np.minimum(p - near, m - window)
        todo = np.concatenate(([0], np.cumsum(open_)))
        use = np.flatnonzero((last >= first) & (todo[np.maximum(last + 1, 0)] > todo[first]))
        key = mixed(key[use] + spans_hash(names, p[use] - near[use], p[use] + far[use])) | U(1)
        order = np.argsort(key, kind="stable")[::-1]  # of several anchors of a window the last one written stays
        use, key = use[order], key[order]
        n = (last - first + 1)[use]
        which = np.repeat(np.arange(len(use)), n)
        windows = np.arange(len(which)) + np.repeat(first[use] - (np.cumsum(n) - n), n)
        keep = open_[windows]
        windows, which = windows[keep], which[keep]
        place[windows], symbol[windows], level[windows] = p[use][which], key[which], r
        open_[windows] = False
        if not open_.any():
            break
    rest = np.flatnonzero(open_)
    place[rest] = rest
    return place, level, symbol


def _rounds(names: np.ndarray, window: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """The boundaries that live after each round and that a window can determine: place, words to the left and right that do so, symbol."""
    m = len(names)
    found = []
    edge = names == EDGE
    symbols, at = names, np.arange(m + 1)
    left = right = np.zeros(m + 1, np.int64)
    for r in range(ROUNDS):
        if len(symbols) < 2:
            break
        a, b = symbols[:-1], symbols[1:]
        fixed = edge[:-1] | edge[1:]
        if r % 2 == 0:
            joined = (a == b) & ~fixed
        else:
            side = (symbols >> U(8 + r)) & U(1)
            joined = (side[:-1] < side[1:]) & ~fixed
        # the fate of a boundary hangs on the symbols beside it, so on whether the next boundaries are known to live
        size = np.diff(at)
        near, far = left[:-2] + size[:-1], right[2:] + size[1:]
        near[edge[:-1]] = FAR
        far[edge[1:]] = FAR
        near, far = np.minimum(near, FAR), np.minimum(far, FAR)
        alive = np.flatnonzero(~joined)
        fits = alive[(near + far)[alive] <= window]
        if not len(fits):
            break
        found.append((at[1:-1][fits], near[fits], far[fits], mixed(mixed(a[fits] + U(r + 1)) + b[fits])))
        heads = np.concatenate(([0], alive + 1))
        count = np.diff(np.concatenate((heads, [len(symbols)])))
        several = np.flatnonzero(count > 1)
        then = count.astype(U) if r % 2 == 0 else symbols[np.minimum(heads + 1, len(symbols) - 1)]
        fresh = symbols[heads]
        fresh[several] = mixed(mixed(fresh[several] + U(r)) + then[several] * U(BASE)) | U(1)
        left, right = np.concatenate(([FAR], near[alive], [FAR])), np.concatenate(([FAR], far[alive], [FAR]))
        at = np.concatenate(([0], at[1:-1][alive], [m]))
        symbols, edge = fresh, edge[heads]
    return found
