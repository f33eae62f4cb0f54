"""Word-level helpers for repeated passages: hashes of words, runs of windows, suffix automata."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

import numpy as np
import pyarrow as pa

LENGTH = 35  # words of the shortest repeat
GRAM = 6
_U = np.uint64
_TOP = _U(1 << 63)
_rng = np.random.Generator(np.random.PCG64(35))
_TABLE = _rng.integers(1, 2**63, 256, dtype=np.uint64)
_STEP = _U(0x9E3779B97F4A7C15)
_BACK = _U(pow(int(_STEP), -1, 1 << 64))
_SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
_FACTORS = _rng.integers(1, 2**63, GRAM + 1, dtype=np.uint64) | _U(1)


class Words:
    """The words of several texts: where they begin and end in ``data``, 64-bit hashes of them, and how many each text has.

    A hash is a polynomial over the bytes, cut out of a running sum; equal words have equal hashes wherever they stand.
    """

    def __init__(self, texts: pa.Array):
        column = texts.cast(pa.binary())
        ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
        body = column.buffers()[2]
        self.data = np.frombuffer(body, np.uint8)[ends[0] : ends[-1]] if body is not None else np.empty(0, np.uint8)
        ends -= ends[0]
        n = len(self.data)
        border = np.zeros(n + 1, bool)
        border[ends] = True
        space = _SPACE[self.data]
        self.begin = np.flatnonzero(~space & (np.concatenate([[True], space[:-1]])[:n] | border[:n]))
        self.behind = np.flatnonzero(~space & (np.concatenate([space[1:], [True]])[:n] | border[1:])) + 1
        self.sizes = np.diff(np.searchsorted(self.begin, ends))
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(_TABLE[self.data] * np.cumprod(np.full(n, _STEP, np.uint64)), out=total[1:])
        h = (total[self.behind] - total[self.begin]) * np.cumprod(np.full(n, _BACK, np.uint64))[self.begin]
        h = (h ^ (h >> _U(32))) * _STEP
        self.hashes = h ^ (h >> _U(29))

    def joined(self, first: int, behind: int) -> bytes:
        """These words with one space between them."""
        return b" ".join(self.data[self.begin[first] : self.behind[behind - 1]].tobytes().split())


def _lows(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` neighbours."""
    have = 1
    while have * 2 <= width:
        values = np.minimum(values[:-have], values[have:])
        have *= 2
    rest = width - have
    return np.minimum(values[:-rest], values[rest:]) if rest else values


def window_runs(hashes: np.ndarray, sizes: np.ndarray, heavy: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, ...]:
    """(key, text, first, behind, twice) of the runs of windows of ``length`` words that have the same key.

    ``hashes`` are the words of several texts of ``sizes`` words, one after the other. A window's key is the smallest hash
    of the ``GRAM`` words in a row within it, where the ``heavy`` ones (sorted) come after all others. Equal windows have
    equal keys. ``twice``: the key's words stand in the text more than once.
    """
    reach = length - GRAM + 1
    begin = np.cumsum(sizes) - sizes
    count = np.maximum(sizes - length + 1, 0)  # windows of each text
    if not count.any():
        none = np.empty(0, np.int64)
        return none, none, none, none, none.astype(bool)
    n = len(hashes) - GRAM + 1
    grams = np.zeros(n, np.uint64)
    for k in range(GRAM):
        grams = grams * _FACTORS[k] + hashes[k : k + n]
    grams = (grams ^ (grams >> _U(29))) * _FACTORS[GRAM]
    grams = (grams ^ (grams >> _U(32))) & ~_TOP
    if len(heavy):
        at = np.minimum(np.searchsorted(heavy, grams), len(heavy) - 1)
        grams[heavy[at] == grams] |= _TOP
    low = _lows(grams, reach)
    # Windows that lie in one text.
    text = np.repeat(np.arange(len(sizes)), count)
    place = np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count)
    own = low[np.repeat(begin, count) + place]
    start = np.flatnonzero(np.concatenate([[True], (own[1:] != own[:-1]) | (text[1:] != text[:-1])]))
    key, text = own[start], text[start]
    first = place[start]
    behind = first + np.diff(np.append(start, len(place)))
    # The places of keys: grams as small as the largest key of the windows around them.
    around = np.zeros(n + reach - 1, np.uint64)
    valid = np.repeat(begin, count) + place
    around[reach - 1 + valid] = own
    chosen = np.flatnonzero(_lows(~around, reach) == ~grams)
    names = grams[chosen] + (np.searchsorted(begin, chosen, side="right") - 1).astype(np.uint64) * _FACTORS[0]
    names.sort()
    several = names[1:][names[1:] == names[:-1]]
    return key.view(np.int64), text, first, behind, np.isin(key + text.astype(np.uint64) * _FACTORS[0], several)


class SuffixAutomaton:
    """The suffix automaton of several sequences, with the number of places that each state's strings end at."""

    def __init__(self):
        self.next: list[dict[int, int]] = [{}]
        self.link = [-1]
        self.length = [0]
        self.count = [0]

    def add(self, sequence: Iterable[int], weight: int = 1) -> None:
        """Insert a sequence that stands in ``weight`` places."""
        last, count = 0, self.count
        for symbol in sequence:
            last = self._extend(last, symbol)
            count[last] += weight

    def _state(self, moves: dict[int, int], length: int, link: int) -> int:
        self.next.append(moves)
        self.length.append(length)
        self.link.append(link)
        self.count.append(0)
        return len(self.link) - 1

    def _extend(self, last: int, symbol: int) -> int:
        moves, link, length = self.next, self.link, self.length
        known = moves[last].get(symbol)
        if known is not None:
            return known if length[known] == length[last] + 1 else self._clone(last, symbol, known)
        new = self._state({}, length[last] + 1, 0)
        at = last
        while at >= 0 and symbol not in moves[at]:
            moves[at][symbol] = new
            at = link[at]
        if at >= 0:
            known = moves[at][symbol]
            link[new] = known if length[known] == length[at] + 1 else self._clone(at, symbol, known)
        return new

    def _clone(self, at: int, symbol: int, known: int) -> int:
        """A state of its own for the strings of ``known`` that are no longer than those of ``at`` and the symbol."""
        moves, link = self.next, self.link
        clone = self._state(dict(moves[known]), self.length[at] + 1, link[known])
        link[known] = clone
        while at >= 0 and moves[at].get(symbol) == known:
            moves[at][symbol] = clone
            at = link[at]
        return clone

    def count_places(self) -> None:
        """After the last ``add``: what ends in a state also ends in the state of its shorter suffixes."""
        for state in np.argsort(np.array(self.length), kind="stable")[:0:-1].tolist():
            self.count[self.link[state]] += self.count[state]

    def matching(self, sequence: Iterable[int], places: int = 1) -> list[int]:
        """Matching statistics: at each position the length of the longest string ending there that ``places`` places have."""
        moves, link, length, count = self.next, self.link, self.length, self.count
        state = matched = 0
        out = []
        for symbol in sequence:
            while True:
                after = moves[state].get(symbol)
                if after is not None and count[after] >= places:
                    state, matched = after, matched + 1
                    break
                if not state:
                    matched = 0
                    break
                state = link[state]
                matched = length[state]
            out.append(matched)
        return out


def covered(matched: Sequence[int], least: int) -> list[tuple[int, int]]:
    """(begin, behind) of the maximal spans covered by matches of ``least`` symbols or more."""
    spans: list[tuple[int, int]] = []
    for end in np.flatnonzero(np.asarray(matched) >= least).tolist():
        begin = end + 1 - least
        if spans and begin <= spans[-1][1]:
            spans[-1] = (spans[-1][0], end + 1)
        else:
            spans.append((begin, end + 1))
    return spans
