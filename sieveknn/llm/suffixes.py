"""Byte-level helpers for repeated passages: window keys, packed records, enhanced suffix arrays; numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import zstandard

LENGTH = 50  # bytes of the shortest repeat
GRAM = 24
_REACH = LENGTH - GRAM + 1
_U = np.uint64
_rng = np.random.Generator(np.random.PCG64(50))
_TABLE = _rng.integers(1, 2**63, 256, dtype=np.uint64)
_BYTES = np.array([1 << 8 * k for k in range(1, 8)], np.uint64)
_FACTORS = _rng.integers(1, 2**63, 6, dtype=np.uint64) | _U(1)


def _lows(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` neighbours."""
    have = 1
    while have * 2 <= width:
        values = np.minimum(values[:-have], values[have:])
        have *= 2
    rest = width - have
    return np.minimum(values[:-rest], values[rest:]) if rest else values


def window_runs(text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, first, behind) of the runs of 50-byte windows that have the same key.

    A window's key is the smallest hash of the 24-byte strings in it: equal windows have equal keys, and a key
    changes every 14 bytes or so.
    """
    if len(text) < LENGTH:
        return np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
    h = _TABLE[np.frombuffer(text, np.uint8)]
    size, eight = 1, None
    for factor in _FACTORS[:4]:
        h = h[:-size] * factor + h[size:]
        size *= 2
        if size == 8:
            eight = h
    n = len(text) - GRAM + 1
    h = h[:n] * _FACTORS[4] + eight[16 : 16 + n]
    h = (h ^ (h >> _U(29))) * _FACTORS[5]
    low = _lows(h ^ (h >> _U(32)), _REACH)
    cuts = np.flatnonzero(low[1:] != low[:-1]) + 1
    first = np.concatenate([[0], cuts])
    return low[first], first, np.concatenate([cuts, [len(low)]])


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays of one length as a compressed blob, byte planes apart so that constant ones vanish."""
    planes = [np.ascontiguousarray(a).view(np.uint8).reshape(len(a), -1).T.tobytes() if len(a) else b"" for a in arrays]
    return zstandard.ZstdCompressor(level=1).compress(b"".join(planes))


def unpack(blob: bytes, *kinds) -> list[np.ndarray]:
    data = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8)
    n = len(data) // sum(np.dtype(k).itemsize for k in kinds)
    out, at = [], 0
    for kind in kinds:
        size = np.dtype(kind).itemsize
        out.append(np.ascontiguousarray(data[at : at + n * size].reshape(size, n).T).view(kind).reshape(n))
        at += n * size
    return out


def split_rows(owner: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(value, row numbers) for each value of ``owner``."""
    order = np.argsort(owner, kind="stable")
    cuts = np.flatnonzero(np.diff(owner[order])) + 1
    for part in np.split(order, cuts):
        if len(part):
            yield int(owner[part[0]]), part


class SuffixArray:
    """Enhanced suffix array of the windows of some records (pieces of texts).

    ``order`` sorts the windows by what follows them in their record, ``lcp[i]`` is the length that windows i - 1 and i
    of that order share. Both look at ``reach`` bytes of a window, so a record of one repeated phrase, which can be
    very long, costs no more than others.
    """

    def __init__(self, data: np.ndarray, begin: np.ndarray, size: np.ndarray, windows: np.ndarray, reach: int = 80):
        """Record k is ``data[begin[k] : begin[k] + size[k]]``; a window starts at each of its first ``windows[k]`` bytes."""
        # Room behind each record, so that words read behind it are zero.
        room = size + 32
        at = np.concatenate([[0], np.cumsum(room)])
        text = np.zeros(int(at[-1]) + 64, np.uint8)
        inside = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
        text[np.repeat(at[:-1], size) + inside] = data[np.repeat(begin, size) + inside]
        self.record = np.repeat(np.arange(len(size)), windows)
        self.offset = np.arange(int(windows.sum())) - np.repeat(np.cumsum(windows) - windows, windows)
        start = at[:-1][self.record] + self.offset
        left = np.minimum(size[self.record] - self.offset, reach)
        word = text.astype(np.uint64)
        for step in (1, 2, 4):
            word = (word[:-step] << _U(8 * step)) | word[step:]
        marks = range(0, -(-int(left.max(initial=0)) // 8) * 8, 8)
        keys = [word[np.minimum(start + k, len(word) - 1)] for k in marks]
        # Behind a record's end all words are zero; the length settles what zero bytes of a text would leave open.
        for k, key in zip(marks, keys, strict=True):
            key[left <= k] = 0
            cut = left < k + 8
            key[cut] &= ~_U(0) << (_U(8) * (k + 8 - left[cut]).clip(0, 7).astype(np.uint64))
        self.order = np.lexsort([left, *reversed(keys)]) if len(left) else np.empty(0, np.int64)
        same = np.zeros(len(left), np.int64)
        open_ = np.ones(max(0, len(left) - 1), bool)
        for key in keys:
            a, b = key[self.order[:-1]], key[self.order[1:]]
            differ = a ^ b
            bits = differ != 0
            equal = np.where(bits, 7 - np.searchsorted(_BYTES, differ, side="right"), 8)  # leading bytes of two words
            same[1:] += np.where(open_, equal, 0)
            open_ &= ~bits
        ordered = left[self.order]
        same[1:] = np.minimum(same[1:], np.minimum(ordered[1:], ordered[:-1]))
        self.lcp = same

    def intervals(self, least: int) -> list[tuple[int, int, int]]:
        """(length, low, behind) of every common-prefix interval of ``least`` bytes or more, children before parents.

        One scan over the array: the stack holds the open intervals, each longer than the one below.
        """
        found: list[tuple[int, int, int]] = []
        stack: list[tuple[int, int]] = []
        hot = np.flatnonzero(self.lcp >= least)
        lcp = self.lcp
        before = -2
        for i, value in zip(hot.tolist(), lcp[hot].tolist(), strict=True):
            if i != before + 1:  # a gap closes all that is open
                while stack:
                    length, low = stack.pop()
                    found.append((length, low, before + 1))
            low = i - 1
            while stack and stack[-1][0] > value:
                length, low = stack.pop()
                found.append((length, low, i))
            if not stack or stack[-1][0] < value:
                stack.append((value, low))
            before = i
        while stack:
            length, low = stack.pop()
            found.append((length, low, before + 1))
        return found
