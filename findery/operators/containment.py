"""Which texts of a set lie inside others, without comparing all pairs.

Every text is known by its anchor, the window of characters with the smallest hash in it. Wherever the text
occurs in another one, the anchor does. Window hashes of all texts come from one array of running sums, so
the places of all anchors are found by one look-up for each window length; what agrees in the hash of the
whole text is then compared character by character.
"""

from __future__ import annotations

import numpy as np

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
#: Lengths of the windows, and places looked at together.
WINDOWS = (1, 2, 4, 8, 16, 32)
AT_ONCE = 1 << 20


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


class _Hashes:
    """Hashes of all stretches of one array of characters."""

    def __init__(self, chars: np.ndarray):
        n = len(chars)
        steps = np.full(n + 1, _BASE)
        steps[0] = 1
        up = np.multiply.accumulate(steps)
        steps = np.full(n + 1, _INVERSE)
        steps[0] = 1
        self.down = np.multiply.accumulate(steps)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_mixed(chars.astype(np.uint64) + np.uint64(1)) * up[:n], out=self.sums[1:])

    def of(self, start: np.ndarray, length: np.ndarray | int) -> np.ndarray:
        return _mixed((self.sums[start + length] - self.sums[start]) * self.down[start])


def contained_pairs(texts: list[str]) -> list[tuple[int, int]]:
    """(inner, outer) for every text that lies inside a longer one; texts are distinct and not empty."""
    if not texts:
        return []
    chars = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    begin = np.cumsum(size) - size
    owner = np.repeat(np.arange(len(texts)), size)
    hashes = _Hashes(chars)
    whole = hashes.of(begin, size)
    found: dict[tuple[int, int], list[int]] = {}
    for k, width in enumerate(WINDOWS):
        mine = np.flatnonzero((size >= width) & ((size < 2 * width) | (k == len(WINDOWS) - 1)))
        if not len(mine):
            continue
        window = hashes.of(np.arange(len(chars) - width + 1), width)
        anchor = np.array([int(window[begin[t]: begin[t] + size[t] - width + 1].argmin()) for t in mine])
        names = window[begin[mine] + anchor]
        order = np.argsort(names, kind="stable")
        names, mine, anchor = names[order], mine[order], anchor[order]
        low, high = np.searchsorted(names, window, "left"), np.searchsorted(names, window, "right")
        at = np.flatnonzero(high > low)
        done = np.cumsum(high[at] - low[at])
        first = 0
        while first < len(at):
            last = max(first + 1, int(np.searchsorted(done, (done[first - 1] if first else 0) + AT_ONCE, "right")))
            place, a, b = at[first:last], low[at[first:last]], high[at[first:last]]
            first = last
            which = np.repeat(a - (np.cumsum(b - a) - (b - a)), b - a) + np.arange((b - a).sum())
            start, t, s = np.repeat(place, b - a) - anchor[which], mine[which], owner[np.repeat(place, b - a)]
            fits = (s != t) & (start >= begin[s]) & (start + size[t] <= begin[s] + size[s])
            start, t, s = start[fits], t[fits], s[fits]
            same = hashes.of(start, size[t]) == whole[t]
            for i, o, p in zip(t[same].tolist(), s[same].tolist(), (start - begin[s])[same].tolist()):
                found.setdefault((i, o), []).append(p)
    return [(i, o) for (i, o), places in found.items() if any(texts[o].startswith(texts[i], p) for p in places)]


def first_apart(texts: list[str]) -> list[int]:
    """Places of the texts that stay when each one goes that contains, or lies in, one that stayed before it."""
    distinct: dict[str, int] = {}
    for at, text in enumerate(texts):
        distinct.setdefault(text, at)  # a copy lies in its original, or goes with it
    if "" in distinct:  # it lies in every text
        if distinct[""] == 0:
            return [0]
        del distinct[""]
    names, order = list(distinct), list(distinct.values())
    beside: list[list[int]] = [[] for _ in names]
    for inner, outer in contained_pairs(names):
        beside[inner].append(outer)
        beside[outer].append(inner)
    gone, kept = [False] * len(names), []
    for number, at in enumerate(order):
        if not gone[number]:
            kept.append(at)
            for other in beside[number]:
                gone[other] = True
    return kept
