"""Content-defined anchors of byte strings (robust winnowing) for exact-substring search.

Every window of ``length`` bytes selects the ``gram``-byte substring with the
smallest hash inside it (rightmost on ties). The choice depends on the
window's bytes alone, so two equal windows select the same gram at the same
offset: windows that are equal always meet under the same anchor gram.
"""

from __future__ import annotations

import numpy as np

_B = np.uint64(0x9E3779B97F4A7C15 | 1)
_B_INV = np.uint64(pow(int(_B), -1, 1 << 64))
_LOW = np.uint64(0xFFFFFFFF)


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    with np.errstate(over="ignore"):
        return np.multiply.accumulate(out)


class AnchorFinder:
    """Finds the anchors of many concatenated texts in vectorised passes."""

    def __init__(self, length: int, gram: int):
        if not 0 < gram < length:
            raise ValueError("gram must be shorter than the window")
        self.length, self.gram = length, gram
        self._pow = self._inv = np.empty(0, np.uint64)

    def _gram_hashes(self, data: np.ndarray) -> np.ndarray:
        n = len(data)
        if len(self._pow) < n + 1:
            self._pow, self._inv = _powers(_B, 2 * n + 1), _powers(_B_INV, 2 * n + 1)
        c = np.zeros(n + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * self._pow[:n], out=c[1:])
        m = n - self.gram + 1
        h = (c[self.gram:] - c[:m]) * self._inv[:m]
        h ^= h >> np.uint64(31)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        return h

    def find(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray):
        """Anchors of the texts ``data[starts[i]:ends[i]]``.

        Returns arrays (text index, anchor, lo, hi): positions in ``data``;
        the windows that start at lo..hi all select the gram at ``anchor``.
        Texts shorter than the window have none.
        """
        none = np.empty(0, np.int64)
        n = len(data)
        if n < self.length:
            return none, none, none, none
        h = self._gram_hashes(data)
        pos = np.arange(len(h), dtype=np.uint64)
        key = (h & ~_LOW) | (_LOW - pos)
        width, have = self.length - self.gram + 1, 1
        low = key
        while have * 2 <= width:
            low = np.minimum(low[:-have], low[have:])
            have *= 2
        if have < width:
            low = np.minimum(low[:len(low) - (width - have)], low[width - have:])
        pick = (_LOW - (low & _LOW)).astype(np.int64)
        # valid windows lie inside one text
        ok = np.zeros(n + 1, np.int8)
        long_enough = ends - starts >= self.length
        np.add.at(ok, starts[long_enough], 1)
        np.add.at(ok, ends[long_enough] - self.length + 1, -1)
        ok = np.cumsum(ok[:len(pick)], dtype=np.int8).astype(bool)
        at = np.flatnonzero(ok)
        if not len(at):
            return none, none, none, none
        p = pick[at]
        new = np.ones(len(at), bool)
        new[1:] = (p[1:] != p[:-1]) | (at[1:] != at[:-1] + 1)
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(at)) - 1
        lo, hi = at[first], at[last]
        text = np.searchsorted(starts, lo, "right") - 1
        return text, p[first], lo, hi
