"""Suffix sorting by external induced sorting.

The sorted suffixes and the common prefixes of neighbours are induced from the sorted LMS suffixes
(those at the start of a rise): popping a suffix, in order, settles the place of the one
before it. The priority queue is a row of first-in-first-out queues, one per first
symbol, popped from the least symbol up (then from the largest down); a queue beyond
its share of memory goes on in a file. The LMS substrings are named by the same induction and the
names sorted recursively; where names are too many to keep a queue each, by doubling.
"""

from __future__ import annotations

import tempfile

import numpy as np

#: Most symbols that get a queue each; rows in memory before queues go to disk.
SYMBOLS, IN_MEMORY = 4096, 1 << 22


class Queues:
    """One queue of (suffix, common prefix) rows per symbol, with a shared memory budget and files for the rest."""

    def __init__(self, symbols: int, budget: int):
        self.parts: list[list] = [[] for _ in range(symbols)]
        self.held, self.budget, self.folder = 0, budget, None

    def push(self, symbol: int, suffix: np.ndarray, lcp: np.ndarray) -> None:
        self.parts[symbol].append((suffix, lcp))
        self.held += len(suffix)
        if self.held > self.budget:
            self._spill()

    def _spill(self) -> None:
        if self.folder is None:
            self.folder = tempfile.TemporaryFile()  # of this task only, gone when it ends
        for parts in self.parts:
            for i, part in enumerate(parts):
                if isinstance(part[0], np.ndarray):
                    at = self.folder.seek(0, 2)
                    part[0].tofile(self.folder)
                    part[1].tofile(self.folder)
                    parts[i] = (at, len(part[0]))
        self.held = 0

    def _load(self, part) -> tuple[np.ndarray, np.ndarray]:
        if isinstance(part[0], np.ndarray):
            self.held -= len(part[0])
            return part
        self.folder.seek(part[0])
        return np.fromfile(self.folder, np.int64, part[1]), np.fromfile(self.folder, np.uint8, part[1])

    def pop(self, symbol: int) -> tuple[np.ndarray, np.ndarray]:
        parts = [self._load(p) for p in self.parts[symbol]]
        self.parts[symbol] = []
        if not parts:
            return np.zeros(0, np.int64), np.zeros(0, np.uint8)
        return tuple(np.concatenate(x) for x in zip(*parts))

    def close(self) -> None:
        if self.folder is not None:
            self.folder.close()


def rises(text: np.ndarray) -> np.ndarray:
    """Whether each suffix is smaller than the next one; the last is (it ends in the least symbol)."""
    step = np.sign(np.diff(text.astype(np.int64)))
    at = np.where(step != 0, np.arange(len(step)), len(step))
    nxt = np.minimum.accumulate(at[::-1])[::-1]
    return np.append(np.append(step, 1)[nxt] > 0, True)


def common_prefix(text: np.ndarray, a: np.ndarray, b: np.ndarray, most: int | np.ndarray) -> np.ndarray:
    """Length of the common prefix of suffixes ``a`` and ``b``, up to ``most``."""
    out = np.zeros(len(a), np.int64)
    live = np.arange(len(a))
    n, d = len(text), 0
    most = np.broadcast_to(most, len(a))
    while len(live):
        x, y = a[live] + d, b[live] + d
        ok = (x < n) & (y < n) & (most[live] > d)
        ok[ok] = text[x[ok]] == text[y[ok]]
        live, d = live[ok], d + 1
        out[live] = d
    return out


class _Minima:
    """Minima of ranges of one batch (sparse table)."""

    def __init__(self, values: np.ndarray):
        self.levels = [values]
        while len(self.levels[-1]) > 1 << (len(self.levels) - 1):
            half, last = 1 << (len(self.levels) - 1), self.levels[-1]
            self.levels.append(np.minimum(last[:-half], last[half:]))

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Minimum of values[start:end], ranges not empty."""
        level = np.frexp((end - start).astype(np.float64))[1] - 1
        out = np.empty(len(start), np.int64)
        for k in np.unique(level):
            at = level == k
            out[at] = np.minimum(self.levels[k][start[at]], self.levels[k][end[at] - (1 << int(k))])
        return out


def _induce(text: np.ndarray, small: np.ndarray, seeds: np.ndarray, seed_lcp: np.ndarray, symbols: int, most: int, budget: int) -> tuple[np.ndarray, np.ndarray]:
    """All suffixes in order and the common prefix (up to ``most``) with the one before, from the sorted LMS suffixes."""
    first = np.searchsorted(text[seeds], np.arange(symbols + 1))
    larger = [(np.zeros(0, np.int64), np.zeros(0, np.uint8))] * symbols
    smaller = [(np.zeros(0, np.int64), np.zeros(0, np.uint8))] * symbols
    for going_up in (True, False):
        queues = Queues(symbols, budget)
        least = np.full(symbols, -1, np.int64)  # smallest common prefix since the last push to a queue; -1 before the first

        def advance(suffix: np.ndarray, lcp: np.ndarray, symbol: int) -> tuple[np.ndarray, np.ndarray]:
            """Push the suffixes before these; those with the symbol being popped come back for the next round."""
            before = suffix - 1
            ok = np.flatnonzero(suffix > 0)
            ok = ok[small[before[ok]] != going_up]
            to = text[before[ok]]
            order = np.argsort(to, kind="stable")
            ok, to = ok[order], to[order]
            lowest = int(lcp.min())
            old = least.copy()
            np.minimum(least, lowest, out=least)
            if not len(ok):
                return np.zeros(0, np.int64), np.zeros(0, np.uint8)
            table = _Minima(lcp)
            new = np.append(True, to[1:] != to[:-1])
            start = np.where(new, 0, np.append(0, ok[:-1] + 1))
            low = table.of(start, ok + 1)
            low[new] = np.minimum(low[new], old[to[new]])
            got = np.minimum(low + 1, most).astype(np.uint8)
            starts = np.flatnonzero(new)
            ends = np.append(starts[1:], len(to))
            tail = ok[ends - 1]
            after = np.full(len(starts), most, np.int64)
            rest = tail + 1 < len(lcp)
            after[rest] = table.of(tail[rest] + 1, np.full(rest.sum(), len(lcp)))
            least[to[starts]] = after
            again = (np.zeros(0, np.int64), np.zeros(0, np.uint8))
            moved = before[ok]
            for s, e in zip(starts.tolist(), ends.tolist()):
                if to[s] == symbol:
                    again = moved[s:e], got[s:e]
                else:
                    queues.push(int(to[s]), moved[s:e], got[s:e])
            return again

        for symbol in range(symbols) if going_up else range(symbols - 1, -1, -1):
            rounds = []
            part = queues.pop(symbol)
            while len(part[0]):
                rounds.append(part)
                part = advance(*part, symbol)
            if rounds:
                whole = tuple(np.concatenate(x) for x in zip(*rounds))
                (larger if going_up else smaller)[symbol] = whole
            else:
                whole = (np.zeros(0, np.int64), np.zeros(0, np.uint8))
            if going_up:
                s, e = first[symbol], first[symbol + 1]
                next_up, next_lcp = seeds[s:e], seed_lcp[s:e].copy()
            else:
                next_up, lcp_up = larger[symbol]
                next_up = next_up[::-1]
                next_lcp = np.append(np.zeros(1, np.uint8), lcp_up[:0:-1]) if len(next_up) else lcp_up
            if len(next_up):
                next_lcp[0] = common_prefix(text, whole[0][-1:], next_up[:1], most)[0] if len(whole[0]) else 0
                advance(next_up, next_lcp.astype(np.uint8), symbol)
        queues.close()
    suffixes, prefixes = [np.array([len(text) - 1])], [np.zeros(1, np.uint8)]  # the last suffix is followed by none, so nothing induces it
    for symbol in range(symbols):
        up, up_lcp = larger[symbol]
        down, down_lcp = smaller[symbol]
        if len(up):
            suffixes.append(up)
            prefixes.append(up_lcp)
        if len(down):
            lcp = np.append(np.zeros(1, np.uint8), down_lcp[:0:-1])
            if len(up):
                lcp[0] = common_prefix(text, up[-1:], down[-1:], most)[0]
            suffixes.append(down[::-1])
            prefixes.append(lcp)
    return np.concatenate(suffixes), np.concatenate(prefixes)


def _double(names: np.ndarray, steps: int) -> np.ndarray:
    """Ranks of the suffixes of ``names`` by their first ``steps`` names or more."""
    rank, h = np.unique(names, return_inverse=True)[1].astype(np.int64), 1
    while h < steps and rank.max() + 1 < len(rank):
        nxt = np.append(rank[h:] + 1, np.zeros(min(h, len(rank)), np.int64))[: len(rank)]
        rank = np.unique(rank * (len(rank) + 1) + nxt, return_inverse=True)[1].astype(np.int64)
        h *= 2
    return rank


def sort_suffixes(text: np.ndarray, symbols: int, most: int, budget: int = IN_MEMORY) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes of ``text`` in the order of their first ``most`` symbols (at most 255), and common prefixes up to ``most``.

    ``text`` holds integers below ``symbols`` and ends with a single 0, its least symbol.
    """
    if len(text) < 2:
        return np.arange(len(text)), np.zeros(len(text), np.uint8)
    small = rises(text)
    lms = np.flatnonzero(small[1:] & ~small[:-1]) + 1
    by_symbol = lms[np.argsort(text[lms], kind="stable")]
    order, _ = _induce(text, small, by_symbol, np.zeros(len(lms), np.uint8), symbols, 1, budget)
    is_lms = np.zeros(len(text), bool)
    is_lms[lms] = True
    ranked = order[is_lms[order]]
    # names of the LMS substrings, which run up to and with the next LMS symbol
    length = np.zeros(len(text), np.int64)
    length[lms] = np.append(np.diff(lms), 0) + 1
    a, b = ranked[:-1], ranked[1:]
    same = (length[a] == length[b]) & (common_prefix(text, a, b, np.minimum(length[a], length[b])) == length[a])
    name = np.zeros(len(text), np.int64)
    name[ranked] = np.append(0, np.cumsum(~same))
    names = name[lms]
    count = int(names.max()) + 1
    if count == len(names):
        seeds = ranked
    elif count <= SYMBOLS:
        seeds = lms[sort_suffixes(names, count, most, budget)[0]]
    else:
        seeds = lms[np.argsort(_double(names, most // 2 + 1), kind="stable")]
    lcp = np.append(0, common_prefix(text, seeds[:-1], seeds[1:], most)).astype(np.uint8)
    return _induce(text, small, seeds, lcp, symbols, most, budget)
