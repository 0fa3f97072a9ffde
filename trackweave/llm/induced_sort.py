"""Suffix arrays with common-prefix values by external induced sorting.

The suffixes that are smaller than the next one but follow a larger one ("low" suffixes)
are sorted first: one ascending and one descending pass sort the stretches from each to
the next, equal stretches get equal names, and the string of names is sorted by recursion,
which also gives how many names neighbours have in common. From the low suffixes one
ascending pass induces all suffixes that are larger than their successor, and one
descending pass the rest, each with its common prefix with the one before.

A pass takes suffix tuples (symbol, position, common prefix) from a priority queue ordered
by symbol, then by arrival. Symbols are dealt into ranges; tuples of ranges ahead wait in
memory up to ``memory`` of them and then go to disk, a block a range. Only the range at
hand is in memory, and a symbol with more tuples than that is read block by block, as its
tuples come in order of arrival. Of the range at hand all tuples up to the first that
could follow one still to be pushed are taken at once, so arrays do the work.

Text, kinds, names, seeds and results are files of the task that are mapped, not read; what
is held in arrays is a multiple of ``memory`` whatever the length of the text. A string of
names with no more than ``memory`` symbols is sorted in memory. Common-prefix values are
exact up to ``cap``.
"""

from __future__ import annotations

import tempfile
from collections.abc import Callable, Iterator

import numpy as np

#: Tuples (24 bytes each) that a sort keeps in memory.
MEMORY = 1 << 19
#: Tuples a range of several symbols has at most, about.
RANGE = 2048
_NONE = np.iinfo(np.int64).max


def on_disk(n: int, dtype: type) -> np.ndarray:
    """An array of ``n`` zeros in an unnamed scratch file of the task."""
    if not n:
        return np.empty(0, dtype=dtype)
    with tempfile.TemporaryFile() as file:
        return np.asarray(np.memmap(file, dtype=dtype, mode="w+", shape=(n,)))


def parts(n: int, size: int) -> Iterator[slice]:
    for at in range(0, n, size):
        yield slice(at, min(n, at + size))


class Stats:
    """What a sort did: blocks and tuples spilled, the most tuples held, the depth of the recursion by induction."""

    def __init__(self) -> None:
        self.spills = self.spilled = self.held = self.depth = 0


class SymbolQueue:
    """Tuples (symbol, position, common) by range of symbols, in order of arrival."""

    def __init__(self, bounds: np.ndarray, memory: int, stats: Stats):
        self.bounds, self.memory, self.stats = bounds, memory, stats
        self.tails: dict[int, list[np.ndarray]] = {}
        self.blocks: dict[int, list[tuple[int, int]]] = {}
        self.held, self.file = 0, None

    def push(self, tuples: np.ndarray, ranges: np.ndarray) -> None:
        """``tuples``: 3 x n in order of arrival; ``ranges``: the range of each."""
        order = np.argsort(ranges, kind="stable")
        tuples, ranges = tuples[:, order], ranges[order]
        cuts = np.flatnonzero(np.r_[True, ranges[1:] != ranges[:-1]])
        for a, b in zip(cuts, np.r_[cuts[1:], len(ranges)]):
            self.tails.setdefault(int(ranges[a]), []).append(tuples[:, a:b])
        self.held += len(ranges)
        self.stats.held = max(self.stats.held, self.held)
        if self.held > self.memory:
            self.spill()

    def spill(self) -> None:
        if self.file is None:
            self.file = tempfile.TemporaryFile()
        for r, tail in self.tails.items():
            block = np.ascontiguousarray(np.concatenate(tail, axis=1))
            self.blocks.setdefault(r, []).append((self.file.seek(0, 2), block.shape[1]))
            self.file.write(block.data)
            self.stats.spills += 1
            self.stats.spilled += block.shape[1]
        self.tails, self.held = {}, 0

    def drain(self, r: int) -> Iterator[np.ndarray]:
        """The tuples of a range in order of arrival, those pushed for it meanwhile included."""
        while True:
            if blocks := self.blocks.get(r):
                at, n = blocks.pop(0)
                self.file.seek(at)
                yield np.frombuffer(self.file.read(24 * n), dtype=np.int64).reshape(3, n)
            elif tail := self.tails.pop(r, None):
                block = np.concatenate(tail, axis=1)
                self.held -= block.shape[1]
                yield block
            else:
                return

    def close(self) -> None:
        if self.file is not None:
            self.file.close()


class Minima:
    """Least common value since a place of the sequence; values rise along the stack, so it has at most one entry a value."""

    def __init__(self) -> None:
        self.places, self.lows, self.base = np.array([0]), np.array([0]), 1

    def since(self, before: np.ndarray, commons: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Least of the values after place ``before`` up to index ``at`` of ``commons``, which go on from the last place."""
        out = np.minimum.accumulate(commons)[at]
        here = before >= self.base
        if not here.all():
            old = ~here
            found = np.searchsorted(self.places, before[old], side="right")
            lows = np.r_[self.lows, _NONE]
            out[old] = np.minimum(out[old], lows[found])
        if here.any():
            a, b = before[here] - self.base + 1, at[here] + 1
            level = np.log2(b - a).astype(np.int64)
            table, found = commons, np.empty(len(a), dtype=commons.dtype)
            for j in range(int(level.max()) + 1):
                if j:
                    half = 1 << (j - 1)
                    table = np.minimum(table[:-half], table[half:])
                of = level == j
                found[of] = np.minimum(table[a[of]], table[b[of] - (1 << j)])
            out[here] = found
        return out

    def extend(self, commons: np.ndarray) -> None:
        after = np.minimum.accumulate(commons[::-1])[::-1]
        last = np.flatnonzero(np.r_[commons[:-1] < after[1:], True])
        stay = self.lows < after[0]
        self.places = np.r_[self.places[stay], self.base + last]
        self.lows = np.r_[self.lows[stay], commons[last]]
        self.base += len(commons)


class Induction:
    """One pass over the suffixes in order: each taken one pushes its predecessor if that is not ahead of it."""

    def __init__(self, t: np.ndarray, run: np.ndarray, bounds: np.ndarray, top: int | None, cap: int, memory: int, stats: Stats, take: Callable[[np.ndarray, np.ndarray, np.ndarray], None], commons: bool):
        self.t, self.run, self.top, self.cap, self.take, self.commons = t, run, top, cap, take, commons
        self.bounds, self.queue = bounds, SymbolQueue(bounds, memory, stats)
        self.came = on_disk(int(bounds[-1]), np.int64) if commons else None  # symbol -> place of the suffix its latest tuple came from
        self.minima, self.before = Minima(), (-1, 0, False)

    def symbols(self, p: np.ndarray) -> np.ndarray:
        s = self.t[p].astype(np.int64)
        return s if self.top is None else self.top - s

    def true_commons(self, symbol: np.ndarray, p: np.ndarray, common: np.ndarray, given: np.ndarray) -> np.ndarray:
        """Common prefix of each with the one before it in the sequence."""
        b_symbol = np.r_[self.before[0], symbol[:-1]]
        b_p, b_given = np.r_[self.before[1], p[:-1]], np.r_[self.before[2], given[:-1]]
        out = np.where(symbol == b_symbol, common, 0)
        edge = np.flatnonzero((symbol == b_symbol) & given & ~b_given)
        out[edge] = np.minimum(self.run[p[edge]], self.run[b_p[edge]])
        self.before = (symbol[-1], p[-1], given[-1])
        return out

    def pushed(self, symbol: np.ndarray, p: np.ndarray, common: np.ndarray, given: np.ndarray, next_symbol: np.ndarray, valid: np.ndarray) -> np.ndarray:
        """Take these suffixes; the tuples of their predecessors, in order."""
        at = np.flatnonzero(valid)
        d, q = next_symbol[at], p[at] - 1
        if not self.commons:
            self.take(p, common, given)
            return np.stack([d, q, np.zeros(len(d), dtype=np.int64)])
        common = self.true_commons(symbol, p, common, given)
        self.take(p, common, given)
        values = np.zeros(len(d), dtype=np.int64)
        if len(d):
            order = np.argsort(d, kind="stable")
            ds, places = d[order], self.minima.base + at[order]
            again = np.r_[False, ds[1:] == ds[:-1]]
            before = np.where(again, np.r_[0, places[:-1]], self.came[ds])
            known = before > 0
            found = self.minima.since(before[known], common, at[order[known]])
            values[order[known]] = np.minimum(found + 1, self.cap)
            last = np.r_[~again[1:], True]
            self.came[ds[last]] = places[last]
        self.minima.extend(common)
        return np.stack([d, q, values])

    def successors(self, symbol: np.ndarray, p: np.ndarray, given: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        d = self.symbols(np.maximum(p - 1, 0))
        return d, (p > 0) & np.where(given, d > symbol, d >= symbol)

    def ranges(self, symbol: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.bounds, symbol, side="right") - 1

    def send(self, tuples: np.ndarray) -> None:
        if tuples.shape[1]:
            self.queue.push(tuples, self.ranges(tuples[0]))

    def go(self, given: Callable[[int], Iterator[np.ndarray]], first: np.ndarray | None) -> None:
        """``given(range)``: blocks 3 x n of the suffixes known beforehand, in order, of each range in turn; ``first``: tuples to begin with."""
        if first is not None:
            self.send(first)
            if self.commons:
                # They came from the empty suffix, which stands at place 1.
                self.came[first[0]] = 1
                self.minima.extend(np.zeros(1, dtype=np.int64))
        for r in range(len(self.bounds) - 1):
            if self.bounds[r + 1] - self.bounds[r] == 1:
                for kind, blocks in ((False, self.queue.drain(r)), (True, given(r))):
                    for symbol, p, common in blocks:
                        g = np.full(len(p), kind)
                        d, valid = self.successors(symbol, p, g)
                        self.send(self.pushed(symbol, p, common, g, d, valid))
            else:
                self.several(r, given)
        self.queue.close()

    def several(self, r: int, given: Callable[[int], Iterator[np.ndarray]]) -> None:
        """A range of several symbols, whose tuples fit in memory."""
        queued, known = list(self.queue.drain(r)), list(given(r))
        if not queued and not known:
            return
        block = np.concatenate([*queued, *known], axis=1)
        n = sum(b.shape[1] for b in queued)
        g = np.arange(block.shape[1]) >= n
        key = 2 * block[0] + g
        order = np.argsort(key, kind="stable")
        key, block, g = key[order], block[:, order], g[order]
        at, width = 0, 64
        while at < len(key):
            w = slice(at, at + width)
            symbol, p, common = block[:, w]
            d, valid = self.successors(symbol, p, g[w])
            limit = np.minimum.accumulate(np.where(valid, 2 * d, _NONE))
            late = key[w][1:] > limit[:-1]
            k = int(late.argmax()) + 1 if late.any() else len(symbol)
            new = self.pushed(symbol[:k], p[:k], common[:k], g[w][:k], d[:k], valid[:k])
            at += k
            width = min(4096, max(64, 2 * k))
            here = new[0] < self.bounds[r + 1]
            if not here.all():
                self.send(new[:, ~here])
            if here.any():
                new = new[:, here]
                block = np.concatenate([block[:, at:], new], axis=1)
                key = np.r_[key[at:], 2 * new[0]]
                g = np.r_[g[at:], np.zeros(new.shape[1], dtype=bool)]
                order = np.argsort(key, kind="stable")
                key, block, g, at = key[order], block[:, order], g[order], 0


def range_bounds(counts: np.ndarray, size: int) -> np.ndarray:
    """Symbols at which ranges begin, and the end: ranges have about ``size`` tuples, frequent symbols one of their own."""
    found, total, heavy_before = [np.array([0])], 0, False
    for s in parts(len(counts), 1 << 20):
        c = np.asarray(counts[s])
        begin = total + np.cumsum(c) - c
        heavy = c > size
        group = begin // size
        cut = np.r_[(group[0] != max(total - 1, 0) // size) | heavy[0] | heavy_before, (group[1:] != group[:-1]) | heavy[1:] | heavy[:-1]]
        found.append(s.start + np.flatnonzero(cut))
        total, heavy_before = total + int(c.sum()), bool(heavy[-1])
    return np.unique(np.r_[np.concatenate(found), len(counts)])


def common_prefixes(t: np.ndarray, a: np.ndarray, b: np.ndarray, cap: int) -> np.ndarray:
    """Common prefix of the suffixes at ``a`` and ``b``, up to ``cap``."""
    n = len(t)
    out = np.zeros(len(a), dtype=np.int64)
    live, width = np.arange(len(a)), 8
    while len(live):
        step = np.arange(width)
        x, y = a[live, None] + out[live, None] + step, b[live, None] + out[live, None] + step
        same = (t[np.minimum(x, n - 1)] == t[np.minimum(y, n - 1)]) & (x < n) & (y < n)
        equal = np.where(same.all(axis=1), width, (~same).argmax(axis=1))
        out[live] += equal
        live = live[(equal == width) & (out[live] < cap)]
        width = min(64, 2 * width)
    return np.minimum(out, cap)


def sorted_in_memory(t: np.ndarray, cap: int, block: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffix array by doubling, and common prefixes, of a string that fits in memory."""
    n = len(t)
    rank = np.unique(t, return_inverse=True)[1].astype(np.int64)
    k = 1
    while True:
        key = rank * (n + 1)
        key[: max(0, n - k)] += rank[k:] + 1
        order = np.argsort(key)
        new = np.cumsum(np.r_[0, key[order][1:] != key[order][:-1]])
        rank[order] = new
        if n == 0 or new[-1] == n - 1:
            break
        k *= 2
    commons = np.zeros(n, dtype=np.int64)
    for s in parts(max(0, n - 1), block):
        commons[s.start + 1 : s.stop + 1] = common_prefixes(t, order[s.start : s.stop], order[s.start + 1 : s.stop + 1], cap)
    return order, commons


def kinds(t: np.ndarray, cap: int, block: int) -> tuple[np.ndarray, np.ndarray]:
    """1 for each suffix that is smaller than the next, and the run of equal symbols (up to ``cap``) each begins with."""
    n = len(t)
    small, run = on_disk(n, np.uint8), on_disk(n, np.int32)
    after, smaller = n - 1, 0  # where the next symbol differs, and how; the end of the text is smaller than all
    for s in reversed(list(parts(n - 1, block))):
        x = t[s.start : s.stop + 1].astype(np.int64)
        step = x[1:] - x[:-1]
        at = np.where(step != 0, np.arange(s.start, s.stop), _NONE)
        at = np.minimum(np.minimum.accumulate(at[::-1])[::-1], after)
        inside = at < s.stop
        kind = np.where(inside, step[np.where(inside, at - s.start, 0)] > 0, smaller)
        small[s], run[s] = kind, np.minimum(at - np.arange(s.start, s.stop) + 1, cap)
        after, smaller = int(at[0]), int(kind[0])
    small[n - 1], run[n - 1] = 0, 1
    return small, run


def suffix_array(t: np.ndarray, cap: int, memory: int = MEMORY, stats: Stats | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(suffixes in order, common prefix of each with the one before it) of an array of symbols from 0."""
    stats = stats or Stats()
    n = len(t)
    if n < 2:
        return np.arange(n), np.zeros(n, dtype=np.int64)
    stats.depth += 1
    block = max(64, memory)
    small, run = kinds(t, cap, block)
    lows = low_suffixes(small, block)
    top = max(int(np.asarray(t[s]).max()) for s in parts(n, block))
    counts = on_disk(top + 1, np.int64)
    for s in parts(n, block):
        symbol, times = np.unique(np.asarray(t[s]), return_counts=True)
        counts[symbol] += times
    up, down = range_bounds(counts, min(RANGE, block)), range_bounds(counts[::-1], min(RANGE, block))
    larger, larger_commons = on_disk(n, np.int64), on_disk(n, np.int32)
    order, commons = on_disk(n, np.int64), on_disk(n, np.int32)

    def passes(seeds: np.ndarray, seed_commons: np.ndarray, keep: bool) -> None:
        """From seeds in order: the larger suffixes upwards, then all downwards into ``order`` from its end."""
        found = Filled(larger, larger_commons)
        Induction(t, run, up, None, cap, memory, stats, lambda p, c, g: found.add(p[~g], c[~g]), keep).go(
            ranged(t, None, up, seeds, seed_commons, block), np.array([[t[n - 1]], [n - 1], [0]], dtype=np.int64)
        )
        # Downwards a value belongs to the one above.
        back = larger[: found.n][::-1]
        back_commons = Shifted(larger_commons, found.n)
        out = Filled(order, commons)
        Induction(t, run, down, top, cap, memory, stats, lambda p, c, g: out.add(p, c), keep).go(ranged(t, top, down, back, back_commons, block), None)

    m = len(lows)
    seeds, seed_commons = on_disk(m, np.int64), on_disk(m, np.int32)
    if m:
        by_symbol(t, lows, seeds, counts, block)
        passes(seeds, seed_commons, False)
        names, distinct = named(t, order, small, lows, seeds, block)
        if distinct < m:
            if m <= memory:
                inner, shared = sorted_in_memory(np.asarray(names), cap, block)
            else:
                inner, shared = suffix_array(names, cap, memory, stats)
            for s in parts(m, block):
                seeds[s] = lows[inner[s]]
        else:
            inner = shared = None
        seed_values(t, lows, seeds, inner, shared, seed_commons, cap, block)
    passes(seeds, seed_commons, True)
    # Both were filled downwards: value i is that of order[i] with the one above it.
    return order[::-1], Shifted(commons, n)


class Filled:
    """Two arrays on disk that fill in order."""

    def __init__(self, places: np.ndarray, values: np.ndarray):
        self.places, self.values, self.n = places, values, 0

    def add(self, p: np.ndarray, c: np.ndarray) -> None:
        self.places[self.n : self.n + len(p)] = p
        self.values[self.n : self.n + len(p)] = c
        self.n += len(p)


class Shifted:
    """The first ``n`` values backwards and one on: a value with the one above becomes one with the one before."""

    def __init__(self, values: np.ndarray, n: int):
        self.values, self.n = values, n

    def __len__(self) -> int:
        return self.n

    def __getitem__(self, s: slice) -> np.ndarray:
        a, b, _ = s.indices(self.n)
        # Index i holds values[n - i], and 0 at i = 0.
        out = self.values[self.n - b + 1 : self.n - max(a, 1) + 1][::-1].astype(np.int64)
        return np.r_[0, out] if a == 0 and b > a else out


def low_suffixes(small: np.ndarray, block: int) -> np.ndarray:
    def found(s: slice) -> np.ndarray:
        x = small[s.start : s.stop + 1]
        return s.start + 1 + np.flatnonzero((x[1:] == 1) & (x[:-1] == 0))

    n = sum(len(found(s)) for s in parts(len(small) - 1, block))
    lows, at = on_disk(n, np.int64), 0
    for s in parts(len(small) - 1, block):
        f = found(s)
        lows[at : at + len(f)] = f
        at += len(f)
    return lows


def by_symbol(t: np.ndarray, lows: np.ndarray, seeds: np.ndarray, counts: np.ndarray, block: int) -> None:
    """Low suffixes by first symbol, into ``seeds``: a counting sort whose next places are on disk."""
    nexts = on_disk(len(counts), np.int64)
    for s in parts(len(lows), block):
        symbol, times = np.unique(np.asarray(t[lows[s]]), return_counts=True)
        nexts[symbol] += times
    total = 0
    for s in parts(len(nexts), block):
        c = nexts[s].copy()
        nexts[s] = total + np.cumsum(c) - c
        total += int(c.sum())
    for s in parts(len(lows), block):
        symbol = np.asarray(t[lows[s]])
        order = np.argsort(symbol, kind="stable")
        symbol = symbol[order]
        begins = np.flatnonzero(np.r_[True, symbol[1:] != symbol[:-1]])
        sizes = np.diff(np.r_[begins, len(symbol)])
        seeds[nexts[symbol] + np.arange(len(symbol)) - np.repeat(begins, sizes)] = lows[s][order]
        nexts[symbol[begins]] += sizes


def ranged(t: np.ndarray, top: int | None, bounds: np.ndarray, known: np.ndarray, values: np.ndarray, block: int) -> Callable[[int], Iterator[np.ndarray]]:
    """Blocks (symbol, position, common) of ``known`` suffixes range by range; they are in order of their symbols."""
    state = {"at": 0}

    def of(r: int) -> Iterator[np.ndarray]:
        while state["at"] < len(known):
            a = state["at"]
            size = 1024 if bounds[r + 1] - bounds[r] > 1 else block
            p = np.asarray(known[a : a + size])
            symbol = t[p].astype(np.int64)
            symbol = symbol if top is None else top - symbol
            k = int(np.searchsorted(symbol, bounds[r + 1]))
            if k:
                state["at"] = a + k
                yield np.stack([symbol[:k], p[:k], np.asarray(values[a : a + k])])
            if k < len(p):
                return

    return of


def named(t: np.ndarray, order: np.ndarray, small: np.ndarray, lows: np.ndarray, seeds: np.ndarray, block: int) -> tuple[np.ndarray, int]:
    """Names of the low suffixes' stretches in text order, and how many differ; ``seeds`` gets the low suffixes in order of their stretches.

    ``order`` has all suffixes from the largest down, in order of their stretches.
    """
    n, m = len(t), len(lows)
    names, at = on_disk(m, np.int64), 0
    for s in parts(n, block):
        p = np.asarray(order[n - s.stop : n - s.start])[::-1]
        p = p[(p > 0) & (small[p] == 1)]
        p = p[small[p - 1] == 0]
        seeds[at : at + len(p)] = p
        at += len(p)
    name = -1
    previous = None
    for s in parts(m, block):
        p = np.asarray(seeds[s])
        i = np.searchsorted(lows, p)
        length = np.where(i + 1 < m, lows[np.minimum(i + 1, m - 1)] - p + 1, 0)  # the last stretch runs to the end and is like no other
        b_p, b_length = (np.r_[previous[0], p[:-1]], np.r_[previous[1], length[:-1]]) if previous else (np.r_[p[0], p[:-1]], np.r_[-1, length[:-1]])
        same = (length == b_length) & (length > 0)
        maybe = np.flatnonzero(same)
        if len(maybe):
            same[maybe] = common_prefixes_of(t, b_p[maybe], p[maybe], length[maybe])
        found = name + np.cumsum(~same)
        names[i] = found
        name, previous = int(found[-1]), (p[-1], length[-1])
    return names, name + 1


def common_prefixes_of(t: np.ndarray, a: np.ndarray, b: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Whether the stretches of ``length`` at ``a`` and ``b`` are equal."""
    n, out = len(t), np.ones(len(a), dtype=bool)
    live, at, width = np.arange(len(a)), 0, 8
    while len(live):
        step = at + np.arange(width)
        x, y = np.minimum(a[live, None] + step, n - 1), np.minimum(b[live, None] + step, n - 1)
        ok = ((t[x] == t[y]) | (step >= length[live, None])).all(axis=1)
        out[live[~ok]] = False
        at += width
        live = live[ok & (length[live] > at)]
        width = min(64, 2 * width)
    return out


def seed_values(t: np.ndarray, lows: np.ndarray, seeds: np.ndarray, inner: np.ndarray | None, shared: np.ndarray | None, out: np.ndarray, cap: int, block: int) -> None:
    """Common prefixes of neighbouring seeds: the stretches of their common names, and what the first that differ share."""
    n, m = len(t), len(lows)
    for s in parts(m, max(1, block // 16)):
        a = max(0, s.start - 1)
        p = np.asarray(seeds[a : s.stop])
        skip = np.zeros(len(p), dtype=np.int64)
        if inner is not None:
            i, c = np.asarray(inner[a : s.stop]), np.asarray(shared[a : s.stop])
            ahead = i + c
            skip = np.where(ahead < m, lows[np.minimum(ahead, m - 1)], n) - p
        skip = np.minimum(skip, cap)
        value = skip[1:].copy()
        open_ = np.flatnonzero(value < cap)
        value[open_] += common_prefixes(t, p[:-1][open_] + value[open_], p[1:][open_] + value[open_], cap)
        out[a + 1 : s.stop] = np.minimum(value, cap)
