"""External induced sorting of the suffixes of one shard, with common-prefix
values.

The order of the leftmost smaller (LMS) suffixes is found by recursion: their
substrings are sorted by one induction, named, and the string of names is
sorted by the same procedure.  Two inductions then carry tuples (position,
common prefix with the neighbour before it) from each suffix to the one a
symbol longer: ascending for the larger-type, descending for the smaller-type
suffixes.  Tuples wait in a priority queue by first symbol whose contents go
to disk beyond a limit, and leave it in blocks; a symbol's common prefix is one
more than the least value between the two sources, carried along by range
minima.

Nothing of a text's length has to be in memory: text, types, runs, names, ranks
and results are arrays of a :class:`Workspace`, files beyond a size, and every
step reads and writes them a block at a time.

Once names have become nearly unique (fewer than LEAST_PER_SYMBOL suffixes a
symbol) there is next to nothing to induce from, and a symbol's queue would
hold a handful of tuples (more symbols than the queue's memory has room for
besides): the string of names is then ordered by prefix doubling, also in
blocks over such arrays.
"""

from __future__ import annotations

import os
import tempfile

import numpy as np

#: below so many suffixes a symbol a (recursive) string is sorted by doubling
LEAST_PER_SYMBOL = 100
QUEUE_BYTES = 16 << 20
ARRAY_BYTES = 16 << 20
SYMBOL_BYTES = 1024      # what a queue's bookkeeping of a symbol may take
PUSH_BYTES = 320         # what a push holds besides its tuples
BLOCK = 1 << 18          # tuples or places worked on at a time


class Workspace:
    """Arrays and queues of one sort; large ones live in a folder of the task
    that is deleted at its end (its content is rebuilt with the task)."""

    def __init__(self, queue_bytes: int = QUEUE_BYTES, array_bytes: int = ARRAY_BYTES, block: int = BLOCK):
        self.folder = None
        self.queue_bytes, self.array_bytes, self.block = queue_bytes, array_bytes, block
        self.made = 0

    @classmethod
    def within(cls, memory: int) -> Workspace:
        """One whose sort takes about ``memory`` bytes, whatever the text's length."""
        return cls(memory // 4, memory // 64, max(memory // 512, 16))

    def __enter__(self):
        return self

    def __exit__(self, *exc):
        if self.folder is not None:
            self.folder.cleanup()

    def file(self) -> str:
        if self.folder is None:
            self.folder = tempfile.TemporaryDirectory(prefix="suffix-queue-")
        self.made += 1
        return os.path.join(self.folder.name, str(self.made))

    def array(self, n: int, dtype) -> np.ndarray:
        if n * np.dtype(dtype).itemsize <= self.array_bytes:
            return np.zeros(n, dtype=dtype)
        return np.memmap(self.file(), dtype=dtype, mode="w+", shape=(n,))

    def drop(self, *arrays: np.ndarray) -> None:
        """The arrays are not needed any more: their files go."""
        for x in arrays:
            if isinstance(x, np.memmap) and os.path.exists(x.filename):
                os.unlink(x.filename)

    def blocks(self, n: int, backwards: bool = False):
        """(lo, hi) of the blocks of 0..n-1."""
        starts = range(0, n, self.block)
        for lo in reversed(starts) if backwards else starts:
            yield lo, min(lo + self.block, n)


class SymbolQueue:
    """Priority queue of (position, common prefix) tuples by symbol; tuples of
    a symbol keep the order they came in."""

    def __init__(self, work: Workspace):
        self.work, self.held, self.sizes, self.bytes = work, {}, {}, 0
        self.spilled: dict[int, list] = {}
        self.out, self.end = None, 0

    def push(self, symbol: int, pos: np.ndarray, lcp: np.ndarray | None) -> None:
        size = pos.nbytes + (0 if lcp is None else lcp.nbytes) + PUSH_BYTES
        self.held.setdefault(symbol, []).append((pos, lcp))
        self.sizes[symbol] = self.sizes.get(symbol, 0) + size
        self.bytes += size
        if self.bytes > self.work.queue_bytes:
            self._spill()

    def _spill(self) -> None:
        """The symbols with the most tuples go to disk, until half is free."""
        if self.out is None:
            self.path = self.work.file()
            self.out = open(self.path, "w+b")
        for symbol in sorted(self.sizes, key=self.sizes.get, reverse=True):
            pos, lcp = _joined(self.held.pop(symbol))
            self.bytes -= self.sizes.pop(symbol)
            self.out.seek(self.end)
            pos.tofile(self.out)
            if lcp is not None:
                lcp.tofile(self.out)
            self.spilled.setdefault(symbol, []).append(
                [self.end, len(pos), pos.dtype, 0, self.end + pos.nbytes, None if lcp is None else lcp.dtype])
            self.out.flush()
            self.end = self.out.tell()
            if self.bytes <= self.work.queue_bytes // 2:
                break

    def pop(self, symbol: int):
        """The next tuples of a symbol, a block at most: (positions, common
        prefixes or None); None if there are none."""
        parts = self.spilled.get(symbol)
        if parts:
            at, n, kind, done, at_lcp, lcp_kind = parts[0]
            m = min(n - done, self.work.block)
            lcp = None
            self.out.seek(at + done * kind.itemsize)
            pos = np.fromfile(self.out, kind, m)
            if lcp_kind is not None:
                self.out.seek(at_lcp + done * lcp_kind.itemsize)
                lcp = np.fromfile(self.out, lcp_kind, m)
            parts[0][3] += m
            if done + m == n:
                parts.pop(0)
                if not parts:
                    del self.spilled[symbol]
            return pos, lcp
        held = self.held.pop(symbol, None)
        if held is None:
            return None
        self.bytes -= self.sizes.pop(symbol)
        pos, lcp = _joined(held)
        if len(pos) > self.work.block:
            m = self.work.block
            rest = pos[m:], None if lcp is None else lcp[m:]
            self.held[symbol] = [rest]
            self.sizes[symbol] = rest[0].nbytes + (0 if lcp is None else rest[1].nbytes) + PUSH_BYTES
            self.bytes += self.sizes[symbol]
            pos, lcp = pos[:m], None if lcp is None else lcp[:m]
        return pos, lcp

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
            os.unlink(self.path)


def _joined(parts: list) -> tuple:
    if len(parts) == 1:
        return parts[0]
    pos, lcp = zip(*parts)
    return np.concatenate(pos), None if lcp[0] is None else np.concatenate(lcp)


def _range_min(values: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """min(values[lo:hi+1]) for each pair, by a table of powers of two."""
    size = hi - lo + 1
    out = np.empty(len(lo), dtype=values.dtype)
    level = np.frexp(size.astype(np.float64))[1] - 1
    table = values
    for k in range(int(level.max()) + 1 if len(level) else 0):
        here = level == k
        if here.any():
            out[here] = np.minimum(table[lo[here]], table[hi[here] - (1 << k) + 1])
        if len(table) > 1 << k:
            table = np.minimum(table[:-(1 << k)], table[1 << k:])
    return out


def _spread(keys: np.ndarray, cursor: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A block of a stable counting sort: (order of the block by key, where its
    elements go); ``cursor`` has the next free place of each key and moves on."""
    order = np.argsort(keys, kind="stable")
    k = keys[order]
    if not len(k):
        return order, order
    first = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
    size = np.diff(np.append(first, len(k)))
    to = np.repeat(cursor[k[first]], size) + np.arange(len(k)) - np.repeat(first, size)
    cursor[k[first]] += size
    return order, to


class _Sorter:
    def __init__(self, text: np.ndarray, work: Workspace):
        self.text, self.work = text, work
        n = len(text)
        self.kind = np.int32 if n < 2 ** 31 else np.int64
        self.small, self.run = work.array(n, bool), work.array(n, np.int32)     # S-type; length of the run of equal symbols
        for lo, hi in work.blocks(n, backwards=True):
            t = text[lo:min(hi + 1, n)]
            change = np.flatnonzero(t[1:] != t[:-1])         # i: symbols i and i+1 differ
            at = np.searchsorted(change, np.arange(hi - lo))
            last = at == len(change)                         # the run goes on in the next block
            after = np.append(change, 0)[at]
            here = np.arange(hi - lo)
            own = t[:hi - lo] < t[np.minimum(after + 1, len(t) - 1)]
            beyond = (self.small[hi], int(self.run[hi])) if hi < n else (True, 0)
            self.small[lo:hi] = np.where(last, beyond[0], own)
            self.run[lo:hi] = np.where(last, hi - lo - here + beyond[1], after - here + 1)
        found = sum(int(self._lms(lo, hi).sum()) for lo, hi in work.blocks(n))
        self.lms = work.array(max(found, 1), self.kind)
        at = 0
        for lo, hi in work.blocks(n):
            x = np.flatnonzero(self._lms(lo, hi)) + lo
            self.lms[at:at + len(x)] = x
            at += len(x)
        if not found:
            self.lms[0] = n - 1
        count = np.zeros(int(self._largest()) + 1, np.int64)
        for lo, hi in work.blocks(n):
            x = np.bincount(text[lo:hi])
            count[:len(x)] += x
        self.symbols = np.flatnonzero(count)
        self.stop = np.cumsum(count)
        self.start = self.stop - count

    def _largest(self):
        return max(self.text[lo:hi].max() for lo, hi in self.work.blocks(len(self.text)))

    def _lms(self, lo: int, hi: int) -> np.ndarray:
        """Which of the places are LMS places: smaller-type after larger-type."""
        before = self.small[lo - 1:hi - 1] if lo else np.concatenate([[True], self.small[:hi - 1]])
        return self.small[lo:hi] & ~before

    # -- inductions --------------------------------------------------------
    def _step(self, queue, want_small, symbol, pos, lcp, carry):
        """Queue the suffixes one symbol longer than ``pos`` (in scanning order)."""
        text = self.text
        prev = pos - 1
        ok = (pos > 0) & (self.small[prev] == want_small)
        sel = np.flatnonzero(ok)
        if lcp is None:
            return self._step_plain(queue, prev[sel])
        low = int(lcp.min()) if len(lcp) else 0
        if not len(sel):
            for t in carry:
                carry[t] = min(carry[t], low)
            return
        new = prev[sel]
        target = text[new]
        order = np.argsort(target, kind="stable")
        target, sel, new = target[order], sel[order], new[order]
        first = np.ones(len(sel), dtype=bool)
        first[1:] = target[1:] != target[:-1]
        lo = np.empty(len(sel), dtype=np.int64)
        lo[1:] = sel[:-1] + 1
        lo[first] = 0
        got = _range_min(lcp, lo, sel)
        start = np.flatnonzero(first)
        names = target[start].tolist()
        got[start] = np.minimum(got[start], [carry.get(t, 0) for t in names])
        got += 1
        end = np.append(start[1:], len(sel))
        if carry:
            for t in carry:
                carry[t] = min(carry[t], low)
        tail = _range_min(lcp, np.minimum(sel[end - 1] + 1, len(lcp) - 1), np.full(len(end), len(lcp) - 1))
        for t, a, b, x, s in zip(names, start.tolist(), end.tolist(), tail.tolist(), sel[end - 1].tolist()):
            carry[t] = x if s + 1 < len(lcp) else _NONE
            queue.push(t, new[a:b].copy(), got[a:b].copy())      # no view, which would hold the block

    def _step_plain(self, queue, new):
        """The same without common prefixes (for sorting LMS substrings)."""
        if not len(new):
            return
        target = self.text[new]
        order = np.argsort(target, kind="stable")
        target, new = target[order], new[order]
        start = np.flatnonzero(np.concatenate([[True], target[1:] != target[:-1]]))
        for t, a, b in zip(target[start].tolist(), start.tolist(), np.append(start[1:], len(new)).tolist()):
            queue.push(t, new[a:b].copy(), None)

    def _seed_ranges(self, seeds: np.ndarray):
        """(symbol, begin, end) of the seeds of each symbol; seeds are in order
        of their symbols."""
        count = np.zeros(len(self.stop), np.int64)
        for lo, hi in self.work.blocks(len(seeds)):
            x = np.bincount(self.text[seeds[lo:hi]])
            count[:len(x)] += x
        end = np.cumsum(count)
        return zip(self.symbols.tolist(), (end - count)[self.symbols].tolist(), end[self.symbols].tolist())

    def _parts(self, lo: int, hi: int, backwards: bool = False):
        for a, b in self.work.blocks(hi - lo, backwards):
            yield lo + a, lo + b

    def induce_plain(self, seeds: np.ndarray) -> np.ndarray:
        """The LMS places in the order of their substrings."""
        text, small, work = self.text, self.small, self.work
        large = work.array(len(text), self.kind)              # larger-type places, from each symbol's start
        many = {}
        queue = SymbolQueue(work)
        for c, s0, s1 in self._seed_ranges(seeds):
            at = int(self.start[c])
            while (gen := queue.pop(c)) is not None:
                large[at:at + len(gen[0])] = gen[0]
                at += len(gen[0])
                self._step(queue, False, c, gen[0], None, None)
            many[c] = at
            for lo, hi in self._parts(s0, s1):
                self._step(queue, False, c, np.array(seeds[lo:hi]), None, None)
        queue.close()
        queue = SymbolQueue(work)
        queue.push(int(text[-1]), np.array([len(text) - 1], dtype=self.kind), None)
        found = work.array(len(self.lms), self.kind)
        left = len(found)
        for c in self.symbols[::-1].tolist():
            while (gen := queue.pop(c)) is not None:
                pos = gen[0]
                own = pos[(pos > 0) & ~small[pos - 1]]
                found[left - len(own):left] = own[::-1]        # they come last first
                left -= len(own)
                self._step(queue, True, c, pos, None, None)
            for lo, hi in self._parts(int(self.start[c]), many[c], backwards=True):
                self._step(queue, True, c, np.array(large[lo:hi][::-1]), None, None)
        queue.close()
        work.drop(large)
        return found[left:] if left else found

    def induce(self, seeds: np.ndarray, seed_lcp: np.ndarray):
        """Suffix order and common prefixes from the sorted LMS suffixes."""
        text, work, run = self.text, self.work, self.run
        n = len(text)
        sa, lcps = work.array(n, self.kind), work.array(n, np.int32)
        many = {}
        queue = SymbolQueue(work)
        for c, s0, s1 in self._seed_ranges(seeds):
            carry, at = {}, int(self.start[c])
            while (gen := queue.pop(c)) is not None:
                pos, lcp = gen
                if at == self.start[c]:
                    lcp = lcp.copy()
                    lcp[0] = 0
                sa[at:at + len(pos)], lcps[at:at + len(pos)] = pos, lcp
                at += len(pos)
                self._step(queue, False, c, pos, lcp, carry)
            many[c] = at
            for lo, hi in self._parts(s0, s1):
                pos, lcp = np.array(seeds[lo:hi]), np.array(seed_lcp[lo:hi])
                if lo == s0:
                    lcp[0] = min(run[sa[at - 1]], run[pos[0]]) if at > self.start[c] else 0
                self._step(queue, False, c, pos, lcp, carry)
        queue.close()
        queue = SymbolQueue(work)
        queue.push(int(text[-1]), np.array([n - 1], dtype=self.kind), np.zeros(1, np.int32))
        for c in self.symbols[::-1].tolist():
            carry, stop = {}, int(self.stop[c])
            at = stop
            while (gen := queue.pop(c)) is not None:
                pos, lcp = gen
                m = len(pos)
                if at == stop:
                    lcp = lcp.copy()
                    lcp[0] = 0
                    lcps[at - m + 1:at] = lcp[:0:-1]
                else:
                    lcps[at - m + 1:at + 1] = lcp[::-1]
                sa[at - m:at] = pos[::-1]
                at -= m
                self._step(queue, True, c, pos, lcp, carry)
            if at < stop:
                lcps[at] = 0
            end = many[c]
            for lo, hi in self._parts(int(self.start[c]), end, backwards=True):
                back = np.zeros(hi - lo, np.int32)
                back[1:] = lcps[lo + 1:hi][::-1]
                if hi < end:
                    back[0] = lcps[hi]
                elif at < stop:
                    back[0] = lcps[at] = min(run[sa[end - 1]], run[sa[at]])
                self._step(queue, True, c, np.array(sa[lo:hi][::-1]), back, carry)
        queue.close()
        return sa, lcps

    # -- recursion ---------------------------------------------------------
    def _same(self, a: np.ndarray, b: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Do the ``length`` symbols from a and from b agree?"""
        same = np.ones(len(a), dtype=bool)
        left, k = np.arange(len(a)), 0
        while len(left):
            differ = self.text[a[left] + k] != self.text[b[left] + k]
            same[left[differ]] = False
            k += 1
            left = left[~differ & (length[left] > k)]
        return same

    def _agree(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many symbols from a and from b agree (the suffixes differ)."""
        out = np.zeros(len(a), dtype=np.int64)
        left, n = np.arange(len(a)), len(self.text)
        while len(left):
            x, y = a[left] + out[left], b[left] + out[left]
            inside = (x < n) & (y < n)
            left, x, y = left[inside], x[inside], y[inside]
            left = left[self.text[x] == self.text[y]]
            out[left] += 1
        return out

    def sort(self):
        text, lms, work, n = self.text, self.lms, self.work, len(self.text)
        m = len(lms)
        by_symbol, cursor = work.array(m, self.kind), np.zeros(len(self.stop), np.int64)
        for lo, hi in work.blocks(m):
            x = np.bincount(text[lms[lo:hi]])
            cursor[:len(x)] += x
        cursor = np.cumsum(cursor) - cursor
        for lo, hi in work.blocks(m):
            order, to = _spread(text[lms[lo:hi]], cursor)
            by_symbol[to] = lms[lo:hi][order]
        ordered = self.induce_plain(by_symbol)
        work.drop(by_symbol)
        names, named, last = work.array(m, self.kind), -1, None
        for lo, hi in work.blocks(m):
            num = np.searchsorted(lms, ordered[lo:hi])
            length = np.where(num + 1 < m, lms[np.minimum(num + 1, m - 1)], n - 1) - lms[num] + 1
            pos = np.array(ordered[lo:hi])
            if last is not None:
                pos, length = np.append(last[0], pos), np.append(last[1], length)
            new = np.ones(len(pos), dtype=bool)
            pair = np.flatnonzero(length[1:] == length[:-1]) + 1
            new[pair] = ~self._same(pos[pair - 1], pos[pair], length[pair])
            if last is not None:
                new = new[1:]
            x = named + np.cumsum(new)
            names[num], named, last = x, int(x[-1]), (pos[-1], length[-1])
        work.drop(ordered)
        order, common = suffix_array(names, work)
        work.drop(names)
        seeds, lcp = work.array(m, self.kind), work.array(m, np.int32)
        for lo, hi in work.blocks(m):
            seeds[lo:hi] = lms[order[lo:hi]]
            at = max(lo, 1)
            x, y, h = order[at - 1:hi - 1].astype(np.int64), order[at:hi].astype(np.int64), common[at:hi].astype(np.int64)
            lcp[at:hi] = lms[y + h].astype(np.int64) - lms[y] + self._agree(lms[x + h].astype(np.int64), lms[y + h].astype(np.int64))
        work.drop(order, common)
        out = self.induce(seeds, lcp)
        work.drop(seeds, lcp, self.small, self.run, lms)
        return out


_NONE = np.iinfo(np.int32).max - 1      # nothing since the last push


def suffix_array(text: np.ndarray, work: Workspace) -> tuple[np.ndarray, np.ndarray]:
    """Suffix array and common prefixes (with the suffix before) of ``text``,
    whose last symbol is its unique smallest."""
    symbols = 1 + max((int(text[lo:hi].max()) for lo, hi in work.blocks(len(text))), default=-1)
    if len(text) < LEAST_PER_SYMBOL * max(symbols, 1) or len(text) < 3 or symbols > max(work.queue_bytes // SYMBOL_BYTES, 512):
        return _by_doubling(text, work)
    return _Sorter(text, work).sort()


def _by_doubling(text: np.ndarray, work: Workspace) -> tuple[np.ndarray, np.ndarray]:
    """The same by prefix doubling: each round is a stable counting sort by the
    rank so far, of places in the order of the suffixes ``step`` further on."""
    n, kind = len(text), np.int32 if len(text) < 2 ** 31 else np.int64
    if not n:
        return np.empty(0, np.int32), np.empty(0, np.int32)
    cursor = work.array(int(max(text[lo:hi].max() for lo, hi in work.blocks(n))) + 1, kind)
    for lo, hi in work.blocks(n):
        x, size = np.unique(text[lo:hi], return_counts=True)
        cursor[x] += size.astype(kind)
    before = 0
    for lo, hi in work.blocks(len(cursor)):
        x = np.cumsum(cursor[lo:hi]) + before
        before, cursor[lo:hi] = int(x[-1]), x - cursor[lo:hi]
    order, rank = work.array(n, kind), work.array(n, kind)     # a rank is the first place of its class
    for lo, hi in work.blocks(n):
        rank[lo:hi] = cursor[text[lo:hi]]
    for lo, hi in work.blocks(n):
        o, to = _spread(np.asarray(text[lo:hi]).astype(np.int64), cursor)
        order[to] = o + lo
    work.drop(cursor)
    levels, step = [rank], 1
    while True:
        rank, new_order, seen = levels[-1], work.array(n, kind), work.array(n, kind)
        for lo, hi in work.blocks(n):
            seen[lo:hi] = np.arange(lo, hi)                    # next free place of the class that starts here
        for part in _second_keys(order, n, step, work):
            o, to = _spread(rank[part].astype(np.int64), seen)
            new_order[to] = part[o]
        work.drop(order, seen)
        order, new_rank, distinct, at = new_order, work.array(n, kind), True, 0
        for lo, hi in work.blocks(n):
            pos = order[max(lo - 1, 0):hi].astype(np.int64)
            a, b = rank[pos], np.where(pos + step < n, rank[np.minimum(pos + step, n - 1)], -1)
            new = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
            if not lo:
                new = np.append(True, new)
            distinct &= bool(new.all())
            x = np.maximum.accumulate(np.where(new, np.arange(lo, hi), at))
            new_rank[order[lo:hi]], at = x, int(x[-1])
        if distinct:
            work.drop(new_rank)
            break
        levels.append(new_rank)
        step *= 2
    lcp = work.array(n, np.int32)
    for lo, hi in work.blocks(n):
        pos = order[max(lo - 1, 0):hi].astype(np.int64)
        a, b, got = pos[:-1], pos[1:], np.zeros(len(pos) - 1, np.int64)
        for k in range(len(levels) - 1, -1, -1):
            x, y = a + got, b + got
            inside = (x < n) & (y < n)
            same = inside.copy()
            same[inside] = levels[k][x[inside]] == levels[k][y[inside]]
            got[same] += 1 << k
        lcp[max(lo, 1):hi] = got
    work.drop(*levels)
    return order, lcp


def _second_keys(order: np.ndarray, n: int, step: int, work: Workspace):
    """All places in the order of what stands ``step`` further on: first those
    with nothing there."""
    for lo, hi in work.blocks(min(step, n)):
        yield np.arange(n - min(step, n) + lo, n - min(step, n) + hi)
    for lo, hi in work.blocks(n):
        pos = order[lo:hi]
        yield np.array(pos[pos >= step]) - step
