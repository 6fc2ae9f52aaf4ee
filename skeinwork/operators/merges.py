"""Pair merges over words that one process holds: symbols as numbers in one array, worked through pair by pair."""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator

import numpy as np

# What stands between words, where a word goes on unseen, and the first number of a symbol.
GAP, EDGE, FIRST = 0, 1, 2
PREFIX = "##"
# A look at all pairs follows those that count an eighth of the best one (a third where cells are many, since each of theirs takes
# four bytes), PAIRS_MOST at most; cells of one numpy pass.
SHARE, SHARE_OF_MANY, MANY, PAIRS_MOST, PASS = 8, 3, 20_000_000, 50_000, 1_000_000
# Symbols up to which a table of all pairs is the fastest way to count them; one key of two symbols.
TABLE_SYMBOLS, SPAN = 1500, 1 << 32


def number_kind(most: int) -> type:
    """Numbers that hold ``most`` symbols and one more for hidden cells."""
    return np.uint16 if most + FIRST < np.iinfo(np.uint16).max else np.uint32


def laid(numbers: np.ndarray, lengths: np.ndarray, before: np.ndarray, after: np.ndarray) -> np.ndarray:
    """Cells of words: a gap, an edge if the word goes on before, its symbols, an edge if it goes on after."""
    sizes = 1 + before + lengths + after
    begins = np.cumsum(sizes) - sizes + 1 + before
    out = np.zeros(int(sizes.sum()), numbers.dtype)
    out[np.repeat(begins - (np.cumsum(lengths) - lengths), lengths) + np.arange(numbers.size)] = numbers
    out[begins[before] - 1] = EDGE
    out[(begins + lengths)[after]] = EDGE
    return out


def merged_name(left: str, right: str) -> str:
    return left + right.removeprefix(PREFIX)


class Merger:
    """The next merges of one-at-a-time training, of words ``symbols`` (each after a ``GAP``, the last before one) that count
    ``weights``, heaviest first. ``names`` has the symbols' texts by number.

    Every cell of the array is a symbol's begin or hidden behind one; ``size`` tells at a symbol's first and last cell how many cells
    it covers. Pairs within ``bound`` are followed: their counts, and the cells where they begin (cells that no longer do are passed
    over). All others rank after it, so nothing is missed until the bound is reached; then holes are closed and all pairs
    are looked at again. A merge adds no occurrence to a pair without its token, and a token that was there already gets all its pairs anew.
    """

    def __init__(self, symbols: np.ndarray, weights: np.ndarray, names: list[str]) -> None:
        self.hole = np.iinfo(symbols.dtype).max
        self.symbols, self.names = symbols, names
        self.numbers = {name: number for number, name in enumerate(names) if number >= FIRST}
        gaps = np.flatnonzero(self.symbols == GAP)
        longest = int(np.diff(gaps).max(initial=1))
        self.kind = np.uint8 if longest < 256 else np.uint16 if longest < 65_536 else np.uint32
        first = np.flatnonzero(np.diff(weights, prepend=-1)) if weights.size else np.zeros(0, np.int64)
        #: First cells of the words of equal weight, and that weight.
        self.begins, self.weights = gaps[first], weights[first].astype(np.int64)
        self.counts: dict[int, int] = {}
        self.cells: dict[int, list[np.ndarray]] = {}
        self.heap: list[tuple[int, str, str, int]] = []
        self.low = None

    def weight(self, at: np.ndarray) -> np.ndarray:
        return self.weights[np.searchsorted(self.begins, at, "right") - 1]

    def close(self) -> None:
        """Hidden cells go, and symbols and words without a pair."""
        self._keep(lambda part: part != self.hole)
        self._keep(_paired)
        self._keep(_leading)
        self.size = np.ones(self.symbols.size, self.kind)

    def _keep(self, mask: Callable[[np.ndarray], np.ndarray]) -> None:
        """Close up, where they lie, to the cells a mask keeps; it looks two cells to either side."""
        symbols, begins, kept = self.symbols, np.empty_like(self.begins), 0
        behind = symbols[:0]
        for start in range(0, symbols.size, PASS):
            part = np.concatenate([behind, symbols[start : start + PASS + 2]])
            there = mask(part)[behind.size :][:PASS]
            part, behind = part[behind.size :][: there.size], part[max(0, behind.size + there.size - 2) :][:2]
            of = slice(*np.searchsorted(self.begins, (start, start + part.size)))
            held = np.cumsum(there)
            begins[of] = kept + (held - there)[self.begins[of] - start]
            symbols[kept : kept + int(held[-1])] = part[there]
            kept += int(held[-1])
        self.symbols = symbols[:kept].copy()
        some = np.diff(begins, append=kept) > 0
        self.begins, self.weights = begins[some], self.weights[some]

    def chunks(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Cells where pairs begin, once all holes are closed, and the pairs' keys."""
        for start in range(0, self.symbols.size - 1, PASS):
            part = self.symbols[start : start + PASS + 1]
            at = np.flatnonzero((part[:-1] >= FIRST) & (part[1:] >= FIRST))
            yield at + start, part[at].astype(np.int64) * SPAN + part[at + 1]

    def all_pairs(self) -> tuple[np.ndarray, np.ndarray]:
        """Keys and counts of all pairs."""
        n = len(self.names)
        if n <= TABLE_SYMBOLS:
            table = np.zeros(n * n, np.int64)
            for at, keys in self.chunks():
                np.add.at(table, keys // SPAN * n + keys % SPAN, self.weight(at))
            found = np.flatnonzero(table)
            return found // n * SPAN + found % n, table[found]
        parts: list[tuple[np.ndarray, np.ndarray]] = []
        for at, keys in self.chunks():
            parts.append(_summed(keys, self.weight(at)))
            if sum(keys.size for keys, _ in parts[1:]) > 4 * PASS:
                parts = [_summed(*map(np.concatenate, zip(*parts)))]
        return _summed(*map(np.concatenate, zip(*parts))) if parts else (np.zeros(0, np.int64),) * 2

    def look(self, least: int) -> bool:
        """Follow the best pairs of all; whether there are any that count ``least``."""
        self.counts, self.cells, self.heap = {}, {}, []
        self.close()
        keys, counts = self.all_pairs()
        chosen = self.asked(keys) & (counts >= least)
        keys, counts = keys[chosen], counts[chosen]
        if not keys.size:
            return False
        self.low = max(least, int(counts.max()) // (SHARE if self.symbols.size < MANY else SHARE_OF_MANY))
        self.bound: tuple = (1 - self.low,)
        chosen = counts >= self.low
        keys, counts = keys[chosen], counts[chosen]
        if keys.size > PAIRS_MOST:
            place = np.empty(len(self.names), np.int64)
            place[sorted(range(len(self.names)), key=self.names.__getitem__)] = np.arange(len(self.names))
            best = np.lexsort((place[keys % SPAN], place[keys // SPAN], -counts))[:PAIRS_MOST]
            last = best[-1]
            self.low, self.bound = int(counts[last]), (-int(counts[last]), *self._names(int(keys[last])))
            best.sort()
            keys, counts = keys[best], counts[best]
        for key, n in zip(keys.tolist(), counts.tolist()):
            self.counts[key] = n
            self.cells[key] = []
            self.heap.append((-n, *self._names(key), key))
        heapq.heapify(self.heap)
        lists = [self.cells[key] for key in keys.tolist()]
        for at, some in self.chunks():
            which = np.searchsorted(keys, some)
            which[which == keys.size] = 0
            held = np.flatnonzero(keys[which] == some)
            at, which = at[held].astype(np.int32), which[held].astype(np.uint16)
            order = np.argsort(which, kind="stable")
            at, which = at[order], which[order]
            first = np.flatnonzero(np.diff(which.astype(np.int64), prepend=-1))
            for k, cells in zip(which[first].tolist(), np.split(at, first[1:]) if first.size else []):
                lists[k].append(cells)
        return True

    def _names(self, key: int) -> tuple[str, str]:
        return self.names[key // SPAN], self.names[key % SPAN]

    def asked(self, keys: np.ndarray) -> np.ndarray:
        """Which pairs' counts are whole: of whole words all."""
        return np.ones(keys.size, bool)

    def follow(self, key: int, n: int, cells: np.ndarray) -> None:
        rank = -n, *self._names(key)
        if rank <= self.bound:
            self.counts[key], self.cells[key] = n, [cells]
            heapq.heappush(self.heap, (*rank, key))

    def best(self) -> tuple[int, str, str, int] | None:
        """Rank and key of the followed pair that comes first."""
        while self.heap:
            rank = self.heap[0]
            n = self.counts.get(rank[3], 0)
            if n == -rank[0]:
                return rank
            heapq.heappop(self.heap)
            if 0 < n < -rank[0]:
                heapq.heappush(self.heap, (-n, *rank[1:]))
        return None

    def occurrences(self, key: int) -> tuple[np.ndarray, np.ndarray]:
        """Cells where a pair's left and right symbol begin now, from the left and without overlap."""
        del self.counts[key]
        lists = self.cells.pop(key)
        left, right = key // SPAN, key % SPAN
        at = lists[0] if len(lists) == 1 else np.concatenate(lists)
        at = at[self.symbols[at] == left]
        next_ = at + self.size[at]
        held = self.symbols[next_] == right
        at, next_ = at[held], next_[held]
        if left == right and at.size > 1:
            new = np.ones(at.size, bool)
            new[1:] = at[1:] != next_[:-1]
            place = np.arange(at.size)
            even = (place - np.maximum.accumulate(np.where(new, place, 0))) % 2 == 0
            at, next_ = at[even], next_[even]
        return at, next_

    def merge(self, key: int) -> tuple[int, int, int]:
        """Join a pair wherever it stands; the token's number, and how often it stands before and after the unseen."""
        left, right = key // SPAN, key % SPAN
        name = merged_name(*self._names(key))
        token = self.numbers.get(name)
        new = token is None
        if new:
            token = self.numbers[name] = len(self.names)
            self.names.append(name)
        symbols, size = self.symbols, self.size
        at, next_ = self.occurrences(key)
        end = next_ + size[next_]
        weights = self.weight(at)
        before = at - size[at - 1]
        x, y = symbols[before], symbols[end]
        follows = np.zeros(at.size, bool)
        follows[1:] = at[1:] == end[:-1]
        symbols[next_] = self.hole
        symbols[at] = token
        size[at] = size[end - 1] = (end - at).astype(self.kind)
        counts = self.counts
        alone = np.flatnonzero((x >= FIRST) & ~follows)
        for other, n, cells in _grouped(x[alone], weights[alone], before[alone]):
            if (old := other * SPAN + left) in counts:
                counts[old] -= n
            if new and n >= self.low:
                self.follow(other * SPAN + token, n, cells)
        some = np.flatnonzero(y >= FIRST)
        for other, n, _ in _grouped(y[some], weights[some], at[some]):
            if (old := right * SPAN + other) in counts:
                counts[old] -= n
        if new:
            y_now = symbols[end[some]]
            for other, n, cells in _grouped(y_now, weights[some], at[some]):
                if n >= self.low:
                    self.follow(token * SPAN + other, n, cells)
        else:
            self.anew(token)
        return token, int(weights[x == EDGE].sum()), int(weights[y == EDGE].sum())

    def anew(self, token: int) -> None:
        """Count and find all pairs of a token that was there already."""
        at = np.flatnonzero(self.symbols == token)
        after = self.symbols[at + self.size[at]]
        before = at - self.size[at - 1]
        x = self.symbols[before]
        weights, at = self.weight(at), at.astype(np.int32)
        some = np.flatnonzero(after >= FIRST)
        for other, n, cells in _grouped(after[some], weights[some], at[some]):
            self.follow(token * SPAN + other, n, cells)
        some = np.flatnonzero((x >= FIRST) & (x != token))
        for other, n, cells in _grouped(x[some], weights[some], before[some].astype(np.int32)):
            self.follow(other * SPAN + token, n, cells)

    def merges(self, known: set[str], room: int, least: int) -> list[tuple[str, str]]:
        """Pairs in the order of their merges, until ``room`` tokens are new or no pair counts ``least``."""
        out: list[tuple[str, str]] = []
        fresh: set[str] = set()
        while room > 0:
            rank = self.best() if self.low is not None else None
            if rank is None or rank[:3] > self.bound:
                if not (self.low is None or self.low > least or len(self.bound) > 1) or not self.look(least):
                    break
                continue
            if -rank[0] < least or self.over(rank[:3]):
                break
            token, *unseen = self.merge(rank[3])
            name = self.names[token]
            out.append(rank[1:3])
            if name not in known and name not in fresh:
                room -= 1
            fresh.add(name)
            if self.after(token, *unseen):
                break
        return out

    def over(self, rank: tuple[int, str, str]) -> bool:
        """Whether something unseen could come before this pair."""
        return False

    def after(self, token: int, before: int, behind: int) -> bool:
        """Whether nothing more can be told once this token is made."""
        return False


class StretchMerger(Merger):
    """The same of stretches of words around some pairs.

    A pair that was not among the best, ``top``, counts no more than the last of them, ``last`` (None: there are no others), and its
    count only falls, so nothing unseen comes before ``last``. Counts of pairs with a new symbol, or one of ``again``, are whole but
    for occurrences at the end of a stretch that goes on; merging ends where such a pair could win, and after a token
    that exists already (``known``) though its surroundings were not asked for.
    """

    def __init__(
        self, symbols: np.ndarray, weights: np.ndarray, names: list[str], top: list[tuple[str, str]], again: frozenset,
        last: tuple | None, known: set[str],
    ) -> None:
        super().__init__(symbols, weights, names)
        both = [(self.numbers.get(left, -1), self.numbers.get(right, -1)) for left, right in top]
        self.top = np.array([x * SPAN + y for x, y in both if x >= 0 and y >= 0], np.int64)
        self.whole = {self.numbers[t] for t in again if t in self.numbers}
        self.again, self.last, self.known = again, last, known
        self.edges: dict[tuple[int, bool], int] = {}
        self.unseen = 0

    def asked(self, keys: np.ndarray) -> np.ndarray:
        whole = np.fromiter(self.whole, np.int64, len(self.whole))
        return np.isin(keys, self.top) | np.isin(keys // SPAN, whole) | np.isin(keys % SPAN, whole)

    def over(self, rank: tuple[int, str, str]) -> bool:
        return -rank[0] <= self.unseen or (self.last is not None and rank > self.last)

    def after(self, token: int, before: int, behind: int) -> bool:
        self.whole.add(token)
        for side, n in ((False, before), (True, behind)):
            self.edges[token, side] = self.edges.get((token, side), 0) + n
            self.unseen = max(self.unseen, self.edges[token, side])
        return self.names[token] in self.known and self.names[token] not in self.again


def _paired(part: np.ndarray) -> np.ndarray:
    """Gaps, symbols that have another beside them, and edges beside such a symbol."""
    real = part >= FIRST
    pair = real[:-1] & real[1:]
    held = np.zeros(part.size, bool)
    held[:-1] |= pair
    held[1:] |= pair
    edge = part == EDGE
    beside = edge[:-1] & held[1:], edge[1:] & held[:-1]
    held[:-1] |= beside[0]
    held[1:] |= beside[1]
    return held | (part == GAP)


def _leading(part: np.ndarray) -> np.ndarray:
    """All but gaps before another gap."""
    held = part != GAP
    held[:-1] |= part[1:] != GAP
    held[-1:] = True
    return held


def _summed(keys: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.diff(keys, prepend=-1))
    return keys[first], np.add.reduceat(weights[order], first) if first.size else weights


def _grouped(keys: np.ndarray, weights: np.ndarray, cells: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
    """Each key, its weight and its cells in their order."""
    if not keys.size:
        return
    order = np.argsort(keys, kind="stable")
    keys, cells = keys[order], cells[order].astype(np.int32, copy=False)
    first = np.flatnonzero(keys[1:] != keys[:-1]) + 1
    begins = np.concatenate([[0], first])
    sums = np.add.reduceat(weights[order], begins).tolist()
    ends = [*first.tolist(), keys.size]
    start = 0
    for key, n, end in zip(keys[begins].tolist(), sums, ends):
        yield key, n, cells[start:end]
        start = end
