"""Suffix-array dedup with a run-length index: a run-compressed Burrows-Wheeler transform with sampled run ends.

Texts are cut into segments at their minimisers, so that equal strings of 100 bytes lie in segments of the same part. In
each part the differing segments that may overlap are indexed: the Burrows-Wheeler transform of a repetitive collection
has few runs, and the samples at the ends of its runs give, for every place, how long a string it shares with its
neighbour in suffix order. Streaming all segments backward through the transform collects equal strings.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from skeinwork.llm import common, relay

#: Bytes of a string that must not repeat.
LENGTH = 100
#: Bytes of the grams among which a window's minimiser is taken.
GRAM = 32
SPREAD = LENGTH - GRAM + 1
#: Segment bytes in one index; a group of segments that belongs together is never split.
#: Below 2 MB, three ranks fit one sort key.
INDEX_BYTES = 3 << 19
#: Compared lengths whose ranks an index keeps while it is built; places between two walks at most.
LEVELS, STRIDE = 4, 4096
#: Grams worked on at once, so that what is computed of them stays near the processor.
BLOCK = 1 << 15

#: What travels: of minimisers 40 bits, which only choose candidates; of segments their bytes.
MINIMISERS = [relay.HASH, relay.KEY, relay.PLACE]
SEGMENTS = [relay.Short(8), relay.DOC, relay.KEY, relay.PLACE, relay.PLACE, relay.Bytes()]
TOLD = [relay.KEY, relay.PLACE, relay.PLACE]

RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"

_BYTES = common.mixed(np.arange(1, 257, dtype=np.uint64))
_BASE = 0x9FB21C651E98DF25


def grams(data: np.ndarray) -> np.ndarray:
    """A hash of every run of ``GRAM`` bytes, by doubling."""
    h, base, size = _BYTES[data], _BASE, 1
    while size < GRAM:
        h = h[:-size] * np.uint64(base) + h[size:]
        base, size = base * base % (1 << 64), size * 2
    return common.mixed(h)


def minimisers(h: np.ndarray) -> np.ndarray:
    """For each window of ``LENGTH`` bytes the smallest hash of its grams; windows are not told apart by row here."""
    size, low = 1, h
    while size * 2 <= SPREAD:
        low = np.minimum(low[:-size], low[size:])
        size *= 2
    windows = h.size - SPREAD + 1
    return np.minimum(low[:windows], low[SPREAD - size : SPREAD - size + windows])


def grams_and_minimisers(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``grams`` and ``minimisers`` of at least ``LENGTH`` bytes, block by block."""
    n = data.size - GRAM + 1
    h, least = np.empty(n, np.uint64), np.empty(n - SPREAD + 1, np.uint64)
    for a in range(0, least.size, BLOCK):
        b = min(a + BLOCK + SPREAD - 1, n)
        h[a:b] = grams(data[a : b + GRAM - 1])
        least[a : b - SPREAD + 1] = minimisers(h[a:b])
    return h, least


def _occurrences(h: np.ndarray, least: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """How often the minimiser itself occurs among the grams from ``begin`` to ``end`` (exclusive) of each segment."""
    seen = np.zeros(1 << 22, bool)
    mask = np.uint64(seen.size - 1)
    seen[least & mask] = True
    at = np.flatnonzero(seen[h & mask])
    values = np.sort(least)
    values = values[np.append(True, values[1:] != values[:-1])]
    which = np.minimum(np.searchsorted(values, h[at]), values.size - 1)
    true = values[which] == h[at]
    places = np.sort((which[true] << 32) | at[true])
    own = np.searchsorted(values, least) << 32
    return np.searchsorted(places, own | end) - np.searchsorted(places, own | begin)


def segments(data: np.ndarray, offsets: np.ndarray):
    """Maximal runs of windows with one minimiser: (row, first byte in the row, bytes, minimiser, whether it may repeat a
    string of its own: then it holds its minimiser more than once)."""
    if data.size < LENGTH:
        none = np.empty(0, np.int64)
        return none, none, none, none.view(np.uint64), none.astype(bool)
    h, least = grams_and_minimisers(data)
    inside = np.zeros(least.size + 1, np.int64)
    first, stop = offsets[:-1], offsets[1:] - LENGTH + 1
    rows = np.flatnonzero(stop > first)
    inside[first[rows]] += 1
    inside[stop[rows]] -= 1
    inside = np.cumsum(inside[:-1]) > 0
    new = inside.copy()
    new[1:] &= ~inside[:-1] | (least[1:] != least[:-1])
    new[first[rows]] = True
    begin = np.flatnonzero(new)
    row = np.searchsorted(offsets, begin, "right") - 1
    end = np.minimum(np.append(begin[1:], least.size), stop[row])
    least = least[begin]
    twice = _occurrences(h, least, begin, end + SPREAD - 1) > 1 if begin.size else np.empty(0, bool)
    return row, begin - offsets[row], end - begin + LENGTH - 1, least, twice


class RunIndex:
    """Run-compressed Burrows-Wheeler transform of several texts, with samples at the ends of its runs.

    ``heads`` and ``starts`` are the runs, ``jump`` is where a run's first row goes in a backward step. ``at`` are the sampled
    places (the first row of each run, and where a text begins) in text order and ``shared`` how many bytes each shares with
    the row above; from one sampled place to the next, that length shrinks by one a byte.
    """

    def __init__(self, data: np.ndarray, sizes: np.ndarray):
        n = data.size + sizes.size
        ends = np.cumsum(sizes + 1) - 1
        symbols = np.zeros(n, np.int64)
        text = np.ones(n, bool)
        text[ends] = False
        symbols[text] = data.astype(np.int64) + 1
        self.symbols, self.ends, self.sizes = symbols, ends, sizes
        limit = np.repeat(ends, sizes + 1)
        order, levels = self._sorted(symbols, limit)
        before = symbols[order - 1]
        change = np.ones(n, bool)
        change[1:] = before[1:] != before[:-1]
        self.starts = np.flatnonzero(change)
        self.heads = before[self.starts]
        lengths = np.diff(np.append(self.starts, n))
        by_head = np.argsort(self.heads, kind="stable")
        self.lengths, self.jump = lengths, np.empty(self.starts.size, np.int64)
        self.jump[by_head] = np.cumsum(lengths[by_head]) - lengths[by_head]
        sampled = change | (before == 0)
        rows = np.flatnonzero(sampled[1:]) + 1
        here, above = order[rows], order[rows - 1]
        shared = self._common(levels, symbols, here, above, limit)
        self.at, by_place = np.unique(np.append(here, order[0]), return_index=True)
        self.shared = np.append(shared, 0)[by_place]
        # walks begin at sampled ends of texts and at one sampled place in ``STRIDE``, so that long texts are cut up
        known = (order % STRIDE == 0) | (symbols[order] == 0)
        self.walks, by_place = np.unique(order[known], return_index=True)
        self.walk_rows = np.flatnonzero(known)[by_place]

    @staticmethod
    def _sorted(symbols: np.ndarray, limit: np.ndarray) -> tuple[np.ndarray, list[tuple[int, np.ndarray]]]:
        """Suffixes in order, each up to its text's end, equal ones by place; by multiplying the compared length.

        A key is as many symbols, later as many ranks, as 63 bits hold. Only suffixes that are still tied are sorted again; one whose text ended within the compared length stays tied. Also
        gives some compared lengths with the ranks under them: equal ranks are equal strings.
        """
        n, small = symbols.size, np.int32 if symbols.size < 1 << 31 else np.int64
        used = np.zeros(257, np.int64)
        used[symbols] = 1
        width, bits = max(1, int(used.sum() - 1).bit_length()), n.bit_length()
        tied, rank = np.arange(n, dtype=small), np.zeros(n, small)
        codes = (np.cumsum(used) - 1).astype(np.int16)[symbols]
        key, begin = codes.astype(np.int64), 63 // width
        for k in range(1, begin):
            key <<= width
            key |= codes[np.minimum(tied + k, limit)]
        del codes
        depth, levels = begin, []
        while True:
            by_key = np.argsort(key)
            tied, ordered = tied[by_key], key[by_key]
            del by_key, key
            new = np.ones(tied.size, bool)
            new[1:] = ordered[1:] != ordered[:-1]
            del ordered
            first, group = np.flatnonzero(new).astype(small), np.cumsum(new, dtype=small) - 1
            # a group keeps its rows: its first of them is the rank of its first part
            if depth == begin:
                rank[tied] = first[group]
            else:
                old = rank[tied[first]]
                lead = np.ones(first.size, bool)
                lead[1:] = old[1:] != old[:-1]
                rank[tied] = (old + first - first[lead][np.cumsum(lead) - 1])[group]
            if len(levels) < LEVELS:
                levels.append((depth, rank.copy()))
            many = np.diff(np.append(first, tied.size)) > 1
            tied = tied[many[group]]
            tied = tied[limit[tied] - tied >= depth]
            del first, group, new
            if not tied.size:
                order = rank.astype(np.int64) << 32
                order |= np.arange(n)
                order.sort()
                order &= 0xFFFFFFFF
                return order, levels
            key, times = rank[tied].astype(np.int64), 63 // bits
            for k in range(1, times):
                key <<= bits
                key |= rank[np.minimum(tied.astype(np.int64) + k * depth, limit[tied])]
            depth *= times

    @staticmethod
    def _common(levels: list[tuple[int, np.ndarray]], symbols: np.ndarray, a: np.ndarray, b: np.ndarray, limit: np.ndarray) -> np.ndarray:
        """Bytes that the texts share from the places a and b on: each compared length as often as it fits, the longest
        first, then single bytes."""
        last_a, last_b = limit[a], limit[b]
        most, out = np.minimum(last_a - a, last_b - b), np.zeros(a.size, np.int64)

        def equal(ranks: np.ndarray, some: np.ndarray) -> np.ndarray:
            return ranks[np.minimum(a[some] + out[some], last_a[some])] == ranks[np.minimum(b[some] + out[some], last_b[some])]

        every = np.flatnonzero(most)
        long = every[equal(levels[0][1], every)]
        for depth, ranks, going in [*((d, r, long) for d, r in levels[::-1]), (1, symbols, every)]:
            going = going[out[going] < most[going]]
            while going.size:
                going = going[equal(ranks, going)]
                out[going] += depth
                going = going[out[going] < most[going]]
        return np.minimum(out, most)

    def statistics(self) -> np.ndarray:
        """For every place, the bytes it shares with the row above, from the samples alone."""
        gaps = np.diff(np.append(self.at, self.symbols.size))
        return np.repeat(self.shared + self.at, gaps) - np.arange(self.symbols.size)

    def rows(self) -> np.ndarray:
        """The row of every place, by streaming all texts backward through the transform at once, each walk down to the
        place after the next one's begin."""
        out = np.empty(self.symbols.size, np.int64)
        left = np.diff(np.append(-1, self.walks))
        going = np.argsort(-left, kind="stable")
        left, row, place = left[going], self.walk_rows[going], self.walks[going]
        out[place] = row
        shift = np.repeat(self.jump - self.starts, self.lengths)  # the runs' backward steps, row by row
        step = 0
        while True:
            step += 1
            alive = int(np.searchsorted(-left, -step, "left"))
            if not alive:
                return out
            row = row[:alive] + shift[row[:alive]]
            out[place[:alive] - step] = row

    def classes(self, length: int) -> np.ndarray:
        """A number per place, equal where the next ``length`` bytes are equal; -1 where fewer are left."""
        row, long = self.rows(), self.statistics() >= length
        new = np.ones(row.size, np.int64)
        new[row] = ~long
        out = np.cumsum(new)[row]
        place = np.arange(row.size)
        out[place + length > np.repeat(self.ends, self.sizes + 1)] = -1
        return out


def later_strings(data: np.ndarray, sizes: np.ndarray, doc: np.ndarray, key: np.ndarray, start: np.ndarray, length: int = LENGTH):
    """(text, place) of all strings of ``length`` bytes that start earlier as well, by (doc, key, start + place)."""
    index = RunIndex(data, sizes)
    kind = index.classes(length)
    where = np.flatnonzero(kind >= 0)
    where = where[(np.bincount(kind[where], minlength=1) > 1)[kind[where]]]
    text = np.searchsorted(index.ends, where)
    place = where - (index.ends - index.sizes)[text]
    order = np.lexsort((start[text] + place, key[text], doc[text], kind[where]))
    first = np.ones(order.size, bool)
    first[1:] = kind[where][order][1:] != kind[where][order][:-1]
    out = order[~first]
    return text[out], place[out]


def _told(keys: np.ndarray, starts: np.ndarray, counts: np.ndarray, n: int) -> Iterator[pa.RecordBatch]:
    order = np.lexsort((starts, keys))
    keys, starts, counts = keys[order], starts[order], counts[order]
    return relay.parcels(relay.TELL, relay.part_of(keys, n), [keys, starts, counts], TOLD)


def minimiser_entries(docs: DataFrame, n: int) -> DataFrame:
    """(minimiser, row, segment start) to the minimiser's part; those met twice in a pass are told at once."""

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches, "text"):
            data, offsets = common.flat(batch.column("text"))
            doc = common.ids(batch.column("doc_id"))
            key = relay.row_keys(doc, data, offsets)
            row, start, _, least, twice = segments(data, offsets)
            order, first, group = relay.groups(least)
            many = np.diff(np.append(first, order.size)) > 1
            tell = order[many[group] | twice[order]] if order.size else order
            yield from _told(key[row[tell]], start[tell], np.zeros(tell.size), n)
            ask = np.sort(order[first])
            yield from relay.parcels(relay.ASK, relay.part_of(least[ask], n), [least[ask], key[row[ask]], start[ask]], MINIMISERS)

    return docs.select("doc_id", "text").mapInArrow(take, relay.SCHEMA)


def shared_minimisers(entries: DataFrame, n: int) -> DataFrame:
    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = []
        for kind, batch in relay.split(batches):
            if kind == relay.TELL:
                yield batch
            else:
                held.append(batch)
        least, key, start = relay.gathered(held, MINIMISERS)
        order, first, group = relay.groups(least)
        if order.size:
            tell = order[(np.diff(np.append(first, order.size)) > 1)[group]]
            yield from _told(key[tell], start[tell], np.zeros(tell.size), n)

    return common.dealt(entries, n).mapInArrow(settle, relay.SCHEMA)


def segment_entries(shared: DataFrame, docs: DataFrame, n: int) -> DataFrame:
    """Segments with a shared minimiser, with their bytes, to the minimiser's part.

    Of segments with equal bytes in a parcel only the first goes on; the others' strings all start earlier too.
    """

    def grow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chosen, doc, key, data, offsets in relay.against(batches, TOLD):
            yield from _segments(chosen, doc, key, data, offsets, n)

    return relay.met(shared, docs, n).mapInArrow(grow, relay.SCHEMA)


def _segments(chosen, doc, key, data, offsets, n):
    if not np.isin(key, chosen.keys).any():
        return
    row, start, size, least, twice = segments(data, offsets)
    wanted = np.zeros(row.size, bool)
    first = np.searchsorted(row, np.arange(doc.size + 1))
    for i in np.flatnonzero(np.isin(key, chosen.keys)):
        wanted[first[i] : first[i + 1]] = np.isin(start[first[i] : first[i + 1]], chosen.of(key[i])[0])
    keep = np.flatnonzero(wanted)
    row, start, size, least, twice = row[keep], start[keep], size[keep], least[keep], twice[keep]
    content = contents(data, offsets[row] + start, size)
    tell, ask = copies(content, doc[row], key[row], start)
    yield from _told(key[row[tell]], start[tell], size[tell] - LENGTH + 1, n)
    ask.sort()
    dest = relay.part_of(least[ask], n)
    ask = ask[np.argsort(dest, kind="stable")]
    dest = np.sort(dest)
    raw, at = data.tobytes(), offsets[row] + start
    for batch in relay.parcels(
        relay.ASK, dest,
        [least[ask], doc[row[ask]], key[row[ask]], start[ask], np.where(twice, -size, size)[ask]], SEGMENTS[:5],
    ):
        cuts = np.searchsorted(dest, np.append(batch.column(0).to_numpy(), n))
        joined = [relay.Bytes().pack(b"".join(raw[at[i] : at[i] + size[i]] for i in ask[a:b])) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        yield batch.set_column(7, "f", pa.array(joined, pa.binary()))


_BASES = tuple(map(int, common.BASES))
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(base: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of a base and of its inverse modulo 2^64, kept by the worker."""
    if base not in _POWERS or _POWERS[base][0].size < size:
        room = max(size, common.PASS_BYTES * 5 // 4)
        _POWERS[base] = tuple(common.powers(np.uint64(b), room) for b in (base, pow(base, -1, 1 << 64)))
    return tuple(p[:size] for p in _POWERS[base])


def contents(data: np.ndarray, at: np.ndarray, size: np.ndarray) -> list[np.ndarray]:
    """Two 64-bit hashes of each range of bytes, from running sums of bytes weighed by powers."""
    out = [np.empty(at.size, np.uint64) for _ in _BASES]
    begin = 0
    while begin < at.size:  # ``at`` ascends
        stop = max(begin + 1, int(np.searchsorted(at, at[begin] + common.PASS_BYTES)))
        low, high = int(at[begin]), int((at + size)[begin:stop].max())
        some, values = slice(begin, stop), _BYTES[data[low:high]]
        powers = [_powers(base, values.size) for base in _BASES]
        first, last = at[some] - low, (at + size)[some] - low
        for k, (power, inverse) in enumerate(powers):
            sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values * power)])
            out[k][some] = common.mixed((sums[last] - sums[first]) * inverse[first] + size[some].astype(np.uint64))
        begin = stop
    return out


def copies(content: list[np.ndarray], doc: np.ndarray, key: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places whose bytes come earlier too, and the first place of each different content. A place met twice stays once."""
    order, first, group = relay.groups(*content, doc, key, start)
    order = order[first]
    new = np.ones(order.size, bool)
    if order.size:
        new[1:] = np.logical_or(*(c[order][1:] != c[order][:-1] for c in content))
    return order[~new], order[new]


def indexed(entries: DataFrame, n: int) -> DataFrame:
    """In each part, drop equal segments and index the differing ones that share a minimiser; tell the later strings."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = []
        for kind, batch in relay.split(batches):
            if kind == relay.TELL:
                yield batch
            else:
                held.append(batch)
        least, doc, key, start, size, data = relay.gathered(held, SEGMENTS)
        held.clear()
        if not least.size:
            return
        start, size, twice = start.astype(np.int64), np.abs(size.astype(np.int64)), size < 0
        at = np.cumsum(size) - size
        tell, kept = copies(contents(data, at, size), doc, key, start)
        yield from _told(key[tell], start[tell], size[tell] - LENGTH + 1, n)
        kept = kept[np.argsort(least[kept], kind="stable")]
        cuts = np.flatnonzero(np.append(True, least[kept][1:] != least[kept][:-1]))
        counts = np.diff(np.append(cuts, kept.size))
        some, held_bytes = [], 0
        raw = data.tobytes()

        def settle(chosen: np.ndarray) -> Iterator[pa.RecordBatch]:
            text = np.frombuffer(b"".join(raw[at[i] : at[i] + size[i]] for i in chosen), np.uint8)
            which, place = later_strings(text, size[chosen], doc[chosen], key[chosen], start[chosen])
            if not which.size:
                return
            order = np.lexsort((place, which))
            which, place = which[order], place[order]
            new = np.flatnonzero(np.append(True, (which[1:] != which[:-1]) | (place[1:] != place[:-1] + 1)))
            which, place, count = which[new], place[new], np.diff(np.append(new, which.size))
            yield from _told(key[chosen[which]], start[chosen[which]] + place, count, n)

        for a, count in zip(cuts.tolist(), counts.tolist(), strict=True):
            group = kept[a : a + count]
            if count == 1 and not twice[group[0]]:
                continue  # a lone segment with its minimiser once repeats no string
            some.append(group)
            held_bytes += int(size[group].sum())
            if held_bytes >= INDEX_BYTES:
                yield from settle(np.concatenate(some))
                some, held_bytes = [], 0
        if some:
            yield from settle(np.concatenate(some))

    return common.dealt(entries, n).mapInArrow(work, relay.SCHEMA)


def cut(found: DataFrame, docs: DataFrame, n: int, texts: bool = True) -> DataFrame:
    """Remove every byte that a told string covers."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for told, doc, key, data, offsets in relay.against(batches, TOLD):
            out = []
            for i in range(doc.size):
                own = data[offsets[i] : offsets[i + 1]]
                start, count = (x.astype(np.int64) for x in told.of(key[i]))
                gone = common.covered(own.size, start, start + count + LENGTH - 1) if start.size else np.zeros(own.size, bool)
                runs = int(np.count_nonzero(gone[1:] & ~gone[:-1])) + int(gone[:1].sum())
                kept = own[~gone].tobytes()
                doc_id = None if doc[i] == common.NO_ID else int(doc[i])
                out.append((doc_id, own.size, int(gone.sum()), runs, hashlib.sha256(kept).hexdigest(), kept if texts else None))
            types = [pa.int64()] * 4 + [pa.string(), pa.binary()]
            names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names)

    return relay.met(found, docs, n).mapInArrow(work, RESULT)


def repeated_strings(docs: DataFrame, texts: bool = True) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept) of every row of ``docs`` (doc_id, text).

    A byte goes if a string of 100 bytes over it also starts earlier: in a document of smaller id, or in the same one before.
    Null and empty texts have no bytes; a null id counts as larger than all others; rows that repeat id and text are one
    document, rows that repeat only the id are ordered by their text's hash. ``kept`` is null unless ``texts``.
    """
    docs = docs.select("doc_id", "text")
    n = common.parts(docs.sparkSession)
    shared = shared_minimisers(minimiser_entries(docs, n), n)
    found = indexed(segment_entries(shared, docs, n), n)
    return cut(found, docs, n, texts)
