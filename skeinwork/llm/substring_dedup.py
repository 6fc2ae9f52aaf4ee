"""Substring dedup by difference-cover anchors: only windows at cover positions are hashed, and matches grow from them."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from skeinwork.llm import common, relay

#: Words of a window that must not repeat.
WINDOW = 13
#: A perfect difference set: for any two places some shift below the period brings both onto the cover.
PERIOD, COVER = 7, (0, 1, 3)
#: The longest anchor that every window still holds whole, whatever the shift.
ANCHOR = WINDOW - PERIOD + 1

#: What travels: of anchors 40 bits of hash, which only choose candidates; of windows 96 bits, which decide.
ANCHORS = [relay.HASH, relay.DOC, relay.KEY, relay.PLACE]
WINDOWS = [relay.Short(8), relay.Short(4), relay.DOC, relay.KEY, relay.PLACE]
TOLD = [relay.KEY, relay.PLACE]

#: In place of a word's place: two documents of a pass hold this anchor, and its places there are told.
SHARED = -1

RESULT = "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string"


def _words(data: np.ndarray, offsets: np.ndarray):
    starts, ends = common.word_bounds(data, offsets)
    owner = np.searchsorted(offsets, starts, "right") - 1
    first = np.searchsorted(owner, np.arange(offsets.size))
    return starts, ends, owner, first


def _whole(owner: np.ndarray, n: int) -> np.ndarray:
    """Whether the run of ``n`` words from each word on ends in the same row."""
    ok = np.zeros(owner.size, bool)
    if owner.size >= n:
        ok[: owner.size - n + 1] = owner[n - 1 :] == owner[: owner.size - n + 1]
    return ok


def _settle(keys: list[np.ndarray], doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Windows to tell and to pass on, of entries with equal keys: those in documents after the smallest are told, the
    smallest one's stand."""
    order, first, group = relay.groups(*keys)
    if not order.size:
        return order, order
    after = doc[order] > np.minimum.reduceat(doc[order], first)[group]
    return order[after], order[~after]


def _share(keys: list[np.ndarray], doc: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchors to tell, one of each told key, and the others, of entries with equal keys.

    A key's places are told where it has two documents or an entry marked ``SHARED``, which has no place of its own.
    """
    order, first, group = relay.groups(*keys)
    if not order.size:
        return order, order, order
    several = np.maximum.reduceat(doc[order], first) > np.minimum.reduceat(doc[order], first)
    shared = several | (np.minimum.reduceat(place[order], first) == SHARED)
    tell = order[shared[group]]
    return tell[place[tell] != SHARED], order[first[shared]], order[~shared[group]]


def anchor_entries(docs: DataFrame, n: int) -> DataFrame:
    """Anchors of ``docs``: (hash, doc, row, word place) to the part of the hash; anchors that two documents of the same pass
    share are told at once, and one entry marked ``SHARED`` goes on for all of them, so a hot passage sends one a pass.
    The mark, not the entry's document, says that there are two: another pass may hold only that document's id again."""
    cover = np.isin(np.arange(PERIOD), COVER)

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches, "text"):
            data, offsets = common.flat(batch.column("text"))
            doc = common.ids(batch.column("doc_id"))
            key = relay.row_keys(doc, data, offsets)
            starts, ends, owner, first = _words(data, offsets)
            if owner.size < WINDOW:
                continue
            place = np.arange(owner.size) - first[owner]
            long = (first[1:] - first[:-1] >= WINDOW)[owner]
            at = np.flatnonzero(cover[place % PERIOD] & _whole(owner, ANCHOR) & long)
            if not at.size:
                continue
            found = common.run_hash(common.word_hashes(data, starts, ends)[0], ANCHOR, common.STEPS[0])[at]
            rows = owner[at]
            at_word = place[at]
            tell, heads, alone = _share([found], doc[rows], at_word)
            yield from told(key[rows[tell]], at_word[tell], n)
            at_word[heads] = SHARED
            ask = np.sort(np.concatenate([heads, alone]))
            arrays = [found[ask], doc[rows[ask]], key[rows[ask]], at_word[ask]]
            yield from relay.parcels(relay.ASK, relay.part_of(found[ask], n), arrays, ANCHORS)

    return docs.select("doc_id", "text").mapInArrow(take, relay.SCHEMA)


def told(keys: np.ndarray, places: np.ndarray, n: int) -> Iterator[pa.RecordBatch]:
    order = np.lexsort((places, keys))
    keys, places = keys[order], places[order]
    return relay.parcels(relay.TELL, relay.part_of(keys, n), [keys, places], TOLD)


def answered(entries: DataFrame, n: int, windows: bool) -> DataFrame:
    """In each part, tell which places share their key; what was told before goes through."""
    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = []
        for kind, batch in relay.split(batches):
            if kind == relay.TELL:
                yield batch
            else:
                held.append(batch)
        *keys, doc, key, place = relay.gathered(held, WINDOWS if windows else ANCHORS)
        tell = (_settle(keys, doc) if windows else _share(keys, doc, place))[0]
        yield from told(key[tell], place[tell], n)

    return common.dealt(entries, n).mapInArrow(settle, relay.SCHEMA)


def window_entries(shared: DataFrame, docs: DataFrame, n: int) -> DataFrame:
    """Windows around shared anchors: (two hashes, doc, row, word place) to the part of the hash."""

    def grow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for anchors, doc, key, data, offsets in relay.against(batches, TOLD):
            yield from _windows(anchors, doc, key, data, offsets, n)

    return relay.met(shared, docs, n).mapInArrow(grow, relay.SCHEMA)


def _windows(anchors, doc, key, data, offsets, n):
    marked = np.isin(key, anchors.keys)
    if not marked.any():
        return
    keep = np.flatnonzero(marked)
    data = np.concatenate([data[offsets[i] : offsets[i + 1]] for i in keep])
    offsets = np.concatenate([[0], np.cumsum((offsets[1:] - offsets[:-1])[keep])])
    doc, key = doc[keep], key[keep]
    starts, ends, owner, first = _words(data, offsets)
    near = np.zeros(owner.size, bool)
    for i in range(doc.size):
        at = np.unique(anchors.of(key[i])[0]).astype(np.int64)
        size = first[i + 1] - first[i]
        near[first[i] : first[i + 1]] = common.covered(size, np.maximum(at - (WINDOW - ANCHOR), 0), at + 1)
    at = np.flatnonzero(near & _whole(owner, WINDOW))
    if not at.size:
        return
    hashes = common.word_hashes(data, starts, ends)
    one, two = (common.run_hash(h, WINDOW, step)[at] for h, step in zip(hashes, common.STEPS, strict=True))
    rows, place = owner[at], at - first[owner[at]]
    tell, ask = _settle([one, two], doc[rows])
    yield from told(key[rows[tell]], place[tell], n)
    ask.sort()
    arrays = [one[ask], two[ask], doc[rows[ask]], key[rows[ask]], place[ask]]
    yield from relay.parcels(relay.ASK, relay.part_of(one[ask], n), arrays, WINDOWS)


def cut(found: DataFrame, docs: DataFrame, n: int, texts: bool = True) -> DataFrame:
    """Remove the told windows' words from the texts."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for windows, doc, key, data, offsets in relay.against(batches, TOLD):
            raw, out = data.tobytes(), []
            for i in range(doc.size):
                words = raw[offsets[i] : offsets[i + 1]].split()
                at = windows.of(key[i])[0].astype(np.int64)
                gone = common.covered(len(words), at, at + WINDOW) if at.size else np.zeros(len(words), bool)
                kept = b" ".join(w for w, g in zip(words, gone.tolist(), strict=True) if not g) if at.size else b" ".join(words)
                doc_id = None if doc[i] == common.NO_ID else int(doc[i])
                out.append((doc_id, len(words), int(gone.sum()), hashlib.sha256(kept).hexdigest(), kept.decode() if texts else None))
            columns = list(zip(*out, strict=True))
            types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            names = ["doc_id", "n_words", "n_removed", "kept_sha256", "kept"]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

    return relay.met(found, docs, n).mapInArrow(work, RESULT)


def repeated_windows(docs: DataFrame, texts: bool = True) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256, kept) of every row of ``docs`` (doc_id, text).

    A word goes if a window of 13 consecutive words over it also starts in a document of smaller id. Any two equal windows
    share an anchor of seven words that lies on the cover in both, so only windows around anchors of two documents are
    compared, by 96 bits of hash over their words. Null and empty texts have no words; a null id counts as larger than all others;
    rows that repeat an id never remove each other's words. ``kept`` is null unless ``texts``.
    """
    docs = docs.select("doc_id", "text")
    n = common.parts(docs.sparkSession)
    anchors = answered(anchor_entries(docs, n), n, windows=False)
    windows = answered(window_entries(anchors, docs, n), n, windows=True)
    return cut(windows, docs, n, texts)
