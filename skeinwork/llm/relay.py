"""Moving numpy arrays between tasks: each shuffled row is a parcel of arrays for one part.

Two kinds of traffic meet in a part: parcels of a stage's entries, and the texts that the entries speak of. ``kind`` orders
them, so that a task takes in the small entries first and then streams the texts past them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame

from skeinwork.llm import common

SCHEMA = "dest int, kind int, a binary, b binary, c binary, d binary, e binary, f binary"
ARROW = pa.schema([("dest", pa.int32()), ("kind", pa.int32()), *((x, pa.binary()) for x in "abcdef")])
#: Questions to a key's part, answers on the way to a text's part, and texts.
ASK, TELL, TEXT = 0, 1, 2


class Short:
    """A hash of which only so many low bytes travel; its part is known by the others."""

    empty = np.empty(0, np.uint64)

    def __init__(self, size: int):
        self.size = size

    def pack(self, values: np.ndarray) -> bytes:
        return values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, : self.size].tobytes()

    def unpack(self, packed: bytes) -> np.ndarray:
        out = np.zeros((len(packed) // self.size, 8), np.uint8)
        out[:, : self.size] = np.frombuffer(packed, np.uint8).reshape(-1, self.size)
        return out.reshape(-1).view("<u8").astype(np.uint64)


class Deltas:
    """Integers that repeat or rise: differences, byte by byte, compressed."""

    def __init__(self, dtype):
        self.dtype = np.dtype(dtype)
        self.empty = np.empty(0, dtype)

    def pack(self, values: np.ndarray) -> bytes:
        values = values.astype(self.dtype)
        steps = np.concatenate([values[:1], values[1:] - values[:-1]])
        planes = np.ascontiguousarray(steps.view(np.uint8).reshape(-1, self.dtype.itemsize).T)
        return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())

    def unpack(self, packed: bytes) -> np.ndarray:
        planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(packed), np.uint8).reshape(self.dtype.itemsize, -1)
        return np.cumsum(np.ascontiguousarray(planes.T).reshape(-1).view(self.dtype), dtype=self.dtype)


class Bytes:
    """Pieces of text, joined and compressed."""

    empty = np.empty(0, np.uint8)

    def pack(self, joined: bytes) -> bytes:
        return zstandard.ZstdCompressor(level=1).compress(joined)

    def unpack(self, packed: bytes) -> np.ndarray:
        return np.frombuffer(zstandard.ZstdDecompressor().decompress(packed), np.uint8)


HASH, PLACE, DOC, KEY = Short(5), Deltas(np.int32), Deltas(np.int64), Deltas(np.uint64)


def parcels(kind: int, dest: np.ndarray, arrays: list[np.ndarray], codecs: list) -> Iterator[pa.RecordBatch]:
    """One row per part with that part's share of each array, in the order given."""
    if not dest.size:
        return
    order = np.argsort(dest, kind="stable")
    parts, first = np.unique(dest[order], return_index=True)
    cuts = [*first.tolist(), dest.size]
    columns = [pa.array(parts, pa.int32()), pa.array(np.full(parts.size, kind, np.int32))]
    for k in range(6):
        if k < len(arrays):
            moved = np.ascontiguousarray(arrays[k][order])
            columns.append(pa.array([codecs[k].pack(moved[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)], pa.binary()))
        else:
            columns.append(pa.nulls(parts.size, pa.binary()))
    yield pa.RecordBatch.from_arrays(columns, schema=ARROW)


def gathered(batches: list[pa.RecordBatch], codecs: list) -> list[np.ndarray]:
    """The arrays of all parcels of a list, each joined."""
    parts = [[codec.unpack(x.as_py()) for b in batches for x in b.column(2 + k)] for k, codec in enumerate(codecs)]
    return [np.concatenate([codec.empty, *x]) for x, codec in zip(parts, codecs, strict=True)]


def row_keys(doc: np.ndarray, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A key per row by its id and text: rows that repeat both are one document, others are told apart."""
    raw = memoryview(np.ascontiguousarray(data)).cast("B") if data.size else memoryview(b"")
    text = [xxhash.xxh64_intdigest(raw[a:b], 7) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
    return common.mixed(doc.view(np.uint64)) ^ np.array(text, np.uint64)


def part_of(keys: np.ndarray, n: int) -> np.ndarray:
    return ((keys >> np.uint64(40)) % np.uint64(n)).astype(np.int32)


def texts(docs: DataFrame, n: int) -> DataFrame:
    """The texts of ``docs`` (doc_id, text) as compressed parcels, each row in the part of its key."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = zstandard.ZstdCompressor(level=1)
        for batch in common.slices(batches, "text", 8 << 20):
            data, offsets = common.flat(batch.column("text"))
            doc = common.ids(batch.column("doc_id"))
            key = row_keys(doc, data, offsets)
            dest = part_of(key, n)
            order = np.argsort(dest, kind="stable")
            parts, first = np.unique(dest[order], return_index=True)
            raw, rows = data.tobytes(), []
            for part, a, b in zip(parts.tolist(), first.tolist(), [*first[1:].tolist(), dest.size], strict=True):
                some = order[a:b]
                text = b"".join(raw[offsets[i] : offsets[i + 1]] for i in some.tolist())
                sizes = (offsets[some + 1] - offsets[some]).tobytes()
                rows.append((part, TEXT, doc[some].tobytes(), key[some].tobytes(), sizes, packer.compress(text), None, None))
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), ARROW, strict=True)], schema=ARROW)

    return docs.select("doc_id", "text").mapInArrow(pack, SCHEMA)


def unpacked(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(ids, row keys, bytes, offsets) of each text parcel."""
    for k in range(batch.num_rows):
        doc, key, sizes = (np.frombuffer(batch.column(x)[k].as_py(), t) for x, t in ((2, np.int64), (3, np.uint64), (4, np.int64)))
        data = np.frombuffer(zstandard.ZstdDecompressor().decompress(batch.column(5)[k].as_py()), np.uint8)
        yield doc, key, data, np.concatenate([[0], np.cumsum(sizes)])


def met(told: DataFrame, docs: DataFrame, n: int) -> DataFrame:
    """What is told about texts and the texts themselves, part by part, the former first."""
    return common.dealt(told.unionByName(texts(docs, n)), n).sortWithinPartitions("kind")


def split(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.RecordBatch]]:
    """Each batch cut where ``kind`` changes."""
    for batch in batches:
        kinds = batch.column(1).to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(kinds)) + 1).tolist(), kinds.size]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if b > a:
                yield int(kinds[a]), batch.slice(a, b - a)


def against(batches: Iterator[pa.RecordBatch], codecs: list) -> Iterator[tuple]:
    """(told, ids, row keys, bytes, offsets) for texts joined to passes of some size, after all that is told of them."""
    waiting, told, held, size = [], None, [], 0
    for kind, batch in split(batches):
        if kind == TELL:
            waiting.append(batch)
            continue
        if told is None:
            told = Told(*gathered(waiting, codecs))
            waiting.clear()
        for found in unpacked(batch):
            held.append(found)
            size += found[2].size
            if size >= common.PASS_BYTES:
                yield told, *_joined(held)
                held, size = [], 0
    if held:
        yield told, *_joined(held)


def _joined(held: list[tuple]) -> tuple:
    doc, key, data, offsets = zip(*held, strict=True)
    sizes = np.concatenate([np.diff(o) for o in offsets])
    return np.concatenate(doc), np.concatenate(key), np.concatenate(data), np.concatenate([[0], np.cumsum(sizes)])


class Told:
    """What was told about row keys: values sorted by key."""

    def __init__(self, keys: np.ndarray, *values: np.ndarray):
        order = np.argsort(keys, kind="stable")
        self.keys, self.values = keys[order], [v[order] for v in values]

    def of(self, key: np.uint64) -> list[np.ndarray]:
        a, b = np.searchsorted(self.keys, key, "left"), np.searchsorted(self.keys, key, "right")
        return [v[a:b] for v in self.values]


def groups(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order by the keys, the first place of each group in that order, and the group of each place."""
    order = np.lexsort(keys[::-1]) if len(keys) > 1 else np.argsort(keys[0], kind="stable")
    new = np.ones(order.size, bool)
    if order.size:
        new[1:] = np.logical_or.reduce([k[order][1:] != k[order][:-1] for k in keys])
    return order, np.flatnonzero(new), np.cumsum(new) - 1
