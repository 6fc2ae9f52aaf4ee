"""Benchmark decontamination: one Aho-Corasick automaton over the normalised windows of the benchmark items, word by word."""

from __future__ import annotations

import functools
import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skeinwork.llm import common

WINDOW = 13
#: Of its words a document may have one in this many hit before it counts as contaminated.
SHARE = 20
#: Nodes of one automaton, about 48 bytes each in every worker. A benchmark of more (about 3 MB of items) is split over several,
#: each scanned in turn; driver and executors hold one at a time.
AUTOMATON_NODES = 5_000_000

LOWER = bytes(c + 32 if 0x41 <= c <= 0x5A else c for c in range(256))
NO_WORD = np.zeros(256, bool)
NO_WORD[[*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]] = True
#: Lower-cases A-Z and turns every byte outside words into a space.
PLAIN = bytes(0x20 if NO_WORD[LOWER[c]] else LOWER[c] for c in range(256))

HITS = "text_key string, ranges binary, items array<string>"
FOUND = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, spans string"


def words_of(text: bytes) -> list[bytes]:
    return text.translate(PLAIN).split()


def _letter(number: int) -> str:
    """The letter of a word; zero stands for all other words, and half characters are left out."""
    return chr(number + 1 if number < 0xD7FF else number + 0x801)


class Windows:
    """The windows of some items in one automaton over words: each different word of the items is a letter."""

    def __init__(self, items: list[tuple[str, bytes]], size: int = WINDOW):
        import ahocorasick

        self.machine, self.letters = ahocorasick.Automaton(), {}
        for item, text in items:
            line = "".join([self.letters.setdefault(word, _letter(len(self.letters))) for word in words_of(text)])
            own = (min(len(line), size), {item: None})  # one object for all windows of the item
            for k in range(max(1, len(line) - size + 1) if line else 0):
                key = line[k : k + size]
                held = self.machine.get(key, None)
                if held is None:
                    self.machine.add_word(key, (*own, False))
                elif item not in held[1]:
                    n, holders, shared = held
                    if not shared:
                        self.machine.add_word(key, (n, {**holders, item: None}, True))
                    else:
                        holders[item] = None
        self.machine.make_automaton()

    def scan(self, words: list[bytes]) -> tuple[np.ndarray, set[str]]:
        """Which words lie in an occurrence of a window, and the items of those windows."""
        letter = self.letters.get
        matches = list(self.machine.iter("".join([letter(word, "\0") for word in words]))) if len(self.machine) else []
        if not matches:
            return np.zeros(len(words), bool), set()
        last = np.array([end for end, _ in matches]) + 1
        spans = np.array([n for _, (n, _, _) in matches])
        items = set().union(*{id(holders): holders for _, (_, holders, _) in matches}.values())
        return common.covered(len(words), last - spans, last), items


_WINDOWS: dict[str, Windows] = {}


def held_windows(name: str, items: list[tuple[str, bytes]], size: int) -> Windows:
    """The worker's automaton of a piece; kept from task to task until another piece is asked for."""
    if name not in _WINDOWS:
        _WINDOWS.clear()
        _WINDOWS[name] = Windows(items, size)
    return _WINDOWS[name]


def sent(spark: SparkSession, piece: list[tuple[str, bytes]], size: int):
    """A broadcast of a piece's items and their name, from which each worker builds the automaton once."""
    digest = hashlib.sha256(repr(size).encode())
    for item, text in piece:
        digest.update(b"%d:%b%d:%b" % (len(item.encode()), item.encode(), len(text), text))
    return spark.sparkContext.broadcast((digest.hexdigest(), piece, size))


def weight(data: bytes, size: int) -> int:
    """A bound of an item's nodes in an automaton; not less than its bytes, and five a word, so that the letters suffice."""
    words = len(words_of(data))
    return max(len(data), 5 * words, min(words, size) * max(words - size + 1, 1))


def chunks(parts: DataFrame, limit: int) -> Iterator[list[tuple[str, bytes]]]:
    """The parts (item_id, text, weight) in pieces of about ``limit``, streamed to the driver one partition at a time, which
    hold no more than about ``limit`` either."""
    total = parts.agg(F.sum("weight")).first()[0] or 0
    if total > limit:
        parts = parts.repartition(-(-total // limit))
    held, size = [], 0
    for row in parts.toLocalIterator():
        if held and size + row["weight"] > limit:
            yield held
            held, size = [], 0
        held.append((str(row["item_id"]), row["text"].encode()))
        size += row["weight"]
    if held:
        yield held


def original_spans(text: bytes, hit: np.ndarray) -> list[tuple[int, int]]:
    """Runs of hit words as code-point ranges of the text as it was given."""
    data = np.frombuffer(text, np.uint8)
    starts, ends = common.word_bounds(np.frombuffer(text.translate(LOWER), np.uint8), np.array([0, data.size]), NO_WORD)
    edge = np.diff(np.concatenate([[0], hit.astype(np.int8), [0]]))
    first, last = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) - 1
    point = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    return [(int(a), int(b)) for a, b in zip(point[starts[first]], point[ends[last]], strict=True)]


def cut_items(items: DataFrame, size: int, limit: int) -> DataFrame:
    """(item_id, text, weight), items of a weight over ``limit`` cut into parts with the same windows: they overlap by a window
    less one word. Null texts are empty."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                data = (text.as_py() or "").encode()
                parts = [data]
                if weight(data, size) > limit:
                    words = words_of(data)
                    # so many windows begin in one part
                    step = max(1, limit // max(size, -(-len(data) // len(words)))) if words else 1
                    starts = range(0, max(1, len(words) - size + 1), step)
                    parts = [b" ".join(words[a : a + step + size - 1]) for a in starts]
                columns = [[item] * len(parts), [part.decode() for part in parts], [weight(part, size) for part in parts]]
                types = [pa.string(), pa.string(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["item_id", "text", "weight"])

    return items.select(F.col("item_id").cast("string"), "text").mapInArrow(work, "item_id string, text string, weight long")


def hits_by_text(spark: SparkSession, docs: DataFrame, pieces: Iterator[list[tuple[str, bytes]]], size: int) -> DataFrame:
    """(text_key, ranges, items) of the texts that are hit: one scan of ``docs`` per piece, stored, so that no more than one
    piece's windows are held anywhere."""
    found = [spark.createDataFrame([], HITS)]
    for piece in pieces:
        held = sent(spark, piece, size)

        def look(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            windows = held_windows(*held.value)
            for batch in common.slices(batches, "text", common.ROW_BYTES):
                out = []
                for key, text in zip(batch.column("text_key").to_pylist(), batch.column("text").cast(pa.large_binary()).to_pylist(), strict=True):
                    hit, met = windows.scan(words_of(text))
                    if met:
                        edges = np.flatnonzero(np.diff(np.concatenate([[0], hit.astype(np.int8), [0]])))
                        out.append((key, edges.astype("<i8").tobytes(), sorted(met)))
                if out:
                    types = [pa.string(), pa.binary(), pa.list_(pa.string())]
                    columns = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)]
                    yield pa.RecordBatch.from_arrays(columns, ["text_key", "ranges", "items"])

        texts = docs.filter("text is not null").select(F.sha2("text", 256).alias("text_key"), "text")
        found.append(common.stored(texts.mapInArrow(look, HITS).dropDuplicates(["text_key"]), "hits"))
        held.destroy()
    every = functools.reduce(DataFrame.unionByName, found)
    return every.groupBy("text_key").agg(F.collect_list("ranges").alias("ranges"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"))


def judge(text: bytes | None, hit_of, share: int) -> tuple:
    text = text or b""
    words = words_of(text)
    hit, met = hit_of(words)
    n_hit = int(hit.sum())
    spans = ",".join(f"{a}:{b}" for a, b in original_spans(text, hit)) if n_hit else ""
    digest = hashlib.sha256(",".join(sorted(met)).encode()).hexdigest()
    return len(words), n_hit, len(met), digest, n_hit > 0 and share * n_hit >= len(words), spans


def from_ranges(ranges: list[bytes], items: list[str]):
    """The hits of a text as they were stored, in the form of ``scan``."""

    def hit_of(words: list[bytes]) -> tuple[np.ndarray, set[str]]:
        edges = np.frombuffer(b"".join(ranges), "<i8")
        return common.covered(len(words), edges[0::2], edges[1::2]), set(items)

    return hit_of


def split_pieces(items: DataFrame, size: int) -> tuple[list[tuple[str, bytes]] | None, Iterator[list[tuple[str, bytes]]]]:
    """The benchmark if it is one piece, else none; and its pieces, of which no more than two are held at once."""
    pieces = chunks(cut_items(items, size, AUTOMATON_NODES), AUTOMATON_NODES)
    first = next(pieces, [])
    second = next(pieces, None)
    return (first, iter(())) if second is None else (None, itertools.chain([first, second], pieces))


def joined(spark: SparkSession, docs: DataFrame, pieces: Iterator[list[tuple[str, bytes]]], size: int) -> DataFrame:
    """``docs`` with the stored hits of their texts as its last two columns, null where there are none."""
    key, ranges, items = common.fresh(docs, "key", "ranges", "items")
    hits = hits_by_text(spark, docs, pieces, size).select("text_key", "ranges", "items").toDF(key, ranges, items)
    return docs.join(hits, F.sha2("text", 256) == F.col(key), "left").select(*docs.columns, ranges, items)


def contamination(spark: SparkSession, docs: DataFrame, items: DataFrame, size: int = WINDOW, share: int = SHARE) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): the words, those hit, the items met, the verdict, and the hit runs.

    ``spans`` lists start:end of each run of hit words in the original text (code points, end exclusive). Null and empty
    texts have no words and are clean; items without words match nothing; an empty benchmark hits nothing; repeated rows
    each get a row. Items go to the executors in automata of bounded size, one at a time; a larger benchmark takes more scans.
    """
    docs = docs.select("doc_id", "text")
    whole, pieces = split_pieces(items, size)
    if whole is None:
        docs = joined(spark, docs, pieces, size)
    held = None if whole is None else sent(spark, whole, size)

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows = None if held is None else held_windows(*held.value)
        for batch in common.slices(batches, "text", common.ROW_BYTES):
            columns = list(zip(*(judge(text, hit_of, share) for text, hit_of in told_hits(batch, windows)), strict=True))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").cast(pa.int64()), *map(pa.array, columns)],
                ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "spans"],
            )

    return docs.mapInArrow(look, FOUND)


def told_hits(batch: pa.RecordBatch, windows: Windows | None) -> Iterator[tuple]:
    """Each text of the batch and how to find its hits: with the automaton, or as they were stored."""
    texts = batch.column("text").cast(pa.large_binary()).to_pylist()
    if windows is not None:
        return ((text, windows.scan) for text in texts)
    ranges, items = (batch.column(batch.num_columns - k).to_pylist() for k in (2, 1))
    return ((text, from_ranges(r or [], i or [])) for text, r, i in zip(texts, ranges, items, strict=True))


def clean(spark: SparkSession, docs: DataFrame, items: DataFrame, size: int = WINDOW, share: int = SHARE) -> DataFrame:
    """The rows of ``docs`` that are not contaminated, with all their columns."""
    schema = docs.schema
    whole, pieces = split_pieces(items, size)
    if whole is None:
        docs = joined(spark, docs, pieces, size)
    held = None if whole is None else sent(spark, whole, size)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows = None if held is None else held_windows(*held.value)
        for batch in common.slices(batches, "text", common.ROW_BYTES):
            good = []
            for text, hit_of in told_hits(batch, windows):
                words = words_of(text or b"")
                n_hit = int(hit_of(words)[0].sum())
                good.append(not (n_hit and share * n_hit >= len(words)))
            yield batch.select(schema.names).filter(pa.array(good))

    return docs.mapInArrow(keep, schema)
