"""Token ids in binary shards: independent zstandard frames, a seek table at the end, a checksum per frame.

File format of a shard, all integers little-endian:
frames   each a whole zstandard frame holding the ids of consecutive documents, 2 or 4 bytes each
entries  per document: frame number u32, first id in the frame u32, ids u32, has an id u32, doc_id i64
table    per frame: offset u64, packed bytes u32, ids u32, crc32 of the unpacked bytes u32, bytes per id u32
footer   packed bytes of the entries u64, frames u64, documents u64, crc32 of entries and table u32, the letters SKT1
The entries are one more zstandard frame. A reader takes the footer, then the entries and the table, then only the
frames that hold the documents it wants.
"""

from __future__ import annotations

import itertools
import os
import re
import uuid
import zlib
from collections.abc import Iterable, Iterator
from unicodedata import is_normalized

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skeinwork.llm import common
from skeinwork.session import scratch_path

END_ID = 2
#: Unpacked ids in a frame before the next one begins; a longer document has a frame of its own.
FRAME_IDS = 1 << 18
#: Words whose ids a worker remembers; beyond it the memory starts afresh.
REMEMBERED = 200_000
MAGIC = b"SKT1"
ENTRY = np.dtype([("frame", "<u4"), ("first", "<u4"), ("n", "<u4"), ("known", "<u4"), ("doc_id", "<i8")])
FRAME = np.dtype([("offset", "<u8"), ("packed", "<u4"), ("ids", "<u4"), ("crc", "<u4"), ("width", "<u4")])
FOOTER = np.dtype([("entries", "<u8"), ("frames", "<u8"), ("docs", "<u8"), ("crc", "<u4"), ("magic", "S4")])

_LETTER, _MARK, _OTHER = 1, 2, 3
KINDS = np.full(256, _OTHER, np.uint8)
KINDS[np.frombuffer(b"abcdefghijklmnopqrstuvwxyz", np.uint8)] = _LETTER
KINDS[np.frombuffer(b'!"#$%&()*+,-./:;=?@[]_{}', np.uint8)] = _MARK
KINDS[common.WHITE] = 0
SPECIAL = b"<|"
#: Below it all letters are Latin ones, known to every Unicode table.
LATIN_END = "\u0250"


class WordEncoder:
    """Encodes texts word by word through the given tokenizer, remembering the ids of words.

    A word is a stretch without ASCII white space, cut where an ASCII letter meets ASCII punctuation: there the
    tokenizer's own splitting always cuts, so the pieces' ids joined are the text's ids. Texts that may hold a special
    token go through the tokenizer whole. ``tests`` hold this against plain encoding.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        self.letters = ByteLevel(add_prefix_space=False, use_regex=False)
        probe = ["the", "straße", "épaules", "zyxwvut", "ñandú"]
        self.direct = all(self.word(w) == self.plain(w.encode()) for w in probe)
        self.forget()

    def forget(self) -> None:
        """Word 0 is the end of a document; the ids of word k are ``pool[starts[k] : starts[k] + sizes[k]]``."""
        self.known: dict[bytes, int] = {}
        self.pool, self.used = np.zeros(1 << 16, np.uint32), 1
        self.pool[0] = END_ID
        self.starts, self.sizes, self.count = np.zeros(1 << 14, np.int64), np.ones(1 << 14, np.int32), 1

    def plain(self, text: bytes) -> list[int]:
        return self.tokenizer.encode(text.decode(), add_special_tokens=False).ids

    def word(self, word: str) -> list[int]:
        """Ids of one word of lower-case Latin letters, which normalising and splitting leave as it is."""
        spelled = word if word.isascii() else self.letters.pre_tokenize_str(word)[0][0]
        return [token.id for token in self.tokenizer.model.tokenize(spelled)]

    def words(self, words: list[str]) -> list[list[int]]:
        """Ids of each; words of other than plain letters take the tokenizer's whole way."""
        simple = [self.direct and w.isalpha() and w == w.lower() and max(w) < LATIN_END and is_normalized("NFC", w) for w in words]
        others = iter(self.tokenizer.encode_batch_fast([w for w, s in zip(words, simple, strict=True) if not s], add_special_tokens=False))
        return [self.word(w) if s else next(others).ids for w, s in zip(words, simple, strict=True)]

    def keep(self, lists: list[list[int]]) -> None:
        sizes = np.fromiter(map(len, lists), np.int32, len(lists))
        total = int(sizes.sum())
        while self.used + total > self.pool.size:
            self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
        while self.count + sizes.size > self.starts.size:
            self.starts, self.sizes = (np.concatenate([x, np.zeros_like(x)]) for x in (self.starts, self.sizes))
        self.pool[self.used : self.used + total] = np.fromiter(itertools.chain.from_iterable(lists), np.uint32, total)
        here = slice(self.count, self.count + sizes.size)
        self.starts[here] = self.used + np.cumsum(sizes) - sizes
        self.sizes[here] = sizes
        self.used += total
        self.count += sizes.size

    def learn(self, words: list[bytes]) -> np.ndarray:
        """The number of each word."""
        new = [w for w in words if w not in self.known]
        if self.count + len(new) > REMEMBERED:
            self.forget()
            new = words
        for begin in range(0, len(new), 4096):
            some = new[begin : begin + 4096]
            self.known.update(zip(some, range(self.count, self.count + len(some)), strict=True))
            self.keep(self.words([w.decode() for w in some]))
        return np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows, each row closed by ``END_ID``, and the number of ids of each row."""
        n, raw = offsets.size - 1, data.tobytes()
        special = [i for i in range(n) if raw.find(SPECIAL, offsets[i], offsets[i + 1]) >= 0] if SPECIAL in raw else []
        low = raw.lower()
        lower = np.frombuffer(low, np.uint8)
        starts, ends = self.pieces(lower, offsets)
        owner = np.searchsorted(offsets, starts, "right") - 1
        if special:
            keep = ~np.isin(owner, special)
            starts, ends, owner = starts[keep], ends[keep], owner[keep]
        if starts.size:
            (hashes,) = common.word_hashes(lower, starts, ends, 1)
            order = np.argsort(hashes)
            new = np.append(True, hashes[order[1:]] != hashes[order[:-1]])
            group = np.cumsum(new) - 1
            first = order[new]
            # words whose hashes clash would as a rule differ here; then every row is taken whole
            looks = (ends - starts) << 16 | lower[starts].astype(np.int64) << 8 | lower[ends - 1]
            if np.any(looks[order] != looks[first][group]):
                special, starts, ends, owner = list(range(n)), starts[:0], ends[:0], owner[:0]
        if starts.size:
            numbers = self.learn([low[a:b] for a, b in zip(starts[first].tolist(), ends[first].tolist(), strict=True)])
            which = np.empty(starts.size, np.int64)
            which[order] = numbers[group]
        else:
            which = np.empty(0, np.int64)
        begin = self.count
        self.keep([self.plain(raw[offsets[i] : offsets[i + 1]]) for i in special])
        # every row's words, or the one number that stands for a row taken whole, and its end
        pieces = np.bincount(owner, minlength=n)
        pieces[special] = 1
        row_end = np.cumsum(pieces + 1) - 1
        line = np.zeros(int(row_end[-1]) + 1 if n else 0, np.int64)
        inner = np.ones(line.size, bool)
        inner[row_end] = False
        if special:
            inner[row_end[special] - 1] = False
            line[row_end[special] - 1] = np.arange(begin, self.count)
        line[inner] = which
        counts = self.sizes[line].astype(np.int64)
        ends_at = np.cumsum(counts)
        found = self.pool[np.repeat(self.starts[line] - (ends_at - counts), counts) + np.arange(int(counts.sum()))]
        row_n = np.diff(np.append(0, ends_at[row_end])) if n else np.empty(0, np.int64)
        return found, row_n

    @staticmethod
    def pieces(lower: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not lower.size:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        kind = KINDS[lower]
        cut = np.zeros(lower.size + 1, bool)
        cut[offsets] = True
        left, right = kind[:-1], kind[1:]
        cut[1:-1] |= (left == 0) | (right == 0) | ((left == _LETTER) & (right == _MARK)) | ((left == _MARK) & (right == _LETTER))
        at = np.flatnonzero(cut)
        starts, ends = at[:-1], at[1:]
        words = kind[starts] != 0
        return starts[words], ends[words]


_ENCODERS: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """The worker's encoder of a vocabulary file; kept from task to task."""
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


def filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    """The store of a shared folder; local and mounted folders as such, others by their scheme."""
    local = re.sub(r"^file:(//)?(?=/)", "", uri)
    if local.startswith("/"):
        return pafs.LocalFileSystem(), local
    return pafs.FileSystem.from_uri(uri)


def write_shard(store: pafs.FileSystem, path: str, docs: Iterable[tuple[int | None, np.ndarray]]) -> tuple[int, int]:
    """Write documents in the order given; returns how many documents and ids. The file appears under its name only
    when it is whole, so a failed attempt leaves no half of it."""
    attempt = f"{path}.{uuid.uuid4().hex}"
    packer = zstandard.ZstdCompressor(level=3)
    entries, frames, waiting, held, offset = [], [], [], 0, 0

    with store.open_output_stream(attempt) as out:

        def close_frame() -> None:
            nonlocal offset, held
            found = np.concatenate(waiting)
            width = 2 if found.max(initial=0) < 1 << 16 else 4
            plain = found.astype(f"<u{width}").tobytes()
            packed = packer.compress(plain)
            out.write(packed)
            frames.append((offset, len(packed), found.size, zlib.crc32(plain), width))
            offset += len(packed)
            waiting.clear()
            held = 0

        for doc_id, found in docs:
            if waiting and held + found.size > FRAME_IDS:
                close_frame()
            entries.append((len(frames), held, found.size, doc_id is not None, doc_id or 0))
            waiting.append(found)
            held += found.size
        if waiting:
            close_frame()
        listing, seek = np.array(entries, ENTRY), np.array(frames, FRAME)
        plain = listing.tobytes()
        packed = packer.compress(plain)
        out.write(packed)
        out.write(seek.tobytes())
        crc = zlib.crc32(seek.tobytes(), zlib.crc32(plain))
        out.write(np.array([(len(packed), seek.size, listing.size, crc, MAGIC)], FOOTER).tobytes())
    if store.get_file_info(path).type != pafs.FileType.NotFound:
        store.delete_file(path)  # of an attempt whose answer was lost
    store.move(attempt, path)
    return listing.size, int(seek["ids"].sum())


class ShardReader:
    """Reads chosen documents of a shard; every checksum is compared."""

    def __init__(self, store: pafs.FileSystem, path: str):
        self.file = store.open_input_file(path)
        self.file.seek(self.file.size() - FOOTER.itemsize)
        foot = np.frombuffer(self.file.read(FOOTER.itemsize), FOOTER)[0]
        if foot["magic"] != MAGIC:
            raise ValueError(f"{path} is no token shard")
        tail = int(foot["frames"]) * FRAME.itemsize
        self.file.seek(self.file.size() - FOOTER.itemsize - tail - int(foot["entries"]))
        plain = zstandard.ZstdDecompressor().decompress(self.file.read(int(foot["entries"])))
        seek = self.file.read(tail)
        if zlib.crc32(seek, zlib.crc32(plain)) != foot["crc"]:
            raise ValueError(f"{path}: the seek table is damaged")
        self.entries, self.frames = np.frombuffer(plain, ENTRY), np.frombuffer(seek, FRAME)

    def frame(self, k: int) -> np.ndarray:
        row = self.frames[k]
        self.file.seek(int(row["offset"]))
        plain = zstandard.ZstdDecompressor().decompress(self.file.read(int(row["packed"])))
        if zlib.crc32(plain) != row["crc"]:
            raise ValueError(f"frame {k} is damaged")
        return np.frombuffer(plain, f"<u{row['width']}").astype(np.uint32)

    def documents(self, wanted: Iterable[int] | None = None) -> Iterator[tuple[int | None, np.ndarray]]:
        """(doc_id, ids) of the documents at the places ``wanted``, or of all; each needed frame is unpacked once."""
        places = np.arange(self.entries.size) if wanted is None else np.asarray(list(wanted), np.int64)
        held, at = None, -1
        for entry in self.entries[places]:
            if entry["frame"] != at:
                at, held = int(entry["frame"]), self.frame(int(entry["frame"]))
            first = int(entry["first"])
            yield (int(entry["doc_id"]) if entry["known"] else None), held[first : first + int(entry["n"])]

    def close(self) -> None:
        self.file.close()


WRITTEN = "shard int, path string, n_docs long, n_ids long"
READ = "doc_id long, start long, n_tokens long, ids_crc32 long"


def write_tokens(docs: DataFrame, folder: str, vocabulary: str, shards: int) -> DataFrame:
    """Encode ``docs`` (doc_id, text) and write them as shards in ascending doc_id order, rows without an id first.

    Returns one row per shard (shard, path, n_docs, n_ids), shards in document order. Null texts are empty; repeated ids
    are written as often as they occur, ordered by text. An empty table makes no shard.
    """
    ordered = docs.select("doc_id", "text").repartitionByRange(shards, "doc_id").sortWithinPartitions("doc_id", "text")
    ordered = ordered.select("doc_id", "text", F.spark_partition_id().alias("shard"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary)
        batches = (b for b in batches if b.num_rows)
        head = next(batches, None)
        if head is None:
            return
        shard = head.column("shard")[0].as_py()

        def rows() -> Iterator[tuple[int | None, np.ndarray]]:
            for batch in common.slices(_chain(head, batches), "text", common.ROW_BYTES):
                found, counts = encode.encode(*common.flat(batch.column("text")))
                ends = np.cumsum(counts)
                for doc_id, a, b in zip(batch.column("doc_id").to_pylist(), ends - counts, ends, strict=True):
                    yield doc_id, found[a:b]

        store, base = filesystem(folder)
        path = f"{base}/part-{shard:06d}.skt"
        store.create_dir(base, recursive=True)
        n_docs, n_ids = write_shard(store, path, rows())
        yield pa.RecordBatch.from_pydict(
            {"shard": pa.array([shard], pa.int32()), "path": [path], "n_docs": [n_docs], "n_ids": [n_ids]}
        )

    return ordered.mapInArrow(write, WRITTEN)


def _chain(head, rest):
    yield head
    yield from rest


def read_tokens(shards: DataFrame, folder: str, base: str = "start") -> DataFrame:
    """Per document of the shards (path, ``base``: ids in all shards before) its place, size and checksum."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = filesystem(folder)
        for batch in batches:
            for path, start in zip(batch.column("path").to_pylist(), batch.column(base).to_pylist(), strict=True):
                reader, rows = ShardReader(store, path), []
                for doc_id, found in reader.documents():
                    rows.append((doc_id, start, found.size, zlib.crc32(found.astype("<u4").tobytes())))
                    start += found.size
                reader.close()
                columns = list(zip(*rows, strict=True)) or [[], [], [], []]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return shards.select("path", base).mapInArrow(read, READ)


def token_table(spark: SparkSession, docs: DataFrame, vocabulary: str, folder: str | None = None, shards: int | None = None) -> DataFrame:
    """Write ``docs`` as token shards, then read them back: doc_id, start, n_tokens, ids_crc32.

    ``start`` counts the ids of all documents before. Only one row per shard (its name and sizes) passes the driver.
    """
    folder = folder or scratch_path(spark, "tokens")
    shards = shards or common.parts(spark)
    written = write_tokens(docs, folder, vocabulary, shards).collect()
    starts, total = [], 0
    for row in sorted(written, key=lambda r: r["shard"]):  # sorting in Spark would write all shards once more, to sample them
        starts.append((row["path"], total))
        total += row["n_ids"]
    listing = spark.createDataFrame(starts, "path string, start long").repartition(max(1, len(starts)))
    return read_tokens(listing, folder)
