"""Subword encoding: words are cut by a trie where their rows lie, each distinct word of a batch once."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from skeinwork.functions import arrays
from skeinwork.functions.text import spaced, token_words, words
from skeinwork.operators.masking import CLS, PAD, SEP, UNK
from skeinwork.operators.vocab import PREFIX
from skeinwork.session import frozen

# Longest word that is cut into pieces, and the default sequence length.
MAX_WORD_CHARS, MAX_LENGTH = 100, 512
VOCAB_LIMIT = 500_000
# Cut words that a worker remembers, and words or bytes of text that one pass takes: what a worker holds does not grow with its batches.
MEMO_WORDS, PASS_WORDS, PASS_BYTES = 250_000, 200_000, 8_000_000


class Trie:
    """Longest match from the left in one pass over a word, by failure links (linear in the word's length).

    Every node is a text that some token begins with. Where no child fits the next character, ``cut[node]`` are the pieces that
    the text so far certainly ends with, and ``link[node]`` is the node of what is left over, below the continuation root; no
    link means that the word cannot be covered.
    """

    def __init__(self, tokens: list[str], ids: list[int]) -> None:
        self.child: list[dict[str, int]] = [{}, {}]
        self.alone = {token: (number,) for token, number in zip(tokens, ids, strict=True) if token}
        whole: dict[int, int] = {}
        parents: list[tuple[int, str]] = [(0, ""), (0, "")]
        for token, number in zip(tokens, ids, strict=True):
            for root, text in ((0, token), (1, token.removeprefix(PREFIX) if token.startswith(PREFIX) else "")):
                node = root
                for c in text:
                    below = self.child[node].get(c)
                    if below is None:
                        below = self.child[node][c] = len(self.child)
                        self.child.append({})
                        parents.append((node, c))
                    node = below
                if text:
                    whole[node] = number
        self.link, self.cut = [-1] * len(self.child), [()] * len(self.child)
        level = [*self.child[0].values(), *self.child[1].values()]
        while level:
            for node in level:
                if node in whole:
                    self.link[node], self.cut[node] = 1, (whole[node],)
                    continue
                parent, c = parents[node]
                pieces, at = self.cut[parent], self.link[parent]
                while at >= 0 and c not in self.child[at]:
                    pieces, at = pieces + self.cut[at], self.link[at]
                if at >= 0:
                    self.link[node], self.cut[node] = self.child[at][c], pieces
            level = [below for node in level for below in self.child[node].values()]

    def pieces(self, word: str) -> tuple[int, ...]:
        """Ids of the greedy longest match; the unknown id alone for a word that cannot be covered, or is empty."""
        if (alone := self.alone.get(word)) is not None:
            return alone
        node, out = 0, ()
        for c in word:
            while (below := self.child[node].get(c)) is None:
                if self.link[node] < 0:
                    return (UNK,)
                out, node = out + self.cut[node], self.link[node]
            node = below
        while node != 1:
            if self.link[node] < 0:
                return (UNK,)
            out, node = out + self.cut[node], self.link[node]
        return out or (UNK,)


#: The trie a worker has built last, and the words it has cut with it.
_HELD: dict[str, tuple[Trie, dict[str, tuple[int, ...]]]] = {}


def _held(digest: str, tokens: list[str], ids: list[int]) -> tuple[Trie, dict[str, tuple[int, ...]]]:
    if digest not in _HELD:
        _HELD.clear()
        _HELD[digest] = Trie(tokens, ids), {}
    return _HELD[digest]


def _cut_lists(lists: pa.Array, cut: Callable[[str], tuple[int, ...]], memo: dict[str, tuple[int, ...]]) -> tuple[pa.Array, pa.Array]:
    """Piece ids of a column of word arrays, and pieces of each word; each distinct word of the batch is looked at once."""
    counts = arrays.lengths(lists)
    coded = lists.flatten().dictionary_encode()
    types = []
    for word in coded.dictionary.to_pylist():
        ids = memo.get(word)
        if ids is None:
            ids = cut(word)
            if len(memo) >= MEMO_WORDS:
                memo.clear()
            memo[word] = ids
        types.append(ids)
    lengths = np.fromiter(map(len, types), np.int64, len(types))
    pool = np.fromiter((x for ids in types for x in ids), np.int32, int(lengths.sum()))
    which = coded.indices.to_numpy(zero_copy_only=False)
    sizes = lengths[which] if which.size else np.empty(0, np.int64)
    ends = np.concatenate([[0], np.cumsum(sizes)])
    first = np.cumsum(lengths) - lengths
    source = np.repeat(first[which] - ends[:-1], sizes) + np.arange(ends[-1]) if which.size else np.empty(0, np.int64)
    words = np.concatenate([[0], np.cumsum(counts)])
    return (
        pa.ListArray.from_arrays(pa.array(ends[words], pa.int32()), pa.array(pool[source], pa.int32())),
        pa.ListArray.from_arrays(pa.array(words, pa.int32()), pa.array(sizes, pa.int32())),
    )


def _text_ids(texts: pa.Array, cut: Callable[[str], tuple[int, ...]], memo: dict[str, tuple[int, ...]], most: int | None) -> pa.Array:
    """Piece ids of a column of texts whose tokens stand apart by spaces, the first ``most`` of each. As many tokens are taken at
    first; a token may have no word, so more are where a text isn't through."""
    lists = pc.split_pattern(pc.fill_null(texts, ""), " ")
    if most is None:
        return _cut_lists(lists, cut, memo)[0]
    take, tokens = most, arrays.lengths(lists)
    while True:
        ids, _ = _cut_lists(pc.list_slice(lists, 0, take), cut, memo)
        if not np.any((tokens > take) & (arrays.lengths(ids) < most)):
            return pc.list_slice(ids, 0, most)
        take *= 4


def _passes(batch: pa.RecordBatch, lists: list[str], most: int = PASS_WORDS) -> Iterator[pa.RecordBatch]:
    """A batch cut so that one pass takes about ``most`` words; a longer row stands alone."""
    return (batch.slice(*part) for part in arrays.cuts(sum(arrays.lengths(batch.column(c)) for c in lists), most))


def _sent(vocab: DataFrame) -> tuple[str, Broadcast]:
    """A vocabulary's digest, and its tokens and ids for the workers."""
    rows = sorted(((r["id"], r["token"]) for r in vocab.select("token", "id").limit(VOCAB_LIMIT + 1).collect()))
    if len(rows) > VOCAB_LIMIT:
        raise ValueError(f"more than {VOCAB_LIMIT} tokens")
    ids, tokens = [i for i, _ in rows], [t for _, t in rows]
    return hashlib.sha256(repr(rows).encode()).hexdigest(), vocab.sparkSession.sparkContext.broadcast((tokens, ids))


def cut_words(df: DataFrame, lists: list[str], vocab: DataFrame, max_chars: int = MAX_WORD_CHARS, keep: bool = True) -> DataFrame:
    """``df`` with ``<list>_ids`` and ``<list>_sizes`` for each array column of words: piece ids, and pieces per word, in order.

    Pieces are the greedy longest match from the left; a word that cannot be covered, is longer than ``max_chars`` or is empty
    is the unknown id. A missing array is empty. Nothing moves: rows are cut where they lie, in a batch or a stream, against a trie
    that each worker builds once. The vocabulary, which is small by construction, may have ``VOCAB_LIMIT`` tokens. Without ``keep``
    the words do not come back.
    """
    digest, held = _sent(vocab)
    stay = [f for f in df.schema.fields if keep or f.name not in lists]
    schema = StructType([*stay, *[StructField(f"{c}_{x}", ArrayType(IntegerType())) for c in lists for x in ("ids", "sizes")]])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, memo = _held(digest, *held.value)

        def cut(word: str) -> tuple[int, ...]:
            return trie.pieces(word) if len(word) <= max_chars else (UNK,)

        for whole in batches:
            for batch in _passes(whole, lists):
                added = [x for c in lists for x in _cut_lists(batch.column(c), cut, memo)]
                yield pa.RecordBatch.from_arrays([*[batch.column(f.name) for f in stay], *added], schema.names)

    return df.mapInArrow(work, schema)


def cut_texts(df: DataFrame, key: str, text: str, vocab: DataFrame, most: int | None, max_chars: int = MAX_WORD_CHARS) -> DataFrame:
    """``(key, ids)``: the first ``most`` piece ids of the words of a text column, or all. As ``cut_words`` of its ``words``, but
    texts move as they are, and each distinct part between spaces is normalised and cut once."""
    digest, held = _sent(vocab)
    texts = df.select(key, spaced(F.col(text)).alias("ids"))
    schema = StructType([texts.schema[0], StructField("ids", ArrayType(IntegerType()))])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, memo = _held(f"{digest}:texts", *held.value)

        def cut(token: str) -> tuple[int, ...]:
            out = ()
            for word in token_words(token):
                out += trie.pieces(word) if len(word) <= max_chars else (UNK,)
            return out

        for batch in batches:
            for start, n in arrays.cuts(arrays.lengths(batch.column(1)), PASS_BYTES):
                ids = _text_ids(batch.column(1).slice(start, n), cut, memo, most)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, n), ids], schema.names)

    return texts.mapInArrow(work, schema)


def segment(types: DataFrame, vocab: DataFrame, max_chars: int = MAX_WORD_CHARS) -> DataFrame:
    """Adds ``pieces`` to a table with ``word``: ids of the greedy longest match from the left."""
    cut = cut_words(types.withColumn("_w", F.array("word")), ["_w"], vocab, max_chars)
    return cut.select(*types.columns, F.col("_w_ids").alias("pieces"))


def decode_words(df: DataFrame, ids: str, sizes: str, vocab: DataFrame, name: str = "decoded") -> DataFrame:
    """``df`` with the text of its pieces: those of a word without gap or prefix, words apart by one space."""
    rows = vocab.select("id", "token").limit(VOCAB_LIMIT + 1).collect()
    if len(rows) > VOCAB_LIMIT:
        raise ValueError(f"more than {VOCAB_LIMIT} tokens")
    plain = [""] * (max((r["id"] for r in rows), default=-1) + 1)
    for r in rows:
        plain[r["id"]] = r["token"].removeprefix(PREFIX)
    held = df.sparkSession.sparkContext.broadcast(plain)
    schema = StructType([*df.schema.fields, StructField(name, StringType())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts = pa.array(held.value, pa.string())
        for batch in (b for whole in batches for b in _passes(whole, [ids])):
            lengths = batch.column(sizes)
            ends = np.concatenate([[0], np.cumsum(lengths.flatten().to_numpy(zero_copy_only=False))])
            words = pc.binary_join(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), texts.take(batch.column(ids).flatten())), "")
            rows = np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(lengths), 0).to_numpy(zero_copy_only=False))])
            joined = pc.binary_join(pa.ListArray.from_arrays(pa.array(rows, pa.int32()), words), " ")
            yield pa.RecordBatch.from_arrays([*batch.columns, joined], schema.names)

    return df.mapInArrow(work, schema)


def template(ids: Column, max_len: int = MAX_LENGTH, mode: str = "truncate") -> Column:
    """Boundary ids around one sequence. ``truncate`` keeps both; ``slice`` cuts afterwards."""
    if mode == "slice":
        return F.slice(F.concat(F.array(F.lit(CLS)), ids, F.array(F.lit(SEP))), 1, max_len)
    return F.concat(F.array(F.lit(CLS)), F.slice(ids, 1, max_len - 2), F.array(F.lit(SEP)))


def pair_template(a: Column, b: Column, max_len: int = MAX_LENGTH, mode: str = "slice") -> Column:
    """``struct(input_ids, token_type_ids)`` of two sequences.

    ``slice`` joins, then cuts, which may lose the last boundary id; ``longest_first`` shortens
    the longer sequence until the boundary ids fit too.
    """
    size_a, size_b = F.size(a), F.size(b)
    if mode == "longest_first":
        room = max_len - 3
        half_a, half_b = (room + 1) // 2, room // 2
        fits = size_a + size_b <= room
        keep_a = F.when(fits, size_a).otherwise(
            F.least(size_a, F.greatest(F.lit(half_a), F.lit(room) - size_b))
        )
        keep_b = F.when(fits, size_b).otherwise(
            F.least(size_b, F.greatest(F.lit(half_b), F.lit(room) - size_a))
        )
        a, b = F.slice(a, 1, keep_a), F.slice(b, 1, keep_b)
    sep = F.array(F.lit(SEP))
    ids = F.concat(F.array(F.lit(CLS)), a, sep, b, sep)
    types = F.concat(F.array_repeat(F.lit(0), F.size(a) + 2), F.array_repeat(F.lit(1), F.size(b) + 1))
    return F.struct(
        F.slice(ids, 1, max_len).alias("input_ids"), F.slice(types, 1, max_len).alias("token_type_ids")
    )


def encode(
    df: DataFrame, key: str, vocab: DataFrame, text: str = "text", max_len: int | None = MAX_LENGTH,
    mode: str = "truncate", pad: str = "none",
) -> DataFrame:
    """``(key, input_ids, attention_mask, token_type_ids)`` of one text column.

    Of a text only what can reach the output is normalised and cut. ``pad`` is ``none``, ``longest`` (of the whole
    table) or ``max_length``. ``max_len=None`` keeps whole texts. Every row of ``df`` gets a row,
    whether its key repeats or is NULL.
    """
    return _framed(cut_texts(df, key, text, vocab, max_len), key, "ids", max_len, mode, pad)


def encode_words(
    df: DataFrame, key: str, vocab: DataFrame, listed: str = "w", max_len: int | None = MAX_LENGTH,
    mode: str = "truncate", pad: str = "none",
) -> DataFrame:
    """``encode`` for texts that are arrays of words already.

    A word gives one piece at least, so only the first ``max_len`` words can reach the output.
    """
    kept = F.col(listed) if max_len is None else F.slice(listed, 1, max_len)
    ids = cut_words(df.select(key, kept.alias("w")), ["w"], vocab, keep=False)
    return _framed(ids, key, "w_ids", max_len, mode, pad)


def _framed(cut: DataFrame, key: str, ids: str, max_len: int | None, mode: str, pad: str) -> DataFrame:
    """Piece ids between boundary ids, filled."""
    whole = 2_147_483_647 if max_len is None else max_len
    return padded(cut.select(key, template(F.col(ids), whole, mode).alias("input_ids")), key, max_len, pad)


def padded(encoded: DataFrame, key: str, max_len: int | None, pad: str) -> DataFrame:
    """Adds the attention mask and token types, and fills all three arrays."""
    if pad == "longest":
        frozen_ids = frozen(encoded)
        length = frozen_ids.agg(F.max(F.size("input_ids"))).first()[0] or 0
        encoded = frozen_ids
    elif pad == "max_length":
        length = max_len
    else:
        length = 0
    real = F.size("input_ids")
    full = F.greatest(real, F.lit(length))
    return encoded.select(
        key,
        arrays.fill_to(F.col("input_ids"), full, PAD).alias("input_ids"),
        arrays.fill_to(F.array_repeat(F.lit(1), real), full, 0).alias("attention_mask"),
        F.array_repeat(F.lit(0), full).alias("token_type_ids"),
    )


def encode_pair(
    df: DataFrame, key: str, vocab: DataFrame, first: str, second: str, max_len: int = MAX_LENGTH,
    mode: str = "slice",
) -> DataFrame:
    """``(key, input_ids, token_type_ids, attention_mask)`` of two text columns, filled to ``max_len``."""
    listed = [F.slice(words(F.col(c)), 1, max_len).alias(name) for c, name in ((first, "a"), (second, "b"))]
    ids = cut_words(df.select(key, *listed), ["a", "b"], vocab, keep=False)
    both = ids.select(key, pair_template(F.col("a_ids"), F.col("b_ids"), max_len, mode).alias("p"))
    return both.select(
        key,
        arrays.fit(F.col("p.input_ids"), max_len, PAD).alias("input_ids"),
        arrays.fit(F.col("p.token_type_ids"), max_len, 0).alias("token_type_ids"),
        arrays.attention(F.size("p.input_ids"), max_len).alias("attention_mask"),
    )
