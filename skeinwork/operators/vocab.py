"""Vocabulary: word counts, alphabet, pair counts, and training by repeated pair merges."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skeinwork.functions.arrays import lengths, let, passes
from skeinwork.functions.text import characters, spaced, token_words
from skeinwork.operators import merges
from skeinwork.operators.merges import PREFIX, merged_name
from skeinwork.session import frozen

# Special tokens (ids 0..4), continuation prefix and training limits.
SPECIALS = ["[PAD]", "[UNK]", "[CLS]", "[SEP]", "[MASK]"]
VOCAB_SIZE, MIN_FREQUENCY, ALPHABET_LIMIT = 30_500, 2, 1000

# Best pairs a training round begins to look at and most it comes to, cells of words or stretches of words that may reach the driver
# (some 6 bytes each there), and symbols seen on each side of a pair.
LOOK, LOOK_MOST, CELLS, AROUND = 64, 8192, 60_000_000, 2
# Pairs that a counting task holds before it passes them on, and bytes of text whose words it counts together.
PAIRS_HELD, PASS_BYTES = 300_000, 32_000_000
# ASCII marks that stand alone, and the line feed.
MARK = r"([!-/:-@\[-`{-~\n])"


def word_counts(df: DataFrame, text: str = "text") -> DataFrame:
    """``(word, n)`` of normalised, pre-tokenised text. No rule looks beyond a space, so each distinct token of a pass is worked
    through once (ASCII letters are lowered and ASCII marks set apart before, which leaves fewer); words are added up by pass
    before the shuffle."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for texts in passes(batch.column("text"), PASS_BYTES):
                plainer = pc.replace_substring_regex(pc.ascii_lower(texts), MARK, r" \1 ")
                tokens, found = pc.split_pattern(plainer, " ").flatten().value_counts().flatten(), {}
                for token, n in zip(*(column.to_pylist() for column in tokens), strict=True):
                    for word in token_words(token):
                        found[word] = found.get(word, 0) + n
                yield pa.RecordBatch.from_arrays([pa.array(found, pa.string()), pa.array(found.values(), pa.int64())], ["word", "n"])

    counts = df.select(spaced(F.col(text)).alias("text")).mapInArrow(count, "word string, n bigint")
    return counts.groupBy("word").agg(F.sum("n").alias("n"))


def counted(df: DataFrame, lists: Column) -> DataFrame:
    """``(word, n)`` of the words in an array expression.

    The outer explode matters: for the inner one the optimizer adds a filter on the array's size,
    which would compute the array again.
    """
    exploded = df.select(F.explode_outer(lists).alias("word")).filter(F.col("word").isNotNull())
    return exploded.groupBy("word").agg(F.count(F.lit(1)).alias("n"))


def character_counts(counts: DataFrame) -> DataFrame:
    """``(char, n)`` weighted by word counts."""
    return (
        counts.select(F.explode_outer(characters(F.col("word"))).alias("char"), "n")
        .filter(F.col("char").isNotNull())
        .groupBy("char")
        .agg(F.sum("n").alias("n"))
    )


def alphabet(counts: DataFrame, limit: int = ALPHABET_LIMIT) -> DataFrame:
    """The ``limit`` most frequent characters; ties by character."""
    return character_counts(counts).orderBy(F.desc("n"), F.asc("char")).limit(limit)


def symbols(word: Column) -> Column:
    """Characters of a word, all but the first with the continuation prefix."""
    return F.transform(characters(word), lambda c, i: F.when(i == 0, c).otherwise(F.concat(F.lit(PREFIX), c)))


def neighbours(parts: Column) -> Column:
    """Array of ``struct(left, right)`` of adjacent symbols."""
    return let(
        parts,
        lambda p: F.transform(
            F.slice(p, 1, F.greatest(F.size(p) - 1, F.lit(0))),
            lambda left, i: F.struct(left.alias("left"), F.get(p, i + 1).alias("right")),
        ),
    )


def pair_counts(counts: DataFrame, parts: Column | None = None) -> DataFrame:
    """``(left, right, n)``: adjacent symbol pairs weighted by word counts."""
    parts = symbols(F.col("word")) if parts is None else parts
    pairs = counts.select(F.explode_outer(neighbours(parts)).alias("p"), "n").filter(F.col("p").isNotNull())
    return pairs.groupBy("p.left", "p.right").agg(F.sum("n").alias("n"))


def state_pairs(state: DataFrame) -> DataFrame:
    """``(left, right, n)`` of words ``(s, n)`` whose symbols stand apart by spaces; pairs are added up by task before the shuffle."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple[str, str], int] = {}
        for batch in batches:
            for s, n in zip(batch.column("s").to_pylist(), batch.column("n").to_pylist(), strict=True):
                parts = s.split(" ")
                for pair in zip(parts, parts[1:]):
                    found[pair] = found.get(pair, 0) + n
            if len(found) >= PAIRS_HELD:
                yield rows(found)
                found = {}
        yield rows(found)

    def rows(found: dict[tuple[str, str], int]) -> pa.RecordBatch:
        columns = [pa.array([p[0] for p in found], pa.string()), pa.array([p[1] for p in found], pa.string())]
        return pa.RecordBatch.from_arrays([*columns, pa.array(list(found.values()), pa.int64())], ["left", "right", "n"])

    pairs = state.select("s", "n").mapInArrow(find, "left string, right string, n bigint")
    return pairs.groupBy("left", "right").agg(F.sum("n").alias("n"))


def marked_pairs(top: list[tuple[str, str]], known: set[str]) -> tuple[frozenset, frozenset]:
    """Pairs whose every occurrence a round must see: the best ones, and all beside a token that one of them makes again."""
    return frozenset(top), frozenset(t for t in (merged_name(left, right) for left, right in top) if t in known)


def stretches(parts: list[str], pairs: frozenset, again: frozenset) -> list[tuple[int, int]]:
    """Ranges of a word's symbols around its marked pairs; ranges do not overlap or touch."""
    out: list[tuple[int, int]] = []
    for i in range(len(parts) - 1):
        if (parts[i], parts[i + 1]) in pairs or parts[i] in again or parts[i + 1] in again:
            begin, end = max(0, i - AROUND), min(len(parts), i + 2 + AROUND)
            if out and begin <= out[-1][1]:
                out[-1] = out[-1][0], end
            else:
                out.append((begin, end))
    return out


def contexts(state: DataFrame, top: list[tuple[str, str]], known: set[str]) -> DataFrame:
    """``(s, before, after, n)``: the stretches of all words that a round must see, equal ones counted together.

    ``before`` and ``after`` tell whether the word goes on beyond the stretch.
    """
    pairs, again = marked_pairs(top, known)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: dict[tuple[str, bool, bool], int] = {}
            for s, n in zip(batch.column("s").to_pylist(), batch.column("n").to_pylist(), strict=True):
                parts = s.split(" ")
                for begin, end in stretches(parts, pairs, again):
                    key = " ".join(parts[begin:end]), begin > 0, end < len(parts)
                    found[key] = found.get(key, 0) + n
            yield pa.RecordBatch.from_pydict(
                {"s": [k[0] for k in found], "before": [k[1] for k in found], "after": [k[2] for k in found], "n": list(found.values())},
                pa.schema([("s", pa.string()), ("before", pa.bool_()), ("after", pa.bool_()), ("n", pa.int64())]),
            )

    schema = "s string, before boolean, after boolean, n bigint"
    return state.select("s", "n").mapInArrow(find, schema).groupBy("s", "before", "after").agg(F.sum("n").alias("n"))


def held_cells(words: DataFrame, tokens: list[str], most: int) -> tuple[np.ndarray, np.ndarray]:
    """Words or stretches ``(s, before, after, n)`` on the driver, heaviest first: their symbols' numbers as ``merges`` lays them, and ``n``."""
    numbers = words.sparkSession.sparkContext.broadcast({t: i for i, t in enumerate(tokens, merges.FIRST)})
    kind = merges.number_kind(most)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = numbers.value
        for batch in batches:
            lists = pc.split_pattern(batch.column("s"), " ")
            coded = lists.flatten().dictionary_encode()
            ids = np.array([known[t] for t in coded.dictionary.to_pylist()], kind)[coded.indices.to_numpy(zero_copy_only=False)]
            edges = [batch.column(c).to_numpy(zero_copy_only=False).astype(bool) for c in ("before", "after")]
            cells, n = merges.laid(ids, lengths(lists), *edges), batch.column("n").to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([pa.array([cells.tobytes()]), pa.array([n.tobytes()])], ["cells", "n"])

    rows = words.orderBy(F.desc("n"), "s").mapInArrow(work, "cells binary, n binary").collect()
    weights = np.concatenate([np.zeros(0, np.int64), *[np.frombuffer(r["n"], np.int64) for r in rows]])
    cells, size = np.zeros(sum(len(r["cells"]) for r in rows) // np.dtype(kind).itemsize + 1, kind), 0
    rows.reverse()
    while rows:
        part = np.frombuffer(rows.pop()["cells"], kind)
        cells[size : size + part.size] = part
        size += part.size
    return cells, weights


def cell_count(words: DataFrame) -> int:
    """Cells that words ``s`` take: their symbols and a gap each."""
    return words.agg(F.sum(F.length("s") - F.length(F.replace("s", F.lit(" "))) + 2)).first()[0] or 0


def joined_at(parts: list[str], pair: tuple[str, str], token: str) -> list[str]:
    """``parts`` with every occurrence of the pair joined, from the left and without overlap."""
    out, i = [], 0
    while i < len(parts):
        if i + 1 < len(parts) and parts[i] == pair[0] and parts[i + 1] == pair[1]:
            out.append(token)
            i += 2
        else:
            out.append(parts[i])
            i += 1
    return out


def apply_merges(state: DataFrame, merges: list[tuple[str, str]]) -> DataFrame:
    """Words after the merges, taken in order; a pair that comes to be after its turn stays apart."""
    turns: dict[tuple[str, str], list[int]] = {}
    for turn, pair in enumerate(merges):
        turns.setdefault(pair, []).append(turn)

    def merged(s: str) -> str:
        parts, now = s.split(" "), 0
        while len(parts) > 1:
            due = [t for pair in zip(parts, parts[1:]) if pair in turns for t in turns[pair] if t >= now]
            if not due:
                break
            now = min(due)
            parts = joined_at(parts, merges[now], merged_name(*merges[now]))
            now += 1
        return " ".join(parts)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pa.array([merged(s) for s in batch.column("s").to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("n"), texts], ["n", "s"])

    return state.select("n", "s").mapInArrow(work, "n bigint, s string")


def train(
    counts: DataFrame,
    vocab_size: int = VOCAB_SIZE,
    min_frequency: int = MIN_FREQUENCY,
    alphabet_limit: int = ALPHABET_LIMIT,
    look: int = LOOK,
    limit: int = CELLS,
) -> DataFrame:
    """Vocabulary ``(token, id)`` from word counts: specials, alphabet, continuations, then merges.

    The result is that of merging one pair at a time; equal counts go by left, then right symbol. Characters outside the
    alphabet drop out. Words that take at most ``limit`` cells (a symbol or a gap each) come to the driver, which does all merges on
    them. Of more, a round counts all pairs where the words lie and takes the ``look`` best (up to ``LOOK_MOST`` as rounds go on); the words'
    stretches around them, counted together, are all that decides the next merges. Beyond ``limit`` cells of them fewer
    pairs are looked at, and of a single pair nothing but its merge. Then the words are rewritten where they lie, which
    leaves fewer cells. So the driver's share is bounded, and a round settles many merges.
    """
    spark = counts.sparkSession
    letters = sorted(r["char"] for r in alphabet(counts, alphabet_limit).collect())
    allowed = F.lit("".join(letters))
    kept = F.filter(characters(F.col("word")), lambda c: F.contains(allowed, c))
    spelled = F.transform(kept, lambda c, i: F.when(i == 0, c).otherwise(F.concat(F.lit(PREFIX), c)))
    state = frozen(counts.select("n", F.array_join(spelled, " ").alias("s")).filter("s <> ''"))
    parts = F.split("s", " ")
    inner = state.select(F.explode(parts).alias("t")).filter(F.col("t").startswith(PREFIX)).distinct()
    tokens = SPECIALS + letters + sorted(r["t"] for r in inner.limit(2 * alphabet_limit).collect())
    known = set(tokens)
    whole = F.lit(False)
    while len(tokens) < vocab_size:
        room, names = vocab_size - len(tokens), ["", "", *tokens]
        done = cell_count(state) <= limit
        if done:
            merger = merges.Merger(*held_cells(state.select("s", whole.alias("before"), whole.alias("after"), "n"), tokens, vocab_size), names)
            order = merger.merges(known, room, min_frequency)
        else:
            ranked = state_pairs(state).filter(F.col("n") >= min_frequency).orderBy(F.desc("n"), "left", "right").limit(look + 1).collect()
            if not ranked:
                break
            order, look = next_merges(state, [tuple(r) for r in ranked], look, limit, tokens, room, min_frequency, vocab_size)
        for left, right in order:
            token = merged_name(left, right)
            if token not in known:
                tokens.append(token)
                known.add(token)
        if done:
            break
        if len(tokens) < vocab_size:
            state = frozen(apply_merges(state, order))
    return from_tokens(spark, tokens)


def next_merges(
    state: DataFrame, ranked: list[tuple[str, str, int]], look: int, limit: int, tokens: list[str], room: int, least: int, most: int
) -> tuple[list[tuple[str, str]], int]:
    """The merges that the stretches around the ``look`` best pairs settle, ``ranked`` having one more, and how many to look at next."""
    known = set(tokens)
    while look > 1:
        top = [pair[:2] for pair in ranked[:look]]
        found = frozen(contexts(state, top, known))
        cells = cell_count(found)
        if cells <= limit:
            last = (-ranked[look][2], *ranked[look][:2]) if len(ranked) > look else None
            _, again = marked_pairs(top, known)
            held = held_cells(found, tokens, most)
            merger = merges.StretchMerger(*held, ["", "", *tokens], top=top, again=again, last=last, known=known)
            return merger.merges(known, room, least), min(2 * look, LOOK_MOST) if cells * 3 <= limit else look
        look //= 2
    return [ranked[0][:2]], min(2, LOOK_MOST)


def from_tokens(spark: SparkSession, tokens: list[str]) -> DataFrame:
    return spark.createDataFrame([(t, i) for i, t in enumerate(tokens)], "token string, id int")


def continuation_flags(vocab: DataFrame, limit: int = 1_000_000) -> list[bool]:
    """Per id, whether it is a continuation piece; a vocabulary is small by construction."""
    rows = vocab.select("id", F.col("token").startswith(PREFIX).alias("c")).limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"more than {limit} tokens")
    flags = [False] * (max(r["id"] for r in rows) + 1)
    for row in rows:
        flags[row["id"]] = row["c"]
    return flags


def ranked_tokens(parts: list[DataFrame]) -> DataFrame:
    """Number the tokens of ``(token, n)`` tables, table after table, by falling count, then name.
    The first table that holds a token decides. For vocabularies only: one window numbers all."""
    stacked = None
    for place, part in enumerate(parts):
        tagged = part.select("token", F.col("n").cast("bigint").alias("n"), F.lit(place).alias("place"))
        stacked = tagged if stacked is None else stacked.unionByName(tagged)
    first = stacked.groupBy("token").agg(F.min(F.struct("place", (-F.col("n")).alias("minus"))).alias("k"))
    order = Window.orderBy("k.place", "k.minus", "token")
    return first.select("token", (F.row_number().over(order) - 1).cast("int").alias("id"))
