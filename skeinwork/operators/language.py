"""Language and length filter, and a language predictor learnt from a labelled table."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skeinwork.functions.text import strip
from skeinwork.session import frozen

# Language kept, least length, and the one character a line's end adds to it.
KEPT_LANGUAGE, MIN_CHARS, LINE_END = "en", 1000, 1
SCALE = 1_000_000
# Bits of a character in a gram's key, characters that one numpy pass takes, grams that a worker holds at once.
BITS, PASS_CHARS, MODEL_LIMIT = 21, 500_000, 2_000_000
# Cells of a table over the frequent characters' grams, and kinds that a counting task holds before it passes them on.
CELLS, HELD_KINDS = 4_000_000, 500_000


def is_kept(
    lang: Column, text: Column, language: str = KEPT_LANGUAGE, min_chars: int = MIN_CHARS, size: Column | None = None
) -> Column:
    size = F.length(text) if size is None else size
    return F.coalesce((lang == language) & (size + LINE_END >= min_chars), F.lit(False))


def accepted(df: DataFrame, language: str = KEPT_LANGUAGE, min_chars: int = MIN_CHARS, size: str | None = None) -> DataFrame:
    """Documents of the language that are long enough, stripped. ``size`` names a column that holds the length in the text's place."""
    length = F.length("text") if size is None else F.col(size)
    kept = df.filter(F.col("lang") == language).filter(length + LINE_END >= min_chars)
    return kept.withColumn("text", strip(F.col("text"))) if size is None else kept


def rejected(df: DataFrame, language: str = KEPT_LANGUAGE, min_chars: int = MIN_CHARS, size: str | None = None) -> DataFrame:
    """The other documents with the reason: another ``language``, or too ``short``."""
    length = F.length("text") if size is None else F.col(size)
    dropped = df.filter(~is_kept(F.col("lang"), F.lit(None), language, min_chars, length))
    return dropped.withColumn("reason", F.when(F.col("lang") == language, "short").otherwise("language"))


def reject_counts(df: DataFrame) -> DataFrame:
    return df.groupBy("lang", "reason").agg(F.count(F.lit(1)).alias("n"))


def code_points(lows: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Code points of a column of texts, one after the other, and the row of each."""
    texts = pc.fill_null(lows, "")
    points = np.frombuffer("".join(texts.to_pylist()).encode("utf-32-le", "surrogatepass"), np.uint32)
    sizes = pc.utf8_length(texts).to_numpy(zero_copy_only=False)
    return points, np.repeat(np.arange(sizes.size, dtype=np.int32), sizes)


class Letters:
    """Some frequent characters: grams of them alone have small numbers, so tables take the place of sorting and searching."""

    def __init__(self, letters: np.ndarray) -> None:
        self.letters = np.sort(letters).astype(np.uint64)
        self.size = self.letters.size
        self.code = np.full(0x110000, self.size, np.int32)
        self.code[self.letters.astype(np.int64)] = np.arange(self.size)

    def grams(self, points: np.ndarray, row: np.ndarray, longest: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """Per length ``(n, number, plain, key, other)``: of the grams that cross no row, those of these characters alone have a
        number, at the places ``plain``; the others their key, at the places ``other``.

        A key holds the code points themselves, 21 bits each, so different grams (of up to three characters) have different keys.
        """
        if longest > 3:
            raise ValueError("a key holds three characters")
        codes = self.code[points]
        strange = codes == self.size
        number, odd, none = codes, strange, not strange.any()
        for n in range(1, longest + 1):
            if n > 1:
                number = number[: max(0, points.size - n + 1)] * self.size + codes[n - 1 :]
                odd = odd[: number.size] | strange[n - 1 :]
            inside = row[: number.size] == row[n - 1 : n - 1 + number.size]
            plain = np.flatnonzero(inside if none else inside & ~odd)
            other = np.empty(0, np.int64) if none else np.flatnonzero(inside & odd)
            key = np.zeros(other.size, np.uint64)
            for i in range(n):
                key = key << np.uint64(BITS) | (points[other + i].astype(np.uint64) + np.uint64(1))
            yield n, number[plain], plain, key, other

    def keys(self, numbers: np.ndarray, n: int) -> np.ndarray:
        """The keys of numbers."""
        out, rest = np.zeros(numbers.size, np.uint64), numbers
        for i in range(n):
            rest, letter = np.divmod(rest, self.size)
            out |= (self.letters[letter] + np.uint64(1)) << np.uint64(BITS * i)
        return out


def frequent(points: np.ndarray, cells: int, longest: int) -> Letters:
    """As many of the most frequent characters as have grams for so many cells."""
    counts = np.bincount(points)
    most = max(1, int(cells ** (1 / longest)))
    return Letters(np.argsort(-counts, kind="stable")[: min(most, int(np.count_nonzero(counts)))])


def pass_counts(lows: pa.Array, codes: np.ndarray, kinds: int, longest: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys of all grams of a column of texts, and how often each is in rows of each of ``kinds`` codes."""
    points, row = code_points(lows)
    if not points.size:
        return np.empty(0, np.uint64), np.empty((0, kinds), np.int64)
    letters = frequent(points, CELLS // kinds, longest)
    found = []
    for n, number, plain, key, other in letters.grams(points, row, longest):
        table = np.bincount(number.astype(np.int64) * kinds + codes[row[plain]], minlength=letters.size**n * kinds).reshape(-1, kinds)
        seen = np.flatnonzero(table.any(axis=1))
        found.append((letters.keys(seen, n), table[seen]))
        if other.size:
            rare, which = np.unique(key, return_inverse=True)
            table = np.bincount(which * kinds + codes[row[other]], minlength=rare.size * kinds)
            found.append((rare, table.reshape(-1, kinds)))
    return np.concatenate([k for k, _ in found]), np.concatenate([t for _, t in found])


def merged_counts(found: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Counts of several passes, added by key."""
    keys, table = np.concatenate([k for k, _ in found]), np.concatenate([t for _, t in found])
    order = np.argsort(keys, kind="stable")
    keys, table = keys[order], table[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if keys.size else np.empty(0, np.int64)
    return keys[first], np.add.reduceat(table, first) if keys.size else table


def key_of(gram: str) -> int:
    out = 0
    for c in gram:
        out = out << BITS | (ord(c) + 1)
    return out


def gram_of(key: int) -> str:
    out = ""
    while key:
        out, key = chr((key & (1 << BITS) - 1) - 1) + out, key >> BITS
    return out


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches cut so that one numpy pass takes about ``PASS_CHARS`` characters; a longer text stands alone."""
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.utf8_length(batch.column("low")), 0).to_numpy(zero_copy_only=False))
        start = 0
        while start < batch.num_rows:
            stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + PASS_CHARS, "right")))
            yield batch.slice(start, stop - start)
            start = stop


def gram_counts(df: DataFrame, languages: list[str], longest: int = 3) -> DataFrame:
    """``(gram, n_<language> ..)``: grams are counted per task before anything is shuffled, and never listed."""
    names, kinds = [f"n_{code}" for code in languages], len(languages) + 1

    def rows(keys: np.ndarray, table: np.ndarray) -> pa.RecordBatch:
        grams = pa.array([gram_of(k) for k in keys.tolist()], pa.string())
        return pa.RecordBatch.from_arrays([grams, *[pa.array(table[:, j], pa.int64()) for j in range(kinds - 1)]], ["gram", *names])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, held = [], 0
        for batch in _pieces(batches):
            codes = pc.fill_null(pc.index_in(batch.column("lang"), pa.array(languages, pa.string())), kinds - 1).to_numpy(zero_copy_only=False)
            found.append(pass_counts(batch.column("low"), codes, kinds, longest))
            held += found[-1][0].size
            if held >= 2 * HELD_KINDS:
                found = [merged_counts(found)]
                held = found[0][0].size
                if held >= HELD_KINDS:
                    yield rows(*found[0])
                    found, held = [], 0
        if found:
            yield rows(*merged_counts(found))

    lows = df.select("lang", F.lower("text").alias("low"))
    found = lows.mapInArrow(count, ", ".join(["gram string", *[f"{n} bigint" for n in names]]))
    return found.groupBy("gram").agg(*[F.sum(n).alias(n) for n in names])


def train_languages(df: DataFrame, languages: list[str], longest: int = 3) -> DataFrame:
    """``(gram, n, weights)``: its count, and per language the add-one log probability in millionths.

    Whole numbers make the later sums exact in any order.
    """
    counts = frozen(gram_counts(df, languages, longest))
    kinds, *sizes = counts.agg(F.count(F.lit(1)), *[F.sum(f"n_{code}") for code in languages]).first()
    weight = [
        F.round(F.log((F.col(f"n_{code}") + 1) / F.lit(float((size or 0) + kinds))) * SCALE).cast("bigint")
        for code, size in zip(languages, sizes)
    ]
    everywhere = sum((F.col(f"n_{code}") for code in languages[1:]), F.col(f"n_{languages[0]}"))
    return counts.select("gram", everywhere.alias("n"), F.array(*weight).alias("weights"))


def predict_languages(
    df: DataFrame, key: str, model: DataFrame, languages: list[str], longest: int = 3, limit: int = MODEL_LIMIT, keep: list[str] = (),
) -> DataFrame:
    """``(key, lang, score)`` and the columns ``keep`` of every row: the language with the best summed weight, ties by name.

    One pass, no shuffle: grams meet the model's weights as sorted keys in each worker. Unknown grams and texts without any
    weigh nothing. A model beyond ``limit`` grams is held in parts, whose sums follow each other over the same rows.
    """
    order = sorted(languages)
    names = [f"s_{c}" for c in order]
    parts = max(1, -(-model.count() // limit))
    stay = [key, *keep]
    sums = df.select(*stay, F.lower("text").alias("low"), *[F.lit(0).cast("bigint").alias(n) for n in names])
    for part in range(parts):
        some = model.filter(F.pmod(F.xxhash64("gram"), F.lit(parts)) == part).select("gram", "weights").collect()
        rows = sorted((key_of(r["gram"]), [r["weights"][languages.index(c)] for c in order]) for r in some)
        held = df.sparkSession.sparkContext.broadcast((
            np.array([k for k, _ in rows], np.uint64), np.array([w for _, w in rows], np.int64).reshape(len(rows), len(order))
        ))
        left = sums if part + 1 < parts else sums.drop("low")
        sums = sums.mapInArrow(_adding(held, names, left.columns, longest), left.schema)
    best = F.greatest(*names) if len(order) > 1 else F.col(names[0])
    name = F.coalesce(*[F.when(F.col(n) == best, F.lit(c)) for n, c in zip(names, order)])
    return sums.select(key, name.alias("lang"), best.alias("score"), *keep)


def _adding(held, names: list[str], left: list[str], longest: int):
    """Adds a part of the model's weights to the sums of each row."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, weights = held.value
        # A gram without weights meets a last row of zeros.
        columns = [np.append(weights[:, j], 0) for j in range(len(names))]
        chars = np.concatenate([(known >> np.uint64(BITS * i)) & np.uint64((1 << BITS) - 1) for i in range(longest)])
        letters = frequent(chars[chars > 0].astype(np.int64) - 1, CELLS, longest) if known.size else None
        tables = []
        for n in range(1, longest + 1) if known.size else ():
            keys = letters.keys(np.arange(letters.size**n), n)
            at = np.minimum(np.searchsorted(known, keys), known.size - 1)
            tables.append(np.where(known[at] == keys, at, known.size).astype(np.int32))
        for batch in _pieces(batches):
            added = np.zeros((batch.num_rows, len(names)), np.int64)
            if known.size:
                points, row = code_points(batch.column("low"))
                begins = np.searchsorted(row, np.arange(batch.num_rows + 1))
                for n, number, plain, key, other in letters.grams(points, row, longest):
                    met = np.full(points.size, known.size, np.int32)
                    met[plain] = tables[n - 1][number]
                    at = np.minimum(np.searchsorted(known, key), known.size - 1)
                    met[other] = np.where(known[at] == key, at, known.size)
                    for j, column in enumerate(columns):
                        before = np.concatenate([[0], np.cumsum(column[met])])
                        added[:, j] += before[begins[1:]] - before[begins[:-1]]
            sums = {n: pa.array(batch.column(n).to_numpy() + added[:, j]) for j, n in enumerate(names)}
            yield pa.RecordBatch.from_arrays([sums[c] if c in sums else batch.column(c) for c in left], left)

    return work
