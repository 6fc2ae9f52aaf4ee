"""Per-token and whole-word masking of id arrays, and the masked share."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skeinwork.functions.arrays import cuts, lengths, let
from skeinwork.functions.draws import below, digests, position_draw, prefix

# Ids of the special tokens.
PAD, UNK, CLS, SEP, MASK = 0, 1, 2, 3, 4
# Ids that one pass of whole-word masking takes: what a worker holds does not grow with its batches.
PASS_IDS = 500_000


def mask_tokens(df: DataFrame, key: str, seed: int, ids: str = "input_ids", probability: float = 0.15) -> DataFrame:
    """Each id above 4 becomes the mask id with this probability; ``labels`` keeps the ids as they were."""
    bound = below(probability)
    masked = let(
        digests(seed, F.col(key), F.size(ids)),
        lambda d: F.transform(
            F.col(ids), lambda x, i: F.when((x > MASK) & (position_draw(d, i) < bound), F.lit(MASK)).otherwise(x)
        ),
    )
    return df.withColumns({"labels": F.col(ids), ids: masked})


def budget(size: Column, probability: float = 0.15, most: int = 80) -> Column:
    """Number of positions to mask in ``size`` ids; rounds half to even."""
    wanted = F.bround(size * F.lit(float(probability)), 0).cast("int")
    return F.least(F.lit(most), F.greatest(F.lit(1), wanted))


class _Row(NamedTuple):
    """What a row's masking is drawn from: digest prefixes of the order and of the pieces, ids to mask at most."""

    order: str
    piece: str
    cap: int


def _free(ids: np.ndarray, skip_padding: bool) -> np.ndarray:
    """Which ids may be masked: all but boundary ids."""
    return ~np.isin(ids, [CLS, SEP, PAD] if skip_padding else [CLS, SEP])


def _heads(ids: np.ndarray, rows: np.ndarray, continues: np.ndarray) -> np.ndarray:
    """Which candidates begin a word; a continuation piece belongs to the word before, if its row has one."""
    known = (ids >= 0) & (ids < continues.size)
    goes_on = np.zeros(ids.size, bool)
    goes_on[known] = continues[ids[known]]
    goes_on[1:] &= rows[1:] == rows[:-1]
    goes_on[:1] = False
    return ~goes_on


def _order_draws(prefix: str, size: int) -> bytes:
    """Draws of ``size`` positions as in ``digests``: eight of four bytes each from one digest."""
    start = f"{prefix}:".encode()
    return b"".join([hashlib.sha256(b"%b%d" % (start, block)).digest() for block in range(-(-size // 8))])


def _replaced(old: np.ndarray, pieces: list[bytes], places: list[int], size: int, bounds: tuple[str, str]) -> np.ndarray:
    """What chosen ids become by the draws of their row's prefix and place; draws and bounds compare as text."""
    spelled = "".join([hashlib.sha256(b"%b%d" % drawn).hexdigest() for drawn in zip(pieces, places, strict=True)])
    draws = np.frombuffer(spelled.encode(), "S8").reshape(-1, 8)
    mask_below, same_below = (bound.encode() for bound in bounds)
    masked, other = draws[:, 0] < mask_below, draws[:, 1] >= same_below
    new = np.where(masked, MASK, old)
    other &= ~masked
    new[other] = [int(text, 16) % size for text in draws[other, 2].tolist()]
    return new


def _taken(words: list[int], sizes: list[int], cap: int) -> list[int]:
    """Words in drawn order, each taken while it still fits."""
    n, out = 0, []
    for word, size in zip(words, sizes, strict=True):
        if n + size <= cap:
            n += size
            out.append(word)
            if n == cap:
                break
    return out


def _masked_lists(lists: pa.Array, rows: list[_Row], continues: np.ndarray, skip_padding: bool, bounds: tuple[str, str]) -> pa.Array:
    """A column of id arrays with the words of each row's draws masked; missing arrays and ids stay missing."""
    counts = lengths(lists)
    ends = np.concatenate([[0], np.cumsum(counts)])
    flat = lists.flatten()
    missing = flat.is_null().to_numpy(zero_copy_only=False)
    ids = pc.fill_null(flat, 0).to_numpy(zero_copy_only=False).copy()

    at = np.flatnonzero(_free(ids, skip_padding) & ~missing)
    row = np.repeat(np.arange(len(rows)), counts)[at]
    heads = np.flatnonzero(_heads(ids[at], row, continues))
    sizes = np.diff(np.append(heads, at.size))
    draws = np.frombuffer(b"".join(_order_draws(r.order, int(n)) for r, n in zip(rows, counts, strict=True)), ">u4")
    blocks = np.cumsum(-(-counts // 8)) - -(-counts // 8)
    of = row[heads]
    drawn = draws[blocks[of] * 8 + at[heads] - ends[of]].astype(np.int64)
    order = np.argsort((of << 32) | drawn, kind="stable")
    first = np.searchsorted(of, np.arange(len(rows) + 1))

    chosen, pieces = [], []
    for i, (_, piece, cap) in enumerate(rows):
        words = order[first[i] : first[i + 1]]
        taken = _taken(words.tolist(), sizes[words].tolist(), cap)
        chosen += taken
        pieces += [f"{piece}:".encode()] * sum(sizes[taken].tolist())
    many = sizes[chosen]
    where = at[np.repeat(heads[chosen], many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)]
    ids[where] = _replaced(ids[where], pieces, (where - np.repeat(ends[of[chosen]], many)).tolist(), continues.size, bounds)
    values = pa.array(ids, flat.type, mask=missing)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values, mask=lists.is_null())


def mask_whole_words(
    df: DataFrame,
    key: str,
    seed: int,
    continues: list[bool],
    ids: str = "input_ids",
    probability: float = 0.15,
    most: int = 80,
    skip_padding: bool = False,
) -> DataFrame:
    """Whole words are taken in a drawn order while they fit the budget; of their pieces 80 % become
    the mask id, 10 % stay and 10 % become any vocabulary id. ``labels`` keeps the ids as they were.

    ``continues[id]`` tells whether a vocabulary id is a ``##`` piece. Rows are masked where they lie,
    ``PASS_IDS`` ids at a time: no shuffle, the same in a stream and in a batch.
    """
    flags, bounds = np.array(continues, bool), (below(0.8), below(0.5))
    held = df.sparkSession.sparkContext.broadcast(flags)

    @F.arrow_udf(df.schema[ids].dataType)
    def masked(lists: Iterator[tuple[pa.Array, pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for column, *drawn in lists:
            rows = list(map(_Row, *(part.to_pylist() for part in drawn)))
            done = [
                _masked_lists(column.slice(start, n), rows[start : start + n], held.value, skip_padding, bounds)
                for start, n in cuts(lengths(column), PASS_IDS)
            ]
            yield pa.concat_arrays(done) if done else column

    drawn = prefix(f"{seed}:order", F.col(key)), prefix(f"{seed}:piece", F.col(key)), budget(F.size(ids), probability, most)
    return df.withColumns({"labels": F.col(ids), ids: masked(F.col(ids), *drawn)})


def masked_share(df: DataFrame, ids: str = "input_ids", labels: str = "labels", by: list[str] = ()) -> DataFrame:
    """Mask ids in the input over non-mask ids in the labels; NULL where there are none."""
    masked = F.sum(F.size(F.filter(ids, lambda x: x == MASK)).cast("bigint"))
    others = F.sum(F.size(F.filter(labels, lambda x: x != MASK)).cast("bigint"))
    return df.groupBy(*by).agg(masked.alias("masked"), others.alias("others")).withColumn(
        "share", F.try_divide("masked", "others")
    )
