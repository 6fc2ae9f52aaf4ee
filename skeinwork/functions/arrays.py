"""Expressions over id, label and score arrays."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once per row.

    The optimizer may inline a column into a lambda that uses it, which then computes it again for
    every element. A lambda variable is a value already.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def literal_array(values: list, element: str) -> Column:
    """A constant array; folded once while planning."""
    return F.from_json(F.lit(json.dumps(values)), f"array<{element}>")


def fit(values: Column, length: int, fill) -> Column:
    """Cut or fill an array to exactly ``length``."""
    return F.slice(F.concat(values, F.array_repeat(F.lit(fill), length)), 1, length)


def fill_to(values: Column, length: Column, fill) -> Column:
    """Fill an array up to ``length``; longer arrays stay whole."""
    missing = F.greatest(length - F.size(values), F.lit(0)).cast("int")
    return F.concat(values, F.array_repeat(F.lit(fill), missing))


def attention(real: Column, length: int) -> Column:
    """``real`` ones followed by zeros, ``length`` in all."""
    ones = F.least(real, F.lit(length)).cast("int")
    return F.concat(F.array_repeat(F.lit(1), ones), F.array_repeat(F.lit(0), F.lit(length) - ones))


def argmax(scores: Column) -> Column:
    """Index of the first maximum."""
    return (F.array_position(scores, F.array_max(scores)) - 1).cast("int")


def threshold(scores: Column, at: float = 0.5) -> Column:
    """1 where the score reaches ``at``, else 0."""
    return F.transform(scores, lambda x: (x >= F.lit(at)).cast("int"))


def top_k(scores: Column, k: int) -> Column:
    """The ``k`` best ``(rank, candidate, score)``; equal scores in candidate order."""
    ordered = F.sort_array(F.transform(scores, lambda s, i: F.struct((-s).alias("minus"), i.alias("candidate"))))
    return F.transform(
        F.slice(ordered, 1, k),
        lambda x, i: F.struct(
            (i + 1).alias("rank"), x["candidate"].alias("candidate"), (-x["minus"]).alias("score")
        ),
    )


def gather_concat(vectors: Column, *positions: Column) -> Column:
    """Vectors at the given zero-based positions, one after the other."""
    return F.concat(*[F.get(vectors, p) for p in positions])


def cuts(sizes: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """First row and number of rows of parts of about ``most`` in size; a larger row stands alone."""
    ends, start = np.cumsum(sizes), 0
    while start < ends.size:
        stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + most, "right")))
        yield start, stop - start
        start = stop


def lengths(column: pa.Array) -> np.ndarray:
    """Elements of each array, or bytes of each text, of a column; 0 where it is missing."""
    measure = pc.list_value_length if pa.types.is_list(column.type) else pc.binary_length
    return pc.fill_null(measure(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def passes(column: pa.Array, most: int) -> Iterator[pa.Array]:
    """A column in parts of about ``most`` elements or bytes."""
    return (column.slice(*part) for part in cuts(lengths(column), most))
