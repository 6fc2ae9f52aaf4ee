"""Relation text with ``<< >>`` around the subject and ``[[ ]]`` around the object."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from skeinwork.functions.arrays import let

# Markers in the order in which a word is tested for them.
MARKERS = ["<<", ">>", "[[", "]]"]
# The shift that turns a marker's word index into the entity's.
SHIFTS = {"ss": ("<<", 1), "se": (">>", -1), "os": ("[[", 1), "oe": ("]]", -1)}


def token_span(text: Column) -> Column:
    """``struct(ss, se, os, oe)`` of word indices; null where a marker is missing.

    A word counts for the first marker it holds; of several such words the last wins.
    """
    tokens = F.split(text, " ")
    first_marker = F.transform(
        tokens, lambda w: F.coalesce(*[F.when(w.contains(m), F.lit(m)) for m in MARKERS], F.lit(""))
    )

    def index(backwards: Column, name: str) -> Column:
        marker, shift = SHIFTS[name]
        found = F.array_position(backwards, marker)
        return F.when(found > 0, (F.size(backwards) - found + shift).cast("int")).alias(name)

    return let(F.reverse(first_marker), lambda b: F.struct(*[index(b, name) for name in SHIFTS]))


def _between(text: Column, opening: str, closing: str, skip: int) -> Column:
    """``text[find(opening)+skip : find(closing)]`` where both exist, else null."""
    start = F.instr(text, opening)
    end = F.instr(text, closing)
    length = F.greatest(end - start - skip, F.lit(0))
    return F.when((start > 0) & (end > 0), F.substr(text, start + skip, length))


def substring_span(text: Column, obj_skip: int = 12) -> Column:
    """``struct(subj, obj)``; ``obj_skip=2`` keeps the whole object."""
    return F.struct(
        _between(text, "<<", ">>", 2).alias("subj"), _between(text, "[[", "]]", obj_skip).alias("obj")
    )


def second_segment(subj: Column, obj: Column) -> Column:
    return F.concat_ws(" ", subj, obj)
