"""Candidates of a masked position from the neighbours that words have in a corpus, and the filled sequences."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skeinwork.functions.arrays import let
from skeinwork.operators.metrics import top_candidates
from skeinwork.operators.vocab import counted
from skeinwork.session import broadcast_checked, frozen, stored

# What a candidate keeps of its share where only its left neighbour, or none, is asked for.
BACK_OFF = 0.4
CONTEXT_LIMIT = 200_000
# Numbers that contexts are dealt to.
CELLS = 1 << 23


def _beside(words: str | Column, at: Column, step: int) -> Column:
    """The word beside a position; the empty word at either end."""
    return F.coalesce(F.get(words, at + step), F.lit(""))


def places(corpus: DataFrame, words: str = "w") -> DataFrame:
    """``(l, r, w)``: each word with the words beside it."""
    placed = let(
        F.col(words),
        lambda a: F.transform(
            a, lambda w, i: F.struct(_beside(a, i, -1).alias("l"), _beside(a, i, 1).alias("r"), w.alias("w"))
        ),
    )
    return corpus.select(F.explode_outer(placed).alias("p")).filter(F.col("p").isNotNull()).select("p.*")


def neighbour_counts(corpus: DataFrame, asked: DataFrame, words: str = "w") -> DataFrame:
    """``(*context, w, n)``: how often each word stands beside the contexts ``asked`` for, which are distinct rows of ``l``, or ``l``
    and ``r``; counted in the map task before the shuffle.

    What is not asked for goes before that too: a context has one of ``CELLS`` numbers, and the numbers asked for are broadcast.
    """
    context = asked.columns
    cell = F.pmod(F.xxhash64(*context), F.lit(CELLS)).alias("_cell")
    some = places(corpus, words).select(*context, "w", cell).join(F.broadcast(asked.select(cell).distinct()), "_cell", "left_semi")
    counts = some.groupBy(*context, "w").agg(F.count(F.lit(1)).alias("n"))
    return counts.join(broadcast_checked(asked, CONTEXT_LIMIT), context, "left_semi")


def _best(counts: DataFrame, context: list[str], weight: float, k: int) -> DataFrame:
    """``(*context, found)``: the ``k`` most frequent words of each context with their weighted shares."""
    known = stored(counts, "counts").withColumn("_context", F.struct(*[F.col(c) for c in context]) if context else F.lit(0))
    totals = known.groupBy("_context").agg(F.sum("n").alias("_total"))
    best = top_candidates(known.select("_context", "w", "n"), "_context", "w", "n", k)
    shares = best.join(totals, "_context").withColumn("score", F.lit(weight) * F.col("n") / F.col("_total"))
    lists = shares.groupBy("_context").agg(F.collect_list(F.struct("w", "score")).alias("found"))
    return lists.select(*[F.col(f"_context.{c}").alias(c) for c in context], "found")


def fill_masked(masked: DataFrame, key: str, corpus: DataFrame, k: int = 5, words: str = "w", at: str = "at") -> DataFrame:
    """``(key, rank, candidate, score, sequence)``: the ``k`` best words for one position of each text, put in its place.

    A candidate's score is the greatest of its share between both neighbours, ``BACK_OFF`` times its share after the left one,
    and ``BACK_OFF`` squared times its share of all words; ties by word. So the best of all are among the best of each, and only
    ``k`` rows of a context leave a task. ``key`` is unique; ``at`` counts from 0, and a position outside the text fills nothing.
    """
    asked = masked.filter((F.col(at) >= 0) & (F.col(at) < F.size(words))).select(
        key, words, at, _beside(words, F.col(at), -1).alias("l"), _beside(words, F.col(at), 1).alias("r")
    )
    contexts = frozen(asked.select("l", "r").distinct())
    between = neighbour_counts(corpus, contexts, words)
    after = neighbour_counts(corpus, frozen(contexts.select("l").distinct()), words)
    overall = counted(corpus, F.col(words)).withColumnRenamed("word", "w")
    lists = [_best(between, ["l", "r"], 1.0, k), _best(after, ["l"], BACK_OFF, k)]
    common = _best(overall, [], BACK_OFF**2, k).first()
    everywhere = F.array(*[F.struct(F.lit(w).alias("w"), F.lit(s).alias("score")) for w, s in (common["found"] if common else [])])
    joined = reduce(
        lambda rows, part: rows.join(broadcast_checked(part[1].withColumnRenamed("found", part[0]), CONTEXT_LIMIT), [c for c in ("l", "r") if c in part[1].columns], "left"),
        zip(("_both", "_left"), lists), asked,
    )
    none = F.array().cast("array<struct<w:string,score:double>>")
    found = F.concat(F.coalesce("_both", none), F.coalesce("_left", none), everywhere.cast("array<struct<w:string,score:double>>"))
    each = joined.select(key, F.explode(found).alias("c")).groupBy(key, F.col("c.w").alias("candidate")).agg(F.max("c.score").alias("score"))
    best = top_candidates(each, key, "candidate", "score", k)
    filled = F.concat(F.slice(words, 1, F.col(at)), F.array("candidate"), F.slice(words, F.col(at) + 2, F.size(words)))
    return best.join(asked.select(key, words, at), key).select(key, "rank", "candidate", "score", F.array_join(filled, " ").alias("sequence"))
