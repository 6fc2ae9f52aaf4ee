"""Entity-tagging rows: encoded sentences with one label per position."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skeinwork.functions import arrays
from skeinwork.functions.arrays import let
from skeinwork.functions.text import words
from skeinwork.operators.labelled import first_label_ids, labels_on_pieces, padded_labels, with_label_ids
from skeinwork.operators.masking import PAD
from skeinwork.operators.order import null_safe_join
from skeinwork.operators.wordpiece import cut_words, template

# Sequence length and the class of positions without a word.
LENGTH, PAD_LABEL = 200, 4


def _first_only(label_ids: Column, owners: Column, pad_label: int) -> Column:
    """Per pre-token the label of its word if it is the word's first, else the padding label."""
    return F.transform(
        owners,
        lambda w, t: F.when((t == 0) | (F.get(owners, t - 1) != w), F.get(label_ids, w)).otherwise(F.lit(pad_label)),
    )


def entity_rows(
    tokens: DataFrame, index: DataFrame, vocab: DataFrame, length: int = LENGTH, pad_label: int = PAD_LABEL,
    align: str = "word",
) -> DataFrame:
    """``(id, input_ids, attention_mask, labels)`` of length ``length`` from ``(id, pos, word, label)``.

    ``align='word'`` lays word labels out one after the other, as if every word were one piece;
    ``align='first_piece'`` puts each label on the first piece of its word.
    """
    known = with_label_ids(tokens, index)
    grouped = known.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("pos", "word", "label_id"))).alias("_t"))
    rows = grouped.select("id", F.col("_t.word").alias("_words"), F.col("_t.label_id").alias("_labels"))
    if align == "word":
        placed = padded_labels(F.col("_labels"), length, pad_label)
        listed = rows.select("id", F.slice(words(F.array_join("_words", " ")), 1, length).alias("w"), placed.alias("l"))
    else:
        parts = F.transform("_words", lambda w: words(w))
        owners = let(
            parts, lambda p: F.flatten(F.transform(p, lambda pre, i: F.array_repeat(i, F.size(pre))))
        )
        per_token = let(owners, lambda o: _first_only(F.col("_labels"), o, pad_label))
        listed = rows.select(
            "id", F.slice(F.flatten(parts), 1, length).alias("w"), F.slice(per_token, 1, length).alias("l")
        )
    return _encoded(listed, vocab, length, pad_label, align)


def block_entity_rows(
    blocks: DataFrame, index: DataFrame, vocab: DataFrame, length: int = LENGTH, pad_label: int = PAD_LABEL,
) -> DataFrame:
    """``entity_rows`` with ``align='word'`` of ``span_blocks``: a piece moves no more labels and pre-tokens of its own than the
    ``length`` that can reach the output."""
    labels = first_label_ids(blocks, index, length)
    # Pre-tokens hold no space, so they move as one text. An empty text has none but stands for a word: both sides hold every document.
    parts = blocks.select("id", "pos", F.array_join(F.slice(words(F.col("text")), 1, length), " ").alias("_w"))
    grouped = parts.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("pos", "_w"))).alias("_t"))
    listed = F.filter(F.split(F.array_join("_t._w", " "), " "), lambda w: w != "")
    rows = grouped.select("id", F.slice(listed, 1, length).alias("w"))
    listed = null_safe_join(rows, labels.select("id", padded_labels(F.col("label_ids"), length, pad_label).alias("l")), ["id"])
    return _encoded(listed, vocab, length, pad_label, "word")


def _encoded(listed: DataFrame, vocab: DataFrame, length: int, pad_label: int, align: str) -> DataFrame:
    both = cut_words(listed, ["w"], vocab).withColumn("_ids", template(F.col("w_ids"), length))
    labels = F.col("l") if align == "word" else labels_on_pieces(F.col("l"), F.col("w_sizes"), length, pad_label)
    return both.select(
        "id",
        arrays.fit(F.col("_ids"), length, PAD).alias("input_ids"),
        arrays.attention(F.size("_ids"), length).alias("attention_mask"),
        labels.alias("labels"),
    )
